"""Directory rollups over ancestor closures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Content states that count in each bucket.
BUCKETS = {"pending": ("pending", "stale"), "indexed": ("indexed", "partial"), "failed": ("failed",), "excluded": ("excluded",)}


def is_directory(kind: Column = None) -> Column:
    return (F.col("kind") if kind is None else kind).isin("directory", "virtual_directory")


def _sums(entries: DataFrame) -> DataFrame:
    """(source_id, dir_id, ...) of directories that have entries below them.

    Every entry is sent to its ancestors; sums are combined before the shuffle, so the rows that move
    are one for each directory and task."""
    file = ~is_directory()
    below = entries.withColumn("dir_id", F.explode("ancestors"))
    one = lambda test: F.sum(F.when(test, 1).otherwise(0))
    return below.groupBy("source_id", "dir_id").agg(
        one(file).alias("file_count"), one(~file).alias("dir_count"),
        F.sum(F.when(file, F.col("size")).otherwise(0)).alias("subtree_logical"), F.sum(F.when(file, F.col("allocated")).otherwise(0)).alias("subtree_allocated"),
        F.max(F.when(file, F.col("modified"))).alias("newest_modified"), F.min(F.when(file, F.col("modified"))).alias("oldest_modified"),
        *(one(file & F.col("content_state").isin(*states)).alias(f"{name}_count") for name, states in BUCKETS.items()),
        F.min(F.when(~file, F.col("listed")).otherwise(True)).alias("_complete"),
    )


def subtree_rollup(entries: DataFrame) -> DataFrame:
    """One row for each directory: counts, bytes and extrema over all entries below it. Directories without entries below are kept with zeros."""
    sums = _sums(entries)
    dirs = entries.where(is_directory()).select("source_id", F.col("object_id").alias("dir_id"), "listed")
    zero = [c for c in sums.columns if c.endswith("_count") or c.startswith("subtree_")]
    return dirs.join(sums, ["source_id", "dir_id"], "left").select("source_id", "dir_id", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) if c in zero else F.col(c) for c in sums.columns[2:-1]), (F.col("listed") & F.coalesce("_complete", F.lit(True))).alias("complete"))


def extension_counts(entries: DataFrame) -> DataFrame:
    """(source_id, dir_id, extension, files, bytes) over the files below each directory."""
    below = entries.where(~is_directory()).select("source_id", F.explode("ancestors").alias("dir_id"), "extension", "size")
    return below.groupBy("source_id", "dir_id", "extension").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))


def extension_maps(counts: DataFrame) -> DataFrame:
    """(source_id, dir_id, extension_counts map)."""
    return counts.groupBy("source_id", "dir_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("extension", "files")))).alias("extension_counts"))


def rollup_deltas(changes: DataFrame) -> DataFrame:
    """Additive parts of changed entries (with sign +1 or -1) by directory."""
    below = changes.where(~is_directory()).select("source_id", F.explode("ancestors").alias("dir_id"), "sign", "size", "allocated", "content_state")
    return below.groupBy("source_id", "dir_id").agg(
        F.sum("sign").alias("file_count"), F.sum(F.col("sign") * F.col("size")).alias("subtree_logical"), F.sum(F.col("sign") * F.col("allocated")).alias("subtree_allocated"),
        *(F.sum(F.when(F.col("content_state").isin(*s), F.col("sign")).otherwise(0)).alias(f"{n}_count") for n, s in BUCKETS.items()),
    )


def apply_deltas(rollup: DataFrame, deltas: DataFrame, entries: DataFrame) -> DataFrame:
    """The rollup after additive deltas; extrema, which can't be taken back, are taken anew for the touched directories only."""
    added = [c for c in deltas.columns if c not in ("source_id", "dir_id")]
    d = deltas.select("source_id", "dir_id", *(F.col(c).alias(f"d_{c}") for c in added), F.lit(True).alias("_touched"))
    new = rollup.join(d, ["source_id", "dir_id"], "left")
    for c in added:
        new = new.withColumn(c, F.col(c) + F.coalesce(f"d_{c}", F.lit(0)))
    # extrema of each task come before the join: all files are below the root, and their rows would meet in one task
    below = entries.where(~is_directory()).select("source_id", F.explode("ancestors").alias("dir_id"), "modified")
    fresh = below.groupBy("source_id", "dir_id").agg(F.max("modified").alias("_new"), F.min("modified").alias("_old"))
    new = new.join(fresh, ["source_id", "dir_id"], "left")
    touched = F.coalesce("_touched", F.lit(False))
    new = new.withColumn("newest_modified", F.when(touched, F.col("_new")).otherwise(F.col("newest_modified"))).withColumn("oldest_modified", F.when(touched, F.col("_old")).otherwise(F.col("oldest_modified")))
    return new.select(rollup.columns)


def entry_documents(entries: DataFrame) -> DataFrame:
    """The wide table that search scans: entries with folded names, their rollups and extension counts. Missing times are 0. Only directories have
    rollups, so files go through no join; a query that asks for no rollup leaves the joins out."""
    directory = F.coalesce(is_directory(), F.lit(False))
    kept = ("file_count", "dir_count", "subtree_logical", "subtree_allocated", "newest_modified")
    sums = _sums(entries).select("source_id", F.col("dir_id").alias("object_id"), *(F.col(c).alias(f"_{c}") for c in kept))
    maps = extension_maps(extension_counts(entries)).withColumnRenamed("dir_id", "object_id")
    docs = entries.where(directory).join(sums, ["source_id", "object_id"], "left").join(maps, ["source_id", "object_id"], "left")
    docs = docs.withColumns({
        **{c: F.coalesce(f"_{c}", F.lit(0)).cast("long") for c in kept},
        "modified": F.coalesce("modified", F.lit(0)), "created": F.coalesce("created", F.lit(0)),
        "name_folded": F.lower("name"), "path_folded": F.lower("path"),
    })
    return docs.drop(*(f"_{c}" for c in kept)).unionByName(file_documents(entries.where(~directory)))


def file_documents(entries: DataFrame) -> DataFrame:
    """entry_documents() of a catalog of files only: no rollups, no shuffle."""
    return entries.withColumns({
        "subtree_logical": F.col("size"), "subtree_allocated": F.col("allocated"), "newest_modified": F.coalesce("modified", F.lit(0)), "file_count": F.lit(0).cast("long"), "dir_count": F.lit(0).cast("long"),
        "modified": F.coalesce("modified", F.lit(0)), "created": F.coalesce("created", F.lit(0)), "name_folded": F.lower("name"), "path_folded": F.lower("path"), "extension_counts": F.lit(None).cast("map<string,bigint>"),
    })
