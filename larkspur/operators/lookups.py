"""Lookups over catalog tables: sources and volumes, objects, chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Objects that a sample of chunks takes: one in so many.
SAMPLE = 97


def ids_of(spark: SparkSession, ids: list[int], name: str = "object_id") -> DataFrame:
    """A list of ids as a table; lists of a request are short, so it may be broadcast."""
    return F.broadcast(spark.createDataFrame([(i,) for i in sorted(set(ids))], f"{name} long"))


def sources_listed(sources: DataFrame, name: str | None = None) -> DataFrame:
    """Sources in order of id, or those of a name."""
    return (sources if name is None else sources.where(F.col("name") == name)).orderBy("source_id")


def hosts_listed(hosts: DataFrame, name: str | None = None) -> DataFrame:
    """Hosts in order of id, or those of a name; a display name may carry the host's key as name#<32 hex digits>."""
    if name is None:
        return hosts.orderBy("host_id")
    shown = F.concat_ws("#", "name", F.lower("host_key")) if "host_key" in hosts.columns else F.col("name")
    return hosts.where((F.lower("name") == name.lower()) | (F.lower(shown) == name.lower())).orderBy("host_id")


def with_volumes(sources: DataFrame, volumes: DataFrame) -> DataFrame:
    """Sources with case_sensitive: remote sources say it themselves, others by their volume; unknown is insensitive. Both tables are small."""
    v = volumes.select("volume_id", F.col("case_sensitive").alias("_volume_case"))
    own = F.col("case_sensitive") if "case_sensitive" in sources.columns else F.lit(None).cast("boolean")
    case = F.coalesce(F.when(F.col("kind") == "remote", own).otherwise(F.col("_volume_case")), F.lit(False))
    return sources.join(v, "volume_id", "left").withColumn("case_sensitive", case).drop("_volume_case")


def entries_of(entries: DataFrame, object_id: int) -> DataFrame:
    """All names of an object (hard links), in order."""
    return entries.where(F.col("object_id") == object_id).orderBy("entry_id")


def generations_of(objects: DataFrame, ids: list[int]) -> DataFrame:
    """object_id, generation of those of the ids that are live."""
    return objects.join(ids_of(objects.sparkSession, ids), "object_id").select("object_id", "generation")


def current_chunks(records: DataFrame, chunks: DataFrame) -> DataFrame:
    """Chunks of indexed records, for a rebuild: those of the record's generation, in order."""
    known = records.where(F.col("state").isin("indexed", "partial", "indexing")).select("object_id", "generation")
    return chunks.join(known, ["object_id", "generation"], "left_semi").orderBy("object_id", "ordinal")


def chunks_for(chunks: DataFrame, keys: list[tuple[int, int, int]]) -> DataFrame:
    """Chunks by (object_id, generation, ordinal)."""
    wanted = chunks.sparkSession.createDataFrame(sorted(set(keys)), "object_id long, generation long, ordinal int")
    return chunks.join(F.broadcast(wanted), ["object_id", "generation", "ordinal"], "left_semi")  # as long as the request


def chunks_range(chunks: DataFrame, object_id: int, generation: int, first: int, last: int) -> DataFrame:
    """Chunks of an object from one ordinal to another."""
    same = (F.col("object_id") == object_id) & (F.col("generation") == generation)
    return chunks.where(same & F.col("ordinal").between(first, last)).orderBy("ordinal")


def chunks_sampled(chunks: DataFrame) -> DataFrame:
    """The fixed sample of objects by which an index is checked."""
    return chunks.where(F.col("object_id") % SAMPLE == 0)


def light_counts(rollup: DataFrame, roots: DataFrame) -> DataFrame:
    """Counts of sources from their root's rollup: source_id, files, directories, bytes. roots: source_id, dir_id."""
    counted = rollup.join(roots, ["source_id", "dir_id"], "left_semi")
    return counted.select("source_id", F.col("file_count").alias("files"), F.col("dir_count").alias("directories"), F.col("subtree_logical").alias("bytes"))


def top_extensions(counts: DataFrame, most: int = 8) -> DataFrame:
    """source_id, dir_id, extension_counts: a map of the most frequent extensions of each directory."""
    pairs = F.sort_array(F.collect_list(F.struct((-F.col("files")).alias("n"), "extension")))
    best = counts.groupBy("source_id", "dir_id").agg(F.slice(pairs, 1, most).alias("best"))
    return best.select("source_id", "dir_id", F.map_from_entries(F.transform("best", lambda b: F.struct(b["extension"], (-b["n"]).alias("files")))).alias("extension_counts"))


def descendants(entries: DataFrame, object_id: int) -> DataFrame:
    return entries.where(F.array_contains("ancestors", object_id))


def ancestors(entries: DataFrame, object_id: int) -> DataFrame:
    """The directories above an object, nearest first."""
    above = entries.where(F.col("object_id") == object_id).select(F.posexplode(F.reverse("ancestors")).alias("depth", "object_id"))
    # as many rows as the path has names
    return entries.join(F.broadcast(above), "object_id").orderBy("depth")
