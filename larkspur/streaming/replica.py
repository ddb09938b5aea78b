"""Applying a source's ledger on a replica: id map, batches, epochs, repair by leaves."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.streaming import ledger

MOST_ROWS = 100_000


def mapped(batch: DataFrame, ids: DataFrame, base: int) -> tuple[DataFrame, DataFrame]:
    """batch with local ids, and the id map with those that are new: ids are given in order of the remote id, from base on."""
    known = batch.join(ids, ["source_id", "remote_object"], "left")
    new = known.where(F.col("local_object").isNull()).select("source_id", F.col("remote_object").alias("object_id")).distinct()
    fresh = ledger.minted(new, base).select("source_id", F.col("object_id").alias("remote_object"), F.col("seq").alias("local_object"))
    every = ids.unionByName(fresh)
    return batch.join(every, ["source_id", "remote_object"]), every


def checked(batch: DataFrame, after: int, through: int) -> str | None:
    """What is wrong with a batch (after, through], or None: rows outside it, objects that come twice, too many rows."""
    row = batch.agg(F.count("*").alias("n"), F.count_distinct("remote_object").alias("objects"), F.min("seq").alias("low"), F.max("seq").alias("high")).first()
    if row["n"] > MOST_ROWS:
        return "too_many_rows"
    if row["n"] and (row["low"] <= after or row["high"] > through):
        return "outside_interval"
    return "repeated_object" if row["objects"] != row["n"] else None


def applied(replica: DataFrame, batch: DataFrame) -> DataFrame:
    """The replica's rows after a batch: later sequences win, deletes stay as tombstones; parents that haven't come yet get placeholders."""
    columns = ["source_id", "local_object", "parent", "name", "seq", "deleted", "placeholder"]
    rows = batch.select("source_id", "local_object", "parent", "name", "seq", "deleted", F.lit(False).alias("placeholder"))
    merged = replica.select(columns).unionByName(rows).groupBy("source_id", "local_object").agg(F.max_by(F.struct("parent", "name", "seq", "deleted", "placeholder"), "seq").alias("r"))
    merged = merged.select("source_id", "local_object", "r.*")
    missing = merged.where("parent is not null and not deleted").select("source_id", F.col("parent").alias("local_object")).distinct().join(merged, ["source_id", "local_object"], "left_anti")
    empty = missing.select("source_id", "local_object", F.lit(None).cast("long").alias("parent"), F.lit("").alias("name"), F.lit(0).cast("long").alias("seq"), F.lit(False).alias("deleted"), F.lit(True).alias("placeholder"))
    return merged.select(columns).unionByName(empty.select(columns))


def switched(replica: DataFrame, snapshot: DataFrame) -> DataFrame:
    """The replica after a whole new epoch: what the snapshot doesn't have is retired."""
    seen = snapshot.select("source_id", "local_object")
    retired = replica.join(seen, ["source_id", "local_object"], "left_anti").withColumn("deleted", F.lit(True))
    return applied(retired.where(F.lit(False)), snapshot).unionByName(retired.select("source_id", "local_object", "parent", "name", "seq", "deleted", "placeholder"))


def closed(replica: DataFrame) -> bool:
    """Whether each live row's parent is live and no placeholder."""
    live = replica.where("not deleted and not placeholder")
    return not live.where("parent is not null").join(live.select("source_id", F.col("local_object").alias("parent")), ["source_id", "parent"], "left_anti").head(1)
