"""Change feeds: coalescing, application under a fenced checkpoint, and the streaming follower."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest_state(events: DataFrame) -> DataFrame:
    """Of each object the last event; later (at, event_id) wins. Combined before the shuffle."""
    last = events.groupBy("object_id").agg(F.max_by(F.struct("event_id", "at", "op", "size"), F.struct("at", "event_id")).alias("e"), F.count("*").alias("n_events"))
    return last.select("object_id", "e.*", "n_events")


def live(events: DataFrame) -> DataFrame:
    return latest_state(events).where("op <> 'delete'")


def tombstones(events: DataFrame) -> DataFrame:
    return latest_state(events).where("op = 'delete'").select("object_id", F.col("at").alias("deleted_at"))


def coalesced(events: DataFrame) -> DataFrame:
    """One change for each object of a batch: reasons together, the last name kept, a delete cleared by a later creation, deletes of what the batch created dropped."""
    bits = F.when(F.col("op") == "link", 1).when(F.col("op") == "upsert", 2).when(F.col("op") == "rename", 4).when(F.col("op") == "content", 8).otherwise(16)
    order = F.struct("at", "event_id")
    g = events.groupBy("object_id").agg(F.bit_or(bits).alias("reasons"), F.max_by("op", order).alias("last_op"), F.min_by("op", order).alias("first_op"), F.max_by("size", order).alias("size"), F.max(order).alias("o"))
    kept = g.where(~((F.col("first_op") == "link") & (F.col("last_op") == "delete")))
    reasons = F.when(F.col("last_op") == "delete", F.col("reasons")).otherwise(F.col("reasons").bitwiseAND(F.lit(15)))
    return kept.select("object_id", reasons.alias("reasons"), "last_op", "size", F.col("o.at").alias("at"))


def generations(events: DataFrame) -> DataFrame:
    """object_id, generation: 1 plus the changes of content or size that its upserts bring."""
    w = Window.partitionBy("object_id").orderBy("at", "event_id")
    changed = F.col("op").isin("upsert", "content") & ~F.col("size").eqNullSafe(F.lag("size").over(w))
    return events.withColumn("c", changed.cast("long")).groupBy("object_id").agg((F.lit(1) + F.sum("c")).alias("generation"))


def apply_batch(table: DataFrame, batch: DataFrame) -> DataFrame:
    """Copy-on-write upsert: rows of the batch replace those of the table, deletes become tombstones."""
    changed = batch.select("object_id", F.col("size"), F.when(F.col("last_op") == "delete", F.col("at")).alias("deleted_at"), F.col("at").alias("touched_at"))
    return table.join(changed, "object_id", "left_anti").unionByName(changed)


class Fence:
    """A checkpoint that a batch must know to be applied: others are no-ops."""

    def __init__(self, position: int = 0):
        self.position = position

    def advance(self, expected: int, to: int) -> bool:
        if self.position != expected or to < expected:
            return False
        self.position = to
        return True


def follow(stream: DataFrame, path: str, checkpoint: str, each: Callable[[DataFrame], DataFrame] = coalesced):
    """A streaming query that writes each micro-batch, coalesced, under its own number: a batch that runs again overwrites itself."""

    def write(batch: DataFrame, number: int) -> None:
        each(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
