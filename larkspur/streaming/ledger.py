"""Replication ledger: sequences, hash chain, batches, admission, Merkle leaves, compaction."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A tree has 2**10 to 2**20 leaves.
LEAST_BITS, MOST_BITS = 10, 20
#: Rows of a leaf or of a rank bucket, about.
LEAF_ROWS = 64
RANK_ROWS = 100_000
GENESIS = "0" * 64


def ranked(rows: DataFrame, group: str, key: str, name: str = "rank") -> DataFrame:
    """rank (from 1) of each row among those of its group, in order of key: buckets of the key's range are counted, and a window ranks inside
    each, so a large group is in no step one task's. Ties are in any order."""
    spread = rows.groupBy(group).agg(F.count("*").alias("_n"), F.percentile_approx(key, [i / 100 for i in range(1, 100)], 10_000).alias("_edges"))
    # one row for each group; small groups need no buckets
    edges = spread.select(F.col(group).alias("_g"), F.when(F.col("_n") > RANK_ROWS, F.array_distinct("_edges")).otherwise(F.array().cast(spread.schema["_edges"].dataType)).alias("_edges"))
    placed = rows.join(edges, F.col(group).eqNullSafe(F.col("_g"))).withColumn("_b", F.size(F.filter("_edges", lambda e: e < F.col(key)))).drop("_edges", "_g")
    counts = placed.groupBy(group, "_b").agg(F.count("*").alias("_c"))
    before = F.sum("_c").over(Window.partitionBy(group).orderBy("_b")) - F.col("_c")
    counts = counts.select(F.col(group).alias("_g"), F.col("_b").alias("_h"), before.alias("_before"))
    inside = F.row_number().over(Window.partitionBy(group, "_b").orderBy(key))
    out = placed.withColumn("_i", inside).join(counts, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_b") == F.col("_h")))
    return out.withColumn(name, F.col("_i") + F.col("_before")).drop("_i", "_b", "_g", "_h", "_before")


def minted(touched: DataFrame, base: int = 0) -> DataFrame:
    """seq for each touched object of a source, in order of its id."""
    return ranked(touched, "source_id", "object_id", "seq").withColumn("seq", F.col("seq") + F.lit(base))


def stamped(touched: DataFrame, done: int, base: int, limit: int) -> DataFrame:
    """A step of a backfill: seq for the next `limit` objects after `done`, in order of id; it goes on from the last object of its result."""
    step = touched.where(F.col("object_id") > done).orderBy("object_id").limit(limit)
    return minted(step, base)


def ledger(events: DataFrame) -> DataFrame:
    """seq, object_id, deleted, image_hash: the last touch of each object keeps its sequence (the event's id)."""
    last = events.groupBy("object_id").agg(F.max("event_id").alias("seq"), F.max_by(F.struct("op", "size", "at"), "event_id").alias("e"))
    image = F.sha2(F.concat_ws("|", F.col("object_id").cast("string"), F.col("e.op"), F.col("e.size").cast("string")), 256)
    return last.select("seq", "object_id", (F.col("e.op") == "delete").alias("deleted"), image.alias("image_hash"), F.col("e.at").alias("touched_at"))


def batch(rows: DataFrame, after: int, through: int, limit: int | None = None) -> DataFrame:
    """Rows of (after, through], the first `limit` of them."""
    found = rows.where((F.col("seq") > after) & (F.col("seq") <= through)).orderBy("seq")
    return found.limit(limit) if limit else found


def folded(previous: str, row) -> str:
    """The next hash of a chain: SHA-256 over the previous one, the object, its generation and its image (or that it is deleted)."""
    value = "deleted" if row["deleted"] else row["image_hash"]
    return hashlib.sha256(f"{previous}|{row['object_id']}|{row['generation']}|{value}".encode()).hexdigest()


def chained(rows: DataFrame, after: str = GENESIS) -> DataFrame:
    """seq, chain of a source's rows (source_id, seq, object_id, generation, deleted, image_hash), each hash folded over all before it. A fold has one
    order, so a source is one task, which streams its rows; sources are folded side by side."""

    def run(batches):
        state = {}
        for b in batches:
            found = []
            for row in b.to_dict("records"):
                state[row["source_id"]] = folded(state.get(row["source_id"], after), row)
                found.append((row["source_id"], row["seq"], state[row["source_id"]]))
            yield pd.DataFrame(found, columns=["source_id", "seq", "chain"])

    columns = rows.select("source_id", "seq", "object_id", "generation", "deleted", "image_hash")
    return columns.repartition("source_id").sortWithinPartitions("source_id", "seq").mapInPandas(run, "source_id long, seq long, chain string")


def chain_of(blocks: DataFrame) -> str:
    """One hash over the block hashes of chain(), in order: equal for two ledgers if all their blocks are."""
    total = GENESIS
    for row in blocks.orderBy("block").toLocalIterator():
        total = hashlib.sha256(f"{total}|{row['block']}|{row['block_hash']}".encode()).hexdigest()
    return total


def chain(rows: DataFrame, block: int = 1000) -> DataFrame:
    """block, rows, block_hash over blocks of sequences: each hash covers its rows in order, in parallel; chain_of() links blocks up."""
    hashed = rows.groupBy(F.floor(F.col("seq") / block).alias("block")).agg(F.count("*").alias("rows"), F.sort_array(F.collect_list(F.struct("seq", "image_hash"))).alias("r"))
    return hashed.select("block", "rows", F.sha2(F.array_join(F.transform("r", lambda x: F.concat_ws(":", x["seq"].cast("string"), x["image_hash"])), ","), 256).alias("block_hash"))


def _leaf(bits: int) -> Column:
    """The low bits of a hash of the id."""
    return F.conv(F.substring(F.md5(F.col("object_id").cast("string").cast("binary")), 1, 8), 16, 10).cast("long") % (1 << bits)


def leaf_bits(rows: int) -> int:
    """Bits by the number of rows, so that a leaf has about LEAF_ROWS; both sides of a comparison must use the same."""
    return max(LEAST_BITS, min(MOST_BITS, (max(1, rows) // LEAF_ROWS).bit_length()))


def merkle_leaves(rows: DataFrame, bits: int = LEAST_BITS) -> DataFrame:
    """leaf, rows, leaf_hash; an object's leaf is given by its id alone."""
    leaf = _leaf(bits)
    hashed = rows.groupBy(leaf.alias("leaf")).agg(F.count("*").alias("rows"), F.sort_array(F.collect_list(F.struct("object_id", "image_hash"))).alias("r"))
    return hashed.select("leaf", "rows", F.sha2(F.array_join(F.transform("r", lambda x: F.concat_ws(":", x["object_id"].cast("string"), x["image_hash"])), ","), 256).alias("leaf_hash"))


def differing(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """Leaves whose hashes differ or that one side lacks."""
    a, b = (x.select("leaf", F.col("leaf_hash").alias(n)) for x, n in ((ours, "ours"), (theirs, "theirs")))
    return a.join(b, "leaf", "full_outer").where(~F.col("ours").eqNullSafe(F.col("theirs"))).select("leaf", "ours", "theirs")


def repaired(ours: DataFrame, theirs: DataFrame, leaves: DataFrame, bits: int = LEAST_BITS) -> DataFrame:
    """Our rows with the differing leaves replaced by theirs, deletes included."""
    leaf = _leaf(bits).alias("leaf")
    keyed = lambda rows: rows.select("*", leaf)
    return keyed(ours).join(leaves.select("leaf"), "leaf", "left_anti").unionByName(keyed(theirs).join(leaves.select("leaf"), "leaf", "left_semi")).drop("leaf")


def floor(watermarks: DataFrame, kept: int = 0) -> DataFrame:
    """The sequence up to which all consumers of a source are done, or up to which retention lets go anyway."""
    return watermarks.groupBy("source_id").agg(F.greatest(F.min("acked"), F.lit(kept)).alias("floor"))


def compacted(rows: DataFrame, upto: int) -> DataFrame:
    """Rows without tombstones that every consumer has seen."""
    return rows.where(~(F.col("deleted") & (F.col("seq") <= upto)))


def backlog(rows: DataFrame, acked: int) -> DataFrame:
    waiting = rows.where(F.col("seq") > acked)
    return waiting.agg(F.count("*").alias("rows"), F.count_if("deleted").alias("deletes"), F.min("touched_at").alias("oldest"))


@dataclass(frozen=True)
class Position:
    epoch: int
    seq: int
    chain: str
    pending: int | None = None
    retired: frozenset = frozenset()


def admit(have: Position, epoch: int, after: int, after_chain: str, through: int) -> str:
    """What to do with a batch (after, through] of an epoch."""
    if epoch != have.epoch or have.pending is not None:
        return "full_resync_required"
    if through <= have.seq:
        return "already_applied"
    if after != have.seq:
        return "gap" if after > have.seq else "stale"
    return "apply" if after_chain == have.chain else "history_fork"


def admit_hello(have: Position, epoch: int, head: int) -> tuple[str, Position]:
    """What to answer a source that offers an epoch up to `head`, and the position after it: another epoch asks for all of it and
    stays pending until it came, one that was left behind or is not the pending one is refused, and so is a head behind what is applied."""
    if epoch in have.retired or have.pending is not None and epoch != have.pending:
        return "reject_epoch", have
    if epoch != have.epoch:
        return "full_resync", replace(have, pending=epoch)
    return ("reject_rewound" if head < have.seq else "incremental"), have


def resynced(have: Position, epoch: int, through: int, chain: str) -> Position:
    """The position after a whole pending epoch has come; the one before it is retired."""
    if have.pending != epoch:
        raise ValueError("this epoch was not asked for")
    return Position(epoch, through, chain, None, have.retired | {have.epoch})


def advanced(watermarks: DataFrame, acked: DataFrame) -> DataFrame:
    """Watermarks (source_id, consumer, acked) after acknowledgements: they never go back."""
    return watermarks.unionByName(acked).groupBy("source_id", "consumer").agg(F.max("acked").alias("acked"))
