"""Mixing sources to target weights by cube-method balanced sampling.

Each source has a target number of words; target / size is how often each of its documents
is to be taken on average. The whole part is taken for sure, the fraction is an inclusion
probability. The flight moves fractions inside the null-space of the balancing constraints
(words and documents of the source): of three fractional documents one direction keeps both
totals, and a step along it makes one of them 0 or 1. Documents fly in small buckets of a
source, what stays fractional flies again with that of other buckets, until one small group
of documents of each source remains; the landing takes, of all choices for those few documents, that
whose words come nearest to what the flight has left of the target. It is not random: a landing that draws fairly was tried and left
sources further from their targets.

Scale: one scan of the texts gives narrow rows (id, source, size), which the folder shared by
the executors keeps. Buckets hold about BUCKET documents whatever the source's size, so a hot
source is spread; each level leaves at most LANDING documents of a bucket, so levels shrink by
BUCKET / LANDING. Choices depend on ids alone, so reruns agree.

Defined results: a null text has size 0; a null source is a source of its own, after all others;
documents of size 0 may be chosen but give no words; a source of size 0 has target 0; repeated
rows are separate documents; an empty table gives no rows; other columns don't matter.
"""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkspur.llm.common import durable, n_words, packed, unpacked

WEIGHTS = (5.0, 2.0, 1.0)
#: No source gives more than so many times its size.
MOST_REPEATS = 3.0
#: Documents that fly together.
BUCKET = 200
#: Documents of a bucket that may stay fractional until the last level.
LANDING = 10


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST_REPEATS) -> DataFrame:
    """Rows (source, docs, source_size) -> with target: shares by weight, each at most `most` times
    its size. With sources in order of cap / weight, the capped ones are a prefix, so running sums
    find the level that the others share. One row for each source, so one task is enough."""
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    every = Window.partitionBy()
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    ranked = sizes.withColumn("weight", F.element_at(cycle, ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("cap", F.lit(float(most)) * F.col("source_size"))
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), F.col("source"))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    ranked = ranked.withColumn("left", F.sum("source_size").over(every).cast("double") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
    ranked = ranked.withColumn("shared", F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    ranked = ranked.withColumn("level", F.col("left") / F.col("shared"))
    # the first source that the level doesn't fill sets the level of all after it
    ranked = ranked.withColumn("level", F.min_by("level", F.when(F.col("cap") >= F.col("level") * F.col("weight"), F.col("cap") / F.col("weight"))).over(every))
    return ranked.select("source", "docs", "source_size", F.when(F.col("source_size") == 0, 0.0).otherwise(F.least("cap", F.coalesce(F.col("level") * F.col("weight"), F.col("cap")))).alias("target"))


def _uniform(keys: np.ndarray, salt: int) -> np.random.Generator:
    return np.random.Generator(np.random.PCG64([salt, *(int(k) & 0xFFFFFFFF for k in keys[:4]), len(keys)]))


def _step(now: np.ndarray, u: np.ndarray, draw) -> np.ndarray:
    """A fair step along u or against it, until one of the fractions is 0 or 1."""
    up, down = np.where(u > 0, 1 - now, -now), np.where(u > 0, -now, 1 - now)
    with np.errstate(divide="ignore", invalid="ignore"):
        forth, back = np.where(u != 0, up / u, np.inf), np.where(u != 0, down / u, -np.inf)
    ahead, behind = forth.min(), -back.max()
    step = ahead if draw() * (ahead + behind) < behind else -behind
    at = int(forth.argmin()) if step > 0 else int(back.argmax())
    now = now + step * u
    now[at] = float((step > 0) == (u[at] > 0))
    return np.where(now < 1e-9, 0.0, np.where(now > 1 - 1e-9, 1.0, now))


def _fly(size: np.ndarray, p: np.ndarray, draw, leave: int = LANDING) -> np.ndarray:
    """Move fractions along directions that keep sum(p) and sum(p * size), in order, until at most `leave` (2 or more) are left."""
    p = p.astype(float).copy()
    waiting = [i for i in range(len(p)) if 0 < p[i] < 1][::-1]
    held: list[int] = []
    while len(held) + len(waiting) > leave:
        while len(held) < 3:
            held.append(waiting.pop())
        a, b, c = held
        u = np.array([size[b] - size[c], size[c] - size[a], size[a] - size[b]], float)
        p[held] = _step(p[held], u if u.any() else np.array([1.0, -1.0, 0.0]), draw)
        held = [i for i in held if 0 < p[i] < 1]
    return p


def _land(size: np.ndarray, p: np.ndarray, draw) -> np.ndarray:
    """All choices for the last fractional documents: the nearest in words, then in documents."""
    p = _fly(size, p, draw)
    open_ = np.flatnonzero((p > 0) & (p < 1))
    if len(open_):
        choices = np.array(list(itertools.product((0.0, 1.0), repeat=len(open_))))
        words, docs = np.abs((choices - p[open_]) @ size[open_]), np.abs((choices - p[open_]).sum(1))
        p[open_] = choices[np.lexsort((docs, np.round(words, 6)))[0]]
    return p


def _level(rows: DataFrame, level: int, last: bool) -> DataFrame:
    """Fly each (source, bucket) of rows; rows keep their place, p becomes the new state."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["key", "copy"], kind="stable", ignore_index=True)
        size, draw = part["size"].to_numpy(float), _uniform(part["key"].to_numpy(), level).random
        p = part["p"].to_numpy(float)
        return part.assign(p=_land(size, p, draw) if last else _fly(size, p, draw))

    return rows.groupBy("source", "bucket").applyInPandas(run, rows.schema)


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST_REPEATS) -> DataFrame:
    """doc_id, source, size, source_size, target, copies (times the document is taken), row_key."""
    sized = durable(docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), F.xxhash64("doc_id", "text").alias("key")))
    shares = targets(sized.groupBy("source").agg(F.count("*").alias("docs"), F.sum("size").alias("source_size")), weights, most)
    most_docs = shares.agg(F.max("docs")).first()[0] or 0
    shares = durable(shares.withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)))
    # repeated rows share a key; their number tells them apart
    rows = sized.withColumn("copy", F.row_number().over(Window.partitionBy("key", "doc_id").orderBy("size")))
    s = shares.select(F.col("source").alias("_s"), "docs", "source_size", "target", "rate")
    rows = rows.join(s, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    rows = rows.withColumn("whole", F.floor("rate").cast("int")).withColumn("p", F.col("rate") - F.floor("rate"))
    buckets, level, decided = most_docs, 0, []
    rows = rows.withColumn("bucket", F.lit(0))
    while True:
        buckets = -(-buckets // BUCKET)
        rows = rows.withColumn("bucket", F.pmod(F.xxhash64("key", "copy", F.lit(level)), F.greatest(F.lit(1), F.ceil(F.col("docs") / F.lit(float(BUCKET) * (BUCKET // LANDING) ** level)))).cast("int"))
        last = buckets <= 1
        rows = durable(_level(rows, level, last))
        if last:
            break
        decided.append(rows.where("p = 0 or p = 1"))
        rows = rows.where("p > 0 and p < 1")
        buckets, level = buckets * LANDING, level + 1
    for part in decided:
        rows = rows.unionByName(part)
    return rows.select("doc_id", "source", "size", "source_size", "target", (F.col("whole") + F.col("p").cast("int")).alias("copies"), F.col("key").alias("row_key"))


def mixed(docs: DataFrame) -> DataFrame:
    """The rows of docs, all columns, as often as the mix takes them. Rows that are alike in doc_id and
    text share their copies as evenly as whole numbers can."""
    taken = mix(docs).groupBy("row_key").agg(F.sum("copies").alias("copies"), F.count("*").alias("alike")).where("copies > 0")
    rows = packed(docs).withColumn("row_key", F.xxhash64("doc.doc_id", "doc.text")).join(taken, "row_key")
    place = F.row_number().over(Window.partitionBy("row_key").orderBy(F.xxhash64("doc")))
    share = F.floor(F.col("copies") / F.col("alike")) + (place <= F.col("copies") % F.col("alike")).cast("int")
    rows = rows.withColumn("take", share.cast("int")).where("take > 0")
    return unpacked(rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("take")))), docs)
