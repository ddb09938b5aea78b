"""Exact top-k inner products by a three-phase uniform threshold.

A vector's dimensions are cut into `nodes` slices; each slice scores all vectors and has its own score list. A vector's
score is the sum over the slices.

1. In each tile of vectors, each slice gives its list: its k highest partial scores of each query, the highest of which
   is the list's head. These vectors are scored in full, and the tile reports its k highest totals and the heads.
2. The k-th highest total that all tiles report for a query is a safe cutoff t: k vectors reach it. It goes back to
   the tiles with the query and the tile's own heads. A slice needs to give only entries that reach t together with the
   heads of the slices after it: others can't be part of a total of t. A tile whose heads together miss t is out.
3. What the first slice gives is resolved slice by slice, and only for what can still reach t; totals of t or
   more, at most k of a tile (ties to smaller ids), meet per query for the final rank.

Scale: vectors are dealt once into tiles of at most TILE_BYTES, written once; blocks of queries are sent once to each tile
and stream through it, so nothing of the size of tiles times blocks but lists of k entries is written. A task holds one tile
and one block. The first phase multiplies all pairs, the second one slice of them.

Defined results: null vectors and those with null or non-finite components take no part; scores and
scaled components beyond 64 bits count as the nearest such number; shorter vectors count as padded with zeros, so an empty one scores
0; vectors with null id take no part; rows that repeat an id are separate candidates, and a query
id counts once, with its smallest vector; other columns don't matter; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.llm.common import durable

K = 10
NODES = 2
#: A tile's matrix of 64-bit numbers is at most so large; there is at least one tile for each core.
TILE_BYTES = 16_000_000
#: Vectors of a tile that are multiplied at once, and queries of a block.
CHUNK = 2048
BLOCK = 256
#: Scores are at most so large in size.
MOST = 2**63 - 1


def quantized(embeddings: DataFrame, scale: int = 1024) -> DataFrame:
    """vec_id and floor(scale * x) of each component, without vectors that take no part."""
    x = F.transform("embedding", lambda v: v.cast("double"))
    fine = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.coalesce(F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))), F.lit(False))
    return embeddings.where(fine).select("vec_id", F.transform(x, lambda v: F.floor(v * scale).cast("long")).alias("v"))


def _packed(rows: DataFrame, packs: int, dims: int) -> DataFrame:
    """Rows dealt by hash into packs: pack, ids, matrix bytes; in order of id, then vector."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        m = np.zeros((len(part), dims), "<i8")
        for i, v in enumerate(part["v"]):
            m[i, : len(v)] = v
        ids = part["vec_id"].to_numpy("<i8")
        order = np.lexsort((*m.T[::-1], ids))
        if m.max(initial=0) < 2**31 and m.min(initial=0) >= -(2**31):
            m = m.astype("<i4")
        return pd.DataFrame({"pack": part["pack"].iloc[:1], "ids": [ids[order].tobytes()], "m": [m[order].tobytes()]})

    keyed = rows.withColumn("pack", F.pmod(F.xxhash64("vec_id", "v"), F.lit(packs)))
    return keyed.groupBy("pack").applyInPandas(run, "pack long, ids binary, m binary")


def _unpacked(ids: bytes, data: bytes, dims: int) -> tuple[np.ndarray, np.ndarray]:
    found = np.frombuffer(ids, "<i8")
    return found, np.frombuffer(data, "<i8" if len(data) > 4 * len(found) * dims else "<i4").reshape(len(found), dims)


def _size(m: np.ndarray) -> float:
    return float(np.abs(m.astype("f8")).max(initial=0))


def _dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products: by floats where every sum is below 2**53, by 64-bit integers below 2**60, else Python's."""
    high = _size(a) * _size(b) * max(1, a.shape[1])
    if high < 2**53:
        return (a.astype("f8") @ b.astype("f8").T).astype("i8")
    if high < 2**60:
        return a.astype("i8") @ b.astype("i8").T
    return a.astype(object) @ b.astype(object).T


def _row_dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact products of rows with rows."""
    if _size(a) * _size(b) * max(1, a.shape[1]) < 2**60:
        return np.einsum("ij,ij->i", a.astype("i8"), b.astype("i8"))
    return (a.astype(object) * b.astype(object)).sum(1) if len(a) else np.zeros(0, "i8")


def _near(x: np.ndarray) -> np.ndarray:
    """Scores as 64-bit numbers."""
    return np.clip(x, -MOST, MOST).astype("i8") if x.dtype == object else np.maximum(x, -MOST)


def _slices(dims: int, nodes: int) -> list[tuple[int, int]]:
    edges = np.linspace(0, dims, nodes + 1).astype(int)
    return list(zip(edges, edges[1:]))


def _best(query: np.ndarray, ids: np.ndarray, place: np.ndarray, total: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each query's k highest of distinct places, ties to smaller ids."""
    order = np.lexsort((place, ids, -total, query))  # totals are above -2**63
    query, ids, place, total = query[order], ids[order], place[order], total[order]
    new = np.ones(len(query), bool)
    new[1:] = (query[1:] != query[:-1]) | (place[1:] != place[:-1])
    query, ids, total = query[new], ids[new], total[new]
    first = np.searchsorted(query, query)
    kept = np.arange(len(query)) - first < k
    return query[kept], ids[kept], total[kept]


def _lists(ids, m, query_ids, q, k, nodes):
    """Phase 1: (query, vector, total) of the tile's k best out of the slices' lists, and the heads of the lists."""
    cuts, found, heads = _slices(m.shape[1], nodes), [], np.full((len(query_ids), nodes), -MOST)
    for at in range(0, len(ids), CHUNK):
        some, some_ids = m[at : at + CHUNK], ids[at : at + CHUNK]
        parts = [_dot(q[:, a:b], some[:, a:b]) for a, b in cuts]
        own = query_ids[:, None] == some_ids[None, :]
        picked = []
        for s, p in enumerate(parts):
            ranked = _near(p)
            ranked[own] = -MOST
            heads[:, s] = np.maximum(heads[:, s], ranked.max(1))
            n = min(k, len(some_ids))
            picked.append(np.argpartition(-ranked, n - 1, axis=1)[:, :n])
        columns = np.concatenate(picked, 1)
        rows = np.repeat(np.arange(len(query_ids)), columns.shape[1])
        columns = columns.ravel()
        other = ~own[rows, columns]
        rows, columns = rows[other], columns[other]
        total = _near(sum(p[rows, columns].astype(object) if p.dtype == object else p[rows, columns] for p in parts))
        query, near, total = _best(rows, some_ids[columns], columns, total, k)
        found.append((query, near, total))
    query, near, total = (np.concatenate([f[j] for f in found]) for j in range(3))
    # chunks have different rows, so a place of its own for each
    query, near, total = _best(query, near, np.arange(len(query)), total, k)
    return query, near, total, heads


def _resolved(ids, m, query_ids, q, k, nodes, cutoff, heads):
    """Phases 2 and 3: (query, vector, total) of the tile's k best at or above the cutoff."""
    cuts, found = _slices(m.shape[1], nodes), []
    # heads that stand for clipped scores say nothing
    open_ = (np.abs(heads) >= MOST).any(1) | (cutoff <= -MOST)
    rest = heads.astype(object)[:, ::-1].cumsum(1)[:, ::-1]
    alive = np.flatnonzero(open_ | (rest[:, 0] >= cutoff).astype(bool))
    if not len(alive):
        return (np.zeros(0, "i8"),) * 3
    after = np.concatenate([rest[:, 1:], np.zeros((len(rest), 1), object)], 1)
    need = np.where(open_[:, None], -(2**70), cutoff[:, None].astype(object) - after)
    for at in range(0, len(ids), CHUNK):
        some, some_ids = m[at : at + CHUNK], ids[at : at + CHUNK]
        a, b = cuts[0]
        first = _dot(q[alive, a:b], some[:, a:b])
        least = np.clip(need[alive, 0], -MOST, MOST).astype("i8") if first.dtype != object else need[alive, 0]
        row, column = np.nonzero((first >= least[:, None]) & (query_ids[alive][:, None] != some_ids[None, :]))
        total, row = first[row, column], alive[row]
        for s, (a, b) in enumerate(cuts[1:], 1):
            part = _row_dots(q[row, a:b], some[column, a:b])
            total = total.astype(object) + part if object in (total.dtype, part.dtype) else total + part
            going = total >= (need[row, s] if total.dtype == object else np.clip(need[row, s], -MOST, MOST).astype("i8"))
            going = going.astype(bool)
            row, column, total = row[going], column[going], total[going]
        total = _near(total)
        reach = total >= cutoff[row]
        found.append(_best(row[reach], some_ids[column[reach]], column[reach], total[reach], k))
    query, near, total = (np.concatenate([f[j] for f in found]) for j in range(3))
    return _best(query, near, np.arange(len(query)), total, k)


def top_k(vectors: DataFrame, is_query: Column, k: int = K, nodes: int = NODES) -> DataFrame:
    """query_id, rank, vec_id, score of each query's k highest among all other vectors."""
    spark = vectors.sparkSession
    vectors = durable(vectors.select("vec_id", "v"))
    queries = vectors.where(is_query).groupBy("vec_id").agg(F.min("v").alias("v"))
    n, dims = vectors.agg(F.count("*"), F.max(F.size("v"))).first()
    dims, n_blocks = max(1, dims or 0), max(1, -(-queries.count() // BLOCK))
    n_tiles = max(1, -(-n * dims * 8 // TILE_BYTES), min(spark.sparkContext.defaultParallelism, n // CHUNK))
    none = lambda kind: F.lit(None).cast(kind)
    tiles = durable(_packed(vectors, n_tiles, dims)).select(F.col("pack").alias("tile"), none("long").alias("block"), "ids", "m", none("binary").alias("cutoffs"), none("binary").alias("heads"))
    asked = durable(_packed(queries, n_blocks, dims).withColumnRenamed("pack", "block"))
    at_tiles = asked.withColumn("tile", F.explode(F.sequence(F.lit(0), F.lit(n_tiles - 1)))).withColumn("tile", F.col("tile").cast("long"))

    def streamed(blocks: DataFrame, schema: str, answer):
        """Blocks of queries stream through their tile."""

        def run(batches):
            here, ids, m = None, None, None
            for batch in batches:
                for i in range(batch.num_rows):
                    row = {name: batch.column(name)[i].as_py() for name in batch.schema.names}
                    if row["block"] is None:
                        here, (ids, m) = row["tile"], _unpacked(row["ids"], row["m"], dims)
                    elif row["tile"] == here:
                        yield answer(row, ids, m, *_unpacked(row["ids"], row["m"], dims))

        rows = tiles.unionByName(blocks.select(tiles.columns))
        return rows.repartition(n_tiles, "tile").sortWithinPartitions("tile", F.col("block").asc_nulls_first()).mapInArrow(run, schema)

    def lists(row, ids, m, query_ids, q):
        query, near, total, heads = _lists(ids, m, query_ids, q, k, nodes)
        cells = [row["tile"], row["block"], query_ids[query].tolist(), near.tolist(), total.tolist(), heads.astype("<i8").tobytes()]
        kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(cells, kinds)], ["tile", "block", "query_ids", "vec_ids", "scores", "heads"])

    listed = "tile long, block long, query_ids array<long>, vec_ids array<long>, scores array<long>, heads binary"
    first = durable(streamed(at_tiles.withColumns({"cutoffs": none("binary"), "heads": none("binary")}), listed, lists))
    entry = F.explode(F.arrays_zip("query_ids", "vec_ids", "scores")).alias("e")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    reported = first.select("block", entry).select("block", F.col("e.query_ids").alias("query_id"), F.col("e.vec_ids").alias("vec_id"), F.col("e.scores").alias("score"))
    lowest = reported.withColumn("rank", F.row_number().over(best)).where(F.col("rank") == k).select("block", "query_id", F.col("score").alias("cutoff"))

    def with_cutoffs(key, block: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        ids = np.frombuffer(block["ids"].iloc[0], "<i8")
        # a query of fewer than k totals has no cutoff: all its entries are collected
        cut = np.full(len(ids), -MOST)
        order = np.argsort(ids)
        cut[order[np.searchsorted(ids[order], found["query_id"].to_numpy("i8"))]] = found["cutoff"].to_numpy("i8")
        return block.assign(cutoffs=[cut.astype("<i8").tobytes()])

    cut = asked.groupBy("block").cogroup(lowest.groupBy("block")).applyInPandas(with_cutoffs, "block long, ids binary, m binary, cutoffs binary")
    again = first.select("tile", "block", "heads").join(durable(cut), "block")

    def resolved(row, ids, m, query_ids, q):
        cutoff, heads = np.frombuffer(row["cutoffs"], "<i8"), np.frombuffer(row["heads"], "<i8").reshape(len(query_ids), -1)
        query, near, total = _resolved(ids, m, query_ids, q, k, nodes, cutoff, heads)
        return pa.RecordBatch.from_arrays([pa.array(x.astype("i8")) for x in (query_ids[query], near, total)], ["query_id", "vec_id", "score"])

    final = streamed(again, "query_id long, vec_id long, score long", resolved)
    return final.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
