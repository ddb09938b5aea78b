"""Near-duplicate documents: MinHash banding, signature check, exact check, star contraction.

1. One scan hashes each text: words, set of 5-word shingles, ROWS * BANDS universal hash minima.
   Equal word sequences share a content key, so copies are one node from here on.
2. Nodes that share a band meet in its bucket. Each node is paired with the bucket's smallest node
   only, so a bucket of m nodes gives m - 1 pairs.
3. Pairs whose signatures agree in less than SIGNATURE_LEAST of the minima or whose set sizes
   rule a link out are dropped; the rest is confirmed on full shingle sets.
4. Alternating large-star and small-star joins give components.
5. Buckets in which nodes besides the smallest lie in different components still hold untried pairs. While
   such a bucket has more than SMALL nodes and rounds make PROGRESS, steps 2 to 4 are repeated without the smallest nodes, which
   have been tried with all; one group of near copies is one component after a few rounds.
6. In what is left, nodes of different components meet in blocks of at most BLOCK nodes and about BLOCK_BYTES of sets a
   side. Blocks compare signatures first; only nodes of pairs that agree there get their full sets, once for
   each block. In a block, pairs that links already connect are not compared. Only links leave the blocks, and the components
   are taken again.

A pair of similarity 0.75 shares a band with probability 1 - (1 - 0.75**5)**40 > 0.99998 and passes
the signature check with probability > 0.99999; higher similarities do better.

Scale: narrow shuffles (band, node, size); hot buckets are split by skew joins in step 2 and by
blocks in step 6; full sets travel only for nodes in surviving pairs. Batches and blocks are bounded by
bytes, so workers hold little. Nothing is collected.

Defined results: a null or empty text, or one without words, has an empty set and stays alone; fewer than five
words make one shingle of the whole sequence; rows that repeat a doc_id and text are copies; rows with a null doc_id take
part, and their component is the smallest id reachable (null if there is none); an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import WordHashes, durable, each, packed, shingles, unpacked, words_of
from larkspur.llm.linking import Forest, blocked, linked_in_cells, shared_cells

WIDTH = 5
ROWS, BANDS = 5, 40
SIGNATURE_LEAST = 0.6
BLOCK = 1024
#: Full sets of a block's side, about.
BLOCK_BYTES = 8_000_000
#: Percent of the union that the intersection must reach.
LEAST_PERCENT = 75

_constants = np.random.Generator(np.random.PCG64(20_240_501)).integers(0, 2**64, (2, ROWS * BANDS), np.uint64)
_A, _B = _constants[0] | np.uint64(1), _constants[1]


def signature(values: np.ndarray) -> np.ndarray:
    """The minima of ROWS * BANDS multiply-shift hashes, 32 bits each."""
    lowest = np.full(len(_A), np.iinfo(np.uint64).max)
    with np.errstate(over="ignore"):
        for start in range(0, len(values), 512):
            np.minimum(lowest, (values[start : start + 512, None] * _A + _B).min(0), out=lowest)
    return (lowest >> np.uint64(32)).astype("<u4")


def band_keys(sig: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band; bands differ by their number."""
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for column in sig.reshape(BANDS, ROWS).T.astype(np.uint64):
            key = (key ^ column) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(29)
    return key.view("i8")


def linked(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two full sets (sorted, distinct) are near enough."""
    both = np.concatenate([x, y])
    both.sort()
    shared = int((both[1:] == both[:-1]).sum())
    return 100 * shared >= LEAST_PERCENT * (len(both) - shared)


def content_key(words: list[bytes]) -> int:
    return int.from_bytes(hashlib.blake2b(b" ".join(words), digest_size=8).digest(), "little", signed=True)


def hashed(docs: DataFrame) -> DataFrame:
    """doc_id, node (content key; null without words), n_shingles, and for a node's first row in a batch bands and sig."""

    def run(batches):
        hashes = WordHashes()
        for batch in batches:
            seen: dict[int, int] = {}
            node, size, bands, sigs = [], [], [], []
            for text in each(batch.column("text")):
                words = words_of(text)
                key = content_key(words) if words else None
                new = words and key not in seen
                if new:
                    found = shingles(hashes.of(words), WIDTH)
                    sig = signature(found)
                    seen[key] = len(found)
                node.append(key)
                size.append(seen[key] if words else 0)
                bands.append(band_keys(sig) if new else None)
                sigs.append(sig.tobytes() if new else None)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(node, pa.int64()), pa.array(size, pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(sigs, pa.binary())], ["doc_id", "node", "n_shingles", "bands", "sig"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, node long, n_shingles long, bands array<long>, sig binary")


def _agreeing(pairs: DataFrame, signed: DataFrame) -> DataFrame:
    """Pairs (a, b) whose signatures and sizes allow a link."""
    left = signed.select(F.col("node").alias("a"), F.col("n_shingles").alias("n_a"), F.col("sig").alias("sig_a"))
    right = signed.select(F.col("node").alias("b"), F.col("n_shingles").alias("n_b"), F.col("sig").alias("sig_b"))

    def run(batches):
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u4").reshape(batch.num_rows, -1) for c in ("sig_a", "sig_b"))
            near = (a == b).mean(1) >= SIGNATURE_LEAST if batch.num_rows else np.zeros(0, bool)
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(near)) for c in ("a", "b")], ["a", "b"])

    allowed = (F.col("n_a") * 100 >= F.col("n_b") * LEAST_PERCENT) & (F.col("n_b") * 100 >= F.col("n_a") * LEAST_PERCENT)
    return pairs.join(left, "a").join(right, "b").where(allowed).select("a", "b", "sig_a", "sig_b").mapInArrow(run, "a long, b long")


def _sets(docs: DataFrame, rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, shingle set (sorted 64-bit hashes): texts are read again for the nodes asked for only."""
    asked = rows.where("node is not null").join(nodes, "node", "left_semi").groupBy("node").agg(F.min("doc_id").alias("doc_id"))

    def run(batches):
        hashes = WordHashes()
        for batch in batches:
            node, sets = [], []
            for want, text in zip(batch.column("node").to_pylist(), each(batch.column("text"))):
                words = words_of(text)
                if words and content_key(words) == want:  # not if a repeated id has another text
                    node.append(want)
                    sets.append(shingles(hashes.of(words), WIDTH).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(sets, pa.binary())], ["node", "shingle_set"])

    texts = docs.select("doc_id", "text")
    return texts.join(asked, texts["doc_id"].eqNullSafe(asked["doc_id"])).select("node", "text").mapInArrow(run, "node long, shingle_set binary").dropDuplicates(["node"])


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Links: 100 * intersection >= LEAST_PERCENT * union on full sets."""
    left, right = (sets.select(F.col("node").alias(c), F.col("shingle_set").alias(f"set_{c}")) for c in "ab")

    def run(batches):
        for batch in batches:
            links = [linked(*(np.frombuffer(x, "<u8") for x in sides)) for sides in zip(each(batch.column("set_a")), each(batch.column("set_b")))]
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(links, pa.bool_())) for c in ("a", "b")], ["a", "b"])

    return pairs.join(left, "a").join(right, "b").select("a", "b", "set_a", "set_b").mapInArrow(run, "a long, b long")


def _across(rest: DataFrame, signed: DataFrame, sets_of) -> DataFrame:
    """Links (a, b) that connect what is linked in cells (cell, node, comp, m). Nodes of a bucket meet in blocks; a pair is
    looked at in the first band it shares, by signature, then by full sets. sets_of(nodes) gives (node, shingle_set)."""
    rest = rest.join(signed.select("node", "n_shingles", "sig"), "node").withColumn("bytes", F.col("n_shingles") * 8)
    rest = blocked(rest, "bytes", BLOCK, BLOCK_BYTES).select("cell", "i", "j", "mine", "node", "comp", "n_shingles", "sig")

    def alike(part: pd.DataFrame) -> pd.DataFrame:
        sig = np.frombuffer(b"".join(part["sig"]), "<u4").reshape(len(part), -1)
        node, comp, size, mine = (part[c].to_numpy() for c in ("node", "comp", "n_shingles", "mine"))
        i, j, cell = part["i"].iloc[0], part["j"].iloc[0], part["cell"].iloc[0]
        here = int((band_keys(sig[0]) == cell).argmax())
        a, b, agree = [], [], []
        for x in np.flatnonzero(mine == i):
            ok = (comp != comp[x]) & (node > node[x] if i == j else mine == j) & (size * 100 >= size[x] * LEAST_PERCENT) & (size[x] * 100 >= size * LEAST_PERCENT)
            ys = np.flatnonzero(ok)
            same = sig[ys] == sig[x]
            share, first = same.mean(1), same.reshape(len(ys), BANDS, ROWS).all(2).argmax(1)
            near = (share >= SIGNATURE_LEAST) & (first == here)
            a.append(np.full(near.sum(), node[x]))
            b.append(node[ys[near]])
            agree.append(share[near])
        a, b, agree = (np.concatenate(x) if x else np.zeros(0) for x in (a, b, agree))
        # one row for a block, with its pairs packed
        out = pd.DataFrame({"cell": [cell], "i": [i], "j": [j], "a": [a.astype("<i8").tobytes()], "b": [b.astype("<i8").tobytes()], "agree": [agree.astype("<f4").tobytes()]})
        return out if len(a) else out[:0]

    near = durable(rest.groupBy("cell", "i", "j").applyInPandas(alike, "cell long, i int, j int, a binary, b binary, agree binary"))

    def nodes(batches):
        """The different nodes of a block's pairs."""
        for batch in batches:
            for k in range(batch.num_rows):
                both = np.unique(np.frombuffer(batch.column("a")[k].as_py() + batch.column("b")[k].as_py(), "<i8"))
                cell = [pa.array(np.full(len(both), batch.column(c)[k].as_py()), t) for c, t in (("cell", pa.int64()), ("i", pa.int32()), ("j", pa.int32()))]
                yield pa.RecordBatch.from_arrays([*cell, pa.array(both)], ["cell", "i", "j", "node"])

    asked = durable(near.mapInArrow(nodes, "cell long, i int, j int, node long"))
    full = asked.join(sets_of(asked.select("node").distinct()), "node")

    def confirmed(key, pairs: pd.DataFrame, sets: pd.DataFrame) -> pd.DataFrame:
        have = {n: np.frombuffer(x, "<u8") for n, x in zip(sets["node"], sets["shingle_set"])}
        a, b, agree = (np.frombuffer(b"".join(pairs[c]), t) for c, t in (("a", "<i8"), ("b", "<i8"), ("agree", "<f4")))
        forest, found = Forest(), []
        for k in np.lexsort((b, a, -agree)):  # the likeliest links first, so that the others are mostly connected by then
            x, y = int(a[k]), int(b[k])
            if x in have and y in have and forest.top(x) != forest.top(y) and linked(have[x], have[y]):
                forest.join(x, y)
                found.append((min(x, y), max(x, y)))
        return pd.DataFrame(found, columns=["a", "b"]).astype("i8")

    return near.groupBy("cell", "i", "j").cogroup(full.groupBy("cell", "i", "j")).applyInPandas(confirmed, "a long, b long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row."""
    rows = durable(hashed(docs))
    signed = durable(rows.where("sig is not null").groupBy("node").agg(F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands"), F.first("sig").alias("sig")))
    bands = shared_cells(signed.select(F.explode("bands").alias("cell"), "node"))

    def confirm(pairs: DataFrame) -> DataFrame:
        near = durable(_agreeing(pairs, signed))
        sets = durable(_sets(docs, rows, near.select(F.explode(F.array("a", "b")).alias("node")).distinct()))
        return _confirmed(near, sets)

    comps = linked_in_cells(bands, confirm, lambda rest: _across(rest, signed, lambda nodes: _sets(docs, rows, nodes)))
    found = rows.select("doc_id", "node", "n_shingles").join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    lowest = found.where("node is not null").groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    found = found.join(lowest, "comp", "left").withColumn("component_id", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")))
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows of docs, all columns, that near_duplicates() keeps; of rows alike in doc_id and text one."""
    kept = near_duplicates(docs).where("kept").select(F.col("doc_id").alias("_id")).distinct()
    rows = packed(docs).withColumns({"id": F.col("doc.doc_id"), "content": F.xxhash64("doc.text")}).join(kept, F.col("id").eqNullSafe(F.col("_id")), "left_semi")
    return unpacked(rows.dropDuplicates(["id", "content"]), docs)
