"""Katz backoff language model of bigrams, with Good-Turing discounts and exact normalisation.

P(w | h) = keep(h) * d(c) * c / c(h) for a seen bigram of count c, else alpha(h) * P(w); P(w) is the unigram
base (c(w) + 1) / (N + V + 1). d(c) discounts counts up to GT_MOST by Good-Turing, and
alpha(h) = (1 - sum of seen P(. | h)) / (1 - sum of P(w) of the seen w), so each context sums to 1. keep(h) is
c(h) / (c(h) + 1) where discounts leave no mass, else 1. A text's first word follows the end of a text.

A corpus of invented or rare words has nearly as many bigrams as tokens, so tables don't fit in a task, and a row
for each token is too much to shuffle. Instead texts become chunks of about CHUNK_TOKENS tokens: word numbers and
the 64-bit hashes of the chunk's words. Three times chunks ask hash-partitioned tables, and each key travels once
for each chunk that has it, packed:

1. word counts of the training rows -> c(w), N, V;
2. bigram counts -> c(h, w) and which chunk counts for the bigram in sums over seen bigrams; count-of-counts;
3. sums over seen bigrams by context -> keep(h), alpha(h).

Then each chunk scores its documents. A chunk is many rows, cells of at most PIECE_BYTES: whole chunks as rows fill the
JVM's heap and native memory. Its cells meet in one task and come to Python in order, a few at once, so a worker holds
one chunk however many its task has. Tables grow with the corpus and are spread over buckets of about BUCKET_KEYS
keys; a frequent word is one key of each chunk, so no bucket is hot. Hashes of 64 bits stand for words and bigrams.

Defined results: a null or empty text has just the end token; without training rows every word is unknown;
repeated rows count each time; rows with a null doc_id count as the id of empty text; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import WordHashes, durable, each, mix64, words_of

CHUNK_TOKENS = 1_500_000
BUCKET_KEYS = 1_500_000
GT_MOST = 5
PIECE_BYTES = 1 << 18
#: Rows that go to Python at once: of documents, and of cells.
TEXT_BATCH = 256
CELL_BATCH = 16
CELLS = "chunk long, kind string, bucket int, piece int, n long, data binary"
_END = b""


def pack(x: np.ndarray, sorted_: bool = False) -> bytes:
    """8-byte numbers as compressed byte planes; sorted ones as differences."""
    x = np.ascontiguousarray(x)
    if sorted_ and len(x):
        x = np.concatenate([x[:1], x[1:] - x[:-1]])
    return zstandard.compress(np.ascontiguousarray(x.view("u1").reshape(-1, 8).T), 1)


def unpack(data: bytes, dtype: str = "u8", sorted_: bool = False) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), "u1").reshape(8, -1)
    x = np.ascontiguousarray(planes.T).view(dtype).ravel()
    return np.cumsum(x, dtype=dtype) if sorted_ else x


def _batch(names: list[str], columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(columns, names)


def _pieces(data: bytes) -> Iterator[tuple[int, bytes]]:
    return ((at // PIECE_BYTES, data[at : at + PIECE_BYTES]) for at in range(0, max(1, len(data)), PIECE_BYTES))


def _cell(chunk: int, kind: str, data: bytes, n: int = 0) -> Iterator[pa.RecordBatch]:
    """A cell of a chunk as rows; n: its size, in the first of them."""
    for piece, part in _pieces(data):
        cells = [chunk, kind, 0, piece, 0 if piece else n, part]
        kinds = [pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.binary()]
        yield _batch(["chunk", "kind", "bucket", "piece", "n", "data"], [pa.array([c], k) for c, k in zip(cells, kinds)])


def chunked(docs: DataFrame, train: Column) -> DataFrame:
    """Cells of chunks of about CHUNK_TOKENS tokens. words: hashes, most frequent first; tokens: numbers of words, ends included."""

    def run(batches):
        hashes = WordHashes()
        part, number, ids, flags, parts, size = TaskContext.get().partitionId(), 0, [], [], [], 0

        def emit(chunk: int):
            sizes, trained, every = np.array([len(p) for p in parts], "i8"), np.array(flags, bool), np.concatenate(parts)
            absent, known = np.array([i is None for i in ids]), np.array([i or 0 for i in ids], "i8")
            for used in (ids, flags, parts):
                used.clear()
            n = len(every)
            words, tokens, often = np.unique(every, return_inverse=True, return_counts=True)
            del every
            order = np.argsort(-often, kind="stable")
            rank = np.empty(len(order), np.int32)
            rank[order] = np.arange(len(order))
            tokens, words = rank[tokens], words[order]
            del order, rank, often
            counts = np.bincount(tokens[np.repeat(trained, sizes)], minlength=len(words))
            yield from _cell(chunk, "ids", pack(known))
            yield from _cell(chunk, "absent", absent.tobytes())
            yield from _cell(chunk, "train", trained.tobytes())
            yield from _cell(chunk, "sizes", pack(sizes))
            yield from _cell(chunk, "counts", pack(counts.astype("u8")))
            yield from _cell(chunk, "words", pack(words, True), len(words))
            yield from _cell(chunk, "tokens", pack(tokens.astype("u8")), n)

        for batch in batches:
            for doc_id, text, flag in zip(*(each(batch.column(c)) for c in ("doc_id", "text", "train"))):
                ids.append(doc_id)
                flags.append(bool(flag))
                parts.append(hashes.of([*words_of(text), _END]))
                size += len(parts[-1])
                if size >= CHUNK_TOKENS:
                    yield from emit((part << 32) | number)
                    number, size = number + 1, 0
        if ids:
            yield from emit((part << 32) | number)

    return docs.select("doc_id", "text", train.alias("train")).mapInArrow(run, CELLS)


class Chunk:
    """A chunk with what it has been told so far. cells: kind -> bucket -> pieces; those that are read go."""

    def __init__(self, number: int, cells: dict[str, dict[int, list[bytes]]]):
        self.id, self.cells = number, cells
        self.words = unpack(self.take("words"), sorted_=True)
        self.by_hash = np.argsort(self.words).astype(np.int32)

    def take(self, kind: str) -> bytes:
        return b"".join(self.cells.pop(kind)[0])

    def answers(self, name: str, dtype: str = "u8") -> np.ndarray:
        """Answers in order of keys: buckets are ranges of them."""
        told = self.cells.pop(name)
        return np.concatenate([unpack(b"".join(told.pop(bucket)), dtype) for bucket in sorted(told)])

    def count(self) -> np.ndarray:
        """c(w) of the chunk's words."""
        c = np.empty(len(self.words), "u8")
        c[self.by_hash] = self.answers("unigrams")
        return c.astype("f8")

    def pairs(self) -> np.ndarray:
        """Hashes of the chunk's distinct bigrams in order; sets (h, w) of each, and each token's place among them."""
        self.tokens = unpack(self.take("tokens")).astype(np.int32)
        self.train, self.sizes = np.frombuffer(self.take("train"), bool), unpack(self.take("sizes"), "i8")
        pair = np.empty(len(self.tokens), np.int64)
        pair[0], pair[1:] = self.tokens[-1], self.tokens[:-1]
        pair *= len(self.words)
        pair += self.tokens
        pair, place = np.unique(pair, return_inverse=True)
        place = place.astype(np.int32)
        h, w = (x.astype(np.int32) for x in np.divmod(pair, len(self.words)))
        del pair
        with np.errstate(over="ignore"):
            mixed = mix64(self.words)[h]
            mixed *= np.uint64(0x9E3779B97F4A7C15)
            mixed += self.words[w]
            mixed = mix64(mixed)
        order = np.argsort(mixed)
        back = np.empty(len(order), np.int32)
        back[order] = np.arange(len(order))
        self.h, self.w, self.place = h[order], w[order], back[place]
        return mixed[order]


def _chunks(batches) -> Iterator[Chunk]:
    """Chunks of cells that come in order."""
    at, cells = None, {}
    for batch in batches:
        for number, kind, bucket, data in zip(*(each(batch.column(c)) for c in ("chunk", "kind", "bucket", "data"))):
            if number != at and cells:
                whole, cells = cells, {}
                yield Chunk(at, whole)
            at = number
            cells.setdefault(kind, {}).setdefault(bucket, []).append(data)
    if cells:
        yield Chunk(at, cells)


def _gathered(cells: DataFrame, *kinds: str) -> DataFrame:
    """The cells of these kinds, those of a chunk one after the other."""
    return cells.where(F.col("kind").isin(*kinds)).repartition("chunk").sortWithinPartitions("chunk", "kind", "bucket", "piece")


def _asked(cells: DataFrame, bits: int, ask) -> DataFrame:
    """(bucket, chunk, keys, values): each chunk's sorted keys, cut by their top bits."""

    def run(batches):
        for chunk in _chunks(batches):
            number, (keys, values) = chunk.id, ask(chunk)
            del chunk
            edges = np.searchsorted(keys, np.arange(1, 2**bits, dtype="u8") << np.uint64(64 - bits)) if bits else []
            cuts = [0, *edges, len(keys)]
            spans = [(b, s, e) for b, (s, e) in enumerate(zip(cuts, cuts[1:])) if s < e]
            for i in range(0, len(spans), CELL_BATCH):
                some = spans[i : i + CELL_BATCH]
                columns = [pa.array([b for b, _, _ in some], pa.int32()), pa.array([number] * len(some), pa.int64()), pa.array([pack(keys[s:e], True) for _, s, e in some], pa.binary())]
                yield _batch(["bucket", "chunk", "keys", "values"], [*columns, pa.array([[pack(v[s:e]) for v in values] for _, s, e in some], pa.list_(pa.binary()))])

    return cells.mapInArrow(run, "bucket int, chunk long, keys binary, values array<binary>")


def _answered(asked: DataFrame, name: str, answer) -> DataFrame:
    """Cells of chunks, aligned with their keys, and one of kind "statistics" with the bucket's statistics."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("chunk")
        keys = [unpack(k, sorted_=True) for k in part["keys"]]
        found, stats = answer(np.concatenate(keys), [np.concatenate([unpack(v[j], "u8") for v in part["values"]]) for j in range(len(part["values"].iloc[0]))])
        ends, bucket = np.cumsum([len(k) for k in keys]), part["bucket"].iloc[0]
        rows = [(chunk, name, bucket, piece, 0, data) for chunk, x in zip(part["chunk"], np.split(found, ends[:-1])) for piece, data in _pieces(pack(x))]
        rows.append((-1, "statistics", bucket, 0, 0, np.asarray(stats, "<f8").tobytes()))
        return pd.DataFrame(rows, columns=["chunk", "kind", "bucket", "piece", "n", "data"])

    return asked.groupBy("bucket").applyInPandas(run, CELLS)


def _stats(answers: DataFrame) -> np.ndarray:
    """Sum over the buckets, of which each gives a few numbers: a row of sums for each task, then one of all."""

    def add(batches):
        total = [np.frombuffer(cell, "<f8") for batch in batches for cell in batch.column("data").to_pylist()]
        if total:
            yield _batch(["at", "value"], [pa.array(range(len(total[0])), pa.int32()), pa.array(sum(total))])

    sums = answers.where("kind = 'statistics'").select("data").mapInArrow(add, "at int, value double").groupBy("at").agg(F.sum("value").alias("value"))
    found = sums.orderBy("at").collect()  # a few rows
    return np.array([row.value for row in found]) if found else 0


def _count_words(keys, values):
    distinct, place = np.unique(keys, return_inverse=True)
    total = np.zeros(len(distinct), "u8")
    np.add.at(total, place, values[0])
    return total[place], [float(total.sum()), float((total > 0).sum())]


def _count_bigrams(keys, values):
    """Twice the count, plus 1 for the first chunk that has the bigram in training rows."""
    distinct, place = np.unique(keys, return_inverse=True)
    total = np.zeros(len(distinct), "u8")
    np.add.at(total, place, values[0])
    trained = np.flatnonzero(values[0] > 0)
    _, first = np.unique(place[trained], return_index=True)
    owner = np.zeros(len(keys), "u8")
    owner[trained[first]] = 1
    return total[place] * np.uint64(2) + owner, np.bincount(np.minimum(total, GT_MOST + 2).astype(int), minlength=GT_MOST + 3).astype(float)


def _add_sums(keys, values):
    distinct, place = np.unique(keys, return_inverse=True)
    out = [np.bincount(place, v.view("f8"), len(distinct))[place] for v in values]
    # both sums of a key stand side by side, so one answer holds them
    return np.stack(out, 1), []


def discounts(n: np.ndarray, most: int = GT_MOST) -> np.ndarray:
    """d(0..most) of Good-Turing from count-of-counts n; where these are too sparse, counts lose a half."""
    d = np.ones(most + 1)
    for r in range(1, most + 1):
        with np.errstate(divide="ignore", invalid="ignore"):
            tail = (most + 1) * n[most + 1] / n[1]
            value = ((r + 1) * n[r + 1] / (r * n[r]) - tail) / (1 - tail)
        d[r] = value if 0 < value < 1 else (r - 0.5) / r
    return d


def _bits(keys: int) -> int:
    return max(0, int(np.ceil(np.log2(max(1, keys / BUCKET_KEYS)))))


def score(docs: DataFrame, train: Column) -> DataFrame:
    """doc_id, train, n_tokens, n_known, train_tokens, base_score, score of each row; train marks rows to learn from."""
    cells = durable(chunked(docs, train), batch=TEXT_BATCH)
    tokens, words = cells.agg(*(F.sum(F.when(F.col("kind") == kind, F.col("n"))) for kind in ("tokens", "words"))).first()

    def answers(name: str, kinds: list[str], keys: int | None, ask, answer) -> DataFrame:
        return durable(_answered(_asked(_gathered(cells, *kinds), _bits(keys or 0), ask), name, answer), batch=CELL_BATCH)

    def ask_words(c: Chunk):
        return c.words[c.by_hash], [unpack(c.take("counts"))[c.by_hash]]

    unigrams = answers("unigrams", ["words", "counts"], words, ask_words, _count_words)
    known = _stats(unigrams)
    n, v = (float(x) for x in known) if np.ndim(known) else (0.0, 0.0)
    kinds = ["words", "tokens", "train", "sizes"]

    def ask_bigrams(c: Chunk):
        key = c.pairs()
        of_train = np.repeat(c.train, c.sizes)
        return key, [np.bincount(c.place[of_train], minlength=len(key)).astype("u8")]

    bigrams = answers("bigrams", kinds, tokens, ask_bigrams, _count_bigrams)
    often = _stats(bigrams)
    d = discounts(often if np.ndim(often) else np.zeros(GT_MOST + 3))
    cells, kinds = cells.union(unigrams).union(bigrams), [*kinds, "unigrams", "bigrams"]

    def seen(c: Chunk):
        """Count and undiscounted-mass parts of the chunk's bigrams: c(h, w), owner, d * c / c(h), P(w)."""
        c.pairs()
        count, told = c.count(), c.answers("bigrams")
        own = (told & np.uint64(1)).astype(bool)
        told >>= np.uint64(1)
        both = told.astype("f8")
        share = d[np.where(both <= GT_MOST, both, 0).astype("i1")]
        share *= both
        share /= np.maximum(1, count)[c.h]
        return count, both, own, share, ((count + 1) / (n + v + 1))[c.w]

    def ask_sums(c: Chunk):
        _, _, own, share, base = seen(c)
        sums = [np.bincount(c.h[own], x[own], len(c.words))[c.by_hash] for x in (share, base)]
        return c.words[c.by_hash], [x.view("u8") for x in sums]

    sums = answers("sums", kinds, words, ask_sums, _add_sums)
    cells, kinds = cells.union(sums), [*kinds, "sums", "ids", "absent"]
    names = ["doc_id", "train", "n_tokens", "n_known", "base_score", "score"]

    def run(batches):
        for c in _chunks(batches):
            count, both, _, share, base = seen(c)
            total = np.empty((len(c.words), 2))
            total[c.by_hash] = c.answers("sums", "f8").reshape(-1, 2)
            used, shared = total.T
            keep = np.where(used >= 1 - 1e-9, count / (count + 1), 1.0)
            p = ((1 - keep * used) / (1 - shared))[c.h]  # alpha
            p *= base
            share *= keep[c.h]
            np.copyto(p, share, where=both > 0)
            np.log10(p, out=p)
            starts = np.concatenate([[0], np.cumsum(c.sizes)[:-1]])
            of_docs = [np.add.reduceat(x[at], starts) for x, at in ((np.log10((count + 1) / (n + v + 1)), c.tokens), (p, c.place), ((count > 0).astype("i8"), c.tokens))]
            ids = pa.array(unpack(c.take("ids"), "i8"), mask=np.frombuffer(c.take("absent"), bool))
            yield _batch(names, [ids, pa.array(c.train), pa.array(c.sizes), pa.array(of_docs[2]), pa.array(of_docs[0]), pa.array(of_docs[1])])
            del c, both, share, base, p

    scored = _gathered(cells, *kinds).mapInArrow(run, "doc_id long, train boolean, n_tokens long, n_known long, base_score double, score double")
    return durable(scored, batch=CELL_BATCH).withColumn("train_tokens", F.lit(int(n)).cast("long"))
