"""Quality classifier: random-indexing word vectors, pooled, then a small calibrated network.

1. Each hashed word has a fixed sparse index vector of +1 and -1. A word's context vector is the
   sum of the index vectors within WINDOW places of all its occurrences in all documents; tasks
   add up in integers, so the result doesn't depend on how rows are dealt.
2. A document's features are the mean and the spread of its words' context vectors.
3. A two-layer network is trained in numpy by the driver on at most MAX_LABELLED labelled rows (the
   smallest by hash of doc_id) outside the held-out third; a fifth of them sets the temperature.
4. All documents are scored. Labels, language, source and doc_id are no inputs.

Scale: two scans of the texts; the vector table has HASHED_WORDS rows whatever the corpus, so it
may be collected and broadcast; partial tables are added in two levels.

Defined results: null and empty texts have zero features and get the network's score for these;
null labels are ignored, of several labels of one doc_id the highest counts, and labels of unknown
documents don't matter; with labels of one class or none, the score is that class or 0.5; repeated
rows score alike; an empty table gives no rows.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import WordCache, crc_mod, durable, each

HASHED_WORDS = 16_384
DIMS = 64
NONZERO = 8
WINDOW = 2
HIDDEN = 32
MAX_LABELLED = 20_000
HELD_OUT_MOD, HELD_OUT_IS = 3, 1
SLICES, LANES = 64, 512
#: Words whose contexts are added at once.
BLOCK_WORDS = 40_000
_TOKENS = re.compile(rb"[A-Za-z\x80-\xff]+|[0-9]+|[^\sA-Za-z0-9\x80-\xff]+").findall


def index_vectors() -> np.ndarray:
    """HASHED_WORDS sparse vectors, and a zero one for places without a word."""
    rng = np.random.Generator(np.random.PCG64(7))
    table = np.zeros((HASHED_WORDS + 1, DIMS), np.int8)
    at = rng.permuted(np.tile(np.arange(DIMS), (HASHED_WORDS, 1)), axis=1)[:, :NONZERO]
    np.put_along_axis(table[:-1], at, rng.choice(np.array([-1, 1], np.int8), at.shape), axis=1)
    return table


class WordIds(WordCache):
    """Rows of words in the table of vectors."""

    def value(self, word: bytes) -> int:
        return xxhash.xxh3_64_intdigest(word) % HASHED_WORDS

    def of(self, text: str | None) -> np.ndarray:
        words = _TOKENS(text.encode("utf-8", "surrogatepass")) if text else []
        return np.fromiter(map(self.__getitem__, words), np.uint16, len(words))


def _add_contexts(total: np.ndarray, ids: np.ndarray, index: np.ndarray) -> None:
    """Add each place's context to its word's row; ids has WINDOW empty places around each document."""
    place = index[ids]
    context = np.zeros_like(place)
    for step in range(1, WINDOW + 1):
        context[step:] += place[:-step]
        context[:-step] += place[step:]
    order = np.argsort(ids, kind="stable")
    words, starts = np.unique(ids[order], return_index=True)
    total[words, :DIMS] += np.add.reduceat(context[order], starts, axis=0, dtype=np.int64)
    total[words, DIMS] += np.diff(np.append(starts, len(ids)))


def context_vectors(docs: DataFrame) -> np.ndarray:
    """The context vectors of all documents' words, of unit length, and a zero row."""

    def count(batches):
        index, ids = index_vectors(), WordIds()
        total, gap = np.zeros((HASHED_WORDS + 1, DIMS + 1), np.int64), np.full(WINDOW, HASHED_WORDS, np.uint16)
        block, size = [gap], 0
        for batch in batches:
            for text in each(batch.column(0)):
                block += [ids.of(text), gap]
                size += len(block[-2])
                if size > BLOCK_WORDS:
                    _add_contexts(total, np.concatenate(block), index)
                    block, size = [gap], 0
        if size:
            _add_contexts(total, np.concatenate(block), index)
        small = np.abs(total).max() < 2**31
        parts = np.array_split(total[:-1].astype("<i4" if small else "<i8"), SLICES)
        lane = int(np.random.default_rng().integers(LANES))  # sums don't depend on it
        yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array([lane] * SLICES, pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())], ["slice", "lane", "sums"])

    def add(part: pd.DataFrame) -> pd.DataFrame:
        cells, total = HASHED_WORDS // SLICES * (DIMS + 1), 0
        for sums in part["sums"]:
            total = total + np.frombuffer(sums, "<i4" if len(sums) == 4 * cells else "<i8").astype("<i8")
        return part.iloc[:1].assign(sums=[total.tobytes()])

    schema = "slice int, lane int, sums binary"
    partial = docs.select("text").mapInArrow(count, schema)
    total = partial.groupBy("slice", "lane").applyInPandas(add, schema).groupBy("slice").applyInPandas(add, schema)
    parts = {r.slice: np.frombuffer(r.sums, "<i8") for r in total.collect()}
    table = np.concatenate([parts[i] for i in range(SLICES)]).reshape(HASHED_WORDS, -1)[:, :DIMS] if parts else np.zeros((HASHED_WORDS, DIMS))
    table = table / np.maximum(1e-9, np.sqrt((table.astype(float) ** 2).sum(1, keepdims=True)))
    return np.vstack([table, np.zeros((1, DIMS))]).astype(np.float32)


def pooled(texts: pa.Array, ids: WordIds, vectors: np.ndarray) -> np.ndarray:
    """Features of texts: mean and standard deviation of the word vectors."""
    out = np.zeros((len(texts), 2 * DIMS))
    for i, text in enumerate(each(texts)):
        words = ids.of(text)
        if len(words):
            kinds, counts = np.unique(words, return_counts=True)
            rows, share = vectors[kinds], (counts / len(words)).astype(np.float32)
            mean = share @ rows
            out[i] = np.concatenate([mean, np.sqrt(np.maximum(0, share @ rows**2 - mean**2))])
    return out


class Network:
    """tanh layer and logistic output, standardized inputs, temperature."""

    def __init__(self, x: np.ndarray, y: np.ndarray, epochs: int = 60, seed: int = 3):
        self.prior = float(y.mean()) if len(y) else 0.5
        self.trained = bool(len(y)) and 0 < self.prior < 1
        if not self.trained:
            return
        rng = np.random.Generator(np.random.PCG64(seed))
        self.center, self.width = x.mean(0), x.std(0) + 1e-6
        x, check = (x - self.center) / self.width, rng.random(len(y)) < 0.2
        if len(set(y[~check])) < 2:
            check[:] = False
        w = [rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
        m, v, t = [np.zeros_like(p) for p in w], [np.zeros_like(p) for p in w], 0
        rows = np.flatnonzero(~check)
        for epoch in range(epochs):
            rng.shuffle(rows)
            for at in range(0, len(rows), 128):
                a, b = x[rows[at : at + 128]], y[rows[at : at + 128]]
                h = np.tanh(a @ w[0] + w[1])
                e = (1 / (1 + np.exp(-(h @ w[2] + w[3]))) - b) / len(b)
                back = np.outer(e, w[2]) * (1 - h**2)
                t += 1
                for i, g in enumerate([a.T @ back + 1e-4 * w[0], back.sum(0), h.T @ e + 1e-4 * w[2], e.sum(keepdims=True)]):
                    m[i] = 0.9 * m[i] + 0.1 * g
                    v[i] = 0.999 * v[i] + 0.001 * g**2
                    w[i] = w[i] - 0.003 * (1 - epoch / epochs) * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
        self.w, self.temperature = w, 1.0
        if check.any():
            z, b = self.logit(x[check]), y[check]
            grid = np.exp(np.linspace(np.log(0.25), np.log(8), 60))
            self.temperature = float(min(grid, key=lambda t: float(np.logaddexp(0, -np.where(b > 0, z, -z) / t).mean())))

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(x @ self.w[0] + self.w[1]) @ self.w[2] + self.w[3]

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.trained:
            return np.full(len(x), self.prior)
        z = self.logit((x - self.center) / self.width) / self.temperature
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


class Model:
    """Word vectors and the network; fixed in size."""

    def __init__(self, vectors: np.ndarray, network: Network):
        self.vectors, self.network = vectors, network

    def score(self, texts: pa.Array, ids: WordIds) -> np.ndarray:
        return self.network.score(pooled(texts, ids, self.vectors))


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> Model:
    """Vectors from all documents, the network from at most max_labelled labelled ones."""
    vectors = context_vectors(docs)
    shared = docs.sparkSession.sparkContext.broadcast(vectors)
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    known = known.where(crc_mod(F.col("doc_id"), HELD_OUT_MOD) != HELD_OUT_IS)
    known = known.join(docs.select("doc_id").distinct(), "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)

    def run(batches):
        ids = WordIds()
        for batch in batches:
            x = pooled(batch.column("text"), ids, shared.value).astype("<f4")
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("quality"), pa.array([r.tobytes() for r in x], pa.binary())], ["doc_id", "quality", "features"])

    # at most max_labelled ids, whatever the tables' size
    rows = docs.select("doc_id", "text").join(F.broadcast(durable(known)), "doc_id").select("doc_id", F.col("quality").cast("int").alias("quality"), "text")
    sample = rows.mapInArrow(run, "doc_id long, quality int, features binary").toPandas().drop_duplicates("doc_id").sort_values("doc_id")
    x = np.frombuffer(b"".join(sample["features"]), "<f4").reshape(-1, 2 * DIMS).astype(float)
    return Model(vectors, Network(x, sample["quality"].to_numpy(float)))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted for each row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        ids = WordIds()
        for batch in batches:
            found = shared.value.score(batch.column("text"), ids)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.float64())], ["doc_id", "score"])

    scored = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", (crc_mod(F.col("doc_id"), HELD_OUT_MOD) == HELD_OUT_IS).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def accept(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The rows of docs, all columns, that score at least so high."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        ids = WordIds()
        for batch in batches:
            yield batch.filter(pa.array(shared.value.score(batch.column("text"), ids) >= least))

    return docs.mapInArrow(run, docs.schema)
