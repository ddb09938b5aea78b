"""The stored search index: entry documents, chunks with their lengths, postings; built once, read by searches, followed by batches of changes.

Entry documents are partitioned by source and sorted by path, so prefixes and single sources read few row groups; postings are sorted by token. Versions
are folders of their own; a manifest names those that are current, so readers never see a half-written index, and of two writers one goes on.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.functions.text import LONGEST_TOKEN, query_tokens, tokens
from larkspur.operators import content, rollup, search
from larkspur.plans.compile import Compiler
from larkspur.storage import Manifest, shared_dir

#: Entries and chunks of a file of the index, about.
FILE_ROWS, FILE_CHUNKS = 1_000_000, 50_000


def postings_of(chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(token, object_id, ordinal, tf) and (object_id, generation, ordinal, length) of chunks. A token's occurrences are counted in its chunk: runs of
    the sorted tokens, so nothing is shuffled."""
    found = chunks.select("object_id", "generation", "ordinal", tokens(F.col("text"), longest=LONGEST_TOKEN).alias("found"))
    lengths = found.select("object_id", "generation", "ordinal", F.size("found").alias("length"))
    dealt = found.where(F.size("found") > 0).select("object_id", "ordinal", F.sort_array("found").alias("found"))
    starts = F.filter(F.sequence(F.lit(0), F.size("found") - 1), lambda i: (i == 0) | (F.get("found", i) != F.get("found", i - 1)))
    runs = dealt.select("object_id", "ordinal", "found", starts.alias("starts"))
    each = F.transform("starts", lambda at, k: F.struct(F.get("found", at).alias("token"), (F.coalesce(F.get("starts", k + 1), F.size("found")) - at).cast("long").alias("tf")))
    return runs.select("object_id", "ordinal", F.inline(each)).select("token", "object_id", "ordinal", "tf"), lengths


class Index:
    """An index in a folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self.manifest = spark, folder, Manifest(spark, f"{folder}/manifest")

    def table(self, name: str) -> DataFrame:
        version = self.manifest.current()[1].get(name)
        if not version:
            raise LookupError(f"the index has no {name}")
        return self.spark.read.parquet(f"{self.folder}/{name}/{version}")

    def _write(self, name: str, rows: DataFrame, parts: int, *order: str, by: tuple[str, ...] = ()) -> dict:
        version = uuid.uuid4().hex
        dealt = rows.repartitionByRange(max(1, parts), *by, *order).sortWithinPartitions(*by, *order)
        dealt.write.partitionBy(*by).parquet(f"{self.folder}/{name}/{version}")
        return {name: version}

    def build(self, entries: DataFrame | None = None, chunks: DataFrame | None = None, generations: dict[int, int] | None = None) -> bool:
        """Write what is given anew. generations: the published generation of each source that the index then stands for."""
        number, state = self.manifest.current()
        new: dict = {}
        if entries is not None:
            docs = rollup.entry_documents(entries)
            new |= self._write("entry_doc", docs, -(-entries.count() // FILE_ROWS) * 4, "path", by=("source_id",))
        if chunks is not None:
            parts = -(-chunks.count() // FILE_CHUNKS) * 4
            postings, lengths = postings_of(chunks)
            new |= self._write("chunks", chunks, parts, "object_id", "ordinal") | self._write("postings", postings, parts, "token") | self._write("lengths", lengths, parts, "object_id", "ordinal")
        built = state.get("generations", {}) | {str(k): v for k, v in (generations or {}).items()}
        return self.manifest.advance(number, {**state, **new, "generations": built})

    def behind(self, published: dict[int, int]) -> list[int]:
        """Sources whose published generation the index doesn't stand for."""
        built = self.manifest.current()[1].get("generations", {})
        return sorted(s for s, g in published.items() if built.get(str(s)) != g)

    def entries(self) -> DataFrame:
        return self.table("entry_doc")

    def chunks(self) -> DataFrame:
        return self.table("chunks")

    def applied(self, changed: DataFrame, deleted: DataFrame, position: int) -> bool:
        """One batch of the follower: documents of changed objects replace those of the index, deleted ones (object_id) go; only if the batch goes on from
        where the index is, so a batch that comes twice is applied once. changed has the columns of entry documents."""
        number, state = self.manifest.current()
        if position <= state.get("position", 0):
            return False
        gone = deleted.select("object_id").unionByName(changed.select("object_id")).distinct()
        docs = self.entries().join(gone, "object_id", "left_anti").unionByName(changed.select(self.entries().columns))
        new = self._write("entry_doc", docs, -(-docs.count() // FILE_ROWS) * 4, "path", by=("source_id",))
        return self.manifest.advance(number, {**state, **new, "position": position})

    def store_content(self, objects: DataFrame, chunks: DataFrame) -> bool:
        """Content of objects (object_id, generation) at their new generation: their older chunks and over-long tails go, chunks come in."""
        number, state = self.manifest.current()
        kept = self.chunks().join(objects.select("object_id"), "object_id", "left_anti")
        fresh = chunks.join(objects.select("object_id", "generation"), ["object_id", "generation"], "left_semi")
        whole = kept.unionByName(fresh.select(kept.columns))
        parts = -(-whole.count() // FILE_CHUNKS) * 4
        postings, lengths = postings_of(whole)
        new = self._write("chunks", whole, parts, "object_id", "ordinal") | self._write("postings", postings, parts, "token") | self._write("lengths", lengths, parts, "object_id", "ordinal")
        return self.manifest.advance(number, {**state, **new})

    def bm25(self, query: str) -> DataFrame:
        """object_id, ordinal, score as content.bm25(), from postings and lengths: texts are not read."""
        words = list(dict.fromkeys(query_tokens(query)))
        lengths = self.table("lengths")
        if not words:
            return lengths.where(F.lit(False)).select("object_id", "ordinal", F.lit(0.0).alias("score"))
        found = self.table("postings").where(F.col("token").isin(words))
        stats = lengths.agg(F.count("*").alias("n"), F.avg("length").alias("mean")).first()
        often = {r.token: r.n for r in found.groupBy("token").agg(F.count("*").alias("n")).collect()}  # a row for each word of the query
        tf = found.groupBy("object_id", "ordinal").agg(*(F.max(F.when(F.col("token") == w, F.col("tf"))).alias(f"tf_{i}") for i, w in enumerate(words)))
        tf = tf.where(reduce(lambda a, b: a & b, [F.col(f"tf_{i}").isNotNull() for i in range(len(words))])).join(lengths, ["object_id", "ordinal"])
        return tf.select("object_id", "ordinal", content.bm25_score(words, often, stats["n"], stats["mean"]).alias("score"))

    def search(self, request: search.Request, compiler: Compiler | None = None) -> search.Response:
        has = self.manifest.current()[1]
        return search.search(self.entries(), request, self.chunks() if "chunks" in has else None, compiler, self.bm25 if "postings" in has else None)


_opened: dict[tuple[str, str], Index] = {}


def is_opened(spark: SparkSession, name: str) -> bool:
    """Whether opened() has built the index of this name."""
    return (spark.sparkContext.applicationId, name) in _opened


def opened(spark: SparkSession, name: str, entries=None, chunks=None) -> Index:
    """The index of this name in the shared folder, built at its first use in an application; entries() and chunks() give what it is built from."""
    key = (spark.sparkContext.applicationId, name)
    if key not in _opened:
        index = Index(spark, f"{shared_dir(spark)}/larkspur-index/{uuid.uuid4().hex}")
        index.build(entries() if entries else None, chunks() if chunks else None)
        _opened[key] = index
    return _opened[key]
