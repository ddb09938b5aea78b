"""What the training-data operators share: tables, durable intermediates, words and hashes."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
import xxhash
from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.storage import shared_dir

#: Java regular expression of one word: a run without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Row groups of rows with large cells: a writer holds one, and a reader takes thousands of rows of one at once.
_LARGE_CELLS = {"parquet.block.size": str(8 << 20), "parquet.page.size.row.check.min": "8"}
#: A worker's word cache is emptied at this size and keeps no longer words, so its memory is bounded.
CACHE_WORDS = 100_000
LONGEST_CACHED = 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_scratch: ContextVar[list[str] | None] = ContextVar("scratch", default=None)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that durable() writes inside are deleted at the end, but for those that are kept; what is read later must come from these."""
    paths: list[str] = []
    token = _scratch.set(paths)
    try:
        yield
    finally:
        _scratch.reset(token)
        for name in paths:
            path = spark._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def trim(spark: SparkSession) -> str:
    """Give back native memory that the driver's JVM has freed (of its compilers and codecs), which the C library else
    keeps: some 200 MB after many queries. What the JVM says of it; empty if this JVM can't."""
    jvm = spark._jvm
    try:
        server = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
        # through the interface, as the server's own class is closed to py4j
        invoke = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
        call = spark.sparkContext._gateway.new_array(jvm.java.lang.Object, 4)
        call[0], call[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        return invoke.invoke(server, call)
    except Py4JError:
        return ""


def durable(df: DataFrame, kept: bool = False, batch: int = 0) -> DataFrame:
    """Cut the lineage: write to the shared folder and read back. batch, for rows with large cells: so many at once go to
    Python, as a batch lies in the JVM's native memory twice, in buffers that grow by doubling; and row groups are small."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/larkspur/{uuid.uuid4().hex}"
    if not kept and (paths := _scratch.get()) is not None:
        paths.append(path)
    # shuffle files of what is written are of no more use
    held = {_CLEAN: "true"} | ({_BATCH: str(batch)} if batch else {})
    before = {key: spark.conf.get(key, default) for key, default in ((_CLEAN, "false"), (_BATCH, "10000")) if key in held}
    for key, value in held.items():
        spark.conf.set(key, value)
    try:
        df.write.options(**_LARGE_CELLS if batch else {}).option("compression", "zstd").parquet(path)
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    trim(spark)
    return spark.read.schema(df.schema).parquet(path)


def packed(docs: DataFrame) -> DataFrame:
    """The rows as one column `doc`, so that no name of theirs can clash with a helper's."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"))


def unpacked(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of docs again."""
    return rows.select(*(F.col("doc").getField(c).alias(c) for c in docs.columns))


def crc_mod(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def words_of(text: str | None) -> list[bytes]:
    """Words with A-Z in lower case; bytes.split() knows just the six ASCII white-space bytes."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def each(column: pa.Array) -> Iterator:
    """A batch's values one after the other, so that a worker holds no second copy of all of them."""
    return (value.as_py() for value in column)


class WordCache(dict):
    """word -> number, by value(); words over LONGEST_CACHED bytes are not kept, and it is emptied at CACHE_WORDS."""

    def value(self, word: bytes) -> int:
        raise NotImplementedError

    def __missing__(self, word: bytes) -> int:
        number = self.value(word)
        if len(word) <= LONGEST_CACHED:
            if len(self) >= CACHE_WORDS:
                self.clear()
            self[word] = number
        return number


class WordHashes(WordCache):
    """64-bit hashes of words."""

    value = staticmethod(xxhash.xxh3_64_intdigest)

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix64(x: np.ndarray) -> np.ndarray:
    """The finalizer of SplitMix64, on uint64."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def shingles(hashes: np.ndarray, width: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of word windows; the whole sequence if it is shorter."""
    n = len(hashes)
    if not n:
        return hashes
    size = min(width, n)
    with np.errstate(over="ignore"):
        value = np.full(n - size + 1, size, np.uint64)
        for i in range(size):
            value = mix64(value * np.uint64(0x9E3779B97F4A7C15) + hashes[i : n - size + 1 + i])
    return np.unique(value)
