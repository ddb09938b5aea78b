"""Text files: encoding, chunks on line ends, content-defined chunks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SNIFF, MAX_CONTROL = 8192, 0.05
CHUNK_BYTES, MAX_LINE = 16_384, 262_144
CDC_MIN, CDC_MEAN, CDC_MAX = 4096, 16_384, 65_536


def sniff(head: bytes) -> str | None:
    """Encoding of a file by its first bytes; None for binary. BOM, then zeros in even or odd places, then UTF-8, then a single-byte code."""
    for mark, name in ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16")):
        if head.startswith(mark):
            return name
    head = head[:SNIFF]
    if not head:
        return "utf-8"
    if b"\0" in head:
        even, odd = head[::2].count(0), head[1::2].count(0)
        half = max(1, len(head) // 2)
        return "utf-16-le" if odd > 0.4 * half and even < 0.05 * half else "utf-16-be" if even > 0.4 * half and odd < 0.05 * half else None
    control = sum(b < 32 and b not in (9, 10, 12, 13, 27) for b in head)
    if control > MAX_CONTROL * len(head):
        return None
    for cut in range(4):
        try:
            head[: len(head) - cut].decode("utf-8")
            return "utf-8"
        except UnicodeDecodeError:
            if len(head) < SNIFF:
                break
    return "cp1252"


def _boundary(data: bytes, end: int) -> int:
    """The last start of a UTF-8 character at or before end."""
    while end > 0 and end < len(data) and data[end] & 0xC0 == 0x80:
        end -= 1
    return end


def chunk_lines(text: str, target: int = CHUNK_BYTES, longest: int = MAX_LINE) -> Iterator[dict]:
    """Chunks of whole lines (ended by \\n) of at least `target` bytes; a line over `longest` bytes is cut between characters. Byte
    ranges [byte_start, byte_end), the first line and the number of line ends, the text as it is, and whether a chunk cuts a line."""
    data = text.encode("utf-8", "surrogatepass")
    ordinal = start = at = line = lines = 0
    split = False
    while at < len(data):
        end = data.find(b"\n", at) + 1
        if whole := 0 < end <= at + longest:
            lines += 1
        else:
            end = len(data) if not end and len(data) - at < longest else _boundary(data, at + longest)
            end = end if end > at else len(data)
        split, at = not whole, end
        if at - start >= target or at == len(data):
            yield {"ordinal": ordinal, "byte_start": start, "byte_end": at, "first_line": line, "lines": lines, "text": data[start:at].decode("utf-8", "surrogatepass"), "split_line": split}
            ordinal, start, line, lines, split = ordinal + 1, at, line + lines, 0, False


_CHUNK_SCHEMA = "object_id long, generation long, ordinal int, byte_start long, byte_end long, first_line long, lines long, text string, split_line boolean"
#: Text and rows of a batch that goes back to the JVM, about.
BATCH_BYTES, BATCH_ROWS = 1 << 20, 1000


def chunked(texts: DataFrame) -> DataFrame:
    """Chunks of rows (object_id, generation, text). A worker takes one text at a time out of what it is sent and gives back batches of bounded
    size, so its memory doesn't follow the texts, and short texts don't make a batch each."""
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}
    schema = pa.schema([(name, kinds[kind]) for name, kind in (c.split() for c in _CHUNK_SCHEMA.split(", "))])

    def run(batches):
        for b in batches:
            rows, held = [], 0
            for o, g, t in zip(*(b.column(c) for c in ("object_id", "generation", "text"))):
                o, g = o.as_py(), g.as_py()
                for c in chunk_lines(t.as_py() or ""):
                    rows.append({"object_id": o, "generation": g, **c})
                    held += c["byte_end"] - c["byte_start"]
                    if held >= BATCH_BYTES or len(rows) >= BATCH_ROWS:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema)

    return texts.select("object_id", "generation", "text").mapInArrow(run, _CHUNK_SCHEMA)


def extract(spark: SparkSession, path: str, most_bytes: int = 1 << 30) -> DataFrame:
    """path, state, encoding and text of files, read by Spark's binary source. Files over most_bytes (the source's own limit is 2 GB)
    are not read: their state is `partial`, their text null."""

    def run(batches):
        for b in batches:
            kinds = [sniff(c) for c in b["content"]]
            yield pd.DataFrame({"path": b["path"], "state": ["unsupported" if k is None else "indexed" for k in kinds], "encoding": kinds, "text": [None if k is None else bytes(c).decode(k, "replace") for c, k in zip(b["content"], kinds)]})

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    large = files.where(F.col("length") > most_bytes).select("path", F.lit("partial").alias("state"), F.lit(None).cast("string").alias("encoding"), F.lit(None).cast("string").alias("text"))
    files = files.where(F.col("length") <= most_bytes)
    return large.unionByName(_read(files, run))


def _read(files: DataFrame, run) -> DataFrame:
    return files.select("path", "content").mapInPandas(run, "path string, state string, encoding string, text string")


_GEAR = np.random.Generator(np.random.PCG64(64)).integers(0, 2**64, 256, np.uint64)


def cut_points(data: bytes, least: int = CDC_MIN, mean: int = CDC_MEAN, most: int = CDC_MAX) -> list[int]:
    """Ends of content-defined chunks. A gear hash starts anew at each cut, at the byte that makes the chunk `least` long; a chunk ends where its low
    bits are 0: one bit more than log2(mean) before the mean size, one less after it, or at `most` bytes."""
    bits = round(np.log2(max(2, mean)))
    strict, loose = np.uint64((1 << (bits + 1)) - 1), np.uint64((1 << (bits - 1)) - 1)
    gear = _GEAR[np.frombuffer(data, np.uint8)]
    ends, start = [], 0
    with np.errstate(over="ignore"):
        while start < len(gear):
            first, stop = start + least - 1, min(start + most, len(gear))
            part = gear[first:stop]
            # a byte's part leaves the low bits after as many steps as there are bits
            rolling = np.zeros(len(part), np.uint64)
            for i in range(min(bits + 1, len(part))):
                rolling[i:] += part[: len(part) - i] << np.uint64(i)
            sizes = np.arange(least, least + len(part))
            hit = np.flatnonzero(rolling & np.where(sizes < mean, strict, loose) == 0)
            start = first + int(hit[0]) + 1 if len(hit) else stop
            ends.append(start)
    return ends


def looks_textual(sample: bytes) -> bool | None:
    """No zero byte and nine tenths printable; None for an empty sample."""
    if not sample:
        return None
    odd = sum(b < 32 and b not in (9, 10, 13) or b == 127 for b in sample)
    return b"\0" not in sample and 10 * (len(sample) - odd) >= 9 * len(sample)


def content_defined(texts: DataFrame) -> DataFrame:
    """object_id, ordinal, bytes, chunk_hash of content-defined chunks."""
    import hashlib

    def run(batches):
        for b in batches:
            rows = []
            for o, t in zip(b["object_id"], b["text"]):
                data, start = (t or "").encode(), 0
                for i, end in enumerate(cut_points(data)):
                    rows.append((o, i, end - start, hashlib.sha256(data[start:end]).hexdigest()))
                    start = end
            yield pd.DataFrame(rows, columns=["object_id", "ordinal", "bytes", "chunk_hash"])

    return texts.select("object_id", "text").mapInPandas(run, "object_id long, ordinal int, bytes long, chunk_hash string")
