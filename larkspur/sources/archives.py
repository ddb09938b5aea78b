"""ZIP inventories: the central directory only, nothing is unpacked."""

from __future__ import annotations

import calendar
import io
import zipfile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

#: Bits that mark odd member names.
FLAGS = {"traversal": 1, "absolute": 2, "backslash": 4, "control": 8, "duplicate": 16, "encoding": 32, "empty": 64}
#: Rows of a data frame that a task emits at once.
ROWS = 100_000
_SCHEMA = "container string, ordinal int, path string, name string, parent string, raw_name string, is_dir boolean, implicit boolean, encrypted boolean, size long, compressed long, method int, crc32 long, modified long, flags int, error string"


def clean_name(raw: str) -> tuple[str, int]:
    """The path inside the archive, without what leads outside, and flags of what was odd."""
    flags = 0
    if "\\" in raw:
        flags, raw = flags | FLAGS["backslash"], raw.replace("\\", "/")
    if raw.startswith("/"):
        flags |= FLAGS["absolute"]
    parts = raw.strip("/").split("/")
    if parts and len(parts[0]) == 2 and parts[0][1] == ":":
        flags, parts = flags | FLAGS["absolute"], parts[1:]
    if any(p == ".." for p in parts):
        flags |= FLAGS["traversal"]
    if any(ord(c) < 32 or 127 <= ord(c) < 160 for c in raw):
        flags |= FLAGS["control"]
    path = "/".join(p for p in parts if p not in ("", ".", ".."))
    return path, flags | (0 if path else FLAGS["empty"])


def _odd_encoding(m: zipfile.ZipInfo) -> bool:
    """Whether a name was not stored as UTF-8: it has no such flag and bytes beyond ASCII that aren't UTF-8."""
    if m.flag_bits & 0x800 or m.orig_filename.isascii():
        return False
    try:
        m.orig_filename.encode("cp437").decode("utf-8")
    except (UnicodeEncodeError, UnicodeDecodeError):
        return True
    return False


def inventory(container: str, data: bytes) -> list[tuple]:
    """Rows of _SCHEMA: members in order, then directories that members imply; one row with an error for what can't be read."""
    try:
        members = zipfile.ZipFile(io.BytesIO(data)).infolist()
    except (zipfile.BadZipFile, ValueError, NotImplementedError, OSError) as e:
        return [(container, *[None] * 14, str(e) or "corrupt")]
    rows, seen = [], {}
    for i, m in enumerate(members):
        path, flags = clean_name(m.orig_filename)
        flags |= FLAGS["encoding"] if _odd_encoding(m) else 0
        if path in seen:
            flags |= FLAGS["duplicate"]
        seen[path] = m.is_dir()
        parent, _, name = path.rpartition("/")
        when = calendar.timegm((*m.date_time, 0, 0, 0)) * 10**9 if m.date_time[1] and m.date_time[2] else None
        rows.append((container, i, path, name, parent, m.orig_filename, m.is_dir(), False, bool(m.flag_bits & 1), m.file_size, m.compress_size, m.compress_type, m.CRC, when, flags, None))
    implied = {p for path in seen for p in _above(path)} - seen.keys()
    for i, path in enumerate(sorted(implied), len(rows)):
        parent, _, name = path.rpartition("/")
        rows.append((container, i, path, name, parent, None, True, True, False, 0, 0, 0, 0, None, 0, None))
    return rows


def _above(path: str):
    while path := path.rpartition("/")[0]:
        yield path


def members(files: DataFrame) -> DataFrame:
    """Inventories of rows (path, content)."""

    def run(batches):
        for b in batches:
            for p, c in zip(b["path"], b["content"]):
                found = inventory(p, bytes(c))
                yield from (framed(found[i : i + ROWS]) for i in range(0, len(found), ROWS))

    def framed(rows):
        return pd.DataFrame(rows, columns=[f.split()[0] for f in _SCHEMA.split(", ")]).astype({"ordinal": "Int32", "method": "Int32", "flags": "Int32", "size": "Int64", "compressed": "Int64", "crc32": "Int64", "modified": "Int64"})

    return files.select("path", "content").mapInPandas(run, _SCHEMA)


def read(spark: SparkSession, path: str, pattern: str = "*.zip") -> DataFrame:
    return members(spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path))


def virtual_entries(found: DataFrame, containers: DataFrame) -> DataFrame:
    """Members as entries below their container (container, path, source_id, entry path)."""
    from pyspark.sql import functions as F

    j = found.where("error is null").join(containers, "container")
    kind = F.when(F.col("is_dir"), "virtual_directory").otherwise("virtual_file")
    return j.select("source_id", F.concat("container_path", F.lit("/"), "path").alias("path"), "name", kind.alias("kind"), "size", "modified")


def records(found: DataFrame) -> DataFrame:
    """One record for each container: state, members, directories, declared bytes, odd names, error."""
    from pyspark.sql import functions as F

    explicit = F.col("error").isNull() & ~F.coalesce("implicit", F.lit(False))
    count = lambda test: F.count_if(test).alias
    return found.groupBy("container").agg(
        F.when(F.bool_or(F.col("error").isNotNull()), "failed").otherwise("complete").alias("state"),
        count(explicit)("member_count"), count(F.coalesce("is_dir", F.lit(False)))("dir_count"), count(F.coalesce("implicit", F.lit(False)))("implicit_dir_count"),
        count(explicit & (F.col("flags") != 0))("suspicious_count"), F.coalesce(F.sum(F.when(explicit, F.col("size"))), F.lit(0)).alias("declared_size"), F.max("error").alias("error"),
    )


def stats(records_: DataFrame) -> DataFrame:
    """Totals over the records of supported containers."""
    from pyspark.sql import functions as F

    known = records_.where("state <> 'unsupported'")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias
    return known.agg(F.count("*").alias("archives"), total("member_count")("members"), total("declared_size")("declared_size"), F.count_if(F.col("state") == "failed").alias("failed"))


def listed(found: DataFrame, container: str, parent: str | None = None, prefix: str | None = None, limit: int = 1000, offset: int = 0) -> DataFrame:
    """Members of a container: children of a directory, directories first, then by name; or all below a prefix in order of path."""
    from pyspark.sql import functions as F

    if not 0 < limit <= 5000:
        raise ValueError("limit is 1 to 5000")
    rows = found.where((F.col("container") == container) & F.col("error").isNull())
    if prefix is not None:
        below = prefix.strip("/")
        rows = rows.where((F.col("path") == below) | F.startswith("path", F.lit(below + "/")) if below else F.lit(True)).orderBy("path", "ordinal")
    else:
        rows = rows.where(F.col("parent") == (parent or "")).orderBy(F.desc("is_dir"), "name", "ordinal")
    return rows.offset(offset).limit(limit)


def requeued(containers: DataFrame, records_: DataFrame) -> DataFrame:
    """Containers (container, generation) without a record of their current generation."""
    return containers.join(records_.select("container", "generation"), ["container", "generation"], "left_anti")
