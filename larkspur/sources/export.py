"""Exports of hits: CSV, JSON and NDJSON; 64-bit numbers are text in JSON."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Columns in order.
COLUMNS = ["object_id", "entry_id", "source", "kind", "name", "path", "extension", "size", "allocated_size", "modified", "created", "content_state", "hard_link_count", "score"]
#: Where a column has another name in hits.
_FROM = {"source": "source_id", "allocated_size": "allocated", "hard_link_count": "links"}
MOST_ROWS, PAGE = 100_000, 500
BOM = "\ufeff"
SCHEMA = "export/2"


def rows(hits: DataFrame) -> DataFrame:
    """The columns of an export, in order."""
    found = {c: c if c in hits.columns else _FROM.get(c) for c in COLUMNS}
    return hits.select(*(F.col(f).alias(c) if f in hits.columns else F.lit(None).cast("string").alias(c) for c, f in found.items()))


def csv_field(value: Column) -> Column:
    text = F.coalesce(value.cast("string"), F.lit(""))
    return F.when(text.rlike(r'[",\r\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def csv_lines(hits: DataFrame) -> DataFrame:
    """RFC 4180 lines without their ends."""
    return rows(hits).select(F.concat_ws(",", *(csv_field(F.col(c)) for c in COLUMNS)).alias("value"))


def write_csv(hits: DataFrame, path: str) -> None:
    """A folder of CSV files with CRLF; Spark writes in parallel."""
    rows(hits).write.option("lineSep", "\r\n").option("header", True).option("escape", '"').csv(path)


def json_rows(hits: DataFrame) -> DataFrame:
    out = rows(hits)
    text = [F.col(c).cast("string").alias(c) if t == "bigint" else F.col(c) for c, t in out.dtypes]
    return out.select(F.to_json(F.struct(*text)).alias("value"))


def write_ndjson(hits: DataFrame, path: str) -> None:
    json_rows(hits).write.text(path)


def _bounded(hits: DataFrame, most: int) -> Iterator[tuple[str, bool]]:
    """Rows as JSON, the last of them with whether more follow; partitions come one after the other."""
    if not 0 <= most <= MOST_ROWS:
        raise ValueError(f"at most {MOST_ROWS} rows are exported")
    for n, r in enumerate(json_rows(hits.limit(most + 1)).toLocalIterator()):
        if n == most:
            yield "", True
            return
        yield r.value, False


def _summary(n: int, truncated: bool, error: str | None) -> dict:
    return {"rows_exported": n, "truncated": truncated, "error": error}


def ndjson(hits: DataFrame, query: str, most: int = MOST_ROWS) -> Iterator[str]:
    """Header, rows and summary of a bounded export, streamed; an error on the way is told in the summary."""
    yield json.dumps({"schema": SCHEMA, "type": "header", "query": query, "columns": COLUMNS, "max_rows": most})
    n, truncated, error = 0, False, None
    try:
        for value, truncated in _bounded(hits, most):
            if not truncated:
                n += 1
                yield value
    except Exception as e:  # what was sent can't be taken back
        error = type(e).__name__
    yield json.dumps({"schema": SCHEMA, "type": "summary", **_summary(n, truncated, error)})


def json_document(hits: DataFrame, query: str, most: int = MOST_ROWS) -> Iterator[str]:
    """One JSON object in pieces: header fields, rows, summary fields."""
    head = json.dumps({"schema": SCHEMA, "query": query, "columns": COLUMNS, "max_rows": most})
    yield head[:-1] + ', "rows": ['
    n, truncated = 0, False
    for value, truncated in _bounded(hits, most):
        if not truncated:
            yield ("," if n else "") + value
            n += 1
    yield "], " + json.dumps(_summary(n, truncated, None))[1:]


def csv_document(hits: DataFrame, most: int = MOST_ROWS, bom: bool = False) -> Iterator[str]:
    """Lines of RFC 4180 with their ends: columns, then rows; a mark of UTF-8 first, if wanted."""
    yield (BOM if bom else "") + ",".join(COLUMNS) + "\r\n"
    for r in csv_lines(hits.limit(min(most, MOST_ROWS))).toLocalIterator():
        yield r.value + "\r\n"


def pages(search, request, most: int = MOST_ROWS) -> Iterator[DataFrame]:
    """Pages of PAGE hits of a request, one after the other, until one isn't full or `most` rows came; search(request) gives a response."""
    done = 0
    while done < most:
        step = min(PAGE, most - done)
        hits = search(replace(request, offset=done, limit=step)).hits.cache()
        n = hits.count()
        if n:
            yield hits
        done += n
        if n < step:
            return


def bench_records(runs: DataFrame) -> DataFrame:
    """Runs (name, ms) as JSON lines of a bench record: percentiles by nearest rank."""
    from larkspur.operators.bookkeeping import percentiles

    found = percentiles(runs, "name", "ms")
    return found.select(F.to_json(F.struct(F.lit("bench/1").alias("schema"), *found.columns)).alias("value"))
