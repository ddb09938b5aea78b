"""SQL surface: views over a catalog, and table functions for searches, chunks and archive members."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from larkspur.operators import search as engine
from larkspur.operators.index import Index
from larkspur.sources import archives, textfiles

#: What catalog_search() gives.
HIT = ["entry_id", "object_id", "source_id", "name", "path", "kind", "extension", "size", "content_state", "score"]


@udtf(returnType="ordinal: int, byte_start: long, byte_end: long, first_line: long, lines: long, text: string, split_line: boolean")
class ChunkText:
    """chunk_text(text): the chunks of a text."""

    def eval(self, text: str) -> Iterator[tuple]:
        for c in textfiles.chunk_lines(text or ""):
            yield c["ordinal"], c["byte_start"], c["byte_end"], c["first_line"], c["lines"], c["text"], c["split_line"]


@udtf(returnType=archives._SCHEMA)
class ArchiveMembers:
    """archive_members(path, content): the members of a container."""

    def eval(self, path: str, content: bytes) -> Iterator[tuple]:
        yield from archives.inventory(path, bytes(content))


def register(spark: SparkSession, index: Index | None = None) -> None:
    """chunk_text and archive_members as table functions; of an index, the views catalog_entries and catalog_chunks (if it has them)."""
    spark.udtf.register("chunk_text", ChunkText)
    spark.udtf.register("archive_members", ArchiveMembers)
    if index is not None:
        index.entries().createOrReplaceTempView("catalog_entries")
        if "chunks" in index.manifest.current()[1]:
            index.chunks().createOrReplaceTempView("catalog_chunks")


def catalog_search(index: Index, text: str, **options) -> DataFrame:
    """Hits of a search text, with a fixed schema: all of them, or the page that a limit, offset or cursor asks for."""
    found = index.search(engine.Request(text, **options))
    hits = found.hits if options.keys() & {"limit", "offset", "cursor"} else found.ranked
    return hits.select(*(F.col(c) for c in HIT))


def sql(spark: SparkSession, index: Index, statement: str, **searches: str) -> DataFrame:
    """A statement in which each {name} stands for all hits of a search text given by that name."""
    return spark.sql(statement, **{name: catalog_search(index, text) for name, text in searches.items()})
