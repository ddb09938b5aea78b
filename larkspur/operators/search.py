"""Search: parse, compile, scope, sort, page, facets."""

from __future__ import annotations

import base64
import hashlib
import hmac
import json
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions.text import query_tokens, tokens
from larkspur.operators.content import bm25, current, ranked_objects, verified_objects, with_flags
from larkspur.plans import ast as q
from larkspur.plans.compile import Compiler, content_clauses
from larkspur.plans.parser import DAY, parse
from larkspur.plans.render import render, rfc3339

MODES = {"files": ("file", "reparse", "virtual_file"), "directories": ("directory", "virtual_directory"), "both": ()}
SORTS = {"name": "name_folded", "path": "path_folded", "size": "subtree_logical", "subtree_size": "subtree_logical", "allocated": "subtree_allocated", "modified": "newest_modified", "created": "created"}
MOST_ROWS = 1000
#: Edges of the facets of size (bytes) and age (days).
SIZE_EDGES = (4096, 65536, 1 << 20, 16 << 20, 256 << 20, 1 << 30)
AGE_EDGES = (0, 1, 7, 30, 365)


@dataclass
class Request:
    text: str
    mode: str = "both"
    sort: str = "relevance"
    descending: bool = False
    offset: int = 0
    limit: int = 50
    now: int = 0
    retired: tuple = ()
    include_retired: bool = False
    hidden: bool = True
    cursor: str | None = None
    generation: int = 0


@dataclass
class Response:
    hits: DataFrame
    matches: DataFrame
    query: q.Node
    ranked: DataFrame | None = None
    cursor: str | None = None
    facets: dict = field(default_factory=dict)
    warnings: list = field(default_factory=list)


def matches(entries: DataFrame, request: Request, chunks: DataFrame | None = None, compiler: Compiler | None = None) -> tuple[DataFrame, q.Node]:
    """All entry documents that match, and the tree."""
    node = parse(request.text, request.now)
    clauses = content_clauses(node)
    if clauses and chunks is None:
        raise q.QueryError("no content is indexed")
    if clauses and "generation" in entries.columns and "generation" in chunks.columns:
        chunks = current(chunks, entries.select("object_id", "generation").distinct())
    found = with_flags(entries, chunks, clauses) if clauses else entries
    found = found.where((compiler or Compiler()).predicate(node))
    if MODES[request.mode]:
        found = found.where(F.col("kind").isin(*MODES[request.mode]))
    if request.retired and not request.include_retired:
        found = found.where(~F.col("source_id").isin(*request.retired))
    if not request.hidden:
        found = found.where(F.col("attributes").bitwiseAND(F.lit(6)) == 0)
    return found.drop(*(f"_content_{i}" for i in range(len(clauses)))), node


def tight(found: DataFrame) -> DataFrame:
    """found with score: 1.0 for directories that hold no other match, 0.5 for their ancestors."""
    above = found.select("source_id", F.explode("ancestors").alias("object_id")).distinct().withColumn("_holds", F.lit(True))
    return found.join(above, ["source_id", "object_id"], "left").withColumn("score", F.when(F.col("_holds"), 0.5).otherwise(1.0)).drop("_holds")


def name_relevance(node: q.Node) -> Column:
    """For ranked words of names and paths: 2 for a name that is the word, 1 for a name that has it as a token, a half for the path, each over 1 + a tenth of
    the number of tokens, so that short names come first."""
    total = F.lit(0.0)
    for n in q.walk(node):
        if isinstance(n, q.Text) and n.mode == "ranked" and n.field in ("name", "path"):
            names, paths = tokens(F.col("name")), tokens(F.col("path"))
            for w in query_tokens(n.value):
                place = F.when(F.col("name_folded") == w, 2.0).when(F.array_contains(names, w), 1.0).when(F.array_contains(paths, w), 0.5).otherwise(0.0)
                total = total + place / (1 + 0.1 * F.size(names))
    return total


def scored(found: DataFrame, node: q.Node, chunks: DataFrame | None, mode: str, rank: Callable[[str], DataFrame] | None = None) -> DataFrame:
    """Relevance: tight directories for has:; else the sum of BM25 of ranked content clauses (by rank(), from an index, if given), of the matching
    chunks of other content clauses (at most 8 each), and of ranked words in names and paths."""
    if mode == "directories" and any(isinstance(n, q.Has) for n in q.walk(node)):
        return tight(found)
    rank = rank or (lambda text: bm25(chunks, text))
    parts = [(ranked_objects(rank(c.value)) if c.mode == "ranked" else verified_objects(chunks, c)).withColumnRenamed("score", f"_s{i}") for i, c in enumerate(content_clauses(node))]
    out = reduce(lambda a, b: a.join(b, "object_id", "left"), parts, found)
    return out.withColumn("score", reduce(lambda a, b: a + b, [F.coalesce(f"_s{i}", F.lit(0.0)) for i in range(len(parts))], name_relevance(node))).drop(*(f"_s{i}" for i in range(len(parts))))


def ordering(request: Request) -> list[Column]:
    if request.sort == "relevance":
        return [F.desc("score"), F.asc("name_folded"), F.asc("entry_id")]
    key = F.col(SORTS[request.sort])
    return [key.desc() if request.descending else key.asc(), F.asc("entry_id")]


def search(entries: DataFrame, request: Request, chunks: DataFrame | None = None, compiler: Compiler | None = None, rank: Callable[[str], DataFrame] | None = None) -> Response:
    """A page of hits; the sort and the limit run as one top-k. `ranked` is all of them with their scores. A cursor in the request sets its offset; one of an older generation is told in `warnings`."""
    warnings = []
    if request.cursor:
        offset, generation, _ = Cursor.read(request.cursor, request)
        request = replace(request, offset=offset)
        if generation != request.generation:
            warnings.append("the catalog has changed since the page before")
    if not 0 < request.limit <= MOST_ROWS:
        raise q.QueryError(f"limit is 1 to {MOST_ROWS}")
    found, node = matches(entries, request, chunks, compiler)
    ranked = scored(found, node, chunks, request.mode, rank) if request.sort == "relevance" else found.withColumn("score", F.lit(0.0))
    hits = ranked.orderBy(*ordering(request)).offset(request.offset).limit(request.limit)
    return Response(hits, found, node, ranked, Cursor.next(request, request.generation), warnings=warnings)


def keyset_page(found: DataFrame, request: Request, after: tuple | None) -> DataFrame:
    """The page after (sort key, entry_id): rows before it are filtered, not skipped."""
    key = F.col(SORTS[request.sort])
    if after is not None:
        beyond = key < after[0] if request.descending else key > after[0]
        found = found.where(beyond | (key == after[0]) & (F.col("entry_id") > after[1]))
    return found.orderBy(*ordering(request)).limit(request.limit)


def total(found: DataFrame, policy: str = "exact", shown: int = 0) -> tuple[int, str]:
    """(count, origin); `none` counts no further than the page."""
    if policy == "none":
        return found.limit(shown + 1).count(), "bound"
    return found.count(), "counted"


class Cursor:
    """Opaque, signed place in a result: it fits the same query, mode and sort only."""

    SECRET = b"larkspur"

    @staticmethod
    def fingerprint(r: Request) -> str:
        return hashlib.sha256(json.dumps([render(parse(r.text, r.now)), r.mode, r.sort, r.descending, r.include_retired]).encode()).hexdigest()[:16]

    @classmethod
    def sign(cls, body: str) -> str:
        return hmac.new(cls.SECRET, body.encode(), hashlib.sha256).hexdigest()[:16]

    @classmethod
    def next(cls, r: Request, generation: int = 0, count: int | None = None) -> str:
        body = json.dumps([r.offset + r.limit, generation, cls.fingerprint(r), count])
        return base64.urlsafe_b64encode(f"{cls.sign(body)}{body}".encode()).decode()

    @classmethod
    def read(cls, text: str, r: Request) -> tuple[int, int, int | None]:
        """(offset, generation, count)."""
        try:
            raw = base64.urlsafe_b64decode(text).decode()
            body = raw[16:]
            offset, generation, mark, count = json.loads(body)
        except ValueError:
            raise q.QueryError("not a cursor") from None
        if not hmac.compare_digest(raw[:16], cls.sign(body)) or mark != cls.fingerprint(r):
            raise q.QueryError("the cursor belongs to another query")
        return offset, generation, count


def facet_terms(found: DataFrame, column: str, limit: int = 20) -> DataFrame:
    """value, n of the most frequent values."""
    value = F.coalesce(F.nullif(F.col(column).cast("string"), F.lit("")), F.lit("(none)"))
    return found.groupBy(value.alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value").limit(limit)


def _ladder(value: Column, edges: tuple, labels: list[str]) -> Column:
    out = F.when(value < edges[0], labels[0])
    for edge, label in zip(edges[1:], labels[1:]):
        out = out.when(value < edge, label)
    return out.otherwise(labels[-1])


def size_labels() -> list[str]:
    return [f"<{SIZE_EDGES[0]}", *(f"{a}..{b - 1}" for a, b in zip(SIZE_EDGES, SIZE_EDGES[1:])), f">={SIZE_EDGES[-1]}"]


def facet_sizes(found: DataFrame) -> DataFrame:
    """bucket, n by subtree size; empty buckets are left out."""
    return found.groupBy(_ladder(F.col("subtree_logical"), SIZE_EDGES, size_labels()).alias("bucket")).agg(F.count("*").alias("n"))


def facet_ages(found: DataFrame, now: int) -> DataFrame:
    """bucket, n by UTC days before today."""
    today = now - now % DAY
    edges = tuple(today - d * DAY for d in reversed(AGE_EDGES))
    labels = ["older", *(f"{d}d" for d in reversed(AGE_EDGES[1:])), "today"]
    return found.groupBy(_ladder(F.col("newest_modified"), edges, labels).alias("bucket")).agg(F.count("*").alias("n"))


def facet_page(found: DataFrame, column: str, limit: int = 20) -> tuple[list, bool]:
    """(value, n) of the most frequent values, and whether there are more."""
    rows = facet_terms(found, column, limit + 1).collect()  # as long as the page
    return [(r.value, r.n) for r in rows[:limit]], len(rows) > limit


def size_clauses() -> dict[str, str]:
    """Search texts of the buckets of facet_sizes()."""
    edges = SIZE_EDGES
    texts = [f"<{edges[0]}", *(f"{a}..{b - 1}" for a, b in zip(edges, edges[1:])), f">={edges[-1]}"]
    return {label: f"size:{text}" for label, text in zip(size_labels(), texts)}


def age_clauses(now: int) -> dict[str, str]:
    """Search texts of the buckets of facet_ages()."""
    today = now - now % DAY
    edges = [today - d * DAY for d in reversed(AGE_EDGES)]
    texts = [f"<{rfc3339(edges[0])}", *(f">={rfc3339(a)},<{rfc3339(b)}" for a, b in zip(edges, edges[1:])), f">={rfc3339(edges[-1])}"]
    labels = ["older", *(f"{d}d" for d in reversed(AGE_EDGES[1:])), "today"]
    return {label: f"mtime:{text}" for label, text in zip(labels, texts)}


def query_shape(text: str) -> str:
    """The strongest kind of clause: metadata, name, content_ranked, content_regex."""
    strength = ["metadata", "name", "content_ranked", "content_regex"]

    def of(n: q.Node) -> int:
        if isinstance(n, q.Text):
            return (3 if n.mode in ("substring", "regex") else 2) if n.field == "content" else 1
        return 1 if isinstance(n, q.Path) else 0

    return strength[max((of(n) for n in q.walk(parse(text))), default=0)]


def query_hash(text: str) -> str:
    """128 bits that group queries without keeping their text; white space doesn't matter."""
    return hashlib.sha256(b"query-v1\0" + " ".join(text.split()).encode()).hexdigest()[:32]


def with_clause(text: str, clause: str, exclude: bool = False) -> str:
    """The query with one more clause; a top-level OR is put in parentheses."""
    node = parse(text) if text.strip() else q.All()
    base = f"({text})" if isinstance(node, q.Or) else text.strip()
    clause = f"-{clause}" if exclude else clause
    return clause if isinstance(node, q.All) else f"{base} {clause}"


def without_clause(text: str, clause: str) -> str:
    node, gone = parse(text), parse(clause)
    if node == gone:
        return ""
    rest = tuple(i for i in node.items if i != gone) if isinstance(node, q.And) else (node,)
    return render(rest[0] if len(rest) == 1 else q.And(rest))


def children(entries: DataFrame, directory: int, sort: str = "name", descending: bool = False, limit: int = 100, offset: int = 0, hidden: bool = True) -> DataFrame:
    """Entries of a directory; directories come first when sorted by name."""
    found = entries.where(F.col("parent_id") == directory)
    if not hidden:
        found = found.where(F.col("attributes").bitwiseAND(F.lit(6)) == 0)
    flip = (lambda c: c.desc()) if descending else (lambda c: c.asc())
    keys = {"name": [F.when(F.col("kind") == "directory", 0).otherwise(1), F.col("name_folded")], "kind": [F.col("kind"), F.col("extension")]}.get(sort, [F.col(SORTS.get(sort, "name_folded"))])
    return found.orderBy(*map(flip, keys), F.asc("entry_id")).offset(offset).limit(limit)


def resolve(entries: DataFrame, path: str, case_sensitive: bool = False) -> DataFrame:
    """Entries at a path."""
    path = path.replace("\\", "/").rstrip("/")
    return entries.where(F.col("path") == path if case_sensitive else F.col("path_folded") == path.lower())


def first_entries(entries: DataFrame) -> DataFrame:
    """Of each object the live entry of smallest id."""
    return entries.withColumn("_r", F.row_number().over(Window.partitionBy("object_id").orderBy("entry_id"))).where("_r = 1").drop("_r")
