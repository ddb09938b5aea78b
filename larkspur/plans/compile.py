"""Syntax tree -> boolean Column over entry documents.

A clause on the content of files is a set of objects; the compiler takes it as a flag column that search() joins
in (see operators.search), so it works inside OR and NOT. Predicates are two-valued: null counts as false.
"""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from larkspur.functions.text import in_order_within, java_regex, phrase_key, query_tokens, tokens
from larkspur.plans import ast as q
from larkspur.plans.parser import ATTRIBUTES, glob_regex

NAMED_BITS = sum(ATTRIBUTES.values())
_ORDER = {"logical": "size", "allocated": "allocated", "subtree": "subtree_logical", "subtree_allocated": "subtree_allocated", "files": "file_count"}


def content_clauses(node: q.Node) -> list[q.Text]:
    """The distinct content clauses, in order; the i-th has the flag column _content_i."""
    return list(dict.fromkeys(n for n in q.walk(node) if isinstance(n, q.Text) and n.field == "content"))


def _between(value: Column, low: int | None, high: int | None) -> Column:
    tests = [value >= low] if low is not None else []
    tests += [value <= high] if high is not None else []
    return reduce(and_, tests, F.lit(True))


def text_predicate(mode: str, value: str, case: bool, slop: int, raw: Column, found: Column) -> Column:
    """A text clause over a column and its tokens."""
    words = query_tokens(value)
    if mode == "ranked":
        return reduce(and_, [F.array_contains(found, w) for w in words], F.lit(True))
    if mode in ("phrase", "proximity"):
        if not words:
            return F.lit(False)
        if len(words) == 1:
            return F.array_contains(found, words[0])
        if mode == "phrase":
            return F.contains(phrase_key(found), F.lit(" " + " ".join(words) + " "))
        return in_order_within(found, words, slop)
    if mode == "exact":
        return raw == value if case else F.lower(raw) == value.lower()
    if mode == "substring":
        return F.contains(raw, F.lit(value)) if case else F.contains(F.lower(raw), F.lit(value.lower()))
    try:
        return raw.rlike(java_regex(value, case))
    except ValueError as e:
        raise q.QueryError(str(e)) from None


class Compiler:
    """names: source name -> id and host name -> source ids, as looked up by the driver."""

    def __init__(self, sources: dict[str, int] | None = None, hosts: dict[str, list[int]] | None = None):
        self.sources, self.hosts = sources or {}, {k.lower(): v for k, v in (hosts or {}).items()}

    def predicate(self, node: q.Node) -> Column:
        self.flags = {c: F.col(f"_content_{i}") for i, c in enumerate(content_clauses(node))}
        return F.coalesce(self.of(node), F.lit(False))

    def of(self, n: q.Node) -> Column:
        return getattr(self, type(n).__name__.lower())(n)

    def all(self, n):
        return F.lit(True)

    def and_(self, n):
        return reduce(and_, map(self.of, n.items), F.lit(True))

    def or_(self, n):
        return reduce(or_, map(self.of, n.items), F.lit(False))

    def not_(self, n):
        return ~F.coalesce(self.of(n.item), F.lit(False))

    def text(self, n: q.Text) -> Column:
        if n.field == "content":
            return F.coalesce(self.flags[n], F.lit(False))
        raw = F.col("name" if n.field == "name" else "path")
        if n.field == "name" and n.mode == "ranked":
            names, paths = tokens(F.col("name")), tokens(F.col("path"))
            return reduce(and_, [F.array_contains(names, w) | F.array_contains(paths, w) for w in query_tokens(n.value)], F.lit(True))
        value = n.value.replace("\\", "/") if n.field == "path" and n.mode == "substring" else n.value
        return text_predicate(n.mode, value, n.case, n.slop, raw, tokens(raw))

    def path(self, n: q.Path) -> Column:
        value = n.value.replace("\\", "/")
        column, value = (F.col("path"), value) if n.case else (F.col("path_folded"), value.lower())
        if n.mode == "exact":
            return column == value
        if n.mode == "prefix":
            value = value.rstrip("/")
            return (column == value) | F.startswith(column, F.lit(value + "/"))
        anchored = value if "/" in value else "*" + value
        return column.rlike(r"(?ds)\A" + glob_regex(anchored) + r"\z")

    def extension(self, n):
        return F.col("extension").isin([v.lower() for v in n.values])

    def kind(self, n):
        return F.col("kind").isin(list(n.values))

    def state(self, n):
        return F.col("content_state").isin(list(n.values))

    def size(self, n: q.Size) -> Column:
        test = _between(F.col(_ORDER[n.basis]), n.low, n.high)
        return test if n.basis in ("logical", "allocated") else (F.col("kind") == "directory") & test

    def time(self, n: q.Time) -> Column:
        if n.which in ("changed", "accessed"):
            raise q.QueryError(f"{n.which} times are not indexed")
        column = F.col({"subtree_modified": "newest_modified"}.get(n.which, n.which))
        tests = [column >= n.after] if n.after is not None else []
        tests += [column < n.before] if n.before is not None else []
        tests += [F.col("kind") == "directory"] if n.which == "subtree_modified" else []
        return reduce(and_, tests, F.lit(True))

    def attributes(self, n):
        want, shun = n.all_of & NAMED_BITS, n.none_of & NAMED_BITS
        bits = F.col("attributes")
        return (bits.bitwiseAND(F.lit(want)) == want) & (bits.bitwiseAND(F.lit(shun)) == 0)

    def has(self, n: q.Has) -> Column:
        count = F.coalesce(F.element_at("extension_counts", n.extension), F.lit(0))
        return (F.col("kind") == "directory") & _between(count, max(1, n.low), n.high)

    def source(self, n):
        ids = []
        for v in n.values:
            if v not in self.sources and not v.removeprefix("s:").isdigit():
                raise q.QueryError(f"unknown source {v}")
            ids.append(self.sources[v] if v in self.sources else int(v.removeprefix("s:")))
        return F.col("source_id").isin(ids)

    def host(self, n):
        ids = []
        for v in n.values:
            if v.lower() not in self.hosts:
                raise q.QueryError(f"unknown host {v}")
            ids += self.hosts[v.lower()]
        return F.col("source_id").isin(ids)

    def object(self, n):
        return F.col("object_id").isin(list(n.values))

    def under(self, n: q.Under) -> Column:
        at = F.array_position("ancestors", n.directory)
        deep = F.size("ancestors") - at + 1
        return (at > 0) & ((deep <= n.depth) if n.depth is not None else F.lit(True))

    def archive(self, n):
        raise q.QueryError("archive queries are not supported")


# words of Python's own can't name methods
setattr(Compiler, "and", Compiler.and_)
setattr(Compiler, "or", Compiler.or_)
setattr(Compiler, "not", Compiler.not_)
