"""Syntax tree of the search language."""

from __future__ import annotations

from dataclasses import asdict, dataclass, fields


@dataclass(frozen=True)
class Node:
    def to_json(self) -> dict:
        """Tagged by `op`; 64-bit numbers as text."""

        def plain(x):
            if isinstance(x, Node):
                return x.to_json()
            if isinstance(x, tuple):
                return [plain(i) for i in x]
            return str(x) if isinstance(x, int) and not isinstance(x, bool) else x

        return {"op": OPS_BY_TYPE[type(self)]} | {f.name: plain(getattr(self, f.name)) for f in fields(self)}


@dataclass(frozen=True)
class All(Node):
    pass


@dataclass(frozen=True)
class And(Node):
    items: tuple


@dataclass(frozen=True)
class Or(Node):
    items: tuple


@dataclass(frozen=True)
class Not(Node):
    item: Node


@dataclass(frozen=True)
class Text(Node):
    """field: name, path, content. mode: ranked, phrase, proximity, exact, substring, regex."""

    field: str
    mode: str
    value: str
    case: bool = False
    slop: int = 0


@dataclass(frozen=True)
class Path(Node):
    """mode: exact, prefix, glob."""

    mode: str
    value: str
    case: bool = False


@dataclass(frozen=True)
class Extension(Node):
    values: tuple


@dataclass(frozen=True)
class Kind(Node):
    values: tuple


@dataclass(frozen=True)
class State(Node):
    values: tuple


@dataclass(frozen=True)
class Size(Node):
    """Inclusive bounds. basis: logical, allocated, subtree, subtree_allocated, files."""

    basis: str
    low: int | None = None
    high: int | None = None


@dataclass(frozen=True)
class Time(Node):
    """Half-open bounds in nanoseconds. which: modified, created, subtree_modified, changed, accessed."""

    which: str
    after: int | None = None
    before: int | None = None


@dataclass(frozen=True)
class Attributes(Node):
    all_of: int = 0
    none_of: int = 0


@dataclass(frozen=True)
class Has(Node):
    extension: str
    low: int = 1
    high: int | None = None


@dataclass(frozen=True)
class Source(Node):
    values: tuple


@dataclass(frozen=True)
class Host(Node):
    values: tuple


@dataclass(frozen=True)
class Object(Node):
    values: tuple


@dataclass(frozen=True)
class Under(Node):
    directory: int
    depth: int | None = None


@dataclass(frozen=True)
class Archive(Node):
    value: str


OPS = {
    "all": All, "and": And, "or": Or, "not": Not, "text": Text, "path": Path, "extension": Extension, "kind": Kind, "content_state": State,
    "size": Size, "time": Time, "attributes": Attributes, "descendant_extension": Has, "source": Source, "host": Host, "object": Object,
    "descendant_of": Under, "archive": Archive,
}
OPS_BY_TYPE = {t: op for op, t in OPS.items()}


def from_json(data: dict) -> Node:
    kind = OPS[data["op"]]
    numbers = {"slop", "low", "high", "after", "before", "all_of", "none_of", "directory", "depth"}

    def back(name, x):
        if isinstance(x, dict):
            return from_json(x)
        if isinstance(x, list):
            return tuple(back("values" if kind is Object else "", i) if not (kind is Object and not isinstance(i, dict)) else int(i) for i in x)
        return int(x) if name in numbers and x is not None else x

    return kind(**{f.name: back(f.name, data[f.name]) for f in fields(kind)})


def walk(node: Node):
    yield node
    for child in getattr(node, "items", ()) or ((node.item,) if isinstance(node, Not) else ()):
        yield from walk(child)


def depth(node: Node) -> int:
    return 1 + max((depth(c) for c in (getattr(node, "items", ()) or ((node.item,) if isinstance(node, Not) else ()))), default=0)


class QueryError(ValueError):
    """A query that can't be parsed or run."""


MAX_CLAUSES, MAX_DEPTH, MAX_TEXT, MAX_REGEX = 256, 16, 4096, 1024


def validate(node: Node) -> Node:
    clauses = [n for n in walk(node) if not isinstance(n, And | Or | Not)]
    if len(clauses) > MAX_CLAUSES:
        raise QueryError(f"more than {MAX_CLAUSES} clauses")
    if depth(node) > MAX_DEPTH:
        raise QueryError(f"nested more than {MAX_DEPTH} levels")
    for n in clauses:
        if isinstance(n, Text | Path) and not n.value:
            raise QueryError("empty value")
        if isinstance(n, Text):
            if n.mode == "regex" and len(n.value.encode()) > MAX_REGEX:
                raise QueryError(f"regular expression of more than {MAX_REGEX} bytes")
            if n.mode == "proximity" and n.slop < 1:
                raise QueryError("proximity needs a distance above 0")
        if isinstance(n, Extension | Kind | State | Source | Host | Object) and not n.values:
            raise QueryError("empty list")
    return node


__all__ = [*(t.__name__ for t in OPS.values()), "Node", "QueryError", "asdict", "depth", "from_json", "validate", "walk"]
