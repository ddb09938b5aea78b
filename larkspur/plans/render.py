"""Syntax tree -> search text that parses to the same tree."""

from __future__ import annotations

import re
from datetime import datetime, timedelta

from larkspur.plans import ast as q
from larkspur.plans.parser import ATTRIBUTES

_SIZES = {"logical": "size", "allocated": "alloc", "subtree": "subtree", "subtree_allocated": "subtree_alloc", "files": "files"}
_TIMES = {"modified": "mtime", "created": "ctime", "subtree_modified": "subtree_mtime"}


def quoted(value: str) -> str:
    return '"' + value.replace("\\", "\\\\").replace('"', '\\"') + '"'


def _range(low: int | None, high: int | None) -> str:
    if low is None and high is None:
        return "*"
    if low == high:
        return str(low)
    return f">={low}" if high is None else f"<={high}" if low is None else f"{low}..{high}"


def _text(n: q.Text) -> str:
    if n.mode == "regex":
        return f"{n.field}:/{re.sub(r'(?<!\\)((?:\\\\)*)/', r'\1\\/', n.value)}/" + "c" * n.case
    if n.mode == "ranked":
        return f"{'' if n.field == 'name' else n.field + '_'}ranked:{quoted(n.value)}"
    mark = {"exact": "=" if n.case else "=i", "substring": "~", "phrase": "", "proximity": ""}[n.mode]
    if n.mode == "substring" and not n.case:
        return f"{n.field}:{n.value}"
    return f"{n.field}:{mark}{quoted(n.value)}" + (f"~{n.slop}" if n.mode == "proximity" else "")


def rfc3339(ns: int) -> str:
    """A time in UTC, with as many digits of a second as it needs: none, three or nine."""
    seconds, rest = divmod(ns, 10**9)
    text = (datetime(1970, 1, 1) + timedelta(seconds=seconds)).isoformat()
    return text + ("" if not rest else f".{rest // 10**6:03d}" if rest % 10**6 == 0 else f".{rest:09d}") + "Z"


def _time(n: q.Time) -> str:
    if n.after is None and n.before is None:
        return "*"
    if n.before is None:
        return f">={rfc3339(n.after)}"
    return f"<{rfc3339(n.before)}" if n.after is None else f">={rfc3339(n.after)},<{rfc3339(n.before)}"


def render(node: q.Node, inner: bool = False) -> str:
    if isinstance(node, q.All):
        return "*"
    if isinstance(node, q.And | q.Or):
        parts = [render(i, True) for i in node.items]
        text = (" " if isinstance(node, q.And) else " OR ").join(parts)
        return f"({text})" if inner else text
    if isinstance(node, q.Not):
        return "-" + (f"({render(node.item)})" if isinstance(node.item, q.And | q.Or | q.Not) else render(node.item, True))
    if isinstance(node, q.Text):
        return _text(node)
    if isinstance(node, q.Path):
        return f"path:{node.value}" if node.mode == "glob" and not re.match(r"/|[A-Za-z]:[\\/]|\\\\", node.value) else node.value
    if isinstance(node, q.Extension):
        return "ext:" + ",".join(node.values)
    if isinstance(node, q.Kind):
        return "kind:" + ",".join(node.values)
    if isinstance(node, q.State):
        return "state:" + ",".join(node.values)
    if isinstance(node, q.Size):
        return f"{_SIZES[node.basis]}:{_range(node.low, node.high)}"
    if isinstance(node, q.Time):
        if node.which not in _TIMES:
            raise q.QueryError(f"{node.which} has no text form")
        return f"{_TIMES[node.which]}:{_time(node)}"
    if isinstance(node, q.Attributes):
        names = [*(k for k, b in ATTRIBUTES.items() if node.all_of & b), *(f"-{k}" for k, b in ATTRIBUTES.items() if node.none_of & b)]
        return "attr:" + ",".join(names)
    if isinstance(node, q.Has):
        return f"has:{node.extension}" + ("" if (node.low, node.high) == (1, None) else _range(node.low, node.high) if node.low != node.high else f"={node.low}")
    if isinstance(node, q.Source):
        return "source:" + ",".join(node.values)
    if isinstance(node, q.Host):
        return "host:" + ",".join(node.values)
    if isinstance(node, q.Object):
        return "object:" + ",".join(f"o:{v}" for v in node.values)
    if isinstance(node, q.Under):
        return f"in:o:{node.directory}" + (f"~{node.depth}" if node.depth is not None else "")
    raise q.QueryError("no text form")
