"""Search text -> syntax tree.

or := and ((OR | '|') and)*;  and := unary (AND? unary)*;  unary := (NOT | '!' | '-') unary | '(' or ')' | term.
A term is field:value, a glob, a path, a /regex/ or words. A '-' before a digit is part of the term.
"""

from __future__ import annotations

import calendar
import re
from dataclasses import dataclass
from datetime import datetime, timedelta, timezone

from larkspur.plans.ast import (
    MAX_TEXT, All, And, Attributes, Extension, Has, Host, Kind, Node, Not, Object, Or, Path, QueryError, Size, Source, State, Text, Time, Under, validate,
)

#: Attribute bits that have names.
ATTRIBUTES = {"readonly": 1, "hidden": 2, "system": 4, "archive": 32, "temporary": 256, "sparse": 512, "reparse": 1024, "compressed": 2048, "offline": 4096, "encrypted": 16384, "recall": 4194304}
KINDS = ("file", "directory", "reparse", "virtual_file", "virtual_directory")
STATES = ("unknown", "pending", "indexing", "indexed", "partial", "stale", "failed", "excluded", "unsupported")
_ALIASES = {
    "name_ranked": "ranked name_ranked", "path_ranked": "path_ranked", "content_ranked": "content_ranked", "name": "name n file", "content": "content text body",
    "path": "path p folder dir", "ext": "ext e extension", "kind": "kind k type is", "size": "size sz", "alloc": "alloc allocated", "subtree": "subtree tree",
    "subtree_alloc": "subtree_alloc tree_alloc", "files": "files count", "mtime": "mtime modified m dm", "subtree_mtime": "subtree_mtime subtree_modified tree_mtime",
    "ctime": "ctime created dc", "state": "state content_state indexed", "has": "has contains_ext", "attr": "attr attrs a", "source": "source src volume drive",
    "host": "host h", "object": "object obj o", "in": "in under",
}
FIELDS = {alias: field for field, aliases in _ALIASES.items() for alias in aliases.split()}
_KIND_WORDS = {"dir": "directory", "folder": "directory", "d": "directory", "f": "file", "link": "reparse"} | {k: k for k in KINDS}
_SIZES = {"size": "logical", "alloc": "allocated", "subtree": "subtree", "subtree_alloc": "subtree_allocated", "files": "files"}
_TIMES = {"mtime": "modified", "ctime": "created", "subtree_mtime": "subtree_modified"}
SECOND, DAY = 10**9, 86_400 * 10**9


@dataclass(frozen=True)
class Token:
    kind: str  # ( ) or and not term
    head: str = ""
    body: str | None = None
    form: str = "bare"  # bare, quoted, regex
    tail: str = ""


def tokenize(text: str) -> list[Token]:
    if len(text.encode()) > MAX_TEXT:
        raise QueryError(f"query of more than {MAX_TEXT} bytes")
    out, i, n = [], 0, len(text)
    while i < n:
        c = text[i]
        if c.isspace():
            i += 1
        elif c in "()":
            out.append(Token(c))
            i += 1
        elif c == "|":
            out.append(Token("or"))
            i += 1
        elif c == "!" or c == "-" and i + 1 < n and not text[i + 1].isdigit() and not text[i + 1].isspace():
            out.append(Token("not"))
            i += 1
        else:
            head, body, form, tail = "", None, "bare", ""
            while i < n and not text[i].isspace() and text[i] not in "()|":
                c = text[i]
                if body is None and c == '"':
                    body, form, i = "", "quoted", i + 1
                    while i < n and text[i] != '"':
                        if text[i] == "\\" and i + 1 < n and text[i + 1] in '\\"':
                            i += 1
                        body += text[i]
                        i += 1
                    if i >= n:
                        raise QueryError("quote without an end")
                    i += 1
                elif body is None and c == "/" and re.fullmatch(r"|.*[:=~]|.*=i", head) and (found := re.compile(r"/((?:\\.|[^/\\])+)/([ci]*)(?=[\s()|]|$)").match(text, i)) and (head or re.search(r"[\\^$*+?\[\]{}()|]", found[1])):
                    body, form, tail, i = found[1].replace("\\/", "/"), "regex", found[2], found.end()
                elif body is None:
                    head += c
                    i += 1
                else:
                    tail += c
                    i += 1
            word = head if body is None else None
            out.append(Token({"OR": "or", "AND": "and", "NOT": "not", "&&": "and"}.get(word, "term"), head, body, form, tail))
    return out


class _Parser:
    def __init__(self, text: str, now: int):
        self.tokens, self.at, self.now = tokenize(text), 0, now

    def peek(self) -> str:
        return self.tokens[self.at].kind if self.at < len(self.tokens) else ""

    def take(self) -> Token:
        self.at += 1
        return self.tokens[self.at - 1]

    def either(self) -> Node:
        items = [self.both()]
        while self.peek() == "or":
            self.take()
            items.append(self.both())
        return items[0] if len(items) == 1 else Or(tuple(items))

    def both(self) -> Node:
        items = []
        while self.peek() in ("term", "not", "(", "and"):
            if self.peek() == "and":
                self.take()
                continue
            items.append(self.unary())
        if not items:
            raise QueryError("expected a term")
        return items[0] if len(items) == 1 else And(tuple(items))

    def unary(self) -> Node:
        token = self.take()
        if token.kind == "not":
            if self.peek() not in ("term", "not", "("):
                raise QueryError("nothing to negate")
            return Not(self.unary())
        if token.kind == "(":
            inner = self.either()
            if self.peek() != ")":
                raise QueryError("parenthesis without an end")
            self.take()
            return inner
        return self.term(token)

    def term(self, t: Token) -> Node:
        if t.body is None and t.head == "*":
            return All()
        name, colon, value = t.head.partition(":")
        field = FIELDS.get(name.lower()) if colon else None
        if field is None:
            return self.bare(t)
        t = Token("term", value, t.body, t.form, t.tail)
        plain = value + (t.body or "") + t.tail
        if not plain:
            raise QueryError(f"{name}: has no value")
        if field in ("name", "path", "content", "name_ranked", "path_ranked", "content_ranked"):
            return self.text(field, t)
        if field == "ext":
            return Extension(tuple(v.lower().lstrip(".") for v in plain.split(",")))
        if field in ("kind", "state"):
            words = plain.lower().split(",")
            known = _KIND_WORDS if field == "kind" else {s: s for s in STATES}
            for w in words:
                if w not in known:
                    raise QueryError(f"unknown {field} {w}")
            return (Kind if field == "kind" else State)(tuple(known[w] for w in words))
        if field in _SIZES:
            return Size(_SIZES[field], *_bounds(plain, _size if field != "files" else _count))
        if field in _TIMES:
            return Time(_TIMES[field], *time_bounds(plain, self.now))
        if field == "has":
            found = re.fullmatch(r"\.?([^<>=.]*)(.*)", plain.lower())
            low, high = _bounds(found[2], _count) if found[2] else (1, None)
            return Has(found[1], max(1, low or 1), high)
        if field == "attr":
            all_of = none_of = 0
            for w in plain.lower().split(","):
                bit = ATTRIBUTES.get(w.lstrip("-!"))
                if bit is None:
                    raise QueryError(f"unknown attribute {w}")
                all_of, none_of = (all_of, none_of | bit) if w[0] in "-!" else (all_of | bit, none_of)
            return Attributes(all_of, none_of)
        if field in ("source", "host"):
            return (Source if field == "source" else Host)(tuple(plain.split(",")))
        number = lambda x: int(re.sub(r"^[a-z]:", "", x))
        try:
            if field == "object":
                return Object(tuple(number(x) for x in plain.split(",")))
            place, _, deep = plain.partition("~")
            return Under(number(place), int(deep) if deep else None)
        except ValueError:
            raise QueryError(f"{name}: needs a number") from None

    def bare(self, t: Token) -> Node:
        if t.form == "regex" and not t.head or t.form == "quoted" and not t.head:
            return self.text("name", t)
        raw = t.head + (t.body or "") + t.tail
        if re.match(r"/|[A-Za-z]:[\\/]|\\\\", raw):
            return Path("glob" if re.search(r"[*?]", raw) else "prefix", raw)
        if t.form == "bare" and re.fullmatch(r"\*\.[^*?./\\]+", raw):
            return Extension((raw[2:].lower(),))
        if t.form == "bare" and re.search(r"[*?]", raw):
            return Text("name", "regex", "^" + glob_regex(raw) + "$")
        return Text("name", "ranked", raw)

    def text(self, field: str, t: Token) -> Node:
        ranked = field.endswith("_ranked")
        field = field.removesuffix("_ranked")
        if ranked:
            return Text(field, "ranked", t.head + (t.body or "") + t.tail)
        if t.form == "regex":
            return Text(field, "regex", t.body, "c" in t.tail)
        value = t.head + (t.body or "")
        if t.head.startswith("=i"):
            return Text(field, "exact", value[2:], False)
        if t.head.startswith("="):
            return Text(field, "exact", value[1:], True)
        if t.head.startswith("~"):
            return Text(field, "substring", value[1:], True)
        if t.form == "quoted":
            if found := re.fullmatch(r"~(\d+)", t.tail):
                return Text(field, "proximity", t.body, False, int(found[1]))
            return Text(field, "phrase", t.body)
        value += t.tail
        if field == "name" and re.fullmatch(r"\*\.[^*?./\\]+", value):
            return Extension((value[2:].lower(),))
        if field != "content" and re.search(r"[*?]", value):
            return Path("glob", value) if field == "path" else Text(field, "regex", "^" + glob_regex(value) + "$")
        return Text(field, "ranked" if field == "content" else "substring", value)


def glob_regex(glob: str) -> str:
    parts = re.split(r"(\*+|\?)", glob)
    return "".join(".*" if p.startswith("*") else "." if p == "?" else re.escape(p) for p in parts)


#: Names and lengths of spans of time.
UNITS = {
    "m min mins": 60 * SECOND, "h hr hrs hour hours": 3600 * SECOND, "d day days": DAY, "w wk week weeks": 7 * DAY,
    "mo month months": 30 * DAY, "y yr year years": 365 * DAY,
}


def _size(text: str) -> int:
    found = re.fullmatch(r"(\d+(?:\.\d*)?|\.\d+)\s*([kmgt]?)(?:ib|b)*", text.strip().lower())
    if not found:
        raise QueryError(f"not a size: {text}")
    value = round(float(found[1]) * 1024 ** " kmgt".index(found[2] or " ")) if "." in found[1] else int(found[1]) * 1024 ** " kmgt".index(found[2] or " ")
    if value >= 2**63:
        raise QueryError(f"too large: {text}")
    return value


def _count(text: str) -> int:
    if not re.fullmatch(r"\d{1,18}", text.strip()):
        raise QueryError(f"not a number: {text}")
    return int(text)


def _bounds(text: str, read) -> tuple[int | None, int | None]:
    """Inclusive bounds of >n, >=n, <n, <=n, a..b, n, *."""
    if text == "*":
        return None, None
    if ".." in text:
        low, high = text.split("..", 1)
        # bounds the wrong way round are a range that holds nothing
        return read(low) if low else None, read(high) if high else None
    found = re.fullmatch(r"(>=|<=|>|<|=?)(.*)", text, re.S)
    n = read(found[2])
    return {">": (n + 1, None), ">=": (n, None), "<": (None, max(0, n - 1)), "<=": (None, n)}.get(found[1], (n, n))


def _ns(t: datetime) -> int:
    return calendar.timegm(t.utctimetuple()) * SECOND + t.microsecond * 1000


def instant(text: str) -> int:
    """Nanoseconds of an RFC 3339 time; up to nine digits of a second, UTC without a zone."""
    found = re.fullmatch(r"(.*?\d)(?:\.(\d{1,9}))?(z|[+-]\d\d:?\d\d)?", text.strip().lower())
    if not found:
        raise ValueError(text)
    whole = datetime.fromisoformat((found[1] + (found[3] or "z")).upper().replace("Z", "+00:00"))
    whole = whole if whole.tzinfo else whole.replace(tzinfo=timezone.utc)
    return _ns(whole.astimezone(timezone.utc)) + int((found[2] or "").ljust(9, "0"))


def _span(text: str, now: int) -> tuple[int, int]:
    """[start, end) of a point in time."""
    word = text.strip().lower()
    today = now - now % DAY
    if word in ("today", "yesterday"):
        start = today - (DAY if word == "yesterday" else 0)
        return start, start + DAY
    if found := re.fullmatch(r"(\d+(?:\.\d*)?|\.\d+)([a-z]+)", word):
        for names, length in UNITS.items():
            if found[2] in names.split():
                return now - int(float(found[1]) * length), now + 1
    try:
        if found := re.fullmatch(r"(\d{4})(?:-(\d\d))?(?:-(\d\d))?", word):
            y, m, d = int(found[1]), int(found[2] or 1), int(found[3] or 1)
            start = datetime(y, m, d, tzinfo=timezone.utc)
            if found[3]:
                end = start + timedelta(days=1)
            elif found[2]:
                end = datetime(y + m // 12, m % 12 + 1, 1, tzinfo=timezone.utc)
            else:
                end = datetime(y + 1, 1, 1, tzinfo=timezone.utc)
            return _ns(start), _ns(end)
        start = instant(text)
        return start, start + SECOND
    except ValueError:
        raise QueryError(f"not a time: {text}") from None


def time_bounds(text: str, now: int) -> tuple[int | None, int | None]:
    """Half-open bounds; an age like 30d spans from that long ago until now."""
    if text == "*":
        return None, None
    if found := re.fullmatch(r">=(.+),<(.+)", text):  # exact bounds, as the renderer writes them
        return _span(found[1], now)[0], _span(found[2], now)[0]
    if ".." in text:
        low, high = text.split("..", 1)
        return (_span(low, now)[0] if low else None), (_span(high, now)[1] if high else None)
    found = re.fullmatch(r"(>=|<=|>|<|=?)(.*)", text, re.S)
    start, end = _span(found[2], now)
    return {">": (end, None), ">=": (start, None), "<": (None, start), "<=": (None, end)}.get(found[1], (start, end))


def parse(text: str, now: int = 0) -> Node:
    """The query's tree; an empty text matches everything."""
    p = _Parser(text, now)
    if not p.tokens:
        return All()
    node = p.either()
    if p.at < len(p.tokens):
        raise QueryError("parenthesis without a start")
    return validate(node)
