"""Folds, tokens, trigrams and paths as Column builders."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that separate tokens, in Java's syntax.
SEPARATORS = r"[^\p{IsAlphabetic}\p{N}]+"
LONGEST_TOKEN = 64


def fold(text: Column) -> Column:
    """Full lower case."""
    return F.lower(text)


def fold_chars(text: Column) -> Column:
    """Lower case of each character alone, first code point only, so offsets stay."""
    return F.array_join(F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.substring(F.lower(c), 1, 1)), "")


def tokens(text: Column, lower: bool = True, longest: int | None = None) -> Column:
    """Alphanumeric runs in order; longer ones than `longest` bytes are left out."""
    found = F.filter(F.split(F.lower(text) if lower else text, SEPARATORS), lambda t: t != "")
    return F.filter(found, lambda t: F.octet_length(t) <= longest) if longest else found


def query_tokens(text: str) -> list[str]:
    """The same for a query's text."""
    return [t for t in re.split(r"[\W_]+", text.lower()) if t]


def trigrams(text: Column) -> Column:
    """Distinct windows of three characters of the folded text. The expression looks ahead at each character, so the text is gone through
    once; a substring would count its characters from the start for each window."""
    return F.coalesce(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"(?s)(?=(.{3}))."), F.lit(1))), F.array().cast("array<string>"))


def extension_of(name: Column) -> Column:
    """What follows the last dot, lower case; none for dot files, over 32 characters or white space."""
    ext = F.regexp_extract(name, r"(?s)^.+\.([^.]+)$", 1)
    return F.when((F.length(ext) > 32) | ext.rlike(r"\s"), "").otherwise(F.lower(ext))


def canonical_path(path: Column, backslash: Column | None = None) -> Column:
    """Matching form: '/' between names. Stored paths of backslash sources are rewritten."""
    return F.when(backslash, F.replace(path, F.lit("\\"), F.lit("/"))).otherwise(path) if backslash is not None else path


def is_backslash_root(root: str) -> bool:
    return not root.startswith("/") and bool(re.match(r"[A-Za-z]:|\\\\", root) or "\\" in root)


def join_path(parent: str, name: str) -> str:
    mark = "\\" if is_backslash_root(parent) else "/"
    return parent + name if parent.endswith(mark) else parent + mark + name


def java_regex(pattern: str, case: bool) -> str:
    """A pattern of the search language in Java's dialect: Unicode classes, only \\n ends a line, $ is the very end."""
    if re.search(r"\(\?(?:[=!]|<[=!])|\\[1-9]|\\k<", pattern):
        raise ValueError("look-around and back-references are not supported")
    body = re.sub(r"((?:^|[^\\])(?:\\\\)*)\$(?=$|\))", r"\1\\z", pattern)
    return f"(?{'dU' if case else 'diuU'}){body}"


def phrase_key(found: Column) -> Column:
    """Tokens between blanks, so that a run of tokens is a substring."""
    return F.concat(F.lit(" "), F.array_join(found, " "), F.lit(" "))


def in_order_within(found: Column, words: list[str], slop: int) -> Column:
    """Whether the words occur in this order with at most `slop` other tokens in between, all gaps together. One pass over the tokens: for each
    number of words, the last place from which so many are found in order; a later start leaves fewer tokens in between."""
    none = F.lit(None).cast("int")
    start = F.struct(F.lit(0).alias("i"), F.lit(False).alias("hit"), *(none.alias(f"s{j}") for j in range(len(words))))

    def step(at: Column, t: Column) -> Column:
        first = [F.when(t == w, at["i"] if j == 0 else at[f"s{j - 1}"]).otherwise(at[f"s{j}"]) for j, w in enumerate(words)]
        ends = (t == words[-1]) & F.coalesce(at["i"] - (at["i"] if len(words) == 1 else at[f"s{len(words) - 2}"]) - (len(words) - 1) <= slop, F.lit(False))
        return F.struct((at["i"] + 1).alias("i"), (at["hit"] | ends).alias("hit"), *(s.alias(f"s{j}") for j, s in enumerate(first)))

    return F.aggregate(found, start, step, lambda at: at["hit"])


def fnv1a(data: bytes) -> int:
    """FNV-1a, 64 bits."""
    value = 0xCBF29CE484222325
    for byte in data:
        value = (value ^ byte) * 0x100000001B3 % 2**64
    return value


def from_filetime(ticks: Column) -> Column:
    """Nanoseconds since 1970 of a count of 100 ns since 1601; 0 is no time."""
    return F.when(ticks != 0, (ticks - 116_444_736_000_000_000) * 100)


def utc_day(ns: Column) -> Column:
    """The start of a time's day."""
    return ns - F.pmod(ns, F.lit(86_400 * 10**9))


def rfc3339_text(ns: Column) -> Column:
    """A time as text in UTC with nine digits of a second."""
    seconds, rest = F.floor(ns / 10**9).cast("long"), F.pmod(ns, F.lit(10**9))
    return F.concat(F.date_format(F.to_utc_timestamp(F.timestamp_seconds(seconds), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("."), F.lpad(rest.cast("string"), 9, "0"), F.lit("Z"))
