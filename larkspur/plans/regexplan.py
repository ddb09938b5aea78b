"""A regular expression's required literals, as a cheap test that rules texts out before the expression runs.

The planner walks Python's parse tree and keeps, for each part, either the exact strings that it can match (few and
short) or a set of alternatives of literals, one of which must occur. What it can't tell, it leaves open, so the test
never rejects a text that matches.
"""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

try:
    import re._parser as sre
except ImportError:  # before Python 3.11
    import sre_parse as sre

MAX_EXACT, MAX_CLASS, MAX_REPEAT = 20, 10, 3


class _Plan:
    """exact: all strings that match, or None. need: sets of literals, one of each of which must occur."""

    def __init__(self, exact: set[str] | None, need: list[frozenset[str]]):
        self.exact, self.need = exact, need

    def needs(self) -> list[frozenset[str]]:
        own = [frozenset(self.exact)] if self.exact and all(self.exact) else []
        return self.need + own


def _sequence(parts: list[_Plan]) -> _Plan:
    need, run = [], {""}
    closed = False
    for p in parts:
        if p.exact is not None and len(run) * len(p.exact) <= MAX_EXACT:
            run = {a + b for a in run for b in p.exact}
            continue
        closed = True
        need += [frozenset(run)] if all(run) else []
        run = p.exact if p.exact is not None else {""}
        need += p.need
    return _Plan(run, need) if not closed else _Plan(None, need + ([frozenset(run)] if all(run) else []))


def _of(tree) -> _Plan:
    parts = []
    for op, arg in tree:
        name = str(op)
        if name == "LITERAL":
            parts.append(_Plan({chr(arg)}, []))
        elif name == "IN":
            chars: set[str] | None = set()
            for kind, x in arg:
                if str(kind) == "LITERAL" and chars is not None:
                    chars.add(chr(x))
                elif str(kind) == "RANGE" and chars is not None and x[1] - x[0] < MAX_CLASS:
                    chars |= {chr(c) for c in range(x[0], x[1] + 1)}
                else:
                    chars = None
            parts.append(_Plan(chars if chars and len(chars) <= MAX_CLASS else None, []))
        elif name == "SUBPATTERN":
            parts.append(_of(arg[-1]))
        elif name == "BRANCH":
            plans = [_of(b) for b in arg[1]]
            if all(p.exact is not None for p in plans) and sum(len(p.exact) for p in plans) <= MAX_EXACT:
                parts.append(_Plan(set().union(*(p.exact for p in plans)), []))
            else:
                # one literal of each branch; a branch without any leaves all open
                each = [max(p.needs(), key=lambda s: min(map(len, s)), default=None) for p in plans]
                parts.append(_Plan(None, [frozenset().union(*each)] if all(each) else []))
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
            low, high, inner = arg
            plan = _of(inner)
            if plan.exact is not None and low == high and low <= MAX_REPEAT and len(plan.exact) ** max(low, 1) <= MAX_EXACT:
                parts += [plan] * low
            elif plan.exact is not None and low == 0 and high == 1 and len(plan.exact) < MAX_EXACT:
                parts.append(_Plan(plan.exact | {""}, []))
            else:
                parts += [plan] if low else []
                parts.append(_Plan(None, []))
        elif name == "AT":
            continue
        else:
            parts.append(_Plan(None, []))
    return _sequence(parts)


def required_literals(pattern: str, case: bool) -> list[frozenset[str]]:
    """Sets of literals: a text that matches holds one of each set. Without case, letters that fold unlike Python's lower() leave a literal out."""
    try:
        plan = _of(sre.parse(pattern))
    except (re.error, RecursionError, OverflowError):
        return []
    sets = [s for s in plan.needs() if min(map(len, s)) >= 2]
    if case:
        return sets
    # only ASCII folds alike everywhere, and k and s have relatives outside
    safe = lambda x: x.isascii() and not set(x.lower()) & {"k", "s", "i"}

    def core(x: str) -> str:
        return max(re.split(r"[^\x00-\x7f]|[ksiKSI]", x), key=len).lower()

    out = [frozenset(x.lower() if safe(x) else core(x) for x in s) for s in sets]
    return [s for s in out if min(map(len, s)) >= 2]


def likely_predicate(pattern: str, case: bool, text: Column) -> Column:
    """True for every text that matches."""
    folded = text if case else F.lower(text)
    tests = [reduce(or_, [F.contains(folded, F.lit(x)) for x in sorted(s)]) for s in required_literals(pattern, case)]
    return reduce(lambda a, b: a & b, tests, F.lit(True))
