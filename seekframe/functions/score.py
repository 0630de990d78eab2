"""The matching tiers as one CASE over search forms; the fuzzy tier is a fold that only the rest reaches."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

_SEP = re.compile(r"[\s._/\-]+")


@dataclass(frozen=True)
class Query:
    """A query's forms, as literals or as columns of a table of queries."""

    lower: Column
    separated: Column
    compact: Column
    tokens: Column
    blank: bool = False
    text: str = ""
    letters: list[str] = field(default_factory=list)
    parts: list[str] = field(default_factory=list)


def normalise(query: str) -> Query:
    """Trimmed, lower-cased forms of one query; a blank one has none."""
    t = query.strip().lower()
    tokens = [x for x in _SEP.split(t) if x]
    sep, comp = _SEP.sub("-", t).strip("-"), _SEP.sub("", t)
    return Query(F.lit(t), F.lit(sep), F.lit(comp), F.array(*map(F.lit, tokens)).cast("array<string>"), not t, t, list(comp), tokens)


def normalise_column(c: Column) -> Query:
    """The same forms of a column of queries."""
    from .text import SEP, compact, separated, trim

    t = F.lower(trim(c))
    return Query(t, separated(t), compact(t), F.filter(F.split(t, SEP), lambda x: x != ""))


def fuzzy(candidate: Column, query: Column) -> Column:
    """Greedy subsequence score of compact forms: 0 if a character is missing, else at least 35."""
    start = F.struct(F.lit(1).alias("pos"), F.lit(0).alias("score"), F.lit(0).alias("streak"))

    def step(a: Column, ch: Column) -> Column:
        at = F.when(a["pos"] > 0, F.call_function("locate", ch, candidate, a["pos"])).otherwise(0)
        near = at == a["pos"]
        streak = F.when(near, a["streak"] + 1).otherwise(0)
        gained = F.when(near, 18 + 3 * (a["streak"] + 1)).otherwise(8)
        return F.when(at == 0, F.struct(F.lit(0).alias("pos"), a["score"].alias("score"), a["streak"].alias("streak"))).otherwise(F.struct((at + 1).alias("pos"), (a["score"] + gained).alias("score"), streak.alias("streak")))

    spare = F.least(F.length(candidate) - F.length(query), F.lit(60))
    chars = F.filter(F.split(query, ""), lambda x: x != "")
    return F.aggregate(chars, start, step, lambda a: F.when((a["pos"] == 0) | (F.length(query) == 0), 0).otherwise(F.greatest(F.lit(35), a["score"] - spare)))


def _in_order(c: Column, letters: list[str]) -> Column:
    """Whether a text has these characters in this order; the pattern never goes back, so it is linear."""
    each = [f"\\x{{{ord(x):x}}}" for x in letters]
    return c.rlike("^" + "".join(f"[^{x}]*+{x}" for x in each))


def matches(lower: Column, q: Query) -> Column | None:
    """Whether any tier gives a text a score, from its lower-case form alone; None if only the score tells.

    Every tier but that of the tokens has the query's letters in order, and separators, which the compact form leaves out,
    are none of them.
    """
    if not q.letters:
        return None
    every = [lower.contains(t) for t in q.parts]
    return _in_order(lower, q.letters) | reduce(lambda a, b: a & b, every) if len(every) > 1 else _in_order(lower, q.letters)


def score(c: dict[str, Column], q: Query) -> Column:
    """The tier score of a candidate's forms (see functions.text.prepared) for a query; 0: no match."""
    norm, sep, comp, base, stem, sep_base = (c[k] for k in ("normalized", "separated", "compact", "base", "stem", "sep_base"))
    more = lambda x, y: F.least(F.greatest(F.length(x) - F.length(y), F.lit(0)), F.lit(120))
    in_sep, in_base, in_comp = (F.call_function("locate", y, x) - 1 for x, y in ((sep, q.separated), (sep_base, q.separated), (comp, q.compact)))
    first = F.when((in_sep >= 0) & (in_base >= 0), F.least(in_sep, in_base)).otherwise(F.greatest(in_sep, in_base))
    out = (
        F.when((norm == q.lower) | (base == q.lower) | (stem == q.lower), 720)
        .when((sep == q.separated) | (sep_base == q.separated), 680)
        .when(comp == q.compact, 560)
        .when(sep.startswith(q.separated) | sep_base.startswith(q.separated), 470 - more(sep, q.separated))
        .when(comp.startswith(q.compact), 390 - more(comp, q.compact))
        .when((in_sep >= 0) | (in_base >= 0), 330 - F.least(first, F.lit(80)))
        .when(in_comp >= 0, 240 - F.least(in_comp, F.lit(80)))
        .when((F.size(q.tokens) >= 2) & F.forall(q.tokens, lambda t: norm.contains(t)), 210)
    )
    # one query: a pattern of its letters in order is a cheap test for the fold to run at all
    if q.letters:
        out = out.when(~_in_order(comp, q.letters), 0)
    return out.otherwise(fuzzy(comp, q.compact)).cast("int")
