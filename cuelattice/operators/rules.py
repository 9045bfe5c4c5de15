"""Ordered keyword rules, weighted scores over what is available, and gates with reasons."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rules of one call; they become part of the plan, so a table of rules is read up to this size and refused beyond it.
MOST_RULES = 20_000


def read_rules(rules: DataFrame) -> Column:
    """A table of rules (priority, category, needle, weight) as one array, by priority; blank needles don't count."""
    rows = rules.select("priority", "category", F.lower(F.trim("needle")).alias("needle"), "weight").where("needle <> ''").orderBy("priority", "category", "needle").limit(MOST_RULES + 1).collect()
    if len(rows) > MOST_RULES:
        raise ValueError("too many rules")
    kind = "array<struct<priority:bigint,category:string,needle:string,weight:bigint>>"
    if not rows:
        return F.array().cast(kind)
    return F.array(*[F.struct(F.lit(r[0]).alias("priority"), F.lit(r[1]).alias("category"), F.lit(r[2]).alias("needle"), F.lit(r[3]).alias("weight")) for r in rows]).cast(kind)


def matched(text: Column, rules: Column) -> Column:
    """The rules whose needle stands in the text (lower case); NULL text matches none."""
    return F.filter(rules, lambda r: F.contains(F.coalesce(F.lower(text), F.lit("")), r["needle"]))


def first_category(text: Column, rules: Column) -> Column:
    """The category of the matching rule of least priority, of equals the first by name; NULL without one."""
    return F.array_min(F.transform(matched(text, rules), lambda r: F.struct(r["priority"], r["category"])))["category"]


def risk(text: Column, rules: Column, *others: Column) -> Column:
    """The largest weight of a matching rule or of ``others``, 0 without any."""
    top = F.coalesce(F.array_max(F.transform(matched(text, rules), lambda r: r["weight"])), F.lit(0).cast("long"))
    return F.greatest(top, *[F.coalesce(o, F.lit(0).cast("long")) for o in others]) if others else top


def available_score(parts: Sequence[tuple[Column, float]], *penalties: tuple[Column, float]) -> Column:
    """Weighted mean of the parts that aren't NULL, less weighted penalties (NULL is none), within [0, 1]; NULL without a part."""
    zero = F.lit(0.0)
    have = sum((F.when(p.isNotNull(), F.lit(float(w))).otherwise(zero) for p, w in parts), zero)
    total = sum((F.coalesce(p * float(w), zero) for p, w in parts), zero)
    less = sum((F.coalesce(p * float(w), zero) for p, w in penalties), zero)
    return F.when(have > 0, F.greatest(zero, F.least(F.lit(1.0), total / have - less)))


def gate(**checks: Column) -> tuple[Column, Column]:
    """(passed, names of failed checks in order); a NULL check fails."""
    failed = F.array_compact(F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in checks.items()]))
    return F.size(failed) == 0, failed
