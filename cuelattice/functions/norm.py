"""Scalar expressions: tolerant casts, clamps, labels, identities and small similarities.

All stay inside whole-stage code generation. NULL means missing and is never taken as zero.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Labels that mean "no label"; fixed values.
EMPTY_LABELS = ("", "unknown", "unresolved", "general", "none", "n/a")


def finite(c: Column | str, default: float | None = None) -> Column:
    """A number, or ``default`` where the text or number isn't a finite number."""
    x = (F.col(c) if isinstance(c, str) else c).try_cast("double")
    x = F.when(x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")), x)
    return x if default is None else F.coalesce(x, F.lit(float(default)))


def clamp(x: Column, lo: float, hi: float) -> Column:
    """x within [lo, hi]; NULL stays NULL."""
    return F.when(x.isNotNull(), F.greatest(F.lit(lo), F.least(F.lit(hi), x)))


def first_nonempty(*cols: Column) -> Column:
    """The first text that is neither NULL nor blank."""
    return F.coalesce(*[F.when(F.trim(c) != "", c) for c in cols])


def label(c: Column, empty: tuple[str, ...] = EMPTY_LABELS) -> Column:
    """Trimmed lower-case label; NULL for the words that mean none."""
    x = F.lower(F.trim(c))
    return F.when(~x.isin(*empty), x)


def rounded(x: Column, digits: int = 4) -> Column:
    """Half-up rounding by floor, which every engine computes alike."""
    k = float(10**digits)
    return F.floor(x * k + 0.5).cast("double") / k


def scaled(x: Column, k: int = 1000) -> Column:
    """A decimal quantity as a whole number of 1/k, so that sums don't depend on their order."""
    return F.floor(x * float(k) + 0.5).cast("long")


def ratio_of(text: Column) -> Column:
    """``a/b`` or ``a:b`` or a plain number as a number; NULL where it can't be read or b is 0."""
    parts = F.split(text, "[/:]")
    a, b = F.try_element_at(parts, F.lit(1)).try_cast("double"), F.try_element_at(parts, F.lit(2)).try_cast("double")
    return F.when(F.size(parts) == 1, a).otherwise(F.try_divide(a, F.nullif(b, F.lit(0.0))))


def gcd(a: Column, b: Column, steps: int = 48) -> Column:
    """Greatest common divisor by Euclid's steps over a fixed sequence (48 suffice for 32-bit sizes)."""
    start = F.struct(F.greatest(a, b).cast("long").alias("x"), F.least(a, b).cast("long").alias("y"))
    step = lambda s, _: F.when(s["y"] == 0, s).otherwise(F.struct(s["y"].alias("x"), F.pmod(s["x"], F.when(s["y"] == 0, 1).otherwise(s["y"])).alias("y")))
    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step, lambda s: s["x"])


def ratio_label(w: Column, h: Column) -> Column:
    """``16:9`` and the like; NULL where a side is missing or not above 0."""
    g = gcd(w, h)
    return F.when((w > 0) & (h > 0), F.concat_ws(":", (w.cast("long") / g).cast("long").cast("string"), (h.cast("long") / g).cast("long").cast("string")))


def jitter(*parts: Column) -> Column:
    """A number in [0, 1] that depends on the parts alone."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 8), 16, 10).cast("double") / 4294967295.0


def digest(*cols: str) -> Column:
    """SHA-256 of the columns as JSON, in order of their names, NULL kept."""
    return F.sha2(F.to_json(F.struct(*sorted(cols)), {"ignoreNullFields": "false"}), 256)


def tokens(c: Column) -> Column:
    """Distinct lower-case words in order; NULL gives an empty list."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("([a-z0-9]+)"), 1))


def overlap(a: Column, b: Column) -> Column:
    """Shared members over the shorter list, 0 if one is empty."""
    n = F.least(F.size(a), F.size(b))
    return F.when(n > 0, F.size(F.array_intersect(a, b)) / n).otherwise(0.0)


def hue_similarity(a: Column, b: Column) -> Column:
    """1 for equal hues, 0 for opposite ones on the circle of 360."""
    d = F.pmod(F.abs(a - b), F.lit(360.0))
    return 1.0 - F.least(d, 360.0 - d) / 180.0


def availability_weighted(parts: list[tuple[Column, float]]) -> tuple[Column, Column]:
    """(score, weight): weighted mean of the values present, clamped to [0, 1]; 0 if none is.

    Missing values are left out and their weight with them; nothing is imputed.
    """
    w = reduce(lambda a, b: a + b, [F.when(v.isNotNull(), F.lit(float(k))).otherwise(0.0) for v, k in parts])
    s = reduce(lambda a, b: a + b, [F.coalesce(clamp(v, 0.0, 1.0), F.lit(0.0)) * float(k) for v, k in parts])
    return F.when(w > 0, s / w).otherwise(0.0), w


def reasons(*rules: tuple[Column, str]) -> Column:
    """Names of the rules that hold, in order; a NULL rule doesn't hold."""
    return F.array_compact(F.array(*[F.when(c, F.lit(n)) for c, n in rules]))


def redacted(c: Column) -> Column:
    """Text with secrets masked: values of key-like parameters and bearer tokens."""
    x = F.regexp_replace(c, r"(?i)((?:api[_-]?key|token|secret|password)\s*[=:]\s*)[^\s&,;\"']+", "$1***")
    return F.regexp_replace(x, r"(?i)(bearer\s+)[A-Za-z0-9._-]+", "$1***")
