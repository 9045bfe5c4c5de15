"""Row-to-row operators over an entity's time line that never sort a whole entity in one task.

An entity's rows are cut into slices of its order column. Windows run within slices; what a
slice needs from the slices before or after it comes from a summary with one row a slice.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_neighbour(df: DataFrame, keys: Sequence[str], at: str, order: Sequence[str], take: Sequence[str], width: float, out: str = "prev", after: bool = False) -> DataFrame:
    """``df`` with struct ``out``: the ``take`` columns of the row before (or after) in its entity.

    ``order`` breaks ties and must start with ``at``, a non-null number; the struct is NULL for the
    first (last) row. Null keys form one entity.
    """
    k = [F.col(c) for c in keys]
    s = df.withColumn("_slice", F.floor(F.col(at) / F.lit(width)).cast("long"))
    pack = F.struct(*[F.col(c) for c in take])
    w = Window.partitionBy(*k, "_slice").orderBy(*order)
    near = F.lead(pack).over(w) if after else F.lag(pack).over(w)
    key = F.struct(*order)
    edge = F.min_by(pack, key) if after else F.max_by(pack, key)
    ends = s.groupBy(*k, "_slice").agg(edge.alias("_edge"))
    over = Window.partitionBy(*k).orderBy("_slice")
    far = F.lead("_edge").over(over) if after else F.lag("_edge").over(over)
    ends = ends.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(keys)], F.col("_slice").alias("_s"), far.alias("_far"))
    s = s.withColumn(out, near)
    on = [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(keys)] + [F.col("_slice") == F.col("_s")]
    s = s.join(ends, on, "left").withColumn(out, F.coalesce(out, "_far"))
    return s.drop("_slice", "_s", "_far", *[f"_k{i}" for i in range(len(keys))])


def running_total(df: DataFrame, keys: Sequence[str], at: str, order: Sequence[str], value: Column, width: float, out: str = "total") -> DataFrame:
    """``df`` with the sum of ``value`` over the rows up to and with this one in its entity."""
    s = df.withColumn("_slice", F.floor(F.col(at) / F.lit(width)).cast("long")).withColumn("_v", value)
    w = Window.partitionBy(*keys, "_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    sums = s.groupBy(*keys, "_slice").agg(F.sum("_v").alias("_sum"))
    before = F.sum("_sum").over(Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(keys)], F.col("_slice").alias("_s"), F.coalesce(before, F.lit(0)).alias("_base"))
    s = s.withColumn(out, F.coalesce(F.sum("_v").over(w), F.lit(0)))
    on = [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(keys)] + [F.col("_slice") == F.col("_s")]
    s = s.join(sums, on, "left").withColumn(out, F.col(out) + F.col("_base"))
    return s.drop("_slice", "_s", "_v", "_base", *[f"_k{i}" for i in range(len(keys))])


def islands(df: DataFrame, keys: Sequence[str], at: str, order: Sequence[str], starts: Column, width: float, out: str = "island") -> DataFrame:
    """``df`` with the number of the run each row is in; ``starts`` is true where a run begins."""
    return running_total(df, keys, at, order, F.when(starts, 1).otherwise(0), width, out)


def range_join(points: DataFrame, spans: DataFrame, keys: Sequence[str], at: str, lo: str, hi: str, width: float, how: str = "inner") -> DataFrame:
    """Points with the half-open spans of their entity that contain them, as an equi-join on cells.

    A span is laid into every cell of ``width`` that it touches, so choose ``width`` near the usual
    length of a span. Columns of both sides must differ but for ``keys``.
    """
    p = points.withColumn("_cell", F.floor(F.col(at) / F.lit(width)).cast("long"))
    cells = F.sequence(F.floor(F.col(lo) / F.lit(width)).cast("long"), F.floor(F.col(hi) / F.lit(width)).cast("long"))
    s = spans.where(f"{lo} < {hi}").withColumn("_cell", F.explode(cells))
    cond = [F.col(f"p.{c}") == F.col(f"s.{c}") for c in [*keys, "_cell"]] + [F.col(at) >= F.col(lo), F.col(at) < F.col(hi)]
    j = p.alias("p").join(s.alias("s"), cond, how)
    return j.select("p.*", *[F.col(f"s.{c}") for c in spans.columns if c not in keys]).drop("_cell")


def overlaps(spans: DataFrame, keys: Sequence[str], lo: str, hi: str, ident: str, width: float) -> DataFrame:
    """(keys, a, b, shared, ratio): pairs of one entity's spans that overlap, each pair once.

    A pair meets in the cell where the later of the two begins, so no pair is counted twice and no
    entity is paired in full.
    """
    s = spans.where(f"{lo} < {hi}").select(*keys, F.col(ident).alias("i"), F.col(lo).alias("lo"), F.col(hi).alias("hi"))
    cells = F.sequence(F.floor(F.col("lo") / F.lit(width)).cast("long"), F.floor((F.col("hi") - 1) / F.lit(width)).cast("long"))
    c = s.withColumn("cell", F.explode(cells))
    a, b = c.alias("a"), c.alias("b")
    cond = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys] + [F.col("a.cell") == F.col("b.cell"), F.col("a.i") < F.col("b.i"), F.col("a.lo") < F.col("b.hi"), F.col("b.lo") < F.col("a.hi")]
    j = a.join(b, cond).where(F.floor(F.greatest("a.lo", "b.lo") / F.lit(width)) == F.col("a.cell"))
    shared = F.least("a.hi", "b.hi") - F.greatest("a.lo", "b.lo")
    shorter = F.least(F.col("a.hi") - F.col("a.lo"), F.col("b.hi") - F.col("b.lo"))
    return j.select(*[F.col(f"a.{k}").alias(k) for k in keys], F.col("a.i").alias("a"), F.col("b.i").alias("b"), shared.alias("shared"), (shared / shorter).alias("ratio"))
