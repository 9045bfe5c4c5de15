"""Curves and sequences: smoothing, density, interpolation, regions, peaks and thinning."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.norm import rounded
from .neighbours import islands, with_neighbour


#: Stretches of a time line that are settled in one call.
TOGETHER = 256


def regions(df: DataFrame, keys: Sequence[str], at: str, order: Sequence[str], max_gap: int, min_length: int, value: str, width: float) -> DataFrame:
    """(keys, start_ms, end_ms, n, mean): rows joined while the gap is at most ``max_gap``; short ones dropped."""
    d = with_neighbour(df, keys, at, order, [at], width)
    d = islands(d, keys, at, order, F.col("prev").isNull() | (F.col(at) - F.col(f"prev.{at}") > max_gap), width)
    r = d.groupBy(*keys, "island").agg(F.min(at).alias("start_ms"), F.max(at).alias("end_ms"), F.count("*").alias("n"), rounded(F.sum(value) / F.count("*")).alias("mean"))
    return r.where(F.col("end_ms") - F.col("start_ms") >= min_length).drop("island")


def around(df: DataFrame, key: str, order: Sequence[str], value: str, reach: int, slice_rows: float) -> DataFrame:
    """``df`` with ``_before`` and ``_after``: the values (structs of ``v``) of up to ``reach`` rows on either side, nearest first.

    Slices of the first order column lend each other their last and first ``reach`` values, so no window spans an entity.
    A slice with fewer rows passes on what its neighbours lent it.
    """
    at = order[0]
    d = df.withColumn("_slice", F.floor(F.col(at) / F.lit(slice_rows)).cast("long"))
    w = Window.partitionBy(key, "_slice").orderBy(*order)
    held = F.struct(F.col(value).alias("v"))  # nulls keep their place
    d = d.withColumn("_before", F.reverse(F.collect_list(held).over(w.rowsBetween(-reach, -1)))).withColumn("_after", F.collect_list(held).over(w.rowsBetween(1, reach)))
    packed = F.struct(*order, held.alias("_v"))
    # the rows at a slice's ends, found within the slice
    up, down = F.row_number().over(w), F.row_number().over(Window.partitionBy(key, "_slice").orderBy(*[F.desc(c) for c in order]))
    ends = d.withColumn("_u", up).withColumn("_d", down).where((F.col("_u") <= reach) | (F.col("_d") <= reach))
    first, last = F.collect_list(F.when(F.col("_u") <= reach, packed)), F.collect_list(F.when(F.col("_d") <= reach, packed))
    ends = ends.groupBy(key, "_slice").agg(F.transform(F.array_sort(first), lambda x: x["_v"]).alias("head"), F.transform(F.array_sort(last), lambda x: x["_v"]).alias("tail"))
    # enough neighbouring slices to fill the reach even if each has one row
    o = Window.partitionBy(key).orderBy("_slice")
    lent = F.slice(F.reverse(F.flatten(F.collect_list("tail").over(o.rowsBetween(-reach, -1)))), 1, reach)
    next_ = F.slice(F.flatten(F.collect_list("head").over(o.rowsBetween(1, reach))), 1, reach)
    ends = ends.select(F.col(key).alias("_k"), F.col("_slice").alias("_s"), lent.alias("_lent"), next_.alias("_next"))
    d = d.join(ends, d[key].eqNullSafe(F.col("_k")) & (F.col("_slice") == F.col("_s")), "left")
    d = d.withColumn("_before", F.slice(F.concat("_before", "_lent"), 1, reach)).withColumn("_after", F.slice(F.concat("_after", "_next"), 1, reach))
    return d.drop("_slice", "_s", "_k", "_lent", "_next")


def total_of(c: str) -> Column:
    """Sum of the values of a list of ``around``; nulls count as 0."""
    return F.aggregate(c, F.lit(0).cast("long"), lambda s, x: s + F.coalesce(x["v"], F.lit(0)))


def _farthest(side: str, value: str) -> Column:
    return F.when(F.size(side) > 0, F.element_at(side, -1)["v"]).otherwise(F.col(value))


def moving_average_edge(df: DataFrame, key: str, order: Sequence[str], value: str, width: int, slice_width: float) -> DataFrame:
    """``df`` with ``smooth``: sum of ``width`` (odd) values around the row, the end values repeated beyond the ends; nulls count as 0."""
    k = width // 2
    d = around(df, key, order, value, k, slice_width)
    zero = F.lit(0).cast("long")
    first, last = F.coalesce(_farthest("_before", value), zero), F.coalesce(_farthest("_after", value), zero)
    near = F.coalesce(F.col(value), zero) + total_of("_before") + total_of("_after")
    smooth = near + first * (k - F.size("_before")) + last * (k - F.size("_after"))
    return d.withColumn("smooth", smooth.cast("long")).drop("_before", "_after")


def level_change(df: DataFrame, key: str, order: Sequence[str], value: str, steps: int, slice_width: float) -> DataFrame:
    """``df`` with ``change``: the value ``steps`` rows later less that ``steps`` rows before, ends clamped."""
    d = around(df, key, order, value, steps, slice_width)
    return d.withColumn("change", _farthest("_after", value) - _farthest("_before", value)).drop("_before", "_after")


def density(df: DataFrame, key: str, at: str, reach: int) -> DataFrame:
    """``df`` with ``near``: rows of the entity within ``reach`` of each row, itself included.

    Counted per cell of ``reach`` and neighbouring cells, so a hot entity spreads over its time line.
    """
    n = df.groupBy(key, at).agg(F.count("*").alias("k")).withColumn("cell", F.floor(F.col(at) / F.lit(reach * 64)).cast("long"))
    edge = lambda d: F.floor((F.col(at) + d) / F.lit(reach * 64)).cast("long")
    own = n.withColumn("own", F.lit(True))
    copies = n.select(key, at, "k", F.explode(F.array_except(F.array_distinct(F.array(edge(-reach), edge(reach))), F.array("cell"))).alias("cell"), F.lit(False).alias("own"))
    w = Window.partitionBy(key, "cell").orderBy(at).rangeBetween(-reach, reach)
    near = own.unionByName(copies).withColumn("near", F.sum("k").over(w)).where("own").select(key, at, "near")
    return df.join(near, [key, at])


def robust_normalise(df: DataFrame, key: str, value: str, lo: float, hi: float) -> DataFrame:
    """``df`` with ``level``: values between two percentiles (nearest rank) scaled to [0, 1] and clipped; 0 if flat."""
    n = df.groupBy(key, value).agg(F.count("*").alias("_k"))
    w = Window.partitionBy(key).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    n = n.withColumn("_upto", F.sum("_k").over(w)).withColumn("_all", F.sum("_k").over(Window.partitionBy(key)))
    at = lambda q: F.min(F.when(F.col("_upto") >= F.ceil(F.col("_all") * q), F.col(value)))
    r = n.groupBy(key).agg(at(lo).alias("lo"), at(hi).alias("hi"))
    x = (F.col(value) - F.col("lo")) / (F.col("hi") - F.col("lo"))
    return df.join(r, key).withColumn("level", rounded(F.when(F.col("hi") > F.col("lo"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))).otherwise(0.0))).drop("lo", "hi")


def lerp(points: DataFrame, curve: DataFrame, key: str, at: str, value: str, width: float) -> DataFrame:
    """(id, level): the curve read at each point by linear interpolation, clamped at its ends.

    Points of entities without a curve give no row. Curve and points are read in one sorted pass
    within slices; a slice's first and last points take the curve beyond it from slice summaries.
    """
    c = curve.groupBy(key, at).agg(F.min(value).alias("v"))
    null = F.lit(None).cast("long")
    rows = c.select(key, at, F.lit(0).alias("side"), null.alias("id"), F.struct(at, "v").alias("p")).unionByName(
        points.select(key, at, F.lit(1).alias("side"), "id", F.lit(None).cast("struct<%s:bigint,v:bigint>" % at).alias("p"))
    )
    rows = rows.withColumn("s", F.floor(F.col(at) / F.lit(width)).cast("long"))
    w = Window.partitionBy(key, "s").orderBy(at, "side")
    rows = rows.withColumn("b", F.last("p", True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    back = Window.partitionBy(key, "s").orderBy(F.desc(at), "side")
    rows = rows.withColumn("a", F.last("p", True).over(back.rowsBetween(Window.unboundedPreceding, 0)))
    ends = rows.groupBy(key, "s").agg(F.max("p").alias("tail"), F.min("p").alias("head"))
    o = Window.partitionBy(key).orderBy("s")
    ends = ends.select(F.col(key).alias("_k"), F.col("s").alias("_s"), F.last("tail", True).over(o.rowsBetween(Window.unboundedPreceding, -1)).alias("fb"), F.first("head", True).over(o.rowsBetween(1, Window.unboundedFollowing)).alias("fa"))
    j = rows.where("side = 1").join(ends, (F.col(key) == F.col("_k")) & (F.col("s") == F.col("_s")))
    j = j.select("id", at, F.coalesce("b", "fb").alias("b"), F.coalesce("a", "fa").alias("a")).where("a is not null or b is not null")
    t0, v0, t1, v1 = F.col(f"b.{at}"), F.col("b.v"), F.col(f"a.{at}"), F.col("a.v")
    x = F.when(F.col("b").isNull(), v1.cast("double")).when(F.col("a").isNull() | (t1 == t0), v0.cast("double")).otherwise(v0 + (v1 - v0) * (F.col(at) - t0) / (t1 - t0))
    return j.select("id", rounded(x).alias("level"))


def _stretches(df: DataFrame, keys: Sequence[str], at: str, apart: int, window: int) -> DataFrame:
    """``df`` with ``stretch``: times of one entity that are ``apart`` or more from any other stretch.

    Rows of different stretches never touch each other, so each could be settled on its own; ``TOGETHER``
    neighbours share a number, as a task's call costs more than a stretch. ``df`` has a time once.
    """
    d = with_neighbour(df, keys, at, [at], [at], window)
    d = islands(d, keys, at, [at], F.col("prev").isNull() | (F.col(at) - F.col(f"prev.{at}") >= apart), window, "stretch")
    return d.drop("prev").withColumn("stretch", F.floor(F.col("stretch") / TOGETHER).cast("long"))


def nms(df: DataFrame, keys: Sequence[str], at: str, value: str, apart: int, window: int) -> DataFrame:
    """(keys, window, kept): greedy peaks by height, then earlier time, at least ``apart`` from each kept one.

    Over the whole time line, cut only where neighbours are ``apart`` or more; ``window`` is the
    part of the time line that a peak lies in. A stretch without such a gap is settled in one task.
    """
    d = df.where(F.col(at).isNotNull() & F.col(value).isNotNull()).groupBy(*keys, at).agg(F.max(value).alias("v"))
    d = _stretches(d, keys, at, apart, window)

    def keep(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        t, v = pdf[at].to_numpy(), pdf["v"].to_numpy()
        kept: list[int] = []
        for x in t[np.lexsort((t, -v))].tolist():
            i = bisect_left(kept, x)
            if (i == 0 or x - kept[i - 1] >= apart) and (i == len(kept) or kept[i] - x >= apart):
                kept.insert(i, x)
        return _kept_frame(keys, key, kept, window)

    return d.groupBy(*keys, "stretch").applyInPandas(keep, _kept_schema(df, keys))


def thin(df: DataFrame, keys: Sequence[str], at: str, apart: int, window: int) -> DataFrame:
    """(keys, window, kept): times at least ``apart`` after the last kept one, over the whole time line as in ``nms``."""
    d = _stretches(df.where(F.col(at).isNotNull()).select(*keys, at).distinct(), keys, at, apart, window)

    def keep(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        kept: list[int] = []
        for x in np.sort(pdf[at].to_numpy()).tolist():
            if not kept or x - kept[-1] >= apart:
                kept.append(x)
        return _kept_frame(keys, key, kept, window)

    return d.groupBy(*keys, "stretch").applyInPandas(keep, _kept_schema(df, keys))


def merge_boundaries(df: DataFrame, keys: Sequence[str], at: str, value: str, apart: int, window: int) -> DataFrame:
    """(keys, window, kept): a walk in order of time; a boundary nearer than ``apart`` to the last kept one replaces it if higher.

    Of boundaries at one time the highest counts. Over the whole time line as in ``nms``.
    """
    d = df.where(F.col(at).isNotNull() & F.col(value).isNotNull()).groupBy(*keys, at).agg(F.max(value).alias("v"))
    d = _stretches(d, keys, at, apart, window)

    def keep(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(at)
        kept: list[tuple[int, int]] = []
        for x, v in zip(pdf[at].tolist(), pdf["v"].tolist()):
            if not kept or x - kept[-1][0] >= apart:
                kept.append((x, v))
            elif v > kept[-1][1]:
                kept[-1] = (x, v)
        return _kept_frame(keys, key, [x for x, _ in kept], window)

    return d.groupBy(*keys, "stretch").applyInPandas(keep, _kept_schema(df, keys))


def _kept_frame(keys: Sequence[str], key: tuple, kept: list[int], window: int) -> pd.DataFrame:
    return pd.DataFrame({**{c: [k] * len(kept) for c, k in zip(keys, key)}, "window": [x // window for x in kept], "kept": kept})


def _kept_schema(df: DataFrame, keys: Sequence[str]) -> str:
    kinds = dict(df.dtypes)
    return ", ".join([*[f"`{c}` {kinds[c]}" for c in keys], "window bigint", "kept bigint"])
