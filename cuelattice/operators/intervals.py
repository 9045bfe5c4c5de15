"""Overlapping and gapped intervals: continuous periods and the gaps between them.

``merge_intervals`` works in two steps. Native ``session_window`` with a row's own length as its
session gap merges overlaps inside one *slice* of an entity's time line; a slice holds at most
``slice_ms`` / 2 separate periods, since ends are whole milliseconds, so no task meets an
unbounded group even if one entity holds a third of all rows. Periods that touch, or that reach
into later slices, are then joined over slice summaries, and gaps come from ``lead``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import write_out

SLICE_MS = 60_000
#: Whole milliseconds that fit into 64 bits with a slice to spare: 292 million years.
FARTHEST_MS = 9.2e18


def whole_ms(seconds: Column) -> Column:
    """Seconds as whole milliseconds (half away from zero); NULL for null, NaN and infinite values and those that 64 bits can't hold."""
    ok = seconds.isNotNull() & ~F.isnan(seconds) & (F.abs(seconds) <= F.lit(FARTHEST_MS / 1000.0))
    return F.when(ok, F.round(seconds * 1000.0, 0).cast("long"))


def _slice(at: str, slice_ms: int) -> Column:
    """The slice of a time, in whole numbers."""
    return F.call_function("div", F.col(at) - F.pmod(F.col(at), F.lit(slice_ms)), F.lit(slice_ms).cast("long"))


def merge_intervals(
    df: DataFrame, keys: Sequence[str], start: str = "start_ms", end: str = "end_ms", slice_ms: int = SLICE_MS
) -> DataFrame:
    """Longest stretches covered by the intervals of each entity.

    Takes bigint ``start``/``end`` in whole ms, half-open; gives ``keys`` + (``start_ms``, ``end_ms``).
    Touching intervals are joined. Rows with a null end or not ending after their start don't
    count; null keys form an entity of their own; repeated rows change nothing; an empty table
    gives an empty table; other columns are dropped. Sessions run on times within their slice, so any end
    up to ``FARTHEST_MS`` counts.
    """
    k = [f"k{i}" for i in range(len(keys))]
    rows = df.select(
        *[F.col(f"`{c}`").alias(a) for c, a in zip(keys, k)], F.col(start).cast("long").alias("s"), F.col(end).cast("long").alias("e")
    ).where("s is not null and e is not null and e > s")
    rows = rows.withColumn("slice", _slice("s", slice_ms))
    # exact repeats vanish before the shuffle; session_window then merges within a slice
    rows = rows.groupBy(*k, "slice", "s").agg(F.max("e").alias("e"))
    at = F.col("s") - F.col("slice") * slice_ms
    length = F.least(F.col("e"), F.col("slice") * slice_ms + slice_ms) - F.col("s")
    session = F.session_window(F.timestamp_millis(at), F.concat(length.cast("string"), F.lit(" milliseconds")))
    part = (
        rows.withColumn("slice2", F.col("slice"))
        .groupBy(*k, "slice2", session.alias("w"))
        .agg(F.min("s").alias("s"), F.max("e").alias("e"))
        .select(*k, F.col("slice2").alias("slice"), "s", "e")
    )
    return _join_slices(part, k).select(*[F.col(a).alias(c) for a, c in zip(k, keys)], F.col("s").alias("start_ms"), F.col("e").alias("end_ms"))


def _join_slices(part: DataFrame, k: list[str]) -> DataFrame:
    """Join touching periods, within slices and across them, without gathering an entity in one task."""
    # first pass: how far everything before a slice reaches
    tops = part.groupBy(*k, "slice").agg(F.max("e").alias("top"))
    before = Window.partitionBy(*k).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.withColumn("reach", F.max("top").over(before)).select(*[F.col(c).alias(f"_{c}") for c in k], F.col("slice").alias("_slice"), "reach")
    on = [part[c].eqNullSafe(F.col(f"_{c}")) for c in k] + [part["slice"] == F.col("_slice")]
    rows = part.join(tops, on, "left").select(*k, "slice", "s", "e", "reach")
    inner = Window.partitionBy(*k, "slice").orderBy("s", "e")
    far = F.greatest(F.max("e").over(inner.rowsBetween(Window.unboundedPreceding, -1)), F.col("reach"))
    rows = rows.withColumn("island", F.when(far.isNull() | (F.col("s") > far), F.col("s")))
    rows = rows.withColumn("island", F.last("island", True).over(inner.rowsBetween(Window.unboundedPreceding, 0)))
    # a slice's first rows may belong to an island that an earlier slice began
    last = rows.groupBy(*k, "slice").agg(F.max("island").alias("at"))
    last = last.withColumn("open", F.last("at", True).over(before)).select(*[F.col(c).alias(f"_{c}") for c in k], F.col("slice").alias("_slice"), "open")
    on = [rows[c].eqNullSafe(F.col(f"_{c}")) for c in k] + [rows["slice"] == F.col("_slice")]
    rows = rows.join(last, on, "left").select(*k, F.coalesce("island", "open").alias("s"), "e")
    return rows.groupBy(*k, "s").agg(F.max("e").alias("e"))


def gaps_between(periods: DataFrame, keys: Sequence[str], slice_ms: int = SLICE_MS) -> DataFrame:
    """Stretches between two consecutive periods of an entity, by ``lead`` within slices.

    Takes the output of ``merge_intervals``. The last period of a slice takes the first start of
    the next slice in use, from a summary with one row per slice.
    """
    k = [f"k{i}" for i in range(len(keys))]
    rows = periods.select(*[F.col(f"`{c}`").alias(a) for c, a in zip(keys, k)], F.col("start_ms").alias("s"), F.col("end_ms").alias("e"))
    rows = rows.withColumn("slice", _slice("s", slice_ms))
    heads = rows.groupBy(*k, "slice").agg(F.min("s").alias("head"))
    heads = heads.withColumn("next", F.lead("head").over(Window.partitionBy(*k).orderBy("slice")))
    heads = heads.select(*[F.col(c).alias(f"_{c}") for c in k], F.col("slice").alias("_slice"), "next")
    on = [rows[c].eqNullSafe(F.col(f"_{c}")) for c in k] + [rows["slice"] == F.col("_slice")]
    rows = rows.join(heads, on, "left").select(*k, "slice", "s", "e", "next")
    follow = F.coalesce(F.lead("s").over(Window.partitionBy(*k, "slice").orderBy("s")), F.col("next"))
    gaps = rows.select(*k, F.col("e").alias("start_ms"), follow.alias("end_ms")).where("end_ms > start_ms")
    return gaps.select(*[F.col(a).alias(c) for a, c in zip(k, keys)], "start_ms", "end_ms")


def periods_and_gaps(df: DataFrame, keys: Sequence[str], start: str = "start_ms", end: str = "end_ms", slice_ms: int = SLICE_MS) -> DataFrame:
    """``keys`` + (``kind``, ``start_ms``, ``end_ms``) with kinds ``period`` and ``gap``."""
    periods = write_out(merge_intervals(df, keys, start, end, slice_ms), "periods")  # read twice
    gaps = gaps_between(periods, keys, slice_ms)
    out = [*keys, "kind", "start_ms", "end_ms"]
    return periods.withColumn("kind", F.lit("period")).select(*out).unionByName(gaps.withColumn("kind", F.lit("gap")).select(*out))
