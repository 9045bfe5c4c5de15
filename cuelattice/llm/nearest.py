"""Matching records by nearest time.

Both tables are laid into one row set, repartitioned by entity and time slice, sorted within
partitions by time, and read by a two-pointer merge that holds only the right record last seen and
the left rows still waiting for the next one. Slices keep a hot entity from landing in one task;
the right record that lies before or after a slice comes from slice summaries (two rows a slice),
so the result doesn't depend on the slice length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLICE_TICKS = 6_000_000  # 600 s of 1/10000 s
_NONE = np.iinfo(np.int64).min
_MOST = np.iinfo(np.int64).max
#: Ticks whose distances fit into 64 bits: 14 million years of 1/10000 s.
FARTHEST = 4.6e18
_OUT = "left_id bigint, right_id bigint, left_tick bigint, right_tick bigint"


def ticks(seconds: Column, digits: int = 4) -> Column:
    """Seconds rounded to ``digits`` decimals as a whole number; NULL for null, NaN and infinite values and those beyond ``FARTHEST``."""
    ok = seconds.isNotNull() & ~F.isnan(seconds) & (F.abs(seconds) <= FARTHEST / 10**digits)
    return F.when(ok, F.round(seconds * float(10**digits), 0).cast("long"))


def tolerance_ticks(seconds: Column, digits: int = 4) -> Column:
    """As ``ticks``; a finite tolerance beyond any distance stands for the largest."""
    ok = seconds.isNotNull() & ~F.isnan(seconds) & (F.abs(seconds) < float("inf"))
    return F.when(ok & (seconds > FARTHEST / 10**digits), F.lit(_MOST).cast("long")).otherwise(ticks(seconds, digits))


class _Merge:
    """The two-pointer state between batches of one sorted partition."""

    def __init__(self) -> None:
        self.wait: list[np.ndarray] = []  # columns of left rows that wait for the next right record
        self.prev = (_NONE, _NONE)  # tick and id of the last right record
        self.group = None

    def settle(self, lt, lid, tol, pt, pid, nt, nid) -> pa.RecordBatch | None:
        """Choose between the neighbours; of two equally near the earlier."""
        dp = np.where(pt == _NONE, _MOST, lt - np.where(pt == _NONE, lt, pt))
        dn = np.where(nt == _NONE, _MOST, np.where(nt == _NONE, lt, nt) - lt)
        first = (dp <= dn) & (pt != _NONE)
        d, rid, rt = np.where(first, dp, dn), np.where(first, pid, nid), np.where(first, pt, nt)
        ok = (d <= tol) & (rt != _NONE)
        if not ok.any():
            return None
        return pa.RecordBatch.from_arrays([pa.array(x[ok]) for x in (lid, rid, lt, rt)], ["left_id", "right_id", "left_tick", "right_tick"])

    def flush(self, nt: int, nid: int) -> pa.RecordBatch | None:
        if not self.wait:
            return None
        cols = [np.concatenate(c) for c in zip(*self.wait)]
        self.wait = []
        n = len(cols[0])
        return self.settle(*cols, np.full(n, nt), np.full(n, nid))

    def feed(self, tick, side, rid, tol) -> Iterator[pa.RecordBatch]:
        """One run of rows of one group, in order of (tick, side, id); side 0 is right, 1 left."""
        n = len(tick)
        at = np.arange(n)
        right = side == 0
        before = np.maximum.accumulate(np.where(right, at, -1))
        after = np.minimum.accumulate(np.where(right, at, n)[::-1])[::-1]
        if right.any() and self.wait:
            i = int(after[0])
            if (out := self.flush(int(tick[i]), int(rid[i]))) is not None:
                yield out
        left = ~right
        if left.any():
            b, a = before[left], after[left]
            lt, lid, ltol = tick[left], rid[left], tol[left]
            bt = np.where(b >= 0, tick[np.maximum(b, 0)], self.prev[0])
            bid = np.where(b >= 0, rid[np.maximum(b, 0)], self.prev[1])
            done = a < n
            if done.any():
                i = a[done]
                if (out := self.settle(lt[done], lid[done], ltol[done], bt[done], bid[done], tick[i], rid[i])) is not None:
                    yield out
            rest = ~done
            if rest.any():
                self.wait.append((lt[rest], lid[rest], ltol[rest], bt[rest], bid[rest]))
        if right.any():
            # of right records at one tick the smallest id stands for all
            i = int(before[-1])
            self.prev = (int(tick[i]), int(rid[i]))
        if self.wait:
            # rows whose tolerance ended before this point can't match a later record: settle them
            now = int(tick[-1])
            late = [c[2] < now - c[0] for c in self.wait]
            if any(x.any() for x in late):
                cols = [np.concatenate(c) for c in zip(*self.wait)]
                gone = np.concatenate(late)
                n = int(gone.sum())
                out = self.settle(*[c[gone] for c in cols], np.full(n, _NONE), np.full(n, _NONE))
                self.wait = [tuple(c[~gone] for c in cols)] if (~gone).any() else []
                if out is not None:
                    yield out


def _merge_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    state = _Merge()
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column(0).dictionary_encode()
        codes, names = key.indices.to_numpy(zero_copy_only=False), key.dictionary.to_pylist()
        slices, tick, side, rid, tol = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(1, 6))
        cuts = np.flatnonzero((np.diff(codes) != 0) | (np.diff(slices) != 0)) + 1
        for lo, hi in zip([0, *cuts], [*cuts, len(tick)]):
            group = (names[codes[lo]], int(slices[lo]))
            if group != state.group:
                if (out := state.flush(_NONE, _NONE)) is not None:
                    yield out
                state = _Merge()
                state.group = group
            yield from state.feed(tick[lo:hi], side[lo:hi], rid[lo:hi], tol[lo:hi])
    if (out := state.flush(_NONE, _NONE)) is not None:
        yield out


def nearest_in_time(left: DataFrame, right: DataFrame, slice_ticks: int = SLICE_TICKS) -> DataFrame:
    """The nearest right record of each left record's entity, within the left record's tolerance.

    ``left``: (``entity`` string, ``id`` bigint, ``tick`` bigint, ``tolerance`` bigint);
    ``right``: (``entity``, ``id``, ``tick``). Ticks are whole units. Gives (``left_id``,
    ``right_id``, ``left_tick``, ``right_tick``), at most one row for each left id.
    Distance may equal the tolerance. Of two equally near records the earlier counts, of several
    at the same tick the smallest id. Rows with a null entity, id, tick or tolerance don't count;
    rows repeated in full count once; extra columns are ignored; empty tables give no rows.
    """
    cut = F.floor(F.col("tick") / F.lit(slice_ticks)).cast("long").alias("slice")
    r = right.select("entity", F.col("id").cast("long").alias("id"), F.col("tick").cast("long").alias("tick")).dropna()
    # one record stands for all at the same tick: pre-aggregated before the shuffle
    r = r.select("entity", cut, "tick", "id").groupBy("entity", "slice", "tick").agg(F.min("id").alias("id"))
    le = left.select("entity", F.col("id").cast("long").alias("id"), F.col("tick").cast("long").alias("tick"), F.col("tolerance").cast("long").alias("tolerance")).dropna()
    le = le.select("entity", cut, "tick", "id", "tolerance")
    heads = r.groupBy("entity", "slice").agg(
        F.min(F.struct("tick", "id")).alias("head"), F.max_by(F.struct("tick", "id"), "tick").alias("tail")
    )
    used = le.select("entity", "slice").distinct()
    known = heads.unionByName(used.withColumn("head", F.lit(None)).withColumn("tail", F.lit(None)), allowMissingColumns=True)
    known = known.groupBy("entity", "slice").agg(F.max("head").alias("head"), F.max("tail").alias("tail"), F.count("*").alias("n"))
    w = Window.partitionBy("entity").orderBy("slice")
    edges = known.select(
        "entity", "slice",
        F.last("tail", True).over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("before"),
        F.first("head", True).over(w.rowsBetween(1, Window.unboundedFollowing)).alias("after"),
    )
    edges = edges.select("entity", "slice", F.explode(F.array("before", "after")).alias("r")).where("r is not null").select("entity", "slice", "r.tick", "r.id")
    zero = F.lit(0).cast("long")
    rows = (
        r.select("entity", "slice", "tick", zero.alias("side"), "id", zero.alias("tolerance"))
        .unionByName(edges.select("entity", "slice", "tick", zero.alias("side"), "id", zero.alias("tolerance")))
        .unionByName(le.select("entity", "slice", "tick", F.lit(1).cast("long").alias("side"), "id", "tolerance"))
    )
    rows = rows.repartition("entity", "slice").sortWithinPartitions("entity", "slice", "tick", "side", "id")
    out = rows.mapInArrow(_merge_partition, _OUT)
    # rows repeated in full lie side by side in one slice; ids that stand at several ticks keep the nearest
    return out.groupBy("left_id").agg(F.min(F.struct(F.abs(F.col("left_tick") - F.col("right_tick")).alias("d"), "right_tick", "right_id", "left_tick")).alias("m")).select(
        "left_id", F.col("m.right_id").alias("right_id"), F.col("m.left_tick").alias("left_tick"), F.col("m.right_tick").alias("right_tick")
    )
