"""Programs that are sequential within a plan: slot walks, diversified order, assignment, evidence.

Plans run side by side as grouped functions, assignments as one pass over sorted plans; inside one plan each step depends on the one before.
Their inputs are bounded per plan by construction (a track's distinct times, a batch's candidates, candidate pools), and
all scoring that doesn't depend on earlier choices is done in columns before.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def slot_walk(events: DataFrame, window_ms: int = 600_000, lo: int = 800, target: int = 2000, hi: int = 4000, terminal: int = 500) -> DataFrame:
    """(track, window, slot, start_ms, end_ms): a walk over a track's sounds from 0 to its last one.

    From each cursor the boundary is the sound between ``lo`` and ``hi`` ms ahead that is nearest to
    ``target``, less 0.08 s of distance for full strength, then the earlier; without one, ``target``.
    A rest shorter than ``terminal`` joins the slot before. Slots cover a track without gaps;
    ``window`` is the part of the time line in which a slot starts. A track's walk needs its distinct times at once.

    ``events``: (track, ms, strength in thousandths); null tracks and times don't count.
    """
    e = events.where("track is not null and ms >= 0").select("track", "ms", F.coalesce("strength", F.lit(0).cast("long")).alias("strength"))
    e = e.groupBy("track", "ms").agg(F.max("strength").alias("strength"))

    def walk(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ms")
        t, s = pdf["ms"].to_numpy(), pdf["strength"].to_numpy()
        at, end = 0, int(t[-1])
        out = []
        while end - at > 0:
            i, j = np.searchsorted(t, [at + lo, at + hi + 1])
            if i < j:
                cost = np.abs(t[i:j] - at - target) - s[i:j] * 80 // 1000
                to = int(t[i + int(cost.argmin())])
            else:
                to = at + target
            if end - to < terminal:
                to = end
            out.append((key[0], at // window_ms, len(out), at, to))
            at = to
        return pd.DataFrame(out, columns=["track", "window", "slot", "start_ms", "end_ms"])

    return e.groupBy("track").applyInPandas(walk, "track string, window bigint, slot bigint, start_ms bigint, end_ms bigint")


def diversified_order(cands: DataFrame, task: str) -> DataFrame:
    """(task, id, position, adjusted): greedy order of all candidates of each task.

    ``cands``: (task, id, score, scene, author), score in thousandths. The first of a scene gains 120,
    the second 50, later ones lose 60 a repetition; each earlier pick of an author costs 25.
    Of equals the higher score and then the smaller id comes first. Within a scene and author the
    order is that of the scores, so each step looks at the best one left of each such pair; adjusted
    scores only fall, so a heap whose head is scored again gives the exact greedy order.
    """

    def order(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        queues: dict[tuple, list] = {}
        for ident, score, scene, author in pdf.sort_values(["score", "id"], ascending=[True, False])[["id", "score", "scene", "author"]].itertuples(index=False, name=None):
            queues.setdefault((scene, author), []).append((int(score), int(ident)))
        scenes: dict = {}
        authors: dict = {}

        def entry(pair: tuple, n: int) -> tuple:
            score, ident = queues[pair][-1]
            k = scenes.get(pair[0], 0)
            gain = score + (120 if k == 0 else 50 if k == 1 else -60 * (k - 1)) - 25 * authors.get(pair[1], 0)
            return -gain, -score, ident, n, pair

        heap = [entry(pair, n) for n, pair in enumerate(queues)]
        heapq.heapify(heap)
        out = []
        while heap:
            *_, n, pair = head = heap[0]
            now = entry(pair, n)
            if now[0] != head[0]:
                heapq.heapreplace(heap, now)
                continue
            out.append((key[0], now[2], len(out), -now[0]))
            queues[pair].pop()
            scenes[pair[0]] = scenes.get(pair[0], 0) + 1
            authors[pair[1]] = authors.get(pair[1], 0) + 1
            if queues[pair]:
                heapq.heapreplace(heap, entry(pair, n))
            else:
                heapq.heappop(heap)
        return pd.DataFrame(out, columns=[task, "id", "position", "adjusted"])

    kind = dict(cands.dtypes)[task]
    return cands.where(f"{task} is not null and score is not null").groupBy(task).applyInPandas(order, f"{task} {kind}, id bigint, position bigint, adjusted bigint")


def assign(options: DataFrame, max_reuse: int = 2, gap: int = 2) -> DataFrame:
    """(plan, slot, source, score, reason): greedy assignment of sources to the slots of each plan in order.

    ``options``: (plan, slot, source, score). A source may be used ``max_reuse`` times and not within
    ``gap`` slots of its last use; unused sources are preferred. Of equals the smaller source wins.
    A slot none can fill keeps NULL and the reason of its best option. All options of a slot count.
    Options are sorted by plan, slot and rank within partitions of whole plans and read once in that order, many plans
    in one pass, so a task holds the sources that one plan has used and a batch of rows.
    """
    o = options.where("plan is not null and slot is not null and source is not null and score is not null").select(*(F.col(c).cast("long").alias(c) for c in ("plan", "slot", "source", "score")))
    o = o.repartition("plan").groupBy("plan", "slot", "source").agg(F.max("score").alias("score"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        used: dict[int, int] = {}
        last: dict[int, int] = {}
        plan = slot = fit = fresh = why = None
        out: list[tuple] = []

        def settle() -> None:
            pick = fresh or fit
            if pick:
                used[pick[0]] = used.get(pick[0], 0) + 1
                last[pick[0]] = slot
            out.append((plan, slot, *(pick or (None, None)), None if pick else why))

        def rows() -> pa.RecordBatch:
            cols = zip(*out) if out else [()] * 5
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.int64()] * 4 + [pa.string()])], ["plan", "slot", "source", "score", "reason"])

        for batch in batches:
            for p, s, source, score in zip(*(batch.column(i).to_numpy().tolist() for i in range(4))):
                if p != plan or s != slot:
                    if plan is not None:
                        settle()
                    if p != plan:
                        used.clear()
                        last.clear()
                    plan, slot, fit, fresh, why = p, s, None, None, None
                if fresh:
                    continue
                reason = "max_reuse" if used.get(source, 0) >= max_reuse else "repeat_gap" if source in last and s - last[source] <= gap else None
                if reason is None:
                    fit = fit or (source, score)
                    if source not in used:
                        fresh = (source, score)
                elif why is None:
                    why = reason
            yield rows()
            out.clear()
        if plan is not None:
            settle()
            yield rows()

    ranked = o.sortWithinPartitions("plan", "slot", F.desc("score"), "source").select("plan", "slot", "source", "score")
    return ranked.mapInArrow(run, "plan bigint, slot bigint, source bigint, score bigint, reason string")


def evidence(frames: DataFrame, budget: int = 24) -> DataFrame:
    """(group, id, tier): frames to look at, pinned first, then one of each label, then the rest, within the budget.

    ``frames``: (group, id, pinned, label). The order is total, so the choice never depends on partitions.
    """
    first = F.row_number().over(Window.partitionBy("group", "label").orderBy("id")) == 1
    tier = F.when(F.col("pinned"), 0).when(first & F.col("label").isNotNull(), 1).otherwise(2)
    rows = frames.withColumn("tier", tier)
    r = F.row_number().over(Window.partitionBy("group").orderBy("tier", "id"))
    return rows.withColumn("r", r).where(F.col("r") <= budget).select("group", "id", "tier")
