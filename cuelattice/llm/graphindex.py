"""Deduplicating new batches against all history with graph index shards.

The history's distinct hash values lie in shards: the catalog, one shard for each batch, and merged
ones. A shard's segment is a navigable small-world graph: each value links to its ``LINKS`` nearest, and
links are walked in both directions. A search enters the graph beside the query's place in several
bit-permuted sorted orders and walks on from every value within ``MAX_BITS`` + ``SLACK`` bits of the
query until it meets no new one, so its beam is as wide as the query's surroundings are dense. The number of
sorted orders that give entry points is widened until sampled queries, half of them at the full distance and half
in dense surroundings, reach the target recall of an exact search; a segment that misses it with all orders
is searched exactly, by blocks of bits. What is met is reranked exactly.

Segments are ranges of duration (records whose durations differ too much are never alike), so a query
visits those alone that its duration can match; a range that one duration fills is split by hash.

``Index`` is a folder. ``create`` takes the catalog; ``append`` takes new batches, reads the index and not
the history's texts or graphs again, and adds their shards and what was accepted; ``compact`` drops merged-away shards.
Compaction follows a fixed schedule (four shards of one level make one of the next as the batch
counter in base 4 carries), so a batch reads O(log batches) shards and the catalog's, which are never rebuilt.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import discard, scratch_path, write_out
from . import fingerprints as fp

SHARD_VALUES = 2_000_000  # values of a segment, about
QUERY_BLOCK = 250_000  # query values that one task searches in one segment, about
LINKS = 6
SLACK = 3
TARGET_RECALL = 0.97  # of single values; records that are alike mostly share several
SAMPLE = 512
#: Sorted orders that give entry points, from narrow to wide, and places on either side in each.
WIDTHS = (8, 12, 16, 20, 26, 32, 40, 48, 64, 96)
PLACES = 4
#: Segments up to this size need no graph: their few values are all entry points.
ALL_ENTRIES = 64
HITS = 50_000  # entry hits that are walked from together
SEED = 20_250_101
#: Records that a query value may reach and still be *light*; a record that can do without its other values does.
WIDE = 512
INDEX = "seg bigint, part int, n bigint, width int, recall double, entry_recall double, vals binary, counts binary, graph binary"
MET = "va bigint, w bigint, vbs array<bigint>"
_PART = 250_000


def _orders(n: int) -> np.ndarray:
    rng = np.random.default_rng(SEED)
    return np.array([rng.permutation(64) for _ in range(n)], dtype=np.uint64)


def _prefixes(values: np.ndarray, order: np.ndarray) -> np.ndarray:
    """The first 32 bits of the values in a bit order; tables of 16 bits, vectorised."""
    byte = np.arange(256, dtype=np.uint32)
    small = np.zeros((8, 256), np.uint32)
    for to, pos in enumerate(order[:32].tolist()):
        small[pos // 8] |= ((byte >> np.uint32(pos % 8)) & np.uint32(1)) << np.uint32(31 - to)
    parts = values.astype("<u8").view("<u2").reshape(-1, 4)
    out = (small[1][:, None] | small[0]).ravel()[parts[:, 0]]
    for k in (1, 2, 3):
        out |= (small[2 * k + 1][:, None] | small[2 * k]).ravel()[parts[:, k]]
    return out


def _sorted(values: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(prefixes, positions) of the values in a bit order."""
    both = np.sort(_prefixes(values, order).astype(np.uint64) << np.uint64(32) | np.arange(len(values), dtype=np.uint64))
    return (both >> np.uint64(32)).astype(np.uint32), (both & np.uint64(0xFFFFFFFF)).astype(np.int64)


def build_graph(values: np.ndarray, orders: int = 3, reach: int = 6) -> np.ndarray:
    """(n, LINKS) positions of the nearest that each of the sorted distinct values meets in a few sorted orders."""
    n = len(values)
    if n <= ALL_ENTRIES:
        return np.zeros((0, LINKS), np.int32)
    near = []
    for order in _orders(WIDTHS[-1] + orders)[-orders:]:
        o = _sorted(values, order)[1].astype(np.int32)
        place = np.empty(n, np.int32)
        place[o] = np.arange(n, dtype=np.int32)
        for off in (*range(-reach, 0), *range(1, reach + 1)):
            near.append(o[np.clip(place + off, 0, n - 1)])
    ids = np.stack(near, 1)
    out = np.empty((n, LINKS), np.int32)
    for lo in range(0, n, 50_000):
        c = np.sort(ids[lo : lo + 50_000], axis=1)
        own = np.arange(lo, lo + len(c), dtype=np.int32)[:, None]
        d = np.bitwise_count(values[c] ^ values[own])
        d[:, 1:][c[:, 1:] == c[:, :-1]] = 65
        d[c == own] = 65
        best = np.argpartition(d, LINKS, axis=1)[:, :LINKS]
        out[lo : lo + len(c)] = np.take_along_axis(c, best, 1)
    return out


def _reversed(graph: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, sources) of the links into each value."""
    n = len(graph)
    to = graph.ravel()
    sources = (np.argsort(to, kind="stable") // LINKS).astype(np.int32)
    starts = np.zeros(n + 1, np.int64)
    np.cumsum(np.bincount(to, minlength=n), out=starts[1:])
    return starts, sources


def exact_blocks(values: np.ndarray, queries: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All (query position, value position) within ``MAX_BITS``, each once, of any data.

    Two values that differ in at most ``MAX_BITS`` bits agree in one of ``MAX_BITS`` + 1 blocks of bits.
    """
    blocks = fp.MAX_BITS + 1
    cuts = [64 * b // blocks for b in range(blocks + 1)]
    masks = [np.uint64((1 << hi) - (1 << lo)) for lo, hi in zip(cuts, cuts[1:])]
    for b, mask in enumerate(masks):
        vk, qk = values & mask, queries & mask
        vo, qo = np.argsort(vk), np.argsort(qk)
        keys, first = np.unique(qk[qo], return_index=True)
        last = [*first[1:].tolist(), len(qo)]
        vk = vk[vo]
        lo, hi = np.searchsorted(vk, keys), np.searchsorted(vk, keys, side="right")
        for f, e, x, y in zip(first.tolist(), last, lo.tolist(), hi.tolist()):
            if x == y:
                continue
            own, at = values[vo[x:y]], vo[x:y]
            step = max(1, 4_000_000 // (y - x))
            for k in range(f, e, step):
                rows = qo[k : min(e, k + step)]
                diff = queries[rows][:, None] ^ own
                q, v = np.nonzero(np.bitwise_count(diff) <= fp.MAX_BITS)
                # pairs that agree in an earlier block came out there
                keep = np.ones(len(q), bool)
                for m in masks[:b]:
                    keep &= (diff[q, v] & m) != 0
                if keep.any():
                    yield rows[q[keep]], at[v[keep]]


def _pairs(found: Iterator[tuple[np.ndarray, np.ndarray]], n: int) -> np.ndarray:
    """Sorted query position * n + value position."""
    return np.sort(np.concatenate([np.zeros(0, np.int64), *(q * n + v for q, v in found)]))


def entry_hits(values: np.ndarray, queries: np.ndarray, orders: Sequence[np.ndarray]) -> np.ndarray:
    """Entry points within the walk's reach: sorted query position * n + value position."""
    n = len(values)
    met = [np.zeros(0, np.int64)]
    for order in orders:
        keys, o = _sorted(values, order)
        pq, qo = _sorted(queries, order)
        there, sought = values[o], queries[qo]
        pos = np.searchsorted(keys, pq)
        for off in range(-PLACES, PLACES):
            at = np.clip(pos + off, 0, n - 1)
            hit = np.flatnonzero(np.bitwise_count(there[at] ^ sought) <= fp.MAX_BITS + SLACK)
            met.append(qo[hit] * n + o[at[hit]])
    return np.unique(np.concatenate(met))


def walk(values: np.ndarray, graph: np.ndarray, back: tuple[np.ndarray, np.ndarray], queries: np.ndarray, hits: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(query position, value position) within ``MAX_BITS`` that the graph leads to from the entry ``hits``, each once."""
    n = len(values)
    starts, sources = back
    lo = 0
    while lo < len(hits):
        # whole queries together, few where values crowd around
        hi = int(np.searchsorted(hits, (hits[min(lo + HITS, len(hits)) - 1] // n + 1) * n))
        seen = front = hits[lo:hi]
        lo = hi
        while len(front):
            q, v = front // n, front % n
            deg = starts[v + 1] - starts[v]
            into = np.repeat(starts[v] - np.cumsum(deg) + deg, deg) + np.arange(deg.sum())
            q = np.concatenate([np.repeat(q, LINKS), np.repeat(q, deg)])
            v = np.concatenate([graph[v].ravel(), sources[into]])
            near = np.bitwise_count(values[v] ^ queries[q]) <= fp.MAX_BITS + SLACK
            new = np.unique(q[near] * n + v[near])
            front = new[seen[np.minimum(np.searchsorted(seen, new), len(seen) - 1)] != new]
            seen = np.sort(np.concatenate([seen, front]), kind="stable")
        q, v = seen // n, seen % n
        near = np.bitwise_count(values[v] ^ queries[q]) <= fp.MAX_BITS
        yield q[near], v[near]


def search_segment(values: np.ndarray, graph: np.ndarray, queries: np.ndarray, width: int, recall: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(query position, value position) met within ``MAX_BITS``, each once.

    The graph answers; where the tuned ``recall`` misses the target the segment is searched exactly.
    """
    n = len(values)
    if not n or not len(queries):
        return
    if n <= ALL_ENTRIES:
        q, v = np.nonzero(np.bitwise_count(queries[:, None] ^ values) <= fp.MAX_BITS)
        yield q, v
    elif recall < TARGET_RECALL:
        yield from exact_blocks(values, queries)
    else:
        yield from walk(values, graph, _reversed(graph), queries, entry_hits(values, queries, _orders(width)))


def sample_queries(values: np.ndarray, size: int = SAMPLE) -> tuple[np.ndarray, np.ndarray]:
    """(at the full distance, in dense surroundings): queries to tune by.

    The first are random values with ``MAX_BITS`` bits flipped, the hardest that count; the second are values
    that many others crowd around in a sorted order, with one bit flipped.
    """
    rng = np.random.default_rng(SEED)
    n = len(values)

    def flipped(v: np.ndarray, bits: int) -> np.ndarray:
        at = rng.random((len(v), 64)).argpartition(bits, axis=1)[:, :bits].astype(np.uint64)
        return v ^ np.bitwise_or.reduce(np.uint64(1) << at, axis=1)

    far = flipped(values[rng.choice(n, min(size, n), replace=False)], fp.MAX_BITS)
    crowd = np.zeros(n, np.int32)
    for order in _orders(2):
        o = _sorted(values, order)[1]
        there = values[o]
        for off in range(1, 9):
            near = np.bitwise_count(there[off:] ^ there[:-off]) <= 2 * fp.MAX_BITS
            crowd[o[off:][near]] += 1
            crowd[o[:-off][near]] += 1
    dense = np.flatnonzero(crowd >= 12)
    dense = rng.choice(dense, min(size, len(dense)), replace=False) if len(dense) else dense
    return far, flipped(values[dense], 1)


def tuned(values: np.ndarray, graph: np.ndarray, target: float = TARGET_RECALL) -> tuple[int, float, float]:
    """(width, recall, entry recall): the least number of sorted orders that meets ``target`` on both samples.

    The recall of the worse sample against an exact search counts; the entry recall is what the same entry points
    reach without the graph. If no width meets the target the last is recorded, and the segment is searched exactly.
    """
    n = len(values)
    if n <= ALL_ENTRIES:
        return WIDTHS[0], 1.0, 1.0
    far, dense = sample_queries(values)
    queries = np.concatenate([far, dense])
    want = _pairs(exact_blocks(values, queries), n)
    hard = want < len(far) * n
    back = _reversed(graph)
    hits, done, orders = np.zeros(0, np.int64), 0, _orders(WIDTHS[-1])
    recall = entries = 0.0
    # share of values at the full distance beside the query in one order; fewer orders than it allows needn't be measured
    beside = math.prod((57 - i) / (64 - i) for i in range(min(57, max(0, math.ceil(math.log2(n / PLACES / 2))))))
    least = 0.6 * math.log(1 - target) / math.log(1 - beside) if beside < 1 else 0
    for width in WIDTHS:
        if width < least and width < WIDTHS[-1]:
            continue
        hits = np.union1d(hits, entry_hits(values, queries, orders[done:width]))
        done = width
        got = np.isin(want, _pairs(walk(values, graph, back, queries, hits), n))
        recall = min(float(got[part].mean()) for part in (hard, ~hard) if part.any()) if len(want) else 1.0
        entries = float(np.isin(want, hits).mean()) if len(want) else 1.0
        if recall >= target:
            break
    return done, recall, entries


# ---- segments of a shard ------------------------------------------------------------------------
CATALOG = -1
_LEVEL = 1 << 32
_SEG = 20  # bits of a segment's number within its shard
_CUTS = 256
_LOW, _HIGH = -(1 << 62), 1 << 62


class Stats(NamedTuple):
    """What the plan knows of a batch (or the catalog): its values and quantiles of their durations."""

    rank: int
    batch_no: int | None
    n: int
    cuts: list[int]


class Spans(NamedTuple):
    """A shard's segments: ranges of duration from ``low`` to below the next, each of ``sub`` segments from ``base``."""

    low: np.ndarray
    base: np.ndarray
    sub: np.ndarray


def spans(parts: Sequence[Stats], size: int = SHARD_VALUES) -> Spans:
    """Segments of about ``size`` values for a shard of these batches. Balance is all that the quantiles decide."""
    n = sum(p.n for p in parts)
    ranges = min(_CUTS, max(1, math.ceil(n / size)))
    at = np.array([c for p in parts for c in p.cuts], np.int64)
    weight = np.array([p.n / len(p.cuts) for p in parts for _ in p.cuts])
    low, count = np.array([_LOW], np.int64), np.array([1])
    if ranges > 1 and len(at):
        o = np.argsort(at, kind="stable")
        share = np.cumsum(weight[o]) / weight.sum()
        edges = at[o][np.minimum(np.searchsorted(share, np.arange(1, ranges) / ranges), len(at) - 1)]
        # an edge that stands several times is a duration that fills several ranges
        low, count = np.unique(np.concatenate([low, edges]), return_counts=True)
    sub = np.maximum(1, np.ceil(count * n / ranges / size)).astype(np.int64)
    return Spans(low, np.concatenate([[0], np.cumsum(sub)[:-1]]), sub)


def _mixed(v: np.ndarray, seed: int) -> np.ndarray:
    x = (v ^ np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15)
    return (x ^ x >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(33)


def reach(ms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The shortest and longest duration that a record of ``ms`` can be alike to."""
    p = 100 - fp.MAX_PERCENT
    low = ms // 100 * p + -(-(ms % 100) * p // 100)
    return low, ms // p * 100 + ms % p * 100 // p


def _grouped(seg: np.ndarray, v: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    o = np.argsort(seg, kind="stable")
    ids, cut = np.unique(seg[o], return_index=True)
    yield from zip(ids.tolist(), np.split(v[o], cut[1:]))


def _packed(rows: DataFrame, emit, most: int = 100_000) -> DataFrame:
    """(seg, block, vals) of rows (rank, ms, hashes): ``emit`` maps a rank and its (ms, values) to segments; values are packed into byte strings, cheap to shuffle."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def out() -> Iterator[pa.RecordBatch]:
            rank, ms, v = (np.concatenate(x) for x in zip(*held))
            held.clear()
            segs, blocks, blobs = [], [], []
            for r in np.unique(rank).tolist():
                own = rank == r
                for seg, block, vals in emit(r, ms[own], v[own]):
                    segs.append(seg), blocks.append(block), blobs.append(vals.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(segs, pa.int64()), pa.array(blocks, pa.int32()), pa.array(blobs, pa.binary())], ["seg", "block", "vals"])

        for b in batches:
            lists = b.column(2)
            offsets, v = np.asarray(lists.offsets), np.asarray(lists.flatten()).view(np.uint64)
            per = np.diff(offsets)
            held.append((np.repeat(b.column(0).to_numpy(), per), np.repeat(b.column(1).to_numpy(), per), v))
            if sum(len(h[0]) for h in held) >= most:
                yield from out()
        if held and sum(len(h[0]) for h in held):
            yield from out()

    return rows.where("ms is not null and size(hashes) > 0").select("rank", "ms", "hashes").mapInArrow(pack, "seg bigint, block int, vals binary")


def build_shards(rows: DataFrame, writes: dict[int, list[int]], plan: dict[int, Spans]) -> DataFrame:
    """The index rows of new shards from (rank, ms, hashes); ``writes``: the shards that a rank's values go to."""

    def emit(rank: int, ms: np.ndarray, v: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
        for shard in writes.get(rank, ()):
            s = plan[shard]
            r = np.searchsorted(s.low, ms, side="right") - 1
            seg = (shard << _SEG) + s.base[r] + (_mixed(v, 1) % s.sub[r].astype(np.uint64)).astype(np.int64)
            for i, vals in _grouped(seg, v):
                yield i, 0, vals

    def build(key: tuple, it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, counts = np.unique(np.concatenate([np.frombuffer(x.as_buffer(), np.uint64) for b in it for x in b.column("vals")]), return_counts=True)
        counts = counts.astype(np.uint32)
        graph = build_graph(v)
        width, recall, entries = tuned(v, graph)
        for i, lo in enumerate(range(0, len(v), _PART)):
            cut = slice(lo, lo + _PART)
            yield pa.RecordBatch.from_pylist([{"seg": key[0].as_py(), "part": i, "n": len(v), "width": width, "recall": recall, "entry_recall": entries, "vals": v[cut].tobytes(), "counts": counts[cut].tobytes(), "graph": graph[cut].tobytes()}], _ARROW)

    return _packed(rows, emit).groupBy("seg").applyInArrow(build, INDEX)


_ARROW = pa.schema([("seg", pa.int64()), ("part", pa.int32()), ("n", pa.int64()), ("width", pa.int32()), ("recall", pa.float64()), ("entry_recall", pa.float64()), ("vals", pa.binary()), ("counts", pa.binary()), ("graph", pa.binary())])


def query_blocks(reads: dict[int, list[int]], stats: dict[int, Stats], plan: dict[int, Spans]) -> dict[int, int]:
    """Segment to the number of blocks that its queries are cut into, of about ``QUERY_BLOCK`` values each."""
    n: dict[int, float] = {}
    for rank, shards in reads.items():
        low, high = reach(np.array(stats[rank].cuts or [0], np.int64))
        for shard in shards:
            s = plan[shard]
            ends = np.concatenate([s.low[1:], [_HIGH]])
            share = ((low[:, None] < ends) & (high[:, None] >= s.low)).mean(0)
            for j in range(len(s.low)):
                for k in range(int(s.sub[j])):
                    seg = (shard << _SEG) + int(s.base[j]) + k
                    n[seg] = n.get(seg, 0) + share[j] * stats[rank].n
    return {seg: max(1, math.ceil(x / QUERY_BLOCK)) for seg, x in n.items()}


def search_shards(index: DataFrame, rows: DataFrame, reads: dict[int, list[int]], plan: dict[int, Spans], blocks: dict[int, int]) -> DataFrame:
    """(va, w, vbs): query values, records they reach and different history values within ``MAX_BITS``, from (rank, ms, hashes).

    ``reads``: the shards that a rank's values are searched in. A value may have several rows, of several segments;
    values that meet none but themselves have none.
    """

    def emit(rank: int, ms: np.ndarray, v: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
        low, high = reach(ms)
        for shard in reads.get(rank, ()):
            s = plan[shard]
            ends = np.concatenate([s.low[1:], [_HIGH]])
            for j in range(len(s.low)):
                own = np.unique(v[(low < ends[j]) & (high >= s.low[j])] if len(s.low) > 1 else v)
                for k in range(int(s.sub[j]) if len(own) else 0):
                    seg = (shard << _SEG) + int(s.base[j]) + k
                    many = blocks[seg]
                    if many == 1:
                        yield seg, 0, own
                    else:
                        for block, vals in _grouped((_mixed(own, 2) % np.uint64(many)).astype(np.int64), own):
                            yield seg, block, vals

    def search(key: tuple, it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, asked, width, recall = {}, [], 0, 0.0
        for b in it:
            for row in b.to_pylist():
                if row["part"] is None:
                    asked.append(np.frombuffer(row["vals"], np.uint64))
                else:
                    parts[row["part"]] = (row["vals"], row["counts"], row["graph"])
                    width, recall = row["width"], row["recall"]
        if not parts or not asked:
            return
        v = np.frombuffer(b"".join(parts[i][0] for i in sorted(parts)), np.uint64)
        counts = np.frombuffer(b"".join(parts[i][1] for i in sorted(parts)), np.uint32).astype(np.int64)
        graph = np.frombuffer(b"".join(parts[i][2] for i in sorted(parts)), np.int32).reshape(-1, LINKS)
        parts.clear()
        q = np.unique(np.concatenate(asked))
        for qi, vi in search_segment(v, graph, q, width, recall):
            if not len(qi):
                continue
            # runs of one query; a value's meeting with itself counts, but isn't listed
            start = np.concatenate([[0], np.flatnonzero(np.diff(qi)) + 1])
            w = np.add.reduceat(counts[vi], start)
            other = q[qi] != v[vi]
            listed = np.add.reduceat(other.astype(np.int32), start)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(listed)]), pa.int32()), pa.array(v[vi[other]].view(np.int64)))
            rows = pa.RecordBatch.from_arrays([pa.array(q[qi[start]].view(np.int64)), pa.array(w), lists], ["va", "w", "vbs"])
            yield rows.filter(pa.array((listed > 0) | (w > 1)))

    spark = index.sparkSession
    at = spark.createDataFrame([(seg, b) for seg, n in blocks.items() for b in range(n)] or [(0, -1)], "seg bigint, block int")
    own = index.join(F.broadcast(at), "seg").select("seg", "block", "part", "width", "recall", "vals", "counts", "graph")
    null = lambda t: F.lit(None).cast(t)
    asked = _packed(rows, emit).select("seg", "block", null("int").alias("part"), null("int").alias("width"), null("double").alias("recall"), "vals", null("binary").alias("counts"), null("binary").alias("graph"))
    return own.unionByName(asked).groupBy("seg", "block").applyInArrow(search, MET)


# ---- schedule of the batch shards -------------------------------------------------------------
def shards_read(rank: int) -> list[int]:
    """Shards that the batch of this rank (from 0) reads: the catalog's, its own and those of all batches before.

    Four shards of one level make one of the next, so at most three a level are read.
    """
    out = [CATALOG, rank]
    level = 0
    while rank >> 2 * level:
        here = rank >> 2 * level
        out.extend(level * _LEVEL + b for b in range(here - here % 4, here))
        level += 1
    return out


def ranks_of(shard: int) -> range:
    """The batches that a shard holds."""
    level, block = divmod(shard, _LEVEL)
    return range(block << 2 * level, (block + 1) << 2 * level)


# ---- records over value pairs -------------------------------------------------------------------
def class_links(left: DataFrame, right: DataFrame, met: DataFrame) -> DataFrame:
    """(a, s, b): all pairs of a left class and another right class that are alike by content.

    ``right``: classes (s, id, ms, hashes); ``left``: those of them that are asked for, (id, ms, hashes), side 1 of ``right``;
    ``met``: output of ``search_shards`` for the left values. Equal values meet by an equi-join.

    Two alike lists pair up in at least ``need`` members of either, so a left class can do without ``need`` - 1 of its
    members: a class whose members that reach more than ``WIDE`` records are that few is expanded over the others alone.
    Classes with more of them go through ``_crowded_links``.
    """
    fl = left.select("id", "ms", "hashes", F.size("hashes").alias("n"))
    fr = right.select("s", "id", "ms", "hashes", F.size("hashes").alias("n"))
    pr = fr.select("s", F.col("id").alias("b"), F.col("ms").alias("mb"), F.col("n").alias("nb"), F.explode(F.array_distinct("hashes")).alias("vb"))
    weight = met.groupBy("va").agg(F.sum("w").alias("w"))
    each = fl.select(F.col("id").alias("a"), F.col("ms").alias("ma"), F.col("n").alias("na"), F.explode("hashes").alias("va"))
    each = each.join(weight, "va", "left").withColumn("light", F.coalesce("w", F.lit(0)) <= WIDE)
    each = each.groupBy("a", "ma", "na").agg(F.sum((~F.col("light")).cast("int")).alias("wide"), F.collect_set(F.when(F.col("light"), F.col("va"))).alias("vs"))
    each = write_out(each.withColumn("easy", F.col("wide") <= F.ceil(F.col("na") * 3 / 5) - 1), "graph-members")
    easy = each.where("easy").select("a", "ma", "na", F.explode("vs").alias("va"))
    steps = met.where((F.col("w") <= WIDE) & (F.size("vbs") > 0)).select("va", "vbs")
    pairs = easy.withColumnRenamed("va", "vb").unionByName(easy.join(steps, "va").select("a", "ma", "na", F.explode("vbs").alias("vb")))
    links = write_out(_verified(pairs.join(pr, "vb"), fl, fr), "graph-links")
    hard = each.where("not easy").select(F.col("a").alias("id"))
    if hard.take(1):
        hard = write_out(fl.join(hard, "id", "left_semi"), "graph-hard")
        own = hard.select(F.explode("hashes").alias("va")).distinct()
        pairs = met.join(own, "va", "left_semi").select("va", F.explode("vbs").alias("vb"))
        links = write_out(links.unionByName(_crowded_links(hard, fr, pairs)).distinct(), "graph-all-links")
    discard(each)
    return links


def _verified(pairs: DataFrame, fl: DataFrame, fr: DataFrame) -> DataFrame:
    """(a, s, b) of those (a, ma, na, s, b, mb, nb) whose durations fit and whose lists are alike."""
    fit = pairs.where(fp.durations_fit(F.col("ma"), F.col("mb")) & (F.least("na", "nb") * 5 >= F.greatest("na", "nb") * 3) & ~((F.col("s") == 1) & (F.col("a") == F.col("b"))))
    fit = fit.select("a", "s", "b").distinct()
    lists = fit.join(fr.select("s", F.col("id").alias("b"), F.col("hashes").alias("hb")), ["s", "b"]).join(fl.select(F.col("id").alias("a"), F.col("hashes").alias("ha")), "a")
    return fp.verified(lists.withColumn("s", F.col("s").cast("long")), ("a", "s", "b"))


def _crowded_links(fl: DataFrame, fr: DataFrame, met: DataFrame) -> DataFrame:
    """Links of classes in crowded surroundings, from different close values (va, vb).

    Heavy value pairs are not expanded; classes that meet over heavy values alone meet by their profiles,
    within duration cells.
    """
    pl = fl.select(F.col("id").alias("a"), F.col("ms").alias("ma"), F.col("n").alias("na"), F.explode(F.array_distinct("hashes")).alias("va"))
    pr = fr.select("s", F.col("id").alias("b"), F.col("ms").alias("mb"), F.col("n").alias("nb"), F.explode(F.array_distinct("hashes")).alias("vb"))
    ka = pl.groupBy("va").agg(F.count("*").alias("ka"))
    kb = pr.groupBy("vb").agg(F.count("*").alias("kb"))
    same = ka.join(kb, F.col("va") == F.col("vb")).select("va", "vb", "ka", "kb")
    weighed = write_out(met.join(ka, "va").join(kb, "vb").select("va", "vb", "ka", "kb").unionByName(same), "graph-values")
    few = F.col("ka") * F.col("kb") <= fp.HEAVY
    links = _verified(weighed.where(few).select("va", "vb").join(pr, "vb").join(pl, "va"), fl, fr)
    heavy = write_out(weighed.where(~few).select("va", "vb"), "graph-heavy")
    return links.unionByName(_heavy_links(fl.withColumn("s", F.lit(1)), fr, heavy)) if heavy.take(1) else links


def _heavy_links(fl: DataFrame, fr: DataFrame, heavy: DataFrame) -> DataFrame:
    from .lshforest import _enough

    def profiles(flat: DataFrame, side: str) -> DataFrame:
        zone = heavy.select(F.col(side).alias("v")).distinct()
        m = flat.select("s", "id", "ms", "n", F.explode("hashes").alias("v")).join(zone, "v")
        m = m.groupBy("s", "id", "ms", "n").agg(F.array_sort(F.collect_list("v")).alias("z")).where(F.size("z") * 5 >= F.col("n") * 3)
        return m.withColumn("key", F.sha2(F.to_json(F.struct("n", "z")), 256))

    left, right = write_out(profiles(fl, "va"), "graph-heavy-left"), write_out(profiles(fr, "vb"), "graph-heavy-right")
    ka, kb = (p.select("key", "n", "z").dropDuplicates(["key"]) for p in (left, right))
    va = ka.select(F.col("key").alias("x"), F.col("n").alias("na"), F.explode(F.array_distinct("z")).alias("va"))
    vb = kb.select(F.col("key").alias("y"), F.col("n").alias("nb"), F.explode(F.array_distinct("z")).alias("vb"))
    met = va.join(heavy, "va").join(vb, "vb").where(F.least("na", "nb") * 5 >= F.greatest("na", "nb") * 3).select("x", "y", "na", "nb").distinct()
    met = met.join(ka.select(F.col("key").alias("x"), F.col("z").alias("za")), "x").join(kb.select(F.col("key").alias("y"), F.col("z").alias("zb")), "y")
    good = met.where(_enough(F.col("za"), F.col("zb"), F.greatest("na", "nb"))).select("x", "y")
    # durations within the limit lie in the same or a neighbouring cell
    cell = F.floor(F.log(F.col("ms").cast("double")) / F.lit(-math.log(1 - fp.MAX_PERCENT / 100))).cast("long")
    a = left.select(F.col("key").alias("x"), F.col("id").alias("a"), F.col("ms").alias("ma"), F.explode(F.array(cell - 1, cell, cell + 1)).alias("cell"))
    b = right.select("s", F.col("key").alias("y"), F.col("id").alias("b"), F.col("ms").alias("mb"), cell.alias("cell"))
    found = a.join(good, "x").join(b, ["y", "cell"]).where(fp.durations_fit(F.col("ma"), F.col("mb")))
    return found.where("not (s = 1 and a = b)").select("a", F.col("s").cast("long").alias("s"), "b")


# ---- acceptance ------------------------------------------------------------------------------------
def settle(cands: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, ord): the candidates that are accepted, taken in order.

    ``cands``: (id, ord, p, s, c) with at most one accepted for each non-null key p (provider id),
    s (digest) and c (content class); ``edges``: (c, d) alike classes, both directions. Cliques
    stay keys: no group is expanded into pairs. Each round decides every candidate whose earlier
    rivals are decided, the first open one at least; rounds end when none is open.
    """
    keys = ("p", "s", "c")
    start = cands
    for k in keys:
        n = cands.where(F.col(k).isNotNull()).groupBy(k).agg(F.count("*").alias(f"n{k}")).where(f"n{k} > 1").withColumn(f"n{k}", F.lit(True))
        start = start.join(n, k, "left")
    inside = edges.join(cands.select("c").distinct(), "c", "left_semi").join(cands.select(F.col("c").alias("d")).distinct(), "d", "left_semi").distinct()
    inside = write_out(inside, "settle-edges")
    start = start.join(inside.select("c").distinct().withColumn("ne", F.lit(True)), "c", "left")
    start = write_out(start, "settle-all")
    alone = "np is null and ns is null and nc is null and ne is null"
    done = [start.where(alone).select("id", "ord")]
    left = start.where(f"not ({alone})").select("id", "ord", *keys)
    i = 0
    while True:
        x = left
        for k in keys:
            x = x.join(left.where(F.col(k).isNotNull()).groupBy(k).agg(F.min("ord").alias(f"m{k}")), k, "left")
        low = left.where("c is not null").groupBy(F.col("c").alias("d")).agg(F.min("ord").alias("o"))
        x = x.join(inside.join(low, "d").groupBy("c").agg(F.min("o").alias("me")), "c", "left")
        first = F.lit(True)
        for k in ("p", "s", "c", "e"):
            first = first & (F.col(f"m{k}").isNull() | (F.col("ord") <= F.col(f"m{k}")))
        x = write_out(x.withColumn("first", first).select("id", "ord", *keys, "first"), f"settle-{i}")
        got = x.where("first")
        done.append(got.select("id", "ord"))
        rest = x.where("not first")
        for k in keys:
            rest = rest.join(got.where(F.col(k).isNotNull()).select(k), k, "left_anti")
        taken = inside.join(got.where("c is not null").select(F.col("c").alias("d")), "d", "left_semi").select("c").distinct()
        was = left
        left = write_out(rest.join(taken, "c", "left_anti"), f"settle-left-{i}")
        if i:
            discard(was)
        i += 1
        if not left.take(1):
            break
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


# ---- the index ---------------------------------------------------------------------------------------
RECORDS = "s int, rank bigint, id bigint, sha string, ms bigint, hashes array<bigint>, pid bigint, c bigint"
_OK = "ms is not null and size(hashes) > 0"


class Index:
    """History as a folder of versions: records, graph shards and what the plan needs to know of each batch.

    A version counts once its mark stands, so a run that breaks off leaves no half of one.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _file(self, name: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def versions(self) -> list[str]:
        fs, p = self._file("")
        names = sorted(x.getPath().getName() for x in fs.listStatus(p)) if fs.exists(p) else []
        return [f"{self.path}/{n}" for n in names if n.startswith("v") and self._file(f"{n}/done")[0].exists(self._file(f"{n}/done")[1])]

    def _table(self, name: str, schema: str) -> DataFrame:
        found = [f"{v}/{name}" for v in self.versions()]
        fs = self._file("")[0]
        found = [f for f in found if fs.exists(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f))]
        return self.spark.read.schema(schema).parquet(*found) if found else self.spark.createDataFrame([], schema)

    def _write(self, df: DataFrame, version: str, name: str, schema: str) -> DataFrame:
        df.write.mode("overwrite").option("compression", "zstd").parquet(f"{version}/{name}")
        return self.spark.read.schema(schema).parquet(f"{version}/{name}")

    def _commit(self, version: str) -> None:
        fs, p = self._file(version.rsplit("/", 1)[1] + "/done")
        fs.create(p, True).close()

    def _next(self) -> str:
        return f"{self.path}/v{len(self.versions()):09d}"

    def records(self) -> DataFrame:
        """Everything accepted so far."""
        return self._table("records", RECORDS)

    def stats(self) -> dict[int, Stats]:
        """Metadata, one row a batch; of rank ``CATALOG`` for the catalog."""
        return {r[0]: Stats(*r) for r in self._table("stats", "rank bigint, batch_no bigint, n bigint, cuts array<bigint>").collect()}

    def shards(self) -> DataFrame:
        """(shard, segment, n, width, recall, entry_recall): every segment with what its tuning measured."""
        rows = self._table("shards", INDEX).where("part = 0")
        return rows.select(F.shiftright("seg", _SEG).alias("shard"), F.expr(f"seg - (seg >> {_SEG} << {_SEG})").alias("segment"), "n", "width", "recall", "entry_recall")

    def _stats_of(self, rows: DataFrame, by: Column) -> list:
        cuts = F.percentile_approx("ms", [i / _CUTS for i in range(_CUTS + 1)], 2000)
        return rows.where(_OK).groupBy(by.alias("b")).agg(F.sum(F.size("hashes")).alias("n"), cuts.alias("cuts")).collect()

    def _save_stats(self, version: str, stats: list[Stats]) -> None:
        schema = "rank bigint, batch_no bigint, n bigint, cuts array<bigint>"
        self._write(self.spark.createDataFrame(stats, schema).coalesce(1), version, "stats", schema)

    def create(self, catalog: DataFrame) -> Index:
        """Start from a catalog (id, sha, ms, hashes, pid): all of it is accepted."""
        version = self._next()
        if not version.endswith("v000000000"):
            raise ValueError("the index exists")
        raw = write_out(catalog, "p2-catalog")
        classes = raw.where(_OK).groupBy("ms", "hashes").agg(F.min("id").alias("id"), F.count("*").alias("k"))
        rows = _with_class(raw, classes).select(F.lit(0).alias("s"), F.lit(CATALOG).cast("long").alias("rank"), "id", "sha", "ms", "hashes", "pid", "c")
        rows = self._write(rows, version, "records", RECORDS)
        discard(raw)
        known = self._stats_of(rows, F.lit(None).cast("long"))
        stats = Stats(CATALOG, None, known[0]["n"] if known else 0, known[0]["cuts"] if known else [])
        self._write(build_shards(rows, {CATALOG: [CATALOG]}, {CATALOG: spans([stats])}), version, "shards", INDEX)
        self._save_stats(version, [stats])
        self._commit(version)
        return self

    def append(self, cands: DataFrame) -> DataFrame:
        """(candidate_id, accepted_in, accepted_id) of new batches, which join the history.

        ``cands``: (id, sha, ms, hashes, pid, batch_no). Batches are taken by number (a null one first), after those
        of earlier calls, and candidates by id. A candidate without a row here is accepted. Records without provider id,
        digest, duration or hashes just lack those links; empty tables give no rows.
        """
        spark = self.spark
        version, history, stats = self._next(), self.records(), self.stats()
        raw = write_out(cands, "p2-raw")
        first = max(stats) + 1
        sizes = {r["b"]: r for r in self._stats_of(raw, F.col("batch_no"))}
        # batch numbers are metadata: one row a batch
        numbers = sorted((r[0] for r in raw.select("batch_no").distinct().collect()), key=lambda b: (b is not None, b or 0))
        new = [Stats(first + i, b, sizes[b]["n"] if b in sizes else 0, sizes[b]["cuts"] if b in sizes else []) for i, b in enumerate(numbers)]
        stats |= {x.rank: x for x in new}
        at = F.broadcast(spark.createDataFrame([(x.rank, x.batch_no) for x in new], "rank bigint, bn bigint"))
        cand = raw.join(at, F.col("batch_no").eqNullSafe(F.col("bn"))).withColumn("ord", F.struct("rank", "id"))
        classes = write_out(raw.where(_OK).groupBy("ms", "hashes").agg(F.min("id").alias("id"), F.count("*").alias("k")), "p2-classes")
        cand = write_out(_with_class(cand, classes).select("rank", "id", "sha", "ms", "hashes", "pid", "ord", "c"), "p2-candidates")
        discard(raw)
        # the shards that the new batches read; those that aren't there yet are built
        reads = {x.rank: shards_read(x.rank) for x in new}
        plan = {s: spans([stats[CATALOG]] if s == CATALOG else [stats[r] for r in ranks_of(s) if r in stats]) for s in {s for r in reads.values() for s in r}}
        have = {r[0] for r in self.shards().select("shard").distinct().collect()}
        writes: dict[int, list[int]] = {}
        for s in plan.keys() - have - {CATALOG}:
            for r in ranks_of(s):
                writes.setdefault(r, []).append(s)
        old = history.where(F.col("rank").isin([r for r in writes if r < first])) if any(r < first for r in writes) else None
        values = cand.select("rank", "ms", "hashes")
        self._write(build_shards(values if old is None else values.unionByName(old.select("rank", "ms", "hashes")), writes, plan), version, "shards", INDEX)
        index = self._table("shards", INDEX).unionByName(spark.read.schema(INDEX).parquet(f"{version}/shards"))
        met = write_out(search_shards(index, values, reads, plan, query_blocks(reads, stats, plan)), "p2-met")
        # links by content, to history and among the new
        reps = classes.select(F.lit(1).alias("s"), "id", "ms", "hashes")
        right = history.where(f"{_OK} and id = c").select("s", "id", "ms", "hashes").unionByName(reps)
        links = class_links(reps, right, met)
        discard(met)
        fresh = classes.select(F.lit(1).cast("long").alias("s"), F.col("id").alias("b"))
        among = links.join(fresh, ["s", "b"], "left_semi").select("a", "b")
        edges = write_out(among.select(F.col("a").alias("c"), F.col("b").alias("d")).unionByName(among.select(F.col("b").alias("c"), F.col("a").alias("d"))).distinct(), "p2-edges")
        to_old = links.join(fresh, ["s", "b"], "left_anti")
        content = cand.where("c is not null").select(F.col("c").alias("a"), F.col("id").alias("x")).join(to_old, "a").select("x", F.col("s").cast("int").alias("s"), F.col("b").alias("y"))
        content = write_out(content, "p2-content")
        copies = history.where("id <> c").select("s", F.col("c").alias("y"), F.col("id").alias("m"))
        old = content.unionByName(content.join(copies, ["s", "y"]).select("x", "s", F.col("m").alias("y")))
        for k in ("pid", "sha"):
            own, there = cand.where(F.col(k).isNotNull()).select(F.col("id").alias("x"), k), history.where(F.col(k).isNotNull()).select("s", F.col("id").alias("y"), k)
            old = old.unionByName(own.join(there, k).select("x", "s", "y"))
        old = write_out(old.distinct(), "p2-old")
        # acceptance among the rest, and links to what was accepted
        rest = cand.join(old.select(F.col("x").alias("id")).distinct(), "id", "left_anti")
        accepted = settle(rest.select("id", "ord", F.col("pid").alias("p"), F.col("sha").alias("s"), "c"), edges)
        got = cand.join(accepted.select("id"), "id", "left_semi").select(F.lit(1).alias("s"), "rank", "id", "sha", "ms", "hashes", "pid", F.col("c"))
        got = self._write(got, version, "records", RECORDS)
        self._save_stats(version, new)
        self._commit(version)
        x = cand.select(F.col("id").alias("x"), F.col("ord").alias("ox"), "pid", "sha", "c")
        y = got.select(F.col("id").alias("y"), F.struct("rank", "id").alias("oy"), "pid", "sha", "c")
        found = None
        for k in ("pid", "sha", "c"):
            part = x.where(F.col(k).isNotNull()).select(k, "x", "ox").join(y.where(F.col(k).isNotNull()).select(k, "y", "oy"), k).where("oy < ox").select("x", "y")
            found = part if found is None else found.unionByName(part)
        side = y.where("c is not null").select(F.col("c").alias("d"), "y", "oy")
        far = x.where("c is not null").select("c", "x", "ox").join(edges.join(side, "d"), "c").where("oy < ox").select("x", "y")
        found = found.unionByName(far).distinct().withColumn("s", F.lit(1))
        both = old.unionByName(found.select("x", "s", "y"))
        return both.select(F.col("x").alias("candidate_id"), F.when(F.col("s") == 0, "catalog_entry").otherwise("candidate_batch").alias("accepted_in"), F.col("y").alias("accepted_id"))

    def compact(self) -> list[int]:
        """Drop the shards that no later batch reads; gives their numbers. Files of versions that lose none stay as they are."""
        last = max(self.stats())
        # later batches read what the next rank reads, and shards that are yet to be built
        live = set(shards_read(last + 1))
        dead = sorted(r[0] for r in self.shards().select("shard").distinct().collect() if r[0] not in live)
        for v in self.versions():
            fs, p = self._file(v.rsplit("/", 1)[1] + "/shards")
            if not dead or not fs.exists(p):
                continue
            rows = self.spark.read.schema(INDEX).parquet(f"{v}/shards").withColumn("gone", F.shiftright("seg", _SEG).isin(dead))
            if not rows.where("gone").take(1):
                continue
            self._write(rows.where("not gone").drop("gone"), v, "shards-kept", INDEX)
            fs.delete(p, True)
            fs.rename(self._file(v.rsplit("/", 1)[1] + "/shards-kept")[1], p)
        return dead


def _with_class(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """``rows`` with ``c``, the least id of the same content; only contents that repeat are looked up."""
    many = classes.where("k > 1").select("ms", "hashes", F.col("id").alias("c0"))
    return rows.join(many, ["ms", "hashes"], "left").withColumn("c", F.expr(f"case when {_OK} then coalesce(c0, id) end")).drop("c0")


def repeats(catalog: DataFrame, cands: DataFrame) -> DataFrame:
    """Rows of ``Index.append`` for all batches of ``cands``, against ``catalog`` and what earlier batches added."""
    spark = catalog.sparkSession
    return Index(spark, scratch_path(spark, "p2-index")).create(catalog).append(cands)
