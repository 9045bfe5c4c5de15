"""Near-duplicate records by a MinHash LSH forest over perceptual hashes.

Tokens of a 64-bit hash are its (bit position, bit value) pairs, so hashes that differ in d bits
share 64 - d of 64 tokens a side. Each tree draws a permutation of the positions; its i-th MinHash
function ranks the two tokens of the i-th position first (a restricted min-wise family: the
minimum is the token of that position that the hash has, and two hashes agree with probability
1 - d / 64). A signature is then the hash with its bits permuted, a tree's sorted signatures are
a prefix trie, and records that share a prefix are neighbours in it.

Prefixes are shortened from the depth at which a node would hold a single value until nodes hold
``NODE_AIM`` values on average; the depth follows from the row count and not from what was matched.
A tree's first bits are its *root*: values are shuffled once for each root order, to one task for each
root part, and that task grows several trees over the bits that remain. So the copies that are shuffled
grow with the logarithm of the number of tasks and not with the depth. Alike lists share at least ``need`` pairs of
close hashes, one per list of one and three for lists of five, so values of long lists need fewer copies:
``plan_forest`` gives each its number, so that records whose hashes all differ in ``MAX_BITS`` bits are met
with probability ``TARGET_RECALL``. Parts that stay far larger than ``ROOT_AIM`` are cut into blocks that
meet pair by pair; nodes that stay larger than ``NODE_MAX`` get a forest of their own over their remaining
bits. Everything met is verified exactly (bits, then durations, then the one-to-one pairing of whole lists).

Hash values stand once in the forest, however many records carry them. Value pairs with few
records are expanded to record pairs; records that meet only over *heavy* values (carried by very
many records) meet by their profile of heavy values and by neighbouring durations, so that no
group is ever expanded into all its pairs and no link is lost.

Around a value that very many records carry lie its slightly changed copies, all of them close to each other, so that
pairs of distinct values would grow with the square of their number. Values within ``ZONE_BITS`` of such a
*centre* make up the zone, and pairs of two zone values are left out: two alike records share a pair with at most one
end in the zone unless both have three fifths of their hashes in it. Records that have are also linked among
themselves, with all their pairs. Pairs leave a task in blocks, so its memory doesn't grow with their number.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.components import components
from ..session import write_out
from . import fingerprints as fp

TARGET_RECALL = 0.999  # of two records whose hashes are all at the full distance
WITHIN_RECALL = 0.9  # of two hashes at the full distance, by the trees of one root part
NODE_AIM = 512  # values a node may hold on average: the shortest prefix that is affordable
NODE_MAX = 8192
ROOT_AIM = 500_000  # values in one task
ROOT_LEAST = 3  # root bits at least, so that small inputs keep several tasks busy
PAIRS_OUT = 200_000  # pairs that a task holds before it gives them out
ZONE_BITS = 10  # of a zone value from its centre
MOST_CENTRES = 32  # the most frequent; the surroundings of others are searched pair by pair
SEED = 20_240_607
#: Logarithm of the ratio of the longest to the shortest duration of a cell: under half of what may differ.
CELL = -0.495 * math.log(1 - fp.MAX_PERCENT / 100)


def meet_probability(depth: int, bits: int = fp.MAX_BITS) -> float:
    """Probability that two hashes at distance ``bits`` share a prefix of ``depth`` sampled positions."""
    return math.comb(64 - bits, depth) / math.comb(64, depth) if depth <= 64 - bits else 0.0


class Forest(NamedTuple):
    """Shape of a forest: bits of a prefix and of its root, trees of a root part, and copies by ``need``."""

    depth: int
    root: int
    trees: int
    copies: tuple[int, ...]  # of values whose lists need 1, 2, ... pairs


def plan_forest(n_values: int, target: float = TARGET_RECALL, most_need: int = 16) -> Forest:
    """Prefixes are shortened from log2(n) to nodes of ``NODE_AIM``; copies follow from the recall wanted."""
    depth = math.ceil(math.log2(n_values / NODE_AIM)) if n_values > NODE_AIM else 0
    root = min(depth, max(ROOT_LEAST, math.ceil(math.log2(max(1, n_values) / ROOT_AIM))))
    at_root = meet_probability(root)
    below = meet_probability(depth) / at_root
    trees = 1 if below >= WITHIN_RECALL else math.ceil(math.log(1 - WITHIN_RECALL) / math.log(1 - below))
    p = at_root * (1 - (1 - below) ** trees)
    copies = tuple(1 if p >= 1 else max(1, math.ceil(math.log(1 - target) / (need * math.log(1 - p)))) for need in range(1, most_need + 1))
    return Forest(depth, root, trees, copies)


def needed(n: np.ndarray) -> np.ndarray:
    """Pairs that two alike lists share at least, where the longer has ``n`` hashes."""
    return -(-3 * n // 5)


def tree_orders(plan: Forest, seed: int = SEED) -> np.ndarray:
    """(copies, trees, 64) bit positions. Roots that fit into one permutation take disjoint prefixes of it."""
    rng = np.random.default_rng(seed)
    out, per = [], max(1, 64 // plan.root) if plan.root else 1
    for t in range(plan.copies[0]):
        if t % per == 0:
            order = rng.permutation(64)
        whole = np.roll(order, -(t % per) * plan.root)
        out.append([np.concatenate([whole[: plan.root], rng.permutation(whole[plan.root :])]) for _ in range(plan.trees)])
    return np.array(out, dtype=np.uint64)


def permuted(values: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Signatures: the first position of ``order`` becomes the highest bit. Byte tables, vectorised."""
    tables = np.zeros((8, 256), dtype=np.uint64)
    byte = np.arange(256, dtype=np.uint64)
    for to, pos in enumerate(order):
        k, bit = divmod(int(pos), 8)
        tables[k] |= ((byte >> np.uint64(bit)) & np.uint64(1)) << np.uint64(63 - to)
    octets = values.astype("<u8").view(np.uint8).reshape(-1, 8)
    out = tables[0][octets[:, 0]]
    for k in range(1, 8):
        out |= tables[k][octets[:, k]]
    return out


def restored(values: np.ndarray, order: np.ndarray) -> np.ndarray:
    """The inverse of ``permuted``."""
    inverse = np.empty(64, dtype=np.uint64)
    for to, pos in enumerate(order):
        inverse[63 - int(pos)] = 63 - to
    return permuted(values, inverse)


def close_pairs(keys: np.ndarray, depth: int, rng_seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (x, y) of sorted distinct signatures within ``MAX_BITS`` that share a prefix of ``depth`` bits."""
    found = list(_close_blocks(keys, depth, rng_seed))
    return tuple(np.concatenate([keys[:0], *(f[i] for f in found)]) for i in (0, 1))


def _close_blocks(keys: np.ndarray, depth: int, rng_seed: int = SEED) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs of ``close_pairs``, some at a time."""
    if len(keys) < 2:
        return
    node = _node(keys, depth)
    starts = np.concatenate([[0], np.flatnonzero(np.diff(node)) + 1, [len(keys)]])
    sizes = np.diff(starts)
    large = sizes > NODE_MAX
    for i in np.flatnonzero(large):
        yield from _forest_within(keys[starts[i] : starts[i + 1]], depth, rng_seed + 1)
    if large.any():
        keep = ~np.repeat(large, sizes)
        keys, node = keys[keep], node[keep]
        sizes = sizes[~large]
    for off in range(1, int(sizes.max()) if len(sizes) else 0):
        # neighbours at this offset in the sorted trie; nodes smaller than it drop out
        if off & (off - 1) == 0 and off > 1:
            keep = np.repeat(sizes > off, sizes)
            keys, node, sizes = keys[keep], node[keep], sizes[sizes > off]
        hit = np.flatnonzero(np.bitwise_count(keys[off:] ^ keys[:-off]) <= fp.MAX_BITS)
        hit = hit[node[hit] == node[hit + off]]
        if len(hit):
            yield keys[hit], keys[hit + off]


def _node(keys: np.ndarray, depth: int) -> np.ndarray:
    return keys >> np.uint64(64 - depth) if depth else np.zeros(len(keys), np.uint64)


def _forest_within(keys: np.ndarray, depth: int, seed: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of a large node by a forest over its remaining bits, to a recall of one in two thousand missed, each pair once.

    Where values lie so close that the trees would compare as many pairs as there are, all are compared once instead.
    """
    rest = 64 - depth
    more = max(1, math.ceil(math.log2(len(keys) / NODE_AIM)))
    if more > rest - fp.MAX_BITS:  # too few bits left to tell values apart: compare all
        yield from _all_blocks(keys)
        return
    p = math.comb(rest - fp.MAX_BITS, more) / math.comb(rest, more)
    trees = math.ceil(math.log(0.0005) / math.log(1 - p)) if p < 1 else 1
    rng = np.random.default_rng(seed)
    masks: list[int] = []  # pairs that share the prefix in an earlier tree were given out there
    for u in range(trees):
        order = np.concatenate([63 - np.arange(depth), rng.permutation(rest)]).astype(np.uint64)
        turned = np.sort(permuted(keys, order))
        if not u and trees * (np.unique(_node(turned, depth + more), return_counts=True)[1] ** 2).sum() >= len(keys) ** 2:
            yield from _all_blocks(keys)
            return
        for x, y in _close_blocks(turned, depth + more, seed + 1):
            a, b = restored(x, order), restored(y, order)
            new = _none_shared(a ^ b, masks)
            yield np.minimum(a, b)[new], np.maximum(a, b)[new]
        masks.append(sum(1 << int(p) for p in order[: depth + more]))


def _none_shared(diff: np.ndarray, masks: list[int]) -> np.ndarray:
    """Whether pairs that differ in the bits ``diff`` differ in some bit of each mask."""
    new = np.ones(len(diff), bool)
    for m in masks:
        new &= (diff & np.uint64(m)) != 0
    return new


def _all_blocks(keys: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for off in range(1, len(keys)):
        hit = np.flatnonzero(np.bitwise_count(keys[off:] ^ keys[:-off]) <= fp.MAX_BITS)
        yield keys[hit], keys[hit + off]


def _all_close(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    found = list(_all_blocks(keys))
    return tuple(np.concatenate([keys[:0], *(f[i] for f in found)]) for i in (0, 1))


def _bridges(left: np.ndarray, right: np.ndarray, depth: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of a signature of ``left`` and one of ``right``, sorted, within ``MAX_BITS`` that share a prefix of ``depth`` bits."""
    to, at = _node(right, depth), _node(left, depth)
    lo, hi = np.searchsorted(to, at, "left"), np.searchsorted(to, at, "right")
    for i in np.flatnonzero(lo < hi):
        near = right[lo[i] : hi[i]]
        y = near[np.bitwise_count(near ^ left[i]) <= fp.MAX_BITS]
        if len(y):
            yield np.full(len(y), left[i]), y


def _gathered(blocks: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs in blocks of ``PAIRS_OUT`` or somewhat more."""
    held, size = [], 0
    for block in blocks:
        held.append(block)
        size += len(block[0])
        if size >= PAIRS_OUT:
            yield tuple(np.concatenate(x) for x in zip(*held))
            held, size = [], 0
    if size:
        yield tuple(np.concatenate(x) for x in zip(*held))


def _around(v: np.ndarray, centres: list[int], bits: int) -> np.ndarray:
    """Which of ``v`` lie within ``bits`` of a centre."""
    out = np.zeros(len(v), bool)
    for c in centres:
        out |= np.bitwise_count(v ^ np.uint64(c % (1 << 64))) <= bits
    return out


def _in_zone(v: Column, centres: list[int]) -> Column:
    """Whether a hash lies within ``ZONE_BITS`` of a centre."""
    out = F.lit(False)
    for c in centres:
        out = out | (F.bit_count(v.bitwiseXOR(F.lit(c).cast("long"))) <= ZONE_BITS)
    return out


def zone_centres(counts: DataFrame) -> list[int]:
    """Values, as signed numbers, with more than ``HEAVY`` records, the most frequent first, none in the zone of another.

    ``counts``: (v, k). Which values are chosen changes what is compared, never what is found.
    """
    out: list[int] = []
    for r in counts.where(F.col("k") > fp.HEAVY).orderBy(F.desc("k"), "v").limit(4096).collect():
        if len(out) < MOST_CENTRES and not _around(np.array([r["v"]]).view(np.uint64), out, ZONE_BITS)[0]:
            out.append(r["v"])
    return out


def _block_of(v: np.ndarray, blocks: int) -> np.ndarray:
    return ((v * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)) % np.uint64(blocks)


def close_values(values: DataFrame, n_values: int, target: float = TARGET_RECALL, centres: list[int] = ()) -> DataFrame:
    """(va, vb), va < vb as signed numbers: distinct hash values within ``MAX_BITS``, each pair once.

    ``values``: (v, n), distinct values with the length of the shortest list that has them. Each value is shuffled once
    for each of its copies, packed with its batch into byte strings by copy and root part. Pairs of two values in
    the zone of ``centres`` are left out.
    """
    plan = plan_forest(n_values, target)
    orders = tree_orders(plan)
    copies = np.array(plan.copies)
    roots = plan.root
    # pairs that share the prefix in an earlier tree were given out there
    masks = [[int(sum(1 << int(p) for p in o[: plan.depth])) for o in trees] for trees in orders]

    def held_batches(batches: Iterator[pa.RecordBatch], size: int = 200_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            if sum(len(h[0]) for h in held) >= size:
                yield tuple(np.concatenate(x) for x in zip(*held))
                held.clear()
        if held and sum(len(h[0]) for h in held):
            yield tuple(np.concatenate(x) for x in zip(*held))

    def cut(v: np.ndarray, n: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(part, values) of a batch: all root parts of all copies that its values take."""
        v, own = v.view(np.uint64), copies[np.minimum(needed(n), len(copies)) - 1]
        for t in range(int(own.max())):
            mine = v[own > t]
            part = (permuted(mine, orders[t][0]) >> np.uint64(64 - roots)).astype(np.int64) if roots else np.zeros(len(mine), np.int64)
            o = np.argsort(part, kind="stable")
            ids, at = np.unique(part[o], return_index=True)
            for r, vals in zip(ids.tolist(), np.split(mine[o], at[1:])):
                yield t << roots | r, vals

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes: dict[int, int] = {}
        for v, n in held_batches(batches):
            for part, vals in cut(v, n):
                sizes[part] = sizes.get(part, 0) + len(vals)
        yield pa.RecordBatch.from_arrays([pa.array(list(sizes), pa.int64()), pa.array(list(sizes.values()), pa.int64())], ["part", "n"])

    split: dict[int, int] = {}
    if n_values > 4 * ROOT_AIM:
        # few parts are so large: at most one of each 4 * ROOT_AIM values and copy
        large = values.mapInArrow(count, "part bigint, n bigint").groupBy("part").agg(F.sum("n").alias("n")).where(F.col("n") > 4 * ROOT_AIM)
        split = {r["part"]: math.ceil(r["n"] / ROOT_AIM) for r in large.collect()}

    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for v, n in held_batches(batches):
            rows = []
            for part, vals in cut(v, n):
                many = split.get(part, 1)
                if many == 1:
                    rows.append((part, 0, 0, vals.tobytes()))
                    continue
                block = _block_of(vals, many)
                for i in np.unique(block).tolist():
                    blob = vals[block == i].tobytes()
                    rows.extend((part, min(i, j), max(i, j), blob) for j in range(many))
            yield pa.RecordBatch.from_arrays([pa.array(c, ty) for c, ty in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int32(), pa.binary()))], ["part", "i", "j", "vals"])

    def search(key: tuple, it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, i, j = (k.as_py() for k in key)
        t, many = part >> roots, split.get(part, 1)
        v = np.concatenate([np.frombuffer(x.as_buffer(), np.uint64) for b in it for x in b.column("vals")])
        zone = _around(v, centres, ZONE_BITS)
        dense, v = v[zone], v[~zone]
        edge = v[_around(v, centres, ZONE_BITS + fp.MAX_BITS)]
        for u, order in enumerate(orders[t]):
            before = [m for row in masks[:t] for m in row] + masks[t][:u]
            bridges = _bridges(permuted(edge, order), np.sort(permuted(dense, order)), plan.depth)
            for x, y in _gathered(chain(_close_blocks(np.sort(permuted(v, order)), plan.depth), bridges)):
                a, b = restored(x, order), restored(y, order)
                new = _none_shared(a ^ b, before)
                if many > 1 and i != j:  # pairs of one block come out where it meets itself
                    new &= _block_of(a, many) != _block_of(b, many)
                a, b = a[new].view(np.int64), b[new].view(np.int64)
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["va", "vb"])

    packed = values.select("v", F.col("n").cast("long").alias("n")).mapInArrow(scatter, "part bigint, i int, j int, vals binary")
    return packed.groupBy("part", "i", "j").applyInArrow(search, "va bigint, vb bigint")


def content_links(reps: DataFrame) -> DataFrame:
    """(a, b) ids of alike records; enough links to connect all records that are alike.

    ``reps``: written-out (id, ms, hashes), one row per distinct (ms, hashes).
    """
    flat = reps.where("ms is not null and size(hashes) > 0")
    post, counts = _postings(flat)
    centres = zone_centres(counts)
    links = _links(flat, post, counts, centres)
    if not centres:
        return links
    members = flat.select("id", F.size("hashes").alias("n"), F.explode("hashes").alias("v")).where(_in_zone(F.col("v"), centres))
    crowded = members.groupBy("id", "n").agg(F.count("*").alias("c")).where(F.col("c") * 5 >= F.col("n") * 3)
    own = write_out(flat.join(crowded, "id", "left_semi"), "forest-crowded")
    return links.unionByName(_links(own, *_postings(own))) if own.take(1) else links


def _postings(flat: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, ms, n, v) of each record and hash, and (v, k, n) of each hash: its records and the length of the shortest list with it."""
    post = write_out(flat.select("id", "ms", F.size("hashes").alias("n"), F.explode(F.array_distinct("hashes")).alias("v")), "forest-postings")
    return post, write_out(post.groupBy("v").agg(F.count("*").alias("k"), F.min("n").alias("n")), "forest-counts")


def _links(flat: DataFrame, post: DataFrame, counts: DataFrame, centres: list[int] = ()) -> DataFrame:
    """Links of all alike records but those alike by pairs of zone values alone."""
    pairs = close_values(counts.select("v", "n"), counts.count(), centres=centres)
    same = counts.where((F.col("k") > 1) & ~_in_zone(F.col("v"), centres)).select(F.col("v").alias("va"), F.col("v").alias("vb"))
    pairs = pairs.select("va", "vb").unionByName(same)
    weighed = pairs.join(counts.select(F.col("v").alias("va"), F.col("k").alias("ka")), "va").join(counts.select(F.col("v").alias("vb"), F.col("k").alias("kb")), "vb")
    weighed = write_out(weighed, "forest-values")
    light = weighed.where(F.col("ka") * F.col("kb") <= fp.HEAVY).select("va", "vb")
    left = light.join(post.select(F.col("v").alias("va"), F.col("id").alias("ida"), F.col("ms").alias("ma"), F.col("n").alias("na")), "va")
    both = left.join(post.select(F.col("v").alias("vb"), F.col("id").alias("idb"), F.col("ms").alias("mb"), F.col("n").alias("nb")), "vb")
    fit = both.where((F.col("ida") != F.col("idb")) & fp.durations_fit(F.col("ma"), F.col("mb")))
    fit = fit.where(F.least("na", "nb") * 5 >= F.greatest("na", "nb") * 3)
    met = fit.select(F.least("ida", "idb").alias("a"), F.greatest("ida", "idb").alias("b")).distinct()
    lists = flat.select("id", "hashes")
    met = met.join(lists.select(F.col("id").alias("a"), F.col("hashes").alias("ha")), "a").join(lists.select(F.col("id").alias("b"), F.col("hashes").alias("hb")), "b")
    links = fp.verified(met, ("a", "b"))
    heavy = weighed.where(F.col("ka") * F.col("kb") > fp.HEAVY).select("va", "vb")
    dense = counts.where(_in_zone(F.col("v"), centres)).select("v")
    return links.unionByName(_profile_links(flat, write_out(heavy, "forest-heavy"), dense, centres))


def _profile_links(flat: DataFrame, heavy: DataFrame, dense: DataFrame, centres: list[int]) -> DataFrame:
    """Links of records that are alike by heavy values alone, or by heavy pairs and pairs of zone values.

    A record's profile is its length and the multiset of its hashes that take part in a heavy
    pair or lie in the zone (``dense``); only records with at least three fifths heavy members can need this path. Two profiles that pair
    up in enough members make all their records alike whose durations fit. Durations are cut into
    cells so narrow that all within one fit; a cell's records link to its first one, and cells
    are linked by their nearest ends. That connects the same groups as all pairs would, and
    the tables that are joined have one row a profile and cell.
    """
    loaded = heavy.select(F.explode(F.array("va", "vb")).alias("v"))
    zone = loaded.unionByName(dense).distinct()
    member = flat.select("id", "ms", F.size("hashes").alias("n"), F.explode("hashes").alias("v")).join(zone, "v")
    prof = member.groupBy("id", "ms", "n").agg(F.array_sort(F.collect_list("v")).alias("z")).where(F.size("z") * 5 >= F.col("n") * 3)
    cell = F.floor(F.log(F.col("ms").cast("double")) / F.lit(CELL)).cast("long")
    prof = write_out(prof.withColumn("key", F.sha2(F.to_json(F.struct("n", "z")), 256)).withColumn("cell", cell), "forest-profiles")
    kinds = prof.groupBy("key").agg(F.first("n").alias("n"), F.first("z").alias("z"))
    two = heavy.where("va <> vb")
    pairs = two.unionByName(two.select(F.col("vb").alias("va"), F.col("va").alias("vb"))).unionByName(loaded.distinct().where(~_in_zone(F.col("v"), centres)).select(F.col("v").alias("va"), F.col("v").alias("vb")))
    vals = kinds.select("key", "n", F.explode(F.array_distinct("z")).alias("v"))
    met = vals.select(F.col("key").alias("x"), F.col("n").alias("na"), F.col("v").alias("va")).join(pairs, "va").join(vals.select(F.col("key").alias("y"), F.col("n").alias("nb"), F.col("v").alias("vb")), "vb")
    met = met.where(F.least("na", "nb") * 5 >= F.greatest("na", "nb") * 3).select("x", "y", "na", "nb").distinct()
    met = met.join(kinds.select(F.col("key").alias("x"), F.col("z").alias("za")), "x").join(kinds.select(F.col("key").alias("y"), F.col("z").alias("zb")), "y")
    good = met.where(_enough(F.col("za"), F.col("zb"), F.greatest("na", "nb"))).select("x", "y")
    ends = write_out(prof.groupBy("key", "cell").agg(F.min(F.struct("ms", "id")).alias("lo"), F.max(F.struct("ms", "id")).alias("hi")), "forest-cells")
    inside = prof.join(ends, ["key", "cell"]).select(F.col("id").alias("a"), F.col("lo.id").alias("b"))
    left = ends.select(F.col("key").alias("x"), "cell", F.col("lo").alias("alo"), F.col("hi").alias("ahi"))
    # an upper cell that still fits lies at most three cells on
    right = ends.select(F.col("key").alias("y"), F.col("lo").alias("blo"), F.col("cell").alias("bcell"), F.explode(F.sequence(F.col("cell") - 3, F.col("cell"))).alias("cell"))
    across = left.join(good, "x").join(right, ["y", "cell"])
    same = F.col("cell") == F.col("bcell")
    across = across.where(same | fp.durations_fit(F.col("ahi.ms"), F.col("blo.ms")))
    return inside.unionByName(across.select(F.when(same, F.col("alo.id")).otherwise(F.col("ahi.id")).alias("a"), F.col("blo.id").alias("b")))


@F.pandas_udf(T.BooleanType())
def _enough(za: pd.Series, zb: pd.Series, longest: pd.Series) -> pd.Series:
    """Whether enough heavy members of two profiles pair up."""
    out = []
    for a, b, n in zip(za, zb, longest):
        x, y = np.asarray(a, np.int64).view(np.uint64), np.asarray(b, np.int64).view(np.uint64)
        out.append(fp._matching(np.bitwise_count(x[:, None] ^ y[None, :]) <= fp.MAX_BITS) * 5 >= 3 * n)
    return pd.Series(out, dtype=bool)


def groups(records: DataFrame) -> DataFrame:
    """(id, comp): the group of each record that is alike to another, directly or through others.

    ``records``: output of ``fingerprints.prepared``. Equal digests link records; so does alike
    content. Records that are alike to none don't appear. Records without digest, duration or
    hashes just lack those links; repeated ids link to themselves at most; empty tables give no rows.
    """
    rec = write_out(records.select("id", "sha", "ms", "hashes"), "forest-records")
    shas = rec.where("sha is not null").select("id", "sha")
    first = shas.groupBy("sha").agg(F.min("id").alias("b"), F.count("*").alias("k")).where("k > 1").select("sha", "b")
    by_sha = shas.join(first, "sha").select(F.col("id").alias("a"), "b")
    with_list = rec.where("ms is not null and size(hashes) > 0")
    reps = with_list.groupBy("ms", "hashes").agg(F.min("id").alias("id"), F.count("*").alias("k"))
    reps = write_out(reps, "forest-reps")
    many = reps.where("k > 1").select("ms", "hashes", F.col("id").alias("b"))
    by_copy = with_list.join(many, ["ms", "hashes"]).select(F.col("id").alias("a"), "b")
    links = by_sha.unionByName(by_copy).unionByName(content_links(reps.select("id", "ms", "hashes")))
    return components(links)


def group_pairs(found: DataFrame) -> DataFrame:
    """(a, b), a < b: all pairs of records in one group, as p1 defines its result."""
    f = found.select("comp", F.col("id").alias("a"))
    return f.join(found.select("comp", F.col("id").alias("b")), "comp").where("a < b").select("a", "b")
