"""Near-duplicates and batches against exhaustive comparison."""

import itertools
import random

import numpy as np
import pytest

from cuelattice.operators import components as cc
from cuelattice.llm import fingerprints as fp
from cuelattice.llm import graphindex as gi
from cuelattice.llm import lshforest as lf

SCHEMA = "id long, fingerprint struct<sha256:string,perceptual_hashes:array<string>,duration_seconds:double>, pid long, batch_no long, comp string"


def flip(rng, v, n):
    for b in rng.sample(range(64), n):
        v ^= 1 << b
    return v


def collection(seed, n, first=0, base=None):
    """Clips with edited copies at the limits, shared popular hashes, dirty members and nulls."""
    rng = random.Random(seed)
    out, clips = [], list(base or [])
    popular = [0, 1 << 63]
    for i in range(first, first + n):
        if clips and rng.random() < 0.5:
            hs, d = rng.choice(clips)
            hs = [flip(rng, h, rng.choice([0, 1, 5, 7, 8])) for h in hs]
            if rng.random() < 0.4:
                hs[0] = rng.getrandbits(64)
            rng.shuffle(hs)
            d = d * rng.choice([1, 0.88, 0.89, 1.12, 1.14, 0.7])
        else:
            hs, d = [rng.getrandbits(64) for _ in range(rng.choice([1, 2, 3, 4, 5, 5, 6]))], rng.uniform(3, 40)
            clips.append((hs, d))
        if rng.random() < 0.2:
            hs = hs + [rng.choice(popular)]
        text = [f"{h:016X}" if rng.random() < 0.3 else f"{h:016x}" for h in hs] + rng.choice([[], [None], ["zz"], [""], ["n/a"]])
        sha = rng.choice([None, "", f"{rng.randrange(n):064x}", f"{rng.randrange(n):064X}"])
        out.append((i, (sha, rng.choice([text] * 12 + [None, []]), rng.choice([d] * 15 + [None, 0.0, float("nan")])), rng.choice([None, 0, rng.randrange(n)]), rng.choice([1, 2, 3, None]), "x"))
    return out, clips


def parsed(row):
    (sha, hs, d) = row[1]
    h = []
    for x in hs or []:
        if x is not None and len(x) == 16:
            try:
                h.append(int(x, 16))
            except ValueError:
                pass
    ms = round(d * 1000) if d is not None and d == d and d > 0 else 0
    return row[0], np.array(h, np.uint64), ms, (sha or "").lower() or None, row[2] or None


def alike(a, b):
    if a[3] and a[3] == b[3]:
        return True
    return a[2] > 0 and b[2] > 0 and abs(a[2] - b[2]) * 100 <= 12 * max(a[2], b[2]) and fp.alike_lists(a[1], b[1])


def closure(ids, links):
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        up[max(find(a), find(b))] = min(find(a), find(b))
    by = {}
    for i in ids:
        by.setdefault(find(i), []).append(i)
    return {p for g in by.values() for p in itertools.combinations(sorted(g), 2)}


def pairs_of(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    got = [tuple(r) for r in lf.group_pairs(lf.groups(fp.prepared(df, "id"))).collect()]
    assert len(got) == len(set(got))
    return set(got)


@pytest.mark.parametrize("heavy", [4096, 2])
def test_groups(spark, monkeypatch, heavy):
    monkeypatch.setattr(fp, "HEAVY", heavy)
    rows, _ = collection(11, 220)
    recs = [parsed(r) for r in rows]
    want = closure([r[0] for r in recs], [(a[0], b[0]) for a, b in itertools.combinations(recs, 2) if alike(a, b)])
    assert len(want) > 30 and pairs_of(spark, rows) == want


def test_third_of_rows_alike_by_popular_hashes(spark, monkeypatch):
    monkeypatch.setattr(fp, "HEAVY", 50)
    rng = random.Random(2)
    rows = [(i, (None, [f"{0:016x}", f"{1 << 63:016x}", f"{rng.getrandbits(64):016x}"], 10.0 * 1.05 ** (i % 30) if i % 30 < 12 else 200.0), None, 1, "x") for i in range(120)]
    rows += [(1000 + i, (None, [f"{rng.getrandbits(64):016x}"], 10.0), None, 1, "x") for i in range(100)]
    recs = [parsed(r) for r in rows]
    assert pairs_of(spark, rows) == closure([r[0] for r in recs], [(a[0], b[0]) for a, b in itertools.combinations(recs, 2) if alike(a, b)])


def test_crowd_around_a_popular_hash(spark, monkeypatch):
    """Close values around a popular one aren't paired with each other, yet no group is lost."""
    monkeypatch.setattr(fp, "HEAVY", 50)
    paired, write_out = [], lf.write_out

    def counted(df, name, *more):
        out = write_out(df, name, *more)
        if name == "forest-values":
            paired.append(out.count())
        return out

    monkeypatch.setattr(lf, "write_out", counted)
    rng = random.Random(6)
    centre = 1 << 63
    some = lambda: rng.getrandbits(64)
    near = lambda v, most: v ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(1, most + 1)))
    row = lambda i, lists, s: (i, (None, [f"{v:016x}" for v in lists], s), None, 1, "x")
    rows = [row(i, [centre, some(), some()], 10.0) for i in range(60)]
    rows += [row(100 + i, [near(centre, 4), some(), some()], 10.0) for i in range(500)]
    for i in range(40):  # copies that share a zone value and one other, or values at the zone's edge
        a, b = some(), near(centre, 12)
        rows += [row(1000 + 10 * i, [centre if i % 2 else b, a, some()], 10.0), row(1001 + 10 * i, [near(centre, 3) if i % 2 else near(b, 7), near(a, 7), some()], 10.5)]
    for i in range(12):  # alike by zone values alone
        rows.append(row(2000 + i, [near(centre, 3), near(centre, 5), some()], 4.0 * 1.2 ** (i // 3)))
    recs = [parsed(r) for r in rows]
    want = closure([r[0] for r in recs], [(a[0], b[0]) for a, b in itertools.combinations(recs, 2) if alike(a, b)])
    assert len(want) > 40 and pairs_of(spark, rows) == want
    assert sum(paired) < 2000  # 98,244 with the crowd's own pairs


def test_pairs_leave_in_blocks(monkeypatch):
    """However close the values, a task holds few pairs at once, each of them once."""
    monkeypatch.setattr(lf, "NODE_MAX", 100)
    monkeypatch.setattr(lf, "PAIRS_OUT", 1000)
    keys = np.unique(flips(np.full(400, 1 << 40, dtype=np.uint64), 3, 5))
    blocks = list(lf._gathered(lf._close_blocks(keys, 0)))
    got = [p for x, y in blocks for p in zip(x.tolist(), y.tolist())]
    want = set(zip(*(x.tolist() for x in lf._all_close(keys))))
    assert len(got) == len(set(got)) and set(got) <= want and len(got) >= 0.99 * len(want)
    assert max(len(x) for x, _ in blocks) < 1000 + len(keys)


def test_empty_and_alone(spark):
    assert pairs_of(spark, []) == set()
    rows, _ = collection(5, 1)
    assert pairs_of(spark, rows) == set()


def test_matching_is_largest():
    rng = np.random.default_rng(0)
    for _ in range(300):
        m = rng.random((rng.integers(1, 6), rng.integers(1, 6))) < 0.4
        n, k = m.shape
        best = max(sum(m[i, j] for i, j in enumerate(p) if j < k) for p in itertools.permutations(range(max(n, k)), n))
        assert fp._matching(m) == best


def test_permutation_round_trip_and_recall():
    rng = np.random.default_rng(1)
    v = np.unique(rng.integers(0, 1 << 63, 30_000, dtype=np.uint64))
    near = v[:500].copy()
    for i in range(len(near)):
        for b in rng.choice(64, 7, replace=False):
            near[i] ^= np.uint64(1) << np.uint64(b)
    both = np.unique(np.concatenate([v, near]))
    plan = lf.plan_forest(len(both))
    orders = lf.tree_orders(plan)
    assert orders.shape == (plan.copies[0], plan.trees, 64) and (np.sort(orders, axis=2) == np.arange(64)).all()
    assert (orders[:, :, : plan.root] == orders[:, :1, : plan.root]).all()
    found = set()
    for o in orders.reshape(-1, 64):
        keys = lf.permuted(both, o)
        assert (lf.restored(keys, o) == both).all()
        x, y = lf.close_pairs(np.sort(keys), plan.depth)
        found |= {frozenset(p) for p in zip(lf.restored(x, o).tolist(), lf.restored(y, o).tolist())}
    want = {frozenset(p) for p in zip(v[:500].tolist(), near.tolist())}
    assert len(want & found) / len(want) >= 0.99


def test_copies_stay_few():
    """Bytes that a value is shuffled with: hash lists of five need a quarter of those of one."""
    for n, most in ((1_000_000, 4), (10_000_000, 5), (432_000_000, 9)):
        plan = lf.plan_forest(n)
        assert plan.copies[2] <= most and plan.copies[0] <= 3 * most
    assert lf.plan_forest(1) == (0, 0, 1, (1,) * 16)


def test_single_hash_lists_and_split_parts(spark, monkeypatch):
    rng = np.random.default_rng(2)
    v = np.unique(rng.integers(0, 1 << 63, 20_000, dtype=np.uint64))
    crowd = flips(np.full(1500, v[7]), 2, 3)
    far = flips(v[:600], 7, 4)
    both = np.unique(np.concatenate([v, far, crowd]))
    monkeypatch.setattr(lf, "ROOT_AIM", 500)  # crowded parts are cut into blocks
    df = spark.createDataFrame([(int(x), 1) for x in both.view(np.int64)], "v bigint, n int")
    got = [tuple(r) for r in lf.close_values(df, len(both)).collect()]
    assert len(got) == len(set(got))
    q, w = np.nonzero(np.triu(np.bitwise_count(both[:, None] ^ both) <= fp.MAX_BITS, 1))
    want = {tuple(sorted(p)) for p in zip(both[q].view(np.int64).tolist(), both[w].view(np.int64).tolist())}
    assert set(got) <= want and len(got) >= 0.99 * len(want)
    full = {tuple(sorted(p)) for p in zip(v[:600].view(np.int64).tolist(), far.view(np.int64).tolist())}
    assert len(full & set(got)) >= 0.99 * 600


def test_large_node_gets_its_own_forest(monkeypatch):
    monkeypatch.setattr(lf, "NODE_MAX", 400)
    monkeypatch.setattr(lf, "NODE_AIM", 64)
    rng = np.random.default_rng(3)
    keys = np.unique(rng.integers(0, 1 << 40, 3000, dtype=np.uint64))
    near = keys[:200] ^ (np.uint64(0b1010101) << rng.integers(0, 30, 200).astype(np.uint64))
    both = np.unique(np.concatenate([keys, near]))
    want = {frozenset(p) for p in zip(*(x.tolist() for x in lf._all_close(both)))}
    got = {frozenset(p) for p in zip(*(x.tolist() for x in lf.close_pairs(both, 8)))}
    assert got <= want and len(got) >= 0.98 * len(want)


def test_components(spark):
    rng = random.Random(4)
    links = [(i, i + 1) for i in range(0, 60)] + [(rng.randrange(100, 300), rng.randrange(100, 300)) for _ in range(120)] + [(7, 7), (None, 3)]
    df = spark.createDataFrame(links, "a long, b long")
    got = {r["id"]: r["comp"] for r in cc.components(df).collect()}
    clean = [p for p in links if None not in p and p[0] != p[1]]
    ids = {i for p in clean for i in p}
    want = closure(ids, clean)
    assert set(got) == ids and {p for p in itertools.combinations(sorted(ids), 2) if got[p[0]] == got[p[1]]} == want
    assert all(c <= i for i, c in got.items())


def repeats_of(spark, cat, cand):
    c = fp.prepared(spark.createDataFrame(cat, SCHEMA).selectExpr("id", "fingerprint", "case when pid <> 0 then pid end as pid"), "id", extra=("pid",))
    d = fp.prepared(spark.createDataFrame(cand, SCHEMA).selectExpr("id", "fingerprint", "case when pid <> 0 then pid end as pid", "batch_no"), "id", extra=("pid", "batch_no"))
    got = [tuple(r) for r in gi.repeats(c, d).collect()]
    assert len(got) == len(set(got))
    return set(got)


def brute_repeats(cat, cand):
    kept = [("catalog_entry", parsed(r)) for r in cat]
    out = set()
    for row in sorted(cand, key=lambda r: (r[3] is not None, r[3], r[0]) if r[3] is not None else (False, 0, r[0])):
        p = parsed(row)
        hits = {(p[0], kind, k[0]) for kind, k in kept if (p[4] and p[4] == k[4]) or alike(p, k)}
        out |= hits
        if not hits:
            kept.append(("candidate_batch", p))
    return out


@pytest.mark.parametrize("heavy, wide", [(4096, 512), (4096, 2), (2, 0)])
def test_batches(spark, monkeypatch, heavy, wide):
    monkeypatch.setattr(fp, "HEAVY", heavy)
    monkeypatch.setattr(gi, "WIDE", wide)
    cat, clips = collection(21, 120)
    cand, _ = collection(22, 160, first=5000, base=clips)
    cand += [(6000 + i, cand[3][1], None, 2, "x") for i in range(8)]
    want = brute_repeats(cat, cand)
    assert any(k == "candidate_batch" for _, k, _ in want) and repeats_of(spark, cat, cand) == want


def test_batches_empty(spark):
    cat, clips = collection(21, 20)
    cand, _ = collection(22, 10, first=500, base=clips)
    assert repeats_of(spark, [], []) == set() and repeats_of(spark, cat, []) == set()
    assert repeats_of(spark, [], cand) == brute_repeats([], cand)


def prepared_of(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("id", "fingerprint", "case when pid <> 0 then pid end as pid", "batch_no")
    return fp.prepared(df, "id", extra=("pid", "batch_no"))


def test_appending_batch_by_batch_equals_one_run(spark, tmp_path):
    """An index on disk takes batches one call at a time; a new Index object on the folder goes on where the last ended."""
    cat, clips = collection(21, 60)
    cand, _ = collection(22, 120, first=5000, base=clips)
    cand = [(i, f, p, n % 6, t) for n, (i, f, p, _, t) in enumerate(cand)]
    want = brute_repeats(cat, cand)
    path = f"file://{tmp_path}/index"
    gi.Index(spark, path).create(prepared_of(spark, cat).drop("batch_no"))
    got, dropped = [], []
    for batches in ((0, 1), (2,), (3,), (4,), (5,)):
        index = gi.Index(spark, path)
        got += [tuple(r) for r in index.append(prepared_of(spark, [r for r in cand if r[3] in batches])).collect()]
        dropped += index.compact()
    assert set(got) == want and len(got) == len(want)
    assert dropped and len(gi.Index(spark, path).versions()) == 6
    shards = {r["shard"] for r in gi.Index(spark, path).shards().collect()}
    assert not shards & set(dropped) and {-1, gi._LEVEL} <= shards
    with pytest.raises(ValueError):
        gi.Index(spark, path).create(prepared_of(spark, cat).drop("batch_no"))


def test_segments_and_blocks_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(gi, "QUERY_BLOCK", 40)
    monkeypatch.setattr(gi.spans, "__defaults__", (60,))
    cat, clips = collection(21, 120)
    cand, _ = collection(22, 160, first=5000, base=clips)
    assert repeats_of(spark, cat, cand) == brute_repeats(cat, cand)


def test_spans_split_a_duration_that_fills_them():
    s = gi.spans([gi.Stats(0, 0, 1000, [5] * 200 + list(range(6, 63)))], 100)
    assert s.sub[s.low <= 5].sum() >= 7 and s.sub.sum() >= 10
    assert (np.diff(s.low) > 0).all() and s.base.tolist() == [0, *np.cumsum(s.sub)[:-1]]
    low, high = gi.reach(np.array([1, 99, 1000, 12_345_678_901_234_567]))
    for m, lo, hi in zip([1, 99, 1000, 12_345_678_901_234_567], low.tolist(), high.tolist()):
        fits = lambda a, b: abs(a - b) * 100 <= max(a, b) * 12
        assert fits(m, lo) and fits(m, hi) and not fits(m, lo - 1) and not fits(m, hi + 1)


def test_schedule_reads_each_batch_once():
    for rank in range(300):
        shards = gi.shards_read(rank)
        assert shards[0] == gi.CATALOG and sorted(r for s in shards[1:] for r in gi.ranks_of(s)) == list(range(rank + 1))


def flips(v, bits, seed):
    rng = np.random.default_rng(seed)
    out = v.copy()
    for i in range(len(out)):
        for b in rng.choice(64, bits, replace=False):
            out[i] ^= np.uint64(1) << np.uint64(b)
    return out


def close_ones(values, queries):
    q, v = np.nonzero(np.bitwise_count(queries[:, None] ^ values) <= fp.MAX_BITS)
    return q * len(values) + v


def test_graph_walk_reaches_what_entries_miss():
    rng = np.random.default_rng(5)
    crowd = flips(np.full(3000, rng.integers(0, 1 << 63, dtype=np.uint64)), 3, 6)
    v = np.unique(np.concatenate([rng.integers(0, 1 << 63, 30_000, dtype=np.uint64), crowd]))
    graph = gi.build_graph(v)
    width, recall, entries = gi.tuned(v, graph)
    assert recall >= gi.TARGET_RECALL and entries < 0.6
    for q in (flips(v[rng.choice(len(v), 400, replace=False)], 7, 7), flips(crowd[:300], 1, 8)):
        want = close_ones(v, q)
        got = gi._pairs(gi.search_segment(v, graph, q, width, recall), len(v))
        assert len(got) == len(np.unique(got)) and np.isin(got, want).all() and len(got) >= 0.95 * len(want)
    dense = flips(crowd[:300], 1, 8)
    hits = gi.entry_hits(v, dense, gi._orders(width))
    assert np.isin(close_ones(v, dense), hits).mean() < 0.5


def test_segments_that_miss_the_target_are_searched_exactly():
    rng = np.random.default_rng(3)
    group = flips(np.full(2000, rng.integers(0, 1 << 63, dtype=np.uint64)), 2, 4)
    v = np.unique(np.concatenate([rng.integers(0, 1 << 63, 5000, dtype=np.uint64), group]))
    q = np.unique(group)[:300]
    got = gi._pairs(gi.search_segment(v, gi.build_graph(v), q, 8, gi.TARGET_RECALL - 0.01), len(v))
    assert np.array_equal(got, np.sort(close_ones(v, q)))
    few = v[:50]
    assert np.array_equal(gi._pairs(gi.search_segment(few, gi.build_graph(few), q, 8, 1.0), 50), np.sort(close_ones(few, q)))
