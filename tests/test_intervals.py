import random

from pyspark.sql import functions as F

from cuelattice.operators import intervals


def brute(rows):
    by = {}
    for k, s, e in rows:
        if s is not None and e is not None and e > s:
            by.setdefault(k, []).append((s, e))
    out = set()
    for k, iv in by.items():
        iv.sort()
        done = [list(iv[0])]
        for s, e in iv[1:]:
            if s <= done[-1][1]:
                done[-1][1] = max(done[-1][1], e)
            else:
                done.append([s, e])
        out |= {(k, "period", s, e) for s, e in done}
        out |= {(k, "gap", a[1], b[0]) for a, b in zip(done, done[1:])}
    return out


def run(spark, rows, slice_ms=intervals.SLICE_MS):
    df = spark.createDataFrame([(*r, "x") for r in rows], "k string, start_ms long, end_ms long, kind string")
    got = intervals.periods_and_gaps(df, ["k"], slice_ms=slice_ms).collect()
    assert len(got) == len({tuple(r) for r in got})
    return {tuple(r) for r in got}


def test_random_and_slices(spark):
    rng = random.Random(1)
    rows = []
    for _ in range(400):
        s = rng.randrange(-500, 3000)
        rows.append((rng.choice(["a", "b", None]), s, s + rng.choice([0, -3, 1, 5, 40, 900])))
    rows += [("a", None, 4), ("b", 4, None)] + rows[:30]
    for width in (7, 100, 60_000):
        assert run(spark, rows, width) == brute(rows)


def test_touch_nest_and_long_reach(spark):
    rows = [("a", 0, 10), ("a", 10, 20), ("a", 2, 5), ("a", 25, 100_000), ("a", 70_000, 70_001), ("a", 100_001, 100_002)]
    assert run(spark, rows, 1000) == brute(rows)


def test_farthest_times_count(spark):
    far = 9_100_000_000_000_000_000
    rows = [("a", -far, far), ("a", far - 5, far + 7), ("a", far + 8, far + 9), ("b", far, far + 1), ("b", -far - 3, -far), ("b", -far, -far + 2)]
    assert run(spark, rows) == brute(rows)


def test_empty(spark):
    assert run(spark, []) == set()
    assert run(spark, [("a", 5, 5)]) == set()


def test_whole_ms(spark):
    df = spark.createDataFrame([(1.0004,), (float("nan"),), (float("inf"),), (None,), (-0.00005,)], "x double")
    assert [r[0] for r in df.select(intervals.whole_ms(F.col("x"))).collect()] == [1000, None, None, None, 0]
