import random

import pytest

from cuelattice.llm import nearest as nt


def brute(left, right):
    out = {}
    for e, i, t, tol in left:
        if None in (e, i, t, tol):
            continue
        best = min(((abs(rt - t), rt, ri) for re, ri, rt in right if re == e and ri is not None and rt is not None), default=None)
        if best and best[0] <= tol:
            out[i] = best[2]
    return out


def run(spark, left, right, width):
    le = spark.createDataFrame([(*r, "x") for r in left], "entity string, id long, tick long, tolerance long, slice string")
    r = spark.createDataFrame([(*r, "x") for r in right], "entity string, id long, tick long, side string")
    rows = nt.nearest_in_time(le, r, width).collect()
    got = {x["left_id"]: x["right_id"] for x in rows}
    assert len(got) == len(rows)
    return got


@pytest.mark.parametrize("width", [7, 100, 10**6])
def test_random_hot_and_dirty(spark, width):
    rng = random.Random(width)
    pick = lambda: rng.choice(["hot"] * 6 + ["a", "b", None])
    left = [(pick(), i, rng.randrange(-300, 3000), rng.choice([0, 1, 5, 40, 5000])) for i in range(300)]
    right = [(pick(), i, rng.randrange(-300, 3000)) for i in range(200)]
    left += [("a", 900, None, 3), ("a", None, 3, 3), ("a", 901, 3, None)] + left[:20]
    right += [("a", 950, None), ("a", None, 4)] + right[:20]
    assert run(spark, left, right, width) == brute(left, right)


def test_ties(spark):
    assert run(spark, [("a", 1, 10, 5)], [("a", 7, 5), ("a", 3, 15), ("a", 6, 5)], 4) == {1: 6}
    assert run(spark, [("a", 1, 10, 5)], [("a", 7, 10), ("a", 3, 10)], 4) == {1: 3}
    assert run(spark, [("a", 1, 10, 4)], [("a", 7, 5)], 4) == {}


def test_empty(spark):
    assert run(spark, [], [("a", 1, 1)], 5) == {} and run(spark, [("a", 1, 1, 1)], [], 5) == {} and run(spark, [], [], 5) == {}


def test_farthest_times_and_tolerances(spark):
    far = 4_600_000_000_000_000_000
    assert run(spark, [("a", 1, -far, 2**63 - 1), ("a", 2, far, 0), ("b", 3, 5, 2**63 - 1)], [("a", 7, far)], 10**6) == {1: 7, 2: 7}
    df = spark.createDataFrame([(1e14,), (1e300,), (float("inf"),), (float("nan"),), (None,)], "x double")
    got = [tuple(r) for r in df.select(nt.ticks(df["x"]), nt.tolerance_ticks(df["x"])).collect()]
    assert got == [(10**18, 10**18), (None, 2**63 - 1), (None, None), (None, None), (None, None)]
