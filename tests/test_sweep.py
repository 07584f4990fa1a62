"""Interval joins by a sweep against all pairs: ties, open ends, overlaps, empty intervals, missing keys and one hot key."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from panelwright.operators import sweep


@pytest.mark.parametrize("closed", [False, True])
@pytest.mark.parametrize("open_start", [False, True])
def test_all_pairs(spark, closed, open_start):
    rng = np.random.default_rng(1)
    pick = lambda hot: "hot" if hot else f"k{rng.integers(0, 8)}"
    left = [(pick(i % 3), int(rng.integers(0, 60)), i) for i in range(400)] + [(None, 5, 900), ("k1", None, 901), ("hot", 30, 902), ("hot", 30, 902), ("nowhere", 4, 903)]
    iv = []
    for i in range(150):
        a = int(rng.integers(0, 50))
        iv.append((pick(i % 3), None if i % 37 == 5 else a, None if i % 11 == 0 else a + int(rng.integers(-2, 20)), int(rng.integers(0, 4)), i))
    iv += [(None, 0, None, 9, 777), iv[3]]
    best = {}
    for k, t, i in left:
        if k is None or t is None:
            continue
        inside = [(p, j) for kk, a, b, p, j in iv if kk == k and a is not None and (t > a if open_start else t >= a) and (b is None or (t <= b if closed else t < b))]
        best[i] = max(inside, default=(None, None))
    schema = "inst string, a int, b int, p int, j int"
    x = sweep.interval_latest(spark.createDataFrame(left, "inst string, t int, i int"), spark.createDataFrame(iv, schema), "inst", "t", "a", "b", ["p", "j"], [F.desc("p"), F.desc("j")], closed, open_start)
    got = x.collect()
    assert len(got) == len(left)
    assert all((r.p, r.j) == best.get(r.i, (None, None)) for r in got)


def test_no_intervals_and_no_rows(spark):
    left = spark.createDataFrame([("a", 1)], "inst string, t int")
    iv = spark.createDataFrame([("a", 0, 9, 1)], "inst string, a int, b int, v int")
    of = lambda x, y: [r.v for r in sweep.interval_latest(x, y, "inst", "t", "a", "b", ["v"], [F.desc("a")]).collect()]
    assert of(left, iv) == [1] and of(left, iv.limit(0)) == [None] and of(left.limit(0), iv) == []


def test_the_plan_has_no_range_join(spark):
    left = spark.range(10).selectExpr("id % 2 as inst", "id as t")
    iv = spark.range(10).selectExpr("id % 2 as inst", "id as a", "id + 3 as b", "id as v")
    plan = sweep.interval_latest(left, iv, "inst", "t", "a", "b", ["v"], [F.desc("a")])._jdf.queryExecution().optimizedPlan().toString()
    assert all("inst" not in line or ">=" not in line for line in plan.splitlines() if "Join" in line)
