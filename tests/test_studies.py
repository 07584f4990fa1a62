"""Studies as one family: rank correlations, regressions and Holm steps over signals, horizons and targets by plain loops."""
import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelwright.operators import regression as X
from panelwright.operators import studies as D

DAY = dt.date(2018, 1, 1)


def day(i):
    return DAY + dt.timedelta(days=7 * i)


@pytest.fixture(scope="module")
def study(spark):
    rng = np.random.default_rng(1)
    n = 150
    a, b = np.round(rng.normal(size=n), 1), rng.integers(0, 4, n).astype(float)
    sig = [(day(i), None if i % 17 == 0 else float(a[i]), float(b[i])) for i in range(n)]
    out = [(day(i), h, None if i > n - h else float(a[i] * h + rng.normal()), float(rng.normal())) for h in (2, 5) for i in range(n)]
    x = spark.createDataFrame(sig, "session date, s1 double, s2 double")
    y = spark.createDataFrame(out, "session date, horizon int, gain double, low double")
    return sig, out, D.long_study(x, ["s1", "s2"], y, ["gain", "low"])


def pairs(sig, out, s, h, t):
    x, y = {r[0]: r[1 if s == "s1" else 2] for r in sig}, {r[0]: r[2 if t == "gain" else 3] for r in out if r[1] == h}
    return [(x[d], y[d]) for d in sorted(x) if x[d] is not None and y[d] is not None]


def mean_rank(v):
    v = np.array(v)
    return np.array([(v < x).sum() + ((v == x).sum() + 1) / 2 for x in v])


def test_family_of_hypotheses(spark, study):
    sig, out, long = study
    prior = spark.createDataFrame([(1e-12,), (None,), (0.4,)], "p double")
    got = {(r.signal, r.horizon, r.target): r for r in D.study_tests(long, (2, 5), 3, 80, prior=prior).collect()}
    assert set(got) == {(s, h, t) for s in ("s1", "s2") for h in (2, 5) for t in ("gain", "low")}
    for (s, h, t), r in got.items():
        both = pairs(sig, out, s, h, t)
        assert r.n == len(both) and r.spearman == pytest.approx(np.corrcoef(mean_rank([p[0] for p in both]), mean_rank([p[1] for p in both]))[0, 1])
        alone = X.hac_regression(long.filter((F.col("signal") == s) & (F.col("horizon") == h) & (F.col("target") == t)).withColumn("k", F.lit(1)), "k", "y", "x", "session", h + 3).first()
        assert (r.beta, r.se, r.p) == (pytest.approx(alone.beta), pytest.approx(alone.se), pytest.approx(alone.p))
    for column, more in (("local_p", []), ("joint_p", [1e-12, 1.0, 0.4])):
        family = sorted([(r.p, k) for k, r in got.items()] + [(p, None) for p in more], key=lambda x: x[0])
        worst = 0.0
        for i, (p, k) in enumerate(family):
            worst = max(worst, p * (len(family) - i))
            if k:
                assert got[k][column] == pytest.approx(min(1.0, worst))


def test_short_series_stay_in_the_family(spark):
    rows = [("s", 2, "gain", day(i), float(i), float(i % 3)) for i in range(20)]
    r = D.study_tests(spark.createDataFrame(rows, "signal string, horizon int, target string, session date, x double, y double"), (2,)).first()
    assert (r.status, r.p, r.local_p, r.joint_p) == ("insufficient", None, 1.0, 1.0) and r.spearman is not None


def test_buckets_keep_outcomes_of_their_year(spark):
    rows = [("g", day(i), float(i % 10), float(i), i < 100, day(i + 4)) for i in range(200)] + [("g", day(3), None, 1.0, True, day(4)), ("g", day(5), 1.0, None, True, None)]
    got = {(r.half, r.bucket): r for r in D.contained_buckets(spark.createDataFrame(rows, "g string, session date, x double, y double, early boolean, leaves date"), ["g"], "x", "y", "early", "leaves").collect()}
    cuts = np.unique(np.quantile([r[2] for r in rows if r[4] and r[2] is not None], [0.2, 0.4, 0.6, 0.8]))
    want = {}
    for _, s, x, y, early, leaves in rows:
        if x is not None and y is not None and leaves.year <= s.year:
            want.setdefault((1 if early else 2, 1 + int((cuts <= x).sum())), []).append(y)
    assert {k: (r.n, r.mean, r.worst) for k, r in got.items()} == {k: (len(v), pytest.approx(np.mean(v)), min(v)) for k, v in want.items()}


def test_events_of_all_horizons(spark):
    rng = np.random.default_rng(2)
    rows = [(i % 3, i, h, float(rng.normal(0.2 * h))) for i in range(60) for h in (1, 4)]
    out = spark.createDataFrame(rows, "inst int, seq int, horizon int, y double")
    anchors = spark.createDataFrame([(i % 3, i, i) for i in range(0, 60, 2)] + [(9, 9, 9)], "inst int, seq int, place int")
    got = {r.horizon: r for r in D.event_study(anchors, out, ["inst", "seq"], "horizon", "y", "place", 0).collect()}
    for h, r in got.items():
        v = np.array([y for _, s, k, y in rows if k == h and s % 2 == 0])
        assert (r.n, r.mean, r.median, r.win, r.worst) == (30, pytest.approx(v.mean()), pytest.approx(np.median(v)), pytest.approx((v > 0).mean()), v.min())
        assert r.t == pytest.approx(v.mean() / (np.sqrt(((v - v.mean()) ** 2).sum()) / 30))
    low, high = sorted(got.values(), key=lambda r: r.p)
    assert low.holm_p == pytest.approx(min(1, 2 * low.p)) and high.holm_p == pytest.approx(max(low.holm_p, high.p))
