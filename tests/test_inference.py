"""Bootstraps of full size, two-sided inference and calendar-keeping regressions against plain loops."""
import datetime as dt
import math

import numpy as np
import pytest

from panelwright.operators import evidence as E
from panelwright.operators import regression as X
from panelwright.operators import resampling as B


def day(i):
    return dt.date(2020, 1, 1) + dt.timedelta(days=7 * i)


def start(seed, b, k, n):
    x = (seed + b * B.STEP_RESAMPLE + k * B.STEP_BLOCK) % 2**32
    for _ in range(2):
        x = ((x >> 16) ^ x) * B.MIXER % 2**32
    return ((x >> 16) ^ x) % n


def seed(entity):
    import hashlib

    return int(hashlib.md5(str(entity).encode()).hexdigest()[:8], 16)


def taken(entity, n, block, b):
    """Positions of resample b, one after another."""
    out = []
    for k in range(math.ceil(n / block)):
        s = start(seed(entity), b, k, n)
        out += [(s + i) % n for i in range(block)]
    return out[:n]


def test_ten_thousand_resamples_by_a_plain_loop(spark):
    rng = np.random.default_rng(1)
    series = {"a": rng.normal(0.1, 1, 37), "b": rng.normal(0, 1, 3), "one": np.array([0.5])}
    rows = [(e, day(i), float(v)) for e, s in series.items() for i, v in enumerate(s)] + [("a", day(99), None), ("none", day(0), None)]
    got = {r.e: r for r in B.block_bootstrap(spark.createDataFrame(rows, "e string, day date, x double"), "e", "x", "day", 5).collect()}
    assert set(got) == set(series)  # a series without values gives none
    for e, s in series.items():
        means = [s[taken(e, len(s), 5, b)].mean() for b in range(10_000)]
        assert got[e].n == len(s) and got[e].mean == pytest.approx(s.mean())
        assert got[e].p == pytest.approx((sum(abs(m - s.mean()) >= abs(s.mean()) * (1 - 1e-9) for m in means) + 1) / 10_001)
        assert (got[e].lower, got[e].upper) == (pytest.approx(np.quantile(means, 0.025)), pytest.approx(np.quantile(means, 0.975)))


@pytest.mark.parametrize("chunk", [1, 7, 1000])
def test_chunks_do_not_change_the_draws(spark, chunk):
    rows = [(e, day(i), float(i * i % 7)) for e in (1, 2) for i in range(23)]
    d = spark.createDataFrame(rows, "e int, day date, x double")
    from pyspark.sql import functions as F

    got = sorted((r.e, r.b, r.s) for r in B.block_totals(d, "e", "day", {"s": F.col("x")}, 4, 20, chunk).collect())
    assert got == sorted((e, b, sum(float(i * i % 7) for i in taken(e, 23, 4, b))) for e in (1, 2) for b in range(20))


def test_contrast_keeps_gaps_in_place(spark):
    rng = np.random.default_rng(2)
    n = 150
    v, t = rng.normal(size=n), rng.integers(0, 3, n)  # treated, control, neither
    rows = [("g", day(i), None if i % 10 == 3 else float(v[i]), bool(t[i] == 0), bool(t[i] == 1)) for i in range(n)] + [("few", day(i), 1.0, i % 2 == 0, i % 2 == 1) for i in range(20)]
    d = spark.createDataFrame(rows, "e string, day date, x double, t boolean, c boolean")
    got = {r.e: r for r in B.bootstrap_contrast(d, "e", "x", "t", "c", "day", 7, 300).collect()}
    has = np.arange(n) % 10 != 3
    diff = []
    for b in range(300):
        at = np.array(taken("g", n, 7, b))
        a, c = at[has[at] & (t[at] == 0)], at[has[at] & (t[at] == 1)]
        if min(len(a), len(c)) >= 5:
            diff.append(v[a].mean() - v[c].mean())
    r = got["g"]
    assert r.draws == len(diff) and r.observed == pytest.approx(v[has & (t == 0)].mean() - v[has & (t == 1)].mean())
    assert (r.lower, r.upper) == (pytest.approx(np.quantile(diff, 0.025)), pytest.approx(np.quantile(diff, 0.975)))
    assert got["few"].draws == 0 and got["few"].observed is None


def test_both_inferences_and_outcomes(spark):
    rng = np.random.default_rng(3)
    means = {"up": 1.0, "down": -1.0, "flat": 0.0, "free": 1.0}
    rows = [(e, day(i), float(m + rng.normal() * 0.3), None if e == "free" else "POSITIVE") for e, m in means.items() for i in range(60)]
    d = spark.createDataFrame(rows, "e string, day date, x double, declared string")
    t = E.mean_inference(d, "e", "x", "day", 3, 5, 500, 0.1).join(d.select("e", "declared").distinct(), "e")
    got = {r.e: r for r in E.incremental_outcome(t).collect()}
    assert {e: r.outcome for e, r in got.items()} == {"up": "supported", "down": "contradicted", "flat": "no_increment", "free": "undirected"}
    for p, q in (("hac_p", "hac_q"), ("bootstrap_p", "bootstrap_q")):
        order = sorted(got, key=lambda e: got[e][p])
        best = 1.0
        for k, e in reversed(list(enumerate(order, 1))):
            best = min(best, got[e][p] * 4 / k)
            assert got[e][q] == pytest.approx(best)


@pytest.mark.parametrize("lags", [0, 3, 8])
def test_hac_regression_by_matrices(spark, lags):
    """The whole design with its dummies, unlike the operator, which takes year means away."""
    rng = np.random.default_rng(5)
    n = 160
    x = rng.normal(size=n)
    y = 2 * x + np.repeat(rng.normal(size=4), 40) + rng.normal(size=n)
    miss = np.arange(n) % 9 == 0
    rows = [("s", day(i), float(x[i]), None if miss[i] else float(y[i])) for i in range(n)] + [("short", day(i), float(i), float(i)) for i in range(79)] + [("flat", day(i), 1.0, float(i)) for i in range(120)]
    got = {r.g: r for r in X.hac_regression(spark.createDataFrame(rows, "g string, day date, x double, y double"), "g", "y", "x", "day", lags).collect()}
    years = np.array([day(i).year for i in range(n)])
    a = np.column_stack([np.ones(n), x, *(years == v for v in sorted(set(years))[1:])]).astype(float)
    a[miss] = 0
    b = np.where(miss, 0, y)
    bread = np.linalg.inv(a.T @ a)
    u = a * (b - a @ (bread @ a.T @ b))[:, None]
    omega = sum((1 - abs(k) / (lags + 1)) * (u[max(k, 0) :][: n - abs(k)].T @ u[max(-k, 0) :][: n - abs(k)]) for k in range(-lags, lags + 1))
    used = int((~miss).sum())
    se = math.sqrt((bread @ omega @ bread)[1, 1] * used / (used - a.shape[1]))
    r = got["s"]
    assert (r.n, r.status) == (used, "estimated") and r.beta == pytest.approx((bread @ a.T @ b)[1]) and r.se == pytest.approx(se)
    assert r.p == pytest.approx(math.erfc(abs(r.beta / se) / math.sqrt(2)), abs=1e-6) and r.upper == pytest.approx(r.beta + 1.96 * se)
    assert [(got[k].status, got[k].beta) for k in ("short", "flat")] == [("insufficient", None), ("no_within_year_variation", None)]


def test_conditional_ic_with_one_to_four_controls(spark):
    rng = np.random.default_rng(6)
    z = rng.normal(size=(50, 6)) @ rng.normal(size=(6, 6))
    d = spark.createDataFrame([(day(0), *map(float, v)) for v in z], "session date, " + ", ".join(f"c{k} double" for k in range(6)))
    for k in (1, 2, 4):
        r = X.conditional_rank_ic(d, "c4", "c5", [f"c{i}" for i in range(k)]).first()
        a = np.column_stack([np.ones(50), z[:, :k]])
        rx, ry = (v - a @ np.linalg.lstsq(a, v, rcond=None)[0] for v in (z[:, 4], z[:, 5]))
        y = z[:, 5]
        assert r.partial == pytest.approx(np.corrcoef(rx, ry)[0, 1], abs=1e-4) and r.semi_partial == pytest.approx(np.corrcoef(rx, y)[0, 1], abs=1e-4)
        assert r.baseline_r2 == pytest.approx(1 - (ry @ ry) / ((y - y.mean()) ** 2).sum(), abs=1e-4)
