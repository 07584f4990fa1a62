"""Order statistics of trailing windows against brute force: ties, missing values, several instruments and batches."""
import datetime as dt

import numpy as np
import pytest

from panelwright.operators import order_stats as O


def brute(values, n, past, qs):
    out = []
    for i, v in enumerate(values):
        w = [x for x in (values[max(0, i - n) : i] if past else values[max(0, i - n + 1) : i + 1]) if x is not None and x == x]
        has = v is not None and v == v
        q = [float(np.quantile(w, p)) if w else None for p in qs]
        out.append(((sum(x < v for x in w), sum(x == v for x in w)) if has else (None, None)) + (len(w), *q))
    return out


@pytest.mark.parametrize("n, past", [(1, False), (1, True), (5, False), (5, True), (40, True), (756, False)])
def test_windows_by_brute_force(spark, n, past):
    rng = np.random.default_rng(n)
    series = {k: [None if rng.random() < 0.1 else float("nan") if rng.random() < 0.05 else float(rng.integers(0, 9)) for _ in range(m)] for k, m in (("a", 120), ("b", 1), ("c", 63))}
    day = dt.date(2020, 1, 1)
    rows = [(k, day + dt.timedelta(i), v, i) for k, s in series.items() for i, v in enumerate(s)]
    rng.shuffle(rows)
    d = spark.createDataFrame([(k, s, None if v is None else float(v), int(i)) for k, s, v, i in rows], "inst string, session date, x double, w_below int")
    got = {}
    for r in O.with_trailing(d.withColumnRenamed("w_below", "i"), {"w": O.Trailing("x", n, past, (0.2, 0.8)), "v": O.Trailing("x", 3)}).collect():
        got[r.inst, r.i] = ((r.w_below, r.w_same, r.w_size, r.w_q0, r.w_q1), (r.v_below, r.v_same, r.v_size))
    assert len(got) == len(rows)
    for k, s in series.items():
        for i, (w, v) in enumerate(zip(brute(s, n, past, (0.2, 0.8)), brute(s, 3, False, ()))):
            assert got[k, i][0] == pytest.approx(w) and got[k, i][1] == v


def test_windows_run_on_over_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        d = spark.range(100).selectExpr("cast(1 as int) inst", "id session", "cast(id % 10 as double) x")
        got = {r.session: r.p for r in O.with_history_percentile(d, {"p": "x"}, 20, 20).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert all(got[i] is None if i < 19 else got[i] == pytest.approx((2 * (i % 10) + 1) / 20) for i in range(100))
