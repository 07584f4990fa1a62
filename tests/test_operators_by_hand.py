"""Operators that have no SQL form, and edge cases of others, worked out by hand or by plain loops."""
import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelwright.operators import clustering as C
from panelwright.operators import events as V
from panelwright.operators import evidence as E
from panelwright.operators import facts as X
from panelwright.operators import gates as G
from panelwright.operators import reference as N
from panelwright.operators import regression, sweep, switching
from panelwright.operators import research as R
from panelwright.operators import temporal as M
from panelwright.plans import evidence_queries as Q  # noqa: F401
from panelwright.sources import ingest as I
from panelwright.sources import tables as T

SF = "/root/testdata/sf0.001"
D = dt.date


def day(i):
    return D(2020, 1, 6) + dt.timedelta(7 * i)


CYCLE = "inst int, ex_date date, imp_ann date, end_date date, cash double, stock double, conflict boolean"


@pytest.mark.parametrize("events, session, cash, status", [
    ([], D(2021, 1, 1), None, "no_known_cycle"),
    ([(D(2020, 6, 1), D(2019, 12, 31), 1.0, 0.0)], D(2020, 9, 1), 1.0, "annual_once"),
    ([(D(2020, 6, 1), D(2019, 12, 31), 1.0, 0.25)], D(2020, 9, 1), 0.8, "annual_once"),
    ([(D(2019, 9, 1), D(2019, 6, 30), 0.4, 0.0), (D(2020, 6, 1), D(2019, 12, 31), 1.0, 0.0)], D(2020, 7, 1), 1.4, "annual_split"),
    ([(D(2019, 9, 1), D(2019, 6, 30), 0.4, 0.0), (D(2020, 6, 1), D(2019, 12, 31), 1.0, 0.0), (D(2020, 9, 1), D(2020, 6, 30), 0.5, 0.0)], D(2020, 10, 1), 1.5, "rolling_split_cycle"),
    ([(D(2020, 6, 1), D(2019, 12, 31), 1.0, 0.0), (D(2020, 9, 1), D(2020, 6, 30), 0.5, 0.0)], D(2020, 10, 1), 1.0, "frequency_transition"),
    ([(D(2018, 9, 1), D(2018, 6, 30), 0.4, 0.0), (D(2019, 6, 1), D(2018, 12, 31), 1.0, 0.0), (D(2020, 6, 1), D(2019, 12, 31), 1.0, 0.0)], D(2020, 7, 1), None, "expected_interim_missing"),
    ([(D(2020, 9, 1), D(2020, 6, 30), 0.5, 0.0)], D(2020, 10, 1), None, "annual_cycle_not_complete"),
    ([(D(2020, 6, 1), D(2019, 12, 31), 1.0, 0.0)], D(2022, 6, 1), None, "stale_cycle"),
    ([(D(2020, 6, 1), D(2019, 12, 31), None, 0.0)], D(2020, 9, 1), None, "amount_or_event_conflict"),
    ([(D(2020, 6, 1), D(2019, 12, 31), 1.0, None)], D(2020, 9, 1), None, "share_distribution_unknown"),
    ([(D(2020, 6, 1), D(2019, 12, 31), 1.0, 0.0), (D(2020, 7, 1), D(2019, 12, 31), 1.0, 0.0)], D(2020, 9, 1), None, "several_payments_of_a_period"),
    ([(D(2020, 6, 1), D(2019, 12, 31), 1.0, 0.0), (D(2020, 7, 1), D(2020, 3, 17), 1.0, 0.0)], D(2020, 9, 1), None, "nonstandard_period"),
    ([(D(2020, 6, 1), None, 1.0, 0.0)], D(2020, 9, 1), None, "period_missing"),
    ([(D(2020, 6, 1), D(2019, 12, 31), 1.0, 0.0), (D(2020, 7, 1), D(2020, 12, 31), 1.0, 0.0)], D(2020, 9, 1), None, "period_after_information_date"),
])
def test_dividend_cycles(spark, events, session, cash, status):
    ev = spark.createDataFrame([(1, x, x - dt.timedelta(5), e, c, s, False) for x, e, c, s in events], CYCLE)
    got = V.with_dividend_cycle(spark.createDataFrame([(1, session)], "inst int, session date"), ev).first()
    assert got.status == status and (got.cash is None if cash is None else got.cash == pytest.approx(cash))


def test_an_event_announced_late_is_not_known(spark):
    ev = spark.createDataFrame([(1, day(1), day(3), 1.0, 0.5)], "inst int, ex_date date, imp_ann date, cash double, stock double")
    s = spark.createDataFrame([(1, day(i)) for i in range(6)], "inst int, session date")
    got = {r.session: r.c for r in V.cash_per_current_share(s, ev).withColumnRenamed("cash", "c").collect()}
    assert [got[day(i)] for i in range(6)] == [0, 0, 0, 0, pytest.approx(1 / 1.5), pytest.approx(1 / 1.5)]


def test_as_of_keeps_repeated_rows_and_is_strict(spark):
    left = spark.createDataFrame([(1, day(1), "a"), (1, day(1), "a"), (1, day(2), "b"), (2, day(2), "c")], "inst int, session date, tag string")
    right = spark.createDataFrame([(1, day(1), 5.0, 1), (1, day(1), 6.0, 2)], "inst int, available date, value double, k int")
    got = sorted(((r.inst, r.session, r.tag, r.value) for r in X.asof_last(left, right, ["inst"], "session", "available", ["value"], ["k"]).collect()), key=repr)
    assert got == sorted([(1, day(1), "a", None), (1, day(1), "a", None), (1, day(2), "b", 6.0), (2, day(2), "c", None)], key=repr)
    assert X.asof_last(left, right, ["inst"], "session", "available", ["value"], ["k"], strict=False).filter("value = 6").count() == 3


def test_interval_keeps_repeated_rows(spark):
    left = spark.createDataFrame([(1, day(1)), (1, day(1)), (1, day(9))], "inst int, session date")
    iv = spark.createDataFrame([(1, day(0), day(3), "x"), (1, day(1), day(5), "y")], "inst int, a date, b date, g string")
    for got in (sweep.interval_latest(left, iv, "inst", "session", "a", "b", ["g"], [F.desc("a")]),):
        assert sorted((r.session, r.g or "") for r in got.collect()) == [(day(1), "y"), (day(1), "y"), (day(9), "")]


def test_a_total_loss_stays_one(spark):
    d = spark.createDataFrame([("a", i, x, day(i)) for i, x in enumerate([0.1, -1.0, 0.5])], "e string, t int, ret double, session date")
    got = R.performance(d, "e", "ret", "t", 52).first()
    assert got.total == -1 and got.max_drawdown == -1
    assert {(r.q, r.total) for r in R.period_returns(d, "e", "ret").collect()} == {(0, -1.0), (1, -1.0)}


def test_tail_against_erfc(spark):
    z = [0.0, 0.3, 1.0, 1.96, 3.0, -2.5]
    got = spark.createDataFrame([(x,) for x in z], "z double").select("z", E.two_sided_p("z").alias("p")).collect()
    assert all(r.p == pytest.approx(math.erfc(abs(r.z) / math.sqrt(2)), abs=3e-7) for r in got)


def test_average_linkage_by_hand(spark):
    d = spark.createDataFrame([("f", "a", "b", 0.1), ("f", "a", "c", 0.5), ("f", "b", "c", 0.3), ("f", "a", "d", 0.9), ("f", "b", "d", 0.9), ("f", "c", "d", 0.2)], "family string, left_id string, right_id string, distance double")
    cut = lambda t: {r.id: r.cluster for r in C.average_linkage(d, t).collect()}
    assert cut(0.05) == {x: x for x in "abcd"} and cut(0.35) == {"a": "a", "b": "a", "c": "c", "d": "c"}
    assert set(cut(0.65).values()) == {"a"}  # mean of 0.5, 0.3, 0.9, 0.9
    med = {r.id: (r.mean_distance, r.representative) for r in E.medoids(C.average_linkage(d, 0.65), d).collect()}
    assert med["b"] == (pytest.approx((0.1 + 0.3 + 0.9) / 3), "c") and med["a"][1] == "c"


def test_conditional_ic_is_that_of_residuals(spark):
    rng = np.random.default_rng(4)
    n = 60
    x, c1, c2 = rng.normal(size=(3, n))
    x = x + c1
    y = 0.5 * x + c2 + rng.normal(size=n)
    d = spark.createDataFrame([(day(0), *map(float, v)) for v in zip(x, y, c1, c2)] + [(day(1), 1.0, 1.0, 1.0, 1.0)] * 12 + [(day(2), None, 1.0, 1.0, 1.0)], "session date, x double, y double, c1 double, c2 double")
    rows = regression.conditional_rank_ic(d, "x", "y", ["c1", "c2"]).collect()
    assert [r.session for r in rows] == [day(0)]  # a session without variation or pairs gives none
    a = np.column_stack([np.ones(n), c1, c2])
    rx, ry = (v - a @ np.linalg.lstsq(a, v, rcond=None)[0] for v in (x, y))
    assert rows[0].partial == pytest.approx(np.corrcoef(rx, ry)[0, 1], abs=1e-5)
    assert rows[0].semi_partial == pytest.approx(np.corrcoef(rx, y)[0, 1], abs=1e-5)
    full = np.column_stack([a, x])
    assert rows[0].full_r2 == pytest.approx(1 - ((y - full @ np.linalg.lstsq(full, y, rcond=None)[0]) ** 2).sum() / ((y - y.mean()) ** 2).sum(), abs=1e-5)


def test_regimes_need_confirmation(spark):
    raw = ["strong", "strong", "strong", None, "weak", "weak", "strong", "weak", "base", "base", "base"]
    d = spark.createDataFrame([("a", i, x) for i, x in enumerate(raw)], "g string, seq int, raw string")
    got = [r.regime for r in switching.confirmed_regime(d, "g", "raw", 2, 3).orderBy("seq").collect()]
    assert got == ["base", "base", "strong", "strong", "strong", "weak", "weak", "weak", "weak", "weak", "base"]
    assert [r.exposure for r in switching.confirmed_regime(d, "g", "raw", 2, 3).orderBy("seq").collect()][:3] == [0.7, 0.7, 1.0]


def test_ridge_by_a_plain_solve(spark):
    rng = np.random.default_rng(6)
    rows = []
    for s in range(30):
        for i in range(8):
            f = rng.normal(size=2)
            rows.append((i, day(s), float(f[0]) if rng.random() > 0.2 else None, float(f[1]), float(2 * f[0] - f[1] + 0.1 * rng.normal()), day(s + 3)))
    d = spark.createDataFrame(rows, "inst int, session date, f1 double, f2 double, y double, label_end date")
    refits = spark.createDataFrame([(day(20), day(25))], "refit date, next_refit date")
    got = {(r.inst, r.session): r.prediction for r in E.walk_forward_ridge(d, ["f1", "f2"], "y", "label_end", refits, 1.0).collect()}
    train = [r for r in rows if r[5] < day(20)]
    med = [float(np.median([r[k] for r in train if r[k] is not None])) for k in (2, 3)]
    vec = lambda r: [r[2] if r[2] is not None else med[0], r[3], float(r[2] is None), 0.0]
    x, y, w = np.array([vec(r) for r in train]), np.array([r[4] for r in train]), np.full(len(train), 1 / 8)
    n = w.sum()
    mean, my = w @ x / n, w @ y / n
    sd = np.sqrt(w @ (x - mean) ** 2 / n)
    on = sd > 1e-9
    z = (x[:, on] - mean[on]) / sd[on]
    beta = np.linalg.solve((z.T * w) @ z / n + np.eye(on.sum()) / n, (z.T * w) @ (y - my) / n)
    for r in rows:
        if day(20) <= r[1] < day(25):
            assert got.pop((r[0], r[1])) == pytest.approx(my + ((np.array(vec(r)) - mean)[on] / sd[on]) @ beta, rel=1e-6, abs=1e-9)
    assert not got


def test_trees_predict_every_row_that_the_ridge_does(spark):
    from panelwright.plans import registry

    trees, ridge = (registry.QUERIES[q](spark, SF).select("inst", "session", "refit") for q in ("j50_walk_forward_gbt", "j49_walk_forward_ridge"))
    assert trees.count() == ridge.count() > 500 and trees.exceptAll(ridge).isEmpty()
    assert registry.QUERIES["j51_prediction_diagnostics"](spark, SF).filter("abs(rank_ic) <= 1").count() > 50


def test_a_tree_of_depth_one_by_a_plain_search(spark):
    rng = np.random.default_rng(9)
    rows = []
    for s in range(40):
        for i in range(10):
            a, b = float(rng.integers(0, 9)), None if rng.random() < 0.3 else float(rng.integers(0, 9))
            rows.append((i, day(s), a, b, None, float((3 if b is None else b > 5) + 0.2 * rng.normal()), day(s + 2)))
    d = spark.createDataFrame(rows, "inst int, session date, a double, b double, c double, y double, label_end date")
    refits = spark.createDataFrame([(day(10), day(20)), (day(20), day(30)), (day(0), day(1))], "refit date, next_refit date")
    got = E.walk_forward_trees(d, ["a", "b", "c"], "y", "label_end", refits, rounds=1, depth=1).collect()
    assert len(got) == 200
    for refit, until in ((day(10), day(20)), (day(20), day(30))):
        train = [r for r in rows if r[6] < refit]
        med = [float(np.median([r[k] for r in train if r[k] is not None])) for k in (2, 3)]
        vec = lambda r: (r[2], med[1] if r[3] is None else r[3], 0.0, float(r[3] is None))
        x, y = np.array([vec(r) for r in train]), np.array([r[5] for r in train])
        sse = lambda v: ((v - v.mean()) ** 2).sum() if len(v) else 0.0
        f, cut = min(((f, c) for f in range(4) for c in np.unique(x[:, f])[:-1]), key=lambda p: sse(y[x[:, p[0]] <= p[1]]) + sse(y[x[:, p[0]] > p[1]]))
        side = {s: y[(x[:, f] <= cut) == s].mean() for s in (True, False)}
        mine = {(r.inst, r.session): r for r in got if r.refit == refit}
        for r in rows:
            if refit <= r[1] < until:
                g = mine[r[0], r[1]]
                assert g.prediction == pytest.approx(side[bool(vec(r)[f] <= cut)]) and g.importance[("a", "b", "a_missing", "b_missing")[f]] == pytest.approx(1.0)


@pytest.mark.parametrize("seed", range(4))
def test_linkage_by_all_means(spark, seed):
    rng = np.random.default_rng(seed)
    n = 24
    x = rng.integers(0, 5 if seed % 2 else 40, (n, n)) / 64  # few values: many ties
    x = np.minimum(x, x.T)
    names = [f"n{k:02d}" for k in range(n)]
    rows = [("f", names[i], names[j], float(x[i, j])) for i in range(n) for j in range(i + 1, n) if (i + j) % 13]
    rows += [("g", "p", "q", 0.9)]
    known = {frozenset(r[1:3]): r[3] for r in rows}
    groups = [[k] for k in names]
    while True:
        mean = lambda a, b: sum(known.get(frozenset((p, q)), math.inf) for p in a for q in b) / (len(a) * len(b))
        pairs = [(mean(a, b), a, b) for k, a in enumerate(groups) for b in groups[k + 1 :]]
        low = min(p[0] for p in pairs)
        if low > 0.15 + 1e-12:
            break
        _, a, b = min((p for p in pairs if p[0] <= low + 1e-12), key=lambda p: (p[1][0], p[2][0]))
        groups = sorted([g for g in groups if g not in (a, b)] + [sorted(a + b)])
    d = spark.createDataFrame(rows, "family string, left_id string, right_id string, distance double")
    got = {(r.family, r.id): r.cluster for r in C.average_linkage(d, 0.15).collect()}
    assert got == {("f", m): g[0] for g in groups for m in g} | {("g", "p"): "p", ("g", "q"): "q"}


def test_linkage_of_two_thousand_ids_is_quadratic():
    import time

    rng = np.random.default_rng(3)
    at = rng.normal(size=(2000, 3))
    d = np.sqrt(((at[:, None] - at[None]) ** 2).sum(axis=2))
    t = time.process_time()
    own = C.merge(d, 0.5)
    assert time.process_time() - t < 60 and 50 < len(set(own)) < 2000


def test_capped_weights_by_filling(spark):
    rng = np.random.default_rng(9)
    rows = [(s, i, float(v)) for s in range(6) for i, v in enumerate(rng.lognormal(0, 1.5, [3, 6, 9, 20, 5, 12][s]))]
    d = spark.createDataFrame(rows, "session int, inst int, risk double")
    got = {(r.session, r.inst): r.weight for r in E.capped_inverse_weights(d, "risk", 0.15).collect()}
    for s in range(6):
        u = {i: 1 / v for t, i, v in rows if t == s}
        w, free, left = {}, set(u), 1.0
        while free:
            share = {i: left * u[i] / sum(u[j] for j in free) for i in free}
            over = {i for i in free if share[i] >= 0.15}
            if not over:
                w |= share
                break
            w |= dict.fromkeys(over, 0.15)
            left, free = left - 0.15 * len(over), free - over
        assert all(got[s, i] == pytest.approx(w[i]) for i in u)


def test_components_of_a_chain(spark):
    nodes = spark.createDataFrame([(x,) for x in "abcdefg"], "id string")
    edges = spark.createDataFrame([("f", "e"), ("e", "d"), ("d", "c"), ("c", "b"), ("b", "a")], "left_id string, right_id string")
    assert {r.id: r.label for r in E.small_components(nodes, edges).collect()} == {**dict.fromkeys("abcdef", "a"), "g": "g"}


def test_abnormal_names(spark):
    rows = [("*ST Alpha", False, True), ("STAR Corp", False, True), (" S*ST x", False, True), ("Plain", True, True), ("ST x", False, False), ("Old 退", False, True), (None, None, None)]
    got = [r.a for r in spark.createDataFrame(rows, "n string, st boolean, pit boolean").select(N.is_abnormal(F.col("n"), F.col("st"), F.col("pit")).alias("a")).collect()]
    assert got == [True, False, True, True, False, True, False]


def test_payloads_that_do_not_fit(spark):
    rows = [(day(0), '{"day":"20200106","n":1,"items":[{"k":1}]}'), (day(0), '{"day":"20200106","n":2,"items":[{"k":1}]}'), (day(0), '{"day":"20200107","n":1,"items":[{"k":1}]}'), (day(0), "nonsense"), (day(0), None)]
    got = I.decode_payloads(spark.createDataFrame(rows, "day date, p string"), "p", "struct<k:int>", "day").collect()
    assert sorted(r.status for r in got) == ["ok", "partition_date", "row_count", "unreadable", "unreadable"] and [r.item.k for r in got if r.item] == [1]


def test_upsert_and_month_folders(spark, tmp_path):
    old, new = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    assert sorted(map(tuple, I.upsert(old, new, ["k"]).collect())) == [(1, "a"), (2, "c"), (3, "d")]
    d = spark.createDataFrame([(D(2020, 1, 5), 1), (D(2021, 3, 5), 2)], "day date, v int")
    T.write_panel(d, str(tmp_path / "p"), "day")
    assert T.scan_panel(spark, str(tmp_path / "p"), [2021]).collect() == [(D(2021, 3, 5), 2)]


def test_gates_on_empty_tables(spark):
    d = spark.createDataFrame([], "inst int, session date, open double, high double, low double, close double, volume double, amount double, adj_factor double")
    assert {r.check_name: r.violations for r in G.audit_market(d, 0).collect()} == dict.fromkeys(("null_key", "ohlc", "negative_volume", "factor_not_positive", "unit", "duplicate_key", "manifest_count"), 0)


def test_spacing_and_warmup(spark):
    d = spark.createDataFrame([(1, x) for x in (1, 2, 6, 7, 12, 30)] + [(2, 5)], "inst int, seq int")
    assert sorted(map(tuple, M.spaced(d, "inst", "seq", 5).collect())) == [(1, 1), (1, 6), (1, 12), (1, 30), (2, 5)]
    c = spark.createDataFrame([(day(i),) for i in range(5)], "session date")
    assert M.warmup_start(c, F.lit(day(4)), 2).first().start == day(2) and M.warmup_start(c, F.lit(day(2)), 9).first().start == day(0)
