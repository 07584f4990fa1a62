import datetime as dt

import pytest
from pyspark.sql import functions as F

from panelwright.operators import panel as P
from panelwright.operators import research as R
from panelwright.operators import order_stats as O
from panelwright.operators import windows as V
from panelwright.operators.exprs import ref
from panelwright.plans import registry
from panelwright.sources import tables as T

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_matches_its_sql(spark, duck, same, name):
    assert same(registry.QUERIES[name](spark, SF).toPandas(), duck.sql(registry.ORACLES[name]).df())


def _bars(spark, closes):
    day = dt.date(2024, 1, 1)
    return spark.createDataFrame([(1, day + dt.timedelta(i), i + 1, c, c) for i, c in enumerate(closes)], "inst int, session date, seq int, open double, close double")


def test_a_missing_session_takes_its_place_in_the_window(spark):
    out = P.with_momentum(_bars(spark, [10.0, None, 12.0]), 2).orderBy("session").collect()
    assert [r.mom for r in out] == [None, None, pytest.approx(0.2)]


def test_looking_ahead_is_refused():
    with pytest.raises(ValueError):
        ref("close", -1)


def test_later_rows_do_not_change_past_momentum(spark):
    full, cut = (P.with_momentum(_bars(spark, c), 1).orderBy("session").collect() for c in ([1.0, 2.0, 3.0, 9.0], [1.0, 2.0, 3.0]))
    assert [r.mom for r in full][:3] == [r.mom for r in cut]


def test_benjamini_hochberg_by_hand(spark):
    df = spark.createDataFrame([("a", 0.01), ("a", 0.04), ("a", 0.03), ("a", None)], "f string, p double")
    got = {r.p: r.q for r in P.benjamini_hochberg(df, "p", "f").collect()}
    assert got[None] is None and got[0.01] == pytest.approx(0.03) and got[0.03] == got[0.04] == pytest.approx(0.04)


def test_as_of_join_does_not_see_the_same_day(spark):
    left = spark.createDataFrame([(1, dt.date(2024, 1, 2)), (1, dt.date(2024, 1, 3))], "inst int, session date")
    right = spark.createDataFrame([(1, dt.date(2024, 1, 2), 5.0)], "inst int, available date, value double")
    got = P.asof_strict(left, right, "inst", "session", "available", "value").orderBy("session").collect()
    assert [r.value for r in got] == [None, 5.0]


def test_unknown_flags_end_a_run(spark):
    df = _bars(spark, [2.0, 3.0, None, 4.0, 1.0]).withColumn("up", F.col("close") > 1.5)
    got = sorted((r.start.day, r.stop.day, r.length) for r in V.runs(df, "up").collect())
    assert got == [(1, 2, 2), (4, 4, 1)]


def test_a_segment_starts_again_after_a_gap(spark):
    df = V.segmented_index(V.with_return(_bars(spark, [10.0, 11.0, None, 20.0, 30.0])), "ret").orderBy("session").collect()
    assert [r.level for r in df] == [pytest.approx(x) for x in (100, 110, 100, 100, 150)]
    assert [r.observations for r in df] == [0, 1, 0, 0, 1]


def test_past_rank_leaves_today_out(spark):
    df = _bars(spark, [1.0, 2.0, 3.0, 2.0, None])
    got = [r.p for r in O.with_history_percentile(df, {"p": "close"}, 3, 1, past=True).orderBy("session").collect()]
    assert got == [None, 1.0, 1.0, pytest.approx(0.5), None]


def test_holm_by_hand(spark):
    df = spark.createDataFrame([("a", 0.01), ("a", 0.04), ("a", 0.03), ("a", None)], "f string, p double")
    got = {r.p: r.adjusted for r in R.holm(df, "p", "f").collect()}
    assert got == {0.01: pytest.approx(0.04), 0.03: pytest.approx(0.09), 0.04: pytest.approx(0.09), None: 1.0}


def test_turnover_counts_members_of_the_session_before(spark):
    day = dt.date(2024, 1, 1)
    df = spark.createDataFrame([(day + dt.timedelta(s), s, i) for s, names in enumerate([(1, 2), (2, 3), (4,)]) for i in names], "session date, seq int, inst int")
    got = [(r.n, r.retained, r.turnover) for r in R.retained_members(df).orderBy("seq").collect()]
    assert got == [(2, 0, None), (2, 1, 0.5), (1, 0, 1.0)]


def test_key_difference_names_the_side_and_takes_empty_tables(spark):
    a = spark.createDataFrame([(1,), (2,), (2,)], "k int")
    b = spark.createDataFrame([(2,), (3,)], "k int")
    assert sorted(map(tuple, R.key_difference(a, b, ["k"]).collect())) == [(1, "left"), (3, "right")]
    assert R.key_difference(a.limit(0), b.limit(0), ["k"]).count() == 0


def test_newey_west_without_lags_is_the_plain_error(spark):
    df = spark.createDataFrame([("a", i, x) for i, x in enumerate([1.0, 2.0, None, 6.0])], "e string, t int, x double")
    got = V.newey_west(df, "e", "x", "t", 0).first()
    assert (got.n, got["mean"]) == (3, 3.0) and got.se == pytest.approx((14**0.5) / 3)


def test_content_hash_tells_null_from_empty_text(spark):
    df = spark.createDataFrame([(1, None), (1, ""), (1, "x"), (1, "x")], "a int, b string")
    assert df.select(T.content_hash(["b", "a"]).alias("h")).distinct().count() == 3


def test_sorted_sink_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(2, "b"), (1, "a"), (2, None)], "k int, v string")
    T.write_sorted(df, str(tmp_path / "t"), ["v"], ["k"])
    assert sorted(map(str, spark.read.parquet(str(tmp_path / "t")).select("k", "v").collect())) == sorted(map(str, df.collect()))
