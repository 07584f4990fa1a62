"""Factors by users: values, availability of what they read, and refusals."""
import datetime as dt

import numpy as np
import pytest

from panelwright.operators import user_factors as U

DAY = dt.date(2021, 1, 1)
SCHEMA = "inst string, session date, close double, available_at timestamp"


def frame(spark, values, late=()):
    rows = [(k, DAY + dt.timedelta(i), v, dt.datetime(2021, 1, 1, 12) + dt.timedelta(i + (50 if (k, i) in late else 0))) for k, s in values.items() for i, v in enumerate(s)]
    return spark.createDataFrame(rows[::-1], SCHEMA)


def read(df):
    return {(r.inst, (r.session - DAY).days): (r.value, None if r.available_at is None else (r.available_at - dt.datetime(2021, 1, 1, 12)).days) for r in df.collect()}


def test_values_and_availability(spark):
    f = U.Factor("f", ["close"], 3, lambda h: h.now("close") - h.lag("close", 2))
    got = read(f(frame(spark, {"a": [1.0, 2.0, 4.0, 8.0, None], "b": [5.0]}, late={("a", 1)})))
    assert got == {("a", 0): (None, 0), ("a", 1): (None, 51), ("a", 2): (3.0, 2), ("a", 3): (6.0, 51), ("a", 4): (None, 4), ("b", 0): (None, 0)}


def test_windows_read_all_their_rows(spark):
    f = U.Factor("f", ["close"], 3, lambda h: h.mean("close", 3) + h.std("close", 3) * 0 + h.sum("close", 3) * 0)
    got = read(f(frame(spark, {"a": [3.0, 6.0, 9.0, None, 1.0, 2.0, 3.0]}, late={("a", 2)})))
    assert [got["a", i] for i in range(7)] == [(None, 0), (None, 1), (6.0, 52), (None, 52), (None, 52), (None, 5), (2.0, 6)]


def test_running_maximum_of_any_length():
    at = np.array([5, 1, 9, 2, 3, 0, 7], np.int64)
    for n in range(1, 8):
        h = U.History({"x": np.zeros(7)}, at, 7)
        h.window("x", n)
        assert h.touched.tolist() == [at[max(0, i - n + 1) : i + 1].max() for i in range(7)]


@pytest.mark.parametrize("bad, message", [(lambda h: h.lag("close", -1), "looks back"), (lambda h: h.lag("close", 4), "looks back"), (lambda h: h.mean("close", 0), "looks back"), (lambda h: h.now("volume"), "not declared"), (lambda h: np.zeros(1), "values for")])
def test_refusals(spark, bad, message):
    with pytest.raises(Exception, match=message):
        U.Factor("f", ["close"], 3, bad)(frame(spark, {"a": [1.0, 2.0, 3.0]})).collect()


def test_nothing_read_and_values_that_are_not_finite(spark):
    f = U.Factor("f", ["close"], 3, lambda h: np.full(len(h), np.inf))
    assert set(read(f(frame(spark, {"a": [1.0, 2.0]}))).values()) == {(None, None)}
    assert f(frame(spark, {"a": [1.0]}).limit(0)).count() == 0


def test_names_are_taken_once():
    U.factor(["close"], 1)(lambda h: h.now("close"))
    with pytest.raises(ValueError, match="already"):
        U.factor(["close"], 1)(lambda h: h.now("close"))
    del U.REGISTERED["<lambda>"]
