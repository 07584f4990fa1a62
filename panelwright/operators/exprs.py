"""Column builders: null-propagating arithmetic and windows over an instrument's sessions or a session's instruments."""
from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def by_instrument(n: int | None = None):
    w = Window.partitionBy("inst").orderBy("session")
    return w if n is None else w.rowsBetween(-(n - 1), 0)


def by_session(*more: str):
    return Window.partitionBy("session", *more)


def safe_div(a, b) -> Column:
    """NULL for a zero divisor or a result that is not finite."""
    return finite_or_null(F.try_divide(col(a), col(b)))


def safe_log(x) -> Column:
    return F.when(col(x) > 0, F.ln(col(x)))


def finite_or_null(x) -> Column:
    return F.when(~F.isnan(col(x)) & (F.abs(col(x)) < F.lit(float("inf"))), col(x))


def ref(x, n: int) -> Column:
    """The value n sessions ago; looking ahead is refused."""
    if n < 0:
        raise ValueError("ref looks back only")
    return F.lag(col(x), n).over(by_instrument())


def rolling_full(x, n: int, how: str = "avg") -> Column:
    """Mean, sum or population deviation over n sessions that all have a value."""
    f = {"avg": F.avg, "sum": F.sum, "std": F.stddev_pop}[how]
    return F.when(F.count(col(x)).over(by_instrument(n)) == n, f(col(x)).over(by_instrument(n)))


def rolling_partial(x, n: int, how: str) -> Column:
    f = {"avg": F.avg, "sum": F.sum, "min": F.min, "max": F.max, "std": F.stddev_samp}[how]
    return f(col(x)).over(by_instrument(n))


def average_rank(x, *more: str) -> Column:
    """Rank within the session, ties sharing their mean; NULL stays NULL and does not count."""
    x = col(x)
    rank = F.rank().over(by_session(*more).orderBy(x.asc_nulls_last()))
    return F.when(x.isNotNull(), rank + (F.count("*").over(Window.partitionBy("session", *more, x)) - 1) / 2)


def zscore(x, least: int = 10) -> Column:
    w = by_session()
    sd = F.stddev_pop(col(x)).over(w)
    return F.when((F.count(col(x)).over(w) >= least) & (sd > 1e-12), (col(x) - F.avg(col(x)).over(w)) / sd)


def mid_percentile(x, high_is_good: bool = True) -> Column:
    """Average rank less one over the members less one, a half where there is one member; of rows that all have x."""
    n = F.count("*").over(by_session())
    rank = F.rank().over(by_session().orderBy(col(x))) + (F.count("*").over(Window.partitionBy("session", col(x))) - 1) / 2
    p = (rank - 1) / F.nullif(n - 1, F.lit(0))
    return F.when(n <= 1, 0.5).otherwise(p if high_is_good else 1 - p)
