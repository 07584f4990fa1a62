"""Rolling, trailing and segment operators over an instrument's sessions, as column builders and DataFrame functions."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .exprs import by_instrument, col, ref, safe_div


def with_return(df: DataFrame) -> DataFrame:
    return df.withColumn("ret", safe_div("close", ref("close", 1)) - 1)


def rolling_regression(y, n: int) -> dict[str, Column]:
    """Slope, fit and last residual of y on the session number over n sessions that all have a value."""
    w, y, x = by_instrument(n), col(y), F.col("seq").cast("double")
    full = F.count(y).over(w) == n
    slope, base = F.regr_slope(y, x).over(w), F.regr_intercept(y, x).over(w)
    return {"slope": F.when(full, slope), "r2": F.when(full & (F.var_pop(y).over(w) > 1e-12), F.regr_r2(y, x).over(w)), "resid": F.when(full, y - base - slope * x)}


def since_extremum(x, n: int, largest: bool = True) -> Column:
    """Sessions since the window's first largest (smallest) value."""
    x, seq = col(x), F.col("seq")
    key = F.when(x.isNotNull(), F.struct((x if largest else -x).alias("v"), (-seq).alias("s")))
    return seq - F.max_by(seq, key).over(by_instrument(n))


def rolling_corr(a, b, n: int) -> Column:
    """Correlation over n full pairs; NULL where one side does not vary."""
    a, b, w = col(a), col(b), by_instrument(n)
    both = a.isNotNull() & b.isNotNull()
    varies = (F.var_pop(F.when(both, a)).over(w) > 1e-12) & (F.var_pop(F.when(both, b)).over(w) > 1e-12)
    return F.when((F.count(F.when(both, 1)).over(w) == n) & varies, F.corr(a, b).over(w))


def rolling_beta(y, x, n: int, least: int) -> Column:
    y, x, w = col(y), col(x), by_instrument(n)
    var = F.var_samp(F.when(y.isNotNull(), x)).over(w)
    return F.when((F.count(F.when(y.isNotNull() & x.isNotNull(), 1)).over(w) >= least) & (var > 1e-18), F.covar_samp(y, x).over(w) / var)


def ewm_std(x, n: int, half_life: float) -> Column:
    """Exponentially weighted deviation over n sessions. Weights rise with the session number, which cancels in the quotient;
    they stay finite for 1,000 half-lives."""
    x, w = col(x), by_instrument(n)
    weight = F.when(x.isNotNull(), F.pow(F.lit(2.0), F.col("seq") / half_life))
    total = F.sum(weight).over(w)
    mean = F.sum(weight * x).over(w) / total
    return F.when(total.isNotNull(), F.sqrt(F.greatest(F.sum(weight * x * x).over(w) / total - mean * mean, F.lit(0.0))))


def rolling_skew(x, n: int, least: int) -> Column:
    """Sample skewness of the values in n sessions."""
    x, w = col(x), by_instrument(n)
    k = F.count(x).over(w)
    return F.when((k >= least) & (F.var_pop(x).over(w) > 1e-18), F.skewness(x).over(w) * F.sqrt(k * (k - 1)) / (k - 2))


def rolling_least(x, n: int, least: int) -> Column:
    """Mean over n sessions of which `least` have a value."""
    w = by_instrument(n)
    return F.when(F.count(col(x)).over(w) >= least, F.avg(col(x)).over(w))


def segmented_index(df: DataFrame, ret: str, base: float = 100.0) -> DataFrame:
    """Compounded level that starts again after each session without a return; segment number and length so far."""
    seg = df.withColumn("segment", F.sum(F.when(F.col(ret).isNull(), 1).otherwise(0)).over(by_instrument().rowsBetween(Window.unboundedPreceding, 0)))
    w = Window.partitionBy("inst", "segment").orderBy("session").rowsBetween(Window.unboundedPreceding, 0)
    level = F.when(F.col(ret) > -1, base * F.exp(F.sum(F.when(F.col(ret) > -1, F.log1p(ret))).over(w))).when(F.col(ret).isNull(), base)
    return seg.withColumn("level", level).withColumn("observations", F.count(ret).over(w))


def runs(df: DataFrame, flag) -> DataFrame:
    """First session, last session and length of each unbroken run of true flags; an unknown flag ends a run."""
    w = by_instrument()
    x = df.withColumn("__f", F.coalesce(col(flag), F.lit(False)))
    x = x.withColumn("__run", F.sum(F.when(F.col("__f") & ~F.coalesce(F.lag("__f").over(w), F.lit(False)), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return x.filter("__f").groupBy("inst", "__run").agg(F.min("session").alias("start"), F.max("session").alias("stop"), F.count("*").alias("length")).drop("__run")


def dedupe_latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key by `order`."""
    return df.withColumn("__rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("__rn = 1").drop("__rn")


def revisions(df: DataFrame, keys: list[str], available: str, order: list[str]) -> DataFrame:
    """Revision number and the half-open validity [available, valid_to) of each record."""
    w = Window.partitionBy(*keys).orderBy(available, *order)
    return df.withColumn("revision", F.row_number().over(w)).withColumn("valid_to", F.lead(available).over(w))


def newey_west(df: DataFrame, entity: str, x: str, time: str, lags: int) -> DataFrame:
    """Mean, Bartlett standard error and t of each entity's series; missing values are passed over."""
    has, w = df.filter(F.col(x).isNotNull()), Window.partitionBy(entity)
    e = has.withColumn("__e", F.col(x) - F.avg(x).over(w))
    e = e.withColumns({f"__p{k}": F.col("__e") * F.lag("__e", k).over(w.orderBy(time)) for k in range(1, lags + 1)})
    total = F.sum(F.col("__e") * F.col("__e"))
    for k in range(1, lags + 1):
        total = total + 2 * (1 - k / (lags + 1)) * F.coalesce(F.sum(f"__p{k}"), F.lit(0.0))
    s = e.groupBy(entity).agg(F.count("*").alias("n"), F.avg(x).alias("mean"), total.alias("__v"))
    se = F.when((F.col("n") > 1) & (F.col("__v") > 1e-18), F.sqrt("__v") / F.col("n"))
    return s.select(entity, "n", "mean", se.alias("se"), (F.col("mean") / se).alias("t"))


def factor_jumps(df: DataFrame, factor: str, price: str) -> DataFrame:
    """Sessions at which the adjustment factor changes: its ratio to the session before, the price's inverse ratio, and their gap."""
    w = by_instrument()
    x = df.withColumns({"previous_session": F.lag("session").over(w), "ratio": safe_div(factor, F.lag(factor).over(w)), "price_ratio": safe_div(F.lag(price).over(w), price)})
    return x.filter(F.abs(F.col("ratio") - 1) > 1e-10).withColumn("error", F.col("price_ratio") - F.col("ratio"))


def crossings(df: DataFrame, flag) -> DataFrame:
    """Rows whose flag is true where the session before it was false; an unknown one is no crossing."""
    x = df.withColumn("_f", col(flag)).withColumn("_was", F.lag("_f").over(by_instrument()))
    return x.filter(F.col("_f") & ~F.col("_was")).drop("_f", "_was")


def worst_episode(df: DataFrame, level: str, n: int) -> DataFrame:
    """Per instrument: the trough of the deepest fall below the peak so far (the first of equals), its peak and recovery
    sessions, and the deepest fall below the peak of the last n sessions."""
    w = by_instrument()
    x = df.withColumn("_peak", F.max(level).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_dd", safe_div(level, "_peak") - 1).withColumn("_ddn", safe_div(level, F.max(level).over(by_instrument(n))) - 1)
    key = F.when(F.col("_dd").isNotNull(), F.struct("_dd", "session"))
    best = x.groupBy("inst").agg(F.min_by("session", key).alias("trough"), F.min("_dd").alias("worst"), F.min_by("_peak", key).alias("_top"), F.min("_ddn").alias(f"worst{n}"))
    at = df.select("inst", "session", level).join(best, "inst")
    sides = at.groupBy("inst").agg(
        F.max(F.when((F.col("session") <= F.col("trough")) & (F.col(level) == F.col("_top")), F.col("session"))).alias("peak_session"),
        F.min(F.when((F.col("session") > F.col("trough")) & (F.col(level) >= F.col("_top")), F.col("session"))).alias("recovered"),
    )
    return best.filter("trough is not null").join(sides, "inst").drop("_top")
