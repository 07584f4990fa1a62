"""Cross-sections, selections, reconciliations and research statistics as DataFrame functions."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .exprs import by_session, col, safe_div, zscore


def session_residual(y, x, *more: str) -> Column:
    """Residual of y on x within each session, over rows that have both; NULL where x does not vary."""
    y, x, w = col(y), col(x), by_session(*more)
    ok = y.isNotNull() & x.isNotNull()
    yy, xx = F.when(ok, y), F.when(ok, x)
    beta = F.when(F.var_pop(xx).over(w) > 1e-12, F.covar_pop(yy, xx).over(w) / F.var_pop(xx).over(w))
    return yy - F.avg(yy).over(w) - beta * (xx - F.avg(xx).over(w))


def industry_size_residual(df: DataFrame, y: str, x: str, industry: str) -> DataFrame:
    """y without its industry mean and without the pooled slope on x inside industries; column `residual`."""
    ok = F.col(y).isNotNull() & F.col(x).isNotNull()
    w = by_session(industry)
    d = df.withColumn("__y", F.when(ok, F.col(y)) - F.avg(F.when(ok, F.col(y))).over(w)).withColumn("__x", F.when(ok, F.col(x)) - F.avg(F.when(ok, F.col(x))).over(w))
    xx = F.sum(F.col("__x") * F.col("__x")).over(by_session())
    return d.withColumn("residual", F.when(xx > 1e-12, F.col("__y") - F.col("__x") * F.sum(F.col("__x") * F.col("__y")).over(by_session()) / xx)).drop("__x", "__y")


def winsorized_zscore(df: DataFrame, x: str, k: float = 5 * 1.4826) -> DataFrame:
    """z-score after clipping to the session's median +- k MAD."""
    from .panel import winsorize_mad

    clipped = winsorize_mad(df, x, k)
    return clipped.withColumn("z", zscore(F.when(F.col(x).isNotNull(), F.col("clipped"))))


def retained_members(held: DataFrame) -> DataFrame:
    """Per session of (session, seq, inst): members, members kept since the session before, and one-way turnover."""
    before = held.select((F.col("seq") + 1).alias("seq"), "inst", F.lit(1).alias("__kept"))
    now = held.join(before, ["seq", "inst"], "left").groupBy("session", "seq").agg(F.count("*").alias("n"), F.count("__kept").alias("retained"))
    sizes = now.select((F.col("seq") + 1).alias("seq"), F.col("n").alias("n_before"))
    out = now.join(sizes, "seq", "left")
    return out.withColumn("turnover", F.when(F.col("n_before").isNotNull(), 1 - F.col("retained") / F.greatest("n", "n_before")))


def observed_turnover(held: DataFrame) -> DataFrame:
    """Per session and bucket of (session, inst, bucket): members, and one-way turnover against the session observed before."""
    days = held.select("session").distinct().withColumn("_d", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("session")))  # a row a session
    h = held.join(F.broadcast(days), "session")
    before = h.select((F.col("_d") + 1).alias("_d"), "inst", "bucket", F.lit(1).alias("_kept"))
    now = h.join(before, ["_d", "inst", "bucket"], "left").groupBy("session", "_d", "bucket").agg(F.count("*").alias("n"), F.count("_kept").alias("_k"))
    sizes = now.select((F.col("_d") + 1).alias("_d"), "bucket", F.col("n").alias("_m"))
    out = now.join(sizes, ["_d", "bucket"], "left")
    return out.withColumn("turnover", F.when(F.col("_m").isNotNull(), 1 - F.col("_k") * F.least(1 / F.col("_m"), 1 / F.col("n")))).drop("_d", "_k", "_m")


def stability_summary(df: DataFrame, entity: str, x: str, time: str, parts: int) -> DataFrame:
    """Of the means of equal consecutive parts: share with the sign of the whole, worst in that direction, and range."""
    m = stability_segments(df, entity, x, time, parts)
    whole = df.filter(F.col(x).isNotNull()).groupBy(entity).agg(F.avg(x).alias("_all"))
    sign = F.when(F.col("_all") < 0, -1).otherwise(1)
    return m.join(whole, entity).groupBy(entity).agg(F.avg((F.signum("mean") == F.signum("_all")).cast("double")).alias("same_sign"), F.min(F.col("mean") * sign).alias("worst"), (F.max("mean") - F.min("mean")).alias("spread"))


def period_returns(df: DataFrame, entity: str, ret: str) -> DataFrame:
    """Compounded return by year (q 0) and by quarter; a total loss stays one."""
    has = df.filter(F.col(ret).isNotNull()).withColumns({"y": F.year("session").cast("long"), "q": F.explode(F.array(F.lit(0).cast("long"), F.quarter("session").cast("long")))})
    lost = F.min(ret) <= -1
    return has.groupBy(entity, "y", "q").agg(F.count("*").alias("n"), F.when(lost, -1.0).otherwise(F.exp(F.sum(F.when(F.col(ret) > -1, F.log1p(ret)))) - 1).alias("total"))


def holm(df: DataFrame, p: str, family: str) -> DataFrame:
    """Step-down adjusted p in each family; a missing p counts as 1."""
    w = Window.partitionBy(family)
    x = df.withColumn("__p", F.coalesce(p, F.lit(1.0))).withColumn("__r", F.row_number().over(w.orderBy(F.coalesce(p, F.lit(1.0)))))
    step = F.col("__p") * (F.count("*").over(w) - F.col("__r") + 1)
    return x.withColumn("__s", step).withColumn("adjusted", F.least(F.lit(1.0), F.max("__s").over(w.orderBy("__r").rowsBetween(Window.unboundedPreceding, 0)))).drop("__p", "__r", "__s")


def stability_segments(df: DataFrame, entity: str, x: str, time: str, parts: int) -> DataFrame:
    """Mean of x in equal consecutive parts of each entity's series."""
    w = Window.partitionBy(entity)
    has = df.filter(F.col(x).isNotNull()).withColumn("part", F.floor((F.row_number().over(w.orderBy(time)) - 1) * parts / F.count("*").over(w)))
    return has.groupBy(entity, "part").agg(F.count("*").alias("n"), F.avg(x).alias("mean"))


def performance(df: DataFrame, entity: str, ret: str, time: str, a_year: int) -> DataFrame:
    """Total return, yearly volatility, Sharpe ratio and deepest drawdown of each entity's returns. After a return of
    -100 % or less the level is 0 for good, so the total and the drawdown are -100 %."""
    w = Window.partitionBy(entity).orderBy(time).rowsBetween(Window.unboundedPreceding, 0)
    has = df.filter(F.col(ret).isNotNull())
    nav = has.withColumn("__lost", F.max(F.col(ret) <= -1).over(w)).withColumn("__l", F.sum(F.when(F.col(ret) > -1, F.log1p(ret))).over(w))
    fall = F.exp(F.col("__l") - F.greatest(F.max("__l").over(w), F.lit(0.0))) - 1
    nav = nav.withColumn("__d", F.when(F.col("__lost"), -1.0).otherwise(fall))
    total = F.when(F.max("__lost"), -1.0).otherwise(F.exp(F.sum(F.when(F.col(ret) > -1, F.log1p(ret)))) - 1)
    s = nav.groupBy(entity).agg(total.alias("total"), (F.stddev_samp(ret) * F.sqrt(F.lit(float(a_year)))).alias("volatility"), (F.avg(ret) * a_year).alias("__m"), F.min("__d").alias("max_drawdown"))
    return s.select(entity, "total", "volatility", safe_div("__m", "volatility").alias("sharpe"), "max_drawdown")


def key_difference(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of only one side, with the side's name: one shuffle for both directions."""
    both = a.select(*keys, F.lit(1).alias("__s")).unionByName(b.select(*keys, F.lit(2).alias("__s")))
    d = both.groupBy(*keys).agg(F.min("__s").alias("__lo"), F.max("__s").alias("__hi")).filter("__lo = __hi")
    return d.select(*keys, F.when(F.col("__lo") == 1, "left").otherwise("right").alias("side"))


def quantile_spread(df: DataFrame, score: str, label: str, k: int) -> DataFrame:
    """Mean label of the k largest scores less that of the k smallest, per session."""
    w = by_session()
    x = df.filter(F.col(score).isNotNull() & F.col(label).isNotNull()).withColumn("__t", F.row_number().over(w.orderBy(F.desc(score), "inst"))).withColumn("__b", F.row_number().over(w.orderBy(score, "inst")))
    return x.groupBy("session").agg((F.avg(F.when(F.col("__t") <= k, F.col(label))) - F.avg(F.when(F.col("__b") <= k, F.col(label)))).alias("spread"), F.count("*").alias("n"))


def capped_top_k(df: DataFrame, score: str, group: str, k: int, cap: int) -> DataFrame:
    """The k largest scores of each session with at most `cap` of a group."""
    x = df.filter(F.col(score).isNotNull()).withColumn("__g", F.row_number().over(by_session(group).orderBy(F.desc(score), "inst"))).filter(F.col("__g") <= cap)
    return x.withColumn("rank", F.row_number().over(by_session().orderBy(F.desc(score), "inst"))).filter(F.col("rank") <= k).drop("__g")
