"""Panel operators: projections, joins in time, aggregates, windows, selections and audits, as DataFrame functions."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .exprs import average_rank, by_instrument, by_session, ref, rolling_full, rolling_partial, safe_div, safe_log, zscore


def with_momentum(df: DataFrame, n: int = 5) -> DataFrame:
    return df.withColumn("mom", safe_div("close", ref("close", n)) - 1)


def with_forward_return(df: DataFrame, h: int = 5) -> DataFrame:
    """Return from the next session's open to the close h sessions later, and why there is none."""
    w = by_instrument()
    entry, leave = F.lead("open", 1).over(w), F.lead("close", h + 1).over(w)
    out = df.withColumn("fwd", safe_div(leave, entry) - 1)
    reason = F.when(F.lead("seq", h + 1).over(w).isNull(), "no_exit_session").when(F.col("close").isNull(), "no_signal_bar").when(entry.isNull(), "no_entry_bar").when(leave.isNull(), "no_exit_bar").otherwise("valid")
    return out.withColumn("reason", reason)


def quality_flags(df: DataFrame) -> DataFrame:
    ok = (F.col("high") >= F.greatest("open", "close", "low")) & (F.col("low") <= F.least("open", "close"))
    return df.withColumn("valid_ohlc", F.coalesce(ok, F.lit(False))).withColumn("tradeable", F.coalesce(ok & (F.col("volume") > 0), F.lit(False)))


def rank_ic(df: DataFrame, factor: str = "mom", label: str = "fwd", least: int = 10) -> DataFrame:
    """Per session: correlation of average ranks of factor and label over rows that have both."""
    both = df.filter(F.col(factor).isNotNull() & F.col(label).isNotNull())
    r = both.select("session", average_rank(factor).alias("x"), average_rank(label).alias("y"))
    varies = (F.var_pop("x") > 1e-12) & (F.var_pop("y") > 1e-12)
    s = r.groupBy("session").agg(F.count("*").alias("n_pairs"), F.when(varies, F.covar_pop("x", "y") / F.sqrt(F.var_pop("x") * F.var_pop("y"))).alias("rank_ic"))
    return s.filter(F.col("n_pairs") >= least)


def quantile_means(df: DataFrame, factor: str, label: str, q: int = 5, least: int = 10) -> DataFrame:
    """Mean label per session and quantile of the factor's average rank; ties share a bucket."""
    both = df.filter(F.col(factor).isNotNull() & F.col(label).isNotNull())
    r = both.withColumn("r", average_rank(factor)).withColumn("n", F.count("*").over(by_session()))
    bucket = F.least(F.lit(q), F.floor((F.col("r") - 1) * q / F.col("n")) + 1).cast("int")
    return r.filter(F.col("n") >= least).groupBy("session", bucket.alias("bucket")).agg(F.avg(label).alias("mean_label"), F.count("*").alias("n"))


def quantile_buckets(df: DataFrame, factor: str, q: int = 5) -> DataFrame:
    """(session, inst, bucket) of rows with a factor, by average rank: ties share a bucket."""
    r = df.filter(F.col(factor).isNotNull()).withColumn("_r", average_rank(factor)).withColumn("_n", F.count("*").over(by_session()))
    return r.select("session", "inst", F.least(F.lit(q), F.floor((F.col("_r") - 1) * q / F.col("_n")) + 1).cast("int").alias("bucket"))


def median_mad(df: DataFrame, x: str) -> DataFrame:
    m = df.groupBy("session").agg(F.median(x).alias("median"))
    return df.join(m, "session").groupBy("session").agg(F.first("median").alias("median"), F.median(F.abs(F.col(x) - F.col("median"))).alias("mad"))


def winsorize_mad(df: DataFrame, x: str, k: float = 5 * 1.4826) -> DataFrame:
    """Clip to the session's median +- k MAD; a zero MAD keeps the value."""
    lo, hi = F.col("median") - k * F.col("mad"), F.col("median") + k * F.col("mad")
    return df.join(median_mad(df, x), "session").withColumn("clipped", F.when(F.col("mad") > 0, F.greatest(lo, F.least(hi, F.col(x)))).otherwise(F.col(x)))


def asof_strict(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, value: str) -> DataFrame:
    """Latest right value strictly before each left row: one union and one window, no range join."""
    a = left.select(F.col(key), F.col(left_time).alias("__t"), F.lit(0).alias("__side"), F.lit(None).cast(right.schema[value].dataType).alias("__v"), F.lit(None).cast(right.schema[right_time].dataType).alias("__vt"))
    b = right.select(F.col(key), F.col(right_time).alias("__t"), F.lit(1).alias("__side"), F.col(value).alias("__v"), F.col(right_time).alias("__vt"))
    w = Window.partitionBy(key).orderBy("__t", "__side", "__v").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col("__side") == 1, F.struct("__v", "__vt")), ignorenulls=True).over(w)
    return a.unionByName(b).withColumn("__l", last).filter("__side = 0").select(key, F.col("__t").alias(left_time), F.col("__l.__v").alias(value), F.col("__l.__vt").alias(right_time))


def select_as_of(df: DataFrame, key: str, cutoff: str, available: str, order: list[str]) -> DataFrame:
    """The latest record of each key that was available at the cutoff."""
    w = Window.partitionBy(key).orderBy(*(F.desc(c) for c in order))
    return df.filter(F.col(available) <= F.lit(cutoff).cast("date")).withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__rn")


def drawdown(df: DataFrame, level: str) -> DataFrame:
    peak = F.max(level).over(by_instrument().rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("drawdown", safe_div(level, peak) - 1)


def benjamini_hochberg(df: DataFrame, p: str, family: str) -> DataFrame:
    """Monotone adjusted p within each family; NULL p stays NULL and does not count."""
    has = df.filter(F.col(p).isNotNull())
    w = Window.partitionBy(family)
    r = has.withColumn("__r", F.row_number().over(w.orderBy(p))).withColumn("__q", F.col(p) * F.count("*").over(w) / F.col("__r"))
    adj = r.withColumn("q", F.least(F.lit(1.0), F.min("__q").over(w.orderBy("__r").rowsBetween(0, Window.unboundedFollowing)))).drop("__r", "__q")
    return adj.unionByName(df.filter(F.col(p).isNull()).withColumn("q", F.lit(None).cast("double")))


def top_k(df: DataFrame, score: str, k: int) -> DataFrame:
    """The k largest scores of each session, ties by the smaller instrument."""
    w = by_session().orderBy(F.desc(score), "inst")
    return df.filter(F.col(score).isNotNull()).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def market_return(df: DataFrame) -> DataFrame:
    r = df.withColumn("ret", safe_div("close", ref("close", 1)) - 1)
    return r.groupBy("session").agg(F.avg("ret").alias("market"), F.count("ret").alias("n"))


def entity_pairs(df: DataFrame, x: str) -> DataFrame:
    """Pearson correlation of each pair of instruments over the sessions both have. For entities that are few, as factors are."""
    a = df.filter(F.col(x).isNotNull()).select("session", F.col("inst").alias("left_id"), F.col(x).alias("a"))
    b = df.filter(F.col(x).isNotNull()).select("session", F.col("inst").alias("right_id"), F.col(x).alias("b"))
    varies = (F.var_pop("a") > 1e-9) & (F.var_pop("b") > 1e-9)
    j = a.join(b, "session").filter("left_id < right_id").groupBy("left_id", "right_id")
    return j.agg(F.count("*").alias("n"), F.when(varies, F.covar_pop("a", "b") / F.sqrt(F.var_pop("a") * F.var_pop("b"))).alias("corr"))


def zero_quote():
    """A row in which the vendor gives a price without any trade."""
    return F.coalesce((F.col("volume") == 0) & (F.col("amount") == 0) & (F.col("close") > 0), F.lit(False))


def adjusted(df: DataFrame, factor: str = "adj_factor") -> DataFrame:
    """Prices times a positive adjustment factor, volume over it, and the adjusted mean price; NULL without one."""
    f = F.when(F.col(factor) > 0, F.col(factor))
    out = df.withColumns({f"adj_{c}": F.col(c) * f for c in ("open", "high", "low", "close")})
    return out.withColumns({"adj_volume": safe_div("volume", f), "adj_vwap": safe_div("amount", "volume") * f})


def release_quality(df: DataFrame, factor: str, value: str, keys: list[str]) -> DataFrame:
    """Per factor: rows, finite values, values that are not finite, coverage, range, sessions, instruments, repeated keys."""
    finite = ~F.isnan(value) & (F.abs(value) < float("inf"))
    v = F.when(finite, F.col(value))
    return df.groupBy(factor).agg(
        F.count("*").alias("n_rows"), F.count(v).alias("present"), (F.count(value) - F.count(v)).alias("not_finite"), (F.count(v) / F.count("*")).alias("coverage"),
        F.min(v).alias("lowest"), F.max(v).alias("highest"), F.count_distinct("session").alias("sessions"), F.count_distinct("inst").alias("instruments"), (F.count("*") - F.count_distinct(*keys)).alias("duplicates"),
    )


__all__ = [n for n in dir() if not n.startswith("_")] + ["rolling_full", "rolling_partial", "safe_log", "zscore"]
