"""Queries of the rolling and segment operators, with their SQL."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import order_stats as O
from ..operators import user_factors as U
from ..operators import windows as V
from ..operators.exprs import by_instrument, by_session, rolling_full, rolling_partial, safe_div, safe_log
from ..operators.panel import market_return
from .base import _N, _W, RET, panel, r
from .research_queries import table

_PAIR = "a.inst = b.inst and b.seq between a.seq - {0} and a.seq - {1}"


@panel("e4_rolling_regression", f"""select inst, session, round(case when count(close) {_N.format(19)} = 20 then regr_slope(close, seq) {_N.format(19)} end, 5) + 0.0 slope, round(case when count(close) {_N.format(19)} = 20 then regr_r2(close, seq) {_N.format(19)} end, 5) + 0.0 r2,
round(case when count(close) {_N.format(19)} = 20 then close - regr_intercept(close, seq) {_N.format(19)} - seq * regr_slope(close, seq) {_N.format(19)} end, 4) + 0.0 resid from bars""")
def e4(df):
    x = V.rolling_regression("close", 20)
    return df.select("inst", "session", r(x["slope"], 5).alias("slope"), r(x["r2"], 5).alias("r2"), r(x["resid"], 4).alias("resid"))


@panel("e6_rolling_ts_rank", f"select a.inst, a.session, round(case when a.close is not null then (count(case when b.close < a.close then 1 end) + count(case when b.close = a.close then 1 end) / 2.0) / count(b.close) end, 6) + 0.0 ts_rank from bars a join bars b on {_PAIR.format(19, 0)} group by a.inst, a.session, a.close")
def e6(df):
    return O.with_history_percentile(df, {"p": "close"}, 20, 1).select("inst", "session", r("p").alias("ts_rank"))


@panel("e7_rolling_argmax", f"w as (select *, max(high) {_N.format(19)} mx from bars) select a.inst, a.session, coalesce(a.seq - min(b.seq), -1) age from w a left join bars b on {_PAIR.format(19, 0)} and b.high = a.mx group by a.inst, a.session, a.seq")
def e7(df):
    return df.select("inst", "session", F.coalesce(V.since_extremum("high", 20), F.lit(-1)).alias("age"))


@panel("e8_rolling_corr", f"v as (select *, case when volume > 0 then ln(volume) end lv from bars) select inst, session, round(case when count(close * lv) {_N.format(19)} = 20 then corr(close, lv) {_N.format(19)} end, 5) + 0.0 corr from v")
def e8(df):
    return df.withColumn("lv", safe_log("volume")).select("inst", "session", r(V.rolling_corr("close", "lv", 20), 5).alias("corr"))


@panel("e9_rolling_beta", f"{RET}, m as (select session, avg(ret) mkt from ret group by 1), j as (select ret.*, mkt from ret join m using (session)) select inst, session, round(case when count(ret) {_N.format(59)} >= 30 then covar_samp(ret, mkt) {_N.format(59)} / var_samp(case when ret is not null then mkt end) {_N.format(59)} end, 5) + 0.0 beta from j")
def e9(df):
    x = V.with_return(df).join(market_return(df).drop("n"), "session")
    return x.select("inst", "session", r(V.rolling_beta("ret", "market", 60, 30), 5).alias("beta"))


@panel("e10_ewm_std", f"""{RET}, p as (select a.inst, a.session, b.ret x, power(0.5::double, (a.seq - b.seq) / 42.0) w from ret a join ret b on {_PAIR.format(59, 0)}), m as (select *, sum(case when x is not null then w * x end) over (partition by inst, session) / sum(case when x is not null then w end) over (partition by inst, session) mu from p)
select inst, session, round(sqrt(sum(w * (x - mu) * (x - mu)) / sum(case when x is not null then w end)), 4) + 0.0 ewm from m group by 1, 2""")
def e10(df):
    return V.with_return(df).select("inst", "session", r(V.ewm_std("ret", 60, 42.0), 4).alias("ewm"))


@panel("e11_rolling_skew", f"{RET} select inst, session, round(case when count(ret) {_N.format(59)} >= 20 then skewness(ret) {_N.format(59)} end, 5) + 0.0 skew from ret")
def e11(df):
    return V.with_return(df).select("inst", "session", r(V.rolling_skew("ret", 60, 20), 5).alias("skew"))


@panel("e12_history_percentile", f"select a.inst, a.session, round(case when a.close is not null and count(b.close) >= 60 then (count(case when b.close < a.close then 1 end) + count(case when b.close = a.close then 1 end) / 2.0) / count(b.close) end, 6) + 0.0 pct from bars a join bars b on {_PAIR.format(251, 0)} group by a.inst, a.session, a.close")
def e12(df):
    return O.with_history_percentile(df, {"p": "close"}, 252, 60).select("inst", "session", r("p").alias("pct"))


@panel("e13_past_rank", f"select a.inst, a.session, round(case when a.close is not null and count(b.close) >= 60 then (count(case when b.close < a.close then 1 end) + count(case when b.close = a.close then 1 end) / 2.0) / count(b.close) end, 6) + 0.0 pct from bars a left join bars b on {_PAIR.format(120, 1)} group by a.inst, a.session, a.close")
def e13(df):
    return O.with_history_percentile(df, {"p": "close"}, 120, 60, past=True).select("inst", "session", r("p").alias("pct"))


# ---- factors by users: two that the library has too


@U.factor(["close"], 5)
def user_momentum(h):
    return U.safe_div(h.now("close"), h.lag("close", 5)) - 1


@U.factor(["close", "volume"], 20)
def user_average_gap(h):
    """Close against its mean of 20 sessions, by the share of today's volume in theirs."""
    return (U.safe_div(h.now("close"), h.mean("close", 20)) - 1) * U.safe_div(h.now("volume"), h.sum("volume", 20))


def with_availability(df):
    """Bars with the time at which each was available: some come weeks late."""
    return df.withColumn("available_at", F.date_add("session", F.when((F.col("inst") + F.col("seq")) % 11 == 0, 40).otherwise(1)))


_AVAILABLE = "av as (select *, session + case when (inst + seq) % 11 = 0 then 40 else 1 end known from bars)"


@panel("s14_user_momentum", f"{_AVAILABLE} select inst, session, round(close / nullif(lag(close, 5) {_W}, 0) - 1, 6) + 0.0 as value, cast(greatest(known, lag(known, 5) {_W}) as varchar) available from av")
def s14_momentum(df):
    return user_momentum(with_availability(df)).select("inst", "session", r("value").alias("value"), F.to_date("available_at").cast("string").alias("available"))


@panel("s14_user_average_gap", f"{_AVAILABLE} select inst, session, round(case when count(close) {_N.format(19)} = 20 and count(volume) {_N.format(19)} = 20 then (close / avg(close) {_N.format(19)} - 1) * volume / sum(volume) {_N.format(19)} end, 6) + 0.0 as value, cast(max(known) {_N.format(19)} as varchar) available from av")
def s14_gap(df):
    return user_average_gap(with_availability(df)).select("inst", "session", r("value").alias("value"), F.to_date("available_at").cast("string").alias("available"))


# ---- three years of days: the windows that the weekly bars are too short for


def daily(spark, sf_dir):
    """One price a day of each instrument, from all lines; days without a line are missing from its series."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").filter("l_quantity > 0")
    day = li.groupBy((F.col("l_suppkey") % 20).cast("int").alias("inst"), F.col("l_shipdate").cast("date").alias("session"))
    return day.agg(F.sum("l_extendedprice").cast("double").alias("amt"), F.sum("l_quantity").cast("double").alias("qty")).select("inst", "session", r(F.col("amt") / F.col("qty"), 2).alias("close"))


_DAILY = "dl as (select cast(l_suppkey % 20 as int) inst, cast(l_shipdate as date) as session, round(sum(l_extendedprice)::double / sum(l_quantity)::double, 2) + 0.0 as close from lineitem where l_quantity > 0 group by 1, 2), dn as (select *, row_number() over (partition by inst order by session) i from dl)"
_THREE_YEARS = "select a.inst, a.session, round(case when count(b.close) >= 504 then (count(case when b.close < a.close then 1 end) + count(case when b.close = a.close then 1 end) / 2.0::double) / count(b.close) end, 6) + 0.0 pct from dn a left join dn b on a.inst = b.inst and b.i between a.i - {} and a.i - {} group by a.inst, a.session, a.close"


@table("e12_history_percentile_three_years", f"with {_DAILY} " + _THREE_YEARS.format(755, 0), ("session",), False)
def e12_long(spark, sf_dir):
    return O.with_history_percentile(daily(spark, sf_dir), {"p": "close"}, 756, 504).select("inst", "session", r("p").alias("pct"))


@table("e13_past_rank_three_years", f"with {_DAILY} " + _THREE_YEARS.format(756, 1), ("session",), False)
def e13_long(spark, sf_dir):
    return O.with_history_percentile(daily(spark, sf_dir), {"p": "close"}, 756, 504, past=True).select("inst", "session", r("p").alias("pct"))


@panel("e14_segmented_index", f"""{RET}, s as (select *, sum(case when ret is null then 1 else 0 end) over (partition by inst order by session) segment from ret)
select inst, session, cast(segment as bigint) segment, round(case when ret is null then 100 else 100 * exp(sum(ln(1 + ret)) over (partition by inst, segment order by session)) end, 4) + 0.0 as level, count(ret) over (partition by inst, segment order by session) observations from s""")
def e14(df):
    return V.segmented_index(V.with_return(df), "ret").select("inst", "session", "segment", r("level", 4).alias("level"), "observations")


@panel("e17_mid_percentile", "k as (select *, rank() over (partition by session order by close) + (count(*) over (partition by session, close) - 1) / 2.0 ar, count(*) over (partition by session) n from bars where close is not null) select inst, session, round(case when n <= 1 then 0.5 else (ar - 1) / (n - 1) end, 6) + 0.0 mid from k")
def e17(df):
    from ..operators.panel import average_rank

    x = df.filter("close is not null")
    n = F.count("*").over(by_session())
    return x.select("inst", "session", r(F.when(n <= 1, 0.5).otherwise((average_rank("close") - 1) / (n - 1))).alias("mid"))


@panel("e19_filtered_cross_stat", "select inst, session, round(avg(close) filter (close > open) over (partition by session), 5) + 0.0 mean_up, count(*) filter (close > open) over (partition by session) n_up from bars")
def e19(df):
    up = F.when(F.col("close") > F.col("open"), F.col("close"))
    return df.select("inst", "session", r(F.avg(up).over(by_session()), 5).alias("mean_up"), F.count(up).over(by_session()).alias("n_up"))


@panel("e20_session_ordinal", "select inst, session, row_number() over (partition by inst order by session) ordinal from bars where close is not null")
def e20(df):
    return df.filter("close is not null").select("inst", "session", F.row_number().over(by_instrument()).cast("long").alias("ordinal"))


@panel("e24_trailing_compound_breadth", f"{RET}, t as (select session, case when count(ret) {_N.format(9)} = 10 then sum(ln(1 + ret)) {_N.format(9)} end s from ret) select session, count(s) n, round(avg(case when s > 0 then 1.0 when s is not null then 0.0 end), 6) + 0.0 up_share from t group by session")
def e24(df):
    x = V.with_return(df).select("session", rolling_full(F.log1p("ret"), 10, "sum").alias("s"))
    return x.groupBy("session").agg(F.count("s").alias("n"), r(F.avg(F.when(F.col("s").isNotNull(), (F.col("s") > 0).cast("double")))).alias("up_share"))


@panel("e25_moving_average_gap", f"select inst, session, round(case when count(close) {_N.format(29)} = 30 then close / avg(close) {_N.format(29)} - 1 end, 6) + 0.0 gap from bars")
def e25(df):
    return df.select("inst", "session", r(safe_div("close", rolling_full("close", 30)) - 1).alias("gap"))


@panel("e27_gaps_islands_runs", """f as (select inst, session, seq from bars where close > open), g as (select *, seq - row_number() over (partition by inst order by seq) island from f)
select inst, min(session) start, max(session) stop, count(*) length from g group by inst, island""", ("start", "stop"))
def e27(df):
    return V.runs(df, F.col("close") > F.col("open"))


@panel("e28_turnover_activity", f"a as (select session, case when count(volume) {_N.format(19)} >= 15 then avg(volume) {_N.format(19)} end / case when count(volume) {_N.format(59)} >= 45 then avg(volume) {_N.format(59)} end ratio from bars) select session, count(ratio) n, round(median(ratio), 5) + 0.0 med, round(avg(case when ratio > 1 then 1.0 when ratio is not null then 0.0 end), 6) + 0.0 breadth from a group by session")
def e28(df):
    x = df.select("session", safe_div(V.rolling_least("volume", 20, 15), V.rolling_least("volume", 60, 45)).alias("ratio"))
    return x.groupBy("session").agg(F.count("ratio").alias("n"), r(F.median("ratio"), 5).alias("med"), r(F.avg(F.when(F.col("ratio").isNotNull(), (F.col("ratio") > 1).cast("double")))).alias("breadth"))


@panel("h3_trend", f"select inst, session, round(lag(close, 20) {_W} / close, 5) + 0.0 roc20, round(avg(close) {_N.format(19)} / close, 5) + 0.0 ma20, round(stddev_samp(close) {_N.format(19)} / close, 5) + 0.0 std20, round(regr_slope(close, seq) {_N.format(19)} / close, 5) + 0.0 beta20 from bars")
def h3(df):
    w = by_instrument(20)
    slope = F.regr_slope(F.col("close"), F.col("seq").cast("double")).over(w)
    return df.select("inst", "session", r(safe_div(F.lag("close", 20).over(by_instrument()), "close"), 5).alias("roc20"), r(safe_div(rolling_partial("close", 20, "avg"), "close"), 5).alias("ma20"), r(safe_div(rolling_partial("close", 20, "std"), "close"), 5).alias("std20"), r(safe_div(slope, "close"), 5).alias("beta20"))


@panel("h4_extremes", f"select inst, session, round(max(high) {_N.format(9)} / close, 5) + 0.0 max10, round(min(low) {_N.format(9)} / close, 5) + 0.0 min10, round((close - min(low) {_N.format(9)}) / (max(high) {_N.format(9)} - min(low) {_N.format(9)} + 1e-12), 5) + 0.0 rsv10 from bars")
def h4(df):
    hi, lo = rolling_partial("high", 10, "max"), rolling_partial("low", 10, "min")
    return df.select("inst", "session", r(safe_div(hi, "close"), 5).alias("max10"), r(safe_div(lo, "close"), 5).alias("min10"), r(safe_div(F.col("close") - lo, hi - lo + 1e-12), 5).alias("rsv10"))


@panel("h6_up_down_counts", f"d as (select *, close - lag(close) {_W} ch from bars) select inst, session, round(avg(case when ch > 0 then 1.0 when ch is not null then 0.0 end) {_N.format(19)}, 6) + 0.0 cntp, round(sum(greatest(ch, 0)) {_N.format(19)} / (sum(abs(ch)) {_N.format(19)} + 1e-12), 6) + 0.0 sump from d")
def h6(df):
    x = df.withColumn("ch", F.col("close") - F.lag("close").over(by_instrument()))
    up = F.when(F.col("ch").isNotNull(), (F.col("ch") > 0).cast("double"))
    gain = F.when(F.col("ch").isNotNull(), F.greatest("ch", F.lit(0.0)))
    return x.select("inst", "session", r(rolling_partial(up, 20, "avg")).alias("cntp"), r(safe_div(rolling_partial(gain, 20, "sum"), rolling_partial(F.abs("ch"), 20, "sum") + 1e-12)).alias("sump"))


@panel("h7_volume", f"select inst, session, round(avg(volume) {_N.format(19)} / (volume + 1e-12), 5) + 0.0 vma20, round(stddev_samp(volume) {_N.format(19)} / (volume + 1e-12), 5) + 0.0 vstd20 from bars")
def h7(df):
    v = F.col("volume") + 1e-12
    return df.select("inst", "session", r(safe_div(rolling_partial("volume", 20, "avg"), v), 5).alias("vma20"), r(safe_div(rolling_partial("volume", 20, "std"), v), 5).alias("vstd20"))


@panel("h8_native_seeds", f"{RET} select inst, session, round(open / lag(close) {_W} - 1, 6) + 0.0 gap, round(case when count(ret / amount) {_N.format(9)} = 10 then 1e6 * avg(abs(ret) / amount) {_N.format(9)} end, 5) + 0.0 amihud10 from ret")
def h8(df):
    x = V.with_return(df)
    return x.select("inst", "session", r(safe_div("open", F.lag("close").over(by_instrument())) - 1).alias("gap"), r(1e6 * rolling_full(safe_div(F.abs("ret"), "amount"), 10), 5).alias("amihud10"))


@panel("j14_newey_west_mean", f"""{RET}, e as (select inst, session, ret, ret - avg(ret) over (partition by inst) e from ret where ret is not null), l as (select *, e * lag(e, 1) {_W} p1, e * lag(e, 2) {_W} p2, e * lag(e, 3) {_W} p3 from e),
s as (select inst, count(*) n, avg(ret) mean, sum(e * e) + 2 * (0.75::double * coalesce(sum(p1), 0) + 0.5::double * coalesce(sum(p2), 0) + 0.25::double * coalesce(sum(p3), 0)) v from l group by inst)
select inst, n, round(mean, 6) + 0.0 mean, round(sqrt(case when v > 1e-18 and n > 1 then v end) / n, 6) + 0.0 se, round(mean / (sqrt(case when v > 1e-18 and n > 1 then v end) / n), 5) + 0.0 t from s""", ())
def j14(df):
    return V.newey_west(V.with_return(df), "inst", "ret", "session", 3).select("inst", "n", r("mean").alias("mean"), r("se").alias("se"), r("t", 5).alias("t"))
