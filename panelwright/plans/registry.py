"""All queries of the panel operators over the test panel, with their SQL counterparts."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import gates as G
from ..operators import panel as P
from ..operators.exprs import by_instrument, by_session, rolling_full, rolling_partial, safe_div, safe_log, zscore
from ..sources.fixture import bars, oracle
from .base import _N, _W, _sql_r, DATED, FWD, MOM, ORACLES, QUERIES, RET, panel, r


def both(df):
    return P.with_forward_return(P.with_momentum(df))


@panel("b1_market_daily", "select inst, session, coalesce(high >= greatest(open, close, low) and low <= least(open, close), false) valid_ohlc, coalesce(high >= greatest(open, close, low) and low <= least(open, close) and volume > 0, false) tradeable, volume * 100 shares from bars")
def b1(df):
    return P.quality_flags(df).select("inst", "session", "valid_ohlc", "tradeable", (F.col("volume") * 100).alias("shares"))


@panel("b2_tradable_split", "select coalesce(volume > 0, false) tradeable, count(*) n from bars group by 1")
def b2(df):
    return P.quality_flags(df).groupBy(F.col("tradeable")).agg(F.count("*").alias("n"))


@panel("b7_safe_arith", "select inst, session, round(case when volume <> 0 then amount / volume end, 4) + 0.0 vwap, round(case when volume > 0 then ln(volume) end, 6) + 0.0 log_volume from bars")
def b7(df):
    return df.select("inst", "session", r(safe_div("amount", "volume"), 4).alias("vwap"), r(safe_log("volume")).alias("log_volume"))


@panel("b9_signal_clock", "select distinct session, cast(session as timestamp) + interval 7 hours as available_at from bars")
def b9(df):
    return df.select("session", F.convert_timezone(F.lit("Asia/Shanghai"), F.lit("UTC"), F.col("session").cast("timestamp_ntz") + F.expr("interval 15 hours")).alias("available_at")).distinct()


@panel("d1_conditional_counts", "select session, count(close) n_bars, count(case when close > open then 1 end) n_up, round(avg(case when close > open then close / open - 1 end), 6) + 0.0 mean_up from bars group by session")
def d1(df):
    up = F.col("close") > F.col("open")
    return df.groupBy("session").agg(F.count("close").alias("n_bars"), F.count(F.when(up, 1)).alias("n_up"), r(F.avg(F.when(up, safe_div("close", "open") - 1))).alias("mean_up"))


@panel("d2_median_mad", "m as (select session, median(close) med from bars group by session) select session, round(min(med), 6) + 0.0 as median, round(median(abs(close - med)), 6) + 0.0 mad from bars join m using (session) group by session")
def d2(df):
    return P.median_mad(df, "close").select("session", r("median").alias("median"), r("mad").alias("mad"))


@panel("d4_quantile_bucket_means", f"""{MOM}, {FWD}, k as (select session, fwd, rank() over (partition by session order by mom) + (count(*) over (partition by session, mom) - 1) / 2.0 r, count(*) over (partition by session) n from fwd where mom is not null and fwd is not null)
select session, cast(least(5, floor((r - 1) * 5 / n) + 1) as int) bucket, round(avg(fwd), 6) + 0.0 mean_label, count(*) n from k where n >= 10 group by 1, 2""")
def d4(df):
    return P.quantile_means(both(df), "mom", "fwd").select("session", "bucket", r("mean_label").alias("mean_label"), "n")


@panel("d8_breadth", f"{RET} select session, round(avg(case when ret > 0 then 1.0 when ret is not null then 0.0 end), 6) + 0.0 breadth, count(ret) n_valid from ret group by session")
def d8(df):
    x = df.withColumn("ret", safe_div("close", F.lag("close", 1).over(by_instrument())) - 1)
    return x.groupBy("session").agg(r(F.avg(F.when(F.col("ret").isNotNull(), (F.col("ret") > 0).cast("double")))).alias("breadth"), F.count("ret").alias("n_valid"))


@panel("d9_dispersion_iqr", "select session, round(quantile_cont(close, 0.75) - quantile_cont(close, 0.25), 6) + 0.0 iqr from bars group by session")
def d9(df):
    return df.groupBy("session").agg(r(F.percentile("close", F.lit(0.75)) - F.percentile("close", F.lit(0.25))).alias("iqr"))


@panel("d14_month_end_sessions", "select year(session) y, month(session) m, max(session) last_session from bars group by 1, 2")
def d14(df):
    return df.groupBy(F.year("session").cast("long").alias("y"), F.month("session").cast("long").alias("m")).agg(F.max("session").alias("last_session"))


@panel("d15_equal_weight_index", f"{RET} select session, round(avg(ret), 6) + 0.0 market, count(ret) n from ret group by session")
def d15(df):
    return P.market_return(df).select("session", r("market").alias("market"), "n")


@panel("e1_ref_lag", f"{MOM} select inst, session, round(mom, 6) + 0.0 mom from mom")
def e1(df):
    return P.with_momentum(df).select("inst", "session", r("mom").alias("mom"))


@panel("e2_rolling_full", f"select inst, session, round(case when count(close) {_N.format(19)} = 20 then avg(close) {_N.format(19)} end, 6) + 0.0 mean20, round(case when count(close) {_N.format(19)} = 20 then stddev_pop(close) {_N.format(19)} end, 6) + 0.0 std20 from bars")
def e2(df):
    return df.select("inst", "session", r(rolling_full("close", 20)).alias("mean20"), r(rolling_full("close", 20, "std")).alias("std20"))


@panel("e3_rolling_partial", f"select inst, session, round(min(low) {_N.format(9)}, 6) + 0.0 low10, round(max(high) {_N.format(9)}, 6) + 0.0 high10, round(avg(close) {_N.format(9)}, 6) + 0.0 mean10 from bars")
def e3(df):
    return df.select("inst", "session", r(rolling_partial("low", 10, "min")).alias("low10"), r(rolling_partial("high", 10, "max")).alias("high10"), r(rolling_partial("close", 10, "avg")).alias("mean10"))


@panel("e5_rolling_quantile", f"select inst, session, round(quantile_cont(close, 0.8) {_N.format(19)}, 6) + 0.0 q80 from bars")
def e5(df):
    return df.select("inst", "session", r(F.percentile("close", F.lit(0.8)).over(by_instrument(20))).alias("q80"))


@panel("e15_cross_avg_rank", f"{MOM} select inst, session, rank() over (partition by session order by mom) + (count(*) over (partition by session, mom) - 1) / 2.0 avg_rank from mom where mom is not null")
def e15(df):
    x = P.with_momentum(df).filter("mom is not null")
    return x.select("inst", "session", P.average_rank("mom").alias("avg_rank"))


@panel("e16_cross_percent_rank", "select inst, session, round(percent_rank() over (partition by session order by close), 6) + 0.0 pr from bars where close is not null")
def e16(df):
    return df.filter("close is not null").select("inst", "session", r(F.percent_rank().over(by_session().orderBy("close"))).alias("pr"))


@panel("e18_cross_zscore", f"{MOM} select inst, session, round(case when count(mom) over (partition by session) >= 10 and stddev_pop(mom) over (partition by session) > 1e-12 then (mom - avg(mom) over (partition by session)) / stddev_pop(mom) over (partition by session) end, 6) + 0.0 z from mom")
def e18(df):
    return P.with_momentum(df).select("inst", "session", r(zscore("mom")).alias("z"))


@panel("e26_drawdown", f"select inst, session, round(close / max(close) over (partition by inst order by session rows between unbounded preceding and current row) - 1, 6) + 0.0 drawdown from bars")
def e26(df):
    return P.drawdown(df, "close").select("inst", "session", r("drawdown").alias("drawdown"))


@panel("f2_top_k_per_session", f"{MOM} select session, inst, rank from (select *, row_number() over (partition by session order by mom desc, inst) rank from mom where mom is not null) where rank <= 3")
def f2(df):
    return P.top_k(P.with_momentum(df), "mom", 3).select("session", "inst", F.col("rank").cast("long").alias("rank"))


@panel("h1_kbar", "select inst, session, round((close - open) / open, 6) + 0.0 kmid, round((high - low) / open, 6) + 0.0 klen, round((close - open) / (high - low + 1e-12), 6) + 0.0 kmid2, round((high - greatest(open, close)) / open, 6) + 0.0 kup, round((least(open, close) - low) / open, 6) + 0.0 klow, round((2 * close - high - low) / open, 6) + 0.0 ksft from bars")
def h1(df):
    o, h, lo, c = (F.col(x) for x in ("open", "high", "low", "close"))
    return df.select("inst", "session", r(safe_div(c - o, o)).alias("kmid"), r(safe_div(h - lo, o)).alias("klen"), r(safe_div(c - o, h - lo + 1e-12)).alias("kmid2"), r(safe_div(h - F.greatest(o, c), o)).alias("kup"), r(safe_div(F.least(o, c) - lo, o)).alias("klow"), r(safe_div(2 * c - h - lo, o)).alias("ksft"))


@panel("h2_price", "select inst, session, round(open / close, 6) + 0.0 open0, round(high / close, 6) + 0.0 high0, round(low / close, 6) + 0.0 low0, round(amount / volume / close, 6) + 0.0 vwap0 from bars")
def h2(df):
    return df.select("inst", "session", *(r(safe_div(x, "close")).alias(f"{x}0") for x in ("open", "high", "low")), r(safe_div(safe_div("amount", "volume"), "close")).alias("vwap0"))


@panel("j1_winsorize_mad", "m as (select session, median(close) med from bars group by session), d as (select session, min(med) med, median(abs(close - med)) mad from bars join m using (session) group by session) select inst, session, round(case when mad > 0 and close is not null then greatest(med - 7.413 * mad, least(med + 7.413 * mad, close)) else close end, 6) + 0.0 clipped from bars join d using (session)")
def j1(df):
    return P.winsorize_mad(df, "close").select("inst", "session", r(F.when(F.col("close").isNotNull(), F.col("clipped"))).alias("clipped"))


@panel("j5_forward_label", f"{MOM}, {FWD} select inst, session, round(fwd, 6) + 0.0 fwd, case when lead(seq, 6) {_W} is null then 'no_exit_session' when close is null then 'no_signal_bar' when lead(open, 1) {_W} is null then 'no_entry_bar' when lead(close, 6) {_W} is null then 'no_exit_bar' else 'valid' end reason from fwd")
def j5(df):
    return both(df).select("inst", "session", r("fwd").alias("fwd"), "reason")


_IC = f"""{MOM}, {FWD}, k as (select session, rank() over (partition by session order by mom) + (count(*) over (partition by session, mom) - 1) / 2.0 x, rank() over (partition by session order by fwd) + (count(*) over (partition by session, fwd) - 1) / 2.0 y from fwd where mom is not null and fwd is not null)"""


@panel("j10_rank_ic", f"{_IC} select session, count(*) n_pairs, round(corr(x, y), 6) + 0.0 rank_ic from k group by session having count(*) >= 10")
def j10(df):
    return P.rank_ic(both(df)).select("session", "n_pairs", r("rank_ic").alias("rank_ic"))


@panel("j9_coverage", f"{MOM}, {FWD} select session, count(*) universe, count(mom) present, count(fwd) labelled, count(case when mom is not null and fwd is not null then 1 end) paired from fwd group by session")
def j9(df):
    return both(df).groupBy("session").agg(F.count("*").alias("universe"), F.count("mom").alias("present"), F.count("fwd").alias("labelled"), F.count(F.when(F.col("mom").isNotNull() & F.col("fwd").isNotNull(), 1)).alias("paired"))


@panel("c17_entity_pair_join", f"{RET}, p as (select a.inst left_id, b.inst right_id, a.ret a, b.ret b from ret a join ret b using (session) where a.inst < b.inst and a.ret is not null and b.ret is not null) select left_id, right_id, count(*) n, round(corr(a, b), 6) + 0.0 corr from p group by 1, 2")
def c17(df):
    x = df.withColumn("ret", safe_div("close", F.lag("close", 1).over(by_instrument())) - 1)
    return P.entity_pairs(x, "ret").select("left_id", "right_id", "n", r("corr").alias("corr"))


@panel("l1_audit_market", "select 'ohlc' as check_name, count(*) violations from bars where high < greatest(open, close, low) or low > least(open, close) union all select 'negative_volume', count(*) from bars where volume < 0 or amount < 0 union all select 'duplicate_key', count(*) from (select inst, session from bars group by 1, 2 having count(*) > 1) d")
def l1(df):
    rules = {"ohlc": (F.col("high") < F.greatest("open", "close", "low")) | (F.col("low") > F.least("open", "close")), "negative_volume": (F.col("volume") < 0) | (F.col("amount") < 0)}
    return G.all_of(G.count_rules(df, rules), G.repeated_keys(df, ["inst", "session"]))


def _facts(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    end = F.last_day(F.add_months(F.date_trunc("quarter", "o_orderdate"), 2)).cast("date")
    return o.select((F.col("o_custkey") % 20).cast("int").alias("inst"), end.alias("period_end"), F.date_add(end, (F.col("o_orderkey") % 60).cast("int")).alias("available"), F.col("o_totalprice").cast("double").alias("value"), "o_orderkey")


_FACTS = "facts as (select cast(o_custkey % 20 as int) inst, cast(last_day(date_trunc('quarter', o_orderdate) + interval 2 months) as date) period_end, cast(last_day(date_trunc('quarter', o_orderdate) + interval 2 months) as date) + cast(o_orderkey % 60 as int) available, cast(o_totalprice as double) as value, o_orderkey from orders)"


def c5_asof_strict_join(spark, sf_dir):
    facts = _facts(spark, sf_dir).groupBy("inst", "available").agg(F.max("value").alias("value"))
    return P.asof_strict(bars(spark, sf_dir).select("inst", "session"), facts, "inst", "session", "available", "value").select("inst", "session", "value", "available")


def c8_select_as_of(spark, sf_dir):
    return P.select_as_of(_facts(spark, sf_dir).withColumn("k", F.concat_ws(":", "inst", "period_end")), "k", "1997-06-30", "available", ["available", "value", "o_orderkey"]).select("inst", "period_end", "available", "value")


def j17_benjamini_hochberg(spark, sf_dir):
    n = F.count("*")
    f = _facts(spark, sf_dir).groupBy("inst", "period_end").agg((n % 97 / 97.0).alias("p"))
    return P.benjamini_hochberg(f.withColumn("p", F.when(F.col("p") > 0, F.col("p"))), "p", "inst").select("inst", "period_end", r("p").alias("p"), r("q").alias("q"))


QUERIES |= {"c5_asof_strict_join": c5_asof_strict_join, "c8_select_as_of": c8_select_as_of, "j17_benjamini_hochberg": j17_benjamini_hochberg}
ORACLES |= {
    "c5_asof_strict_join": oracle("").rstrip() + f",\n{_FACTS}, f as (select inst, available, max(value) as value from facts group by 1, 2) select b.inst, b.session, f.value, f.available from bars b asof left join f on b.inst = f.inst and b.session > f.available",
    "c8_select_as_of": f"with {_FACTS} select inst, period_end, available, value from (select *, row_number() over (partition by inst, period_end order by available desc, value desc, o_orderkey desc) rn from facts where available <= date '1997-06-30') where rn = 1",
    "j17_benjamini_hochberg": f"with {_FACTS}, f as (select inst, period_end, nullif(count(*) % 97 / 97.0, 0) p from facts group by 1, 2), k as (select *, p * count(*) over (partition by inst) / row_number() over (partition by inst order by p) q0, row_number() over (partition by inst order by p) rn from f where p is not null) select inst, period_end, round(p, 6) + 0.0 p, round(least(1.0, min(q0) over (partition by inst order by rn rows between current row and unbounded following)), 6) + 0.0 q from k union all select inst, period_end, null, null from f where p is null",
}


from . import evidence_queries, fact_queries, formula_queries, gate_queries, inference_queries, research_queries, streaming_queries, source_queries, temporal_queries, window_queries  # noqa: E402,F401  (they register themselves)


def _plain(query):
    """Dates and timestamps as text, so that results compare alike in any client."""

    def run(spark, sf_dir):
        df = query(spark, sf_dir)
        return df.withColumns({c: F.col(c).cast("string") for c, t in df.dtypes if t in ("date", "timestamp", "timestamp_ntz")})

    return run


DATED |= {"b2_tradable_split": (), "c17_entity_pair_join": (), "l1_audit_market": (), "d14_month_end_sessions": ("last_session",), "b9_signal_clock": ("session", "available_at"), "c5_asof_strict_join": ("session", "available"), "c8_select_as_of": ("period_end", "available"), "j17_benjamini_hochberg": ("period_end",)}


def _plain_sql(name: str, sql: str) -> str:
    cols = DATED.get(name, ("session",))
    return f"select * replace ({', '.join(f'cast({c} as varchar) as {c}' for c in cols)}) from ({sql})" if cols else sql


QUERIES = {k: _plain(q) for k, q in QUERIES.items()}
ORACLES = {k: _sql_r(_plain_sql(k, q)) for k, q in ORACLES.items()}
