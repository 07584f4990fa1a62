"""Queries of the cross-section, selection, reconciliation and research operators, with their SQL."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.sweep import interval_latest
from ..operators import panel as P
from ..operators import research as R
from ..operators.exprs import by_instrument, by_session, safe_div, safe_log
from ..operators.windows import dedupe_latest, revisions, with_return
from ..sources import tables as T
from ..sources.fixture import bars, oracle
from .base import _W, DATED, FWD, MOM, ORACLES, QUERIES, RET, panel, r

MEMBERS = "members as (select cast(s_suppkey % 20 as int) inst, date '1995-01-02' + cast(7 * (s_suppkey % 50) as int) in_date, case when s_suppkey % 3 <> 0 then date '1995-01-02' + cast(7 * (s_suppkey % 50) + 1050 as int) end out_date, cast(s_nationkey as bigint) grp from supplier)"


def both(df):
    return P.with_forward_return(P.with_momentum(df))


def members(spark, sf_dir):
    week = 7 * (F.col("s_suppkey") % 50)
    day = lambda n: F.date_add(F.lit("1995-01-02").cast("date"), n.cast("int"))
    return spark.read.parquet(f"{sf_dir}/supplier.parquet").select((F.col("s_suppkey") % 20).cast("int").alias("inst"), day(week).alias("in_date"), F.when(F.col("s_suppkey") % 3 != 0, day(week + 1050)).alias("out_date"), F.col("s_nationkey").cast("long").alias("grp"))


def table(name: str, sql: str, dates: tuple = (), with_bars: bool = True):
    """Register f(spark, sf_dir) with its SQL."""

    def add(f):
        QUERIES[name], DATED[name] = f, dates
        ORACLES[name] = sql if not with_bars else oracle(sql) if sql.startswith("select") else oracle("").rstrip() + ",\n" + sql
        return f

    return add


@panel("b6_adjusted_prices", "select inst, session, round(close * (1 + seq / 1000::double), 5) + 0.0 adj_close, round(volume / (1 + seq / 1000::double), 4) + 0.0 adj_volume, round(amount / volume * (1 + seq / 1000::double), 5) + 0.0 adj_vwap from bars")
def b6(df):
    adj = 1 + F.col("seq") / 1000
    return df.select("inst", "session", r(F.col("close") * adj, 5).alias("adj_close"), r(F.col("volume") / adj, 4).alias("adj_volume"), r(safe_div("amount", "volume") * adj, 5).alias("adj_vwap"))


@panel("b10_wide_to_long", "select inst, session, 'open0' factor, round(open / close, 6) + 0.0 as val from bars union all select inst, session, 'high0', round(high / close, 6) + 0.0 from bars union all select inst, session, 'low0', round(low / close, 6) + 0.0 from bars")
def b10(df):
    wide = df.select("inst", "session", *(r(safe_div(x, "close")).alias(f"{x}0") for x in ("open", "high", "low")))
    return wide.unpivot(["inst", "session"], ["open0", "high0", "low0"], "factor", "val")


_WIDE_CLOSE = "select session, " + ", ".join(f"round(max(case when inst = {i} then close end), 5) + 0.0 i{i}" for i in range(20)) + " from bars group by session"


@panel("b11_long_to_wide", _WIDE_CLOSE)
@panel("b11_long_to_wide_all", _WIDE_CLOSE)
def b11(df):
    wide = df.groupBy("session").pivot("inst", list(range(20))).agg(F.max("close"))
    return wide.select("session", *(r(F.col(str(i)), 5).alias(f"i{i}") for i in range(20)))


@panel("c10_session_offset_join", "select a.inst, a.session, b.session entry_session, round(b.open, 5) + 0.0 entry_open from bars a left join bars b on a.inst = b.inst and b.seq = a.seq + 1", ("session", "entry_session"))
def c10(df):
    b = df.select("inst", (F.col("seq") - 1).alias("seq"), F.col("session").alias("entry_session"), r("open", 5).alias("entry_open"))
    return df.select("inst", "seq", "session").join(b, ["inst", "seq"], "left").drop("seq")


@panel("c11_full_outer_reconcile", f"{RET}, j as (select inst, session, ret from ret where abs(ret) > 0.5), v as (select inst, session, volume from bars where volume > 150) select coalesce(j.inst, v.inst) inst, coalesce(j.session, v.session) session, case when v.inst is null then 'jump_only' when j.inst is null then 'event_only' else 'matched' end status from j full join v on j.inst = v.inst and j.session = v.session")
def c11(df):
    j = with_return(df).filter(F.abs("ret") > 0.5).select("inst", "session", F.lit(True).alias("j"))
    v = df.filter("volume > 150").select("inst", "session", F.lit(True).alias("v"))
    return j.join(v, ["inst", "session"], "full").select("inst", "session", F.when(F.col("v").isNull(), "jump_only").when(F.col("j").isNull(), "event_only").otherwise("matched").alias("status"))


@panel("c12_overlap_diff", "n as (select inst, session, case when seq % 17 = 0 then null else close end c from bars where seq > 20), o as (select inst, session, close c from bars where seq <= 200) select count(*) pairs, count(*) filter (o.c is distinct from n.c) differing from o join n using (inst, session)", ())
def c12(df):
    new = df.filter("seq > 20").select("inst", "session", F.when(F.col("seq") % 17 != 0, F.col("close")).alias("n"))
    j = df.filter("seq <= 200").select("inst", "session", "close").join(new, ["inst", "session"])
    return j.agg(F.count("*").alias("pairs"), F.count(F.when(~F.col("close").eqNullSafe(F.col("n")), 1)).alias("differing"))


@panel("c12_overlap_full_diff", "n as (select inst, session, case when seq % 17 = 0 then null else close end c from bars where seq > 20 and (seq + inst) % 13 <> 0), o as (select inst, session, close c from bars where seq <= 200 and (seq + inst) % 11 <> 0), d as (select o.inst oi, n.inst ni, o.c oc, n.c nc from (select * from o where session >= (select min(session) from n)) o full join (select * from n where session <= (select max(session) from o)) n on o.inst = n.inst and o.session = n.session) select count(*) keys, count(*) filter (oi is not null and ni is not null) pairs, count(*) filter (ni is null) old_only, count(*) filter (oi is null) new_only, count(*) filter (oi is not null and ni is not null and oc is distinct from nc) differing from d", ())
def c12_full(df):
    new = df.filter("seq > 20 and (seq + inst) % 13 <> 0").select("inst", "session", F.when(F.col("seq") % 17 != 0, F.col("close")).alias("n"))
    old = df.filter("seq <= 200 and (seq + inst) % 11 <> 0").select("inst", "session", F.col("close").alias("o"))
    # the overlap: from the first session of the new release to the last of the old one
    o = old.join(new.agg(F.min("session").alias("from")), F.col("session") >= F.col("from")).drop("from").withColumn("in_o", F.lit(True))
    n = new.join(old.agg(F.max("session").alias("to")), F.col("session") <= F.col("to")).drop("to").withColumn("in_n", F.lit(True))
    both_sides = F.col("in_o").isNotNull() & F.col("in_n").isNotNull()
    return o.join(n, ["inst", "session"], "full").agg(F.count("*").alias("keys"), F.count(F.when(both_sides, 1)).alias("pairs"), F.count(F.when(F.col("in_n").isNull(), 1)).alias("old_only"), F.count(F.when(F.col("in_o").isNull(), 1)).alias("new_only"), F.count(F.when(both_sides & ~F.col("o").eqNullSafe(F.col("n")), 1)).alias("differing"))


@panel("c14_survivorship_anti", "select inst, session from bars where not exists (select 1 from bars b where b.inst = bars.inst and b.session = bars.session and b.close is not null)")
def c14(df):
    return df.select("inst", "session").join(df.filter("close is not null").select("inst", "session"), ["inst", "session"], "left_anti")


@panel("c15_scenario_cross_join", "select inst, session, cast(capital as bigint) capital, round(least(1::double, capital / 20 / amount), 6) + 0.0 participation from bars cross join (values (10000::double), (100000::double), (1000000::double)) c(capital) where amount > 0")
def c15(df):
    return df.filter("amount > 0").withColumn("capital", F.explode(F.array(*(F.lit(float(x)) for x in (10_000, 100_000, 1_000_000))))).select("inst", "session", F.col("capital").cast("long").alias("capital"), r(F.least(F.lit(1.0), F.col("capital") / 20 / F.col("amount"))).alias("participation"))


@panel("c16_prev_membership_self_join", f"{MOM}, h as (select session, seq, inst from (select *, row_number() over (partition by session order by mom desc, inst) k from mom where mom is not null) where k <= 5), s as (select session, seq, count(*) n from h group by 1, 2), k as (select a.seq, count(*) kept from h a join h b on a.inst = b.inst and a.seq = b.seq + 1 group by 1) select s.session, s.n, coalesce(kept, 0) retained, round(case when p.n is not null then 1 - coalesce(kept, 0) / greatest(s.n, p.n)::double end, 6) + 0.0 turnover from s left join s p on s.seq = p.seq + 1 left join k on s.seq = k.seq")
def c16(df):
    return R.retained_members(P.top_k(P.with_momentum(df), "mom", 5)).select("session", "n", "retained", r("turnover").alias("turnover"))


@table("c13_pit_membership_semi", MEMBERS + " select inst, session from bars where exists (select 1 from members m where m.inst = bars.inst and bars.session >= in_date and (out_date is null or bars.session < out_date))", ("session",))
def c13(spark, sf_dir):
    b, m = bars(spark, sf_dir).select("inst", "session"), members(spark, sf_dir)
    x = interval_latest(b, m.withColumn("member", F.lit(True)), "inst", "session", "in_date", "out_date", ["member"], [F.desc("in_date")])
    return x.filter("member").drop("member")


@table("c18_pit_industry_snapshot", MEMBERS + ", k as (select bars.inst, session, grp, row_number() over (partition by bars.inst, session order by in_date desc nulls last, grp desc) rn from bars left join members m on m.inst = bars.inst and session >= in_date and (out_date is null or session < out_date)) select inst, session, coalesce(grp, -1) grp from k where rn = 1", ("session",))
def c18(spark, sf_dir):
    return interval_latest(bars(spark, sf_dir).select("inst", "session"), members(spark, sf_dir), "inst", "session", "in_date", "out_date", ["grp"], [F.desc("in_date"), F.desc("grp")]).select("inst", "session", F.coalesce("grp", F.lit(-1)).alias("grp"))


@panel("d3_grouped_corr_regr", "select session, count(*) n, round(regr_slope(close, volume), 5) + 0.0 slope, round(covar_samp(close, volume), 3) + 0.0 cov, round(stddev_pop(close), 5) + 0.0 sd from bars where close is not null group by session having count(*) >= 5")
def d3(df):
    return df.filter("close is not null").groupBy("session").agg(F.count("*").alias("n"), r(F.regr_slope("close", "volume"), 5).alias("slope"), r(F.covar_samp("close", "volume"), 3).alias("cov"), r(F.stddev_pop("close"), 5).alias("sd")).filter("n >= 5")


@table("d5_distinct_tuple_count", "select count(*) - count(distinct (l_orderkey, l_linenumber)) duplicates from lineitem", (), False)
def d5(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").agg((F.count("*") - F.count_distinct("l_orderkey", "l_linenumber")).alias("duplicates"))


@table("d6_having_duplicates", "select cast(l_orderkey as bigint) l_orderkey, cast(l_linenumber as bigint) l_linenumber, count(*) n from lineitem group by 1, 2 having count(*) > 1", (), False)
def d6(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy(F.col("l_orderkey").cast("long").alias("l_orderkey"), F.col("l_linenumber").cast("long").alias("l_linenumber")).agg(F.count("*").alias("n")).filter("n > 1")


@table("d7_daily_status_rollup", "select cast(o_orderdate as date) as day, bool_or(o_orderstatus = 'F') any_f, string_agg(distinct o_orderstatus, ',' order by o_orderstatus) statuses, min(o_orderpriority) priority from orders group by 1", ("day",), False)
def d7(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy(F.col("o_orderdate").cast("date").alias("day")).agg(F.bool_or(F.col("o_orderstatus") == "F").alias("any_f"), F.array_join(F.array_sort(F.collect_set("o_orderstatus")), ",").alias("statuses"), F.min("o_orderpriority").alias("priority"))


@panel("d10_compound_return", f"{RET} select inst, year(session) as y, count(ret) n, round(exp(sum(ln(1 + ret))) - 1, 5) + 0.0 total from ret group by 1, 2", ())
def d10(df):
    return with_return(df).groupBy("inst", F.year("session").cast("long").alias("y")).agg(F.count("ret").alias("n"), r(F.exp(F.sum(F.log1p("ret"))) - 1, 5).alias("total"))


@panel("d11_tail_and_winrate", f"{MOM}, {FWD} select case when mom > 0 then 'up' when mom <= 0 then 'down' else 'unknown' end state, count(*) n, round(avg(fwd), 6) + 0.0 mean, round(median(fwd), 6) + 0.0 med, round(quantile_cont(fwd, 0.1), 6) + 0.0 p10, round(avg(case when fwd > 0 then 1.0 else 0.0 end), 6) + 0.0 win from fwd where fwd is not null group by 1", ())
def d11(df):
    state = F.when(F.col("mom") > 0, "up").when(F.col("mom") <= 0, "down").otherwise("unknown")
    return both(df).filter("fwd is not null").groupBy(state.alias("state")).agg(F.count("*").alias("n"), r(F.avg("fwd")).alias("mean"), r(F.median("fwd")).alias("med"), r(F.percentile("fwd", F.lit(0.1))).alias("p10"), r(F.avg((F.col("fwd") > 0).cast("double"))).alias("win"))


@panel("d12_release_quality", f"{MOM} select count(*) n_rows, count(mom) present, round(count(mom) / count(*)::double, 6) + 0.0 coverage, round(min(mom), 6) + 0.0 lowest, round(max(mom), 6) + 0.0 highest, count(distinct session) sessions, count(distinct inst) instruments, count(*) - count(distinct (inst, session)) duplicates from mom", ())
def d12(df):
    x = P.with_momentum(df)
    return x.agg(F.count("*").alias("n_rows"), F.count("mom").alias("present"), r(F.count("mom") / F.count("*")).alias("coverage"), r(F.min("mom")).alias("lowest"), r(F.max("mom")).alias("highest"), F.count_distinct("session").alias("sessions"), F.count_distinct("inst").alias("instruments"), (F.count("*") - F.count_distinct("inst", "session")).alias("duplicates"))


@panel("d16_sector_daily_stats", "select session, inst % 4 sector, round(avg(close), 5) + 0.0 mean, round(median(close), 5) + 0.0 med, count(close) n_valid, count(*) n, round(sum(case when amount > 0 then amount end), 2) + 0.0 total from bars group by 1, 2")
def d16(df):
    return df.groupBy("session", (F.col("inst") % 4).alias("sector")).agg(r(F.avg("close"), 5).alias("mean"), r(F.median("close"), 5).alias("med"), F.count("close").alias("n_valid"), F.count("*").alias("n"), r(F.sum(F.when(F.col("amount") > 0, F.col("amount"))), 2).alias("total"))


@panel("d17_latest_summary", "select inst, count(*) sessions, count(close) valid, max(session) filter (close is not null) last_session, round(arg_max(close, session) filter (close is not null), 5) + 0.0 last_close from bars group by inst", ("last_session",))
def d17(df):
    day = F.when(F.col("close").isNotNull(), F.col("session"))
    return df.groupBy("inst").agg(F.count("*").alias("sessions"), F.count("close").alias("valid"), F.max(day).alias("last_session"), r(F.max_by("close", day), 5).alias("last_close"))


@panel("d18_status_counts", f"{MOM}, {FWD}, q as (select case when lead(seq, 6) {_W} is null then 'no_exit_session' when close is null then 'no_signal_bar' when lead(open, 1) {_W} is null then 'no_entry_bar' when lead(close, 6) {_W} is null then 'no_exit_bar' else 'valid' end reason from fwd) select reason, count(*) n from q group by 1", ())
def d18(df):
    return both(df).groupBy("reason").agg(F.count("*").alias("n"))


@panel("d19_error_quantiles", "e as (select abs(close - open) x from bars where close is not null) select count(*) n, round(quantile_cont(x, 0.5), 5) + 0.0 p50, round(quantile_cont(x, 0.95), 5) + 0.0 p95, round(quantile_cont(x, 0.99), 5) + 0.0 p99, round(max(x), 5) + 0.0 largest from e", ())
def d19(df):
    x = df.select(F.abs(F.col("close") - F.col("open")).alias("x")).filter("x is not null")
    q = lambda p: r(F.percentile("x", F.lit(p)), 5)
    return x.agg(F.count("*").alias("n"), q(0.5).alias("p50"), q(0.95).alias("p95"), q(0.99).alias("p99"), r(F.max("x"), 5).alias("largest"))


_FACTS = "facts as (select cast(o_custkey % 20 as int) inst, cast(last_day(date_trunc('quarter', o_orderdate) + interval 2 months) as date) period_end, cast(last_day(date_trunc('quarter', o_orderdate) + interval 2 months) as date) + cast(o_orderkey % 60 as int) available, cast(o_totalprice as double) as value, cast(o_orderkey as bigint) k from orders)"


def facts(spark, sf_dir):
    end = F.last_day(F.add_months(F.date_trunc("quarter", "o_orderdate"), 2)).cast("date")
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select((F.col("o_custkey") % 20).cast("int").alias("inst"), end.alias("period_end"), F.date_add(end, (F.col("o_orderkey") % 60).cast("int")).alias("available"), F.col("o_totalprice").cast("double").alias("value"), F.col("o_orderkey").cast("long").alias("k"))


@table("e21_revision_sequence", f"with {_FACTS} select inst, period_end, k, row_number() over w revision, lead(available) over w valid_to from facts window w as (partition by inst, period_end order by available, k, value)", ("period_end", "valid_to"), False)
def e21(spark, sf_dir):
    return revisions(facts(spark, sf_dir), ["inst", "period_end"], "available", ["k", "value"]).select("inst", "period_end", "k", F.col("revision").cast("long").alias("revision"), "valid_to")


@table("e22_dedupe_latest", f"with {_FACTS} select inst, period_end, k, round(value, 2) + 0.0 as value from (select *, row_number() over (partition by inst, period_end order by available desc, k desc, value desc) rn from facts) where rn = 1", ("period_end",), False)
def e22(spark, sf_dir):
    return dedupe_latest(facts(spark, sf_dir), ["inst", "period_end"], [F.desc("available"), F.desc("k"), F.desc("value")]).select("inst", "period_end", "k", r("value", 2).alias("value"))


@table("i3_same_period_change", f"with {_FACTS}, f as (select * from (select *, row_number() over (partition by inst, period_end order by available desc, k desc, value desc) rn from facts) where rn = 1) select a.inst, a.period_end, round(a.value - b.value, 2) + 0.0 change, case when b.inst is null then 'no_prior' else 'ok' end status from f a left join f b on a.inst = b.inst and b.period_end = last_day(a.period_end - interval 12 months)", ("period_end",), False)
def i3(spark, sf_dir):
    f = dedupe_latest(facts(spark, sf_dir), ["inst", "period_end"], [F.desc("available"), F.desc("k"), F.desc("value")])
    prior = f.select("inst", F.last_day(F.add_months("period_end", 12)).alias("period_end"), F.col("value").alias("prior"))
    return f.join(prior, ["inst", "period_end"], "left").select("inst", "period_end", r(F.col("value") - F.col("prior"), 2).alias("change"), F.when(F.col("prior").isNull(), "no_prior").otherwise("ok").alias("status"))


@table("j18_holm_adjust", f"with {_FACTS}, f as (select inst, period_end, nullif(count(*) % 97 / 97.0::double, 0) p from facts group by 1, 2), k as (select *, coalesce(p, 1) q, row_number() over (partition by inst order by coalesce(p, 1)) rn, count(*) over (partition by inst) m from f) select inst, period_end, round(least(1::double, max(q * (m - rn + 1)) over (partition by inst order by rn)), 6) + 0.0 adjusted from k", ("period_end",), False)
def j18(spark, sf_dir):
    p = F.count("*") % 97 / 97.0
    f = facts(spark, sf_dir).groupBy("inst", "period_end").agg(F.when(p > 0, p).alias("p"))
    return R.holm(f, "p", "inst").select("inst", "period_end", r("adjusted").alias("adjusted"))


@panel("f1_top_quantile_select", f"{MOM}, k as (select session, inst, percent_rank() over (partition by session order by mom) pr from mom where mom is not null) select session, inst from k where pr >= 0.8")
def f1(df):
    x = P.with_momentum(df).filter("mom is not null").withColumn("pr", F.percent_rank().over(by_session().orderBy("mom")))
    return x.filter("pr >= 0.8").select("session", "inst")


@panel("f3_bottom_top_spread", f"{MOM}, {FWD}, k as (select *, row_number() over (partition by session order by mom desc, inst) t, row_number() over (partition by session order by mom, inst) b from fwd where mom is not null and fwd is not null) select session, round(avg(case when t <= 3 then fwd end) - avg(case when b <= 3 then fwd end), 6) + 0.0 spread, count(*) n from k group by session")
def f3(df):
    return R.quantile_spread(both(df), "mom", "fwd", 3).select("session", r("spread").alias("spread"), "n")


@panel("f4_industry_capped_top_k", f"{MOM}, g as (select *, row_number() over (partition by session, inst % 4 order by mom desc, inst) gr from mom where mom is not null), t as (select *, row_number() over (partition by session order by mom desc, inst) rank from g where gr <= 2) select session, inst, rank from t where rank <= 5")
def f4(df):
    x = P.with_momentum(df).withColumn("sector", F.col("inst") % 4)
    return R.capped_top_k(x, "mom", "sector", 5, 2).select("session", "inst", F.col("rank").cast("long").alias("rank"))


@panel("f6_nth_session_sample", "select inst, session from bars where seq % 5 = 1")
def f6(df):
    return df.filter("seq % 5 = 1").select("inst", "session")


@panel("f8_boundary_witnesses", "select inst, year(session) as y, min(session) first_session, max(session) last_session from bars where close is not null group by 1, 2", ("first_session", "last_session"))
def f8(df):
    return df.filter("close is not null").groupBy("inst", F.year("session").cast("long").alias("y")).agg(F.min("session").alias("first_session"), F.max("session").alias("last_session"))


@panel("g2_symmetric_key_diff", "a as (select inst, session from bars where close > open), b as (select inst, session from bars where volume > 100) select *, 'left' side from (select * from a except select * from b) union all select *, 'right' from (select * from b except select * from a)")
def g2(df):
    return R.key_difference(df.filter("close > open"), df.filter("volume > 100"), ["inst", "session"])


@panel("g4_portfolio_jaccard", f"{MOM}, a as (select session, inst from (select *, row_number() over (partition by session order by mom desc, inst) k from mom where mom is not null) where k <= 5), b as (select session, inst from (select *, row_number() over (partition by session order by volume desc, inst) k from mom where volume is not null) where k <= 5), j as (select coalesce(a.session, b.session) session, a.inst x, b.inst y from a full join b on a.session = b.session and a.inst = b.inst) select session, count(case when x is not null and y is not null then 1 end) shared, count(*) n_union from j group by 1")
def g4(df):
    x = P.with_momentum(df)
    a, b = (P.top_k(x, c, 5).select("session", "inst", F.lit(1).alias(c)) for c in ("mom", "volume"))
    return a.join(b, ["session", "inst"], "full").groupBy("session").agg(F.count(F.when(F.col("mom").isNotNull() & F.col("volume").isNotNull(), 1)).alias("shared"), F.count("*").alias("n_union"))


_RES = "case when var_pop(x) over (partition by session) > 1e-12 then y - avg(y) over (partition by session) - covar_pop(y, x) over (partition by session) / var_pop(x) over (partition by session) * (x - avg(x) over (partition by session)) end"


@panel("h10_nonlinear_size", f"v as (select inst, session, ln(amount) x, power(ln(amount), 3) y from bars where amount > 0) select inst, session, round({_RES}, 4) + 0.0 resid from v")
def h10(df):
    x = df.filter("amount > 0").withColumn("x", safe_log("amount"))
    return x.select("inst", "session", r(R.session_residual(F.pow("x", F.lit(3.0)), "x"), 4).alias("resid"))


@panel("j2_winsorized_zscore", "m as (select session, median(close) med from bars group by session), d as (select session, min(med) med, median(abs(close - med)) mad from bars join m using (session) group by session), c as (select inst, session, case when mad > 0 and close is not null then greatest(med - 7.413 * mad, least(med + 7.413 * mad, close)) else close end c from bars join d using (session)) select inst, session, round(case when count(c) over w >= 10 and stddev_pop(c) over w > 1e-12 then (c - avg(c) over w) / stddev_pop(c) over w end, 5) + 0.0 z from c window w as (partition by session)")
def j2(df):
    return R.winsorized_zscore(df, "close").select("inst", "session", r("z", 5).alias("z"))


@panel("j3_size_neutralize", f"{MOM}, v as (select inst, session, mom y, ln(amount) x from mom where mom is not null and amount > 0) select inst, session, round({_RES}, 5) + 0.0 resid from v")
def j3(df):
    x = P.with_momentum(df).filter("mom is not null and amount > 0")
    return x.select("inst", "session", r(R.session_residual("mom", safe_log("amount")), 5).alias("resid"))


@panel("j4_industry_size_neutralize", f"{MOM}, v as (select inst, session, mom - avg(mom) over (partition by session, inst % 4) y, ln(amount) - avg(ln(amount)) over (partition by session, inst % 4) x from mom where mom is not null and amount > 0) select inst, session, round(case when sum(x * x) over (partition by session) > 1e-12 then y - x * sum(x * y) over (partition by session) / sum(x * x) over (partition by session) end, 5) + 0.0 resid from v")
def j4(df):
    x = P.with_momentum(df).filter("mom is not null and amount > 0").withColumn("size", safe_log("amount")).withColumn("sector", F.col("inst") % 4)
    return R.industry_size_residual(x, "mom", "size", "sector").select("inst", "session", r("residual", 5).alias("resid"))


@panel("j16_stability_segments", f"{RET}, k as (select inst, ret, cast(((row_number() over (partition by inst order by session) - 1) * 4) // count(*) over (partition by inst) as bigint) part from ret where ret is not null) select inst, part, count(*) n, round(avg(ret), 6) + 0.0 mean from k group by 1, 2", ())
def j16(df):
    return R.stability_segments(with_return(df), "inst", "ret", "session", 4).select("inst", "part", "n", r("mean").alias("mean"))


@panel("j33_score_combination", f"{MOM}, a as (select inst, session, percent_rank() over (partition by session order by mom) p from mom where mom is not null union all select inst, session, percent_rank() over (partition by session order by volume) from mom where volume is not null union all select inst, session, percent_rank() over (partition by session order by close) from mom where close is not null) select inst, session, count(*) n, round(avg(p), 6) + 0.0 score from a group by 1, 2 having count(*) >= 2")
def j33(df):
    long = P.with_momentum(df).unpivot(["inst", "session"], ["mom", "volume", "close"], "factor", "val").filter("val is not null")
    ranked = long.withColumn("p", F.percent_rank().over(by_session("factor").orderBy("val")))
    return ranked.groupBy("inst", "session").agg(F.count("*").alias("n"), r(F.avg("p")).alias("score")).filter("n >= 2")


@panel("j31_state_assignment", f"{MOM} select inst, session, case when mom is null or close is null then null when mom > 0 and close > open then 'strong_up' when mom > 0 then 'strong_down' when close > open then 'weak_up' else 'weak_down' end state from mom")
def j31(df):
    up = F.col("close") > F.col("open")
    return P.with_momentum(df).select("inst", "session", F.when(F.col("mom").isNull() | F.col("close").isNull(), F.lit(None)).when((F.col("mom") > 0) & up, "strong_up").when(F.col("mom") > 0, "strong_down").when(up, "weak_up").otherwise("weak_down").alias("state"))


@panel("j41_performance_summary", f"{RET}, n as (select inst, session, ret, sum(ln(1 + ret)) over (partition by inst order by session) l from ret where ret > -1), d as (select *, exp(l - greatest(0, max(l) over (partition by inst order by session))) - 1 dd from n) select inst, round(exp(sum(ln(1 + ret))) - 1, 5) + 0.0 total, round(stddev_samp(ret) * sqrt(52), 5) + 0.0 volatility, round(avg(ret) * 52 / (stddev_samp(ret) * sqrt(52)), 5) + 0.0 sharpe, round(min(dd), 6) + 0.0 max_drawdown from d group by inst", ())
def j41(df):
    x = R.performance(with_return(df), "inst", "ret", "session", 52)
    return x.select("inst", r("total", 5).alias("total"), r("volatility", 5).alias("volatility"), r("sharpe", 5).alias("sharpe"), r("max_drawdown").alias("max_drawdown"))


@panel("l8_audit_label_overlap", f"s as (select inst, session, lead(session, 6) {_W} exit_session from bars) select count(*) n, count(*) filter (exit_session >= date '1999-01-04') violations from s where session < date '1999-01-04'", ())
def l8(df):
    cut = F.lit("1999-01-04").cast("date")
    x = df.select("session", F.lead("session", 6).over(by_instrument()).alias("leave")).filter(F.col("session") < cut)
    return x.agg(F.count("*").alias("n"), F.count(F.when(F.col("leave") >= cut, 1)).alias("violations"))


@panel("l10_verify_against_reference", f"{MOM}, o as (select a.inst, a.session, case when b.close <> 0 then a.close / b.close - 1 end m from bars a left join bars b on a.inst = b.inst and b.seq = a.seq - 5) select count(*) n, count(*) filter ((o.m is null) <> (mom is null)) null_diff, count(*) filter (abs(o.m - mom) > 1e-12 + 1e-10 * greatest(abs(o.m), abs(mom))) value_diff from mom join o using (inst, session)", ())
def l10(df):
    old = df.select("inst", (F.col("seq") + 5).alias("seq"), F.col("close").alias("c5"))
    x = P.with_momentum(df).join(old, ["inst", "seq"], "left").withColumn("m", safe_div("close", "c5") - 1)
    far = F.abs(F.col("m") - F.col("mom")) > 1e-12 + 1e-10 * F.greatest(F.abs("m"), F.abs("mom"))
    return x.agg(F.count("*").alias("n"), F.count(F.when(F.col("m").isNull() != F.col("mom").isNull(), 1)).alias("null_diff"), F.count(F.when(far, 1)).alias("value_diff"))


@table("a2_scan_union_by_name", "select kind, cast(nation as bigint) nation, count(*) n, count(segment) with_segment from (select 'customer' kind, c_nationkey nation, c_mktsegment segment from customer union all select 'supplier', s_nationkey, null from supplier) group by 1, 2", (), False)
def a2(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.lit("customer").alias("kind"), F.col("c_nationkey").cast("long").alias("nation"), F.col("c_mktsegment").alias("segment"))
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.lit("supplier").alias("kind"), F.col("s_nationkey").cast("long").alias("nation"))
    return T.union_by_name(c, s).groupBy("kind", "nation").agg(F.count("*").alias("n"), F.count("segment").alias("with_segment"))


@table("a9_row_content_hash", "select cast(o_orderkey as bigint) o_orderkey, sha256('=' || o_orderkey || '|' || coalesce('=' || o_orderpriority, '~') || '|' || coalesce('=' || o_orderstatus, '~')) digest from orders", (), False)
def a9(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return o.select(F.col("o_orderkey").cast("long").alias("o_orderkey"), T.content_hash(["o_orderstatus", "o_orderpriority", "o_orderkey"]).alias("digest"))


@table("i2_stale_fact_filter", f"with {_FACTS} select inst, period_end, k from facts where date '1998-06-30' - period_end between 0 and 550 and available <= date '1998-06-30'", ("period_end",), False)
def i2(spark, sf_dir):
    day = F.lit("1998-06-30").cast("date")
    return facts(spark, sf_dir).filter(F.datediff(day, "period_end").between(0, 550) & (F.col("available") <= day)).select("inst", "period_end", "k")


@panel("j11_high_minus_low", f"""{MOM}, {FWD}, k as (select session, fwd, rank() over (partition by session order by mom) + (count(*) over (partition by session, mom) - 1) / 2.0 r, count(*) over (partition by session) n from fwd where mom is not null and fwd is not null),
q as (select session, least(5, floor((r - 1) * 5 / n) + 1) bucket, avg(fwd) m from k where n >= 10 group by 1, 2), h as (select session, max(case when bucket = 5 then m end) - max(case when bucket = 1 then m end) d from q group by 1) select count(d) n, round(avg(d), 6) + 0.0 high_minus_low from h""", ())
def j11(df):
    top = lambda b: F.max(F.when(F.col("bucket") == b, F.col("mean_label")))
    d = P.quantile_means(both(df), "mom", "fwd").groupBy("session").agg((top(5) - top(1)).alias("d"))
    return d.agg(F.count("d").alias("n"), r(F.avg("d")).alias("high_minus_low"))


@panel("j43_trailing_score", f"{RET}, m as (select session, avg(ret) mkt from ret group by 1), j as (select ret.*, ret - mkt ex from ret join m using (session)) select inst, session, round(sum(ret) over w, 6) + 0.0 trail, round(sum(ex) over w, 6) + 0.0 excess, round(case when stddev_pop(ret) over w > 1e-9 then avg(ret) over w / stddev_pop(ret) over w end, 5) + 0.0 adjusted from j window w as (partition by inst order by session rows between 19 preceding and current row)")
def j43(df):
    x, w = with_return(df).join(P.market_return(df).drop("n"), "session"), by_instrument(20)
    sd = F.stddev_pop("ret").over(w)
    return x.select("inst", "session", r(F.sum("ret").over(w)).alias("trail"), r(F.sum(F.col("ret") - F.col("market")).over(w)).alias("excess"), r(F.when(sd > 1e-9, F.avg("ret").over(w) / sd), 5).alias("adjusted"))


@panel("j59_fixed_value_buckets", f"{MOM}, {FWD} select case when mom < -0.2 then 'a' when mom < 0 then 'b' when mom < 0.2 then 'c' else 'd' end bucket, count(*) n, round(avg(fwd), 6) + 0.0 mean from fwd where mom is not null and fwd is not null group by 1", ())
def j59(df):
    b = F.when(F.col("mom") < -0.2, "a").when(F.col("mom") < 0, "b").when(F.col("mom") < 0.2, "c").otherwise("d")
    return both(df).filter("mom is not null and fwd is not null").groupBy(b.alias("bucket")).agg(F.count("*").alias("n"), r(F.avg("fwd")).alias("mean"))
