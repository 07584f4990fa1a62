"""Queries of the joins in time, checks of cardinality, samples and unions, with their SQL."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import panel as P
from ..operators import temporal as T
from ..operators.sweep import interval_latest
from ..operators.exprs import by_instrument, safe_div
from ..operators.windows import revisions
from ..sources.fixture import bars, oracle
from .base import _W, MOM, panel, r
from .research_queries import _FACTS, MEMBERS, facts, members, table
from .source_queries import _O, _SEC, orders, securities


def day(text):
    return F.lit(text).cast("date")


_ADJ = "adj as (select inst, session, 1 + seq / 1000::double adj_factor from bars where (inst + seq) % 5 <> 0), basic as (select inst, session, close / 100 pb from bars where (inst * seq) % 7 <> 0)"


def adj_basic(df):
    return df.filter("(inst + seq) % 5 <> 0").select("inst", "session", (1 + F.col("seq") / 1000).alias("adj_factor")), df.filter("(inst * seq) % 7 <> 0").select("inst", "session", (F.col("close") / 100).alias("pb"))


@panel("c1_panel_left_join", f"{_ADJ} select bars.inst, bars.session, round(close * adj_factor, 4) + 0.0 adj_close, round(pb, 6) + 0.0 pb from bars left join adj using (inst, session) left join basic using (inst, session)")
def c1(df):
    x = T.panel_join(df.select("inst", "session"), df.select("inst", "session", "close"), *adj_basic(df))
    return x.select("inst", "session", r(F.col("close") * F.col("adj_factor"), 4).alias("adj_close"), r("pb").alias("pb"))


@table("c2_checked_join", "with v as (select 'left' side, l_orderkey from lineitem group by 2 having count(*) > 1 union all select 'right', l_orderkey from (select o_orderkey l_orderkey from orders union all select o_orderkey from orders where o_orderkey % 50 = 0) group by 2 having count(*) > 1) select side, count(*) n from v group by 1", (), False)
def c2(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate")
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_quantity")
    _, bad = T.checked_join(lines, o.unionByName(o.filter("l_orderkey % 50 = 0")), ["l_orderkey"], "one_to_one")
    return bad.groupBy("side").agg(F.count("*").alias("n"))


@table("c3_listing_calendar_expand", f"{_SEC}, c as (select distinct session from bars) select k, session, row_number() over (partition by k order by session) listed_number from sec join c on session >= list_date and (delist_date is null or session <= delist_date)", ("session",))
def c3(spark, sf_dir):
    x = T.listed_sessions(securities(spark, sf_dir), bars(spark, sf_dir).select("session").distinct())
    return x.withColumn("listed_number", F.col("listed_number").cast("long"))


@table("c4_interval_latest_join", MEMBERS + ", n as (select *, in_date + cast(grp as int) ann from members), k as (select bars.inst, session, grp, row_number() over (partition by bars.inst, session order by in_date desc nulls last, ann desc nulls last, grp desc nulls last) rn from bars left join n m on m.inst = bars.inst and session >= in_date and session >= ann and (out_date is null or session <= out_date)) select inst, session, coalesce(grp, -1) grp from k where rn = 1", ("session",))
def c4(spark, sf_dir):
    m = members(spark, sf_dir).withColumn("ann", F.date_add("in_date", F.col("grp").cast("int")))
    known = m.withColumn("from_date", F.greatest("in_date", "ann"))
    x = interval_latest(bars(spark, sf_dir).select("inst", "session"), known, "inst", "session", "from_date", "out_date", ["grp"], [F.desc("in_date"), F.desc("ann"), F.desc("grp")], closed=True)
    return x.select("inst", "session", F.coalesce("grp", F.lit(-1)).alias("grp"))


@table("c6_bitemporal_interval_join", f"{_FACTS}, v as (select *, row_number() over w revision, lead(available) over w valid_to from facts window w as (partition by inst, period_end order by available, k, value)), j as (select b.inst, b.session, v.k, row_number() over (partition by b.inst, b.session order by v.available desc nulls last, v.revision desc, v.k desc) rn from bars b left join v on v.inst = b.inst and v.available < b.session and (v.valid_to is null or b.session < v.valid_to)) select inst, session, coalesce(k, -1) k from j where rn = 1", ("session",))
def c6(spark, sf_dir):
    v = revisions(facts(spark, sf_dir), ["inst", "period_end"], "available", ["k", "value"])
    x = interval_latest(bars(spark, sf_dir).select("inst", "session"), v, "inst", "session", "available", "valid_to", ["k"], [F.desc("available"), F.desc("revision"), F.desc("k")], open_start=True)
    return x.select("inst", "session", F.coalesce("k", F.lit(-1)).alias("k"))


@table("c7_asof_tolerance", f"{_FACTS}, f as (select inst, available, max(value) as value from facts group by 1, 2), j as (select b.inst, b.session, f.value, f.available from bars b asof left join f on b.inst = f.inst and b.session > f.available) select inst, session, case when session - available <= 10 then round(value, 2) + 0.0 end as value from j", ("session",))
def c7(spark, sf_dir):
    f = facts(spark, sf_dir).groupBy("inst", "available").agg(F.max("value").alias("value"))
    return T.asof_within(bars(spark, sf_dir).select("inst", "session"), f, "inst", "session", "available", "value", 10).select("inst", "session", r("value", 2).alias("value"))


@table("c9_select_effective_as_of", f"with {_FACTS}, v as (select *, available + cast(k % 20 as int) ingested, case when k % 4 <> 0 then period_end end valid_from, case when k % 3 <> 0 then period_end + 400 end valid_to from facts), l as (select *, row_number() over (partition by inst, period_end order by available desc, ingested desc, k desc) rn from v where available <= date '1998-06-30' and ingested <= date '1998-06-30') select inst, period_end, k from l where rn = 1 and (valid_from is null or valid_from <= date '1998-03-31') and (valid_to is null or valid_to >= date '1998-03-31')", ("period_end",), False)
def c9(spark, sf_dir):
    f = facts(spark, sf_dir).withColumns({"ingested": F.date_add("available", (F.col("k") % 20).cast("int")), "valid_from": F.when(F.col("k") % 4 != 0, F.col("period_end")), "valid_to": F.when(F.col("k") % 3 != 0, F.date_add("period_end", 400))})
    return T.effective_as_of(f, ["inst", "period_end"], day("1998-06-30"), day("1998-03-31"), ["available", "ingested", "k"]).select("inst", "period_end", "k")


@panel("c19_cross_source_compare", "b as (select inst, session, case when seq % 29 = 0 then close * 1.01 else close end close, case when seq % 31 = 0 then null else volume end volume from bars) select a.inst, a.session, 'close' field, round(a.close, 4) + 0.0 base, round(b.close, 4) + 0.0 other from bars a join b using (inst, session) where abs(a.close - b.close) > 0.001 union all select a.inst, a.session, 'volume', round(a.volume, 4) + 0.0, round(b.volume, 4) + 0.0 from bars a join b using (inst, session) where (a.volume is null) <> (b.volume is null)")
def c19(df):
    one = df.select("inst", "session", F.lit("a").alias("src"), "close", "volume")
    two = df.select("inst", "session", F.lit("b").alias("src"), F.when(F.col("seq") % 29 == 0, F.col("close") * 1.01).otherwise(F.col("close")).alias("close"), F.when(F.col("seq") % 31 != 0, F.col("volume")).alias("volume"))
    x = T.cross_source(one.unionByName(two), ["inst", "session"], "src", ["close", "volume"], 0.001, 0.0)
    return x.select("inst", "session", "field", r("base", 4).alias("base"), r("other", 4).alias("other"))


@panel("c20_frozen_exclusion", "select count(*) filter (seq % 50 = 0 and inst % 5 = 0) + 1 listed, count(*) filter (seq % 50 = 0 and inst % 5 = 0) matched, count(*) filter (seq % 50 = 0 and inst % 5 = 0) removed, count(*) filter (not (seq % 50 = 0 and inst % 5 = 0)) kept from bars", ())
def c20(df):
    listed = df.filter("seq % 50 = 0 and inst % 5 = 0").select("inst", "session")
    stray = df.select(F.lit(-1).alias("inst"), F.col("session")).groupBy("inst").agg(F.min("session").alias("session"))
    kept, counts = T.frozen_exclusion(df, listed.unionByName(stray), ["inst", "session"])
    return counts.crossJoin(kept.agg(F.count("*").alias("kept")))


@panel("c21_calendar_reindex", "s as (select inst, session, close from bars where close > open), e as (select distinct inst from s), c as (select distinct session from bars) select e.inst, c.session, round(s.close, 4) + 0.0 close, cast(0 as bigint) outside from e cross join c left join s on s.inst = e.inst and s.session = c.session")
def c21(df):
    full, outside = T.on_calendar(df.filter("close > open").select("inst", "session", "close"), df.select("session").distinct(), "inst")
    return full.select("inst", "session", r("close", 4).alias("close")).crossJoin(outside.agg(F.count("*").alias("outside")))


@panel("c11_full_reconcile_status", f"""j as (select inst, session, close / lag(close) {_W} jump from bars), e as (select inst, session, case when seq % 26 = 0 then volume end cash, seq % 13 = 0 ev from bars), x as (select coalesce(j.inst, e.inst) inst, coalesce(j.session, e.session) session, jump, cash, e.inst is not null has_event from (select * from j where abs(jump - 1) > 0.4) j full join (select * from e where ev) e on j.inst = e.inst and j.session = e.session)
select inst, session, case when not has_event then 'jump_without_event' when jump is null then 'event_without_jump' when cash is null then 'matched_amount_missing' when jump < 1 then 'matched_down' else 'matched_up' end status from x""")
def c11_status(df):
    j = df.withColumn("jump", safe_div("close", F.lag("close").over(by_instrument()))).filter(F.abs(F.col("jump") - 1) > 0.4).select("inst", "session", "jump")
    e = df.filter("seq % 13 = 0").select("inst", "session", F.when(F.col("seq") % 26 == 0, F.col("volume")).alias("cash"), F.lit(True).alias("ev"))
    status = F.when(F.col("ev").isNull(), "jump_without_event").when(F.col("jump").isNull(), "event_without_jump").when(F.col("cash").isNull(), "matched_amount_missing").when(F.col("jump") < 1, "matched_down").otherwise("matched_up")
    return j.join(e, ["inst", "session"], "full").select("inst", "session", status.alias("status"))


@panel("e23_adj_factor_jumps", f"a as (select inst, session, seq, close, case when seq % 26 >= 13 then 1.5 else 1.2 end * (1 + inst / 100.0::double) f from bars), l as (select *, lag(f) {_W} f0, lag(session) {_W} s0, lag(close) {_W} c0 from a) select inst, session, s0 previous_session, round(f / f0, 6) + 0.0 ratio, round(c0 / close, 5) + 0.0 price_ratio, round(c0 / close - f / f0, 5) + 0.0 error from l where abs(f / f0 - 1) > 1e-10", ("session", "previous_session"))
def e23(df):
    from ..operators.windows import factor_jumps

    f = F.when(F.col("seq") % 26 >= 13, 1.5).otherwise(1.2) * (1 + F.col("inst") / 100.0)
    x = factor_jumps(df.withColumn("f", f), "f", "close")
    return x.select("inst", "session", "previous_session", r("ratio").alias("ratio"), r("price_ratio", 5).alias("price_ratio"), r("error", 5).alias("error"))


@panel("f5_warmup_start", "select min(session) as start from (select distinct session from bars where session < date '1998-01-05' order by session desc limit 60)", ("start",))
def f5(df):
    return T.warmup_start(df.select("session").distinct(), day("1998-01-05"), 60)


@panel("f6_period_end_sessions", "c as (select distinct session from bars), p as (select 'month' unit, date_trunc('month', session) p, max(session) s from c group by 2 union all select 'quarter', date_trunc('quarter', session), max(session) from c group by 2) select unit, s as session from p where not (unit = 'month' and p = (select max(date_trunc('month', session)) from c)) and not (unit = 'quarter' and p = (select max(date_trunc('quarter', session)) from c))")
def f6_ends(df):
    c = df.select("session").distinct()
    return T.period_ends(c, "month").select(F.lit("month").alias("unit"), "session").unionByName(T.period_ends(c, "quarter").select(F.lit("quarter").alias("unit"), "session"))


@panel("f7_nonoverlap_sample", "f as (select inst, seq from bars where close > open), walk as (with recursive w(inst, seq) as (select inst, min(seq) from f group by inst union all select inst, nxt from (select w.inst, (select min(f.seq) from f where f.inst = w.inst and f.seq >= w.seq + 6) nxt from w) where nxt is not null) select * from w) select inst, cast(seq as bigint) seq from walk", ())
def f7(df):
    return T.spaced(df.filter("close > open").select("inst", "seq"), "inst", "seq", 6)


@panel("g1_union_all_scores", f"{MOM}, a as (select inst, session, 'mom' score, mom as val from mom where mom is not null union all select inst, session, 'size', ln(amount) from mom where amount > 0), p as (select *, percent_rank() over (partition by session, score order by val) pr from a), c as (select inst, session, 'combined' score, avg(pr) as val from p group by 1, 2 having count(*) = 2) select inst, session, score, round(val, 5) + 0.0 as val from a union all select inst, session, score, round(val, 5) + 0.0 from c")
def g1(df):
    from ..operators.exprs import by_session, safe_log

    raw = P.with_momentum(df).withColumn("size", safe_log("amount")).unpivot(["inst", "session"], ["mom", "size"], "score", "val").filter("val is not null")
    ranked = raw.withColumn("pr", F.percent_rank().over(by_session("score").orderBy("val")))
    both = ranked.groupBy("inst", "session").agg(F.count("*").alias("n"), F.avg("pr").alias("val")).filter("n = 2").select("inst", "session", F.lit("combined").alias("score"), "val")
    return raw.unionByName(both).withColumn("val", r("val", 5))


@panel("g3_distinct_signal_keys", f"{MOM} select distinct session, inst from (select session, inst from mom where mom is not null union all select session, inst from mom where volume > 100)")
def g3(df):
    x = P.with_momentum(df)
    return x.filter("mom is not null").select("session", "inst").union(x.filter("volume > 100").select("session", "inst")).distinct()


@panel("g5_append_extension", "select inst, session, round(case when seq <= 200 then close else close + 1 end, 4) + 0.0 close from bars where seq <= 200 or seq > 200")
def g5(df):
    end = df.filter("seq = 200").agg(F.max("session").alias("end"))
    old, new = df.filter("seq <= 220").select("inst", "session", "close"), df.filter("seq > 20").select("inst", "session", (F.col("close") + 1).alias("close"))
    cut = F.broadcast(end)
    x = T.append_extension(old.crossJoin(cut), new.crossJoin(cut), F.col("end"))
    return x.select("inst", "session", r("close", 4).alias("close"))


@table("g6_canonical_financial_union", _O + " select 'income' feed, k, day available, round(price, 2) + 0.0 net_income, null::double operating_cash, null::double total_assets from o where k % 4 = 0 union all select 'cash', k, day, null, round(price, 2) + 0.0, null from o where k % 4 = 1 union all select 'balance', k, day, null, null, round(price, 2) + 0.0 from o where k % 4 = 2 union all select 'indicator', k, day, null, null, null from o where k % 4 = 3", ("available",), False)
def g6(spark, sf_dir):
    from ..sources.tables import union_by_name

    o = orders(spark, sf_dir)
    feed = lambda i, name, *c: o.filter(F.col("k") % 4 == i).select(F.lit(name).alias("feed"), "k", F.col("day").alias("available"), *c)
    return union_by_name(feed(0, "income", r("price", 2).alias("net_income")), feed(1, "cash", r("price", 2).alias("operating_cash")), feed(2, "balance", r("price", 2).alias("total_assets")), feed(3, "indicator"))


@panel("g7_factor_cohort", f"{MOM}, a as (select session, inst, 'mom' factor, mom as val from mom where seq > 10 union all select session, inst, 'open0', open / close from mom where seq <= 300 union all select session, inst, 'rare', case when (inst + seq) % 3 = 0 then close end from mom), s as (select session from a group by 1 having count(distinct factor) = 3) select factor, count(*) n, round(count(val) / count(*)::double, 6) + 0.0 coverage, count(val) >= 0.9 * count(*) accepted from a where session in (select session from s) group by 1", ())
def g7(df):
    x = P.with_momentum(df)
    one = lambda name, rows, val: rows.select("session", "inst", F.lit(name).alias("factor"), val.alias("val"))
    _, cover = T.cohort([one("mom", x.filter("seq > 10"), F.col("mom")), one("open0", x.filter("seq <= 300"), safe_div("open", "close")), one("rare", x, F.when((F.col("inst") + F.col("seq")) % 3 == 0, F.col("close")))], 0.9)
    return cover.select("factor", "n", r("coverage").alias("coverage"), "accepted")


@panel("g8_factor_values_all", f"{MOM}, m as (select session, avg(mom) a, stddev_pop(mom) s from mom group by 1) select inst, session, 'RAW' variant, round(mom, 5) + 0.0 as val from mom union all select inst, mom.session, 'ZSCORE', round((mom - a) / nullif(s, 0), 5) + 0.0 from mom join m using (session)")
def g8(df):
    from ..operators.exprs import by_session

    x, w = P.with_momentum(df), by_session()
    raw = x.select("inst", "session", F.lit("RAW").alias("variant"), r("mom", 5).alias("val"))
    z = F.try_divide(F.col("mom") - F.avg("mom").over(w), F.nullif(F.stddev_pop("mom").over(w), F.lit(0.0)))
    return raw.unionByName(x.select("inst", "session", F.lit("ZSCORE").alias("variant"), r(z, 5).alias("val")))


__all__ = ["oracle"]
