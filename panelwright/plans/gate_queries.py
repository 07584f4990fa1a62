"""Queries of the quality gates, over tables with planted faults, with their SQL."""
from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import gates as G
from ..operators import panel as P
from ..operators.exprs import safe_div
from ..operators.windows import revisions
from ..sources.fixture import bars
from ..sources.tables import content_hash
from .base import MOM, panel, r
from .fact_queries import _EVENTS, raw_events
from .formula_queries import flawed
from .research_queries import _FACTS, facts, table
from .source_queries import _O, _SEC, orders, securities
from .temporal_queries import day


def _sql_rules(source, rules):
    return " union all ".join(f"select '{n}' check_name, count(*) filter ({c}) violations from {source}" for n, c in rules.items())


_FAULTY = "fb as (select case when seq % 90 = 0 then null else inst end inst, session, open, case when seq % 37 = 0 then low - 1 else high end high, low, close, case when seq % 41 = 0 then -volume when seq % 53 = 0 then volume * 100 else volume end volume, amount, case when seq % 70 = 0 then 0 else 1 end adj_factor from bars union all select inst, session, open, high, low, close, volume, amount, 1 from bars where seq % 60 = 0)"


def faulty(df):
    s = F.col("seq")
    x = flawed(df).withColumn("volume", F.when((s % 53 == 0) & (s % 41 != 0), F.col("volume") * 100).otherwise(F.col("volume")))
    x = x.withColumns({"inst": F.when(s % 90 != 0, F.col("inst")), "adj_factor": F.when(s % 70 == 0, 0).otherwise(1)}).drop("seq")
    return x.unionByName(df.filter("seq % 60 = 0").drop("seq").withColumn("adj_factor", F.lit(1)))


_MARKET = {"null_key": "inst is null or session is null", "ohlc": "high < greatest(open, close, low) or low > least(open, close)", "negative_volume": "volume < 0 or amount < 0", "factor_not_positive": "adj_factor <= 0", "unit": "volume > 0 and (amount / volume > high * 1.001 or amount / volume < low * 0.999)"}
_L1 = f"{_sql_rules('fb', _MARKET)} union all select 'duplicate_key', count(*) from (select inst, session from fb where inst is not null group by 1, 2 having count(*) > 1) union all select 'manifest_count', case when count(*) <> 0 then 1 else 0 end from fb"


@panel("l1_audit_market_faults", f"{_FAULTY} {_L1}", ())
def l1(df):
    return G.audit_market(faulty(df), 0)


_STATE = f"{_SEC}, cal as (select session, case when row_number() over (order by session) % 50 = 0 then session - 14 else lag(session) over (order by session) end previous from (select distinct session from bars)), st as (select k, session, (k + d) % 11 = 0 is_st, (k + d) % 7 <> 0 eligible from sec join (select session, row_number() over (order by session) d from cal) c on session >= list_date - 7 and (delist_date is null or session <= delist_date + 7) where k % 10 <> 3)"


def state(spark, sf_dir):
    cal = bars(spark, sf_dir).select("session").distinct()
    w = Window.partitionBy(F.lit(0)).orderBy("session")
    cal = cal.withColumns({"d": F.row_number().over(w), "_p": F.lag("session").over(w)}).withColumn("previous", F.when(F.col("d") % 50 == 0, F.date_sub("session", 14)).otherwise(F.col("_p"))).drop("_p")
    sec = securities(spark, sf_dir)
    from ..operators.temporal import listed_sessions

    wide = sec.withColumns({"list_date": F.date_sub("list_date", 7), "delist_date": F.date_add("delist_date", 7)})
    s = listed_sessions(wide, cal).join(F.broadcast(cal.select("session", "d")), "session").filter("k % 10 <> 3")
    return cal.select("session", "previous"), s.select("k", "session", ((F.col("k") + F.col("d")) % 11 == 0).alias("is_st"), ((F.col("k") + F.col("d")) % 7 != 0).alias("eligible")), sec


@table("l2_audit_reference", f"{_STATE}, lk as (select *, lag(session) over (order by session) was from cal), j as (select st.*, list_date, delist_date from st left join sec using (k)) select 'calendar_link' check_name, count(*) filter (previous <> was) violations from lk union all {_sql_rules('j', {'eligible_but_st': 'eligible and is_st', 'state_after_delisting': 'session > delist_date', 'state_before_listing': 'session < list_date', 'unknown_security': 'list_date is null'})} union all select 'delisted_without_state', count(*) from sec where delist_date is not null and k not in (select k from st)")
def l2(spark, sf_dir):
    return G.audit_reference(*state(spark, sf_dir))


_ACT = f"{_EVENTS}, ac as (select case when seq % 65 = 0 then null else inst end code, inst * 100000 + seq - seq % 26 lineage, ex_date, imp_ann imp_ann_date, seq % 3 <> 0 approved from ev1), jp as (select inst code, session, case when seq % 91 = 0 then -1 else 1.1::double end ratio from bars where seq % 7 = 0 union all select inst, session, 1.0::double from bars where seq % 140 = 0)"


@table("l3_audit_corporate_actions", f"{_ACT} {_sql_rules('ac', {'null_code': 'code is null', 'late_implementation': 'imp_ann_date > ex_date'})} union all select 'duplicate_lineage', count(*) from (select lineage from ac group by 1 having count(*) > 1) union all select 'duplicate_jump', count(*) from (select code, session from jp group by 1, 2 having count(*) > 1) union all select 'ratio_not_positive', count(*) from jp where ratio <= 0 union all select 'several_candidates', count(*) from (select code, ex_date from ac where approved group by 1, 2 having count(*) > 1) union all select 'approved_rows', count(*) from ac where approved")
def l3(spark, sf_dir):
    s = F.col("seq")
    a = raw_events(spark, sf_dir).select(F.when(s % 65 != 0, F.col("inst")).alias("code"), (F.col("inst") * 100000 + s - s % 26).alias("lineage"), "ex_date", F.col("imp_ann").alias("imp_ann_date"), (s % 3 != 0).alias("approved"))
    b = bars(spark, sf_dir)
    j = b.filter("seq % 7 = 0").select(F.col("inst").alias("code"), "session", F.when(s % 91 == 0, -1.0).otherwise(1.1).alias("ratio")).unionAll(b.filter("seq % 140 = 0").select("inst", "session", F.lit(1.0)))
    return G.audit_actions(a, j)


_FIN = f"with {_FACTS}, vs as (select *, available valid_from, case when k % 41 = 0 then available - 5 else lead(available) over (partition by inst, period_end order by available, k, value) end valid_to from facts)"


@table("l4_audit_financial", f"{_FIN} select 'reversed_interval' check_name, count(*) filter (valid_to < valid_from) violations from vs union all select 'union_count', case when (select count(*) from vs) <> (select count(*) from facts where k % 2 = 0) + (select count(*) from facts where k % 2 = 1) + 1 then 1 else 0 end union all select 'exceptions', count(*) from facts where k % 17 = 0", (), False)
def l4(spark, sf_dir):
    f = facts(spark, sf_dir)
    v = revisions(f, ["inst", "period_end"], "available", ["k", "value"]).withColumn("valid_from", F.col("available")).withColumn("valid_to", F.when(F.col("k") % 41 == 0, F.date_sub("available", 5)).otherwise(F.col("valid_to")))
    return G.audit_financial(v, [f.filter("k % 2 = 0"), f.filter("k % 2 = 1"), f.orderBy("k").limit(1)], f.filter("k % 17 = 0"))


_REC = _O + ", rc as (select k // 4 * 4 as key, cast(k % 2 as int) revision, day published, case when k % 19 = 0 then day - 1 else day + 1 end available, case when k % 23 = 0 then day - 2 else day + 2 end ingested, case when k % 29 = 0 then ' ' else 'src' end lineage, sha256('=' || k || '|' || '=' || status) recomputed, case when k % 31 = 0 then 'x' else sha256('=' || k || '|' || '=' || status) end digest from o)"


def records(spark, sf_dir):
    k = F.col("k")
    o = orders(spark, sf_dir)
    h = content_hash(["k", "status"])
    return o.select((F.floor(k / 4) * 4).alias("key"), (k % 2).cast("int").alias("revision"), F.col("day").alias("published"), F.when(k % 19 == 0, F.date_sub("day", 1)).otherwise(F.date_add("day", 1)).alias("available"), F.when(k % 23 == 0, F.date_sub("day", 2)).otherwise(F.date_add("day", 2)).alias("ingested"), F.when(k % 29 == 0, " ").otherwise("src").alias("lineage"), h.alias("recomputed"), F.when(k % 31 == 0, "x").otherwise(h).alias("digest"))


@table("l5_audit_records", f"{_REC} {_sql_rules('rc', {'available_before_publication': 'available < published', 'ingested_before_available': 'ingested < available', 'lineage_missing': chr(39) + chr(39) + ' = trim(lineage)', 'hash_mismatch': 'digest is distinct from recomputed'})} union all select 'conflicting_revision', count(*) from (select key, revision from rc group by 1, 2 having count(distinct digest) > 1)", (), False)
def l5(spark, sf_dir):
    return G.audit_records(records(spark, sf_dir))


@table("l6_audit_pit_inclusion", f"with {_FACTS}, c as (select *, available + cast(k % 20 as int) ingested, k % 3 <> 0 included from facts) select k, 'available_after_cutoff' reason from c where included and available > date '1998-06-30' union all select k, 'ingested_after_cutoff' from c where included and ingested > date '1998-06-30'", (), False)
def l6(spark, sf_dir):
    f = facts(spark, sf_dir).withColumns({"ingested": F.date_add("available", (F.col("k") % 20).cast("int")), "included": F.col("k") % 3 != 0})
    return G.pit_inclusion(f, day("1998-06-30"))


@table("l7_audit_signal_execution", _O + " select k, case when k % 7 = 0 then 'execution_before_information' else 'same_close_execution' end reason from o where k % 7 = 0 or (k % 5 = 0 and k % 3 = 0)", (), False)
def l7(spark, sf_dir):
    k = F.col("k")
    o = orders(spark, sf_dir).select("k", F.col("day").alias("informed"), F.when(k % 7 == 0, F.date_sub("day", 1)).when(k % 5 == 0, F.col("day")).otherwise(F.date_add("day", 1)).alias("executed"), (k % 3 == 0).alias("at_close"))
    return G.signal_execution(o)


_REL = f"{MOM}, rl as (select case when seq % 99 = 0 then 999 else inst end inst, session, 'mom' factor, case when seq % 45 = 0 then 'nan'::double else mom end as val, session + interval 7 hours - case when seq % 80 = 0 then interval 1 hour else interval 0 hour end available_at from mom union all select inst, session, 'mom', mom, session + interval 7 hours from mom where seq % 120 = 0)"


def release(df):
    s = F.col("seq")
    at = F.col("session").cast("timestamp_ntz") + F.expr("interval 7 hours")
    x = P.with_momentum(df)
    a = x.select(F.when(s % 99 == 0, 999).otherwise(F.col("inst")).alias("inst"), "session", F.lit("mom").alias("factor"), F.when(s % 45 == 0, float("nan")).otherwise(F.col("mom")).alias("val"), (at - F.when(s % 80 == 0, F.expr("interval 1 hour")).otherwise(F.expr("interval 0 hour"))).alias("available_at"))
    return a.unionByName(x.filter("seq % 120 = 0").select("inst", "session", F.lit("mom").alias("factor"), F.col("mom").alias("val"), at.alias("available_at")))


_L9 = "select 'clock' check_name, count(*) filter (available_at is distinct from session + interval 7 hours) violations from rl union all select 'not_finite', count(*) filter (isnan(val) or isinf(val)) from rl union all select 'outside_universe', count(*) from rl where (inst, session) not in (select (inst, session) from bars) union all select 'duplicate_key', count(*) from (select inst, session, factor from rl group by 1, 2, 3 having count(*) > 1)"


@panel("l9_audit_factor_release", f"{_REL} {_L9}", ())
def l9(df):
    return G.audit_release(release(df), df.select("inst", "session"), F.col("session").cast("timestamp_ntz") + F.expr("interval 7 hours"))


_CMP = f"{MOM}, nw as (select inst, session, mom * case when seq % 77 = 0 then 1.001::double else 1 end v, case when seq % 66 = 0 then 'v2' else 'v1' end ver from mom where seq > 10), od as (select inst, session, case when seq % 55 = 0 then null else mom end v, 'v1' ver from mom where seq <= 340), j as (select nw.inst ni, od.inst oi, nw.v nv, od.v ov, nw.ver nr, od.ver orv from nw full join od on nw.inst = od.inst and nw.session = od.session)"
_CMP_RULES = {"only_new": "oi is null", "only_old": "ni is null", "metadata": "ni is not null and oi is not null and nr is distinct from orv", "null_mask": "ni is not null and oi is not null and (nv is null) <> (ov is null)", "values": "abs(nv - ov) > 1e-12 + 1e-10 * greatest(abs(nv), abs(ov))"}


def compared(df):
    s, x = F.col("seq"), P.with_momentum(df)
    new = x.filter("seq > 10").select("inst", "session", (F.col("mom") * F.when(s % 77 == 0, 1.001).otherwise(1.0)).alias("v"), F.when(s % 66 == 0, "v2").otherwise("v1").alias("ver"))
    old = x.filter("seq <= 340").select("inst", "session", F.when(s % 55 != 0, F.col("mom")).alias("v"), F.lit("v1").alias("ver"))
    return G.compare_releases(new, old, ["inst", "session"], "v", ["ver"])


@panel("l10_verify_release_differences", f"{_CMP} {_sql_rules('j', _CMP_RULES)}", ())
def l10(df):
    return compared(df)


@panel("l12_verify_bank_values", f"{MOM}, w as (select inst, session, seq, mom, close, lag(close, 5) over (partition by inst order by session) c5, min(session) over (partition by inst, year(session)) a, max(session) over (partition by inst, year(session)) b from (select *, avg(close) over (partition by inst) > (select avg(close) from bars) eligible from mom) where eligible), e as (select *, case when c5 <> 0 then close / c5 - 1 end again from w where session = a or session = b) select 'only_new' check_name, 0 violations union all select 'only_old', count(*) from e where seq % 8 = 0 union all select 'metadata', 0 union all select 'null_mask', 0 union all select 'values', count(*) from e where seq % 8 <> 0 and seq % 9 = 0 and abs(mom) * 0.001 > 1e-12", ())
def l12(df):
    """Published values against witnesses computed anew at the first and last session of each instrument's year."""
    # eligible: instruments that trade above the average of the market
    level = df.groupBy("inst").agg(F.avg("close").alias("_own")).crossJoin(F.broadcast(df.agg(F.avg("close").alias("_all"))))
    x = P.with_momentum(df).join(level.select("inst", (F.col("_own") > F.col("_all")).alias("eligible")), "inst").filter("eligible").drop("eligible")
    w = Window.partitionBy("inst", F.year("session"))
    ends = x.withColumns({"_a": F.min("session").over(w), "_b": F.max("session").over(w)}).filter("session = _a or session = _b")
    old = df.select("inst", (F.col("seq") + 5).alias("seq"), F.col("close").alias("c5"))
    witnesses = ends.join(old, ["inst", "seq"], "left").select("inst", "session", (safe_div("close", "c5") - 1).alias("v"))
    wrong = F.when(F.col("seq") % 9 == 0, 1.001).otherwise(1.0)
    published = ends.filter("seq % 8 <> 0").select("inst", "session", (F.col("mom") * wrong).alias("v"))
    return G.compare_releases(published, witnesses, ["inst", "session"], "v")


_CHAIN = _O + ", lg as (select status || strftime(day, '%Y-%m') ledger, row_number() over (partition by status, strftime(day, '%Y-%m') order by k) sq from o) select ledger, sq, 'own_hash' reason from lg where sq % 5 = 0 union all select ledger, sq, 'previous_hash' from lg where sq % 7 = 0 or (sq > 1 and (sq - 1) % 5 = 0)"


def ledgers(spark, sf_dir):
    """Chains of hashes, one of each status and month; each seventh entry names a wrong predecessor, each fifth has a false hash."""
    o = orders(spark, sf_dir).withColumn("ledger", F.concat("status", F.date_format("day", "yyyy-MM")))

    def chain(batches):
        ledger, sq, last = None, 0, ""
        for batch in batches:
            out = []
            for name, k, priority in zip(*(batch.column(c).to_pylist() for c in ("ledger", "k", "priority"))):
                sq, last = (sq + 1, last) if name == ledger else (1, "")
                before = "wrong" if sq % 7 == 0 else last
                last, ledger = hashlib.sha256("|".join((before, str(k), priority)).encode()).hexdigest(), name
                out.append({"ledger": name, "sq": sq, "k": k, "priority": priority, "previous": before, "digest": last})
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("ledger", pa.string()), ("sq", pa.int64()), ("k", pa.int64()), ("priority", pa.string()), ("previous", pa.string()), ("digest", pa.string())]))

    line = o.select("ledger", F.col("k").cast("long").alias("k"), "priority").repartition("ledger").sortWithinPartitions("ledger", "k", "priority")
    x = line.mapInArrow(chain, "ledger string, sq long, k long, priority string, previous string, digest string")
    return x.withColumn("digest", F.when(F.col("sq") % 5 == 0, "x").otherwise(F.col("digest")))


@table("l11_hash_chain_verify", _CHAIN, (), False)
def l11(spark, sf_dir):
    return G.hash_chain(ledgers(spark, sf_dir), "ledger", "sq", "previous", "digest", ["k", "priority"])


_EXE = "ex as (select capital, session, count(*) selected, count(*) filter (capital / 20 / amount <= 1) filled, count(*) filter (not capital / 20 / amount <= 1) + case when max(seq) % 100 = 0 then 1 else 0 end rejected, avg(close / open - 1) gross, avg(close / open - 1) - case when max(seq) % 90 = 0 then -0.1::double else 0.001::double end net, least(100, sqrt(avg(capital / amount))) cost, case when max(seq) % 70 = 0 then 1.5::double else 0.5::double end turnover from bars cross join (values (10000::double), (100000::double), (1000000::double)) c(capital) where amount > 0 group by 1, 2), sm as (select capital, sum(filled) / sum(selected)::double fill_rate, avg(cost) + case when capital = 100000 then 0.01::double else 0 end mean_cost from ex group by 1), ag as (select capital, sum(filled) / sum(selected)::double rate, avg(cost) c from ex group by 1)"


def executions(df):
    x = df.filter("amount > 0").withColumn("capital", F.explode(F.array(*(F.lit(float(c)) for c in (10_000, 100_000, 1_000_000)))))
    small, q = F.col("capital") / 20 / F.col("amount") <= 1, F.max("seq")
    ret = F.avg(F.col("close") / F.col("open") - 1)
    daily = x.groupBy("capital", "session").agg(F.count("*").alias("selected"), F.count(F.when(small, 1)).alias("filled"), (F.count(F.when(~small, 1)) + F.when(q % 100 == 0, 1).otherwise(0)).alias("rejected"), ret.alias("gross"), (ret - F.when(q % 90 == 0, -0.1).otherwise(0.001)).alias("net"), F.least(F.lit(100.0), F.sqrt(F.avg(F.col("capital") / F.col("amount")))).alias("cost"), F.when(q % 70 == 0, 1.5).otherwise(0.5).alias("turnover"))
    summary = daily.groupBy("capital").agg((F.sum("filled") / F.sum("selected")).alias("fill_rate"), F.avg("cost").alias("mean_cost")).withColumn("mean_cost", F.col("mean_cost") + F.when(F.col("capital") == 100_000, 0.01).otherwise(0.0))
    return daily, summary


@panel("l14_audit_execution", f"{_EXE} {_sql_rules('ex', {'net_above_gross': 'net > gross + 1e-12', 'negative_cost': 'cost < 0', 'filled_above_selected': 'filled > selected', 'unreconciled': 'filled + rejected <> selected', 'turnover_range': 'turnover not between 0 and 1'})} union all select 'summary_drift', count(*) filter (abs(fill_rate - rate) > 1e-9 or abs(mean_cost - c) > 1e-9) from sm join ag using (capital) union all select 'fill_rate_rises', count(*) filter (fill_rate > f0 + 1e-12) from (select fill_rate, lag(fill_rate) over (order by capital) f0 from sm) union all select 'cost_falls', count(*) filter (mean_cost < c0 - 1e-12) from (select mean_cost, lag(mean_cost) over (order by capital) c0 from sm)", ())
def l14(df):
    return G.audit_execution(*executions(df))


@panel("l13_audit_overview", f"{_REL}, {_FAULTY}, {_CMP.removeprefix(MOM + ', ')}, a as (select 'market' dataset, * from ({_L1}) union all select 'release', * from ({_L9}) union all select 'comparison', * from ({_sql_rules('j', _CMP_RULES)})), g as (select dataset, count(*) checks, count(*) filter (violations > 0 and not check_name in ('metadata', 'only_new', 'only_old', 'null_mask', 'values')) failed, count(*) filter (violations > 0 and check_name in ('metadata', 'only_new', 'only_old', 'null_mask', 'values')) warned, cast(sum(violations) as bigint) violations from a group by 1) select dataset, checks, failed, violations, case when failed > 0 then 'blocked' when warned > 0 then 'warning' else 'passed' end status from g", ())
def l13(df):
    clock = F.col("session").cast("timestamp_ntz") + F.expr("interval 7 hours")
    audits = {"market": G.audit_market(faulty(df), 0), "release": G.audit_release(release(df), df.select("inst", "session"), clock), "comparison": compared(df)}
    return G.overview(audits, ("metadata", "only_new", "only_old", "null_mask", "values"))


@panel("l8_label_purge", "s as (select inst, session, lead(session, 6) over (partition by inst order by session) e from bars) select inst, session from s where session < date '1999-01-04' and e < date '1999-01-04'")
def l8(df):
    from ..operators.evidence import purge
    from ..operators.exprs import by_instrument

    x = df.withColumn("e", F.lead("session", 6).over(by_instrument())).filter(F.col("session") < day("1999-01-04"))
    return purge(x, "e", day("1999-01-04")).select("inst", "session")


__all__ = ["r"]
