"""Queries of facts, dividends and sector indicators, with their SQL."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import events as V
from ..operators import facts as X
from ..operators.order_stats import with_history_percentile
from ..operators.exprs import by_instrument, by_session, safe_div
from ..sources.fixture import bars
from .base import _N, _W, RET, r
from .research_queries import _FACTS, facts, table

# ---- statements

_STMT = f"{_FACTS}, st as (select *, value net_income, value * 1.2::double total_profit, value * 4 revenue, value * 1.5::double operating_profit, value * 3 cost, value * (0.5::double + (k % 7) / 10.0::double) operating_cash, value * ((k % 5) - 2) / 10.0::double net_cash from facts)"
_FLOWS = ["net_income", "total_profit", "revenue", "operating_profit", "cost", "operating_cash", "net_cash"]
_TTM = f"{_STMT}, v as (select * from st qualify row_number() over (partition by inst, available, period_end order by k desc, value desc) = 1), cur as (select * from v qualify period_end = max(period_end) over (partition by inst, available)), j1 as (select p.*, {', '.join(f'a.{c} a_{c}' for c in _FLOWS)}, cast(last_day(p.period_end - interval 12 months) as date) before from (select *, make_date(year(period_end) - 1, 12, 31) annual from cur) p asof left join v a on a.inst = p.inst and a.period_end = p.annual and p.available >= a.available), j2 as (select j.*, {', '.join(f'q.{c} q_{c}' for c in _FLOWS)} from j1 j asof left join v q on q.inst = j.inst and q.period_end = j.before and j.available >= q.available), ttm as (select inst, available, {', '.join(f'case when month(period_end) = 12 then {c} else {c} + a_{c} - q_{c} end {c}' for c in _FLOWS)} from j2)"


def statements(spark, sf_dir):
    v, k = F.col("value"), F.col("k")
    return facts(spark, sf_dir).withColumns({"net_income": v, "total_profit": v * 1.2, "revenue": v * 4, "operating_profit": v * 1.5, "cost": v * 3, "operating_cash": v * (0.5 + (k % 7) / 10.0), "net_cash": v * ((k % 5) - 2) / 10.0})


@table("h15_trailing_twelve_months", f"with {_TTM} select inst, available, round(net_income, 2) + 0.0 net_income, round(operating_cash, 2) + 0.0 operating_cash from ttm", ("available",), False)
def h15(spark, sf_dir):
    x = X.trailing_twelve_months(statements(spark, sf_dir), _FLOWS, ["k", "value"])
    return x.select("inst", "available", r("net_income", 2).alias("net_income"), r("operating_cash", 2).alias("operating_cash"))


_BAL = "bal as (select inst, available, k, value * 20 assets, value * 12 liabilities, value * 8 equity, value * 6 current_assets, value * (3 + k % 3) current_liabilities, value money, case when k % 4 <> 0 then value * 0.5::double end st_borr, case when k % 3 <> 0 then value * 0.25::double end due_1y, value * 2 lt_borr, null::double bonds, value * 0.9::double profit_dedt, case when k % 5 <> 0 then cast(k % 40 - 20 as double) end or_yoy, case when k % 3 <> 0 then cast(k % 30 - 10 as double) end netprofit_yoy, case when k % 4 <> 0 then cast(k % 20 as double) end assets_yoy from facts qualify row_number() over (partition by inst, available order by period_end desc, k desc, value desc) = 1)"
_BALANCE = ["assets", "liabilities", "equity", "current_assets", "current_liabilities", "money", "st_borr", "due_1y", "lt_borr", "bonds", "profit_dedt", "or_yoy", "netprofit_yoy", "assets_yoy"]


def balances(spark, sf_dir):
    v, k = F.col("value"), F.col("k")
    d = lambda cond, x: F.when(cond, x.cast("double"))
    b = X.versions(facts(spark, sf_dir), ["inst", "available"], ["period_end", "k", "value"])
    return b.select("inst", "available", (v * 20).alias("assets"), (v * 12).alias("liabilities"), (v * 8).alias("equity"), (v * 6).alias("current_assets"), (v * (3 + k % 3)).alias("current_liabilities"), v.alias("money"), d(k % 4 != 0, v * 0.5).alias("st_borr"), d(k % 3 != 0, v * 0.25).alias("due_1y"), (v * 2).alias("lt_borr"), F.lit(None).cast("double").alias("bonds"), (v * 0.9).alias("profit_dedt"), d(k % 5 != 0, k % 40 - 20).alias("or_yoy"), d(k % 3 != 0, k % 30 - 10).alias("netprofit_yoy"), d(k % 4 != 0, k % 20).alias("assets_yoy"))


_EV = "(market_cap + coalesce(st_borr, 0) + coalesce(due_1y, 0) + coalesce(lt_borr, 0) + coalesce(bonds, 0) - coalesce(money, 0))"
_RATIOS = {
    "cash_flow_to_price": "net_cash / nullif(market_cap, 0)", "cash_earnings_to_price": "operating_cash / nullif(market_cap, 0)", "earnings_to_price": "net_income / nullif(market_cap, 0)",
    "roe_ttm": "net_income / nullif(equity, 0)", "roa_ttm": "net_income / nullif(assets, 0)", "acca": "(net_income - operating_cash) / nullif(assets, 0)",
    "adjusted_profit_to_total_profit": "profit_dedt / nullif(total_profit, 0)", "net_operating_cash_flow_coverage": "operating_cash / nullif(net_income, 0)", "debt_to_equity": "liabilities / nullif(equity, 0)",
    "operating_cashflow_to_ev": f"case when {_EV} > 0 then operating_cash / {_EV} end", "gross_margin": "(revenue - cost) / nullif(revenue, 0)", "operating_margin": "operating_profit / nullif(revenue, 0)",
    "asset_turnover": "revenue / nullif(assets, 0)", "operating_cashflow_to_debt": "operating_cash / nullif(liabilities, 0)", "current_ratio": "current_assets / nullif(current_liabilities, 0)",
    "revenue_growth_yoy": "or_yoy / 100", "growth": "(coalesce(or_yoy, 0) + coalesce(netprofit_yoy, 0) + coalesce(assets_yoy, 0)) / nullif(case when or_yoy is not null then 1 else 0 end + case when netprofit_yoy is not null then 1 else 0 end + case when assets_yoy is not null then 1 else 0 end, 0) / 100",
}


@table("h16_fundamental_ratios", f"{_TTM}, {_BAL}, u as (select inst, session, amount * 10 market_cap from bars), j as (select u.*, {', '.join('t.' + c for c in _FLOWS)} from u asof left join ttm t on t.inst = u.inst and u.session > t.available), z as (select j.*, {', '.join('b.' + c for c in _BALANCE)} from j asof left join bal b on b.inst = j.inst and j.session > b.available) select inst, session, {', '.join(f'round({x}, 5) + 0.0 {n}' for n, x in _RATIOS.items())} from z", ("session",))
def h16(spark, sf_dir):
    u = bars(spark, sf_dir).select("inst", "session", (F.col("amount") * 10).alias("market_cap"))
    x = X.asof_last(u, X.trailing_twelve_months(statements(spark, sf_dir), _FLOWS, ["k", "value"]), ["inst"], "session", "available", _FLOWS)
    x = X.asof_last(x, balances(spark, sf_dir), ["inst"], "session", "available", _BALANCE)
    return x.select("inst", "session", *(r(c, 5).alias(n) for n, c in X.fundamental_ratios().items()))


# ---- metrics of several sources

_METRICS = ["roe", "npl", "provision", "cet1", "nim", "bvps", "eps", "profit"]
_SCALE = ["5 + (k % 100) / 10.0::double", "0.8::double + (k % 20) / 10.0::double", "120 + cast(k % 200 as double)", "7 + (k % 50) / 10.0::double", "1.5::double + (k % 15) / 10.0::double", "10 + cast(k % 40 as double)", "1 + (k % 20) / 10.0::double", "100 + cast(k % 60 as double)"]
_MF = f"{_FACTS}, mf as (select inst, [{', '.join(map(repr, _METRICS))}][1 + cast(k % 8 as int)] metric, period_end report_date, available, cast(k % 3 as int) priority, case when k % 37 = 0 then 'B' else 'A' end basis, k, case cast(k % 8 as int) {' '.join(f'when {i} then {x}' for i, x in enumerate(_SCALE))} end as value from facts)"


def metric_facts(spark, sf_dir):
    k = F.col("k")
    scale = [5 + (k % 100) / 10.0, 0.8 + (k % 20) / 10.0, 120.0 + k % 200, 7 + (k % 50) / 10.0, 1.5 + (k % 15) / 10.0, 10.0 + k % 40, 1 + (k % 20) / 10.0, 100.0 + k % 60]
    value = F.lit(None).cast("double")
    for i, x in enumerate(scale):
        value = F.when(k % 8 == i, x).otherwise(value)
    metric = F.element_at(F.array(*map(F.lit, _METRICS)), (k % 8).cast("int") + 1)
    return facts(spark, sf_dir).select("inst", metric.alias("metric"), F.col("period_end").alias("report_date"), "available", (k % 3).cast("int").alias("priority"), F.when(k % 37 == 0, "B").otherwise("A").alias("basis"), "k", value.alias("value"))


# the fact of each (instrument, session, metric) by brute force: rank what was known the day before
_PICK = """{0} as (select inst, session, metric, report_date, case when nb = 1 and hi - lo <= 1e-8 * greatest(1, abs(value)) then value end as value, basis, k, case when nb = 1 and hi - lo <= 1e-8 * greatest(1, abs(value)) then 'ok' else 'conflict' end status from (
select s.inst, s.session, f.metric, f.report_date, first(f.value order by f.k) as value, first(f.basis order by f.k) basis, min(f.k) k, count(distinct f.basis) nb, max(f.value) hi, min(f.value) lo, row_number() over (partition by s.inst, s.session, f.metric{1} order by f.report_date desc, f.priority, f.available desc) rn
from (select distinct inst, session from bars) s join mf f on f.inst = s.inst and f.available < s.session group by s.inst, s.session, f.metric, f.report_date, f.priority, f.available) where rn = 1)"""


def sessions_of(spark, sf_dir, metrics):
    return bars(spark, sf_dir).select("inst", "session").withColumn("metric", F.explode(F.array(*map(F.lit, metrics))))


@table("i1_select_fact", f"{_MF}, {_PICK.format('pick', '')}, g as (select inst, session, m metric from bars cross join (select unnest({_METRICS}) m)) select g.inst, g.session, g.metric, case when g.session - report_date between 0 and 550 then round(value, 4) + 0.0 end as value, case when k is null then 'none' when g.session - report_date between 0 and 550 then status else 'stale' end status from g left join pick using (inst, session, metric)", ("session",))
def i1(spark, sf_dir):
    x = X.known_facts(sessions_of(spark, sf_dir, _METRICS), metric_facts(spark, sf_dir), ["inst", "metric"], ["inst", "metric"])
    return x.select("inst", "session", "metric", r("value", 4).alias("value"), "status")


_CHANGE = f"{_MF}, {_PICK.format('pick', '')}, {_PICK.format('prior', ', f.report_date')}, g as (select inst, session, m metric from bars cross join (select unnest({_METRICS}) m)), cur as (select g.*, report_date, case when g.session - report_date between 0 and 550 then value end as value, basis, k from g left join pick using (inst, session, metric)), chg as (select c.*, p.value prior_value, p.basis prior_basis, p.k prior_k, case when c.value is null then 'no_current' when p.value is null then 'no_prior' when p.basis <> c.basis then 'basis_changed' else 'ready' end comparison from cur c left join prior p on p.inst = c.inst and p.session = c.session and p.metric = c.metric and p.report_date = last_day(c.report_date - interval 12 months))"


def changes(spark, sf_dir):
    return X.with_prior_year(sessions_of(spark, sf_dir, _METRICS), metric_facts(spark, sf_dir))


@table("i3_same_period_change_basis", f"{_CHANGE} select inst, session, metric, comparison, case when comparison = 'ready' then round(value - prior_value, 4) + 0.0 end change from chg", ("session",))
def i3(spark, sf_dir):
    return changes(spark, sf_dir).select("inst", "session", "metric", "comparison", F.when(F.col("comparison") == "ready", r(F.col("value") - F.col("prior_value"), 4)).alias("change"))


@table("i4_disclosure_lineage", f"{_CHANGE} select inst, session, metric, coalesce(k, -1) current_fact, coalesce(prior_k, -1) prior_fact, comparison status from chg where metric in ('nim', 'npl')", ("session",))
def i4(spark, sf_dir):
    x = changes(spark, sf_dir).filter(F.col("metric").isin("nim", "npl"))
    return x.select("inst", "session", "metric", F.coalesce("k", F.lit(-1)).alias("current_fact"), F.coalesce("prior_k", F.lit(-1)).alias("prior_fact"), F.col("comparison").alias("status"))


_YEARS = f"with {_FACTS}, y as (select inst, cast(year(period_end) as bigint) y, value from facts where month(period_end) = 12 and (inst + year(period_end)) % 6 <> 0 qualify row_number() over (partition by inst, period_end order by available desc, k desc, value desc) = 1), l as (select *, lag(value, 1) over w v1, lag(value, 2) over w v2, lag(y, 1) over w y1, lag(y, 2) over w y2 from y window w as (partition by inst order by y))"


@table("i5_three_year_stats", f"{_YEARS} select inst, y, case when y1 = y - 1 and y2 = y - 2 then round(list_median([value, v1, v2]), 2) + 0.0 end median3, case when y1 = y - 1 and y2 = y - 2 then round(list_stddev_pop([value, v1, v2]), 2) + 0.0 end volatility3 from l", (), False)
def i5(spark, sf_dir):
    f = facts(spark, sf_dir).filter((F.month("period_end") == 12) & ((F.col("inst") + F.year("period_end")) % 6 != 0))
    y = X.versions(f, ["inst", "period_end"], ["available", "k", "value"]).select("inst", F.year("period_end").cast("long").alias("y"), "value")
    return X.three_year_stats(y, "inst", "y", "value").select("inst", "y", r("median3", 2).alias("median3"), r("volatility3", 2).alias("volatility3"))


_TIER = "(case when roe >= 11 then 28 when roe >= 9.5 then 24 when roe >= 8 then 20 when roe >= 6 then 10 else 2 end + case when npl <= 1.2 then 14 when npl <= 1.6 then 12 when npl <= 2 then 8 else 2 end + case when provision >= 250 then 10 when provision >= 180 then 8 when provision >= 150 then 5 else 1 end) / 52.0::double * 100"
_WIDE = f"{_CHANGE}, wide as (select inst, session, max(case when metric = 'roe' then value end) roe, max(case when metric = 'npl' then value end) npl, max(case when metric = 'provision' then value end) provision, max(case when metric = 'cet1' then value end) cet1, max(case when metric = 'nim' then value end) nim, max(case when metric = 'bvps' then value end) bvps, max(case when metric = 'eps' then value end) eps, max(case when metric = 'npl' and comparison = 'ready' then value - prior_value end) npl_change, max(case when metric = 'nim' and comparison = 'ready' then value - prior_value end) nim_change, max(case when metric = 'profit' and comparison = 'ready' then value / prior_value - 1 end) profit_growth, max(case when metric = 'cet1' and comparison = 'ready' then value - prior_value end) cet1_change, max(case when metric = 'provision' and comparison = 'ready' then value - prior_value end) provision_change from chg group by 1, 2), q as (select *, case when roe is not null and npl is not null and provision is not null then {_TIER} end score from wide), gated as (select *, case when score is not null then case when score >= 75 and roe >= 8 and npl <= 2 and provision >= 150 and not coalesce(npl_change > 0.2 + 1e-10, false) and not coalesce(cet1 < 8.5, false) and not coalesce(profit_growth < -0.05, false) then 1.0::double else 0.0::double end end gate from q)"


def wide_facts(spark, sf_dir):
    of = lambda m, x: F.max(F.when(F.col("metric") == m, x))
    diff = F.when(F.col("comparison") == "ready", F.col("value") - F.col("prior_value"))
    ratio = F.when(F.col("comparison") == "ready", F.col("value") / F.col("prior_value") - 1)
    w = changes(spark, sf_dir).groupBy("inst", "session").agg(*(of(m, F.col("value")).alias(m) for m in _METRICS if m != "profit"), of("npl", diff).alias("npl_change"), of("nim", diff).alias("nim_change"), of("profit", ratio).alias("profit_growth"), of("cet1", diff).alias("cet1_change"), of("provision", diff).alias("provision_change"))
    return w.withColumn("score", X.quality_score()).withColumn("gate", X.quality_gate())


@table("i6_tier_score", f"{_WIDE} select inst, session, round(score, 4) + 0.0 score from gated", ("session",))
def i6(spark, sf_dir):
    return wide_facts(spark, sf_dir).select("inst", "session", r("score", 4).alias("score"))


@table("i7_quality_gate", f"{_WIDE} select inst, session, gate from gated", ("session",))
def i7(spark, sf_dir):
    return wide_facts(spark, sf_dir).select("inst", "session", "gate")


# ---- dividends

_EVENTS = "ev0 as (select cast(l_suppkey % 20 as int) inst, cast(date_trunc('week', l_shipdate) as date) ex_date, cast(l_tax as double) cash, cast(l_discount as double) stock, l_orderkey % 23 lead_days, row_number() over (partition by l_suppkey % 20, date_trunc('week', l_shipdate) order by l_orderkey, l_partkey, l_linenumber, l_quantity, l_tax, l_discount) rn from lineitem where l_returnflag = 'R'), ev1 as (select e.inst, e.ex_date, case when b.seq % 11 = 3 then null else e.cash end cash, e.stock, case when b.seq % 7 = 2 then null else e.ex_date - cast(lead_days as int) + 2 end imp_ann, b.seq, rn from ev0 e join bars b on b.inst = e.inst and b.session = e.ex_date where b.seq % 13 = 0 and rn <= case when b.seq % 39 = 0 then 2 else 1 end), ev as (select inst, ex_date, case when count(*) = 1 then max(cash) end cash, case when count(*) = 1 then max(stock) end stock, case when count(imp_ann) = count(*) then max(imp_ann) end imp_ann, count(*) > 1 conflict, max(seq) seq from ev1 group by 1, 2)"


def raw_events(spark, sf_dir):
    from pyspark.sql import Window

    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").filter("l_returnflag = 'R'")
    inst, day = (F.col("l_suppkey") % 20).cast("int"), F.date_trunc("week", "l_shipdate").cast("date")
    order = ["l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_tax", "l_discount"]
    e = li.select(inst.alias("inst"), day.alias("ex_date"), F.col("l_tax").cast("double").alias("cash"), F.col("l_discount").cast("double").alias("stock"), (F.col("l_orderkey") % 23).cast("int").alias("lead_days"), *order)
    e = e.withColumn("rn", F.row_number().over(Window.partitionBy("inst", "ex_date").orderBy("l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_tax", "l_discount"))).drop(*order)
    b = bars(spark, sf_dir).filter("seq % 13 = 0").select("inst", F.col("session").alias("ex_date"), "seq")
    x = e.join(b, ["inst", "ex_date"]).filter(F.col("rn") <= F.when(F.col("seq") % 39 == 0, 2).otherwise(1))
    announced = F.when(F.col("seq") % 7 != 2, F.date_add(F.col("ex_date"), 2 - F.col("lead_days")))
    return x.select("inst", "ex_date", F.when(F.col("seq") % 11 != 3, F.col("cash")).alias("cash"), "stock", announced.alias("imp_ann"), "seq")


def events(spark, sf_dir):
    return X.unique_events(raw_events(spark, sf_dir))


@table("i8_dedupe_dividend_events", f"{_EVENTS} select inst, ex_date, imp_ann, round(cash, 4) + 0.0 cash, round(stock, 4) + 0.0 stock, conflict from ev", ("ex_date", "imp_ann"))
def i8(spark, sf_dir):
    return events(spark, sf_dir).select("inst", "ex_date", "imp_ann", r("cash", 4).alias("cash"), r("stock", 4).alias("stock"), "conflict")


_KNOWN = f"{_EVENTS}, kn as (select b.inst, b.session, e.ex_date, e.cash, e.stock, product(1 + e.stock) over w scale, sum(case when e.stock is null then 1 else 0 end) over w bad_after from bars b join ev e on e.inst = b.inst and e.ex_date <= b.session and e.imp_ann < b.session window w as (partition by b.inst, b.session order by e.ex_date desc)), tot as (select inst, session, sum(cash / scale) total, count(*) n, count(cash) nc, max(bad_after) bad from kn where session - ex_date between 0 and 364 group by 1, 2), cps as (select b.inst, b.session, b.close, b.seq, case when n is null then 0 when nc = n and bad = 0 then total end cash from bars b left join tot using (inst, session))"


def cash_per_share(spark, sf_dir):
    b = bars(spark, sf_dir).select("inst", "session", "close", "seq")
    return V.cash_per_current_share(b, events(spark, sf_dir))


@table("i9_cash_per_current_share_365", f"{_KNOWN} select inst, session, round(cash, 6) + 0.0 cash from cps", ("session",))
def i9(spark, sf_dir):
    return cash_per_share(spark, sf_dir).select("inst", "session", r("cash").alias("cash"))


_BARS2 = f"{_EVENTS}, b2 as (select b.inst, b.session, b.seq, b.close, case when b.seq % 17 = 5 then lag(close) over w + 0.5::double else (lag(close) over w - coalesce(e.cash, 0)) / (1 + coalesce(e.stock, 0)) end pre_close, lag(close) over w before, lag(close) over w is not null has_before, e.inst is not null has_event, e.cash, e.stock, e.imp_ann, e.conflict from bars b left join ev e on e.inst = b.inst and e.ex_date = b.session window w as (partition by b.inst order by b.session))"


def quoted(spark, sf_dir):
    """Bars with the exchange's reference price, which departs from the events at some sessions."""
    b = bars(spark, sf_dir).select("inst", "session", "seq", "close")
    e = events(spark, sf_dir).select("inst", F.col("ex_date").alias("session"), F.col("cash").alias("c"), F.col("stock").alias("s"))
    before = F.lag("close").over(by_instrument())
    x = b.join(e, ["inst", "session"], "left")
    return x.withColumn("pre_close", F.when(F.col("seq") % 17 == 5, before + 0.5).otherwise((before - F.coalesce("c", F.lit(0.0))) / (1 + F.coalesce("s", F.lit(0.0))))).drop("c", "s")


_BROKEN = "coalesce(has_before and ((has_event and (imp_ann is null or imp_ann >= session or cash is null or stock is null or stock < 0)) or pre_close is null or abs((before - coalesce(cash, 0)) / (1 + coalesce(stock, 0)) - pre_close) > 0.011), false)"


@table("i11_per_share_invalidation", f"{_BARS2} select inst, session, {_BROKEN} unexplained from b2", ("session",))
def i11(spark, sf_dir):
    return X.reference_changes(quoted(spark, sf_dir), events(spark, sf_dir)).select("inst", "session", "unexplained")


@table("i12_normalize_per_share", f"{_MF}, {_PICK.format('pick', '')}, {_BARS2}, br as (select inst, session d from b2 where {_BROKEN}), c as (select b.inst, b.session, p.report_date, p.value from bars b join pick p on p.inst = b.inst and p.session = b.session and p.metric = 'bvps'), s as (select c.inst, c.session, product(1 + e.stock) scale, count(*) n, count(e.stock) ns from c join ev e on e.inst = c.inst and e.ex_date > c.report_date and e.ex_date <= c.session and e.imp_ann < c.session group by 1, 2), k as (select distinct c.inst, c.session from c join br on br.inst = c.inst and br.d > c.report_date and br.d <= c.session) select c.inst, c.session, case when k.inst is null and coalesce(n = ns, true) then round(value / coalesce(scale, 1), 4) + 0.0 end per_share from c left join s using (inst, session) left join k using (inst, session)", ("session",))
def i12(spark, sf_dir):
    ev = events(spark, sf_dir)
    breaks = X.reference_changes(quoted(spark, sf_dir), ev).filter("unexplained").select("inst", "session")
    now = X.known_facts(sessions_of(spark, sf_dir, ["bvps"]), metric_facts(spark, sf_dir), ["inst", "metric"], ["inst", "metric"], None).filter("report_date is not null")
    return V.per_current_share(now, ev, breaks).select("inst", "session", r("per_share", 4).alias("per_share"))


_TR = f"{_BARS2}, tr0 as (select *, case when close is null or close <= 0 then 'invalid_price' when before is null then 'segment_start' when has_event and conflict then 'unresolved_event' when has_event and (imp_ann is null or imp_ann >= session) then 'event_not_known' when has_event and (cash is null or cash < 0 or stock is null or stock < 0) then 'invalid_event_value' when pre_close is null or abs((before - coalesce(cash, 0)) / (1 + coalesce(stock, 0)) - pre_close) > 0.011 then 'unresolved_reference_change' else 'ready' end status from b2), tr1 as (select *, case when status = 'ready' then (close * (1 + coalesce(stock, 0)) + coalesce(cash, 0)) / before - 1 end gross from tr0), tr2 as (select *, sum(case when gross is null then 1 else 0 end) over (partition by inst order by session) segment from tr1), tr as (select *, 100 * exp(coalesce(sum(ln(1 + gross)) over (partition by inst, segment order by session), 0)) lev, count(gross) over (partition by inst, segment order by session) observations from tr2)"


def returns(spark, sf_dir):
    return X.total_return_segments(quoted(spark, sf_dir), events(spark, sf_dir))


@table("i13_total_return_segments", f"{_TR} select inst, session, status, round(gross, 6) + 0.0 gross, cast(segment as bigint) segment, round(lev, 4) + 0.0 lev, observations from tr", ("session",))
def i13(spark, sf_dir):
    return returns(spark, sf_dir).select("inst", "session", "status", r("gross").alias("gross"), "segment", r("level", 4).alias("lev"), "observations")


@table("i14_lagged_equal_basket", f"{RET}, cal as (select distinct session, seq from bars), pool as (select inst, session from bars where close > open), d as (select cal.session, count(p.inst) held, count(rr.ret) valid, avg(rr.ret) mean from cal left join cal c0 on c0.seq = cal.seq - 2 left join pool p on p.session = c0.session left join ret rr on rr.inst = p.inst and rr.session = cal.session group by 1), s as (select *, case when held = 0 then 'no_lagged_pool' when valid < held then 'missing_return' else 'ready' end status from d), g as (select *, case when status = 'ready' then mean end ret, sum(case when status = 'ready' then 0 else 1 end) over (order by session) segment from s) select session, held, valid, status, round(ret, 6) + 0.0 ret, cast(segment as bigint) segment, round(coalesce(sum(ln(1 + ret)) over (partition by segment order by session), 0), 4) + 0.0 log_level from g", ("session",))
def i14(spark, sf_dir):
    from ..operators.windows import with_return

    b = bars(spark, sf_dir)
    x = X.lagged_basket(b.filter("close > open").select("inst", "session"), with_return(b), b.select("session", "seq").distinct())
    return x.select("session", "held", "valid", "status", r("ret").alias("ret"), "segment", r(F.log(F.col("level") / 100), 4).alias("log_level"))


@table("i15_field_resolution", f"with {_FACTS}, f as (select inst, period_end, case when k % 9 <> 0 then cast(k % 4 as double) end as value, available notice, cast(k % 2 as int) update_flag, cast(k % 3 as int) retrieved from facts), t as (select *, rank() over (partition by inst, period_end order by notice desc, update_flag desc, retrieved desc) rk from f where value is not null and notice <= date '1999-06-30') select inst, period_end, case when count(distinct value) = 1 then min(value) end as value, count(distinct value) > 1 conflict, max(notice) notice from t where rk = 1 group by 1, 2", ("period_end", "notice"), False)
def i15(spark, sf_dir):
    k = F.col("k")
    f = facts(spark, sf_dir).select("inst", "period_end", F.when(k % 9 != 0, (k % 4).cast("double")).alias("value"), F.col("available").alias("notice"), (k % 2).cast("int").alias("update_flag"), (k % 3).cast("int").alias("retrieved"))
    return X.resolve_field(f, ["inst", "period_end"], "value", F.lit("1999-06-30").cast("date"))


@table("i16_field_lineage_long", "select inst, session, metric, source, unit, round(raw, 4) + 0.0 raw, round(normalized, 4) + 0.0 normalized from (select inst, session, 'price' metric, 'close' source, 'cny' unit, close raw, close * 1 normalized from bars union all select inst, session, 'shares', 'volume', 'lots', volume, volume * 100 from bars union all select inst, session, 'turnover', 'amount', 'thousand_cny', amount, amount * 1000 from bars) where raw is not null", ("session",))
def i16(spark, sf_dir):
    x = X.field_lineage(bars(spark, sf_dir).select("inst", "session", "close", "volume", "amount"), ["inst", "session"], {"close": ("price", "cny", 1.0), "volume": ("shares", "lots", 100.0), "amount": ("turnover", "thousand_cny", 1000.0)})
    return x.withColumns({"raw": r("raw", 4), "normalized": r("normalized", 4)})


_PANEL = f"pn as (select inst, session, seq, close pb, case when (inst + seq) % 6 <> 0 then volume end yld, count(close) {_N.format(59)} pb_n, count(case when (inst + seq) % 6 <> 0 then volume end) {_N.format(59)} yld_n from bars)"


def input_panel(spark, sf_dir):
    b = bars(spark, sf_dir).select("inst", "session", "seq", F.col("close").alias("pb"), F.when((F.col("inst") + F.col("seq")) % 6 != 0, F.col("volume")).alias("yld"))
    return b.withColumns({f"{c}_n": F.count(c).over(by_instrument(60)) for c in ("pb", "yld")})


_HISTORY = {"pb": ("pb_n", 40), "yld": ("yld_n", 40)}


@table("i17_input_readiness", f"{_PANEL}, l as (select session, 'pb' field, pb is not null has, pb is not null and pb_n >= 40 ok from pn union all select session, 'yld', yld is not null, yld is not null and yld_n >= 40 from pn), n as (select session, field, count(*) members, count(*) filter (has) present, count(*) filter (ok) valid from l group by 1, 2) select session, field, members, valid, round(valid / members::double, 6) + 0.0 coverage, valid >= 5 and valid >= 0.8 * members ready, case when valid >= 5 and valid >= 0.8 * members then '' when present < members then 'current_input_missing' when valid < present then 'history_too_short' else 'coverage' end reason from n", ("session",))
def i17(spark, sf_dir):
    x = X.readiness(input_panel(spark, sf_dir), ["pb", "yld"], _HISTORY, 5, 0.8)
    return x.withColumn("coverage", r("coverage"))


@table("i17_gap_queue", f"{_PANEL}, z as (select * from pn where session = (select max(session) from pn)) select inst, session, 'pb' field, case when pb is null then 'missing_current_input' else 'insufficient_history' end status from z where pb is null or pb_n < 40 union all select inst, session, 'yld', case when yld is null then 'missing_current_input' else 'insufficient_history' end from z where yld is null or yld_n < 40", ("session",))
def i17_gaps(spark, sf_dir):
    return X.gap_queue(input_panel(spark, sf_dir), ["pb", "yld"], _HISTORY)


@table("i18_yield_change_decomposition", f"{_KNOWN}, l as (select *, lag(cash, 20) {_W} c0, lag(close, 20) {_W} p0 from cps), g as (select session, count(*) filter (cash is not null and c0 is not null and close > 0 and p0 > 0) matched, count(cash) now, avg(c0 / close - c0 / p0) filter (cash is not null and close > 0 and p0 > 0) price, avg((cash - c0) / close) filter (close > 0 and p0 > 0) cash, avg(case when cash < c0 then 1.0::double else 0.0::double end) filter (cash is not null and c0 is not null and close > 0 and p0 > 0) declining from l group by 1) select session, matched, case when matched >= 4 and matched >= ceil(0.7 * now) then round(price, 7) + 0.0 end price, case when matched >= 4 and matched >= ceil(0.7 * now) then round(cash, 7) + 0.0 end cash, case when matched >= 4 and matched >= ceil(0.7 * now) then round(declining, 6) + 0.0 end declining from g", ("session",))
def i18(spark, sf_dir):
    x = X.yield_change(cash_per_share(spark, sf_dir), 20, 4, 0.7)
    return x.select("session", "matched", r("price", 7).alias("price"), r("cash", 7).alias("cash"), r("declining").alias("declining"))


@table("i19_ex_right_reference_check", "select cast(l_orderkey as bigint) k, cast(l_linenumber as bigint) line, count(*) n, max(cast(round((cast(l_extendedprice as decimal(18,6)) - cast(l_tax as decimal(18,6)) + cast(2 as decimal(18,6)) * cast(0.125 as decimal(18,6))) / cast(1.25 as decimal(18,6)), 2) as double)) reference from lineitem group by 1, 2", (), False)
def i19(spark, sf_dir):
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    x = li.select(F.col("l_orderkey").cast("long").alias("k"), F.col("l_linenumber").cast("long").alias("line"), X.ex_right_reference("l_extendedprice", "l_tax", F.lit(0.125), F.lit(0.125), F.lit(2)).alias("ref"))
    return x.groupBy("k", "line").agg(F.count("*").alias("n"), F.max("ref").alias("reference"))


_CYCLE = f"""{_EVENTS}, ce as (select e.inst, e.ex_date, e.ex_date - 9 imp_ann, case when e.inst % 7 = 3 and b.seq % 4 = 0 then d - 11 else d end end_date, e.cash, case when e.stock < 0.09 then e.stock end stock, e.conflict
  from ev e join bars b on b.inst = e.inst and b.session = e.ex_date and b.seq % 26 = 0,
  lateral (select case when month(e.ex_date) <= 6 then make_date(year(e.ex_date) - 1, 12, 31) else make_date(year(e.ex_date), 6, 30) end d) where (e.inst + b.seq / 26) % 5 <> 0),
k as (select b.inst, b.session s, e.* exclude (inst, imp_ann), month(end_date) * 100 + day(end_date) md, product(1 + stock) over w scale, sum(case when stock is null or stock < 0 then 1 else 0 end) over w unknown
  from bars b join ce e on e.inst = b.inst and e.ex_date <= b.session and e.imp_ann < b.session window w as (partition by b.inst, b.session order by e.ex_date desc)),
a as (select *, max(end_date) filter (md = 1231 and end_date <= s) over w closing, max(end_date) over w newest from k window w as (partition by inst, s)),
b as (select *, count(*) filter (year(end_date) = year(closing) and end_date < closing) over w inner_n, count(*) filter (year(end_date) = year(closing) - 1 and md in (630, 930)) over w before_n,
  count(*) filter (year(end_date) = year(closing) and end_date < closing and end_date = newest - interval 1 year) over w twin from a window w as (partition by inst, s)),
c as (select *, coalesce(newest > closing and year(newest) = year(closing) + 1 and twin > 0, false) rolls from b),
d as (select *, case when rolls then newest else closing end period_end, coalesce(case when rolls then end_date > newest - interval 1 year else year(end_date) = year(closing) end, false) chosen from c),
g as (select inst, s, any_value(closing) closing, any_value(newest) newest, any_value(period_end) period_end, any_value(rolls) rolls, any_value(inner_n) inner_n, any_value(before_n) before_n, count(*) filter (end_date is null) missing, count(*) filter (end_date > s) ahead,
  count(*) filter (md not in (630, 930, 1231) and end_date > period_end - interval 1 year) odd, max(ex_date) filter (chosen) paid, count(*) filter (chosen) payments, count(distinct end_date) filter (chosen) periods,
  count(*) filter (chosen and (conflict or cash is null or cash < 0)) bad_cash, max(unknown) filter (chosen) bad_stock, sum(cash / scale) filter (chosen) total from d group by inst, s),
st as (select *, case when missing > 0 then 'period_missing' when closing is null then 'annual_cycle_not_complete' when ahead > 0 then 'period_after_information_date' when inner_n = 0 and before_n > 0 then 'expected_interim_missing'
  when odd > 0 then 'nonstandard_period' when s - paid > 550 then 'stale_cycle' when periods < payments then 'several_payments_of_a_period' when bad_cash > 0 then 'amount_or_event_conflict' when bad_stock > 0 then 'share_distribution_unknown'
  when rolls then 'rolling_split_cycle' when newest > closing then 'frequency_transition' when inner_n > 0 then 'annual_split' else 'annual_once' end status from g)
select b.inst, b.session, round(case when status in ('annual_once', 'annual_split', 'rolling_split_cycle', 'frequency_transition') then total end, 6) + 0.0 cash, coalesce(status, 'no_known_cycle') status, cast(period_end as date) period_end from bars b left join st on st.inst = b.inst and st.s = b.session"""


@table("i10_dividend_cycle", _CYCLE, ("session", "period_end"))
def i10(spark, sf_dir):
    ev = cycle_events(spark, sf_dir)
    return V.with_dividend_cycle(bars(spark, sf_dir).select("inst", "session"), ev).select("inst", "session", r("cash").alias("cash"), "status", "period_end")


def cycle_events(spark, sf_dir):
    """Two events a year of most instruments: a closing one and an interim one, some missing, odd or late."""
    e = events(spark, sf_dir)
    b = bars(spark, sf_dir).filter("seq % 26 = 0").select("inst", F.col("session").alias("ex_date"), "seq")
    first_half = F.month("ex_date") <= 6
    end = F.when(first_half, F.make_date(F.year("ex_date") - 1, F.lit(12), F.lit(31))).otherwise(F.make_date(F.year("ex_date"), F.lit(6), F.lit(30)))
    odd = F.when((F.col("inst") % 7 == 3) & (F.col("seq") % 4 == 0), F.date_sub(end, 11)).otherwise(end)
    x = e.join(b, ["inst", "ex_date"]).filter((F.col("inst") + F.col("seq") / 26) % 5 != 0)
    return x.select("inst", "ex_date", F.date_sub("ex_date", 9).alias("imp_ann"), odd.alias("end_date"), "cash", F.when(F.col("stock") < 0.09, F.col("stock")).alias("stock"), "conflict")


# ---- banks and their sector

_BANK = {
    "book_to_price": "bvps / nullif(close, 0)", "annual_earnings_yield": "eps / nullif(close, 0)", "roe": "roe", "npl": "npl", "provision": "provision", "cet1": "cet1",
    "npl_improvement": "-npl_change", "nim_change": "nim_change", "profit_growth": "profit_growth", "quality_score": "score", "quality_gate": "gate", "cash_yield": "cash / nullif(close, 0)", "gated_yield": "case when gate = 1 then cash / nullif(close, 0) end",
}


@table("h17_bank_factors", f"{_WIDE}, {_KNOWN}, z as (select g.*, c.close, c.cash from gated g join cps c using (inst, session)) select inst, session, {', '.join(f'round({x}, 4) + 0.0 {n}' for n, x in _BANK.items())} from z", ("session",))
def h17(spark, sf_dir):
    x = wide_facts(spark, sf_dir).join(cash_per_share(spark, sf_dir), ["inst", "session"])
    y = safe_div("cash", "close")
    out = {"book_to_price": safe_div("bvps", "close"), "annual_earnings_yield": safe_div("eps", "close"), "npl_improvement": -F.col("npl_change"), "quality_score": F.col("score"), "quality_gate": F.col("gate"), "cash_yield": y, "gated_yield": F.when(F.col("gate") == 1, y)}
    return x.select("inst", "session", *(r(out.get(n, F.col(n)), 4).alias(n) for n in _BANK))


_PCT = "case when a.{0} is not null and count(b.{0}) >= 60 then (count(case when b.{0} < a.{0} then 1 end) + count(case when b.{0} = a.{0} then 1 end) / 2.0::double) / count(b.{0}) end"
_SECTOR = f"{RET}, ip as (select inst, session, seq, close pb, volume yld, amount eyld, ret, sum(case when ret is null then 1 else 0 end) {_W} segment from ret), lv as (select *, 100 * exp(coalesce(sum(ln(1 + ret)) over (partition by inst, segment order by session), 0)) lev from ip), pc as (select a.inst, a.session, {_PCT.format('pb')} pb_pct, {_PCT.format('yld')} yield_pct, {_PCT.format('eyld')} earnings_pct from ip a join ip b on a.inst = b.inst and b.seq between a.seq - 119 and a.seq group by a.inst, a.session, a.pb, a.yld, a.eyld), sm as (select lv.*, case when count(lev) over w = 20 then avg(lev) over w end sma from lv window w as (partition by inst, segment order by session rows between 19 preceding and current row)), pn as (select sm.*, pb_pct, yield_pct, earnings_pct, case when inst % 3 <> 0 then 1 end gate, pb - lag(pb, 4) over (partition by inst order by session) d1, yld - lag(yld, 4) over (partition by inst order by session) d2 from sm join pc using (inst, session))"
_FALL = lambda c: f"avg(case when {c} < 0 then 1.0::double when {c} is not null then 0.0::double end)"
_SHARE = lambda c, of: f"avg(case when {of} then case when {c} then 1.0::double else 0.0::double end end)"
_DAY = f"dy as (select session, max(seq) seq, avg(pb_pct) pb_history_percentile, median(pb_pct) pb_history_median, avg(yield_pct) dividend_history_percentile, avg(earnings_pct) earnings_history_percentile, {_SHARE('pb_pct <= 0.2 and yield_pct >= 0.8', 'pb_pct is not null and yield_pct is not null')} cheap_high_yield_breadth, {_SHARE('pb_pct <= 0.2 and yield_pct >= 0.8', 'pb_pct is not null and yield_pct is not null and gate = 1')} quality_cheap_high_yield_breadth, {_FALL('d1')} nim_deterioration_breadth, {_SHARE('lev > sma', 'sma is not null')} trend_breadth, quantile_cont(pb_pct, 0.75) - quantile_cont(pb_pct, 0.25) valuation_dispersion, ({_FALL('d2')} + {_FALL('d1')} + {_FALL('d2')} + {_FALL('d1')} + {_FALL('d2')}) / 5 operating_deterioration, avg(ret) rr, max(case when inst = 0 then 1 end) one, 100.0::double + max(seq) bench from pn group by session), ix as (select *, exp(sum(coalesce(ln(1 + rr), 0)) over (order by seq)) idx from dy), rs as (select *, idx / lag(idx, 13) over (order by seq) - bench / lag(bench, 13) over (order by seq) relative_strength from ix)"
_INDICATORS = ["pb_history_percentile", "pb_history_median", "dividend_history_percentile", "earnings_history_percentile", "cheap_high_yield_breadth", "quality_cheap_high_yield_breadth", "nim_deterioration_breadth", "trend_breadth", "valuation_dispersion", "operating_deterioration", "relative_strength"]


@table("h18_sector_indicators", f"{_SECTOR}, {_DAY} " + " union all ".join(f"select session, '{n}' indicator, round({n}, {0 if n == 'relative_strength' else 8}) + 0.0 as val from rs" for n in _INDICATORS), ("session",))
def h18(spark, sf_dir):
    from ..operators.windows import segmented_index, with_return

    b = segmented_index(with_return(bars(spark, sf_dir)), "ret").withColumns({"pb": F.col("close"), "yld": F.col("volume"), "eyld": F.col("amount")})
    b = with_history_percentile(b, {"pb_pct": "pb", "yield_pct": "yld", "earnings_pct": "eyld"}, 120, 60)
    w = by_instrument()
    d1, d2 = F.col("pb") - F.lag("pb", 4).over(w), F.col("yld") - F.lag("yld", 4).over(w)
    p = b.withColumns({"nim_change": d1, "profit_growth": d2, "npl_improvement": d2, "provision_change": d1, "cet1_change": d2, "quality_gate": F.when(F.col("inst") % 3 != 0, 1), "benchmark": 100.0 + F.col("seq")})
    return X.sector_indicators(p, 20, 13).withColumn("val", F.when(F.col("indicator") == "relative_strength", r("val", 0)).otherwise(r("val", 8)))


__all__ = ["by_session"]
