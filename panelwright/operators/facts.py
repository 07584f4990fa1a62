"""Point-in-time financial facts and dividends: as-of states, trailing sums, ratios, cycles and return segments."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .exprs import by_instrument, col, safe_div

#: A report older than this many days says nothing any more.
MAX_REPORT_AGE = 550
TICK_ERROR = 0.011


def asof_last(left: DataFrame, right: DataFrame, keys: Sequence[str], left_time: str, right_time: str, values: Sequence[str], order: Sequence[str] = (), strict: bool = True) -> DataFrame:
    """left, all its rows and columns, with `values` of the latest right row before (or, not strict, at) its time.

    Equal right times go by `order`, the last one wins. One union and one window: no pairs of rows are formed.
    """
    row = F.struct(*(F.col(c) for c in left.columns))
    vals = F.struct(F.lit(True).alias("_is"), *(F.col(c).alias(f"_v{i}") for i, c in enumerate(values)))
    o = F.struct(*(F.col(c) for c in order)) if order else F.struct(F.lit(0).alias("_z"))
    b = right.select(*keys, F.col(right_time).alias("_t"), F.lit(1 if strict else 0).alias("_side"), o.alias("_o"), vals.alias("_v"))
    kinds = dict(zip(b.columns, (f.dataType for f in b.schema.fields)))
    a = left.select(*keys, F.col(left_time).alias("_t"), F.lit(0 if strict else 1).alias("_side"), F.lit(None).cast(kinds["_o"]).alias("_o"), F.lit(None).cast(kinds["_v"]).alias("_v"), row.alias("_row"))
    both = a.unionByName(b, allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy("_t", "_side", "_o").rowsBetween(Window.unboundedPreceding, 0)
    x = both.withColumn("_last", F.last("_v", ignorenulls=True).over(w)).filter("_row is not null")
    return x.select("_row.*", *(F.col(f"_last._v{i}").alias(c) for i, c in enumerate(values)))


def versions(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    rn = F.row_number().over(Window.partitionBy(*keys).orderBy(*(F.desc(c) for c in order)))
    return df.withColumn("_rn", rn).filter("_rn = 1").drop("_rn")


def trailing_twelve_months(df: DataFrame, values: Sequence[str], order: Sequence[str], entity: str = "inst", period: str = "period_end", available: str = "available") -> DataFrame:
    """(entity, available, values): the newest report of each announcement day as twelve months, from what was known then.

    An annual report is itself; another is its figure plus the last annual one less that of the same period a year ago.
    """
    v = versions(df, [entity, available, period], order).select(entity, period, available, *values)
    cur = v.withColumn("_newest", F.max(period).over(Window.partitionBy(entity, available))).filter(F.col(period) == F.col("_newest")).drop("_newest")
    out = cur.withColumns({"_annual": F.make_date(F.year(period) - 1, F.lit(12), F.lit(31)), "_before": F.last_day(F.add_months(period, -12))})
    for tag, date in (("a", "_annual"), ("q", "_before")):
        past = v.select(entity, F.col(period).alias(date), available, *(F.col(c).alias(f"_{tag}_{c}") for c in values))
        out = asof_last(out, past, [entity, date], available, available, [f"_{tag}_{c}" for c in values], strict=False)
    annual = F.month(period) == 12
    return out.select(entity, available, *(F.when(annual, F.col(c)).otherwise(F.col(c) + F.col(f"_a_{c}") - F.col(f"_q_{c}")).alias(c) for c in values))


def fundamental_ratios() -> dict[str, Column]:
    """Ratios over trailing sums (net_income, total_profit, revenue, operating_profit, cost, operating_cash, net_cash),
    balance figures, indicator figures and market_cap."""
    c = F.col
    debt = sum((F.coalesce(c(x), F.lit(0.0)) for x in ("st_borr", "due_1y", "lt_borr", "bonds")), F.lit(0.0))
    ev = c("market_cap") + debt - F.coalesce(c("money"), F.lit(0.0))
    yoy = ("or_yoy", "netprofit_yoy", "assets_yoy")
    known = sum((c(x).isNotNull().cast("int") for x in yoy), F.lit(0))
    return {
        "cash_flow_to_price": safe_div("net_cash", "market_cap"), "cash_earnings_to_price": safe_div("operating_cash", "market_cap"), "earnings_to_price": safe_div("net_income", "market_cap"),
        "roe_ttm": safe_div("net_income", "equity"), "roa_ttm": safe_div("net_income", "assets"), "acca": safe_div(c("net_income") - c("operating_cash"), "assets"),
        "adjusted_profit_to_total_profit": safe_div("profit_dedt", "total_profit"), "net_operating_cash_flow_coverage": safe_div("operating_cash", "net_income"), "debt_to_equity": safe_div("liabilities", "equity"),
        "operating_cashflow_to_ev": F.when(ev > 0, safe_div("operating_cash", ev)), "gross_margin": safe_div(c("revenue") - c("cost"), "revenue"), "operating_margin": safe_div("operating_profit", "revenue"),
        "asset_turnover": safe_div("revenue", "assets"), "operating_cashflow_to_debt": safe_div("operating_cash", "liabilities"), "current_ratio": safe_div("current_assets", "current_liabilities"),
        "revenue_growth_yoy": c("or_yoy") / 100, "growth": safe_div(sum((F.coalesce(c(x), F.lit(0.0)) for x in yoy), F.lit(0.0)), known) / 100,
    }


def fact_states(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """What is known of each key after each announcement: newest report, best source, newest availability.

    df: (keys, report_date, priority, available, value, basis, k). Rows that tie in all three and differ in basis or
    value abstain (value NULL, status conflict). Returns (keys, available, report_date, value, basis, k, status).
    """
    tie = df.groupBy(*keys, "available", *([] if "report_date" in keys else ["report_date"]), "priority").agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.count_distinct("basis").alias("nb"), F.min_by(F.struct("value", "basis", "k"), "k").alias("p"))
    same = (F.col("nb") == 1) & (F.col("hi") - F.col("lo") <= 1e-8 * F.greatest(F.lit(1.0), F.abs("p.value")))
    tie = tie.withColumn("s", F.struct("report_date", (-F.col("priority")).alias("rank"), "available", F.when(same, F.col("p.value")).alias("value"), F.col("p.basis").alias("basis"), F.col("p.k").alias("k"), F.when(same, "ok").otherwise("conflict").alias("status")))
    w = Window.partitionBy(*keys).orderBy("available").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    best = tie.withColumn("b", F.max("s").over(w)).groupBy(*keys, "available").agg(F.max("b").alias("b"))
    rest = [c for c in ("report_date", "value", "basis", "k", "status") if c not in keys]
    return best.select(*keys, "available", *(F.col(f"b.{c}").alias(c) for c in rest))


def known_facts(sessions: DataFrame, facts: DataFrame, keys: Sequence[str], entity_keys: Sequence[str], max_age: int | None = MAX_REPORT_AGE) -> DataFrame:
    """sessions (entity_keys, session) with the state of the day before; facts older than max_age are NULL."""
    x = asof_last(sessions, fact_states(facts, keys), entity_keys, "session", "available", ["report_date", "value", "basis", "k", "status"])
    if max_age is None:
        return x
    fresh = F.datediff("session", "report_date").between(0, max_age)
    return x.withColumns({"value": F.when(fresh, F.col("value")), "status": F.when(F.col("report_date").isNull(), "none").when(fresh, F.col("status")).otherwise("stale")})


def with_prior_year(sessions: DataFrame, facts: DataFrame) -> DataFrame:
    """known_facts of (inst, metric) with the fact of the same period a year before as then known, and the comparison's status."""
    now = known_facts(sessions, facts, ["inst", "metric"], ["inst", "metric"])
    now = now.withColumns({"_prior": F.last_day(F.add_months("report_date", -12))})
    prior = fact_states(facts, ["inst", "metric", "report_date"]).select("inst", "metric", F.col("report_date").alias("_prior"), "available", F.col("value").alias("prior_value"), F.col("basis").alias("prior_basis"), F.col("k").alias("prior_k"))
    x = asof_last(now, prior, ["inst", "metric", "_prior"], "session", "available", ["prior_value", "prior_basis", "prior_k"])
    status = F.when(F.col("value").isNull(), "no_current").when(F.col("prior_value").isNull(), "no_prior").when(F.col("prior_basis") != F.col("basis"), "basis_changed").otherwise("ready")
    return x.withColumn("comparison", status).drop("_prior")


def three_year_stats(df: DataFrame, entity: str, year: str, value: str) -> DataFrame:
    """Median and population deviation of the values of three consecutive years; NULL with a gap."""
    w = Window.partitionBy(entity).orderBy(year)
    a, b, c = F.col(value), F.lag(value, 1).over(w), F.lag(value, 2).over(w)
    whole = (F.lag(year, 1).over(w) == F.col(year) - 1) & (F.lag(year, 2).over(w) == F.col(year) - 2) & a.isNotNull() & b.isNotNull() & c.isNotNull()
    mean = (a + b + c) / 3
    sd = F.sqrt(((a - mean) ** 2 + (b - mean) ** 2 + (c - mean) ** 2) / 3)
    return df.withColumns({"median3": F.when(whole, a + b + c - F.greatest(a, b, c) - F.least(a, b, c)), "volatility3": F.when(whole, sd)})


def tier(x, steps: Sequence[tuple[float, float]], rest: float, falling: bool = False) -> Column:
    """Points by the first threshold that x reaches (or, falling, does not pass)."""
    out = F.lit(float(rest))
    for limit, points in reversed(steps):
        out = F.when(col(x) <= limit if falling else col(x) >= limit, F.lit(float(points))).otherwise(out)
    return out


def quality_score(roe="roe", npl="npl", provision="provision") -> Column:
    # Thresholds and points of the score.
    points = tier(roe, [(11, 28), (9.5, 24), (8, 20), (6, 10)], 2) + tier(npl, [(1.2, 14), (1.6, 12), (2, 8)], 2, falling=True) + tier(provision, [(250, 10), (180, 8), (150, 5)], 1)
    known = col(roe).isNotNull() & col(npl).isNotNull() & col(provision).isNotNull()
    return F.when(known, points / 52 * 100)


def quality_gate(roe="roe", npl="npl", provision="provision", npl_change="npl_change", cet1="cet1", profit_growth="profit_growth") -> Column:
    """1 or 0 where the score is known, else NULL; the last three veto only where they are known."""
    no = lambda c: ~F.coalesce(c, F.lit(False))
    good = (quality_score(roe, npl, provision) >= 75) & (col(roe) >= 8) & (col(npl) <= 2) & (col(provision) >= 150)
    good = good & no(col(npl_change) > 0.2 + 1e-10) & no(col(cet1) < 8.5) & no(col(profit_growth) < -0.05)
    return F.when(quality_score(roe, npl, provision).isNotNull(), good.cast("double"))


# ---- dividends


def unique_events(df: DataFrame) -> DataFrame:
    """One row of each (inst, ex_date); several are a conflict with NULL amounts, known once the last of them is."""
    n = F.count("*")
    one = lambda c: F.when(n == 1, F.first(c)).alias(c)
    return df.groupBy("inst", "ex_date").agg(one("cash"), one("stock"), F.when(F.count("imp_ann") == n, F.max("imp_ann")).alias("imp_ann"), (n > 1).alias("conflict"))


def _bad(x: Column) -> Column:
    return x.isNull() | F.isnan(x) | (x < 0)


def reference_changes(bars: DataFrame, events: DataFrame) -> DataFrame:
    """bars with `unexplained`: whether pre_close departs from the close before, adjusted for a known event of the day."""
    e = events.select("inst", F.col("ex_date").alias("session"), "cash", "stock", "imp_ann", F.lit(True).alias("_event"))
    x = bars.join(e, ["inst", "session"], "left").withColumn("_before", F.lag("close").over(by_instrument()))
    unknown = F.col("_event").isNotNull() & (F.col("imp_ann").isNull() | (F.col("imp_ann") >= F.col("session")) | F.col("cash").isNull() | _bad(F.col("stock")))
    expected = (F.col("_before") - F.coalesce("cash", F.lit(0.0))) / (1 + F.coalesce("stock", F.lit(0.0)))
    off = F.col("pre_close").isNull() | (F.abs(expected - F.col("pre_close")) > TICK_ERROR)
    return x.withColumn("unexplained", F.when(F.col("_before").isNotNull(), unknown | off).otherwise(F.lit(False))).drop("_event", "_before")


def total_return_segments(bars: DataFrame, events: DataFrame) -> DataFrame:
    """Gross total return of each session and its status; level and segment start again at every session that is not ready."""
    w = by_instrument()
    e = events.select("inst", F.col("ex_date").alias("session"), "cash", "stock", "imp_ann", "conflict", F.lit(True).alias("_event"))
    x = bars.join(e, ["inst", "session"], "left").withColumns({"_before": F.lag("close").over(w), "_was": F.lag("session").over(w)})
    has = F.col("_event").isNotNull()
    cash, stock = F.when(has, F.col("cash")).otherwise(0.0), F.when(has, F.col("stock")).otherwise(0.0)
    expected = (F.col("_before") - cash) / (1 + stock)
    status = (
        F.when(F.col("close").isNull() | (F.col("close") <= 0), "invalid_price").when(F.col("_before").isNull(), "segment_start")
        .when(has & F.col("conflict"), "unresolved_event").when(has & (F.col("imp_ann").isNull() | (F.col("imp_ann") >= F.col("session"))), "event_not_known")
        .when(has & (_bad(F.col("cash")) | _bad(F.col("stock"))), "invalid_event_value")
        .when(F.col("pre_close").isNull() | (F.abs(expected - F.col("pre_close")) > TICK_ERROR), "unresolved_reference_change").otherwise("ready")
    )
    x = x.withColumn("status", status)
    ret = F.when(F.col("status") == "ready", (F.col("close") * (1 + stock) + cash) / F.col("_before") - 1)
    x = x.withColumn("gross", ret).drop("_before", "_was", "_event")
    return _compounded(x, "gross", ["inst"])


def _compounded(df: DataFrame, ret: str, keys: Sequence[str]) -> DataFrame:
    """Adds segment, level (from 100) and observations (returns so far) of runs of known returns."""
    w = Window.partitionBy(*keys).orderBy("session").rowsBetween(Window.unboundedPreceding, 0)
    x = df.withColumn("segment", F.sum(F.when(F.col(ret).isNull(), 1).otherwise(0)).over(w))
    inner = Window.partitionBy(*keys, "segment").orderBy("session").rowsBetween(Window.unboundedPreceding, 0)
    return x.withColumn("level", 100 * F.exp(F.coalesce(F.sum(F.log1p(ret)).over(inner), F.lit(0.0)))).withColumn("observations", F.count(ret).over(inner))


def lagged_basket(pool: DataFrame, returns: DataFrame, calendar: DataFrame, lag: int = 2) -> DataFrame:
    """Equal-weight return of each session over the members of `lag` sessions before; one missing return voids the day.

    calendar (session, seq) numbers the sessions. The series is one row a session; it is small whatever the members."""
    if lag < 2:
        raise ValueError("membership must be known before the close that it is held from")
    held = pool.join(calendar, "session").select("inst", (F.col("seq") + lag).alias("seq"))
    held = held.join(calendar, "seq").join(returns.select("inst", "session", "ret"), ["inst", "session"], "left")
    day = held.groupBy("session").agg(F.count("*").alias("held"), F.count("ret").alias("valid"), F.avg("ret").alias("mean"))
    x = calendar.select("session").join(day, "session", "left").na.fill(0, ["held", "valid"])
    status = F.when(F.col("held") == 0, "no_lagged_pool").when(F.col("valid") < F.col("held"), "missing_return").otherwise("ready")
    x = x.withColumn("status", status).withColumn("ret", F.when(F.col("status") == "ready", F.col("mean"))).drop("mean").withColumn("basket", F.lit(1))
    return _compounded(x, "ret", ["basket"]).drop("basket")


def resolve_field(df: DataFrame, keys: Sequence[str], value: str, cutoff: Column) -> DataFrame:
    """The last disclosed non-NULL value of each key known at the cutoff; updated rows go first, different values abstain."""
    known = df.filter(F.col(value).isNotNull() & (F.col("notice") <= cutoff))
    rank = F.struct("notice", F.col("update_flag"), F.col("retrieved"))
    top = known.withColumn("_top", F.max(rank).over(Window.partitionBy(*keys))).filter(rank == F.col("_top"))
    return top.groupBy(*keys).agg(F.when(F.count_distinct(value) == 1, F.min(value)).alias(value), (F.count_distinct(value) > 1).alias("conflict"), F.max("notice").alias("notice"))


def field_lineage(df: DataFrame, keys: Sequence[str], fields: dict[str, tuple[str, str, float]]) -> DataFrame:
    """A vendor's wide rows as (keys, metric, source, unit, raw, normalized); fields: column -> (metric, unit, scale)."""
    info = F.create_map(*(F.lit(x) for c, (m, u, s) in fields.items() for x in (c, f"{m}|{u}|{s}")))
    long = df.unpivot(list(keys), list(fields), "_column", "raw").filter("raw is not null").withColumn("_i", F.split(info[F.col("_column")], r"\|"))
    return long.select(*keys, F.col("_i")[0].alias("metric"), F.col("_column").alias("source"), F.col("_i")[1].alias("unit"), "raw", (F.col("raw") * F.col("_i")[2].cast("double")).alias("normalized"))


def readiness(panel: DataFrame, fields: Sequence[str], history: dict[str, tuple[str, int]], least: int, coverage: float) -> DataFrame:
    """Per session and field: members, valid ones, coverage, ready, reason. history: field -> (count column, least count)."""
    grown = {f: F.col(history[f][0]) >= history[f][1] if f in history else F.lit(True) for f in fields}
    long = panel.select("session", F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).isNotNull().alias("has"), (F.col(f).isNotNull() & grown[f]).alias("ok")) for f in fields))).alias("x"))
    n = long.groupBy("session", "x.field").agg(F.count("*").alias("members"), F.count(F.when(F.col("x.has"), 1)).alias("present"), F.count(F.when(F.col("x.ok"), 1)).alias("valid"))
    ready = (F.col("valid") >= least) & (F.col("valid") >= coverage * F.col("members"))
    reason = F.when(ready, "").when(F.col("present") < F.col("members"), "current_input_missing").when(F.col("valid") < F.col("present"), "history_too_short").otherwise("coverage")
    return n.select("session", "field", "members", "valid", (F.col("valid") / F.col("members")).alias("coverage"), ready.alias("ready"), reason.alias("reason"))


def gap_queue(panel: DataFrame, fields: Sequence[str], history: dict[str, tuple[str, int]]) -> DataFrame:
    """What is to be mended on the last session: (inst, field, status) of values that are missing or too young."""
    last = panel.join(F.broadcast(panel.agg(F.max("session").alias("session"))), "session", "left_semi")
    young = {f: ~F.coalesce(F.col(history[f][0]) >= history[f][1], F.lit(False)) if f in history else F.lit(False) for f in fields}
    status = lambda f: F.when(F.col(f).isNull(), "missing_current_input").when(young[f], "insufficient_history")
    long = last.select("inst", "session", F.explode(F.array(*(F.struct(F.lit(f).alias("field"), status(f).alias("status")) for f in fields))).alias("x"))
    return long.filter("x.status is not null").select("inst", "session", "x.field", "x.status")


def yield_change(panel: DataFrame, span: int, least: int, coverage: float) -> DataFrame:
    """Mean change of cash / close over `span` sessions on the members that have both ends, as a price and a cash part."""
    w = by_instrument()
    x = panel.withColumns({"c0": F.lag("cash", span).over(w), "p0": F.lag("close", span).over(w)})
    ok = F.col("cash").isNotNull() & F.col("c0").isNotNull() & (F.col("close") > 0) & (F.col("p0") > 0)
    price, cash = F.when(ok, F.col("c0") / F.col("close") - F.col("c0") / F.col("p0")), F.when(ok, (F.col("cash") - F.col("c0")) / F.col("close"))
    g = x.groupBy("session").agg(F.count(F.when(ok, 1)).alias("matched"), F.count("cash").alias("now"), F.avg(price).alias("price"), F.avg(cash).alias("cash"), F.avg(F.when(ok, (F.col("cash") < F.col("c0")).cast("double"))).alias("declining"))
    good = (F.col("matched") >= least) & (F.col("matched") >= F.ceil(coverage * F.col("now")))
    return g.select("session", "matched", *(F.when(good, F.col(c)).alias(c) for c in ("price", "cash", "declining")))


def ex_right_reference(before, cash, bonus, rights, rights_price) -> Column:
    """Reference price after dividends, bonus and rights issues, rounded to a cent (half up)."""
    d = lambda c: col(c).cast("decimal(18,6)")
    raw = (d(before) - d(cash) + d(rights_price) * d(rights)) / (F.lit(1).cast("decimal(18,6)") + d(bonus) + d(rights))
    return F.round(raw, 2).cast("double")


# ---- sector indicators


def sector_indicators(panel: DataFrame, trend: int, strength: int) -> DataFrame:
    """(session, indicator, value) from a panel of pb_pct, yield_pct, earnings_pct, quality_gate, nim_change, profit_growth,
    npl_improvement, provision_change, cet1_change, level and segment of each member, and a benchmark level of the session."""
    w = Window.partitionBy("inst", "segment").orderBy("session").rowsBetween(-(trend - 1), 0)
    x = panel.withColumn("_sma", F.when(F.count("level").over(w) == trend, F.avg("level").over(w)))
    both = F.col("pb_pct").isNotNull() & F.col("yield_pct").isNotNull()
    joint = (F.col("pb_pct") <= 0.2) & (F.col("yield_pct") >= 0.8)
    share = lambda c, of: F.avg(F.when(of, c.cast("double")))
    falls = {c: share(F.col(c) < 0, F.col(c).isNotNull()) for c in ("profit_growth", "nim_change", "npl_improvement", "provision_change", "cet1_change")}
    gate = F.col("quality_gate") == 1
    values = {
        "pb_history_percentile": F.avg("pb_pct"), "pb_history_median": F.median("pb_pct"), "dividend_history_percentile": F.avg("yield_pct"), "earnings_history_percentile": F.avg("earnings_pct"),
        "cheap_high_yield_breadth": share(joint, both), "quality_cheap_high_yield_breadth": share(joint, both & gate), "nim_deterioration_breadth": falls["nim_change"],
        "trend_breadth": share(F.col("level") > F.col("_sma"), F.col("_sma").isNotNull()), "valuation_dispersion": F.percentile("pb_pct", F.lit(0.75)) - F.percentile("pb_pct", F.lit(0.25)),
        "operating_deterioration": sum(falls.values(), F.lit(0.0)) / len(falls),
    }
    day = x.groupBy("session").agg(*(v.alias(k) for k, v in values.items()), F.avg("ret").alias("_ret"), F.max("benchmark").alias("_bench"), F.max("seq").alias("seq"))
    one = Window.partitionBy(F.lit(0)).orderBy("seq")  # a series of one row a session
    day = day.withColumn("_idx", F.exp(F.sum(F.coalesce(F.log1p("_ret"), F.lit(0.0))).over(one.rowsBetween(Window.unboundedPreceding, 0))))
    day = day.withColumn("relative_strength", safe_div("_idx", F.lag("_idx", strength).over(one)) - safe_div("_bench", F.lag("_bench", strength).over(one)))
    return day.unpivot(["session"], [*values, "relative_strength"], "indicator", "val")
