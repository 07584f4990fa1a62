"""Queries of the formula library: every family over all its windows, with their SQL."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import formulas as K
from ..operators import panel as P
from ..operators import windows as V
from ..operators.exprs import by_instrument, by_session, rolling_partial, safe_div
from ..operators.order_stats import Trailing, with_trailing
from ..operators.windows import with_return
from .base import _N, _W, FWD, MOM, RET, panel, r

_CH = f"ch as (select *, close / nullif(lag(close) {_W}, 0) close_ratio, volume / nullif(lag(volume) {_W}, 0) volume_ratio, close - lag(close) {_W} dc, volume - lag(volume) {_W} dv from bars)"


def rounded(columns, digits=5):
    return [r(c, digits).alias(n) for n, c in columns.items()]


def _sql(columns, digits=5):
    return ", ".join(f"round({x}, {digits}) + 0.0 {n}" for n, x in columns.items())


def _over(x, n):
    return f"{x} {_N.format(n - 1)}"


def _family(name, source, sql, python, prefix=None, digits=5, prepare=K.with_changes):
    """Register a family of rolling formulas over all windows."""
    texts = {}
    for n in K.WINDOWS:
        texts |= {k.format(n=n): v(n) for k, v in sql.items()}

    @panel(name, f"{prefix + ' ' if prefix else ''}select inst, session, {_sql(texts, digits)} from {source}")
    def run(df):
        return prepare(df).select("inst", "session", *rounded(K.all_windows(python), digits))

    return run


_span = "(high - low + 1e-12)"


@panel("h1_kbar_all", "select inst, session, " + _sql({"kmid": "(close - open) / open", "klen": "(high - low) / open", "kmid2": f"(close - open) / {_span}", "kup": "(high - greatest(open, close)) / open", "kup2": f"(high - greatest(open, close)) / {_span}", "klow": "(least(open, close) - low) / open", "klow2": f"(least(open, close) - low) / {_span}", "ksft": "(2 * close - high - low) / open", "ksft2": f"(2 * close - high - low) / {_span}"}) + " from bars")
def h1(df):
    return df.select("inst", "session", *rounded(K.kbar()))


_slope = lambda n: f"case when {_over('count(close)', n)} >= 2 then {_over('regr_slope(close, seq)', n)} end"
_family("h3_trend_windows", "bars", {
    "roc{n}": lambda n: f"lag(close, {n}) {_W} / close", "ma{n}": lambda n: f"{_over('avg(close)', n)} / close", "std{n}": lambda n: f"{_over('stddev_samp(close)', n)} / close",
    "beta{n}": lambda n: f"{_slope(n)} / close", "rsqr{n}": lambda n: f"case when {_over('count(close)', n)} >= 2 and {_over('var_pop(close)', n)} > 1e-12 then {_over('regr_r2(close, seq)', n)} end",
    "resi{n}": lambda n: f"(close - case when {_over('count(close)', n)} >= 2 then {_over('regr_intercept(close, seq)', n)} end - {_slope(n)} * seq) / close",
}, K.trend, digits=4)
_hi, _lo = lambda n: _over("max(high)", n), lambda n: _over("min(low)", n)
_amax = lambda n: _over("arg_max(seq, high)", n)
_amin = lambda n: _over("arg_min(seq, low)", n)
_list = lambda n: _over("list(close)", n)
_family("h4_extremes_windows", "bars", {
    "max{n}": lambda n: f"{_hi(n)} / close", "min{n}": lambda n: f"{_lo(n)} / close", "qtlu{n}": lambda n: f"{_over('quantile_cont(close, 0.8)', n)} / close", "qtld{n}": lambda n: f"{_over('quantile_cont(close, 0.2)', n)} / close",
    "rank{n}": lambda n: f"case when close is not null then (len(list_filter({_list(n)}, lambda x: x < close)) + (len(list_filter({_list(n)}, lambda x: x = close)) + 1) / 2.0::double) / {_over('count(close)', n)} end",
    "rsv{n}": lambda n: f"(close - {_lo(n)}) / ({_hi(n)} - {_lo(n)} + 1e-12)",
    "imax{n}": lambda n: f"({_amax(n)} - {_over('min(seq)', n)} + 1) / {n}.0::double", "imin{n}": lambda n: f"({_amin(n)} - {_over('min(seq)', n)} + 1) / {n}.0::double", "imxd{n}": lambda n: f"({_amax(n)} - {_amin(n)}) / {n}.0::double",
}, K.extremes, prepare=K.with_close_order)


def _corr_sql(a, b, n):
    x, y = f"case when {b} is not null then {a} end", f"case when {a} is not null then {b} end"
    vx, vy = _over(f"var_pop({x})", n), _over(f"var_pop({y})", n)
    return f"case when {_over(f'count({x})', n)} >= 2 and {vx} > 1e-12 and {vy} > 1e-12 then {_over(f'covar_pop({x}, {y})', n)} / sqrt({vx} * {vy}) end"


_family("h5_price_volume_corr", "ch", {"corr{n}": lambda n: _corr_sql("close", "ln(volume + 1)", n), "cord{n}": lambda n: _corr_sql("close_ratio", "ln(volume_ratio + 1)", n)}, K.price_volume, _CH, 4)
_up = lambda d, n: _over(f"sum(greatest({d}, 0::double))", n)
_dn = lambda d, n: _over(f"sum(greatest(-{d}, 0::double))", n)
_ab = lambda d, n: f"({_over(f'sum(abs({d}))', n)} + 1e-12)"
_cp = lambda n: _over("avg(case when dc > 0 then 1.0::double else 0.0::double end)", n)
_cn = lambda n: _over("avg(case when dc < 0 then 1.0::double else 0.0::double end)", n)
_family("h6_up_down_windows", "ch", {
    "cntp{n}": _cp, "cntn{n}": _cn, "cntd{n}": lambda n: f"{_cp(n)} - {_cn(n)}",
    "sump{n}": lambda n: f"{_up('dc', n)} / {_ab('dc', n)}", "sumn{n}": lambda n: f"{_dn('dc', n)} / {_ab('dc', n)}", "sumd{n}": lambda n: f"({_up('dc', n)} - {_dn('dc', n)}) / {_ab('dc', n)}",
}, K.up_down, _CH)
_wv = "abs(close_ratio - 1) * volume"
_family("h7_volume_windows", "ch", {
    "vma{n}": lambda n: f"{_over('avg(volume)', n)} / (volume + 1e-12)", "vstd{n}": lambda n: f"{_over('stddev_samp(volume)', n)} / (volume + 1e-12)",
    "wvma{n}": lambda n: f"{_over(f'stddev_samp({_wv})', n)} / ({_over(f'avg({_wv})', n)} + 1e-12)",
    "vsump{n}": lambda n: f"{_up('dv', n)} / {_ab('dv', n)}", "vsumn{n}": lambda n: f"{_dn('dv', n)} / {_ab('dv', n)}", "vsumd{n}": lambda n: f"({_up('dv', n)} - {_dn('dv', n)}) / {_ab('dv', n)}",
}, K.volume, _CH, 4)


@panel("h8_adjusted_gap", f"a as (select *, 1 + seq / 1000::double f from bars) select inst, session, round(open * f / (lag(close) {_W} * lag(f) {_W}) - 1, 6) + 0.0 adjusted_gap from a")
def h8(df):
    f = 1 + F.col("seq") / 1000
    x = df.withColumns({"ao": F.col("open") * f, "ac": F.col("close") * f})
    return x.select("inst", "session", r(safe_div("ao", F.lag("ac").over(by_instrument())) - 1).alias("adjusted_gap"))


@panel("h9_point_valuation", "select inst, session, round(1 / nullif(close / 50, 0), 6) + 0.0 book_to_price, round(1 / nullif(close / 20, 0), 6) + 0.0 sales_to_price, round(volume / 10000, 6) + 0.0 dividend_yield_ttm, round(ln(amount * 1e4), 5) + 0.0 log_market_cap from bars")
def h9(df):
    x = df.withColumns({"pb": F.col("close") / 50, "ps_ttm": F.col("close") / 20, "dv_ttm": F.col("volume") / 100, "total_mv": F.col("amount")})
    v = K.point_valuation()
    return x.select("inst", "session", *(r(c, 5 if n == "log_market_cap" else 6).alias(n) for n, c in v.items()))


_RISK = f"b0 as (select *, close / nullif(lag(close) {_W}, 0) - 1 ret, greatest(high - low, abs(high - lag(close) {_W}), abs(low - lag(close) {_W})) true_range, volume / 1000 turnover, close / nullif(lag(close, 20) {_W}, 0) - 1 trail20 from bars), b as (select *, avg(ret) over (partition by session) market_ret from b0)"


def _full(x, n, value):
    return f"case when {_over(f'count({x})', n)} = {n} then {value} end"


def risk_inputs(df):
    return K.with_risk_inputs(df.withColumn("turnover", F.col("volume") / 1000))


_atr = _full("true_range / close", 6, _over("avg(true_range / close)", 6))
_davol = _full("turnover", 120, f"{_over('avg(turnover)', 10)} / nullif({_over('avg(turnover)', 120)}, 0) - 1")
_cv = _full("turnover", 20, f"case when {_over('avg(turnover)', 20)} > 0 then {_over('stddev_samp(turnover)', 20)} / {_over('avg(turnover)', 20)} end")
_skew = f"case when {_over('count(ret)', 120)} >= 120 and {_over('var_pop(ret)', 120)} > 1e-18 then {_over('skewness(ret)', 120)} end"
_sharpe = _full("ret", 60, f"case when {_over('stddev_samp(ret)', 60)} > 1e-8 then {_over('avg(ret)', 60)} / {_over('stddev_samp(ret)', 60)} * sqrt(250.0::double) end")


@panel("h11_technical_risk", f"{_RISK} select inst, session, " + _sql({"atr6": _atr, "davol10": _davol, "variance20": _full("ret", 20, f"{_over('var_samp(ret)', 20)} * 250"), "liquidity": _full("turnover", 21, f"ln({_over('avg(turnover)', 21)})"), "turnover_cv20": _cv, "skew120": _skew, "momentum": f"lag(close, 21) {_W} / nullif(lag(close, 252) {_W}, 0) - 1", "sharpe60": _sharpe}) + " from b")
def h11(df):
    return risk_inputs(df).select("inst", "session", *rounded(K.risk()))


@panel("h12_rank1m", f"{_RISK} select inst, session, round(case when trail20 is not null then 1 - percent_rank() over (partition by session order by trail20 nulls last) end, 6) + 0.0 rank1m from b")
def h12(df):
    return risk_inputs(df).select("inst", "session", r(K.one_month_rank()).alias("rank1m"))


_wt = "case when ret is not null then power(2.0::double, seq / 42.0::double) end"
_m = lambda x, n: f"{_over(f'sum({x})', n)}"
_ewm = f"sqrt(greatest({_m(f'{_wt} * ret * ret', 120)} / {_m(_wt, 120)} - power({_m(f'{_wt} * ret', 120)} / {_m(_wt, 120)}, 2), 0::double))"
_ok = f"{_over('count(ret)', 120)} = 120 and {_over('count(market_ret)', 120)} = 120 and {_over('var_samp(market_ret)', 120)} > 1e-12"
_cov, _var = _over("covar_samp(ret, market_ret)", 120), _over("var_samp(market_ret)", 120)


@panel("h13_beta_resvol", f"{_RISK} select inst, session, " + _sql({"beta": f"case when {_ok} then {_cov} / {_var} end", "resvol": f"case when {_ok} then 0.50::double * {_ewm} + 0.42::double * sqrt(greatest({_over('var_samp(ret)', 120)} - power({_cov}, 2) / {_var}, 0::double)) + 0.08::double * ({_over('max(ln(close))', 120)} - {_over('min(ln(close))', 120)}) end"}, 4) + " from b")
def h13(df):
    return risk_inputs(df).select("inst", "session", *rounded(K.beta_and_residual(120), 4))


@panel("h14_turnover_deviation", f"{_RISK} select inst, session, " + _sql({"share_turnover_monthly": _full("turnover", 21, f"ln({_over('sum(turnover)', 21)})"), "daily_standard_deviation": _full("ret", 120, _ewm)}, 4) + " from b")
def h14(df):
    return risk_inputs(df).select("inst", "session", *rounded(K.turnover_and_deviation(120), 4))


# ---- the rest of rolling and cross-section operators


@panel("e2_rolling_full_sum", f"select inst, session, round(case when count(volume) {_N.format(19)} = 20 then sum(volume) {_N.format(19)} end, 3) + 0.0 sum20 from bars")
def e2(df):
    from ..operators.exprs import rolling_full

    return df.select("inst", "session", r(rolling_full("volume", 20, "sum"), 3).alias("sum20"))


@panel("e3_rolling_partial_rest", f"select inst, session, round(sum(volume) {_N.format(9)}, 3) + 0.0 sum10, round(stddev_samp(close) {_N.format(9)}, 5) + 0.0 std10 from bars")
def e3(df):
    return df.select("inst", "session", r(rolling_partial("volume", 10, "sum"), 3).alias("sum10"), r(rolling_partial("close", 10, "std"), 5).alias("std10"))


@panel("e5_rolling_quantiles", f"select inst, session, round(quantile_cont(close, 0.8) {_N.format(19)}, 6) + 0.0 q80, round(quantile_cont(close, 0.2) {_N.format(19)}, 6) + 0.0 q20 from bars")
def e5(df):
    x = with_trailing(df, {"w": Trailing("close", 20, quantiles=(0.8, 0.2))})
    return x.select("inst", "session", r("w_q0").alias("q80"), r("w_q1").alias("q20"))


@panel("e7_rolling_argmin", f"select inst, session, coalesce(seq - {_over('arg_min(seq, low)', 20)}, -1) age from bars")
def e7(df):
    return df.select("inst", "session", F.coalesce(V.since_extremum("low", 20, largest=False), F.lit(-1)).alias("age"))


@panel("e8_rolling_corr_changes", f"{_CH} select inst, session, round({_corr_sql('close_ratio', 'ln(volume_ratio + 1)', 20)}, 4) + 0.0 corr20 from ch")
def e8(df):
    return K.with_changes(df).select("inst", "session", r(K.price_volume(20)["cord20"], 4).alias("corr20"))


@panel("e16_percent_rank_descending", "select inst, session, round(percent_rank() over (partition by session order by close desc nulls last), 6) + 0.0 pr from bars")
def e16(df):
    return df.select("inst", "session", r(F.percent_rank().over(by_session().orderBy(F.desc_nulls_last("close")))).alias("pr"))


@panel("e17_mid_percentile_flipped", "k as (select *, rank() over (partition by session order by close) + (count(*) over (partition by session, close) - 1) / 2.0::double ar, count(*) over (partition by session) n from bars where close is not null) select inst, session, round(case when n <= 1 then 0.5::double else 1 - (ar - 1) / (n - 1) end, 6) + 0.0 mid from k")
def e17(df):
    from ..operators.exprs import mid_percentile

    return df.filter("close is not null").select("inst", "session", r(mid_percentile("close", high_is_good=False)).alias("mid"))


_EL = "case when close > open then {} end"


@panel("e19_filtered_cross_moments", f"select inst, session, round(var_samp({_EL.format('close')}) over w, 4) + 0.0 var_up, round(covar_samp({_EL.format('close')}, {_EL.format('volume')}) over w, 4) + 0.0 cov_up, round(avg(close) filter (close > open) over w, 5) + 0.0 mean_up from bars window w as (partition by session)")
def e19(df):
    up = lambda c: F.when(F.col("close") > F.col("open"), F.col(c))
    w = by_session()
    return df.select("inst", "session", r(F.var_samp(up("close")).over(w), 4).alias("var_up"), r(F.covar_samp(up("close"), up("volume")).over(w), 4).alias("cov_up"), r(F.avg(up("close")).over(w), 5).alias("mean_up"))


@panel("e25_index_average_gap", f"{RET}, i as (select inst, session, seq, ret, sum(case when ret > -1 then ln(1 + ret) end) {_W} l from ret), x as (select *, exp(l) lev from i) select inst, session, round(case when count(lev) {_N.format(49)} = 50 then lev / avg(lev) {_N.format(49)} - 1 end, 5) + 0.0 gap from x")
def e25(df):
    from ..operators.exprs import rolling_full
    from pyspark.sql import Window

    w = by_instrument().rowsBetween(Window.unboundedPreceding, 0)
    x = with_return(df).withColumn("lev", F.exp(F.sum(F.when(F.col("ret") > -1, F.log1p("ret"))).over(w)))
    return x.select("inst", "session", r(safe_div("lev", rolling_full("lev", 50)) - 1, 5).alias("gap"))


@panel("e26_drawdown_episodes", f"""d as (select inst, session, seq, close, max(close) {_N.format(51)} peak52, max(close) {_W} peak from bars), x as (select *, close / peak52 - 1 dd52, close / peak - 1 dd from d), w as (select inst, arg_min(session, struct_pack(dd := dd, s := session)) trough, min(dd) worst, arg_min(peak, struct_pack(dd := dd, s := session)) top, round(min(dd52), 6) + 0.0 worst52 from x where dd is not null group by inst)
select w.inst, trough, round(worst, 6) + 0.0 worst, worst52, (select max(session) from bars b where b.inst = w.inst and b.session <= trough and b.close = w.top) peak_session, (select min(session) from bars b where b.inst = w.inst and b.session > trough and b.close >= w.top) recovered from w""", ("trough", "peak_session", "recovered"))
def e26(df):
    x = V.worst_episode(df, "close", 52)
    return x.select("inst", "trough", r("worst").alias("worst"), r("worst52").alias("worst52"), "peak_session", "recovered")


@panel("e27_crossings", f"""f as (select inst, session, close > open up, lag(close > open) {_W} was from bars) select inst, session from f where up and was = false""")
def e27(df):
    return V.crossings(df, F.col("close") > F.col("open")).select("inst", "session")


@panel("e28_activity_coverage_gate", f"a as (select session, case when count(volume) {_N.format(19)} >= 15 then avg(volume) {_N.format(19)} end / case when count(volume) {_N.format(59)} >= 45 then avg(volume) {_N.format(59)} end ratio from bars) select session, count(ratio) n, count(*) n_all, case when count(ratio) >= 0.7 * count(*) then round(median(ratio), 5) + 0.0 end med from a group by session")
def e28(df):
    x = df.select("session", safe_div(V.rolling_least("volume", 20, 15), V.rolling_least("volume", 60, 45)).alias("ratio"))
    return x.groupBy("session").agg(F.count("ratio").alias("n"), F.count("*").alias("n_all"), F.when(F.count("ratio") >= 0.7 * F.count("*"), r(F.median("ratio"), 5)).alias("med"))


@panel("b1_market_daily_flags", "select inst, session, coalesce(volume = 0 and amount = 0 and close > 0, false) zero_quote, round(amount * 1000, 2) + 0.0 amount_cny from (select inst, session, close, case when seq % 40 = 0 then 0 else volume end volume, case when seq % 40 = 0 then 0 else amount end amount from bars)")
def b1(df):
    z = F.col("seq") % 40 == 0
    x = df.withColumns({"volume": F.when(z, 0.0).otherwise(F.col("volume")), "amount": F.when(z, 0.0).otherwise(F.col("amount"))})
    return x.select("inst", "session", P.zero_quote().alias("zero_quote"), r(F.col("amount") * 1000, 2).alias("amount_cny"))


_FLAW = "flawed as (select inst, session, seq, open, case when seq % 37 = 0 then low - 1 else high end high, low, close, case when seq % 41 = 0 then -volume else volume end volume, amount from bars)"


def flawed(df):
    """Bars with planted faults, so that checks have something to find."""
    return df.withColumns({"high": F.when(F.col("seq") % 37 == 0, F.col("low") - 1).otherwise(F.col("high")), "volume": F.when(F.col("seq") % 41 == 0, -F.col("volume")).otherwise(F.col("volume"))})


@panel("b2_tradable_split_flawed", f"{_FLAW} select seq % 37 = 0 or seq % 41 = 0 planted, coalesce(high >= greatest(open, close, low) and low <= least(open, close) and volume > 0, false) tradeable, count(*) n from flawed group by 1, 2", ())
def b2(df):
    x = P.quality_flags(flawed(df)).withColumn("planted", (F.col("seq") % 37 == 0) | (F.col("seq") % 41 == 0))
    return x.groupBy("planted", "tradeable").agg(F.count("*").alias("n"))


@panel("b6_adjusted_ohlc", "select inst, session, " + _sql({c: f"{c} * (1 + seq / 1000::double)" for c in ("open", "high", "low")}) + " from bars")
def b6(df):
    return P.adjusted(df.withColumn("adj_factor", 1 + F.col("seq") / 1000)).select("inst", "session", *(r(f"adj_{c}", 5).alias(c) for c in ("open", "high", "low")))


@panel("b8_finite_or_null", "select inst, session, case when seq % 3 = 2 and close is not null then round(close, 4) + 0.0 end as val from bars")
def b8(df):
    from ..operators.exprs import finite_or_null

    x = F.when(F.col("seq") % 3 == 0, F.lit(float("nan"))).when(F.col("seq") % 3 == 1, F.lit(float("-inf"))).otherwise(F.col("close"))
    return df.select("inst", "session", r(finite_or_null(x), 4).alias("val"))


@panel("d3_grouped_corr_var", "select session, round(case when var_samp(close) > 1e-12 and var_samp(volume) > 1e-12 then corr(close, volume) end, 5) + 0.0 corr, round(var_samp(close), 3) + 0.0 var from bars where close is not null group by session having count(*) >= 5")
def d3(df):
    ok = (F.var_samp("close") > 1e-12) & (F.var_samp("volume") > 1e-12)
    x = df.filter("close is not null").groupBy("session").agg(F.count("*").alias("n"), r(F.when(ok, F.corr("close", "volume")), 5).alias("corr"), r(F.var_samp("close"), 3).alias("var"))
    return x.filter("n >= 5").drop("n")


@panel("d8_breadth_coverage", f"{RET} select session, round(count(ret) / count(*)::double, 6) + 0.0 coverage, case when count(ret) >= 0.5 * count(*) then round(avg(case when ret > 0 then 1.0 when ret is not null then 0.0 end), 6) + 0.0 end breadth from ret group by session")
def d8(df):
    x = with_return(df).groupBy("session").agg(F.count("ret").alias("n"), F.count("*").alias("m"), F.avg(F.when(F.col("ret").isNotNull(), (F.col("ret") > 0).cast("double"))).alias("b"))
    return x.select("session", r(F.col("n") / F.col("m")).alias("coverage"), F.when(F.col("n") >= 0.5 * F.col("m"), r("b")).alias("breadth"))


@panel("d10_compound_periods", f"{RET} select inst, cast(year(session) * 10 + quarter(session) as bigint) q, count(ret) n, round(exp(sum(ln(1 + ret))) - 1, 4) + 0.0 total, round(product(1 + case when seq % 13 = 0 then 0.1::double else 0 end), 5) + 0.0 scale from ret group by 1, 2", ())
def d10(df):
    q = (F.year("session") * 10 + F.quarter("session")).cast("long")
    return with_return(df).groupBy("inst", q.alias("q")).agg(F.count("ret").alias("n"), r(F.exp(F.sum(F.log1p("ret"))) - 1, 4).alias("total"), r(F.product(F.when(F.col("seq") % 13 == 0, 1.1).otherwise(1.0)), 5).alias("scale"))


@panel("d11_hit_thresholds", f"{MOM}, {FWD} select case when mom > 0 then 'up' when mom <= 0 then 'down' else 'unknown' end state, round(avg(case when fwd >= 0.02 then 1.0 else 0.0 end), 6) + 0.0 hit2, round(avg(case when fwd >= 0.05 then 1.0 else 0.0 end), 6) + 0.0 hit5, round(avg(case when fwd <= -0.05 then 1.0 else 0.0 end), 6) + 0.0 miss5 from fwd where fwd is not null group by 1", ())
def d11(df):
    state = F.when(F.col("mom") > 0, "up").when(F.col("mom") <= 0, "down").otherwise("unknown")
    hit = lambda c: r(F.avg(c.cast("double")))
    x = P.with_forward_return(P.with_momentum(df)).filter("fwd is not null")
    return x.groupBy(state.alias("state")).agg(hit(F.col("fwd") >= 0.02).alias("hit2"), hit(F.col("fwd") >= 0.05).alias("hit5"), hit(F.col("fwd") <= -0.05).alias("miss5"))


_LONG = f"{MOM}, l as (select inst, session, 'mom' factor, mom as val from mom union all select inst, session, 'size', ln(amount) from mom union all select inst, session, 'bad', case when seq % 50 = 0 then 'nan'::double when seq % 3 = 0 then close end from mom)"


def long_factors(df):
    x = P.with_momentum(df).withColumns({"size": F.log("amount"), "bad": F.when(F.col("seq") % 50 == 0, float("nan")).when(F.col("seq") % 3 == 0, F.col("close"))})
    return x.unpivot(["inst", "session"], ["mom", "size", "bad"], "factor", "val")


@panel("d12_release_quality_by_factor", f"{_LONG} select factor, count(*) n_rows, count(val) filter (isfinite(val)) present, count(val) filter (not isfinite(val)) not_finite, round(count(val) filter (isfinite(val)) / count(*)::double, 6) + 0.0 coverage, round(min(val) filter (isfinite(val)), 5) + 0.0 lowest, round(max(val) filter (isfinite(val)), 5) + 0.0 highest, count(distinct session) sessions, count(distinct inst) instruments, count(*) - count(distinct (inst, session)) duplicates from l group by factor", ())
def d12(df):
    x = P.release_quality(long_factors(df), "factor", "val", ["inst", "session"])
    return x.withColumns({c: r(c, 6 if c == "coverage" else 5) for c in ("coverage", "lowest", "highest")})


@panel("d13_bucket_rejections", "o as (select capital, case when close is null then 'no_bar' when capital / 20 / amount > 1 then 'too_large' when capital / 20 / amount > 0.1 then 'partial' else 'filled' end outcome from bars cross join (values (10000::double), (100000::double), (1000000::double)) c(capital)) select cast(capital as bigint) capital, outcome, count(*) n, round(count(*) / sum(count(*)) over (partition by capital)::double, 6) + 0.0 share from o group by 1, 2, o.capital", ())
def d13(df):
    from pyspark.sql import Window

    x = df.withColumn("capital", F.explode(F.array(*(F.lit(float(c)) for c in (10_000, 100_000, 1_000_000)))))
    part = F.col("capital") / 20 / F.col("amount")
    outcome = F.when(F.col("close").isNull(), "no_bar").when(part > 1, "too_large").when(part > 0.1, "partial").otherwise("filled")
    n = x.groupBy(F.col("capital").cast("long").alias("capital"), outcome.alias("outcome")).agg(F.count("*").alias("n"))
    return n.withColumn("share", r(F.col("n") / F.sum("n").over(Window.partitionBy("capital"))))


@panel("d17_latest_status", "l as (select inst, count(*) n, count(close) valid, max(session) filter (close is not null) last_valid from bars group by inst), e as (select max(session) last_session from bars) select inst, round(valid / n::double, 6) + 0.0 coverage, case when last_valid is null then 'empty' when last_valid < last_session then 'stale' else 'current' end status from l cross join e", ())
def d17(df):
    last = df.agg(F.max("session").alias("last_session"))
    x = df.groupBy("inst").agg(F.count("*").alias("n"), F.count("close").alias("valid"), F.max(F.when(F.col("close").isNotNull(), F.col("session"))).alias("last_valid")).crossJoin(F.broadcast(last))
    status = F.when(F.col("last_valid").isNull(), "empty").when(F.col("last_valid") < F.col("last_session"), "stale").otherwise("current")
    return x.select("inst", r(F.col("valid") / F.col("n")).alias("coverage"), status.alias("status"))
