"""Queries of labels, inference, folds, redundancy, signals and portfolios, with their SQL."""
from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import evidence as E
from ..operators import panel as P
from ..operators import research as R
from ..operators.clustering import average_linkage
from ..operators.events import economic_return_label
from ..operators.exprs import average_rank, by_instrument, by_session, safe_div, safe_log
from ..operators.order_stats import with_history_percentile
from ..operators.switching import Rule, confirmed_regime, switches
from ..operators.windows import crossings, segmented_index, with_return
from ..sources.fixture import bars
from .base import _N, _W, FWD, MOM, ORACLES, RET, panel, r
from .fact_queries import _EVENTS, events
from .formula_queries import rounded
from .research_queries import table
from .temporal_queries import day


def both(df):
    return P.with_forward_return(P.with_momentum(df))


_LIM = "lm as (select *, 1 + seq / 1000::double adj_factor, close is not null and (inst + seq) % 29 <> 0 tradeable, case when (inst + seq) % 19 <> 0 then (inst + seq) % 17 <> 0 end can_buy, case when (inst * seq) % 23 <> 0 then (inst * seq) % 13 <> 0 end can_sell from bars), ll as (select *, lead(seq, 1) over w s1, lead(seq, 6) over w s6, lead(open, 1) over w o1, lead(close, 6) over w c6, lead(adj_factor, 1) over w f1, lead(adj_factor, 6) over w f6, lead(tradeable, 1) over w t1, lead(tradeable, 6) over w t6, lead(can_buy, 1) over w b1, lead(can_sell, 6) over w b6 from lm window w as (partition by inst order by session))"
_REASON = "case when s1 is null then 'no_entry_session' when s6 is null then 'no_exit_session' when not coalesce(t1, false) then 'entry_untradable' when not coalesce(t6, false) then 'exit_untradable' when b1 is null then 'entry_limit_unknown' when b6 is null then 'exit_limit_unknown' when not b1 then 'entry_buy_blocked' when not b6 then 'exit_sell_blocked' when o1 is null or o1 <= 0 or c6 is null or c6 <= 0 then 'price_invalid' else 'valid' end"


@panel("j6_limit_aware_label", f"{_LIM} select inst, session, {_REASON} reason, case when {_REASON} = 'valid' then round(c6 * f6 / (o1 * f1) - 1, 6) + 0.0 end label from ll")
def j6(df):
    s, i = F.col("seq"), F.col("inst")
    x = df.withColumns({"adj_factor": 1 + s / 1000, "tradeable": F.col("close").isNotNull() & ((i + s) % 29 != 0), "can_buy_open": F.when((i + s) % 19 != 0, (i + s) % 17 != 0), "can_sell_close": F.when((i * s) % 23 != 0, (i * s) % 13 != 0)})
    return E.limit_aware_label(x, 5).select("inst", "session", "reason", r("label").alias("label"))


@panel("j5_forward_label_horizons", f"{MOM} select inst, session, " + ", ".join(f"round(lead(close, {h + 1}) {_W} / lead(open, 1) {_W} - 1, 5) + 0.0 fwd{h}" for h in (5, 10, 20, 30, 63, 126)) + " from mom")
def j5(df):
    out = df
    for h in (5, 10, 20, 30, 63, 126):
        out = P.with_forward_return(out, h).withColumnRenamed("fwd", f"fwd{h}").drop("reason")
    return out.select("inst", "session", *(r(f"fwd{h}", 5).alias(f"fwd{h}") for h in (5, 10, 20, 30, 63, 126)))


_SEG = f"{RET}, sg as (select *, sum(case when ret is null then 1 else 0 end) {_W} segment from ret), lv as (select *, case when ret is null then 100.0::double else 100 * exp(sum(ln(1 + ret)) over (partition by inst, segment order by session)) end lev from sg)"


@panel("j7_sector_path_label", f"""{_SEG}, p as (select *, list(lev) over w path, min(segment) over w s0, max(segment) over w s1, lead(100.0::double + seq, 1) over (partition by inst order by session) b0, lead(100.0::double + seq, 11) over (partition by inst order by session) b1 from lv window w as (partition by inst order by session rows between 1 following and 11 following))
select inst, session, case when ok then round(path[11] / path[1] - 1, 5) + 0.0 end path_return, case when ok then round(path[11] / path[1] - 1 - (b1 / b0 - 1), 5) + 0.0 end active_return, case when ok then round(list_min(list_transform(range(1, 12), lambda i: path[i] / list_max(path[1:i]) - 1)), 5) + 0.0 end path_drawdown, case when ok then round(list_min(path) / path[1] - 1, 5) + 0.0 end path_low from (select *, coalesce(len(path) = 11 and s0 = s1, false) ok from p)""")
def j7(df):
    x = segmented_index(with_return(df), "ret").withColumn("bench", 100.0 + F.col("seq"))
    x = E.path_label(x, 10, benchmark="bench")
    return x.select("inst", "session", *(r(c, 5).alias(c) for c in ("path_return", "active_return", "path_drawdown", "path_low")))


@table("j8_economic_total_return_label", f"{_EVENTS}, h as (select inst, session, lead(session, 1) over w i0, lead(session, 14) over w i1, lead(open, 1) over w p0, lead(open, 14) over w p1 from bars window w as (partition by inst order by session)), e as (select h.inst, h.session, e.cash, e.stock, coalesce(product(1 + e.stock) over (partition by h.inst, h.session order by e.ex_date rows between unbounded preceding and 1 preceding), 1) sh from h join ev e on e.inst = h.inst and e.ex_date > h.i0 and e.ex_date <= h.i1), g as (select inst, session, product(1 + stock) shares, sum(sh * cash) cash, count(*) n, count(cash) nc, count(stock) ns from e group by 1, 2), t as (select h.inst, h.session, case when coalesce(n = nc and n = ns, true) then (coalesce(shares, 1) * p1 + coalesce(cash, 0)) / p0 - 1 end total from h left join g using (inst, session)) select inst, session, round(total, 5) + 0.0 total, round(total - avg(total) over (partition by session), 5) + 0.0 relative from t", ("session",))
def j8(spark, sf_dir):
    x = economic_return_label(bars(spark, sf_dir).select("inst", "session", "open"), events(spark, sf_dir), 13)
    return x.select("inst", "session", r("total", 5).alias("total"), r("relative", 5).alias("relative"))


_BUCKET = f"{MOM}, kb as (select session, seq, inst, rank() over (partition by session order by mom) + (count(*) over (partition by session, mom) - 1) / 2.0::double rk, count(*) over (partition by session) n from mom where mom is not null), bk as (select session, seq, inst, cast(least(5, floor((rk - 1) * 5 / n) + 1) as int) bucket from kb), days as (select session, row_number() over (order by session) d from (select distinct session from bk)), bd as (select bk.*, d from bk join days using (session))"


@panel("j12_quantile_turnover", f"{_BUCKET}, sz as (select d, session, bucket, count(*) n from bd group by 1, 2, 3), kept as (select a.d, a.bucket, count(*) kept from bd a join bd b on a.inst = b.inst and a.bucket = b.bucket and a.d = b.d + 1 group by 1, 2) select s.session, s.bucket, s.n, case when p.n is not null then round(1 - coalesce(kept, 0) * least(1.0::double / p.n, 1.0::double / s.n), 6) + 0.0 end turnover from sz s left join sz p on s.d = p.d + 1 and s.bucket = p.bucket left join kept k on k.d = s.d and k.bucket = s.bucket")
def j12(df):
    x = R.observed_turnover(P.quantile_buckets(P.with_momentum(df), "mom"))
    return x.select("session", "bucket", "n", r("turnover").alias("turnover"))


@panel("j13_label_forward_check", f"l as (select inst, session, session + interval 15 hours known, case when seq % 50 = 0 then session else lead(session, 6) {_W} end + interval 15 hours label_known from bars) select inst, session from l where label_known <= known")
def j13(df):
    at = lambda c: c.cast("timestamp_ntz") + F.expr("interval 15 hours")
    end = F.when(F.col("seq") % 50 == 0, F.col("session")).otherwise(F.lead("session", 6).over(by_instrument()))
    x = df.withColumns({"known": at(F.col("session")), "label_known": at(end)})
    return E.label_forward_violations(x, "known", "label_known").select("inst", "session")


_P = "({0} * exp(-{1} * {1}))"
_T = "(1 / (1 + 0.3275911::double * {0}))"


def _p_sql(z):
    x = f"(abs({z}) / sqrt(2.0::double))"
    t = _T.format(x)
    poly = f"{t} * (0.254829592::double + {t} * (-0.284496736::double + {t} * (1.421413741::double + {t} * (-1.453152027::double + {t} * 1.061405429::double))))"
    return f"({poly} * exp(-{x} * {x}))"


def _nw_sql(source, entity, x, order, lags, name):
    """CTEs that end in name(entity, n, mean, t) for the Newey-West test of x."""
    lagged = ", ".join(f"e * lag(e, {k}) over (partition by {entity} order by {order}) p{k}" for k in range(1, lags + 1))
    total = " + ".join(f"{1 - k / (lags + 1)}::double * coalesce(sum(p{k}), 0)" for k in range(1, lags + 1))
    return f"{name}0 as (select *, {x} - avg({x}) over (partition by {entity}) e from {source} where {x} is not null), {name}1 as (select *, {lagged} from {name}0), {name}2 as (select {entity}, count(*) n, avg({x}) mean, sum(e * e) + 2 * ({total}) v from {name}1 group by {entity}), {name} as (select *, mean / (sqrt(case when v > 1e-18 and n > 1 then v end) / n) t from {name}2)"


@panel("j14_newey_west_p_value", f"{RET}, {_nw_sql('ret', 'inst', 'ret', 'session', 5, 'nw')} select inst, n, round(t, 4) + 0.0 t, round({_p_sql('t')}, 5) + 0.0 p from nw", ())
def j14(df):
    return E.mean_test(with_return(df), "inst", "ret", "session", 5).select("inst", "n", r("t", 4).alias("t"), r("p", 5).alias("p"))


@panel("j16_stability_summary", f"{RET}, kk as (select inst, ret, ((row_number() over (partition by inst order by session) - 1) * 4) // count(*) over (partition by inst) part from ret where ret is not null), m as (select inst, part, avg(ret) mean from kk group by 1, 2), a as (select inst, avg(ret) al from ret where ret is not null group by 1) select inst, round(avg(case when sign(mean) = sign(al) then 1.0 else 0.0 end), 6) + 0.0 same_sign, round(min(mean * case when al < 0 then -1 else 1 end), 6) + 0.0 worst, round(max(mean) - min(mean), 6) + 0.0 spread from m join a using (inst) group by inst", ())
def j16(df):
    x = R.stability_summary(with_return(df), "inst", "ret", "session", 4)
    return x.select("inst", r("same_sign").alias("same_sign"), r("worst").alias("worst"), r("spread").alias("spread"))


# ---- folds: rank IC of three factors by session

_FACTORS = {"mom": "mom", "size": "ln(amount)", "vol": "volume"}


def factor_panel(df):
    return both(df).withColumns({"size": safe_log("amount"), "vol": F.col("volume")})


def factor_long(df):
    return factor_panel(df).unpivot(["inst", "session", "seq", "fwd"], list(_FACTORS), "factor", "val").filter("val is not null")


def ic_series(df):
    x = factor_long(df).filter("fwd is not null")
    ranked = x.select("session", "factor", average_rank("val", "factor").alias("x"), average_rank("fwd", "factor").alias("y"))
    ok = (F.var_pop("x") > 1e-12) & (F.var_pop("y") > 1e-12)
    return ranked.groupBy("session", "factor").agg(F.count("*").alias("n"), F.when(ok, F.covar_pop("x", "y") / F.sqrt(F.var_pop("x") * F.var_pop("y"))).alias("ic")).filter("n >= 5")


_IC = f"{MOM}, {FWD}, fl as (" + " union all ".join(f"select inst, session, seq, fwd, '{n}' factor, {x} as val from fwd" for n, x in _FACTORS.items()) + "), rk as (select session, factor, rank() over (partition by session, factor order by val) + (count(*) over (partition by session, factor, val) - 1) / 2.0::double x, rank() over (partition by session, factor order by fwd) + (count(*) over (partition by session, factor, fwd) - 1) / 2.0::double y from fl where val is not null and fwd is not null), ic as (select session, factor, count(*) n, case when var_pop(x) > 1e-12 and var_pop(y) > 1e-12 then covar_pop(x, y) / sqrt(var_pop(x) * var_pop(y)) end ic from rk group by 1, 2 having count(*) >= 5)"
_FOLDS = [("F1", "1995-01-02", "1997-12-22", "1998-01-05", "1998-12-21", "1999-01-04", "1999-12-27"), ("F2", "1995-01-02", "1998-12-21", "1999-01-04", "1999-12-20", "2000-01-03", "2000-12-25")]
_FOLD_COLS = ["fold", "train_start", "train_end", "validation_start", "validation_end", "test_start", "test_end"]
_FOLD_SQL = "fo as (select fold, " + ", ".join(f"cast({c} as date) {c}" for c in _FOLD_COLS[1:]) + f" from (values {', '.join(map(str, _FOLDS))}) v({', '.join(_FOLD_COLS)})), se as (select session, lead(session, 6) over (order by session) label_end from (select distinct session from bars)), wf as (select ic.*, fold, case when session between train_start and train_end and label_end < validation_start then 'train' when session between validation_start and validation_end and label_end < test_start then 'validation' when session between test_start and test_end then 'test' end role from ic join se using (session) join fo on session between train_start and test_end), w as (select * from wf where role is not null)"


def folds(spark):
    d = spark.createDataFrame(_FOLDS, ", ".join(f"{c} string" for c in _FOLD_COLS))
    return d.withColumns({c: F.col(c).cast("date") for c in _FOLD_COLS[1:]})


def fold_rows(df):
    ends = df.select("session").distinct().withColumn("label_end", F.lead("session", 6).over(Window.partitionBy(F.lit(0)).orderBy("session")))
    return E.walk_forward(ic_series(df).join(ends, "session"), folds(df.sparkSession), "label_end")


@panel("j10_value_ic", f"{MOM}, {FWD} select session, count(*) n_pairs, round(case when var_pop(mom) > 1e-12 and var_pop(fwd) > 1e-12 then corr(mom, fwd) end, 6) + 0.0 ic from fwd where mom is not null and fwd is not null group by session having count(*) >= 5")
def j10(df):
    x = both(df).filter("mom is not null and fwd is not null")
    ok = (F.var_pop("mom") > 1e-12) & (F.var_pop("fwd") > 1e-12)
    return x.groupBy("session").agg(F.count("*").alias("n_pairs"), r(F.when(ok, F.corr("mom", "fwd"))).alias("ic")).filter("n_pairs >= 5")


@panel("j9_coverage_ratio", f"{MOM}, {FWD} select session, round(count(mom) / count(*)::double, 6) + 0.0 factor_coverage, round(count(fwd) / count(*)::double, 6) + 0.0 label_coverage from fwd group by session")
def j9(df):
    return both(df).groupBy("session").agg(r(F.count("mom") / F.count("*")).alias("factor_coverage"), r(F.count("fwd") / F.count("*")).alias("label_coverage"))


@panel("j19_walk_forward_splits", f"{_IC}, {_FOLD_SQL} select fold, role, count(distinct session) sessions, min(session) first_session, max(session) last_session from w group by 1, 2", ("first_session", "last_session"))
def j19(df):
    return fold_rows(df).groupBy("fold", "role").agg(F.count_distinct("session").alias("sessions"), F.min("session").alias("first_session"), F.max("session").alias("last_session"))


_DECL = "case factor when 'size' then 'NEGATIVE' end"
_DIR = f"dr as (select fold, factor, avg(ic) filter (role = 'train') train_mean, avg(ic) filter (role = 'test') test_mean, {_DECL} decl from w group by fold, factor), di as (select *, case when decl = 'POSITIVE' then 1 when decl = 'NEGATIVE' then -1 when train_mean >= 0 then 1 when train_mean < 0 then -1 end direction from dr)"


def directions(df):
    return E.fold_directions(fold_rows(df).withColumn("direction", F.when(F.col("factor") == "size", "NEGATIVE")), "ic")


@panel("j20_fold_direction", f"{_IC}, {_FOLD_SQL}, {_DIR} select fold, factor, direction, case when decl is null then 'train_mean_sign' else 'declared' end origin, round(train_mean, 6) + 0.0 train_mean, round(test_mean, 6) + 0.0 test_mean from di", ())
def j20(df):
    return directions(df).select("fold", "factor", "direction", "origin", r("train_mean").alias("train_mean"), r("test_mean").alias("test_mean"))


_REG = f"{_IC}, {_FOLD_SQL}, mk as (select session, avg(ret) mkt from (select session, close / nullif(lag(close) {_W}, 0) - 1 ret from bars) group by 1), rg as (select session, sum(case when mkt > -1 then ln(1 + mkt) end) over (order by session rows between 59 preceding and current row) trend, stddev_pop(mkt) over (order by session rows between 19 preceding and current row) volatility from mk), ct as (select fold, median(volatility) cut from (select distinct fold, w.session, volatility from w join rg using (session) where role = 'train') group by 1)"


@panel("j21_regime_buckets", f"{_REG}, tt as (select w.fold, factor, ic, trend, volatility, cut from w join rg using (session) join ct on ct.fold = w.fold where role = 'test'), l as (select fold, factor, ic, 'trend' dimension, case when trend >= 0 then 'up' else 'down' end regime from tt union all select fold, factor, ic, 'volatility', case when volatility >= cut then 'high' else 'low' end from tt) select fold, factor, dimension, regime, count(ic) n, round(avg(ic), 6) + 0.0 mean, case when count(ic) >= 20 then 'diagnostic' else 'insufficient_sessions' end status from l group by 1, 2, 3, 4", ())
def j21(df):
    x = E.regime_means(fold_rows(df), E.market_regimes(P.market_return(df), "market", 60, 20), "ic", 20)
    return x.withColumn("mean", r("mean"))


def directed_ic(df):
    """Rank IC of the test sessions of each fold and factor (key), times the fold's direction."""
    f = fold_rows(df).filter("role = 'test'").join(directions(df).select("fold", "factor", "direction"), ["fold", "factor"])
    return f.select(F.concat_ws(":", "fold", "factor").alias("key"), "session", (F.col("ic") * F.col("direction")).alias("directed"))


def hypotheses(df, lags=3):
    """Directed test of every fold and factor with the adjusted p of the whole family."""
    t = E.mean_test(directed_ic(df), "key", "directed", "session", lags).withColumn("family", F.lit("all"))
    return P.benjamini_hochberg(t, "p", "family")


_HYP = f"{_IC}, {_FOLD_SQL}, {_DIR}, dd as (select w.fold || ':' || w.factor as key, session, ic * direction directed from w join di on di.fold = w.fold and di.factor = w.factor where role = 'test'), {_nw_sql('dd', 'key', 'directed', 'session', 3, 'hy')}, hp as (select *, {_p_sql('t')} p from hy), hr as (select *, row_number() over (order by p) rn, count(*) over () m from hp where p is not null), hq as (select *, least(1.0::double, min(p * m / rn) over (order by rn rows between current row and unbounded following)) q from hr)"


# ---- redundancy: variants of the factors

_ENT = ["RAW:mom", "Z:mom", "RAW:size", "Z:size", "RAW:vol"]
_MONTHS = "me as (select max(session) session from bars group by year(session), month(session))"
_LONGV = f"{MOM}, {_MONTHS}, en as (select session, inst, 'RAW:mom' entity, mom as val from mom union all select session, inst, 'Z:mom', mom * 3 + 1 from mom union all select session, inst, 'RAW:size', ln(amount) from mom union all select session, inst, 'Z:size', ln(amount) - (inst % 3) / 1000.0::double from mom union all select session, inst, 'RAW:vol', volume from mom), er as (select session, inst, entity, rank() over (partition by session, entity order by val) + (count(*) over (partition by session, entity, val) - 1) / 2.0::double rk from en where val is not null)"
_VALC = f"{_LONGV}, vc as (select session, a.entity left_id, b.entity right_id, count(*) n, case when count(*) >= 3 and var_pop(a.rk) > 1e-12 and var_pop(b.rk) > 1e-12 then covar_pop(a.rk, b.rk) / sqrt(var_pop(a.rk) * var_pop(b.rk)) end corr from er a join er b using (session, inst) where list_position({_ENT}, a.entity) < list_position({_ENT}, b.entity) and session in (select session from me) group by 1, 2, 3)"


def entity_ranks(df, months=True):
    x = P.with_momentum(df)
    v = {"RAW:mom": F.col("mom"), "Z:mom": F.col("mom") * 3 + 1, "RAW:size": safe_log("amount"), "Z:size": safe_log("amount") - (F.col("inst") % 3) / 1000.0, "RAW:vol": F.col("volume")}
    long = x.select("session", "inst", F.explode(F.array(*(F.struct(F.lit(k).alias("entity"), c.alias("val")) for k, c in v.items()))).alias("e")).select("session", "inst", "e.*").filter("val is not null")
    if months:
        ends = df.groupBy(F.trunc("session", "month").alias("m")).agg(F.max("session").alias("session")).select("session")
        long = long.join(F.broadcast(ends), "session", "left_semi")
    return long.select("session", "inst", "entity", average_rank("val", "entity").alias("rk"))


@panel("j23_entity_value_correlation", f"{_VALC} select session, left_id, right_id, n, round(corr, 6) + 0.0 corr from vc")
def j23(df):
    x = E.pair_correlations(entity_ranks(df), ["session", "inst"], "entity", "rk", _ENT, "session")
    return x.filter("n > 0").select("session", "left_id", "right_id", "n", r("corr").alias("corr"))


def pair_summary(df):
    x = E.pair_correlations(entity_ranks(df), ["session", "inst"], "entity", "rk", _ENT, "session").filter("corr is not null")
    return x.groupBy("left_id", "right_id").agg(F.count("*").alias("sessions"), F.avg("corr").alias("mean"), F.median("corr").alias("med"), F.min("corr").alias("low"), F.max("corr").alias("high"))


@panel("j24_pair_summary", f"{_VALC} select left_id, right_id, count(*) sessions, round(avg(corr), 6) + 0.0 mean, round(median(corr), 6) + 0.0 med, round(min(corr), 6) + 0.0 low, round(max(corr), 6) + 0.0 high from vc where corr is not null group by 1, 2", ())
def j24(df):
    return pair_summary(df).select("left_id", "right_id", "sessions", *(r(c).alias(c) for c in ("mean", "med", "low", "high")))


@panel("j24_ic_series_correlation", f"{_IC} select a.factor left_id, b.factor right_id, count(*) n, round(covar_pop(a.ic, b.ic) / sqrt(var_pop(a.ic) * var_pop(b.ic)), 5) + 0.0 corr from ic a join ic b using (session) where list_position(['mom', 'size', 'vol'], a.factor) < list_position(['mom', 'size', 'vol'], b.factor) and a.ic is not null and b.ic is not null group by 1, 2", ())
def j24_ic(df):
    x = E.pair_correlations(ic_series(df).filter("ic is not null"), ["session"], "factor", "ic", list(_FACTORS), "")
    return x.select("left_id", "right_id", "n", r("corr", 5).alias("corr"))


_DUP = f"{_VALC}, ps as (select left_id, right_id, avg(corr) mean from vc where corr is not null group by 1, 2), dg as (select left_id a, right_id b from ps where mean >= 0.95 and split_part(left_id, ':', 2) = split_part(right_id, ':', 2)), nd as (select unnest({_ENT}) id)"


@panel("j25_near_duplicate_groups", f"{_DUP}, gr as (select id, least(id, coalesce((select min(b) from dg where a = id), id), coalesce((select min(a) from dg where b = id), id)) label from nd) select id, label, first_value(id) over (partition by label order by case when id like 'Z:%' then 0 else 1 end, id) canonical, count(*) over (partition by label) members from gr", ())
def j25(df):
    return duplicate_groups(df)


def duplicate_groups(df):
    """Variants of a factor whose ranks agree nearly everywhere, and the one that stands for them."""
    same = F.split("left_id", ":")[1] == F.split("right_id", ":")[1]
    edges = pair_summary(df).filter((F.col("mean") >= 0.95) & same).select("left_id", "right_id")
    nodes = df.sparkSession.createDataFrame([(e,) for e in _ENT], "id string")
    groups = E.small_components(nodes, edges)
    return E.canonical_members(groups, F.when(F.col("id").startswith("Z:"), 0).otherwise(1))


def cluster_distances(df):
    d = pair_summary(df).select(F.lit("all").alias("family"), "left_id", "right_id", (1 - F.abs("mean")).alias("distance"))
    return d


@panel("j26_cluster_threshold_cut", "", ())
def j26(df):
    d = cluster_distances(df)
    x = E.medoids(average_linkage(d, 0.35), d)
    return x.select("family", "id", "cluster", r("mean_distance").alias("mean_distance"), "representative")


def rank_wide(df):
    x = factor_panel(df).filter("mom is not null and size is not null and vol is not null and fwd is not null")
    return x.select("session", "inst", *(average_rank(c).alias(c) for c in ("mom", "size", "vol", "fwd")))


# ---- signals


@panel("j32_signal_quintile_study", f"{MOM}, {FWD}, hf as (select *, case when session < date '1998-06-01' then 1 else 2 end half from fwd), ct as (select inst, quantile_cont(mom, [0.2, 0.4, 0.6, 0.8]) c from hf where half = 1 group by 1), bk as (select half, fwd, 1 + case when mom > c[1] then 1 else 0 end + case when mom > c[2] then 1 else 0 end + case when mom > c[3] then 1 else 0 end + case when mom > c[4] then 1 else 0 end bucket from hf join ct using (inst) where mom is not null and fwd is not null) select half, bucket, count(*) n, round(avg(fwd), 5) + 0.0 mean, round(median(fwd), 5) + 0.0 med from bk group by 1, 2", ())
def j32(df):
    x = both(df).withColumn("half", F.when(F.col("session") < day("1998-06-01"), 1).otherwise(2))
    b = E.frozen_buckets(x, "inst", "mom", "half").filter("bucket is not null and fwd is not null")
    return b.groupBy("half", "bucket").agg(F.count("*").alias("n"), r(F.avg("fwd"), 5).alias("mean"), r(F.median("fwd"), 5).alias("med"))


@panel("j57_state_zones", f"{MOM}, f as (select *, mom > 0 fl, lag(mom > 0) {_W} was, lead(seq) {_W} nx from mom), g as (select *, sum(case when coalesce(fl, false) and not coalesce(was, false) then 1 else 0 end) {_W} run from f) select inst, min(session) as start, max(session) as stop, count(*) length, round(min(mom), 5) + 0.0 low, round(max(mom), 5) + 0.0 high, round(avg(mom), 5) + 0.0 mean, round(arg_max(close, session) / arg_min(close, session) - 1, 5) + 0.0 price_change, bool_or(nx is null) ongoing, arg_min(coalesce(not was, false), session) known_start from g where fl group by inst, run", ("start", "stop"))
def j57(df):
    x = E.state_zones(P.with_momentum(df), F.col("mom") > 0, "mom", "close")
    return x.withColumns({c: r(c, 5) for c in ("low", "high", "mean", "price_change")})


@panel("j58_leave_one_year_out", f"{MOM}, {FWD}, y as (select unnest(range(1995, 2002)) excluded) select cast(excluded as int) excluded, count(fwd) n, round(avg(fwd) filter (mom > 0) - avg(fwd) filter (mom <= 0), 6) + 0.0 difference from fwd join y on year(session) <> excluded where mom is not null group by 1", ())
def j58(df):
    x = both(df).filter("mom is not null").withColumn("up", F.col("mom") > 0)
    return E.leave_one_year_out(x, "up", "fwd", range(1995, 2002)).withColumn("difference", r("difference"))


@panel("j55_split_entry_path", f"an as (select inst, seq, close from bars where seq % 26 = 0 and close is not null), j as (select an.inst, an.seq, an.close p0, b.seq q, b.close from an join bars b on b.inst = an.inst and b.seq between an.seq and an.seq + 20), g as (select inst, seq, any_value(p0) p0, max(close) filter (q = seq + 20) p1, max(close) filter (q = seq + 4) b4, max(close) filter (q = seq + 8) b8, arg_min(close, q) filter (q > seq and close > p0) pc from j group by 1, 2) select inst, seq, round(p1 / p0, 5) + 0.0 immediate, round((p1 / p0 + p1 / b4 + p1 / b8) / 3, 5) + 0.0 split, round(p1 / pc, 5) + 0.0 confirmed from g", ())
def j55(df):
    x = E.entry_paths(df, df.filter("seq % 26 = 0 and close is not null").select("inst", "seq"), 20, [0, 4, 8])
    return x.select("inst", "seq", *(r(c, 5).alias(c) for c in ("immediate", "split", "confirmed")))


@panel("j60_entry_event_study", f"{MOM}, {FWD}, f as (select inst, seq, session, fwd, mom > 0.1 up, lag(mom > 0.1) {_W} was from fwd), c as (select inst, seq from f where up and was = false), walk as (with recursive w(inst, seq) as (select inst, min(seq) from c group by inst union all select inst, nxt from (select w.inst, (select min(c.seq) from c where c.inst = w.inst and c.seq >= w.seq + 12) nxt from w) where nxt is not null) select * from w), s as (select w.inst, count(f.fwd) n, avg(f.fwd) mean, avg(case when f.fwd > 0 then 1.0::double when f.fwd is not null then 0.0::double end) win from walk w join f on f.inst = w.inst and f.seq = w.seq group by 1) select inst, n, round(mean, 5) + 0.0 mean, round(win, 5) + 0.0 win from s", ())
def j60(df):
    from ..operators.temporal import spaced

    x = both(df)
    anchors = spaced(crossings(x, F.col("mom") > 0.1).select("inst", "seq"), "inst", "seq", 12).withColumn("seq", F.col("seq").cast("int"))
    g = anchors.join(x.select("inst", "seq", "fwd"), ["inst", "seq"]).groupBy("inst")
    return g.agg(F.count("fwd").alias("n"), r(F.avg("fwd"), 5).alias("mean"), r(F.avg(F.when(F.col("fwd").isNotNull(), (F.col("fwd") > 0).cast("double"))), 5).alias("win"))


@panel("j61_local_high_flag", "w as (select a.inst, a.session, a.close, count(b.close) n, count(case when b.close < a.close then 1 end) + count(case when b.close = a.close then 1 end) / 2.0::double k from bars a left join bars b on a.inst = b.inst and b.seq between a.seq - 26 and a.seq - 1 group by a.inst, a.session, a.close) select inst, session, case when n = 26 and close is not null then k / n >= 0.8 end high from w")
def j61(df):
    return with_history_percentile(df, {"pct": "close"}, 26, 26, past=True).select("inst", "session", (F.col("pct") >= 0.8).alias("high"))


@panel("j62_feature_correlation_matrix", f"{_IC.split(', ic as (')[0]}, wr as (select inst, session, factor, rank() over (partition by factor order by val) + (count(*) over (partition by factor, val) - 1) / 2.0::double rk from fl where val is not null) select a.factor left_id, b.factor right_id, count(*) n, round(corr(a.rk, b.rk), 5) + 0.0 corr from wr a join wr b using (inst, session) where list_position(['mom', 'size', 'vol'], a.factor) < list_position(['mom', 'size', 'vol'], b.factor) group by 1, 2", ())
def j62(df):
    w = Window.partitionBy("factor")
    long = factor_long(df).select("inst", "session", "factor", (F.rank().over(w.orderBy("val")) + (F.count("*").over(Window.partitionBy("factor", "val")) - 1) / 2).alias("rk"))
    x = E.pair_correlations(long, ["inst", "session"], "factor", "rk", list(_FACTORS), "")
    return x.select("left_id", "right_id", "n", r("corr", 5).alias("corr"))


# ---- portfolios


@panel("j38_multi_factor_screen", f"{MOM}, b0 as (select * from mom where close is not null and volume > 20), p as (select *, case when mom is not null then case when count(mom) over (partition by session) <= 1 then 0.5::double else (rank() over (partition by session, mom is not null order by mom) + (count(*) over (partition by session, mom) - 1) / 2.0::double - 1) / (count(mom) over (partition by session) - 1) end end pm, case when count(volume) over (partition by session) <= 1 then 0.5::double else (rank() over (partition by session order by volume) + (count(*) over (partition by session, volume) - 1) / 2.0::double - 1) / (count(volume) over (partition by session) - 1) end pv from b0), s as (select * from p where pm <= 0.9 and pv >= 0.1), q as (select *, case when count(*) over w <= 1 then 0.5::double else (rank() over (partition by session order by mom) + (count(*) over (partition by session, mom) - 1) / 2.0::double - 1) / (count(*) over w - 1) end q1, case when count(*) over w <= 1 then 0.5::double else 1 - (rank() over (partition by session order by close) + (count(*) over (partition by session, close) - 1) / 2.0::double - 1) / (count(*) over w - 1) end q2 from s window w as (partition by session)), z as (select *, (2.0::double * q1 + q2) / 3.0::double score from q) select inst, session, round(score, 6) + 0.0 score, row_number() over (partition by session order by score desc, inst) rank from z")
def j38(df):
    x = E.screen(P.with_momentum(df), F.col("close").isNotNull() & (F.col("volume") > 20), {"mom": 0.1}, {"volume": 0.1}, {"mom": (2.0, True), "close": (1.0, False)})
    return x.select("inst", "session", r("score").alias("score"), F.col("rank").cast("long").alias("rank"))


@panel("j39_inverse_risk_weights", "u as (select inst, session, 1 / volume u from bars where volume > 0), k as (select *, row_number() over (partition by session order by u desc, inst) k, sum(u) over (partition by session) - coalesce(sum(u) over (partition by session order by u desc, inst rows between unbounded preceding and 1 preceding), 0) rest, count(*) over (partition by session) n from u), o as (select *, greatest(1 - (k - 1) * 0.15::double, 0) * u / rest >= 0.15::double ov from k), f as (select *, coalesce(min(case when not ov then k end) over (partition by session) - 1, n) fl from o) select inst, session, round(case when k <= fl then 0.15::double else greatest(1 - fl * 0.15::double, 0) * u / sum(case when k > fl then u end) over (partition by session) end, 6) + 0.0 weight from f")
def j39(df):
    return E.capped_inverse_weights(df, "volume", 0.15).select("inst", "session", r("weight").alias("weight"))


@panel("j42_benchmark_rebase", "n as (select count(distinct session) n from bars), f as (select inst, count(distinct session) h, arg_min(close, session) c0 from bars where close is not null group by 1) select b.inst, session, round(case when h = n then close / c0 - 1 end, 6) + 0.0 rebased from bars b left join f using (inst) cross join n")
def j42(df):
    return E.rebase(df.select("inst", "session", "close"), df.select("session"), "close").select("inst", "session", r("rebased").alias("rebased"))


@panel("j43_trailing_compound", f"{RET} select inst, session, case when count(ret) {_N.format(19)} = 20 then round(exp(sum(ln(1 + ret)) {_N.format(19)}) - 1, 5) + 0.0 end trail from ret")
def j43(df):
    from ..operators.exprs import rolling_full

    return with_return(df).select("inst", "session", r(F.exp(rolling_full(F.log1p("ret"), 20, "sum")) - 1, 5).alias("trail"))


@panel("j44_candidate_allocation", f"{MOM}, c as (select inst, session, mom from mom), w as (select *, row_number() over (partition by session order by mom desc nulls last, inst) = 1 best, count(*) over (partition by session) n, sum(greatest(mom, 0)) over (partition by session) tot from c) select inst, session, case when best then 1.0::double else 0.0::double end winner, round(case when best then 0.6::double / n + 0.4::double else 0.6::double / n end, 6) + 0.0 tilted, round(case when tot > 0 then coalesce(greatest(mom, 0), 0) / tot else 1.0::double / n end, 6) + 0.0 by_score from w")
def j44(df):
    x = E.allocations(P.with_momentum(df).select("inst", "session", "mom"), "mom", 0.4)
    return x.withColumns({"tilted": r("tilted"), "by_score": r("by_score")})


@panel("j44_blended_weights", f"{MOM}, h as (select session, inst, inst % 4 grp, row_number() over (partition by session, inst % 4 order by mom desc, inst) k from mom where mom is not null), hold as (select session, inst, grp, 1.0::double / count(*) over (partition by session, grp) wt from h where k <= 3), gs as (select session, inst % 4 grp, avg(mom) s from mom where mom is not null group by 1, 2), al as (select *, case when sum(greatest(s, 0)) over (partition by session) > 0 then greatest(s, 0) / sum(greatest(s, 0)) over (partition by session) else 1.0::double / count(*) over (partition by session) end a from gs) select session, inst, round(sum(wt * a), 6) + 0.0 weight from hold join al using (session, grp) group by 1, 2")
def j44_blend(df):
    x = P.with_momentum(df).filter("mom is not null").withColumn("grp", F.col("inst") % 4)
    k = F.row_number().over(by_session("grp").orderBy(F.desc("mom"), "inst"))
    hold = x.withColumn("k", k).filter("k <= 3").withColumn("wt", 1 / F.count("*").over(by_session("grp"))).select("session", "inst", "grp", "wt")
    scores = x.groupBy("session", F.col("grp").alias("inst")).agg(F.avg("mom").alias("s"))
    al = E.allocations(scores, "s", 0.0).select("session", F.col("inst").alias("grp"), "by_score")
    return hold.join(al, ["session", "grp"]).groupBy("session", "inst").agg(r(F.sum(F.col("wt") * F.col("by_score"))).alias("weight"))


#: A lead above 0.02, confirmed twice by one challenger, not before the fourth period of a book's choice.
SWITCH_RULE = Rule(0.02, 2, 4)


def book_scores(df, *more):
    """Five books, each of the four instruments that follow one another, scored by momentum."""
    x = P.with_momentum(df).filter("mom is not null").select(F.concat(F.lit("b"), F.floor(F.col("inst") / 4)).alias("book"), "seq", *more, F.concat(F.lit("g"), F.col("inst") % 4).alias("g"), "mom")
    return x.groupBy("book", "seq", *more).agg(F.map_from_entries(F.collect_list(F.struct("g", "mom"))).alias("scores"))


SWITCH_SQL = f"""{MOM}, bk as (select 'b' || cast(inst // 4 as varchar) book, seq, 'g' || cast(inst % 4 as varchar) g, mom from mom where mom is not null),
rk as (select *, row_number() over (partition by book, seq order by mom desc, g) k from bk),
ld as (select book, seq, max(g) filter (k = 1) leader, max(mom) filter (k = 1) - max(mom) filter (k = 2) lead from rk group by 1, 2 having count(*) >= 2),
od as (select *, row_number() over (partition by book order by seq) n from ld),
sw as (with recursive w(book, n, seq, leader, lead, held, rival, streak, age, switched, reason) as (
  select book, n, seq, leader, lead, leader, null::varchar, 0, 0, true, 'initial_selection' from od where n = 1
  union all
  select book, n, seq, leader, lead, case when reason = 'switch_confirmed' then leader else held end, case when reason = 'awaiting_confirmation' then leader end,
    case when reason = 'awaiting_confirmation' then run else 0 end, case when reason = 'switch_confirmed' then 0 else age end, reason = 'switch_confirmed', reason
  from (select *, case when leader = held then 'active_leads' when lead <= {SWITCH_RULE.margin} then 'below_threshold' when age < {SWITCH_RULE.hold} then 'minimum_hold' when run < {SWITCH_RULE.confirmations} then 'awaiting_confirmation' else 'switch_confirmed' end reason
    from (select od.*, w.held, w.age + 1 age, case when w.rival = od.leader then w.streak + 1 else 1 end run from w join od on od.book = w.book and od.n = w.n + 1)))
  select * from w)
select book, seq, leader, round(lead, 6) + 0.0 lead, held, switched, reason from sw"""


@panel("j45_hysteresis_switch", SWITCH_SQL, ())
def j45(df):
    return switches(book_scores(df), SWITCH_RULE).withColumn("lead", r("lead"))


def market_state(df):
    m = P.market_return(df).select("session", "market").join(df.select("session", "seq").distinct(), "session")
    w = Window.partitionBy(F.lit(0)).orderBy("seq")
    m = m.withColumn("idx", F.exp(F.sum(F.coalesce(F.log1p("market"), F.lit(0.0))).over(w.rowsBetween(Window.unboundedPreceding, 0))))
    b = with_return(df).groupBy("session").agg(F.avg((F.col("ret") > 0).cast("double")).alias("breadth"))
    n = F.count("idx").over(w.rowsBetween(-25, 0))
    gap = F.when(n == 26, F.col("idx") / F.avg("idx").over(w.rowsBetween(-25, 0)) - 1)
    dd = F.col("idx") / F.max("idx").over(w.rowsBetween(-51, 0)) - 1
    return m.withColumns({"gap": gap, "drawdown": dd}).join(b, "session").withColumn("book", F.lit("a")).withColumn("raw", E.raw_regime("gap", "breadth", "drawdown"))


_STATE_SQL = f"""{RET}, mk as (select session, any_value(seq) seq, avg(ret) market, avg(case when ret > 0 then 1.0::double when ret is not null then 0.0::double end) breadth from ret group by session),
ix as (select *, exp(sum(coalesce(case when market > -1 then ln(1 + market) end, 0)) over (order by seq)) idx from mk),
gp as (select *, case when count(idx) over (order by seq rows between 25 preceding and current row) = 26 then idx / avg(idx) over (order by seq rows between 25 preceding and current row) - 1 end gap, idx / max(idx) over (order by seq rows between 51 preceding and current row) - 1 drawdown from ix),
rw as materialized (select seq, row_number() over (order by seq) n, case when gap is null or breadth is null or drawdown is null then null when gap > 0 and breadth >= 0.5 and drawdown > -0.1 then 'strong' when gap < 0 and (breadth < 0.4 or drawdown <= -0.2) then 'weak' else 'base' end raw from gp),
rg as (with recursive w(n, seq, regime, wanted, run) as (
  select 0::bigint, 0, 'base', null::varchar, 0
  union all
  select n, seq, case when move then raw else regime end, case when wants and not move then raw end, case when move or not wants then 0 else again end
  from (select *, wants and again >= case when list_position(['weak', 'base', 'strong'], raw) < list_position(['weak', 'base', 'strong'], regime) then 2 else 3 end move
    from (select rw.n, rw.seq, rw.raw, w.regime, coalesce(rw.raw <> w.regime, false) wants, case when rw.raw = w.wanted then w.run + 1 else 1 end again from w join rw on rw.n = w.n + 1)))
  select * from w where n > 0)
select 'a' book, seq, regime, case regime when 'weak' then 0.3::double when 'base' then 0.7::double else 1.0::double end exposure from rg"""


@panel("j46_regime_exposure", _STATE_SQL, ())
def j46(df):
    return confirmed_regime(market_state(df).select("book", "seq", "raw"), "book", "raw", 2, 3)


# ---- learning


@panel("j48_ml_feature_panel", f"{RET}, pc as (select a.inst, a.session, case when a.volume is not null and count(b.volume) >= 26 then (count(case when b.volume < a.volume then 1 end) + count(case when b.volume = a.volume then 1 end) / 2.0::double) / count(b.volume) end pct from bars a join bars b on a.inst = b.inst and b.seq between a.seq - 51 and a.seq group by a.inst, a.session, a.volume), x as (select inst, session, volume - lag(volume, 52) {_W} ch, close / nullif(lag(close, 13) {_W}, 0) - 1 r13, close / nullif(lag(close, 26) {_W}, 0) - 1 r26, stddev_samp(ret) {_N.format(12)} v13, close / max(close) {_N.format(25)} - 1 d26 from ret) select x.inst, x.session, round(ch, 3) + 0.0 volume_change, round(pct, 6) + 0.0 volume_pct, round(r13, 5) + 0.0 ret13, round(r26, 5) + 0.0 ret26, round(v13, 5) + 0.0 vol13, round(d26, 5) + 0.0 dd26, round(r13 - avg(r13) over (partition by x.session), 5) + 0.0 rel13 from x join pc using (inst, session)")
def j48(df):
    x = E.feature_panel(df, ["volume"], 52, 26)
    return x.select("inst", "session", r("volume_change", 3).alias("volume_change"), r("volume_pct").alias("volume_pct"), *(r(c, 5).alias(c) for c in ("ret13", "ret26", "vol13", "dd26", "rel13")))


_FEATURES = ["ret13", "ret26", "vol13", "dd26", "rel13"]


def learning_panel(df):
    w = by_instrument()
    return P.with_forward_return(E.feature_panel(df, [], 52, 26)).withColumn("label_end", F.lead("session", 6).over(w))


def refits(spark):
    days = ["1998-01-05", "1998-07-06", "1999-01-04", "1999-07-05", "2000-01-03", "2000-07-03", "2001-01-01"]
    d = spark.createDataFrame(list(zip(days, days[1:])), "refit string, next_refit string")
    return d.withColumns({c: F.col(c).cast("date") for c in d.columns})


def ridge_predictions(df):
    return E.walk_forward_ridge(learning_panel(df), _FEATURES, "fwd", "label_end", refits(df.sparkSession))


@panel("j49_walk_forward_ridge", "", ("session", "refit"))
def j49(df):
    return ridge_predictions(df).select("inst", "session", "refit", r("prediction", 5).alias("prediction"))


@panel("j50_walk_forward_gbt", "", ("session", "refit"))
def j50(df):
    x = E.walk_forward_trees(learning_panel(df), _FEATURES, "fwd", "label_end", refits(df.sparkSession))
    return x.select("inst", "session", "refit", r("prediction", 5).alias("prediction"))


@panel("j50_importance_by_refit", "", ("refit",))
def j50_importance(df):
    x = E.walk_forward_trees(learning_panel(df), _FEATURES, "fwd", "label_end", refits(df.sparkSession))
    rows = x.groupBy("refit").agg(F.count("*").alias("n"), F.first("importance").alias("importance"))
    return rows.select("refit", "n", F.explode("importance").alias("feature", "gain")).withColumn("gain", r("gain", 5))


@panel("j51_prediction_diagnostics", "", ("session",))
def j51(df):
    x = ridge_predictions(df).filter("prediction is not null and fwd is not null")
    ic = P.rank_ic(x, "prediction", "fwd", 5)
    top = R.quantile_spread(x, "prediction", "fwd", 3).select("session", "spread")
    lead = x.withColumn("k", F.row_number().over(by_session().orderBy(F.desc("prediction"), "inst"))).groupBy("session").agg((F.avg(F.when(F.col("k") <= 3, F.col("fwd"))) - F.avg("fwd")).alias("relative"))
    return ic.join(top, "session").join(lead, "session").select("session", "n_pairs", r("rank_ic", 5).alias("rank_ic"), r("spread", 5).alias("spread"), r("relative", 5).alias("relative"))


_NEST = f"{MOM}, {FWD}, cf as (select unnest([1, 2, 3, 5]) k), fd as (select session, cast(year(session) as int) fold, k, avg(fwd) filter (rn <= k) - avg(fwd) delta from (select session, fwd, row_number() over (partition by session order by mom desc, inst) rn from fwd where mom is not null and fwd is not null) cross join cf group by 1, 2, 3), a as (select 'top' || k config, avg(delta) mean, stddev_pop(delta) sd from fd group by 1), b as (select 'top' || k config, count(*) filter (m > 0) pf from (select k, fold, avg(delta) m from fd group by 1, 2) group by 1), c as (select config, mean, sd, mean - 0.25::double * sd score, pf from a join b using (config))"


@panel("j52_nested_selection", f"{_NEST} select config, round(mean, 6) + 0.0 mean, round(score, 6) + 0.0 score, pf positive_folds, score >= 0.002 and pf >= 2 accepted, row_number() over (order by score desc, config) place from c", ())
def j52(df):
    x = both(df).filter("mom is not null and fwd is not null").withColumn("rn", F.row_number().over(by_session().orderBy(F.desc("mom"), "inst")))
    x = x.withColumn("k", F.explode(F.array(*map(F.lit, (1, 2, 3, 5)))))
    d = x.groupBy("session", F.year("session").alias("fold"), "k").agg((F.avg(F.when(F.col("rn") <= F.col("k"), F.col("fwd"))) - F.avg("fwd")).alias("delta"))
    y = E.nested_selection(d.withColumn("config", F.concat(F.lit("top"), F.col("k"))), "config", "delta")
    return y.select("config", r("mean").alias("mean"), r("score").alias("score"), "positive_folds", "accepted", F.col("place").cast("long").alias("place"))


_CARD = f"{_HYP}, allh as (select key, mean, q from hq union all select key, mean, null from hp where p is null), ct as (select split_part(key, ':', 2) factor, count(*) filter (q <= 0.5 and mean > 0) supported, count(*) filter (q <= 0.5 and mean <= 0) contradicted, round(avg(mean), 6) + 0.0 mean from allh group by 1), cv as (select factor, round(count(val) / count(*)::double, 6) + 0.0 coverage from fl group by 1)"
_ROUTE = "concat_ws(',', case when supported >= 2 and contradicted = 0 then 'stable_direction' end, case when contradicted > 0 then 'direction_conflict' end, case when factor <> 'vol' then 'tradable' end, case when supported = 0 then 'no_support' end)"


def evidence_counts(df):
    h = hypotheses(df).withColumn("factor", F.split("key", ":")[1])
    strong = F.col("q") <= 0.5
    return h.groupBy("factor").agg(F.count(F.when(strong & (F.col("mean") > 0), 1)).alias("supported"), F.count(F.when(strong & (F.col("mean") <= 0), 1)).alias("contradicted"), r(F.avg("mean")).alias("mean"))


@panel("j53_evidence_routes", f"{_CARD} select factor, {_ROUTE} routes from ct", ())
def j53(df):
    x = E.routes(F.lit(True), "supported", "contradicted", F.lit(False), F.col("factor") != "vol")
    return evidence_counts(df).select("factor", F.concat_ws(",", x).alias("routes"))


@panel("j3_size_neutralize_z", f"{MOM}, v as (select inst, session, mom y, ln(amount) x from mom where mom is not null and amount > 0), e as (select inst, session, case when var_pop(x) over w > 1e-12 then y - avg(y) over w - covar_pop(y, x) over w / var_pop(x) over w * (x - avg(x) over w) end e from v window w as (partition by session)) select inst, session, round(case when count(e) over w >= 10 and stddev_pop(e) over w > 1e-12 then (e - avg(e) over w) / stddev_pop(e) over w end, 4) + 0.0 z from e window w as (partition by session)")
def j3(df):
    from ..operators.exprs import zscore

    x = P.with_momentum(df).filter("mom is not null and amount > 0").withColumn("e", R.session_residual("mom", safe_log("amount")))
    return x.select("inst", "session", r(zscore("e"), 4).alias("z"))


@panel("j4_industry_neutralize_z", f"{MOM}, v as (select inst, session, mom - avg(mom) over (partition by session, inst % 4) y, ln(amount) - avg(ln(amount)) over (partition by session, inst % 4) x from mom where mom is not null and amount > 0), e as (select inst, session, case when sum(x * x) over w > 1e-12 then y - x * sum(x * y) over w / sum(x * x) over w end e from v window w as (partition by session)) select inst, session, round(case when count(e) over w >= 10 and stddev_pop(e) over w > 1e-12 then (e - avg(e) over w) / stddev_pop(e) over w end, 4) + 0.0 z from e window w as (partition by session)")
def j4(df):
    from ..operators.exprs import zscore

    x = P.with_momentum(df).filter("mom is not null and amount > 0").withColumn("size", safe_log("amount")).withColumn("sector", F.col("inst") % 4)
    y = R.industry_size_residual(x, "mom", "size", "sector")
    return y.select("inst", "session", r(zscore("residual"), 4).alias("z"))


@panel("j41_performance_periods", f"{RET}, p as (select inst, cast(year(session) as bigint) y, cast(quarter(session) as bigint) q, case when min(ret) <= -1 then -1 else exp(sum(case when ret > -1 then ln(1 + ret) end)) - 1 end total, count(ret) n from ret where ret is not null group by grouping sets ((1, 2), (1, 2, 3))) select inst, y, coalesce(q, 0) q, n, round(total, 5) + 0.0 total from p", ())
def j41(df):
    x = R.period_returns(with_return(df), "inst", "ret")
    return x.select("inst", "y", "q", "n", r("total", 5).alias("total"))


for _name in ("j26_cluster_threshold_cut", "j49_walk_forward_ridge", "j50_walk_forward_gbt", "j50_importance_by_refit", "j51_prediction_diagnostics"):
    ORACLES.pop(_name)  # no SQL form: tested by hand and brute force
__all__ = ["rounded"]
