"""Queries of bootstraps, two-sided inference, partial correlations and regressions, with their SQL."""
from __future__ import annotations

from itertools import combinations_with_replacement

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import evidence as E
from ..operators import panel as P
from ..operators import regression as X
from ..operators import resampling as B
from ..operators import studies as D
from ..operators.exprs import average_rank, by_instrument, safe_div
from ..operators.windows import with_return
from .base import FWD, MOM, RET, panel, r
from .evidence_queries import _CARD, _DUP, _FACTORS, _HYP, _nw_sql, _p_sql, both, directed_ic, duplicate_groups, evidence_counts, factor_panel, hypotheses

#: Hypotheses are rejected at this rate of false discoveries.
ALPHA = 0.1


def _draw_sql(blocks: int, resamples: int, source: str) -> str:
    """From (e, n, ...): the start s and size sz of each block k of each resample b."""
    x = [f"(('0x' || substr(md5(cast(e as varchar)), 1, 8))::bigint + b * {B.STEP_RESAMPLE} + k * {B.STEP_BLOCK}) & {B.MASK} x0"]
    x += [f"(xor(x{i} >> 16, x{i}) * {B.MIXER}) & {B.MASK} x{i + 1}" for i in range(2)]
    return f"select *, {', '.join(x)}, xor(x2 >> 16, x2) % n s, least({blocks}, n - k * {blocks}) sz from {source}, (select unnest(range({resamples}::bigint)) b), (select unnest(range((select coalesce(max(ceil(n / {blocks}.0)), 0)::bigint from {source}))) k) where k * {blocks} < n"


def _totals_sql(name: str, rows: str, channels: list[str], block: int, resamples: int) -> str:
    """CTEs that end in {name}_t(e, b, n, *channels) over the rows (e, i, *channels), i from 1 without gaps."""
    cols, sums = ", ".join(channels), ", ".join(f"sum({c}) over (partition by e order by i) {c}" for c in channels)
    diff = ", ".join(f"sum(q.{c} - p.{c}) {c}" for c in channels)
    return f"""{name}_n as (select e, count(*) n from {rows} group by e),
{name}_w as (select e, i, {cols} from {rows} union all select x.e, x.i + n, {cols} from {rows} x join {name}_n using (e) where x.i <= {block}),
{name}_p as materialized (select e, i, {sums} from {name}_w union all select e, 0, {', '.join('0::double' for _ in channels)} from {name}_n),
{name}_d as ({_draw_sql(block, resamples, f"{name}_n")}),
{name}_t as (select d.e, d.b, any_value(d.n) n, {diff} from {name}_d d join {name}_p p on p.e = d.e and p.i = d.s join {name}_p q on q.e = d.e and q.i = d.s + d.sz group by d.e, d.b)"""


def _boot_sql(name: str, source: str, entity: str, x: str, order: str, block: int, resamples: int) -> str:
    """CTEs that end in {name}(e, n, mean, p, lower, upper)."""
    return f"""{name}_s as (select {entity} e, row_number() over (partition by {entity} order by {order}) i, {x}::double v from {source} where {x} is not null),
{_totals_sql(name, f"{name}_s", ["v"], block, resamples)},
{name}_m as (select e, avg(v) mean from {name}_s group by e),
{name} as (select e, any_value(n) n, any_value(mean) mean, (count(*) filter (abs(v / n - mean) >= abs(mean) * (1 - 1e-9::double)) + 1) / (count(*) + 1.0::double) p,
  quantile_cont(v / n, 0.025) lower, quantile_cont(v / n, 0.975) upper from {name}_t join {name}_m using (e) group by e)"""


def _bh_sql(name: str, source: str, p: str, key: str) -> str:
    """CTEs that end in {name}(key, q) over the rows with a p."""
    return f"""{name}_r as (select {key}, {p} p, row_number() over (order by {p}) rn, count(*) over () m from {source} where {p} is not null),
{name} as (select {key}, least(1.0::double, min(p * m / rn) over (order by rn rows between current row and unbounded following)) q from {name}_r)"""


@panel("j15_moving_block_bootstrap", f"{RET}, {_boot_sql('bt', 'ret', 'inst', 'ret', 'session', 5, B.RESAMPLES)} select e inst, n, round(mean, 6) + 0.0 mean, round(p, 6) + 0.0 p, round(lower, 5) + 0.0 lower, round(upper, 5) + 0.0 upper from bt", ())
def j15(df):
    x = B.block_bootstrap(with_return(df), "inst", "ret", "session", 5)
    return x.select("inst", "n", r("mean").alias("mean"), r("p").alias("p"), r("lower", 5).alias("lower"), r("upper", 5).alias("upper"))


# ---- hypotheses of the walk-forward folds, by both tests

_TESTS = f"""{_HYP}, {_boot_sql('bt', 'dd', 'key', 'directed', 'session', 5, B.RESAMPLES)}, {_bh_sql('bq', 'bt', 'p', 'e')},
ts as (select hp.key, hp.n, hp.mean, hp.t, hp.p hac_p, hq.q hac_q, bt.p bootstrap_p, bq.q bootstrap_q, bt.lower, bt.upper from hp join bt on bt.e = hp.key left join hq on hq.key = hp.key left join bq on bq.e = hp.key)"""
_FIGURES = {"mean": 6, "t": 4, "hac_p": 5, "hac_q": 5, "bootstrap_p": 6, "bootstrap_q": 5, "lower": 5, "upper": 5}


@panel("j22_walk_forward_hypotheses", f"{_TESTS} select key, n, {', '.join(f'round({c}, {k}) + 0.0 {c}' for c, k in _FIGURES.items())} from ts", ())
def j22(df):
    x = E.mean_inference(directed_ic(df), "key", "directed", "session", 3, 5, B.RESAMPLES, ALPHA)
    return x.select("key", "n", *(r(c, k).alias(c) for c, k in _FIGURES.items()))


_DECIDE = "case when not coalesce({0}_q <= 0.1, false) then 'not_rejected' when mean > 0 then 'direction_supported' else 'direction_contradicted' end {0}_decision"


@panel("j56_fold_decisions", f"{_TESTS} select key, {_DECIDE.format('hac')}, {_DECIDE.format('bootstrap')} from ts", ())
def j56(df):
    x = E.mean_inference(directed_ic(df), "key", "directed", "session", 3, 5, B.RESAMPLES, ALPHA)
    return x.select("key", *(E.decision(f"{k}_reject", "mean").alias(f"{k}_decision") for k in ("hac", "bootstrap")))


# ---- partial correlations and what a factor adds to the others

_RANKS = f"{MOM}, {FWD}, rw as (select session, inst, " + ", ".join(f"rank() over (partition by session order by {c}) + (count(*) over (partition by session, {c}) - 1) / 2.0::double {n}" for n, c in {"mom": "mom", "size": "ln(amount)", "vol": "volume", "fwd": "fwd"}.items()) + " from fwd where mom is not null and amount > 0 and volume is not null and fwd is not null)"


def rank_wide(df):
    x = factor_panel(df).filter("mom is not null and size is not null and vol is not null and fwd is not null")
    return x.select("session", "inst", *(average_rank(c).alias(c) for c in ("mom", "size", "vol", "fwd")))


def _conditional_sql(name: str, candidate: str, label: str, a: str, b: str) -> str:
    """CTEs that end in {name} for two controls a and b: the inverse of their 2 x 2 matrix is written out."""
    c = {f"{x}_{y}": f"corr({x}, {y})" for x, y in combinations_with_replacement((a, b, candidate, label), 2) if x != y}
    fit = lambda u, v: f"(({u[0]} * {v[0]} + {u[1]} * {v[1]}) * (1 + 1e-8::double) - {a}_{b} * ({u[0]} * {v[1]} + {u[1]} * {v[0]})) / ((1 + 1e-8::double) * (1 + 1e-8::double) - {a}_{b} * {a}_{b})"
    x, y = ((f"{a}_{z}", f"{b}_{z}") for z in (candidate, label))
    clip = lambda e, lo: f"greatest({lo}::double, least(1::double, {e}))"
    spread = ", ".join(f"var_pop({v})" for v in (a, b, candidate, label))
    return f"""{name}_c as (select session, count(*) n, {', '.join(f'{e} {k}' for k, e in c.items())} from rw group by session having count(*) >= 10 and least({spread}) > 1e-24),
{name}_f as (select session, n, {candidate}_{label} raw, greatest(1e-8::double, 1 - {fit(x, x)}) va, greatest(1e-8::double, 1 - {fit(y, y)}) vb, {fit(y, y)} explained, {candidate}_{label} - {fit(x, y)} cov from {name}_c),
{name}_g as (select *, {clip('explained', 0)} baseline_r2 from {name}_f),
{name} as (select session, n, raw, {clip('cov / sqrt(va)', -1)} semi_partial, {clip('cov / sqrt(va * vb)', -1)} partial, baseline_r2, {clip('baseline_r2 + cov * cov / va', 0)} full_r2 from {name}_g)"""


@panel("j27_conditional_rank_ic", f"{_RANKS}, {_conditional_sql('ci', 'mom', 'fwd', 'size', 'vol')} select session, n, {', '.join(f'round({c}, 5) + 0.0 {c}' for c in ('raw', 'semi_partial', 'partial', 'baseline_r2', 'full_r2'))}, round(full_r2 - baseline_r2, 5) + 0.0 incremental_r2 from ci")
def j27(df):
    x = X.conditional_rank_ic(rank_wide(df), "mom", "fwd", ["size", "vol"])
    return x.select("session", "n", *(r(c, 5).alias(c) for c in ("raw", "semi_partial", "partial", "baseline_r2", "full_r2", "incremental_r2")))


#: Declared directions; a factor without one is tested and reported as undirected.
_DECLARED = {"mom": "POSITIVE", "size": "NEGATIVE", "vol": None}
_OTHERS = {"mom": ("size", "vol"), "size": ("mom", "vol"), "vol": ("mom", "size")}
_DIRECTED = ", ".join(_conditional_sql(f"c{k}", k, "fwd", *o) for k, o in _OTHERS.items()) + ", di as (" + " union all ".join(f"select '{k}' factor, session, {'-' if _DECLARED[k] == 'NEGATIVE' else ''}semi_partial directed, full_r2 - baseline_r2 gain from c{k}" for k in _OTHERS) + ")"


def increments(df):
    """Tests of what each factor adds to the ranks that the others explain, in its declared direction."""
    wide, rows = rank_wide(df), None
    for k, others in _OTHERS.items():
        sign = -1 if _DECLARED[k] == "NEGATIVE" else 1
        x = X.conditional_rank_ic(wide, k, "fwd", others).select(F.lit(k).alias("factor"), "session", (F.col("semi_partial") * sign).alias("directed"), F.col("incremental_r2").alias("gain"))
        rows = x if rows is None else rows.unionByName(x)
    rows = E.written(rows)
    gain = rows.groupBy("factor").agg(F.avg("gain").alias("mean_gain"), F.median("gain").alias("median_gain"))
    tests = E.mean_inference(rows, "factor", "directed", "session", 3, 5, B.RESAMPLES, ALPHA).join(gain, "factor")
    declared = F.when(F.col("factor") == "mom", "POSITIVE").when(F.col("factor") == "size", "NEGATIVE")
    return E.incremental_outcome(tests.withColumn("declared", declared))


_INCREMENT = f"""{_RANKS}, {_DIRECTED}, {_nw_sql('di', 'factor', 'directed', 'session', 3, 'nw')}, np as (select *, {_p_sql('t')} p from nw), {_bh_sql('hb', 'np', 'p', 'factor')},
{_boot_sql('bt', 'di', 'factor', 'directed', 'session', 5, B.RESAMPLES)}, {_bh_sql('bq', 'bt', 'p', 'e')}, ga as (select factor, avg(gain) mean_gain, median(gain) median_gain from di group by 1),
ix as (select np.factor, np.n, np.mean, hb.q hac_q, bt.p bootstrap_p, bq.q bootstrap_q, mean_gain, median_gain,
  case when np.factor = 'vol' then 'undirected' when not coalesce(hb.q <= 0.1 and bq.q <= 0.1, false) then 'no_increment' when np.mean > 0 then 'supported' else 'contradicted' end outcome
  from np join bt on bt.e = np.factor join ga using (factor) left join hb using (factor) left join bq on bq.e = np.factor)"""
_GAINS = {"mean": 6, "hac_q": 5, "bootstrap_p": 6, "bootstrap_q": 5, "mean_gain": 5, "median_gain": 5}


@panel("j28_incremental_outcome", f"{_INCREMENT} select factor, n, {', '.join(f'round({c}, {k}) + 0.0 {c}' for c, k in _GAINS.items())}, outcome from ix", ())
def j28(df):
    return increments(df).select("factor", "n", *(r(c, k).alias(c) for c, k in _GAINS.items()), "outcome")


# ---- regressions and contrasts of series

_LAGS = 5
_NEAR = " + ".join(f"{1 - k / (_LAGS + 1)}::double * coalesce(lag(score, {k}) over (partition by inst order by session), 0)" for k in range(1, _LAGS + 1))


@panel("j29_hac_regression", f"""{MOM}, {FWD}, h as (select inst, session, year(session) yr, case when mom is not null and fwd is not null then mom end x, case when mom is not null and fwd is not null then fwd end y from fwd),
u as (select *, x - avg(x) over (partition by inst, yr) u, y - avg(y) over (partition by inst, yr) v from h),
o as (select *, sum(u * u) over (partition by inst) uu, sum(u * v) over (partition by inst) / sum(u * u) over (partition by inst) beta from u),
s as (select *, coalesce(u * (v - beta * u), 0) score from o), l as (select *, score * (score + 2 * ({_NEAR})) meat from s),
g as (select inst, count(x) n, count(distinct yr) filter (x is not null) ny, any_value(beta) beta, sum(meat) meat, any_value(uu) uu from l group by inst),
e as (select inst, n, case when n >= 80 then beta end beta, case when n >= 80 then sqrt(greatest(meat, 0) * n / (n - ny - 1)) / uu end se, case when n < 80 then 'insufficient' else 'estimated' end status from g)
select inst, n, round(beta, 5) + 0.0 beta, round(se, 5) + 0.0 se, round(beta / se, 4) + 0.0 t, round({_p_sql('(beta / se)')}, 5) + 0.0 p, round(beta - 1.96 * se, 5) + 0.0 lower, round(beta + 1.96 * se, 5) + 0.0 upper, status from e""", ())
def j29(df):
    x = X.hac_regression(both(df).select("inst", "session", "mom", "fwd"), "inst", "fwd", "mom", "session", _LAGS)
    return x.select("inst", "n", *(r(c, k).alias(c) for c, k in {"beta": 5, "se": 5, "t": 4, "p": 5, "lower": 5, "upper": 5}.items()), "status")


@panel("j30_bootstrap_contrast", f"""{MOM}, {FWD}, a0 as (select inst e, row_number() over (partition by inst order by session) i, case when fwd is not null and mom > 0 then 1.0::double else 0 end tn, case when fwd is not null and mom > 0 then fwd else 0 end ts,
  case when fwd is not null and mom <= 0 then 1.0::double else 0 end cn, case when fwd is not null and mom <= 0 then fwd else 0 end cs from fwd),
ob as (select e, sum(ts) / sum(tn) - sum(cs) / sum(cn) observed from a0 group by e having least(sum(tn), sum(cn)) >= 30),
a1 as (select * from a0 where e in (select e from ob)), {_totals_sql('bt', 'a1', ['tn', 'ts', 'cn', 'cs'], 13, 1999)},
dr as (select e, ts / tn - cs / cn d from bt_t where least(tn, cn) >= 5), gr as (select e, count(*) draws, quantile_cont(d, 0.025) lo, quantile_cont(d, 0.975) hi from dr group by e)
select i.e inst, round(case when draws >= 1799.1 then observed end, 5) + 0.0 observed, coalesce(draws, 0) draws, round(case when draws >= 1799.1 then lo end, 5) + 0.0 lower, round(case when draws >= 1799.1 then hi end, 5) + 0.0 upper from (select distinct e from a0) i left join ob using (e) left join gr using (e)""", ())
def j30(df):
    x = both(df).withColumns({"t": F.col("mom") > 0, "c": F.col("mom") <= 0})
    x = B.bootstrap_contrast(x, "inst", "fwd", "t", "c", "session", 13)
    return x.select("inst", r("observed", 5).alias("observed"), "draws", r("lower", 5).alias("lower"), r("upper", 5).alias("upper"))


# ---- a study of market signals over horizons and targets

_HORIZONS = (5, 13)
_HALF = "1998-06-01"


def market_series(df):
    """One row a session: an index of the market, two signals of it and, for each horizon, the path from the next session on."""
    log = F.when(F.col("ret") > -1, F.log1p("ret"))
    m = with_return(df).groupBy("session").agg(F.first("seq").alias("seq"), F.avg(log).alias("market"), F.avg(F.when(F.col("ret").isNotNull(), (F.col("ret") > 0).cast("double"))).alias("breadth"))
    w = Window.partitionBy(F.lit(0)).orderBy("seq")  # one row a session
    m = m.withColumn("level", F.exp(F.sum(F.coalesce("market", F.lit(0.0))).over(w.rowsBetween(Window.unboundedPreceding, 0))))
    return m.withColumn("trend", safe_div("level", F.lag("level", 8).over(w)) - 1)


def market_outcomes(m):
    w = Window.partitionBy(F.lit(0)).orderBy("seq")
    rows = None
    for h in _HORIZONS:
        start, path = F.lead("level", 1).over(w), w.rowsBetween(1, h + 1)
        whole = F.lead("level", h + 1).over(w).isNotNull()
        x = m.select("session", F.lit(h).alias("horizon"), (F.lead("level", h + 1).over(w) / start - 1).alias("gain"), F.when(whole, F.min("level").over(path) / start - 1).alias("low"), F.lead("session", h + 1).over(w).alias("leaves"))
        rows = x if rows is None else rows.unionByName(x)
    return rows


_MARKET = f"""{RET}, mk as (select session, any_value(seq) seq, avg(case when ret > -1 then ln(1 + ret) end) market, avg(case when ret > 0 then 1.0::double when ret is not null then 0.0::double end) breadth from ret group by session),
lv as (select *, exp(sum(coalesce(market, 0)) over (order by seq)) as lev from mk),
sg as (select *, lev / lag(lev, 8) over (order by seq) - 1 trend from lv),
oc as ({' union all '.join(f"select session, {h} horizon, lead(lev, {h + 1}) over o / lead(lev, 1) over o - 1 gain, case when lead(lev, {h + 1}) over o is not null then min(lev) over (order by seq rows between 1 following and {h + 1} following) / lead(lev, 1) over o - 1 end low, lead(session, {h + 1}) over o leaves from lv window o as (order by seq)" for h in _HORIZONS)}),
st as (select signal, horizon, target, session, x, y from (select session, 'trend' signal, trend x from sg union all select session, 'breadth', breadth from sg) join (select session, horizon, 'gain' target, gain y from oc union all select session, horizon, 'low', low from oc) using (session))"""


def _study_sql() -> str:
    """CTEs that end in tests(signal, horizon, target, n, beta, se, t, p, status, spearman)."""
    k = "signal, horizon, target"
    near = " + ".join(f"(case when {j} <= horizon + 20 then 1 - {j} / (horizon + 21.0::double) else 0 end) * coalesce(lag(score, {j}) over (partition by {k} order by session), 0)" for j in range(1, max(_HORIZONS) + 21))
    return f"""ha as (select {k}, session, year(session) yr, case when x is not null and y is not null then x end x, case when x is not null and y is not null then y end y from st),
hb as (select *, x - avg(x) over (partition by {k}, yr) u, y - avg(y) over (partition by {k}, yr) v from ha),
hc as (select *, sum(u * u) over (partition by {k}) uu, sum(u * v) over (partition by {k}) / sum(u * u) over (partition by {k}) beta from hb),
hd as (select *, coalesce(u * (v - beta * u), 0) score from hc), he as (select *, score * (score + 2 * ({near})) meat from hd),
hf as (select {k}, count(x) n, count(distinct yr) filter (x is not null) ny, any_value(beta) b, sum(meat) meat, any_value(uu) uu from he group by {k}),
hg as (select {k}, n, case when n >= 80 then b end beta, case when n >= 80 then sqrt(greatest(meat, 0) * n / (n - ny - 1)) / uu end se, case when n < 80 then 'insufficient' else 'estimated' end status from hf),
sr as (select {k}, rank() over (partition by {k} order by x) + (count(*) over (partition by {k}, x) - 1) / 2.0::double rx, rank() over (partition by {k} order by y) + (count(*) over (partition by {k}, y) - 1) / 2.0::double ry from st where x is not null and y is not null),
sp as (select {k}, corr(rx, ry) spearman from sr group by {k}),
tests as (select hg.*, beta / se t, {_p_sql('(beta / se)')} p, spearman from hg left join sp using ({k}))"""


def _holm_sql(name: str, source: str, order: str) -> str:
    """CTEs that end in {name}: source with `adjusted`; a missing p counts as 1."""
    return f"{name}_r as (select *, coalesce(p, 1) pp, row_number() over (order by coalesce(p, 1), {order}) rn, count(*) over () m from {source}), {name} as (select * exclude (pp, rn, m), least(1.0::double, max(pp * (m - rn + 1)) over (order by rn)) adjusted from {name}_r)"


_TEST_FIGURES = {"beta": 5, "se": 5, "t": 4, "p": 5, "spearman": 5, "local_p": 4, "joint_p": 4}


@panel("j32_signal_tests", f"""{_MARKET}, {_study_sql()}, pr as (select * from (with {_HYP} select p from hp)),
fm as (select signal, horizon, target, p from tests union all select null, null, null, p from pr), {_holm_sql('jo', 'fm', 'signal, horizon, target')}, {_holm_sql('lo', 'tests', 'signal, horizon, target')}
select lo.signal, lo.horizon, lo.target, n, {', '.join(f'round({c}, {d}) + 0.0 {c}' for c, d in list(_TEST_FIGURES.items())[:5])}, round(lo.adjusted, 4) + 0.0 local_p, round(jo.adjusted, 4) + 0.0 joint_p, status from (select * exclude (p), p from lo) lo join jo using (signal, horizon, target)""".replace("select lo.signal, lo.horizon, lo.target, n, ", "select signal, horizon, target, n, ").replace("round(p, 5) + 0.0 p", "round(lo.p, 5) + 0.0 p"), ())
def j32_tests(df):
    m = E.written(market_series(df))
    study = D.long_study(m, ["trend", "breadth"], market_outcomes(m), ["gain", "low"])
    x = D.study_tests(study, _HORIZONS, prior=hypotheses(df).select("p"))
    return x.select("signal", "horizon", "target", "n", *(r(c, d).alias(c) for c, d in _TEST_FIGURES.items()), "status")


_BUCKETS = {"mean": 5, "median": 5, "win": 5, "worst": 5}


@panel("j32_contained_buckets", f"""{_MARKET}, rw as (select *, session < date '{_HALF}' early from st join (select session, horizon, leaves from oc) using (session, horizon) where target = 'gain'),
ct as (select signal, horizon, list_distinct(quantile_cont(x, [0.2, 0.4, 0.6, 0.8])) c from rw where early group by 1, 2),
bk as (select signal, horizon, case when early then 1 else 2 end half, 1 + len(list_filter(c, lambda q: q <= x)) bucket, y from rw join ct using (signal, horizon) where x is not null and y is not null and year(leaves) <= year(session))
select signal, horizon, half, cast(bucket as int) bucket, count(*) n, round(avg(y), 5) + 0.0 mean, round(median(y), 5) + 0.0 median, round(avg(case when y > 0 then 1.0::double else 0.0::double end), 5) + 0.0 win, round(min(y), 5) + 0.0 worst from bk group by 1, 2, 3, 4""", ())
def j32_buckets(df):
    m = E.written(market_series(df))
    out = market_outcomes(m)
    rows = D.long_study(m, ["trend", "breadth"], out.drop("leaves"), ["gain"]).join(out.select("session", "horizon", "leaves"), ["session", "horizon"])
    x = D.contained_buckets(rows.withColumn("early", F.col("session") < F.to_date(F.lit(_HALF))), ["signal", "horizon"], "x", "y", "early", "leaves")
    return x.select("signal", "horizon", "half", "bucket", "n", *(r(c, d).alias(c) for c, d in _BUCKETS.items()))


# ---- entries of instruments over several horizons

_ENTRY_HORIZONS = (4, 13, 26)
_ENTRIES = f"""{MOM}, f as (select inst, seq, session, mom > 0.1 up, lag(mom > 0.1) over (partition by inst order by session) was from mom), c as (select inst, seq from f where up and was = false),
wk as (with recursive w(inst, seq) as (select inst, min(seq) from c group by inst union all select inst, nxt from (select w.inst, (select min(c.seq) from c where c.inst = w.inst and c.seq >= w.seq + 12) nxt from w) where nxt is not null) select * from w),
fw as ({' union all '.join(f"select inst, seq, {h} horizon, lead(close, {h + 1}) over v / nullif(lead(open, 1) over v, 0) - 1 y from bars window v as (partition by inst order by session)" for h in _ENTRY_HORIZONS)}),
ev as (select horizon, wk.seq * 1000 + wk.inst place, y from wk join fw using (inst, seq) where y is not null)"""
_EVENT_FIGURES = {"mean": 5, "median": 5, "win": 5, "worst": 5, "t": 4, "p": 5, "holm_p": 5}


@panel("j60_entry_horizons", f"""{_ENTRIES}, {_nw_sql('ev', 'horizon', 'y', 'place', 3, 'nw')}, np as (select horizon, n, mean, t, {_p_sql('t')} p from nw), {_holm_sql('ho', 'np', 'horizon')},
sm as (select horizon, median(y) median, avg(case when y > 0 then 1.0::double else 0.0::double end) win, min(y) worst from ev group by 1)
select horizon, n, round(mean, 5) + 0.0 mean, round(median, 5) + 0.0 median, round(win, 5) + 0.0 win, round(worst, 5) + 0.0 worst, round(t, 4) + 0.0 t, round(p, 5) + 0.0 p, round(adjusted, 5) + 0.0 holm_p from ho join sm using (horizon)""", ())
def j60_horizons(df):
    from ..operators.temporal import spaced
    from ..operators.windows import crossings

    anchors = spaced(crossings(P.with_momentum(df), F.col("mom") > 0.1), "inst", "seq", 12).select("inst", F.col("seq").cast("int").alias("seq"))
    w = by_instrument()
    rows = None
    for h in _ENTRY_HORIZONS:
        x = df.select("inst", "seq", F.lit(h).alias("horizon"), (safe_div(F.lead("close", h + 1).over(w), F.lead("open", 1).over(w)) - 1).alias("y"))
        rows = x if rows is None else rows.unionByName(x)
    x = D.event_study(anchors.withColumn("place", F.col("seq") * 1000 + F.col("inst")), rows, ["inst", "seq"], "horizon", "y", "place", 3)
    return x.select("horizon", "n", *(r(c, d).alias(c) for c, d in _EVENT_FIGURES.items()))


# ---- all evidence on a factor in one row

_ROUTES = """concat_ws(',', case when not canonical then 'duplicate' end, case when canonical and supported >= 2 and contradicted = 0 then 'stable_direction' end, case when contradicted > 0 then 'direction_conflict' end,
  case when outcome = 'supported' then 'incremental' end, case when factor <> 'vol' and canonical then 'tradable' end, case when supported = 0 then 'no_support' end)"""


@panel("j54_factor_card", f"""select ev.*, coverage, canonical, members, outcome, round(mean_gain, 5) + 0.0 mean_gain, {_ROUTES} routes
from (with {_CARD} select factor, supported, contradicted, mean, coverage from ct join cv using (factor)) ev
join (with {_DUP}, gr as (select id, least(id, coalesce((select min(b) from dg where a = id), id), coalesce((select min(a) from dg where b = id), id)) label from nd)
  select split_part(id, ':', 2) factor, first_value(id) over (partition by label order by case when id like 'Z:%' then 0 else 1 end, id) = id canonical, count(*) over (partition by label) members, id from gr) du using (factor)
join (with {_INCREMENT} select factor, outcome, mean_gain from ix) inc using (factor) where id like 'RAW:%'""".replace("select ev.*, coverage,", "select factor, supported, contradicted, mean, coverage,"), ())
def j54(df):
    """Each published factor: folds that support or contradict it, coverage, its place among near duplicates, what it adds to
    the others, and what the evidence is good for."""
    long = factor_panel(df).unpivot(["inst", "session"], list(_FACTORS), "factor", "val")
    cover = long.groupBy("factor").agg(r(F.count("val") / F.count("*")).alias("coverage"))
    dup = duplicate_groups(df).filter(F.col("id").startswith("RAW:")).select(F.split("id", ":")[1].alias("factor"), (F.col("canonical") == F.col("id")).alias("canonical"), "members")
    gain = increments(df).select("factor", "outcome", r("mean_gain", 5).alias("mean_gain"))
    x = evidence_counts(df).join(cover, "factor").join(dup, "factor").join(gain, "factor")
    return x.withColumn("routes", F.concat_ws(",", E.routes("canonical", "supported", "contradicted", F.col("outcome") == "supported", F.col("factor") != "vol")))
