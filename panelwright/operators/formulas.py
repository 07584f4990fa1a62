"""The factor formula library: columns over bars and daily figures, all on one partitioning by instrument."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .exprs import by_instrument, by_session, rolling_full, rolling_partial, safe_div, safe_log
from .order_stats import Trailing, with_trailing
from .windows import ewm_std, rolling_skew

WINDOWS = (5, 10, 20, 30, 60)
EPS = 1e-12


def kbar() -> dict[str, Column]:
    o, h, lo, c = (F.col(x) for x in ("open", "high", "low", "close"))
    span, top, bottom, shift = h - lo + EPS, h - F.greatest(o, c), F.least(o, c) - lo, 2 * c - h - lo
    return {
        "kmid": safe_div(c - o, o), "klen": safe_div(h - lo, o), "kmid2": safe_div(c - o, span),
        "kup": safe_div(top, o), "kup2": safe_div(top, span), "klow": safe_div(bottom, o), "klow2": safe_div(bottom, span),
        "ksft": safe_div(shift, o), "ksft2": safe_div(shift, span),
    }


def with_changes(df: DataFrame) -> DataFrame:
    """Adds the ratios and differences to the session before that the rolling formulas use."""
    w = by_instrument()
    p, v = F.lag("close").over(w), F.lag("volume").over(w)
    return df.withColumns({
        "close_ratio": safe_div("close", p), "volume_ratio": safe_div("volume", v), "dc": F.col("close") - p, "dv": F.col("volume") - v,
    })


def trend(n: int) -> dict[str, Column]:
    w, seq = by_instrument(n), F.col("seq").cast("double")
    two = F.count("close").over(w) >= 2
    slope = F.when(two, F.regr_slope("close", seq).over(w))
    fitted = F.when(two, F.regr_intercept("close", seq).over(w)) + slope * seq
    return {
        f"roc{n}": safe_div(F.lag("close", n).over(by_instrument()), "close"), f"ma{n}": safe_div(rolling_partial("close", n, "avg"), "close"),
        f"std{n}": safe_div(rolling_partial("close", n, "std"), "close"), f"beta{n}": safe_div(slope, "close"),
        f"rsqr{n}": F.when(two & (F.var_pop("close").over(w) > EPS), F.regr_r2("close", seq).over(w)), f"resi{n}": safe_div(F.col("close") - fitted, "close"),
    }


def _when_extreme(x: str, n: int, sign: int) -> Column:
    """Session number of the window's first largest (sign 1) or smallest value."""
    key = F.when(F.col(x).isNotNull(), F.struct((sign * F.col(x)).alias("v"), (-F.col("seq")).alias("s")))
    return F.max_by("seq", key).over(by_instrument(n))


def with_close_order(df: DataFrame, windows: Sequence[int] = WINDOWS) -> DataFrame:
    """df with the order statistics of close that extremes() reads, in one pass for all windows."""
    return with_trailing(df, {f"_close{n}": Trailing("close", n, quantiles=(0.8, 0.2)) for n in windows})


def extremes(n: int) -> dict[str, Column]:
    """Columns over rows of with_close_order()."""
    w = by_instrument(n)
    hi, lo = rolling_partial("high", n, "max"), rolling_partial("low", n, "min")
    own = f"_close{n}"
    first, at_max, at_min = F.min("seq").over(w), _when_extreme("high", n, 1), _when_extreme("low", n, -1)
    return {
        f"max{n}": safe_div(hi, "close"), f"min{n}": safe_div(lo, "close"),
        f"qtlu{n}": safe_div(f"{own}_q0", "close"), f"qtld{n}": safe_div(f"{own}_q1", "close"),
        f"rank{n}": safe_div(F.col(f"{own}_below") + (F.col(f"{own}_same") + 1) / 2, f"{own}_size"),
        f"rsv{n}": safe_div(F.col("close") - lo, hi - lo + EPS),
        f"imax{n}": (at_max - first + 1) / n, f"imin{n}": (at_min - first + 1) / n, f"imxd{n}": (at_max - at_min) / n,
    }


def _corr(a: Column, b: Column, n: int) -> Column:
    w, both = by_instrument(n), a.isNotNull() & b.isNotNull()
    x, y = F.when(both, a), F.when(both, b)
    varies = (F.count(x).over(w) >= 2) & (F.var_pop(x).over(w) > EPS) & (F.var_pop(y).over(w) > EPS)
    return F.when(varies, F.covar_pop(x, y).over(w) / F.sqrt(F.var_pop(x).over(w) * F.var_pop(y).over(w)))


def price_volume(n: int) -> dict[str, Column]:
    return {f"corr{n}": _corr(F.col("close"), F.log1p("volume"), n), f"cord{n}": _corr(F.col("close_ratio"), F.log1p("volume_ratio"), n)}


def _moves(d: str, n: int, names: Sequence[str]) -> dict[str, Column]:
    """Gains, losses and their difference as parts of all movement."""
    up, down, all_ = (rolling_partial(x, n, "sum") for x in (F.greatest(F.col(d), F.lit(0.0)), F.greatest(-F.col(d), F.lit(0.0)), F.abs(d)))
    return {names[0]: safe_div(up, all_ + EPS), names[1]: safe_div(down, all_ + EPS), names[2]: safe_div(up - down, all_ + EPS)}


def up_down(n: int) -> dict[str, Column]:
    share = lambda c: rolling_partial(F.when(c, 1.0).otherwise(0.0), n, "avg")
    up, down = share(F.col("dc") > 0), share(F.col("dc") < 0)
    return {f"cntp{n}": up, f"cntn{n}": down, f"cntd{n}": up - down} | _moves("dc", n, [f"sump{n}", f"sumn{n}", f"sumd{n}"])


def volume(n: int) -> dict[str, Column]:
    v, weighted = F.col("volume") + EPS, F.abs(F.col("close_ratio") - 1) * F.col("volume")
    return {
        f"vma{n}": safe_div(rolling_partial("volume", n, "avg"), v), f"vstd{n}": safe_div(rolling_partial("volume", n, "std"), v),
        f"wvma{n}": safe_div(rolling_partial(weighted, n, "std"), rolling_partial(weighted, n, "avg") + EPS),
    } | _moves("dv", n, [f"vsump{n}", f"vsumn{n}", f"vsumd{n}"])


def all_windows(family, windows: Sequence[int] = WINDOWS) -> dict[str, Column]:
    out: dict[str, Column] = {}
    for n in windows:
        out |= family(n)
    return out


def point_valuation() -> dict[str, Column]:
    """Over pb, ps_ttm, dv_ttm (percent) and total_mv (ten thousands)."""
    return {"book_to_price": safe_div(F.lit(1.0), "pb"), "sales_to_price": safe_div(F.lit(1.0), "ps_ttm"), "dividend_yield_ttm": F.col("dv_ttm") / 100, "log_market_cap": safe_log(F.col("total_mv") * 1e4)}


def with_risk_inputs(df: DataFrame) -> DataFrame:
    """Adds ret, true_range, market_ret (mean return of the session) and trail20 to (close, high, low, turnover)."""
    w = by_instrument()
    p = F.lag("close").over(w)
    x = df.withColumns({"ret": safe_div("close", p) - 1, "true_range": F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - p), F.abs(F.col("low") - p)), "trail20": safe_div("close", F.lag("close", 20).over(w)) - 1})
    return x.withColumn("market_ret", F.avg("ret").over(by_session()))


def full(x: str, n: int, value: Column) -> Column:
    """value where all n sessions have x."""
    return F.when(F.count(x).over(by_instrument(n)) == n, value)


def risk() -> dict[str, Column]:
    of = lambda f, x, n: f(x).over(by_instrument(n))
    w = by_instrument()
    sd20, sd60 = of(F.stddev_samp, "turnover", 20), of(F.stddev_samp, "ret", 60)
    mean20, mean21 = of(F.avg, "turnover", 20), of(F.avg, "turnover", 21)
    return {
        "atr6": full("true_range", 6, rolling_full(safe_div("true_range", "close"), 6)),
        "davol10": full("turnover", 120, safe_div(of(F.avg, "turnover", 10), of(F.avg, "turnover", 120)) - 1),
        "variance20": full("ret", 20, of(F.var_samp, "ret", 20) * 250), "liquidity": full("turnover", 21, safe_log(mean21)),
        "turnover_cv20": full("turnover", 20, F.when(mean20 > 0, safe_div(sd20, mean20))), "skew120": rolling_skew("ret", 120, 120),
        "momentum": safe_div(F.lag("close", 21).over(w), F.lag("close", 252).over(w)) - 1,
        "sharpe60": full("ret", 60, F.when(sd60 > 1e-8, of(F.avg, "ret", 60) / sd60 * F.sqrt(F.lit(250.0)))),
    }


def one_month_rank() -> Column:
    return F.when(F.col("trail20").isNotNull(), 1 - F.percent_rank().over(by_session().orderBy(F.asc_nulls_last("trail20"))))


def beta_and_residual(n: int = 252, half_life: float = 42.0) -> dict[str, Column]:
    """Market beta, and the mix of weighted deviation, residual deviation and range of the log price."""
    w = by_instrument(n)
    ok = (F.count("ret").over(w) == n) & (F.count("market_ret").over(w) == n) & (F.var_samp("market_ret").over(w) > EPS)
    cov, var = F.covar_samp("ret", "market_ret").over(w), F.var_samp("market_ret").over(w)
    resid = F.sqrt(F.greatest(F.var_samp("ret").over(w) - cov * cov / var, F.lit(0.0)))
    log_close = safe_log("close")
    mix = 0.50 * ewm_std("ret", n, half_life) + 0.42 * resid + 0.08 * (F.max(log_close).over(w) - F.min(log_close).over(w))
    return {"beta": F.when(ok, cov / var), "resvol": F.when(ok, mix)}


def turnover_and_deviation(n: int = 252, half_life: float = 42.0) -> dict[str, Column]:
    month = rolling_partial("turnover", 21, "sum")
    return {"share_turnover_monthly": full("turnover", 21, safe_log(month)), "daily_standard_deviation": full("ret", n, ewm_std("ret", n, half_life))}
