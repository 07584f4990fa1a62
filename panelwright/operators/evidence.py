"""Labels, inference, folds, redundancy and portfolio statistics over panels and series, as DataFrame functions."""
from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import written
from .exprs import by_instrument, by_session, col, safe_div


# ---- labels


def limit_aware_label(df: DataFrame, h: int, require_flags: bool = True) -> DataFrame:
    """Adjusted return from the next session's open to the close h later, and the first reason why there is none.

    df is a dense grid with open, close, adj_factor, tradeable, can_buy_open and can_sell_close (NULL: unknown)."""
    w = by_instrument()
    at = lambda c, k: F.lead(c, k).over(w)
    entry, leave = {c: at(c, 1) for c in ("seq", "open", "adj_factor", "tradeable", "can_buy_open")}, {c: at(c, h + 1) for c in ("seq", "close", "adj_factor", "tradeable", "can_sell_close")}
    no = lambda c: ~F.coalesce(c, F.lit(False))
    unknown = lambda c: F.lit(require_flags) & c.isNull()
    bad_factor = lambda c: c.isNull() | (c <= 0)
    reason = (
        F.when(entry["seq"].isNull(), "no_entry_session").when(leave["seq"].isNull(), "no_exit_session")
        .when(no(entry["tradeable"]), "entry_untradable").when(no(leave["tradeable"]), "exit_untradable")
        .when(unknown(entry["can_buy_open"]), "entry_limit_unknown").when(unknown(leave["can_sell_close"]), "exit_limit_unknown")
        .when(~entry["can_buy_open"], "entry_buy_blocked").when(~leave["can_sell_close"], "exit_sell_blocked")
        .when(bad_factor(entry["adj_factor"]) | bad_factor(leave["adj_factor"]), "adjustment_missing")
        .when(bad_factor(entry["open"]) | bad_factor(leave["close"]), "price_invalid").otherwise("valid")
    )
    value = safe_div(leave["close"] * leave["adj_factor"], entry["open"] * entry["adj_factor"]) - 1
    return df.withColumn("reason", reason).withColumn("label", F.when(F.col("reason") == "valid", value))


def path_label(df: DataFrame, h: int, level: str = "level", segment: str = "segment", benchmark: str | None = None) -> DataFrame:
    """From the next session to h after it, within one segment: return, lowest return and deepest fall of the path, and the
    return less the benchmark's."""
    w = by_instrument().rowsBetween(1, h + 1)
    path = F.collect_list(level).over(w)
    whole = (F.size(path) == h + 1) & (F.min(segment).over(w) == F.max(segment).over(w))
    start = F.struct(F.lit(0.0).alias("peak"), F.lit(0.0).alias("worst"))
    step = lambda acc, x: F.struct(F.greatest(acc["peak"], x).alias("peak"), F.least(acc["worst"], x / F.greatest(acc["peak"], x) - 1).alias("worst"))
    out = df.withColumns({"_path": path, "_whole": whole}).withColumn("path_return", F.when(F.col("_whole"), F.try_element_at("_path", F.lit(h + 1)) / F.try_element_at("_path", F.lit(1)) - 1))
    out = out.withColumn("path_drawdown", F.when(F.col("_whole"), F.aggregate("_path", start, step)["worst"])).withColumn("path_low", F.when(F.col("_whole"), F.array_min("_path") / F.try_element_at("_path", F.lit(1)) - 1))
    if benchmark:
        b0, b1 = F.lead(benchmark, 1).over(by_instrument()), F.lead(benchmark, h + 1).over(by_instrument())
        out = out.withColumn("active_return", F.col("path_return") - (safe_div(b1, b0) - 1))
    return out.drop("_path", "_whole")


def label_forward_violations(df: DataFrame, factor_time: str, label_time: str) -> DataFrame:
    """Rows whose label was known no later than their factor."""
    return df.filter(F.col(label_time) <= F.col(factor_time))


def purge(df: DataFrame, label_end: str, boundary: Column) -> DataFrame:
    """Rows whose label ends before the next split begins."""
    return df.filter(F.col(label_end) < boundary)


# ---- inference


def two_sided_p(z) -> Column:
    """Normal tail of |z| on both sides, by the rational approximation of Abramowitz and Stegun 7.1.26 (error below 2e-7)."""
    x = F.abs(col(z)) / F.sqrt(F.lit(2.0))
    t = 1 / (1 + 0.3275911 * x)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return poly * F.exp(-x * x)


def mean_test(df: DataFrame, entity: str, x: str, time: str, lags: int) -> DataFrame:
    """Newey-West mean test with its two-sided normal p."""
    from .windows import newey_west

    return newey_west(df, entity, x, time, lags).withColumn("p", two_sided_p("t"))


def mean_inference(df: DataFrame, entity: str, x: str, time: str, lags: int, block: int, resamples: int, alpha: float) -> DataFrame:
    """Each entity's mean by both tests: Newey-West (hac_) and circular block bootstrap (bootstrap_), each with the p adjusted
    over all entities as one family and whether that rejects; `lower` and `upper` bound the mean by the bootstrap."""
    from .panel import benjamini_hochberg
    from .resampling import block_bootstrap

    hac = mean_test(df, entity, x, time, lags).withColumnRenamed("p", "hac_p")
    boot = block_bootstrap(df, entity, x, time, block, resamples).select(entity, F.col("p").alias("bootstrap_p"), "lower", "upper")
    t = written(hac.join(boot, entity).withColumn("_all", F.lit(1)))  # a row a hypothesis
    for test in ("hac", "bootstrap"):
        t = benjamini_hochberg(t, f"{test}_p", "_all").withColumnRenamed("q", f"{test}_q").withColumn(f"{test}_reject", F.coalesce(F.col(f"{test}_q") <= alpha, F.lit(False)))
    return t.drop("_all")


def incremental_outcome(tests: DataFrame, declared: str = "declared") -> DataFrame:
    """Adds `outcome` to tests that both inferences must reject; without a declared direction there is none to support."""
    both = F.col("hac_reject") & F.col("bootstrap_reject")
    outcome = F.when(~F.coalesce(F.col(declared).isin("POSITIVE", "NEGATIVE"), F.lit(False)), "undirected").when(~both, "no_increment").when(F.col("mean") > 0, "supported").otherwise("contradicted")
    return tests.withColumn("outcome", outcome)


# ---- folds and regimes


def walk_forward(df: DataFrame, folds: DataFrame, label_end: str) -> DataFrame:
    """Rows with (fold, role): train, validation or test of each fold that holds their session. Rows of train and
    validation whose label reaches the next part are purged.

    folds: fold, train_start, train_end, validation_start, validation_end, test_start, test_end; a handful of rows."""
    j = df.join(F.broadcast(folds), F.col("session").between(F.col("train_start"), F.col("test_end")))
    s, end = F.col("session"), F.col(label_end)
    role = (
        F.when(s.between(F.col("train_start"), F.col("train_end")) & (end < F.col("validation_start")), "train")
        .when(s.between(F.col("validation_start"), F.col("validation_end")) & (end < F.col("test_start")), "validation")
        .when(s.between(F.col("test_start"), F.col("test_end")), "test")
    )
    return j.withColumn("role", role).filter("role is not null").drop(*(c for c in folds.columns if c != "fold"))


def fold_directions(df: DataFrame, x: str, declared: str = "direction") -> DataFrame:
    """Per fold and factor: 1 or -1 as declared, else by the sign of the mean in train, and where it comes from."""
    g = df.groupBy("fold", "factor").agg(F.first(declared, ignorenulls=True).alias("declared"), F.avg(F.when(F.col("role") == "train", F.col(x))).alias("train_mean"), F.avg(F.when(F.col("role") == "test", F.col(x))).alias("test_mean"))
    sign = F.when(F.col("declared") == "POSITIVE", 1).when(F.col("declared") == "NEGATIVE", -1).when(F.col("train_mean") >= 0, 1).when(F.col("train_mean") < 0, -1)
    return g.select("fold", "factor", sign.alias("direction"), F.when(F.col("declared").isin("POSITIVE", "NEGATIVE"), "declared").otherwise("train_mean_sign").alias("origin"), "train_mean", "test_mean")


def market_regimes(market: DataFrame, ret: str, trend: int, vol: int) -> DataFrame:
    """Per session: sum of log returns over `trend` sessions and deviation over `vol`; a series of one row a session."""
    w = Window.partitionBy(F.lit(0)).orderBy("session")
    log = F.when(F.col(ret) > -1, F.log1p(ret))
    return market.select("session", F.sum(log).over(w.rowsBetween(-(trend - 1), 0)).alias("trend"), F.stddev_pop(ret).over(w.rowsBetween(-(vol - 1), 0)).alias("volatility"))


def regime_means(df: DataFrame, regimes: DataFrame, x: str, least: int) -> DataFrame:
    """Mean of x on test sessions by fold, factor, dimension and regime; high volatility is judged by the train median."""
    j = df.join(regimes, "session")
    cut = j.filter("role = 'train'").select("fold", "session", "volatility").distinct().groupBy("fold").agg(F.median("volatility").alias("cut"))
    t = j.filter("role = 'test'").join(F.broadcast(cut), "fold")
    long = t.select("fold", "factor", x, F.explode(F.array(
        F.struct(F.lit("trend").alias("dimension"), F.when(F.col("trend") >= 0, "up").otherwise("down").alias("regime")),
        F.struct(F.lit("volatility").alias("dimension"), F.when(F.col("volatility") >= F.col("cut"), "high").otherwise("low").alias("regime")),
    )).alias("r"))
    g = long.groupBy("fold", "factor", "r.dimension", "r.regime").agg(F.count(x).alias("n"), F.avg(x).alias("mean"))
    return g.withColumn("status", F.when(F.col("n") >= least, "diagnostic").otherwise("insufficient_sessions"))


def decision(reject, mean) -> Column:
    return F.when(~F.coalesce(col(reject), F.lit(False)), "not_rejected").when(col(mean) > 0, "direction_supported").otherwise("direction_contradicted")


# ---- redundancy


def pair_correlations(long: DataFrame, keys: Sequence[str], entity: str, x: str, entities: Sequence[str], by: str, least: int = 3) -> DataFrame:
    """Correlation of each pair of `entities` over the rows of every `by` that have both: (by, left_id, right_id, n, corr).

    Entities are factors, some dozens: one pivot and one aggregate for all pairs, no join of rows with rows."""
    wide = long.groupBy(*keys).pivot(entity, list(entities)).agg(F.first(x))
    pairs = [(a, b) for i, a in enumerate(entities) for b in entities[i + 1 :]]

    def stats(a, b):
        ok = F.col(f"`{a}`").isNotNull() & F.col(f"`{b}`").isNotNull()
        p, q = F.when(ok, F.col(f"`{a}`")), F.when(ok, F.col(f"`{b}`"))
        varies = (F.count(p) >= least) & (F.var_pop(p) > 1e-12) & (F.var_pop(q) > 1e-12)
        return F.struct(F.lit(a).alias("left_id"), F.lit(b).alias("right_id"), F.count(p).alias("n"), F.when(varies, F.covar_pop(p, q) / F.sqrt(F.var_pop(p) * F.var_pop(q))).alias("corr"))

    out = wide.groupBy(by) if by else wide.groupBy()
    rows = out.agg(F.array(*(stats(a, b) for a, b in pairs)).alias("_p")).withColumn("_p", F.explode("_p"))
    return rows.select(*([by] if by else []), "_p.*")


def small_components(nodes: DataFrame, edges: DataFrame, node: str = "id") -> DataFrame:
    """(id, label): the smallest id that the undirected edges (left_id, right_id) reach. For tables of some hundred ids;
    each round takes the least label of the neighbours and of their labels, until nothing changes."""
    both = edges.select("left_id", "right_id").unionByName(edges.select(F.col("right_id").alias("left_id"), F.col("left_id").alias("right_id"))).distinct()
    labels = nodes.select(F.col(node).alias("id"), F.col(node).alias("label"))
    while True:
        near = both.join(labels, F.col("right_id") == F.col("id")).groupBy("left_id").agg(F.min("label").alias("near"))
        new = labels.join(near, F.col("id") == F.col("left_id"), "left").select("id", F.least("label", F.coalesce("near", "label")).alias("label"), (F.coalesce("near", "label") < F.col("label")).alias("moved"))
        new = written(new)
        if new.filter("moved").isEmpty():
            return new.select("id", "label")
        labels = new.select("id", "label")


def canonical_members(groups: DataFrame, priority: Column) -> DataFrame:
    """The member that stands for each group: best priority, then smallest id."""
    w = Window.partitionBy("label")
    key = F.struct(priority.alias("p"), F.col("id").alias("i"))
    return groups.withColumn("canonical", F.min(key).over(w)["i"]).withColumn("members", F.count("*").over(w))


def medoids(clusters: DataFrame, distances: DataFrame) -> DataFrame:
    """Adds mean_distance to the other members of the cluster and the representative: nearest to all, then smallest id."""
    both = distances.select("left_id", "right_id", "distance").unionByName(distances.select(F.col("right_id").alias("left_id"), F.col("left_id").alias("right_id"), "distance"))
    other = clusters.select(F.col("id").alias("right_id"), "cluster")
    d = clusters.join(both, F.col("id") == F.col("left_id")).join(other, ["right_id", "cluster"]).groupBy("id").agg(F.avg("distance").alias("mean_distance"))
    x = clusters.join(d, "id", "left").na.fill(0.0, ["mean_distance"])
    key = F.struct("mean_distance", "id")
    return x.withColumn("representative", F.min(key).over(Window.partitionBy("family", "cluster"))["id"])


# ---- signals and events


def frozen_buckets(df: DataFrame, entity: str, x: str, half: str, quantiles: Sequence[float] = (0.2, 0.4, 0.6, 0.8)) -> DataFrame:
    """Bucket 1.. of x by cutpoints that the first half of each entity sets for both halves."""
    cuts = df.filter(F.col(half) == 1).groupBy(entity).agg(F.percentile(x, F.array(*map(F.lit, quantiles))).alias("_cuts"))
    return df.join(F.broadcast(cuts), entity).withColumn("bucket", F.when(F.col(x).isNotNull(), 1 + F.size(F.filter("_cuts", lambda c: c < F.col(x))))).drop("_cuts")


def state_zones(df: DataFrame, flag, x: str, price: str) -> DataFrame:
    """Each unbroken run of true flags: first and last session, length, range and mean of x, price change, whether it goes
    on at the end of the data and whether its start is a known crossing (the session before was known to be false)."""
    w = by_instrument()
    d = df.withColumn("_f", col(flag)).withColumns({"_was": F.lag("_f").over(w), "_next": F.lead("seq").over(w)})
    on = F.coalesce("_f", F.lit(False))
    d = d.withColumn("_run", F.sum(F.when(on & ~F.coalesce("_was", F.lit(False)), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    g = d.filter("_f").groupBy("inst", "_run").agg(
        F.min("session").alias("start"), F.max("session").alias("stop"), F.count("*").alias("length"), F.min(x).alias("low"), F.max(x).alias("high"), F.avg(x).alias("mean"),
        F.min_by(price, "session").alias("_p0"), F.max_by(price, "session").alias("_p1"), F.max(F.col("_next").isNull()).alias("ongoing"), F.min_by(F.coalesce(~F.col("_was"), F.lit(False)), "session").alias("known_start"),
    )
    return g.withColumn("price_change", safe_div("_p1", "_p0") - 1).drop("_run", "_p0", "_p1")


def leave_one_year_out(df: DataFrame, flag: str, x: str, years: Sequence[int]) -> DataFrame:
    """Mean of x where flag less where not, with each year left out in turn."""
    d = df.withColumn("excluded", F.explode(F.array(*map(F.lit, years)))).filter(F.year("session") != F.col("excluded"))
    return d.groupBy("excluded").agg(F.count(x).alias("n"), (F.avg(F.when(F.col(flag), F.col(x))) - F.avg(F.when(~F.col(flag), F.col(x)))).alias("difference"))


def entry_paths(prices: DataFrame, anchors: DataFrame, h: int, parts: Sequence[int]) -> DataFrame:
    """Per anchor (inst, seq): value after h sessions of one unit bought at once, of a unit in equal parts at the offsets
    `parts`, and of one bought when the price first lies above the anchor's (`confirmed`; NULL if it never does)."""
    p = prices.select("inst", F.col("seq").alias("_q"), "close")
    j = anchors.join(p, "inst").filter(F.col("_q").between(F.col("seq"), F.col("seq") + h))
    at = lambda k: F.max(F.when(F.col("_q") == F.col("seq") + k, F.col("close")))
    g = j.groupBy("inst", "seq").agg(F.array_sort(F.collect_list(F.struct("_q", "close"))).alias("_path"), at(0).alias("_p0"), at(h).alias("_p1"), *(at(k).alias(f"_b{k}") for k in parts))
    above = F.filter("_path", lambda e: (e["_q"] > F.col("seq")) & (e["close"] > F.col("_p0")))
    split = sum((safe_div("_p1", f"_b{k}") for k in parts), F.lit(0.0)) / len(parts)
    return g.select("inst", "seq", safe_div("_p1", "_p0").alias("immediate"), split.alias("split"), safe_div("_p1", F.try_element_at(above, F.lit(1))["close"]).alias("confirmed"))


# ---- portfolios


def screen(df: DataFrame, base: Column, exclude_high: dict[str, float], exclude_low: dict[str, float], weights: dict[str, tuple[float, bool]]) -> DataFrame:
    """All sessions at once: base rows, less those in the highest or lowest part of a column (parts are of the base rows),
    less those without all scored columns, ranked by the weighted mid-percentiles of what is left."""
    x = df.filter(base)
    for c, share in {**exclude_high, **exclude_low}.items():
        has = F.col(c).isNotNull()
        n = F.count(c).over(by_session())
        rank = F.rank().over(by_session(has).orderBy(c)) + (F.count("*").over(Window.partitionBy("session", c)) - 1) / 2
        x = x.withColumn(f"_p_{c}", F.when(has, F.when(n <= 1, 0.5).otherwise((rank - 1) / F.nullif(n - 1, F.lit(0)))))
    for c, share in exclude_high.items():
        x = x.filter(F.col(f"_p_{c}") <= 1 - share)
    for c, share in exclude_low.items():
        x = x.filter(F.col(f"_p_{c}") >= share)
    x = x.filter(" and ".join(f"{c} is not null" for c in weights)).drop(*(f"_p_{c}" for c in (*exclude_high, *exclude_low)))
    from .exprs import mid_percentile

    score = sum((w * mid_percentile(c, good) for c, (w, good) in weights.items()), F.lit(0.0)) / sum(w for w, _ in weights.values())
    x = x.withColumn("score", score)
    return x.withColumn("rank", F.row_number().over(by_session().orderBy(F.desc("score"), "inst")))


def capped_inverse_weights(df: DataFrame, risk: str, cap: float, keys: Sequence[str] = ("session",)) -> DataFrame:
    """Weights in proportion to 1 / risk that sum to 1 with none above the cap; what a cap leaves over goes to the others,
    and stays in cash if all are at it.

    With the largest first, the first k stand at the cap where the k+1-th of the rest would not pass it: prefix sums."""
    w = Window.partitionBy(*keys)
    down = w.orderBy(F.desc("_u"), "inst")
    x = df.filter(F.col(risk) > 0).withColumn("_u", 1 / F.col(risk))
    x = x.withColumns({"_k": F.row_number().over(down), "_rest": F.sum("_u").over(w) - F.coalesce(F.sum("_u").over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))})
    share = F.greatest(F.lit(1.0) - (F.col("_k") - 1) * cap, F.lit(0.0)) * F.col("_u") / F.col("_rest")
    x = x.withColumn("_over", share >= cap)
    full = F.min(F.when(~F.col("_over"), F.col("_k"))).over(w)
    x = x.withColumn("_full", F.coalesce(full - 1, F.count("*").over(w)))
    left = F.greatest(F.lit(1.0) - F.col("_full") * cap, F.lit(0.0))
    others = F.sum(F.when(F.col("_k") > F.col("_full"), F.col("_u"))).over(w)
    return x.withColumn("weight", F.when(F.col("_k") <= F.col("_full"), F.lit(cap)).otherwise(left * F.col("_u") / others)).drop("_u", "_k", "_rest", "_over", "_full")


def rebase(series: DataFrame, calendar: DataFrame, level: str) -> DataFrame:
    """level / first - 1 for each entity that has a level on every session of the calendar, NULL for the others."""
    n = calendar.agg(F.count_distinct("session").alias("_n"))
    g = series.filter(F.col(level).isNotNull()).groupBy("inst").agg(F.count_distinct("session").alias("_have"), F.min_by(level, "session").alias("_first"))
    x = series.join(g, "inst", "left").crossJoin(F.broadcast(n))
    return x.withColumn("rebased", F.when(F.col("_have") == F.col("_n"), safe_div(level, "_first") - 1)).drop("_n", "_have", "_first")


def allocations(scores: DataFrame, score: str, tilt: float) -> DataFrame:
    """Weights of the candidates of each session: all to the best, equal with a tilt to the best, and by positive score."""
    w = by_session()
    best = F.row_number().over(w.orderBy(F.desc_nulls_last(score), "inst")) == 1
    n = F.count("*").over(w)
    positive = F.greatest(F.col(score), F.lit(0.0))
    total = F.sum(positive).over(w)
    x = scores.withColumns({"_best": best, "_n": n})
    tilted = F.when(F.col("_best"), (1 - tilt) / F.col("_n") + tilt).otherwise((1 - tilt) / F.col("_n"))
    return x.select("session", "inst", F.col("_best").cast("double").alias("winner"), tilted.alias("tilted"), F.when(total > 0, F.coalesce(positive, F.lit(0.0)) / total).otherwise(1 / n).alias("by_score"))


def raw_regime(gap, breadth, drawdown) -> Column:
    """strong, weak or base of a market by its gap to the average, breadth and drawdown; NULL while one is unknown."""
    known = col(gap).isNotNull() & col(breadth).isNotNull() & col(drawdown).isNotNull()
    strong = (col(gap) > 0) & (col(breadth) >= 0.5) & (col(drawdown) > -0.1)
    weak = (col(gap) < 0) & ((col(breadth) < 0.4) | (col(drawdown) <= -0.2))
    return F.when(known, F.when(strong, "strong").when(weak, "weak").otherwise("base"))


# ---- learning


def feature_panel(df: DataFrame, columns: Sequence[str], n: int, least: int) -> DataFrame:
    """Changes over n sessions and mid-rank percentiles within n of each column, returns, volatility, drawdown and relative
    momentum of close."""
    from .order_stats import with_history_percentile

    w = by_instrument()
    df = with_history_percentile(df, {f"{c}_pct": c for c in columns}, n, least) if columns else df
    out = {f"{c}_change": F.col(c) - F.lag(c, n).over(w) for c in columns}
    ret = safe_div("close", F.lag("close", 1).over(w)) - 1
    x = df.withColumns(out).withColumns({"ret13": safe_div("close", F.lag("close", 13).over(w)) - 1, "ret26": safe_div("close", F.lag("close", 26).over(w)) - 1, "_ret": ret})
    x = x.withColumns({"vol13": F.stddev_samp("_ret").over(by_instrument(13)), "dd26": safe_div("close", F.max("close").over(by_instrument(26))) - 1})
    return x.withColumn("rel13", F.col("ret13") - F.avg("ret13").over(by_session())).drop("_ret")


def walk_forward_ridge(df: DataFrame, features: Sequence[str], label: str, label_end: str, refits: DataFrame, ridge: float = 1.0, most_missing: float = 0.8) -> DataFrame:
    """(inst, session, refit, prediction) for the sessions of [refit, next_refit), from labels that ended before the refit.

    Features with too many NULLs in training are left out, others imputed by their median and flagged; columns are scaled,
    and each session weighs the same. Moments are aggregates of Spark; a task solves one small system a refit.
    refits: (refit, next_refit), some dozens of rows."""
    d = df.select("inst", "session", label, label_end, *features)
    r = F.broadcast(refits)
    train = d.join(r, (F.col(label_end) < F.col("refit")) & F.col(label).isNotNull())
    med = train.groupBy("refit").agg(F.struct(*(F.median(c).alias(c) for c in features)).alias("med"), F.struct(*((F.count(c) >= (1 - most_missing) * F.count("*")).alias(c) for c in features)).alias("use"))

    def imputed(x):
        x = x.join(F.broadcast(med), "refit")
        value = lambda c: F.when(F.col(f"use.{c}"), F.coalesce(F.col(c), F.col(f"med.{c}"))).otherwise(0.0)
        return x.withColumn("x", F.array(*(value(c) for c in features), *(F.when(F.col(f"use.{c}") & F.col(c).isNull(), 1.0).otherwise(0.0) for c in features)))

    k = 2 * len(features)
    t = imputed(train).withColumn("w", 1 / F.count("*").over(Window.partitionBy("refit", "session")))
    v = [F.element_at("x", i + 1) for i in range(k)] + [F.col(label), F.lit(1.0)]
    moments = t.groupBy("refit").agg(F.array(*(F.sum(F.col("w") * v[i] * v[j]) for i in range(k + 2) for j in range(i, k + 2))).alias("m"))

    def solve(frames):
        import numpy as np
        import pandas as pd

        for pdf in frames:
            out = []
            for refit, m in zip(pdf.refit, pdf.m):
                s = np.zeros((k + 2, k + 2))
                s[np.triu_indices(k + 2)] = m
                s = s + s.T - np.diag(np.diag(s))
                n, mean = s[-1, -1], s[-1, :-1] / s[-1, -1]
                cov = s[:-1, :-1] / n - np.outer(mean, mean)
                sd = np.sqrt(np.maximum(np.diag(cov)[:k], 0))
                on = sd > 1e-9
                z = np.where(on, sd, 1.0)
                a = cov[:k, :k] / np.outer(z, z) + ridge / n * np.eye(k)
                a[~on], a[:, ~on] = 0, 0
                a[~on, ~on] = 1
                b = np.where(on, cov[:k, k] / z, 0)
                beta = np.linalg.solve(a, b) / z * on
                out.append((refit, [float(x) for x in beta], float(mean[k] - mean[:k] @ beta)))
            yield pd.DataFrame(out, columns=["refit", "beta", "base"])

    model = moments.mapInPandas(solve, "refit date, beta array<double>, base double")
    test = imputed(d.join(r, (F.col("session") >= F.col("refit")) & (F.col("session") < F.col("next_refit"))))
    dot = F.aggregate(F.zip_with("x", "beta", lambda a, b: a * b), F.lit(0.0), lambda acc, y: acc + y)
    return test.join(F.broadcast(model), "refit").select("inst", "session", "refit", label, (dot + F.col("base")).alias("prediction"))


def walk_forward_trees(df: DataFrame, features: Sequence[str], label: str, label_end: str, refits: DataFrame, rounds: int = 10, depth: int = 3, most_missing: float = 0.8, seed: int = 7) -> DataFrame:
    """(inst, session, refit, label, prediction, importance) for the sessions of [refit, next_refit): gradient-boosted trees,
    fitted anew at each refit from labels that ended before it, with the share of the gain of each feature.

    Features are treated as in walk_forward_ridge: too many NULLs in training leave one out, other NULLs become the median
    of training and are flagged (feature `x_missing`), so every row gets a prediction. A refit without training rows gives
    none. refits: (refit, next_refit), some dozens of rows, each one distributed fit."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    d = written(df.select("inst", "session", label, label_end, *features))
    out = []
    for refit, until in sorted(tuple(r) for r in refits.select("refit", "next_refit").collect()):
        train = d.filter((F.col(label_end) < F.lit(refit)) & F.col(label).isNotNull())
        seen = train.agg(F.count("*").alias("_n"), *(F.median(c).alias(f"m_{c}") for c in features), *(F.count(c).alias(f"n_{c}") for c in features)).first()
        used = [c for c in features if seen._n and seen[f"n_{c}"] >= (1 - most_missing) * seen._n and seen[f"n_{c}"]]
        if not used:
            continue
        filled = lambda x, used=used, seen=seen: x.withColumns({f"_{c}": F.coalesce(c, F.lit(seen[f"m_{c}"])) for c in used} | {f"_{c}_missing": F.col(c).isNull().cast("double") for c in used})
        names = [*used, *(f"{c}_missing" for c in used)]
        pack = VectorAssembler(inputCols=[f"_{c}" for c in names], outputCol="_x")
        model = GBTRegressor(featuresCol="_x", labelCol=label, maxIter=rounds, maxDepth=depth, seed=seed).fit(pack.transform(filled(train)))
        gain = F.create_map(*(F.lit(v) for c, g in zip(names, model.featureImportances.toArray()) for v in (c, float(g))))
        test = d.filter((F.col("session") >= F.lit(refit)) & (F.col("session") < F.lit(until)))
        out.append(model.transform(pack.transform(filled(test))).select("inst", "session", F.lit(refit).alias("refit"), label, "prediction", gain.alias("importance")))
    if not out:
        return d.limit(0).select("inst", "session", F.col("session").alias("refit"), label, F.lit(0.0).alias("prediction"), F.create_map(F.lit(""), F.lit(0.0)).alias("importance"))
    return reduce(DataFrame.unionByName, out)


def nested_selection(folds: DataFrame, config: str, session_delta: str, penalty: float = 0.25, least: float = 0.002, positive: int = 2) -> DataFrame:
    """Per config: mean and deviation of its deltas over dates, score = mean - penalty * deviation, folds with a positive
    mean, whether it is accepted, and its place among all (ties by name)."""
    by_fold = folds.groupBy(config, "fold").agg(F.avg(session_delta).alias("m")).groupBy(config).agg(F.count(F.when(F.col("m") > 0, 1)).alias("positive_folds"))
    g = folds.groupBy(config).agg(F.avg(session_delta).alias("mean"), F.stddev_pop(session_delta).alias("sd")).join(by_fold, config)
    g = g.withColumn("score", F.col("mean") - penalty * F.col("sd")).withColumn("accepted", (F.col("score") >= least) & (F.col("positive_folds") >= positive))
    return g.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("score"), config)))  # a row a config


def routes(canonical, supported_folds, contradicted_folds, incremental, cost_ok) -> Column:
    """Labels of what the evidence is good for; none excludes another."""
    yes = lambda c: F.coalesce(col(c), F.lit(False))
    return F.array_compact(F.array(
        F.when(~yes(canonical), "duplicate"), F.when(yes(canonical) & (col(supported_folds) >= 2) & (col(contradicted_folds) == 0), "stable_direction"),
        F.when(col(contradicted_folds) > 0, "direction_conflict"), F.when(yes(incremental), "incremental"), F.when(yes(cost_ok) & yes(canonical), "tradable"), F.when(col(supported_folds) == 0, "no_support"),
    ))
