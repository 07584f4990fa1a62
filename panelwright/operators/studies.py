"""Studies of many signals, horizons and targets as one family of hypotheses: each series is dealt to a task by its key."""
from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .regression import hac_regression
from .research import holm

KEY = ("signal", "horizon", "target")


def long_study(signals: DataFrame, names: Sequence[str], outcomes: DataFrame, targets: Sequence[str], on: Sequence[str] = ("session",)) -> DataFrame:
    """(signal, horizon, target, *on, x, y): every signal of a row against every outcome of its horizons; missing values stay,
    as they keep their place in the calendar. outcomes: (*on, horizon, *targets)."""
    x = signals.unpivot(list(on), list(names), "signal", "x")
    y = outcomes.unpivot([*on, "horizon"], list(targets), "target", "y")
    return x.join(y, list(on))


def rank_correlation(study: DataFrame) -> DataFrame:
    """(signal, horizon, target, spearman) over rows with both values, ties by their mean rank; NULL below three rows or
    without variation."""
    both = study.filter(F.col("x").isNotNull() & F.col("y").isNotNull())

    def rank(c):
        return F.rank().over(Window.partitionBy(*KEY).orderBy(c)) + (F.count("*").over(Window.partitionBy(*KEY, c)) - 1) / 2

    r = both.select(*KEY, rank("x").alias("_x"), rank("y").alias("_y"))
    varies = (F.count("*") >= 3) & (F.var_pop("_x") > 0) & (F.var_pop("_y") > 0)
    return r.groupBy(*KEY).agg(F.when(varies, F.covar_pop("_x", "_y") / F.sqrt(F.var_pop("_x") * F.var_pop("_y"))).alias("spearman"))


def study_tests(study: DataFrame, horizons: Sequence[int], more_lags: int = 20, least: int = 80, time: str = "session", prior: DataFrame | None = None) -> DataFrame:
    """One row a hypothesis: rank correlation and the regression with year levels (errors over horizon + more_lags rows), its
    p adjusted by Holm over the study (`local_p`) and over the study and the p of earlier ones (`joint_p`; prior: p).

    A hypothesis that could not be estimated stays in the family with p = 1."""
    key = F.concat_ws("/", *KEY)
    fits = [hac_regression(study.filter(F.col("horizon") == h).withColumn("_key", key), "_key", "y", "x", time, h + more_lags, least) for h in horizons]
    part = F.split("_key", "/")
    fit = reduce(DataFrame.unionByName, fits).select(part[0].alias("signal"), part[1].cast("int").alias("horizon"), part[2].alias("target"), "n", "beta", "se", "t", "p", "status")
    tests = fit.join(rank_correlation(study), list(KEY), "left").withColumn("_new", F.lit(True))
    family = tests if prior is None else tests.unionByName(prior.select("p", F.lit(False).alias("_new")), allowMissingColumns=True)
    joint = holm(family.withColumn("_all", F.lit(1)), "p", "_all").filter("_new").withColumnRenamed("adjusted", "joint_p")
    return holm(joint, "p", "_all").withColumnRenamed("adjusted", "local_p").drop("_all", "_new")


def contained_buckets(rows: DataFrame, by: Sequence[str], x: str, y: str, first_half: str, leaves: str, time: str = "session", quantiles: Sequence[float] = (0.2, 0.4, 0.6, 0.8)) -> DataFrame:
    """(*by, half, bucket, n, mean, median, win, worst) of y: bucket 1.. of x by the distinct cutpoints of the first half
    (values at a cutpoint lie above it), for rows whose outcome ends within the year of their signal."""
    cuts = rows.filter(F.col(first_half)).groupBy(*by).agg(F.array_distinct(F.percentile(x, F.array(*map(F.lit, quantiles)))).alias("_cuts"))
    d = rows.join(F.broadcast(cuts), list(by)).filter(F.col(x).isNotNull() & F.col(y).isNotNull() & (F.year(leaves) <= F.year(time)))
    d = d.withColumn("bucket", 1 + F.size(F.filter("_cuts", lambda c: c <= F.col(x)))).withColumn("half", F.when(F.col(first_half), 1).otherwise(2))
    return d.groupBy(*by, "half", "bucket").agg(F.count("*").alias("n"), F.avg(y).alias("mean"), F.median(y).alias("median"), F.avg((F.col(y) > 0).cast("double")).alias("win"), F.min(y).alias("worst"))


def event_study(anchors: DataFrame, outcomes: DataFrame, on: Sequence[str], horizon: str, y: str, order: str, lags: int) -> DataFrame:
    """(horizon, n, mean, median, win, worst, t, p, holm_p): outcomes after the anchors, each horizon tested by Newey-West over
    the anchors in their order, all horizons one family."""
    from .evidence import mean_test

    j = anchors.join(outcomes, list(on)).filter(F.col(y).isNotNull())
    sums = j.groupBy(horizon).agg(F.median(y).alias("median"), F.avg((F.col(y) > 0).cast("double")).alias("win"), F.min(y).alias("worst"))
    tests = holm(mean_test(j, horizon, y, order, lags).withColumn("_all", F.lit(1)), "p", "_all").withColumnRenamed("adjusted", "holm_p")
    return tests.drop("_all", "se").join(sums, horizon)
