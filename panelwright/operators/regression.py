"""Regressions and partial correlations as aggregates and eliminations over columns, all inside the JVM."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def conditional_rank_ic(wide: DataFrame, candidate: str, label: str, controls: Sequence[str], ridge: float = 1e-8, least: int = 10) -> DataFrame:
    """Per session, from the correlations of rows that have all columns: raw, semi-partial and partial correlation of
    candidate and label given the controls, and the share of the label that controls alone and with the candidate explain.

    One aggregate gives the correlation matrix in the order controls, candidate, label. Eliminating the controls one by
    one (the Schur complement) leaves what they do not explain of candidate and label: their remaining variances and
    covariance are all that the results need. The controls' diagonal carries the ridge. Sessions with fewer than `least`
    rows or a column that does not vary give none.
    """
    order = [*controls, candidate, label]
    size, last = len(order), len(order) - 1
    pairs = [(i, j) for i in range(size) for j in range(i, size)]
    m = lambda i, j: F.col(f"m{min(i, j)}_{max(i, j)}")
    has = wide.filter(" and ".join(f"`{c}` is not null" for c in order))
    s = has.groupBy("session").agg(F.count("*").alias("n"), *(F.covar_pop(order[i], order[j]).alias(f"m{i}_{j}") for i, j in pairs))
    s = s.filter((F.col("n") >= least) & (F.least(*(m(i, i) for i in range(size))) > 1e-24))
    corr = [(m(i, j) / F.sqrt(m(i, i) * m(j, j)) if i != j else F.lit(1 + ridge if i < size - 2 else 1.0)).alias(f"m{i}_{j}") for i, j in pairs]
    s = s.select("session", "n", *corr)
    s = s.withColumn("raw", m(last - 1, last))
    for p in range(size - 2):
        left = [(i, j) for i, j in pairs if i > p]
        s = s.select("session", "n", "raw", *((m(i, j) - m(p, i) * m(p, j) / m(p, p)).alias(f"m{i}_{j}") for i, j in left))
    inside = lambda x, lo: F.greatest(F.lit(lo), F.least(F.lit(1.0), x))
    own, rest, cov = F.greatest(F.lit(ridge), m(last - 1, last - 1)), F.greatest(F.lit(ridge), m(last, last)), m(last - 1, last)
    base = inside(1 - m(last, last), 0.0)
    full = inside(base + cov * cov / own, 0.0)
    return s.select(
        "session", "n", "raw", inside(cov / F.sqrt(own), -1.0).alias("semi_partial"), inside(cov / F.sqrt(own * rest), -1.0).alias("partial"),
        base.alias("baseline_r2"), full.alias("full_r2"), (full - base).alias("incremental_r2"),
    )


def hac_regression(df: DataFrame, group: str, y: str, x: str, time: str, lags: int, least: int = 80, each: int = 0) -> DataFrame:
    """Slope of y on x with a level for each year: (group, n, beta, se, t, p, lower, upper, status).

    Taking the year's means from x and y leaves the slope of the whole regression, and its score is the remaining x times
    the residual. The variance is the Bartlett sum of the products of scores up to `lags` rows apart, over the squared sum
    of squares of x, times n / (n - number of coefficients). Rows without x or y keep their place with score 0.

    status: `insufficient` with fewer than `least` complete rows (or, if `each` is given, fewer than that at x = 0 or at
    x = 1), `no_within_year_variation`, else `estimated`; only the last has figures. A group is the series of one signal,
    horizon and target: groups spread over tasks.
    """
    has = F.col(x).isNotNull() & F.col(y).isNotNull()
    year, own = Window.partitionBy(group, "_year"), Window.partitionBy(group)
    d = df.select(group, F.col(time).alias("_time"), F.year(time).alias("_year"), F.when(has, F.col(x).cast("double")).alias("_x"), F.when(has, F.col(y).cast("double")).alias("_y"))
    d = d.withColumns({"_u": F.col("_x") - F.avg("_x").over(year), "_v": F.col("_y") - F.avg("_y").over(year)})
    d = d.withColumns({"_uu": F.sum(F.col("_u") * F.col("_u")).over(own), "_uv": F.sum(F.col("_u") * F.col("_v")).over(own), "_xx": F.sum(F.col("_x") * F.col("_x")).over(own)})
    varies = F.col("_uu") > 1e-12 * F.col("_xx")
    d = d.withColumn("_beta", F.when(varies, F.col("_uv") / F.col("_uu")))
    d = d.withColumn("_score", F.coalesce(F.col("_u") * (F.col("_v") - F.col("_beta") * F.col("_u")), F.lit(0.0)))
    line = own.orderBy("_time")
    near = sum(((1 - k / (lags + 1)) * F.coalesce(F.lag("_score", k).over(line), F.lit(0.0)) for k in range(1, lags + 1)), F.lit(0.0))
    d = d.withColumn("_meat", F.col("_score") * (F.col("_score") + 2 * near))
    n = F.count("_x")
    g = d.groupBy(group).agg(
        n.alias("n"), F.count_distinct(F.when(F.col("_x").isNotNull(), F.col("_year"))).alias("_years"), F.first("_beta", ignorenulls=True).alias("_b"), F.sum("_meat").alias("_m"), F.first("_uu", ignorenulls=True).alias("_s"),
        F.count(F.when(F.col("_x") == 0, 1)).alias("_zero"), F.count(F.when(F.col("_x") == 1, 1)).alias("_one"),
    )
    few = (F.col("n") < least) | (F.least("_zero", "_one") < each)
    status = F.when(few, "insufficient").when(F.col("_b").isNull() | (F.col("n") <= F.col("_years") + 1), "no_within_year_variation").otherwise("estimated")
    g = g.withColumn("status", status)
    ok = F.col("status") == "estimated"
    se = F.sqrt(F.greatest(F.col("_m"), F.lit(0.0)) * F.col("n") / (F.col("n") - F.col("_years") - 1)) / F.col("_s")
    g = g.select(group, "n", F.when(ok, F.col("_b")).alias("beta"), F.when(ok, se).alias("se"), "status")
    from .evidence import two_sided_p

    t = F.col("beta") / F.nullif("se", F.lit(0.0))
    p = F.when(F.col("se") > 0, two_sided_p(t)).when(F.abs("beta") < 1e-12, 1.0).when(F.col("se") == 0, 0.0)
    return g.select(group, "n", "beta", "se", t.alias("t"), p.alias("p"), (F.col("beta") - 1.96 * F.col("se")).alias("lower"), (F.col("beta") + 1.96 * F.col("se")).alias("upper"), "status")
