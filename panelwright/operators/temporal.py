"""Joins in time, on intervals and with checks of their cardinality; set operations on releases."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .panel import asof_strict


def panel_join(universe: DataFrame, *tables: DataFrame, keys: Sequence[str] = ("session", "inst")) -> DataFrame:
    """The universe with each table's columns where it has a row: equi joins on one key, so one partitioning serves all."""
    out = universe
    for t in tables:
        out = out.join(t, list(keys), "left")
    return out


def checked_join(left: DataFrame, right: DataFrame, keys: Sequence[str], relation: str = "many_to_one", how: str = "inner") -> tuple[DataFrame, DataFrame]:
    """The join, and the keys that break `relation` (side, keys, n). Nothing is dropped: the caller decides."""
    many = {"one_to_one": (left, right), "many_to_one": (None, right), "one_to_many": (left, None)}[relation]
    out = None
    for side, df in zip(("left", "right"), many):
        if df is not None:
            bad = df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1").select(F.lit(side).alias("side"), *keys, "n")
            out = bad if out is None else out.unionByName(bad)
    return left.join(right, list(keys), how), out


def listed_sessions(securities: DataFrame, calendar: DataFrame, key: str = "k") -> DataFrame:
    """(key, session, listed_number) for each open session between list_date and delist_date, both included.

    Each security is spread over the months of its life, so that the join is by month and not a scan of all pairs.
    """
    month = lambda c: F.trunc(c, "month")
    last = calendar.agg(F.max("session").alias("_last"))
    s = securities.filter("list_date is not null").crossJoin(F.broadcast(last)).withColumn("_to", F.coalesce("delist_date", "_last"))
    s = s.filter(F.col("_to") >= F.col("list_date")).withColumn("_month", F.explode(F.sequence(month("list_date"), month("_to"), F.expr("interval 1 month"))))
    x = s.join(calendar.select("session", month("session").alias("_month")), "_month").filter(F.col("session").between(F.col("list_date"), F.col("_to")))
    return x.select(key, "session", F.row_number().over(Window.partitionBy(key).orderBy("session")).alias("listed_number"))


def asof_within(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, value: str, days: int) -> DataFrame:
    """As asof_strict, but NULL where the value is older than `days`."""
    x = asof_strict(left, right, key, left_time, right_time, value)
    fresh = F.datediff(left_time, right_time) <= days
    return x.withColumns({value: F.when(fresh, F.col(value)), right_time: F.when(fresh, F.col(right_time))})


def effective_as_of(df: DataFrame, keys: Sequence[str], cutoff: Column, day: Column, order: Sequence[str]) -> DataFrame:
    """Latest record of each key known at the cutoff (available and ingested), if its valid time holds the day."""
    known = df.filter((F.col("available") <= cutoff) & (F.col("ingested") <= cutoff))
    rn = F.row_number().over(Window.partitionBy(*keys).orderBy(*(F.desc(c) for c in order)))
    last = known.withColumn("_rn", rn).filter("_rn = 1").drop("_rn")
    return last.filter((F.col("valid_from").isNull() | (F.col("valid_from") <= day)) & (F.col("valid_to").isNull() | (F.col("valid_to") >= day)))


def cross_source(df: DataFrame, keys: Sequence[str], source: str, fields: Sequence[str], absolute: float, relative: float) -> DataFrame:
    """Fields in which a source departs from the first source (by name) of the same key: (keys, source, field, base, other)."""
    long = df.unpivot([*keys, source], list(fields), "field", "other")
    w = Window.partitionBy(*keys, "field")
    base = F.min_by("other", source).over(w)
    x = long.withColumns({"base": base, "_first": F.min(source).over(w)}).filter(F.col(source) != F.col("_first")).drop("_first")
    far = F.abs(F.col("base") - F.col("other")) > absolute + relative * F.greatest(F.abs("base"), F.abs("other"))
    return x.filter(far | (F.col("base").isNull() != F.col("other").isNull()))


def frozen_exclusion(df: DataFrame, listed: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Rows that are not listed, and one row of counts: listed, matched and removed must agree."""
    kept = df.join(listed, list(keys), "left_anti")
    counts = listed.agg(F.count("*").alias("listed")).crossJoin(listed.join(df, list(keys), "left_semi").agg(F.count("*").alias("matched"))).crossJoin(df.join(listed, list(keys), "left_semi").agg(F.count("*").alias("removed")))
    return kept, counts


def on_calendar(series: DataFrame, calendar: DataFrame, entity: str) -> tuple[DataFrame, DataFrame]:
    """The series of every entity on all sessions, gaps as NULL, and its rows outside the calendar."""
    grid = series.select(entity).distinct().crossJoin(F.broadcast(calendar.select("session").distinct()))
    return grid.join(series, [entity, "session"], "left"), series.join(calendar.select("session"), "session", "left_anti")


def warmup_start(calendar: DataFrame, day: Column, n: int) -> DataFrame:
    """One row: the n-th session before the day, or the first one there is."""
    return calendar.filter(F.col("session") < day).orderBy(F.desc("session")).limit(n).agg(F.min("session").alias("start"))


def period_ends(calendar: DataFrame, unit: str) -> DataFrame:
    """The last session of each complete month or quarter: one that a later session follows in another period."""
    p = calendar.select("session", F.trunc("session", unit).alias("period"))
    last = p.groupBy("period").agg(F.max("session").alias("session"))
    newest = p.agg(F.max("period").alias("_newest"))
    return last.crossJoin(F.broadcast(newest)).filter(F.col("period") < F.col("_newest")).select("session")


def spaced(df: DataFrame, entity: str, position: str, gap: int) -> DataFrame:
    """The first position of each entity, then greedily the next one at least `gap` later.

    A fold over each entity's ordered positions: one array an entity (a panel has thousands of sessions)."""
    take = lambda acc, p: F.when((F.size(acc) == 0) | (p >= F.try_element_at(acc, F.lit(-1)) + gap), F.concat(acc, F.array(p))).otherwise(acc)
    folded = df.groupBy(entity).agg(F.array_sort(F.collect_set(F.col(position).cast("long"))).alias("_all"))
    return folded.select(entity, F.explode(F.aggregate("_all", F.array().cast("array<bigint>"), take)).alias(position))


def append_extension(old: DataFrame, new: DataFrame, end: Column, time: str = "session") -> DataFrame:
    """Old rows up to `end` and new rows after it; to be called once the overlap has been compared."""
    return old.filter(F.col(time) <= end).unionByName(new.filter(F.col(time) > end))


def cohort(releases: Sequence[DataFrame], least: float) -> tuple[DataFrame, DataFrame]:
    """Releases (session, inst, factor, val) over the sessions that all of them have, and per factor its rows, share of
    values and whether that share reaches `least`; factors below it are left out."""
    all_rows = releases[0]
    for x in releases[1:]:
        all_rows = all_rows.unionByName(x)
    shared = all_rows.groupBy("session").agg(F.count_distinct("factor").alias("_n")).filter(F.col("_n") == len(releases)).select("session")
    inside = all_rows.join(shared, "session", "left_semi")
    cover = inside.groupBy("factor").agg(F.count("*").alias("n"), (F.count("val") / F.count("*")).alias("coverage"))
    cover = cover.withColumn("accepted", F.col("coverage") >= least)
    return inside.join(F.broadcast(cover.filter("accepted").select("factor")), "factor", "left_semi"), cover
