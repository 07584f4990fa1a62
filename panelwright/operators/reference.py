"""Predicates on securities, announcements and records: flags, segments, exceptions and visibility."""
from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Board prefixes of the exchanges, and marks of abnormal status in names.
A_SHARE_PREFIXES = {"SSE": ["6"], "SZSE": ["00", "30"], "BSE": [""]}
SEGMENTS = {
    "SH_MAIN": ["600%.SH", "601%.SH", "603%.SH", "605%.SH"],
    "SZ_MAIN": ["00%.SZ"],
    "CHINEXT": ["300%.SZ", "301%.SZ"],
    "STAR": ["688%.SH", "689%.SH"],
    "BSE": ["%.BJ"],
}
ST_NAME = r"^(S\*ST|\*ST|ST|SST|PT)"
DELISTED_MARK = "退"


def any_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def is_a_share(exchange: Column, symbol: Column) -> Column:
    fits = [(exchange == e) & symbol.startswith(p) for e, ps in A_SHARE_PREFIXES.items() for p in ps]
    return F.coalesce(any_of(fits), F.lit(False))


def in_segments(code: Column, segments: Sequence[str]) -> Column:
    """Whether a code like '600000.SH' is on one of the boards."""
    return any_of([code.like(p) for s in segments for p in SEGMENTS[s]])


def is_st_name(name: Column) -> Column:
    return F.upper(name).rlike(ST_NAME)


def is_abnormal(name: Column, is_st: Column, point_in_time: Column) -> Column:
    """An explicit flag, or a name known at the time with a star, a status mark of its own or the mark of delisting."""
    n = F.regexp_replace(F.upper(F.trim(F.coalesce(name, F.lit("")))), " ", "")
    marked = n.startswith("*") | F.upper(F.trim(F.coalesce(name, F.lit("")))).rlike(ST_NAME + r"(?![A-Z])") | n.contains(DELISTED_MARK)
    return F.coalesce(is_st, F.lit(False)) | (F.coalesce(point_in_time, F.lit(True)) & marked)


def action_available(implemented: Column, implemented_on: Column, announced_on: Column) -> Column:
    return F.when(implemented, implemented_on).otherwise(announced_on)


def pit_exceptions(df: DataFrame, entity: str, period: str, available: str) -> DataFrame:
    """Rows that no point-in-time view may use, with the first reason."""
    reason = F.when(F.col(entity).isNull(), "missing_entity").when(F.col(period).isNull(), "missing_period").when(F.col(available).isNull(), "missing_availability").when(F.col(available) < F.col(period), "available_before_period_end")
    return df.withColumn("reason", reason).filter("reason is not null")


def feature_view(df: DataFrame, domain: str, available: str, cutoff: str) -> DataFrame:
    """Each row with its outcome in a feature's view: label and holdout domains are out of sight, as is what came later."""
    hidden = F.when(F.col(domain) == "label", "label_domain").when(F.col(domain) == "holdout", "holdout_domain")
    return df.withColumn("outcome", F.coalesce(hidden, F.when(F.col(available) > F.lit(cutoff).cast("date"), "after_cutoff"), F.lit("visible")))


def active_versions(df: DataFrame, dispositions: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose version is not registered as superseded or diagnostic."""
    out = dispositions.filter(F.col("disposition").isin("superseded", "diagnostic")).select(*keys).distinct()
    return df.join(out, list(keys), "left_anti")
