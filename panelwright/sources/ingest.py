"""Decoding of archived payloads and normalisation of vendor rows, as DataFrame functions."""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def decode_payloads(df: DataFrame, payload: str, item: str, day: str) -> DataFrame:
    """Rows of JSON payloads {"day", "n", "items"} archived under the date `day`, one row an item, with `status`.

    A payload whose row count or date does not fit, or which does not parse, gives one row without an item and the reason.
    """
    p = df.withColumn("_p", F.from_json(payload, f"day string, n long, items array<{item}>"))
    size = F.coalesce(F.size("_p.items"), F.lit(-1))
    status = F.when(F.col("_p.items").isNull(), "unreadable").when(size != F.col("_p.n"), "row_count").when(F.to_date("_p.day", "yyyyMMdd") != F.col(day), "partition_date").otherwise("ok")
    p = p.withColumn("status", status)
    return p.withColumn("item", F.explode_outer(F.when(F.col("status") == "ok", F.col("_p.items")))).drop("_p", payload)


def normalize_types(df: DataFrame, dates: Sequence[str], numbers: Sequence[str]) -> DataFrame:
    """Text columns as dates (yyyyMMdd) and doubles; blank and unreadable text is NULL."""
    day = lambda c: F.try_to_timestamp(F.nullif(F.trim(c), F.lit("")), F.lit("yyyyMMdd")).cast("date")
    return df.withColumns({c: day(F.col(c)) for c in dates} | {c: F.trim(F.col(c)).try_cast("double") for c in numbers})


def exchange_code(raw: Column) -> Column:
    """'sh.600000', 'sz000001' or '600000.SH' as '600000.SH'."""
    mark = F.upper(F.regexp_extract(raw, r"(?i)(sh|sz|bj)", 1))
    return F.concat(F.regexp_extract(raw, r"(\d{6})", 1), F.lit("."), mark)


def vendor_bars(df: DataFrame, code: str, volume: Column, session: str) -> DataFrame:
    """A vendor's bars as (code, session, shares, closed_at): one select for each vendor, joined by union."""
    return df.select(exchange_code(F.col(code)).alias("code"), F.col(session).alias("session"), volume.cast("double").alias("shares"), (F.col(session).cast("timestamp_ntz") + F.expr("interval 15 hours")).alias("closed_at"))


def report_metrics(df: DataFrame, names: Mapping[str, str], bounds: Mapping[str, tuple[float, float]], ordered: Sequence[tuple[str, str]] = ()) -> DataFrame:
    """Vendor metrics under their own names, '--' as NULL, and the quality flags of each row.

    bounds: lowest and highest sound value of a metric. ordered: pairs of which the first may not exceed the second.
    """
    values = {new: F.nullif(F.trim(F.col(old)), F.lit("--")).try_cast("double") for old, new in names.items()}
    out = df.withColumns(values)
    flags = [F.when(~F.col(c).between(lo, hi), F.lit(f"{c}_out_of_range")) for c, (lo, hi) in bounds.items()]
    flags += [F.when(F.col(a) > F.col(b), F.lit(f"{a}_above_{b}")) for a, b in ordered]
    return out.withColumn("flags", F.array_compact(F.array(*flags)))


def canonical_json(values: Column) -> Column:
    """A map as JSON with its keys in order."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(values))))


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of both; where a key is in both, the new row."""
    both = old.withColumn("_age", F.lit(1)).unionByName(new.withColumn("_age", F.lit(0)))
    first = F.row_number().over(Window.partitionBy(*keys).orderBy("_age"))
    return both.withColumn("_rn", first).filter("_rn = 1").drop("_rn", "_age")


def input_cut(df: DataFrame, keys: Sequence[str], available: str, period: str, value: str, cutoff: Column, last_period: Column) -> DataFrame:
    """One row: rows kept by the information cutoff and the last report period, rows that each leaves out, repeated keys
    and values that are missing or not finite among the kept."""
    late, beyond = F.col(available) > cutoff, F.col(period) > last_period
    kept = ~late & ~beyond
    x = df.select(*keys, value, late.alias("late"), (beyond & ~late).alias("beyond"), kept.alias("kept"))
    by_key = x.groupBy(*keys).agg(F.count(F.when(F.col("late"), 1)).alias("late"), F.count(F.when(F.col("beyond"), 1)).alias("beyond"), F.count(F.when(F.col("kept"), 1)).alias("kept"), F.count(F.when(F.col("kept") & (F.col(value).isNull() | F.isnan(value) | (F.abs(value) == float("inf"))), 1)).alias("bad"))
    return by_key.agg(F.sum("kept").alias("kept"), F.sum("late").alias("late"), F.sum("beyond").alias("beyond"), F.sum(F.greatest(F.col("kept") - 1, F.lit(0))).alias("repeated_keys"), F.sum("bad").alias("not_finite"))
