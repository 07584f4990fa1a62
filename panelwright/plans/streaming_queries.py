"""Queries of the streams, each run over files of a given table until all is read, with the batch answer as SQL."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import tables as T
from ..sources.fixture import bars
from ..streaming import panel as S
from .base import ORACLES, panel, r
from .evidence_queries import SWITCH_RULE, SWITCH_SQL, book_scores
from .research_queries import _FACTS, facts, table


_ROWS_A_FILE = 250_000


def replay(df: DataFrame, parts: int, by: Column, closing: DataFrame | None = None) -> DataFrame:
    """A table as the batches of a stream, one after another in the order of the number `by`; `closing` comes last, in a file
    of its own, to move the watermark past all rows. A batch is one file, or on large tables the same number of files each."""
    path = T.scratch(df.sparkSession)
    rows = T.written(df.withColumn("_by", by))
    lo, hi = rows.agg(F.min("_by"), F.max("_by")).first()
    place = F.floor((F.col("_by") - lo) * parts / (hi - lo + 1))
    least = min(rows.agg(*(F.count_if(place == k) for k in range(parts))).first())
    # Dealt in turn by each task, a part has rows for each of its files if it has more rows than tasks times files; so no
    # file is left out and none slips into another batch.
    files = max(1, least // max(_ROWS_A_FILE, rows.rdd.getNumPartitions()))
    for k in range(parts):
        part = rows.filter(place == k).drop("_by")
        (part.coalesce(1) if files == 1 else part.repartition(files)).write.mode("append").parquet(path)
    if closing is not None:
        closing.coalesce(1).write.mode("append").parquet(path)
    return S.read_bars(df.sparkSession, path, df.schema, files)


@table("k1_stream_pit_latest", f"with {_FACTS} select inst * 100000 + cast(year(period_end) * 10 + quarter(period_end) as bigint) as key, arg_max(k, row(available, k, value)) k, max(available) available from facts group by 1", ("available",), False)
def k1(spark, sf_dir):
    """Facts come in by the day of their ingestion, some weeks after they were available, and out of order within it."""
    f = facts(spark, sf_dir).select((F.col("inst") * 100000 + F.year("period_end") * 10 + F.quarter("period_end")).cast("long").alias("key"), F.col("available").cast("string").alias("available"), "k", "value", F.date_add("available", (F.col("k") % 20).cast("int")).alias("ingested"))
    late = f.agg(F.max("ingested").alias("d")).first().d
    closing = spark.createDataFrame([(-1, "9000-01-01", 0, 0.0)], "key long, available string, k long, value double").select("key", "available", F.col("k").cast(f.schema["k"].dataType), F.col("value").cast(f.schema["value"].dataType), F.date_add(F.lit(late), 400).alias("ingested"))
    stream = replay(f, 4, F.unix_date("ingested") + F.col("k") % 15, closing)
    order, path = ["available", "k", "value"], T.scratch(spark)
    changes = S.latest_known(stream, "key", order, "available", "ingested", "60 days", 365)
    S.upsert(changes, path)
    return S.upserted(spark, path, changes.schema, "key", order).select("key", "k", F.to_date("available").alias("available"))


@table("k3_stream_bar_quality", "select inst, session, coalesce(high >= greatest(open, close, low) and low <= least(open, close), false) valid_ohlc, coalesce(high >= greatest(open, close, low) and low <= least(open, close) and volume > 0, false) tradeable, round(close, 4) + 0.0 close from bars", ("session",))
def k3(spark, sf_dir):
    b = bars(spark, sf_dir).select("inst", "session", F.col("session").cast("timestamp").alias("at"), "open", "high", "low", "close", "volume", "seq")
    twice = b.withColumn("n", F.lit(0)).unionByName(b.filter("seq % 10 = 0").withColumn("n", F.lit(1)))  # a repeated bar comes a session later
    stream = replay(twice, 4, F.col("seq") + F.col("n"))
    return S.drain(S.bar_quality(stream.drop("seq", "n"), ["inst", "session"], "at", "28 days"), T.scratch(spark)).select("inst", "session", "valid_ohlc", "tradeable", r("close", 4).alias("close"))


@panel("k2_stream_hysteresis", SWITCH_SQL, ())
def k2(df):
    """Scores of five books in files that are out of order by up to nine sessions; the last file closes the stream."""
    spark = df.sparkSession
    scores = book_scores(df, "session").withColumn("at", F.col("session").cast("timestamp")).drop("session")
    last = scores.agg(F.max("at").alias("at"), F.max("seq").alias("seq"))
    closing = last.select(F.lit("").alias("book"), (F.col("seq") + 99).cast("int").alias("seq"), F.create_map(F.lit("x"), F.lit(0.0), F.lit("y"), F.lit(0.0)).alias("scores"), (F.col("at") + F.expr("interval 600 days")).alias("at"))
    stream = replay(scores, 4, F.col("seq") + F.pmod(F.hash("book", "seq"), F.lit(9)), closing.select(*scores.columns))
    out = S.drain(S.switches(stream, SWITCH_RULE, "at", "90 days", 400), T.scratch(spark))
    return out.select("book", "seq", "leader", r("lead").alias("lead"), "held", "switched", "reason")


__all__ = ["ORACLES"]
