"""Reading and writing of tables: alignment by name, content hashes, sorted sinks."""
from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def union_by_name(*tables: DataFrame) -> DataFrame:
    """All rows, columns matched by name; a column that a table lacks is NULL there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def content_hash(columns: list[str]) -> Column:
    """SHA-256 over the named columns as text in the order of their names; NULL differs from the empty text."""
    part = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("~"))
    return F.sha2(F.concat_ws("|", *(part(c) for c in sorted(columns))), 256)


def lineage_hashes(content: list[str], lineage: list[str]) -> dict[str, Column]:
    """Content hash of a row without and with the columns that tell how it was acquired."""
    return {"content": content_hash(content), "with_lineage": content_hash([*content, *lineage])}


def write_sorted(df: DataFrame, path: str, by: list[str], partitions: list[str] | None = None) -> None:
    """Parquet (ZSTD) whose files hold ranges of `by`, sorted inside."""
    keys = [*(partitions or []), *by]
    out = df.repartitionByRange(*keys).sortWithinPartitions(*keys).write.option("compression", "zstd").mode("overwrite")
    (out.partitionBy(*partitions) if partitions else out).parquet(path)


_OWN: dict = {}


def scratch(spark: SparkSession) -> str:
    """A new folder below the session's spark.checkpoint.dir, which driver and executors share; a local one of our own
    only where that is unset and the master is local."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        top = "file://" + _OWN.setdefault("dir", tempfile.mkdtemp(prefix="panel-"))
    return f"{top}/panel/{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """df, written to the shared folder and read again: its lineage is cut, and lost executors cost nothing."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_panel(df: DataFrame, path: str, day: str) -> None:
    """Parquet by year and month of `day`, each month written by few tasks."""
    out = df.withColumn("year", F.year(day)).withColumn("month", F.month(day))
    out.repartition("year", "month").write.option("compression", "zstd").partitionBy("year", "month").parquet(path)


def scan_panel(spark: SparkSession, path: str, years: Sequence[int] | None = None) -> DataFrame:
    """The rows of a panel in month folders, without the folder columns; `years` leaves other folders unread."""
    df = spark.read.parquet(path)
    return (df.filter(F.col("year").isin(*years)) if years else df).drop("year", "month")
