"""Circular moving-block bootstraps: many series, each dealt out in chunks of resamples, as sums over prefix arrays."""
from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Resamples of a bootstrap unless the caller says otherwise, and those that one task's row works on.
RESAMPLES, CHUNK = 10_000, 1000
#: Block starts that are drawn at once inside a task.
CELLS = 1 << 20
#: The draw of a block's start: seed, resample and block number through a 32-bit integer mixer, so that Spark, numpy and SQL
#: draw alike. Fixed values.
STEP_RESAMPLE, STEP_BLOCK, MIXER, MASK = 2654435761, 1013904223, 73244475, 4294967295


def draw(seed: int, resample: np.ndarray, block: np.ndarray) -> np.ndarray:
    """A number below 2^32 for each resample (rows) and block (columns)."""
    x = (seed + resample[:, None] * STEP_RESAMPLE + block[None, :] * STEP_BLOCK) & MASK
    for _ in range(2):
        x = ((x >> 16) ^ x) * MIXER & MASK
    return (x >> 16) ^ x


def seed_of(entity) -> Column:
    """The first 32 bits of the MD5 of an entity's text."""
    text = (F.col(entity) if isinstance(entity, str) else entity).cast("string")
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long")


def _totals(block: int, resamples: int, chunk: int, names: Sequence[str], kind: str):
    fields = f"entity {kind}, n long, b long, " + ", ".join(f"`{c}` double" for c in names)

    def run(batches):
        for batch in batches:
            cols = {n: batch.column(k) for k, n in enumerate(batch.schema.names)}
            for i in range(batch.num_rows):
                n, seed, part = (cols[c][i].as_py() for c in ("n", "seed", "part"))
                values = [cols[f"v{k}"][i].values.to_numpy(zero_copy_only=False) for k in range(len(names))]
                prefix = [np.concatenate([[0.0], np.cumsum(np.concatenate([v, np.resize(v, block)]))]) for v in values]
                k = np.arange(-(-n // block))
                size = np.minimum(block, n - k * block)
                first, last = part * chunk, min((part + 1) * chunk, resamples)
                step = max(1, CELLS // len(k))
                for lo in range(first, last, step):
                    b = np.arange(lo, min(lo + step, last))
                    start = draw(seed, b, k) % n
                    sums = [(p[start + size] - p[start]).sum(axis=1) for p in prefix]
                    entity = pa.array([cols["entity"][i].as_py()] * len(b), batch.schema.field("entity").type)
                    yield pa.RecordBatch.from_arrays([entity, pa.array(np.full(len(b), n)), pa.array(b), *map(pa.array, sums)], names=["entity", "n", "b", *names])

    return run, fields


def block_totals(df: DataFrame, entity: str, time: str, channels: dict[str, Column], block: int, resamples: int = RESAMPLES, chunk: int = CHUNK) -> DataFrame:
    """(entity, n, b, *channels): the total of each channel over each circular moving-block resample b of an entity's rows.

    A resample is ceil(n / block) blocks of consecutive rows in the order of `time`, the last one cut so that n rows are
    taken; blocks run on from the end to the start. Channels must not be NULL. A series travels once a chunk of resamples,
    chunks are dealt over all tasks, and a block costs one difference of prefix sums. An entity without rows gives none.
    """
    names = list(channels)
    items = F.struct(F.col(time).alias("_t"), *(c.cast("double").alias(f"v{k}") for k, c in enumerate(channels.values())))
    s = df.select(F.col(entity).alias("entity"), items.alias("_i")).groupBy("entity").agg(F.array_sort(F.collect_list("_i")).alias("_a"), F.count("*").alias("n"))
    arrays = [F.col(f"_a.v{k}").alias(f"v{k}") for k in range(len(names))]
    parts = F.explode(F.sequence(F.lit(0), F.lit((resamples - 1) // chunk))).alias("part")
    dealt = s.select("entity", "n", seed_of("entity").alias("seed"), *arrays).select("*", parts).repartition("entity", "part")
    run, fields = _totals(block, resamples, chunk, names, df.schema[entity].dataType.simpleString())
    return dealt.mapInArrow(run, fields).withColumnRenamed("entity", entity)


def block_bootstrap(df: DataFrame, entity: str, x: str, time: str, block: int, resamples: int = RESAMPLES, confidence: float = 0.95) -> DataFrame:
    """(entity, n, mean, p, lower, upper) of each entity's mean: p is the share of resampled means at least as far from the
    mean as the mean is from zero (up to a part in 1e9, so that ties count whatever the order of the sums), with one added to
    both counts. Missing values are passed over."""
    has = df.filter(F.col(x).isNotNull())
    drawn = block_totals(has, entity, time, {"total": F.col(x)}, block, resamples)
    mean = has.groupBy(entity).agg(F.avg(x).alias("mean"))
    m = F.col("total") / F.col("n")
    tail = (1 - confidence) / 2
    extreme = F.count(F.when(F.abs(m - F.col("mean")) >= F.abs("mean") * (1 - 1e-9), 1))
    return drawn.join(mean, entity).groupBy(entity).agg(
        F.first("n").alias("n"), F.first("mean").alias("mean"), ((extreme + 1) / (F.count("*") + 1)).alias("p"), F.percentile(m, F.lit(tail)).alias("lower"), F.percentile(m, F.lit(1 - tail)).alias("upper")
    )


def bootstrap_contrast(df: DataFrame, entity: str, x: str, treated: str, control: str, time: str, block: int, resamples: int = 1999, least: int = 30, each: int = 5, share: float = 0.9) -> DataFrame:
    """(entity, observed, draws, lower, upper): mean of x where `treated` less that where `control`, with a block interval.

    Rows with neither, and those without x, keep their place in the blocks. Without `least` rows on both sides there is no
    result (draws 0); a resample counts if it has `each` rows on both, and the interval needs that share of them."""
    side = {s: F.coalesce(F.col(c) & F.col(x).isNotNull(), F.lit(False)) for s, c in (("t", treated), ("c", control))}
    channels = {f"{s}{k}": F.when(on, v).otherwise(0) for s, on in side.items() for k, v in (("n", F.lit(1)), ("sum", F.col(x)))}
    seen = df.groupBy(entity).agg(*(F.sum(c).alias(f"_{k}") for k, c in channels.items()))
    difference = lambda p: F.col(f"{p}tsum") / F.col(f"{p}tn") - F.col(f"{p}csum") / F.col(f"{p}cn")
    seen = seen.withColumn("_ready", F.least("_tn", "_cn") >= least)
    ready = seen.filter("_ready").select(entity, difference("_").alias("_seen"))
    drawn = block_totals(df.join(ready.select(entity), entity, "left_semi"), entity, time, channels, block, resamples)
    drawn = drawn.filter(F.least("tn", "cn") >= each).select(entity, difference("").alias("d"))
    got = drawn.groupBy(entity).agg(F.count("*").alias("_draws"), F.percentile("d", F.lit(0.025)).alias("_lo"), F.percentile("d", F.lit(0.975)).alias("_hi"))
    enough = F.col("_draws") >= resamples * share
    return seen.join(ready, entity, "left").join(got, entity, "left").select(
        entity, F.when(enough, F.col("_seen")).alias("observed"), F.coalesce("_draws", F.lit(0)).alias("draws"), F.when(enough, F.col("_lo")).alias("lower"), F.when(enough, F.col("_hi")).alias("upper")
    )
