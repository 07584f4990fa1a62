"""Interval joins by a sweep: the intervals of a key become segments with one winner each, and probes read them as of their time."""
from __future__ import annotations

from collections.abc import Sequence
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Sides of a boundary: it holds at its time, or only after it. Probes stand between the two.
AT, PROBE, AFTER = 0, 1, 2


def _sweep(batches):
    """(row of a boundary, winner after it) from boundaries in the order of key and time; the heap holds open intervals, and
    a closed one leaves when it comes to the top."""
    place, heap, gone, told = None, [], set(), None

    def winner():
        while heap and heap[0] in gone:
            gone.discard(heappop(heap))
        return heap[0] if heap else None

    out: list = []
    for batch in batches:
        names = batch.schema.names
        keys, at, side, rank, opens = (batch.column(names.index(c)).to_pylist() for c in ("key", "at", "side", "rank", "opens"))
        for row in zip(keys, at, side, rank, opens):
            here = row[:3]
            if here != place:
                if place is not None and (now := winner()) != told:
                    out.append((*place, now))
                    told = now
                if place is None or here[0] != place[0]:
                    heap.clear()
                    gone.clear()
                    told = None
                place = here
            if row[4]:
                heappush(heap, row[3])
            else:
                gone.add(row[3])
        yield _segments(out, batch.schema)
        out = []
        schema = batch.schema
    if place is not None and (now := winner()) != told:
        yield _segments([(*place, now)], schema)


def _segments(rows: list, schema: pa.Schema) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, schema.field(n).type) for c, n in zip(cols, ("key", "at", "side", "rank"))], names=["key", "at", "side", "rank"])


def winning_segments(intervals: DataFrame, key: str, start: str, stop: str, order: Sequence[Column], closed: bool = False, open_start: bool = False) -> DataFrame:
    """(key, at, side, rank) where the winner of a key changes: the open interval that is first by `order` (rank, NULL: none).

    Each interval enters and leaves a heap once. A key has at most two segments an interval, however many probes it gets."""
    ranked = intervals.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    begun = F.col(stop).isNull() | (F.col(stop) >= F.col(start) if closed and not open_start else F.col(stop) > F.col(start))
    edge = lambda c, after, opens: F.struct(F.col(c).alias("at"), F.lit(AFTER if after else AT).alias("side"), F.lit(opens).alias("opens"))
    edges = ranked.filter(F.col(key).isNotNull() & F.col(start).isNotNull() & begun)
    edges = edges.select(F.col(key).alias("key"), "rank", F.explode(F.array(edge(start, open_start, True), edge(stop, closed, False))).alias("e")).select("key", "e.at", "e.side", "rank", "e.opens")
    kind = {f.name: f.dataType.simpleString() for f in edges.schema.fields}
    line = edges.filter("at is not null").repartition("key").sortWithinPartitions("key", "at", "side")
    return line.mapInArrow(_sweep, f"key {kind['key']}, at {kind['at']}, side int, rank int")


def interval_latest(left: DataFrame, intervals: DataFrame, key: str, time: str, start: str, stop: str, values: Sequence[str], order: Sequence[Column], closed: bool = False, open_start: bool = False) -> DataFrame:
    """left with `values` of the interval that holds its time, the first by `order`; repeated left rows stay.

    [start, stop) or, if closed, [start, stop]; open_start leaves the start out. A NULL stop never ends; a NULL start never
    begins; a NULL key or time is in none. No left row meets an interval: both sides meet in one union and one window.
    """
    ranked = intervals.select(F.col(key).alias("key"), F.row_number().over(Window.partitionBy(key).orderBy(*order)).alias("rank"), *(F.col(c).alias(f"_v{i}") for i, c in enumerate(values)))
    won = winning_segments(intervals, key, start, stop, order, closed, open_start).join(ranked, ["key", "rank"], "left")
    value = F.struct(F.lit(True).alias("_is"), *(F.col(f"_v{i}") for i in range(len(values))))
    b = won.select(F.col("key").alias("_k"), F.col("at").alias("_t"), F.col("side").alias("_side"), value.alias("_v"))
    a = left.select(F.col(key).alias("_k"), F.col(time).alias("_t"), F.lit(PROBE).alias("_side"), F.lit(None).cast(b.schema["_v"].dataType).alias("_v"), F.struct(*(F.col(f"`{c}`") for c in left.columns)).alias("_row"))
    w = Window.partitionBy("_k").orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    x = a.unionByName(b, allowMissingColumns=True).withColumn("_last", F.last("_v", ignorenulls=True).over(w)).filter("_row is not null")
    known = F.col("_k").isNotNull() & F.col("_t").isNotNull()
    return x.select("_row.*", *(F.when(known, F.col(f"_last._v{i}")).alias(c) for i, c in enumerate(values)))
