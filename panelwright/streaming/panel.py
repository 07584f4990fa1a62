"""Streams of records and bars: latest known record, quality flags and confirmed switches, as Structured Streaming jobs.

State is keyed, typed and bounded: rows wait until the watermark passes their time and are then worked on in order, so files
that come late or in any order (within the delay) give the batch answer; what no longer changes is dropped.
"""
from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.switching import Book, Rule, advance, leaders

DAY_MS = 86_400_000
_NEVER = 2**63 - 1
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def read_bars(spark: SparkSession, path: str, schema, files_at_once: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(path)


def _ms(c: str):
    return F.unix_millis(F.col(c).cast("timestamp"))


# ---- latest known record


class LatestKnown(StatefulProcessor):
    """Per key: the best record that is known, and those that will replace it once they are known. A record is known once its
    `known` time (available and ingested) has passed; it is emitted when it is better than the best one so far. One that is
    known no earlier than a better one never counts and is dropped as it comes, so the state holds one record for a known
    time at most, and one timer for the first of them. A key without news for `keep` ms is dropped; the sink holds its record
    and keeps the better one should an old one come later."""

    def __init__(self, fields: str, key: str, columns: Sequence[str], order: Sequence[str], keep: int):
        self.fields, self.key, self.columns, self.order, self.keep = fields, key, list(columns), list(order), keep
        self.places = [self.columns.index(c) for c in order]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.best = handle.getValueState("best", self.fields + ", known_ms long")
        self.waiting = handle.getListState("waiting", self.fields + ", known_ms long")

    def _rank(self, record):
        return tuple(record[k] for k in self.places)

    def _counting(self, x: pd.DataFrame) -> pd.DataFrame:
        """The rows that are known before all better ones, best first."""
        x = x.sort_values([*self.order, "known_ms"], ascending=[False] * len(self.order) + [True])
        return x[x["known_ms"] < x["known_ms"].cummin().shift(fill_value=_NEVER)]

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = self._counting(pd.concat([self._counting(frame[[*self.columns, "known_ms"]]) for frame in rows]))
        best, held = self.best.get(), [tuple(r) for r in self.waiting.get()]
        records = [tuple(x.item() if hasattr(x, "item") else x for x in r) for r in new.itertuples(index=False, name=None)]
        waiting = []
        for record in sorted(sorted(held + records, key=self._rank, reverse=True), key=lambda r: r[-1]):
            if all(self._rank(record) > self._rank(r) for r in (best, waiting[-1] if waiting else None) if r is not None):
                waiting.append(record)
        if waiting != held:
            self.waiting.put(waiting)
            self.handle.registerTimer(waiting[0][-1])
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        best, held = self.best.get(), [tuple(r) for r in self.waiting.get()]
        known, waiting = [r for r in held if r[-1] <= now], [r for r in held if r[-1] > now]
        if known:
            if waiting:
                self.waiting.put(waiting)
                self.handle.registerTimer(waiting[0][-1])
            else:
                self.waiting.clear()
            best = known[-1]
            self.best.update(best)
            self.handle.registerTimer(best[-1] + self.keep)
            yield pd.DataFrame([(*key, *best[:-1])], columns=[self.key, *self.columns])
        elif best is not None and best[-1] + self.keep <= now and not waiting:
            self.best.clear()

    def close(self) -> None:
        pass


def _best_of(group: Sequence[str], order: Sequence[str], most: int = 200_000):
    """Of the rows of a task that agree in `group`, the best one by `order`, in rounds of `most` rows."""

    def best(tables: list[pa.Table]) -> pa.Table:
        x = pa.concat_tables(tables).sort_by([(c, "descending") for c in order])  # nulls come last
        first = x.select(list(group)).append_column("_i", pa.array(range(len(x)), pa.int64())).group_by(list(group)).aggregate([("_i", "min")])
        return x.take(first["_i_min"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            held.append(pa.Table.from_batches([b]))
            n += b.num_rows
            if n >= most:
                held = [best(held)]
                n = len(held[0])
                if n > most // 2:  # too many different ones to hold
                    yield from held[0].to_batches()
                    held, n = [], 0
        if n:
            yield from best(held).to_batches()

    return run


def latest_known(df: DataFrame, key: str, order: Sequence[str], available: str, ingested: str, delay: str, keep_days: int) -> DataFrame:
    """Changes of the latest known record of each key of a stream: a row whenever a better one, by `order`, becomes known.

    A record counts from the later of its two times on. Rows may come late by `delay` of their ingestion. order: columns of
    the record, largest last one wins. To be written by `upsert`."""
    columns = [c for c in df.columns if c not in (key, ingested)]
    fields = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in columns)
    x = df.withColumn("_at", F.col(ingested).cast("timestamp")).withColumn("known_ms", F.greatest(_ms(available), _ms(ingested))).select(key, "_at", "known_ms", *columns)
    # Rows with the same times are late or known together, so each task sends on only the best of them.
    x = x.mapInArrow(_best_of([key, "_at", "known_ms"], order), x.schema).withWatermark("_at", delay)
    run = LatestKnown(fields, key, columns, order, keep_days * DAY_MS)
    return x.groupBy(key).transformWithStateInPandas(run, f"{key} {df.schema[key].dataType.simpleString()}, {fields}", "Update", "EventTime")


def upsert(stream: DataFrame, path: str):
    """Run a stream of changes over all that is there; each batch writes its changed keys to a folder of its number, so a
    batch that runs twice leaves the same rows. Returns the ended query with its progress."""
    return _start(stream.writeStream.outputMode("update").foreachBatch(lambda rows, n: rows.write.mode("overwrite").parquet(f"{path}/changes/batch={n:06d}")), path, stream.sparkSession)


def upserted(spark: SparkSession, path: str, schema, key: str, order: Sequence[str]) -> DataFrame:
    """The table that the changes make: the best record of each key by `order`."""
    rows = spark.read.schema(schema).parquet(f"{path}/changes/batch=*")
    best = F.max_by(F.struct(*(c for c in rows.columns if c != key)), F.struct(*order))
    return rows.groupBy(key).agg(best.alias("_r")).select(key, "_r.*")


# ---- bars


def bar_quality(df: DataFrame, keys: list[str], time: str, delay: str = "14 days") -> DataFrame:
    """Bars with their flags, a repeated key within the delay only once (on a stream; on a batch, once)."""
    ok = (F.col("high") >= F.greatest("open", "close", "low")) & (F.col("low") <= F.least("open", "close"))
    out = df.withColumn("valid_ohlc", F.coalesce(ok, F.lit(False))).withColumn("tradeable", F.coalesce(ok & (F.col("volume") > 0), F.lit(False)))
    return out.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys) if df.isStreaming else out.dropDuplicates(keys)


# ---- confirmed switches


class Switches(StatefulProcessor):
    """Per book: periods that wait for their time, and the state of the switch rule. A book without periods for `idle` ms
    starts anew, whether its state was dropped by then or not."""

    def __init__(self, rule: Rule, idle: int):
        self.rule, self.idle = rule, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "seq int", "at long, leader string, lead double")
        self.book = handle.getValueState("book", "held string, rival string, streak int, age int, last long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for frame in rows:
            for seq, at, leader, lead in zip(frame.seq.tolist(), frame["at_ms"].tolist(), frame.leader.tolist(), frame.lead.tolist()):
                self.waiting.updateValue((seq,), (at, leader, lead))
                self.handle.registerTimer(at)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        due = sorted((v[0], k[0], v[1], v[2]) for k, v in self.waiting.iterator() if v[0] <= now)
        state = tuple(self.book.get()) if self.book.exists() else None
        if due:
            book, last, out = Book(*state[:4]) if state else Book(), state[4] if state else None, []
            for at, seq, leader, lead in due:
                if last is not None and at - last >= self.idle:
                    book = Book()
                last = at
                book, switched, reason = advance(book, leader, lead, self.rule)
                out.append((*key, seq, leader, lead, book.held, switched, reason))
                self.waiting.removeKey((seq,))
            self.book.update((*book, due[-1][0]))
            self.handle.registerTimer(due[-1][0] + self.idle)
            yield pd.DataFrame(out, columns=["book", "seq", "leader", "lead", "held", "switched", "reason"])
        elif state and state[4] + self.idle <= now and not any(True for _ in self.waiting.keys()):
            self.book.clear()

    def close(self) -> None:
        pass


def switches(df: DataFrame, rule: Rule, time: str, delay: str, idle_days: int) -> DataFrame:
    """(book, seq, leader, lead, held, switched, reason) of a stream (book, seq, scores, time), each period once the
    watermark has passed it: the answer of operators.switching.switches for rows late by no more than `delay`."""
    x = leaders(df).withColumn("_at", F.col(time).cast("timestamp")).withWatermark("_at", delay)
    x = x.select("book", F.col("seq").cast("int").alias("seq"), "_at", _ms("_at").alias("at_ms"), "leader", F.col("lead").cast("double").alias("lead"))
    return x.groupBy("book").transformWithStateInPandas(Switches(rule, idle_days * DAY_MS), "book string, seq int, leader string, lead double, held string, switched boolean, reason string", "Append", "EventTime")


# ---- running


def _start(writer, path: str, spark: SparkSession):
    """Run a stream to the end of what is there, its state in the key-value store that typed state needs."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        q = writer.option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
        q.awaitTermination()
        return q
    finally:
        spark.conf.set(_PROVIDER, before) if before else spark.conf.unset(_PROVIDER)


def drain(stream: DataFrame, path: str) -> DataFrame:
    """Run an appending stream over all that is there, then stop; the rows that it wrote."""
    _start(stream.writeStream.format("parquet").option("path", f"{path}/out"), path, stream.sparkSession)
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/out")
