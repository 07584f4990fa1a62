"""Who is held among scored candidates: a challenger takes over after confirmed leads. One rule for tables and streams."""
from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Rule(NamedTuple):
    """The lead that counts must exceed `margin`; it must be confirmed in `confirmations` periods in a row by one challenger,
    none of them among the first `hold` - 1 periods after a switch."""

    margin: float
    confirmations: int
    hold: int


class Book(NamedTuple):
    held: str | None = None
    rival: str | None = None
    streak: int = 0
    age: int = 0


def advance(book: Book, leader: str, lead: float, rule: Rule) -> tuple[Book, bool, str]:
    """The book after one period with that leader and its lead over the next best; whether it switched; why."""
    if book.held is None:
        return Book(leader), True, "initial_selection"
    age = book.age + 1
    blocks = (("active_leads", leader == book.held), ("below_threshold", lead <= rule.margin), ("minimum_hold", age < rule.hold))
    for reason, blocked in blocks:
        if blocked:
            return Book(book.held, age=age), False, reason
    streak = book.streak + 1 if book.rival == leader else 1
    if streak < rule.confirmations:
        return Book(book.held, leader, streak, age), False, "awaiting_confirmation"
    return Book(leader), True, "switch_confirmed"


def leaders(scores: DataFrame, group: str = "book", seq: str = "seq", column: str = "scores") -> DataFrame:
    """scores with the leader and its lead over the next best candidate, ties by name. Rows with fewer than two finite
    scores decide nothing and are left out."""
    finite = lambda k, v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    ranked = F.array_sort(F.transform(F.map_entries(F.map_filter(column, finite)), lambda e: F.struct((-e["value"]).alias("s"), e["key"].alias("k"))))
    x = scores.withColumn("_r", ranked).filter(F.size("_r") >= 2)
    at = lambda k: F.try_element_at("_r", F.lit(k))
    return x.withColumns({"leader": at(1)["k"], "lead": at(2)["s"] - at(1)["s"]}).drop("_r")


_SCHEMA = "book {kind}, seq int, leader string, lead double, held string, switched boolean, reason string"


def _fold(rule: Rule):
    def run(batches: Iterator[pa.RecordBatch]):
        now, book = object(), Book()
        for batch in batches:
            rows = [batch.column(k).to_pylist() for k in range(4)]
            out = []
            for key, leader, lead in zip(rows[0], rows[2], rows[3]):
                if key != now:
                    now, book = key, Book()
                book, switched, reason = advance(book, leader, lead, rule)
                out.append((book.held, switched, reason))
            cols = list(zip(*out)) if out else [()] * 3
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cols[0], pa.string()), pa.array(cols[1], pa.bool_()), pa.array(cols[2], pa.string())], names=["book", "seq", "leader", "lead", "held", "switched", "reason"])

    return run


def switches(scores: DataFrame, rule: Rule, group: str = "book") -> DataFrame:
    """(book, seq, leader, lead, held, switched, reason) of every period that decides, in one ordered pass a book.

    scores: (book, seq, scores: map of candidate -> score). Books spread over tasks; a task holds the state of one."""
    x = leaders(scores).select(F.col(group).alias("book"), F.col("seq").cast("int").alias("seq"), "leader", F.col("lead").cast("double").alias("lead"))
    line = x.repartition("book").sortWithinPartitions("book", "seq")
    return line.mapInArrow(_fold(rule), _SCHEMA.format(kind=x.schema["book"].dataType.simpleString()))


# ---- regimes that need confirmation

#: Regimes from worst to best, and the exposure of each.
EXPOSURE = {"weak": 0.3, "base": 0.7, "strong": 1.0}


class Regime(NamedTuple):
    now: str = "base"
    wanted: str | None = None
    run: int = 0


def confirm(state: Regime, raw: str | None, down: int, up: int) -> Regime:
    """The regime after one session: a worse one must stand for `down` sessions in a row, a better one for `up`."""
    if raw is None or raw == state.now:
        return Regime(state.now)
    run = state.run + 1 if raw == state.wanted else 1
    order = list(EXPOSURE)
    return Regime(raw) if run >= (down if order.index(raw) < order.index(state.now) else up) else Regime(state.now, raw, run)


def confirmed_regime(df: DataFrame, group: str, raw: str, down: int, up: int) -> DataFrame:
    """(group, seq, regime, exposure): the regime in force, which begins as base; an unknown session ends a run of others. One
    ordered pass a group, whose task holds the state of one."""
    x = df.select(F.col(group).alias("group"), F.col("seq").cast("int").alias("seq"), F.col(raw).alias("raw"))

    def run(batches):
        now, state = object(), Regime()
        for batch in batches:
            out = []
            for key, value in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                now, state = key, confirm(state if key == now else Regime(), value, down, up)
                out.append(state.now)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string())], names=["group", "seq", "regime"])

    line = x.repartition("group").sortWithinPartitions("group", "seq")
    done = line.mapInArrow(run, f"group {x.schema['group'].dataType.simpleString()}, seq int, regime string")
    exposure = F.lit(None).cast("double")
    for k, v in EXPOSURE.items():
        exposure = F.when(F.col("regime") == k, v).otherwise(exposure)
    return done.withColumnRenamed("group", group).withColumn("exposure", exposure)
