"""Dividend events against sessions: what is known changes a few times an instrument, so results are made for those days
alone and read by sessions as of their time. No session meets an event."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .exprs import by_instrument, safe_div
from .facts import MAX_REPORT_AGE, asof_last

_STATE = ("inst", "since")


def _bad(c: str) -> Column:
    x = F.col(c)
    return x.isNull() | F.isnan(x) | (x < 0)


def known_rows(events: DataFrame, fields: Sequence[str], turns: Sequence[Column] = ()) -> tuple[DataFrame, DataFrame]:
    """(states, known): states(inst, since) are the days on which an instrument's known events, or what may be said of them,
    change; known holds the events (ex_date, *fields) that each state knows.

    An event is known from its ex_date on, after the day of its announcement; one without either never is. `turns` are
    further dates of an event that count once it is known. An instrument has as many states as events and turns.
    """
    ev = events.select("inst", "ex_date", *fields, F.greatest("ex_date", F.date_add("imp_ann", 1)).alias("_from"), *(t.alias(f"_turn{k}") for k, t in enumerate(turns)))
    ev = ev.filter("ex_date is not null and imp_ann is not null")
    days = F.array("_from", *(F.when(F.col(f"_turn{k}") > F.col("_from"), F.col(f"_turn{k}")) for k in range(len(turns))))
    states = ev.select("inst", F.explode(F.array_compact(days)).alias("since")).distinct()
    known = states.join(ev.drop(*(f"_turn{k}" for k in range(len(turns)))), "inst").filter(F.col("_from") <= F.col("since")).drop("_from")
    return states, known


def with_scale(known: DataFrame) -> DataFrame:
    """Adds `scale`, the product of 1 + stock over the state's events from this one on, and `unknown`, how many of those
    have no sound stock."""
    later = Window.partitionBy(*_STATE).orderBy(F.desc("ex_date"))
    return known.withColumns({"scale": F.product(1 + F.col("stock")).over(later), "unknown": F.sum(_bad("stock").cast("int")).over(later)})


def cash_per_current_share(sessions: DataFrame, events: DataFrame, days: int = 365) -> DataFrame:
    """sessions with `cash` of the events of the last `days` days per share of today: 0 without any, NULL if an amount in it
    is unknown. events: one row of each (inst, ex_date), with cash, stock and imp_ann."""
    states, known = known_rows(events, ["cash", "stock"], [F.date_add("ex_date", days)])
    recent = with_scale(known).filter(F.datediff("since", "ex_date") < days)
    sums = recent.groupBy(*_STATE).agg(F.sum(F.col("cash") / F.col("scale")).alias("_sum"), F.max("unknown").alias("_unknown"), F.sum(_bad("cash").cast("int")).alias("_bad"))
    sums = states.join(sums, list(_STATE), "left").select(*_STATE, F.when(F.col("_bad").isNull(), 0.0).when((F.col("_bad") == 0) & (F.col("_unknown") == 0), F.col("_sum")).alias("cash"), F.lit(True).alias("_any"))
    out = asof_last(sessions, sums, ["inst"], "session", "since", ["cash", "_any"], strict=False)
    return out.withColumn("cash", F.when(F.col("_any").isNull(), 0.0).otherwise(F.col("cash"))).drop("_any")


# ---- fiscal cycles

#: Kinds of periods by (month, day) of their end; any other is odd.
PERIODS = {(12, 31): "closing", (6, 30): "interim", (9, 30): "interim"}


def _kind() -> Column:
    out = F.when(F.col("end_date").isNull(), "missing")
    for (month, day), kind in PERIODS.items():
        out = out.when((F.month("end_date") == month) & (F.dayofmonth("end_date") == day), kind)
    return out.otherwise("odd")


def _count(condition) -> Column:
    return F.count(F.when(condition, 1))


def cycle_states(events: DataFrame, max_age: int = MAX_REPORT_AGE) -> DataFrame:
    """(inst, since, status, period_end, cash): the last fiscal cycle as each state knows it.

    Figures of a state come in three steps, each over its few events: its closing period; the place of every event
    towards it; and what the selected events amount to. RULES turn them into a status; only the last four carry cash.
    """
    turns = [F.col("end_date"), F.date_add("ex_date", max_age + 1)]
    _, known = known_rows(events, ["end_date", "cash", "stock", "conflict"], turns)
    own = Window.partitionBy(*_STATE)
    x = with_scale(known).withColumn("kind", _kind())
    x = x.withColumns({"closing": F.max(F.when((F.col("kind") == "closing") & (F.col("end_date") <= F.col("since")), F.col("end_date"))).over(own), "newest": F.max("end_date").over(own)})
    x = x.withColumn("back", F.year("closing") - F.year("end_date"))  # fiscal years before that of the closing period
    x = x.withColumns({
        "same_year": _count((F.col("back") == 0) & (F.col("end_date") < F.col("closing"))).over(own), "year_before": _count((F.col("back") == 1) & (F.col("kind") == "interim")).over(own),
        "twin": _count((F.col("back") == 0) & (F.col("end_date") < F.col("closing")) & (F.col("end_date") == F.add_months("newest", -12))).over(own),
    })
    rolls = F.coalesce((F.col("newest") > F.col("closing")) & (F.year("newest") == F.year("closing") + 1) & (F.col("twin") > 0), F.lit(False))
    x = x.withColumn("rolls", rolls).withColumn("period_end", F.when(F.col("rolls"), F.col("newest")).otherwise(F.col("closing")))
    in_cycle = F.when(F.col("rolls"), F.col("end_date") > F.add_months("newest", -12)).otherwise(F.col("back") == 0)
    x = x.withColumn("chosen", F.coalesce(in_cycle, F.lit(False)))
    first = lambda c: F.first(c, ignorenulls=True).alias(c)
    pick = lambda c: F.when(F.col("chosen"), c)
    s = x.groupBy(*_STATE).agg(
        first("closing"), first("newest"), first("period_end"), first("rolls"), first("same_year"), first("year_before"),
        _count(F.col("kind") == "missing").alias("missing"), _count(F.col("end_date") > F.col("since")).alias("ahead"), _count((F.col("kind") == "odd") & (F.col("end_date") > F.add_months("period_end", -12))).alias("odd"),
        F.max(pick(F.col("ex_date"))).alias("paid"), F.count(pick(F.lit(1))).alias("payments"), F.count_distinct(pick(F.col("end_date"))).alias("periods"),
        _count(F.col("chosen") & (F.coalesce("conflict", F.lit(False)) | _bad("cash"))).alias("bad_cash"), F.max(pick(F.col("unknown"))).alias("bad_stock"), F.sum(pick(F.col("cash") / F.col("scale"))).alias("total"),
    )
    status = F.lit(None).cast("string")
    for name, rule in reversed(cycle_rules(max_age)):
        status = F.when(F.expr(rule), name).otherwise(status)
    s = s.withColumn("status", status)
    return s.select(*_STATE, "status", "period_end", F.when(F.col("status").isin(*CYCLE_READY), F.col("total")).alias("cash"))


def cycle_rules(max_age: int) -> list[tuple[str, str]]:
    """Statuses in order of precedence: the first whose condition holds. What cannot be proven is no zero."""
    return [
        ("period_missing", "missing > 0"),
        ("annual_cycle_not_complete", "closing is null"),
        ("period_after_information_date", "ahead > 0"),
        ("expected_interim_missing", "same_year = 0 and year_before > 0"),
        ("nonstandard_period", "odd > 0"),
        ("stale_cycle", f"datediff(since, paid) > {int(max_age)}"),
        ("several_payments_of_a_period", "periods < payments"),
        ("amount_or_event_conflict", "bad_cash > 0"),
        ("share_distribution_unknown", "bad_stock > 0"),
        ("rolling_split_cycle", "rolls"),
        ("frequency_transition", "newest > closing"),
        ("annual_split", "same_year > 0"),
        ("annual_once", "true"),
    ]


CYCLE_READY = ("annual_once", "annual_split", "rolling_split_cycle", "frequency_transition")


def with_dividend_cycle(sessions: DataFrame, events: DataFrame, max_age: int = MAX_REPORT_AGE) -> DataFrame:
    """sessions with the status, period_end and cash per share of today of the last fiscal cycle.

    A closing distribution makes a year with that year's interims; a new interim takes the place of last year's only if
    there was one. events: inst, ex_date, imp_ann, end_date, cash, stock, conflict; one row of each (inst, ex_date)."""
    out = asof_last(sessions, cycle_states(events, max_age), ["inst"], "session", "since", ["status", "period_end", "cash"], strict=False)
    return out.withColumn("status", F.coalesce("status", F.lit("no_known_cycle")))


# ---- shares in time


def per_current_share(sessions: DataFrame, events: DataFrame, breaks: DataFrame) -> DataFrame:
    """A reported per-share `value` in shares of today, NULL if a break or an unknown share change lies after the report.

    Sessions read the state they know and their last break; products are made for each state and report, not session."""
    states, known = known_rows(events, ["stock"])
    x = asof_last(sessions, states.withColumn("_since", F.col("since")), ["inst"], "session", "since", ["_since"], strict=False)
    x = asof_last(x, breaks.select("inst", F.col("session").alias("_at"), F.col("session").alias("_break")), ["inst"], "session", "_at", ["_break"], strict=False)
    asked = x.select("inst", F.col("_since").alias("since"), "report_date").filter("since is not null and report_date is not null").distinct()
    later = asked.join(known, list(_STATE)).filter(F.col("ex_date") > F.col("report_date"))
    scale = later.groupBy(*_STATE, "report_date").agg(F.product(1 + F.col("stock")).alias("_scale"), F.sum(_bad("stock").cast("int")).alias("_unknown"))
    x = x.join(scale.withColumnRenamed("since", "_since"), ["inst", "_since", "report_date"], "left")
    sound = ~F.coalesce(F.col("_break") > F.col("report_date"), F.lit(False)) & (F.coalesce("_unknown", F.lit(0)) == 0)
    return x.withColumn("per_share", F.when(sound, F.col("value") / F.coalesce("_scale", F.lit(1.0)))).drop("_since", "_break", "_scale", "_unknown")


def share_path(events: DataFrame) -> DataFrame:
    """(inst, ex_date, shares, paid, unknown) after each event: the shares that one share has become, the cash that it has
    paid so far, and how many amounts are unknown. Running sums; between two dates their differences and ratios tell."""
    w = Window.partitionBy("inst").orderBy("ex_date", "cash", "stock")
    before, upto = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(Window.unboundedPreceding, 0)
    step = 1 + F.coalesce("stock", F.lit(0.0))
    x = events.withColumn("_held", F.coalesce(F.product(step).over(before), F.lit(1.0)))
    x = x.withColumns({"shares": F.product(step).over(upto), "paid": F.sum(F.col("_held") * F.coalesce("cash", F.lit(0.0))).over(upto), "unknown": F.sum((F.col("cash").isNull() | F.col("stock").isNull()).cast("int")).over(upto), "_k": F.row_number().over(w)})
    return x.select("inst", "ex_date", "shares", "paid", "unknown", "_k")


def economic_return_label(df: DataFrame, events: DataFrame, h: int) -> DataFrame:
    """From the next session's open to the open h later with shares and cash of the events in between; `relative` is less
    the mean of the session. An unknown amount in between gives none. Two reads of one running path, no events on rows."""
    w = by_instrument()
    x = df.withColumns({"_in": F.lead("session", 1).over(w), "_out": F.lead("session", h + 1).over(w), "_p0": F.lead("open", 1).over(w), "_p1": F.lead("open", h + 1).over(w)})
    path = share_path(events)
    start = {"shares": 1.0, "paid": 0.0, "unknown": 0}
    for at in ("_in", "_out"):
        x = asof_last(x, path, ["inst"], at, "ex_date", list(start), ["_k"], strict=False)
        x = x.withColumns({f"{at}_{c}": F.coalesce(c, F.lit(v)) for c, v in start.items()}).drop(*start)
    change = lambda c: F.col(f"_out_{c}") - F.col(f"_in_{c}")
    worth = (F.col("_out_shares") * F.col("_p1") + change("paid")) / F.nullif("_in_shares", F.lit(0.0))
    x = x.withColumn("total", F.when(change("unknown") == 0, safe_div(worth, "_p0") - 1))
    x = x.withColumn("relative", F.col("total") - F.avg("total").over(Window.partitionBy("session")))
    return x.select(*df.columns, "total", "relative")
