"""Quality gates: each gives the number of rows that break a rule, one row a rule, from as few scans as it can."""
from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import written


def count_rules(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """(check_name, violations) of all row rules in one scan; an unknown condition is no violation."""
    one = df.agg(*(F.count(F.when(c, 1)).alias(n) for n, c in rules.items()))
    return one.unpivot([], list(rules), "check_name", "violations")


def repeated_keys(df: DataFrame, keys: Sequence[str], name: str = "duplicate_key") -> DataFrame:
    bad = df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")
    return bad.agg(F.count("*").alias("violations")).select(F.lit(name).alias("check_name"), "violations")


def count_rows(df: DataFrame, name: str) -> DataFrame:
    return df.agg(F.count("*").alias("violations")).select(F.lit(name).alias("check_name"), "violations")


def all_of(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def audit_market(bars: DataFrame, manifest_rows: int | Column, factor: str = "adj_factor") -> DataFrame:
    """Keys, prices, amounts, adjustment factors, the unit of volume against amount, and the count in the manifest."""
    c = F.col
    rules = {
        "null_key": c("inst").isNull() | c("session").isNull(), "ohlc": (c("high") < F.greatest("open", "close", "low")) | (c("low") > F.least("open", "close")),
        "negative_volume": (c("volume") < 0) | (c("amount") < 0), "factor_not_positive": c(factor) <= 0,
        "unit": (c("volume") > 0) & ((c("amount") / c("volume") > c("high") * 1.001) | (c("amount") / c("volume") < c("low") * 0.999)),
    }
    n = bars.agg(F.count("*").alias("n"))
    want = manifest_rows if isinstance(manifest_rows, Column) else F.lit(manifest_rows)
    manifest = n.select(F.lit("manifest_count").alias("check_name"), (F.col("n") != want).cast("long").alias("violations"))
    return all_of(count_rules(bars, rules), repeated_keys(bars.filter("inst is not null and session is not null"), ["inst", "session"]), manifest)


def audit_reference(calendar: DataFrame, state: DataFrame, securities: DataFrame) -> DataFrame:
    """calendar (session, previous); state (k, session, is_st, eligible); securities (k, list_date, delist_date)."""
    link = calendar.withColumn("_was", F.lag("session").over(Window.partitionBy(F.lit(0)).orderBy("session")))  # one row a session
    j = state.join(securities, "k", "left")
    rules = {"eligible_but_st": F.col("eligible") & F.col("is_st"), "state_after_delisting": F.col("session") > F.col("delist_date"), "state_before_listing": F.col("session") < F.col("list_date"), "unknown_security": F.col("list_date").isNull()}
    gone = securities.filter("delist_date is not null").join(state, "k", "left_anti")
    return all_of(count_rules(link, {"calendar_link": F.col("previous") != F.col("_was")}), count_rules(j, rules), count_rows(gone, "delisted_without_state"))


def audit_actions(actions: DataFrame, jumps: DataFrame) -> DataFrame:
    """actions (code, lineage, ex_date, imp_ann_date, approved); jumps (code, session, ratio, error)."""
    rules = {"null_code": F.col("code").isNull(), "late_implementation": F.col("imp_ann_date") > F.col("ex_date")}
    several = actions.filter("approved").groupBy("code", "ex_date").agg(F.count("*").alias("n")).filter("n > 1")
    return all_of(
        count_rules(actions, rules), repeated_keys(actions, ["lineage"], "duplicate_lineage"), repeated_keys(jumps, ["code", "session"], "duplicate_jump"),
        count_rules(jumps, {"ratio_not_positive": F.col("ratio") <= 0}), count_rows(several, "several_candidates"), count_rows(actions.filter("approved"), "approved_rows"),
    )


def audit_financial(versions: DataFrame, parts: Sequence[DataFrame], exceptions: DataFrame) -> DataFrame:
    """Reversed validity, rows of the union against those of its feeds, and quarantined rows."""
    total = versions.agg(F.count("*").alias("n")).crossJoin(reduce(DataFrame.unionAll, [p.agg(F.count("*").alias("m")) for p in parts]).agg(F.sum("m").alias("m")))
    union = total.select(F.lit("union_count").alias("check_name"), (F.col("n") != F.col("m")).cast("long").alias("violations"))
    return all_of(count_rules(versions, {"reversed_interval": F.col("valid_to") < F.col("valid_from")}), union, count_rows(exceptions, "exceptions"))


def audit_records(df: DataFrame) -> DataFrame:
    """Records (key, revision, published, available, ingested, lineage, digest, recomputed): times, lineage, hashes, conflicts."""
    rules = {
        "available_before_publication": F.col("available") < F.col("published"), "ingested_before_available": F.col("ingested") < F.col("available"),
        "lineage_missing": F.coalesce(F.trim("lineage"), F.lit("")) == "", "hash_mismatch": ~F.col("digest").eqNullSafe(F.col("recomputed")),
    }
    conflict = df.groupBy("key", "revision").agg(F.count_distinct("digest").alias("n")).filter("n > 1")
    return all_of(count_rules(df, rules), count_rows(conflict, "conflicting_revision"))


def pit_inclusion(df: DataFrame, cutoff: Column) -> DataFrame:
    """(k, reason) of records that were used although they came after the cutoff, a row for each reason."""
    reasons = F.array_compact(F.array(F.when(F.col("available") > cutoff, "available_after_cutoff"), F.when(F.col("ingested") > cutoff, "ingested_after_cutoff")))
    return df.filter("included").select("k", F.explode(reasons).alias("reason"))


def signal_execution(df: DataFrame) -> DataFrame:
    """(k, reason) of executions before their information or at the close that the signal itself uses."""
    reason = F.when(F.col("executed") < F.col("informed"), "execution_before_information").when((F.col("executed") == F.col("informed")) & F.col("at_close"), "same_close_execution")
    return df.withColumn("reason", reason).filter("reason is not null").select("k", "reason")


def audit_release(values: DataFrame, universe: DataFrame, clock: Column) -> DataFrame:
    """values (inst, session, factor, val, available_at): keys in the universe, the signal clock, repeats, finite values."""
    outside = values.join(universe, ["inst", "session"], "left_anti")
    rules = {"clock": ~F.col("available_at").eqNullSafe(clock), "not_finite": F.isnan("val") | (F.abs("val") == float("inf"))}
    return all_of(count_rules(values, rules), count_rows(outside, "outside_universe"), repeated_keys(values, ["inst", "session", "factor"]))


def compare_releases(new: DataFrame, old: DataFrame, keys: Sequence[str], value: str, meta: Sequence[str] = (), absolute: float = 1e-12, relative: float = 1e-10) -> DataFrame:
    """Keys on one side only, differing metadata, one-sided NULLs and values beyond the tolerance, in one full join."""
    a = new.select(*keys, F.col(value).alias("_n"), *(F.col(m).alias(f"_n_{m}") for m in meta), F.lit(True).alias("_in_new"))
    b = old.select(*keys, F.col(value).alias("_o"), *(F.col(m).alias(f"_o_{m}") for m in meta), F.lit(True).alias("_in_old"))
    j = a.join(b, list(keys), "full")
    both = F.col("_in_new") & F.col("_in_old")
    differs = reduce(lambda x, y: x | y, [~F.col(f"_n_{m}").eqNullSafe(F.col(f"_o_{m}")) for m in meta], F.lit(False))
    far = F.abs(F.col("_n") - F.col("_o")) > absolute + relative * F.greatest(F.abs("_n"), F.abs("_o"))
    return count_rules(j, {"only_new": F.col("_in_old").isNull(), "only_old": F.col("_in_new").isNull(), "metadata": both & differs, "null_mask": both & (F.col("_n").isNull() != F.col("_o").isNull()), "values": both & far})


def hash_chain(df: DataFrame, ledger: str, seq: str, previous: str, digest: str, content: Sequence[str]) -> DataFrame:
    """(ledger, seq, reason) of entries that break an append-only chain: number, link to the entry before, own hash.

    Entries stand in ranges of (ledger, seq), so one ledger spreads over tasks. Inside a range each entry meets the one
    before it; what comes before a range is the count and last digest of those before, a row a range and ledger.
    Entries of one number keep an order by their digest."""
    order = [seq, digest]
    placed = written(df.repartitionByRange(ledger, *order).withColumn("_range", F.spark_partition_id()))
    w = Window.partitionBy(ledger, "_range").orderBy(*order)
    edge = placed.groupBy(ledger, "_range").agg(F.count("*").alias("_n"), F.max(F.struct(*order))[digest].alias("_last"))
    ranges = Window.partitionBy(ledger).orderBy("_range")
    before = F.coalesce(F.sum("_n").over(ranges.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    edge = written(edge.select(ledger, "_range", before.alias("_before"), F.lag("_last").over(ranges).alias("_edge")))
    text = F.concat_ws("|", F.coalesce(F.col(previous), F.lit("")), *(F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in content))
    x = placed.join(edge, [ledger, "_range"])
    x = x.withColumns({"_seq": F.row_number().over(w) + F.col("_before"), "_link": F.coalesce(F.lag(digest).over(w), "_edge", F.lit(""))})
    reasons = F.array_compact(F.array(F.when(F.col(seq) != F.col("_seq"), "sequence"), F.when(F.coalesce(F.col(previous), F.lit("")) != F.col("_link"), "previous_hash"), F.when(F.sha2(text, 256) != F.col(digest), "own_hash")))
    return x.select(ledger, seq, F.explode(reasons).alias("reason"))


def audit_execution(daily: DataFrame, summary: DataFrame) -> DataFrame:
    """daily (capital, session, selected, filled, rejected, gross, net, cost, turnover) and its summary (capital, fill_rate,
    mean_cost): identities of each day, the summary rebuilt, and how it changes with capital."""
    rules = {
        "net_above_gross": F.col("net") > F.col("gross") + 1e-12, "negative_cost": F.col("cost") < 0, "filled_above_selected": F.col("filled") > F.col("selected"),
        "unreconciled": F.col("filled") + F.col("rejected") != F.col("selected"), "turnover_range": ~F.col("turnover").between(0, 1),
    }
    again = daily.groupBy("capital").agg((F.sum("filled") / F.sum("selected")).alias("_rate"), F.avg("cost").alias("_cost"))
    drift = summary.join(again, "capital", "full").select(((F.abs(F.col("fill_rate") - F.col("_rate")) > 1e-9) | (F.abs(F.col("mean_cost") - F.col("_cost")) > 1e-9) | F.col("fill_rate").isNull() | F.col("_rate").isNull()).alias("bad"))
    w = Window.partitionBy(F.lit(0)).orderBy("capital")  # a row a scenario
    s = summary.withColumns({"_r": F.lag("fill_rate").over(w), "_c": F.lag("mean_cost").over(w)})
    return all_of(count_rules(daily, rules), count_rules(drift, {"summary_drift": F.col("bad")}), count_rules(s, {"fill_rate_rises": F.col("fill_rate") > F.col("_r") + 1e-12, "cost_falls": F.col("mean_cost") < F.col("_c") - 1e-12}))


def overview(audits: Mapping[str, DataFrame], advisory: Sequence[str] = ()) -> DataFrame:
    """(dataset, checks, failed, violations, status): `advisory` checks only warn."""
    rows = all_of(*(d.select(F.lit(n).alias("dataset"), "check_name", "violations") for n, d in audits.items()))
    soft = F.col("check_name").isin(*advisory) if advisory else F.lit(False)
    g = rows.groupBy("dataset").agg(F.count("*").alias("checks"), F.count(F.when((F.col("violations") > 0) & ~soft, 1)).alias("failed"), F.count(F.when((F.col("violations") > 0) & soft, 1)).alias("warned"), F.sum("violations").alias("violations"))
    return g.select("dataset", "checks", "failed", "violations", F.when(F.col("failed") > 0, "blocked").when(F.col("warned") > 0, "warning").otherwise("passed").alias("status"))


__all__ = [n for n in dir() if not n.startswith("_")]
