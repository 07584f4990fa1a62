"""Raking of token weights to source, language and topic marginals, and calibrated sampling (DataFrame functions only)."""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .sharding import unit_draw
from .store import fresh, materialize, read_table

WORD = r"[^\x20\x09-\x0D]+"
#: Topics by the first pattern that a text has; the rest is "prose".
TOPICS = (("access", r"(?i)password|token|api_?key|AKIA[A-Z0-9]"), ("contact", r"@[a-z0-9.-]+\.[a-z]|\(\d{3}\) \d{3}"), ("listing", r"\|"), ("markup", r"[#$%&*]{3}"))
DIMS = ("source", "lang", "topic")
#: Expected share of all tokens that a sample by budget keeps.
BUDGET = 0.5


def topic_of(text: Column, rules: Sequence[tuple[str, str]] = TOPICS) -> Column:
    out = F.lit("prose")
    for name, pattern in reversed(rules):
        out = F.when(text.rlike(pattern), F.lit(name)).otherwise(out)
    return out


def _keyed(docs: DataFrame, text: str, rules) -> DataFrame:
    body = F.coalesce(F.col(text), F.lit(""))
    label = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("?"))
    return docs.select("*", F.struct(label("source").alias("source"), label("lang").alias("lang"), topic_of(body, rules).alias("topic")).alias("__mix"))


def rake(cells: DataFrame, dims: Sequence[str] = DIMS, temper: float = 0.8, rounds: int = 12, targets: Mapping[str, Mapping[str, float]] | None = None) -> DataFrame:
    """Iterative proportional fitting of `n_tokens` of a cell table.

    targets has the wished shares of a dimension's values ({"lang": {"en": 0.5, "de": 0.5}}); a value that it leaves out
    gets none, and shares are taken over the values that have tokens. The target of each value of a dimension that is not
    in targets is its token share to the power `temper`, normalised, times all tokens.
    Each step scales the cells of a value to its target; `rounds` passes over all dimensions. Adds weight_tokens and
    misfit (largest relative gap between a cell's marginals and their targets at the end). Cells without tokens keep 0.
    The work is on cells (distinct source x lang x topic), never on documents.
    """
    everything = Window.partitionBy(F.lit(0))
    out = cells.withColumn("w", F.col("n_tokens").cast("double")).withColumn("__all", F.sum("w").over(everything))
    for d in dims:
        by = Window.partitionBy(d)
        # the powered share of a value, spread over its cells so that a plain sum counts each value once
        share = F.pow(F.try_divide(F.sum("w").over(by), F.col("__all")), F.lit(float(temper)))
        if targets and d in targets:
            wish = F.lit(0.0)
            for value, part in targets[d].items():
                wish = F.when(F.col(d) == value, float(part)).otherwise(wish)
            share = F.when(F.sum("w").over(by) > 0, wish).otherwise(0.0)
        out = out.withColumn("__s", share).withColumn("__k", F.count("*").over(by))
        out = out.withColumn(f"__t_{d}", F.try_divide(F.col("__s") * F.col("__all"), F.sum(F.col("__s") / F.col("__k")).over(everything)))
    for _ in range(rounds):
        for d in dims:
            out = out.withColumn("w", F.coalesce(F.try_divide(F.col("w") * F.col(f"__t_{d}"), F.sum("w").over(Window.partitionBy(d))), F.lit(0.0)))
    gaps = [F.abs(F.coalesce(F.try_divide(F.sum("w").over(Window.partitionBy(d)), F.col(f"__t_{d}")), F.lit(1.0)) - 1) for d in dims]
    return out.withColumn("misfit", F.greatest(*gaps)).select(*dims, "n_docs", "n_tokens", F.col("w").alias("weight_tokens"), "misfit")


def budgeted(multiple: Column, budget: float) -> Column:
    """min(1, c * multiple) with c such that the expected tokens of the sample are `budget` times all tokens.

    A cell keeps all its rows if, with c at the inverse of its multiple, the sample would not pass the budget; c follows
    from what the other cells have left. Columns n_tokens and weight_tokens of a cell table.
    """
    everything = Window.partitionBy(F.lit(0))
    down = everything.orderBy(F.when(F.col("n_tokens") > 0, multiple).desc_nulls_last())
    goal = F.sum("n_tokens").over(everything) * F.lit(float(budget))
    rest = F.sum("weight_tokens").over(everything) - F.sum("weight_tokens").over(down)
    full = (F.col("n_tokens") > 0) & (F.sum("n_tokens").over(down) + F.try_divide(rest, multiple) <= goal)
    full = F.coalesce(full, F.lit(False))
    return F.struct(goal.alias("goal"), full.alias("full"))


def mixing_rates(docs: DataFrame, text: str = "text", temper: float = 0.8, rounds: int = 12, rules=TOPICS, budget: float | None = None, targets: Mapping[str, Mapping[str, float]] | None = None) -> DataFrame:
    """Sampling probability of each cell, from its raked weight per token.

    With a budget (a share of all tokens) it is min(1, c * weight), c solved so that the sample is expected to hold that
    share: cells at 1 keep all rows, the others stand in the raked proportion, and a rare cell takes no more from them
    than its own tokens. Without one it is relative to the largest weight, so the expected mix is the raked one exactly,
    but the rarest cell sets the size of the sample.
    """
    cells = (
        _keyed(docs.select("source", "lang", text), text, rules)
        .groupBy("__mix").agg(F.count("*").alias("n_docs"), F.sum(F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(WORD)).cast("long")).alias("n_tokens"))
        .select("__mix.source", "__mix.lang", "__mix.topic", "n_docs", "n_tokens")
    )
    raked = rake(materialize(cells, "cells"), temper=temper, rounds=rounds, targets=targets)
    multiple = F.coalesce(F.try_divide(F.col("weight_tokens"), F.col("n_tokens")), F.lit(1.0))
    everything = Window.partitionBy(F.lit(0))
    if budget is None:
        rate = F.coalesce(multiple / F.max(F.when(F.col("n_tokens") > 0, multiple)).over(everything), F.lit(1.0))
    else:
        raked = raked.withColumn("__b", budgeted(multiple, budget))
        left = F.col("__b.goal") - F.sum(F.when(F.col("__b.full"), F.col("n_tokens")).otherwise(0)).over(everything)
        c = F.try_divide(left, F.sum(F.when(F.col("__b.full"), 0.0).otherwise(F.col("weight_tokens"))).over(everything))
        rate = F.when(F.col("__b.full"), 1.0).when(multiple == 0, 0.0).otherwise(F.coalesce(multiple * c, F.lit(1.0)))
    return materialize(raked.select("source", "lang", "topic", multiple.alias("weight"), F.least(F.lit(1.0), rate).alias("probability"), "misfit"), "rates")


def with_rates(docs: DataFrame, rates: DataFrame, text: str = "text", seed: int = 8, rules=TOPICS) -> DataFrame:
    """docs with a struct __mix (source, lang, topic), weight, probability and __draw; Spark broadcasts rates if its files are small."""
    flat = rates.select(F.struct("source", "lang", "topic").alias("__mix"), F.col("weight").alias("__weight"), F.col("probability").alias("__probability"), F.col("misfit").alias("__misfit"))
    return _keyed(docs, text, rules).join(flat, "__mix").withColumn("__draw", unit_draw(F.lit(seed), F.col("doc_id")))


def sample_mix(docs: DataFrame, text: str = "text", temper: float = 0.8, rounds: int = 12, seed: int = 8, budget: float = BUDGET, targets: Mapping[str, Mapping[str, float]] | None = None) -> DataFrame:
    """The rows drawn, with the columns of docs alone: a `budget` share of all tokens in expectation. A row's draw depends on seed and doc_id; equal rows fare alike.

    Null source or lang is the value '?'; a null text is empty; an empty table gives an empty table. Columns of any name
    are kept as they are.
    """
    rates = mixing_rates(docs, text, temper, rounds, budget=budget, targets=targets)
    cell, rate = fresh("cell", docs.columns), fresh("rate", docs.columns)
    label = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("?"))
    topic = topic_of(F.coalesce(F.col(text), F.lit("")))
    keyed = docs.withColumn(cell, F.struct(label("source").alias("source"), label("lang").alias("lang"), topic.alias("topic")))
    flat = rates.select(F.struct("source", "lang", "topic").alias(cell), F.col("probability").alias(rate))
    return keyed.join(flat, cell).filter(unit_draw(F.lit(seed), F.col("doc_id")) < F.col(rate)).select(*(F.col(f"`{c}`") for c in docs.columns))


def _drawn(docs: DataFrame, rates: DataFrame) -> DataFrame:
    return with_rates(docs, rates).select(
        "doc_id", F.col("__mix.source").alias("source"), F.col("__mix.lang").alias("lang"), F.col("__mix.topic").alias("topic"),
        F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long").alias("n_tokens"),
        F.round("__weight", 6).alias("weight"), F.round("__probability", 6).alias("probability"), (F.col("__draw") < F.col("__probability")).alias("drawn"),
    )


def op8_raked_mixing(spark, sf_dir: str) -> DataFrame:
    """Per document: its cell, tokens, raked weight, probability relative to the largest weight and whether it is drawn."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    return _drawn(docs, mixing_rates(docs))


def op8_budgeted_mixing(spark, sf_dir: str) -> DataFrame:
    """As op8_raked_mixing, with the probabilities of the pipeline's stage, which keep a share BUDGET of the tokens."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    return _drawn(docs, mixing_rates(docs, budget=BUDGET))


def sample_oracle(relation: str, columns: str | None = None, temper: float = 0.8, rounds: int = 12, seed: int = 8) -> str:
    """DuckDB SQL for the query (columns None) or for the sampled rows of `relation` with the given columns."""
    topic = "case " + " ".join(f"when regexp_matches(coalesce(text, ''), '{p}') then '{n}'" for n, p in TOPICS) + " else 'prose' end"
    ctes = [
        f"m0 as (select *, coalesce(source, '?') s_, coalesce(lang, '?') l_, {topic} t_, cast(len(regexp_extract_all(coalesce(text, ''), '{WORD}')) as bigint) k_ from {relation})",
        "m1 as (select s_, l_, t_, sum(k_)::bigint n, sum(k_)::double w, sum(sum(k_)) over ()::double tot from m0 group by all)",
    ]
    last = "m1"
    for d in "slt":
        ctes.append(f"p{d} as (select *, power(sum(w) over (partition by {d}_) / nullif(tot, 0), {temper}) sh{d}, count(*) over (partition by {d}_) kk{d} from {last})")
        ctes.append(f"q{d} as (select *, sh{d} * tot / nullif(sum(sh{d} / kk{d}) over (), 0) tg{d} from p{d})")
        last = f"q{d}"
    keep = "s_, l_, t_, n, tgs, tgl, tgt"
    for r in range(rounds):
        for d in "slt":
            ctes.append(f"r{r}{d} as (select {keep}, coalesce(w * tg{d} / nullif(sum(w) over (partition by {d}_), 0), 0) w from {last})")
            last = f"r{r}{d}"
    ctes.append(f"rates as (select *, least(1.0, coalesce(mult / max(case when n > 0 then mult end) over (), 1.0)) prob from (select s_, l_, t_, n, coalesce(w / nullif(n, 0), 1.0) mult from {last}))")
    draw = f"((('0x' || substr(md5('{seed}:' || coalesce(cast(doc_id as varchar), 'null')), 1, 13))::bigint)::double + 0.5) / 4503599627370496.0"
    if columns:
        return "with " + ",\n".join(ctes) + f"\nselect {columns} from m0 join rates using (s_, l_, t_) where {draw} < prob"
    return "with " + ",\n".join(ctes) + f"\nselect doc_id, s_ as source, l_ as lang, t_ as topic, k_ as n_tokens, round(mult, 6) as weight, round(prob, 6) as probability, {draw} < prob as drawn from m0 join rates using (s_, l_, t_)"


QUERIES = {"op8_budgeted_mixing": op8_budgeted_mixing, "op8_raked_mixing": op8_raked_mixing}
ORACLES = {"op8_raked_mixing": sample_oracle("documents")}
