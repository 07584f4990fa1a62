"""Append-only chains over ranges of one ledger, against a plain loop."""
import hashlib

import numpy as np

from panelwright.operators import gates as G

SCHEMA = "ledger string, sq long, previous string, digest string, body string"


def chain(name, n, rng):
    last, out = "", []
    for i in range(1, n + 1):
        body = f"b{rng.integers(1000)}"
        digest = hashlib.sha256(f"{last}|{body}".encode()).hexdigest()
        out.append([name, i, last, digest, body])
        last = digest
    return out


def loop(rows):
    out, by = set(), {}
    for r in sorted(rows, key=lambda r: (r[0], r[1], r[3])):
        n, last = by.get(r[0], (0, ""))
        if r[1] != n + 1:
            out.add((r[0], r[1], "sequence"))
        if (r[2] or "") != last:
            out.add((r[0], r[1], "previous_hash"))
        if hashlib.sha256(f"{r[2] or ''}|{r[4]}".encode()).hexdigest() != r[3]:
            out.add((r[0], r[1], "own_hash"))
        by[r[0]] = (n + 1, r[3])
    return out


def test_one_ledger_over_many_tasks(spark):
    rng = np.random.default_rng(1)
    rows = chain("hot", 3000, rng) + chain("a", 7, rng) + chain("b", 1, rng)
    for i in (0, 5, 700, 1499, 1500, 2999):
        rows[i][3] = "x" * 3
    rows[900][2] = None
    rows[1200][4] = "other"
    del rows[2000]  # a gap: all later numbers are off
    rows.append(["hot", 50, "dup", "dup", "dup"])
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        d = spark.createDataFrame([tuple(r) for r in rows], SCHEMA).repartition(8)
        got = {tuple(r) for r in G.hash_chain(d, "ledger", "sq", "previous", "digest", ["body"]).collect()}
        spread = d.repartitionByRange("ledger", "sq", "digest").filter("ledger = 'hot'").selectExpr("spark_partition_id() p").distinct().count()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert spread > 1 and got == loop(rows)


def test_no_entries(spark):
    assert G.hash_chain(spark.createDataFrame([], SCHEMA), "ledger", "sq", "previous", "digest", ["body"]).collect() == []
