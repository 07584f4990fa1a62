"""The switch rule by plain loops, on tables and streams; records and bars on streams with late and disordered files."""
import datetime as dt
import json

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from panelwright.operators import switching as W
from panelwright.plans.streaming_queries import replay
from panelwright.sources import tables as T
from panelwright.streaming import panel as S

DAY = dt.datetime(2020, 1, 1)


def plain(rows, margin, confirmations, hold):
    """Periods of one book in order: looks back over the history instead of carrying a state."""
    held, chosen_at, out = None, None, []
    history = []  # (leader, contested) since the last switch
    for i, (seq, scores) in enumerate(rows):
        order = sorted(scores, key=lambda c: (-scores[c], c))
        leader, lead = order[0], scores[order[0]] - scores[order[1]]
        if held is None:
            held, chosen_at, history, switched = leader, i, [], True
        else:
            history.append((leader, leader != held and lead > margin and i - chosen_at >= hold))
            tail = history[-confirmations:]
            switched = len(tail) == confirmations and all(c and x == leader for x, c in tail)
            if switched:
                held, chosen_at, history = leader, i, []
        out.append((seq, held, switched))
    return out


def books(n, periods, seed=1):
    rng = np.random.default_rng(seed)
    for b in range(n):
        walk = np.cumsum(rng.normal(0, 0.05, (periods, 3)), axis=0)
        yield from ((f"b{b}", t, {f"c{k}": float(np.round(walk[t, k], 2)) for k in range(3)}) for t in range(periods))


SCHEMA = "book string, seq int, scores map<string,double>"


@pytest.mark.parametrize("margin, confirmations, hold", [(0.0, 1, 1), (0.05, 2, 4), (0.02, 3, 2), (0.1, 2, 1)])
def test_rule_by_history(spark, margin, confirmations, hold):
    rows = list(books(6, 80))
    got = {}
    for r in W.switches(spark.createDataFrame(rows, SCHEMA), W.Rule(margin, confirmations, hold)).collect():
        got.setdefault(r.book, []).append((r.seq, r.held, r.switched))
    for b in got:
        assert sorted(got[b]) == plain([(s, m) for k, s, m in rows if k == b], margin, confirmations, hold)


def test_reasons_by_hand(spark):
    lead = lambda who, by=1.0: {c: by if c == who else 0.0 for c in "abc"}
    scores = [lead("a"), lead("b"), lead("b"), lead("c"), lead("b"), lead("b", 0.01), lead("b"), lead("b"), lead("b")]
    rows = [("x", i, s) for i, s in enumerate(scores)] + [("x", 90, {"a": 1.0}), ("x", 91, {"a": 1.0, "b": float("nan")})]
    out = sorted((r.seq, r.held, r.reason) for r in W.switches(spark.createDataFrame(rows, SCHEMA), W.Rule(0.1, 2, 2)).collect())
    assert [x[1:] for x in out] == [  # periods with fewer than two scores decide nothing
        ("a", "initial_selection"), ("a", "minimum_hold"), ("a", "awaiting_confirmation"), ("a", "awaiting_confirmation"), ("a", "awaiting_confirmation"),
        ("a", "below_threshold"), ("a", "awaiting_confirmation"), ("b", "switch_confirmed"), ("b", "active_leads"),
    ]


def stamped(spark, rows):
    return spark.createDataFrame([(*r, DAY + dt.timedelta(days=int(r[1]))) for r in rows], SCHEMA + ", at timestamp")


def test_disordered_files_give_the_batch_answer(spark):
    rows = list(books(4, 40, 3))
    rule = W.Rule(0.02, 2, 3)
    df = stamped(spark, rows)
    close = stamped(spark, [("", 200, {"x": 0.0, "y": 0.0})])
    stream = replay(df, 5, F.col("seq") + F.pmod(F.hash("seq", "book"), F.lit(7)), close)
    out = S.drain(S.switches(stream, rule, "at", "10 days", 1000), T.scratch(spark)).drop("lead")
    want = W.switches(df, rule).drop("lead")
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, want.collect()))


def test_idle_books_are_forgotten(spark):
    scores = {"a": 1.0, "b": 0.0}
    rows = [("x", 0, scores), ("x", 1, scores), ("x", 100, {"a": 0.0, "b": 1.0}), ("y", 150, scores), ("z", 400, scores)]
    out = S.drain(S.switches(_files(spark, rows), W.Rule(0.1, 5, 1), "at", "1 day", 30), T.scratch(spark))
    got = {r.seq: (r.held, r.reason) for r in out.filter("book = 'x'").collect()}
    assert got == {0: ("a", "initial_selection"), 1: ("a", "active_leads"), 100: ("b", "initial_selection")}


def _files(spark, rows):
    """One file a row, in the order given."""
    path = T.scratch(spark)
    for r in rows:
        stamped(spark, [r]).coalesce(1).write.mode("append").parquet(path)
    return S.read_bars(spark, path, stamped(spark, rows[:1]).schema)


RECORD = "key long, available timestamp, ingested timestamp, revision long, value double"


def _records(spark, files):
    path = T.scratch(spark)
    for rows in files:
        at = lambda d: DAY + dt.timedelta(days=d)
        spark.createDataFrame([(k, at(a), at(i), rev, float(v)) for k, a, i, rev, v in rows], RECORD).coalesce(1).write.mode("append").parquet(path)
    return S.read_bars(spark, path, spark.createDataFrame([], RECORD).schema)


def test_late_revisions_change_the_record_and_nothing_else_is_written(spark):
    files = [
        [(1, 0, 1, 1, 10), (2, 0, 1, 1, 20)],
        [(1, 5, 6, 2, 11), (3, 0, 6, 1, 30)],  # a revision of key 1
        [(1, 3, 9, 9, 99), (2, 40, 9, 2, 21)],  # an older record of key 1 that comes late; one of key 2 that is not available yet
        [(9, 20, 20, 1, 0)],
        [(9, 60, 60, 2, 0)],
        [(9, 90, 90, 3, 0)],
    ]
    path, order = T.scratch(spark), ["available", "revision"]
    changes = S.latest_known(_records(spark, files), "key", order, "available", "ingested", "2 days", 1000)
    S.upsert(changes, path)
    table = {r.key: (r.revision, r.value) for r in S.upserted(spark, path, changes.schema, "key", order).collect()}
    assert table[1] == (2, 11.0) and table[2] == (2, 21.0) and table[3] == (1, 30.0)
    rows = spark.read.parquet(f"{path}/changes/batch=*")
    assert sorted((r.key, r.revision) for r in rows.filter("key < 9").collect()) == [(1, 1), (1, 2), (2, 1), (2, 2), (3, 1)]


def test_state_of_records_stays_bounded(spark):
    """A thousand keys come one after another; keys without news are dropped, so the state never holds them all."""
    files = [[(100 * f + k, 30 * f, 30 * f, 1, 0.0) for k in range(100)] for f in range(10)]
    path = T.scratch(spark)
    changes = S.latest_known(_records(spark, files), "key", ["available", "revision"], "available", "ingested", "1 day", 40)
    q = S.upsert(changes, path)
    assert S.upserted(spark, path, changes.schema, "key", ["available", "revision"]).count() >= 900
    held = [json.loads(p.json)["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if json.loads(p.json)["stateOperators"]]
    assert 0 < max(held) < 1500  # a record and its timers; 1000 keys would hold 3000


def test_records_that_never_count_are_not_kept(spark):
    """400 revisions of a record, each better than the last, become known at once: one is kept, with one timer."""
    files = [[(1, 0, 5, rev, 0.0) for rev in range(400)], [(9, 6, 6, 1, 0.0)], [(9, 30, 30, 2, 0.0)], [(9, 60, 60, 3, 0.0)]]
    path, order = T.scratch(spark), ["available", "revision"]
    changes = S.latest_known(_records(spark, files), "key", order, "available", "ingested", "2 days", 1000)
    q = S.upsert(changes, path)
    assert {r.key: r.revision for r in S.upserted(spark, path, changes.schema, "key", order).collect()}[1] == 399
    held = [sum(x["numRowsTotal"] for x in json.loads(p.json)["stateOperators"]) for p in q.recentProgress if json.loads(p.json)["stateOperators"]]
    assert 0 < max(held) < 20


@pytest.mark.parametrize("groups", [5, 10_000])
def test_tasks_send_on_the_best_rows_of_same_times(groups):
    rng = np.random.default_rng(groups)
    rows = [(int(g), [None, "a", "b"][int(a)], int(b)) for g, a, b in zip(rng.integers(0, groups, 3000), rng.integers(0, 3, 3000), rng.permutation(3000))]
    batches = [pa.RecordBatch.from_pylist([dict(zip("gab", r)) for r in rows[i : i + 70]]) for i in range(0, 3000, 70)]
    got = [tuple(r[c] for c in "gab") for b in S._best_of(["g"], ["a", "b"], 200)(iter(batches)) for r in b.to_pylist()]
    rank = lambda r: (r[1] or "", r[2])
    best = lambda x: {g: max((r for r in x if r[0] == g), key=rank) for g in {r[0] for r in x}}
    assert set(got) <= set(rows) and best(got) == best(rows) and (len(got) == 5 if groups == 5 else len(got) <= 3000)


def test_each_watermark_sees_the_best_known_record(spark):
    """Batches of records in any order, some available long after they came: the table after each watermark is the one of a
    plain loop over all records, and only keys whose record changed are written."""
    rng = np.random.default_rng(5)
    files, n = [], 0
    for f in range(6):
        files.append([])
        for i in rng.integers(0, 20, 120).tolist():
            n += 1
            files[-1].append((int(rng.integers(1, 9)), int(rng.choice([f * 20 + i - 30, f * 20 + i, f * 20 + i + 25])), f * 20 + i, int(rng.permutation(7)[0]), n))
    files += [[(99, 400, 400, 1, 0)], [(99, 800, 800, 1, 0)]]
    path, order = T.scratch(spark), ["available", "revision", "value"]
    changes = S.latest_known(_records(spark, files), "key", order, "available", "ingested", "25 days", 5000)
    S.upsert(changes, path)
    got = [(r.batch, r.key, r.value) for r in spark.read.option("basePath", f"{path}/changes").parquet(f"{path}/changes/batch=*").filter("key < 99").collect()]
    best, want, seen = {}, [], []
    for rows in files:
        seen += rows
        now = max(r[2] for r in seen) - 25
        known = {}
        for k, a, i, rev, v in seen:
            if max(a, i) <= now and k < 99:
                known[k] = max(known.get(k, (-999,)), (a, rev, v))
        want += [(k, float(known[k][2])) for k in known if best.get(k) != known[k]]
        best = known
    assert len(want) > 20 and sorted(x[1:] for x in got) == sorted(want)


def test_parts_of_large_tables_are_batches_of_many_files(spark, monkeypatch):
    """A part is written by several tasks and still read as one batch, before the next: rows late by a part are not lost."""
    from panelwright.plans import streaming_queries as Q

    paths, scratch = [], T.scratch
    monkeypatch.setattr(Q, "_ROWS_A_FILE", 100, raising=False)
    monkeypatch.setattr(T, "scratch", lambda x: paths.append(scratch(x)) or paths[-1])
    df = spark.range(0, 4000, 1, 5).select((F.col("id") % 3000).alias("id")).filter("id < 2950").select("id", (F.col("id") + 1000).cast("timestamp").alias("at"))
    stream = replay(df, 4, F.col("id"), spark.createDataFrame([(10**6, dt.datetime(1990, 1, 1))], "id long, at timestamp"))
    assert len(spark.read.parquet(paths[0]).inputFiles()) == 4 * 7 + 1
    q = stream.withWatermark("at", "5 seconds").groupBy("at").count().writeStream.format("noop").outputMode("append").option("checkpointLocation", scratch(spark)).trigger(availableNow=True).start()
    q.awaitTermination()
    progress = [json.loads(p.json) for p in q.recentProgress]
    assert [p["numInputRows"] for p in progress if p["numInputRows"]] == [1476, 999, 738, 737, 1]
    assert sum(x["numRowsDroppedByWatermark"] for p in progress for x in p["stateOperators"]) == 0


def test_repeated_bars_leave_the_state(spark):
    rows = [(1, DAY + dt.timedelta(days=7 * i), 1.0, 1.0, 1.0, 1.0, 5.0) for i in range(60)]
    df = spark.createDataFrame(rows, "inst int, at timestamp, open double, high double, low double, close double, volume double")
    stream = replay(df, 12, F.unix_date(F.to_date("at")))
    q = S.bar_quality(stream, ["inst", "at"], "at", "14 days").writeStream.format("noop").option("checkpointLocation", T.scratch(spark)).trigger(availableNow=True).start()
    q.awaitTermination()
    held = [json.loads(p.json)["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if json.loads(p.json)["stateOperators"]]
    assert held and max(held) < 20
