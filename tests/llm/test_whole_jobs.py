"""What earlier forms of the text operators left out."""
import numpy as np
import pyarrow as pa
import pytest

from panelwright.llm import decontaminate, language_model, mixing, secrets, words

SF = "/root/testdata/sf0.01"


def test_a_rare_cell_does_not_thin_the_sample(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "source", "lang")
    rare = d.unionByName(spark.createDataFrame([(10**9, " ".join(f"r{i}" for i in range(12)), "one-off", "xx")], d.schema))
    every = d.limit(0)
    for _ in range(5):
        every = every.unionByName(d)
    kept = {}
    for name, x in (("plain", d), ("rare", rare), ("grown", every)):
        n = x.select(mixing.F.sum(mixing.F.regexp_count("text", mixing.F.lit(mixing.WORD)))).first()[0]
        got = mixing._drawn(x, mixing.mixing_rates(x, budget=mixing.BUDGET)).selectExpr("sum(n_tokens * probability) t", "min(probability) p", "max(probability) q", "count(*) n").first()
        assert got.t == pytest.approx(mixing.BUDGET * n, rel=1e-4) and got.p > 0 and got.q <= 1
        kept[name] = mixing.sample_mix(x).count() / got.n
    assert kept["rare"] == pytest.approx(kept["plain"], abs=0.01) and kept["grown"] == pytest.approx(kept["plain"], abs=0.01)
    assert kept["plain"] > 0.4


def test_rates_of_a_budget_by_hand(spark):
    cells = [("a", "x", 100), ("b", "x", 10), ("c", "x", 1)]
    d = spark.createDataFrame([(i, "w " * n, s, t) for i, (s, t, n) in enumerate(cells)], "doc_id long, text string, source string, lang string")
    rates = {r.source: r for r in mixing.mixing_rates(d, temper=0.0, budget=0.5).collect()}
    # equal shares of 37 tokens: c and b keep all they have, a fills the rest of 55.5 tokens
    assert rates["b"].probability == rates["c"].probability == 1 and rates["a"].probability == pytest.approx(0.445)
    assert all(r.probability == 1 for r in mixing.mixing_rates(d, budget=1.0).collect())


def cut(texts):
    return words.split(*words.text_buffers(pa.array(texts)), lower=True)


def test_the_language_model_learns_from_all_words(spark):
    texts = [f"{'a b ' * (300 + i % 50 * 8)}{'c d e f ' * 150}t{i}" for i in range(480)]  # out of step with each other
    table, flat, _ = language_model.fit(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "'en' lang").repartition(2))
    score, *_ = language_model.score_documents(language_model.Net(flat, table), cut(["c d e f " * 50, "a b " * 100]), table)
    assert all(score / 201 > -2)  # words after the 576th of each text are learnt like the first
    trainer = language_model.Trainer(language_model.Net(flat, table), table)
    for some in (texts[:200], ["", "a"], ["a b " * 9000], texts[:3]):
        trainer.read(cut(some))
    trainer.finish()
    assert trainer.tokens == sum(len(t.split()) + 1 for t in texts[:200] + texts[:3]) + 1 + 2 + 18001


def test_gradients_by_differences():
    texts = ["a b c a b", "b c", "", "c a a b c a c b"]
    w = cut(texts)
    hashes, counts = np.unique(language_model._word_keys(w), return_counts=True)
    table = language_model.Table(hashes, counts, np.zeros(len(hashes), int), len(w.doc) + 4, 4, 4)
    start = language_model.Net.start(table)
    trainer = language_model.Trainer(language_model.Net(start, table), table)
    trainer.read(w)
    trainer.finish()
    grads = {k: v / 0.1 for k, v in trainer.m1.items()}
    assert trainer.updates == 1
    for k, g in grads.items():
        i = np.unravel_index(np.abs(g).argmax(), g.shape)
        loss = []
        for e in (1e-2, -1e-2):
            net = language_model.Net(start, table)
            net.p[k][i] += e
            loss.append(-language_model.score_documents(net, w, table)[0].sum() / (len(w.doc) + 4))
        assert (loss[0] - loss[1]) / 2e-2 == pytest.approx(g[i], rel=0.02, abs=1e-4), k


def test_edited_benchmark_passages_are_found(spark):
    item = [f"q{i}" for i in range(30)]
    asked = [*(f"a{i}" for i in range(12)), "end?", "one", "two", "three"]
    edits = [" ".join([*x[:k], "changed", *x[k + 1 :]]) for x in (item, asked) for k in range(len(x))]
    tenth = " ".join("changed" if k % 10 == 4 else f"({x})," for k, x in enumerate(item))
    shuffled = " ".join(item[::-1])
    b = spark.createDataFrame([(1, " ".join(item)), (2, " ".join(asked))], "item_id long, text string")
    texts = ["pad " * 9 + x + " pad" * 150 for x in [*edits, tenth, shuffled]]
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), b).collect()}
    assert got == {(i, 1 if i < 30 or i == len(edits) else 2) for i in range(len(edits) + 1)}
    assert decontaminate._overlap(decontaminate.bare(" ".join(item)), decontaminate.bare(tenth)) == pytest.approx(0.9)


def test_overlap_by_brute_force():
    rng = np.random.default_rng(3)
    for _ in range(200):
        a, b = (rng.integers(0, 5, rng.integers(1, 12)).astype(str).tolist() for _ in range(2))
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        assert decontaminate._overlap(a, b) == pytest.approx(t[-1][-1] / len(a))


@pytest.mark.parametrize("key", ["eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIxMjM0NTY3ODkwIn0.dozjgNryP4J3jVmNHl0w5N_XgL0n3I9P", "qZxKpVwRtYbNmLcDfGhJsXeQ", "SG.q7Zx9Kp2Vw8Rt5Yb1Nm4aa.Kx8Vq2Zt7Rw9Yp4Lm1Nc6Bd3"])
def test_dotted_and_letter_secrets(key):
    text = f"see {key}. Next"
    (a, b, kind), = secrets.token_spans(text, [])
    assert kind == "token" and text[a:b] == key.removeprefix("SG.")


def test_hosts_mail_and_words_are_no_secrets():
    assert not secrets.token_spans("www.some-long-hostname-xkqzvw.example.com first.lastname-of-one@xkqzvwpt.example.org internationalization-of-words invoice_1234567890123456 https://example.org/path/to/article", [])


def test_scores_do_not_depend_on_partitions(spark, monkeypatch):
    monkeypatch.setattr(language_model, "NET_TOKENS", 40_000)  # several nets
    d = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    a, b = ({r.doc_id: r.score for r in language_model.score_corpus(d.repartition(n)).collect()} for n in (2, 16))
    assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k], rel=1e-4, abs=1e-3) for k in a)


def test_scores_by_a_plain_loop(spark):
    texts = ["a b c a b", "b c", "", "c a a b c a c b", "d e f"] * 30
    table, flat, _ = language_model.fit(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "'en' lang"))
    net = language_model.Net(flat, table)
    docs = ["a b c d", "", "b z b", "f " * 40]
    got, *_ = language_model.score_documents(net, cut(docs), table)
    p = {k: v.astype(float) for k, v in net.p.items()}
    n, f = language_model.HIDDEN, language_model.FREQUENT
    for doc, score in zip(docs, got):
        h, prev, total = np.zeros(n), f + table.end, 0.0
        w = cut([doc])
        at, known = table.look_up(language_model._word_keys(w))
        steps = [(table.cls[i], table.place[i], table.input_id[i], table.share[i]) if k else (table.rare, -1, f + table.rare, 0.0) for i, k in zip(at, known)]
        for c, place, token, share in [*steps, (table.end, -1, None, 0.0)]:
            x, g = p["x"][prev], h @ p["u"]
            z, r = (1 / (1 + np.exp(-(x[k * n : k * n + n] + g[k * n : k * n + n]))) for k in (0, 1))
            new = np.tanh(x[2 * n :] + r * g[2 * n :])
            h = new + z * (h - new)
            logits = np.where(table.live, h @ p["v"] + p["b"], -np.inf)
            total += logits[c] - np.log(np.exp(logits).sum()) + share
            if place >= 0:
                inner = (p["w"][c] @ h + p["wb"][c])[: table.cluster_sizes[c]]
                total += inner[place] - np.log(np.exp(inner).sum())
            prev = token
        assert score == pytest.approx(total, rel=1e-4, abs=1e-4)


def test_the_commonest_words_are_whole_steps(spark):
    d = spark.createDataFrame([(i, c, 0) for i, c in enumerate([1] * 50 + [2] * 20 + [7] * 5 + [5000] * 3)], "h long, c long, lang int")
    assert sorted(r.c for r in language_model.commonest(d, 30).collect()) == [2] * 20 + [7] * 5 + [5000] * 3
    assert language_model.commonest(d, 2).count() == 0 and language_model.commonest(d, 100).count() == 78
