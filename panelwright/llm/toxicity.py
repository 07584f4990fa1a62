"""Weighted finite-state grammar for toxicity: insult, threat, target, negation and reported-speech transducers over clauses."""
from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import materialize, read_table

#: Labelled rows that the lexicon and the weights are fitted on, at most, taken by the hash of their id.
SAMPLE = 40_000
#: Lexicon entries (whole words and word beginnings), at most; share of toxic documents among those that have one.
ENTRIES, PRECISION, SUPPORT = 4096, 0.8, 4
#: Log-likelihood gain of an entry over the share of toxic documents, at least: rare by chance.
GAIN = 9.0
THRESHOLD = 0.3
THREAT = frozenset("kill hurt destroy burn shoot stab beat punch strangle töten umbringen tuer frapper matar golpear".split())
TARGET = frozenset("you your yourself he she they him her them this that du dich dein ihr euch sie tu toi ton vous ils elle tú usted ustedes ellos ella".split())
NEGATION = frozenset("not no never isn't aren't don't nicht kein keine nie pas jamais non nunca ningún".split())
REPORT = frozenset("said says wrote called quoted reported claims sagte schrieb nannte dit écrit appelle dijo escribió llamó".split())
#: A colon or a quotation mark ends no clause: what is said belongs to who says it.
CLAUSE = re.compile(r"[.!?;\n]+(?=[\s\"'”»)]*(?:\s|$))|\n")
TOKEN = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
#: Kinds of matched clause, by the composed transducer's output.
KINDS = ("insult", "targeted", "threat", "negated", "reported")

# Weighted transducers over the classes of a clause's words. An arc maps (state, class) to (state, output class, weight);
# "*" stands for every other class, which is put out as it is. A weight of None is that of the word in the lexicon. The
# negation transducer comes first and rewrites what stands within three words after a negation; the others read its output
# side by side (their product), and their final states name the clause.
THREAT_WEIGHT = 1.0
_HITS = (("INSULT", None), ("THREAT", 0.0))
NEGATE = {
    **{(k, "NEGATION"): (1, "NEGATION", 0.0) for k in range(4)},
    **{(k, c): ((k + 1) % 4, f"NOT_{c}", w) for k in (1, 2, 3) for c, w in _HITS},
    **{(k, "*"): ((k + 1) % 4, None, 0.0) for k in (1, 2, 3)},
    (0, "INSULT"): (0, "INSULT", None),
}
MACHINES = {
    "insult": {(0, "INSULT"): (1, None, 0.0)},
    "denied": {(0, "NOT_INSULT"): (1, None, 0.0), (0, "NOT_THREAT"): (1, None, 0.0)},
    "threat": {(0, "THREAT"): (1, None, 0.0), (1, "TARGET"): (2, None, THREAT_WEIGHT)},
    "target": {(0, "TARGET"): (1, None, 0.0), (0, "INSULT"): (2, None, 0.0), (1, "INSULT"): (3, None, 0.0), (2, "TARGET"): (3, None, 0.0)},
    "report": {(0, "REPORT"): (1, None, 0.0)},
}


def clause_path(classes: list[str], weights: list[float] | None = None) -> tuple[str | None, float]:
    """Kind of a clause, and the weight of its path through the composed transducers."""
    state, negation, total = dict.fromkeys(MACHINES, 0), 0, 0.0
    for k, c in enumerate(classes):
        own = weights[k] if weights else 1.0
        negation, out, w = NEGATE.get((negation, c)) or NEGATE.get((negation, "*")) or (negation, None, 0.0)
        total += own if w is None else w
        for name, arcs in MACHINES.items():
            to = arcs.get((state[name], out or c))
            if to:
                state[name] = to[0]
                total += to[2]
    if not state["insult"] and state["threat"] < 2:
        return ("negated" if state["denied"] else None), total
    if state["report"]:
        return "reported", total
    if state["threat"] == 2:
        return "threat", total
    return ("targeted" if state["target"] == 3 else "insult"), total


def clause_kind(classes: list[str]) -> str | None:
    return clause_path(classes)[0]


class Grammar:
    """The lexicon with its weights, and the features of a text."""

    def __init__(self, lexicon: dict[str, float]):
        self.whole = {k[1:]: v for k, v in lexicon.items() if k[0] == "="}
        self.begins = {k[1:]: v for k, v in lexicon.items() if k[0] == "^"}
        self.lengths = sorted({len(k) for k in self.begins})
        stems = sorted({k[1:] for k in lexicon} | THREAT)
        self._stems = stems
        self._automaton = None

    def __getstate__(self):
        return self.__dict__ | {"_automaton": None}

    def automaton(self):
        if self._automaton is None:
            import ahocorasick

            self._automaton = ahocorasick.Automaton()
            for s in self._stems:
                self._automaton.add_word(s, len(s))
            self._automaton.make_automaton()
        return self._automaton

    def weight(self, word: str) -> float:
        return max(self.whole.get(word, 0.0), *(self.begins.get(word[:n], 0.0) for n in self.lengths if len(word) >= n), 0.0) if self.lengths else self.whole.get(word, 0.0)

    def features(self, text: str | None) -> np.ndarray:
        """Per kind: weight of the paths of its clauses, damped; then the heaviest clause's weight and the share of matched clauses."""
        out = np.zeros(len(KINDS) + 2)
        if not text or not self._stems:
            return out
        low = text.lower()
        hits = [e - n + 1 for e, n in self.automaton().iter(low) if e == n - 1 or not low[e - n].isalpha()]
        if not hits:
            return out
        n_clauses, matched, at, k = 0, 0, 0, 0
        bounds = [m.span() for m in CLAUSE.finditer(low)] + [(len(low), len(low))]
        for a, b in bounds:
            n_clauses += 1
            if k < len(hits) and hits[k] < a:
                words = TOKEN.findall(low[at:a])
                weights = [self.weight(w) for w in words]
                classes = ["INSULT" if x else "THREAT" if w in THREAT else "NEGATION" if w in NEGATION else "REPORT" if w in REPORT else "TARGET" if w in TARGET else "OTHER" for w, x in zip(words, weights)]
                kind, weight = clause_path(classes, weights)
                if kind:
                    matched += 1
                    out[KINDS.index(kind)] += weight
                    out[-2] = max(out[-2], weight)
            while k < len(hits) and hits[k] < b:
                k += 1
            at = b
        out[-1] = matched / max(n_clauses, 1)
        out[: len(KINDS)] = np.log1p(np.maximum(out[: len(KINDS)], 0))
        out[-2] = np.log1p(max(out[-2], 0))
        return out


def _entry_counts(batches):
    """(entry, toxic documents, other documents) of each batch; an entry is a whole word or a beginning of 4 to 6 letters."""
    for batch in batches:
        pos, neg = Counter(), Counter()
        for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            words = {w for w in TOKEN.findall((text or "").lower()) if len(w) >= 4}
            (pos if y else neg).update({"=" + w for w in words} | {"^" + w[:n] for w in words for n in (4, 5, 6) if len(w) > n})
        keys = list(pos.keys() | neg.keys())
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([pos[k] for k in keys], pa.int64()), pa.array([neg[k] for k in keys], pa.int64())], names=["entry", "pos", "neg"])


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 50) -> np.ndarray:
    """Ridge logistic weights and intercept by Newton steps that are halved until the loss falls."""
    x = np.column_stack([x, np.ones(len(x))])
    pull = np.append(np.full(x.shape[1] - 1, ridge), 1e-6)

    def loss(w):
        z = x @ w
        return np.logaddexp(0, z).sum() - (y * z).sum() + 0.5 * (pull * w * w).sum()

    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x + np.diag(pull), x.T @ (p - y) + pull * w)
        size = 1.0
        while size > 1e-4 and loss(w - size * step) > loss(w):
            size /= 2
        if size <= 1e-4:
            break
        w = w - size * step
    return w


def _feature_rows(grammar):
    def run(batches):
        for batch in batches:
            x = [grammar.value.features(t).tolist() for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), batch.column(1)], names=["x", "toxic"])

    return run


def fit(docs: DataFrame, labels: DataFrame) -> tuple[Grammar, np.ndarray]:
    """Lexicon and clause weights from labelled rows that are not held out: SAMPLE rows at most, the lexicon counted by Spark.

    A document or text with labels that differ counts as toxic. Null labels and ids do not count; without rows of both
    kinds the lexicon is empty and every text has the score of the prior.
    """
    spark = docs.sparkSession
    train = labels.filter("doc_id is not null and toxic is not null").filter(~held_out("doc_id")).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    train = train.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    rows = materialize(docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(train), "doc_id").groupBy("text").agg(F.max("toxic").alias("toxic")), "labelled")
    total = rows.agg(F.sum("toxic").alias("p"), F.count("*").alias("n")).first()
    p, n = total.p or 0, total.n - (total.p or 0)
    if not p or not n:
        return Grammar({}), np.append(np.zeros(len(KINDS) + 2), np.log((p + 0.5) / (n + 0.5)))
    counts = rows.mapInArrow(_entry_counts, "entry string, pos long, neg long").groupBy("entry").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    share = F.greatest(F.least(F.col("pos") / (F.col("pos") + F.col("neg")), F.lit(1 - 1e-9)), F.lit(1e-9))
    gain = F.col("pos") * F.log(share * (p + n) / p) + F.col("neg") * F.log((1 - share) * (p + n) / n)
    good = counts.filter((gain >= GAIN) & (F.col("pos") >= SUPPORT) & (F.col("pos") * (1 - PRECISION) >= F.col("neg") * PRECISION)).withColumn("weight", F.log((F.col("pos") + 0.5) / p) - F.log((F.col("neg") + 0.5) / n))
    top = good.orderBy(F.desc(F.col("pos") * F.col("weight")), "entry").limit(ENTRIES).toArrow().to_pylist()
    grammar = Grammar({r["entry"]: r["weight"] for r in top})
    shared = spark.sparkContext.broadcast(grammar)
    fitted = rows.mapInArrow(_feature_rows(shared), "x array<double>, toxic int").toArrow()
    x = np.array(fitted.column("x").to_pylist(), float).reshape(-1, len(KINDS) + 2)
    return grammar, _logistic(x, fitted.column("toxic").to_numpy().astype(float))


def held_out(doc_id: str, parts: int = 4, part: int = 2):
    """Whether crc32(doc_id as text) mod parts is part; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % parts == part, F.lit(False))


def score_toxicity(docs: DataFrame, grammar: Grammar, weights: np.ndarray) -> DataFrame:
    """doc_id, held_out, score, predicted of every row. Only the text decides the score; null counts as empty; repeated rows stay."""
    shared = docs.sparkSession.sparkContext.broadcast((grammar, weights))

    def run(batches):
        g, w = shared.value
        for batch in batches:
            x = np.array([g.features(t) for t in batch.column(2).to_pylist()]).reshape(-1, len(KINDS) + 2)
            score = 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out("doc_id").alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def op1_clause_grammar(spark, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return score_toxicity(docs, *fit(docs, read_table(spark, sf_dir, "labels")))


QUERIES = {"op1_clause_grammar": op1_clause_grammar}
ORACLES: dict = {}
