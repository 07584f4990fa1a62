"""A gated recurrent language model in numpy: class-factored softmax, truncated backpropagation, whole-document scores.

Tokens are lower-cased words and one end per document. The FREQUENT commonest words are output through clusters with a
softmax of their own; other words of the table of TABLE words through classes of like language and frequency, inside
which a word has its share of the training counts; all remaining words, unseen ones included, through one rare class
with add-one shares. So the probabilities of the known words and of "any unseen word" sum to one at every place.
"""
from __future__ import annotations

from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import materialize, read_table
from .toxicity import held_out
from .words import runs, signed, split

#: Words in the broadcast table, at most; words with an output weight each, and their clusters.
TABLE, FREQUENT, CLUSTERS = 1 << 18, 256, 16
#: Language slots (a hash of `lang`) and frequency bins of the classes of the other table words.
LANGS, BINS = 16, 4
HIDDEN, WINDOW = 16, 24
#: Training: rounds of weight averaging (each document is learnt from in one of them), documents that are read at once,
#: tokens that one of the averaged nets learns from, about, and such nets at most.
ROUNDS, LANES = 2, 512
NET_TOKENS, MAX_NETS = 2_000_000, 4096
#: Bytes of text scored together; counts of words that a task holds before it sends them on.
SCORE_BYTES, HELD_COUNTS = 8_000_000, 1_000_000
ALL_CLASSES = CLUSTERS + LANGS * BINS + 2


def _code(input_id, cls, place):
    return (np.asarray(input_id, np.int32) << 16) | (np.asarray(cls, np.int32) << 8) | (np.asarray(place, np.int32) + 1)


class Table:
    """The broadcast words: hashes ascending, with count, input id, class and, for frequent words, place in the cluster."""

    def __init__(self, hashes, counts, langs, total: int, distinct: int, ends: int):
        n = len(hashes)
        rank = np.lexsort((hashes, -counts))
        self.total, self.distinct, self.ends = total, distinct, ends
        cls, place, input_id = np.zeros(n, np.int16), np.full(n, -1, np.int16), np.zeros(n, np.int16)
        bins = np.minimum(np.arange(n) * 4 // max(n, 1) if n < 64 else (np.log2(1 + np.arange(n) / FREQUENT) / np.log2(1 + n / FREQUENT) * BINS).astype(int), BINS - 1)
        cls[rank] = CLUSTERS + langs[rank] * BINS + bins
        # only classes that occur have a number, and with it an output and an input
        top = rank[:FREQUENT]
        top = top[np.lexsort((-counts[top], langs[top]))]  # clusters of like language
        size = -(-max(len(top), 1) // CLUSTERS)
        cls[top], place[top] = np.arange(len(top)) // size, np.arange(len(top)) % size
        live = np.zeros(ALL_CLASSES, bool)
        live[np.arange(CLUSTERS)] = True
        live[cls] = True
        live[-2:] = True
        self.classes = int(live.sum())
        self.rare, self.end = self.classes - 2, self.classes - 1
        cls = (np.cumsum(live) - 1)[cls].astype(np.int16)
        input_id[:] = FREQUENT + cls
        input_id[top] = np.arange(len(top))
        self.cluster_sizes = np.bincount(cls[top], minlength=CLUSTERS) if len(top) else np.zeros(CLUSTERS, int)
        self.width = size
        sums = np.bincount(cls, weights=counts, minlength=self.classes)
        order = np.argsort(hashes)
        self.hashes, self.counts = hashes[order], counts[order].astype(np.float64)
        share = np.where(place >= 0, 0.0, np.log(np.maximum(counts, 1) / np.maximum(sums[cls], 1)))
        self.cls, self.place, self.input_id, self.share = cls[order], place[order], input_id[order], share[order].astype(np.float32)
        #: input id, class and place + 1 of each word and, last, of a word that the table does not have; of the end
        self.codes = np.append(_code(self.input_id, self.cls, self.place), _code(FREQUENT + self.rare, self.rare, -1))
        self.end_code = _code(FREQUENT + self.end, self.end, -1)
        #: clusters without a word can not occur: no probability goes to them
        self.live = np.ones(self.classes, bool)
        self.live[:CLUSTERS] = self.cluster_sizes > 0
        #: where the hashes of each prefix begin; a prefix has half a hash or less on average
        self.shift = np.uint64(63 - n.bit_length())
        self.begins = np.searchsorted(self.hashes, np.arange(2 << n.bit_length(), dtype=np.uint64) << self.shift).astype(np.int32)

    def look_up(self, h):
        """Index of each hash, and whether the table has it."""
        n = len(self.hashes)
        if not n:
            return np.zeros(len(h), np.int64), np.zeros(len(h), bool)
        at = np.minimum(self.begins[h >> self.shift], n - 1)
        on = np.flatnonzero(self.hashes[at] < h)
        while len(on):
            at[on] += 1
            on = on[at[on] < n]
            on = on[self.hashes[at[on]] < h[on]]
        at = np.minimum(at, n - 1)
        return at, self.hashes[at] == h


def _merge(keys, counts):
    key, at = np.unique(np.concatenate(keys), return_inverse=True)
    return key, np.bincount(at, weights=np.concatenate(counts), minlength=len(key)).astype(np.int64)


def _count_rows(batches):
    """Counts by word and language, merged inside the task as long as few enough are held."""

    def rows_of(keys, counts):
        u, c = _merge(keys, counts)
        return pa.RecordBatch.from_arrays([pa.array(signed(u & ~np.uint64(LANGS - 1))), pa.array((u & np.uint64(LANGS - 1)).astype(np.int32)), pa.array(c)], names=["h", "lang", "c"])

    keys, counts, held = [], [], 0
    for batch in batches:
        for rows, offsets, data in runs(batch):
            w = split(offsets, data, lower=True)
            lang = rows.column(1).to_numpy(zero_copy_only=False)[w.doc].astype(np.uint64)
            u, c = np.unique(_word_keys(w) | lang, return_counts=True)  # low bits of the hash make room for the language
            keys.append(u)
            counts.append(c)
            held += len(u)
            if held > HELD_COUNTS:
                yield rows_of(keys, counts)
                keys, counts, held = [], [], 0
    if keys:
        yield rows_of(keys, counts)


def _word_keys(words):
    return words.hash & ~np.uint64(LANGS - 1)


def _groups(k):
    """(value, from, to) of each run of equal values in an ascending array."""
    first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, int)
    return zip(k[first].tolist(), first.tolist(), [*first[1:].tolist(), len(k)])


class Scratch:
    """Arrays by name that are filled again and again: the system would have to clear fresh ones of this size each time."""

    def __init__(self):
        self.held: dict[str, np.ndarray] = {}

    def __call__(self, name: str, *shape: int) -> np.ndarray:
        n = int(np.prod(shape))
        if name not in self.held or len(self.held[name]) < n:
            self.held[name] = np.empty(n, np.float32)
        return self.held[name][:n].reshape(shape)


class Net:
    @staticmethod
    def shapes(table: Table) -> dict[str, tuple[int, ...]]:
        c = table.classes
        return {"x": (FREQUENT + c, 3 * HIDDEN), "u": (HIDDEN, 3 * HIDDEN), "v": (HIDDEN, c), "b": (c,), "w": (CLUSTERS, FREQUENT // CLUSTERS + 1, HIDDEN), "wb": (CLUSTERS, FREQUENT // CLUSTERS + 1)}

    def __init__(self, flat: np.ndarray, table: Table):
        self.p, i, self.scratch = {}, 0, Scratch()
        for k, s in self.shapes(table).items():
            n = int(np.prod(s))
            self.p[k] = flat[i : i + n].reshape(s).astype(np.float32)
            i += n
        self.mask = np.where(table.live, 0, -1e9).astype(np.float32)
        self.place_mask = np.where(np.arange(self.p["wb"].shape[1]) < table.cluster_sizes[:, None], 0, -1e9).astype(np.float32)

    @classmethod
    def start(cls, table: Table) -> np.ndarray:
        n = sum(int(np.prod(s)) for s in cls.shapes(table).values())
        return (np.random.Generator(np.random.PCG64(4)).standard_normal(n) * 0.1).astype(np.float32)

    def flat(self) -> np.ndarray:
        return np.concatenate([v.ravel() for v in self.p.values()])

    def gates(self) -> tuple[np.ndarray, np.ndarray]:
        """Input and recurrent weights, one array a gate (update, reset, candidate), scaled so that 1 / (1 + exp(.)) gives
        the two gates and, since tanh(x) = 2 / (1 + exp(-2x)) - 1, half of one more than the candidate."""
        return tuple(_by_gate(self.p[k]) * np.array([-1, -1, -2], np.float32)[:, None, None] for k in ("x", "u"))

    def outputs(self, h, cls, place, gradient: bool = True):
        """Log-probability of each class and place given the states, with the pieces that the gradient needs if it is asked for
        (they last until the next call)."""
        # a row a class: reductions and steps run along the states
        logits = np.matmul(self.p["v"].T, h.T, out=self.scratch("logits", len(self.p["b"]), len(h)))
        logits += (self.p["b"] + self.mask)[:, None]
        logits -= logits.max(axis=0)
        out = logits[cls, np.arange(len(h))]
        e = np.exp(logits, out=logits)
        s = e.sum(axis=0)
        out -= np.log(s)
        f = np.flatnonzero(place >= 0)
        inner = None
        if len(f):
            f = f[np.argsort(cls[f].astype(np.int16), kind="stable")]  # by cluster: one product each
            clusters, hf, bias = list(_groups(cls[f])), h[f], self.p["wb"] + self.place_mask
            li = self.scratch("inner", bias.shape[1], len(f))
            for c, i, j in clusters:
                np.add(self.p["w"][c] @ hf[i:j].T, bias[c][:, None], out=li[:, i:j])
            li -= li.max(axis=0)
            own = li[place[f], np.arange(len(f))]
            ei = np.exp(li, out=li)
            si = ei.sum(axis=0)
            out[f] += own - np.log(si)
            inner = (f, clusters, hf, np.divide(ei, si, out=ei)) if gradient else None
        return out, (np.divide(e, s, out=e) if gradient else None), inner


def _by_gate(w):
    return np.ascontiguousarray(w.reshape(len(w), 3, HIDDEN).transpose(1, 0, 2))


def _logistic(x) -> None:
    np.exp(x, out=x)
    x += 1
    np.reciprocal(x, out=x)


def _advance(a, h, u, new):
    """The states after one token into `new`. `a` has the inputs' part of `Net.gates` and becomes update gate, reset gate and
    candidate; what the states give to the candidate comes back, times -2."""
    g = np.matmul(h, u)
    zr, n = a[:2], a[2]
    zr += g[:2]
    _logistic(zr)
    n += np.multiply(a[1], g[2], out=g[0])
    _logistic(n)
    n *= 2
    n -= 1
    np.subtract(h, n, out=new)
    new *= a[0]
    new += n
    return g[2]


def _take(x, ids, scratch):
    """Rows of each gate's input weights: gate, shape of the ids, HIDDEN."""
    out = scratch("gates", 3, *ids.shape, HIDDEN)
    for gate, rows in zip(x, out):
        np.take(gate, ids, axis=0, out=rows, mode="clip")  # ids are in range; this mode fills `out` directly
    return out


def _sequences(words, table: Table):
    """Code of each word, its row in the table (one beyond the last if it has none), and whether it has one."""
    at, has = table.look_up(_word_keys(words))
    at = np.where(has, at, len(table.hashes))
    return table.codes[at], at, has


class Trainer:
    """Truncated backpropagation with Adam over whole documents: each of LANES lanes reads a document to its end, its
    state going on from window to window and from one call of `read` to the next, and then takes the next document."""

    def __init__(self, net: Net, table: Table):
        self.net, self.table, self.tokens, self.updates = net, table, 0, 0
        self.m1, self.m2 = ({k: np.zeros_like(v) for k, v in net.p.items()} for _ in range(2))
        self.h = np.zeros((LANES, HIDDEN), np.float32)
        self.queue: deque = deque()
        self.lanes: list = [None] * LANES
        self.waiting = 0  # tokens in the queue

    def read(self, words) -> None:
        code = _sequences(words, self.table)[0]
        n = len(words.first) - 1
        at = np.arange(len(code)) + words.doc  # each document has one more target than words: its end
        first = words.first + np.arange(n + 1)
        target, source = (np.full(len(code) + n, self.table.end_code, np.int32) for _ in range(2))
        target[at], source[at + 1] = code, code
        source[first[:-1]] = self.table.end_code
        flow = (source & ~0xFFFF) | (target & 0xFFFF)  # input id, class and place + 1 of each target
        self.queue.extend(flow[i:j] for i, j in zip(first[:-1].tolist(), first[1:].tolist()))
        self.waiting += len(flow)
        while self.waiting >= LANES * WINDOW:  # the window is full whatever comes next, so calls may cut the documents anywhere
            self.window()

    def finish(self) -> None:
        while self.queue or any(x is not None for x in self.lanes):
            self.window()

    def window(self) -> None:
        flow = np.zeros((LANES, WINDOW), np.int32)
        fresh, count = np.zeros((LANES, WINDOW), bool), np.zeros(LANES, int)
        for i, lane in enumerate(self.lanes):
            k = 0
            while k < WINDOW and (lane is not None or self.queue):
                if lane is None:
                    lane, fresh[i, k] = self.queue.popleft(), True
                    self.waiting -= len(lane)
                m = min(WINDOW - k, len(lane))
                flow[i, k : k + m] = lane[:m]
                lane, k = lane[m:] if m < len(lane) else None, k + m
            self.lanes[i], count[i] = lane, k
        used = np.flatnonzero(count)
        if len(used):
            live = np.arange(WINDOW)[:, None] < count[used]
            self.tokens += int(live.sum())
            self.h[used] = self.update(flow[used].T, fresh[used].T, live, self.h[used])

    def update(self, flow, fresh, live, h):
        """One step of Adam on a window (places x lanes); the lanes' last states."""
        net, p, b = self.net, self.net.p, flow.shape[1]
        flow = np.ascontiguousarray(flow)
        prev, cls, place = (flow >> 16).astype(np.int16), ((flow >> 8) & 255).ravel(), ((flow & 255) - 1).ravel()
        x, u = net.gates()
        gates = _take(x, prev, net.scratch)
        states, before, given, keep, to_z, to_n, dn = (net.scratch(k, WINDOW, b, HIDDEN) for k in ("states", "before", "given", "keep", "to_z", "to_n", "dn"))
        starts = fresh.any(axis=1)
        for t in range(WINDOW):
            before[t] = h
            if starts[t]:
                before[t][fresh[t]] = 0
            given[t] = _advance(gates[:, t], before[t], u, states[t])
            h = states[t]
        on = np.flatnonzero(live.ravel())
        hs = states.reshape(WINDOW * b, HIDDEN)
        hs = hs if len(on) == len(hs) else hs[on]
        tg, pl = cls[on], place[on]
        _, d, inner = net.outputs(hs, tg, pl)
        grads = {k: np.zeros_like(v) for k, v in p.items()}
        d[tg, np.arange(len(tg))] -= 1
        d /= len(tg)
        grads["v"], grads["b"] = (d @ hs).T, d.sum(axis=1)
        out = np.matmul(d.T, p["v"].T, out=net.scratch("out", *hs.shape))
        if inner:
            f, clusters, hf, pi = inner
            pi[pl[f], np.arange(len(f))] -= 1
            pi /= len(tg)
            back = net.scratch("back", *hf.shape)
            for c, i, j in clusters:
                grads["w"][c], grads["wb"][c] = pi[:, i:j] @ hf[i:j], pi[:, i:j].sum(axis=1)
                np.matmul(pi[:, i:j].T, p["w"][c], out=back[i:j])
            out[f] += back
        dh_out = out
        if len(on) < WINDOW * b:
            dh_out = np.zeros((WINDOW * b, HIDDEN), np.float32)
            dh_out[on] = out
        dh_out = dh_out.reshape(WINDOW, b, HIDDEN)
        # what a change of a state gives to the inputs of the candidate, the update gate and, by the candidate's, the reset gate
        z, r, n = gates
        np.subtract(1, z, out=keep)
        np.subtract(before, n, out=to_z)
        to_z *= z
        to_z *= keep
        np.multiply(n, n, out=to_n)
        np.subtract(1, to_n, out=to_n)
        to_n *= keep
        to_r = np.subtract(1, r, out=keep)
        to_r *= r
        to_r *= given
        to_r *= -0.5
        du = net.scratch("du", 3, WINDOW, b, HIDDEN)
        dh, back = np.zeros((b, HIDDEN), np.float32), np.ascontiguousarray(_by_gate(p["u"]).transpose(0, 2, 1))
        for t in range(WINDOW - 1, -1, -1):
            dh += dh_out[t]
            np.multiply(dh, to_n[t], out=dn[t])
            np.multiply(dh, to_z[t], out=du[0, t])
            np.multiply(dn[t], to_r[t], out=du[1, t])
            np.multiply(dn[t], r[t], out=du[2, t])
            dh *= z[t]
            for part in np.matmul(du[:, t], back):
                dh += part
            if starts[t]:
                dh[fresh[t]] = 0
        flat = before.reshape(WINDOW * b, HIDDEN).T
        grads["u"] = np.concatenate([flat @ x.reshape(WINDOW * b, HIDDEN) for x in du], axis=1)
        prev = prev.ravel()
        order = np.argsort(prev, kind="stable")
        runs_of = [(c, i) for c, i, _ in _groups(prev[order])]
        dx = np.concatenate([x.reshape(WINDOW * b, HIDDEN).take(order, axis=0) for x in (du[0], du[1], dn)], axis=1, out=net.scratch("dx", WINDOW * b, 3 * HIDDEN))
        grads["x"][[c for c, _ in runs_of]] = np.add.reduceat(dx, [i for _, i in runs_of], axis=0)
        self.updates += 1
        it = self.updates
        for k, v in p.items():
            gk = np.clip(grads[k], -1, 1)
            self.m1[k] = 0.9 * self.m1[k] + 0.1 * gk
            self.m2[k] = 0.99 * self.m2[k] + 0.01 * gk * gk
            p[k] = v - np.float32(0.02 / np.sqrt(1 + it / 64)) * (self.m1[k] / (1 - 0.9**it)) / (np.sqrt(self.m2[k] / (1 - 0.99**it)) + 1e-6)
        return h


def score_documents(net: Net, words, table: Table):
    """Natural log-probability of each document, without the rare words' shares; states run through whole documents."""
    codes, at, has = _sequences(words, table)
    length = np.diff(words.first) + 1
    total = np.bincount(words.doc, weights=np.append(table.share, np.float32(0))[at], minlength=len(length)).astype(float)
    codes = np.append(codes, table.end_code)
    order = np.argsort(-length, kind="stable")
    for i in range(0, len(order), LANES):  # so many that their states stay in a processor's cache, of like length
        some = order[i : i + LANES]
        total[some] += _read_along(net, codes, words.first[some], length[some], table)
    return total, has, at


def _read_along(net: Net, codes, first, length, table: Table):
    """Log-probability of the codes of some documents, longest first, that are read side by side."""
    x, u = net.gates()
    steps = int(length[0])
    longer = (len(length) - np.cumsum(np.bincount(length, minlength=steps + 1))).tolist()  # documents with more than t tokens
    total, t = np.zeros(len(length)), 0
    h, prev = np.zeros((len(length), HIDDEN), np.float32), np.full(len(length), table.end_code, np.int32)
    while t < steps:
        n = longer[t]
        w = min(WINDOW if n > 64 else 8 * WINDOW, steps - t)
        k = t + np.arange(w)[:, None]
        flow = np.where(k < length[:n] - 1, codes[np.minimum(first[:n] + k, len(codes) - 1)], table.end_code)
        gates = _take(x, np.concatenate([prev[None, :n], flow[:-1]]) >> 16, net.scratch)
        states = net.scratch("states", w, n, HIDDEN)
        for k in range(w):
            m = longer[t + k]
            _advance(gates[:, k, :m], h[:m], u, states[k, :m])
            h = states[k]
        h, prev = h.copy(), flow[-1]
        live = t + np.arange(w)[:, None] < length[:n]
        target, part = flow[live], np.zeros((w, n))
        part[live] = net.outputs(states[live], (target >> 8) & 255, (target & 255) - 1, gradient=False)[0]
        total[:n] += part.sum(axis=0)
        t += w
    return total


def _train_rows(shared):
    """Rows come sorted by net and text; each net is trained by itself, whatever task it is in."""

    def weights(trainer):
        v = trainer.net.flat()
        return pa.RecordBatch.from_arrays([pa.array(np.arange(len(v), dtype=np.int32)), pa.array(v.astype(float)), pa.array(np.full(len(v), trainer.tokens, np.int64))], names=["i", "v", "n"])

    def run(batches):
        table, flat = shared.value
        now, trainer = None, None
        for batch in batches:
            net = batch.column(1).to_numpy()
            cuts = [0, *(np.flatnonzero(net[1:] != net[:-1]) + 1).tolist(), batch.num_rows]
            for i, j in zip(cuts, cuts[1:]):
                if i == j:
                    continue
                if net[i] != now:
                    if trainer:
                        trainer.finish()
                        yield weights(trainer)
                    now, trainer = net[i], Trainer(Net(flat, table), table)
                for _, offsets, data in runs(batch.slice(i, j - i)):
                    trainer.read(split(offsets, data, lower=True))
        if trainer:
            trainer.finish()
            yield weights(trainer)

    return run


def commonest(counts: DataFrame, most: int) -> DataFrame:
    """The rows with the largest counts c, as many whole steps of a fine scale as fit into `most`: a filter, not a sort."""
    step = F.when(F.col("c") < 1024, F.col("c")).otherwise(1024 + F.floor(F.log2(F.col("c") / 1024) * 256)).cast("int")
    scale = counts.groupBy(step.alias("step")).agg(F.count("*").alias("n")).orderBy(F.desc("step")).collect()  # some 12,000 rows at most
    total, least = 0, None
    for r in scale:
        total += r.n
        if total > most:
            break
        least = r.step
    return counts.filter(step >= least) if least is not None else counts.limit(0)


def fit(docs: DataFrame) -> tuple[Table, np.ndarray, DataFrame]:
    """The table of commonest words, the averaged weights and the written counts of all training words.

    Training documents are dealt to nets by the hash of their text, about NET_TOKENS to each, and every net reads its own
    in the order of their hashes. So the weights depend on the documents and not on how they are partitioned.
    """
    spark = docs.sparkSession
    lang = F.pmod(F.xxhash64(F.coalesce(F.col("lang").cast("string"), F.lit(""))), F.lit(LANGS)).cast("int")
    train = docs.filter(~held_out("doc_id", 7)).select(F.col("text").cast("string").alias("text"), lang.alias("lang"))
    counts = train.mapInArrow(_count_rows, "h long, lang int, c long").groupBy("h", "lang").agg(F.sum("c").alias("c")).groupBy("h").agg(F.sum("c").alias("c"), F.max(F.struct("c", "lang"))["lang"].alias("lang"))
    counts = materialize(counts, "counts")
    ends = train.count()
    sums = counts.agg(F.sum("c").alias("s"), F.count("*").alias("k")).first()
    top = commonest(counts, TABLE).toArrow().sort_by("h")
    col = lambda c: top.column(c).to_numpy()
    table = Table(col("h").view(np.uint64), col("c"), col("lang").astype(np.int64), (sums.s or 0) + ends, sums.k + (1 if ends else 0), ends)
    flat = Net.start(table)
    nets = int(np.clip(-(-table.total // (NET_TOKENS * ROUNDS)), 1, MAX_NETS))
    hashed = train.select("text", F.xxhash64("text").alias("h"))
    for r in range(ROUNDS):
        shared = spark.sparkContext.broadcast((table, flat))
        part = hashed.filter(F.pmod("h", F.lit(ROUNDS)) == r).withColumn("net", F.pmod(F.floor(F.col("h") / ROUNDS), F.lit(nets)).cast("int"))
        part = part.repartitionById(nets, "net").sortWithinPartitions("net", "h").select("text", "net")
        mean = part.mapInArrow(_train_rows(shared), "i int, v double, n long").groupBy("i").agg((F.sum(F.col("v") * F.col("n")) / F.sum("n")).alias("v")).orderBy("i").toArrow()
        if mean.num_rows:
            flat = mean.column("v").to_numpy().astype(np.float32)
    return table, flat, counts


def _score_rows(shared):
    def run(batches):
        table, flat = shared.value
        net = Net(flat, table)
        log_counts = np.append(np.log10(table.counts + 1), 0.0)
        log_denominator = np.log10(table.total + table.distinct + 1)
        for batch in batches:
            for rows, offsets, data in runs(batch, limit=SCORE_BYTES):
                w = split(offsets, data, lower=True)
                n_docs = rows.num_rows
                score, has, at = score_documents(net, w, table)
                n = np.diff(w.first) + 1
                base = np.bincount(w.doc, weights=log_counts[at], minlength=n_docs) + np.log10(table.ends + 1) - n * log_denominator
                known = np.bincount(w.doc, weights=has, minlength=n_docs).astype(np.int64) + int(table.ends > 0)
                rare = np.flatnonzero(~has)
                cut = np.searchsorted(w.doc[rare], np.arange(n_docs + 1))
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), rows.column(3), pa.array(n), pa.array(known), pa.array(base), pa.array(score / np.log(10)), pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(signed(_word_keys(w)[rare])))],
                                                 names=["doc_id", "held_out", "key", "n_tokens", "n_known", "base", "model", "rare"])

    return run


def score_corpus(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row.

    A null or empty text is the end alone. Rows whose crc32(doc_id) mod 7 is 2 are held out; a null id is not. Repeated
    rows stay. Counts cover all training words; those outside the broadcast table are joined by word, so the vocabulary
    may grow without bound. The network is fitted on every training document to its end, by nets of some million tokens whose weights are averaged.
    """
    table, flat, counts = fit(docs)
    shared = docs.sparkSession.sparkContext.broadcast((table, flat))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out("doc_id", 7).alias("held_out"), F.col("text").cast("string").alias("text"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("key"))
    scored = materialize(rows.mapInArrow(_score_rows(shared), "doc_id long, held_out boolean, key long, n_tokens long, n_known long, base double, model double, rare array<long>"), "scored")
    covered, n_rare = float(table.counts.sum()), table.distinct - (1 if table.ends else 0) - len(table.hashes)
    # the rare class: add-one shares over its known words and one place for all unseen ones
    rare_total = table.total - table.ends - covered + n_rare + 1
    once = scored.filter(F.size("rare") > 0).select("key", "rare").groupBy("key").agg(F.first("rare").alias("rare"))
    words = once.select("key", F.explode("rare").alias("h")).groupBy("key", "h").agg(F.count("*").alias("n"))
    found = words.join(counts.select("h", "c"), "h", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    extra = found.groupBy("key").agg(F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("more_known"), F.sum(F.col("n") * F.log10(F.col("c") + 1)).alias("more"), F.sum("n").alias("n_rare"))
    out = scored.drop("rare").join(extra, "key", "left").na.fill(0, ["more_known", "n_rare"]).na.fill(0.0, ["more"])
    return out.select("doc_id", "held_out", "n_tokens", (F.col("n_known") + F.col("more_known")).alias("n_known"), F.lit(int(table.total)).cast("long").alias("train_tokens"),
                      (F.col("base") + F.col("more")).alias("base_score"), (F.col("model") + F.col("more") - F.col("n_rare") * float(np.log10(rare_total))).alias("score"))


def op4_class_factored_gru(spark, sf_dir: str) -> DataFrame:
    return score_corpus(read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


QUERIES = {"op4_class_factored_gru": op4_class_factored_gru}
ORACLES: dict = {}
