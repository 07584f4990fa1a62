"""Secrets: three base patterns, and strings that a public BPE vocabulary spells with few characters per token."""
from __future__ import annotations

import base64
import hashlib
import re
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import read_table

#: Letters in either case are A-Z and a-z alone (re.ASCII): no Kelvin sign or long s.
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex", "token")
#: A word is looked at from this length on; it is a secret with fewer characters a token than this.
MIN_CHARS, RATIO = 16, 2.2
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=.-]{%d,}" % MIN_CHARS)
PIECE = re.compile(r"[^.]{%d,}" % MIN_CHARS)
HOST = re.compile(r"(?:https?)?/*(?:[a-z0-9](?:[a-z0-9-]*[a-z0-9])?\.)+[a-z]{2,12}(?=/|$)")
MAIL_HOST = re.compile(r"@[A-Za-z0-9-]+\.[A-Za-z]")
#: Known digests and identifiers: MD5, SHA-1, SHA-256 and SHA-512 in hex after their name, UUIDs, numbers.
UUID = re.compile(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
DIGEST_NAME = re.compile(r"(?i)(?:md5|sha-?(?:1|256|512)|digest|checksum|integrity|etag|commit)\W{0,3}$")
NUMBERED = re.compile(r"([A-Za-z]*)[-_/=+0-9]+([A-Za-z]*)")
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
_PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_encoders: dict = {}


def encoder(vocabulary: str | bytes):
    """The encoder of a vocabulary file, given by its path or its bytes."""
    if vocabulary not in _encoders:
        import tiktoken

        lines = vocabulary.splitlines() if isinstance(vocabulary, bytes) else Path(vocabulary).read_bytes().splitlines()
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        _encoders[vocabulary] = tiktoken.Encoding("own", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[vocabulary]


def base_spans(text: str) -> list[tuple[int, int, str]]:
    out = []
    low = text.lower()
    if "passw" in low or "secret" in low or "token" in low or "key" in low:
        out += [(*m.span(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        out += [(*m.span(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= 18]
    out += [(*m.span(), "hex") for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def token_spans(text: str, taken: list[tuple[int, int, str]], vocabulary: str | bytes = VOCABULARY) -> list[tuple[int, int, str]]:
    """Candidate words outside the base spans whose characters per token are few."""
    out = []
    few = lambda w: len(w) < RATIO * len(encoder(vocabulary).encode_ordinary(w))
    for m in CANDIDATE.finditer(text):
        a, b = m.span()
        if MAIL_HOST.match(text, b) or (text[a - 1 : a] == "@" and "." in m[0] and text[max(a - 2, 0) : a - 1].isalnum()):
            continue
        host = HOST.match(m[0])
        hits = [(a + p.start(), a + p.end()) for p in PIECE.finditer(m[0], host.end() if host else 0) if _odd(text, a + p.start(), p[0], taken, few)]
        if hits:
            out.append((hits[0][0], hits[-1][1], "token"))
    return out


def _odd(text: str, a: int, w: str, taken, few) -> bool:
    """Whether a piece without dots is neither known nor spelt in long tokens."""
    b, n = a + len(w), NUMBERED.fullmatch(w)
    if not any(c.isalpha() for c in w) or UUID.fullmatch(w) or any(x < b and a < y for x, y, _ in taken):
        return False
    if re.fullmatch(r"[0-9a-fA-F]+", w) and len(w) in (32, 40, 64, 128) and DIGEST_NAME.search(text, max(0, a - 16), a):
        return False
    # a word with a number is taken by its letters
    return few(w) and not (n and all(len(x) < 4 or not few(x) for x in n.groups()))


def _scan(shared):
    def run(batches):
        vocabulary = shared.value
        for batch in batches:
            n = {k: [] for k in KINDS}
            sha, spans = [], []
            for t in batch.column(1).to_pylist():
                base = base_spans(t or "")
                found = sorted(base + token_spans(t or "", base, vocabulary), key=lambda s: (s[0], KINDS.index(s[2])))
                for k in KINDS:
                    n[k].append(sum(s[2] == k for s in found))
                sha.append(hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, b, k in base).encode()).hexdigest())
                spans.append(",".join(f"{k}:{a}:{b}" for a, b, k in found))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(n[k], pa.int64()) for k in KINDS), pa.array(sha, pa.string()), pa.array(spans, pa.string())], names=["doc_id", "n_assign", "n_access", "n_hex", "n_token", "base_sha256", "spans"])

    return run


def find_secrets(docs: DataFrame, text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """Counts, base digest and spans (kind:start:end in code points) of every row; null counts as empty, repeated rows stay.

    Only doc_id and text are read, so other columns may have any names; a text of any length is scanned whole."""
    # the file (some hundred KB to a few MB) is read on the driver and sent to every executor
    shared = docs.sparkSession.sparkContext.broadcast(Path(vocabulary).read_bytes())
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(_scan(shared), "doc_id long, n_assign long, n_access long, n_hex long, n_token long, base_sha256 string, spans string")


def op9_token_efficiency(spark, sf_dir: str) -> DataFrame:
    return find_secrets(read_table(spark, sf_dir, "documents"))


QUERIES = {"op9_token_efficiency": op9_token_efficiency}
ORACLES: dict = {}
