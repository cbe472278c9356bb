"""Secret scans: fixed patterns, and two character Markov models compared by log-likelihood ratio.

One model is of random strings, one of ordinary identifiers and words; both are first-order chains over the characters
that a secret may have, trained from labelled samples: what the fixed patterns find in at most about ``FIT_ROWS``
documents together with generated random strings on one side, the other long tokens of those documents on the other.
A token of ``LEAST_LENGTH`` characters or more whose log-likelihood ratio reaches ``LEAST_RATIO`` is a span of kind
``random`` unless it overlaps a span of a fixed pattern, which always stays.

Null texts count as empty and have no span.  Positions are code points, the end exclusive.  Extra columns are not read.
"""

from __future__ import annotations

import hashlib
import random
import re
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stillwater.llm import common, labelled

FIT_ROWS = 2000
LEAST_LENGTH = 16
LEAST_RATIO = 10.0

# The patterns of the three base kinds.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # a run of [0-9a-f] has one match at most, so the length may be asked for at once
KINDS = ("assign", "access", "hex", "random")

_ALPHABET = string.ascii_letters + string.digits + "+/_=-"
_RUN = re.compile("[A-Za-z0-9+/_=-]{%d,}" % LEAST_LENGTH)
_STATES = len(_ALPHABET) + 1  # 0: the start of a token
_CODE = np.zeros(256, np.int64)
_CODE[np.frombuffer(_ALPHABET.encode(), np.uint8)] = np.arange(1, _STATES)
_TOKENS = bytes(i if chr(i) in _ALPHABET else 32 for i in range(256))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """Spans (start, place in KINDS, end) of the fixed patterns."""
    out = []
    if "=" in text or ":" in text:
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    return sorted(out + [(m.start(), 2, m.end()) for m in HEX.finditer(text)])


def long_tokens(text: str) -> list[bytes]:
    return [w for w in text.encode("utf-8", "surrogatepass").translate(_TOKENS).split() if len(w) >= LEAST_LENGTH]


def _transitions(tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Transition numbers of all tokens in a row, and the tokens' starts."""
    codes = _CODE[np.frombuffer(b"".join(tokens), np.uint8)]
    starts = np.cumsum([0] + [len(t) for t in tokens[:-1]])
    before = np.concatenate([[0], codes[:-1]])
    before[starts] = 0
    return before * _STATES + codes, starts


def chain(tokens: list[bytes]) -> np.ndarray:
    """Log transition probabilities with add-one-half smoothing."""
    counts = np.full(_STATES * _STATES, 0.5)
    if tokens:
        counts += np.bincount(_transitions(tokens)[0], minlength=len(counts))
    counts = counts.reshape(_STATES, _STATES)
    return np.log(counts / counts.sum(1, keepdims=True)).ravel()


def generated(n: int = 3000, seed: int = 11) -> list[bytes]:
    """Random strings over the alphabets that keys come in."""
    rng = random.Random(seed)
    kinds = ("0123456789abcdef", string.ascii_letters + string.digits, string.ascii_uppercase + string.digits, _ALPHABET.replace("=", "").replace("_", ""))
    return ["".join(rng.choices(kinds[k % len(kinds)], k=rng.randint(20, 48))).encode() for k in range(n)]


def fit(texts: list[str]) -> np.ndarray:
    """The log-likelihood ratio of each transition, random against ordinary."""
    secret, ordinary = generated(), []
    for text in texts:
        spans = base_spans(text)
        inside = "\0".join(text[a:b] for a, _, b in spans)
        found = long_tokens(inside)
        secret += found
        blank = list(text)
        for a, _, b in spans:
            blank[a:b] = " " * (b - a)
        ordinary += [w for w in re.findall(rb"[A-Za-z0-9+/_=-]{4,}", "".join(blank).encode("utf-8", "surrogatepass"))]
    return chain(secret) - chain(ordinary)


def ratios(model: np.ndarray, tokens: list[bytes]) -> np.ndarray:
    """Log-likelihood ratio of each token."""
    if not tokens:
        return np.zeros(0)
    moves, starts = _transitions(tokens)
    return np.add.reduceat(model[moves], starts)


def all_spans(text: str, model: np.ndarray) -> tuple[list, list]:
    """Base spans, and all spans with those of the models."""
    base = base_spans(text)
    if not (ratios(model, long_tokens(text)) >= LEAST_RATIO).any():
        return base, base
    runs = [(m.start(), m.end()) for m in _RUN.finditer(text)]
    likely = ratios(model, [text[a:b].encode() for a, b in runs]) >= LEAST_RATIO
    taken = np.zeros(len(text) + 1, bool)
    for a, _, b in base:
        taken[a:b] = True
    more = [(a, 3, b) for (a, b), yes in zip(runs, likely, strict=True) if yes and not taken[a:b].any()]
    return base, sorted(base + more)


def write(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def train(docs: DataFrame, most: int = FIT_ROWS) -> np.ndarray:
    """Fit on about ``most`` documents that a hash of doc_id chooses, however many there are, and at most
    ``labelled.MOST_BYTES`` of their texts.  Of a doc_id that has several texts, the first in byte order teaches.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null and doc_id is not null")
    n = rows.count()
    chosen = rows.where(labelled.turn() < int(min(1.0, most / max(n, 1)) * 1_000_000))
    return fit([r["text"] for r in labelled.bounded(chosen.groupBy("doc_id").agg(F.min("text").alias("text")))])


def scan(docs: DataFrame, model: np.ndarray) -> DataFrame:
    """One row a document: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random."""
    spark = common.prepare(docs.sparkSession)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, digests, spans = [], [], []
            for text in batch.column(1).to_pylist():
                base, every = all_spans(text, shared.value)
                counts.append([sum(k == kind for _, k, _ in every) for kind in range(4)])
                digests.append(hashlib.sha256(write(base).encode()).hexdigest())
                spans.append(write(every))
            n = np.array(counts, np.int64).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(n[:, k]) for k in range(3)), pa.array(digests, pa.string()), pa.array(spans, pa.string()), pa.array(n[:, 3])], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_random"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_of().alias("text")).mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_random long")
