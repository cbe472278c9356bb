"""Toxicity by multiple-instance learning.

A document is a bag of sentences.  Each sentence has a probability from a logistic model of its words; the noisy-or of
the sentences, 1 - prod(1 - p), is the document's.  Only documents are labelled: the gradient reaches a sentence through
the noisy-or, so the sentences that explain a label take it.  ``locate`` then lists the offending sentences.  While
fitting, a document has one ``LEAK`` beside its sentences, which takes labels that no words explain, and the bias falls to
``BIAS``: a sentence without evidence adds 2e-6.

The noisy-or of a cautious model tells the documents apart long before it reaches 0.5.  So ``INNER`` models, each fitted
without a part of the rows that may be learnt from, score that part, and the noisy-or from which on these scores are worth
believing (``CUTS``: the best F1) becomes 0.5: odds are multiplied by one factor.  A clean document stays below 0.5 up to
about 10 000 sentences at the lowest cut.

A word has as features itself and its beginnings of ``PREFIXES`` bytes, so inflected forms of a stem share evidence.
Only features that go with the labels beyond chance (``LEAST_Z``) take part.

Fitting takes at most about ``FIT_ROWS`` labelled rows (a hash of doc_id chooses them) on the driver; scoring reads
every row and whole texts in one pass without a shuffle.

Null and empty texts have no sentence and score 0.  Without usable labels, every score is 0.  Extra columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stillwater.llm import common, labelled

FIT_ROWS = 4000
PREFIXES = (4, 5, 6, 7)
LEAST_DOCS, LEAST_Z = 4, 3.0
#: Rounds of fitting, those in which the bias falls, where it begins and ends, and what a document has beside its sentences.
ROUNDS, FALL = 220, 140
FIRST_BIAS, BIAS, LEAK = -6.0, -13.0, 0.05
#: Weight of the L1 term, for each row that is fitted.
SHRINK = 3e-5
#: Parts of the rows for choosing the cut, and what it may be.
INNER, CUTS = 3, (0.5, 0.3, 0.2, 0.1, 0.07, 0.05, 0.04, 0.03, 0.02)
#: Words whose weights a worker remembers.
MEMO = 400_000

#: Sentence ends become bars, which are never part of a word; ASCII letters are lower-cased.
_TABLE = bytes(124 if chr(i) in ".!?\n" else common.LETTERS[i] for i in range(256))
_BAR = b"|"


@dataclass
class Model:
    weights: dict[bytes, float]  # by feature
    bias: float
    cut: float = 0.5  # the noisy-or that becomes a score of 0.5
    memo: dict[bytes, float] = field(default_factory=dict)

    def __getstate__(self):
        return {"weights": self.weights, "bias": self.bias, "cut": self.cut, "memo": {}}

    def of(self, words: list[bytes]) -> np.ndarray:
        """Weights of words; the end of a sentence is NaN."""
        memo = self.memo
        if len(memo) > MEMO:
            memo.clear()
        memo[_BAR] = float("nan")
        for w in set(words) - memo.keys():
            memo[w] = sum(self.weights.get(x, 0.0) for x in features(w))
        return np.fromiter(map(memo.__getitem__, words), float, len(words))


def features(word: bytes) -> list[bytes]:
    return [b"=" + word, *(word[:k] for k in PREFIXES if len(word) >= k)]


def bag(text: str | None) -> list[bytes]:
    """Words of the text, with a bar after each sentence."""
    if not text:
        return []
    return (text.encode("utf-8", "surrogatepass").translate(_TABLE).replace(_BAR, b" | ") + b" |").split()


def _sentences(end: np.ndarray, sizes: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """For each word its sentence (ends are left out, as are sentences without words), and each sentence's bag."""
    owner = np.repeat(np.arange(len(sizes)), sizes)[~end]
    number = (np.cumsum(end) - end)[~end]
    fresh = np.diff(number, prepend=-1) > 0
    return np.cumsum(fresh) - 1, owner[fresh]


def _noisy_or(logits: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """log(1 - p) of each sentence, and the bags' scores."""
    stay = -np.logaddexp(0, np.minimum(logits, 30))
    return stay, -np.expm1(np.bincount(owner, stay, n))


def _associated(bags: list[list[bytes]], y: np.ndarray) -> list[bytes]:
    """Features whose documents are toxic more or less often than chance allows."""
    hit, df = Counter(), Counter()
    for words, label in zip(bags, y, strict=True):
        own = {x for w in set(words) for x in features(w)}
        df.update(own)
        if label:
            hit.update(own)
    rate = y.mean()
    z = {x: (hit[x] - n * rate) / np.sqrt(n * rate * (1 - rate) + 0.5) for x, n in df.items() if n >= LEAST_DOCS}
    return sorted(x for x, v in z.items() if abs(v) >= LEAST_Z and x != b"=" + _BAR)


def fit(rows: list[tuple[str, int]]) -> Model:
    """Proximal Adagrad on the noisy-or's log-loss; a small L1 term keeps features without evidence at 0."""
    bags, y = [bag(t) for t, _ in rows], np.array([label for _, label in rows], float)
    if not len(y) or not y.sum() or y.all():
        return Model({}, 30.0 if len(y) and y.all() else -1000.0)  # no sentence counts: exactly 0
    names = _associated(bags, y)
    index = {x: k for k, x in enumerate(names)}
    of_word = {w: [index[x] for x in features(w) if x in index] for w in {w for b in bags for w in b}}
    flat = [w for b in bags for w in b]
    sentence, owner = _sentences(np.fromiter((w == _BAR for w in flat), bool, len(flat)), [len(b) for b in bags])
    pairs = [(k, s) for w, s in zip((w for w in flat if w != _BAR), sentence.tolist(), strict=True) for k in of_word[w]]
    ids, place = (np.array(x, np.int64) for x in zip(*pairs, strict=True)) if pairs else (np.zeros(0, np.int64),) * 2
    m, n, weights = len(owner), len(bags), np.zeros(len(names))
    g2 = np.full(len(names), 1e-3)
    for k in range(ROUNDS):
        bias = FIRST_BIAS + (BIAS - FIRST_BIAS) * min(1.0, k / FALL)
        stay, score = _noisy_or(np.bincount(place, weights[ids], m) + bias, owner, n)
        p = -np.expm1(stay)
        s = 1 - (1 - LEAK) * (1 - np.clip(score, 0, 1))
        pull = np.where(y > 0, -(1 - s) / s, 1.0)  # of the loss, by a sentence's logit: p if clean, -p (1 - s) / s if toxic
        grad = np.bincount(ids, (pull[owner] * p)[place], len(names))
        g2 += grad**2
        step = 0.6 / np.sqrt(g2)
        weights -= step * grad
        weights = np.sign(weights) * np.maximum(np.abs(weights) - step * SHRINK * n, 0)
    return Model({x: float(w) for x, w in zip(names, weights, strict=True) if w}, BIAS)


def _logits(model: Model, bags: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each sentence's logit and bag, and each word's sentence."""
    flat = [w for b in bags for w in b]
    weights = model.of(flat)
    end = np.isnan(weights)
    sentence, owner = _sentences(end, [len(b) for b in bags])
    return np.bincount(sentence, weights[~end], len(owner)) + model.bias, owner, sentence


def score_bags(model: Model, bags: list[list[bytes]]) -> np.ndarray:
    """The bags' scores: the noisy-or, its odds multiplied so that ``cut`` becomes 0.5."""
    logits, owner, _ = _logits(model, bags)
    s = np.clip(_noisy_or(logits, owner, len(bags))[1], 0, 1)
    return s * (1 - model.cut) / (s * (1 - model.cut) + (1 - s) * model.cut)


def chosen_cut(rows: list[tuple[str, int]]) -> float:
    """The cut of the best F1 over rows, each scored by a model that was fitted without it; the largest of equally good ones."""
    y = np.array([label for _, label in rows], bool)
    part = np.arange(len(rows)) % INNER
    found = np.zeros(len(rows))
    for k in range(INNER):
        model = fit([r for r, p in zip(rows, part, strict=True) if p != k])
        found[part == k] = score_bags(model, [bag(t) for (t, _), p in zip(rows, part, strict=True) if p == k])
    f1 = [2 * (y & (found >= c)).sum() / max(1, y.sum() + (found >= c).sum()) for c in CUTS]
    return CUTS[int(np.argmax(f1))]


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", most: int = FIT_ROWS) -> Model:
    rows = labelled.fit_rows(docs, labels, label, most)
    model = fit(rows)
    if model.weights:
        model.cut = chosen_cut(rows)
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """One row a document: doc_id, held_out, score, predicted (1 from a score of 0.5 on)."""
    spark = common.prepare(docs.sparkSession)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = score_bags(shared.value, [bag(t) for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.float64())], names=["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_of().alias("text")).mapInArrow(run, "doc_id long, score double")
    return rows.select("doc_id", labelled.held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def locate(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The offending sentences: doc_id, sentence (its number among those with words), words, probability."""
    spark = common.prepare(docs.sparkSession)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, list, list, list] = ([], [], [], [])
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = bag(text)
                logits, _, sentence = _logits(shared.value, [words])
                p = 1 / (1 + np.exp(-np.clip(logits, -30, 30)))
                plain = [w for w in words if w != _BAR]
                for k in np.flatnonzero(p >= least).tolist():
                    a, b = np.searchsorted(sentence, [k, k + 1])
                    for column, value in zip(out, (key, k, b" ".join(plain[a:b]).decode("utf-8", "replace"), float(p[k])), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string()), pa.array(out[3], pa.float64())], names=["doc_id", "sentence", "words", "probability"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_of().alias("text")).mapInArrow(run, "doc_id long, sentence long, words string, probability double")
