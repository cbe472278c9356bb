"""Quality by nearest-neighbour voting among labelled latent-semantic vectors.

The terms of a document are its tokens' shapes: runs of lower-case letters, capitals or digits shrink to one sign each,
all other characters stay, so ``Thing.`` is ``Aa.``; one more term counts tokens that repeat the one before.  Labelled
documents give tf-idf rows, whose singular vectors span the latent space.  The labelled vectors are broadcast (at most
``FIT_ROWS`` of ``DIMS`` numbers); every document's exact cosine to all of them comes from one matrix product a block,
and the ``NEIGHBOURS`` nearest, of equally near ones the earlier labelled rows, vote with their similarity to the power
``POWER`` as weight.  Words themselves are no terms: quality that shows in wording alone isn't seen.  Of the labelled
documents' shapes, the ``TERMS`` - 2 in most documents are terms; all others count as one.

Null and empty texts have no terms: their vector is 0 and their score is 0.  Without usable labels every score is 0.5.
Extra columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stillwater.llm import common, labelled

FIT_ROWS = 4000
DIMS = 32
TERMS = 1024
NEIGHBOURS, POWER = 25, 8
#: Cosines that differ by less are equal: one product may be summed in another order.
TIE = 1e-12

_SIGNS = np.array([97 if 97 <= i < 123 or i >= 128 else 65 if 65 <= i < 91 else 48 if 48 <= i < 58 else i for i in range(256)], np.uint8)
_RUNS = np.isin(np.arange(256), [97, 65, 48])


@dataclass
class Model:
    index: dict[bytes, int]  # shape -> term; 0: unknown, 1: repeated token
    idf: np.ndarray
    basis: np.ndarray  # terms x dims
    vectors: np.ndarray  # labelled x dims, of length 1
    labels: np.ndarray


def shapes(text: str | None) -> tuple[list[bytes], int]:
    """The tokens' shapes, and how many tokens equal the one before."""
    words = common.space_words(text)
    if not words:
        return [], 0
    raw = np.frombuffer(b" ".join(words), np.uint8)
    signs = _SIGNS[raw]
    keep = np.ones(len(signs), bool)
    keep[1:] = (signs[1:] != signs[:-1]) | ~_RUNS[signs[1:]]
    return signs[keep].tobytes().split(b" "), sum(map(eq, words, words[1:]))


def _rows(index: dict[bytes, int], docs: list[tuple[list[bytes], int]], terms: int) -> np.ndarray:
    """Square roots of the terms' shares."""
    out = np.zeros((len(docs), terms))
    for k, (found, repeats) in enumerate(docs):
        if found:
            out[k] = np.bincount(np.fromiter(map(index.get, found, repeat(0)), np.int64, len(found)), minlength=terms)
            out[k, 1] = repeats
            out[k] /= len(found)
    return np.sqrt(out)


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 1e-12)


def fit(rows: list[tuple[str, int]]) -> Model:
    docs, y = [shapes(t) for t, _ in rows], np.array([label for _, label in rows], float)
    df: Counter[bytes] = Counter()
    for found, _ in docs:
        df.update(set(found))
    chosen = [w for w, _ in sorted(df.items(), key=lambda x: (-x[1], x[0]))][: TERMS - 2]
    index = {w: k + 2 for k, w in enumerate(chosen)}
    terms = len(index) + 2
    x = _rows(index, docs, terms)
    idf = np.log((1 + len(docs)) / (1 + (x > 0).sum(0))) + 1
    if not len(docs):
        return Model(index, idf, np.zeros((terms, 1)), np.zeros((0, 1)), y)
    x *= idf
    _, vectors = np.linalg.eigh(x.T @ x)
    basis = vectors[:, ::-1][:, :DIMS]
    return Model(index, idf, basis, _unit(x @ basis), y)


def vote(model: Model, texts: list[str | None]) -> np.ndarray:
    """Scores of one block of documents."""
    if not len(model.labels):
        return np.full(len(texts), 0.5)
    docs = [shapes(t) for t in texts]
    own = _unit((_rows(model.index, docs, len(model.idf)) * model.idf) @ model.basis)
    out = np.zeros(len(texts))
    k = min(NEIGHBOURS, len(model.labels))
    for a in range(0, len(texts), 256):
        near = own[a : a + 256] @ model.vectors.T
        least = -np.partition(-near, k - 1, axis=1)[:, k - 1 : k]
        above, level = near > least + TIE, np.abs(near - least) <= TIE
        chosen = above | (level & (np.cumsum(level, axis=1) <= k - above.sum(1, keepdims=True)))
        weight = np.maximum(near[chosen].reshape(-1, k), 1e-6) ** POWER
        votes = model.labels[np.nonzero(chosen)[1]].reshape(-1, k)
        out[a : a + 256] = (weight * votes).sum(1) / weight.sum(1)
    out[[not d[0] for d in docs]] = 0.0
    return np.clip(out, 0, 1)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = FIT_ROWS) -> Model:
    return fit(labelled.fit_rows(docs, labels, label, most))


def score(docs: DataFrame, model: Model, least: float = 0.3) -> DataFrame:
    """One row a document: doc_id, held_out, score, predicted (1 from ``least`` on)."""
    spark = common.prepare(docs.sparkSession)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(vote(shared.value, batch.column(1).to_pylist()), pa.float64())], names=["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_of().alias("text")).mapInArrow(run, "doc_id long, score double")
    return rows.select("doc_id", labelled.held_out().alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: Model, least: float = 0.3) -> DataFrame:
    """The documents that the vote accepts, with all their columns; no row is shuffled."""
    spark = common.prepare(docs.sparkSession)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(vote(shared.value, batch.column("text").to_pylist()) >= least))

    return docs.mapInArrow(run, docs.schema)
