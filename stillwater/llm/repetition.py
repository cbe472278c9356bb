"""Quality rules by how much of a text repeats itself.

The characters that stand in later copies of word n-grams, for each length of ``LENGTHS``, and in later copies of lines, as
shares of all characters in words.  N-grams are rolling hashes over the words of a whole batch: an n-gram's hash comes from
that of the n-gram one word shorter.  Only places whose shorter n-grams are repeated are hashed and sorted for the longer
ones, so texts without repeats cost one sort.  One pass without a shuffle; a task holds one Arrow batch.

``n_repeat_words`` and ``n_dup_lines`` are exact: repeated 3-grams are compared word by word, lines by their bytes.  Null texts
have no words; they and texts of fewer than ``LEAST_WORDS`` words fail the base rules.  Every row has its own verdict, whatever
it repeats.  Other columns are read only by ``keep_plain``.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stillwater.llm import common

BASE = 3
LENGTHS = (5, 6, 7, 8, 9, 10)
#: Base rules: fewer words, or more than so many percent of them in repeated 3-grams.
LEAST_WORDS, MOST_REPEATED = 50, 50
#: The verdict: more than so many percent of the characters in later copies of n-grams of one length, or of lines.
MOST_GRAM_CHARS, MOST_LINE_CHARS = 20, 20
SYMBOLS = b"#*$%&|<>"

_STEP = np.uint64(0x9E3779B97F4A7C15)
_BLANK = np.isin(np.arange(256), [0x20, 9, 10, 11, 12, 13])
_SYMBOL = np.isin(np.arange(256), list(SYMBOLS))

COLUMNS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "dup_line_chars", *(f"dup_chars_{n}" for n in LENGTHS)]


def _groups(keys: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of places (ascending) with their keys: those whose key an earlier place has, the first place of each one's key, and
    those whose key any other has.
    """
    if not len(places):
        return places, places, places
    by = np.argsort(keys, kind="stable")
    equal = keys[by][1:] == keys[by][:-1]
    later = np.concatenate([[False], equal])
    head = np.maximum.accumulate(np.where(later, 0, np.arange(len(by))))
    several = later | np.concatenate([equal, [False]])
    return places[by[later]], places[by[head[later]]], places[by[several]]


def _inside(places: np.ndarray, length: int, n: int) -> np.ndarray:
    """Which of n words stand in a window of ``length`` words that begins at one of places."""
    edges = np.bincount(places, minlength=n + 1)[: n + 1] - np.bincount(places + length, minlength=n + 1)[: n + 1]
    return np.cumsum(edges)[:n] > 0


def _repeated_exactly(words: list[bytes]) -> np.ndarray:
    """Which words stand in a 3-gram that occurs twice or more, by the words themselves."""
    grams = list(zip(words, words[1:], words[2:], strict=False))
    count = Counter(grams)
    return _inside(np.array([k for k, g in enumerate(grams) if count[g] > 1], np.int64), BASE, len(words))


def measure(texts: list[str | None]) -> dict[str, np.ndarray]:
    """COLUMNS, each an array with one entry a text."""
    raws = [t.encode("utf-8", "surrogatepass") if t else b"" for t in texts]
    flat, sizes = common.word_hashes(texts)
    n, ends = len(flat), np.cumsum(sizes)
    owner = np.repeat(np.arange(len(texts)), sizes)
    data = np.frombuffer(b" ".join(raws) + b" ", np.uint8) if raws else np.zeros(0, np.uint8)
    edge = np.flatnonzero(np.diff(_BLANK[data], prepend=True)) if len(data) else np.zeros(0, np.int64)
    begin, end = edge[::2], edge[1::2]
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    chars = points[end] - points[begin]  # of each word
    first = np.cumsum([0] + [len(r) + 1 for r in raws])
    symbols = np.concatenate([[0], np.cumsum(_SYMBOL[data])])
    out = {"n_words": sizes.astype(np.int64), "word_chars": _summed(chars, owner, len(texts)), "n_symbols": np.diff(symbols[first])}

    # grams: the hash of the words from each place on, mixed with the text's number
    rolled, salt = flat.copy(), common.mix64(owner.astype(np.uint64) * _STEP + np.uint64(7))
    room = ends[owner] - np.arange(n)  # words from each place to the end of its text
    places = np.arange(n)
    for length in range(2, LENGTHS[-1] + 1):
        places = places[room[places] >= length]
        rolled[places] = rolled[places] * _STEP + flat[places + length - 1]
        if length != BASE and length not in LENGTHS:
            continue
        later, heads, several = _groups(common.mix64(rolled[places] ^ salt[places]), places)
        if length == BASE:
            inside = _inside(several, length, n)
            _verify(inside, later, heads, raws, ends, sizes)
            out["n_repeat_words"] = _summed(inside, owner, len(texts))
        else:
            out[f"dup_chars_{length}"] = _summed(chars * _inside(later, length, n), owner, len(texts))
        # a longer gram repeats only where both that begin in it do
        known = np.zeros(n + 1, bool)
        known[several] = True
        places = np.sort(several)
        places = places[known[places + 1]]

    lines = [_repeated_lines(r) for r in raws]
    out["n_dup_lines"] = np.array([len(x) for x in lines], np.int64)
    out["dup_line_chars"] = np.array([sum(len(x.translate(None, b" \t\r\x0b\x0c").decode("utf-8", "surrogatepass")) for x in own) for own in lines], np.int64)
    return out


def _summed(values: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Sums of whole numbers by owner; counts stay far below 2^53."""
    return np.bincount(owner, values, n).astype(np.int64)


def _verify(inside: np.ndarray, later: np.ndarray, heads: np.ndarray, raws: list[bytes], ends: np.ndarray, sizes: np.ndarray) -> None:
    """Compare repeated 3-grams with the first of their hash; a text where two of a hash differ is counted by its words."""
    by = np.argsort(later)
    later, heads = later[by], heads[by]
    text = np.searchsorted(ends, later, side="right")
    cuts = np.flatnonzero(np.diff(text, prepend=-1, append=-1)) if len(text) else []
    for a, b in zip(cuts, cuts[1:], strict=False):
        k = int(text[a])
        words, start = raws[k].split(), int(ends[k] - sizes[k])
        if any(words[x : x + BASE] != words[y : y + BASE] for x, y in zip((later[a:b] - start).tolist(), (heads[a:b] - start).tolist(), strict=True)):
            inside[start : start + len(words)] = _repeated_exactly(words)


def _repeated_lines(raw: bytes) -> list[bytes]:
    """The lines with a word that equal an earlier line."""
    if b"\n" not in raw:
        return []
    lines = [x for x in raw.split(b"\n") if x.strip()]
    if len(set(lines)) == len(lines):
        return []
    seen: set[bytes] = set()
    return [x for x in lines if x in seen or seen.add(x)]


def base_failed(found: dict[str, np.ndarray]) -> np.ndarray:
    n = found["n_words"]
    return (n < LEAST_WORDS) | (100 * found["n_repeat_words"] > MOST_REPEATED * n)


def repetitive(found: dict[str, np.ndarray]) -> np.ndarray:
    """The verdict against a text: too many of its characters are copies."""
    chars = found["word_chars"]
    out = 100 * found["dup_line_chars"] > MOST_LINE_CHARS * chars
    for n in LENGTHS:
        out = out | (100 * found[f"dup_chars_{n}"] > MOST_GRAM_CHARS * chars)
    return out


def rules(docs: DataFrame) -> DataFrame:
    """One row a document: doc_id, COLUMNS, base_failed, kept."""
    common.prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = measure(batch.column(1).to_pylist())
            failed = base_failed(found)
            arrays = [pa.array(found[c], pa.int64()) for c in COLUMNS]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays, pa.array(failed), pa.array(~failed & ~repetitive(found))], names=["doc_id", *COLUMNS, "base_failed", "kept"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_of().alias("text"))
    return rows.mapInArrow(run, f"doc_id long, {', '.join(f'{c} long' for c in COLUMNS)}, base_failed boolean, kept boolean")


def keep_plain(docs: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, that pass both the base rules and the verdict."""
    common.prepare(docs.sparkSession)
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = measure(batch.column(place).to_pylist())
            yield batch.filter(pa.array(~base_failed(found) & ~repetitive(found)))

    return docs.mapInArrow(run, docs.schema)
