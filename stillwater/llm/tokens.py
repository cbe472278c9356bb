"""Encoding whole texts by pieces that are encoded once a worker.

A byte-level vocabulary splits a text by its own pattern.  Texts of well-settled characters whose white space is single
spaces and line ends are cut before each of these, and each distinct piece of a batch is looked up once; new ones go
through the tokenizers library many in a row as one text, and its ids are dealt out by the bytes that they stand for.
Other texts of such characters are split by the pattern here.  Any other text is cut before each space that follows a
character other than white space, which is a cut of either kind of tokenizer whatever stands around it.  These pieces
go through the library as they stand.  What it gave is remembered.
"""

from __future__ import annotations

import json
import os
import re
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: White space of any of the libraries, before a space: there the cut isn't safe.
_UNSAFE = re.compile("[\\s᠎] ")
_CUT = re.compile("(?<=[^\\s᠎])(?= )")
#: Characters whose classes no Unicode version changed, and which normal forms and lower case leave single.
SETTLED = re.compile("[\\x20-\\x7e\\n\\t¡-įı-ɏ]*")
#: The letters and numbers among these, and with them the byte-level pattern.
LETTER, NUMBER = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼-¾"
_BYTE_LEVEL = re.compile(f"'(?:[sdmt]|ll|ve|re)| ?[{LETTER}]+| ?[{NUMBER}]+| ?[^\\s{LETTER}{NUMBER}]+|\\s+(?!\\S)|\\s+")
#: White space of settled texts that is not single, and a tab.
_BLANKS = ("  ", " \n", "\n ", "\n\n", "\t")
LONGEST = 64
REMEMBERED, WORDS_REMEMBERED = 300_000, 600_000
#: New words that go through the library as one text.
ROW = 64

_ENCODERS: dict[str, Encoder] = {}


def cut_at_spaces(text: str) -> list[str]:
    """Pieces of any text that the tokenizers treat alike whatever stands around them."""
    return _CUT.split(text) if _UNSAFE.search(text) or text[:1] == " " else (p := text.split(" "))[:1] + [f" {x}" for x in p[1:]]


def between_spaces(texts: list[str]) -> tuple[list[str], pa.Array, pa.Array]:
    """What stands between single spaces: the distinct strings, those of all texts in a row as places among them, and where
    each text's begin and end."""
    lists = pc.split_pattern(pa.array(texts, pa.string()), " ")
    coded = lists.flatten().dictionary_encode()
    return coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices, lists.offsets


def in_a_row(values: pa.Array, places: pa.Array, ends: pa.Array) -> pa.Array:
    """For each text, the values of its strings one after another."""
    return pc.binary_join(pa.ListArray.from_arrays(ends, values.take(places)), b"")


class Memo:
    """Remembers ``limit`` to twice as many values: what wasn't asked for since the last turn is forgotten."""

    def __init__(self, limit: int):
        self.limit, self.new, self.old = limit, {}, {}

    def missing(self, keys: set[str]) -> list[str]:
        """Keys that ``new`` lacks even after what is still known was brought back."""
        if len(self.new) > self.limit:
            self.new, self.old = {}, self.new
        out = []
        for k in keys - self.new.keys():
            if (value := self.old.get(k)) is None:
                out.append(k)
            else:
                self.new[k] = value
        return out

    def forget(self, keys: list[str]) -> None:
        for k in keys:
            if len(k) > LONGEST:
                del self.new[k]


class Encoder:
    """ids of texts as little-endian bytes, two each (four for a large vocabulary)."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.kind = "<u2" if self.size <= 1 << 16 else "<u4"
        made = json.loads(self.tokenizer.to_str())
        self.special = [x["content"] for x in made["added_tokens"]]
        before = made["pre_tokenizer"] or {}
        self.byte_level = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and made["normalizer"] is None
        self.memo, self.words = Memo(REMEMBERED), Memo(WORDS_REMEMBERED)
        self.bytes = np.zeros(self.size, np.int64)  # that an id of a byte-level vocabulary stands for
        for token, k in self.tokenizer.get_vocab().items():
            self.bytes[k] = len(token)

    def encode_each(self, texts: list[str]) -> list[bytes]:
        """ids of each text, remembering nothing."""
        if not texts:
            return []
        if not all(texts) or any(c in x for x in texts for c in self.special):
            return [np.array(e.ids, self.kind).tobytes() for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]
        # as one list of separate words: one result instead of many
        found = self.tokenizer.encode(texts, is_pretokenized=True, add_special_tokens=False)
        ids = np.array(found.ids, self.kind).tobytes()
        width = np.dtype(self.kind).itemsize
        ends = (np.cumsum(np.bincount(np.array(found.word_ids, np.int64), minlength=len(texts))) * width).tolist()
        return [ids[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def settled(self, text: str) -> bool:
        return bool(SETTLED.fullmatch(text)) and not any(c in text for c in self.special)

    def plain(self, text: str) -> bool:
        """Whether a byte-level vocabulary cuts the text before each space and line end."""
        return self.byte_level and bool(text) and not any(x in text for x in _BLANKS) and text == text.strip() and self.settled(text)

    def encode_row(self, keys: list[str]) -> list[bytes]:
        """ids of a space and each key, of the key alone where it begins with a line end; no key has other white space."""
        texts = [k if k[0] == "\n" else f" {k}" for k in keys]
        rows = self.tokenizer.encode_batch_fast(["".join(texts[a : a + ROW]) for a in range(0, len(texts), ROW)], add_special_tokens=False)
        ids = np.fromiter(chain.from_iterable(e.ids for e in rows), self.kind)
        ends, made = np.cumsum([len(x.encode()) for x in texts]), np.cumsum(self.bytes[ids])
        last = np.searchsorted(made, ends)
        if last[-1:].tolist() != [len(ids) - 1] or (made[last] != ends).any():
            raise ValueError("ids go across words")
        data, cuts = ids.tobytes(), ((last + 1) * ids.itemsize).tolist()
        return [data[a:b] for a, b in zip([0, *cuts], cuts, strict=False)]

    def encode_plain(self, texts: list[str]) -> list[bytes]:
        """ids of each text, all of them plain."""
        if not texts:
            return []
        keys, places, ends = between_spaces(["\n" + t.replace("\n", " \n") for t in texts])
        new = self.words.missing({"\n", *keys})
        self.words.new.update(zip(new, self.encode_row(new) if new else [], strict=True))
        known = self.words.new
        out, first = in_a_row(pa.array(list(map(known.__getitem__, keys)), pa.binary()), places, ends), len(known["\n"])
        self.words.forget(new)
        return [x[first:] for x in out.to_pylist()]

    def encode(self, texts: list[str]) -> list[bytes]:
        """ids of each text."""
        plain = [self.plain(t) for t in texts]
        done = iter(self.encode_plain([t for t, x in zip(texts, plain, strict=True) if x]))
        split = [() if x else _BYTE_LEVEL.findall(t) if self.byte_level and self.settled(t) else cut_at_spaces(t) for t, x in zip(texts, plain, strict=True)]
        new = self.memo.missing({x for own in split for x in own})
        self.memo.new.update(zip(new, self.encode_each(new), strict=True))
        known = self.memo.new
        out = [next(done) if x else b"".join(map(known.__getitem__, own)) for x, own in zip(plain, split, strict=True)]
        self.memo.forget(new)
        return out


def encoder(path: str) -> Encoder:
    """The encoder of a vocabulary file, made once a worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
