"""BPE encoding and decoding by a table of distinct words.

This kind of vocabulary drops white space and splits the rest by its own pattern; texts of well-settled characters are
split by that pattern here, any other text at ASCII white space alone, so each word is encoded by itself, once in the
corpus: ``distinct_words`` counts the words, ``word_table`` encodes and decodes each.  The ids come back by position.  The most
frequent words (at most ``HEAD_WORDS`` and ``HEAD_BYTES``) are broadcast and looked up where the text is.  A document moves
once, as the numbers of its words in that head and the words beyond (``pack``), not as its text; where it arrives, the words
beyond, each rare, go as (document, place among them, word) through a join with the table and return as one list a document.
What stands between white space is split into words once a batch of texts.

``decode`` joins the ids of the distinct words with the id-to-piece table, whose size is the vocabulary's, and puts the
pieces of a word together by spaces: the vocabulary file names no decoder.  These texts go the way of the ids, so a document's
decoded text is that of its words in a row.  Where the pieces spell the word and an ending, only their lengths and the ending
move (``cuts``), as the word goes with its document.

Rows are told apart by a 64-bit hash of doc_id and text; another seed is taken should two different rows share it.

Null texts are empty: no ids, empty decoded text.  Rows that repeat doc_id and text share their lists.  Extra columns
are kept where they are named in ``keep``.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stillwater.llm import common, tokens

HEAD_WORDS = 400_000
HEAD_BYTES = 16 << 20
LONGEST = 64
_DECOMPRESSOR = zstandard.ZstdDecompressor()
#: Words of documents that are put together at a time.
HELD_WORDS = 1 << 20

#: The pattern of the vocabulary for lower-cased texts of settled characters, and ASCII white space.
_LETTER = f"{tokens.LETTER}ɐ-ʯⱥⱦ"  # and what settled ones become in lower case
_WORDS = re.compile(f"[{_LETTER}]+|[{tokens.NUMBER}]|'s|'t|'re|'ve|'m|'ll|'d|[^\\s{_LETTER}{tokens.NUMBER}]+")
_SPACE = re.compile("[\x20\x09-\x0d]+")


def _settled(text: str) -> bool:
    return bool(tokens.SETTLED.fullmatch(text)) and "<|" not in text


def split(text: str) -> list[str]:
    """Words whose ids in a row are the text's."""
    if _settled(text):
        return _WORDS.findall(text.lower())
    return [w for w in _SPACE.split(text) if w]


def _keys(texts: list[str]) -> tuple[list[str], pa.Array, pa.Array]:
    """What stands between white space, as from ``between_spaces``; ``_words_of`` gives the words of each."""
    return tokens.between_spaces([t.lower().replace("\n", " ").replace("\t", " ") if _settled(t) else "\t" + _SPACE.sub(" \t", t) for t in texts])


def _words_of(key: str) -> list[str]:
    if key.isalpha():
        return [key]
    if key[:1] == "\t":  # of a text that isn't settled
        return [key[1:]] if len(key) > 1 else []
    return _WORDS.findall(key)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_of().alias("text"))


def distinct_words(docs: DataFrame) -> DataFrame:
    """word, n.  Each task counts its own words first, a bounded number at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out():
            for a in range(0, len(counts), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(words[a : a + 50_000], pa.string()), pa.array(sizes[a : a + 50_000], pa.int64())], names=["word", "n"])

        counts: dict[str, int] = {}
        for batch in common.released(batches):
            keys, places, _ = _keys(batch.column(0).to_pylist())
            for key, n in zip(keys, np.bincount(places.to_numpy(), minlength=len(keys)).tolist(), strict=True):
                for word in _words_of(key):
                    counts[word] = counts.get(word, 0) + n
            if len(counts) > 300_000:
                words, sizes = list(counts), list(counts.values())
                yield from out()
                counts.clear()
        words, sizes = list(counts), list(counts.values())
        yield from out()

    return _texts(docs).select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def encode_words(words: DataFrame, vocabulary: str) -> DataFrame:
    """word, n, ids (little-endian bytes), numbers (the ids as an array): each distinct word is encoded once."""
    kind = np.dtype(tokens.encoder(vocabulary).kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokens.encoder(vocabulary)
        for batch in common.released(batches):
            for a in range(0, batch.num_rows, 5000):
                part = batch.slice(a, 5000)
                ids = own.encode_each(part.column(0).to_pylist())
                ends = np.cumsum([0] + [len(x) // kind.itemsize for x in ids]).astype(np.int32)
                numbers = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(ids), kind).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(ids, pa.binary()), numbers], names=["word", "n", "ids", "numbers"])

    return words.select("word", "n").mapInArrow(run, "word string, n long, ids binary, numbers array<int>")


def pieces(spark: SparkSession, vocabulary: str) -> DataFrame:
    """id, piece: one row an id of the vocabulary; ids without a piece have an empty one."""
    own = tokens.encoder(vocabulary)
    return spark.createDataFrame(pa.table({"id": pa.array(range(own.size), pa.int32()), "piece": pa.array([own.tokenizer.id_to_token(k) or "" for k in range(own.size)], pa.string())}))


def cuts(word: str, parts: list[str]) -> bytes:
    """The pieces of a word, in short where they spell it: 0, their number, their lengths, what follows the word; else 1 and the
    pieces joined by spaces."""
    spelt = "".join(parts)
    sizes = list(map(len, parts))
    if len(parts) < 256 and max(sizes) < 256 and spelt.startswith(word):
        return bytes([0, len(parts), *sizes]) + spelt[len(word) :].encode("utf-8", "surrogatepass")
    return b"\x01" + " ".join(parts).encode("utf-8", "surrogatepass")


def uncut(word: str, short: bytes | None) -> str | None:
    """The pieces of a word joined by spaces, from ``cuts``; null for null."""
    if short is None:
        return None
    if short[0] == 1:
        return short[1:].decode("utf-8", "surrogatepass")
    n = short[1]
    spelt, at, parts = word + short[2 + n :].decode("utf-8", "surrogatepass"), 0, []
    for size in short[2 : 2 + n]:
        parts.append(spelt[at : at + size])
        at += size
    return " ".join(parts)


def decode(table: DataFrame, vocabulary: str, short: bool = False) -> DataFrame:
    """word, n, ids, decoded: the pieces of each word's ids, joined by spaces; null for a word without ids.

    With ``short``, decoded is the binary form of ``cuts``.

    The id-to-piece table is broadcast, as the vocabulary bounds it, so the rows of a word stay in their task in a row and are
    put together there; a word whose rows are not 0 to size - 1 raises an error.
    """
    each = table.select("word", "n", "ids", F.size("numbers").alias("size"), F.posexplode_outer("numbers").alias("pos", "id"))
    first = F.coalesce(F.col("pos"), F.lit(0)) == 0  # count and ids go with one row of a word
    each = each.select(*(F.when(first, F.col(c)).alias(c) for c in ("word", "n", "ids", "size")), "pos", "id")
    joined = each.join(F.broadcast(pieces(table.sparkSession, vocabulary)), "id", "left")
    return joined.select("word", "n", "ids", "size", "pos", "piece").mapInArrow(lambda it: _gather(it, short), f"word string, n long, ids binary, decoded {'binary' if short else 'string'}")


def _gather(batches: Iterator[pa.RecordBatch], short: bool = False) -> Iterator[pa.RecordBatch]:
    """One row a word from its rows in order; a batch's last word may go on in the next one."""

    def whole(part: pa.Table) -> pa.RecordBatch:
        pos = part.column("pos").to_numpy()
        pos = np.where(np.isnan(pos), -1, pos) if pos.dtype.kind == "f" else pos
        starts = np.flatnonzero(pos <= 0)
        ends = np.append(starts[1:], len(pos))
        lead = part.take(pa.array(starts))
        size = lead.column("size").to_numpy()
        if len(pos) and (starts[:1].tolist() != [0] or (size != np.where(pos[starts] < 0, 0, ends - starts)).any() or (np.diff(pos) != 1)[pos[1:] > 0].any()):
            raise ValueError("the pieces of a word are not in its task in order")
        piece = part.column("piece").to_pylist()
        columns = [lead.column(c).combine_chunks() for c in ("word", "n", "ids")]
        form = cuts if short else lambda _, parts: " ".join(parts)
        words = zip(columns[0].to_pylist(), starts.tolist(), ends.tolist(), size.tolist(), strict=True)
        decoded = [form(w, piece[a:b]) if k else None for w, a, b, k in words]
        return pa.RecordBatch.from_arrays([*columns, pa.array(decoded, pa.binary() if short else pa.string())], names=["word", "n", "ids", "decoded"])

    held = None
    for batch in common.released(batches):
        part = pa.Table.from_batches([batch])
        part = pa.concat_tables([held, part]).combine_chunks() if held is not None else part
        last = np.flatnonzero(~(part.column("pos").fill_null(0).to_numpy() > 0))
        cut = int(last[-1]) if len(last) else 0
        held = part.slice(cut)
        if cut:
            yield whole(part.slice(0, cut))
    if held is not None and held.num_rows:
        yield whole(held)


def word_table(words: DataFrame, vocabulary: str, short: bool = False) -> DataFrame:
    """word, n, ids, decoded: each distinct word encoded and decoded once."""
    return decode(encode_words(words, vocabulary), vocabulary, short)


class Numbers(dict):
    """Numbers of words from 0 on; that of any other word is how many there are."""

    def __missing__(self, word: str) -> int:
        return len(self)


class Head:
    """The most frequent words, most frequent first, with their ids and the short form of their pieces.

    A worker builds the form that its tasks need, once: numbers of words, or ids and decoded texts by number.
    """

    def __init__(self, words: pa.Table):
        self.words, self.known, self.made = words, None, None

    def __getstate__(self):
        return {"words": self.words, "known": None, "made": None}

    def numbers(self) -> Numbers:
        if self.known is None:
            self.known, self.made = Numbers((w, k) for k, w in enumerate(self.words.column("word").to_pylist())), None
        return self.known

    def arrays(self) -> tuple[pa.Array, pa.Array]:
        if self.made is None:
            self.known, parts = None, []
            for part in self.words.to_batches(max_chunksize=20_000):  # texts of all words at a time would take four times as much
                parts.append(pa.array([uncut(w, d) for w, d in zip(part.column("word").to_pylist(), part.column("decoded").to_pylist(), strict=True)], pa.string()))
            self.made = _whole(self.words.column("ids")), _whole(pa.chunked_array(parts, pa.string()))
        return self.made


def _whole(column: pa.ChunkedArray) -> pa.Array:
    return pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)


def pack(text: str, known: Numbers) -> tuple[bytes, bytes]:
    """The numbers of a text's words and its words beyond them, each as a zstd frame (nothing for none).

    The first bytes of all numbers come first, then the second and the third ones, most of which are alike.
    """
    return pack_all([text], known)[0]


def pack_all(texts: list[str], known: Numbers) -> list[tuple[bytes, bytes]]:
    """``pack`` of each text; what stands between white space is split and looked up once."""
    keys, places, ends = _keys(texts)
    none, numbers, sizes, beyond, number_of = len(known), [], [], [], known.get
    for key, number in zip(keys, map(number_of, keys), strict=True):
        if number is not None or key.isalpha():  # a word as it stands
            numbers.append(none if number is None else number)
            sizes.append(4)
            beyond.append(f"{key}\n" if number is None else "")
        else:
            words = _words_of(key)
            own = [number_of(w, none) for w in words]
            numbers += own
            sizes.append(4 * len(own))
            beyond.append("".join([f"{w}\n" for w, k in zip(words, own, strict=True) if k == none]) if none in own else "")
    offsets = np.cumsum([0, *sizes]).astype(np.int32)
    each = pa.Array.from_buffers(pa.binary(), len(keys), [None, pa.py_buffer(offsets), pa.py_buffer(np.array(numbers, "<u4"))])
    small, out = zstandard.ZstdCompressor(level=1), []
    for found, rest in zip(*(tokens.in_a_row(x, places, ends).to_pylist() for x in (each, pa.array(beyond, pa.string()).cast(pa.binary()))), strict=True):
        planes = np.frombuffer(found, np.uint8).reshape(-1, 4)[:, :3].T.tobytes()
        out.append((small.compress(planes), small.compress(rest[:-1]) if rest else b""))
    return out


def unpack(numbers: bytes, beyond: bytes) -> tuple[np.ndarray, list[str]]:
    """The numbers and the words beyond, from ``pack``."""
    planes = np.frombuffer(_DECOMPRESSOR.decompress(numbers), np.uint8).reshape(3, -1).astype(np.uint32)
    return planes[0] | planes[1] << 8 | planes[2] << 16, _beyond_words(beyond)


def _beyond_words(beyond: bytes) -> list[str]:
    return _DECOMPRESSOR.decompress(beyond).decode("utf-8", "surrogatepass").split("\n") if beyond else []


def put_together(numbers: list[np.ndarray], rare: list[tuple[bytes, str | None]], ids: pa.Array, decoded: pa.Array) -> tuple[list[bytes], list[str]]:
    """ids and decoded text of each document: those of its numbers, and of ``rare`` in turn where a number is len(ids)."""
    flat, none = np.concatenate([np.zeros(0, np.uint32), *numbers]).astype(np.int64), len(ids)
    beyond = np.flatnonzero(flat == none)
    if len(beyond) != len(rare):
        raise ValueError(f"{len(beyond)} words beyond the head, {len(rare)} found")
    flat[beyond] += np.arange(len(rare))
    if rare:
        ids = pa.concat_arrays([ids, pa.array([i for i, _ in rare], pa.binary())])
        decoded = pa.concat_arrays([decoded, pa.array([d for _, d in rare], pa.string())])
    some = decoded.is_valid().to_numpy(zero_copy_only=False)[flat]  # a word without ids leaves no space
    ends = np.append(0, np.cumsum(some))[np.cumsum([0, *map(len, numbers)])].astype(np.int32)
    flat = pa.array(flat[some])
    return tuple(pc.binary_join(pa.ListArray.from_arrays(pa.array(ends), own.take(flat)), by).to_pylist() for own, by in ((ids, b""), (decoded, " ")))


def _head(table: DataFrame) -> Head:
    return _parted(table)[0]


def _parted(table: DataFrame) -> tuple[Head, DataFrame]:
    """Words from a weight on that at most HEAD_WORDS words reach, found from a histogram of the weights' logarithms; the others.

    The weight of a word is its count; one of more than LONGEST bytes counts so much less as it is longer.
    """
    weight = F.col("n") * LONGEST / F.greatest(F.lit(LONGEST), F.octet_length("word"))
    ranked = table.withColumn("level", F.floor(F.log2(weight) * 16).cast("int"))
    rows = ranked.groupBy("level").agg(F.count("*").alias("n"), F.sum(F.octet_length("word") + F.octet_length("ids") + F.coalesce(F.octet_length("decoded"), F.lit(0))).alias("b")).collect()  # 16 a power of 2
    least, words, size = 1 << 20, 0, 0
    for row in sorted(rows, key=lambda r: -r["level"]):
        words, size = words + row["n"], size + row["b"]
        if words > HEAD_WORDS or size > HEAD_BYTES:
            break
        least = row["level"]
    most = ranked.where(F.col("level") >= least).select("word", "ids", "decoded", "n").toArrow()
    return Head(most.sort_by([("n", "descending")]).drop_columns("n")), ranked.where(F.col("level") < least).select("word", "ids", "decoded")


def _row_key(docs: DataFrame) -> Column:
    """A 64-bit hash of doc_id and text that no two different rows share."""
    for seed in range(16):
        row = F.xxhash64(F.col("doc_id").cast("long"), common.text_of(), F.lit(seed))
        other = F.struct(F.col("doc_id").cast("long").alias("doc_id"), F.substring(common.text_key(), 1, 16).alias("own"))
        keys = docs.select(row.alias("row"), other.alias("other")).groupBy("row").agg(F.min("other").alias("a"), F.max("other").alias("b"))
        if keys.where(~F.col("a").eqNullSafe(F.col("b"))).isEmpty():
            break
    return row


def encode(docs: DataFrame, vocabulary: str, then, schema: str, scratch: common.Scratch, keep: list[str] | None = None) -> DataFrame:
    """Encode every document and hand (ids, decoded texts, kind) of a block to ``then``, which returns the columns of ``schema``.

    The result has ``keep`` (default doc_id) and the columns of ``schema``.
    """
    spark = docs.sparkSession
    table = scratch.table(word_table(distinct_words(docs), vocabulary, short=True), "words")
    row = _row_key(docs)
    most, others = _parted(table)
    head = spark.sparkContext.broadcast(most)
    del most
    kind = tokens.encoder(vocabulary).kind
    common.release(spark)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = head.value.numbers()
        for batch in common.released(batches):
            *others, text = batch.columns
            packs = pack_all(text.to_pylist(), known)
            columns = [pa.array([p[k] for p in packs], pa.binary()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*others, *columns], names=[*batch.schema.names[:-1], "_numbers", "_beyond"])

    def rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.released(batches):
            keys, places, words = [], [], []
            for key, beyond in zip(*(batch.column(c).to_pylist() for c in ("_row", "_beyond")), strict=True):
                own = _beyond_words(beyond)
                keys += [key] * len(own)
                places += range(len(own))
                words += own
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(places, pa.int32()), pa.array(words, pa.string())], names=["_row", "pos", "word"])

    names = keep if keep is not None else ["doc_id"]
    rows = docs.select(*(F.col(f"`{c}`").alias(f"_{k}") for k, c in enumerate(names)), row.alias("_row"), common.text_of().alias("_text"))
    moved = T.StructType([*rows.schema.fields[:-1], T.StructField("_numbers", T.BinaryType()), T.StructField("_beyond", T.BinaryType())])
    # both uses take all columns, so that Spark makes one exchange of them
    dealt = rows.mapInArrow(number, moved).repartition("_row")
    # rows that repeat doc_id and text have one key and ask for the same list, each place of which is kept once
    asked = dealt.mapInArrow(rare, "_row long, pos int, word string")
    # the words of a document come from all over, so flat rows move, not lists of one: a list is 2 to 3 times as large
    found = asked.join(others, "word").select("_row", "pos", "ids", "decoded").repartition("_row")
    tail = found.groupBy("_row").agg(F.collect_set(F.struct("pos", "ids", "decoded")).alias("_rare"))
    joined = dealt.join(tail, "_row", "left")
    joined = joined.select(*(F.col(f"_{k}") for k in range(len(names))), "_numbers", "_beyond", F.col("_rare.pos").alias("_pos"), F.col("_rare.ids").alias("_ids"), F.col("_rare.decoded").alias("_decoded"))

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(part: pa.RecordBatch) -> pa.RecordBatch:
            made = put_together(numbers, rare, ids, decoded)
            return pa.RecordBatch.from_arrays([*part.columns[: len(names)], *then(*made, kind)], schema=pa.schema([part.schema.field(k) for k in range(len(names))] + list(_arrow(schema))))

        ids, decoded = head.value.arrays()
        for batch in common.released(batches):
            first, size, numbers, rare = 0, 0, [], []
            for k, (packs, beyond, *places) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("_numbers", "_beyond", "_pos", "_ids", "_decoded")), strict=True)):
                own, words = unpack(packs, beyond)
                if size and size + len(own) > HELD_WORDS:
                    yield out(batch.slice(first, k - first))
                    first, size, numbers, rare = k, 0, [], []
                numbers.append(own)
                size += len(own)
                there = sorted(zip(*(p or () for p in places), strict=True), key=lambda x: x[0])
                rare += [(i, uncut(w, d)) for w, (_, i, d) in zip(words, there, strict=True)]
            yield out(batch.slice(first))

    out = joined.mapInArrow(assemble, ", ".join([f"`_{k}` {docs.schema[c].dataType.simpleString()}" for k, c in enumerate(names)] + [schema]))
    return out.select(*(F.col(f"_{k}").alias(c) for k, c in enumerate(names)), *(x.name for x in _arrow(schema)))


def _arrow(schema: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    return pa.schema([(name, kinds[kind]) for name, kind in (x.split() for x in schema.split(", "))])


def digests(docs: DataFrame, vocabulary: str) -> DataFrame:
    """One row a document: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    spark = common.prepare(docs.sparkSession)

    def then(lists: list[bytes], decoded: list[str], kind: str) -> list[pa.Array]:
        sizes = [len(x) // np.dtype(kind).itemsize for x in lists]
        ids = [hashlib.sha256(np.frombuffer(x, kind).astype("<u4").tobytes()).hexdigest() for x in lists]
        texts = [hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest() for x in decoded]
        return [pa.array(sizes, pa.int64()), pa.array(ids, pa.string()), pa.array(texts, pa.string())]

    return encode(docs, vocabulary, then, "n_tokens long, ids_sha256 string, decoded_sha256 string", common.Scratch(spark, "word_bpe"))


def encoded(docs: DataFrame, vocabulary: str, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (default doc_id) of each document, its ids (little-endian, four bytes each), their number and
    the decoded text."""
    spark = common.prepare(docs.sparkSession)

    def then(lists: list[bytes], decoded: list[str], kind: str) -> list[pa.Array]:
        wide = [np.frombuffer(x, kind).astype("<u4").tobytes() for x in lists]
        return [pa.array(wide, pa.binary()), pa.array([len(x) // 4 for x in wide], pa.int64()), pa.array(decoded, pa.string())]

    return encode(docs, vocabulary, then, "ids binary, n_tokens long, decoded string", common.Scratch(spark, "word_bpe"), keep)
