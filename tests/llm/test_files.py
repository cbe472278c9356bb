"""Token id files, archives and BPE: exact round trips."""

import base64
import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
from llm_tables import table
from tokenizers import Tokenizer

from stillwater.llm import common, files, huffman, tokens, warc, word_bpe

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
ODD = ["", " ", "  a", "a  b", "a \n b\n\n c ", "don't DON'T 's", "<|endoftext|> x<|endoftext|>", "中文 é 👍🏽", "\x1c a \x85b\xa0c", "½ ²3 İI ı", "x" * 500, "a\r\nb", "́ combining", "<|startoftext|>A b"]


def plain(path):
    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_encoder_is_the_library(path, rows):
    own, lib = tokens.encoder(path), plain(path)
    texts = ODD + [t or "" for _, t in rows] + [a + b for a in ODD for b in ODD]
    for _ in range(2):  # the second time from memory
        assert [np.frombuffer(x, own.kind).tolist() for x in own.encode(texts)] == [e.ids for e in lib.encode_batch(texts, add_special_tokens=False)]


def test_plain_texts_look_up_distinct_words(monkeypatch):
    """The library gets each new word once, many as one text; the texts are not cut into all their pieces in Python."""
    own, lib, rows = tokens.Encoder(BYTES), plain(BYTES), []
    texts = [f"It's {k}th day.\nNaïve über-Straße, don't {'x' * k}!? 'S" for k in range(100)] + ["a", "'s b\n's", "a" * 200, "a\xa0 b \xa0c"]
    monkeypatch.setattr(own, "encode_row", lambda keys, f=own.encode_row: rows.extend(keys) or f(keys))
    for _ in range(2):
        got = [np.frombuffer(x, own.kind).tolist() for x in own.encode(texts)]
        assert got == [e.ids for e in lib.encode_batch(texts, add_special_tokens=False)]
    assert rows.count("day.") == rows.count("don't") == 1 and len(rows) < 250
    monkeypatch.setattr(tokens, "_BYTE_LEVEL", None)
    assert own.encode(texts[:100]) == [np.array(x, own.kind).tobytes() for x in got[:100]]


def test_memo_keeps_what_is_asked_for():
    memo = tokens.Memo(3)
    for k in range(20):
        for x in memo.missing({"often", f"once{k}"}):
            memo.new[x] = b""
        assert "often" in memo.new
    assert len(memo.new) + len(memo.old) < 10


@pytest.mark.parametrize("counts", [[0, 0], [0, 5], [3, 4], [1] * 7, [2**k for k in range(40)], [0, 1, 1, 2, 3, 5, 8, 13, 0, 21]])
def test_code_lengths(counts):
    counts = np.array(counts)
    lengths = huffman.code_lengths(counts, 8)
    used = lengths[counts > 0].astype(int)
    assert (lengths[counts == 0] == 0).all() and used.max(initial=0) <= 8
    assert sum(2.0**-n for n in used) <= 1


def test_too_many_ids_for_the_limit():
    with pytest.raises(ValueError):
        huffman.code_lengths(np.ones(300, int), 8)


def test_encode_decode_blocks():
    rng = np.random.default_rng(4)
    docs = [rng.zipf(1.4, n).clip(0, 3000) for n in (1, 511, 512, 513, 5000, 2)]
    codes = huffman.Codes.of(huffman.code_lengths(np.bincount(np.concatenate(docs), minlength=3001), 16))
    data, offsets, counts = b"", [], []
    for d, (bits, marks) in zip(docs, huffman.encode(codes, docs), strict=True):
        offsets += (marks.astype(np.int64) + 8 * len(data)).tolist()
        counts += [min(huffman.CHECKPOINT, len(d) - k) for k in range(0, len(d), huffman.CHECKPOINT)]
        data += bits
    got = huffman.decode(codes, data, np.array(offsets), np.array(counts))
    assert (got == np.concatenate(docs)).all()


def test_id_files(spark, docs, rows):
    lib = plain(BYTES)
    got = [tuple(r) for r in huffman.round_trip(docs, BYTES).collect()]
    assert len(got) == len(rows)
    ids = {}
    for d, t in rows:
        ids.setdefault(d, []).append(np.array([*lib.encode(t or "", add_special_tokens=False).ids, 0], "<u4"))
    start = 0
    for d, s, n, crc in sorted(got, key=lambda r: r[1]):
        assert s == start and any(len(x) == n and zlib.crc32(x.tobytes()) == crc for x in ids[d])
        start += n
    order = [d for d, *_ in sorted(got, key=lambda r: r[1])]
    assert order == sorted(order, key=lambda d: (d is not None, d or 0))


def test_id_files_of_nothing(empty):
    assert huffman.round_trip(empty, BYTES).count() == 0


def test_word_bpe(spark, docs, rows, monkeypatch):
    monkeypatch.setattr(word_bpe, "HEAD_WORDS", 40)  # most words take the join
    lib = plain(WORDS)
    extra = spark.createDataFrame([(1000 + k, t) for k, t in enumerate(ODD)], "doc_id long, text string")
    both = docs.select("doc_id", "text").unionByName(extra)
    want = []
    for d, t in [*rows, *((1000 + k, t) for k, t in enumerate(ODD))]:
        e = lib.encode(t or "", add_special_tokens=False)
        text = lib.decode(e.ids, skip_special_tokens=False)
        want.append((d, len(e.ids), hashlib.sha256(np.array(e.ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert table(word_bpe.digests(both, WORDS), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(want, key=repr)


def test_word_bpe_of_long_words_and_repeated_rows(spark, monkeypatch):
    """A word of 200 bytes that half the rows hold is in the head; rows that repeat doc_id and text share one list."""
    monkeypatch.setattr(word_bpe, "HEAD_WORDS", 1)
    lib = plain(WORDS)
    rows = [(1, "zyxwvut rare words"), (1, "zyxwvut rare words"), (None, "q" * 200), (None, "q" * 200)] + [(k, "q" * 200) for k in range(2, 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [(r["doc_id"], np.frombuffer(r["ids"], "<u4").tolist()) for r in word_bpe.encoded(docs, WORDS).collect()]
    assert sorted(got, key=repr) == sorted(((d, lib.encode(t, add_special_tokens=False).ids) for d, t in rows), key=repr)
    head = word_bpe._head(word_bpe.word_table(word_bpe.distinct_words(docs), WORDS))
    assert head.words.column("word").to_pylist() == ["q" * 200]


def test_capitals_stay_in_their_word():
    """Settled letters whose lower case is in another block, such as those of Hausa, don't end a word."""
    own, lib = tokens.encoder(WORDS), plain(WORDS)
    texts = ["Ɓaba aȺb", "xɄy"] + [f"a{c}b {c} {c}1{c}" for c in map(chr, range(0x20, 0x250)) if tokens.SETTLED.fullmatch(c)]
    got = [np.frombuffer(b"".join(own.encode_each(word_bpe.split(t))), own.kind).tolist() for t in texts]
    assert got == [e.ids for e in lib.encode_batch(texts, add_special_tokens=False)]
    for t in texts:
        keys, places, _ = word_bpe._keys([t])
        assert [w for k in places.to_pylist() for w in word_bpe._words_of(keys[k])] == word_bpe.split(t)


def test_word_bpe_numbers_each_document_once(spark, docs, monkeypatch):
    """Both uses of the numbered documents read one exchange, and a batch looks each of its strings up once."""
    monkeypatch.setattr(word_bpe, "HEAD_WORDS", 40)
    out = word_bpe.digests(docs, WORDS)
    assert out.count() == docs.count()
    out.collect()
    assert "ReusedExchange" in out._jdf.queryExecution().executedPlan().toString()
    asked, known = [], word_bpe.Numbers({"a": 0, "b": 1})
    monkeypatch.setattr(word_bpe, "_words_of", lambda key, f=word_bpe._words_of: asked.append(key) or f(key))
    packed = word_bpe.pack_all(["a c. b c.\n", "", "c. 中.", "B A"] * 3, known)
    assert sorted(asked) == ["", "\tc.", "\t中.", "c."]
    assert [(n.tolist(), w) for n, w in (word_bpe.unpack(*p) for p in packed)] == [([0, 2, 2, 1, 2, 2], ["c", ".", "c", "."]), ([], []), ([2, 2], ["c.", "中."]), ([1, 0], [])] * 3


def test_word_bpe_of_nothing(empty):
    assert word_bpe.digests(empty, WORDS).count() == 0


PAGES = [(5, "http://a/x y", "<p>one</p>"), (2, None, "<p>one</p>"), (3, "http://b", ""), (9, "http://c", None), (4, "http://d\r\nX: 1", "é" * 5000), (None, "http://e", "<p>one</p>"), (None, "http://f", "only without id"), (8, "http://g", "\r\n\r\nWARC/1.1\r\n")]


def brute_pages(rows, least=0):
    first = {}
    for p, _, h in rows:
        b = (h or "").encode()
        if p is not None and len(b) >= least:
            first[b] = min(first.get(b, p), p)
    out = []
    for p, _, h in rows:
        b = (h or "").encode()
        f = first.get(b)
        again = f is not None and f != p and len(b) >= least
        out.append((p, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if again else "response", f if again else None))
    return sorted(out, key=repr)


def pages(spark):
    return spark.createDataFrame([(*r, "clash", 1) for r in PAGES], "page_id long, url string, html string, payload string, n long")


def test_archives(spark):
    got = table(warc.round_trip(pages(spark)), "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert got == brute_pages(PAGES)
    assert warc.round_trip(pages(spark).limit(0)).count() == 0


def test_archive_reader(spark):
    path = common.Scratch(common.prepare(spark), "warc-test").sub("a")
    warc.write_pages(pages(spark), path, least_bytes=4)
    assert table(warc.read(spark, path).where("record_type in ('response', 'revisit')"), "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to") == brute_pages(PAGES, 4)
    one = warc.read(spark, path).where("record_type = 'revisit'")
    assert {r["record_type"] for r in one.collect()} == {"revisit"}
    assert all(r["payload"] is None for r in warc.read(spark, path, payload=False).collect())
    small = spark.read.format("warc").option("path", path).option("range_bytes", 300).load().where("record_type <> 'warcinfo'")
    assert table(small, "page_id", "payload_bytes") == table(warc.read(spark, path).where("record_type <> 'warcinfo'"), "page_id", "payload_bytes")
    import gzip

    for name, _ in files.sizes(path, ".warc.gz"):  # any gzip reader can read the archives
        assert gzip.decompress(files.read(f"{path}/{name}")).startswith(b"WARC/1.1\r\n")


def test_archives_of_repeated_pages(spark):
    """Each record has an id of its own, and of rows that repeat page_id and payload one is the response."""
    rows = [(5, "u2", "x"), (5, "u1", "x"), (5, "u1", "x"), (5, None, "x"), (5, "u1", "y"), (6, "u1", "x"), (None, "u1", "x"), (None, "u1", "z"), (None, "u1", "z"), (7, "u", ""), (7, "u", "")]
    path = common.Scratch(common.prepare(spark), "warc-test").sub("b")
    warc.write_pages(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4), path, least_bytes=1)
    found = [r for r in warc.read(spark, path).collect() if r["record_type"] != "warcinfo"]
    assert len({r["record_id"] for r in found}) == len(found) == len(rows)
    assert sorted(((r["page_id"], r["target_uri"]) for r in found), key=repr) == sorted(((p, u) for p, u, _ in rows), key=repr)
    told = [(r["page_id"], r["target_uri"], bytes(r["payload"]).decode()) for r in found if r["record_type"] == "response"]
    assert sorted(told, key=repr) == sorted([(5, "u1", "x"), (5, "u1", "y"), (None, "u1", "z"), (None, "u1", "z"), (7, "u", ""), (7, "u", "")], key=repr)
    assert [r["refers_to"] for r in found if r["record_type"] == "revisit"] == [5] * 5


def test_archives_of_long_payloads(spark):
    """Payloads of more bytes than an Arrow batch may hold, and one in two archives' worth of ranges."""
    rows = [(k, f"u{k}", "".join(chr(97 + (i * k) % 26) for i in range(997)) * (9000 if k < 3 else 1)) for k in range(1, 5)] + [(9, "u9", None)]
    rows.append((8, "u8", rows[0][2]))
    path = common.Scratch(common.prepare(spark), "warc-test").sub("c")
    docs = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)
    warc.write_pages(docs, path)
    columns = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert table(warc.read(spark, path).where("record_type <> 'warcinfo'"), *columns) == brute_pages(rows)
    held = {r["page_id"]: bytes(r["payload"]).decode() for r in warc.read(spark, path).where("record_type = 'response'").collect()}
    assert held == {p: h or "" for p, _, h in rows if p != 8}


def test_pieces_out_of_order_are_an_error():
    """Words may go on from batch to batch; a piece that is missing or out of order is no silent loss."""
    import pyarrow as pa

    def batches(rows, cuts):
        names = ("word", "n", "ids", "size", "pos", "piece")
        kinds = (pa.string(), pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.string())
        for a, b in zip([0, *cuts], [*cuts, len(rows)], strict=True):
            part = list(zip(*rows[a:b], strict=True)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(part, kinds, strict=True)], names=names)

    def word(w, parts):
        return [(w if k == 0 else None, 1 if k == 0 else None, b"" if k == 0 else None, len(parts) if k == 0 else None, k, p) for k, p in enumerate(parts)]

    rows = word("ab", ["a", "b"]) + [("-", 3, b"", 0, None, None)] + word("cdefg", list("cdefg")) + word("h", ["h"])
    want = [("ab", "a b"), ("-", None), ("cdefg", "c d e f g"), ("h", "h")]
    for cuts in ([], [1], [2], [3], [4, 5, 5, 7], list(range(1, len(rows)))):
        got = [x for b in word_bpe._gather(batches(rows, cuts)) for x in zip(b.column("word").to_pylist(), b.column("decoded").to_pylist(), strict=True)]
        assert got == want
    for wrong in (rows[1:], rows[:4] + rows[5:], rows[:4] + [rows[5], rows[4]] + rows[6:], rows[:7] + rows[8:]):
        with pytest.raises(ValueError):
            list(word_bpe._gather(batches(wrong, [])))
    assert list(word_bpe._gather(iter([]))) == []


def test_pieces_in_short_are_exact():
    for word, parts in [("abc", ["a", "bc</w>"]), ("abc", ["abc"]), ("Abc", ["a", "bc</w>"]), ("日本", ["日", "本</w>"]), ("x" * 300, ["x" * 300]), ("y" * 300, ["y"] * 300), ("a", ["", "a", ""]), ("ab", ["a", " b"])]:
        assert word_bpe.uncut(word, word_bpe.cuts(word, parts)) == " ".join(parts)
    assert word_bpe.uncut("a", None) is None
    assert len(word_bpe.cuts("zyxwvut", ["zy", "xw", "vut</w>"])) == 9


def test_words_are_decoded_by_a_join(spark):
    """Each distinct word's decoded text is the library's, and documents put them together."""
    lib = plain(WORDS)
    words = ["hello", "zyxwvut", "Ünïcode", "日本", "a" * 300, "x1-2", "́", "�"]
    docs = spark.createDataFrame([(k, w) for k, w in enumerate(words)] + [(99, " \t "), (100, None)], "doc_id long, text string")
    rows = word_bpe.word_table(word_bpe.distinct_words(docs), WORDS).collect()
    assert len({r["word"] for r in rows}) == len(rows)
    for r in rows:
        ids = lib.encode(r["word"], add_special_tokens=False).ids
        assert (r["decoded"] or "") == lib.decode(ids, skip_special_tokens=False)
        assert (r["decoded"] is None) == (not ids) and np.frombuffer(r["ids"], "<u2").tolist() == ids
    plan = word_bpe.word_table(word_bpe.distinct_words(docs), WORDS)._jdf.queryExecution().toString()
    assert "BroadcastHashJoin" in plan


def test_documents_move_as_numbers_of_words():
    """A document moved as its text, which its words' numbers and the words beyond the head spell in fewer bytes."""
    import pyarrow as pa

    words = [f"word{k}" for k in range(70_000)]
    known = word_bpe.Numbers((w, k) for k, w in enumerate(words))
    text = " ".join([words[k * k % 70_000 if k % 3 else k % 20] for k in range(3000)])
    both = f"{text} beyond1 {text} Beyond2 ünd2 "
    numbers, beyond = word_bpe.unpack(*word_bpe.pack(both, word_bpe.Numbers(known | {str(-k): 70_000 + k for k in range(200_000)})))
    assert len(numbers) > 6000 and beyond[-1:] and int(numbers.max()) == 270_000 and (numbers == 270_000).sum() == len(beyond)
    assert word_bpe.unpack(*word_bpe.pack("", known))[0].tolist() == [] and word_bpe.unpack(*word_bpe.pack(" \n", known))[1] == []
    ids, decoded = pa.array([b"a", b"", b"bc"]), pa.array(["A", None, "B C"])
    docs = [np.array(x, np.uint32) for x in ([0, 3, 2], [], [1], [1, 3, 1, 0, 3])]
    rare = [(b"x", "X"), (b"", None), (b"yz", "Y")]
    assert word_bpe.put_together(docs, rare, ids, decoded) == ([b"axbc", b"", b"", b"ayz"], ["A X B C", "", "", "A Y"])
    with pytest.raises(ValueError):
        word_bpe.put_together(docs, rare[:2], ids, decoded)


def test_word_bpe_puts_few_words_together_at_a_time(docs, rows, monkeypatch):
    monkeypatch.setattr(word_bpe, "HELD_WORDS", 1)
    monkeypatch.setattr(word_bpe, "HEAD_WORDS", 40)
    want = sorted((d, plain(WORDS).encode(t or "", add_special_tokens=False).ids) for d, t in rows if d is not None)
    got = [(r["doc_id"], np.frombuffer(r["ids"], "<u4").tolist()) for r in word_bpe.encoded(docs.where("doc_id is not null"), WORDS).collect()]
    assert sorted(got) == want
