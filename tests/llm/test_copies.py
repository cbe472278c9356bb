"""Exact dedup, near copies, repeated passages and decontamination against brute force."""

import hashlib
import re
from collections import defaultdict

import pytest
from llm_tables import table

from stillwater.llm import common, decontaminate, exact_dedup, ngram_join, repeats

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


@pytest.mark.parametrize("bits", [64, 2])
def test_exact_groups(docs, rows, bits):
    groups = defaultdict(list)
    for d, t in rows:
        groups[re.sub("[\x20\x09-\x0d]", "", t or "")].append((d, t or ""))
    want = []
    for s, members in groups.items():
        best = min(range(len(members)), key=lambda k: (-len(members[k][1]), members[k][0] is None, members[k][0] or 0))
        want += [(d, members[best][0], len(members), k == best, sha(s)) for k, (d, _) in enumerate(members)]
    got = table(exact_dedup.exact_groups(docs, bits), "doc_id", "keep_id", "group_size", "kept", "text_sha256")
    assert got == sorted(want, key=repr)


def test_cut_points_follow_content():
    import random

    raw = random.Random(1).randbytes(60_000)
    a = exact_dedup.cut_points(raw)
    b = exact_dedup.cut_points(b"shift" * 99 + raw)
    assert a[-1] == 60_000 and all(y - x <= exact_dedup.MAX_CHUNK for x, y in zip([0, *a], a, strict=False))
    assert len({60_000 - x for x in a} & {len(raw) + 495 - x for x in b}) > len(a) // 2


def test_drop_exact_copies(docs, rows):
    kept = exact_dedup.drop_exact_copies(docs)
    assert kept.columns == docs.columns
    texts = [re.sub("[\x20\x09-\x0d]", "", r["text"] or "") for r in kept.where("doc_id is not null").dropDuplicates(["doc_id"]).collect()]
    assert len(texts) == len(set(texts)) == len({re.sub("[\x20\x09-\x0d]", "", t or "") for d, t in rows if d is not None})


def squeezed(text):
    return re.sub("[\x20\x09-\x0d]", "", text or "")


KEYLESS = [(5, "A"), (9, "A"), (9, "B"), (12, "B"), (20, "C"), (20, "C"), (None, "D"), (None, "D "), (None, "E"), (21, "E"), (None, None), (30, ""), (30, None), (31, "F g"), (31, " Fg"), (31, "Fg"), (32, "F g")]


@pytest.mark.parametrize("bits", [64, 2])
def test_drop_exact_copies_by_row(spark, docs, rows, bits):
    """One row of each group stays, whatever doc_ids repeat or lack."""
    few = spark.createDataFrame([(d, t, "en") for d, t in KEYLESS], "doc_id long, text string, lang string")
    for df, pairs in ((few, KEYLESS), (docs, rows)):
        kept = exact_dedup.drop_exact_copies(df, bits).select("doc_id", "text").collect()
        assert sorted(squeezed(r["text"]) for r in kept) == sorted({squeezed(t) for _, t in pairs})
        rank = lambda d, t: (-len(t or ""), d is None, d or 0)
        for r in kept:
            assert (r["doc_id"], r["text"]) in pairs
            assert rank(r["doc_id"], r["text"]) == min(rank(d, t) for d, t in pairs if squeezed(t) == squeezed(r["text"]))


def shingles(text):
    w = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOW))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_components(rows):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                parent[find(i)] = find(j)
    ids = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        ids[find(i)].append(d)
    out = []
    for i, (d, _) in enumerate(rows):
        known = [x for x in ids[find(i)] if x is not None]
        out.append((d, len(sets[i]), (min(known) if known else d) if sets[i] else d))
    return sorted(out, key=repr)


def test_linked(docs, rows):
    assert table(ngram_join.linked(docs), "doc_id", "n_shingles", "component_id") == brute_components(rows)


def test_drop_near_copies_by_row(spark):
    """One row of each component stays, whatever doc_ids repeat or lack; rows without words stay."""
    one, two, three, four = (" ".join(f"{c}{i}" for i in range(40)) for c in "abcd")
    pairs = [(5, one), (9, one + " x"), (9, two), (12, two + " x"), (20, three), (20, three), (20, three + " x"), (None, four), (None, four + " x"), (None, four), (40, ""), (40, ""), (None, None)]
    kept = ngram_join.drop_near_copies(spark.createDataFrame([(d, t, "en") for d, t in pairs], "doc_id long, text string, lang string"))
    assert kept.columns == ["doc_id", "text", "lang"]
    got = sorted(((r["doc_id"], (r["text"] or "").removesuffix(" x")) for r in kept.collect()), key=repr)
    assert got == sorted([(5, one), (9, two), (20, three), (None, four), (40, ""), (40, ""), (None, "")], key=repr)


def test_linked_small_sets(spark):
    """Sets around the boundary between subsets and lists, in all neighbouring sizes."""
    rows = []
    for k, n in enumerate([5, 6, 7, 8, 9, 9, 10, 11, 12, 13, 14, 15, 16, 17, 18]):
        rows.append((k, " ".join(f"w{i}" for i in range(n))))
        rows.append((100 + k, " ".join(f"v{i}" for i in range(n - 1)) + f" tail{k}"))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert table(ngram_join.linked(df), "doc_id", "n_shingles", "component_id") == brute_components(rows)


@pytest.mark.parametrize("limit", [6, 8, 10, 12])
def test_linked_subsets(spark, monkeypatch, limit):
    """Sets of each size that share one or two shingles less than their size, apart from all others or beside smaller ones."""
    rows = []
    for n in range(3, 14):  # shingles
        for less in (1, 2):
            for k in range(3):
                rows.append((1000 * less + 10 * n + k, " ".join([f"s{n}-{less}-{i}" for i in range(n + 4 - less)] + [f"tail{k}"] * less)))
        rows.append((5000 + n, " ".join(f"run{i}" for i in range(n + 4))))
        rows += [(6000 + 10 * n + k, " ".join([f"run{i}" for i in range(n + 3)] + [f"end{k}"])) for k in range(2) if n % 3 == 0]
    monkeypatch.setattr(ngram_join, "boundary", lambda sizes: limit)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert table(ngram_join.linked(df), "doc_id", "n_shingles", "component_id") == brute_components(rows)


def test_boundary_follows_cost():
    assert ngram_join.boundary({}) == 0
    assert ngram_join.boundary({6: 1000}) >= 6
    assert ngram_join.boundary({20: 1000}) < 20


def brute_repeats(rows, size):
    docs = [(d, re.findall("[^\x20\x09-\x0d]+", t or "")) for d, t in rows]
    least = {}
    for d, w in docs:
        rank = float("inf") if d is None else d
        for i in range(len(w) - size + 1):
            s = tuple(w[i : i + size])
            least[s] = min(least.get(s, float("inf")), rank)
    out = []
    for d, w in docs:
        rank = float("inf") if d is None else d
        gone = set()
        for i in range(len(w) - size + 1):
            if least[tuple(w[i : i + size])] < rank:
                gone.update(range(i, i + size))
        out.append((d, len(w), len(gone), sha(" ".join(x for k, x in enumerate(w) if k not in gone))))
    return sorted(out, key=repr)


def test_repeats(docs, rows):
    assert table(repeats.cut_repeats(docs), "doc_id", "n_words", "n_removed", "kept_sha256") == brute_repeats(rows, repeats.WINDOW)


def brute_contamination(rows, items, size=10):
    cut = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    words = [(i, cut.findall((t or "").translate(LOW))) for i, t in items]
    out = []
    for d, t in rows:
        w = cut.findall((t or "").translate(LOW))
        hit, found = set(), []
        for i, iw in words:
            k = min(size, len(iw))
            windows = {tuple(iw[j : j + k]) for j in range(len(iw) - k + 1)} if iw else set()
            own = [j for j in range(len(w) - k + 1) if windows and tuple(w[j : j + k]) in windows]
            if own:
                found.append(str(i))
                for j in own:
                    hit.update(range(j, j + k))
        out.append((d, len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit)))
    return sorted(out, key=repr)


def brute_longest(rows, items, size=10):
    """The longest verbatim match from a place where a window stands: longest, first in the text, smallest name."""
    cut = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    words = [("" if i is None else str(i), cut.findall((t or "").translate(LOW))) for i, t in items]
    out = []
    for d, t in rows:
        w = cut.findall((t or "").translate(LOW))
        best = (0, None, None)
        for name, iw in words:
            k = min(size, len(iw))
            at = defaultdict(list)
            for j in range(len(iw) - k + 1 if iw else 0):
                at[tuple(iw[j : j + k])].append(j)
            for i in range(len(w) - k + 1):
                for j in at.get(tuple(w[i : i + k]), ()):
                    n = k
                    while i + n < len(w) and j + n < len(iw) and w[i + n] == iw[j + n]:
                        n += 1
                    if best[1] is None or (-n, i, name) < (-best[0], best[1], best[2]):
                        best = (n, i, name)
        out.append((d, *best))
    return sorted(out, key=repr)


def test_longest_match(spark):
    """Windows that stand in several items and places, runs of one word, and items of one name or none."""
    w = [f"w{k}" for k in range(30)]
    items = [(1, " ".join(w[:10]) + " x"), (2, " ".join(w[:15])), (3, "same " * 40), (4, " ".join(w[5:18])), (None, "a b c"), (6, "q " * 12 + " ".join(w[:12]))]
    rows = [(1, " ".join(w[:15])), (2, "same " * 300), (3, "a b c"), (4, " ".join(w)), (5, "q " * 30 + " ".join(w[:12]) + " z " + " ".join(w[:15])), (6, "none"), (7, "same " * 12 + " ".join(w[:10]) + " x")]
    for order in (items, items[::-1]):
        df = spark.createDataFrame(rows, "doc_id long, text string")
        bench = spark.createDataFrame(order, "item_id long, text string")
        for block_bytes in (1 << 20, 60):
            got = decontaminate.contamination(df, bench, block_bytes=block_bytes)
            assert table(got, "doc_id", "longest", "longest_start", "longest_item") == brute_longest(rows, items)


@pytest.mark.parametrize("block_bytes", [1 << 20, 60])
def test_contamination(spark, docs, rows, block_bytes):
    texts = dict(rows)
    pick = texts[97].split()
    items = [(1, " ".join(pick[20:45])), (2, " ".join(pick[20:45])), (10, "one two three"), (3, ""), (4, None), (11, " ".join(texts[106].upper().split()[500:512])), (12, "nothing like this anywhere in there at all my dear friend")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contamination(docs, bench, block_bytes=block_bytes)
    assert table(got, "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == brute_contamination(rows, items)
    assert table(got, "doc_id", "longest", "longest_start", "longest_item") == brute_longest(rows, items)
    clean = decontaminate.remove_contaminated(docs, bench, block_bytes=block_bytes)
    assert clean.columns == docs.columns
    assert sorted(map(repr, (r["doc_id"] for r in clean.collect()))) == sorted(repr(x[0]) for x in brute_contamination(rows, items) if not x[-1])


def test_empty_tables(spark, empty):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert exact_dedup.exact_groups(empty).count() == 0
    assert ngram_join.linked(empty).count() == 0
    assert repeats.cut_repeats(empty).count() == 0
    assert decontaminate.contamination(empty, bench).count() == 0


def thue_morse(n, swap):
    """A word of n letters and its complement: sums of powers can't tell them apart."""
    return "".join("ab"[(bin(k).count("1") + swap) % 2] for k in range(n))


@pytest.mark.parametrize("n", [1024, 2048, 4096])
def test_words_that_collide_as_polynomials(spark, n):
    x, y = thue_morse(n, 0), thue_morse(n, 1)
    shared = " ".join(f"s{k}" for k in range(58))
    rows = [(1, f"{shared} {x}"), (2, f"{shared} {y}"), (3, x), (4, y), (5, f"{x} one two three four"), (6, f"{y} one two three four")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert table(repeats.cut_repeats(df), "doc_id", "n_words", "n_removed", "kept_sha256") == brute_repeats(rows, repeats.WINDOW)
    assert table(ngram_join.linked(df), "doc_id", "n_shingles", "component_id") == brute_components(rows)


def test_signatures_never_exceed_differences():
    import random

    import numpy as np

    rng = random.Random(5)
    for a, b in ((3, 5), (60, 70), (300, 260), (2000, 2500)):
        x = {rng.getrandbits(64) for _ in range(a)}
        y = set(list(x)[: a // 2]) | {rng.getrandbits(64) for _ in range(b - a // 2)}
        signs = [ngram_join.signature(np.array(sorted(s), np.uint64)) for s in (x, y)]
        assert ngram_join.distances([signs[0], signs[0]], [signs[1], signs[0]]).tolist()[1] == 0
        assert ngram_join.distances([signs[0]], [signs[1]])[0] <= len(x ^ y)


def test_long_list_of_near_boundary_sets(spark, monkeypatch):
    """A list of hundreds of sets that share a passage, most without links: blocks give what brute force gives."""
    monkeypatch.setattr(ngram_join, "BLOCK", 32)
    monkeypatch.setattr(ngram_join, "LONG", 16)
    monkeypatch.setattr(ngram_join, "STAR", 64)
    passage = [f"p{k}" for k in range(60)]
    rows = []
    for k in range(400):
        own = [f"u{k}-{i}" for i in range(6 + k % 5)]
        rows.append((k, " ".join(own + passage)))
    rows += [(1000 + k, " ".join([f"u{k}-{i}" for i in range(6 + k % 5)] + passage[:-1] + ["end"])) for k in range(0, 400, 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert table(ngram_join.linked(df), "doc_id", "n_shingles", "component_id") == brute_components(rows)


def test_few_words_alone_in_their_partition(spark):
    """Texts of 0 to 9 words, each in an Arrow batch of its own, beside one long text."""
    texts = ["", *(" ".join(f"w{k}" for k in range(n)) for n in range(1, 10)), None, "w0 w1", " ".join(f"w{k}" for k in range(40))]
    pairs = list(enumerate(texts))
    df = spark.createDataFrame(pairs, "doc_id long, text string").repartitionByRange(len(pairs), "doc_id")
    assert table(ngram_join.linked(df), "doc_id", "n_shingles", "component_id") == brute_components(pairs)
    kept = {r["doc_id"] for r in ngram_join.drop_near_copies(df).collect()}
    assert kept == {d for d, _, c in brute_components(pairs) if d == c}
    for text in texts[:4]:
        one = spark.createDataFrame([(1, text)], "doc_id long, text string")
        assert table(ngram_join.linked(one), "doc_id", "n_shingles", "component_id") == [(1, int(bool(text)), 1)]
    for k in range(10):
        assert [len(x) for x in ngram_join.shingle_sets([" ".join("abcdefghi"[:k])])] == [max(min(k, 1), k - 4)]


def test_one_row_of_each_group_is_kept(spark):
    """Rows that repeat a doc_id, with one text or several, are still told apart."""
    rows = [(7, "t w o"), (7, "two"), (8, "t wo"), (9, "x"), (9, "x"), (None, "y"), (None, "y"), (None, None), (3, "")]
    got = exact_dedup.exact_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    kept = [(r["text_sha256"], r["doc_id"]) for r in got if r["kept"]]
    assert sorted(kept, key=repr) == sorted([(sha("two"), 7), (sha("x"), 9), (sha("y"), None), (sha(""), 3)], key=repr)
    assert len(got) == len(rows)


@pytest.mark.parametrize("parts", [2, 512])
def test_passage_that_many_texts_hold(spark, monkeypatch, parts):
    """Every text holds one passage between words of its own; its keys and digests are heavy, and none is lost."""
    monkeypatch.setattr(common, "HEAVY_PARTS", parts)
    passage = [f"p{k}" for k in range(70)]
    rows = [(d, " ".join([f"a{d}x{k}" for k in range(d % 7)] + passage + [f"b{d}x{k}" for k in range(60)])) for d in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(12)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"]) for r in repeats.cut_repeats(docs).collect()}
    assert got == {d: (d % 7 + 130, 70 if d else 0) for d, _ in rows}
