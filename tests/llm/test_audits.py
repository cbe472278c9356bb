"""Filter audit, repetition rules and whitening against brute force."""

import re
from collections import Counter, defaultdict
from fractions import Fraction
from itertools import permutations

import numpy as np
import pytest
from llm_tables import table

from stillwater.llm import filter_audit, repetition, whitening
from stillwater.llm.eigen import eigen

SPACE = "[^\x20\x09-\x0d]+"


def audit_rows():
    long = " ".join(f"w{k % 150}" for k in range(260))
    plain = " ".join(f"u{k}" for k in range(220))
    texts = [long, plain, plain, "Few WORDS", "a b # c", "", "", None, long + " $", ("ab " * 210), ("AB " * 210), plain + " x", long]
    rows = [(k, t, ["s", "t", None][k % 3]) for k, t in enumerate(texts)]
    rows += [(3, "Few WORDS", "s"), (3, "Few WORDS", "s"), (None, plain, "t"), (None, plain, None), (None, "only here | once", ""), (50, "é　Ü " * 300, "u"), (51, "W" * 40_000, "u")]
    return rows


LABELS = [(0, 1, 0), (1, 0, 1), (2, 1, 1), (2, 0, 0), (3, 1, None), (8, None, 1), (None, 1, 1), (99, 1, 1), (50, 1, 0)]


def brute_audit(rows):
    first = defaultdict(list)
    for d, t, _ in rows:
        if d is not None:
            first[t or ""].append(d)
    good = {d for d, q, _ in LABELS if q == 1 and d is not None}
    bad = {d for d, _, x in LABELS if x == 1 and d is not None}
    parts = defaultdict(list)
    for d, t, s in rows:
        t = t or ""
        w = re.findall(SPACE, t)
        fails = {
            "A": len(w) < 200,
            "B": 100 * len(set(w)) < 50 * len(w),
            "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t),
            "D": bool(re.search("[#$%&*|]", t)),
            "E": d is not None and any(x < d for x in first[t]),
        }
        parts[s or ""].append(({k for k, v in fails.items() if v}, d in good, d in bad))
    out = []
    for part, docs in parts.items():
        removed = {}
        for order in map("".join, permutations("ABCDE")):
            for step, x in enumerate(order):
                before = set(order[:step])
                gone = [v for v in docs if x in v[0] and not v[0] & before]
                removed[order, x] = len(gone)
                kept = sum(not v[0] & (before | {x}) for v in docs)
                redundant = sum(x in v[0] and bool(v[0] & before) for v in docs)
                out.append([part, order, step + 1, kept, len(gone), redundant, sum(v[0] == {x} for v in docs), sum(v[1] for v in gone), sum(v[2] for v in gone), x])
        for row in out:
            if row[0] == part:
                row[9] = sum(n for (_, x), n in removed.items() if x == row[9])
    return sorted(map(tuple, out), key=repr)


AUDIT = ("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def test_filter_audit(spark):
    rows = audit_rows()
    docs = spark.createDataFrame([(d, t, s, 1, "x") for d, t, s in rows], "doc_id long, text string, source string, own long, part string").repartition(3)
    labels = spark.createDataFrame([(*x, "y") for x in LABELS], "doc_id long, quality int, toxic int, text string")
    got = filter_audit.audit(docs, labels)
    assert tuple(got.columns) == AUDIT
    assert table(got, *AUDIT) == brute_audit(rows)
    assert filter_audit.audit(docs.limit(0), labels).count() == 0
    assert filter_audit.audit(docs, labels.limit(0)).agg({"good_lost": "max", "toxic_lost": "max"}).first()[0] == 0


def brute_rules(text):
    t = text or ""
    w = re.findall(SPACE, t)
    lines = [x for x in t.split("\n") if re.search(SPACE, x)]
    copies = [x for k, x in enumerate(lines) if x in lines[:k]]
    grams = Counter(zip(w, w[1:], w[2:]))
    inside = {j for k, g in enumerate(zip(w, w[1:], w[2:])) if grams[g] > 1 for j in range(k, k + 3)}
    chars = sum(map(len, w))
    out = [len(w), chars, len(re.findall("[#*$%&|<>]", t)), len(copies), len(inside), sum(len("".join(re.findall(SPACE, x))) for x in copies)]
    for n in (5, 6, 7, 8, 9, 10):
        seen, covered = set(), set()
        for k in range(len(w) - n + 1):
            g = tuple(w[k : k + n])
            if g in seen:
                covered |= set(range(k, k + n))
            seen.add(g)
        out.append(sum(len(w[k]) for k in covered))
    failed = len(w) < 50 or 100 * len(inside) > 50 * len(w)
    return (*out, failed, not failed and all(100 * x <= 20 * chars for x in out[5:]))


def test_repetition_rules(spark, docs, rows):
    line = "one line of seven words é here"
    passage = " ".join(f"p{k}" for k in range(30))
    more = [
        (200, "\n".join(f"{line}\n{k} " + " ".join(f"w{k}-{j}" for j in range(9)) for k in range(8))),
        (201, passage + " " + " ".join(f"q{k}" for k in range(70)) + " " + passage),
        (202, passage + " " + " ".join(f"q{k}" for k in range(900)) + " " + passage),
        (203, " ".join(f"r{k}" for k in range(60)) + " # <b> & |"),
        (204, "\r\n \n\n\t\nx\nx\nx \n"),
        (205, "a " * 49),
        (206, " ".join("ab"[k % 2] for k in range(60))),
        (207, " ".join(f"t{k % 40}" for k in range(70_000))),
    ]
    more_docs = spark.createDataFrame([(d, t, "en", "s", 1, "k", "r", 1, "l", "z", "q") for d, t in more], docs.schema)
    got = table(repetition.rules(docs.unionByName(more_docs)), "doc_id", *repetition.COLUMNS, "base_failed", "kept")
    want = sorted(((d, *brute_rules(t)) for d, t in [*rows, *more]), key=repr)
    assert got == want
    kept = {r[0]: r[-1] for r in want}
    assert not kept[200] and not kept[201] and kept[202] and kept[203] and not kept[206]
    plain = repetition.keep_plain(docs)
    assert plain.columns == docs.columns
    assert table(plain, "doc_id", "text") == sorted(((d, t) for d, t in rows if brute_rules(t)[-1]), key=repr)


def test_repetition_of_nothing(empty):
    assert repetition.rules(empty).count() == 0
    assert repetition.keep_plain(empty).count() == 0


def test_grams_of_one_hash_are_told_apart(monkeypatch):
    """Hashes that only tell words by their length: repeated 3-grams are still counted by their words."""
    real = repetition.common.word_hashes

    def short(texts, lower=False):
        flat, sizes = real(texts, lower)
        words = [w for t in texts for w in (t or "").encode().split()]
        return np.array([len(w) for w in words], np.uint64), sizes

    monkeypatch.setattr(repetition.common, "word_hashes", short)
    texts = ["aa bb cc dd ee ff", None, "aa bb cc aa bb cc dd", "x y z", "aa bb aa bb aa"]
    assert repetition.measure(texts)["n_repeat_words"].tolist() == [brute_rules(t)[4] for t in texts]


def brute_whitening(vectors):
    x = [[int(np.floor(np.float64(c) * 1024)) + 100_000 for c in v] for v in vectors]
    n, d = len(x), len(x[0])
    sums = [sum(r[k] for r in x) for k in range(d)]
    y = [[n * r[k] - sums[k] for k in range(d)] for r in x]
    cov = np.array([[float(Fraction(sum(r[a] * r[b] for r in y), n**3)) for b in range(d)] for a in range(d)])
    return n, [sum(v * v for v in r) for r in y], np.array(y, float) / n, cov


SCHEMA = "vec_id long, embedding array<float>, label int, whitened string, n string"


def rows_of(vectors):
    return [(k, [None if c is None else float(c) for c in v] if v is not None else None, 1, "a", "b") for k, v in enumerate(vectors)]


def test_whitening(spark):
    rng = np.random.default_rng(4)
    good = (rng.normal(size=(300, 12)) @ rng.normal(size=(12, 12)) * 3).astype(np.float32)
    bad = [None, [None] * 12, [1.0] * 11 + [float("nan")], [float("inf")] + [1.0] * 11, [1.0] * 5, [], [3e38] * 12]
    df = spark.createDataFrame(rows_of([*good.tolist(), good[0].tolist(), *bad]) + [(None, good[1].tolist(), 1, "a", "b"), (7, good[2].tolist(), 1, "a", "b")], SCHEMA).repartition(5)
    got = whitening.whiten(df).collect()
    n, deviation, centred, cov = brute_whitening([*good, good[0], good[1], good[2]])
    values, basis = np.linalg.eigh(cov)
    values, basis = values[::-1][:8], basis[:, ::-1][:, :8]
    assert len(got) == 8 * n == 8 * 303
    by = defaultdict(list)
    for r in got:
        by[r["component"]].append(r)
    assert sorted(by) == list(range(1, 9))
    for k in range(8):
        want = centred @ basis[:, k] / np.sqrt(values[k])
        mine = {r["vec_id"]: r for r in by[k + 1] if r["vec_id"] is not None and r["vec_id"] != 7}
        own = np.array([mine[i]["whitened"] for i in range(300) if i != 7])
        theirs = np.array([want[i] for i in range(300) if i != 7])
        assert min(np.abs(own - theirs).max(), np.abs(own + theirs).max()) < 1e-9
        assert all(mine[i]["deviation"] == deviation[i] and mine[i]["deviation_exact"] == str(deviation[i]) for i in mine if i < 300)
        assert {r["n"] for r in by[k + 1]} == {303} and len({r["explained"] for r in by[k + 1]}) == 1
        assert abs(by[k + 1][0]["explained"] / (values[k] / np.trace(cov)) - 1) < 1e-10
    assert len({r["identity_error"] for r in got}) == 1 and got[0]["identity_error"] < 1e-9


def test_whitening_without_variance(spark):
    assert whitening.whiten(spark.createDataFrame([], SCHEMA)).count() == 0
    assert whitening.whiten(spark.createDataFrame(rows_of([None, []]), SCHEMA)).count() == 0
    one = whitening.whiten(spark.createDataFrame(rows_of([[1.0, 2.0, 3.0]] * 2), SCHEMA)).collect()
    assert len(one) == 6 and all(r["whitened"] is None and r["explained"] == 0 and r["deviation"] == 0 and r["identity_error"] is None for r in one)
    flat = whitening.whiten(spark.createDataFrame(rows_of([[1.0, 2.0], [2.0, 2.0], [4.0, 2.0]]), SCHEMA)).collect()
    assert [r["whitened"] is None for r in sorted(flat, key=lambda r: r["component"])] == [False] * 3 + [True] * 3
    assert all(r["identity_error"] < 1e-12 for r in flat)


def test_wide_vectors_and_large_numbers():
    x = np.array([[2**55, -(2**54)], [2**55 + 3, 5]], np.int64)
    sums = [int(v) for v in x.astype(object).sum(0)]
    y = whitening.centred(x, 10**9, sums)
    assert y.tolist() == [[10**9 * int(v) - s for v, s in zip(r, sums, strict=True)] for r in x]
    hi, lo = whitening.parts(y)
    assert [[int(a) + int(b) for a, b in zip(u, v, strict=True)] for u, v in zip(hi, lo, strict=True)] == y.tolist()
    assert whitening.squares(y) == [sum(v * v for v in r) for r in y.tolist()]
    small = np.array([[2**45 - 1, -(2**44) + 7], [0, 3]], np.int64)
    assert whitening.squares(small) == [sum(v * v for v in r) for r in small.tolist()]


def test_products_keep_their_errors():
    """Sums that lose all digits in doubles are right in double-double."""
    rng = np.random.default_rng(1)
    y = rng.integers(-(2**50), 2**50, (257, 3)).astype(object)
    y[200:] = [[v + 1 for v in r] for r in -y[:57]]
    i, j = np.triu_indices(3)
    hi, lo = whitening.products(*whitening.parts(np.array(y.tolist(), np.int64)), i, j)
    for k, (a, b) in enumerate(zip(i, j, strict=True)):
        exact = sum(r[a] * r[b] for r in y.tolist())
        assert abs(Fraction(float(hi[k])) + Fraction(float(lo[k])) - exact) <= sum(abs(r[a] * r[b]) for r in y.tolist()) * Fraction(1, 2**95)


def test_parts_are_merged_in_rounds(spark, monkeypatch):
    monkeypatch.setattr(whitening, "FAN", 2)
    monkeypatch.setattr(whitening, "BLOCK", 7)
    rng = np.random.default_rng(2)
    vectors = rng.normal(size=(90, 6)).astype(np.float32)
    df = spark.createDataFrame(rows_of(vectors.tolist()), SCHEMA).repartition(9)
    scratch = whitening.common.Scratch(spark, "test-whitening")
    own = df.selectExpr("vec_id", "cast(embedding as array<double>) as vector")
    model = whitening.fit(own, scratch, 6)
    n, _, _, cov = brute_whitening(vectors)
    assert n == model.n and np.allclose(model.values, np.linalg.eigvalsh(cov)[::-1], rtol=1e-12) and abs(model.trace / np.trace(cov) - 1) < 1e-14


@pytest.mark.parametrize("n", [1, 2, 3, 7, 40])
def test_eigen(n):
    rng = np.random.default_rng(n)
    base = rng.normal(size=(n, n))
    cases = [base @ base.T, np.eye(n), np.ones((n, n)), np.diag(np.arange(n) // 2 * 1.0), base[:, :1] @ base[:, :1].T, np.zeros((n, n)), base @ np.diag(10.0 ** np.linspace(-9, 9, n)) @ base.T, np.diag(np.abs(np.arange(n) - n / 2)) + np.diag(np.ones(n - 1), 1) + np.diag(np.ones(n - 1), -1)]
    for matrix in cases:
        matrix = (matrix + matrix.T) / 2
        values, vectors = eigen(matrix)
        size = max(np.abs(matrix).max() * n, 1e-300)
        assert np.abs(values - np.linalg.eigvalsh(matrix)[::-1]).max() < 1e-14 * size
        assert np.abs(vectors.T @ vectors - np.eye(n)).max() < 1e-13
        assert np.abs(matrix @ vectors - vectors * values).max() < 1e-14 * size
