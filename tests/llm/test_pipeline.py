"""The pipeline as a whole against its stages by brute force."""

import re
from collections import defaultdict

import public_tokenizers
import pytest
from test_copies import brute_components, brute_contamination
from test_scores import labelled_docs
from tokenizers import Tokenizer

import corpus_pipeline
from stillwater.llm import quality


@pytest.fixture(scope="module")
def tables(spark, rows, tmp_path_factory):
    """Labelled texts, the texts with copies, repeated ids, nulls and empty texts, and columns whose names clash."""
    folder = str(tmp_path_factory.mktemp("sf"))
    docs, labels = labelled_docs(spark, 300)
    labelled = [(r["doc_id"], r["text"]) for r in docs.collect() if r["doc_id"] is None or r["doc_id"] < 300]
    near = labelled[5][1] + " " + labelled[6][1] + " " + labelled[7][1]
    both = labelled + [(1000 + (d or 0), t) for d, t in rows] + [(2000, near), (2001, near + " more"), (2002, near), (2001, "Other text of a repeated id, short."), (None, near)]
    spark.createDataFrame([(d, t, "en", "s", len(t or ""), "k", 1) for d, t in both], "doc_id long, text string, lang string, source string, n_chars long, _id string, _row long").write.parquet(f"{folder}/documents.parquet")
    labels.write.parquet(f"{folder}/labels.parquet")
    items = [(1, " ".join(labelled[9][1].split()[:14])), (2, None), (3, "")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, both, items


def test_run(spark, tables):
    folder, rows, items = tables
    documents = spark.read.parquet(f"{folder}/documents.parquet")
    model = quality.train(documents, spark.read.parquet(f"{folder}/labels.parquet"))
    good = [r for r, s in zip(rows, quality.vote(model, [t for _, t in rows]), strict=True) if s >= 0.3]
    groups = defaultdict(list)
    for d, t in good:
        groups[re.sub("[\x20\x09-\x0d]", "", t or "")].append((d, t))
    one = [min(g, key=lambda m: (-len(m[1] or ""), m[0] is None, m[0] or 0)) for g in groups.values()]
    assert len({d for d, _ in one if d is not None}) >= len(one) - 2
    label = {}
    for d, _, c in brute_components([(k, t) for k, (_, t) in enumerate(sorted(one, key=lambda m: (m[0] is None, m[0] or 0)))]):
        label[d] = c
    ordered = sorted(one, key=lambda m: (m[0] is None, m[0] or 0))
    apart = [m for k, m in enumerate(ordered) if label[k] == k]
    clean = [m for m, r in zip(apart, (brute_contamination([m], items)[0] for m in apart), strict=True) if not r[-1]]
    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    lib.no_truncation()
    lib.no_padding()
    want = sorted(((d, lib.encode(t or "", add_special_tokens=False).ids) for d, t in clean), key=repr)
    import numpy as np

    got = corpus_pipeline.run(spark, folder).collect()
    assert sorted(((r["doc_id"], np.frombuffer(r["ids"], "<u4").tolist()) for r in got), key=repr) == want
    assert 0 < len(want) < len(apart) < len(one) < len(good) < len(rows)
    assert all(r["n_tokens"] * 4 == len(r["ids"]) for r in got)


def test_run_of_nothing(spark, tables, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{tables[0]}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
