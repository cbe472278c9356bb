"""What filters do to a corpus together: every order of them, with what each removes, repeats and costs.

A relational pipeline.  Texts are dealt by (doc_id, text key) once, equal rows as one; then words are exploded and counted by
(doc_id, word) and by doc_id where they already stand, without another shuffle.  The other conditions are columns of a
second scan, outer-joined with the words' totals.  A part's documents are then 32 conditional counts, one for each set of
filters that a document fails (and as many of those with a label), from which all orders follow.

``part`` is the source, an empty string for null.  Null texts count as empty: they fail the filter of few words and, if
another document with a smaller doc_id has an empty text, that of repeated texts.  Rows without doc_id repeat no text and
make none repeated; rows that repeat doc_id and text count each, and none of them repeats another.  A doc_id that is labelled
twice has a label if one of its rows says so; rows without doc_id have none.  Without documents there are no rows.
Other columns aren't read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stillwater.llm import common

FILTERS = "ABCDE"
MASKS = 1 << len(FILTERS)
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 200, 50, 2  # words, percent of words, percent of characters
MARKS = "[#$%&*|]"
BLANK = r"[\x20\x09-\x0D]+"


def word_totals(docs: DataFrame) -> DataFrame:
    """doc_id, own (the text's key), n_words, n_distinct, of each different (doc_id, text) with a word."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_of().alias("text")).withColumn("own", common.text_key())
    once = texts.groupBy("doc_id", "own").agg(F.min("text").alias("text"))
    words = once.select("doc_id", "own", F.explode(F.split("text", BLANK)).alias("word")).where("word != ''")
    each = words.groupBy("doc_id", "own", "word").agg(F.count("*").alias("n"))
    return each.groupBy("doc_id", "own").agg(F.sum("n").alias("n_words"), F.count("*").alias("n_distinct"))


def failures(docs: DataFrame, labels: DataFrame, scratch: common.Scratch) -> DataFrame:
    """part, mask (bit k: the row fails filter k), quality, toxic, rows: how many documents are alike in all of these and doc_id."""
    text = common.text_of()
    plain = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce("source", F.lit("")).alias("part"),
        common.text_key().alias("own"),
        (100 * F.regexp_count(text, F.lit("[A-Z]")) > MOST_CAPITALS * F.length(text)).alias("c"),
        text.rlike(MARKS).alias("d"),
    )
    # rows that repeat all of these go together, so no key is hot from here on but a text or a doc_id
    rows = scratch.table(plain.groupBy(*plain.columns).agg(F.count("*").alias("rows")), "rows")
    totals = scratch.table(word_totals(docs), "words").toDF("_id", "_own", "n_words", "n_distinct")
    counted = rows.join(totals, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("own") == F.col("_own")), "left").drop("_id", "_own").fillna(0, ["n_words", "n_distinct"])
    marked = counted.select("doc_id", "part", F.hex("own").alias("own"), "rows", F.struct((F.col("n_words") < LEAST_WORDS).alias("a"), (100 * F.col("n_distinct") < LEAST_DISTINCT * F.col("n_words")).alias("b"), "c", "d").alias("fails"))
    copies = rows.groupBy(F.hex("own").alias("own")).agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n"))
    total = rows.count()
    with_first = common.attach(marked, copies.where("n > 1"), "own", "n", total, ["first_id"], ["doc_id", "part"])
    kinds = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality", "toxic").groupBy(F.col("doc_id").cast("string").alias("key"))
    kinds = kinds.agg(F.max((F.col("quality") == 1).cast("int")).alias("quality"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    # rows without doc_id are dealt by their texts
    keyed = with_first.withColumn("key", F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("-"), "own")))
    ids = keyed.where("doc_id is not null").groupBy("key").agg(F.count("*").alias("n")).join(kinds, "key")
    labelled = common.attach(keyed, ids, "key", "n", total, ["quality", "toxic"], ["own", "part"])
    fails = [F.col("fails.a"), F.col("fails.b"), F.col("fails.c"), F.col("fails.d"), F.coalesce(F.col("doc_id") > F.col("first_id"), F.lit(False))]
    mask = sum((x.cast("int") * (1 << k) for k, x in enumerate(fails)), F.lit(0))
    return labelled.select("part", mask.alias("mask"), F.coalesce("quality", F.lit(0)).alias("quality"), F.coalesce("toxic", F.lit(0)).alias("toxic"), "rows")


def part_counts(failed: DataFrame) -> DataFrame:
    """One row a part: documents, good and toxic, each an array of MASKS counts, one for each set of failed filters."""

    def counts(name: str, value: Column) -> list[Column]:
        return [F.sum(F.when(F.col("mask") == m, value).otherwise(0)).alias(f"{name}{m}") for m in range(MASKS)]

    wide = failed.groupBy("part").agg(*counts("documents", F.col("rows")), *counts("good", F.col("rows") * F.col("quality")), *counts("toxic", F.col("rows") * F.col("toxic")))
    return wide.select("part", *(F.array(*(f"{name}{m}" for m in range(MASKS))).alias(name) for name in ("documents", "good", "toxic")))


def _orders() -> list[str]:
    from itertools import permutations

    return ["".join(p) for p in permutations(FILTERS)]


def _total(counts: str, condition: str) -> Column:
    return F.expr(f"aggregate(filter(transform({counts}, (n, m) -> named_struct('n', n, 'm', m)), x -> {condition}), 0L, (s, x) -> s + x.n)")


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row a part, filter_order and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    scratch = common.Scratch(common.prepare(docs.sparkSession), "filter_audit")
    parts = scratch.table(part_counts(failures(docs, labels, scratch)), "parts")
    orders = parts.select("*", F.explode(F.array(*map(F.lit, _orders()))).alias("filter_order"))
    steps = orders.select("*", F.posexplode(F.split("filter_order", "")).alias("place", "letter"))
    steps = steps.withColumns({"own": F.expr("shiftleft(1, ascii(letter) - 65)"), "before": F.expr("aggregate(slice(split(filter_order, ''), 1, place), 0, (s, x) -> s + shiftleft(1, ascii(x) - 65))")})
    here, unseen = "(x.m & own) != 0", "(x.m & before) = 0"
    told = steps.select(
        "part",
        "filter_order",
        (F.col("place") + 1).alias("step"),
        "letter",
        _total("documents", f"(x.m & (before | own)) = 0").alias("kept"),
        _total("documents", f"{here} and {unseen}").alias("removed"),
        _total("documents", f"{here} and not {unseen}").alias("redundant"),
        F.expr("documents[own]").alias("unique_fails"),
        _total("good", f"{here} and {unseen}").alias("good_lost"),
        _total("toxic", f"{here} and {unseen}").alias("toxic_lost"),
    )
    told = scratch.table(told, "told")
    shares = told.groupBy("part", "letter").agg(F.sum("removed").alias("shapley"))
    joined = told.join(shares, ["part", "letter"])
    return joined.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
