"""The corpus pipeline: quality, exact copies, near copies, contamination, tokens.

Each stage is a function of (spark, docs, sf_dir); its result is written as Parquet and read again as the next one's
docs.  All stages but the last return the columns of documents.  Null and empty texts fail the first stage.  Of a group
of copies one row stays, whatever doc_ids its rows repeat or lack.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from stillwater.llm import common, decontaminate, exact_dedup, ngram_join, quality, word_bpe


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that their labelled neighbours vote for."""
    common.prepare(spark)
    return quality.keep_good(docs, quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.drop_exact_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each component of near copies."""
    return ngram_join.drop_near_copies(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any passage of the benchmark."""
    return decontaminate.remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, token ids, their number, and the text that they decode to."""
    return word_bpe.encoded(docs, public_tokenizers.path("word_bpe_49k.json"), ["doc_id", "lang", "source"])


STAGES = [
    ("quality", keep_quality),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("bpe_tokens", encode_tokens),
]

#: Nearest-neighbour votes can't be put in SQL; the pipeline's test compares run() with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in a row over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = common.Scratch(spark, "pipeline")
    for name, stage in STAGES:
        docs = scratch.table(stage(spark, docs, sf_dir), name)
    return docs
