"""The corpus pipeline: documents are filtered for toxicity, near copies and benchmark passages, mixed to target weights,
and written as token shards. Each stage takes what the stage before kept, written as Parquet and read again."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.llm import decontamination, mixing, ngram_jaccard, token_output, toxicity
from tracelake.llm.common import read, small_batches, stored
from tracelake.packaging import ship

#: Token shards have no SQL form; the tests hold the rows against a brute-force version.
ORACLE_SQL = None


#: The columns that the operators of the stages write.
WRITTEN = ["score", "predicted", "contaminated", "item_ids", "similarity", "first_words", "copy_no"]


def with_own_columns(docs: DataFrame, stage: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The rows that a stage keeps with the columns of docs, also of those whose names its operator writes itself."""
    clash = [c for c in docs.columns if c in WRITTEN]
    if not clash:
        return stage(docs).select(*docs.columns)
    rows = docs.select(*[c for c in docs.columns if c not in clash], F.struct(*clash).alias("__own"))
    return stage(rows).select(*[F.col("__own")[c].alias(c) if c in clash else F.col(c) for c in docs.columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the learnt scorer calls toxic go."""
    model = toxicity.fit(docs, read(spark, sf_dir, "labels"))
    return with_own_columns(docs, lambda rows: toxicity.score(rows, model).filter("predicted = 0"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked ones stays (five-word shingles, similarity 0.8)."""
    small_batches(ship(spark))
    return ngram_jaccard.drop_near_copies(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    items = read(spark, sf_dir, "benchmark")
    return with_own_columns(docs, lambda rows: decontamination.find_leaks(rows, items).filter("not contaminated"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every source gets an equal share; a document is there as often as it was drawn."""
    small_batches(ship(spark))
    return with_own_columns(docs, mixing.replicate)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token shards in the shared folder, and a row for each document as read back from them."""
    small_batches(ship(spark))
    params = token_output.TokenParams(public_tokenizers.path("word_bpe_49k.json"))
    return token_output.read_digests(token_output.write_shards(docs, params))


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard", drop_near_copies),
    ("decontamination", drop_leaks),
    ("source_mixing", mix_sources),
    ("token_output", write_tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return stored(STAGES[-1][1](spark, docs, sf_dir), "stage-tokens")
