"""The corpus pipeline: stages over documents, each written as Parquet and read again as the next one's input.

Toxic documents go, then exact copies, then all but one of each group of near copies, then documents with benchmark
passages; what remains is encoded, one row of token counts and digests for each document.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from sourcegrove.llm import bpe, decontaminate, exact_dedup, ngram_join, queries, stage, toxicity

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def scoped(step: Stage) -> Stage:
    """The tables that a stage writes for itself are deleted when the next stage begins: its result has been written by then."""

    @wraps(step)
    def run_in_scope(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        with stage.scope("pipeline"):
            return step(spark, docs, sf_dir)

    return run_in_scope


@scoped
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that score below the threshold; null and empty texts have no hits and stay, rows that repeat are judged alike."""
    labels = queries.table(spark, sf_dir, "labels").filter(queries.remainder("doc_id", 4) != 2)
    return toxicity.clean_rows(docs, toxicity.learn(docs, labels))


@scoped
def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row with the smallest doc_id of each text; null and empty texts are one text, of rows that are alike one stays."""
    return exact_dedup.kept_rows(docs)


@scoped
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row with the smallest doc_id of each link component; rows without words, or without a doc_id, link with nothing and stay."""
    return ngram_join.one_of_each(docs)


@scoped
def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without a verified benchmark item; null and empty texts stay."""
    return decontaminate.clean_rows(docs, queries.table(spark, sf_dir, "benchmark"))


@scoped
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of digests for each row; null counts as empty."""
    return bpe.bpe_tokens(docs, queries.tokenizer_path())


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_leaks),
    ("BPE encoding and decoding", encode),
]

#: SQL can express neither the learned lexicon nor byte-pair encoding.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. Nulls, empty texts and repeats as the stages say; only columns of documents are looked at by name
    (doc_id, text), others stay whatever their names; an empty table gives an empty result."""
    docs = queries.table(spark, sf_dir, "documents")
    for k, (_, step) in enumerate(STAGES):
        docs = stage.written(step(spark, docs, sf_dir), f"pipeline-{k}", keep=True)
    return docs
