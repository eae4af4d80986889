"""The queries opN_<name>: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sourcegrove.llm import bpe, chat_format, decontaminate, exact_dedup, html_extract, language_id, license_scan, ngram_join, stage, suffix_dedup, toxicity

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    stage.small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    """The vocabulary file that the contract of operator 5 names; installed on every machine, never copied."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_join(table(spark, sf_dir, "documents"))


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.chat_format(table(spark, sf_dir, "conversations"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe_tokens(table(spark, sf_dir, "documents"), tokenizer_path())


def op6_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.html_extract(table(spark, sf_dir, "pages"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_scan(table(spark, sf_dir, "documents"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.suffix_dedup(table(spark, sf_dir, "documents"))


def remainder(key: str, by: int) -> Column:
    return F.crc32(F.col(key).cast("string")) % by


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    coder = language_id.learn(docs.filter(remainder("doc_id", 3) != 1))
    found = language_id.language_id(docs, coder)
    return found.select("doc_id", F.coalesce(remainder("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score", "ambiguous")


def toxicity_lexicon(spark: SparkSession, sf_dir: str) -> toxicity.Lexicon:
    labels = table(spark, sf_dir, "labels")
    return toxicity.learn(table(spark, sf_dir, "documents"), labels.filter(remainder("doc_id", 4) != 2))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = toxicity.toxicity(table(spark, sf_dir, "documents"), toxicity_lexicon(spark, sf_dir))
    return found.select("doc_id", F.coalesce(remainder("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "score", "predicted", "n_hits")


QUERIES: dict[str, Query] = {
    "op1_ngram_join": op1_ngram_join,
    "op2_chat_format": op2_chat_format,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_decontaminate": op4_decontaminate,
    "op5_bpe": op5_bpe,
    "op6_html_extract": op6_html_extract,
    "op7_license_scan": op7_license_scan,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_language_id": op9_language_id,
    "op10_toxicity": op10_toxicity,
}
