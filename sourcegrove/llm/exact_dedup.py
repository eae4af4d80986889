"""Exact deduplication, skew-safe: local combining, salted digest groups, global combining of the salt winners.

DataFrame functions only. Texts are compared in full at both aggregations: the normalised text itself is a grouping
key beside its digest, so equal digests of different texts would stay apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Of the rows of one text, each of so many salt groups gets its share.
SALTS = 64


def normalised(text: Column) -> Column:
    """Each run of [\\x20\\x09-\\x0D] as one space; null as the empty text."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def exact_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", salts: int = SALTS) -> DataFrame:
    """One row per row of docs: key, keep_id (smallest key with this text), group_size, kept, text_sha256.

    Null texts count as empty and form one group with empty texts. Rows that repeat a whole row (the same key too) count
    in group_size, and each gets its row; of these, each is kept if its key is the smallest. A null key
    never stays unless all keys of its group are null; then keep_id is null and each such row is kept. An empty table
    gives an empty result; other columns, whatever their names, are not looked at.
    """
    rows = docs.select(F.col(key).alias("__key"), normalised(F.col(text)).alias("__text")).select(
        "__key", "__text", F.sha2(F.col("__text"), 256).alias("__digest"), F.pmod(F.xxhash64("__key"), F.lit(salts)).cast("int").alias("__salt")
    )
    # Map-side combining drops the copies within a task; one exchange deals by (digest, text, salt).
    salted = rows.groupBy("__digest", "__text", "__salt").agg(F.min("__key").alias("__low"), F.count(F.lit(1)).alias("__n"))
    # At most `salts` rows of a text reach this exchange, however many copies there are.
    whole = salted.groupBy("__digest", "__text").agg(
        F.min("__low").alias("__keep"), F.sum("__n").alias("__size"), F.collect_list("__salt").alias("__salts")
    )
    # Back to the rows by (digest, length, second hash, salt): again a text's rows are dealt over the salts.
    tag = [F.xxhash64("__text").alias("__hash"), F.length("__text").alias("__len")]
    found = whole.select("__digest", *tag, "__keep", "__size", F.explode("__salts").alias("__salt"))
    return (
        rows.select("__key", "__digest", *tag, "__salt")
        .join(found, ["__digest", "__hash", "__len", "__salt"])
        .select(
            F.col("__key").alias(key),
            F.col("__keep").alias("keep_id"),
            F.col("__size").alias("group_size"),
            F.col("__key").eqNullSafe(F.col("__keep")).alias("kept"),
            F.col("__digest").alias("text_sha256"),
        )
    )


def kept_rows(docs: DataFrame, key: str = "doc_id", text: str = "text", salts: int = SALTS) -> DataFrame:
    """The rows of docs whose text has no row of a smaller key; all columns stay. Of rows equal in key and text, all stay."""
    stay = exact_dedup(docs, key, text, salts).filter("kept").select(F.col(key).alias("__kept_key")).distinct()
    return docs.join(stay, docs[key].eqNullSafe(F.col("__kept_key")), "left_semi")
