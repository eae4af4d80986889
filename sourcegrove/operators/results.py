"""Cleaning of retrieval results: status, duplicates, low-value clauses, sources, evidence gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sourcegrove.functions import rules
from sourcegrove.functions.text import folded

AVAILABLE = ("available", "indexed")
UNKNOWN = "Bilinmiyor"


def available(df: DataFrame) -> DataFrame:
    """F1."""
    return df.filter(F.col("status").isin(*AVAILABLE))


def blocked(df: DataFrame) -> DataFrame:
    """F2."""
    return df.filter(F.col("status") == "blocked")


def low_value(title: Column) -> Column:
    """whether a clause title is that of a part without content."""
    return F.btrim(F.lower(F.coalesce(title, F.lit(""))), F.lit(" .:-")).isin(rules.LOW_VALUE_TITLES)


def prefer_content(df: DataFrame, title: str = "clause_title", question: str = "question", document_question: Column | None = None) -> DataFrame:
    """F8: without low-value clauses, unless that leaves a question nothing (or it asks for a document)."""
    keep = ~low_value(F.col(title))
    if document_question is not None:
        keep = keep | document_question
    out = df.withColumn("__keep", keep).withColumn("__any", F.max("__keep").over(Window.partitionBy(question)))
    return out.filter("__keep or not __any").drop("__keep", "__any")


def dedup_key(url: Column, org: Column, code: Column, clause: Column, text: Column) -> Column:
    """By url, clause and text where there is a url, else by org, code, clause and text; spaces and case apart."""
    has = folded(url) != ""
    return F.when(has, F.concat_ws("\u0001", F.lit("url"), folded(url), folded(clause), folded(text))).otherwise(
        F.concat_ws("\u0001", F.lit("metadata"), folded(org), folded(code), folded(clause), folded(text))
    )


def first_of_key(df: DataFrame, key: Column, *order: Column | str, within: tuple[str, ...] = ()) -> DataFrame:
    """The first row of each key in the given order. The key is hashed first, so long texts are not sorted or sent as keys."""
    w = Window.partitionBy(*within, "__key").orderBy(*order)
    return df.withColumn("__key", F.sha2(key, 256)).withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__key", "__n")


def source_key(url: Column, org: Column, code: Column, version: Column, clause: Column) -> Column:
    """By url and clause where there is a url, else by org, code, version and clause."""
    parts = [F.coalesce(x, F.lit("")) for x in (url, org, code, version, clause)]
    return F.when(parts[0] != "", F.concat_ws("\u0001", parts[0], parts[4])).otherwise(F.concat_ws("\u0001", *parts[1:]))


def shown_version(version: Column) -> Column:
    """A version that is a link, or none, is shown as unknown."""
    return F.when(version.isNull() | F.lower(version).startswith("http"), UNKNOWN).otherwise(version)


def matches_document(org: Column, code: Column, document: Column) -> Column:
    """whether a hit is of the document that the question names (no constraint: all are)."""
    return document.isNull() | (folded(org) == folded(document["org"])) & (folded(code) == folded(document["code"]))


def usable_evidence(hits: DataFrame, question: str = "question") -> DataFrame:
    """per question whether it has hits of content, one of the named document, and one of its anchors in the texts.

    hits: question, text, org, code, clause_title, anchors (array of lowered strings), document (struct or null).
    """
    content = hits.filter(~low_value(F.col("clause_title")))
    hay = F.lower(F.concat_ws(" ", "text", "org", "code", "clause_title"))
    any_anchor = (F.size("anchors") == 0) | F.exists("anchors", lambda a: F.contains(hay, a))
    good = content.groupBy(question).agg(F.max(matches_document(F.col("org"), F.col("code"), F.col("document"))).alias("m"), F.max(any_anchor).alias("a"))
    return hits.select(question).distinct().join(good, question, "left").select(question, F.coalesce(F.col("m") & F.col("a"), F.lit(False)).alias("usable"))


def last_of_key(df: DataFrame, key: Column, seq: str) -> DataFrame:
    """Each key once, at its first place, with the values of its last row."""
    cols = [c for c in df.columns if c != seq]
    out = df.groupBy(key.alias("__key")).agg(F.max_by(F.struct(*cols), F.col(seq)).alias("v"), F.min(seq).alias(seq))
    return out.select(seq, "v.*")
