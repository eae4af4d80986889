"""Text around matches, and joins by containment and by sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters on each side of a match.
AROUND = 180


def around(text: Column, part: Column, width: int = AROUND) -> Column:
    """The text around the first match of part, case apart; null without a match."""
    at = F.instr(F.lower(text), F.lower(part))
    return F.when(at > 0, F.substring(text, F.greatest(at - width, F.lit(1)), F.least(at - 1, F.lit(width)) + F.length(part) + width))


def neighbours(sentences: Column, index: Column, n: int = 1) -> Column:
    """The sentence at a zero-based index with n before and behind it."""
    first = F.greatest(index - n, F.lit(0))
    return F.array_join(F.slice(sentences, first + 1, index + n + 1 - first), " ")


def mentioned(refs: DataFrame, candidates: DataFrame, question: str = "question") -> DataFrame:
    """Per question and candidate how many of the question's references the candidate's name holds, with or without its organisation.

    refs (question, ref) and candidates (question, candidate) meet by question, so no table is crossed with another.
    """
    name = F.lower("candidate")
    test = F.contains(name, F.lower("ref")) | F.contains(F.regexp_replace(name, "^3gpp ", ""), F.lower("ref"))
    return candidates.join(refs, question).filter(test).groupBy(question, "candidate").agg(F.count(F.lit(1)).alias("n"))


def named_in(questions: DataFrame, refs: DataFrame, text: str = "text", code: str = "code") -> DataFrame:
    """The references (a page's, a short list beside each question as array column `codes`) whose code stands in the question, spaces apart."""
    q = F.replace(F.lower(F.col(text)), F.lit(" "), F.lit(""))
    listed = questions.join(refs.groupBy("page").agg(F.array_sort(F.collect_set(code)).alias("codes")), "page")
    return listed.withColumn("named", F.filter("codes", lambda c: F.contains(q, F.replace(F.lower(c), F.lit(" "), F.lit(""))))).filter(F.size("named") > 0)


def endpoints(label: Column) -> Column:
    """The two ends of a label like "AMF-SMF" or "NG-RAN / AMF", capitals, RAN names folded."""
    parts = F.split(F.regexp_replace(F.upper(F.trim(label)), r"NG-RAN|GNB|GNODEB", "RAN"), r"\s*[/–-]\s*")
    return F.array_sort(F.array_distinct(F.filter(parts, lambda p: p != "")))


def endpoint_score(ends: Column, entities: Column) -> Column:
    """24 if all ends are among the question's entities, 4 if exactly one is, else 0."""
    hit = F.size(F.array_intersect(ends, entities))
    return F.when((F.size(ends) > 0) & (hit == F.size(ends)), 24).when(hit == 1, 4).otherwise(0)
