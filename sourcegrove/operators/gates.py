"""Decisions about documents, answers and second searches, as boolean or text columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sourcegrove.functions import rules
from sourcegrove.functions.text import UNICODE, contains_any, lines, matches_any, squeezed, texts
from sourcegrove.operators.questions import answer_type, echoes_value

DOCUMENT, VALUE = "STANDART / DOKÜMAN", "DEĞER / LİMİT"


def head(text: Column, n: int) -> Column:
    """The first n lines."""
    return F.array_join(F.slice(lines(F.coalesce(text, F.lit(""))), 1, n), "\n")


def is_meeting_contribution(text: Column) -> Column:
    """Two of the marks in the first lines."""
    h = F.lower(head(text, rules.MEETING_LINES))
    return reduce(lambda a, m: a + F.contains(h, F.lit(m)).cast("int"), rules.MEETING_MARKS, F.lit(0)) >= 2


def stated_document(text: Column) -> Column:
    """the code of the 3GPP document that the first lines name, else null."""
    h, pattern = head(text, rules.IDENTITY_LINES), rules.STATED_DOCUMENT
    return F.when(h.rlike(pattern), F.concat(F.upper(F.regexp_extract(h, pattern, 1)), F.lit(" "), F.regexp_extract(h, pattern, 2)))


def is_requested_document(code: Column, text: Column) -> Column:
    """F11."""
    return F.coalesce(stated_document(text) == F.upper(F.trim(code)), F.lit(False))


def fetchable(df: DataFrame) -> DataFrame:
    """resolved references with an address that is open."""
    return df.filter(~F.col("status").isin("blocked", "unresolved") & (F.coalesce("source_url", F.lit("")) != ""))


def reference_section(text: Column) -> Column:
    """From the first "[1] " to the clause of abbreviations; the whole text without a first reference."""
    start = F.regexp_instr(text, F.lit(rules.FIRST_REFERENCE))
    rest = F.substr(text, start)
    tab, space = (F.instr(rest, x) for x in rules.AFTER_REFERENCES)
    end = F.when(tab > 0, tab).when(space > 0, space)
    return F.when(start > 0, F.when(end.isNotNull(), F.substr(rest, F.lit(1), end - 1)).otherwise(rest)).otherwise(text)


def is_cover_noise(org: Column, clause: Column, title: Column) -> Column:
    """the publisher's street address read as a clause."""
    return F.coalesce((F.upper(F.trim(org)) == rules.COVER_NOISE[0]) & (clause == rules.COVER_NOISE[1]) & F.lower(title).contains(rules.COVER_NOISE[2]), F.lit(False))


def precision_phrases(question: Column) -> Column:
    """Q2d: phrases of the first known intent, else an empty array."""
    q = F.lower(F.coalesce(question, F.lit("")))
    out = None
    for needed, absent, phrases in rules.PRECISION_PHRASES:
        test = reduce(lambda a, b: a & b, [contains_any(q, words) for words in needed]) & ~contains_any(q, absent)
        out = F.when(test, texts(phrases)) if out is None else out.when(test, texts(phrases))
    return out.otherwise(F.array().cast("array<string>"))


def is_reference_point_question(question: Column) -> Column:
    """F23."""
    return contains_any(F.lower(F.coalesce(question, F.lit(""))), rules.POINT_WORDS)


def needs_second_search(question: Column, kind: Column, confidence: Column, answer: Column, rendered: Column) -> Column:
    """F16: ordered rules; a sure document answer needs none."""
    q = F.coalesce(question, F.lit(""))
    document = answer_type(q) == DOCUMENT
    has = F.coalesce(F.trim(answer), F.lit("")) != ""
    value = kind == VALUE
    unsure = value & ((confidence != "high") | ~rendered)
    any_rule = is_reference_point_question(q) | matches_any(q, [rf"\b{nf}\b" for nf in rules.SECOND_SEARCH_FUNCTIONS]) | (F.size(precision_phrases(q)) > 0) | document | (value & has & echoes_value(F.lower(q), answer)) | unsure
    return ~(document & (confidence == "high") & has & rendered) & any_rule


def can_answer_now(confidence: Column, rendered: Column, reply: Column) -> Column:
    """a sure and rendered answer needs no generator."""
    return F.coalesce((confidence == "high") & rendered & (F.trim(reply) != ""), F.lit(False))


def scores_usable(hits: DataFrame, question: str = "question", score: str = "rerank_score") -> DataFrame:
    """Per question with hits whether the best score, where there is any, is not negative."""
    return hits.groupBy(question).agg(F.coalesce(F.max(F.col(score).try_cast("double")) >= 0, F.lit(True)).alias("usable"))


def second_wins(question: Column, normal: Column, second: Column) -> Column:
    """whether the second search's evidence goes before the first one's.

    normal and second: structs (code, clause_title, best) of the first hit and the best score; null without hits.
    """
    nf = F.upper(F.regexp_extract(F.coalesce(question, F.lit("")), rules.ASKED_FUNCTION, 1))
    title = F.upper(F.coalesce(normal["clause_title"], F.lit("")))
    other = reduce(lambda a, b: a | b, [F.contains(title, F.lit(x)) & (nf != x) for x in rules.RIVAL_FUNCTIONS])
    report = F.contains(F.upper(F.coalesce(normal["code"], F.lit(""))), F.lit("TR ")) & F.contains(F.upper(F.coalesce(second["code"], F.lit(""))), F.lit("TS "))
    return F.when(second.isNull(), False).when(normal.isNull(), True).when(report, True).when((nf != "") & ~F.contains(title, nf) & other, True).otherwise(F.coalesce(second["best"] >= normal["best"], F.lit(True)))


def document_identity(answer: Column) -> Column:
    """Q8h: struct(org, code) of an answer that is a document's name, else null."""
    a = F.trim(F.coalesce(answer, F.lit("")))
    rfc, spec = rules.ANSWERED_RFC, rules.ANSWERED_SPEC
    return F.when(a.rlike(rfc), F.struct(F.lit("IETF").alias("org"), F.regexp_extract(a, rfc, 1).alias("code"))).when(
        a.rlike(spec), F.struct(F.upper(F.regexp_extract(a, spec, 1)).alias("org"), F.concat(F.upper(F.regexp_extract(a, spec, 2)), F.lit(" "), F.regexp_extract(a, spec, 3)).alias("code"))
    )


def source_quality(title: Column, text: Column) -> Column:
    """Q8g, T5: how well a clause introduces its document."""
    t = F.lower(F.coalesce(title, F.lit("")))
    says = F.lower(F.coalesce(text, F.lit(""))).rlike(rules.SELF_DEFINITION)
    titles = [F.when(contains_any(t, parts), n).otherwise(0.0) for parts, n in rules.TITLE_QUALITY]
    return reduce(lambda a, b: a + b, titles) + F.when(says, 10.0).otherwise(0.0)


def rendered(question: Column, kind: Column, answer: Column, confidence: Column) -> Column:
    """Q10: the sentence for a sure answer of a known type, else null."""
    a = squeezed(answer)
    system = F.regexp_replace(F.regexp_replace(a, r"(?i)\bsystem\b", "System"), r"(?i)\bsubsystem\b", "Subsystem")
    q = squeezed(question)
    at = F.regexp_instr(q, F.lit(UNICODE + rules.SYSTEM_QUESTION))
    subject = F.when(at > 1, F.btrim(F.substr(q, F.lit(1), at - 1), F.lit(" ,;:-")))
    used = contains_any(F.lower(q), rules.USED_WORDS)
    by_subject = F.when(used, F.format_string(rules.SYSTEM_USED, subject, system)).otherwise(F.format_string(rules.SYSTEM_FOR, subject, system))
    out = F.when((kind == "SİSTEM") & (F.coalesce(subject, F.lit("")) != ""), by_subject)
    for name, sentence in rules.ANSWER_SENTENCES.items():
        out = out.when(kind == name, F.format_string(sentence, system if name == "SİSTEM" else a))
    return F.when((confidence == "high") & (a != ""), out)
