"""Understanding of questions: type, search variants, document constraint, predicates. Columns only, no joins: rules are expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sourcegrove.functions import rules
from sourcegrove.functions.text import UNICODE, contains_any, matches_any, squeezed, texts, unique_folded


def first_match(x: Column, table: list[tuple[list[str], list[str]]]) -> Column:
    """The expansions of the first rule with a matching pattern, else null."""
    head, *rest = [(matches_any(x, patterns), texts(expansions)) for patterns, expansions in table]
    return reduce(lambda out, r: out.when(*r), rest, F.when(*head))


def answer_type(question: Column) -> Column:
    """Q1: the first type with a matching pattern, else the general type."""
    q = F.lower(F.coalesce(question, F.lit("")))
    head, *rest = [(matches_any(q, patterns), F.lit(name)) for name, patterns in rules.ANSWER_TYPES]
    return reduce(lambda out, r: out.when(*r), rest, F.when(*head)).otherwise(rules.GENERAL)


def formatted(templates: list[str], *values: Column) -> Column:
    return F.array(*[F.format_string(t, *values[: max(1, sum(f"%{i + 1}$s" in t for i in range(3)))]) for t in templates])


def entity_texts(q: Column) -> Column:
    """Expansions for a reference point or another named entity, else null."""
    point = F.upper(F.regexp_extract(q, UNICODE + rules.REFERENCE_POINT, 1))
    ends = F.array_distinct(F.transform(F.regexp_extract_all(q, F.lit(f"{UNICODE}({rules.ENDPOINT})"), F.lit(1)), F.upper))
    pair = F.size(ends) >= 2
    signalling = F.when(pair, formatted(rules.SIGNALLING_PAIR_TEXTS, point, F.try_element_at(ends, F.lit(1)), F.try_element_at(ends, F.lit(2)))).otherwise(formatted(rules.SIGNALLING_TEXTS, point))
    out = F.when(point != "", F.when(matches_any(q, [rules.SIGNALLING]), signalling).otherwise(formatted(rules.POINT_TEXTS, point)))
    for patterns, expansions in rules.ENTITY_CASES:
        out = out.when(reduce(lambda a, b: a & b, [matches_any(q, [p]) for p in patterns]), texts(expansions))
    return out


def generic_texts(q: Column) -> Column:
    """Templates over the named network entities, by what is asked of them; null without an entity."""
    names = F.array_distinct(F.transform(F.regexp_extract_all(q, F.lit(UNICODE + rules.ENTITY), F.lit(1)), F.upper))
    one = F.array_join(names, " ")
    cases = (
        F.when(matches_any(q, rules.FUNCTIONALITY), formatted(rules.FUNCTIONALITY_TEXTS, one))
        .when(matches_any(q, rules.PROCEDURE), formatted(rules.PROCEDURE_TEXTS, one))
        .when(matches_any(q, rules.OVERVIEW), formatted(rules.OVERVIEW_TEXTS, one))
        .otherwise(formatted(rules.OTHER_TEXTS, one))
    )
    return F.when(F.size(names) > 0, cases)


def query_variants(question: Column, most: int = rules.MAX_VARIANTS) -> Column:
    """Q2: the question and up to most - 1 expansions; null for a blank question."""
    clean = squeezed(question)
    q = F.lower(clean)
    none = F.array().cast("array<string>")
    precise, entity, generic, concept = first_match(q, rules.HIGH_PRECISION), entity_texts(q), generic_texts(q), first_match(q, rules.CONCEPTS)

    def grown(*parts: Column) -> Column:
        return F.slice(unique_folded(F.concat(F.array(clean), *[F.coalesce(p, none) for p in parts])), 1, most)

    by_whom = F.when(matches_any(q, rules.BY_DEVICE[0]), texts(rules.BY_DEVICE[1])).when(matches_any(q, rules.BY_NETWORK[0]), texts(rules.BY_NETWORK[1]))
    leaving = F.when(matches_any(q, rules.DEREGISTRATION), by_whom)
    rest = grown(generic, F.coalesce(leaving, concept))
    return F.when(clean != "", F.when(precise.isNotNull(), grown(precise)).when(entity.isNotNull(), grown(entity)).otherwise(rest))


def document_constraint(question: Column) -> Column:
    """struct(org, code) of a document that the question names, else null. RFCs go before specifications."""
    q = F.coalesce(question, F.lit(""))
    rfc = F.regexp_extract(q, UNICODE + r"\bRFC\s*[-:]?\s*(\d{3,5})\b", 1)
    named = UNICODE + r"\b(3GPP|ETSI)\s+(TS|TR)\s+(\d{2,3})\s*([.\-_ ]?)\s*(\d{3})\b"
    org, kind, a, sep, b = (F.regexp_extract(q, named, i) for i in range(1, 6))
    bare = UNICODE + r"\b(TS|TR)\s+(\d{2})\s*[.\-_ ]\s*(\d{3})\b"
    kind2, a2, b2 = (F.regexp_extract(q, bare, i) for i in range(1, 4))
    dotted = (F.upper(org) == "3GPP") | (sep == ".")

    def found(o: Column, c: Column) -> Column:
        return F.struct(o.alias("org"), c.alias("code"))

    return (
        F.when(rfc != "", found(F.lit("IETF"), rfc))
        .when(org != "", found(F.upper(org), F.concat(F.upper(kind), F.lit(" "), a, F.when(dotted, F.lit(".")).otherwise(F.lit(" ")), b)))
        .when(kind2 != "", found(F.lit("3GPP"), F.concat(F.upper(kind2), F.lit(" "), a2, F.lit("."), b2)))
    )


def is_multi_part(question: Column) -> Column:
    """two question marks, a semicolon, or "and" before a second question word."""
    q = F.lower(F.coalesce(question, F.lit("")))
    return (F.regexp_count(q, F.lit(r"\?")) > 1) | q.contains(";") | q.rlike(UNICODE + r"\bve\b.*\b(?:neden|nasıl|ne\s+zaman|hangi|kaç)\b")


def is_explanatory(question: Column) -> Column:
    """F20."""
    return contains_any(F.lower(F.coalesce(question, F.lit(""))), rules.EXPLANATORY)


def allows_exact_lookup(question: Column, kind: Column) -> Column:
    """the question's type has exact patterns, one matches, and no explanation or second part is asked for."""
    q = F.lower(F.coalesce(question, F.lit("")))
    hit = F.lit(False)
    for name, patterns in rules.EXACT_LOOKUP.items():
        hit = hit | ((kind == name) & matches_any(q, patterns))
    return F.coalesce(hit & ~is_multi_part(question) & ~is_explanatory(question), F.lit(False))


def anchors(question: Column) -> Column:
    """Distinct technical anchors of a question, lowered, in order."""
    found = F.regexp_extract_all(F.coalesce(question, F.lit("")), F.lit(f"{UNICODE}({rules.ANCHOR})"), F.lit(1))
    return F.array_distinct(F.transform(found, lambda a: F.lower(F.regexp_replace(a, r"\s+", " "))))


def echoes_value(question: Column, answer: Column) -> Column:
    """a number of the answer stands in the question already."""
    return F.exists(F.regexp_extract_all(F.coalesce(answer, F.lit("")), F.lit(r"(\d+(?:\.\d+)?)"), F.lit(1)), lambda n: F.contains(question, n))


def understand(questions: DataFrame, column: str = "question") -> DataFrame:
    """All of the above as columns beside the question."""
    q = F.col(column)
    return questions.select(
        "*", answer_type(q).alias("answer_type"), query_variants(q).alias("variants"), document_constraint(q).alias("document"),
        is_multi_part(q).alias("multi_part"), is_explanatory(q).alias("explanatory"),
    ).withColumn("exact_lookup", allows_exact_lookup(q, F.col("answer_type")))
