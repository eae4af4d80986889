"""The answer guard: whether a reply says only what its sources say (Q12), and what to say if not (Q13)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sourcegrove.functions import rules
from sourcegrove.functions.text import contains_any, folded, squeezed, unique_folded
from sourcegrove.operators.questions import answer_type

SYSTEM, DOCUMENT = "SİSTEM", "STANDART / DOKÜMAN"
_EDGES = "-/.,:;()[]"


def found(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(1))


def identifiers(text: Column) -> Column:
    """Different technical identifiers in order: acronyms, mixed-case names, reference points."""
    return unique_folded(F.transform(found(text, rules.GUARD_IDENTIFIER), lambda x: F.btrim(x, F.lit(_EDGES))))


def unsupported(question: Column, reply: Column, evidence: Column) -> Column:
    """Claims of a reply that neither the evidence nor the question has: identifiers, status codes, abbreviations with another expansion."""
    seen, asked = folded(evidence), folded(question)
    names = F.filter(identifiers(reply), lambda x: ~(F.lower(x).isin(rules.ALLOWED_IDENTIFIERS) | F.contains(seen, F.lower(x)) | F.contains(asked, F.lower(x))))
    codes = F.filter(found(reply, rules.GUARD_STATUS), lambda x: ~(F.contains(seen, x) | F.contains(asked, x)))

    def short(x: Column) -> Column:
        return F.btrim(F.regexp_extract(x, r"^([^\s(]+)", 1), F.lit(_EDGES))

    def long(x: Column) -> Column:
        return F.trim(F.regexp_extract(x, r"\(([^)]+)\)", 1))

    pairs = F.filter(found(reply, rules.GUARD_ABBREVIATION), lambda x: (folded(long(x)) != "") & ~F.lower(short(x)).isin(rules.ALLOWED_IDENTIFIERS) & ~F.contains(seen, folded(long(x))))
    return F.array_distinct(F.concat(names, codes, F.transform(pairs, lambda x: F.concat(short(x), F.lit(" ("), long(x), F.lit(")")))))


def system_terms(evidence: Column) -> Column:
    """Different systems that the evidence names."""
    return unique_folded(found(evidence, rules.GUARD_SYSTEM))


def first_sentence(text: Column) -> Column:
    return F.split(F.trim(F.coalesce(text, F.lit(""))), r"(?<=[.!?])\s+", 2)[0]


def document_as_answer(kind: Column, reply: Column) -> Column:
    """Whether the first sentence offers a document's code where something else is asked for."""
    s = first_sentence(reply)
    low = F.lower(s)
    return (kind != DOCUMENT) & s.rlike(rules.GUARD_DOCUMENT) & ~contains_any(low, rules.GUARD_NOT_DOCUMENT) & contains_any(low, rules.GUARD_DOCUMENT_WORDS)


def names_system(reply: Column, terms: Column) -> Column:
    """Whether a reply has one of the systems, in one of the forms that it may take."""
    r = folded(reply)

    def there(t: Column) -> Column:
        low = folded(t)
        base = F.trim(F.regexp_replace(low, f"{rules.SYSTEM_SUFFIX}$", ""))
        return F.contains(r, low) | (low.endswith(rules.SYSTEM_SUFFIX) & (base != "") & F.contains(r, F.concat(base, F.lit(rules.SYSTEM_FORM)))) | ((low == rules.FIFTH_SYSTEM) & F.contains(r, F.lit(rules.FIFTH_SHORT)))

    return F.exists(terms, there)


def validated(question: Column, reply: Column, evidence: Column) -> Column:
    """struct(valid, reason, evidence_terms, unsupported_claims); the first failed check gives the reason."""
    kind = answer_type(question)
    none = F.array().cast("array<string>")
    terms = F.when(kind == SYSTEM, system_terms(evidence)).otherwise(none)
    claims = unsupported(question, reply, evidence)
    why = rules.GUARD_REASONS
    reason = (
        F.when(squeezed(reply) == "", why["empty"])
        .when(document_as_answer(kind, reply), why["document"])
        .when(F.size(claims) > 0, F.concat(F.lit(why["claims"]), F.array_join(claims, ", ")))
        .when((F.size(terms) > 0) & ~names_system(reply, terms), why["system"])
        .otherwise("")
    )
    return F.struct((reason == "").alias("valid"), reason.alias("reason"), terms.alias("evidence_terms"), claims.alias("unsupported_claims"))


def fallback(question: Column, terms: Column) -> Column:
    """What is said when no valid reply came."""
    return F.when((answer_type(question) == SYSTEM) & (F.size(terms) > 0), F.format_string(rules.GUARD_FALLBACK_SYSTEM, F.try_element_at(terms, F.lit(1)))).otherwise(rules.GUARD_FALLBACK)


def without_expansions(reply: Column) -> Column:
    """Q14: a reply whose names have lost the expansion in parentheses behind them."""
    return F.regexp_replace(reply, rules.EXPANSION, "$1")


def repair_prompt(question: Column, reply: Column, context: Column, checked: Column) -> Column:
    """Q13: the prompt that asks for a better reply: question, type, reply, reason, terms and sources, then the rules."""
    terms = F.when(F.size(checked["evidence_terms"]) > 0, F.array_join(checked["evidence_terms"], ", ")).otherwise(rules.REPAIR_NO_TERMS)
    return F.format_string(rules.REPAIR_PROMPT, question, answer_type(question), reply, checked["reason"], terms, context)
