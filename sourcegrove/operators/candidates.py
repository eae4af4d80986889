"""Answer candidates in the evidence of questions: what they are, how well they fit, how sure the best one is.

Everything is column expressions over hits, one row a question and source: question, q (its text), rank (from 1), org, code, clause,
clause_title, text, variants (array of search texts, the question first) and answer_type. Only candidates are grouped, by question.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sourcegrove.functions import rules
from sourcegrove.functions.text import bound, contains_any, folded, literal, squeezed, unique_folded
from sourcegrove.operators import evidence
from sourcegrove.operators.evidence import words

#: Fixed values of the alignment of a candidate with a question's variants.
EXACT, SCALE = 12.0, 10.0
#: Fixed values of the alignment of a text with them: the whole variant in the text, or its words' share.
CONTAINED, COVERED = 15.0, 10.0
DOCUMENT, POINT, PROTOCOL, FUNCTION, VALUE, MESSAGE, PROCEDURE = "STANDART / DOKÜMAN", "ARAYÜZ / REFERANS NOKTASI", "PROTOKOL", "NETWORK FUNCTION", "DEĞER / LİMİT", "MESAJ", "PROSEDÜR"
NONE = "array<string>"


def empty() -> Column:
    return F.array().cast(NONE)


def common(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b))


def canonical(x: Column) -> Column:
    """Folded, with one spelling of deregistration."""
    return F.replace(F.replace(folded(x), F.lit("de-registration"), F.lit("deregistration")), F.lit("de registration"), F.lit("deregistration"))


def highest(values: Column) -> Column:
    return F.coalesce(F.array_max(values), F.lit(0.0))


def points(condition: Column, n: float) -> Column:
    return F.when(condition, F.lit(float(n))).otherwise(F.lit(0.0))


# ---------------------------------------------------------------- candidates


def up_to_ends(text: Column, pattern: str) -> Column:
    """The text as far as matches of a pattern can reach: to the last place of the pattern's end, where `rules.CANDIDATE_ENDS` has it. Behind it
    the pattern would try its words at each letter in vain."""
    whole = F.coalesce(text, F.lit(""))
    return F.regexp_extract(whole, f"(?s)^.*{rules.CANDIDATE_ENDS[pattern]}", 0) if pattern in rules.CANDIDATE_ENDS else whole


def extracted(text: Column, kind: Column, anchors: Column | None = None, near: Column | None = None) -> Column:
    """Q6: the different candidates of a text for an answer type, in order of the type's patterns, then of place; generic ones left out.

    anchors: the question's anchors; for network functions acronyms near enough of them follow. near: their `windows`, if at hand.
    """
    out = None
    for name, patterns in rules.CANDIDATE_PATTERNS.items():
        found = reduce(F.concat, [F.regexp_extract_all(up_to_ends(text, p), F.lit(p), F.lit(1)) for p in patterns])
        if name == FUNCTION and anchors is not None:
            found = F.concat(found, window_acronyms(text, windows(text, anchors) if near is None else near))
        out = F.when(kind == name, found) if out is None else out.when(kind == name, found)
    kept = unique_folded(F.transform(F.coalesce(out, empty()), squeezed))
    return F.filter(kept, lambda c: ~F.lower(c).isin(rules.GENERIC_CANDIDATES))


def function_anchors(question_words: Column) -> Column:
    """The words of a question that name what a network function does."""
    return F.filter(question_words, lambda w: ~w.isin(rules.NO_ANCHORS) & w.rlike(r"^[a-z0-9./\-]+$"))


def windows(text: Column, anchors: Column) -> Column:
    """Sentences with two of the anchors (one where there is one), each with its neighbours: struct(text, low, overlap)."""
    least = F.least(F.size(anchors), F.lit(2))

    def of(parts: Column) -> Column:
        near = F.filter(F.sequence(F.lit(1), F.size(parts)), lambda i: evidence.shared(anchors, F.get(parts, i - 1)) >= least)
        joined = F.transform(near, lambda i: F.array_join(F.slice(parts, F.greatest(i - 1, F.lit(1)), F.least(i + 1, F.size(parts)) - F.greatest(i - 1, F.lit(1)) + 1), " "))
        rows = F.transform(joined, lambda w: F.struct(w.alias("text"), F.lower(w).alias("low"), common(anchors, words(w)).alias("overlap")))
        return F.when(F.size(parts) > 0, rows)

    none = F.array().cast("array<struct<text:string,low:string,overlap:int>>")
    return F.when(F.size(anchors) > 0, F.coalesce(bound(evidence.sentences(text), of), none)).otherwise(none)


def window_acronyms(text: Column, near: Column) -> Column:
    """Q6: different acronyms in the windows around the anchors, without those that are no functions or are spelt out as something else."""
    found = F.flatten(F.transform(near, lambda w: F.regexp_extract_all(w["text"], F.lit(rules.ACRONYM), F.lit(0))))
    return F.filter(F.array_distinct(found), lambda a: ~a.isin(rules.NO_FUNCTIONS) & a.rlike("^[A-Z]{2,8}$") & (role(a, text) >= 0))


# ---------------------------------------------------------------- how a candidate fits


def alignment(candidate: Column, variants: Column) -> Column:
    """12 if a variant is the candidate itself, else 10 times the best F1 of word sets."""
    own, name = words(canonical(candidate)), canonical(candidate)

    def one(v: Column) -> Column:
        theirs = words(canonical(v))
        f1 = 2.0 * common(own, theirs) / (F.size(own) + F.size(theirs))
        return F.when(canonical(v) == name, EXACT).otherwise(F.coalesce(SCALE * f1, F.lit(0.0)))

    return F.when(F.size(own) > 0, highest(F.transform(variants, one))).otherwise(F.lit(0.0))


def local_context(text: Column, candidate: Column) -> Column:
    """The text around the candidate's first place, empty if it has none."""
    at = F.regexp_instr(text, F.concat(F.lit("(?iu)"), literal(candidate)))
    start = F.greatest(at - rules.CONTEXT_CHARS, F.lit(1))
    return F.when(at > 0, F.substr(text, start, at + F.length(candidate) + rules.CONTEXT_CHARS - start)).otherwise(F.lit(""))


def context_points(question_words: Column, context: Column) -> Column:
    """Q7b."""
    return F.least(common(question_words, words(context)), F.lit(rules.MOST_CONTEXT_WORDS)) * rules.EACH_CONTEXT_WORD


def echo(candidate: Column, question: Column, kind: Column) -> Column:
    """What is taken off a candidate that the question names already."""
    base = F.trim(F.regexp_replace(F.trim(candidate), r"(?i)\s+protocol$", ""))
    protocol = (kind == PROTOCOL) & (base != "") & F.contains(F.lower(question), F.lower(base))
    return F.when(protocol, rules.PROTOCOL_ECHO).when((kind == FUNCTION) & F.contains(folded(question), folded(candidate)), rules.FUNCTION_ECHO).otherwise(0.0)


def procedure_points(candidate: Column, variants: Column) -> Column:
    """Q7d: a procedure's kind and who initiates it, against what is asked."""
    c, asked = canonical(candidate), F.transform(variants, canonical)

    def in_question(*parts: str) -> Column:
        return F.exists(asked, lambda v: contains_any(v, parts))

    leaving = F.when(c.contains("deregistration"), 5.0).when(c.contains("registration"), -6.0).otherwise(0.0)
    device = points(c.contains("ue initiated"), 5) - points(c.contains("network initiated"), 8)
    network = points(contains_any(c, ["network initiated", "network triggered"]), 5) - points(c.contains("ue initiated"), 8)
    return (
        points(F.array_contains(asked, c), 6)
        + F.when(in_question("deregistration"), leaving).otherwise(0.0)
        + F.when(in_question("ue initiated"), device).otherwise(0.0)
        + F.when(in_question("network initiated", "network triggered"), network).otherwise(0.0)
    )


def direction(candidate: Column, question: Column) -> Column:
    """Q7g: a question for what is sent wants requests, not answers."""
    low = F.lower(candidate)
    sent = F.when(contains_any(low, rules.SENT), rules.DIRECTION).when(contains_any(low, rules.ANSWERED), -rules.DIRECTION).otherwise(0.0)
    return F.when(contains_any(F.lower(question), rules.SENDING), sent).otherwise(0.0)


def end_name(x: Column) -> Column:
    up = F.upper(F.trim(x))
    return F.when(up.isin(rules.RADIO_ENDS), "RAN").otherwise(up)


def question_ends(question: Column) -> Column:
    """The different network entities that a question names by acronym."""
    found = F.transform(F.regexp_extract_all(question, F.lit(rules.ACRONYM), F.lit(0)), lambda a: F.upper(a))
    return F.array_distinct(F.transform(F.filter(found, lambda a: ~a.isin(rules.NO_QUESTION_ENDS)), end_name))


def point_relations(text: Column, ends: Column) -> Column:
    """Q7e: struct(label, points) of each sentence that tells a reference point's ends, against the two ends that are asked for."""

    def told(pattern: str, label: int, sides: tuple[int, int]) -> Column:
        groups = F.arrays_zip(*[F.regexp_extract_all(text, F.lit(pattern), F.lit(g)).alias(n) for g, n in ((label, "l"), (sides[0], "a"), (sides[1], "b"))])

        def scored(m: Column) -> Column:
            pair = F.array_distinct(F.array(end_name(m["a"]), end_name(m["b"])))
            there = common(pair, ends)
            return F.struct(F.lower(F.trim(m["l"])).alias("label"), F.when(there == F.size(pair), rules.BOTH_ENDS).when(there == 1, rules.ONE_END).otherwise(0.0).alias("points"))

        return F.transform(groups, scored)

    found = reduce(F.concat, [told(*r) for r in rules.POINT_RELATIONS])
    return F.when(F.size(ends) >= 2, found).otherwise(F.array().cast("array<struct<label:string,points:double>>"))


def role(candidate: Column, text: Column) -> Column:
    """Q7e: 12 for an acronym that is spelt out as a function, -12 for one spelt out as something else."""
    spelt = F.concat(F.lit(r"(?i)\b([A-Za-z][A-Za-z0-9/\-]*(?:\s+[A-Za-z][A-Za-z0-9/\-]*){1,10})\s*\(\s*"), literal(F.trim(candidate)), F.lit(r"\s*\)"))
    forms = F.transform(F.regexp_extract_all(text, spelt, F.lit(1)), lambda x: F.lower(F.trim(x)))

    def fold(best: Column, form: Column) -> Column:
        return F.when(form.contains("function"), F.greatest(best, F.lit(rules.ROLE))).when(contains_any(form, rules.NO_FUNCTION_FORMS), F.least(best, F.lit(-rules.ROLE))).otherwise(best)

    bracketed = F.regexp_like(text, F.concat(F.lit(r"(?i)\(\s*"), literal(F.trim(candidate)), F.lit(r"\s*\)")))  # quick: most are never spelt out
    return F.when(F.trim(candidate).rlike(rules.WHOLE_ACRONYM) & bracketed, F.aggregate(forms, F.lit(0.0), fold)).otherwise(F.lit(0.0))


def function_relation(candidate: Column, role_points: Column, near: Column, anchors: Column) -> Column:
    """Q7e: how strongly the windows (see `windows`) tie a candidate to the anchors: common words, a duty's phrase, nearness."""
    name = F.lower(F.trim(candidate))
    topics = F.array_join(F.transform(anchors, literal), "|")
    gap = f".{{0,{rules.NEAR_CHARS}}}"
    forward = F.concat(F.lit("(?is)"), literal(name), F.lit(f"{gap}(?:"), topics, F.lit(")"))
    reverse = F.concat(F.lit("(?is)(?:"), topics, F.lit(f"){gap}"), literal(name))
    least = F.least(F.size(anchors), F.lit(2))

    def scored(w: Column) -> Column:
        return w["overlap"] * rules.EACH_ANCHOR + points(contains_any(w["low"], rules.DUTIES), rules.DUTY) + points(F.regexp_like(w["text"], forward) | F.regexp_like(w["text"], reverse), rules.NEAR)

    best = F.array_max(F.transform(F.filter(near, lambda w: F.contains(w["low"], name) & (w["overlap"] >= least)), scored))
    return F.when(F.size(anchors) > 0, F.greatest(role_points, F.coalesce(best, role_points))).otherwise(role_points)


def scored_sentences(hits: DataFrame) -> DataFrame:
    """Q5 with the types' cues: (question, rank, seq, sentence, score, code, clause) of every sentence of the hits."""
    scored = F.transform(evidence.sentences(F.col("whole")), lambda s: F.struct(s.alias("sentence"), sentence_points(s).alias("points")))
    return sentence_rows(prepared(hits).withColumn("parts", F.transform(scored, lambda p, i: F.struct(p["points"].alias("points"), i.alias("at"), p["sentence"].alias("sentence")))))


def best_sentences(hits: DataFrame, most: int = 3) -> DataFrame:
    """Of `scored_sentences` each hit's `most` best different ones (spaces and case apart), among which are the `most` best of its question."""
    scored = F.transform(evidence.sentences(F.col("whole")), lambda s, i: F.struct((-F.round(sentence_points(s), 6)).alias("less"), i.alias("at"), s.alias("sentence")))
    ordered = F.array_sort(F.filter(scored, lambda p: p["less"] < 0))
    none = F.array().cast("array<struct<points:double,at:int,sentence:string>>")

    def take(got: Column, p: Column) -> Column:
        known = (F.size(got) >= most) | F.exists(got, lambda g: folded(g["sentence"]) == folded(p["sentence"]))
        return F.when(known, got).otherwise(F.concat(got, F.array(F.struct((-p["less"]).cast("double").alias("points"), p["at"].cast("int").alias("at"), p["sentence"].alias("sentence")))))

    return sentence_rows(prepared(hits).withColumn("parts", F.aggregate(ordered, none, take)))


def sentence_rows(hits: DataFrame) -> DataFrame:
    parts = hits.select("question", "rank", "code", "clause", F.posexplode_outer("parts").alias("__at", "p")).filter("p is not null")  # outer: a plain one would make the parts twice
    return parts.select("question", "rank", F.struct("rank", F.col("p.at").alias("at")).alias("seq"), F.col("p.sentence").alias("sentence"), F.round("p.points", 6).alias("score"), "code", "clause").filter("score > 0")


def prepared(hits: DataFrame) -> DataFrame:
    """The hits with what all their candidates share: the whole text, the question's words, ends and anchors."""
    title, body = F.trim(F.coalesce("clause_title", F.lit(""))), F.trim(F.coalesce("text", F.lit("")))
    out = hits.withColumns({"title": title, "whole": F.array_join(F.filter(F.array(title, body), lambda x: x != ""), "\n"), "q": F.coalesce("q", F.lit("")), "variants": F.coalesce("variants", empty())})
    out = out.withColumn("q_words", words(F.col("q")))
    return out.withColumns({"ends": question_ends(F.col("q")), "anchors": function_anchors(F.col("q_words"))})


def sentence_points(sentence: Column) -> Column:
    """Q5 of a sentence of a prepared hit."""
    return evidence.sentence_score(evidence.shared(F.col("q_words"), sentence), F.col("rank") - 1, evidence.cue(F.col("answer_type"), sentence))


def mentions(hits: DataFrame) -> DataFrame:
    """Q6, Q7, Q7a-Q7g: (question, candidate, seq, score, strong, answer_type) of each hit's candidates, for `evidence.folded_scores`.

    The score is what is left of 3 after half a point for each hit above (1 at least), 2 for standing in the title, the best sentence
    with the candidate, the alignment, the context, what its type adds, and the label's shape, less the echo of the question.
    """
    kind, c = F.col("answer_type"), F.col("candidate")
    rows = prepared(hits).withColumns({"relations": F.when(kind == POINT, point_relations(F.col("whole"), F.col("ends"))), "near": F.when(kind == FUNCTION, windows(F.col("whole"), F.col("anchors")))})
    rows = rows.withColumn("found", extracted(F.col("whole"), kind, F.col("anchors"), F.col("near")))
    lowered = F.transform(evidence.sentences(F.col("whole")), lambda s: F.struct(s.alias("sentence"), folded(s).alias("low")))
    rows = rows.withColumn("parts", F.when(F.size("found") > 0, lowered))
    each = rows.select("*", F.posexplode_outer("found").alias("at", "candidate")).filter("candidate is not null").withColumn("key", folded(c))
    each = each.withColumns({"context": local_context(F.col("whole"), c), "role": F.when(kind == FUNCTION, role(c, F.col("whole"))).otherwise(0.0), "echo": echo(c, F.col("q"), kind)})
    told = F.filter("relations", lambda r: r["label"] == F.lower(F.trim(c)))
    relation = F.when(kind == POINT, highest(F.transform(told, lambda r: r["points"]))).when(kind == FUNCTION, function_relation(c, F.col("role"), F.col("near"), F.col("anchors"))).otherwise(0.0)
    each = each.withColumn("relation", relation)
    in_title = (F.col("title") != "") & F.contains(folded(F.col("title")), F.col("key"))
    best = highest(F.transform(F.filter("parts", lambda p: F.contains(p["low"], F.col("key"))), lambda p: sentence_points(p["sentence"])))
    shape = reduce(lambda out, x: out + points((kind == x[0]) & F.trim(c).rlike(x[1][0]), x[1][1]), rules.SHAPES.items(), F.lit(0.0))
    typed = F.when(kind == PROCEDURE, procedure_points(c, F.col("variants"))).when(kind == MESSAGE, direction(c, F.col("q"))).otherwise(0.0)
    score = (
        F.greatest(F.lit(1.0), 3 - 0.5 * (F.col("rank") - 1)) + points(in_title, 2) + best + alignment(c, F.col("variants")) + context_points(F.col("q_words"), F.col("context")) + typed + F.col("relation") + shape - F.col("echo")
    )
    return each.select("question", "candidate", F.struct("rank", "at").alias("seq"), F.round(score, 6).alias("score"), strong(each, kind).alias("strong"), "answer_type")


def strong(each: DataFrame, kind: Column) -> Column:
    """Q7f: whether a candidate's evidence is strong by the rule of its type."""
    low = F.lower(F.col("context"))
    return (
        F.when(kind == POINT, (F.col("relation") >= rules.SURE_RELATION) | contains_any(low, ["reference point", "interface"]) & (F.col("echo") == 0))
        .when(kind == PROTOCOL, contains_any(low, ["protocol", "transport"]) & (F.col("echo") == 0))
        .when(kind == FUNCTION, (F.col("relation") >= rules.SURE_DUTY) | (F.col("role") > 0))
        .when(kind == VALUE, F.col("candidate").rlike(rules.CANDIDATE_PATTERNS[VALUE][0]))
        .otherwise(F.lit(True))
    )


# ---------------------------------------------------------------- documents as answers


def document_name(org: Column, code: Column) -> Column:
    """Q8f: how a source's document is named."""
    o, c = F.trim(F.coalesce(org, F.lit(""))), F.trim(F.coalesce(code, F.lit("")))
    return F.when((F.lower(o) == "ietf") & c.rlike(r"^\d+$"), F.concat(F.lit("RFC "), c.cast("decimal(38,0)").cast("string"))).otherwise(F.trim(F.concat_ws(" ", F.nullif(o, F.lit("")), c)))


def referenced_name(x: Column) -> Column:
    """Q8f: how a document that a text names is named."""
    clean = squeezed(x)
    rfc, spec = r"(?i)^RFC\s*(\d+)$", r"(?i)^(?:3GPP\s+)?(TS|TR)\s*(\d+(?:\.\d+)+)$"
    return F.when(clean.rlike(rfc), F.concat(F.lit("RFC "), F.regexp_extract(clean, rfc, 1).cast("decimal(38,0)").cast("string"))).when(
        clean.rlike(spec), F.concat(F.lit("3GPP "), F.upper(F.regexp_extract(clean, spec, 1)), F.lit(" "), F.regexp_extract(clean, spec, 2))
    ).otherwise(clean)


def asked_words(question_words: Column, text: Column) -> Column:
    """The question's words that a text has; the text's are only made where it contains one of them."""
    low = F.lower(text)
    return F.when(F.exists(question_words, lambda w: F.contains(low, w)), F.array_intersect(question_words, words(text))).otherwise(empty())


def subject(question_words: Column, without: list[str] = rules.NO_SUBJECT) -> Column:
    """The words of a question that say what a document is about."""
    return F.filter(question_words, lambda w: ~w.isin(without))


def directness(question_words: Column, text: Column, text_words: Column) -> Column:
    """How directly a text defines what is asked."""
    return bound(F.lower(F.regexp_replace(text, r"(?U)\s+", " ")), lambda low: direct_points(question_words, low, text_words))


def direct_points(question_words: Column, low: Column, text_words: Column) -> Column:
    about = subject(question_words, rules.NO_DIRECT_SUBJECT)
    shared = common(about, text_words)
    own = reduce(lambda out, r: out + points(contains_any(low, r[0]) & low.contains(r[1]), r[2]), rules.OWN_NUMBERS, F.lit(0.0))
    defined = F.filter(about, lambda t: F.regexp_like(low, F.concat(F.lit(rules.SELF_DEFINITION + r"\s+[^.]{0,35}\b"), F.replace(t, F.lit("/"), F.lit(r"[/\s]?")), F.lit(r"\b"))))
    return (
        F.least(common(question_words, text_words), F.lit(5)) * 0.8
        - points(low.rlike(rules.EXTENDS), 40)
        + own
        + F.size(defined) * 30.0
        + points(low.rlike(rules.SELF_DEFINITION) & (shared >= 1), 10)
        + points((shared >= 1) & low.rlike(rules.DEFINED_IN), 2)
    )


def document_alignment(variants: Column, text: Column) -> Column:
    """15 for a search text (after the question itself) that stands in the text, else 10 times its words' share from two on. The text's
    words are only made where it contains two words of a search text."""

    def one(v: Column, whole: Column, theirs: Column) -> Column:
        own = v["words"]
        both = common(own, theirs)
        return F.when(v["value"] == "", 0.0).when(F.contains(whole, v["value"]), CONTAINED).when((F.size(own) >= 2) & (both >= 2), both / F.size(own) * COVERED).otherwise(0.0)

    asked = F.transform(F.transform(F.slice(variants, 2, 1000), canonical), lambda v: F.struct(v.alias("value"), words(v).alias("words")))

    def best(t: Column) -> Column:
        whole = t["whole"]
        two = F.exists(t["asked"], lambda v: F.size(F.filter(v["words"], lambda w: F.contains(whole, w))) >= 2)
        scored = bound(F.struct(F.when(two, words(whole)).otherwise(empty()).alias("words")), lambda their: highest(F.transform(t["asked"], lambda v: one(v, whole, their["words"]))))
        return F.when(whole != "", scored).otherwise(F.lit(0.0))

    return bound(F.struct(canonical(text).alias("whole"), asked.alias("asked")), best)


def format_points(question: Column, candidate: Column) -> Column:
    """Q8e: whether the candidate is of the kind of document that is asked for."""
    q, c = F.lower(question), F.lower(F.trim(candidate))
    asks = q.contains("3gpp") & contains_any(q, ["standart", "standard"])
    return F.when(q.contains("rfc"), F.when(c.startswith("rfc "), 4.0).otherwise(-6.0)).when(asks, F.when(c.startswith("3gpp "), 3.0).otherwise(-3.0)).otherwise(0.0)


def around(text: Column, pattern: str, chars: int) -> Column:
    """struct(found, context) of each match of a pattern: its first group, and the match with up to `chars` characters on both sides."""
    found = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("whole"), F.regexp_extract_all(text, F.lit(pattern), F.lit(1)).alias("inner"), F.split(text, pattern, -1).alias("parts"))

    def length(x: Column) -> Column:
        return F.length(F.coalesce(x, F.lit("")))

    def all_of(m: Column) -> Column:
        def one(start: Column, i: Column) -> Column:
            first = F.greatest(start - chars, F.lit(1))
            return F.struct(F.get(m["inner"], i).alias("found"), F.substr(text, first, start + F.length(F.get(m["whole"], i)) + chars - first).alias("context"))

        # Where each match starts: behind the parts and matches before it.
        steps = F.transform(m["whole"], lambda w, i: length(F.get(m["parts"], i)) + F.when(i > 0, length(F.get(m["whole"], i - 1))).otherwise(0))
        starts = F.aggregate(steps, F.array().cast("array<int>"), lambda s, n: F.concat(s, F.array(n + F.coalesce(F.try_element_at(s, F.lit(-1)), F.lit(1)))))
        return F.when(F.size(m["whole"]) > 0, F.transform(starts, one)).otherwise(F.array().cast("array<struct<found:string,context:string>>"))

    return bound(found, all_of)


def referenced_documents(text: Column) -> Column:
    """The different documents that a text says something is defined in."""
    return F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(rules.DOCUMENT_RELATION), F.lit(1)), lambda x: F.upper(squeezed(x))))


def references_of(text: Column, title: Column, about: Column) -> Column:
    """struct(value, score, strong) of the documents that a text names: as place of a definition, by a title that has the subject's
    words, or near the subject's words."""

    def made(value: Column, score: Column, sure: Column) -> Column:
        return F.struct(value.alias("value"), score.cast("double").alias("score"), sure.alias("strong"))

    def titled(names: Column, base) -> Column:
        """names: struct(value, title, ...)"""
        rows = F.filter(names, lambda n: common(about, words(n["title"])) >= 2)
        return F.transform(rows, lambda n: made(n["value"], base(n) + F.least(common(about, words(n["title"])), F.lit(4)) * 2.0 + common(about, words(n["title"])) / F.greatest(F.size(about), F.lit(1)) * 6.0, F.lit(True)))

    def group(pattern: str, g: int) -> Column:
        return F.regexp_extract_all(text, F.lit(pattern), F.lit(g))

    relations = F.transform(group(rules.DOCUMENT_RELATION, 1), lambda x: made(referenced_name(x), F.lit(rules.RELATION_POINTS), F.lit(True)))
    rfcs = F.transform(F.arrays_zip(group(rules.RFC_TITLE, 1).alias("t"), group(rules.RFC_TITLE, 2).alias("n")), lambda m: F.struct(F.concat(F.lit("RFC "), m["n"].cast("decimal(38,0)").cast("string")).alias("value"), m["t"].alias("title")))
    specs = F.transform(
        F.arrays_zip(*[group(rules.SPEC_TITLE, g).alias(n) for g, n in ((1, "k"), (2, "n"), (3, "t"))]),
        lambda m: F.struct(F.concat(F.lit("3GPP "), F.upper(m["k"]), F.lit(" "), m["n"]).alias("value"), m["t"].alias("title"), m["n"].alias("number")),
    )
    core = lambda n: F.when(F.contains(F.lower(n["title"]), F.lit(rules.CORE_TITLE)) & F.contains(n["number"], F.lit(rules.CORE_NUMBER)), rules.CORE_TITLE_POINTS).otherwise(rules.TITLE_POINTS)
    near = F.transform(around(text, rules.DOCUMENT_IDENTIFIER, rules.IDENTIFIER_CHARS), lambda m: F.struct(m["found"].alias("found"), common(about, words(m["context"])).alias("n")))
    listed = F.lower(title).contains("reference")
    near = F.filter(near, lambda m: (m["n"] > 0) & ~text.rlike(rules.REFERENCE_SECTION) & ~(listed & (m["n"] < 2)))
    named = F.transform(near, lambda m: made(referenced_name(m["found"]), rules.IDENTIFIER_POINTS + F.least(m["n"], F.lit(4)) * 2.0, m["n"] >= 2))
    return F.concat(relations, titled(rfcs, lambda n: F.lit(rules.TITLE_POINTS)), titled(specs, core), named)


def document_candidates(hits: DataFrame) -> DataFrame:
    """Q8, Q8a-Q8f, T3: (question, candidate, score, occurrences, strong, seq, rank, answer_type) of the documents that answer a question for a document.

    The sources' own documents come first, folded in order of rank (each repeat adds half a point); documents that the texts name raise
    them or join them; each "defined in" of any hit adds to the candidates it names; the kind of document that is asked for is weighed last.
    """
    title, body = F.coalesce("clause_title", F.lit("")), F.coalesce("text", F.lit(""))
    rows = hits.withColumns({"title": title, "whole": F.concat_ws("\n", title, body), "q": F.coalesce("q", F.lit("")), "variants": F.coalesce("variants", empty())})
    rows = rows.withColumns({"q_words": words(F.col("q")), "cites": F.col("whole").rlike(rules.CITED)}).withColumns({"t_words": asked_words(F.col("q_words"), F.col("whole")), "about": subject(F.col("q_words"))})
    direct, aligned = directness(F.col("q_words"), F.col("whole"), F.col("t_words")), document_alignment(F.col("variants"), F.col("whole"))
    rows = rows.withColumns({"direct": direct, "aligned": aligned, "all_of_it": common(F.col("about"), F.col("t_words")) >= F.size("about")})
    score = 8.0 - F.least(F.col("rank") - 1, F.lit(3)) + F.col("direct") + F.col("aligned") + points(F.col("all_of_it"), 10)
    sure = (F.col("direct") >= 10) | (F.col("aligned") >= 8) | F.col("all_of_it")
    own = rows.filter(F.trim(F.coalesce("code", F.lit(""))) != "").select("question", document_name(F.col("org"), F.col("code")).alias("value"), F.struct(F.lit(0).alias("stage"), "rank", F.lit(0).alias("at")).alias("seq"), F.round(score, 6).alias("score"), sure.alias("strong"))
    named = rows.filter("cites").select("question", "rank", F.posexplode_outer(references_of(F.col("whole"), F.col("title"), F.col("about"))).alias("at", "r")).filter("r is not null")
    named = named.select("question", F.col("r.value").alias("value"), F.struct(F.lit(1).alias("stage"), "rank", "at").alias("seq"), F.round("r.score", 6).alias("score"), F.col("r.strong").alias("strong"))
    each = own.unionByName(named).withColumn("key", folded(F.col("value"))).filter("key <> ''")
    # A group has the mentions of one document in the few hits of one question.
    folded_up = each.groupBy("question", "key").agg(F.array_sort(F.collect_list(F.struct("seq", "value", "score", "strong"))).alias("m"))
    step = lambda acc, x: F.when(acc.isNull(), x["score"]).when(x["seq"]["stage"] == 0, F.greatest(acc, x["score"]) + rules.DOCUMENT_REPEATED).otherwise(F.greatest(acc, x["score"]))
    folded_up = folded_up.select(
        "question", "key", F.col("m")[0]["value"].alias("candidate"), F.col("m")[0]["seq"].alias("seq"), F.aggregate("m", F.lit(None).cast("double"), step).alias("score"), F.size("m").alias("occurrences"), F.exists("m", lambda x: x["strong"]).alias("strong")
    )
    relations = F.when(F.col("cites"), F.transform(F.regexp_extract_all("whole", F.lit(rules.DOCUMENT_RELATION), F.lit(1)), folded))
    asked = rows.groupBy("question").agg(F.flatten(F.collect_list(relations)).alias("relations"), F.first("q").alias("q"))
    both = folded_up.join(asked, "question")
    told = F.size(F.filter("relations", lambda r: F.contains(F.col("key"), r) | F.contains(F.replace(F.col("key"), F.lit("3gpp "), F.lit("")), r)))
    out = both.withColumn("told", told).select(
        "question", "candidate", F.round(F.col("score") + F.col("told") * rules.RELATION_BONUS + format_points(F.col("q"), F.col("candidate")), 4).alias("score"), "occurrences", (F.col("strong") | (F.col("told") > 0)).alias("strong"), "seq"
    )
    order = Window.partitionBy("question").orderBy(F.desc("score"), F.desc("occurrences"), "seq", "candidate")
    return out.withColumn("rank", F.row_number().over(order)).withColumn("answer_type", F.lit(DOCUMENT))


# ---------------------------------------------------------------- answers


def ranked(hits: DataFrame) -> DataFrame:
    """(question, candidate, score, occurrences, strong, rank, answer_type): all candidates of all questions, best first."""
    columns = ["question", "candidate", "score", "occurrences", "strong", "rank", "answer_type"]
    kinds = hits.groupBy("question").agg(F.first("answer_type").alias("answer_type"))
    others = evidence.folded_scores(mentions(hits.filter(F.col("answer_type") != DOCUMENT)), value="candidate").join(kinds, "question")
    return others.select(columns).unionByName(document_candidates(hits.filter(F.col("answer_type") == DOCUMENT)).select(columns))


def answered(hits: DataFrame, all_of_them: DataFrame) -> DataFrame:
    """The answers of `ranked` candidates: per question answer_type, primary_answer, confidence, margin."""
    kinds = hits.groupBy("question").agg(F.first("answer_type").alias("answer_type"))
    out = kinds.join(evidence.confidence(all_of_them), "question", "left")
    return out.select("question", "answer_type", F.coalesce("primary_answer", F.lit("")).alias("primary_answer"), F.coalesce("confidence", F.lit("low")).alias("confidence"), "margin")


def answers(hits: DataFrame) -> DataFrame:
    """Q6-Q9: `composed` without its candidates and facts, for uses that give out neither: an outer join is made even where none of its columns is read."""
    return answered(hits, ranked(hits))


def composed(hits: DataFrame) -> DataFrame:
    """Per question answer_type, primary_answer, confidence, margin, its five best candidates and three best facts."""
    all_of_them = ranked(hits)
    best = all_of_them.filter(F.col("rank") <= rules.MOST_CANDIDATES).groupBy("question").agg(F.array_sort(F.collect_list(F.struct("rank", "candidate", "score", "occurrences"))).alias("candidates"))
    facts = evidence.supporting_facts(best_sentences(hits)).groupBy("question").agg(F.array_sort(F.collect_list(F.struct("rank", "sentence", "score", "code", "clause"))).alias("facts"))
    out = answered(hits, all_of_them).join(best, "question", "left").join(facts, "question", "left")
    return out.select("question", "answer_type", "primary_answer", "confidence", "margin", "candidates", "facts")


def guidance(composed_rows: DataFrame) -> DataFrame:
    """Q15: (question, guidance): the composed answer as lines for a prompt: type, confidence, answer, and the facts with their places."""
    answer = F.when(F.col("primary_answer") != "", F.col("primary_answer")).otherwise(rules.GUIDANCE_NO_ANSWER)
    facts = F.transform(F.coalesce("facts", F.array().cast("array<struct<rank:int,sentence:string,score:double,code:string,clause:string>>")), lambda f: F.format_string(rules.GUIDANCE_FACT, f["code"], f["clause"], f["sentence"]))
    head = F.format_string(rules.GUIDANCE, "answer_type", "confidence", answer)
    return composed_rows.select("question", F.when(F.size(facts) > 0, F.concat_ws("\n", head, F.lit(rules.GUIDANCE_FACTS), F.array_join(facts, "\n"))).otherwise(head).alias("guidance"))
