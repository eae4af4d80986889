"""Evidence: sentences, scores, supporting facts, checks of answers, evaluation."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sourcegrove.functions import rules
from sourcegrove.functions.text import contains_any, folded

#: Questions that are searched in one pass over the sentences.
QUESTION_BLOCK = 256


def words(text: Column) -> Column:
    """Q3: distinct lowered words, and of words with slashes the parts and pairs, without stop words."""
    t = F.coalesce(text, F.lit(""))
    slashed = F.concat(*[F.regexp_extract_all(t, F.lit(rules.SLASHED), F.lit(g)) for g in (1, 2, 0)])
    slashed = F.when(F.contains(t, F.lit("/")), slashed).otherwise(F.array().cast("array<string>"))
    found = F.array_distinct(F.concat(F.regexp_extract_all(t, F.lit(f"({rules.WORD})"), F.lit(1)), slashed))
    return F.array_distinct(F.filter(F.transform(found, lambda w: F.lower(w)), lambda w: ~w.isin(rules.STOP_WORDS)))


def shared(asked: Column, text: Column) -> Column:
    """How many of the asked words (lowered, as `words` gives them) a text has; its words are only made where it contains one of them."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.when(F.exists(asked, lambda w: F.contains(low, w)), F.size(F.array_intersect(asked, words(text)))).otherwise(0)


def sentences(text: Column) -> Column:
    """Q4: trimmed sentences, cut behind . ! ? before white space, and at line breaks."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"(?<=[.!?])\s+|\n+"), lambda s: F.trim(s)), lambda s: s != "")


def overlap(a: Column, b: Column) -> Column:
    """Common items of two word sets."""
    return F.size(F.array_intersect(a, b))


def sentence_score(common: Column, index: Column, cue: Column) -> Column:
    """Q5: 1.5 for each common word up to six, what is left of 2.5 after half a point for each source above, and the type's cue."""
    return 1.5 * F.least(common, F.lit(6)) + F.greatest(F.lit(0.0), 2.5 - 0.5 * index) + cue


def cue(kind: Column, sentence: Column) -> Column:
    """Q5: the points of a sentence that speaks of what the question's type asks for."""
    low, value = F.lower(sentence), "DEĞER / LİMİT"
    out = F.when(kind == value, F.when(sentence.rlike(rules.CANDIDATE_PATTERNS[value][0]), rules.VALUE_CUE).otherwise(0.0))
    for name, (parts, n) in rules.SENTENCE_CUES.items():
        out = out.when(kind == name, F.when(contains_any(low, parts), n).otherwise(0.0))
    return out.otherwise(0.0)


def supporting_facts(scored: DataFrame, question: str = "question", sentence: str = "sentence", score: str = "score", seq: str = "seq", most: int = 3) -> DataFrame:
    """Per question the `most` best different sentences (spaces and case apart), each with its best score."""
    key = F.sha2(folded(F.col(sentence)), 256)
    best = scored.withColumn("__k", key).withColumn("__n", F.row_number().over(Window.partitionBy(question, "__k").orderBy(F.desc(score), seq))).filter("__n = 1")
    out = best.withColumn("rank", F.row_number().over(Window.partitionBy(question).orderBy(F.desc(score), seq))).filter(F.col("rank") <= most)
    return out.drop("__k", "__n")


def question_blocks(questions: DataFrame, question: str, words: str) -> list[tuple[np.ndarray, Callable[[pa.Array], np.ndarray]]]:
    """Of each block of questions its ids and a function from word lists to the (questions, lists) matrix of common words."""
    got = questions.select(F.col(question).cast("long").alias("q"), F.coalesce(F.col(words), F.array().cast("array<string>")).alias("w")).orderBy("q").collect()
    blocks = []
    for a in range(0, len(got), QUESTION_BLOCK):
        block = got[a : a + QUESTION_BLOCK]
        pairs = sorted({(w, i) for i, r in enumerate(block) for w in r.w})
        vocabulary = sorted({w for w, _ in pairs})
        starts = np.searchsorted(np.array([w for w, _ in pairs], object), np.array([*vocabulary], object)) if pairs else np.zeros(0, np.int64)
        starts = np.append(starts, len(pairs)).astype(np.int64)
        holders = np.array([i for _, i in pairs], np.int64)

        def common(lists: pa.Array, size=len(block), vocabulary=vocabulary, starts=starts, holders=holders) -> np.ndarray:
            n = len(lists)
            word = pc.fill_null(pc.index_in(lists.flatten(), value_set=pa.array(vocabulary, pa.string())), -1).to_numpy()
            row = pc.list_parent_indices(lists).to_numpy()
            row, word = row[word >= 0], word[word >= 0]
            count = starts[word + 1] - starts[word]
            inside = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            held = holders[np.repeat(starts[word], count) + inside]
            return np.bincount(held * n + np.repeat(row, count), minlength=size * n).reshape(size, n)

        blocks.append((np.array([r.q for r in block], np.int64), common))
    return blocks


def joined(frames: list[DataFrame], rows: DataFrame, schema: str) -> DataFrame:
    out = frames[0] if frames else rows.sparkSession.createDataFrame([], schema)
    for f in frames[1:]:
        out = out.union(f)
    return out


def best_sentences(sentences: DataFrame, questions: DataFrame, most: int = 3) -> DataFrame:
    """(question, doc_id, seq, sentence, common): of every batch of sentences each question's `most` best different ones, for supporting_facts.

    sentences (doc_id, seq, sentence, words) are all searched for all questions (question, words), which go to the executors in blocks.
    A sentence among the `most` best of all is among those of its batch, so nothing is lost. common is cut at six, where the score ends.
    A null question text counts as no words.
    """
    rows = sentences.select(F.col("doc_id").cast("long"), F.col("seq").cast("int"), "sentence", F.sha2(folded(F.col("sentence")), 256).alias("k"), "words")
    schema = "question long, doc_id long, seq int, sentence string, common int"

    def searched(ids: np.ndarray, common: Callable) -> Callable:
        def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                order = np.lexsort((batch.column(1).to_numpy(), batch.column(0).to_numpy()))
                key = pc.dictionary_encode(batch.column(3)).indices.to_numpy()[order]
                first = np.sort(np.unique(key, return_index=True)[1])  # equal sentences have equal words: the earliest stands for them
                kept = batch.take(pa.array(order[first]))
                score = np.minimum(common(kept.column(4)), 6).astype(np.int8)
                at = np.argsort(-score, axis=1, kind="stable")[:, :most]
                out = kept.take(pa.array(at.ravel()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(ids, at.shape[1])), out.column(0), out.column(1), out.column(2), pa.array(np.take_along_axis(score, at, 1).ravel(), pa.int32())],
                    ["question", "doc_id", "seq", "sentence", "common"],
                )

        return best

    return joined([rows.mapInArrow(searched(*b), schema) for b in question_blocks(questions, "question", "words")], rows, schema)


def document_scores(sentences: DataFrame, questions: DataFrame) -> DataFrame:
    """(question, doc_id, n, common, best) of all documents that have sentences, for all questions: sentences, common words, best score (Q5)."""
    rows = sentences.select(F.col("doc_id").cast("long"), "words")
    schema = "question long, doc_id long, n long, common long, most long"

    def searched(ids: np.ndarray, common: Callable) -> Callable:
        def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                order = np.argsort(batch.column(0).to_numpy(), kind="stable")
                docs, starts, n = np.unique(batch.column(0).to_numpy()[order], return_index=True, return_counts=True)
                count = common(batch.column(1))[:, order]
                total, most = np.add.reduceat(count, starts, axis=1), np.maximum.reduceat(count, starts, axis=1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x.astype(np.int64)) for x in (np.repeat(ids, len(docs)), np.tile(docs, len(ids)), np.tile(n, len(ids)), total.ravel(), most.ravel())],
                    ["question", "doc_id", "n", "common", "most"],
                )

        return summed

    parts = joined([rows.mapInArrow(searched(*b), schema) for b in question_blocks(questions, "question", "words")], rows, schema)
    out = parts.groupBy("question", "doc_id").agg(F.sum("n").alias("n"), F.sum("common").alias("common"), F.max("most").alias("most"))
    return out.select("question", "doc_id", "n", "common", F.round(sentence_score(F.col("most"), F.lit(0), F.lit(0.0)), 6).alias("best"))


def folded_scores(candidates: DataFrame, question: str = "question", value: str = "candidate", seq: str = "seq", score: str = "score", strong: str = "strong", again: float = rules.REPEATED) -> DataFrame:
    """Candidates (spaces and case apart) folded in order of seq: the first score, then each time the larger of old and new plus
    `again`; strong if any is; named as at the first place.

    The fold depends on order, so it runs over the candidate's own sorted list of mentions in the question's sources.
    """
    listed = candidates.groupBy(question, folded(F.col(value)).alias("__k")).agg(F.array_sort(F.collect_list(F.struct(seq, score, strong, value))).alias("m"))
    zero = F.lit(None).cast("double")
    total = F.aggregate("m", zero, lambda acc, x: F.when(acc.isNull(), x[score].cast("double")).otherwise(F.greatest(acc, x[score]) + again))
    out = listed.select(question, F.col("m")[0][value].alias(value), F.round(total, 4).alias("score"), F.size("m").alias("occurrences"), F.exists("m", lambda x: x[strong]).alias("strong"), F.col("m")[0][seq].alias("seq"))
    order = Window.partitionBy(question).orderBy(F.desc("score"), F.desc("occurrences"), "seq", value)
    return out.withColumn("rank", F.row_number().over(order))


def confidence(ranked: DataFrame, question: str = "question", kind: str = "answer_type") -> DataFrame:
    """Per question primary_answer, confidence and margin of ranked candidates (rank, candidate, score, occurrences, strong, kind).

    High: 7 or more and ahead by 1 (documents that tie: by two more occurrences); medium: 4 or more. Types at risk need strong evidence
    for either. Low: no answer.
    """
    first, second = (F.max(F.when(F.col("rank") == n, F.struct("score", "strong", "candidate", "occurrences", kind))) for n in (1, 2))
    got = ranked.groupBy(question).agg(first.alias("t"), second.alias("s"))
    margin = F.col("t.score") - F.coalesce("s.score", F.lit(0.0))
    tie = (F.col(f"t.{kind}") == "STANDART / DOKÜMAN") & (F.abs(margin) < rules.TIE) & (F.col("t.occurrences") >= F.coalesce("s.occurrences", F.lit(0)) + rules.TIE_OCCURRENCES)
    sure = ~F.col(f"t.{kind}").isin(rules.RISKY_TYPES) | F.col("t.strong")
    level = F.when((F.col("t.score") >= rules.SURE_SCORE) & ((margin >= rules.SURE_MARGIN) | tie) & sure, "high").when((F.col("t.score") >= rules.MEDIUM_SCORE) & sure, "medium").otherwise("low")
    return got.select(question, F.when(level == "low", "").otherwise(F.col("t.candidate")).alias("primary_answer"), level.alias("confidence"), F.round(margin, 4).alias("margin"))


def evaluated(cases: DataFrame) -> DataFrame:
    """Per case source_ok, facts_ok, forbidden_ok, abstain_ok and passed.

    cases: id, reply, sources array<struct<code, clause>>, expected_document, expected_clause, required_fact_groups and
    forbidden_claim_groups array<array<string>>, should_abstain.
    """
    reply = folded(F.col("reply"))

    def any_in(group: Column) -> Column:
        return F.exists(group, lambda p: F.contains(reply, folded(p)))

    source = F.exists("sources", lambda s: s["code"].eqNullSafe(F.col("expected_document")) & (F.col("expected_clause").isNull() | s["clause"].eqNullSafe(F.col("expected_clause"))))
    abstained = (F.size("sources") == 0) & F.contains(reply, F.lit("bulunamad"))
    out = cases.select(
        "id",
        (F.col("expected_document").isNull() | F.coalesce(source, F.lit(False))).alias("source_ok"),
        F.forall(F.coalesce("required_fact_groups", F.array().cast("array<array<string>>")), any_in).alias("facts_ok"),
        (~F.exists(F.coalesce("forbidden_claim_groups", F.array().cast("array<array<string>>")), any_in)).alias("forbidden_ok"),
        (F.when(F.col("should_abstain"), abstained).otherwise(True)).alias("abstain_ok"),
    )
    return out.withColumn("passed", F.col("source_ok") & F.col("facts_ok") & F.col("forbidden_ok") & F.col("abstain_ok"))


def case_faults(cases: DataFrame) -> DataFrame:
    """Q17: (id, faults) of evaluation cases: what is missing, blank, or an empty group of phrases; no faults for a sound case. Ids must differ."""
    groups = {c: F.col(c) for c in ("required_fact_groups", "forbidden_claim_groups")}
    tests = {f"{c} is blank": F.coalesce(F.trim(c), F.lit("")) == "" for c in ("id", "category", "question")}
    tests |= {f"{c} is missing": x.isNull() for c, x in groups.items()}
    tests |= {f"{c} has an empty group": F.exists(x, lambda g: g.isNull() | (F.size(g) == 0)) for c, x in groups.items()}
    tests |= {f"{c} has a blank phrase": F.exists(x, lambda g: F.exists(g, lambda p: F.coalesce(F.trim(p), F.lit("")) == "")) for c, x in groups.items()}
    tests |= {"should_abstain is missing": F.col("should_abstain").isNull(), "id repeats": F.count(F.lit(1)).over(Window.partitionBy("id")) > 1}
    found = F.array(*[F.when(F.coalesce(test, F.lit(False)), F.lit(name)) for name, test in tests.items()])
    return cases.select("id", found.alias("f")).select("id", F.array_compact("f").alias("faults"))


def categories(cases: DataFrame) -> DataFrame:
    """The different categories, sorted, in one row."""
    return cases.agg(F.array_sort(F.collect_set("category")).alias("categories"))


def pass_rate(results: DataFrame) -> DataFrame:
    """A9."""
    return results.agg(F.count(F.lit(1)).alias("n_cases"), F.count_if("passed").alias("n_passed"), F.coalesce(F.round(F.avg(F.col("passed").cast("double")), 6), F.lit(0.0)).alias("rate"))


def context_blocks(hits: DataFrame, question: str = "question", most: int = 3) -> DataFrame:
    """Q11: the prompt's source blocks, numbered, joined by a blank line."""
    head = F.format_string("[KAYNAK %d: %s %s | Madde %s | %s]", "rank", "org", "code", "clause", "clause_title")
    block = F.concat(head, F.lit("\n"), "text")
    listed = hits.filter(F.col("rank") <= most).groupBy(question).agg(F.array_sort(F.collect_list(F.struct("rank", block.alias("b")))).alias("m"))
    return listed.select(question, F.array_join(F.col("m.b"), "\n\n").alias("context"))
