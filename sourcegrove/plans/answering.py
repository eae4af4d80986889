"""Questions to evidence in one batch (entry A): variants, embedding, vector search, fusion, cleaning, reranking, prompt context.

Embedder and scorer are slots: functions on Arrow columns. The defaults need no model and are deterministic: hashed words, and the
F1 of common words.
"""

from __future__ import annotations

import re
import time
import zlib
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sourcegrove.functions import rules, tables
from sourcegrove.functions.text import blank, folded
from sourcegrove.operators import evidence, gates, guard, lexical, questions, results, vector

Embedder = Callable[[list[str]], np.ndarray]
Scorer = Callable[[list[str], list[str]], list[float]]
#: Characters of a text that a scorer sees, and the score of a lone candidate, which needs no scorer.
RERANK_CHARS, LONE_SCORE = 2600, 1.0
_WORD = re.compile(r"\w+")


def hashed_words(texts: list[str], dims: int = 64) -> np.ndarray:
    """Unit vectors of signed word hashes."""
    out = np.zeros((len(texts), dims), np.float32)
    for i, t in enumerate(texts):
        for w in _WORD.findall(t.lower()):
            h = zlib.crc32(w.encode())
            out[i, h % dims] += 1 if h & 0x10000 else -1
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def common_words(queries: list[str], texts: list[str]) -> list[float]:
    """Ten times the F1 of two word sets."""
    out = []
    for q, t in zip(queries, texts, strict=True):
        a, b = set(_WORD.findall(q.lower())), set(_WORD.findall(t.lower()))
        out.append(20 * len(a & b) / (len(a) + len(b)) if a or b else 0.0)
    return out


def embedded(df: DataFrame, text: str, prefix: str, embedder: Embedder = hashed_words, batch: int = 256) -> DataFrame:
    """V1, V3: df with embedding; blank texts are left out. The embedder gets `batch` prefixed texts at a time; a text's vector must not depend
    on the others of its batch, and a result of another size than its texts is an error."""
    rows = df.filter(~blank(F.col(text)))
    at, names = rows.columns.index(text), rows.columns

    def embed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [prefix + t.strip() for t in b.column(at).to_pylist()]
            vectors = [v for i in range(0, len(texts), batch) for v in embedder(texts[i : i + batch])]
            if len(vectors) != len(texts):
                raise ValueError(f"the embedder gave {len(vectors)} vectors for {len(texts)} texts")
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([v.tolist() for v in vectors], pa.list_(pa.float32()))], [*names, "embedding"])

    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema.fields)
    return rows.mapInArrow(embed, f"{schema}embedding array<float>")


def query_vector(question: str, embedder: Embedder = hashed_words) -> list[float]:
    """V2: the vector of one question; a blank one is an error."""
    return query_vectors([question], embedder)[0]


def query_vectors(questions_: list[str], embedder: Embedder = hashed_words) -> list[list[float]]:
    """V3: the vectors of a question's search texts in one batch; blank ones are left out, and none at all is an error."""
    texts = [f"query: {q.strip()}" for q in questions_ if q and q.strip()]
    if not texts:
        raise ValueError("there is no question to embed")
    return [[float(x) for x in v] for v in embedder(texts)]


def reranked(hits: DataFrame, scorer: Scorer = common_words, top_k: int | None = None) -> DataFrame:
    """Hits (question, chunk_id, text, variants) with the best score over the variants; a question's lone hit is not scored."""
    each = hits.select("question", "chunk_id", F.posexplode("variants").alias("variant", "query"), F.substring("text", 1, RERANK_CHARS).alias("text"))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = scorer(b.column("query").to_pylist(), b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("question"), b.column("chunk_id"), b.column("variant"), pa.array(s, pa.float64())], ["question", "chunk_id", "variant", "score"])

    counts = hits.groupBy("question").agg(F.count(F.lit(1)).alias("__n"))
    many = each.join(counts.filter("__n > 1"), "question", "left_semi")
    kinds = {f.name: f.dataType.simpleString() for f in each.schema.fields}
    scores = many.mapInArrow(scored, f"question {kinds['question']}, chunk_id {kinds['chunk_id']}, variant int, score double")
    best = vector.best_variant(scores, top_k=top_k)
    alone = hits.join(counts.filter("__n = 1"), "question", "left_semi").select(
        "question", "chunk_id", F.lit(LONE_SCORE).alias("rerank_score"), F.lit(0).alias("rerank_variant"), F.lit(1).cast("long").alias("rerank_variant_count"), F.lit(1).alias("position")
    )
    return best.union(alone)


def retrieve(asked: DataFrame, chunks: DataFrame, threshold: float = rules.DISTANCE_THRESHOLD, embedder: Embedder = hashed_words) -> DataFrame:
    """Cleaned hits of each question with the chunk's columns, fused rank and the question's variants.

    asked (question, text); chunks (chunk_id long, text, org, code, version, clause, clause_title, status, source_url, embedding).
    """
    known = asked.select("question", questions.query_variants(F.col("text")).alias("variants"), questions.document_constraint(F.col("text")).alias("document"), questions.answer_type(F.col("text")).alias("answer_type")).filter("variants is not null")
    each = known.select("question", F.posexplode("variants").alias("no", "query")).withColumn("variant", F.col("question").cast("long") * rules.MAX_VARIANTS + F.col("no"))
    found = vector.near_enough(vector.knn(embedded(each, "query", "query: ", embedder), chunks), threshold)
    found = found.withColumn("question", F.floor(F.col("variant") / rules.MAX_VARIANTS).cast("long"))
    fused = vector.select_covering(found).drop("variant_ranks")
    hits = fused.join(chunks.drop("embedding"), "chunk_id").join(known.withColumn("question", F.col("question").cast("long")), "question")
    hits = results.available(hits).filter(results.matches_document(F.col("org"), F.col("code"), F.col("document")))
    key = results.dedup_key(*[F.col(c) for c in ("source_url", "org", "code", "clause", "text")])
    hits = results.first_of_key(hits, key, "position", within=("question",))
    return results.prefer_content(hits, document_question=F.col("answer_type") == "STANDART / DOKÜMAN")


def prompts(asked: DataFrame, chunks: DataFrame, threshold: float = rules.DISTANCE_THRESHOLD, embedder: Embedder = hashed_words, scorer: Scorer = common_words) -> DataFrame:
    """Per question: its type, the prompt's context, its sources, and whether there is evidence; questions without evidence stay, with nulls."""
    hits = retrieve(asked, chunks, threshold, embedder)
    ranked = reranked(hits, scorer).select("question", "chunk_id", "rerank_score", F.col("position").alias("rank"))
    chosen = vector.strong_margin(hits.join(ranked.drop("rank"), ["question", "chunk_id"])).withColumnRenamed("rn", "rank")
    context = evidence.context_blocks(chosen)
    sources = chosen.groupBy("question").agg(F.array_sort(F.collect_list(F.struct("rank", "code", "clause", "clause_title", "source_url"))).alias("sources"))
    types = asked.select(F.col("question").cast("long").alias("question"), questions.answer_type(F.col("text")).alias("answer_type"))
    return types.join(context, "question", "left").join(sources, "question", "left").select("question", "answer_type", "context", "sources", F.col("context").isNotNull().alias("has_evidence"))


def answer_sources(answers: DataFrame, hits: DataFrame, chunks: DataFrame, scorer: Scorer = common_words, most: int = 4, pool: int = 40) -> DataFrame:
    """J12, T5, Q8g: the sources of answers that are documents: (question, position, route, chunk_id, org, code, clause, clause_title, text).

    answers (question, q, answer); hits (question, rank, chunk_id, org, code, clause, clause_title, text, source_url); chunks of the store with
    the same columns and status. First choice are the answer's own document's chunks in the store (`pool` of them, by id), those that
    introduce it if there are any, the best `most` by the reranker, in order of how well they introduce it; then hits of the document;
    then hits that name it; then the first hits.
    """
    named = answers.select(F.col("question").cast("long").alias("question"), "q", F.trim("answer").alias("answer"), gates.document_identity(F.col("answer")).alias("d"))
    key = results.dedup_key(*[F.col(c) for c in ("source_url", "org", "code", "clause", "text")])
    store = results.available(chunks).filter(F.trim("text") != "").select("chunk_id", F.upper("org").alias("o"), "org", "code", "clause", "clause_title", "text", "source_url")
    # What is the same for all questions with a document is done once for the document; the reranker sees each different question once.
    document = ["o", "code"]
    about = named.filter("d is not null").select("question", F.struct("q", F.col("d.org").alias("o"), F.col("d.code").alias("code")).alias("ask"))
    asks = tables.written(about.select("ask").distinct(), "asks")
    store = store.join(asks.select("ask.o", "ask.code").distinct(), document, "left_semi")
    of = Window.partitionBy(*document)
    first = store.select(*document, "chunk_id").withColumn("n", F.row_number().over(of.orderBy("chunk_id"))).filter(F.col("n") <= pool).drop("n")  # without texts
    own = store.join(first, [*document, "chunk_id"], "left_semi").withColumn("n", F.row_number().over(of.orderBy("chunk_id"))).filter(F.col("n") <= pool).drop("n")
    own = results.first_of_key(own, key, "chunk_id", within=tuple(document)).withColumn("quality", gates.source_quality(F.col("clause_title"), F.col("text")))
    own = tables.written(own.withColumn("best", F.max("quality").over(of)).filter("quality > 0 or best <= 0").drop("best"), "own-sources")
    pairs = asks.select("ask", "ask.q", "ask.o", "ask.code").join(own, document)
    order = reranked(pairs.select(F.col("ask").alias("question"), "chunk_id", "text", F.array("q").alias("variants")), scorer, top_k=most).select(F.col("question").alias("ask"), "chunk_id", F.col("position").alias("n"))
    placed = pairs.join(order, ["ask", "chunk_id"]).withColumn("position", F.row_number().over(Window.partitionBy("ask").orderBy(F.desc("quality"), "n")))
    hydrated = about.join(placed, "ask").withColumn("route", F.lit(0))

    # All windows are within a question, so its hits move once.
    per = Window.partitionBy("question")
    each = hits.select(F.col("question").cast("long").alias("question"), "rank", "chunk_id", "org", "code", "clause", "clause_title", "text", "source_url").join(named, "question")
    same = (folded(F.col("org")) == folded(F.col("d.org"))) & (folded(F.col("code")) == folded(F.col("d.code")))
    low = F.lower(F.coalesce("text", F.lit("")))
    short = F.regexp_replace(F.lower("answer"), r"^rfc\s+", "rfc")
    said = (F.col("answer") != "") & (F.contains(low, F.lower("answer")) | F.contains(low, short))
    each = each.withColumns({"same": F.coalesce(same, F.lit(False)), "said": F.coalesce(said, F.lit(False)), "key": F.sha2(key, 256)})
    each = each.withColumn("once", F.row_number().over(Window.partitionBy("question", "same", "key").orderBy("rank")) == 1)
    each = each.withColumn("route", F.when(F.max("same").over(per), 1).when(F.max("said").over(per), 2).otherwise(3))
    routes = each.filter(F.when(F.col("route") == 1, F.col("same") & F.col("once")).when(F.col("route") == 2, F.col("said")).otherwise(True))
    routes = routes.withColumn("position", F.row_number().over(per.orderBy("rank"))).filter(F.col("position") <= most)
    columns = ["question", "position", "route", "chunk_id", "org", "code", "clause", "clause_title", "text"]
    both = hydrated.select(columns).unionByName(routes.select(columns))
    return both.withColumn("low", F.min("route").over(per)).filter("route = low").drop("low")


def second_search(asked: DataFrame, chunks: DataFrame, scorer: Scorer = common_words, most: int = 4) -> DataFrame:
    """(question, route, position, chunk_id, rerank_score) of the second, lexical search for each question.

    asked (question, text); chunks (chunk_id, text, org, code, clause, clause_title, status, source_url). Questions for a reference point use
    the first of their queries that has hits (route 0); questions for a document all their queries, in order, without reranking
    (route 1, up to 20 hits); others their intent's phrases or their search texts (route 2). Low-value clauses, other documents than the one
    named, and repeats go before the reranker.
    """
    kind = questions.answer_type(F.col("text"))
    variants = questions.query_variants(F.col("text"))
    known = asked.select(F.col("question").cast("long").alias("question"), "text", kind.alias("kind"), variants.alias("variants"), gates.precision_phrases(F.col("text")).alias("precise"), lexical.reference_point_queries(F.col("text")).alias("points"), questions.document_constraint(F.col("text")).alias("document"))
    known = known.filter("variants is not null").withColumn("others", F.slice("variants", 2, 1000))
    searching = F.concat("precise", F.when(F.size("others") > 0, F.col("others")).otherwise(F.col("variants")))
    about_point = gates.is_reference_point_question(F.col("text")) & F.col("points").isNotNull()
    general = lexical.general_queries(F.when(F.size("precise") > 0, F.col("precise")).otherwise(F.col("others")))
    rest = F.when(F.col("kind") == gates.DOCUMENT, lexical.document_queries(searching)).otherwise(general)
    known = tables.written(known.withColumns({"point": about_point, "rest": rest}), "second-search")
    doc = F.col("kind") == gates.DOCUMENT
    texts = chunks.select("chunk_id", "text")

    def hits_of(rows: DataFrame, queries: str, limit: int) -> DataFrame:
        found = lexical.searched(texts, rows.select("question", F.col(queries).alias("queries")), limit, "chunk_id")
        return found.join(chunks, "chunk_id").join(known.select("question", "document", "variants", "kind", F.col("text").alias("q")), "question").filter(results.matches_document(F.col("org"), F.col("code"), F.col("document")))

    key = results.dedup_key(*[F.col(c) for c in ("source_url", "org", "code", "clause", "text")])

    def cleaned(rows: DataFrame) -> DataFrame:
        rows = results.first_of_key(rows, key, "query_no", "rank", within=("question",))
        return results.prefer_content(rows, document_question=F.col("kind") == gates.DOCUMENT)

    points = cleaned(lexical.first_with_hits(hits_of(known.filter("point"), "points", rules.FALLBACK_HITS)))
    points = tables.written(points.select("question", "chunk_id", "query_no", "rank", "text", "variants"), "point-hits")
    left = known.join(points.select("question").distinct(), "question", "left_anti")
    listed = lexical.searched(texts, left.filter(doc).select("question", F.col("rest").alias("queries")), rules.DOCUMENT_HITS, "chunk_id")
    listed = listed.withColumn("position", F.row_number().over(Window.partitionBy("question").orderBy("query_no", "rank"))).filter(F.col("position") <= rules.FALLBACK_MOST)
    others = cleaned(hits_of(left.filter(~doc), "rest", rules.FALLBACK_HITS)).select("question", "chunk_id", "query_no", "rank", "text", "variants")

    def scored(rows: DataFrame, route: int) -> DataFrame:
        return reranked(rows, scorer, top_k=most).select("question", F.lit(route).alias("route"), "position", "chunk_id", "rerank_score")

    return scored(points, 0).unionByName(scored(others, 2)).unionByName(listed.select("question", F.lit(1).alias("route"), "position", "chunk_id", F.lit(None).cast("double").alias("rerank_score")))


def combined(second: DataFrame, first: DataFrame, most: int = rules.FALLBACK_MOST) -> DataFrame:
    """The hits of the second search, then those of the first (both: question, position, chunk_id and the columns of `dedup_key`), without
    repeats, up to `most` a question."""
    both = second.withColumn("side", F.lit(0)).unionByName(first.withColumn("side", F.lit(1)), allowMissingColumns=True)
    key = results.dedup_key(*[F.col(c) for c in ("source_url", "org", "code", "clause", "text")])
    once = results.first_of_key(both, key, "side", "position", within=("question",))
    return once.withColumn("position", F.row_number().over(Window.partitionBy("question").orderBy("side", "position"))).filter(F.col("position") <= most)


def replied(asked: DataFrame, generator: Callable[[list[str]], list[str]], question: str = "question", text: str = "text", context: str = "context") -> DataFrame:
    """Q12-Q14: (question, reply, source) of rows with a prompt's context: the generator's reply if it holds, else its repaired one, else the
    fallback sentence. generator: a slot, from prompts to replies; it is called twice at most for a row."""

    def generated(df: DataFrame, prompt: str, out: str) -> DataFrame:
        names, at = df.columns, df.columns.index(prompt)

        def call(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(generator(b.column(at).to_pylist()), pa.string())], [*names, out])

        return df.mapInArrow(call, "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.schema.fields) + f"`{out}` string")

    rows = asked.select(question, text, context, F.concat_ws("\n\n", F.col(text), F.col(context)).alias("prompt"))
    first = generated(rows, "prompt", "r").withColumn("reply", guard.without_expansions(F.col("r")))
    first = tables.written(first.withColumn("v", guard.validated(F.col(text), F.col("reply"), F.col(context))).drop("prompt", "r"), "replies")
    bad = first.filter(~F.col("v.valid")).withColumn("prompt", guard.repair_prompt(F.col(text), F.col("reply"), F.col(context), F.col("v")))
    again = generated(bad.select(question, text, context, "prompt", F.col("v.evidence_terms").alias("terms")), "prompt", "r2").withColumn("v2", guard.validated(F.col(text), F.col("r2"), F.col(context)))
    repaired = again.select(question, F.when(F.col("v2.valid"), F.col("r2")).otherwise(guard.fallback(F.col(text), F.col("terms"))).alias("reply"), F.when(F.col("v2.valid"), "repaired").otherwise("fallback").alias("source"))
    return first.filter(F.col("v.valid")).select(question, "reply", F.lit("first").alias("source")).unionByName(repaired)


def found_at(cases: DataFrame, hits: DataFrame, top: int = 10, good: int = 3) -> DataFrame:
    """V7: (name, rank, verdict) of retrieval cases (name, expected_codes, expected_clauses): the first hit (name, rank, code, clause) of the
    `top` best with an expected code, and an expected clause where there are any."""
    right = F.array_contains("expected_codes", F.col("code")) & ((F.size(F.coalesce("expected_clauses", F.array().cast("array<string>"))) == 0) | F.array_contains("expected_clauses", F.col("clause")))
    best = cases.join(hits.filter(F.col("rank") <= top), "name").filter(right).groupBy("name").agg(F.min("rank").alias("rank"))
    out = cases.select("name").join(best, "name", "left")
    return out.select("name", "rank", F.when(F.col("rank").isNull(), "missing").when(F.col("rank") <= good, "good").otherwise("found").alias("verdict"))


class Report:
    """K8: seconds of each stage of a run: `with report.stage("rerank"): ...`, then report.rows(spark)."""

    def __init__(self) -> None:
        self.seconds: dict[str, float] = {}

    @contextmanager
    def stage(self, name: str) -> Iterator[None]:
        began = time.perf_counter()
        try:
            yield
        finally:
            self.seconds[name] = self.seconds.get(name, 0.0) + time.perf_counter() - began

    def rows(self, spark: SparkSession) -> DataFrame:
        """(stage, seconds), and the total."""
        return spark.createDataFrame([*self.seconds.items(), ("total", sum(self.seconds.values()))], "stage string, seconds double")
