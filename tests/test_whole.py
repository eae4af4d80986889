"""Queries and operators do the whole job: all rows are searched, for all that is asked."""

import inspect

import numpy as np

from sourcegrove.operators import evidence, lexical, references, vector
from sourcegrove.plans import queries


def test_facts_of_all_documents(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(evidence, "QUESTION_BLOCK", 3)
    texts = [(i, f"Filler line {'x' * (i % 7 + 1)}. Other words here.") for i in range(40)]
    texts[7] = (7, "The blue fox jumps over seven lazy dogs. the  BLUE fox jumps over seven lazy dogs.")
    texts[13] = (13, "Blue fox only. ")
    texts[20] = (20, None)
    items = [(i, None if i == 2 else f"item number {i}") for i in range(7)] + [(7, "blue fox jumps over seven lazy dogs")]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    facts = queries.supporting_facts(spark, str(tmp_path)).collect()
    assert [r.score for r in sorted(facts, key=lambda r: r.rank) if r.question == 7] == [9.0, 3.0, 0.0]
    assert {r.question for r in facts} == set(range(8)) and len(facts) == 24
    scores = {(r.question, r.doc_id): (r.n, r.common, r.best) for r in queries.sentence_score(spark, str(tmp_path)).collect()}
    assert len(scores) == 8 * 39
    assert scores[7, 7] == (2, 12, 11.5) and scores[7, 13] == (1, 2, 5.5) and scores[2, 7] == (2, 0, 2.5)


def test_all_stated_vectors_are_queries(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(vector, "QUERY_ROWS", 3)
    e = [(r.vec_id, np.array(r.embedding, float)) for r in queries.table(spark, sf_dir, "embeddings").collect()]
    asked = [x for x in e if x[0] % 20 == 0]
    got = {(r.variant, r["rank"]): r.chunk_id for r in queries.knn_topk(spark, sf_dir).collect()}
    assert len(asked) > 20 and len(got) == 35 * len(asked)
    for q, v in asked:
        near = sorted((round(float(((v - x) ** 2).sum()), 9), c) for c, x in e)
        assert [got[q, k] for k in range(1, 36)] == [c for _, c in near[:35]]
    assert {r.question for r in queries.coverage_select(spark, sf_dir).collect()} == {q // 80 for q, _ in asked}


def test_crawl_ends_only_on_an_empty_frontier(spark, sf_dir):
    assert inspect.signature(references.crawl).parameters["most_levels"].default is None
    cites = spark.createDataFrame([("D", str(a), "D", str((a + 1) % 20)) for a in range(20)], "org string, code string, to_org string, to_code string")
    seeds = spark.createDataFrame([("D", "0")], "org string, code string")
    assert {(r.code, r.level) for r in references.crawl(seeds, cites).collect()} == {(str(i), i) for i in range(20)}
    assert references.crawl(seeds, cites, 13).count() == 13
    n = queries.table(spark, sf_dir, "documents").count()
    assert {int(r.code): r.level for r in queries.crawl_closure(spark, sf_dir).collect()} == {i: (i + 1).bit_length() - 1 for i in range(n)}


def test_places_of_a_lone_token_are_counted_at_the_scan(spark):
    docs = spark.createDataFrame([(1, "a b a c a"), (2, "b a b"), (3, "c"), (4, None)], "doc_id long, text string")
    asked = spark.createDataFrame([(0, 0, "a"), (0, 1, "A b"), (1, 0, "b")], "query long, phrase_no int, phrase string")
    found = lexical.matched(docs, asked)
    assert {tuple(r) for r in found.collect()} == {(0, 0, 1, 3, 5), (0, 0, 2, 1, 3), (0, 1, 1, 1, 5), (0, 1, 2, 1, 3), (1, 0, 1, 1, 5), (1, 0, 2, 2, 3)}
    first = [x for x in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Aggregate" in x][1]
    assert "start" in first or "_groupingexpression" in first  # a row a document and lone token, not one a place
    starts = [x for x in found._jdf.queryExecution().analyzed().toString().splitlines() if "AS start" in x]
    assert any("CASE WHEN (size" in x for x in starts)
