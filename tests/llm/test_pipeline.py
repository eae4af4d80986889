import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sourcegrove.llm import decontaminate, exact_dedup, ngram_join, queries, stage, toxicity
from sourcegrove.llm.oracle import ORACLE_SQL
from tests.llm.test_operators import components_of, plain_bm25, prose, reference_sets


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_oracle(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    df = queries.QUERIES[name](spark, sf_dir)
    cur = con.execute(ORACLE_SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(tuple(r) for r in df.select(*names).collect()) == sorted(cur.fetchall())


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - {"op4_decontaminate", "op2_chat_format"}))
def test_one_row_for_each_input_row(spark, sf_dir, name):
    table = "pages" if name.startswith("op6") else "documents"
    assert queries.QUERIES[name](spark, sf_dir).count() == queries.table(spark, sf_dir, table).count()


def test_pipeline_stage_by_stage(spark, sf_dir):
    docs = queries.table(spark, sf_dir, "documents")
    want = docs.columns
    seen = [docs.count()]
    for k, (name, step) in enumerate(corpus_pipeline.STAGES):
        before = docs
        docs = stage.written(step(spark, docs, sf_dir), f"test-{k}", keep=True)
        seen.append(docs.count())
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == want and docs.exceptAll(before).count() == 0, name
    assert seen == sorted(seen, reverse=True) and seen[-1] == seen[-2]
    assert docs.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, sf_dir).collect()) == sorted(r.doc_id for r in docs.collect())


def test_stages_on_an_empty_table(spark, sf_dir):
    empty = queries.table(spark, sf_dir, "documents").limit(0)
    for _, step in corpus_pipeline.STAGES:
        assert step(spark, empty, sf_dir).count() == 0


def test_row_filters_keep_clean_rows(spark):
    df = spark.createDataFrame([(1, "a b c d e f"), (2, "a b c d e f"), (3, None), (4, "x")], "doc_id long, text string")
    assert {r.doc_id for r in exact_dedup.kept_rows(df).collect()} == {1, 3, 4}
    assert {r.doc_id for r in ngram_join.one_of_each(df).collect()} == {1, 3, 4}
    assert toxicity.clean_rows(df, toxicity.Lexicon({"foul": 9.0}, 1.0, -3.0)).select(F.count("*")).first()[0] == 4


def test_pipeline_equals_plain_stages(spark, sf_dir, tmp_path):
    """All stages against plain Python versions, on the smallest tables with copies, near copies and benchmark passages put in."""
    from tokenizers import Tokenizer

    rng = random.Random(21)
    rows = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in queries.table(spark, sf_dir, "documents").collect()]
    items = [r.text for r in queries.table(spark, sf_dir, "benchmark").orderBy("item_id").collect()]
    long = [r for r in rows if r[1] and len(r[1].split()) > 80]
    more = [(r[1].replace(" ", "  ", 3), *r[2:]) for r in long[:6]] + [(" ".join(w for k, w in enumerate(r[1].split()) if k != 40), *r[2:]) for r in long[6:12]]
    more += [(f"{prose(rng, 60)} {items[k]} {prose(rng, 60)}", "en", "x", 1) for k in range(5)] + [(None, "en", "x", 0), ("", None, None, 0)]
    rows += [(10_000 + k, *r) for k, r in enumerate(more)]
    at = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    for name in ("labels", "benchmark"):
        queries.table(spark, sf_dir, name).write.parquet(f"{at}/{name}.parquet")
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, at).collect()}

    docs = queries.table(spark, at, "documents")
    labels = queries.table(spark, at, "labels").filter(queries.remainder("doc_id", 4) != 2)
    bad = {r.doc_id for r in toxicity.toxicity(docs, toxicity.learn(docs, labels)).filter("predicted = 1").collect()}
    left = {r[0]: r[1] for r in rows if r[0] not in bad}
    first = {}
    for i in sorted(left):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", left[i] or ""), i)
    left = {i: left[i] for i in first.values()}
    ids = sorted(left)
    root = components_of(reference_sets([left[i] for i in ids]), ids)
    left = {i: left[i] for i in ids if root[i] == i}

    def leaks(text):
        own = decontaminate.words(text)
        for k in plain_bm25(items, text, decontaminate.THRESHOLD):
            shares = []
            for part in decontaminate.parts(items[k]):
                n = min(decontaminate.GRAM, len(part))
                mine = {tuple(part[a : a + n]) for a in range(len(part) - n + 1)}
                shares.append(len(mine & {tuple(own[a : a + n]) for a in range(len(own) - n + 1)}) / len(mine) if mine else 1.0)
            if min(shares) >= 0.6:
                return True
        return False

    left = {i: t for i, t in left.items() if not t or not leaks(t)}
    assert set(got) == set(left) and len(left) < len(rows) - 15
    lib = Tokenizer.from_file(queries.tokenizer_path())
    lib.no_truncation()
    lib.no_padding()
    assert all(got[i].n_tokens == len(lib.encode(t or "", add_special_tokens=False).ids) for i, t in left.items())
