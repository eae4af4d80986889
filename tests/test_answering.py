import pytest
from pyspark.sql import functions as F

from sourcegrove.functions import rules
from sourcegrove.plans import answering

CHUNKS = [
    (1, "QUIC loss detection and congestion control for QUIC", "IETF", "9002", "Latest", "1", "Overview", "indexed", "http://x/9002"),
    (2, "QUIC loss detection and congestion  control for QUIC", "IETF", "9002", "Latest", "1", "Overview", "indexed", "http://x/9002"),
    (3, "QUIC loss detection and recovery", "IETF", "9002", "Latest", "9", "References", "indexed", "http://x/9002"),
    (4, "QUIC loss detection and recovery text", "IETF", "9002", "Latest", "2", "Loss", "blocked", "http://x/9002"),
    (5, "Something else entirely about billing", "3GPP", "TS 32.240", "v", "5", "Charging", "indexed", None),
    (6, "  ", "3GPP", "TS 32.240", "v", "6", "Empty", "indexed", None),
]


def tables(spark):
    chunks = spark.createDataFrame(CHUNKS, "chunk_id long, text string, org string, code string, version string, clause string, clause_title string, status string, source_url string")
    asked = spark.createDataFrame([(1, "QUIC loss nasıl?"), (2, "zzz qqq"), (3, " "), (4, "RFC 9999 QUIC loss detection and recovery")], "question long, text string")
    return asked, answering.embedded(chunks, "text", "passage: ")


def test_vectors_are_units_and_batches_agree():
    a = answering.hashed_words(["one two", "three", ""])
    assert abs((a[0] ** 2).sum() - 1) < 1e-3 and (answering.hashed_words(["three"])[0] == a[1]).all()


def test_retrieve_cleans(spark):
    asked, chunks = tables(spark)
    got = answering.retrieve(asked, chunks, threshold=1.2).filter("question = 1").collect()
    assert {r.chunk_id for r in got} <= {1, 2, 5} and len({1, 2} & {r.chunk_id for r in got}) == 1


def test_prompts_keep_every_question(spark):
    asked, chunks = tables(spark)
    got = {r.question: r for r in answering.prompts(asked, chunks, threshold=1.2).collect()}
    assert set(got) == {1, 2, 3, 4}
    assert got[1].has_evidence and got[1].context.startswith("[KAYNAK 1: IETF 9002 | Madde 1 | Overview]")
    assert not got[3].has_evidence and not got[4].has_evidence


def test_lone_hit_is_not_scored(spark):
    hits = spark.createDataFrame([(1, 7, "abc", ["q"]), (2, 8, "a b", ["a", "b a"]), (2, 9, "c", ["a", "b a"])], "question long, chunk_id long, text string, variants array<string>")
    got = {(r.question, r.chunk_id): r for r in answering.reranked(hits).collect()}
    assert got[1, 7].rerank_score == 1.0 and got[2, 8].rerank_score == 10.0 and got[2, 8].rerank_variant == 1 and got[2, 9].position == 2
    assert answering.reranked(hits, top_k=1).filter(F.col("question") == 2).count() == 1


def test_blank_questions_are_errors():
    with pytest.raises(ValueError):
        answering.query_vector("  ")
    with pytest.raises(ValueError):
        answering.query_vectors(["", None])
    one, both = answering.query_vector("a b"), answering.query_vectors(["a b", " ", "c"])
    assert one == both[0] and len(both) == 2


def test_texts_have_the_same_vectors_alone_and_in_batches(spark):
    df = spark.createDataFrame([(i, f"text number {i} {'x ' * i}") for i in range(9)], "id int, text string")
    whole = {r.id: r.embedding for r in answering.embedded(df, "text", "passage: ", batch=4).collect()}
    alone = {r.id: r.embedding for r in answering.embedded(df, "text", "passage: ", batch=1).collect()}
    assert whole == alone and len(whole) == 9


def store(spark):
    rows = [
        (1, "This document defines HTTP/3.", "IETF", "9114", "1", "Scope", None, "indexed"), (2, "HTTP/3 frames and streams", "IETF", "9114", "2", "Frames", None, "indexed"), (3, "An overview", "IETF", "9114", "3", "Overview", None, "indexed"),
        (4, "HTTP/3 refers", "IETF", "9114", "9", "References", None, "indexed"), (5, "This document defines HTTP/3.", "ietf", "9114", "1", "Scope", None, "blocked"), (6, "QUIC and RFC9114 in words", "IETF", "9000", "1", "Scope", None, "indexed"),
        (7, "N11: Reference point between the AMF and the SMF", "3GPP", "TS 23.501", "4", "Points", None, "indexed"), (8, "reference point AMF SMF list", "3GPP", "TS 23.501", "5", "References", None, "indexed"),
    ]
    return spark.createDataFrame(rows, "chunk_id long, text string, org string, code string, clause string, clause_title string, source_url string, status string")


def test_sources_of_document_answers(spark):
    chunks = store(spark)
    hits = chunks.filter("chunk_id in (6, 7)").select(F.explode(F.array(*map(F.lit, (1, 2, 3, 4)))).alias("question"), (F.col("chunk_id") - 5).cast("int").alias("rank"), "chunk_id", "org", "code", "clause", "clause_title", "text", "source_url")
    answers = spark.createDataFrame([(1, "HTTP/3 overview?", "RFC 9114"), (2, "x", "3GPP TS 99.999"), (3, "x", "RFC9114"), (4, "x", "3GPP TS 23.501")], "question int, q string, answer string")
    got = {}
    for r in answering.answer_sources(answers, hits, chunks).orderBy("question", "position").collect():
        got.setdefault(r.question, []).append((r.chunk_id, r.route))
    assert got == {1: [(1, 0), (3, 0)], 2: [(6, 3), (7, 3)], 3: [(6, 2)], 4: [(7, 0), (8, 0)]}


def test_second_search(spark):
    asked = spark.createDataFrame([(1, "AMF ile SMF arasındaki reference point hangisidir?"), (2, "HTTP/3 hangi RFC'de tanımlanır?"), (3, " ")], "question long, text string")
    got = {}
    for r in answering.second_search(asked, store(spark)).orderBy("question", "position").collect():
        got.setdefault(r.question, []).append((r.chunk_id, r.route))
    assert got[1] == [(7, 0)]  # the list of references is of low value
    assert {(1, 1), (2, 1), (4, 1)} <= set(got[2]) and {r for _, r in got[2]} == {1} and 3 not in got


def test_union_of_two_searches(spark):
    rows = [(1, k, c, None, "o", "c", str(c), f"t{c}") for k, c in enumerate((5, 6), 1)]
    kind = "question int, position int, chunk_id int, source_url string, org string, code string, clause string, text string"
    first = spark.createDataFrame([(1, k, c, None, "o", "c", str(c), f"t{c}") for k, c in enumerate((6, 7, 8), 1)], kind)
    got = answering.combined(spark.createDataFrame(rows, kind), first, 3).orderBy("position").collect()
    assert [(r.chunk_id, r.side) for r in got] == [(5, 0), (6, 0), (7, 1)]


def test_replies(spark):
    rows = [(1, "Hangi sistem?", "The 5G System is used."), (2, "Hangi sistem?", "The 5G System is here."), (3, "AMF ne yapar?", "AMF registers.")]
    asked = spark.createDataFrame(rows, "question int, text string, context string")

    def model(prompts):
        again = "Önceki cevabı düzelt"
        return ["The 5G System (5GS)." if "is used" in p else ("The 5G System." if again in p else "Bilinmiyor.") if "is here" in p else "XYZ9 yapar." for p in prompts]

    got = {r.question: (r.reply, r.source) for r in answering.replied(asked, model).collect()}
    assert got == {1: ("The 5G System.", "first"), 2: ("The 5G System.", "repaired"), 3: (rules.GUARD_FALLBACK, "fallback")}


def test_report(spark):
    report = answering.Report()
    with report.stage("a"):
        pass
    with report.stage("a"):
        pass
    got = {r.stage: r.seconds for r in report.rows(spark).collect()}
    assert set(got) == {"a", "total"} and got["total"] == got["a"] >= 0


def test_equal_questions_for_one_document_are_scored_once(spark, tmp_path):
    columns = "chunk_id long, org string, code string, clause string, clause_title string, text string, source_url string, status string"
    chunks = spark.createDataFrame([(i, "IETF", "9114", str(i), "Scope", f"text {i}", None, "indexed") for i in range(10)], columns)
    hits = spark.createDataFrame([(q, 1, 99, "3GPP", "TS 1", "1", "x", "y", None) for q in range(30)], "question long, rank int, chunk_id long, org string, code string, clause string, clause_title string, text string, source_url string")
    answers = spark.createDataFrame([(q, "which rfc", "RFC 9114") for q in range(30)], "question long, q string, answer string")
    log = str(tmp_path / "scored")

    def scorer(queries, texts):
        with open(log, "a") as f:
            f.writelines(f"{t}\n" for t in texts)
        return [float(t.rpartition(" ")[2]) for t in texts]

    got = answering.answer_sources(answers, hits, chunks, scorer, most=4, pool=8).orderBy("question", "position").collect()
    assert [(r.question, r.position, r.route, r.chunk_id) for r in got] == [(q, p, 0, 8 - p) for q in range(30) for p in range(1, 5)]
    with open(log) as f:
        assert len(set(lines := f.read().splitlines())) == 8 and len(lines) < 30
