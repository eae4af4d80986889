import duckdb

from sourcegrove.operators import clauses as C
from sourcegrove.plans import queries

SPEC = """3GPP TS 23.999
Contents
Foreword\t4
1\tScope\t5
2\tReferences\t5
4.1\tGeneral description\t6
4.1.2\tHeterogeneous TDM Port Configurations\t7
4.2\tSession handling procedure\t8
Annex A (informative): Examples\t9
2023 odd line
Foreword
1\tScope
The scope body.
2\tReferences
[1] something
4.1\tGeneral description
4.2\tSession handling procedure?
NOTE: not a heading
4.1.2\tHeterogeneous Configurations
text of ports
.2\tSession handling procedure
text of sessions
Annex A (informative):
Examples follow
1\tScope
"""


def test_spec_with_contents():
    got = C.spec_clauses(SPEC)
    assert [n for n, _, _ in got] == ["1", "2", "4.1", "4.1.2", "4.2", "A"]
    body = {n: b for n, _, b in got}
    assert body["1"] == "The scope body." and body["4.1.2"] == "text of ports" and body["4.2"] == "text of sessions"
    assert "NOTE: not a heading" in body["4.1"] and body["A"].endswith("Scope")


def test_spec_without_contents():
    assert C.spec_clauses("1 Scope\nx\nA.1\tFirst\nbody\nB.2.1 Second.") == [("A.1", "First", "body"), ("B.2.1", "Second", "")]


def test_first_body_line_like_an_entry():
    text = "Contents\n1\tScope\t5\n4.1\tGeneral\t6\n1\tScope\nb words and 14 numbers 27\n4.1\tGeneral\nlast"
    assert C.spec_clauses(text) == [("1", "Scope", "b words and 14 numbers 27"), ("4.1", "General", "last")]


def test_made_clauses_of_odd_texts_equal_their_sql(spark, tmp_path):
    texts = [None, "", "x 5", "call +1 (853) 555-7168 x 4880761348116108", "x\x0by", "x\x0b", "\x85z\x85", "p\u2028q", "nb\xa0", "f\x0cg", "tail\x1c", "r\r\ny", "\u2003em", "a\u20284.1 General"]
    spark.createDataFrame([(i, texts[i // 2]) for i in range(2 * len(texts))], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {tuple(r) for r in queries.clause_split(spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert got == set(con.execute(queries.ORACLE_SQL["clause_split"]).fetchall())


def test_scores():
    assert C.alike("Session handling", "session  handling.") == 1.0
    assert C.alike("", "x") == 0.0 and C.alike("abc", "xyz") < 0.3


RFC = """Request for Comments: 9999
Table of Contents
   1.  Introduction ........ 3
   2.  Streams  ............ 4
2.1
.
Stream Types
3
Very long
title here
7

1.  Introduction
Hello there.
2
Streams
All about streams.
2.1.  Stream Types
kinds
2.  Streams
again
3.  Very long title here
end
"""


def test_rfc_with_contents():
    got = C.rfc_clauses(RFC)
    assert [(n, t) for n, t, _ in got] == [("1", "Introduction"), ("2", "Streams"), ("2.1", "Stream Types"), ("3", "Very long title here")]
    assert got[1][2] == "All about streams." and got[2][2] == "kinds\n2.  Streams\nagain"


def test_rfc_without_contents():
    got = C.rfc_clauses("x\n1.  Intro\nbody\n  2.  indented\n3.  Entry like ..... 12\n2.  Next\nz")
    assert got == [("1", "Intro", "body\n  2.  indented\n3.  Entry like ..... 12"), ("2", "Next", "z")]


def test_clauses_rows(spark):
    df = spark.createDataFrame([(1, "3GPP", SPEC), (2, "IETF", RFC), (3, "3GPP", None), (4, None, "1 A\nb\n\n2 C"), (5, "X", "")], "id int, org string, text string")
    got = C.clauses(df).collect()
    assert {i: sum(r.id == i for r in got) for i in range(1, 6)} == {1: 6, 2: 4, 3: 0, 4: 2, 5: 0}
