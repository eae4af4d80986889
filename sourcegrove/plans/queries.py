"""The registered queries over the reference tables, and their DuckDB SQL."""

from __future__ import annotations

import html
import io
import zipfile
import zlib
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sourcegrove.functions import rules, tables
from sourcegrove.functions.text import blank, squeezed
from sourcegrove.operators import candidates, chunking, clauses, contexts, evidence, gates, guard, history, ingest, lexical, questions, references, results, vector
from sourcegrove.plans import answering
from sourcegrove.sources import documents as sources

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
#: On the random unit vectors of the tables, the default threshold keeps only a vector itself.
WIDE = 1.6


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents for work on every text, over all cores."""
    return tables.spread(table(spark, sf_dir, "documents").select("doc_id", "text"))


def values(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def quoted(x) -> str:
    return "NULL" if x is None else str(x) if isinstance(x, (int, float, bool)) else "'" + x.replace("'", "''") + "'"


def values_sql(rows: list[tuple], names: str) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join(map(quoted, r)) + ")" for r in rows) + f") AS t({names})"


# ---------------------------------------------------------------- vector search and fusion

KNN_SQL = """
WITH q AS (SELECT vec_id AS variant, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 20 = 0),
d AS (
  SELECT variant, e.vec_id AS chunk_id, e.label,
    round(list_dot_product(v, v) + list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[]) - 2 * list_dot_product(v, e.embedding::DOUBLE[]), 9) AS distance
  FROM q, embeddings e
), hits AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY variant ORDER BY distance, chunk_id) AS rank FROM d) WHERE rank <= 35
)"""
FUSED_SQL = (
    KNN_SQL
    + """, near AS (SELECT *, variant // 80 AS question FROM hits WHERE distance <= 1.6),
fused AS (
  SELECT question, chunk_id, round(sum(1 / (60.0 + rank)), 12) AS fusion_score, min(rank) AS best_rank, min(distance) AS distance, count(DISTINCT variant) AS query_hit_count
  FROM near GROUP BY question, chunk_id
)"""
)


def variant_hits(spark: SparkSession, sf_dir: str, searched: str = "true") -> DataFrame:
    """Every vector whose id is divisible by 20 (the stated query set) against all vectors; four of them in order are the variants of a question."""
    e = table(spark, sf_dir, "embeddings")
    queries = e.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("variant"), "embedding")
    return vector.knn(queries, e.filter(searched).withColumnRenamed("vec_id", "chunk_id"))


def near_hits(spark, sf_dir):
    return vector.near_enough(variant_hits(spark, sf_dir), WIDE).withColumn("question", F.expr("variant div 80"))


@query(KNN_SQL + " SELECT variant, chunk_id, distance, rank FROM hits")
def knn_topk(spark, sf_dir):
    """V4 J1 W1."""
    return variant_hits(spark, sf_dir)


@query(KNN_SQL.replace("FROM q, embeddings e", "FROM q, embeddings e WHERE e.label = 1") + " SELECT variant, chunk_id, distance, rank FROM hits WHERE distance <= 1.6")
def knn_filtered(spark, sf_dir):
    """A metadata predicate below the search, a distance threshold above it."""
    return vector.near_enough(variant_hits(spark, sf_dir, "label = 1"), WIDE)


@query(FUSED_SQL + " SELECT * FROM fused")
def rrf_fusion(spark, sf_dir):
    """A1 A2 A6."""
    return vector.fuse(near_hits(spark, sf_dir)).drop("variant_ranks")


@query(
    FUSED_SQL
    + """, tops AS (SELECT question, chunk_id, min(variant) AS top_variant FROM (SELECT *, min(rank) OVER (PARTITION BY variant) AS f FROM near) WHERE rank = f GROUP BY question, chunk_id),
chosen AS (
  SELECT * FROM (SELECT f.*, top_variant, row_number() OVER (PARTITION BY f.question ORDER BY top_variant ASC NULLS LAST, fusion_score DESC, query_hit_count DESC, best_rank, distance, f.chunk_id) AS n FROM fused f LEFT JOIN tops USING (question, chunk_id)) WHERE n <= 12
)
SELECT question, chunk_id, fusion_score, best_rank, distance, query_hit_count, top_variant,
  row_number() OVER (PARTITION BY question ORDER BY fusion_score DESC, query_hit_count DESC, best_rank, distance, chunk_id) AS position FROM chosen"""
)
def coverage_select(spark, sf_dir):
    """W2 W3 T1."""
    return vector.select_covering(near_hits(spark, sf_dir)).drop("variant_ranks")


SCORED_SQL = KNN_SQL + ", scores AS (SELECT variant // 80 AS question, chunk_id, variant, round(10 - 5 * distance, 6) AS score FROM hits)"


def scored_hits(spark, sf_dir):
    return variant_hits(spark, sf_dir).select(F.expr("variant div 80").alias("question"), "chunk_id", "variant", F.round(10 - 5 * F.col("distance"), 6).alias("score"))


@query(
    SCORED_SQL
    + """, best AS (SELECT question, chunk_id, max(score) AS rerank_score, count(DISTINCT variant) AS rerank_variant_count FROM scores GROUP BY ALL),
v AS (SELECT question, chunk_id, min(variant) AS rerank_variant FROM scores s JOIN best b USING (question, chunk_id) WHERE score = rerank_score GROUP BY ALL)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question ORDER BY rerank_score DESC, chunk_id) AS position FROM best JOIN v USING (question, chunk_id)) WHERE position <= 5"""
)
def rerank_best_variant(spark, sf_dir):
    """A3 T2 A5."""
    return vector.best_variant(scored_hits(spark, sf_dir), top_k=5)


@query(
    SCORED_SQL
    + """, best AS (SELECT question, chunk_id, max(score) AS rerank_score FROM scores GROUP BY ALL),
n AS (SELECT *, row_number() OVER (PARTITION BY question ORDER BY rerank_score DESC, chunk_id) AS rn FROM best),
m AS (SELECT *, max(CASE WHEN rn = 1 THEN rerank_score END) OVER w AS top, max(CASE WHEN rn = 2 THEN rerank_score END) OVER w AS second FROM n WHERE rn <= 3 WINDOW w AS (PARTITION BY question))
SELECT question, chunk_id, rerank_score, rn FROM m WHERE NOT coalesce(top >= 7.0 AND top - second >= 2.0, false) OR rn = 1"""
)
def strong_margin(spark, sf_dir):
    """F13 W6."""
    best = scored_hits(spark, sf_dir).groupBy("question", "chunk_id").agg(F.max("score").alias("rerank_score"))
    return vector.strong_margin(best)


# ---------------------------------------------------------------- lexical search

TOKENS_SQL = f"regexp_extract_all(translate(lower(coalesce(text, '')), '{lexical.MARKED}', '{lexical.PLAIN}'), '([\\p{{L}}\\p{{N}}]+)')"
POSTINGS_SQL = f"""
WITH t AS (SELECT doc_id, {TOKENS_SQL} AS w FROM documents),
e AS (SELECT doc_id, unnest(w) AS token, generate_subscripts(w, 1) - 1 AS pos FROM t),
len AS (SELECT doc_id, len(w) AS len FROM t),
stats AS (SELECT count(*) AS n_docs, avg(len) AS avg_len FROM len)"""


@query(POSTINGS_SQL + " SELECT token, count(*) AS df, sum(tf)::BIGINT AS cf, sum(first)::BIGINT AS firsts FROM (SELECT token, doc_id, count(*) AS tf, min(pos) AS first FROM e GROUP BY ALL) GROUP BY token")
def token_postings(spark, sf_dir):
    """L1 K4, as one row per token."""
    return lexical.token_stats(documents(spark, sf_dir))


PHRASES = [(0, 0, "of the"), (0, 1, "that"), (1, 0, "in"), (1, 1, "and the"), (2, 0, "license")]
PHRASE_SQL = (
    POSTINGS_SQL
    + ", p AS (SELECT query, phrase_no, string_split(phrase, ' ') AS ws FROM "
    + values_sql(PHRASES, "query, phrase_no, phrase")
    + """),
x AS (SELECT query, phrase_no, len(ws) AS size, unnest(ws) AS token, generate_subscripts(ws, 1) - 1 AS place FROM p),
s AS (SELECT query, phrase_no, doc_id, pos - place AS start, size FROM e JOIN x USING (token)),
h AS (SELECT query, phrase_no, doc_id, count(*) AS tf FROM (SELECT query, phrase_no, doc_id, start FROM s GROUP BY query, phrase_no, doc_id, start, size HAVING count(*) = size) GROUP BY ALL)"""
)


def phrase_table(spark):
    return values(spark, PHRASES, "query int, phrase_no int, phrase string")


@query(PHRASE_SQL + " SELECT * FROM h")
def phrase(spark, sf_dir):
    """L2."""
    return lexical.matched(documents(spark, sf_dir), phrase_table(spark)).drop("len")


BM25_SQL = (
    PHRASE_SQL
    + """, df AS (SELECT query, phrase_no, count(*) AS df FROM h GROUP BY ALL),
sc AS (
  SELECT query, doc_id, round(sum(-greatest(ln((n_docs - df + 0.5) / (df + 0.5)), 1e-6) * (tf * 2.2) / (tf + 1.2 * (0.25 + 0.75 * len / avg_len))), 9) AS score, count(*) AS n_terms
  FROM h JOIN df USING (query, phrase_no) JOIN len USING (doc_id), stats GROUP BY ALL
)"""
)


@query(BM25_SQL + " SELECT * FROM sc")
def bm25_scores(spark, sf_dir):
    """L3 J16."""
    docs = documents(spark, sf_dir)
    return lexical.bm25(lexical.matched(docs, phrase_table(spark)), lexical.counted(docs))


@query(BM25_SQL + ", need AS (SELECT query, count(*) AS need FROM p GROUP BY ALL) SELECT query, doc_id, score, rank FROM (SELECT query, doc_id, score, row_number() OVER (PARTITION BY query ORDER BY score, doc_id) AS rank FROM sc JOIN need USING (query) WHERE n_terms = need) WHERE rank <= 20")
def boolean_and(spark, sf_dir):
    """L4 T4 F27."""
    docs = documents(spark, sf_dir)
    listed = phrase_table(spark).groupBy("query").agg(F.array_sort(F.collect_list(F.struct("phrase_no", "phrase"))).getField("phrase").alias("phrases"))
    return lexical.search(docs, listed)


@query(PHRASE_SQL + " SELECT * FROM h")
def indexed_phrase(spark, sf_dir):
    """Phrase over an index that is written first and of which only the folders of the phrases' tokens are read."""
    at = tables.new_folder(spark, "lexical-index")
    lexical.write_index(documents(spark, sf_dir), at)
    index, _ = lexical.read_index(spark, at, phrase_table(spark))
    return lexical.phrase_hits(index, phrase_table(spark))


WORDS_OF = "list_transform(list_filter(regexp_extract_all(text, '[A-Za-z0-9]+'), lambda w: length(w) > {}), lambda w: lower(w))"


@query(
    POSTINGS_SQL
    + f""", q AS (SELECT item_id AS question, list_distinct({WORDS_OF.format(2)}[1:3]) AS ws FROM benchmark),
k AS (SELECT doc_id, list_distinct(w) AS w FROM t)
SELECT question, count(*) AS n_docs, min(doc_id) AS first_doc FROM q JOIN k ON list_has_all(k.w, q.ws) WHERE len(ws) > 0 GROUP BY question"""
)
def general_search(spark, sf_dir):
    """The documents that have the first three words of each item."""
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("question"), lexical.general_queries(F.array("text")).alias("queries"))
    docs = documents(spark, sf_dir)
    hits = lexical.searched(docs, asked, docs.count())
    return hits.groupBy("question").agg(F.count(F.lit(1)).alias("n_docs"), F.min("doc_id").alias("first_doc"))


# ---------------------------------------------------------------- results and ingest

FOLD_SQL = r"lower(trim(regexp_replace(coalesce({}, ''), '\s+', ' ', 'g')))"


@query(f"SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY CASE WHEN doc_id % 3 = 0 THEN 'u' || {FOLD_SQL.format('source')} ELSE 'm' || {FOLD_SQL.format('lang')} END, {FOLD_SQL.format('text')} ORDER BY doc_id) AS n FROM documents) WHERE n = 1")
def result_dedup(spark, sf_dir):
    """Every third row has a url (its source), the others go by their language as metadata."""
    d = table(spark, sf_dir, "documents")
    url = F.when(F.col("doc_id") % 3 == 0, F.col("source"))
    key = results.dedup_key(url, F.col("lang"), F.lit(""), F.lit(""), F.col("text"))
    return results.first_of_key(d, key, "doc_id").select("doc_id", "source")


SOURCES_SQL = "SELECT lang AS code, source AS clause, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY doc_id {}) AS n FROM documents) WHERE n = 1"


@query(SOURCES_SQL.format(""))
def source_first(spark, sf_dir):
    """Sources by metadata, the first wins."""
    d = table(spark, sf_dir, "documents")
    none = F.lit(None).cast("string")
    return results.first_of_key(d, results.source_key(none, F.lit("x"), F.col("lang"), none, F.col("source")), "doc_id").select(F.col("lang").alias("code"), F.col("source").alias("clause"), "doc_id")


@query("SELECT lang, source, max(doc_id) AS doc_id, min(doc_id) AS seq FROM documents GROUP BY ALL")
def source_last(spark, sf_dir):
    """The last values win, the first place stays."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("seq"), "lang", "source", "doc_id")
    return results.last_of_key(d, F.concat_ws("|", "lang", "source"), "seq").select("lang", "source", "doc_id", "seq")


TITLED = "CASE doc_id % 5 WHEN 0 THEN 'References' WHEN 1 THEN 'Scope' WHEN 2 THEN ' Foreword. ' WHEN 3 THEN 'Procedures' ELSE 'Change history:' END"
LOW_SQL = f"trim(lower({TITLED}), ' .:-') IN ({', '.join(map(quoted, rules.LOW_VALUE_TITLES))})"


def titled(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", (F.col("doc_id") % 4).alias("question"), "text", F.expr(TITLED).alias("clause_title"), F.when(F.col("doc_id") % 7 == 0, "blocked").when(F.col("doc_id") % 7 == 1, "void").when(F.col("doc_id") % 2 == 0, "available").otherwise("indexed").alias("status"))


@query("SELECT status, count(*) AS n FROM (SELECT CASE WHEN doc_id % 7 = 0 THEN 'blocked' WHEN doc_id % 7 = 1 THEN 'void' WHEN doc_id % 2 = 0 THEN 'available' ELSE 'indexed' END AS status FROM documents) WHERE status <> 'void' GROUP BY status")
def status_filters(spark, sf_dir):
    """F1 F2."""
    t = titled(spark, sf_dir)
    return results.available(t).union(results.blocked(t)).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH t AS (SELECT doc_id, doc_id % 20 AS question, NOT {LOW_SQL} AS keep FROM documents) SELECT doc_id, question FROM (SELECT *, bool_or(keep) OVER (PARTITION BY question) AS any_keep FROM t) WHERE keep OR NOT any_keep")
def prefer_content(spark, sf_dir):
    """F7 F8."""
    t = titled(spark, sf_dir).withColumn("question", F.col("doc_id") % 20)
    return results.prefer_content(t).select("doc_id", "question")


@query("SELECT doc_id, 'chunk_' || sha256(concat_ws('|', trim(coalesce(source, '')), trim(doc_id::VARCHAR), '', trim(coalesce(lang, '')), trim(coalesce(text, '')))) AS chunk_id FROM documents")
def chunk_id_sha(spark, sf_dir):
    """The chunk key of the data model."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", ingest.chunk_id(F.col("source"), F.col("doc_id").cast("string"), F.lit(None).cast("string"), F.col("lang"), F.col("text")).alias("chunk_id"))


@query("SELECT d.doc_id, n_chars FROM documents d WHERE trim(text) <> '' AND NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def resume_anti_join(spark, sf_dir):
    """Documents that are not labelled (indexed) yet."""
    d = table(spark, sf_dir, "documents").filter(~blank(F.col("text"))).select("doc_id", "n_chars")
    return ingest.missing(d, table(spark, sf_dir, "labels"), "doc_id")


@query("SELECT d.doc_id, d.lang, coalesce('q' || l.quality::VARCHAR, 'Latest') AS version, l.url AS source_url FROM documents d LEFT JOIN (SELECT doc_id, quality, 'u' || toxic::VARCHAR AS url FROM labels) l USING (doc_id)")
def left_join_default(spark, sf_dir):
    """J2."""
    labels = table(spark, sf_dir, "labels").select("doc_id", F.concat(F.lit("q"), "quality").alias("version"), F.concat(F.lit("u"), "toxic").alias("source_url"), F.lit(0).alias("seq"))
    return ingest.with_metadata(table(spark, sf_dir, "documents").select("doc_id", "lang"), labels, ["doc_id"], "seq")


@query("SELECT count(*) AS n_docs, count(*) FILTER (trim(coalesce(text, '')) = '') AS n_blank, count(DISTINCT coalesce(text, '')) AS n_distinct, count(*) - count(DISTINCT coalesce(text, '')) AS n_repeats, count(l.doc_id) AS n_indexed FROM documents d LEFT JOIN labels l USING (doc_id)")
def ingest_counters(spark, sf_dir):
    """A8."""
    return ingest.counters(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id", "text")


@query("SELECT doc_id AS id, quality::VARCHAR AS quality, toxic::VARCHAR AS toxic FROM labels")
def eav_pivot(spark, sf_dir):
    """J14 S11."""
    labels = table(spark, sf_dir, "labels")
    none = F.lit(None)
    rows = labels.select(F.col("doc_id").alias("id"), F.explode(F.array(*[F.struct(F.lit(k).alias("key"), F.col(k).alias("v")) for k in ("quality", "toxic")])).alias("x"))
    eav = rows.select("id", "x.key", none.cast("string").alias("string_value"), F.col("x.v").alias("int_value"), none.cast("double").alias("float_value"), none.cast("boolean").alias("bool_value"))
    return ingest.unpivoted(eav, "id", ["quality", "toxic"])


@query("SELECT doc_id, CASE WHEN contains(text, '\n') THEN 1 ELSE 0 END AS has_lines FROM documents WHERE source = 'src3' ORDER BY doc_id LIMIT 40")
def code_lookup(spark, sf_dir):
    """The first rows of a secondary key, ordered before the limit."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("code"), "text")
    return sources.of_code(d, "src3").select(F.col("chunk_id").alias("doc_id"), F.contains("text", F.lit("\n")).cast("int").alias("has_lines"))


# ---------------------------------------------------------------- sections and chunks

SHORT = 40


@query(f"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS no FROM documents),
s AS (SELECT *, sum((length(line) <= {SHORT})::INTEGER) OVER (PARTITION BY doc_id ORDER BY no) AS section FROM l WHERE trim(line) <> '')
SELECT doc_id, section::BIGINT AS section, arg_min(line, no) AS heading, count(*) - 1 AS n_lines, sum(length(line))::BIGINT AS n_chars FROM s WHERE section > 0 GROUP BY ALL""")
def generic_sections(spark, sf_dir):
    """No line of the tables is numbered, so short lines serve as headings here; tests have numbered ones."""
    out = chunking.sections(table(spark, sf_dir, "documents"), ["doc_id"], heading=F.length("line") <= SHORT)
    n = F.when(F.col("body") == "", 0).otherwise(F.size(F.split("body", "\n")))
    body = F.length(F.replace("body", F.lit("\n"), F.lit("")))
    return out.select("doc_id", "section", "heading", n.cast("long").alias("n_lines"), (F.length("heading") + body).cast("long").alias("n_chars"))


@query()
def long_text_chunks(spark, sf_dir):
    """Tested against properties and fixtures."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("title"), "text")
    return chunking.chunked(d).select("doc_id", "part_no", F.sha2("chunk", 256).alias("chunk_sha256"), F.length("chunk").alias("n_chars"), "status")


@query()
def html_text(spark, sf_dir):
    """S5."""
    out = sources.html_texts(table(spark, sf_dir, "pages").select("page_id", "html"))
    return out.select("page_id", F.length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"))


@query("""SELECT page_id, (pos - 1)::INTEGER AS pos, link FROM (SELECT page_id, unnest(l) AS link, generate_subscripts(l, 1) AS pos FROM (SELECT page_id, regexp_extract_all(html, '(?i)<a\\s[^>]*?href="([^"]*)"', 1) AS l FROM pages))""")
def html_links(spark, sf_dir):
    """S13."""
    return sources.html_links(table(spark, sf_dir, "pages"), ["page_id"])


@query("""SELECT page_id, l[1] AS first_link, list_max(l) AS last_link FROM (SELECT page_id, regexp_extract_all(html, '(?i)<a\\s[^>]*?href="([^"]*)"', 1) AS l FROM pages) WHERE len(l) > 0""")
def link_choice(spark, sf_dir):
    """The first link of a page, and the greatest as text."""
    links = sources.html_links(table(spark, sf_dir, "pages"), ["page_id"])
    return links.groupBy("page_id").agg(F.min_by("link", "pos").alias("first_link"), F.max("link").alias("last_link"))


def packed_file(kind: str, text: str) -> bytes:
    """A file of one paragraph: DOCX, a ZIP with one, HTML or PDF."""
    if kind == "html":
        return f"<html><body><script>x</script><p>{html.escape(text)}</p></body></html>".encode()
    if kind == "pdf":
        return b"%PDF-1.4\n1 0 obj\n<< /Filter /FlateDecode >>\nstream\n" + zlib.compress(b"BT 1 0 0 1 72 700 Tm <" + b"\xfe\xff".hex().encode() + text.encode("utf-16-be").hex().encode() + b"> Tj ET") + b"\nendstream\nendobj\n"
    body = f'<w:document xmlns:w="{sources.W[1:-1]}"><w:body><w:p><w:r><w:t>{html.escape(text)}</w:t></w:r></w:p></w:body></w:document>'

    def zipped(name: str, content: bytes) -> bytes:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            z.writestr(name, content)
        return out.getvalue()

    docx = zipped("word/document.xml", body.encode())
    return docx if kind == "docx" else zipped("23501-k00.docx", docx)


@query(r"SELECT item_id, CASE item_id % 4 WHEN 0 THEN 'docx' WHEN 1 THEN 'zip' WHEN 2 THEN 'html' ELSE 'pdf' END AS kind, trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) AS text FROM benchmark")
def file_texts(spark, sf_dir):
    """Every item written as a file of one of four kinds and read again, the kind told by its address."""
    names = ["docx", "zip", "html", "pdf"]

    def packed(batches):
        for b in batches:
            kinds = [names[i % 4] for i in b.column(0).to_pylist()]
            raw = [packed_file(k, t or "") for k, t in zip(kinds, b.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([f"http://x/{i}.{k}" if k != "html" else f"http://x/{i}" for i, k in zip(b.column(0).to_pylist(), kinds, strict=True)]), pa.array(raw, pa.binary())], ["item_id", "url", "content"])

    files = table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("long"), "text").mapInArrow(packed, "item_id long, url string, content binary")
    files = files.withColumn("kind", sources.kind_of(F.lit("text/html"), F.col("url"))).drop("url")
    return sources.read_documents(files).select("item_id", "kind", squeezed(F.col("text")).alias("text"))


# ---------------------------------------------------------------- references and crawl

#: A reference line for each document, in one of ten forms; {n} is a number of three digits, {f} one of four.
REFERENCE_FORMS = [
    '[{i}]\t3GPP TS 22.{n}: "Circuit Teleservices supported by a Public Land Mobile Network (PLMN)".', '[{i}]\tIETF RFC {f}: "Stream Control Transmission Protocol".', '[{i}]\tATIS-0700{n}: "WEA 3.0: Device-Based Geo-Fencing".', '[{i}]\tGSMA AD.{n}: "Coding of Cell Broadcast Functions".',
    '[{i}]\tITU-T Recommendation X.{n}: "Information technology".', "[{i}]\tVoid", '[{i}] ETSI TS 102 {n}: "Emergency Communications".', "no reference {i}", "[{i}] IEEE 802.{n} wireless", "[{i}] O-RAN.WG4-CUS{n} and MEF 10",
]


def form_sql(form: str) -> str:
    out = quoted(form).replace("\t", "' || chr(9) || '")
    for name, value in (("i", "doc_id % 97"), ("n", "(100 + doc_id % 900)"), ("f", "(1000 + doc_id % 9000)")):
        out = out.replace("{" + name + "}", f"' || {value} || '")
    return out


def form_column(form: str):
    out = F.lit(form)
    for name, value in (("i", F.col("doc_id") % 97), ("n", 100 + F.col("doc_id") % 900), ("f", 1000 + F.col("doc_id") % 9000)):
        out = F.replace(out, F.lit("{" + name + "}"), value.cast("string"))
    return out


def _reference_case(group: int) -> str:
    return " ".join(
        f"WHEN regexp_matches(body, '{p}') THEN " + (f"'{org}'" if group == 0 else f"upper(regexp_extract(body, '{p}', 1)) || ' ' || regexp_extract(body, '{p}', 2)" if len(g) == 2 else f"regexp_extract(body, '{p}', {g[0] if g else 0})")
        for org, p, g in rules.REFERENCE_PATTERNS
    )


@query(
    r"WITH x AS (SELECT id, trim(line) AS raw, regexp_extract(trim(line), '^\[(\d+)\]\s*(.+)$', 1) AS num, trim(regexp_extract(trim(line), '^\[(\d+)\]\s*(.+)$', 2)) AS body FROM (SELECT doc_id AS id, CASE doc_id % 10 "
    + " ".join(f"WHEN {k} THEN {form_sql(x)}" for k, x in enumerate(REFERENCE_FORMS))
    + " END AS line FROM documents)), y AS (SELECT id, raw AS raw_text, CASE "
    + _reference_case(0)
    + " END AS org, CASE "
    + _reference_case(1)
    + " END AS code, regexp_extract(body, '\"([^\"]+)\"', 1) AS title, try_cast(num AS INTEGER) AS ref_number, body FROM x WHERE num <> '' AND NOT starts_with(lower(body), 'void')) SELECT id, 0 AS line_no, raw_text, org, code, title, ref_number FROM y WHERE org IS NOT NULL"
)
def reference_parse(spark, sf_dir):
    """R1 R1a R1b R2."""
    line = F.when(F.col("doc_id") % 10 == 0, form_column(REFERENCE_FORMS[0]))
    for k, x in enumerate(REFERENCE_FORMS[1:], 1):
        line = line.when(F.col("doc_id") % 10 == k, form_column(x))
    return references.parse_references(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), line.alias("text")))


@query("SELECT org, code, 'pending' AS status, 'https://www.rfc-editor.org/rfc/rfc' || code || '.html' AS source_url, NULL::VARCHAR AS version FROM (VALUES ('IETF', '4960'), ('IETF', '9000')) t(org, code) UNION ALL SELECT * FROM (VALUES ('3GPP', 'TS 23.501', 'pending', 'https://www.3gpp.org/ftp/Specs/archive/23_series/23.501/23501-k00.zip', '23501-k00.zip'), ('3GPP', 'TS 99.999', 'unresolved', NULL, NULL), ('ETSI', 'TS 102 900', 'pending', 'https://www.etsi.org/deliver/etsi_ts/102900_102999/102900/01.04.01_60/ts_102900v010401p.pdf', NULL), ('ITU-T', 'X.210', 'blocked', 'https://www.itu.int/rec/T-REC-X.210/en', NULL), ('GSMA', 'AD.26', 'blocked', NULL, NULL)) t")
def resolve_urls(spark, sf_dir):
    """R3 R3a-R3e."""
    refs = [("IETF", "4960"), ("IETF", "9000"), ("3GPP", "TS 23.501"), ("3GPP", "TS 99.999"), ("ETSI", "TS 102 900"), ("ITU-T", "X.210"), ("GSMA", "AD.26")]
    gpp, etsi = "https://www.3gpp.org/ftp/Specs/archive/23_series/23.501/", "https://www.etsi.org/deliver/etsi_ts/102900_102999/"
    listing = [
        (gpp, 0, "23501-f00.zip"), (gpp, 1, "23501-k00.zip"), (gpp, 2, "readme.txt"), (etsi, 0, "/deliver/etsi_ts/102900_102999/102901/"), (etsi, 1, "/deliver/etsi_ts/102900_102999/102900/"),
        (etsi + "102900/", 0, "01.01.01_60/"), (etsi + "102900/", 1, "01.04.01_60/"), (etsi + "102900/01.04.01_60/", 0, "ts_102900v010401p.pdf"), ("https://www.itu.int/rec/T-REC-X.210/en", 0, "/about"),
    ]
    return references.resolve(values(spark, refs, "org string, code string"), values(spark, listing, "folder_url string, pos int, link string"))


@query(
    """SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'pending' WHEN 1 THEN CASE WHEN doc_id % 3 = 0 THEN 'unresolved' ELSE 'pending' END WHEN 2 THEN CASE WHEN doc_id % 3 = 0 THEN 'unresolved' WHEN doc_id % 3 = 1 THEN 'blocked' ELSE 'pending' END ELSE CASE WHEN doc_id % 3 = 2 THEN 'pending' ELSE 'blocked' END END AS status,
CASE doc_id % 4 WHEN 0 THEN 'https://www.rfc-editor.org/rfc/rfc' || (1000 + doc_id) || '.html' WHEN 1 THEN CASE WHEN doc_id % 3 <> 0 THEN 'https://www.3gpp.org/ftp/Specs/archive/23_series/23.' || (1000 + doc_id) || '/b.zip' END
  WHEN 2 THEN CASE WHEN doc_id % 3 = 2 THEN 'https://www.itu.int/rec/T-REC-X.' || (1000 + doc_id) || '/t.pdf' WHEN doc_id % 3 = 1 THEN 'https://www.itu.int/rec/T-REC-X.' || (1000 + doc_id) || '/en' END ELSE CASE WHEN doc_id % 3 = 2 THEN 'https://x/' || doc_id || '.PDF' WHEN doc_id % 3 = 1 THEN 'https://x/first' END END AS source_url FROM documents"""
)
def resolved_documents(spark, sf_dir):
    """R3 R3a R3b R3d R3e A11 A12: a reference for each document, and the listings of their folders."""
    n = F.col("doc_id")
    org = F.when(n % 4 == 0, "IETF").when(n % 4 == 1, "3GPP").when(n % 4 == 2, "ITU-T").otherwise("GSMA")
    code = F.when(n % 4 == 0, (1000 + n).cast("string")).when(n % 4 == 1, F.concat(F.lit("TS 23."), 1000 + n)).when(n % 4 == 2, F.concat(F.lit("X."), 1000 + n)).otherwise(F.concat(F.lit("AD."), n))
    folder = F.when(n % 4 == 1, F.concat(F.lit("https://www.3gpp.org/ftp/Specs/archive/23_series/23."), 1000 + n, F.lit("/"))).when(n % 4 == 2, F.concat(F.lit("https://www.itu.int/rec/T-REC-X."), 1000 + n, F.lit("/en"))).when(n % 4 == 3, F.concat(F.lit("search:GSMA AD."), n))
    links = F.when(n % 4 == 1, F.array(F.lit("a.zip"), F.lit("b.zip"), F.lit("z.txt"))).when(n % 4 == 2, F.when(n % 3 == 2, F.array(F.lit("/about"), F.lit("t.pdf"))).otherwise(F.array(F.lit("/about"))))
    links = F.coalesce(links, F.when(n % 3 == 2, F.array(F.lit("https://x/first"), F.concat(F.lit("https://x/"), n, F.lit(".PDF")))).otherwise(F.array(F.lit("https://x/first"))))
    d = table(spark, sf_dir, "documents").select("doc_id", org.alias("org"), code.alias("code"), folder.alias("folder_url"), links.alias("links"))
    listing = d.filter("folder_url is not null and doc_id % 3 <> 0").select("folder_url", F.posexplode("links").alias("pos", "link"))
    return references.resolve(d.select("doc_id", "org", "code"), listing).select("doc_id", "status", "source_url")


@query("WITH RECURSIVE n AS (SELECT count(*) AS n FROM documents), c AS (SELECT doc_id AS a, unnest([2 * doc_id + 1, 2 * doc_id + 2]) AS b FROM documents), r(code, level) AS (SELECT 0::BIGINT, 0 UNION SELECT b, level + 1 FROM r JOIN c ON r.code = c.a, n WHERE b < n) SELECT 'D' AS org, code::VARCHAR AS code, min(level) AS level FROM r GROUP BY ALL")
def crawl_closure(spark, sf_dir):
    """The full closure from document 0 where document a cites 2a + 1 and 2a + 2, as far as they are there."""
    d = table(spark, sf_dir, "documents")
    to = F.explode(F.array(F.col("doc_id") * 2 + 1, F.col("doc_id") * 2 + 2))
    cites = d.select("doc_id", to.alias("to")).filter(F.col("to") < d.count()).select(F.lit("D").alias("org"), F.col("doc_id").cast("string").alias("code"), F.lit("D").alias("to_org"), F.col("to").cast("string").alias("to_code"))
    return references.crawl(values(spark, [("D", "0")], "org string, code string"), cites)


# ---------------------------------------------------------------- questions

QUESTIONS = [
    (1, "QUIC hangi RFC'de tanımlanır?"), (2, "N3 referans noktasının görevi nedir?"), (3, "PDU session nasıl kapatılıyor?"), (4, "roamingde hangi prosedür var?"), (5, "E.164 numarası kaç basamak?"),
    (6, "Which reference point is between AMF and SMF?"), (7, "AMF UE context transfer nasıl çalışıyor?"), (8, "What does RFC 9110 say about idempotent methods?"), (9, "3GPP TS 23.502'de UE kaydı nedir?"),
    (10, "ETSI TS 123 041 when is it used; and why?"), (11, "Şebekeden kendi isteğiyle nasıl çıkılır?"), (12, "  "), (13, "N1 sinyalleşme referans noktası UE ile AMF arasında mı?"), (14, "How many bits? How long?"), (15, "SMS"),
]


def question_table(spark):
    return values(spark, QUESTIONS, "id int, question string")


@query()
def answer_type(spark, sf_dir):
    """Unicode classes that DuckDB's patterns don't have; tested against expected values."""
    return questions.understand(question_table(spark))


#: A question for each document, with a document's name in one of several spellings, and the document's source.
ASKED_SQL = """SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'What does RFC ' || (1000 + doc_id % 9000) || ' say' WHEN 1 THEN '3gpp ts 23.' || (100 + doc_id % 900) || ' in short' WHEN 2 THEN 'ETSI TS 1' || (10 + doc_id % 90) || ' ' || (100 + doc_id % 900) || ' scope'
  WHEN 3 THEN 'is tr 38-' || (100 + doc_id % 900) || ' or TS 1' WHEN 4 THEN 'RFC12 and rfc-' || (100 + doc_id % 900) ELSE 'nothing named ' END || ' ' || coalesce(source, '') AS question FROM documents"""


def asked_documents(spark, sf_dir):
    d, n = table(spark, sf_dir, "documents"), F.col("doc_id")
    parts = [
        F.concat(F.lit("What does RFC "), 1000 + n % 9000, F.lit(" say")), F.concat(F.lit("3gpp ts 23."), 100 + n % 900, F.lit(" in short")), F.concat(F.lit("ETSI TS 1"), 10 + n % 90, F.lit(" "), 100 + n % 900, F.lit(" scope")),
        F.concat(F.lit("is tr 38-"), 100 + n % 900, F.lit(" or TS 1")), F.concat(F.lit("RFC12 and rfc-"), 100 + n % 900), F.lit("nothing named "),
    ]
    said = F.when(n % 6 == 0, parts[0])
    for k, x in enumerate(parts[1:], 1):
        said = said.when(n % 6 == k, x)
    return d.select("doc_id", F.concat(said, F.lit(" "), F.coalesce("source", F.lit(""))).alias("question"))


@query(
    f"""WITH q AS ({ASKED_SQL}), m AS (SELECT doc_id, regexp_extract(question, '(?i)\\bRFC\\s*[-:]?\\s*(\\d{{3,5}})\\b', 1) AS rfc,
  regexp_extract(question, '(?i)\\b(3GPP|ETSI)\\s+(TS|TR)\\s+(\\d{{2,3}})\\s*([.\\-_ ]?)\\s*(\\d{{3}})\\b', ['o', 'k', 'a', 's', 'b']) AS n, regexp_extract(question, '(?i)\\b(TS|TR)\\s+(\\d{{2}})\\s*[.\\-_ ]\\s*(\\d{{3}})\\b', ['k', 'a', 'b']) AS p FROM q)
SELECT doc_id, CASE WHEN rfc <> '' THEN 'IETF' WHEN n.o <> '' THEN upper(n.o) WHEN p.k <> '' THEN '3GPP' END AS org,
  CASE WHEN rfc <> '' THEN rfc WHEN n.o <> '' THEN upper(n.k) || ' ' || n.a || CASE WHEN upper(n.o) = '3GPP' OR n.s = '.' THEN '.' ELSE ' ' END || n.b WHEN p.k <> '' THEN upper(p.k) || ' ' || p.a || '.' || p.b END AS code FROM m"""
)
def doc_constraint(spark, sf_dir):
    """Over a question for each document."""
    return asked_documents(spark, sf_dir).select("doc_id", questions.document_constraint(F.col("question")).alias("d")).select("doc_id", "d.org", "d.code")


@query()
def query_variants(spark, sf_dir):
    """Q2 Q2a Q2b Q2c J13."""
    return question_table(spark).select("id", F.posexplode(questions.query_variants(F.col("question"))).alias("variant_no", "variant"))


@query("SELECT b.item_id, (length(text) - length(replace(text, '.', '')))::INTEGER AS dots FROM benchmark b")
def predicate_counts(spark, sf_dir):
    """How often a mark stands in a text."""
    return table(spark, sf_dir, "benchmark").select("item_id", F.regexp_count("text", F.lit(r"\.")).alias("dots"))


# ---------------------------------------------------------------- evidence

STOPPED = ", ".join(map(quoted, rules.STOP_WORDS))
WORDS_SQL = f"list_distinct(list_filter(list_transform(list_concat(regexp_extract_all({{0}}, '{rules.WORD}'), regexp_extract_all({{0}}, '{rules.SLASHED}', 1), regexp_extract_all({{0}}, '{rules.SLASHED}', 2), regexp_extract_all({{0}}, '{rules.SLASHED}')), lambda w: lower(w)), lambda w: w NOT IN ({STOPPED})))"
SENTENCE_SQL = r"""
WITH s AS (
  SELECT doc_id, trim(unnest(p)) AS sentence, generate_subscripts(p, 1) - 1 AS seq
  FROM (SELECT doc_id, regexp_split_to_array(regexp_replace(text, '([.!?])\s+', '\1' || chr(10), 'g'), '\n+') AS p FROM documents)
), w AS (SELECT *, """ + WORDS_SQL.format("sentence") + " AS sw FROM s WHERE sentence <> ''), q AS (SELECT item_id AS question, " + WORDS_SQL.format("text") + """ AS qw FROM benchmark),
f AS (SELECT question, doc_id, seq, sentence, len(list_intersect(sw, qw)) AS common FROM w, q)"""  # fmt: skip


def all_sentences(spark, sf_dir):
    """The sentences of all documents, and all items of the benchmark as questions."""
    d = documents(spark, sf_dir).select("doc_id", F.posexplode_outer(evidence.sentences(F.col("text"))).alias("seq", "sentence")).filter("sentence is not null")
    q = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("question"), evidence.words(F.col("text")).alias("words"))
    return d.withColumn("words", evidence.words(F.col("sentence"))), q


@query(SENTENCE_SQL + " SELECT question, doc_id, count(*) AS n, sum(common)::BIGINT AS common, round(max(1.5 * least(common, 6) + 2.5), 6)::DOUBLE AS best FROM f GROUP BY ALL")
def sentence_score(spark, sf_dir):
    """Every item and document, so a row for each pair: the items are the stated queries, searched in blocks."""
    return evidence.document_scores(*all_sentences(spark, sf_dir))


@query(SENTENCE_SQL + r""", b AS (SELECT question, lower(trim(regexp_replace(sentence, '\s+', ' ', 'g'))) AS k, max(1.5 * least(common, 6))::DOUBLE AS score FROM f GROUP BY ALL)
SELECT question, score, rank FROM (SELECT question, score, row_number() OVER (PARTITION BY question ORDER BY score DESC) AS rank FROM b) WHERE rank <= 3""")
def supporting_facts(spark, sf_dir):
    """The best sentences of all documents for every item."""
    s = evidence.best_sentences(*all_sentences(spark, sf_dir)).withColumn("score", 1.5 * F.col("common")).withColumn("place", F.struct("doc_id", "seq"))
    return evidence.supporting_facts(s, seq="place").select("question", "score", "rank")


CUED = " ".join(f"WHEN {i} THEN CASE WHEN " + " OR ".join(f"contains(lower(sentence), {quoted(x)})" for x in parts) + f" THEN {n} ELSE 0 END" for i, (parts, n) in enumerate(rules.SENTENCE_CUES.values()))


@query(SENTENCE_SQL.split(", w AS")[0] + f" SELECT doc_id, seq::INTEGER AS seq, (CASE doc_id % {len(rules.SENTENCE_CUES)} {CUED} END)::DOUBLE AS cue FROM (SELECT doc_id, seq, sentence || CASE seq % 3 WHEN 0 THEN ' The reference point of this function.' WHEN 1 THEN ' a Request message in the System ' ELSE '' END AS sentence FROM s WHERE sentence <> '')")
def sentence_cues(spark, sf_dir):
    """Q5: what a sentence's words add for each answer type, over all sentences of all documents (with some words of the rules put behind)."""
    names = list(rules.SENTENCE_CUES)
    d = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.transform(F.split(F.coalesce("text", F.lit("")), r"(?<=[.!?])\s+|\n+"), lambda x: F.trim(x))).alias("seq", "sentence")).filter("sentence <> ''")
    more = F.when(F.col("seq") % 3 == 0, " The reference point of this function.").when(F.col("seq") % 3 == 1, " a Request message in the System ").otherwise("")
    kind = F.element_at(F.array(*map(F.lit, names)), (F.col("doc_id") % len(names) + 1).cast("int"))
    return d.select("doc_id", "seq", evidence.cue(kind, F.concat("sentence", more)).alias("cue"))


MENTIONS = [(1, "a", 1, 2.0, False), (1, "a", 2, 5.0, True), (1, "a", 3, 1.0, False), (1, "b", 1, 6.0, False), (2, "c", 1, 8.5, True), (2, "d", 4, 7.0, True), (3, "e", 2, 4.5, True), (3, "f", 1, 4.4, True)]
FOLD = "WITH m AS (SELECT * FROM " + values_sql(MENTIONS, "question, candidate, seq, score, strong") + "), l AS (SELECT question, candidate, list(score::DOUBLE ORDER BY seq) AS s, bool_or(strong) AS strong, min(seq) AS seq FROM m GROUP BY ALL), r AS (SELECT question, candidate, round(list_reduce(s, lambda a, x: greatest(a, x) + 0.75), 4) AS score, len(s)::INTEGER AS occurrences, strong, seq FROM l), k AS (SELECT *, row_number() OVER (PARTITION BY question ORDER BY score DESC, occurrences DESC, seq, candidate) AS rank FROM r)"


@query(FOLD + " SELECT * FROM k")
def candidate_fold(spark, sf_dir):
    """A4 T3."""
    return evidence.folded_scores(values(spark, MENTIONS, "question int, candidate string, seq int, score double, strong boolean"))


#: The documents of a source are the mentions of a question's candidates, their languages: of five types, in order of doc_id.
ALL_MENTIONS = """WITH m AS (SELECT source AS question, lang AS candidate, doc_id AS seq, round(length(text) % 97 / 10.0, 4)::DOUBLE AS score, doc_id % 3 = 0 AS strong FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL),
l AS (SELECT question, candidate, list(score ORDER BY seq) AS s, bool_or(strong) AS strong, min(seq) AS seq FROM m GROUP BY ALL),
r AS (SELECT question, candidate, round(list_reduce(s, lambda a, x: greatest(a, x) + 0.75), 4) AS score, len(s)::INTEGER AS occurrences, strong, seq FROM l),
k AS (SELECT *, row_number() OVER (PARTITION BY question ORDER BY score DESC, occurrences DESC, seq, candidate) AS rank, CASE WHEN length(question) % 2 = 0 THEN 'PROSEDÜR' ELSE 'STANDART / DOKÜMAN' END AS answer_type FROM r)"""


@query(
    ALL_MENTIONS
    + """, t AS (SELECT a.question, a.candidate, a.score, a.strong OR a.answer_type = 'PROSEDÜR' AS sure, a.answer_type, a.occurrences, b.occurrences AS others, round(a.score - coalesce(b.score, 0), 4) AS margin FROM k a LEFT JOIN k b ON a.question = b.question AND b.rank = 2 WHERE a.rank = 1),
c AS (SELECT *, CASE WHEN score >= 7 AND (margin >= 1 OR answer_type = 'STANDART / DOKÜMAN' AND abs(margin) < 0.001 AND occurrences >= coalesce(others, 0) + 2) AND sure THEN 'high' WHEN score >= 4 AND sure THEN 'medium' ELSE 'low' END AS confidence FROM t)
SELECT question, CASE WHEN confidence = 'low' THEN '' ELSE candidate END AS primary_answer, confidence, margin FROM c"""
)
def answer_confidence(spark, sf_dir):
    """Q9 W6 A4 T3 over all documents: a source's candidates are its documents' languages."""
    d = table(spark, sf_dir, "documents").filter("source is not null and lang is not null")
    m = d.select(F.col("source").alias("question"), F.col("lang").alias("candidate"), F.col("doc_id").alias("seq"), F.round(F.length("text") % 97 / 10.0, 4).alias("score"), (F.col("doc_id") % 3 == 0).alias("strong"))
    kind = F.when(F.length("question") % 2 == 0, "PROSEDÜR").otherwise("STANDART / DOKÜMAN")
    return evidence.confidence(evidence.folded_scores(m).withColumn("answer_type", kind))


@query(
    """WITH d AS (SELECT doc_id, (100 + doc_id % 400)::VARCHAR AS code, (100 + doc_id % 3 * 7)::VARCHAR AS other, 'QX' || doc_id % 11 AS name, 'QX' || doc_id % 7 AS seen FROM documents),
c AS (SELECT *, CASE doc_id % 5 WHEN 0 THEN list_filter([name, code, other], lambda x: x <> code AND x <> seen) WHEN 1 THEN CASE WHEN name = seen THEN [] ELSE [name] END ELSE [] END AS claims FROM d)
SELECT doc_id, CASE doc_id % 5 WHEN 4 THEN false WHEN 3 THEN doc_id % 2 = 0 WHEN 2 THEN false ELSE len(claims) = 0 END AS valid, array_to_string(claims, ',') AS claims, CASE WHEN doc_id % 5 = 3 THEN '5G System' ELSE '' END AS terms FROM c"""
)
def answer_guard(spark, sf_dir):
    """Q12 Q13: a reply for each document: codes and names that its evidence has or not, a document as answer, a system's name, and none."""
    n = F.col("doc_id")
    code, other = (100 + n % 400).cast("string"), (100 + n % 3 * 7).cast("string")
    name, seen = F.concat(F.lit("QX"), n % 11), F.concat(F.lit("QX"), n % 7)
    question = F.when(n % 5 == 3, "Hangi sistem?").when(n % 5 == 2, "amf ne yapar?").otherwise("neler var?")
    reply = F.when(n % 5 == 0, F.concat(name, F.lit(" ile "), code, F.lit(" ve "), other, F.lit(" olur."))).when(n % 5 == 1, F.concat(name, F.lit(" olur."))).when(n % 5 == 2, "amf standart RFC 9000 budur.").when(n % 5 == 3, F.when(n % 2 == 0, "Bu 5GS olur.").otherwise("bilinmeyen bir şey.")).otherwise(" ")
    evidence_ = F.concat(F.when(n % 5 == 3, "the 5G System is used. ").otherwise(""), seen, F.lit(" "), code, F.lit(" RFC 9000"))
    d = table(spark, sf_dir, "documents").select("doc_id", guard.validated(question, reply, evidence_).alias("v"))
    return d.select("doc_id", "v.valid", F.array_join("v.unsupported_claims", ",").alias("claims"), F.array_join("v.evidence_terms", ",").alias("terms"))


@query(
    """WITH h AS (SELECT doc_id // 4 AS question, lower(text || ' ' || coalesce(lang, '') || ' ' || coalesce(source, '') || ' ' || t) AS hay, t, doc_id // 4 % 3 = 0 AS free, source = 'src' || (doc_id // 4 % 7) AS same, doc_id // 4 % 2 = 0 AS anyway FROM (SELECT *, CASE doc_id % 3 WHEN 0 THEN 'References' WHEN 1 THEN 'Scope' ELSE 'Foreword' END AS t FROM documents))
SELECT question, coalesce(max(CASE WHEN t = 'Scope' THEN (free OR coalesce(same, false))::INTEGER END) = 1 AND max(CASE WHEN t = 'Scope' THEN (anyway OR contains(hay, 'qu') OR contains(hay, 'en'))::INTEGER END) = 1, false) AS usable FROM h GROUP BY question"""
)
def evidence_gate(spark, sf_dir):
    """Four documents are the hits of a question; some questions name a document, some have anchors."""
    d = table(spark, sf_dir, "documents").withColumn("question", F.expr("doc_id div 4"))
    title = F.when(F.col("doc_id") % 3 == 0, "References").when(F.col("doc_id") % 3 == 1, "Scope").otherwise("Foreword")
    named = F.when(F.col("question") % 3 != 0, F.struct(F.coalesce("lang", F.lit("")).alias("org"), F.concat(F.lit("SRC"), F.col("question") % 7).alias("code")))
    anchors = F.when(F.col("question") % 2 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("qu"), F.lit("en")))
    hits = d.select("question", "text", F.coalesce("lang", F.lit("")).alias("org"), F.coalesce("source", F.lit("")).alias("code"), title.alias("clause_title"), anchors.alias("anchors"), named.alias("document"))
    return results.usable_evidence(hits)


#: An evaluation case for each document: its text is the reply, its source the document that is expected.
CASE_SQL = f"""SELECT doc_id AS id, {FOLD_SQL.format('text')} AS r, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE 'src' || (doc_id % 3) END AS doc, CASE WHEN doc_id % 2 = 0 THEN 'en' END AS clause, source, lang, doc_id % 4 = 0 AS none, doc_id % 9 = 0 AS silent FROM documents"""


def evaluation_cases(spark, sf_dir):
    d, n = table(spark, sf_dir, "documents"), F.col("doc_id")
    groups = lambda *g: F.array(*[F.array(*map(F.lit, x)) for x in g])
    return d.select(
        n.alias("id"), F.col("text").alias("reply"), F.when(n % 4 == 0, F.array().cast("array<struct<code:string,clause:string>>")).otherwise(F.array(F.struct(F.col("source").alias("code"), F.col("lang").alias("clause")))).alias("sources"),
        F.when(n % 5 != 0, F.concat(F.lit("src"), n % 3)).alias("expected_document"), F.when(n % 2 == 0, "en").alias("expected_clause"), groups(["th", "xq"], ["An"]).alias("required_fact_groups"), groups(["zz", "ou  e"]).alias("forbidden_claim_groups"), (n % 9 == 0).alias("should_abstain"),
    )


CHECKED_SQL = f"""WITH c AS ({CASE_SQL}), k AS (SELECT id, doc IS NULL OR NOT none AND coalesce(source = doc AND (clause IS NULL OR coalesce(lang = clause, false)), false) AS source_ok,
  (contains(r, 'th') OR contains(r, 'xq')) AND contains(r, 'an') AS facts_ok, NOT (contains(r, 'zz') OR contains(r, 'ou e')) AS forbidden_ok, NOT silent OR none AND contains(r, 'bulunamad') AS abstain_ok FROM c)
SELECT *, source_ok AND facts_ok AND forbidden_ok AND abstain_ok AS passed FROM k"""


@query(CHECKED_SQL)
def eval_checks(spark, sf_dir):
    """Over a case for each document."""
    return evidence.evaluated(evaluation_cases(spark, sf_dir))


@query(f"SELECT count(*) AS n_cases, count(*) FILTER (passed) AS n_passed, coalesce(round(avg(passed::INTEGER::DOUBLE), 6), 0.0) AS rate FROM ({CHECKED_SQL})")
def eval_rate(spark, sf_dir):
    """A9."""
    return evidence.pass_rate(eval_checks(spark, sf_dir))


@query(
    """WITH c AS (SELECT CASE WHEN doc_id % 50 = 3 THEN ' ' ELSE (doc_id // 2 * 2 + doc_id % 2 * (doc_id % 10 <> 1)::INTEGER)::VARCHAR END AS id, coalesce(trim(text), '') = '' AS no_question, coalesce(source, '') = '' AS no_category, doc_id FROM documents),
k AS (SELECT id, list_filter([CASE WHEN id = ' ' THEN 'id is blank' END, CASE WHEN no_category THEN 'category is blank' END, CASE WHEN no_question THEN 'question is blank' END, CASE WHEN doc_id % 7 = 0 THEN 'required_fact_groups is missing' END,
  CASE WHEN doc_id % 7 = 1 THEN 'required_fact_groups has an empty group' END, CASE WHEN doc_id % 7 = 2 THEN 'required_fact_groups has a blank phrase' END, CASE WHEN count(*) OVER (PARTITION BY id) > 1 THEN 'id repeats' END], lambda x: x IS NOT NULL) AS f FROM c)
SELECT id, array_to_string(f, '; ') AS faults FROM k"""
)
def case_faults(spark, sf_dir):
    """Q17: over a case for each document, some with faults."""
    d, n = table(spark, sf_dir, "documents"), F.col("doc_id")
    groups = F.when(n % 7 == 1, F.array(F.array(F.lit("a")), F.array().cast("array<string>"))).when(n % 7 == 2, F.array(F.array(F.lit("a"), F.lit(" ")))).when(n % 7 != 0, F.array(F.array(F.lit("a"))))
    name = F.when(n % 50 == 3, " ").otherwise((F.floor(n / 2) * 2 + n % 2 * (n % 10 != 1).cast("int")).cast("string"))
    cases = d.select(name.alias("id"), F.col("source").alias("category"), F.col("text").alias("question"), groups.alias("required_fact_groups"), F.array(F.array(F.lit("x"))).alias("forbidden_claim_groups"), F.lit(False).alias("should_abstain"))
    return evidence.case_faults(cases).select("id", F.array_join("faults", "; ").alias("faults"))


@query("SELECT list_sort(list(DISTINCT source) FILTER (source IS NOT NULL)) AS categories FROM documents")
def case_categories(spark, sf_dir):
    """A13."""
    return evidence.categories(table(spark, sf_dir, "documents").select(F.col("source").alias("category")))


@query(
    KNN_SQL
    + """, r AS (SELECT variant, min(rank) AS rank FROM hits JOIN embeddings e ON e.vec_id = chunk_id WHERE rank <= 10 AND e.label = variant // 20 % 4 AND (variant % 40 = 0 OR e.vec_id % 3 = 1) GROUP BY variant)
SELECT q.variant AS name, r.rank, CASE WHEN r.rank IS NULL THEN 'missing' WHEN r.rank <= 3 THEN 'good' ELSE 'found' END AS verdict FROM q LEFT JOIN r USING (variant)"""
)
def retrieval_ranks(spark, sf_dir):
    """V7: every stated query expects a label, every other one also a clause."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("label").cast("string").alias("code"), (F.col("vec_id") % 3).cast("string").alias("clause"))
    hits = variant_hits(spark, sf_dir).join(e, "chunk_id").select(F.col("variant").alias("name"), "rank", "code", "clause")
    asked = table(spark, sf_dir, "embeddings").filter("vec_id % 20 = 0")
    clause = F.when(F.col("vec_id") % 40 != 0, F.array(F.lit("1"))).otherwise(F.array().cast("array<string>"))
    cases = asked.select(F.col("vec_id").alias("name"), F.array(F.expr("cast(vec_id div 20 % 4 as string)")).alias("expected_codes"), clause.alias("expected_clauses"))
    return answering.found_at(cases, hits)


# ---------------------------------------------------------------- conversations

CONV_SQL = r"""SELECT conv_id, CASE WHEN length(q) > 58 THEN q[1:58] || '…' ELSE q END AS title, n_messages, last_turn FROM (
SELECT conv_id, trim(regexp_replace(coalesce(arg_min(text, turn) FILTER (role = 'user'), ''), '\s+', ' ', 'g')) AS q, count(*) AS n_messages, max(turn) AS last_turn FROM conversations GROUP BY conv_id)"""


@query(CONV_SQL)
def conversation_history(spark, sf_dir):
    """Q18 T6 S15."""
    return history.conversations(table(spark, sf_dir, "conversations"))


@query(f"SELECT * FROM ({CONV_SQL}) ORDER BY last_turn DESC, conv_id LIMIT 20")
def conversation_recent(spark, sf_dir):
    """The feature is a limit."""
    return history.recent(conversation_history(spark, sf_dir), "last_turn", "conv_id", 20)


@query("SELECT conv_id, turn, role, text FROM conversations WHERE conv_id <> 3 UNION ALL SELECT conv_id, max(turn) + 1, 'user', 'one more' FROM conversations WHERE conv_id IN (1, 2) GROUP BY conv_id")
def conversation_edit(spark, sf_dir):
    """Q19: one conversation deleted, a message appended to two."""
    c = table(spark, sf_dir, "conversations")
    new = values(spark, [(1, 0, "user", "one more"), (2, 0, "user", "one more")], "conv_id long, turn long, role string, text string")
    return history.appended(history.deleted(c, "conv_id", F.lit(3)), new)


@query("SELECT conv_id % 10 AS user, (row_number() OVER (PARTITION BY conv_id % 10 ORDER BY conv_id) - 1)::INTEGER AS pos, conv_id::VARCHAR AS id, count(*) AS n_messages, sum(length(text))::BIGINT AS n_chars FROM conversations GROUP BY conv_id")
def saved_histories(spark, sf_dir):
    """The histories of ten users written as JSON and read again, with values that are no histories among them."""
    c = table(spark, sf_dir, "conversations")
    told = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda m: F.struct(m["turn"].cast("long").alias("id"), m["role"].alias("role"), m["text"].alias("content")))
    each = c.groupBy("conv_id").agg(told.alias("messages"), F.max("turn").cast("string").alias("updatedAt"))
    each = each.select((F.col("conv_id") % 10).alias("user"), F.col("conv_id").alias("pos"), F.col("conv_id").cast("string").alias("id"), F.lit("t").alias("title"), F.lit("0").alias("createdAt"), "updatedAt", "messages")
    odd = values(spark, [(100, "not json"), (101, '{"id": 1}'), (102, None), (103, "[]"), (104, "[1, ")], "user long, value string")
    got = history.loaded(history.saved(each).unionByName(odd))
    return got.select("user", "pos", "id", F.size("messages").cast("long").alias("n_messages"), F.aggregate("messages", F.lit(0).cast("long"), lambda n, m: n + F.length(m["content"])).alias("n_chars"))


# ---------------------------------------------------------------- gates


@query("SELECT doc_id, ((contains(h, 'sp-')::INTEGER + contains(h, 'rp-')::INTEGER + contains(h, 'cp-')::INTEGER + contains(h, 'gp-')::INTEGER + contains(h, 'meeting #')::INTEGER + contains(h, '3gpp tsg-')::INTEGER) >= 2) AS contribution FROM (SELECT doc_id, lower(array_to_string(string_split(text, chr(10))[1:50], chr(10))) AS h FROM documents)")
def meeting_contributions(spark, sf_dir):
    """F10 A10."""
    return table(spark, sf_dir, "documents").select("doc_id", gates.is_meeting_contribution(F.col("text")).alias("contribution"))


@query(
    """WITH d AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'RFC ' || doc_id WHEN 1 THEN '3gpp TS 23.' || (100 + doc_id % 900) WHEN 2 THEN 'ETSI tr  102.' || doc_id WHEN 3 THEN ' rfc   7 ' ELSE 'RFC x' END AS answer,
  CASE doc_id % 4 WHEN 0 THEN 'Scope and overview' WHEN 1 THEN 'Normative References' WHEN 2 THEN 'Introduction to scope' END AS title, lower(CASE WHEN doc_id % 3 = 0 THEN 'The present document  Describes ' ELSE '' END || coalesce(text, '')) AS t FROM documents)
SELECT doc_id, CASE WHEN doc_id % 5 IN (0, 3) THEN 'IETF' WHEN doc_id % 5 = 1 THEN '3GPP' WHEN doc_id % 5 = 2 THEN 'ETSI' END AS org, CASE doc_id % 5 WHEN 0 THEN doc_id::VARCHAR WHEN 1 THEN 'TS 23.' || (100 + doc_id % 900) WHEN 2 THEN 'TR 102.' || doc_id WHEN 3 THEN '7' END AS code,
  (CASE WHEN doc_id % 4 IN (0, 2) THEN 17 WHEN doc_id % 4 = 1 THEN -10 ELSE 0 END + CASE WHEN doc_id % 3 = 0 THEN 10 ELSE 0 END)::DOUBLE AS quality FROM d"""
)
def document_sources(spark, sf_dir):
    """Q8g Q8h: what document an answer is, and how well a clause introduces one, for an answer and clause for each document."""
    n = F.col("doc_id")
    answer = F.when(n % 5 == 0, F.concat(F.lit("RFC "), n)).when(n % 5 == 1, F.concat(F.lit("3gpp TS 23."), 100 + n % 900)).when(n % 5 == 2, F.concat(F.lit("ETSI tr  102."), n)).when(n % 5 == 3, " rfc   7 ").otherwise("RFC x")
    title = F.when(n % 4 == 0, "Scope and overview").when(n % 4 == 1, "Normative References").when(n % 4 == 2, "Introduction to scope")
    text = F.concat(F.when(n % 3 == 0, "The present document  Describes ").otherwise(""), F.coalesce("text", F.lit("")))
    d = table(spark, sf_dir, "documents").select("doc_id", gates.document_identity(answer).alias("d"), gates.source_quality(title, text).alias("quality"))
    return d.select("doc_id", "d.org", "d.code", "quality")


KINDS = ["PROSEDÜR", "MESAJ", "STANDART / DOKÜMAN", "PROTOKOL", "DEĞER / LİMİT", "GENEL TEKNİK BİLGİ"]
REPLY_SQL = " ".join(f"WHEN {k} THEN " + quoted(rules.ANSWER_SENTENCES[x]).replace("%s", "' || a || '") for k, x in enumerate(KINDS) if x in rules.ANSWER_SENTENCES)


@query(
    f"""WITH d AS (SELECT doc_id, trim(regexp_replace(coalesce(source, '') || '  ' || doc_id % 40, '\\s+', ' ', 'g')) AS a, doc_id % 3 = 0 AS sure FROM documents),
r AS (SELECT doc_id, a, sure, CASE WHEN sure THEN CASE doc_id % 6 {REPLY_SQL} END END AS reply FROM d)
SELECT doc_id, reply, sure AND reply IS NOT NULL AS now, CASE WHEN doc_id % 6 = 4 THEN reply IS NULL OR NOT sure ELSE false END AS second_search FROM r"""
)
def answer_rendering(spark, sf_dir):
    """Q10 F15 F16 F23 Q2d: the sentence of a sure answer of each type, whether it can be given at once, and whether a second search is needed."""
    n = F.col("doc_id")
    kind = F.element_at(F.array(*map(F.lit, KINDS)), (n % 6 + 1).cast("int"))
    level = F.when(n % 3 == 0, "high").otherwise("medium")
    d = table(spark, sf_dir, "documents").select("doc_id", kind.alias("kind"), F.concat(F.coalesce("source", F.lit("")), F.lit("  "), n % 40).alias("answer"), level.alias("level"), F.lit("neye bakılır?").alias("q"))
    d = d.withColumn("reply", gates.rendered(F.col("q"), F.col("kind"), F.col("answer"), F.col("level")))
    again = gates.needs_second_search(F.col("q"), F.col("kind"), F.col("level"), F.col("answer"), F.col("reply").isNotNull())
    return d.select("doc_id", "reply", gates.can_answer_now(F.col("level"), F.col("reply").isNotNull(), F.coalesce("reply", F.lit(""))).alias("now"), again.alias("second_search"))


@query(
    """WITH d AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'AMF' WHEN 1 THEN 'SMF' WHEN 2 THEN '' ELSE 'NRF' END AS nf, CASE WHEN doc_id % 5 = 0 THEN 'TR 1' ELSE 'TS 1' END AS c1, CASE doc_id % 3 WHEN 0 THEN 'SMF CLAUSE' WHEN 1 THEN 'AMF' ELSE 'GENERAL' END AS t1,
  CASE WHEN doc_id % 11 = 0 THEN NULL ELSE doc_id % 7 END AS b1, doc_id % 6 AS b2, doc_id % 13 = 0 AS no1, doc_id % 17 = 0 AS no2 FROM documents)
SELECT doc_id, CASE WHEN no2 THEN false WHEN no1 THEN true WHEN c1 = 'TR 1' THEN true WHEN nf <> '' AND NOT contains(t1, nf) AND (contains(t1, 'AMF') AND nf <> 'AMF' OR contains(t1, 'SMF') AND nf <> 'SMF') THEN true ELSE coalesce(b2 >= b1, true) END AS wins FROM d"""
)
def evidence_arbitration(spark, sf_dir):
    """The first and the second search's best hit of a question for each document."""
    n, hit = F.col("doc_id"), "struct<code:string,clause_title:string,best:double>"
    question = F.concat(F.lit("what does "), F.when(n % 4 == 0, "AMF").when(n % 4 == 1, "smf").when(n % 4 == 2, "it").otherwise("NRF"), F.lit(" do"))
    first = F.struct(F.when(n % 5 == 0, "TR 1").otherwise("TS 1").alias("code"), F.when(n % 3 == 0, "SMF clause").when(n % 3 == 1, "AMF").otherwise("General").alias("clause_title"), F.when(n % 11 != 0, (n % 7).cast("double")).alias("best")).cast(hit)
    second = F.struct(F.lit("TS 2").alias("code"), F.lit("x").alias("clause_title"), (n % 6).cast("double").alias("best")).cast(hit)
    d = table(spark, sf_dir, "documents").select("doc_id", question.alias("q"), F.when(n % 13 != 0, first).alias("a"), F.when(n % 17 != 0, second).alias("b"))
    return d.select("doc_id", gates.second_wins(F.col("q"), F.col("a"), F.col("b")).alias("wins"))


@query("SELECT 1 AS id, 'N1|reference point' AS queries UNION ALL SELECT 2, 'reference point between|AMF|SMF;reference point|AMF|SMF;AMF|SMF|reference point' UNION ALL SELECT 3, 'Reference point between|AMF;Reference points|AMF;(R)AN|AMF;NG-RAN|AMF;N2|AMF' UNION ALL SELECT 4, NULL")
def reference_point_queries(spark, sf_dir):
    """L6 L9."""
    rows = [(1, "N1 reference point between UE and AMF"), (2, "AMF SMF between the reference point"), (3, "NG-RAN AMF"), (4, "x")]
    q = lexical.reference_point_queries(F.col("question"))
    return values(spark, rows, "id int, question string").select("id", F.array_join(F.transform(q, lambda x: F.array_join(x, "|")), ";").alias("queries"))


# ---------------------------------------------------------------- contexts and clauses


@query("SELECT doc_id, CASE WHEN strpos(lower(text), 'the ') > 0 THEN substr(text, greatest(strpos(lower(text), 'the ') - 180, 1)::BIGINT, (least(strpos(lower(text), 'the ') - 1, 180) + 4 + 180)::BIGINT) END AS context FROM documents")
def character_window(spark, sf_dir):
    """W5."""
    return table(spark, sf_dir, "documents").select("doc_id", contexts.around(F.col("text"), F.lit("the ")).alias("context"))


@query(r"""WITH p AS (SELECT item_id, list_filter(list_transform(regexp_split_to_array(regexp_replace(text, '([.!?])\s+', '\1' || chr(10), 'g'), '\n+'), lambda x: trim(x)), lambda x: x <> '') AS s FROM benchmark)
SELECT item_id, (i - 1)::INTEGER AS seq, array_to_string(s[greatest(i - 1, 1):i + 1], ' ') AS window_text FROM (SELECT item_id, s, unnest(range(1, len(s) + 1)) AS i FROM p)""")
def sentence_window(spark, sf_dir):
    """W4 Q4."""
    b = table(spark, sf_dir, "benchmark").select("item_id", evidence.sentences(F.col("text")).alias("s"))
    each = b.select("item_id", "s", F.posexplode("s").alias("seq", "x"))
    return each.select("item_id", "seq", contexts.neighbours(F.col("s"), F.col("seq")).alias("window_text"))


@query(
    """WITH d AS (SELECT doc_id, doc_id // 8 AS question, CASE WHEN doc_id % 2 = 0 THEN '3GPP TS 23.' ELSE 'RFC ' END || (100 + doc_id % 8 // 2) AS candidate, CASE doc_id % 4 WHEN 0 THEN 'TS 23.10' WHEN 1 THEN 'rfc' WHEN 2 THEN '3gpp ts 23.101' ELSE 'RFC 103' END AS ref FROM documents),
c AS (SELECT DISTINCT question, candidate FROM d)
SELECT c.question, candidate, count(*) AS n FROM c JOIN d USING (question) WHERE contains(lower(c.candidate), lower(d.ref)) OR contains(regexp_replace(lower(c.candidate), '^3gpp ', ''), lower(d.ref)) GROUP BY ALL""".replace("SELECT c.question, candidate, count", "SELECT c.question, c.candidate, count")
)
def document_mentions(spark, sf_dir):
    """Eight documents in order name a question's candidates and what its sources refer to."""
    d, n = table(spark, sf_dir, "documents"), F.col("doc_id")
    each = d.select(F.expr("doc_id div 8").alias("question"), F.concat(F.when(n % 2 == 0, "3GPP TS 23.").otherwise("RFC "), 100 + F.expr("doc_id % 8 div 2")).alias("candidate"), F.when(n % 4 == 0, "TS 23.10").when(n % 4 == 1, "rfc").when(n % 4 == 2, "3gpp ts 23.101").otherwise("RFC 103").alias("ref"))
    return contexts.mentioned(each.select("question", "ref"), each.select("question", "candidate").distinct())


ENDS = ["AMF", "gNB", "SMF", "NG-RAN", "UPF", "UE"]


@query(
    f"""WITH d AS (SELECT doc_id, {ENDS}[doc_id % 6 + 1] AS a, {ENDS}[doc_id // 6 % 6 + 1] AS b, [['AMF', 'SMF'], ['RAN', 'UPF'], ['UE', 'SMF', 'RAN']][doc_id % 3 + 1] AS e FROM documents),
l AS (SELECT *, list_sort(list_distinct([CASE WHEN a IN ('gNB', 'NG-RAN') THEN 'RAN' ELSE a END, CASE WHEN b IN ('gNB', 'NG-RAN') THEN 'RAN' ELSE b END])) AS ends FROM d)
SELECT doc_id, array_to_string(ends, '|') AS ends, CASE WHEN len(list_intersect(ends, e)) = len(ends) THEN 24 WHEN len(list_intersect(ends, e)) = 1 THEN 4 ELSE 0 END::INTEGER AS score FROM l"""
)
def endpoint_scores(spark, sf_dir):
    """A label of two ends for each document."""
    d, n = table(spark, sf_dir, "documents"), F.col("doc_id")
    names = F.array(*map(F.lit, ENDS))
    label = F.concat(F.element_at(names, (n % 6 + 1).cast("int")), F.when(n % 2 == 0, " / ").otherwise("/"), F.element_at(names, F.expr("int(doc_id div 6 % 6 + 1)")))
    entities = F.when(n % 3 == 0, F.array(F.lit("AMF"), F.lit("SMF"))).when(n % 3 == 1, F.array(F.lit("RAN"), F.lit("UPF"))).otherwise(F.array(F.lit("UE"), F.lit("SMF"), F.lit("RAN")))
    ends = contexts.endpoints(label)
    return d.select("doc_id", F.array_join(ends, "|").alias("ends"), contexts.endpoint_score(ends, entities).alias("score"))


#: Each document as a specification with a table of contents and two clauses, or as an RFC.
@query(
    r"""WITH b AS (SELECT doc_id, 'b ' || trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) AS body FROM documents)
SELECT doc_id, 0 AS clause_no, '1' AS clause, CASE WHEN doc_id % 2 = 0 THEN 'Scope' ELSE 'Introduction' END AS clause_title, sha256(trim(body)) AS body_sha256 FROM b
UNION ALL SELECT doc_id, 1, '4.1', 'General', sha256('closing words') FROM b WHERE doc_id % 2 = 0"""
)
def clause_split(spark, sf_dir):
    """Clauses of a specification or RFC made of each document; tests have the further layouts."""
    d, n = table(spark, sf_dir, "documents"), F.col("doc_id")
    body = F.concat(F.lit("b "), F.regexp_replace(F.regexp_replace(F.coalesce("text", F.lit("")), r"[\t\n\f\r ]+", " "), r"\A\p{Zs}+|\p{Zs}+\z", ""))  # as SQL has \s and trim
    spec = F.concat(F.lit("Contents\n1\tScope\t5\n4.1\tGeneral\t6\n1\tScope\n"), body, F.lit("\n4.1\tGeneral\nclosing words"))
    rfc = F.concat(F.lit("Table of Contents\n1.  Introduction ..... 3\n1.  Introduction\n"), body)
    made = d.select("doc_id", F.when(n % 2 == 0, "3GPP").otherwise("IETF").alias("org"), F.when(n % 2 == 0, spec).otherwise(rfc).alias("text"))
    return clauses.clauses(made).select("doc_id", "clause_no", "clause", "clause_title", F.sha2(F.trim("body"), 256).alias("body_sha256"))


@query()
def answer_prompts(spark, sf_dir):
    """V1 V2 V3 V5 V6 J8 Q11 and all of entry A up to the generator, with the model-free slots: items of the benchmark as questions."""
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("question"), "text")
    d = table(spark, sf_dir, "documents")
    chunks = d.select(F.col("doc_id").alias("chunk_id"), "text", F.col("lang").alias("org"), F.col("source").alias("code"), F.lit("Latest").alias("version"), F.lit("1").alias("clause"), F.lit("Text").alias("clause_title"), F.lit("indexed").alias("status"), F.lit(None).cast("string").alias("source_url"))
    out = answering.prompts(asked, answering.embedded(chunks, "text", "passage: "), threshold=1.2)
    return out.select("question", "answer_type", "has_evidence", F.size("sources").alias("n_sources"), F.length("context").alias("context_chars"))


# ---------------------------------------------------------------- catalog, cache, document checks

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


@query(" UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n_rows FROM {t}" for t in TABLES))
def catalog_counts(spark, sf_dir):
    """Rows of every table, from their files' metadata."""
    out = [table(spark, sf_dir, t).agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(t).alias("table_name"), "n_rows") for t in TABLES]
    while len(out) > 1:
        out = [out[0].union(out[1]), *out[2:]]
    return out[0]


@query("WITH c AS (SELECT DISTINCT sha256(concat_ws('|', upper(trim(lang)), upper(trim(source)))) AS cache_id FROM documents WHERE doc_id % 3 = 0) SELECT lang AS org, source AS code, count(*) AS n, max(c.cache_id IS NOT NULL) AS hit FROM documents d LEFT JOIN c ON sha256(concat_ws('|', upper(trim(lang)), upper(trim(source)))) = c.cache_id GROUP BY ALL")
def cache_probe(spark, sf_dir):
    """Which documents a cache keyed by hash has."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("org"), F.col("source").alias("code")).withColumn("cache_id", ingest.cache_id(F.col("org"), F.col("code")))
    cached = d.filter("doc_id % 3 = 0").select("cache_id").distinct().withColumn("hit", F.lit(True))
    return d.join(cached, "cache_id", "left").groupBy("org", "code").agg(F.count(F.lit(1)).alias("n"), F.max(F.coalesce("hit", F.lit(False))).alias("hit"))


CHECKED_TEXT = "'cover 3gpp ' || CASE WHEN doc_id % 2 = 0 THEN 'ts' ELSE 'TR' END || ' 23.' || (100 + doc_id % 900) || chr(10) || '1.1 x' || chr(10) || CASE WHEN doc_id % 3 = 0 THEN '[1] ' ELSE '' END || coalesce(text, '') || CASE WHEN doc_id % 5 < 2 THEN chr(10) || '1.2 Abbreviations' || chr(10) || 'z' ELSE '' END"


@query(f"""WITH d AS (SELECT doc_id, {CHECKED_TEXT} AS t, 'TS 23.' || (100 + doc_id % 450) AS code, lang, source FROM documents), f AS (SELECT *, strpos(t, '[1] ') AS a FROM d), r AS (SELECT *, CASE WHEN a > 0 THEN substr(t, a) END AS rest FROM f)
SELECT doc_id, upper(CASE WHEN doc_id % 2 = 0 THEN 'ts' ELSE 'tr' END) || ' 23.' || (100 + doc_id % 900) = code AS same, sha256(CASE WHEN rest IS NULL THEN t WHEN strpos(rest, '1.2 Abbreviations') > 0 THEN substr(rest, 1, strpos(rest, '1.2 Abbreviations') - 1) ELSE rest END) AS section_sha256,
  doc_id % 4 = 0 AND doc_id % 3 = 0 AND doc_id % 5 = 0 AS noise FROM r""")
def document_checks(spark, sf_dir):
    """Over all documents with a cover, a reference list and a street address put on some of them."""
    n = F.col("doc_id")
    name = F.when(n % 2 == 0, "ts").otherwise("TR")
    text = F.concat(F.lit("cover 3gpp "), name, F.lit(" 23."), 100 + n % 900, F.lit("\n1.1 x\n"), F.when(n % 3 == 0, "[1] ").otherwise(""), F.coalesce("text", F.lit("")), F.when(n % 5 < 2, "\n1.2 Abbreviations\nz").otherwise(""))
    d = table(spark, sf_dir, "documents").select("doc_id", text.alias("text"), F.concat(F.lit("TS 23."), 100 + n % 450).alias("code"))
    org, clause, title = F.when(n % 4 == 0, "etsi ").otherwise("3GPP"), F.when(n % 3 == 0, "650").otherwise("1"), F.when(n % 5 == 0, "650 Route des Lucioles").otherwise("Scope")
    return d.select("doc_id", gates.is_requested_document(F.col("code"), F.col("text")).alias("same"), F.sha2(gates.reference_section(F.col("text")), 256).alias("section_sha256"), gates.is_cover_noise(org, clause, title).alias("noise"))


# ---------------------------------------------------------------- store


@query("SELECT doc_id, coalesce(source, '') AS code, CASE WHEN doc_id % 3 = 0 THEN 'Latest' ELSE 'v' || doc_id END AS version, coalesce(lang, '') AS org, '' AS source_url FROM documents")
def stored_metadata(spark, sf_dir):
    """metadata with defaults."""
    d, n = table(spark, sf_dir, "documents"), F.col("doc_id")
    none = F.lit(None).cast("string")
    chunks = d.select(n.alias("chunk_id"), "text", F.col("lang").alias("org"), F.col("source").alias("code"), F.when(n % 3 == 1, F.concat(F.lit("v"), n)).when(n % 3 == 2, F.concat(F.lit("v"), n)).when(n % 2 == 0, "").alias("version"), none.alias("clause"), none.alias("clause_title"), F.lit("indexed").alias("status"), none.alias("source_url"))
    return ingest.stored(chunks).select(F.col("chunk_id").alias("doc_id"), "code", "version", "org", "source_url")


@query("WITH k AS (SELECT DISTINCT 'chunk_' || sha256(concat_ws('|', trim(coalesce(source, '')), '', '', trim(coalesce(lang, '')), trim(coalesce(text, '')))) AS chunk_id FROM documents WHERE doc_id % 6 <> 0 AND trim(coalesce(text, '')) <> '') SELECT chunk_id FROM k")
def prepared_chunks(spark, sf_dir):
    """Chunk ids of what is neither void nor blank, each once."""
    d = table(spark, sf_dir, "documents")
    none = F.lit(None).cast("string")
    chunks = d.select(F.col("source").alias("org"), none.alias("code"), none.alias("version"), F.col("lang").alias("clause"), "text", F.when(F.col("doc_id") % 6 == 0, "void").otherwise("indexed").alias("status"))
    return ingest.prepared(chunks).select("chunk_id")


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'new ' || CASE WHEN doc_id % 2 = 0 THEN 2 ELSE 1 END ELSE 'old' END AS text FROM documents UNION ALL SELECT -1 - doc_id, 'new 1' FROM documents WHERE doc_id % 50 = 0")
def upserted_rows(spark, sf_dir):
    """K2: every third row is replaced, by the last of its new versions, and some rows are new."""
    d = table(spark, sf_dir, "documents").select("doc_id")
    new = d.filter("doc_id % 3 = 0").select("doc_id", F.explode(F.when(F.col("doc_id") % 2 == 0, F.array(F.lit(2), F.lit(1))).otherwise(F.array(F.lit(1)))).alias("no"))
    new = new.unionByName(d.filter("doc_id % 50 = 0").select((-1 - F.col("doc_id")).alias("doc_id"), F.lit(1).alias("no"))).withColumn("text", F.concat(F.lit("new "), "no"))
    return ingest.upserted(d.withColumns({"no": F.lit(0), "text": F.lit("old")}), new, "doc_id", "no").select("doc_id", "text")


@query("SELECT doc_id, n_chars FROM documents")
def resumed_store(spark, sf_dir):
    """A store of half the documents is opened again and gets the other half."""
    d, at = table(spark, sf_dir, "documents").select("doc_id", "n_chars"), tables.new_folder(spark, "store")
    ingest.append_missing(spark, d.filter("doc_id % 2 = 0"), at, "doc_id")
    ingest.append_missing(spark, d, at, "doc_id", resume=True)
    return spark.read.parquet(at)


@query(
    """WITH q AS (SELECT doc_id, doc_id % 20 AS page, 'see ts 23.' || (100 + doc_id % 40) || CASE WHEN doc_id % 3 = 0 THEN ' and TS23.10' ELSE '' END AS t FROM documents), c AS (SELECT DISTINCT doc_id % 20 AS page, 'TS 23.' || (100 + doc_id % 60) AS code FROM documents)
SELECT doc_id, list_sort(list(code)) AS named FROM q JOIN c USING (page) WHERE contains(replace(lower(t), ' ', ''), replace(lower(code), ' ', '')) GROUP BY doc_id"""
)
def named_references(spark, sf_dir):
    """Which of its page's references a question for each document names."""
    d, n = table(spark, sf_dir, "documents"), F.col("doc_id")
    asked = d.select("doc_id", (n % 20).alias("page"), F.concat(F.lit("see ts 23."), 100 + n % 40, F.when(n % 3 == 0, " and TS23.10").otherwise("")).alias("text"))
    return contexts.named_in(asked, d.select((n % 20).alias("page"), F.concat(F.lit("TS 23."), 100 + n % 60).alias("code"))).select("doc_id", "named")


KEYS = {"documents": "doc_id", "embeddings": "vec_id", "pages": "page_id", "benchmark": "item_id", "labels": "doc_id", "conversations": "conv_id", "events": "event_id"}


@query(
    " UNION ALL ".join(
        f"SELECT '{t}' AS name, (SELECT count(*) FROM {t})::VARCHAR AS rows, (SELECT count(*) FROM {t} WHERE {k} IS NULL) AS null_keys, (SELECT count(*) FROM (SELECT {k} FROM {t} WHERE {k} IS NOT NULL GROUP BY {k} HAVING count(*) > 1)) AS repeated_keys" for t, k in KEYS.items() if t != "events"
    )
    + " UNION ALL SELECT 'nowhere', 'YOK', 0, 0"
)
def table_integrity(spark, sf_dir):
    """Rows, null keys and repeated keys of the tables, and a table that is missing."""
    found = {t: table(spark, sf_dir, t) for t in KEYS if t != "events"} | {"nowhere": None}
    return ingest.table_report(spark, found, KEYS).select("name", "rows", "null_keys", "repeated_keys")


@query("SELECT doc_id, n_chars FROM documents WHERE doc_id > 100 ORDER BY doc_id LIMIT 1000")
def store_page(spark, sf_dir):
    """The page of a thousand rows behind a key; the limit is the feature."""
    return ingest.page(table(spark, sf_dir, "documents"), ["n_chars"], 100, 1000, "doc_id")


@query(
    """WITH l AS (SELECT page_id % 50 AS query, page_id AS rank, 'https://' || CASE page_id % 4 WHEN 0 THEN 'www.3gpp.org' WHEN 1 THEN 'ietf.org' WHEN 2 THEN 'x3gpp.org' ELSE 'blog.example' END || '/' || page_id AS link FROM pages)
SELECT query, (row_number() OVER (PARTITION BY query ORDER BY rank))::INTEGER AS rank, link FROM l WHERE link LIKE '%//www.3gpp.org/%' OR link LIKE '%//ietf.org/%' QUALIFY row_number() OVER (PARTITION BY query ORDER BY rank) <= 3"""
)
def web_results(spark, sf_dir):
    """A listing of results stands in for the search service; only the standards bodies' sites count."""
    n = F.col("page_id")
    host = F.when(n % 4 == 0, "www.3gpp.org").when(n % 4 == 1, "ietf.org").when(n % 4 == 2, "x3gpp.org").otherwise("blog.example")
    listing = table(spark, sf_dir, "pages").select((n % 50).alias("query"), n.alias("rank"), F.concat(F.lit("https://"), host, F.lit("/"), n).alias("link"))
    return sources.web_results(listing)


@query(
    """WITH RECURSIVE n AS (SELECT count(*) AS n FROM documents), c AS (SELECT doc_id AS a, unnest([2 * doc_id + 1, 2 * doc_id + 2]) AS b FROM documents WHERE doc_id % 10 <> 9 AND doc_id < 90000),
r(a, level) AS (SELECT 0::BIGINT, 0 UNION SELECT b, level + 1 FROM r JOIN c ON r.a = c.a, n WHERE b < n AND b < 90000)
SELECT (1000 + a)::VARCHAR AS code, level, a % 7 = 1 AS cached, a % 10 <> 9 AS has_text, CASE WHEN a % 10 = 9 THEN 0 ELSE (2 * a + 1 < (SELECT n FROM n) AND 2 * a + 1 < 90000)::INTEGER + (2 * a + 2 < (SELECT n FROM n) AND 2 * a + 2 < 90000)::INTEGER END AS n_cited FROM r"""
)
def crawl_pages(spark, sf_dir):
    """Documents that cite two others each, read from pages or replayed from a cache; every tenth has no page."""
    d = table(spark, sf_dir, "documents").select("doc_id").filter("doc_id < 90000")
    n = tables.written(d, "crawled").count()
    to = F.filter(F.array(2 * F.col("doc_id") + 1, 2 * F.col("doc_id") + 2), lambda x: x < n)
    lines = F.array_join(F.transform(to, lambda x: F.concat(F.lit("["), x, F.lit("] IETF RFC "), 1000 + x, F.lit(': "t"'))), "\n")
    text = F.when(F.col("doc_id") % 10 != 9, F.concat(F.lit("References\n[1] x\n"), lines))
    pages = d.select(F.concat(F.lit("https://www.rfc-editor.org/rfc/rfc"), 1000 + F.col("doc_id"), F.lit(".html")).alias("source_url"), text.alias("text"), "doc_id", to.alias("to"))
    found = F.transform(F.when(F.col("doc_id") % 10 != 9, F.col("to")).otherwise(F.array().cast("array<bigint>")), lambda x: F.struct(F.lit("IETF").alias("org"), (1000 + x).cast("string").alias("code"), F.lit("t").alias("title"), F.lit(1).alias("ref_number")))
    cache = pages.filter("doc_id % 7 = 1").select(F.lit("IETF").alias("org"), (1000 + F.col("doc_id")).cast("string").alias("code"), F.lit("pending").alias("status"), "source_url", F.lit(None).cast("string").alias("version"), "text", found.alias("discovered"))
    listing = values(spark, [], "folder_url string, pos int, link string")
    out = references.crawl_pages(values(spark, [("IETF", "1000")], "org string, code string"), listing, pages.select("source_url", "text"), cache)
    return out.select("code", "level", "cached", (F.coalesce("text", F.lit("")) != "").alias("has_text"), F.size("discovered").alias("n_cited"))


# ---------------------------------------------------------------- answers

TOLD = [
    "N11: Reference point between the AMF and the SMF. The N4 interface is used.", "The Session Management Function (SMF) performs IP address allocation. The AMF handles registration management.",
    "The UE initiated deregistration procedure and the registration procedure.", "The UE sends PDU SESSION ESTABLISHMENT REQUEST. Then a Registration Accept message.",
    "NGAP runs over SCTP transport protocol. QUIC protocol too.", "It has at most 15 digits, or 30 ms.", "The 5G System uses the Cell Broadcast system.", "This document defines HTTP/3 over QUIC. HTTP/3 is defined in RFC 9114.",
]
ASKED = [
    "AMF ile SMF arasındaki referans noktası hangisidir?", "Which network function handles registration management?", "UE hangi prosedür ile ayrılır?", "UE hangi mesajı gönderir?", "NGAP hangi protokol üzerinde?", "How many digits?",
    "Cell Broadcast hangi sistemde kullanılır?", "HTTP/3 hangi RFC'de tanımlanır?",
]


def evidence_hits(spark, sf_dir):
    """Six documents in order are the hits of a question, each with a sentence of the fixed ones before its text."""
    d, n = documents(spark, sf_dir), F.col("doc_id")
    pick = lambda xs, i: F.element_at(F.array(*map(F.lit, xs)), (i % len(xs) + 1).cast("int"))
    asked = values(spark, list(enumerate(ASKED)), "asked long, q string").select("asked", "q", questions.query_variants(F.col("q")).alias("variants"), questions.answer_type(F.col("q")).alias("answer_type"))
    d = d.withColumn("question", F.expr("doc_id div 6")).withColumn("asked", F.col("question") % len(ASKED)).join(F.broadcast(asked), "asked", "left")  # eight rows, once instead of a hit each
    title = F.when(n % 4 == 0, "Scope").when(n % 4 == 1, "References").when(n % 4 == 2, "N11 and AMF")
    return d.select(
        "question", (n % 6 + 1).cast("int").alias("rank"), "q", n.alias("chunk_id"), F.when(n % 2 == 0, "IETF").otherwise("3GPP").alias("org"), F.when(n % 2 == 0, (9114 + n % 3).cast("string")).otherwise(F.concat(F.lit("TS 23.50"), n % 3)).alias("code"),
        F.lit("4.2").alias("clause"), title.alias("clause_title"), F.concat_ws(" ", pick(TOLD, F.col("question") + n % 3), "text").alias("text"), F.lit(None).cast("string").alias("source_url"), "variants", "answer_type",
    )


@query()
def composed_answers(spark, sf_dir):
    """Q5-Q9 Q7a-Q7g Q8a-Q8f J10 D12 T3: answers over six documents each; tested against a plain version of the rules."""
    out = candidates.composed(tables.written(evidence_hits(spark, sf_dir), "hits"))
    return out.select("question", "answer_type", "primary_answer", "confidence", "margin", F.size("candidates").alias("n_candidates"), F.size("facts").alias("n_facts"))


@query()
def rendered_answers(spark, sf_dir):
    """Whether the composed answers are sure enough to be given at once, and with which sentence."""
    hits = tables.written(evidence_hits(spark, sf_dir), "hits")
    asked = hits.groupBy("question").agg(F.first("q").alias("q"))
    out = candidates.answers(hits).join(asked, "question")
    reply = gates.rendered(F.col("q"), F.col("answer_type"), F.col("primary_answer"), F.col("confidence"))
    again = gates.needs_second_search(F.col("q"), F.col("answer_type"), F.col("confidence"), F.col("primary_answer"), reply.isNotNull())
    return out.select("question", reply.alias("reply"), gates.can_answer_now(F.col("confidence"), reply.isNotNull(), F.coalesce(reply, F.lit(""))).alias("now"), again.alias("second_search"))


@query()
def answer_sources(spark, sf_dir):
    """J12 T5 Q8g Q8h: the sources of answers that are documents; tested against expected values."""
    hits = tables.written(evidence_hits(spark, sf_dir), "hits")
    store = hits.withColumn("status", F.when(F.col("chunk_id") % 11 == 0, "blocked").otherwise("indexed")).select("chunk_id", "org", "code", "clause", "clause_title", "text", "source_url", "status")
    found = candidates.composed(hits).select("question", F.col("primary_answer").alias("answer")).join(hits.groupBy("question").agg(F.first("q").alias("q")), "question")
    found = tables.written(found, "answers")
    return answering.answer_sources(found, hits, store).select("question", "position", "route", "chunk_id")


@query()
def second_search(spark, sf_dir):
    """The lexical second search of all kinds of questions over all documents; tested against expected values."""
    asked = values(spark, list(enumerate(ASKED)), "question long, text string")
    chunks = evidence_hits(spark, sf_dir).withColumn("status", F.lit("indexed")).select("chunk_id", "text", "org", "code", "clause", "clause_title", "status", "source_url")
    return answering.second_search(asked, chunks)


@query()
def guarded_replies(spark, sf_dir):
    """Q12 Q13 Q14: replies of a generator slot that is a rule here (the first sentence of the prompt's sources), guarded, repaired once, else the fallback."""
    hits = evidence_hits(spark, sf_dir).withColumn("clause_title", F.coalesce("clause_title", F.lit("")))
    asked = evidence.context_blocks(hits).join(hits.groupBy("question").agg(F.first("q").alias("text")), "question")

    def first_sentence(prompts: list[str]) -> list[str]:
        return [("RFC 9999 (Unknown Thing) standart. " if "KAYNAK 1: IETF" in p and "hatası" not in p and "HATA" not in p else "") + p.rsplit("]", 1)[-1].strip().split(".")[0] for p in prompts]

    return answering.replied(asked, first_sentence)
