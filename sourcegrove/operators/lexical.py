"""Full-text search: inverted index with positions, phrases, boolean AND of phrases, BM25."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sourcegrove.functions import rules, tables

# Letters with marks that the index folds, and what they become.
TOKEN = r"[\p{L}\p{N}]+"
MARKED, PLAIN = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿğış", "aaaaaaceeeeiiiinooooouuuuyygis"


def tokens(text: Column) -> Column:
    """Lowered runs of letters and digits, common marks removed."""
    return F.regexp_extract_all(F.translate(F.lower(F.coalesce(text, F.lit(""))), MARKED, PLAIN), F.lit(f"({TOKEN})"), F.lit(1))


def postings(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """L1, K4: (token, key, tf, positions), positions from 0 in order. The whole index: for a stated query set, `matched` reads the texts instead."""
    each = docs.select(F.col(key), F.posexplode_outer(tokens(F.col(text))).alias("pos", "token")).filter("token is not null")
    return each.groupBy("token", key).agg(F.count(F.lit(1)).alias("tf"), F.array_sort(F.collect_list("pos")).alias("positions"))


def write_index(docs: DataFrame, path: str, buckets: int = 64, key: str = "doc_id", text: str = "text", mode: str = "errorifexists") -> None:
    """K4: the index as two tables: postings in folders of token hashes, so that a query reads only its tokens' folders, and lengths."""
    index = postings(docs, key, text).withColumn("bucket", F.pmod(F.xxhash64("token"), F.lit(buckets)).cast("int"))
    index.repartition("bucket").sortWithinPartitions("bucket", "token", key).write.mode(mode).partitionBy("bucket").parquet(f"{path}/postings")
    lengths(docs, key, text).write.mode(mode).parquet(f"{path}/lengths")


def read_index(spark: SparkSession, path: str, asked: DataFrame | None = None, buckets: int = 64) -> tuple[DataFrame, DataFrame]:
    """(postings, lengths) of a written index, empty where there is none. asked (phrase): only the folders of their tokens are read."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/postings/_SUCCESS")
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], "token string, doc_id long, tf long, positions array<int>"), spark.createDataFrame([], "doc_id long, len int")
    index = spark.read.parquet(f"{path}/postings")
    if asked is not None:
        wanted = asked.select(F.explode(tokens(F.col("phrase"))).alias("token")).select(F.pmod(F.xxhash64("token"), F.lit(buckets)).cast("int").alias("b")).distinct()
        index = index.filter(F.col("bucket").isin([r.b for r in wanted.collect()]))  # at most `buckets` numbers
    return index.drop("bucket"), spark.read.parquet(f"{path}/lengths")


def token_stats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(token, df, cf, firsts): documents, occurrences, and the sum of first positions. A document's tokens are combined where it is read."""
    each = docs.select(F.col(key), F.posexplode_outer(tokens(F.col(text))).alias("pos", "token")).filter("token is not null")
    by_doc = each.groupBy("token", key).agg(F.count(F.lit(1)).alias("tf"), F.min("pos").alias("first"))
    return by_doc.groupBy("token").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"), F.sum(F.col("first").cast("long")).alias("firsts"))


def lengths(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, len): tokens of each document."""
    return docs.select(F.col(key), F.size(tokens(F.col(text))).alias("len"))


#: A stated query set of so many phrase tokens is sent to the executors; beyond it its tokens are joined by hash.
MOST_TOKENS = 100_000


def matched(docs: DataFrame, phrases: DataFrame, key: str = "doc_id", text: str = "text", query: str = "query") -> DataFrame:
    """(query, phrase_no, key, tf, len) of each phrase in each document that has its tokens side by side, read from the texts in one pass.

    phrases (query, phrase_no, phrase) is a stated query set. Only tokens of the set leave the scan, each with its document's length; a
    token's position less its place in the phrase is the phrase's start, and starts that all tokens give are hits.
    """
    wanted = phrases.select(query, "phrase_no", F.posexplode(tokens(F.col("phrase"))).alias("at", "token"))
    wanted = wanted.withColumn("size", F.count(F.lit(1)).over(Window.partitionBy(query, "phrase_no")))
    if wanted.limit(MOST_TOKENS + 1).count() <= MOST_TOKENS:
        wanted = F.broadcast(wanted)  # checked: MOST_TOKENS short rows
    each = docs.select(F.col(key), tokens(F.col(text)).alias("w")).select(key, F.size("w").alias("len"), F.posexplode_outer("w").alias("pos", "token"))  # outer: a plain one would be tested for tokens by finding them twice
    start = F.when(F.col("size") > 1, F.col("pos") - F.col("at")).alias("start")  # places of a lone token are only counted, where they are read
    starts = each.join(wanted, "token").groupBy(query, "phrase_no", key, start, "size", "len").agg(F.count(F.lit(1)).alias("n"))
    tf = F.sum(F.when(F.col("size") > 1, 1).otherwise(F.col("n"))).cast("long")
    return starts.filter("size = 1 or n = size").groupBy(query, "phrase_no", key, "len").agg(tf.alias("tf")).select(query, "phrase_no", key, "tf", "len")


def phrase_hits(index: DataFrame, phrases: DataFrame, key: str = "doc_id", query: str = "query") -> DataFrame:
    """L2: (query, phrase_no, key, tf) of each phrase in each document that has its tokens side by side, from a written index.

    phrases (query, phrase_no, phrase) is a stated query set; its tokens are joined with the index, so only their lists are read.
    """
    wanted = phrases.select(query, "phrase_no", F.posexplode(tokens(F.col("phrase"))).alias("at", "token"))
    sizes = wanted.groupBy(query, "phrase_no").agg(F.count(F.lit(1)).alias("size"))
    found = index.join(wanted, "token").select(query, "phrase_no", key, "at", F.explode(F.transform("positions", lambda p: p - F.col("at"))).alias("start"))
    starts = found.groupBy(query, "phrase_no", key, "start").agg(F.count(F.lit(1)).alias("n")).join(sizes, [query, "phrase_no"]).filter("n = size")
    return starts.groupBy(query, "phrase_no", key).agg(F.count(F.lit(1)).alias("tf"))


def bm25(hits: DataFrame, docs_len: DataFrame, key: str = "doc_id", query: str = "query", term: str = "phrase_no", k1: float = rules.BM25_K1, b: float = rules.BM25_B) -> DataFrame:
    """L3: (query, key, score, n_terms): smaller is better; a term is a phrase; idf has a floor. hits carry len, or docs_len gives it.

    The hits are written once for their counts and their scores.
    """
    stats = docs_len.agg(F.count(F.lit(1)).alias("n_docs"), F.avg("len").alias("avg_len"))
    hits = tables.written(hits if "len" in hits.columns else hits.join(docs_len, key), "lexical-hits")
    df = hits.groupBy(query, term).agg(F.count(F.lit(1)).alias("df"))  # as many rows as phrases
    idf = F.greatest(F.log((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(rules.LEAST_IDF))
    part = -idf * (F.col("tf") * (k1 + 1)) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("avg_len")))
    rows = hits.join(df, [query, term]).join(F.broadcast(stats))  # stats is one row
    return rows.groupBy(query, key).agg(F.round(F.sum(part), 9).alias("score"), F.count(F.lit(1)).alias("n_terms"))


def search(docs: DataFrame, queries: DataFrame, limit: int = 20, key: str = "doc_id", text: str = "text", query: str = "query", phrases: str = "phrases") -> DataFrame:
    """L4, T4: the `limit` best documents of each query that have all of its phrases (an array column), by score, then key."""
    listed = queries.select(query, F.posexplode(phrases).alias("phrase_no", "phrase")).filter(F.size(tokens(F.col("phrase"))) > 0)
    need = listed.groupBy(query).agg(F.count(F.lit(1)).alias("need"))
    scored = bm25(matched(docs, listed, key, text, query), counted(docs, text), key, query).join(need, query).filter("n_terms = need")
    rank = F.row_number().over(Window.partitionBy(query).orderBy("score", key))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= limit).select(query, key, "score", "rank")


def counted(docs: DataFrame, text: str = "text") -> DataFrame:
    """(len): tokens of each document, counted without making them. Of all letters only İ changes its parts when it is lowered."""
    return docs.select(F.regexp_count(F.replace(F.coalesce(F.col(text), F.lit("")), F.lit("İ"), F.lit("i\u0307")), F.lit(TOKEN)).alias("len"))


def document_queries(phrases: Column) -> Column:
    """Of each phrase its words of two letters and more as an AND query, without words that any document has; the first four where
    only such are left. Phrases without words give none."""

    def one(p: Column) -> Column:
        found = F.filter(F.regexp_extract_all(p, F.lit("([A-Za-z0-9/]+)"), F.lit(1)), lambda w: F.length(w) > 1)
        telling = F.filter(found, lambda w: ~F.lower(w).isin(rules.NO_DOCUMENT_SEARCH))
        return F.when(F.size(telling) > 0, telling).otherwise(F.slice(found, 1, 4))

    return F.filter(F.transform(F.coalesce(phrases, F.array().cast("array<string>")), one), lambda q: F.size(q) > 0)


def general_queries(phrases: Column) -> Column:
    """Of each phrase its first three words of three letters and more as an AND query."""
    return F.filter(F.transform(F.coalesce(phrases, F.array().cast("array<string>")), lambda p: word_query(p)), lambda q: F.size(q) > 0)


def searched(docs: DataFrame, asked: DataFrame, limit: int, key: str = "doc_id", text: str = "text", question: str = "question") -> DataFrame:
    """(question, key, query_no, rank) of the hits of each question's queries (asked: question, queries array<array<string>>), each
    document at its first query only."""
    each = asked.select(F.struct(question, F.col("no").alias("query_no")).alias("query"), "phrases") if "no" in asked.columns else asked.select(question, F.posexplode("queries").alias("no", "phrases")).select(F.struct(question, F.col("no").alias("query_no")).alias("query"), "phrases")
    hits = search(docs, each, limit, key, text).select(F.col(f"query.{question}").alias(question), key, F.col("query.query_no").alias("query_no"), "rank")
    first = Window.partitionBy(question, key).orderBy("query_no")
    return hits.withColumn("__n", F.row_number().over(first)).filter("__n = 1").drop("__n")


def word_query(question: Column, pattern: str = r"([A-Za-z0-9]+)", least: int = 3, most: int = 3) -> Column:
    """The first `most` words of at least `least` characters, each a phrase of an AND query."""
    return F.slice(F.filter(F.regexp_extract_all(F.coalesce(question, F.lit("")), F.lit(pattern), F.lit(1)), lambda w: F.length(w) >= least), 1, most)


def reference_point_queries(question: Column) -> Column:
    """AND queries (arrays of phrases) for a reference point: by its name if the question has one, else by its two ends, else null."""
    q = F.coalesce(question, F.lit(""))
    point = F.upper(F.regexp_extract(q, r"(?i)\b(N\d{1,3})\b", 1))
    named = F.transform(F.regexp_extract_all(q, F.lit(r"\b(NG-RAN|gNB|gNodeB|eNB|[A-Za-z0-9/\-]{2,})\b"), F.lit(1)), F.upper)
    ends = F.array_distinct(F.transform(F.filter(named, lambda x: ~x.isin(rules.NO_ENDPOINTS)), lambda x: F.when(x.isin(rules.RAN_NAMES), "RAN").otherwise(x)))
    a, b = F.try_element_at(ends, F.lit(1)), F.try_element_at(ends, F.lit(2))
    other = F.when(a == "RAN", b).otherwise(a)
    radio = F.array(*[F.array(F.lit(p), other) for p in ("Reference point between", "Reference points", "(R)AN", "NG-RAN", "N2")])
    pair = F.array(F.array(F.lit("reference point between"), a, b), F.array(F.lit("reference point"), a, b), F.array(a, b, F.lit("reference point")))
    return F.when(point != "", F.array(F.array(point, F.lit("reference point")))).when(F.size(ends) >= 2, F.when((a == "RAN") | (b == "RAN"), radio).otherwise(pair))


def first_with_hits(hits: DataFrame, question: str = "question", number: str = "query_no") -> DataFrame:
    """Of each question's queries, only the hits of the first that has any."""
    low = F.min(number).over(Window.partitionBy(question))
    return hits.withColumn("__low", low).filter(F.col(number) == F.col("__low")).drop("__low")
