"""Ingest: chunk ids, preparation, resumable upserts, metadata, counters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sourcegrove.functions.text import blank, sha_key


def chunk_id(org: Column, code: Column, version: Column, clause: Column, text: Column) -> Column:
    """The stable id of a chunk."""
    return F.concat(F.lit("chunk_"), sha_key(org, code, version, clause, text))


def cache_id(org: Column, code: Column) -> Column:
    """The key of a document's crawl record."""
    return F.sha2(F.concat_ws("|", F.upper(F.trim(org)), F.upper(F.trim(code))), 256)


def prepared(chunks: DataFrame) -> DataFrame:
    """Chunks with chunk_id, without void and blank ones and without repeats of an id."""
    rows = chunks.filter((F.col("status") != "void") & ~blank(F.col("text"))).withColumn("chunk_id", chunk_id(*[F.col(c) for c in ("org", "code", "version", "clause", "text")]))
    return rows.dropDuplicates(["chunk_id"])


def with_metadata(docs: DataFrame, resolved: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Documents with the version and url of their last resolution; version "Latest" where there is none."""
    last = resolved.groupBy(*keys).agg(F.max_by(F.struct("version", "source_url"), F.col(order)).alias("r"))
    return docs.join(last, keys, "left").select(*docs.columns, F.coalesce("r.version", F.lit("Latest")).alias("version"), F.col("r.source_url").alias("source_url"))


def missing(new: DataFrame, existing: DataFrame, key: str = "chunk_id") -> DataFrame:
    """The rows whose key isn't there yet. Before any embedding, so that only these are embedded."""
    return new.join(existing.select(key), key, "left_anti")


def upserted(old: DataFrame, new: DataFrame, key: str = "chunk_id", order: str | None = None) -> DataFrame:
    """K2: old rows without those that new replaces, and the new ones; of several new rows with a key the last by `order` stays."""
    if order is not None:
        new = new.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).filter("__n = 1").drop("__n")
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def stored(chunks: DataFrame) -> DataFrame:
    """chunks as the store has them: chunk_id, text and metadata with defaults; version "Latest" where there is none."""
    blank_ = {c: F.coalesce(F.col(c), F.lit("")) for c in ("org", "code", "clause", "clause_title", "source_url")}
    version = F.when(F.coalesce("version", F.lit("")) == "", "Latest").otherwise(F.col("version"))
    return chunks.select("chunk_id", "text", blank_["org"].alias("org"), blank_["code"].alias("code"), version.alias("version"), blank_["clause"].alias("clause"), blank_["clause_title"].alias("clause_title"), "status", blank_["source_url"].alias("source_url"))


def rewritten(spark: SparkSession, source: str, target: str, embed) -> None:
    """K5: the rows of a store embedded anew (embed: a function of DataFrames) into a store that must not exist yet."""
    embed(spark.read.parquet(source).drop("embedding")).write.mode("errorifexists").parquet(target)


def page(store: DataFrame, columns: list[str], after: str | None = None, size: int = 1000, key: str = "chunk_id") -> DataFrame:
    """A page of the store: the next `size` rows behind a key, only the columns asked for. A whole scan needs no pages: read the columns."""
    out = store.select(key, *columns) if after is None else store.select(key, *columns).filter(F.col(key) > after)
    return out.orderBy(key).limit(size)


def table_report(spark: SparkSession, found: dict[str, DataFrame | None], keys: dict[str, str] | None = None) -> DataFrame:
    """(name, rows, columns, null_keys, repeated_keys, whole) of each table; rows "YOK" and whole false for a missing one."""
    parts = []
    for name, df in found.items():
        if df is None:
            parts.append(spark.range(1).select(F.lit(name).alias("name"), F.lit("YOK").alias("rows"), F.array().cast("array<string>").alias("columns"), F.lit(0).cast("long").alias("null_keys"), F.lit(0).cast("long").alias("repeated_keys"), F.lit(False).alias("whole")))
            continue
        key = F.col((keys or {}).get(name, df.columns[0]))
        each = df.groupBy(key.alias("k")).agg(F.count(F.lit(1)).alias("n"))
        got = each.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.coalesce(F.sum(F.when(F.col("k").isNull(), F.col("n"))), F.lit(0)).alias("null_keys"), F.count_if(F.col("k").isNotNull() & (F.col("n") > 1)).alias("repeated_keys"))
        listed = F.array(*[F.lit(f"{f.name}:{f.dataType.simpleString()}") for f in df.schema.fields])
        parts.append(got.select(F.lit(name).alias("name"), F.col("rows").cast("string").alias("rows"), listed.alias("columns"), "null_keys", "repeated_keys", ((F.col("null_keys") == 0) & (F.col("repeated_keys") == 0)).alias("whole")))
    return reduce(DataFrame.unionByName, parts)


def open_store(spark: SparkSession, path: str, reset: bool = False, resume: bool = False) -> str:
    """K6: the save mode of a store. reset: "overwrite"; resume: "append"; else "errorifexists". Both at once are refused."""
    if reset and resume:
        raise ValueError("reset and resume exclude each other")
    return "overwrite" if reset else "append" if resume else "errorifexists"


def append_missing(spark: SparkSession, new: DataFrame, path: str, key: str = "chunk_id", reset: bool = False, resume: bool = False) -> None:
    """K1: writes the rows that the store at path doesn't have yet, in the mode asked for."""
    mode = open_store(spark, path, reset, resume)
    if resume:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        if where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
            new = missing(new, spark.read.parquet(path), key)
    new.write.mode(mode).parquet(path)


def counters(docs: DataFrame, indexed: DataFrame, key: str, text: str) -> DataFrame:
    """One row: documents, blank texts, distinct texts, repeats, and those already indexed."""
    marks = indexed.select(F.col(key)).distinct().withColumn("__there", F.lit(True))
    rows = docs.join(marks, key, "left").select(F.sha2(F.coalesce(F.col(text), F.lit("")), 256).alias("h"), blank(F.col(text)).alias("b"), "__there")
    each = rows.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.count_if("b").alias("b"), F.count_if("__there").alias("t"))
    return each.agg(
        F.sum("n").alias("n_docs"), F.sum("b").alias("n_blank"), F.count(F.lit(1)).alias("n_distinct"), (F.sum("n") - F.count(F.lit(1))).alias("n_repeats"), F.sum("t").alias("n_indexed")
    )


def unpivoted(eav: DataFrame, key: str = "id", names: list[str] | None = None) -> DataFrame:
    """One row per id from (id, key, string_value, int_value, float_value, bool_value); the first kind of value that is there
    counts, and of several values of a key the smallest."""
    value = F.coalesce("string_value", F.col("int_value").cast("string"), F.col("float_value").cast("string"), F.col("bool_value").cast("string"))
    return eav.withColumn("v", value).groupBy(key).pivot("key", names).agg(F.min("v"))


def first_seen(df: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(order))).filter("__n = 1").drop("__n")
