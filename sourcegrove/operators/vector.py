"""Vector search and rank fusion."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sourcegrove.functions import rules

#: Bytes of query vectors that are searched in one pass over the collection.
QUERY_BYTES = 64_000_000
#: Of these, so many are compared with a batch at a time.
QUERY_ROWS = 256


def nearest_of(d: np.ndarray, c: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, columns) of the k smallest of each row of d; of equals those with the smaller c."""
    if d.shape[1] > k:
        low = np.partition(d, k - 1, axis=1)[:, k - 1 : k]
        row, col = np.nonzero(d <= low)
    else:
        row, col = (x.ravel() for x in np.indices(d.shape))
    order = np.lexsort((c[col], d[row, col], row))
    row, col = row[order], col[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    return row[place < k], col[place < k]


def knn(queries: DataFrame, chunks: DataFrame, k: int = rules.CANDIDATES_PER_VARIANT, query_id: str = "variant", chunk_id: str = "chunk_id", vector: str = "embedding", digits: int = 9, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """(query_id, chunk_id, distance, rank) of each query's k nearest chunks by squared Euclidean distance, exact.

    Queries go to the executors in blocks of about query_bytes, dealt by a hash of their ids; each Arrow batch of chunks is compared by matrix
    products and keeps k rows a query, so what is shuffled for the final ranking is k rows a query and batch, however large the
    collection. Ties go by chunk id.
    """
    named = queries.select(F.col(query_id).cast("long").alias("q"), F.col(vector).alias("v")).filter("q is not null and v is not null")
    rows = chunks.select(F.col(chunk_id).cast("long").alias("c"), F.col(vector).alias("v")).filter("c is not null and v is not null")
    size = named.agg(F.coalesce(F.sum(F.size("v").cast("long")), F.lit(0)) * 8).first()[0]
    blocks = max(1, -(-size // query_bytes))
    out = None
    for b in range(blocks):
        got = named.filter(F.pmod(F.xxhash64("q"), F.lit(blocks)) == b).collect()  # about query_bytes
        ids = np.array([r.q for r in got], np.int64)
        matrix = np.array([r.v for r in got], np.float64)

        def nearest(batches: Iterator[pa.RecordBatch], ids=ids, matrix=matrix) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows or not len(ids):
                    continue
                c = batch.column(0).to_numpy()
                x = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)
                for a in range(0, len(ids), QUERY_ROWS):
                    some, m = ids[a : a + QUERY_ROWS], matrix[a : a + QUERY_ROWS]
                    d = np.round((m**2).sum(1)[:, None] + (x**2).sum(1)[None] - 2 * (m @ x.T), digits) + 0.0  # no negative zero
                    row, col = nearest_of(d, c, k)
                    yield pa.RecordBatch.from_arrays([pa.array(some[row]), pa.array(c[col]), pa.array(d[row, col])], ["q", "c", "distance"])

        found = rows.mapInArrow(nearest, "q long, c long, distance double")
        out = found if out is None else out.union(found)
    order = Window.partitionBy("q").orderBy("distance", "c")
    ranked = out.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select(F.col("q").alias(query_id), F.col("c").alias(chunk_id), "distance", "rank")


def near_enough(hits: DataFrame, threshold: float = rules.DISTANCE_THRESHOLD, text: str | None = None) -> DataFrame:
    """hits with a distance of at most the threshold and, where there is a text column, with text. Ranks stay as they are."""
    out = hits.filter(F.col("distance").isNotNull() & (F.col("distance") <= threshold))
    return out.filter(F.trim(text) != "") if text else out


def fuse(hits: DataFrame, question: str = "question", variant: str = "variant", chunk_id: str = "chunk_id", k: float = rules.RRF_K) -> DataFrame:
    """Per question and chunk the reciprocal rank sum, best rank, best distance, number of variants, and variant -> rank.

    The sum is rounded to 12 digits: in whatever order the addends come, equal chunks tie.
    """
    return hits.groupBy(question, chunk_id).agg(
        F.round(F.sum(1 / (F.lit(k) + F.col("rank"))), 12).alias("fusion_score"),
        F.min("rank").alias("best_rank"),
        F.min("distance").alias("distance"),
        F.count_distinct(variant).alias("query_hit_count"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct(variant, "rank")))).alias("variant_ranks"),
    )


def fusion_order(chunk_id: str = "chunk_id") -> list[Column]:
    """T1."""
    return [F.desc("fusion_score"), F.desc("query_hit_count"), F.asc("best_rank"), F.asc("distance"), F.asc(chunk_id)]


def select_covering(hits: DataFrame, question: str = "question", variant: str = "variant", chunk_id: str = "chunk_id", most: int = rules.MAX_CANDIDATES) -> DataFrame:
    """Fused chunks, at most `most` a question: the first hit of each variant before all others, then fusion order; with position."""
    tops = hits.withColumn("first", F.min("rank").over(Window.partitionBy(question, variant))).filter("rank = first").select(question, chunk_id, variant)
    tops = tops.groupBy(question, chunk_id).agg(F.min(variant).alias("top_variant"))
    fused = fuse(hits, question, variant, chunk_id).join(tops, [question, chunk_id], "left")
    chosen = Window.partitionBy(question).orderBy(F.asc_nulls_last("top_variant"), *fusion_order(chunk_id))
    kept = fused.withColumn("n", F.row_number().over(chosen)).filter(F.col("n") <= most).drop("n")
    return kept.withColumn("position", F.row_number().over(Window.partitionBy(question).orderBy(*fusion_order(chunk_id))))


def best_variant(scores: DataFrame, question: str = "question", chunk_id: str = "chunk_id", variant: str = "variant", score: str = "score", top_k: int | None = None) -> DataFrame:
    """Each chunk's highest score over the query variants and the earliest variant that has it; the top_k of each question."""
    out = scores.groupBy(question, chunk_id).agg(
        F.max(score).alias("rerank_score"),
        F.max_by(variant, F.struct(F.col(score), -F.col(variant))).alias("rerank_variant"),
        F.count_distinct(variant).alias("rerank_variant_count"),
    )
    out = out.withColumn("position", F.row_number().over(Window.partitionBy(question).orderBy(F.desc("rerank_score"), chunk_id)))
    return out.filter(F.col("position") <= top_k) if top_k else out


def strong_margin(hits: DataFrame, question: str = "question", score: str = "rerank_score", chunk_id: str = "chunk_id", strong: float = 7.0, margin: float = 2.0, most: int = 3, multi_part: Column | None = None) -> DataFrame:
    """One row where the best score is strong and clearly ahead and the question has one part, else the `most` best."""
    order = Window.partitionBy(question).orderBy(F.desc(score), chunk_id)
    frame = Window.partitionBy(question)
    out = hits.withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= most)
    out = out.withColumn("top", F.max(F.when(F.col("rn") == 1, F.col(score))).over(frame)).withColumn("second", F.max(F.when(F.col("rn") == 2, F.col(score))).over(frame))
    alone = (F.col("top") >= strong) & (F.col("top") - F.col("second") >= margin)
    if multi_part is not None:
        alone = alone & ~multi_part
    return out.filter(~F.coalesce(alone, F.lit(False)) | (F.col("rn") == 1)).drop("top", "second")
