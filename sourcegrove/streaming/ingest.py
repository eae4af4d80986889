"""Incremental ingest of new document files: chunked, made unique by id, and appended where the id isn't there yet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sourcegrove.operators.chunking import chunked
from sourcegrove.operators.ingest import append_missing, prepared


def ingest(spark: SparkSession, source: str, schema: str, store: str, checkpoint: str, trigger: dict | None = None):
    """Starts the query. source: a folder of Parquet files with org, code, version, clause, title, text, source_url.

    A batch that is tried again adds nothing twice, as ids that the store has are left out.
    """
    stream = spark.readStream.schema(schema).parquet(source)

    def one(batch: DataFrame, number: int) -> None:
        parts = chunked(batch).withColumn("text", F.col("chunk")).drop("chunk")
        append_missing(batch.sparkSession, prepared(parts), store, resume=True)

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
