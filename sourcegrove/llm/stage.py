"""Stage tables: cutting lineage with Parquet tables in the folder that the cluster names in spark.checkpoint.dir."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The tables of each scope, and the scope in use; a query on its own has the scope "".
_made: dict[str, list[tuple]] = {}
_scope = [""]
#: Short rows of one file.
FILE_ROWS = 500_000
#: Rows of an Arrow batch: bounds what a Python worker holds at a time.
BATCH_ROWS = 1_000


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where the session has none: a local temporary one under a local master (tests), else an error,
    as executors on other machines would not see it."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="sourcegrove-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def small_batches(spark: SparkSession) -> None:
    """Sets Arrow batches of BATCH_ROWS rows in a session that hasn't set a size of its own."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":  # Spark's own default
        spark.conf.set(name, str(BATCH_ROWS))


def verdict(f: Callable[[Iterator[pa.Array]], Iterator[pa.Array]]) -> Callable:
    """An Arrow function from batches of texts to batches of booleans, for a filter: the other columns stay in the JVM."""
    f.__annotations__ = {"parts": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(f, "boolean")


@contextmanager
def scope(name: str) -> Iterator[None]:
    """Tables written inside belong to this scope alone; what an earlier use of the scope left is deleted first."""
    before = _scope[0]
    clear(name)
    _scope[0] = name
    try:
        yield
    finally:
        _scope[0] = before


def written(df: DataFrame, name: str, keep: bool = False, rows: int | None = None) -> DataFrame:
    """df as a Parquet table in the shared folder: computed once, and safe when executors are lost. It is deleted when the driver's JVM ends,
    or with its scope; keep: neither.

    rows: as many rows as there can be, for tables of short rows: they are written in files of up to FILE_ROWS rows.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    if rows is not None:
        df = df.coalesce(max(1, -(-rows // FILE_ROWS)))
    df.write.parquet(path)
    if not keep:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        files = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        files.deleteOnExit(at)
        _made.setdefault(_scope[0], []).append((files, at))
    return spark.read.schema(schema).parquet(path)


def clear(name: str = "") -> None:
    """Deletes the tables of a scope. Only for when no DataFrame that reads them is in use any more."""
    for files, at in _made.pop(name, []):
        files.delete(at, True)
        files.cancelDeleteOnExit(at)
