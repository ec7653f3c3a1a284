"""Helpers shared by the operators: staged tables, Arrow batches and safe column handling."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import shared_dir, ship

#: Rows and bytes of one Arrow batch, about; whole texts may be long, so batches hold few. A batch is held by the JVM and by Python.
BATCH_ROWS, BATCH_BYTES = 256, 8 << 20


#: Tables written by this process, by application.
_staged: dict[str, list[str]] = {}


def stage(df: DataFrame, what: str) -> DataFrame:
    """Write a DataFrame to the shared folder and read it back: it is computed once, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _staged.setdefault(spark.sparkContext.applicationId, []).append(path)
    return spark.read.schema(df.schema).parquet(path)


def staged(spark: SparkSession) -> list[str]:
    """The tables that have been written so far and not been dropped."""
    return list(_staged.get(spark.sparkContext.applicationId, []))


def drop_staged(spark: SparkSession, paths: list[str]) -> None:
    """Delete tables that nothing reads any more."""
    known = _staged.get(spark.sparkContext.applicationId, [])
    for path in paths:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(target, True)
        known.remove(path)


def small_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small enough for whole documents, and let tasks import this package."""
    ship(spark)
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def map_batches(df: DataFrame, function: Callable[[pa.RecordBatch], Iterable[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow with a function of one batch."""
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from function(batch)

    return df.mapInArrow(run, schema)


def utf8(column: pa.Array) -> list[bytes]:
    """Texts of an Arrow column as UTF-8 bytes; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def need(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that other columns can't clash with an operator's own."""
    return df.select(*(F.col(f"`{n}`") for n in names))


def held_out(doc_id: Column) -> Column:
    """The fold that labels are never learned from."""
    return F.crc32(doc_id.cast("string")) % 3 == 1


def cells(spark: SparkSession, df: DataFrame, per_cell: int) -> int:
    """Number of groups to split a table into, growing with its rows."""
    return max(1, -(-df.count() // per_cell))
