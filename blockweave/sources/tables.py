"""Stored tables laid out by chain and bucket of heights: a change reads and rewrites the buckets that it touches, and no other."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import CODEC

#: Heights of a bucket, and files that a bucket is written in at most by one merge.
WIDTH, FILES = 100_000, 8
#: Buckets of a chain at most in a table whose width is fitted to its heights. Every bucket is a folder to list, open and move.
MOST_BUCKETS = 32
PART = ["_chain", "_bucket"]


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(at)


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def fitting_width(heights: DataFrame, least: int = WIDTH) -> int:
    """The width for a table of these heights (block_number): least, or more where a chain would have over MOST_BUCKETS buckets."""
    lo, hi = heights.agg(F.min("block_number"), F.max("block_number")).first()
    return least if lo is None else max(least, -(-(hi - lo + 1) // (MOST_BUCKETS - 1)))  # one bucket may be cut at both ends


def _dealt(df: DataFrame, width: int) -> DataFrame:
    """With the columns of the layout. The chain's has a prefix, so that no chain's name reads as a number or a date."""
    return df.withColumns({"_chain": F.concat(F.lit("chain-"), "chain_id"), "_bucket": F.expr(f"block_number div {width}")})


def parts(keys: DataFrame, width: int = WIDTH) -> DataFrame:
    """The buckets of keys (chain_id, block_number)."""
    return _dealt(keys.select("chain_id", "block_number"), width).select(*PART).distinct()


def range_parts(ranges: DataFrame, width: int = WIDTH) -> DataFrame:
    """The buckets of ranges (chain_id, lo, hi)."""
    cut = ranges.filter("lo <= hi").select("chain_id", F.explode(F.sequence(F.expr(f"lo div {width}"), F.expr(f"hi div {width}"))).alias("_bucket"))
    return cut.select(F.concat(F.lit("chain-"), "chain_id").alias("_chain"), "_bucket").distinct()


def together(df: DataFrame, width: int = WIDTH) -> DataFrame:
    """With the columns of the layout, and a bucket's rows in FILES tasks at most."""
    return _dealt(df, width).repartition(*PART, F.expr(f"block_number div {max(1, width // FILES)}"))


def _write(df: DataFrame, path: str, dynamic: bool) -> None:
    df.write.partitionBy(*PART).mode("overwrite").option("partitionOverwriteMode", "dynamic" if dynamic else "static").option("compression", CODEC).parquet(path)


def write_table(df: DataFrame, path: str, width: int = WIDTH, then: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> None:
    """A table (chain_id, block_number, ...) from nothing. Rows without a chain or a height can't be stored.

    then: what makes the table's rows of df's, row by row. It comes after these have been dealt and sorted, so that narrow rows can
    be shuffled and wide ones stored; df's chain and height are the table's.
    """
    rows = together(df, width).sortWithinPartitions(*PART, "block_number")
    out = then(rows)
    _write(rows if out is rows else out.select(*(c for c in out.columns if c not in PART), *PART), path, dynamic=False)


def read_table(spark: SparkSession, path: str, lo: int | None = None, hi: int | None = None, width: int = WIDTH) -> DataFrame:
    """The table, or its heights from lo to hi, of which only the buckets are read."""
    rows = spark.read.parquet(path)
    if lo is not None:
        rows = rows.filter(F.col("block_number").between(lo, hi) & F.col("_bucket").between(lo // width, hi // width))
    return rows.drop(*PART)


def touched_rows(spark: SparkSession, path: str, buckets: list[tuple[str, int]]) -> DataFrame:
    """The rows of some buckets; the others' folders aren't opened."""
    chains: dict[str, list[int]] = {}
    for chain, bucket in buckets:
        chains.setdefault(chain, []).append(bucket)
    wanted = F.lit(False)
    for chain, numbers in sorted(chains.items()):
        wanted = wanted | ((F.col("_chain") == chain) & F.col("_bucket").isin(sorted(numbers)))
    return spark.read.parquet(path).filter(wanted)


def _first_files(df: DataFrame) -> dict[tuple[str, int], str]:
    """A file of each bucket of stored rows: the one whose name comes first."""
    return {(r["_chain"], r["_bucket"]): r["file"] for r in df.groupBy(*PART).agg(F.min("_metadata.file_path").alias("file")).collect()}


def merge_into(spark: SparkSession, path: str, touched: DataFrame, function: Callable[[DataFrame], DataFrame], width: int = WIDTH, dealt: bool = False) -> int:
    """Replace the rows of the touched buckets (_chain, _bucket) by function(those rows); the number of buckets that were touched.

    The function's rows must lie in the touched buckets. They are written beside the table, once, and each bucket is moved into
    place when all are written; a lost executor's work is done again. The driver lists the touched buckets, of which there is one for
    each chain and ``width`` heights. Buckets in which nothing is left are removed. dealt: the function leaves rows in the tasks that
    read their buckets, or has dealt them (``together``), so that they aren't shuffled again.
    """
    buckets = sorted((r["_chain"], r["_bucket"]) for r in touched.collect() if r["_chain"] is not None and r["_bucket"] is not None)
    if not buckets:
        return 0
    columns = [c for c in spark.read.parquet(path).columns if c not in PART]
    before = _first_files(touched_rows(spark, path, buckets))
    after = function(touched_rows(spark, path, buckets).select(*columns)).select(*columns)
    _write((_dealt if dealt else together)(after, width).sortWithinPartitions(*PART, "block_number"), path, dynamic=True)
    for bucket, file in _first_files(touched_rows(spark, path, buckets)).items():
        if before.get(bucket) == file:  # not overwritten, as nothing is left in it
            delete(spark, file.rsplit("/", 1)[0])
    return len(buckets)
