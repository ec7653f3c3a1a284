"""Windows over a chain's heights or a log's time, in buckets: one chain's rows spread over many tasks, and only bucket edges meet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Heights of a bucket.
BUCKET = 1_000_000


def _bucketed(df: DataFrame, width: int) -> DataFrame:
    return df.withColumn("_bucket", F.expr(f"block_number div {width}"))


def with_previous(df: DataFrame, value: Column, name: str, width: int = BUCKET) -> DataFrame:
    """Adds the value of the chain's next lower height that is stored; null at the lowest."""
    b = _bucketed(df.withColumn("_value", value), width)
    inner = b.withColumn("_before", F.lag("_value").over(W.partitionBy("chain_id", "_bucket").orderBy("block_number")))
    edges = b.groupBy("chain_id", "_bucket").agg(F.max_by("_value", "block_number").alias("_last"))
    edges = edges.withColumn("_carry", F.lag("_last").over(W.partitionBy("chain_id").orderBy("_bucket"))).drop("_last")
    return inner.join(edges, ["chain_id", "_bucket"]).withColumn(name, F.coalesce("_before", "_carry")).drop("_bucket", "_value", "_before", "_carry")


def with_last(df: DataFrame, value: Column, name: str, width: int = BUCKET) -> DataFrame:
    """Adds the latest value that isn't null at this height or below."""
    b = _bucketed(df.withColumn("_value", value), width)
    inner = b.withColumn("_here", F.last("_value", ignorenulls=True).over(W.partitionBy("chain_id", "_bucket").orderBy("block_number").rowsBetween(W.unboundedPreceding, 0)))
    edges = b.groupBy("chain_id", "_bucket").agg(F.max_by("_value", F.when(F.col("_value").isNotNull(), F.col("block_number"))).alias("_last"))
    edges = edges.withColumn("_carry", F.last("_last", ignorenulls=True).over(W.partitionBy("chain_id").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1))).drop("_last")
    return inner.join(edges, ["chain_id", "_bucket"]).withColumn(name, F.coalesce("_here", "_carry")).drop("_bucket", "_value", "_here", "_carry")


def running(df: DataFrame, by: list[str], at: str, order: list[str], value: Column, name: str, width: int) -> DataFrame:
    """Adds the sum of value over a group's rows up to each, in order; at, the first of the order, is cut into buckets of width."""
    b = df.withColumn("_value", value).withColumn("_bucket", F.expr(f"{at} div {width}"))
    inner = b.withColumn("_here", F.sum("_value").over(W.partitionBy(*by, "_bucket").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)))
    edges = b.groupBy(*by, "_bucket").agg(F.sum("_value").alias("_sum"))
    edges = edges.withColumn("_carry", F.sum("_sum").over(W.partitionBy(*by).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1))).drop("_sum")
    return inner.join(edges, [*by, "_bucket"]).withColumn(name, F.col("_here") + F.coalesce("_carry", F.lit(0))).drop("_bucket", "_value", "_here", "_carry")
