"""Keyed tables that batches of a stream upsert, and that can be read as of any batch.

Rows lie in buckets of their key's hash. A batch writes the buckets that it touches, whole,
below its own number; a bucket's latest number before some batch is its state there. So a
batch that is run again reads what it read before, and replaces its own files only.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed for the life of a table: rows are found by their bucket.
BUCKETS = 64


def _bucket(keys: list[str]) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int").alias("_bucket")


def read_snapshot(spark: SparkSession, path: str, schema: str, before: int | None = None) -> DataFrame:
    """The rows (``schema``, and _bucket) after all batches, or those before ``before``. A
    table that no batch has written is empty. Which batch wrote a bucket last is a row for
    each bucket, at most BUCKETS, so it is broadcast."""
    try:
        rows = spark.read.schema(f"{schema}, _batch long, _bucket int").parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], f"{schema}, _bucket int")
    if before is not None:
        rows = rows.filter(F.col("_batch") < before)
    last = rows.groupBy("_bucket").agg(F.max("_batch").alias("_batch"))
    return rows.join(F.broadcast(last), ["_bucket", "_batch"]).drop("_batch")


def upsert_snapshot(spark: SparkSession, path: str, schema: str, changes: DataFrame, keys: list[str], number: int) -> None:
    """``changes`` (``schema``, one row per key) replace the rows of their keys. Only touched
    buckets are read and written."""
    changes = changes.select(*spark.createDataFrame([], schema).columns).withColumn("_bucket", _bucket(keys))
    touched = changes.select("_bucket").distinct()
    old = read_snapshot(spark, path, schema, number).join(F.broadcast(touched), "_bucket", "left_semi")
    kept = old.join(changes.select(*keys), keys, "left_anti")
    kept.unionByName(changes).repartition("_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(f"{path}/_batch={number}")
