"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Keys that hold over a HEAVY-th of all rows are fewer than HEAVY, whatever the input.
HEAVY = 1000
#: A word is a maximal run of characters outside ASCII white space.
SPACE_RUN = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is what the cluster names in ``spark.checkpoint.dir``. Only where that is
    unset on one machine (tests) a temporary folder is made and set; on a cluster
    executors would not see such a folder, so that is an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.conf.get("spark.master", "").startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def new_path(spark: SparkSession, label: str) -> str:
    """A path not used before, below the shared folder."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str, partition_by: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and return the table read back.

    Later jobs depend on files rather than on lineage or executors' disks, so a
    lost executor costs only its running tasks.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(table: DataFrame) -> None:
    """Empty a table that :func:`materialize` has written and nothing reads any more."""
    spark = table.sparkSession
    for path in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
        spark.range(0).write.mode("overwrite").parquet(path)


def skewed_join(rows: DataFrame, table: DataFrame, key: str, weight: str) -> DataFrame:
    """Inner join; ``table``, a written one, has one row for each key, and in ``weight``
    how many of ``rows`` have it. ``rows`` is computed twice.

    The keys that hold over a HEAVY-th of the rows, fewer than HEAVY, are broadcast, so
    their rows stay where they are; the others are shuffled, and none of them fills a task.
    """
    total = table.agg(F.sum(weight)).first()[0] or 0
    heavy = F.col(weight) * HEAVY > total
    light = rows.join(table.filter(~heavy).drop(weight).hint("merge"), key)
    return light.unionByName(rows.join(F.broadcast(table.filter(heavy).drop(weight)), key))


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Select columns by exact name even if others differ from them only in case
    or repeat them (the first exact match is taken)."""
    at = [df.columns.index(n) for n in names]
    plain = df.toDF(*(f"_c{i}" for i in range(len(df.columns))))
    return plain.select(*(F.col(f"_c{i}").alias(n) for i, n in zip(at, names)))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def id_fold(doc_id: str | Column, k: int) -> Column:
    """crc32 of the id as text, modulo ``k``; a null id counts as empty text."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % k


def ascii_words(text: str | Column) -> Column:
    """Words of a text in order; none for null."""
    c = F.col(text) if isinstance(text, str) else text
    return F.array_remove(F.split(F.coalesce(c, F.lit("")), SPACE_RUN), "")
