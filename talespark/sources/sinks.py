"""Writers: immutable events, catalogs by source, notes by month, content-addressed rows."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _existing(df: DataFrame, path: str) -> DataFrame:
    """What a folder holds; no rows if it is not there yet."""
    try:
        return df.sparkSession.read.schema(df.schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return df.limit(0)


def append_new(df: DataFrame, path: str, keys: list[str], digest: str | None = None, partition: list[str] | None = None) -> None:
    """Append the rows whose key is not there yet, once each. With ``digest``, a key that
    is there with another digest is an error, before anything is written."""
    old = _existing(df, path)
    if digest:
        clash = df.select(*keys, F.col(digest).alias("_d")).join(old.select(*keys, digest), keys).filter(~F.col("_d").eqNullSafe(F.col(digest)))
        first = clash.select(*keys).first()
        if first:
            raise ValueError(f"immutable row differs: {first.asDict()}")
    new = df.dropDuplicates(keys).join(old.select(*keys), keys, "left_anti").select(*df.columns)
    new.write.mode("append").partitionBy(*(partition or [])).parquet(path)


def write_events(df: DataFrame, path: str) -> None:
    """Events by source, each once; an event that is there with another digest is an error."""
    append_new(df, path, ["thread_key", "canonical_sha256", "local_id"], "event_sha256", ["source_id"])


def write_catalog(df: DataFrame, path: str) -> None:
    """Replaces the rows of the sources in ``df``; other sources' files are not touched."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("source_provider", "source_id").parquet(path)


def write_notes(df: DataFrame, path: str) -> None:
    """Notes by year and month of ``started_at`` (text that begins yyyy-mm)."""
    at = df.withColumn("year", F.substring("started_at", 1, 4)).withColumn("month", F.substring("started_at", 6, 2))
    at.write.mode("append").partitionBy("year", "month").parquet(path)


def write_provenance(entities: DataFrame, activities: DataFrame, path: str) -> None:
    """Entities by their key and activities by their id, each once; a second run adds
    nothing, empty tables add nothing."""
    append_new(entities, f"{path}/entities", ["entity_key"])
    append_new(activities, f"{path}/activities", ["activity"])


def write_run_report(df: DataFrame, path: str) -> None:
    """One JSON line per row, added to those of earlier runs."""
    df.write.mode("append").json(path)
