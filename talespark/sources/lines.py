"""Numbered lines of log files that many tasks read, each a part of a file.

Spark's text reader cuts files into blocks and hands each line to the block in which it
starts, whatever ends it (CR, LF or CRLF, also across a cut); a byte order mark at a
file's start is not part of its first line. A line's number is the count of lines in the
blocks before its own, a prefix sum over a row for each block, plus its place in the block.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from talespark.functions.text import strip
from talespark.sources.tables import written


def _blocks(spark: SparkSession, path: str, glob: str) -> DataFrame:
    """(path, block, place, raw) of all lines, blank ones too. ``place`` counts up within a
    block. The table is written, so that later steps see the cuts of one single read:
    where Spark cuts a file may depend on the cores that it has at the time."""
    scan = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(path)
    meta = F.col("_metadata")
    return written(scan.select(meta["file_path"].alias("path"), meta["file_block_start"].alias("block"), F.monotonically_increasing_id().alias("place"), F.col("value").cast("binary").alias("raw")), "lines")


def file_lines(spark: SparkSession, path: str, glob: str = "*.jsonl") -> tuple[DataFrame, DataFrame]:
    """(lines, unreadable): (path, line_no from 1, raw) of all files below ``path``, blank
    lines left out but counted, text trimmed; and (path) of files that are not UTF-8, which
    give no lines. A file of any size is read by as many tasks as it has blocks; only one
    row for each block is gathered by file. An empty file has no rows."""
    rows = _blocks(spark, path, glob)
    bad = ~F.is_valid_utf8(F.col("raw").cast("string"))
    blocks = rows.groupBy("path", "block").agg(F.min("place").alias("_first"), F.count("*").alias("_n"), F.bool_or(bad).alias("_bad"))
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).withColumn("_bad", F.bool_or("_bad").over(Window.partitionBy("path")))
    good = blocks.filter("NOT _bad").select("path", "block", (F.col("_before") - F.col("_first") + 1).alias("_shift"))
    lines = rows.join(good, ["path", "block"]).select("path", (F.col("place") + F.col("_shift")).alias("line_no"), strip(F.col("raw").cast("string")).alias("raw"))
    return lines.filter("raw <> ''"), blocks.filter("_bad").select("path").distinct()
