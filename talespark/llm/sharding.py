"""Sharding by global byte-size prefix sums.

Documents are put in one global order by the MD5 of their text, so equal texts
are neighbours. The order is cut into contiguous shards at equal byte targets.
The global prefix sum is made from per-partition totals: the order is divided
into ``n_bins`` ranges of the digest, each range is summed on its own, the
running total over the (fixed number of) ranges gives each range's start, and a
running sum inside the range does the rest. A group of equal texts may hold any
share of the rows: rows are dealt by (digest, salt), never by the digest alone,
and are numbered inside such a cell only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import pick, read

N_SHARDS = 8


def shard_documents(
    docs: DataFrame, n_shards: int = N_SHARDS, id_col: str = "doc_id", text_col: str = "text", salt_digits: int = 3, hex_digits: int = 3
) -> DataFrame:
    """All columns of ``docs`` plus ``shard`` (int) and ``slot`` (long).

    A document weighs the UTF-8 bytes of its text plus 1. Equal texts are never
    parted: a group goes to the shard in which its middle byte lies, so a shard
    differs from the equal target by at most the largest group at each end.
    ``slot`` numbers a shard's rows from 0 in the global order (digest, salt, id). The
    salt is the first ``salt_digits`` hexadecimal digits of the MD5 of the id as text, so
    ids of any type and step deal a group of equal texts to 4,096 cells alike.

    Null texts form one group and weigh 1 each; empty texts likewise. Rows with
    equal id and text are kept, in neighbouring slots, and are one cell; so are a
    group's null ids, which come in the cell of salt 0, before its ids. Input
    columns named ``shard`` or ``slot`` are replaced. An empty table gives no rows.
    """
    text = plain_column(docs, text_col)
    size, key = (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long"), F.coalesce(F.md5(text.cast("binary")), F.lit(""))
    return shard_rows(docs, size, key, n_shards, id_col, salt_digits, hex_digits)


def plain_column(df: DataFrame, name: str) -> Column:
    """The first column of exactly this name, in ``df`` with its columns called c0, c1, ..."""
    return F.col(f"c{df.columns.index(name)}")


def shard_rows(docs: DataFrame, size: Column, key: Column, n_shards: int = N_SHARDS, id_col: str = "doc_id", salt_digits: int = 3, hex_digits: int = 3) -> DataFrame:
    """:func:`shard_documents` of rows that need not hold their texts: ``size`` is a row's
    weight and ``key`` the hexadecimal digest of its text (empty: no text), both over
    :func:`plain_column`. Only ``key``, ids and the columns given are shuffled."""
    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    cid = f"c{docs.columns.index(id_col)}"
    salt = F.conv(F.substring(F.md5(F.col(cid).cast("string").cast("binary")), 1, salt_digits), 16, 10).cast("int")
    rows = plain.select("*", size.alias("_size"), key.alias("_key"), F.coalesce(salt, F.lit(0)).alias("_salt"))
    cells = rows.groupBy("_key", "_salt").agg(F.count("*").alias("_n"), F.sum("_size").alias("_bytes"))
    in_group = Window.partitionBy("_key").orderBy("_salt")
    cells = cells.select(
        "_key", "_salt", "_n", "_bytes", (F.sum("_n").over(in_group) - F.col("_n")).alias("_cell_start")
    )
    groups = cells.groupBy("_key").agg(F.sum("_n").alias("_n"), F.sum("_bytes").alias("_bytes")).withColumn("_bin", F.substring("_key", 1, hex_digits))
    # At most 16**hex_digits + 1 ranges, whatever the input: their running total is a tiny job.
    bins = groups.groupBy("_bin").agg(F.sum("_n").alias("_n"), F.sum("_bytes").alias("_bytes"))
    before = Window.orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    bins = bins.select(
        "_bin",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_row0"),
        F.coalesce(F.sum("_bytes").over(before), F.lit(0)).alias("_byte0"),
        F.sum("_bytes").over(everything).alias("_total"),
    )
    in_bin = Window.partitionBy("_bin").orderBy("_key").rowsBetween(Window.unboundedPreceding, -1)
    placed = groups.join(F.broadcast(bins), "_bin").select(
        "_key",
        (F.col("_row0") + F.coalesce(F.sum("_n").over(in_bin), F.lit(0))).alias("_group_row"),
        F.least(
            F.lit(n_shards - 1),
            F.floor((2 * (F.col("_byte0") + F.coalesce(F.sum("_bytes").over(in_bin), F.lit(0))) + F.col("_bytes")) * n_shards / (2 * F.col("_total"))),
        ).cast("int").alias("_shard"),
    )
    first = placed.groupBy("_shard").agg(F.min("_group_row").alias("_first"))  # n_shards rows
    placed = placed.join(F.broadcast(first), "_shard").select("_key", "_shard", (F.col("_group_row") - F.col("_first")).alias("_base"))
    plan = cells.join(placed, "_key").select("_key", "_salt", "_shard", (F.col("_base") + F.col("_cell_start")).alias("_base"))
    in_cell = Window.partitionBy("_key", "_salt").orderBy(cid)
    out = rows.join(plan, ["_key", "_salt"]).withColumn("_slot", F.col("_base") + F.row_number().over(in_cell) - 1)
    kept = [F.col(f"c{i}").alias(n) for i, n in enumerate(docs.columns) if n.lower() not in ("shard", "slot")]
    return out.select(*kept, F.col("_shard").alias("shard"), F.col("_slot").cast("long").alias("slot"))


def write_shards(sharded: DataFrame, path: str) -> None:
    """Write the output of :func:`shard_documents` as one folder for each shard."""
    sharded.write.partitionBy("shard").parquet(path)


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    narrow = pick(read(spark, sf_dir, "documents"), "doc_id", "text").select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.coalesce(F.md5(F.col("text").cast("binary")), F.lit("")).alias("digest")
    )
    out = shard_rows(narrow, plain_column(narrow, "size"), plain_column(narrow, "digest"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


#: CRC-32 is folded over the bytes with a table that is itself built by rule.
OP3_SQL = r"""
WITH RECURSIVE
tbl AS (SELECT list(v ORDER BY i) AS t FROM (
  SELECT i, list_reduce(list_prepend(i, range(8)), lambda a, k: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS v
  FROM (SELECT unnest(range(256)) AS i))),
d AS (
  SELECT row_number() OVER () AS rid, doc_id, text, coalesce(strlen(text), 0) + 1 AS size, coalesce(md5(text), '') AS k,
         coalesce(substr(md5(doc_id::VARCHAR), 1, 3), '000') AS salt FROM documents),
hx AS (SELECT k, hex(encode(any_value(text))) AS h FROM d WHERE text IS NOT NULL GROUP BY k),
crc AS (
  SELECT k, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(h), 2), lambda i: ((instr('0123456789ABCDEF', substr(h, i, 1)) - 1) * 16 + instr('0123456789ABCDEF', substr(h, i + 1, 1)) - 1)::BIGINT)),
           lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295::BIGINT) AS c FROM hx, tbl),
g AS (SELECT k, sum(size) AS b FROM d GROUP BY k),
p AS (SELECT k, least(7, ((2 * (sum(b) OVER (ORDER BY k) - b) + b) * 8) // (2 * sum(b) OVER ())) AS shard FROM g)
SELECT d.doc_id, d.size::BIGINT AS size, coalesce(crc.c, 0)::BIGINT AS text_crc32, 'bytes' AS law, p.shard::INTEGER AS shard,
       (row_number() OVER (PARTITION BY p.shard ORDER BY d.k, d.salt, d.doc_id NULLS FIRST) - 1)::BIGINT AS slot, NULL::INTEGER AS grown_shard
FROM d JOIN p USING (k) LEFT JOIN crc USING (k)
"""
