"""WARC archives: write pages as records, read records back by boundary-chain
verification.

Writing uses Spark's text sink, so archives land in any file system Spark knows.
Reading splits the archives at the record magic: every piece that starts after a
magic is a candidate record. Each task derives, from the declared lengths, where a
candidate's successor would start. Chains are contracted inside a split; then
pointer jumping over the splits, from the start of each file, tells where chains
enter each split, and only candidates on these chains are records. A magic inside a
payload is never reached.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, materialize, new_path, pick, read, skewed_join

MAGIC = "WARC/1.1\r\n"
EOL = "\r\n"
DEAD = -1


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 SHA-1: 40 bits at a time are written in base 32 and
    moved to the RFC 4648 alphabet."""
    h = F.sha1(payload.cast("binary"))
    digits = F.concat(*(F.lpad(F.conv(F.substring(h, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)))
    return F.translate(F.upper(digits), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0, date: str = "2000-01-01T00:00:00Z") -> None:
    """Write one record for each row of (page_id, url, html) below ``path``.

    Of pages with equal payloads of at least ``min_bytes``, the one with the largest
    page_id is a ``response``; the others are ``revisit`` records without payload
    that refer to it and carry its digest and size. Null html is an empty payload, a
    null url has no target field, a null id an empty id field; rows that repeat the
    largest id are all responses. Line ends in a url are percent-encoded.
    """
    rows = pick(pages, "page_id", "url", "html").withColumn("html", F.coalesce("html", F.lit("")))
    rows = rows.withColumn("bytes", F.octet_length("html")).withColumn("digest", base32_sha1(F.col("html")))
    # equal payloads are found without the payloads, and only their ids are joined back
    narrow = materialize(rows.filter(F.col("bytes") >= min_bytes).select("page_id", "digest"), "digests")
    owner = materialize(narrow.groupBy("digest").agg(F.max("page_id").alias("owner"), F.count("*").alias("n")).filter("n > 1"), "owners")
    again = skewed_join(narrow, owner, "digest", "n").filter("NOT page_id <=> owner").select(F.col("page_id").alias("_id"), F.col("digest").alias("_digest"), "owner").distinct()
    again = materialize(again, "revisits")
    # a written table: where few pages are copies Spark broadcasts it, by its size, and no payload is shuffled
    rows = rows.join(again, F.col("page_id").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_digest")), "left")
    revisit = F.col("_digest").isNotNull()
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{EOL}Content-Type: text/html; charset=utf-8{EOL}Content-Length: "), F.col("bytes").cast("string"), F.lit(EOL + EOL))
    block = F.when(revisit, http).otherwise(F.concat(http, "html"))
    page = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(">"))
    field = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(EOL))
    url = F.replace(F.replace("url", F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    record = F.concat(
        F.lit(MAGIC),
        field("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        field("WARC-Record-ID", page("page_id")),
        field("WARC-Date", F.lit(date)),
        F.when(F.col("url").isNotNull(), field("WARC-Target-URI", url)).otherwise(""),
        field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")),
        F.when(revisit, F.concat(field("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), field("WARC-Refers-To", page("owner")))).otherwise(""),
        field("Content-Type", F.lit("application/http; msgtype=response")),
        field("Content-Length", F.octet_length(block).cast("string")),
        F.lit(EOL),
        block,
        F.lit(EOL),  # the sink's line end is the second of the record's two
    )
    rows.select(record.alias("value")).write.option("lineSep", EOL).text(path)
    for table in (narrow, owner, again):
        discard(table)


FIELD = {k: re.compile(rb"(?im)^" + k.encode() + rb":[ \t]*([^\r\n]*)") for k in ("WARC-Type", "WARC-Record-ID", "WARC-Refers-To", "WARC-Target-URI", "WARC-Payload-Digest", "Content-Length")}
HTTP_LENGTH = re.compile(rb"(?im)^Content-Length:[ \t]*([0-9]{1,15})[ \t]*\r?$")
#: A declared length is 1 to 15 ASCII digits: an offset plus such a length is always a long.
LENGTH = re.compile(r"[0-9]{1,15}")


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def read_block(block: bytes, revisit: bool) -> tuple[int, str | None]:
    """(payload bytes, digest) of an HTTP block; a revisit has the size only, 0 if none
    can be read."""
    head, _, payload = block.partition(b"\r\n\r\n")
    if revisit:
        m = HTTP_LENGTH.search(head)
        return (int(m[1]) if m else 0), None
    return len(payload), digest(payload)


def pieces(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, value): what lies between magics, in file order inside a split."""
    text = spark.read.option("lineSep", MAGIC).text(path)
    return text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("value"))


def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, int, int, bytes]]:
    """(file, split, number in the split, start of the piece counted from the split's
    first piece, bytes) in reading order."""
    at, i, pos = None, 0, 0
    for batch in batches:
        for file, block, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            if at != (file, block):
                at, i, pos = (file, block), 0, 0
            data = value.as_py()
            yield file, block, i, pos, data
            i, pos = i + 1, pos + len(data) + len(MAGIC)


CANDIDATE = "file string, block long, i long, start long, size long, head long, length long, type string, id string, refers string, url string, declared string, whole boolean, payload_bytes long, payload_digest string"


def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in CANDIDATE.split(", ")]
    kinds = [{"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}[x.split()[1]] for x in CANDIDATE.split(", ")]
    rows: list[tuple] = []
    for file, block, i, start, data in numbered(batches):
        end = data.find(b"\r\n\r\n")
        got = {k: (m[1].decode("utf-8", "replace") if (m := p.search(data[: max(end, 0)])) else None) for k, p in FIELD.items()}
        length = int(got["Content-Length"]) if end >= 0 and LENGTH.fullmatch((got["Content-Length"] or "").strip()) else None
        whole = length is not None and end + 4 + length + 4 == len(data)
        size, dig = read_block(data[end + 4 : end + 4 + length], got["WARC-Type"] == "revisit") if whole else (None, None)
        rows.append((file, block, i, start, len(data), end + 4, length, got["WARC-Type"], got["WARC-Record-ID"], got["WARC-Refers-To"], got["WARC-Target-URI"], got["WARC-Payload-Digest"], whole, size, dig))
        if len(rows) >= 5000:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)
            rows = []
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)


def contract(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of one split: where each candidate's chain leaves the split."""
    pdf = pdf.sort_values("off")
    off, succ = pdf["off"].to_numpy(), pdf["succ"].to_numpy()
    last, at = off[-1], {int(o): k for k, o in enumerate(off)}
    leave = np.full(len(off), DEAD, np.int64)
    for k in range(len(off) - 1, -1, -1):
        s = int(succ[k])
        leave[k] = s if s > last else leave[at[s]] if s in at else DEAD
    return pd.DataFrame({"file": pdf["file"], "block": pdf["block"], "off": off, "succ": succ, "leave": leave})


def walk(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of one split: the candidates on chains from its entries."""
    succ = dict(zip(pdf["off"].tolist(), pdf["succ"].tolist()))
    on = set()
    for at in pdf.loc[pdf["entry"], "off"].tolist():
        while at in succ and at not in on:
            on.add(at)
            at = succ[at]
    return pdf.loc[pdf["off"].isin(on), ["file", "off"]]


def reachable(candidates: DataFrame) -> DataFrame:
    """(file, off) of the candidates reached from the start of each file, for
    (file, block, off, succ). Rounds grow as the logarithm of a file's splits."""
    jump = materialize(candidates.groupBy("file", "block").applyInPandas(contract, "file string, block long, off long, succ long, leave long"), "jumps")
    step = jump.filter(F.col("leave") != DEAD).select("file", "off", F.col("leave").alias("to"))
    entries = materialize(jump.filter("off = 0").select("file", "off"), "entries")
    seen = entries.count()
    while True:
        entries = materialize(entries.union(entries.join(step.hint("merge"), ["file", "off"]).select("file", F.col("to").alias("off"))).distinct(), "entries")
        now = entries.count()
        if now == seen:
            break
        seen = now
        onward = step.select("file", F.col("off").alias("to"), F.col("to").alias("beyond"))
        step = materialize(step.join(onward.hint("merge"), ["file", "to"]).select("file", "off", F.col("beyond").alias("to")), "steps")
    marked = jump.join(entries.withColumn("entry", F.lit(True)).hint("merge"), ["file", "off"], "left").withColumn("entry", F.coalesce("entry", F.lit(False)))
    return marked.select("file", "block", "off", "succ", "entry").groupBy("file", "block").applyInPandas(walk, "file string, off long")


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per record: file, offset, length (of the block), type, id, refers, url,
    declared (its WARC-Payload-Digest field), payload_bytes, payload_digest (computed;
    null for revisits, which hold no payload), complete.

    Only records on the chain from a file's start count. A record cut off by the end
    of its file is given with ``complete`` false and the payload that is there. A head
    that is cut off, or whose Content-Length is missing or not 1 to 15 ASCII digits, is
    no record and ends the chain; inside a payload such heads do no harm. Fields that
    are missing are null; ids may repeat; an empty archive gives no rows.
    """
    got = materialize(pieces(spark, path).mapInArrow(scan, CANDIDATE), "candidates")
    splits = got.groupBy("file", "block").agg(F.sum(F.col("size") + len(MAGIC)).alias("total"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.select("file", "block", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    # until the chains are known, only places and lengths are carried along
    placed = got.select("file", "block", "i", "start", "head", "length").join(splits.hint("merge"), ["file", "block"]).withColumn("off", F.col("base") + F.col("start") - len(MAGIC))
    placed = placed.filter("off >= 0").withColumn("succ", F.when(F.col("length").isNotNull(), F.col("off") + len(MAGIC) + F.col("head") + F.col("length") + 4).otherwise(F.lit(DEAD)))
    placed = materialize(placed.select("file", "block", "i", "off", "succ"), "placed")
    chained = materialize(placed.join(reachable(placed.select("file", "block", "off", "succ")).hint("merge"), ["file", "off"]).filter(F.col("succ") != DEAD), "chained")
    records = materialize(got.drop("start", "size").join(chained.hint("merge"), ["file", "block", "i"]), "records")
    discard(got)
    out = ["file", F.col("off").alias("offset"), "length", "type", "id", "refers", "url", "declared"]
    whole = records.filter("whole").select(*out, "payload_bytes", "payload_digest", F.lit(True).alias("complete"))
    if not records.filter("NOT whole").limit(1).count():
        return whole
    # payloads that hold a magic: their pieces are read again and put together
    chain = Window.partitionBy("file").orderBy("off")
    parts = placed.join(records.select("file", "off", F.struct("off", "succ", "whole").alias("mark")).hint("merge"), ["file", "off"], "left")
    parts = parts.withColumn("own", F.last("mark", True).over(chain)).filter("NOT own.whole AND off < own.succ").select("file", "block", "i", "off", F.col("own.off").alias("own"))

    def raw(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        for file, block, i, _, data in numbered(pa.RecordBatch.from_pandas(b, preserve_index=False) for b in batches):
            yield pd.DataFrame({"file": [file], "block": [block], "i": [i], "data": [data]})

    again = pieces(spark, path).mapInPandas(raw, "file string, block long, i long, data binary")
    joined = again.join(parts.hint("merge"), ["file", "block", "i"]).join(records.select("file", F.col("off").alias("own"), "head", "length", "type").hint("merge"), ["file", "own"])

    def gather(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("off")
        first = pdf.iloc[0]
        body = MAGIC.encode().join(pdf["data"])[first["head"] :]
        block = body[: first["length"]]
        size, dig = read_block(block, first["type"] == "revisit")
        return pd.DataFrame({"file": [first["file"]], "off": [first["own"]], "payload_bytes": [size], "payload_digest": [dig], "complete": [len(block) == first["length"]]})

    rest = joined.groupBy("file", "own").applyInPandas(gather, "file string, off long, payload_bytes long, payload_digest string, complete boolean")
    return whole.union(records.drop("payload_bytes", "payload_digest").join(rest.hint("merge"), ["file", "off"]).select(*out, "payload_bytes", "payload_digest", "complete"))


def page_of(urn: str) -> Column:
    return F.regexp_extract(urn, r"^<urn:page:(-?\d+)>$", 1).try_cast("long")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    write_archives(read(spark, sf_dir, "pages"), path)
    # a revisit holds no payload: the digest of the whole one is the one that it declares
    digest = F.coalesce("payload_digest", F.regexp_extract("declared", r"^sha1:([A-Z2-7]{32})$", 1))
    return read_archives(spark, path).select(page_of("id").alias("page_id"), "payload_bytes", digest.alias("payload_digest"), F.col("type").alias("record_type"), page_of("refers").alias("refers_to"))


OP6_SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
h AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha1(html) AS x, max(page_id) OVER (PARTITION BY html) AS owner FROM p),
d AS (SELECT *, array_to_string(list_transform(range(32), lambda i:
  substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    (((((instr('0123456789abcdef', substr(x, ((5 * i) // 4 + 1)::INTEGER, 1)) - 1) * 16 + (instr('0123456789abcdef', substr(x || '0', ((5 * i) // 4 + 2)::INTEGER, 1)) - 1)) >> (3 - (5 * i) % 4)::INTEGER) & 31) + 1)::INTEGER, 1)), '') AS payload_digest FROM h)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id IS NOT DISTINCT FROM owner THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM owner THEN owner END AS refers_to FROM d
"""
