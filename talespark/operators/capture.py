"""Captured versions: change detection, exact and prefix copies, digests of sets."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_digest(captures: DataFrame) -> DataFrame:
    """Adds sha256 and byte_count of ``content``; null content has neither."""
    return captures.withColumn("sha256", F.sha2("content", 256)).withColumn("byte_count", F.octet_length("content").cast("long"))


def latest_manifest(manifest: DataFrame) -> DataFrame:
    """The last row of each reference."""
    w = Window.partitionBy("source_id", "source_ref").orderBy(F.desc("line_no"))
    return manifest.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def diff_captures(current: DataFrame, manifest: DataFrame, failed: DataFrame | None = None, dry_run: bool = False, schema_version: int | None = None) -> DataFrame:
    """(source_id, source_ref, status): captured (new, changed, or registered under another
    schema version; planned in a dry run), unchanged, deferred (its read failed) or
    bronze-only (the original is gone). All sides carry digests, never contents; a
    reference occurs once in ``current`` and ``failed``, and the manifest's last row counts.
    The manifest's ``schema_version`` is compared where one is asked for."""
    a = current.select("source_id", "source_ref", F.col("sha256").alias("now"), F.lit(False).alias("bad"))
    if failed is not None:
        stop = failed.select("source_id", "source_ref").distinct()
        a = a.join(stop, ["source_id", "source_ref"], "left_anti").unionByName(stop.withColumn("now", F.lit(None).cast("string")).withColumn("bad", F.lit(True)))
    same_schema = F.lit(True) if schema_version is None else F.col("schema_version").eqNullSafe(F.lit(schema_version))
    b = latest_manifest(manifest).select("source_id", "source_ref", F.col("sha256").alias("before"), same_schema.alias("same_schema"))
    status = (
        F.when(F.col("bad"), "deferred").when(F.col("now").isNull(), "bronze-only").when(F.col("before").eqNullSafe(F.col("now")) & F.col("same_schema"), "unchanged")
        .otherwise("planned" if dry_run else "captured")
    )
    return a.join(b, ["source_id", "source_ref"], "full_outer").select("source_id", "source_ref", status.alias("status"))


def merge_manifest(manifest: DataFrame, current: DataFrame, diff: DataFrame) -> DataFrame:
    """The manifest after a capture: captured references with their rows of ``current`` (the
    manifest's columns), all others with their latest row."""
    key = ["source_id", "source_ref"]
    new = diff.filter("status = 'captured'").select(*key)
    kept = latest_manifest(manifest).join(new, key, "left_anti")
    return kept.unionByName(current.join(new, key, "left_semi").select(*kept.columns))


def capture_report(diff: DataFrame, stored: DataFrame | None = None, current: DataFrame | None = None) -> DataFrame:
    """Per source: references discovered (bronze-only ones are not), available for the next
    step, of each status, failed reads, and files created: captured ones whose ``stored``
    copy (source_id, source_ref, sha256) is missing or differs from ``current``. Without
    these two tables every captured file counts as created."""
    key = ["source_id", "source_ref"]
    made = F.col("status") == "captured"
    if stored is not None and current is not None:
        have = stored.join(current, [*key, "sha256"], "left_semi").select(*key, F.lit(True).alias("have"))
        diff, made = diff.join(have, key, "left"), made & F.col("have").isNull()
    count = lambda s: F.count_if(F.col("status") == s).alias(s.replace("-", "_"))
    return diff.groupBy("source_id").agg(
        F.count_if(F.col("status") != "bronze-only").alias("discovered"), F.count_if(F.col("status") != "deferred").alias("available"), count("captured"), count("planned"),
        count("unchanged"), count("bronze-only"), F.count_if(made).alias("created"), F.count_if(F.col("status") == "deferred").alias("failed"),
    )


def group_threads(captures: DataFrame, failed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(threads, failures) of captures (source_id, source_ref, capture_ref, thread_id,
    error). A thread has its references and captures, sorted, without repeats. A capture
    with an error, or without a thread id, is a failure of the stage normalize; ``failed``
    (source_id, source_ref, error) are those of the stage raw."""
    bad = F.col("error").isNotNull()
    nameless = ~bad & (F.coalesce("thread_id", F.lit("")) == "")
    ok = captures.filter(~bad & ~nameless)
    threads = ok.groupBy("source_id", "thread_id").agg(F.sort_array(F.collect_set("source_ref")).alias("source_refs"), F.sort_array(F.collect_set("capture_ref")).alias("capture_refs"))
    reason = F.when(nameless, "missing-thread-metadata").alias("reason")
    failures = captures.filter(bad | nameless).select("source_id", "source_ref", F.lit("normalize").alias("stage"), reason, "error")
    raw = failed.select("source_id", "source_ref", F.lit("raw").alias("stage"), F.lit(None).cast("string").alias("reason"), "error")
    return threads, raw.unionByName(failures)


def collapse_exact(captures: DataFrame) -> DataFrame:
    """Of equal digests in a thread, the smallest reference: partial minimum, no window."""
    return captures.groupBy("thread", "sha256").agg(F.min("source_ref").alias("source_ref"))


def _prefix_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each content, the digests of its first bytes at every length in ``cuts`` that is
    shorter: one pass over the content, whatever the number of lengths."""
    for b in batches:
        out = []
        for thread, cuts, content in zip(b.column("thread"), b.column("cuts"), b.column("content")):
            data, digest, at = memoryview(content.as_buffer()), hashlib.sha256(), 0
            for cut in sorted(cuts.as_py()):
                if cut >= len(data):
                    break
                digest.update(data[at:cut])
                at = cut
                out.append((thread, cut, digest.copy().hexdigest()))
        thread, size, sha = zip(*out) if out else ((), (), ())
        kind = b.schema.field("thread").type
        yield pa.RecordBatch.from_arrays([pa.array([t.as_py() for t in thread], kind), pa.array(size, pa.int64()), pa.array(sha, pa.string())], names=["thread", "size", "sha256"])


def prefix_versions(captures: DataFrame) -> DataFrame:
    """(thread, sha256) of versions whose bytes begin a longer version of the thread.

    A thread's lengths, and the digests of every version's first bytes at these, are compared
    by equality; contents are read, but neither sorted nor compared, and leave their tasks
    once at most: only where the table of lengths is too large for Spark to broadcast. Null
    contents begin none; an empty content begins every other one.
    """
    sized = captures.filter("content IS NOT NULL").select("thread", "sha256", F.octet_length("content").cast("long").alias("size"))
    versions = sized.groupBy("thread", "sha256").agg(F.first("size").alias("size"))
    cuts = versions.groupBy("thread").agg(F.collect_set("size").alias("cuts")).filter(F.size("cuts") > 1)
    kind = dict(captures.dtypes)["thread"]
    begun = captures.filter("content IS NOT NULL").select("thread", "content").join(cuts, "thread").mapInArrow(_prefix_digests, f"thread {kind}, size long, sha256 string")
    return versions.join(begun, ["thread", "size", "sha256"], "left_semi").select("thread", "sha256")


def collapse_prefixes(captures: DataFrame) -> DataFrame:
    """Drop versions whose bytes begin a longer version of the thread."""
    return captures.join(prefix_versions(captures), ["thread", "sha256"], "left_anti").select(*captures.columns)


def last_versions(captures: DataFrame) -> DataFrame:
    """(thread, sha256, byte_count) of the different versions that begin no longer one of
    their thread. Versions are told apart by their digests, so no content is shuffled for it."""
    versions = captures.select("thread", "sha256", "byte_count").distinct()
    return versions.join(prefix_versions(captures), ["thread", "sha256"], "left_anti")


def set_digest(digests: Column) -> Column:
    """SHA-256 of sorted digests as a compact JSON array."""
    return F.sha2(F.concat(F.lit('["'), F.array_join(F.sort_array(digests), '","'), F.lit('"]')), 256)


def verify_captures(manifest: DataFrame, stored: DataFrame, blocked: DataFrame) -> DataFrame:
    """(source_ref, fault) of latest manifest rows whose stored bytes are gone (missing) or
    differ (digest). A reference whose current read failed is left out: it must not fall
    back to an older capture, so it is ``blocked`` instead."""
    rows = latest_manifest(manifest).select("source_ref", F.col("sha256").alias("want"))
    have = stored.select("source_ref", "sha256")
    stop = blocked.select("source_ref").distinct()
    fault = F.when(F.col("sha256").isNull(), "missing").when(F.col("sha256") != F.col("want"), "digest")
    checked = rows.join(stop, "source_ref", "left_anti").join(have, "source_ref", "left").select("source_ref", fault.alias("fault")).filter("fault IS NOT NULL")
    return checked.unionByName(rows.join(stop, "source_ref", "left_semi").select("source_ref", F.lit("blocked").alias("fault")))
