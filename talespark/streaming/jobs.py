"""Incremental versions: capture, idle sessions, de-duplication, planning of late changes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from talespark.functions.text import event_epoch, name_uuid, normalize_text
from talespark.operators.capture import with_digest
from talespark.sources.logs import below
from talespark.sources.tables import written
from talespark.streaming.snapshots import read_snapshot, upsert_snapshot

CAPTURE_SCHEMA = "path string, modificationTime timestamp, length long, content binary"


#: A manifest's row.
MANIFEST = "source_id string, source_ref string, sha256 string, byte_count long, captured_in long"


def stream_captures(spark: SparkSession, root: str, manifest: str, checkpoint: str, source_id: str, archived: bool = False) -> StreamingQuery:
    """Keeps one manifest of log files as they arrive, and says of each arrival what it was.

    Files lie below ``root`` in ``sessions`` (and ``archived_sessions``, if asked for), or in such
    folders of deliveries, which are any folders between: a log that grows comes again in
    a later delivery. Spark's file stream leaves out empty files. Per batch the last arrival of a reference counts. ``seen/_batch=n`` gets
    captured (new or changed), unchanged (the content is that of the manifest), or deferred
    (the file changed while it was read; it is left as it was). ``rows`` is a snapshot table
    in which captured references are replaced. A batch that is run again finds the manifest
    as it was, and replaces what it wrote.
    """
    files = spark.readStream.format("binaryFile").schema(CAPTURE_SCHEMA).option("recursiveFileLookup", True).option("pathGlobFilter", "*.jsonl").load(root)
    folders = "(?:archived_)?sessions" if archived else "sessions"
    ref = F.regexp_extract(F.concat(F.lit("/"), below(F.col("path"), root)), rf"^(?:/[^/]+?)*?/({folders}/.*)$", 1)
    found = with_digest(files.withColumn("source_ref", ref)).filter("source_ref <> ''").drop("content", "path")

    def save(batch: DataFrame, number: int) -> None:
        new = F.struct("sha256", "byte_count", (F.col("byte_count") == F.col("length")).alias("whole"))
        last = batch.groupBy("source_ref").agg(F.max_by(new, F.struct("modificationTime", "sha256")).alias("n")).select(F.lit(source_id).alias("source_id"), "source_ref", "n.*")
        before = read_snapshot(spark, f"{manifest}/rows", MANIFEST, number).select("source_id", "source_ref", F.col("sha256").alias("was"))
        status = F.when(~F.coalesce("whole", F.lit(False)), "deferred").when(F.col("was").eqNullSafe(F.col("sha256")), "unchanged").otherwise("captured")
        x = last.join(before, ["source_id", "source_ref"], "left").withColumn("status", status)
        x.select("source_id", "source_ref", "status", "sha256", "byte_count").write.mode("overwrite").parquet(f"{manifest}/seen/_batch={number}")
        seen = spark.read.parquet(f"{manifest}/seen/_batch={number}")
        captured = seen.filter("status = 'captured'").withColumn("captured_in", F.lit(number).cast("long"))
        upsert_snapshot(spark, f"{manifest}/rows", MANIFEST, captured, ["source_id", "source_ref"], number)

    return found.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_idle_sessions(events: DataFrame, key: str, time: str, minutes: int = 30, delay: str = "10 minutes") -> DataFrame:
    """Sessions that have ended: in append mode one is given out when the watermark has
    passed its gap, which also frees its state."""
    s = events.withWatermark(time, delay).groupBy(key, F.session_window(time, f"{minutes} minutes").alias("s")).agg(F.count("*").alias("events"), F.max(time).alias("last_at"))
    return s.select(key, F.col("s.start").alias("first_at"), "last_at", "events")


def stream_dedupe(events: DataFrame, time: str = "ts", delay: str = "30 minutes") -> DataFrame:
    """Mirrored messages once each while the watermark keeps them; the state holds a
    digest in place of the text."""
    keyed = events.withColumn("_key", F.sha2(normalize_text(F.col("text")), 256)).withWatermark(time, delay)
    return keyed.dropDuplicatesWithinWatermark(["thread", "kind", "actor", "turn_id", "_key"]).drop("_key")


def stream_plan(events: DataFrame, history: Callable[[DataFrame], DataFrame], plan: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """For each batch, all events of the threads that it touches (``history`` reads them
    for a table of threads) are planned anew, so a late event makes its thread eligible
    again under the same identity. ``plan`` must accept a batch number twice."""

    def each(batch: DataFrame, number: int) -> None:
        plan(history(batch.select("thread").distinct()), number)

    return events.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


EVENTS = "thread string, event_id string, at string, digest string"
LEDGER = "thread string, note_id string, fingerprint string, made_in long"
PLAN = "thread string, note_id string, fingerprint string, last_event_at string, reason string"


def stream_notes(events: DataFrame, make: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> StreamingQuery:
    """Events (thread, event_id, at, text) to notes, planned anew when late events arrive.

    Below ``path``: ``events``, a snapshot of all events by (thread, event_id), of which the
    first arrival counts; ``plan/_batch=n``, the threads that batch n makes eligible (new, or
    changed since their note); ``ledger``, a snapshot of the notes made. ``make`` gets the plan
    and returns (thread) of the notes that it made; others stay eligible when their thread is
    next touched, or, as ``retry``, in the next batch. A thread keeps its note's id. A batch that
    is run again reads all three as they were before it and replaces its own part, so ``make``
    must accept a plan twice. A redelivered event changes nothing.
    """
    spark = events.sparkSession
    keys = ["thread", "event_id"]

    def each(batch: DataFrame, number: int) -> None:
        digest = F.sha2(F.concat_ws("\n", "event_id", F.coalesce("at", F.lit("")), normalize_text(F.coalesce("text", F.lit("")))), 256)
        arrived = batch.groupBy(*keys).agg(F.min(F.struct("at", digest.alias("digest"))).alias("e")).select(*keys, "e.at", "e.digest")
        have = read_snapshot(spark, f"{path}/events", EVENTS, number)
        fresh = written(arrived.join(have.select(*keys), keys, "left_anti"), "fresh-events")
        upsert_snapshot(spark, f"{path}/events", EVENTS, fresh, keys, number)
        ledger = read_snapshot(spark, f"{path}/ledger", LEDGER, number).drop("_bucket")
        open_ = _plans(spark, path, number).join(ledger.select("thread", "fingerprint"), ["thread", "fingerprint"], "left_anti").select("thread").distinct()
        touched = written(fresh.select("thread").union(open_).distinct(), "touched-threads")
        mine = have.drop("_bucket").select(*keys, "at", "digest").unionByName(fresh.select(*keys, "at", "digest")).join(touched, "thread", "left_semi")
        # of any number of events in any order: their count and the sum of their hashes
        total = F.sum(F.xxhash64("digest").cast("decimal(38,0)"))
        now = mine.groupBy("thread").agg(F.sha2(F.concat_ws(":", F.count("*"), total.cast("string"), F.min("digest"), F.max("digest")), 256).alias("fingerprint"), F.max_by("at", event_epoch(F.col("at"))).alias("last_event_at"))
        x = now.join(ledger.select("thread", "note_id", F.col("fingerprint").alias("was")), "thread", "left").filter(~F.col("was").eqNullSafe(F.col("fingerprint")))
        reason = F.when(F.col("was").isNotNull(), "late-event").otherwise("new")
        plan = x.select("thread", F.coalesce("note_id", name_uuid(F.col("thread"))).alias("note_id"), "fingerprint", "last_event_at", reason.alias("reason"))
        plan.write.mode("overwrite").parquet(f"{path}/plan/_batch={number}")
        plan = spark.read.schema(PLAN).parquet(f"{path}/plan/_batch={number}")
        made = plan.join(make(plan).select("thread").distinct(), "thread", "left_semi").withColumn("made_in", F.lit(number).cast("long"))
        upsert_snapshot(spark, f"{path}/ledger", LEDGER, written(made, "made-notes"), ["thread"], number)

    return events.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _plans(spark: SparkSession, path: str, before: int) -> DataFrame:
    """Plans of the batches before ``before``."""
    try:
        rows = spark.read.schema(f"{PLAN}, _batch long").parquet(f"{path}/plan")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], PLAN)
    return rows.filter(F.col("_batch") < before).drop("_batch")
