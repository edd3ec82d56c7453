"""Which threads need work: fingerprints, changes, candidates, rebuilds, ledgers."""

from __future__ import annotations

import hashlib
import json
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talespark.functions.text import event_epoch


def generator_fingerprint(settings: dict[str, Any]) -> str:
    """Digest of a generator's settings: one small record, so made on the driver."""
    return hashlib.sha256(json.dumps(settings, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def generation_fingerprint(settings: dict[str, Any]) -> Column:
    """Digest of what a note is made from. Columns: fingerprint, capture_sha256, source_set_sha256."""
    parts = (F.coalesce(c, F.lit("")) for c in ("fingerprint", "capture_sha256", "source_set_sha256"))
    return F.sha2(F.concat_ws(":", *parts, F.lit(generator_fingerprint(settings))), 256)


def note_is_current(candidates: DataFrame, notes: DataFrame, values: dict[str, str]) -> DataFrame:
    """(thread, current): a note of the thread carries the candidate's fingerprint,
    capture and set digest, all ``values`` in its columns, and a version 4 UUID."""
    n = notes.toDF(*(c if c == "thread" else f"n_{c}" for c in notes.columns))
    same = [F.col(c).eqNullSafe(F.col(f"n_{c}")) for c in ("fingerprint", "capture_sha256", "source_set_sha256")]
    same += [F.col(f"n_{k}").eqNullSafe(F.lit(v)) for k, v in values.items()]
    ok = F.coalesce(F.col("n_note_id").rlike("^[0-9a-f]{8}-[0-9a-f]{4}-4[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$"), F.lit(False))
    for s in same:
        ok = ok & s
    return candidates.join(n, "thread", "left").groupBy("thread").agg(F.bool_or(ok).alias("current"))


def time_filter(threads: DataFrame, watermark: str, now: str, idle_minutes: int = 30, backfill: bool = False) -> DataFrame:
    """Idle threads that end at or after the watermark; with ``backfill``, before it. Times
    without a zone are local; threads without a readable time are left out."""
    last, mark = event_epoch(F.col("last_event_at")), event_epoch(F.lit(watermark))
    idle = last <= event_epoch(F.lit(now)) - idle_minutes * 60
    return threads.filter(idle & ((last < mark) if backfill else (last >= mark)))


def classify_change(candidates: DataFrame, state: DataFrame) -> DataFrame:
    """Adds ``change``: eligible, stale-generator (same source, other generator; to be made
    again as well) or unchanged. ``state`` has (thread, fingerprint, capture_sha256, generation)."""
    s = state.select("thread", *(F.col(c).alias(f"p_{c}") for c in ("fingerprint", "capture_sha256", "generation")))
    capture = (F.coalesce("capture_sha256", F.lit("")) == "") | F.col("capture_sha256").eqNullSafe(F.col("p_capture_sha256"))
    same = capture & F.col("fingerprint").eqNullSafe(F.col("p_fingerprint"))
    change = F.when(same & F.col("generation").eqNullSafe(F.col("p_generation")), "unchanged").when(same, "stale-generator").otherwise("eligible")
    return candidates.join(s, "thread", "left").withColumn("change", change).drop("p_fingerprint", "p_capture_sha256", "p_generation")


def _optional(threads: DataFrame, col: str, default: Any) -> Column:
    return F.coalesce(F.col(col), F.lit(default)) if col in threads.columns else F.lit(default)


def _excluded(x: DataFrame, listed: Column, single: str) -> DataFrame:
    """Excluded rows with the reason and the ids of the projects that it concerns."""
    none = F.array().cast(dict(x.dtypes)["candidates"])
    ids = F.when(F.col("reason") == single, F.array("project")).when(F.col("reason") == "ambiguous-project", F.col("candidates")).otherwise(none)
    return x.filter(F.col("reason").isNotNull() & listed).select("thread", "reason", ids.alias("candidates"))


def scan_candidates(threads: DataFrame, project: Any = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(candidates, counts, excluded) of threads: candidates are eligible or have a stale
    generator; counts are one row of twelve; excluded are (thread, reason, candidates), where
    the first reason that holds counts. Threads outside the time window and those not
    selected are counted as ignored only. Columns: thread, in_time, internal, user_messages,
    kind, project and candidates of ``membership``, project_user_messages, and maybe has_time,
    foreign (assigned to a project that is not scanned), selected, change (of
    ``classify_change``). With ``project``, threads of others are foreign too."""
    kind, foreign = F.col("kind"), _optional(threads, "foreign", False)
    if project is not None:
        foreign = foreign | ((kind == "explicit") & ~F.col("project").eqNullSafe(F.lit(project)))
    reason = (
        F.when(~_optional(threads, "has_time", True), "without-event-time").when(~F.col("in_time"), "time").when(F.col("internal"), "approval-or-internal")
        .when(F.col("user_messages") == 0, "without-user-message").when(kind == "projectless", "projectless").when(foreign, "assigned-to-other-project")
        .when(kind == "ambiguous", "ambiguous-project").when(F.col("project").isNull(), "unmatched-project")
        .when(F.lit(False) if project is None else F.col("project") != F.lit(project), "unmatched-project")
        .when((kind == "inferred") & (F.col("project_user_messages") == 0), "without-project-user-message").when(~_optional(threads, "selected", True), "not-selected")
    )
    x = threads.withColumn("reason", reason).withColumn("change", F.when(reason.isNull(), _optional(threads, "change", "eligible")))
    n = F.count_if
    is_ = lambda *r: F.coalesce(F.col("reason").isin(*r), F.lit(False))
    early = is_("without-event-time", "time", "approval-or-internal", "without-user-message", "projectless", "assigned-to-other-project")
    counts = x.agg(
        F.count("*").alias("files"), n(F.col("change").isin("eligible", "stale-generator")).alias("eligible"), n(F.col("change") == "unchanged").alias("unchanged"), n(F.col("change") == "stale-generator").alias("stale_generator"),
        n(F.col("reason").isNotNull()).alias("ignored"), n(is_("without-event-time")).alias("without_event_time"), n(is_("approval-or-internal")).alias("approval_or_internal"), n(is_("without-user-message")).alias("without_user_message"),
        n((kind == "explicit") & ~early).alias("assigned"), n(is_("ambiguous-project")).alias("ambiguous"), n(is_("projectless")).alias("projectless"), n(is_("unmatched-project", "assigned-to-other-project")).alias("unmatched"),
    )
    return x.filter("reason IS NULL AND change <> 'unchanged'").drop("reason"), counts, _excluded(x, ~F.col("reason").isin("time", "not-selected"), "without-project-user-message")


def scan_rebuild(threads: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(candidates, counts, excluded) of a rebuild of one project: here the project is looked
    at first. Columns: thread, project, kind, foreign, project_events, internal,
    user_messages, project_user_messages. Files without a thread (null) are counted only."""
    reason = (
        F.when(F.col("thread").isNull(), "without-thread").when(F.col("kind") == "projectless", "projectless").when(_optional(threads, "foreign", False), "assigned-to-other-project")
        .when(F.col("project_events") == 0, "unmatched-project").when(F.col("internal"), "approval-or-internal")
        .when((F.col("user_messages") == 0) | (F.col("project_user_messages") == 0), "without-project-user-message")
    )
    x = threads.withColumn("reason", reason).withColumn("candidates", F.array("project"))
    other = F.coalesce(F.col("reason").isin("without-thread", "projectless", "assigned-to-other-project", "unmatched-project"), F.lit(False))
    n = F.count_if
    counts = x.agg(
        F.count("*").alias("files"), n(~other).alias("matched_project"), n(F.col("reason").isNull()).alias("eligible"), n(F.col("reason") == "approval-or-internal").alias("approval_or_internal"),
        n(F.col("reason") == "without-project-user-message").alias("without_user_message"), n(other).alias("unmatched_project"),
    )
    ids = F.when(F.col("reason").isin("approval-or-internal", "without-project-user-message"), F.col("candidates")).otherwise(F.array().cast(dict(x.dtypes)["candidates"]))
    return x.filter("reason IS NULL").drop("reason", "candidates"), counts, x.filter("reason IS NOT NULL AND reason <> 'without-thread'").select("thread", "reason", ids.alias("candidates"))


def duplicate_threads(candidates: DataFrame) -> DataFrame:
    """(thread, rows) of threads with more than one candidate."""
    return candidates.groupBy("thread").agg(F.count("*").alias("rows")).filter("rows > 1")


def rebuild_plan(candidates: DataFrame, notes: DataFrame, version: int) -> DataFrame:
    """One row per thread with notes or a candidate: counts of current, older and unknown
    versions, bytes, the latest note (of equal versions the first id), and the action:
    preserved (no candidate), new, reusable (current and same fingerprint), else replaced.
    Columns of notes: thread, note_id, version (null: unknown), fingerprint, byte_count."""
    top = F.min_by(F.struct("note_id", "version", "fingerprint"), F.struct(-F.coalesce("version", F.lit(0)), "note_id"))
    n = notes.groupBy("thread").agg(
        F.count_if(F.col("version") == version).alias("current"), F.count_if(F.col("version") < version).alias("older"),
        F.count_if(F.col("version").isNull() | (F.col("version") > version)).alias("unknown"), F.sum("byte_count").alias("note_bytes"), top.alias("latest"),
    )
    x = candidates.select("thread", F.col("fingerprint").alias("wanted"), F.lit(True).alias("known")).join(n, "thread", "full_outer")
    same = (F.col("latest.version") == version) & F.col("latest.fingerprint").eqNullSafe(F.col("wanted"))
    action = F.when(F.col("known").isNull(), "preserved").when(F.col("latest").isNull(), "new").when(same, "reusable").otherwise("replaced")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return x.select("thread", action.alias("action"), F.col("latest.note_id").alias("note_id"), zero("current"), zero("older"), zero("unknown"), zero("note_bytes"))


def update_ledger(ledger: DataFrame, results: DataFrame) -> DataFrame:
    """The ledger after a run: finished threads take their result; failed ones keep their
    earlier note and get the status failed; threads without a result stay as they are.
    Columns: thread, status, generation, note_id."""
    r = results.select("thread", *(F.col(c).alias(f"r_{c}") for c in ("status", "generation", "note_id")))
    done = F.col("r_status") == "current"
    pick = lambda c: F.when(done, F.col(f"r_{c}")).otherwise(F.col(c)).alias(c)
    return ledger.join(r, "thread", "full_outer").select("thread", F.coalesce("r_status", "status").alias("status"), pick("generation"), pick("note_id"))


def revalidate(candidates: DataFrame, captures: DataFrame) -> DataFrame:
    """(thread, valid): every capture that a thread's note rests on is still there with
    its digest and, where both sides have them, its event fingerprint and last event.
    Columns: thread, source_ref, sha256 and maybe fingerprint, last_event_at."""
    checks = ["sha256", *(c for c in ("fingerprint", "last_event_at") if c in candidates.columns and c in captures.columns)]
    now = captures.select("source_ref", *(F.col(c).alias(f"now_{c}") for c in checks))
    same = F.col("now_sha256").isNotNull()
    for c in checks:
        same = same & F.col(f"now_{c}").eqNullSafe(F.col(c))
    return candidates.join(now, "source_ref", "left").groupBy("thread").agg(F.bool_and(same).alias("valid"))
