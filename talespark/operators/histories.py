"""Several captured versions of one thread: branches, merged events, fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talespark.functions.text import epoch_of, normalize_path, normalize_repo_url, normalize_text, time_key

BRANCH_DIGITS = 16


def canonical_ids(events: DataFrame) -> DataFrame:
    """Adds ``canonical_id``, unique over all threads and captures, and ``raw_locator``.
    Columns: thread_key, sha256, local_id, capture_ref and, in threads of several branches,
    event_id (else null), which then takes local_id's place in the id. Nulls are empty."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    own = F.coalesce("event_id", "local_id", F.lit("")) if "event_id" in events.columns else text("local_id")
    joined = F.concat(text("thread_key"), F.lit(":"), text("sha256"), F.lit(":"), own)
    return events.withColumn("canonical_id", joined).withColumn("raw_locator", F.concat(text("capture_ref"), F.lit("#"), text("local_id")))


def history_branches(captures: DataFrame, bases: DataFrame | None = None) -> DataFrame:
    """Retained versions (thread, sha256, started_at, ...) with ``branch`` (position from
    1 by start time, then digest) and ``branch_id``: H and 16 hex digits, or the whole
    digest in threads where those collide. Threads with one version get no branch id.
    ``bases`` (sha256, history_base) adds that column, null where a version has none."""
    if bases is not None:
        captures = captures.join(bases.groupBy("sha256").agg(F.min("history_base").alias("history_base")), "sha256", "left")
    short = F.substring("sha256", 1, BRANCH_DIGITS)
    sizes = captures.groupBy("thread").agg(F.count("*").alias("_n"), F.countDistinct(short).alias("_short"))
    w = Window.partitionBy("thread").orderBy(time_key(F.col("started_at")), "sha256")
    name = F.when(F.col("_n") > 1, F.concat(F.lit("H"), F.when(F.col("_short") == F.col("_n"), short).otherwise(F.col("sha256"))))
    return captures.join(sizes, "thread").withColumn("branch", F.row_number().over(w)).withColumn("branch_id", name).drop("_n", "_short")


def merge_histories(events: DataFrame, branches: DataFrame) -> DataFrame:
    """Events (sha256, line_no, local_id, ...) of all branches of a thread, with
    ``event_id`` qualified by the branch and ``raw_ref``; order: branch, line_no."""
    b = branches.select("thread", "sha256", "branch", "branch_id", "source_ref")
    return events.join(b, "sha256").withColumn("event_id", F.concat_ws("-", "branch_id", "local_id")).withColumn("raw_ref", F.concat_ws("#", "source_ref", "local_id"))


def thread_spans(branches: DataFrame) -> DataFrame:
    """(thread, started_at, last_event_at): the first branch's start; the latest time with
    a zone, else the last branch's text that is not empty."""
    zoned = epoch_of(F.col("last_event_at"))
    given = F.when(F.col("last_event_at") != "", F.col("branch"))
    last = F.coalesce(F.max_by("last_event_at", F.when(zoned.isNotNull(), F.struct(zoned, -F.col("branch")))), F.max_by("last_event_at", given), F.lit(""))
    return branches.groupBy("thread").agg(F.min_by("started_at", "branch").alias("started_at"), last.alias("last_event_at"))


def json_string(c: Column) -> Column:
    """A text as a JSON string; control characters as \\u escapes in lower case."""
    quoted = F.substring(F.to_json(F.struct(c.alias("x"))), 6, 2**31 - 1)
    return F.substring(quoted, F.lit(1), F.length(quoted) - 1)


def _object(parts: dict[str, Column]) -> Column:
    """A JSON object of texts; null texts are empty, a null of another kind leaves its key out."""
    return F.concat(F.lit("{"), F.concat_ws(",", *(F.concat(F.lit(f'"{k}":'), v) for k, v in parts.items())), F.lit("}"))


def _text(c: Column) -> Column:
    return json_string(F.coalesce(c, F.lit("")))


def event_json(branches: bool = False) -> Column:
    """An event's normalised JSON with keys in order, for digests. With ``branches``, events
    that have a branch_id carry it, row by row."""
    parts = {"actor": _text(F.col("actor"))}
    if branches:
        parts["branchId"] = F.when(F.coalesce("branch_id", F.lit("")) != "", _text(F.col("branch_id")))
    rest = {"cwd": normalize_path(F.col("cwd")), "id": F.col("local_id"), "kind": F.col("kind"), "name": F.col("name"), "text": normalize_text(F.col("text")), "timestamp": F.col("timestamp"), "turnId": F.col("turn_id")}
    return _object(parts | {k: _text(v) for k, v in rest.items()})


def _digests(rows: DataFrame) -> DataFrame:
    """(thread, fingerprint): SHA-256 of ``head``, a thread's ``j`` in order of ``ord`` with
    commas between, and ``tail``; a null ``j`` is no item. Sorted rows are hashed as they stream
    through a task, so a thread of any length needs one batch of memory."""
    import hashlib
    from collections.abc import Iterator

    import pandas as pd

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, digest, tail, comma = None, None, "", False
        for pdf in batches:
            done = []
            for thread, head, j, end in zip(pdf["thread"], pdf["head"], pdf["j"], pdf["tail"]):
                if digest is None or thread != now:
                    if digest is not None:
                        digest.update(tail.encode())
                        done.append((now, digest.hexdigest()))
                    now, digest, tail, comma = thread, hashlib.sha256(head.encode()), end, False
                if isinstance(j, str):
                    digest.update(b"," * comma + j.encode())
                    comma = True
            yield pd.DataFrame(done, columns=["thread", "fingerprint"])
        if digest is not None:
            digest.update(tail.encode())
            yield pd.DataFrame([(now, digest.hexdigest())], columns=["thread", "fingerprint"])

    return rows.repartition("thread").sortWithinPartitions("thread", "ord").mapInPandas(run, "thread string, fingerprint string")


def fingerprint_events(events: DataFrame, source_ref: Column) -> DataFrame:
    """(thread, fingerprint): SHA-256 of a thread's ordered events. Events with a branch_id,
    where there is such a column, carry it. Null texts are empty; ``ord`` tells events apart."""
    tail = F.concat(F.lit('],"id":'), _text(F.col("thread")), F.lit(',"sourceRef":'), _text(source_ref), F.lit("}"))
    return _digests(events.select("thread", "ord", F.lit('{"events":[').alias("head"), event_json("branch_id" in events.columns).alias("j"), tail.alias("tail")))


def fingerprint_threads(threads: DataFrame, messages: DataFrame) -> DataFrame:
    """(thread, fingerprint): SHA-256 of a thread's header and ordered messages. Columns:
    threads thread, started_at, repository_url, source_ref, cwd, one row each; messages
    thread, ord, role, text, turn_id, timestamp, cwd (empty: the thread's). A thread
    without messages has a fingerprint too; messages of no thread have none."""
    t = threads.select("thread", "started_at", "repository_url", "source_ref", F.col("cwd").alias("thread_cwd"))
    x = t.join(messages.select("thread", "ord", "role", "text", "turn_id", "timestamp", "cwd"), "thread", "left")
    cwd = normalize_path(F.coalesce(F.nullif("cwd", F.lit("")), "thread_cwd"))
    parts = {"cwd": cwd, "role": F.col("role"), "text": normalize_text(F.col("text")), "timestamp": F.col("timestamp"), "turnId": F.col("turn_id")}
    j = F.when(F.col("ord").isNotNull(), _object({k: _text(v) for k, v in parts.items()}))
    head = F.concat(F.lit('{"id":'), _text(F.col("thread")), F.lit(',"messages":['))
    tail = {"repositoryUrl": normalize_repo_url(F.col("repository_url")), "sourceRef": F.col("source_ref"), "timestamp": F.col("started_at")}
    tail = F.concat(F.lit("],"), F.substring(_object({k: _text(v) for k, v in tail.items()}), 2, 2**31 - 1))
    return _digests(x.select("thread", "ord", head.alias("head"), j.alias("j"), tail.alias("tail")))
