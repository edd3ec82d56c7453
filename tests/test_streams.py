"""Stateful streams: restart, batches run again, redelivered files, late events."""

import hashlib
import os
import shutil

from pyspark.sql import functions as F

from talespark.functions import text as T
from talespark.streaming import jobs, snapshots


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def forget(checkpoint, number):
    """As if the stream had stopped after batch ``number`` had written, before it was noted."""
    for name in (str(number), f".{number}.crc"):
        if os.path.exists(f"{checkpoint}/commits/{name}"):
            os.remove(f"{checkpoint}/commits/{name}")


def test_captures_with_state(spark, tmp_path):
    root, man, check = tmp_path / "my_sessions's", str(tmp_path / "man"), str(tmp_path / "check")

    def deliver(number, files):
        for name, text in files.items():
            path = root / f"d{number}" / name
            path.parent.mkdir(parents=True, exist_ok=True)
            path.write_text(text)
        jobs.stream_captures(spark, str(root), man, check, "s").awaitTermination()

    def manifest(before=None):
        return {r["source_ref"]: (r["sha256"], r["captured_in"]) for r in snapshots.read_snapshot(spark, f"{man}/rows", jobs.MANIFEST, before).collect()}

    def seen(number):
        return dict(rows(spark.read.parquet(f"{man}/seen/_batch={number}").select("source_ref", "status")))

    sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
    deliver(0, {"sessions/a b/x.jsonl": "1", "sessions/y.jsonl": "2", "archived_sessions/z.jsonl": "3", "sessions/no.txt": "4"})
    assert seen(0) == {"sessions/a b/x.jsonl": "captured", "sessions/y.jsonl": "captured"}
    first = manifest()
    assert first == {"sessions/a b/x.jsonl": (sha("1"), 0), "sessions/y.jsonl": (sha("2"), 0)}
    deliver(1, {"sessions/a b/x.jsonl": "1", "sessions/y.jsonl": "2 more", "sessions/sessions/new.jsonl": "5", "sessions/empty.jsonl": ""})  # a restart, too
    want = {"sessions/a b/x.jsonl": "unchanged", "sessions/y.jsonl": "captured", "sessions/sessions/new.jsonl": "captured"}
    second = first | {"sessions/y.jsonl": (sha("2 more"), 1), "sessions/sessions/new.jsonl": (sha("5"), 1)}
    assert seen(1) == want and manifest() == second and manifest(1) == first
    forget(check, 1)
    deliver(1, {})  # batch 1 again
    assert seen(1) == want and manifest() == second
    deliver(2, {"sessions/y.jsonl": "2 more"})
    assert seen(2) == {"sessions/y.jsonl": "unchanged"} and manifest() == second


def test_files_that_change_while_they_are_read(spark, tmp_path):
    """A file shorter or longer than it was listed is deferred and its row stays."""
    root, man = tmp_path / "r" / "sessions", str(tmp_path / "man")
    root.mkdir(parents=True)
    (root / "x.jsonl").write_text("12")
    old = jobs.with_digest
    for number, change in ((0, 0), (1, 1), (2, 0)):
        jobs.with_digest = lambda df, change=change: old(df).withColumn("length", F.col("length") + change)
        try:
            (root.parent / f"d{number}" / "sessions").mkdir(parents=True)
            shutil.move(str(root / "x.jsonl"), root.parent / f"d{number}" / "sessions" / "x.jsonl") if number == 0 else (root.parent / f"d{number}" / "sessions" / "x.jsonl").write_text("12" * number)
            jobs.stream_captures(spark, str(root.parent), man, str(tmp_path / "c"), "s").awaitTermination()
        finally:
            jobs.with_digest = old
    states = [r["status"] for n in range(3) for r in spark.read.parquet(f"{man}/seen/_batch={n}").collect()]
    assert states == ["captured", "deferred", "captured"]
    assert [(r["byte_count"], r["captured_in"]) for r in snapshots.read_snapshot(spark, f"{man}/rows", jobs.MANIFEST).collect()] == [(4, 2)]


EVENT = "thread string, event_id string, at string, text string"


def test_late_events_make_a_note_anew(spark, tmp_path):
    src, path, check = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check")
    fails = set()

    def run(batch=None):
        if batch is not None:
            spark.createDataFrame(batch, EVENT).coalesce(1).write.mode("append").parquet(src)
        made = lambda plan: plan.filter(~F.col("thread").isin(*fails) if fails else F.lit(True))
        jobs.stream_notes(spark.readStream.schema(EVENT).parquet(src), made, path, check).awaitTermination()

    plan = lambda n: {r["thread"]: (r["note_id"], r["reason"], r["last_event_at"]) for r in spark.read.parquet(f"{path}/plan/_batch={n}").collect()}
    ledger = lambda: {r["thread"]: (r["note_id"], r["made_in"]) for r in snapshots.read_snapshot(spark, f"{path}/ledger", jobs.LEDGER).collect()}
    ids = {r["t"]: r["u"] for r in spark.createDataFrame([("a",), ("b",), ("c",)], "t string").select("t", T.name_uuid(F.col("t")).alias("u")).collect()}

    one = [("a", "1", "2026-01-01T00:00:00Z", "x"), ("a", "2", "2026-01-01T02:00:00Z", "y"), ("b", "1", None, None)]
    run(one)
    assert plan(0) == {"a": (ids["a"], "new", "2026-01-01T02:00:00Z"), "b": (ids["b"], "new", None)}
    assert ledger() == {"a": (ids["a"], 0), "b": (ids["b"], 0)}
    run(one[:1] + one[:1])  # delivered again
    assert plan(1) == {} and ledger()["a"] == (ids["a"], 0)
    fails.add("c")
    late = [("a", "0", "2025-12-31T23:00:00Z", "earlier"), ("c", "1", "2026-01-02T00:00:00Z", "z")]
    run(late)  # earlier in time than the note's events, and a thread whose note fails
    want = {"a": (ids["a"], "late-event", "2026-01-01T02:00:00Z"), "c": (ids["c"], "new", "2026-01-02T00:00:00Z")}
    assert plan(2) == want and ledger() == {"a": (ids["a"], 2), "b": (ids["b"], 0)}
    forget(check, 2)
    run()  # batch 2 again
    assert plan(2) == want and ledger() == {"a": (ids["a"], 2), "b": (ids["b"], 0)}
    fails.clear()
    run([("b", "1", None, None)])  # nothing new, but c is still open
    assert plan(3) == {"c": (ids["c"], "new", "2026-01-02T00:00:00Z")} and ledger()["c"] == (ids["c"], 3)
