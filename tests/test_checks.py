"""Checks of notes, registries and scans, and references: files, nulls, repeats, empty tables."""

import hashlib
import json

from pyspark.sql import functions as F

from talespark.functions import text as T
from talespark.operators import histories, inputs, planning, provenance, records, summaries, threads
from talespark.sources import logs


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


HEX = "0123456789abcdef" * 4
UUID = "01234567-89ab-4cde-8f01-23456789abcd"
NOTE = f"""---
schemaVersion: 6
type: sessionNote
reviewStatus: unreviewed
sourceType: codexChat
automatedValidation: passed
id: {UUID}
promptId: {UUID}
promptVersion: 1
templateId: "{UUID}"
templateVersion: 2
outputSchemaSha256: {HEX}
sourceFingerprint: f
sourceThreadIds:
  - t
sourceRefs:
  - s
sessionNoteId: 20260101T090000+0900
date: 2026-01-01T09:00:00+09:00
fileSlug: a-b
generator: g
status: done
---
# Session Note
## Summary
## Timeline
## Last Known State
- Work State: done
"""


def test_notes_from_files(spark, tmp_path):
    two = f"sourceCaptureRef: raw:/a\nsourceCaptureSha256: {HEX}\nsourceCaptureRefs:\n  - raw:/a\n  - raw:/b\nsourceCaptureSha256s:\n  - {HEX}\n  - {HEX[::-1]}\nsourceSetSha256: "
    digest = hashlib.sha256(json.dumps(sorted([HEX, HEX[::-1]]), separators=(",", ":")).encode()).hexdigest()
    edits = {
        "good": ("", ""), "two": ("status: done\n---", f"status: done\n{two}{digest}\n---"), "captures": ("status: done\n---", f"status: done\n{two}x\n---"), "version": ("schemaVersion: 6", "schemaVersion: 2"), "type": ("sessionNote\n", "note\n"),
        "id": (f"\nid: {UUID}", f"\nid: {UUID.replace('-4', '-1')}"), "capture": ("status: done\n", "status: done\nsourceCaptureRef: raw:/a\n"), "promptId": (f"promptId: {UUID}", "promptId: 12"), "source": ("  - t\n", "  - t\n  - u\n"),
        "heading ## Timeline": ("## Timeline\n", ""), "work-state": ("State: done", "State: over"), "status": ("status: done", "status: blocked"),
    }
    for name, (a, b) in edits.items():
        (tmp_path / f"{name.replace('#', '_')}.md").write_text(NOTE.replace(a, b, 1))
    notes = logs.read_notes(spark, str(tmp_path)).withColumn("name", F.regexp_extract(F.url_decode("path"), r"([^/]+)\.md$", 1))
    got = {r["name"].replace("_", "#"): r["fault"] for r in summaries.validate_notes(notes).collect()}
    assert got == {name: None if name in ("good", "two") else name for name in edits}
    bare = notes.limit(1).select(F.lit(None).cast("map<string,string>").alias("meta"), F.lit(None).cast("string").alias("body"), *(F.lit(None).cast("array<string>").alias(c) for c in logs.NOTE_LISTS))
    assert summaries.validate_notes(bare).first()["fault"] == "version" and summaries.validate_notes(bare.limit(0)).count() == 0


def test_staged(spark, tmp_path):
    name = "20260101T090000+0900-a-b.md"
    (tmp_path / name).write_text(NOTE)
    n = logs.read_notes(spark, str(tmp_path)).withColumn("name", F.lit(name))
    c = spark.createDataFrame([("t", "s", "2026-01-01T00:00:00Z", "f", None, None, True), ("u", "s", None, None, None, None, None)], "thread string, source_ref string, started_at string, fingerprint string, capture_ref string, capture_sha256 string, strict boolean")
    check = lambda notes, wanted=c, s=None: rows(summaries.validate_staged(notes, wanted, s or {"generator": "g"}).select("thread", "fault"))
    lost = ("u", "missing")
    assert check(n) == [lost] and check(n.limit(0)) == [("t", "missing"), lost] and check(n, c.limit(0)) == []
    assert check(n.union(n)) == [("t", "repeated"), ("t", "repeated"), lost]
    assert check(n, s={"generator": "h"}) == [("t", "generator"), lost]
    assert check(n, c.withColumn("fingerprint", F.lit("z"))) == [("t", "sourceFingerprint"), lost]
    assert check(n, c.withColumn("capture_ref", F.lit("raw:/z"))) == [("t", "sourceCaptureRef"), lost]
    assert check(n.withColumn("name", F.lit("20260101T090000+0900-b.md"))) == [("t", "file-slug"), lost]
    assert check(n.withColumn("name", F.lit("x.md"))) == [("t", "session-note-id"), lost]
    assert check(n.withColumn("source_refs", F.lit(None).cast("array<string>"))) == [("t", "provenance"), lost]
    loose = n.withColumn("thread_ids", F.array().cast("array<string>"))
    assert check(loose, c.limit(0)) == [] and check(loose.withColumn("body", F.lit(None).cast("string")), c.limit(0)) == [(None, "heading # Session Note")]


def test_registry_file(spark, tmp_path):
    def row(i, **more):
        return json.dumps({"schemaVersion": 2, "identityKind": "codexAppLocalProject", "projectId": i, "roots": [{"path": f"/{i}"}]} | more)

    (tmp_path / "r.jsonl").write_text("\ufeff" + "\n".join([row("a"), "", row("a"), row("b", roots=None), row("c", roots=["/x"]), row("d", schemaVersion=1), row("e", identityKind="x"), "{", "[]", row(""), row("f", name="F")]) + "\n")
    good, bad = logs.read_registry(spark, str(tmp_path / "r.jsonl"))
    assert rows(good.drop("record")) == [(1, "a", None, ["/a"]), (11, "f", "F", ["/f"]), (4, "b", None, [])]
    assert sorted(map(tuple, bad.collect())) == [(3, "a", "duplicate-id"), (5, "c", "roots"), (6, "d", "version"), (7, "e", "version"), (8, "", "no-object"), (9, "", "no-object"), (10, "", "missing-id")]
    none = spark.createDataFrame([(None,), (bytearray(b""),)], "content binary")
    assert [x.count() for x in logs.registry_rows(none)] == [0, 0]


def test_remotes(spark):
    data = {"git@h:a/B.git": "https://h/a/b", "ssh://git@h/a.GIT/": "https://h/a", " https://h/a.git.git ": "https://h/a.git", "git@h": "git@h", "h\\a//": "h/a", "": "", None: None}
    df = spark.createDataFrame([(k,) for k in data], "u string")
    assert {r["u"]: r["v"] for r in df.withColumn("v", T.normalize_git_remote(F.col("u"))).collect()} == data


def test_messages_and_bases(spark):
    def lines(*records):
        return spark.createDataFrame([("f", i, x if isinstance(x, str) or x is None else json.dumps(x)) for i, x in enumerate(records, 1)], "thread string, line_no int, raw string")

    old = {"type": "message", "role": "user", "content": "a"}
    x = lines(old, {"id": "f", "instructions": "", "timestamp": "T"}, old | {"content": "b"}, old | {"content": "c", "timestamp": "U"}, {"type": "session_meta", "payload": {"timestamp": "V", "history_base": {"b": 1}}}, old | {"content": "d"}, old, "no json", None)
    assert [r[1:5] for r in rows(records.thread_messages(x, "thread"))] == [(1, "user", "a", ""), (3, "user", "b", "T"), (4, "user", "c", "U"), (6, "user", "d", "V")]
    assert {r["timestamp"] for r in records.log_events(x, "thread").collect()} == {"", "U"}
    bases = records.history_bases(records.parse_lines(x), "thread")
    assert rows(bases) == [("f", '{"b":1}')] and records.history_bases(records.parse_lines(x.limit(0)), "thread").count() == 0
    caps = spark.createDataFrame([("t", "1" * 64, "2026-01-01T00:00:00Z"), ("t", "2" * 64, None)], "thread string, sha256 string, started_at string")
    given = spark.createDataFrame([("1" * 64, "b"), ("1" * 64, "b")], "sha256 string, history_base string")
    assert rows(histories.history_branches(caps, given).select("branch", "history_base")) == [(1, "b"), (2, None)]
    ids = spark.createDataFrame([("k", "s", "L1", "c"), (None, None, None, None)], "thread_key string, sha256 string, local_id string, capture_ref string")
    assert rows(histories.canonical_ids(ids).select("canonical_id", "raw_locator")) == [("::", "#"), ("k:s:L1", "c#L1")]


def test_folders_of_messages(spark):
    say = lambda text, **kw: {"type": "response_item", "payload": {"role": "user", "content": text} | kw}
    turn = lambda t, **kw: {"type": "turn_context", "payload": {"turn_id": t} | kw}
    note = {"type": "event_msg", "payload": {"type": "agent_message", "message": "a"}}
    old = {"type": "message", "role": "assistant", "content": "a"}
    records_ = [say("a"), {"type": "session_meta", "payload": {"cwd": "/w"}}, say("a", type="function_call", name="f", input="i"), turn("1", cwd="/w/1"), say("b", type="reasoning"), say("b"), note, old, turn("2"), old, say(" "), {"type": "event_msg", "payload": {"type": "other", "message": "m"}}]
    x = spark.createDataFrame([("f", i, json.dumps(r)) for i, r in enumerate(records_, 1)] + [("f", 99, None), (None, 1, "{")], "thread string, line_no int, raw string")
    m = records.thread_messages(x, "thread")
    assert rows(m.select("line_no", "role", "text", "turn_id", "source", "cwd")) == [
        (1, "user", "a", "", "response_item", ""), (10, "assistant", "a", "2", "legacy_message", "/w"), (5, "user", "b", "1", "response_item", "/w/1"), (7, "assistant", "a", "1", "event_msg", "/w/1"),
    ]
    assert rows(threads.messages_of(m, "assistant").select("line_no")) == [(10,), (7,)] and records.thread_messages(x.limit(0), "thread").count() == 0


def test_last_time_of_files(spark):
    head = {"id": "f", "instructions": "", "timestamp": "H"}
    item = lambda t: {"type": "response_item", "timestamp": t}
    cases = {
        "none": [[]], "new": [item("a"), item("")], "timed": [item("a"), item("b")], "old": [item("a"), head, item("")], "old-timed": [head, item("b"), item("")], "old-none": [item("a"), {**head, "timestamp": ""}, item("")], "two": [head, item(""), {**head, "timestamp": "K"}],
    }
    x = spark.createDataFrame([(k, i, json.dumps(r)) for k, v in cases.items() for i, r in enumerate(v, 1)] + [("old", 4, None)], "thread string, line_no int, raw string")
    got = {r["thread"]: r["last_event_at"] for r in records.diagnostics(records.parse_lines(x), "thread").collect()}
    assert got == {"none": "", "new": "", "timed": "b", "old": "H", "old-timed": "b", "old-none": "", "two": "K"}


def test_unknown_times(spark):
    p = spark.createDataFrame([("t", 1, ["x"], None), ("u", 1, None, ["l"])], "thread string, chunk int, timeline array<string>, limitations array<string>")
    e = spark.createDataFrame([("t", 2, "L2", None), ("t", 1, "L1", "2026-01-01"), ("u", 1, "L1", "2026-01-01T00:00:00Z")], "thread string, ord int, local_id string, timestamp string")
    assert rows(inputs.merge_partials(p, e, "ja")) == [("t", ["x"], [inputs.UNKNOWN_TIMES["ja"] + "L1, L2"]), ("u", [], ["l"])]


def test_scans(spark):
    base = {"in_time": True, "internal": False, "user_messages": 1, "kind": "inferred", "project": "p", "candidates": [], "project_user_messages": 1, "project_events": 1}
    cases = [{}, {"in_time": False}, {"internal": True}, {"kind": "ambiguous", "project": None, "candidates": ["p", "q"]}, {"kind": "explicit", "project": "q", "project_user_messages": 0}, {"kind": "unmatched", "project": None}, {"project_user_messages": 0}, {"project": "q"}]
    schema = "thread int, in_time boolean, internal boolean, user_messages int, kind string, project string, candidates array<string>, project_user_messages int, project_events int"
    t = spark.createDataFrame([{"thread": i} | base | c for i, c in enumerate(cases)], schema)
    found, counts, out = planning.scan_candidates(t)
    assert rows(found.select("thread")) == [(0,), (4,), (7,)] and counts.first()["assigned"] == 1 and counts.first()["ignored"] == 5
    assert rows(out) == [(2, "approval-or-internal", []), (3, "ambiguous-project", ["p", "q"]), (5, "unmatched-project", []), (6, "without-project-user-message", ["p"])]
    found, counts, out = planning.scan_candidates(t, "p")
    assert rows(found.select("thread")) == [(0,)] and counts.first()["unmatched"] == 3
    assert {r["reason"] for r in out.filter("thread = 4").collect()} == {"assigned-to-other-project"}
    found, counts, out = planning.scan_rebuild(t.withColumn("thread", F.nullif("thread", F.lit(1))))
    assert counts.first()["unmatched_project"] == 1 and found.filter("thread IS NULL").count() == 0 and out.filter("thread IS NULL").count() == 0
    assert planning.scan_candidates(t.limit(0))[1].first()["files"] == 0 and planning.scan_rebuild(t.limit(0))[1].first()["eligible"] == 0


def test_status_and_moves(spark):
    s = spark.createDataFrame([("p", "a", True, False), ("p", "b", True, True)], "provider string, source_id string, initialized boolean, migration_required boolean")
    r = spark.createDataFrame([("p", "a", "2", "r1", "x", False), ("p", "a", "2", "r2", "y", True), ("q", "b", "3", "r3", "z", True)], "provider string, source_id string, finished_at string, run string, mode string, complete boolean")
    st = provenance.source_status(s, r)
    assert rows(st.select("source_id", "as_of", "last_mode", "complete")) == [("a", "2", "y", True), ("b", None, None, False)]
    assert rows(provenance.overall_status(st)) == [(2, True, True, False)] and rows(provenance.overall_status(st.limit(0))) == [(0, True, False, True)]
    refs = spark.createDataFrame([("/a/b/c",), ("/a/b",), ("/a/bc",), ("/a\\x/thread-notes",), ("data:/p/s/thread-notes/n",), (None,), ("",)], "ref string")
    moved = refs.select("ref", provenance.rewrite_locator(F.col("ref"), {"/a": "/1", "/a/b": "/2"}, "data:/p/s/").alias("now"))
    assert {r["ref"]: r["now"] for r in moved.collect()} == {"/a/b/c": "/2/c", "/a/b": "/2", "/a/bc": "/1/bc", "/a\\x/thread-notes": "/1\\x/session-notes", "data:/p/s/thread-notes/n": "data:/session-notes/n", None: None, "": ""}
    assert refs.select(provenance.rewrite_locator(F.col("ref"), {}).alias("x")).count() == 7
