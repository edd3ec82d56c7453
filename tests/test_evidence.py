"""Operators that SQL cannot state, against brute force and round trips; edge cases."""

import hashlib
import json
import os

import pytest
from pyspark.sql import functions as F

from talespark.functions import text as T
from talespark.operators import histories, inputs, planning, projects, provenance, records, summaries
from talespark.sources import logs, sinks
from talespark.streaming import jobs, snapshots


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def lines_of(spark, *values):
    return spark.createDataFrame([("f", bytearray("\n".join(v if isinstance(v, str) else json.dumps(v, ensure_ascii=False) for v in values), "utf-8"))], "thread string, content binary")


def test_lines_are_physical_and_counted(spark):
    data = [("a", bytearray("﻿x\r\n\r\n y \rz w\n", "utf-8")), ("b", bytearray(b"\xff\xfe")), ("c", bytearray(b"")), ("d", None)]
    df = spark.createDataFrame(data, "k string, content binary")
    assert rows(logs.read_lines(df, "k")) == [("a", 1, "x"), ("a", 3, "y"), ("a", 4, "z w")]
    assert rows(logs.unreadable(df).select("k")) == [("b",)]


def test_events_of_a_file(spark):
    say = lambda role, text, **kw: {"type": "response_item", "payload": {"type": "message", "role": role, "content": [{"input_text": text}, 3, {"text": ""}]}} | kw
    df = lines_of(
        spark, {"type": "session_meta", "payload": {"id": "f", "cwd": "/a"}}, "[1]", "{bad", {"type": "turn_context", "payload": {"turn_id": "t1"}},
        say("user", "<INSTRUCTIONS>i</INSTRUCTIONS> hi <environment_context>e"), {"type": "event_msg", "payload": {"type": "user_message", "message": "hi"}}, say("user", "# AGENTS.md instructions for x"),
        {"type": "turn_context", "payload": {"turn_id": "t2", "cwd": "/b"}}, say("assistant", "hi"), '{"type":"response_item","payload":{"type":"tool_call","name":"n","input":{"z":NaN,"a":"é","a":"ü"}}}',
        {"type": "session_meta", "payload": {"id": "f"}}, {"type": "event_msg", "payload": {"type": "x_end", "last_agent_message": "q", "v": [1, None]}}, {"type": "event_msg", "payload": {"type": "token_count", "v": 1}},
        {"type": "strange", "timestamp": "2026-01-01T00:00:00Z"}, {"type": "event_msg", "payload": {"type": "only"}},
    )
    lines = logs.read_lines(df, "thread")
    got = rows(records.log_events(lines, "thread").select("local_id", "kind", "name", "text", "turn_id", "cwd"))
    assert got == [
        ("L000005", "user_message", "", "hi", "t1", "/a"), ("L000009", "assistant_message", "", "hi", "t2", "/b"),
        ("L000010", "tool_call", "n", '{"a":"ü","z":NaN}', "t2", "/b"), ("L000012", "tool_result", "x_end", '{"v":[1,null]}', "t2", "/a"),
    ]
    assert rows(records.diagnostics(records.parse_lines(lines), "thread")) == [("f", [2, 3], ["strange"], ["f"], "")]
    assert rows(records.log_events(lines.limit(0), "thread")) == []


def test_old_files(spark):
    df = lines_of(spark, {"id": "f", "instructions": None, "timestamp": "2026-01-01T00:00:00Z", "cwd": "/o", "git": {"repository_url": "u"}}, {"type": "message", "role": "user", "content": "hello"}, {"record_type": "state"})
    parsed = records.parse_lines(logs.read_lines(df, "thread"))
    assert rows(records.thread_metadata(parsed, "thread"))[0][:4] == ("f", "f", "2026-01-01T00:00:00Z", "/o")
    assert rows(records.diagnostics(parsed, "thread")) == [("f", [], [], ["f"], "2026-01-01T00:00:00Z")]
    assert rows(records.log_events(logs.read_lines(df, "thread"), "thread").select("name", "text", "cwd")) == [("legacy", "hello", "/o")]


def test_thread_flags(spark):
    said = [("a", "user", "hello"), ("a", "user", " \n Review this: x"), ("b", "assistant", "Review this: y"), ("c", "user", "not Review this:"), ("c", "user", None)]
    told = [("a", "Cli"), ("b", "cli"), ("b", "GUARD"), ("c", None), ("d", "guard")]
    messages = spark.createDataFrame(said, "thread string, role string, text string")
    metadata = spark.createDataFrame(told, "thread string, thread_source string")
    got = records.thread_flags(messages, metadata, "thread", "Review this:", ["guard"])
    assert sorted(map(tuple, got.collect())) == [("a", True, False, True), ("b", False, True, False), ("c", False, False, True), ("d", False, True, False)]
    assert records.thread_flags(messages.limit(0), metadata.limit(0), "thread", "Review this:", ["guard"]).count() == 0


def test_times(spark):
    df = spark.createDataFrame([("2026-01-01T20:00:00Z",), ("2026-01-02T04:59:00+09:00",), ("2026-01-01",), ("x",), ("",), (None,)], "t string")
    assert [r[0] for r in df.orderBy(T.time_key(F.col("t"))).collect()][:2] == ["2026-01-02T04:59:00+09:00", "2026-01-01T20:00:00Z"]
    assert [tuple(r) for r in df.select(T.local_time(F.col("t"), "day"), T.local_time(F.col("t"), "clock")).collect()[:3]] == [("2026-01-02", "05:00:00"), ("2026-01-02", "04:59:00"), (None, None)]


def event_rows(spark):
    texts = ["a" * 50, 'q"\\\n\t' * 200, "word and word. " * 90, "短い。文です。" * 120, "", "\x01\x7f" * 40, "x" * 3000]
    data = [(t, i, f"L{i:06d}", "event", "tool", "n", x, "", "t") for t in ("one", "two") for i, x in enumerate(texts, 1)]
    return spark.createDataFrame(data, "thread string, ord int, local_id string, kind string, actor string, name string, text string, timestamp string, turn_id string")


def as_json(r, text, note=None):
    return json.dumps({"id": r.local_id, "kind": r.kind, "actor": r.actor, "name": r.name, "text": text, "timestamp": r.timestamp, "turnId": r.turn_id} | ({"textPart": note} if note else {}), ensure_ascii=False)


def test_sizes_parts_and_chunks(spark):
    budget, e = 600, event_rows(spark)
    for r in e.withColumn("size", inputs.event_size()).collect():
        assert r["size"] == len(as_json(r, r.text))
    chunks = inputs.chunk_events(inputs.split_events(inputs.prepare_events(e), budget), budget)
    assert rows(inputs.check_coverage(chunks, e)) == []
    by_thread = {}
    for r in sorted(chunks.collect(), key=lambda r: (r.thread, r.ord, r.part)):
        note = {"index": r.part, "count": r.parts, "start": r.start, "end": r.end, "fullTextCharacters": 3000} if r.parts > 1 else None
        by_thread.setdefault(r.thread, {}).setdefault(r.chunk, []).append((as_json(r, r.text, note), r.parts))
    for made in by_thread.values():
        assert list(made) == list(range(1, len(made) + 1))
        want, now = [], []
        for x, parts in [x for c in made.values() for x in c]:
            if parts > 1 or (now and (now[-1][1] > 1 or len("[" + ", ".join(y for y, _ in now) + "]") + 2 + len(x) > budget)):
                want, now = want + [now] * bool(now), []
            now = now + [(x, parts)]
        assert list(made.values()) == want + [now]
        assert all(len("[" + ", ".join(x for x, _ in c) + "]") <= budget for c in made.values())
    with pytest.raises(Exception, match="too small"):
        inputs.split_events(e, 100).collect()
    calls = inputs.summarize(inputs.render_requests(chunks, "H ", " T"), lambda s: str(len(json.loads(s[2:-2]))) if "短い" not in s else 1 / 0)
    assert {r.error for r in calls.collect()} == {None, "ZeroDivisionError: division by zero"}


def test_merge_partials(spark):
    df = spark.createDataFrame([("t", 2, ["c"], ["x"]), ("t", 1, ["a", "b"], ["x", "y"])], "thread string, chunk int, timeline array<string>, limitations array<string>")
    assert rows(inputs.merge_partials(df)) == [("t", ["a", "b", "c"], ["x", "y"])]


def test_histories(spark):
    a, b = "ab" * 32, "ab" * 8 + "cd" * 24
    df = spark.createDataFrame([("t", a, "2026-01-02T00:00:00Z", "bad", "r1"), ("t", b, "2026-01-01T00:00:00Z", "2026-01-05T00:00:00Z", "r2"), ("u", a, "", "", "r3")], "thread string, sha256 string, started_at string, last_event_at string, source_ref string")
    branches = histories.history_branches(df)
    assert rows(branches.select("thread", "branch", "branch_id")) == [("t", 1, "H" + b), ("t", 2, "H" + a), ("u", 1, None)]
    assert rows(histories.thread_spans(branches)) == [("t", "2026-01-01T00:00:00Z", "2026-01-05T00:00:00Z"), ("u", "", "")]
    events = spark.createDataFrame([(b, 1, "L000001")], "sha256 string, line_no int, local_id string")
    assert rows(histories.merge_histories(events, branches).select("event_id", "raw_ref")) == [(f"H{b}-L000001", "r2#L000001")]


def test_schema_faults(spark):
    schema = {"type": "object", "required": ["a"], "additionalProperties": False, "properties": {"a": {"type": "array", "minItems": 1, "items": {"type": "string", "pattern": "^L", "maxLength": 3}}, "b": {"enum": [1, 2]}}}
    cases = {'{"a":["L1"],"b":2}': None, '{"a":[]}': "$.a: 0 is no allowed length", '{"a":["x"]}': "$.a[0]: does not match the pattern", '{"b":1}': "$.a: missing", '{"a":["L"],"c":1}': "$.c: not allowed", '{"a":["L"],"b":3}': "$.b: not an allowed value", "[": "$: no JSON", "[]": "$: not of type object"}
    df = spark.createDataFrame([(c,) for c in cases], "x string")
    assert {r.x: r.f for r in df.select("x", summaries.validate_schema(F.col("x"), schema).alias("f")).collect()} == cases


def test_notes(spark, tmp_path):
    df = spark.createDataFrame([("t1", "{{body}} $1", None), ("t2", "", "more")], "thread string, title string, extra string")
    made = summaries.render_notes(df, "---\nid: {{thread}}\n---\n# {{title}}\n{{?extra}}## Extra\n{{extra}}\n{{/}}end")
    assert [r.note for r in made.orderBy("thread").collect()] == ["---\nid: t1\n---\n# {{body}} $1\nend", "---\nid: t2\n---\n# \n## Extra\nmore\nend"]
    os.makedirs(tmp_path / "n")
    (tmp_path / "n" / "a.md").write_text("---\nid: 'x'\nrefs:\n  - one\n  - \"two\"\nid: y\nempty: []\n---\nbody\n---\n")
    (tmp_path / "n" / "b.md").write_text("no rule: here\n")
    (tmp_path / "n" / "c.md").write_text("---\n---\n")
    got = {os.path.basename(r.path): (r.meta, r.body) for r in logs.read_notes(spark, str(tmp_path / "n")).collect()}
    assert got == {"a.md": ({"refs": "", "id": "y", "empty": ""}, "body\n---\n"), "b.md": ({}, "no rule: here\n"), "c.md": ({}, "")}
    text = spark.read.text(str(tmp_path / "n" / "a.md"), wholetext=True)
    assert text.select(logs.front_matter_list(F.col("value"), "refs")).first()[0] == ["one", "two"]


def test_files_and_sinks(spark, tmp_path):
    root = tmp_path / "sessions"
    os.makedirs(root / "sessions" / "x y"), os.makedirs(root / "archived_sessions")
    (root / "sessions" / "x y" / "a.jsonl").write_bytes(b"\xffraw")
    (root / "archived_sessions" / "b.jsonl").write_text("{}")
    c = logs.read_captures(spark, "s", str(root), True)
    assert rows(c.select("source_ref", "content")) == [("archived_sessions/b.jsonl", bytearray(b"{}")), ("sessions/x y/a.jsonl", bytearray(b"\xffraw"))]
    digest = hashlib.sha256(b"x").hexdigest()
    row = {"schemaVersion": 3, "sourceProvider": "p", "sourceId": "s", "sourceRef": "a.jsonl", "captureRef": "raw:/p/s/sessions/a.jsonl", "sha256": digest, "byteCount": 1}
    (tmp_path / "m.json").write_text("\n".join(json.dumps(row | x) for x in ({}, {"byteCount": -1}, {"sourceRef": "../a"})) + "\n{bad\n")
    good, bad = logs.read_manifest(spark, str(tmp_path / "m.json"), "s", "p")
    assert good.count() == 1 and bad.count() == 3
    e = spark.createDataFrame([("s", "t", "d", "L1", "1"), ("s", "t", "d", "L1", "1"), ("s", "t", "d", "L2", "2")], "source_id string, thread_key string, canonical_sha256 string, local_id string, event_sha256 string")
    at = str(tmp_path / "events")
    sinks.write_events(e, at)
    sinks.write_events(e, at)
    assert spark.read.parquet(at).count() == 2
    with pytest.raises(ValueError, match="immutable"):
        sinks.write_events(e.withColumn("event_sha256", F.lit("9")), at)
    cat = spark.createDataFrame([("p", "s1", 1), ("p", "s2", 2)], "source_provider string, source_id string, x int")
    sinks.write_catalog(cat, str(tmp_path / "cat"))
    sinks.write_catalog(cat.filter("x = 2").withColumn("x", F.lit(3)), str(tmp_path / "cat"))
    assert rows(spark.read.parquet(str(tmp_path / "cat")).select("source_id", "x")) == [("s1", 1), ("s2", 3)]


def test_selection_and_plans(spark):
    e = spark.createDataFrame([("a", 1, "/r/x", ""), ("a", 2, "/rx", ""), ("b", 1, "", "/R"), ("c", 1, "/z", "")], "thread string, ord int, cwd string, thread_cwd string")
    roots, own = spark.createDataFrame([("/r/",)], "root string"), spark.createDataFrame([("c",)], "thread string")
    assert rows(projects.select_for_roots(e, roots, own).select("thread", "ord")) == [("a", 1), ("b", 1), ("c", 1)]
    t = spark.createDataFrame([("a", "2026-01-01T00:00:00Z"), ("b", "2026-01-05T00:00:00Z"), ("c", "2026-01-09T23:50:00Z"), ("d", "")], "thread string, last_event_at string")
    mark, now = "2026-01-03T00:00:00Z", "2026-01-10T00:00:00Z"
    assert rows(planning.time_filter(t, mark, now).select("thread")) == [("b",)] and rows(planning.time_filter(t, mark, now, backfill=True).select("thread")) == [("a",)]
    c = spark.createDataFrame([("a", "f", "c", None), ("b", "f", "c", None)], "thread string, fingerprint string, capture_sha256 string, source_set_sha256 string")
    uid = "0" * 8 + "-0000-4000-8000-" + "0" * 12
    n = spark.createDataFrame([("a", "f", "c", None, uid, "2"), ("b", "f", "c", None, uid, "1")], "thread string, fingerprint string, capture_sha256 string, source_set_sha256 string, note_id string, version string")
    assert rows(planning.note_is_current(c, n, {"version": "2"})) == [("a", True), ("b", False)]
    f = spark.createDataFrame([("p", "1"), ("q", "2")], "path string, sha256 string")
    assert rows(provenance.plan_signature(f)) == rows(provenance.plan_signature(f.orderBy(F.desc("path")))) != rows(provenance.plan_signature(f.limit(1)))


def test_streams(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    at = lambda m: f"2026-01-01 {m // 60:02d}:{m % 60:02d}:00"
    msg = lambda m, text: (at(m), "t", "user_message", "user", "1", text)
    schema = "ts timestamp, thread string, kind string, actor string, turn_id string, text string"
    for part in ([msg(0, "a"), msg(1, " a "), msg(20, "b")], [msg(300, "c")], [msg(900, "d")]):
        spark.createDataFrame(part, "ts string, thread string, kind string, actor string, turn_id string, text string").withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(src)
    read = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    for name, df in (("idle", jobs.stream_idle_sessions(read(), "thread", "ts")), ("once", jobs.stream_dedupe(read()))):
        df.writeStream.format("parquet").option("checkpointLocation", f"{out}/c-{name}").option("path", f"{out}/{name}").trigger(availableNow=True).start().awaitTermination()
    assert spark.read.parquet(f"{out}/once").filter("text in (' a ', 'a')").count() == 1
    assert (3,) in rows(spark.read.parquet(f"{out}/idle").select("events"))
    os.makedirs(tmp_path / "l" / "sessions")
    for n in (1, 2):
        (tmp_path / "l" / "sessions" / f"{n}.jsonl").write_text(f"{n}")
        jobs.stream_captures(spark, str(tmp_path / "l"), f"{out}/man", f"{out}/c-man", "s").awaitTermination()
    assert rows(snapshots.read_snapshot(spark, f"{out}/man/rows", jobs.MANIFEST).select("source_ref", "captured_in")) == [("sessions/1.jsonl", 0), ("sessions/2.jsonl", 1)]
    seen = []
    jobs.stream_plan(read(), lambda t: spark.read.parquet(src).join(t, "thread", "left_semi"), lambda df, n: seen.append(df.count()), f"{out}/c-plan").awaitTermination()
    assert set(seen) == {5}
