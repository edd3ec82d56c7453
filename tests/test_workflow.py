"""Captures to notes: round trips, brute force, nulls, repeats and empty tables."""

import json

import pytest
from pyspark.sql import functions as F

from talespark.functions import text as T
from talespark.operators import attribution, capture, inputs, planning, projects, provenance, records, summaries, threads
from talespark.sources import sinks


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_writers_round_trip(spark, tmp_path):
    notes = spark.createDataFrame([("a", "2026-01-05T00:00:00Z", "x"), ("b", "2026-02-01", "y"), ("c", None, "z")], "thread string, started_at string, note string")
    sinks.write_notes(notes, str(tmp_path / "n"))
    sinks.write_notes(notes.limit(0), str(tmp_path / "n"))
    assert (tmp_path / "n" / "year=2026" / "month=02").is_dir()
    assert rows(spark.read.parquet(str(tmp_path / "n")).select("thread", "started_at", "note")) == rows(notes)
    e = spark.createDataFrame([("k1", 1), ("k1", 1), ("k2", 2)], "entity_key string, n int")
    a = spark.createDataFrame([("a1", "x")], "activity string, stage string")
    for _ in range(2):
        sinks.write_provenance(e, a, str(tmp_path / "p"))
        sinks.write_provenance(e.limit(0), a.limit(0), str(tmp_path / "p"))
    assert rows(spark.read.parquet(str(tmp_path / "p" / "entities"))) == [("k1", 1), ("k2", 2)] and spark.read.parquet(str(tmp_path / "p" / "activities")).count() == 1
    for run in ("r1", "r2"):
        sinks.write_run_report(spark.createDataFrame([(run, 3)], "run string, n int"), str(tmp_path / "r"))
    assert rows(spark.read.json(str(tmp_path / "r")).select("run", "n")) == [("r1", 3), ("r2", 3)]


def as_dict(r):
    out = {"id": r["local_id"], "kind": r["kind"], "actor": r["actor"], "name": r["name"], "text": r["text"] or "", "timestamp": r["timestamp"], "turnId": r["turn_id"]}
    return out | ({"branchId": r["branch_id"], "rawRef": r["raw_ref"]} if r["branch_id"] else {})


def test_branched_requests(spark):
    """Sizes are those of the JSON, chunks keep the budget, parts carry their offsets."""
    base = {"thread": "t", "kind": "k", "actor": "tool", "name": "", "timestamp": "2026-01-01T00:00:00Z", "turn_id": "u"}
    texts = ["a", None, 'q"\\\n\u0001' * 3, "word " * 300, "b"]
    data = [base | {"ord": i, "local_id": f"L{i}", "text": t, "branch_id": (None, "H12", "")[i % 3], "raw_ref": 'raw:/"x'} for i, t in enumerate(texts)]
    events = spark.createDataFrame(data, "thread string, ord int, local_id string, kind string, actor string, name string, text string, timestamp string, turn_id string, branch_id string, raw_ref string")
    sized = {r["local_id"]: r["size"] for r in events.select("local_id", inputs.event_size(True).alias("size")).collect()}
    assert sized == {r["local_id"]: len(json.dumps(as_dict(r), ensure_ascii=False)) for r in data}
    chunks = inputs.chunk_events(inputs.split_events(events, 500), 500)
    seen = {}
    for r in inputs.render_requests(chunks, "", "").collect():
        assert len(r["request"]) <= 500
        for e in json.loads(r["request"]):
            part = e.pop("textPart", None)
            whole = texts[int(e["id"][1:])] or ""
            assert part is None or (whole[part["start"] : part["end"]] == e["text"] and part["fullTextCharacters"] == len(whole))
            seen.setdefault(e["id"], []).append((part["index"] if part else 1, e["text"]))
            assert ("branchId" in e) == (e["id"] in ("L1", "L4")) and e.get("rawRef", 'raw:/"x') == 'raw:/"x'
    assert {k: "".join(t for _, t in sorted(v)) for k, v in seen.items()} == {f"L{i}": t or "" for i, t in enumerate(texts)}


def test_reduction_and_repair(spark):
    p = spark.createDataFrame([("t", 2, "B"), ("t", 1, "A"), ("u", 1, None)], "thread string, chunk int, result string")
    assert rows(inputs.render_reduction(p, "<", ">")) == [("t", 0, "<[A, B]>")]
    f = spark.createDataFrame([("t", "y"), ("t", "x"), ("t", "x"), ("v", "z")], "thread string, fault string")
    assert rows(inputs.render_repair(p.filter("chunk = 1"), f, "fix:", "!")) == [("t", 1, "fix:\n- x\n- y\nA!")]


def test_local_times(spark):
    data = [("2026-01-01T00:00:00",), ("2026-01-01 00:00",), ("2026-01-01",), ("2026-01-01T00:00:00.5Z",), ("2026-01-01T00:00:00+09:00",), ("x",), ("",), (None,), ("2026-13-01",)]
    df = spark.createDataFrame(data, "t string")
    utc = 1767225600.0
    want = lambda h: [utc - 3600 * h] * 3 + [utc + 0.5, utc - 9 * 3600, None, None, None, None]
    for zone, hours in (("UTC", 0), ("Asia/Tokyo", 9)):
        spark.conf.set("spark.sql.session.timeZone", zone)
        try:
            got = [r[0] for r in df.select(T.event_epoch(F.col("t"))).collect()]
        finally:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
        assert got == want(hours)


def test_roots_of_slashes_hold_nothing(spark):
    paths = spark.createDataFrame([("/a/b",), ("/",), ("",), (None,), ("a",)], "path string")
    roots = spark.createDataFrame([("/", 1), ("", 2), (None, 3), ("///", 4), ("/A/", 5), ("a", 6)], "root string, project int")
    assert rows(attribution.within_roots(paths, roots)) == [("/a/b", 5), ("a", 6)]
    events = spark.createDataFrame([("t", "/a/b", None), ("t", "/", None), ("u", None, "")], "thread string, cwd string, thread_cwd string")
    assert rows(projects.select_for_roots(events, roots, events.select("thread").limit(0)).select("cwd")) == [("/a/b",)]


def test_timeline_of_branches(spark):
    """Headings of branches and days, and every line end that text may have."""
    ev = [("t", i, f"L{i}", "tool_call", "tool", "u", f"2026-01-0{1 + i // 2}T00:00:0{i}Z", ("", "H1", "H1", "H2", "H2")[i], "x") for i in range(5)]
    events = spark.createDataFrame(ev, "thread string, ord int, local_id string, kind string, actor string, turn_id string, timestamp string, branch_id string, text string")
    text = " a\r\nb\rc\x0bd\x0ce\x1cf\u0085g\u2028h\n\ni "
    items = spark.createDataFrame([("t", i, f"L{i}", f"L{i}", [f"L{i}"], text if i == 0 else "x", "Note") for i in range(5)], "thread string, pos int, start_id string, end_id string, event_ids array<string>, text string, label string")
    got = summaries.render_timeline(items, events, "N").first()["timeline"].split("\n")
    assert [x for x in got if x.startswith("#")] == ["### 2026-01-01", "### History H1", "#### 2026-01-01", "#### 2026-01-02", "### History H2", "#### 2026-01-02", "#### 2026-01-03"]
    at = got.index("  - Text: a")
    assert got[at + 1 : at + 10] == ["    b", "    c", "    d", "    e", "    f", "    g", "    h", "", "    i"]
    across = items.filter("pos = 2").withColumn("end_id", F.lit("L3")).withColumn("event_ids", F.array(F.lit("L2"), F.lit("L3")))
    assert [r["fault"] for r in summaries.validate_timeline(across, events).collect()] == ["range"]


def test_published_sources(spark):
    kind = "id int, source string, version string, status string"
    before = spark.createDataFrame([(1, "a", "v", "current"), (2, "b", "v", "current"), (3, None, "v", "current")], kind)
    now = spark.createDataFrame([(1, "a", "w", "current"), (2, "a", "w", "current"), (2, "a", "w", "current")], kind)
    assert rows(provenance.publish_index(before, now.limit(0), "a").select("id", "status")) == [(1, "inactive"), (2, "current"), (3, "current")]
    assert rows(provenance.publish_index(before, now.limit(0)).select("status").distinct()) == [("inactive",)]
    assert rows(provenance.index_faults(before, now, "a")) == [(2, "duplicate-id"), (2, "foreign-owner")] and provenance.index_faults(before, now).count() == 1


def test_empty_tables(spark):
    c = spark.createDataFrame([], "source_id string, source_ref string, capture_ref string, thread_id string, error string, sha256 string, line_no int, schema_version int")
    assert all(x.count() == 0 for x in capture.group_threads(c, c))
    d = capture.diff_captures(c, c, c, True, 3)
    assert d.count() == 0 and capture.capture_report(d, c, c).count() == 0 and capture.merge_manifest(c, c, d).count() == 0
    n = spark.createDataFrame([], "thread string, source string, project int, started_at string, title string, name string, status string, reason string, fresh boolean, exists boolean, edited boolean, reviewed boolean, role string, text string")
    assert summaries.note_names(n, n).count() == 0 and provenance.plan_notes(n.drop("status", "reason")).count() == 0 and attribution.last_served(n, 3).count() == 0
    assert attribution.apply_limit(n, 3, ["source", "thread"]).count() == 0 and threads.messages_by_role(n).count() == 0 and planning.duplicate_threads(n).count() == 0
    s = spark.createDataFrame([], "source_id string, status string, generated boolean")
    assert provenance.run_summary(s, s).count() == 0
    f = spark.createDataFrame([("t", None, ["b", "a"], None), ("t", [2], ["a"], None)], "thread string, invalid_lines array<int>, unknown_types array<string>, metadata_ids array<string>")
    assert [r["unknown_types"] for r in records.thread_diagnostics(f).collect()] == [["a", "b"]]


def test_null_flags_count_as_false(spark):
    n = spark.createDataFrame([(None, None, None, None), (True, True, None, None), (False, True, True, True)], "fresh boolean, exists boolean, edited boolean, reviewed boolean")
    assert [r["status"] for r in provenance.plan_notes(n).collect()] == ["generate", "current", "blocked"]


@pytest.mark.parametrize("state", [True, False])
def test_membership_states(spark, state):
    t = spark.createDataFrame([("a", None), ("b", 7), ("c", None)], "thread string, assigned int")
    o = spark.createDataFrame([("a", 2), ("a", 1), ("a", 2), ("b", 3)], "thread string, project int")
    got = rows(attribution.membership(t, t.filter("thread = 'z'"), o, state))
    assert got == ([("a", "ambiguous", None, [1, 2]), ("b", "explicit", 7, []), ("c", "unmatched", None, [])] if state else [(x, "state-unavailable", None, []) for x in "abc"])
