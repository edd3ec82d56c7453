"""App-state files: shapes, ids, times and references; names of notes in other zones."""

import json

from talespark.operators import summaries
from talespark.sources import state


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def project(ident="p", **other):
    return {"id": ident, "name": " N ", "rootPaths": ["/r"], "createdAt": "2024-01-01T00:00:00Z"} | other


def test_app_state_faults(spark):
    made = {"ok": project("ok"), "blank": project(" blank "), "-x": project("-x"), "name": project("name", name=" "), "roots": project("roots", rootPaths=[]), "time": project("time", createdAt="x"), "later": project("later", updatedAt="x"), "key": project("other"), "list": [1], "none": None}
    given = {"a": {"projectKind": "local", "projectId": "ok", "cwd": "/r"}, "b": {"projectKind": "local", "projectId": "name"}, "c": {"projectKind": "remote", "projectId": "far"}, "d": {"projectId": "ok"}, "e": "ok"}
    whole = {"local-projects": made, "thread-project-assignments": given, "projectless-thread-ids": ["u", "u"], "more": 1}
    texts = [("1", json.dumps(whole)), ("2", "﻿{}"), ("3", "[]"), ("4", None), ("5", ""), ("6", "{broken"), ("7", json.dumps({"local-projects": [], "thread-project-assignments": {}, "projectless-thread-ids": ["u", None]})), ("8", json.dumps(whole))]
    files = spark.createDataFrame(texts, "source string, value string")
    p, a, f, faults = state.app_state_tables(files.filter("source <> '8'"))
    assert rows(p.select("project", "name", "roots")) == [("blank", "N", ["/r"]), ("ok", "N", ["/r"])]
    assert rows(a.select("thread", "project_kind", "project", "cwd")) == [("a", "local", "ok", "/r"), ("c", "remote", "far", None)]
    assert rows(f) == [("1", "u")]
    found = [(r["source"], r["item"] or r["member"], r["fault"]) for r in faults.collect()]
    items = [("-x", "id"), ("name", "name"), ("roots", "roots"), ("time", "time"), ("later", "time"), ("key", "key"), ("list", "shape"), ("none", "shape"), ("b", "unknown-project"), ("d", "shape"), ("e", "shape")]
    members = [("2", "local-projects"), ("2", "thread-project-assignments"), ("3", "file"), ("4", "file"), ("5", "file"), ("6", "file"), ("7", "local-projects"), ("7", "projectless-thread-ids")]
    assert sorted(found) == sorted([("1", *x) for x in items] + [(*x, "shape") for x in members])
    assert all(t.count() == 0 for t in state.app_state_tables(files.limit(0)))


def test_app_states_are_read_once(spark):
    """Each file is parsed once for all four tables, and its projects by several tasks."""
    from pyspark.sql import functions as F

    read = spark.sparkContext.accumulator(0)
    count = F.udf(lambda s: read.add(1) or s, "string").asNondeterministic()
    text = json.dumps({"local-projects": {f"p{i}": project(f"p{i}") for i in range(50)}, "thread-project-assignments": {}, "projectless-thread-ids": []})
    files = spark.createDataFrame([("1", text), ("2", text)], "source string, value string").withColumn("value", count("value"))
    p, a, f, faults = state.app_state_tables(files)
    assert p.count() == 100 and a.count() == f.count() == faults.count() == 0
    assert read.value == 2 and len({x.rsplit("/", 1)[-1] for x in p.inputFiles()}) > 1


def test_app_state_file(spark, tmp_path):
    for name in ("a.json", "it's b.json"):
        (tmp_path / name).write_text("﻿" + json.dumps({"local-projects": {"p": project()}, "thread-project-assignments": {"t": {"projectKind": "local", "projectId": "p"}}}, indent=1), "utf-8")
    p, a, f, faults = state.read_app_state(spark, str(tmp_path))
    assert p.count() == a.count() == 2 and f.count() == faults.count() == 0
    assert len({r["source"] for r in p.collect()}) == 2


def test_note_names_in_other_zones(spark):
    notes = spark.createDataFrame([("t1", "2024-01-01T20:00:00Z", "a title"), ("t2", None, "x"), ("t3", None, "x"), ("t4", "2024-01-01T20:00:00Z", "A Title")], "thread string, started_at string, title string")
    none = spark.createDataFrame([], "name string")
    assert rows(summaries.note_names(notes, none, -5).select("thread", "name")) == [("t1", "20240101T150000-0500-a-title.md"), ("t2", None), ("t3", None), ("t4", "20240101T150000-0500-a-title-t4.md")]
    assert rows(summaries.note_names(notes, none).select("name"))[0] == ("20240102T050000+0900-a-title-t4.md",)
