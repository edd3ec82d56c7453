"""Large files and threads by many tasks, against the versions that see them whole; times."""

import _pydatetime
import json
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from talespark.functions import text as T
from talespark.operators import inputs, records, segments
from talespark.sources import lines, logs


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture
def small_blocks(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "97")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def test_lines_of_cut_files(spark, tmp_path, small_blocks):
    """Every line end across every cut, marks of byte order, blank lines, files not UTF-8."""
    rng = random.Random(1)
    files = {}
    for i in range(12):
        parts = [rng.choice(["", " ", "é", "x" * rng.randrange(60), " ", " a\tb "]) + rng.choice(["\n", "\r\n", "\r", "\n\r", "\r\r\n"]) for _ in range(60)]
        files[f"f{i}.jsonl"] = ("﻿" * (i % 3 == 0) + "".join(parts) + ("tail" if i % 2 else "")).encode()
    files |= {"empty.jsonl": b"", "bad.jsonl": b"ok\n" * 80 + b"\xff\n" + b"ok\n" * 80, "mark.jsonl": "a\n﻿b\n".encode(), "one.jsonl": b"y" * 500}
    for name, data in files.items():
        (tmp_path / "sub").mkdir(exist_ok=True)
        (tmp_path / "sub" / name).write_bytes(data)
    (tmp_path / "other.txt").write_text("no")
    got, bad = lines.file_lines(spark, str(tmp_path))
    name = F.substring_index("path", "/", -1).alias("k")
    whole = spark.createDataFrame([(k, bytearray(v)) for k, v in files.items()], "k string, content binary")
    assert rows(got.select(name, "line_no", "raw")) == rows(logs.read_lines(whole, "k"))
    assert rows(bad.select(name)) == [("bad.jsonl",)]
    assert got.select("path", "line_no").distinct().count() == got.count() > 300


def log_lines(rng, n):
    out = []
    for i in range(1, n + 1):
        at = f"2026-01-01T00:00:{i % 60:02d}Z"
        kind = rng.choice("mtthssuooc")
        cwd = rng.choice(["", "/a", "/b", "/c"])
        if kind == "m":
            out.append({"type": "session_meta", "timestamp": at, "payload": {"id": "x", "cwd": cwd, "timestamp": rng.choice(["", at])}})
        elif kind == "t":
            out.append({"type": "turn_context", "payload": {"turn_id": rng.choice(["", f"t{i}"]), "cwd": cwd}})
        elif kind == "h":
            out.append({"id": "old", "instructions": None, "timestamp": at, "cwd": cwd})
        elif kind == "o":
            out.append({"type": "message", "role": "user", "content": f"said {i % 4}"})
        elif kind == "c":
            out.append({"type": "response_item", "payload": {"type": "tool_call", "name": "n", "input": "i"}})
        else:
            out.append({"type": "event_msg", "timestamp": at, "payload": {"type": "user_message", "message": f"m{rng.randrange(5)}"}})
    return [json.dumps(x) for x in out]


@pytest.mark.parametrize("size", [1, 3, 10, 1000])
def test_context_by_segments(spark, size):
    rng = random.Random(size)
    data = [(f"f{k}", i + 1, raw) for k in range(6) for i, raw in enumerate(log_lines(rng, rng.choice([1, 5, 40]))) if rng.random() < 0.9]
    df = spark.createDataFrame(data, "thread string, line_no int, raw string")
    parsed = records.parse_lines(df)
    cols = ["thread", "line_no", "thread_cwd", "turn_id", "cwd", "header_at"]
    assert rows(segments.fill_context_by_segments(parsed, "thread", size).select(cols)) == rows(records.fill_context(parsed, "thread").select(cols))
    whole = records.log_events(df, "thread")
    assert rows(segments.long_log_events(df, "thread", size).select(whole.columns)) == rows(whole)
    assert segments.long_log_events(df.limit(0), "thread", size).count() == 0


@pytest.mark.parametrize("size", [1, 4, 25, 10_000])
def test_chunks_by_segments(spark, size):
    rng = random.Random(size)
    data = []
    for k in range(5):
        for i in range(rng.choice([1, 30, 200])):
            n = 3 if rng.random() < 0.08 else 1
            data += [(f"t{k}", i, p, rng.choice([1, 20, 40, 98]), n, f"x{i}") for p in range(1, n + 1)]
    split = spark.createDataFrame(data, "thread string, ord int, part int, size int, parts int, local_id string")
    assert rows(segments.long_chunk_events(split, 100, size)) == rows(inputs.chunk_events(split, 100).select(*split.columns, "chunk"))
    assert segments.long_chunk_events(split.limit(0), 100, size).count() == 0


def test_long_thread_spreads_over_tasks(spark):
    """One thread: its segments are finished in many partitions, none of which has it all."""
    split = spark.range(4000).selectExpr("'t' AS thread", "CAST(id AS int) AS ord", "1 AS part", "50 AS size", "1 AS parts")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = segments.long_chunk_events(split, 1000, 100).withColumn("p", F.spark_partition_id()).groupBy("p").count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(out) > 1 and max(r["count"] for r in out) < 4000


def iso_forms(n):
    """Texts in and near all forms of ISO 8601."""
    rng = random.Random(7)
    two = lambda top: f"{rng.randrange(top):02d}"

    def clock(colons):
        c = ":" if colons else ""
        t = two(26) + rng.choice(["", c + two(62), c + two(62) + c + two(62)])
        return t + (rng.choice(".,") + "".join(rng.choice("0123456789") for _ in range(rng.randrange(8))) if rng.random() < 0.3 else "")

    for _ in range(n):
        y, m, d, w = f"{rng.choice([1, 1600, 1969, 1970, 2020, 2024, 2026, 2027, 9998]):04d}", two(14), two(33), two(56)
        date = rng.choice([f"{y}-{m}-{d}", f"{y}{m}{d}", f"{y}-W{w}-{rng.randrange(9)}", f"{y}W{w}{rng.randrange(9)}", f"{y}-W{w}", f"{y}W{w}", f"{y}-{m}{d}"])
        text = date + rng.choice(["T", " ", "x", "-", "1", "Z", "é", ""]) + clock(rng.random() < 0.6) + rng.choice(["", "Z", "+00:00", "-09:30", "+0930", "+09", "+09:00:30", "-093059.5", "z", "+24:00", "+", "+9"])
        if rng.random() < 0.15:
            i = rng.randrange(len(text))
            text = text[:i] + rng.choice(["", " ", ":", "-", "9"]) + text[i + 1 :]
        yield text


def plain_epoch(text, kind=datetime):
    try:
        at = kind.fromisoformat(text.replace("Z", "+00:00"))
    except ValueError:
        return None
    return None if at.tzinfo is None else (at.replace(tzinfo=None) - kind(1970, 1, 1) - at.utcoffset()).total_seconds()


def test_times_in_all_forms(spark):
    texts = [*iso_forms(6000), "T12:30:00Z", " 2024-01-01T00:00:00Z", "2024-01-01T00:00:00+09", "20240101T000000Z", "2024-W01-1T00:00Z", "2024-01-01T00:00:00+09:00:30", "2020-W53-7T23Z", "2021-W53-1T00Z", "0000-01-01T00Z", "2024-02-30T00Z", "2024-W01-1210:00Z", "2024W01123Z", "", "x"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(T.epoch_of(F.col("t"))).collect()]
    want = [plain_epoch(t) for t in texts]
    # the standard library's two readers differ on odd characters before an offset; either will do
    want = [None if a is None and plain_epoch(t, _pydatetime.datetime) is None else b for t, a, b in zip(texts, got, want)]
    wrong = [(t, a, b) for t, a, b in zip(texts, got, want) if (a is None) != (b is None) or a is not None and abs(a - b) > 1e-5]
    assert not wrong, wrong[:10]
    assert sum(x is not None for x in want) > 300
