"""Ranks over ranges and the cut of a fair order, against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from talespark.operators import attribution, ranks


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def plain_turns(data):
    out, seen = [], {}
    for p, at, t in sorted(data, key=lambda r: (r[1] is not None, r[1] or "", r[2])):
        seen[p] = seen.get(p, 0) + 1
        out.append((p, at, t, seen[p]))
    return out


def table(spark, data):
    return spark.createDataFrame(data, "project int, started_at string, thread string")


@pytest.fixture
def many_tasks(spark):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", old)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_turns_over_many_tasks(spark, many_tasks):
    """One project has most rows; a null project, null times and one-row projects."""
    rng = random.Random(3)
    data = [(rng.choice([1] * 8 + [2, 3, None]), rng.choice([None, *"abcd"]), f"t{i}") for i in range(900)] + [(100 + i, "a", "x") for i in range(40)]
    got = attribution.round_robin(table(spark, data))
    assert rows(got) == sorted(plain_turns(data), key=repr)
    runs = ranks.ranked(table(spark, data), ["project"], ["started_at", "thread"]).filter("project = 1")
    assert runs.count() == sum(p == 1 for p, _, _ in data)


@pytest.mark.parametrize("n", [1, 7, 40, 500, 2000])
def test_budgets(spark, n):
    rng = random.Random(n)
    data = [(rng.choice([1] * 5 + [2, 2, 3, 4, None]), f"{rng.randrange(99):02d}", f"t{i}") for i in range(600)]
    turns = plain_turns(data)
    first = sorted(turns, key=lambda r: (r[3], r[0] is not None, r[0] or 0))[:n]
    last = sorted(turns, key=lambda r: (-r[3], r[0] is None, -(r[0] or 0)))[:n]
    assert rows(attribution.first_served(table(spark, data), n)) == sorted(first, key=repr)
    assert rows(attribution.last_served(table(spark, data), n)) == sorted(last, key=repr)


def test_empty_and_repeated(spark):
    none = table(spark, [])
    assert attribution.round_robin(none).count() == attribution.first_served(none, 3).count() == attribution.last_served(none, 3).count() == 0
    same = table(spark, [(1, "a", "t")] * 5)
    assert [r["turn"] for r in attribution.round_robin(same).orderBy("turn").collect()] == [1, 2, 3, 4, 5]
    assert attribution.round_robin(same.withColumn("more", F.lit(1))).columns == ["project", "started_at", "thread", "more", "turn"]


def test_cuts_by_brute_force():
    rng = random.Random(6)
    for _ in range(400):
        sizes = [rng.randrange(1, 12) for _ in range(rng.randrange(1, 8))]
        counts, n = {s: sizes.count(s) for s in sizes}, rng.randrange(1, 60)
        served = lambda t, sizes=sizes: sum(min(s, t) for s in sizes)
        left = lambda t, sizes=sizes: sum(max(0, s - t) for s in sizes)
        assert ranks.turns_served(counts, n) == next((t for t in range(max(sizes) + 1) if served(t) >= n), max(sizes))
        assert ranks.turns_left(counts, n) == max((t for t in range(max(sizes)) if left(t) >= n), default=0)
    assert ranks.turns_served({}, 5) == ranks.turns_left({}, 5) == 0
