"""Versions that begin no longer one: repeated, empty and null contents; contents stay out of shuffles."""

import re

from talespark.operators import capture
from talespark.plans import registry


def test_last_versions(spark):
    rows = [("t", b"ab"), ("t", b"ab"), ("t", b"abc"), ("t", b"abc"), ("t", b"b"), ("t", b""), ("u", b"ab"), ("u", None), ("u", None), ("v", b""), (None, b"a"), (None, b"a")]
    c = capture.with_digest(spark.createDataFrame(rows, "thread string, content binary"))
    out = capture.last_versions(c)
    want = capture.collapse_prefixes(c.distinct()).select("thread", "sha256", "byte_count")
    assert sorted(map(tuple, out.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)
    assert sorted((r["thread"] or "", r["byte_count"] or 0) for r in out.collect()) == [("", 1), ("t", 1), ("t", 3), ("u", 0), ("u", 2), ("v", 0)]


def test_contents_are_no_keys(spark, data):
    plan = registry.prefix_versions(spark, data)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" in plan and not re.search(r"Aggregate \[[^\]]*(content|text)#", plan)
