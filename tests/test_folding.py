"""Full case folding against the language's own, and what rests on it."""

import sys

from pyspark.sql import functions as F

from talespark.functions import text as T
from talespark.operators import summaries


def test_folds_every_letter(spark):
    """All code points but surrogates. Letters that are newer than the JVM's table stay as they are."""
    codes = [c for c in range(1, sys.maxunicode + 1) if not 0xD800 <= c < 0xE000]
    kept = [c for c in codes if chr(c).casefold() != chr(c)] + list(range(0x20, 0x3000))
    got = spark.createDataFrame([(c, f"x{chr(c)}y") for c in kept], "code int, s string").select("code", T.fold(F.col("s")).alias("f")).collect()
    unlike = [r["code"] for r in got if r["f"] != f"x{chr(r['code'])}y".casefold()]
    assert set(unlike) <= {0x1C89}, [hex(c) for c in unlike]  # a letter of Unicode 16


def test_folds_words(spark):
    words = ["STRASSE", "straße", "STRAẞE", "ΟΔΟΣ", "οδος", "οδοσ", "ﬁlE", "İ", "ŉ", "Ꭰꭰ", "𐐀", "ſ", "K", "", "plain", "A:B,c", None, "x" * 100_000 + "ß"]
    got = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "i int, w string").select("i", T.fold(F.col("w")).alias("f")).collect()
    assert {r["i"]: r["f"] for r in got} == {i: None if w is None else w.casefold() for i, w in enumerate(words)}


def test_paths_and_urls_fold(spark):
    rows = [("/mnt/c/Straße/ﬀ/", "git@Host:STRAẞE/ΟΔΟΣ.git")]
    got = spark.createDataFrame(rows, "p string, u string").select(T.normalize_path(F.col("p")), T.normalize_repo_url(F.col("u")), T.normalize_git_remote(F.col("u"))).first()
    assert tuple(got) == ("c:\\strasse\\ff", "https://host/strasse/οδοσ", "https://host/strasse/οδοσ")


def test_timeline_literals_fold(spark):
    """A quoted path is found whatever the case of its letters, sharp s and final sigma too."""
    events = spark.createDataFrame([("t", 1, "L1", "user", "user_message", "", "", "2024-01-01T00:00:00Z", "in ./Straße/ΟΔΟΣ now")], "thread string, ord int, local_id string, actor string, kind string, turn_id string, branch_id string, timestamp string, text string")
    for literal, fault in (("./STRASSE/οδος", None), ("./strase/x", "path-not-in-source")):
        items = spark.createDataFrame([("t", 1, "L1", "L1", ["L1"], f"see `{literal}`")], "thread string, pos int, start_id string, end_id string, event_ids array<string>, text string")
        assert [r["fault"] for r in summaries.validate_timeline(items, events).collect()] == ([fault] if fault else [])
