"""Source divergence against its plain definition."""

import random
import re
from collections import Counter, defaultdict

import duckdb
import pyarrow as pa

from talespark.llm import divergence, queries

A_Z = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string"


def plain(rows):
    counts, docs, out = defaultdict(Counter), defaultdict(Counter), set()
    groups = {((lang or ""), (source or "")) for _, _, lang, source in rows}
    for _, text, lang, source in rows:
        terms = re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", (text or "").translate(A_Z))
        counts[lang or "", source or ""].update(terms)
        docs[lang or ""].update(set(terms))
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in docs[lang].items() if n >= 3]
        mine = [s for k, s in groups if k == lang]

        def shares(c, kept=kept):
            n = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 1) // (n + len(kept)) for t in kept}

        p = {s: shares(counts[lang, s]) for s in mine}
        q = shares(sum((counts[lang, s] for s in mine), Counter()))
        f = lambda a, b: (a - b) ** 2 // b
        for s in mine:
            pairs = [(o, sum(f(p[s][t], p[o][t]) for t in kept)) for o in mine if o != s]
            terms = [(t, f(p[s][t], q[t])) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, items in (("pair", pairs), ("term", terms)):
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out |= {(lang, s, part, i, v, k) for k, (i, v) in enumerate(items, 1) if part == "pair" or k <= 200}
    return out


def got(out):
    rows = [tuple(r) for r in out.select("lang", "source", "part", "item", "value", "rank").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_whole_query_by_brute_force(spark, data):
    rows = duckdb.sql(f"SELECT doc_id, text, lang, source FROM '{data}/documents.parquet'").fetchall()
    assert got(queries.QUERIES["op13_source_divergence"](spark, data)) == plain(rows)


ODD = [
    (1, None, None, None),
    (2, "", "en", "a"),
    (3, "123 !!", "en", "empty group"),
    (4, "Same text İ É. x_y", "en", "a"),
    (4, "Same text İ É. x_y", "en", "a"),
    (5, "Same text İ É. x_y", "en", "b"),
    (6, "Same text İ É. x_y", "fr", "b"),
    (None, "one two three one", "en", None),
    (7, "one two", "en", "b"),
    (8, "two one\x00two \U0001f600two", "en", "b"),
    (9, "word " * 50_000 + "w" * 100_000, "de", "a"),
    (10, "word", "de", "b"),
    (11, "word", "de", "c"),
    (12, "text without a kept term", "nl", "a"),
    (13, "another", "nl", "b"),
]


def test_odd_rows(spark):
    docs = spark.createDataFrame(ODD, SCHEMA).selectExpr("*", "'x' AS TEXT", "1 AS n", "2 AS docs", "'z' AS Lang")
    want = plain(ODD)
    assert got(divergence.source_divergence(docs)) == want
    assert {("nl", "a", "pair", "b", 0, 1), ("en", "empty group", "pair", "a")} <= want | {w[:4] for w in want}
    assert got(divergence.source_divergence(docs.limit(0))) == set()


def test_hot_copies_and_many_ties(spark):
    """A third of all rows is one text; sources of very unlike sizes; equal values."""
    rng = random.Random(2)
    words = ["w" + chr(97 + i % 26) + chr(97 + i // 26) for i in range(300)]
    rows = [(i, "hot text of many copies", "en", f"s{i % 7}") for i in range(400)]
    rows += [(i, " ".join(rng.choices(words, k=rng.randrange(30))), rng.choice(["en", "de"]), f"s{min(int(rng.expovariate(0.5)), 11)}") for i in range(800)]
    assert got(divergence.source_divergence(spark.createDataFrame(rows, SCHEMA))) == plain(rows)


def test_shares_are_exact(spark):
    rng = random.Random(4)
    cases = [(rng.randrange(10**k), 10**k + rng.randrange(10**k)) for k in range(1, 15) for _ in range(40)] + [(0, 1), (8 * 10**15 - 1, 8 * 10**15)]
    rows = spark.createDataFrame(cases, "c long, t long").selectExpr("c", "t", f"{divergence.share('c', 't')} AS p").collect()
    assert all(r["p"] == 1 + 10**9 * (r["c"] + 1) // r["t"] for r in rows)


def test_counts_do_not_depend_on_what_a_task_holds(monkeypatch):
    texts = pa.RecordBatch.from_pydict({"lang": ["en", "en", "de"], "text": ["A b b", "b c", "b"], "sources": [["x", "y"], ["x"], ["z"]], "copies": [[2, 1], [1], [4]], "docs": [3, 1, 4]})
    out = []
    for held in (0, 10**6):
        monkeypatch.setattr(divergence, "HELD", held)
        batches = list(divergence._count(iter([texts])))
        total = Counter()
        for r in (r for b in batches for r in b.to_pylist()):
            total.update({(r["lang"], r["term"], k): n for k, n in zip(r["sources"], r["n"])})
        out.append((len(batches), total))
    assert out[0][0] == 3 and out[1][0] == 1 and out[0][1] == out[1][1]
    assert out[0][1]["en", "b", "x"] == 5 and out[0][1]["en", "b", None] == 4 and out[0][1]["de", "b", "z"] == 4
