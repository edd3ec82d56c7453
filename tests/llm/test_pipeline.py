"""The pipeline against brute force, stage by stage on each stage's own input."""

import re

import duckdb
import numpy as np
import pytest

from talespark.llm import rules

from .test_operators import ODD, base, brute_components, contained, copy_runs, is_copy, ratios, tokenizer  # noqa: F401

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def rows(df):
    return sorted((r["doc_id"], r["text"]) for r in df.collect())


def test_stages(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    columns, kept = docs.columns, rows(docs)
    (_, f5), (_, f1), (_, f10), (_, f2), (_, f8) = corpus_pipeline.STAGES
    good = {r[0] for r in duckdb.sql(f"SELECT doc_id FROM '{data}/labels.parquet' WHERE quality = 1").fetchall()}
    llr = ratios([t for _, t in kept], [i in good for i, _ in kept])
    want = [r for r, x in zip(kept, llr) if not base(r[1])[-1] and x >= rules.THRESHOLD]
    docs = f5(spark, docs, data)
    assert docs.columns == columns and rows(docs) == want

    docs = f1(spark, docs, data)
    want = [r for r in want if re.search(r"[^\W\d_]", r[1])]
    assert docs.columns == columns and rows(docs) == want

    docs = f10(spark, docs, data)
    roots = brute_components([copy_runs(t) for _, t in want], near=is_copy)
    first = {}
    for r, (i, _) in zip(roots, want):
        first[r] = min(i, first.get(r, i))
    want = [x for r, x in zip(roots, want) if first[r] == x[0]]
    assert docs.columns == columns and rows(docs) == want

    docs = f2(spark, docs, data)
    items = duckdb.sql(f"SELECT item_id, text FROM '{data}/benchmark.parquet'").fetchall()
    bad = {i for i, _ in contained(want, items)}
    want = [r for r in want if r[0] not in bad]
    assert docs.columns == columns and rows(docs) == want

    out = f8(spark, docs, data).toPandas()
    assert set(out["doc_id"]) == {i for i, _ in want}


def test_stages_on_odd_rows(spark, data):
    odd = spark.createDataFrame(ODD, "doc_id long, text string, lang string, source string, n_chars long")
    for table in (odd, odd.limit(0)):
        docs = table
        for name, stage in corpus_pipeline.STAGES:
            got = stage(spark, table, data)
            if name != "packing":
                assert got.columns == table.columns
            assert got.count() >= 0
            docs = stage(spark, docs, data) if name != "packing" else docs
    same = spark.createDataFrame([(6, "same words here"), (6, "same words here"), (7, "same words here")], "doc_id long, text string")
    assert rows(corpus_pipeline.keep_one_of_each(spark, same, data)) == [(6, "same words here")]


def test_rows_of_one_id_or_none_are_judged_by_their_texts(spark, data):
    """Repeated and null ids with different texts: no text is lost that nothing rejects."""
    rng = np.random.default_rng(4)
    item = duckdb.sql(f"SELECT text FROM '{data}/benchmark.parquet' WHERE length(text) > 60 LIMIT 1").fetchall()[0][0]
    clean = [t for (t,) in duckdb.sql(f"SELECT DISTINCT text FROM '{data}/documents.parquet' JOIN '{data}/labels.parquet' USING (doc_id) WHERE quality = 1 AND length(text) BETWEEN 600 AND 4000 ORDER BY text LIMIT 12").fetchall()]
    a, b, c, e, f, g = (x for x in clean[:6])
    docs = [(5, a), (5, b), (0, b), (8, c), (8, e), (None, f), (None, f), (None, g), (None, "bad"), (8, "bad too"), (8, "bad too"), (11, e + " " + item), (11, a[:300] + " " + item)]
    junk = [(20, " ".join(rng.choice(list("#$%&<>|"), 60))), (20, clean[7]), (7, clean[7]), (None, clean[7])]
    table = spark.createDataFrame(docs + junk, "doc_id long, text string").selectExpr("doc_id", "text", "'en' AS lang", "'s' AS source", "1 AS TEXT_", "2L AS n_chars")
    kept = [(r["doc_id"], r["text"]) for r in corpus_pipeline.keep_one_of_each(spark, table, data).collect()]
    roots, want = brute_components([copy_runs(t) for _, t in docs + junk], near=is_copy), {}
    for r, (i, t) in zip(roots, docs + junk):
        want[r] = min(want.get(r, (True, 2**63)), (i is None, i or 0))
    assert len(kept) == len(want)
    for i, t in kept:  # of the smallest id of its component
        r = roots[(docs + junk).index((i, t))]
        assert (i is None, i or 0) == want[r]
    assert {a, b, c, e, f, g} <= {t for _, t in kept}

    found = corpus_pipeline.drop_benchmark(spark, table, data)
    bad = {t for t in dict.fromkeys(t for _, t in docs + junk) if contained([(0, t)], duckdb.sql(f"SELECT item_id, text FROM '{data}/benchmark.parquet'").fetchall())}
    assert len(bad) >= 2 and sorted(((r["doc_id"], r["text"]) for r in found.collect()), key=repr) == sorted((x for x in docs + junk if x[1] not in bad), key=repr)

    good = {r[0] for r in duckdb.sql(f"SELECT doc_id FROM '{data}/labels.parquet' WHERE quality = 1").fetchall()}
    llr = ratios([t for _, t in docs + junk], [i in good for i, _ in docs + junk])
    passed = [x for x, s in zip(docs + junk, llr) if not base(x[1])[-1] and s >= rules.THRESHOLD]
    got = corpus_pipeline.keep_quality(spark, table, data)
    assert got.columns == table.columns and sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=repr) == sorted(passed, key=repr)


def test_mixed_and_garbled_texts_go(spark):
    """Planted texts, unlabelled or labelled, go; held-out clean texts all stay."""
    rng = np.random.default_rng(9)
    parts = {"aa": "ba do ki mu ne ra", "bb": "sch ein ter ung pf oz", "cc": "eau oui ent lle qu x", "dd": "zyk wro cja nad prz ow"}
    vocabulary = {k: ["".join(rng.choice(v.split(), int(rng.integers(1, 4)))) for _ in range(300)] for k, v in parts.items()}
    draw = lambda k, n: [str(w) for w in rng.choice(vocabulary[k], n)]
    clean = [(i, " ".join(draw(k, int(rng.integers(40, 200)))), k) for i, k in enumerate(list(parts) * 60)]
    planted = []
    for i in range(30):
        a, b = rng.choice(list(parts), 2, replace=False)
        mixed = [w for pair in zip(draw(a, 60), draw(b, 60)) for w in pair]
        noise = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), int(rng.integers(2, 9)))) for _ in range(100)]
        planted += [(1000 + 2 * i, " ".join(mixed), None), (1001 + 2 * i, " ".join(noise), "aa" if i % 10 == 0 else None)]
    docs = spark.createDataFrame(clean + planted, "doc_id long, text string, lang string")
    kept = {r["doc_id"] for r in corpus_pipeline.keep_language(spark, docs, None).collect()}
    assert {i for i, _, _ in clean} <= kept
    assert [i for i, _, _ in planted if i % 2 and i in kept] == []
    assert sum(i in kept for i, _, _ in planted if i % 2 == 0) <= 3
