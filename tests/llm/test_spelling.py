"""Spelling variants against brute force."""

import random
import re
import zlib
from collections import Counter

import duckdb
import pytest

from talespark.llm import queries, spelling

A_Z = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def near(a, b):
    """Exactly one inserted, deleted or replaced code point."""
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_groups(n):
    """word to (n, form, root, n_near, form_n) from word counts."""
    out, form = {}, {}
    for w in n:
        others = sorted((o for o in n if near(w, o)), key=lambda o: (-n[o], o))
        form[w] = others[0] if others and n[others[0]] >= 2 * n[w] else None
        out[w] = len(others)
    root = lambda w: w if form[w] is None else root(form[w])
    return {w: (n[w], form[w], root(w), out[w], n[form[w]] if form[w] else None) for w in n}


def plain_words(rows):
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(A_Z)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    return {w: c for w, c in n.items() if c >= 3 and len(w) >= 5}


def plain(out):
    rows = out.select("word", "n", "form", "root", "n_near", "form_n").collect()
    got = {r[0]: tuple(r)[1:] for r in rows}
    assert len(got) == len(rows)
    return got


def table(spark, n):
    return spark.createDataFrame([*n.items()], "word string, n long")


def test_whole_query_by_brute_force(spark, data):
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{data}/documents.parquet'").fetchall()
    got = plain(queries.QUERIES["op12_spelling_variants"](spark, data))
    assert got == plain_groups(plain_words(rows))
    assert sum(x[1] is not None for x in got.values()) > 20


def test_odd_documents(spark, tmp_path):
    words = "Straße STRASSE straße Éclair éclair eclair naïve naive x×yzab x÷yzab abcde abcdef Abcde abde"
    rows = [(1, None), (2, ""), (None, words), (None, words), (3, words * 40), (3, words), (4, "İstanbul istanbul Kelvin kelvin " * 4), (5, "y" * 30_000 + " " + "y" * 30_001), (6, "y" * 30_000 + " " + "y" * 30_001), (7, "y" * 30_000 + "," + "y" * 30_001)]
    spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "doc_id AS TEXT_", "'abcdef abcdef abcdef' AS source").write.parquet(f"{tmp_path}/documents.parquet")
    got = plain(queries.QUERIES["op12_spelling_variants"](spark, str(tmp_path)))
    assert got == plain_groups(plain_words(rows)) and any(len(w) == 30_000 for w in got)


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert plain(queries.QUERIES["op12_spelling_variants"](spark, str(tmp_path))) == {}


@pytest.mark.parametrize("max_part", [1, 3, 50, 8192])
def test_parts_of_any_size_lose_no_pair(spark, max_part):
    """Few letters, so that nearly all words are near, runs of one letter, and equal counts."""
    rng = random.Random(max_part)
    words = {"".join(rng.choice("aabé") for _ in range(rng.randrange(1, 8))) for _ in range(220)} | {"a" * k for k in range(1, 9)}
    n = {w: rng.choice([3, 3, 4, 6, 9, 20, 50]) for w in words}
    assert plain(spelling.spelling_groups(table(spark, n), max_part=max_part)) == plain_groups(n)


def test_hot_start(spark):
    """A third of all words starts alike, another third ends alike."""
    rng = random.Random(8)
    draw = lambda k: "".join(rng.choice("abcdefgh") for _ in range(k))
    words = {"hot" + draw(3) for _ in range(150)} | {draw(3) + "tail" for _ in range(150)} | {draw(6) for _ in range(150)}
    n = {w: rng.randrange(3, 99) for w in words}
    assert plain(spelling.spelling_groups(table(spark, n), max_part=20)) == plain_groups(n)


def test_long_chain_of_forms(spark):
    n = {"a" * k + "b" * (24 - k): 3 * 2**k for k in range(25)}
    got = plain(spelling.spelling_groups(table(spark, n)))
    assert got == plain_groups(n) and got["b" * 24][2] == "a" * 24


def test_acceptor_is_minimal_and_numbers_words():
    words = sorted({"tap", "taps", "top", "tops", "stop", "stops", "", "a"})
    a = spelling.Acceptor(words)
    states = {}

    def language(s):
        if s not in states:
            states[s] = frozenset(([""] if a.final[s] else []) + [c + w for c, (t, _) in a.arcs[s].items() for w in language(t)])
        return states[s]

    assert language(a.root) == set(words) and len(set(states.values())) == len(states) == len(a.arcs)
    for i, w in enumerate(words):
        s, at = a.root, 0
        for c in w:
            s, before = a.arcs[s][c]
            at += before
        assert at == i
    pairs = [(words[x], words[y]) for x, y, _ in spelling.one_edit_pairs(words)]
    assert len(pairs) == len(set(pairs)) and {frozenset(p) for p in pairs} == {frozenset((u, v)) for u in words for v in words if near(u, v)}
