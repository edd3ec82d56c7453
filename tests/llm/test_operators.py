"""Each operator against a brute-force version, a round trip or held-out accuracy."""

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pandas as pd
import pytest
import xxhash

from talespark.llm import contamination, langid, lm, packing, quality, queries, rules, sharding, simhash, url_filter, warc

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
A_Z = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def docs(data):
    return duckdb.sql(f"SELECT * FROM '{data}/documents.parquet'").df()


ODD = [
    (1, None, "en", "s", 0),
    (2, "", "en", "s", 0),
    (3, "  \n\t ", None, "s", 0),
    (None, "the word of the word and the other word of it all was in the end a very long word for them", "en", None, 0),
    (5, "x " * 30000, "en", "s", 0),
    (6, "Same text. Same text.", "fr", "s", 0),
    (6, "Same text. Same text.", "fr", "s", 0),
    (7, "Same text. Same text.", None, "s", 0),
    (-8, "12345 !!! ###", "de", "s", 0),
    (9, "a\u00e9\u4e2d\U0001f600 \u2028b  c\u00a0d", "de", "s", 0),
]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty, blank and long texts, repeated rows, and columns whose names clash."""
    got = spark.createDataFrame(ODD, "doc_id long, text string, lang string, source string, n_chars long")
    return got.withColumnsRenamed({"source": "Text", "n_chars": "shard"})


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string")


def crc(x):
    return zlib.crc32(("" if x is None else str(x)).encode())


# --- language ID ------------------------------------------------------------


def test_language_held_out(spark, data, docs):
    out = queries.QUERIES["op1_language_id"](spark, data).toPandas().merge(docs, on="doc_id")
    assert len(out) == len(docs) and (out["held_out"] == out["doc_id"].map(lambda i: crc(i) % 5 == 0)).all()
    held = out[out["held_out"] & out["lang"].notna()]
    assert (held["lang_pred"] == held["lang"]).mean() > 0.95 and out["score"].between(0, 1).all()


def plain_grams(text):
    """Buckets of the byte 1-, 2- and 3-grams of a text, byte by byte."""
    kept = "".join(c if ord(c) >= 128 or c.isalpha() or c == "'" else " " for c in text.lower())
    data, out = b" " + b" ".join(kept.encode().split()) + b" ", Counter()
    for i in range(len(data)):
        h = 0x811C9DC5
        for b in data[i : i + 3]:
            h = (h ^ b) * 0x01000193 % 2**32
            out[(h ^ h >> 15) * 0x2C1B3C6D % 2**32 >> 32 - langid.BITS] += 1
    return out


def test_language_brute_force(spark, data, docs):
    """The whole query again: counts, likelihood-ratio bits, trust, loss-weighted decoding."""
    grams, n_buckets = [plain_grams(t or "") for t in docs["text"]], 2**langid.BITS
    counts = defaultdict(Counter)
    for i, lang, t, g in zip(docs["doc_id"], docs["lang"], docs["text"], grams):
        if crc(i) % 5 and lang is not None and t is not None:
            counts[lang] += g
    names = sorted(counts)
    code = langid.codewords(len(names)).astype(int)
    total = {k: sum(counts[k].values()) + 0.5 * n_buckets for k in names}
    p = lambda k, b: (counts[k][b] + 0.5) / total[k]
    weight = {}
    for b in {b for g in grams for b in g}:
        side = lambda j, sign: [p(k, b) for k, c in zip(names, code) if c[j] == sign]
        weight[b] = [math.log(np.mean(side(j, 1)) / np.mean(side(j, -1))) for j in range(code.shape[1])]
    rare = [math.log(np.mean([0.5 / total[k] for k, c in zip(names, code) if c[j] == 1]) / np.mean([0.5 / total[k] for k, c in zip(names, code) if c[j] == -1])) for j in range(code.shape[1])]
    trust = []
    for k, c in zip(names, code):
        m = [max(c[j] * (sum(p(k, b) * w[j] for b, w in weight.items()) + (n_buckets - len(weight)) * 0.5 / total[k] * rare[j]), 1e-6) for j in range(code.shape[1])]
        trust.append(np.array(m) / sum(m))
    out = queries.QUERIES["op1_language_id"](spark, data).toPandas().set_index("doc_id").loc[docs["doc_id"]]
    for t, g, got in zip(docs["text"], grams, out.itertuples()):
        if not re.search(r"[^\W\d_]", t or ""):
            assert (got.lang_pred, got.score) == ("und", 0)
            continue
        n = sum(g.values())
        z = np.array([sum(c * weight[b][j] for b, c in g.items()) for j in range(code.shape[1])]) / n * min(n, 400) * 0.25
        loss = [(np.log1p(np.exp(-z * c)) * v).sum() for c, v in zip(code, trust)]
        prob = np.exp(min(loss) - np.array(loss))
        prob /= prob.sum()
        assert got.lang_pred == names[int(prob.argmax())] and math.isclose(got.score, prob.max(), rel_tol=1e-4)
        assert got.ambiguous == (np.sort(prob)[-1] - np.sort(prob)[-2] < langid.AMBIGUOUS)


def test_language_odd(spark, odd, none):
    model = langid.fit(langid.training_rows(odd))
    out = langid.identify(odd, model).toPandas()
    assert len(out) == len(ODD)
    assert set(out[out["doc_id"].isin([1, 2, 3, -8])]["lang_pred"]) == {"und"}
    empty = langid.fit(none.select("text", "lang"))
    assert langid.identify(odd, empty).toPandas()["lang_pred"].eq("und").all()
    assert langid.identify(none, model).count() == 0


def test_codewords_stay_apart():
    for k in (2, 3, 4, 6, 9, 40):
        code = langid.codewords(k).astype(int)
        assert len({tuple(r) for r in code}) == k and all(abs(c.sum()) < k for c in code.T)


# --- decontamination --------------------------------------------------------


def plain(text):
    return [w for w in re.split(r"[^\w]+|_", (text or "").lower()) if w]


def grams(words, n):
    return {" ".join(words[i : i + n]) for i in range(len(words) - n + 1)}


def contained(docs, items, t=0.8):
    out = {}
    for item_id, text in items:
        w = plain(text)
        n = min(5, len(w))
        if not n or item_id is None:
            continue
        want = grams(w, n)
        for doc_id, body in docs:
            hit = len(want & grams(plain(body), n))
            if doc_id is not None and hit / len(want) >= t:
                out[doc_id, item_id] = max(hit, out.get((doc_id, item_id), 0))
    return out


def test_contamination_brute_force(spark, data, docs):
    items = duckdb.sql(f"SELECT item_id, text FROM '{data}/benchmark.parquet'").fetchall()
    want = contained(docs[["doc_id", "text"]].values.tolist(), items)
    got = queries.QUERIES["op2_decontamination"](spark, data).collect()
    assert want and {(r["doc_id"], r["item_id"]): r["n_shared"] for r in got} == want


def test_contamination_edge(spark, odd, none):
    base = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen".split()
    items = [(1, " ".join(base)), (2, "Same text"), (3, None), (4, ""), (5, "zzz"), (None, "the word of")]
    rows = [(10, " ".join(base[:12])), (11, " ".join(base[:11])), (12, "x ZZZ! y"), (13, ("filler " * 3000) + " ".join(base).upper()), (14, None), (None, " ".join(base)), (11, "no")]
    want = contained(rows, items)
    assert want.keys() == {(10, 1), (13, 1), (12, 5)}
    table = spark.createDataFrame(items, "item_id long, text string")
    got = contamination.find_contaminated(spark.createDataFrame(rows, "doc_id long, text string"), table).collect()
    assert {(r["doc_id"], r["item_id"]): r["n_shared"] for r in got} == want
    assert {(r["doc_id"], r["item_id"]) for r in contamination.find_contaminated(odd, table).collect()} == {(6, 2), (7, 2)}
    assert contamination.find_contaminated(none, table).count() == 0
    assert contamination.find_contaminated(odd, table.limit(0)).count() == 0
    kept = contamination.decontaminate(odd, table)
    assert kept.columns == odd.columns and kept.count() == len(ODD) - 3


# --- sharding ---------------------------------------------------------------


def test_sharding_whole(spark, data, docs):
    out = queries.QUERIES["op3_sharding"](spark, data).toPandas().merge(docs, on="doc_id")
    assert len(out) == len(docs)
    assert (out["size"] == out["text"].map(lambda t: len((t or "").encode()) + 1)).all()
    assert (out["text_crc32"] == out["text"].map(lambda t: zlib.crc32((t or "").encode()))).all()
    sums = out.groupby("shard")["size"].sum()
    largest = out.groupby(out["text"].fillna(""))["size"].sum().max()
    assert list(sums.index) == list(range(8)) and (abs(sums - out["size"].sum() / 8) <= largest).all()
    assert (out.groupby("text")["shard"].nunique() == 1).all()
    for _, part in out.groupby("shard"):
        assert sorted(part["slot"]) == list(range(len(part)))


def test_sharding_odd(spark, odd, none):
    out = sharding.shard_documents(odd).toPandas()
    assert len(out) == len(ODD) and list(out.columns).count("shard") == 1 and "Text" in out
    assert out[out["text"] == "Same text. Same text."]["shard"].nunique() == 1
    for _, part in out.groupby("shard"):
        assert sorted(part["slot"]) == list(range(len(part)))
    assert sharding.shard_documents(none).count() == 0


def test_sharding_ids_of_any_step_and_type(spark):
    """One group of equal texts whose ids are 64 apart, or texts: its order is brute force's."""
    for kind, ids in (("long", [64 * i for i in range(500)] + [None] * 3), ("string", [f"n{i}" for i in range(500)] + [None, "", ""])):
        rows = [(i, "same" if k % 5 else f"other {k}") for k, i in enumerate(ids)]
        got = sharding.shard_documents(spark.createDataFrame(rows, f"doc_id {kind}, text string"), n_shards=3).toPandas()
        salt = lambda i: 0 if i is None else int(hashlib.md5(str(i).encode()).hexdigest()[:3], 16)
        order = sorted(rows, key=lambda r: (hashlib.md5(r[1].encode()).hexdigest(), salt(r[0]), r[0] is not None, r[0] if r[0] is not None else 0))
        got = got.sort_values(["shard", "slot"])
        assert [(None if pd.isna(i) else i, t) for i, t in zip(got["doc_id"], got["text"])] == order
        assert len({salt(i) for i, t in rows if t == "same"}) > 300


# --- quality ----------------------------------------------------------------


def test_quality_held_out(spark, data):
    big = data.replace("0.001", "0.01")
    labels = duckdb.sql(f"SELECT * FROM '{big}/labels.parquet'").df()
    out = queries.QUERIES["op4_quality"](spark, big).toPandas().merge(labels, on="doc_id")
    held = out[out["held_out"]]
    assert (held["predicted"] == held["quality"]).mean() > 0.95 and out["score"].between(0, 1).all()


def plain_statistics(text):
    """The 13 statistics of a text, from its characters."""
    t = text or ""
    data, words, lines = t.encode(), SPACE.findall(t), [x for x in t.split("\n") if SPACE.search(x)]
    size, letters = max(len(data), 1), sum(c.isascii() and c.isalpha() for c in t)
    of = lambda chars: math.log(sum(t.count(c) for c in chars) / size + 2e-3)
    share = [n / len(data) for n in Counter(data).values()]
    return [
        math.log1p(len(words)),
        math.log1p((size - sum(t.count(c) for c in " \n\t\r")) / max(len(words), 1)),
        math.log(sum("A" <= c <= "Z" for c in t) / max(letters, 1) + 2e-3),
        of("#*$%&|<>"),
        of("!?"),
        of("0123456789"),
        of(".,;:"),
        math.log(len(set(words)) / max(len(words), 1) + 2e-3),
        math.log(sum(a == b for a, b in zip(words, words[1:])) / max(len(words), 1) + 2e-3),
        math.log(1 - len(set(lines)) / max(len(lines), 1) + 2e-3) if lines else math.log(1 + 2e-3),
        math.log1p(len(words) / max(len(lines), 1)),
        -sum(p * math.log2(p) for p in share),
        math.log1p(max((len(w.encode()) for w in words), default=0)),
    ]


def test_quality_brute_force(spark, data):
    """The whole query again: statistics, class moments, shrinkage, Gaussian densities."""
    big = data.replace("0.001", "0.01")
    table = duckdb.sql(f"SELECT doc_id, text, quality FROM '{big}/documents.parquet' LEFT JOIN '{big}/labels.parquet' USING (doc_id)").df()
    x, y = np.array([plain_statistics(t) for t in table["text"]]), table["quality"].to_numpy(float)
    learn = np.array([crc(i) % 3 != 1 for i in table["doc_id"]])
    cov = [np.cov(x[learn & (y == c)].T, bias=True) for c in (0, 1)]
    n = [(learn & (y == c)).sum() for c in (0, 1)]
    pooled, logs = (n[0] * cov[0] + n[1] * cov[1]) / sum(n), []
    for c in (0, 1):
        s = (1 - quality.SHRINKAGE) * cov[c] + quality.SHRINKAGE * pooled + quality.RIDGE * np.eye(x.shape[1])
        z = x - x[learn & (y == c)].mean(0)
        logs.append(-0.5 * (np.einsum("ij,jk,ik->i", z, np.linalg.inv(s), z) + np.linalg.slogdet(s)[1]) + np.log(n[c]))
    out = queries.QUERIES["op4_quality"](spark, big).toPandas().set_index("doc_id").loc[table["doc_id"]]
    want = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -500, 500)))
    assert np.allclose(out["score"], want, atol=1e-6) and (out["held_out"].to_numpy() == ~learn).all()
    assert (out["predicted"].to_numpy() == (out["score"].to_numpy() >= 0.5)).all()


def test_quality_odd(spark, odd, none):
    labels = spark.createDataFrame([(1, 1), (2, 0), (6, None), (None, 1)], "doc_id long, quality int")
    for known in (labels, labels.limit(0)):
        out = quality.classify_quality(odd, known).toPandas()
        assert len(out) == len(ODD) and out["score"].between(0, 1).all()
        assert ((out["score"] >= 0.5) == out["predicted"]).all()
    assert quality.classify_quality(none, labels).count() == 0


def test_quality_scores_are_gaussian(spark):
    rng = np.random.default_rng(3)
    d = len(quality.NAMES)
    x = np.concatenate([rng.normal(0, 1, (80, d)), rng.normal(1, 2, (60, d))])
    y = np.array([0] * 80 + [1] * 60)
    table = spark.createDataFrame([(a.tolist(), int(b)) for a, b in zip(x, y)], "x array<double>, label int")
    m = quality.fit(table)
    cov = [np.cov(x[y == c].T, bias=True) for c in (0, 1)]
    pooled = (80 * cov[0] + 60 * cov[1]) / 140
    logs = []
    for c in (0, 1):
        s = 0.8 * cov[c] + 0.2 * pooled + 1e-3 * np.eye(d)
        z = x - x[y == c].mean(0)
        logs.append(-0.5 * (np.einsum("ij,jk,ik->i", z, np.linalg.inv(s), z) + np.linalg.slogdet(s)[1]) + np.log((y == c).mean()))
    got = quality.score(spark.createDataFrame([(i, a.tolist()) for i, a in enumerate(x)], "doc_id long, x array<double>"), m).toPandas().sort_values("doc_id")
    assert np.allclose(got["score"], 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -500, 500))), atol=1e-9)


# --- quality rules ----------------------------------------------------------


def base(text):
    words = SPACE.findall(text or "")
    lines = [x for x in (text or "").split("\n") if SPACE.search(x)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    often = Counter(windows)
    covered = {j for i, w in enumerate(windows) if often[w] > 1 for j in range(i, i + 8)}
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered), n < 20 or 100 * len(covered) > 30 * n


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def edge(mark, chars):
    """Spark's xxhash64 of two columns: the hash of the first seeds the second."""
    first = xxhash.xxh64_intdigest(mark.encode(), 42)
    return signed(xxhash.xxh64_intdigest(chars.encode(), first)) % rules.N_BUCKETS


def ratios(texts, trusted):
    raw, target = Counter(), Counter()
    buckets = [[b for w in SPACE.findall(t or "") for b in (edge("^", w[:3]), edge("$", w[-3:]))] for t in texts]
    for b, good in zip(buckets, trusted):
        raw.update(b)
        if good:
            target.update(b)
    r, t, s = sum(raw.values()), sum(target.values()), rules.N_BUCKETS
    weight = {b: math.log((target[b] + 1) / (t + s)) - math.log((raw[b] + 1) / (r + s)) if t else 0.0 for b in raw}
    return [sum(weight[x] for x in b) / len(b) if b else 0.0 for b in buckets]


def test_rules_brute_force(spark, data, docs):
    out = queries.QUERIES["op5_quality_rules"](spark, data).toPandas().set_index("doc_id").loc[docs["doc_id"]]
    want = docs["text"].map(base).tolist()
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    assert out[names].values.tolist() == [list(x) for x in want]
    good = set(duckdb.sql(f"SELECT doc_id FROM '{data}/labels.parquet' WHERE quality = 1").df()["doc_id"])
    llr = ratios(docs["text"], docs["doc_id"].isin(good))
    assert np.allclose(out["llr"], llr)
    assert (out["kept"].to_numpy() == ([not b[-1] and x >= rules.THRESHOLD for b, x in zip(want, llr)])).all()


def test_rules_odd(spark, odd, none):
    ids = spark.createDataFrame([(5,), (None,), (5,)], "doc_id long")
    texts = [r[1] for r in ODD]
    for known in (ids, ids.limit(0)):
        out = rules.quality_rules(odd, known).toPandas()
        key = lambda rows: sorted(rows, key=repr)
        got = key((None if pd.isna(i) else int(i), *map(int, x)) for i, *x in out[["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]].values.tolist())
        assert got == key((r[0], *map(int, base(r[1]))) for r in ODD)
    assert len(texts) == len(out)
    assert rules.quality_rules(none, ids).count() == 0


def test_rules_read_whole_words(spark):
    """Texts whose words have good edges but other characters inside, or one run without spaces
    that is good at both ends only, are not kept; the ratio is that of all trigrams."""
    rng = np.random.default_rng(5)
    words = ["".join(rng.choice(list("abcdefgh"), 12)) for _ in range(200)]
    good = ["a bc " + " ".join(rng.choice(words, 40)) for _ in range(30)]
    inside = [" ".join(w[:3] + "".join(rng.choice(list("QXZ\U00010400"), 6)) + w[-3:] for w in rng.choice(words, 40)) for _ in range(3)]
    texts = [*good, *inside, " ".join(words[:21]) + "Q" * 3000 + words[0], *(" ".join(words[:20]) + " " + "".join(rng.choice(list("abcdefgh"), n)) for n in (255, 256, 257, 510, 511, 512, 513))]
    ids = spark.createDataFrame([(i,) for i in range(25)], "doc_id long")
    out = rules.quality_rules(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), ids).orderBy("doc_id").toPandas()
    assert out["kept"].tolist() == [True] * 30 + [False] * 4 + [True] * 7 and (out["llr"] >= rules.THRESHOLD).all() and not out["base_failed"].any()
    grams = [[signed(xxhash.xxh64_intdigest(w[i : i + 3].encode(), 42)) % rules.N_BUCKETS for w in t.split() for i in range(max(1, len(w) - 2))] for t in texts]
    raw, target = Counter(g for t in grams for g in t), Counter(g for t in grams[:25] for g in t)
    weight = {g: math.log((target[g] + 1) / (target.total() + rules.N_BUCKETS) * (raw.total() + rules.N_BUCKETS) / (n + 1)) for g, n in raw.items()}
    assert np.allclose(out["whole_llr"], [sum(weight[g] for g in t) / len(t) for t in grams])


def test_repeat_shapes(spark):
    w = [f"w{i}" for i in range(100)]
    texts = [w[:8] * 2, w[:8] + w[50:60] + w[:8], w[:9] + w[3:12] + w[:9], w[:4] * 5, w[:7] * 2, ["a"] * 9, ["a"] * 8, w[:20] + w[2:11] + w[30:40] + w[5:18]]
    texts = [" ".join(t) for t in texts]
    out = rules.base_statistics(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").toPandas()
    assert out["n_repeat_words"].tolist() == [base(t)[4] for t in texts]


# --- WARC -------------------------------------------------------------------


def test_warc_round_trip(spark, data):
    pages = duckdb.sql(f"SELECT * FROM '{data}/pages.parquet'").df()
    out = queries.QUERIES["op6_warc"](spark, data).toPandas().set_index("page_id")
    assert len(out) == len(pages) and set(out.index) == set(pages["page_id"])
    top = pages.groupby(pages["html"].fillna(""))["page_id"].max()
    for page_id, html in zip(pages["page_id"], pages["html"].fillna("")):
        r = out.loc[page_id]
        assert r["payload_bytes"] == len(html.encode()) and r["payload_digest"] == base64.b32encode(hashlib.sha1(html.encode()).digest()).decode()
        assert (r["record_type"] == "response") == (top[html] == page_id)
        assert pd.isna(r["refers_to"]) if top[html] == page_id else r["refers_to"] == top[html]


def read_back(spark, path, split):
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        return warc.read_archives(spark, path).toPandas()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def check_archive(got, rows):
    """rows: (page_id, url, html); ids are unique."""
    text = {i: (h or "").encode() for i, _, h in rows}
    assert len(got) == len(rows) and got["complete"].all()
    assert sorted(got["id"]) == sorted(f"<urn:page:{i}>" for i in text)
    for r in got.itertuples():
        body = text[int(r.id[10:-1])]
        want = base64.b32encode(hashlib.sha1(body).digest()).decode()
        assert r.payload_bytes == len(body) and r.declared == "sha1:" + want
        assert r.payload_digest == (None if r.type == "revisit" else want)


def test_warc_crafted_lengths(spark, tmp_path):
    """Heads inside payloads whose lengths no long holds, or that are no ASCII number."""
    head = "WARC/1.1\r\nWARC-Type: {}\r\nContent-Length: {}\r\n\r\nHTTP/1.1 200 OK\r\nContent-Length: {}\r\n\r\nabc\r\n\r\n"
    odd = ["9" * 20, "\u00b2", "9223372036854775807", "-1", "", "1e3", "\u0663", "0" * 15, "9" * 15, "9" * 16, "12 x"]
    rows = [(i, "http://a/", "p" + head.format(kind, n, m) + "q") for i, (kind, n, m) in enumerate((k, n, m) for k in ("response", "revisit") for n in odd for m in ("3", "9" * 30))]
    path = str(tmp_path / "w")
    warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(2), path)
    for split in ("1500", "134217728"):
        check_archive(read_back(spark, path, split), rows)


def test_warc_fuzz(spark, tmp_path):
    """Random heads, whole or broken, with random lengths, inside payloads."""
    rng = np.random.default_rng(9)
    bits = ["WARC/1.1\r\n", "WARC-Type: revisit\r\n", "Content-Length: ", "\r\n\r\n", "\r\n", "\r", "\n", "WARC/1.1", "abc", "HTTP/1.1 200 OK\r\n", "\u00e9\U0001f600", " ", "<urn:page:7>", "WARC-Record-ID: "]
    pick = lambda: str(10 ** int(rng.integers(0, 22)) // int(rng.integers(1, 9))) if rng.random() < 0.3 else str(rng.choice(bits))
    rows = [(i, "http://a/" + pick() + "b", "".join(pick() for _ in range(int(rng.integers(0, 60))))) for i in range(300)]
    path = str(tmp_path / "w")
    warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(3), path)
    for split in ("4000", "134217728"):
        check_archive(read_back(spark, path, split), rows)


def test_warc_large_group(spark, tmp_path):
    """A third of all pages and all empty ones are copies."""
    rows = [(i, None, "same" if i % 3 == 0 else "" if i % 3 == 1 and i % 2 else f"page {i}") for i in range(900)]
    path = str(tmp_path / "w")
    warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string"), path)
    got = warc.read_archives(spark, path).toPandas()
    check_archive(got, rows)
    last = {h: i for i, _, h in rows}
    assert {r.id: r.refers for r in got.itertuples()} == {f"<urn:page:{i}>": None if last[h] == i else f"<urn:page:{last[h]}>" for i, _, h in rows}


def test_warc_magic_inside(spark, tmp_path):
    fake = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:999>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    html = ["plain", fake, "a" + fake + fake + "b", None, "", "WARC/1.1\r\n", fake, "\u00e9" * 5000 + "WARC/1.1\r\nx", "x" * 70000]
    rows = [(i, f"http://a/{i}\r\nContent-Length: 1" if i % 2 else None, h) for i, h in enumerate(html)] + [(None, "u", "no id"), (0, None, "plain")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumnRenamed("url", "url")
    path = str(tmp_path / "w")
    warc.write_archives(pages.coalesce(2), path)
    for split in ("400", "3000", "134217728"):
        got = read_back(spark, path, split)
        assert len(got) == len(rows) and got["complete"].all() and not got["id"].str.contains("999").any()
        text = {i: (h or "").encode() for i, _, h in rows}
        for r in got.itertuples():
            m = re.match(r"<urn:page:(\d*)>", r.id)
            body = text[int(m[1]) if m[1] else None]
            assert r.payload_bytes == len(body)
            assert r.type == "revisit" or r.payload_digest == base64.b32encode(hashlib.sha1(body).digest()).decode()


def test_warc_cut_and_empty(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "first"), (2, "u", "second payload")], "page_id long, url string, html string")
    path = tmp_path / "w"
    warc.write_archives(pages.coalesce(1), str(path))
    (file,) = path.glob("part-*")
    cut = tmp_path / "cut"
    cut.mkdir()
    (cut / "a.warc").write_bytes(file.read_bytes()[:-10])
    got = warc.read_archives(spark, str(cut)).toPandas()
    assert sorted(got["complete"]) == [False, True]
    warc.write_archives(pages.limit(0), str(tmp_path / "none"))
    assert warc.read_archives(spark, str(tmp_path / "none")).count() == 0


# --- URL filter -------------------------------------------------------------


def judge(url):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :], re.S)[0]
        host = host.translate(A_Z)
    fits = [(h + p, v) for h, p, v in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *(max(fits, key=lambda f: len(f[0])) if fits else (None, None))


def test_url_rules(spark, data):
    urls = [None, "", "nothing", "http://", "HTTP://A.COM/x?y", "https://www.example.com/en/a", "http://x.www.example.com/en/", "http://example.com/en/1#t", "http://example.com/en", "http://a.net/es/", "http://a.net?x/es/", "net://b://c.net/fr/x", "http://notcom/", "http://É.COM/\n/a"]
    rows = [(i, u) for i, u in enumerate(urls)] + [(None, "http://casino-win.example.org/de/1"), (1, "")]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    got = url_filter.filter_urls(pages).toPandas()
    assert len(got) == len(rows)
    for r in got.itertuples():
        host, path, rule, verdict = judge(r.url)
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == (verdict or ("block" if r.p_block >= url_filter.THRESHOLD else "allow"))
    assert url_filter.filter_urls(pages.limit(0)).count() == 0


def test_url_query_is_whole(spark, data):
    """Rules and model of every page of the table, the model's scores from its weights."""
    pages = duckdb.sql(f"SELECT page_id, url FROM '{data}/pages.parquet'").df().set_index("page_id")["url"]
    w = url_filter.fit([(*judge(u)[:2], label) for u, label in url_filter.default_labels()])
    out = queries.QUERIES["op7_url_filter"](spark, data).toPandas()
    assert sorted(out["page_id"]) == sorted(pages.index)
    for r in out.itertuples():
        host, path, rule, verdict = judge(pages[r.page_id])
        at = {(side, g) for side, t in ((1, f"^{host}$"), (2, f"^{path}$")) for n in url_filter.ORDERS for g in zip(*(t.encode()[i:] for i in range(n)))}
        buckets = set()
        for side, g in at:
            h = (0x811C9DC5 + side * 0x85EBCA6B) % 2**32
            for b in g:
                h = (h ^ b) * 0x01000193 % 2**32
            buckets.add((h ^ h >> 15) * 0x2C1B3C6D % 2**32 >> 32 - url_filter.BITS)
        p = 1 / (1 + math.exp(-(sum(float(w[b]) for b in buckets) / math.sqrt(max(len(buckets), 1)) + float(w[-1]))))
        assert (r.host, r.path, r.rule) == (host, path, rule) and math.isclose(r.p_block, p, rel_tol=1e-3)
        assert r.verdict == (verdict or ("block" if r.p_block >= url_filter.THRESHOLD else "allow"))


def test_url_names_of_the_table_joined_anew(spark):
    """Hosts joined from two words of a kind that the table never joins."""
    known = {u.split("://")[1].split("/")[0] for u, _ in url_filter.default_labels()}
    rows, want = [], []
    for label, words in ((1, url_filter.BLOCK_WORDS), (0, url_filter.ALLOW_WORDS)):
        for step in (2, 9):
            for i, a in enumerate(words):
                rows.append((len(rows), f"http://{a}-{words[(i + step) % len(words)]}.test/p/{i}"))
                want.append("block" if label else "allow")
    assert not known & {u.split("://")[1].split("/")[0] for _, u in rows}
    got = url_filter.filter_urls(spark.createDataFrame(rows, "page_id long, url string"), []).toPandas().set_index("page_id")["verdict"]
    right = np.array([got[i] == v for i, v in enumerate(want)])
    assert right[np.array(want) == "block"].mean() > 0.97 and right[np.array(want) == "allow"].mean() > 0.99


def test_url_words_left_out_of_the_table():
    """Five folds over words: half of the unwanted words that the model never saw are
    blocked, and about one in twenty of the ordinary ones."""
    words = [(w, 1) for w in url_filter.BLOCK_WORDS] + [(w, 0) for w in url_filter.ALLOW_WORDS]
    assert len({w for w, _ in words}) == len(words) and len(url_filter.default_labels()) <= url_filter.MAX_LABELLED
    blocked = {0: [], 1: []}
    for fold in range(5):
        out = frozenset(w for w, _ in words if zlib.crc32(w.encode()) % 5 == fold)
        w = url_filter.fit([(*judge(u)[:2], label) for u, label in url_filter.default_labels(out)])
        for word, label in words:
            if word in out:
                at = url_filter.features(f"{word}.com", "/en/5")
                blocked[label].append(1 / (1 + math.exp(-(w[at].sum() / math.sqrt(len(at)) + w[-1]))) >= url_filter.THRESHOLD)
    print("blocked of left-out words:", np.mean(blocked[1]), np.mean(blocked[0]))
    assert np.mean(blocked[1]) > 0.45 and np.mean(blocked[0]) < 0.07


def test_url_model_leaves_ordinary_pages_alone(spark, data):
    """Hosts of made-up syllables, as most given pages have them, are not blocked by the model."""
    syllables = ["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "at", "en", "es", "of", "or", "nt", "ea", "ti", "to", "it", "st", "io", "le", "is", "ou", "ar", "as", "de", "rt", "ve"]
    hosts = sorted({f"{a}{b}{c}" for i, a in enumerate(syllables) for j, b in enumerate(syllables) for c in (syllables[(i + j) % 30],)})
    rows = [(i, f"http://{h}.example.net/de/{i}") for i, h in enumerate(hosts)]
    verdict = url_filter.filter_urls(spark.createDataFrame(rows, "page_id long, url string"), []).toPandas()["verdict"]
    print("syllables blocked:", (verdict == "block").mean())
    assert (verdict == "block").mean() < 0.05


def test_url_learns_any_table(spark):
    labels = [(f"http://shop{i}.org/buy/{i}", 1) for i in range(30)] + [(f"http://school{i}.org/read/{i}", 0) for i in range(30)]
    pages = spark.createDataFrame([(1, "http://shop99.org/buy/7"), (2, "http://school99.org/read/7")], "page_id long, url string")
    got = {r["page_id"]: r["verdict"] for r in url_filter.filter_urls(pages, [], labels).collect()}
    assert got == {1: "block", 2: "allow"}
    assert url_filter.filter_urls(pages, [], []).count() == 2
    with pytest.raises(ValueError):
        url_filter.filter_urls(pages, [], [("http://a.b/c", 1)] * (url_filter.MAX_LABELLED + 1))


# --- packing ----------------------------------------------------------------


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    got = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got.encode_special_tokens = True
    return got


def test_ids_equal_tokenizer(tokenizer, docs):
    """The ids of the rank file are those of the JSON file: given texts, random Unicode with
    every kind of white space, and long runs without a word boundary."""
    encode, rng = packing.encoder(packing.default_vocabulary()), random.Random(4)
    texts = [*docs["text"].fillna("").tolist()[:60], *(r[1] or "" for r in ODD)]
    space = [chr(c) for c in (9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 32, 32, 0x85, 0xA0, 0x1680, 0x2000, 0x2003, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]
    pool = [*space, *"ab1'sdtlmrve.,#", *"\u00e9\u4e2d\u0301\u0915\u00bd\u2167\u00b2\u01c5\u02b0\u203f\u0663\ufeff\u200b", "\U0001f600", "\U00010348", "<|endoftext|>"]
    other = lambda: chr(rng.choice([rng.randint(1, 0xD7FF), rng.randint(0xE000, 0x10FFFF)]))
    texts += ["".join(rng.choice(pool) if rng.random() < 0.8 else other() for _ in range(rng.randint(0, 40))) for _ in range(10_000)]
    texts += ["x" * 50_000, "7" * 50_000, "#" * 50_000, " " * 50_000, "\n" * 50_000 + "a", " \n\t" * 20_000 + "b", "".join(rng.choice("abcdefghij") for _ in range(50_000)), "".join(chr(rng.randint(0x4E00, 0x9FFF)) for _ in range(20_000))]
    for text in texts:
        assert encode(text) == tokenizer.encode(text, add_special_tokens=False).ids


def check_packing(out, want):
    """want: list of (doc_id, ids)."""
    assert (out["length"] > 0).all() and (out.groupby("sequence_id")["length"].sum() <= 1024).all()
    for _, s in out.sort_values("offset").groupby("sequence_id"):
        assert s["offset"].tolist() == [0, *np.cumsum(s["length"])[:-1]]
    left = Counter((i, tuple(ids)) for i, ids in want)
    for doc_id, part in out.groupby(out["doc_id"].astype("Int64").fillna(-99)):
        starts = part.sort_values("start")
        copies = sum(n for (i, _), n in left.items() if (-99 if i is None else i) == doc_id)
        assert starts["length"].sum() == sum(len(ids) * n for (i, ids), n in left.items() if (-99 if i is None else i) == doc_id)
        if copies == 1:
            ids = next(ids for (i, ids) in left if (-99 if i is None else i) == doc_id)
            assert starts["start"].tolist() == [0, *np.cumsum(starts["length"])[:-1]] and (starts["doc_tokens"] == len(ids)).all()
            for r in starts.itertuples():
                assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())


def test_packing_whole(spark, data, docs, tokenizer):
    out = queries.QUERIES["op8_packing"](spark, data).toPandas()
    check_packing(out, [(i, tokenizer.encode(t or "", add_special_tokens=False).ids + [0]) for i, t in zip(docs["doc_id"], docs["text"])])
    assert out["sequence_id"].nunique() * 1024 - out["length"].sum() < 1024 * 8


def test_packing_odd(spark, odd, none, tokenizer):
    out = packing.with_digest(packing.pack_documents(odd, group_tokens=5000)).toPandas()
    check_packing(out, [(r[0], tokenizer.encode(r[1] or "", add_special_tokens=False).ids + [0]) for r in ODD])
    assert packing.pack_documents(none).count() == 0


def plain_place(lengths, capacity):
    """The rule of ``place`` one sequence at a time."""
    total = sum(n % capacity for n in lengths)
    first = sum(n // capacity for n in lengths)
    used, cost, out = [0] * -(-total // capacity), [0.0] * -(-total // capacity), []
    for n, i in sorted(((n % capacity, i) for i, n in enumerate(lengths)), key=lambda x: (-x[0], x[1])):
        while n:
            room = [s for s in range(len(used)) if capacity - used[s] >= n] or [s for s in range(len(used)) if used[s] < capacity]
            s = min(room, key=lambda s: (cost[s], s))
            take = min(n, capacity - used[s])
            out.append((i, take, first + s, used[s]))
            used[s], cost[s], n = used[s] + take, cost[s] + take * packing.LINEAR + take * take * packing.QUADRATIC, n - take
    return out


@pytest.mark.parametrize("top", [40, 700, 3000])
def test_place_takes_the_cheapest_with_room(top):
    rng = np.random.default_rng(top)
    lengths = rng.integers(1, top, 600).tolist() + [1024, 1, 1]
    got = list(packing.place(lengths, 1024))
    whole = sum(n // 1024 for n in lengths)
    assert [(p[0], p[2], p[3], p[4]) for p in got if p[3] >= whole] == plain_place(lengths, 1024)
    assert len({p[3] for p in got}) == -(-sum(n % 1024 for n in lengths) // 1024) + whole
    for item, n in enumerate(lengths):
        mine = [p for p in got if p[0] == item]
        assert [p[1] for p in mine] == [0, *np.cumsum([p[2] for p in mine])[:-1]] and sum(p[2] for p in mine) == n


# --- language model ---------------------------------------------------------


def katz(texts, train):
    """Plain dictionaries: (n_tokens, n_known, N, base, score) of each text, and a function
    p(w, history) for histories of up to two words."""
    split = lambda t: [*SPACE.findall((t or "").translate(A_Z)), ""]
    grams, ctx, docs = [Counter(), Counter(), Counter()], Counter(), 0
    history = lambda w, i: tuple([" ", *w][max(0, i - 1) : i + 1])
    for t, learn in zip(texts, train):
        if learn:
            w = split(t)
            for i, x in enumerate(w):
                h = history(w, i)
                for k in range(len(h) + 1):
                    grams[k][(*h[len(h) - k :], x)] += 1
                    ctx[h[len(h) - k :]] += 1
    ratio = [lm.ratios([sum(1 for x in c.values() if x == r) for r in range(1, lm.K + 2)]) for c in grams]
    n, types = sum(grams[0].values()), len(grams[0])
    seen_p = lambda g: grams[len(g) - 1][g] * ratio[len(g) - 1][min(grams[len(g) - 1][g], lm.K + 1)] / ctx[g[:-1]]
    unknown = 1 - sum(seen_p(g) for g in grams[0]) if n else 1.0
    after = defaultdict(list)
    for c in grams[1:]:
        for g in c:
            after[g[:-1]].append(g)
    alpha = {}

    def p(w, h):
        g = (*h, w)
        if g in grams[len(h)]:
            return seen_p(g)
        if not h:
            return unknown
        if h not in ctx:
            return p(w, h[1:])
        if h not in alpha:
            alpha[h] = (1 - sum(map(seen_p, after[h]))) / (1 - sum(p(x[-1], h[1:]) for x in after[h]))
        return alpha[h] * p(w, h[1:])

    out = []
    for t in texts:
        w = split(t)
        known = [grams[0][(x,)] for x in w]
        out.append((len(w), sum(x > 0 for x in known), n, sum(math.log10((x + 1) / (n + types + 1)) for x in known), sum(math.log10(p(x, history(w, i))) for i, x in enumerate(w))))
    return out, p, [g[0] for g in grams[0]], ctx


def test_lm_brute_force(spark, data, docs):
    out = queries.QUERIES["op9_lm_score"](spark, data).toPandas().set_index("doc_id").loc[docs["doc_id"]]
    want, p, uni, ctx = katz(docs["text"], [crc(i) % 7 != 2 for i in docs["doc_id"]])
    assert (out["held_out"].to_numpy() == [crc(i) % 7 == 2 for i in docs["doc_id"]]).all()
    assert out[["n_tokens", "n_known", "train_tokens"]].values.tolist() == [list(x[:3]) for x in want]
    assert np.allclose(out["base_score"], [x[3] for x in want]) and np.allclose(out["score"], [x[4] for x in want])
    for n in (0, 1, 2):  # exactly normalised over the vocabulary and the unknown word
        for h in [h for h in ctx if len(h) == n][:5]:
            assert math.isclose(sum(p(w, h) for w in uni) + p("\0unknown", h), 1, rel_tol=1e-9)


def test_katz_discounts():
    """Rescaled Good-Turing: r = 1 and 2 by hand for counts of counts 100, 40, 20, 12, 8, 5."""
    d, share = lm.ratios([100, 40, 20, 12, 8, 5]), 6 * 5 / 100
    assert math.isclose(d[1], (2 * 40 / 100 - share) / (1 - share)) and math.isclose(d[2], (3 * 20 / (2 * 40) - share) / (1 - share))
    assert ((d[1:] > 0) & (d[1:] < 1)).all()
    assert lm.ratios([0] * 6)[1:-1].tolist() == [r / (r + 1) for r in range(1, lm.K + 1)]


def test_lm_blocks_and_odd(spark, odd, none, docs):
    from pyspark.sql import functions as F

    rows = [(None if pd.isna(r[0]) else r[0], r[1], i % 3 != 0) for i, r in enumerate([*ODD, *docs[["doc_id", "text"]].values.tolist()[:60]])]
    table = spark.createDataFrame(rows, "doc_id long, text string, train boolean").repartition(3)
    got = lm.score_documents(table, block_tokens=2000).toPandas()
    want, *_ = katz([r[1] for r in rows], [r[2] for r in rows])
    key = lambda a: sorted((round(float(x), 4) for x in a))
    assert len(got) == len(rows) and np.allclose(key(got["score"]), key(x[4] for x in want), atol=1e-3)
    assert np.allclose(key(got["base_score"]), key(x[3] for x in want), atol=1e-3)
    nothing = lm.score_documents(odd.withColumn("train", F.lit(None).cast("boolean"))).toPandas()
    assert len(nothing) == len(ODD) and (nothing["score"] == 0).all() and (nothing["n_known"] == 0).all()
    assert lm.score_documents(none.withColumn("train", F.lit(True))).count() == 0


# --- SimHash ----------------------------------------------------------------


def simple_fingerprint(text):
    w = SPACE.findall((text or "").translate(A_Z))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def copy_runs(text):
    w = SPACE.findall((text or "").translate(A_Z))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def is_copy(a, b):
    """Exact Jaccard similarity of 0.8 or more; sets without shingles are alike."""
    return 10 * len(a & b) >= 8 * len(a | b)


def brute_components(fps, radius=3, near=None):
    near = near or (lambda x, y: bin(x ^ y).count("1") <= radius)
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if near(fps[i], fps[j]):
                root[find(i)] = find(j)
    return [find(i) for i in range(len(fps))]


def check_simhash(out, rows):
    fps = {i: simple_fingerprint(t) for i, t in rows}
    ids = list(fps)
    roots = brute_components([fps[i] for i in ids])
    low = {}
    for i, r in zip(ids, roots):
        low[r] = min(i, low.get(r, i))
    want = {i: (f"{fps[i]:016x}", low[r]) for i, r in zip(ids, roots)}
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in out.itertuples()} == want


def test_simhash_brute_force(spark, data, docs):
    check_simhash(queries.QUERIES["op10_simhash"](spark, data).toPandas(), docs[["doc_id", "text"]].values.tolist())


def test_simhash_odd(spark, odd, none):
    got = simhash.near_duplicates(odd.filter("doc_id IS NOT NULL")).toPandas()
    assert len(got) == len(ODD) - 1
    check_simhash(got, [(r[0], r[1]) for r in ODD if r[0] is not None])
    whole = simhash.near_duplicates(odd).toPandas()
    assert len(whole) == len(ODD) and whole["component_id"].isna().sum() == 1
    assert simhash.near_duplicates(none).count() == 0


@pytest.mark.parametrize("radius", [3, 7])
def test_trees_lose_no_pair(spark, radius):
    """Planted clusters, chains and a crowd around one centre; small leaves force many
    shards, and tiles."""
    rng = np.random.default_rng(11)
    base = rng.integers(0, 2**63, 700, dtype=np.int64)
    flip = lambda x, k: x ^ int(sum(1 << int(b) for b in rng.choice(63, k, replace=False)))
    fps = [int(x) for x in base]
    fps += [flip(int(x), int(rng.integers(1, 6))) for x in base[:300]]
    fps += [flip(int(base[0]), int(rng.integers(1, 4))) for _ in range(400)]
    chain = [int(base[1])]
    for _ in range(30):
        chain.append(flip(chain[-1], 3))
    fps = sorted(set(fps + chain))
    links = simhash.near_links(spark.createDataFrame([(f,) for f in fps], "fp long"), radius, leaf_rows=20)
    roots = {r["node"]: r["root"] for r in simhash.components(links).collect()}
    got = [roots.get(f, f) for f in fps]
    want = brute_components(fps, radius)
    pairs = {}
    for g, w in zip(got, want):
        assert pairs.setdefault(g, w) == w
    assert len(set(got)) == len(set(want))


def check_copies(spark, rows):
    """Components are those of exact five-word Jaccard, by brute force."""
    got = sorted((r["doc_id"], r["component_id"]) for r in simhash.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    roots, low = brute_components([copy_runs(t) for _, t in rows], near=is_copy), {}
    for r, (i, _) in zip(roots, rows):
        low[r] = min(i, low.get(r, i))
    assert got == sorted((i, low[r]) for r, (i, _) in zip(roots, rows))
    return len(low)


def test_near_copies_of_changed_words(spark):
    rng = np.random.default_rng(5)
    vocabulary = [f"w{i}" for i in range(3000)]
    weight = 1 / np.arange(1, 3001)
    draw = lambda n: list(rng.choice(vocabulary, n, p=weight / weight.sum()))
    rows = []
    for g in range(120):
        words = draw(int(rng.integers(120, 900)))
        copy = list(words)
        for at in rng.choice(len(words), max(1, len(words) * int(rng.choice([1, 2, 15])) // 100), replace=False):
            copy[at] = draw(1)[0]
        rows += [(2 * g, " ".join(words)), (2 * g + 1, " ".join(copy))]
    assert 130 < check_copies(spark, rows) < 200


def test_near_copies_odd(spark):
    """A crowd of near copies of one text, cut into blocks; null ids, repeated rows, one id
    with several texts, short and empty texts."""
    words = [f"u{i}" for i in range(400)]
    edit = lambda i: " ".join(f"e{i}" if k == i % 390 else w for k, w in enumerate(words))
    rows = [(i, edit(i)) for i in range(300)] + [(1000 + i, "a b") for i in range(4)] + [(1010, None), (1011, ""), (1012, " \n"), (1013, "A B"), (1014, "a b c")]
    assert check_copies(spark, rows) == 4
    rows += [(5, "other words than the first text of this id has"), (2000, "other words than the first text of this id has"), (7, edit(7)), (7, edit(7))]
    rows += [(None, edit(3)), (None, "only texts without an id have these words"), (None, "only texts without an id have these words")]
    got = Counter((r["doc_id"], r["component_id"]) for r in simhash.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got[2000, 5] == 1 and got[5, 5] == 1 and got[5, 0] == 1 and got[7, 0] == 3 and got[None, 0] == 1 and got[None, None] == 2
    assert sum(got.values()) == len(rows)


def test_components_of_long_paths(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 200), (200, 150), (5, 5)]
    got = {r["node"]: r["root"] for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, 200: 100, 150: 100}


def test_near_copies_of_edited_passages(spark):
    """Passages appended, cut off or replaced."""
    rng = np.random.default_rng(77)
    vocabulary = [f"v{i}" for i in range(4000)]
    weight = 1 / np.arange(1, 4001)
    draw = lambda n: list(rng.choice(vocabulary, n, p=weight / weight.sum()))
    rows = []
    for g in range(150):
        words = draw(int(rng.integers(30, 600)))
        n, at = int(len(words) * rng.uniform(0.05, 0.24)), int(rng.integers(0, len(words) // 2))
        copy = [words + draw(n), words[:-n], words[:at] + draw(n // 2) + words[at + n // 2 :]][g % 3]
        rows += [(2 * g, " ".join(words)), (2 * g + 1, " ".join(copy))]
    assert 160 < check_copies(spark, rows) < 240
