"""Spelling variants by finite-state composition.

The words that a corpus holds often enough form an acceptor. Composed with a one-edit
transducer and with itself, it accepts the pairs of words that differ by one inserted,
deleted or replaced code point. Until the edit both copies of the acceptor stand in
the same state, and after it they read the same letters; so the composition falls apart by
the state that the copies reach together. Here such a part is all words of length L and
L + 1 that share what stands before and after a window of places; the edit lies in the
window. Each part's minimised acceptor is built and composed in one task, and
words are numbered by the counts of paths, so pairs come out as numbers.

Windows are the two halves of a word at first. Parts of more than ``max_part`` words are
split into two smaller windows, down to one place, where a part has at most one word for
each letter: no part grows with the corpus, and no pair is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, pick, read

#: A run of letters; between runs stands anything else.
NO_LETTERS = "[^A-Za-zÀ-ÿ]+"
MIN_LENGTH, MIN_COUNT = 5, 3
#: One run in so many has a letter dropped, by its document and spelling.
DROP_EVERY = 97
#: Parts with more words are split.
MAX_PART = 8192
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def letter_runs(docs: DataFrame, min_length: int = MIN_LENGTH) -> DataFrame:
    """(doc_id, run): the letter runs of whole texts, A to Z in lower case, of at least
    ``min_length`` letters. Null texts have none."""
    runs = pick(docs, "doc_id", "text").select("doc_id", F.explode(F.split("text", NO_LETTERS)).alias("run")).filter(F.length("run") >= min_length)
    lower = F.when(F.col("run").rlike("[À-Þ]"), F.translate("run", UPPER, LOWER)).otherwise(F.lower("run"))
    return runs.select("doc_id", lower.alias("run"))


def dropped_letter(doc_id: str, run: str, every: int = DROP_EVERY) -> Column:
    """The run, or for one in ``every`` the run without one letter; a null id is empty text."""
    h = F.crc32(F.concat(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.lit(":"), F.col(run)).cast("binary"))
    at = (h % F.length(run)).cast("int")
    return F.when(h % every == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))).otherwise(F.col(run))


def vocabulary(words: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n) of the column ``word``: words long and frequent enough."""
    return words.filter(F.length("word") >= min_length).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= min_count)


def _affix(word: str, length: str, lo: str, hi: str) -> str:
    """What stands before the window ``lo`` to ``hi`` (exclusive), and after it, of a word
    that is taken to have ``length`` letters; an inserted one is in the window."""
    rest = f"greatest({length} - {hi}, 0)"
    return f"concat(substring({word}, 1, {lo}), substring({word}, length({word}) - {rest} + 1, {rest}))"


def window_rows(words: DataFrame, min_length: int = MIN_LENGTH) -> DataFrame:
    """(length, lo, hi, affix, word, n): each word in both halves, as the shorter or equal
    one of a pair (its own length) and as the longer one (its length less one)."""
    both = "explode(filter(array(length(word), length(word) - 1), x -> x >= 1)) AS length"
    rows = words.selectExpr("word", "n", both).selectExpr("word", "n", "length", "explode(array(struct(0 AS lo, length div 2 AS hi), struct(length div 2 AS lo, length + 1 AS hi))) AS w")
    rows = rows.filter("w.lo < w.hi").selectExpr("length", "w.lo AS lo", "CAST(w.hi AS int) AS hi", "word", "n").selectExpr("length", "CAST(lo AS int) AS lo", "hi", "word", "n")
    return rows.selectExpr("length", "lo", "hi", f"{_affix('word', 'length', 'lo', 'hi')} AS affix", "word", "n")


PART = ["length", "lo", "hi", "affix"]


def parts(words: DataFrame, max_part: int = MAX_PART) -> DataFrame:
    """:func:`window_rows` in which windows of large parts are halved until none is left,
    or the window is one place. Parts of one word are left out."""
    rows, done = window_rows(words), None
    while True:
        sizes = materialize(rows.groupBy(*PART).agg(F.count("*").alias("size")).filter(F.col("size") > max_part).filter("hi - lo > 1").drop("size"), "spelling-large")
        if not sizes.limit(1).count():
            return rows if done is None else done.unionByName(rows)
        small = rows.join(sizes, PART, "left_anti").select(*rows.columns)
        done = small if done is None else done.unionByName(small)
        halves = "explode(array(struct(lo AS lo, (lo + hi) div 2 AS hi), struct((lo + hi) div 2 AS lo, CAST(hi AS bigint) AS hi))) AS w"
        large = rows.join(sizes, PART, "left_semi").selectExpr("length", halves, "word", "n").selectExpr("length", "CAST(w.lo AS int) AS lo", "CAST(w.hi AS int) AS hi", "word", "n")
        rows = materialize(large.selectExpr("length", "lo", "hi", f"{_affix('word', 'length', 'lo', 'hi')} AS affix", "word", "n"), "spelling-windows")


class Acceptor:
    """Minimised acceptor of sorted, distinct words. A state is a number; ``arcs[s]`` maps a
    letter to (next state, number of words of s that come before those with this letter)."""

    def __init__(self, words: list[str]) -> None:
        self.arcs: list[dict[str, tuple[int, int]]] = []
        self.final: list[bool] = []
        self.size: list[int] = []
        self._known: dict[tuple, int] = {}
        open_: list[list] = [[False, []]]  # states on the path of the last word: final, [(letter, next state)]
        last = ""
        for word in words:
            same = 0
            while same < min(len(last), len(word)) and last[same] == word[same]:
                same += 1
            self._close(open_, last, same)
            open_ += [[False, []] for _ in word[same:]]
            open_[-1][0] = True
            last = word
        self._close(open_, last, 0)
        self.root = self._state(open_[0])

    def _close(self, open_: list[list], last: str, depth: int) -> None:
        while len(open_) > depth + 1:
            state = self._state(open_.pop())
            open_[-1][1].append((last[len(open_) - 1], state))

    def _state(self, made: list) -> int:
        key = (made[0], tuple(made[1]))
        if key not in self._known:
            self._known[key] = len(self.arcs)
            arcs, before = {}, int(made[0])
            for letter, state in made[1]:
                arcs[letter] = (state, before)
                before += self.size[state]
            self.arcs.append(arcs)
            self.final.append(made[0])
            self.size.append(before)
        return self._known[key]


def one_edit_pairs(words: list[str], before: str = "", places: int | None = None) -> Iterator[tuple[int, int, bool]]:
    """The composition of the words' acceptor, one edit and the acceptor: pairs (x, y,
    inserted) of positions in ``words`` (sorted, distinct), each pair once.

    ``inserted``: word y has one more letter than x, at its leftmost place; ``before`` is the
    letter that stands before the words, and the place is among the first ``places``.
    Otherwise y > x and one letter is replaced.
    """
    a = Acceptor(words)
    arcs, final, size = a.arcs, a.final, a.size
    memo: dict[tuple[int, int], list[tuple[int, int]]] = {}

    def common(s: int, t: int) -> list[tuple[int, int]]:
        """Numbers, below s and below t, of what both accept."""
        todo = [(s, t)]
        while todo:
            p = todo[-1]
            if p in memo:
                todo.pop()
                continue
            s1, t1 = p
            if s1 == t1:
                memo[p] = [(k, k) for k in range(size[s1])]
                continue
            shared = [(arcs[s1][c], arcs[t1][c]) for c in arcs[s1] if c in arcs[t1]]
            missing = [q for (s2, _), (t2, _) in shared if (q := (s2, t2)) not in memo]
            if missing:
                todo += missing
                continue
            memo[p] = [(0, 0)] * (final[s1] and final[t1]) + [(i + k, j + m) for (s2, i), (t2, j) in shared for k, m in memo[s2, t2]]
        return memo[s, t]

    paths = [(a.root, 0, before, 0)]  # both copies have read the same letters
    while paths:
        q, base, last, depth = paths.pop()
        out = list(arcs[q].items())
        for k, (c, (s, i)) in enumerate(out):
            for _, (t, j) in out[k + 1 :]:
                for x, y in common(s, t):
                    yield base + i + x, base + j + y, False
            if c != last and (places is None or depth < places):
                for x, y in common(q, s):
                    yield base + x, base + i + y, True
            paths.append((s, base + i, c, depth + 1))


def near_in_part(length: int, lo: int, hi: int, words: list[str], counts: list[int]) -> Iterator[tuple[str, int, int, str]]:
    """(word, near words, largest count among them, the word that has it) in one part."""
    tail = max(length - hi, 0)
    middles = [w[lo : len(w) - tail] for w in words]
    near, best = [0] * len(words), [None] * len(words)
    order = sorted(range(len(words)), key=middles.__getitem__)
    for x, y, inserted in one_edit_pairs([middles[i] for i in order], words[0][lo - 1 : lo] if lo else "", hi - lo):
        x, y = order[x], order[y]
        if inserted or len(words[x]) == length:
            for u, v in ((x, y), (y, x)):
                near[u] += 1
                if best[u] is None or (-counts[v], words[v]) < best[u]:
                    best[u] = (-counts[v], words[v])
    for i, k in enumerate(near):
        if k:
            yield words[i], k, -best[i][0], best[i][1]


def _compose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sorted rows of parts to :func:`near_in_part`; a part may span batches."""
    key, words, counts = None, [], []
    for b in batches:
        out = []
        for *k, word, n in zip(*(b[c].tolist() for c in [*PART, "word", "n"])):
            if k != key:
                if len(words) > 1:
                    out += near_in_part(*key[:3], words, counts)
                key, words, counts = k, [], []
            words.append(word)
            counts.append(n)
        yield pd.DataFrame(out, columns=["word", "n_near", "best_n", "best"])
    if len(words) > 1:
        yield pd.DataFrame(list(near_in_part(*key[:3], words, counts)), columns=["word", "n_near", "best_n", "best"])


def near_words(words: DataFrame, max_part: int = MAX_PART) -> DataFrame:
    """(word, n, n_near, best_n, best): every word with the number of its near words, and
    that of largest count (ties: the first by code points); nulls where there is none."""
    rows = parts(words, max_part)
    rows = rows.repartition(*PART).sortWithinPartitions(*PART)
    found = rows.mapInPandas(_compose, "word string, n_near long, best_n long, best string")
    first = F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("word"))
    found = found.select("word", F.lit(None).cast("long").alias("n"), "n_near", first.alias("first"))
    every = words.select("word", "n", F.lit(0).cast("long").alias("n_near"), F.lit(None).cast(found.schema["first"].dataType).alias("first"))
    out = every.unionByName(found).groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), F.min("first").alias("first"))
    return out.select("word", "n", "n_near", (-F.col("first.n")).alias("best_n"), F.col("first.word").alias("best"))


def roots(links: DataFrame) -> DataFrame:
    """(word, root) of (word, form) by pointer jumping; forms must not form a ring. Rounds
    grow with the logarithm of the longest chain."""
    links = materialize(links.select("word", F.col("form").alias("root")), "spelling-links")
    while True:
        ahead = links.select(F.col("word").alias("at"), F.col("root").alias("next"))
        links = materialize(links.join(ahead, F.col("root") == F.col("at"), "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-links")
        if not links.filter("moved").limit(1).count():
            return links.select("word", "root")
        links = links.select("word", "root")


def spelling_groups(words: DataFrame, ratio: int = 2, max_part: int = MAX_PART) -> DataFrame:
    """(word, n, form, root, n_near, form_n) of (word, n), one row per word.

    A word's form is its most frequent near word, if that is at least ``ratio`` (2 or more)
    times as frequent; the root is the last of the chain of forms. Words are distinct and
    without nulls. An empty table gives no rows.
    """
    words = materialize(words.select("word", F.col("n").cast("long").alias("n")), "spelling-words")
    fits = F.col("best_n") >= ratio * F.col("n")
    near = materialize(near_words(words, max_part).select("word", "n", F.when(fits, F.col("best")).alias("form"), "n_near", F.when(fits, F.col("best_n")).alias("form_n")), "spelling-near")
    last = roots(near.filter("form IS NOT NULL").select("word", "form"))
    return near.join(last, "word", "left").select("word", "n", "form", F.coalesce("root", "word").alias("root"), "n_near", "form_n")


def document_words(docs: DataFrame) -> DataFrame:
    """(word, n): letter runs of whole texts, one in DROP_EVERY less a letter, counted."""
    return vocabulary(letter_runs(docs).select(dropped_letter("doc_id", "run").alias("word")))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null texts hold no words; a null id is empty text in the drawing of letters."""
    return spelling_groups(document_words(read(spark, sf_dir, "documents")))


#: CRC-32 by a table that is itself built by rule; near words by strings with one letter left out.
OP12_SQL = r"""
WITH RECURSIVE
tbl AS (SELECT list(v ORDER BY i) AS t FROM (
  SELECT i, list_reduce(list_prepend(i, range(8)), lambda a, k: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS v
  FROM (SELECT unnest(range(256)) AS i))),
runs AS (
  SELECT doc_id, run, count(*) AS n FROM (
    SELECT coalesce(doc_id::VARCHAR, '') AS doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]{5,}')) AS run FROM documents)
  GROUP BY ALL),
hx AS (SELECT *, hex(encode(doc_id || ':' || run)) AS x FROM runs),
hashed AS (
  SELECT run, n, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(x), 2), lambda i: ((instr('0123456789ABCDEF', substr(x, i, 1)) - 1) * 16 + instr('0123456789ABCDEF', substr(x, i + 1, 1)) - 1)::BIGINT)),
    lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295::BIGINT) AS h FROM hx, tbl),
w AS (
  SELECT word, sum(n)::BIGINT AS n FROM (
    SELECT n, CASE WHEN h % 97 = 0 THEN left(run, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word FROM hashed)
  WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
places AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w),
holes AS (SELECT word, n, left(word, i - 1) || '*' || substr(word, i + 1) AS k FROM places),
less AS (SELECT DISTINCT word, n, left(word, i - 1) || substr(word, i + 1) AS k FROM places),
near AS (
  SELECT a.word, b.word AS other, b.n AS m FROM holes a JOIN holes b USING (k) WHERE a.word <> b.word
  UNION ALL SELECT l.word, w.word, w.n FROM less l JOIN w ON w.word = l.k
  UNION ALL SELECT w.word, l.word, l.n FROM less l JOIN w ON w.word = l.k),
best AS (SELECT word, count(*) AS n_near, first(other ORDER BY m DESC, other) AS other, max(m) AS m FROM near GROUP BY word),
forms AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 2 * w.n THEN other END AS form, CASE WHEN m >= 2 * w.n THEN m END AS form_n FROM w LEFT JOIN best USING (word)),
chain AS (
  SELECT word, word AS top, form FROM forms
  UNION ALL SELECT c.word, f.word, f.form FROM chain c JOIN forms f ON f.word = c.form)
SELECT f.word, f.n, f.form, c.top AS root, f.n_near, f.form_n FROM forms f JOIN (SELECT word, top FROM chain WHERE form IS NULL) c USING (word)
"""
