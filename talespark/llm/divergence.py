"""How far the sources of a language differ in their words, with equal texts collapsed.

Equal texts of a language are one group with its multiplicity in each source. Each text
is tokenised once; its terms count with these multiplicities, and in as many documents as the
group has. Two sources are compared term by term only where both hold the term; what a
source alone holds enters by a histogram of its counts, and what neither holds by one
product. All arithmetic is on whole numbers.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, pick, read

#: ASCII letters (lower-cased before) and everything beyond ASCII.
TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
MIN_DOCS, TOP_TERMS = 3, 200
#: Entries that a task holds before it emits them; sums do not depend on it.
HELD = 800_000
GROUP = ["lang", "source"]


def distinct_texts(docs: DataFrame) -> DataFrame:
    """(lang, text, sources, copies, docs): one row per language and text, with the sources
    that hold it and how often. Only here are texts shuffled, once and already collapsed."""
    rows = pick(docs, "lang", "source", "text").select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")))
    rows = rows.withColumn("digest", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))
    texts = rows.groupBy("lang", "digest").agg(F.first("text").alias("text"))
    copies = rows.groupBy("lang", "digest", "source").count().groupBy("lang", "digest")
    copies = copies.agg(F.collect_list(F.struct("source", "count")).alias("s"), F.sum("count").alias("docs"))
    return texts.join(copies, ["lang", "digest"]).select("lang", "text", F.col("s.source").alias("sources"), F.col("s.count").alias("copies"), "docs")


COUNTED = "lang string, term string, sources array<string>, n array<long>"


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A term's weighted count in each source, and for the source null its document
    frequency, over a task's texts."""
    counts, docs, held = defaultdict(dict), defaultdict(dict), 0

    def rows() -> pa.RecordBatch:
        out = {(lang, t): ([None], [n]) for lang, d in docs.items() for t, n in d.items()}
        docs.clear()
        for (lang, source), d in counts.items():
            for t, n in d.items():
                at = out[lang, t]
                at[0].append(source)
                at[1].append(n)
        counts.clear()
        lang, term, sources, n = (*zip(*out), *zip(*out.values()))
        kinds = (pa.string(), pa.string(), pa.list_(pa.string()), pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip((lang, term, sources, n), kinds)], names=["lang", "term", "sources", "n"])

    for b in batches:
        for lang, text, sources, copies, total in zip(*(b.column(i).to_pylist() for i in range(5))):
            terms = Counter(TERM.findall(text.encode().lower().decode()))  # bytes: only A to Z
            for into, once, k in ((docs[lang], True, total), *((counts[lang, s], False, k) for s, k in zip(sources, copies))):
                held -= len(into)
                for t, n in terms.items():
                    into[t] = into.get(t, 0) + (k if once else n * k)
                held += len(into)
            if held > HELD:
                yield rows()
                held = 0
    if held:
        yield rows()


def term_counts(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(lang, term, n, s): terms in at least ``min_docs`` documents of the language, with
    their count there and, in ``s``, (source, n) for each source that holds them."""
    parts = distinct_texts(docs).mapInArrow(_count, COUNTED).repartition("lang", "term")
    parts = parts.select("lang", "term", F.explode(F.arrays_zip("sources", "n")).alias("s")).select("lang", "term", F.col("s.sources").alias("source"), F.col("s.n").alias("n"))
    held = F.col("source").isNotNull()
    out = parts.groupBy("lang", "term", "source").agg(F.sum("n").alias("n")).groupBy("lang", "term")
    out = out.agg(F.sum(F.when(held, F.col("n"))).alias("n"), F.sum(F.when(~held, F.col("n"))).alias("docs"), F.collect_list(F.when(held, F.struct("source", "n"))).alias("s"))
    return out.filter(F.col("docs") >= min_docs).select("lang", "term", "n", "s")


def share(count: str, total: str) -> str:
    """SQL: 1 + floor(10**9 * (count + 1) / total) in steps of 1,000; totals below 9 * 10**15."""
    a = f"(({count} + 1) * 1000)"
    b = f"(({a} % {total}) * 1000)"
    c = f"(({b} % {total}) * 1000)"
    return f"(1 + (({a} div {total}) * 1000 + {b} div {total}) * 1000 + {c} div {total})"


def excess(p: str, q: str) -> str:
    """SQL: floor((p - q)**2 / q); q is positive."""
    return f"((({p} - {q}) * ({p} - {q})) div {q})"


def source_totals(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(lang, source, v, total, lang_total, p0): every group of ``docs``; v terms are kept in the
    language, ``total`` is the group's count plus v, ``p0`` the share of a term it lacks
    (null where v is 0)."""
    groups = pick(docs, *GROUP).select(*(F.coalesce(c, F.lit("")).alias(c) for c in GROUP)).distinct()
    n = terms.select("lang", F.explode("s").alias("s")).groupBy("lang", F.col("s.source").alias("source")).agg(F.sum("s.n").alias("n"))
    v = terms.groupBy("lang").agg(F.count("*").alias("v"), F.sum("n").alias("lang_n"))
    out = groups.join(n, GROUP, "left").join(v, "lang", "left").na.fill(0, ["n", "v", "lang_n"])
    out = out.select("lang", "source", "v", (F.col("n") + F.col("v")).alias("total"), (F.col("lang_n") + F.col("v")).alias("lang_total"))
    return out.withColumn("p0", F.when(F.col("v") > 0, F.expr(share("0", "total"))))


def pair_values(held: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value) of all ordered pairs of a language's sources.

    Of V terms, f(p0, q0) is taken V times and mended where a source holds the term.
    """
    a = groups.select("lang", "source", "v", F.col("p0").alias("p0"))
    b = groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"))
    pairs = a.join(b, "lang").filter("source <> item")
    base = pairs.select("lang", "source", "item", F.coalesce(F.expr(f"v * {excess('p0', 'q0')}"), F.lit(0)).cast("long").alias("value"))
    counts = held.groupBy("lang", "source", "p0", "p").agg(F.count("*").alias("m"))  # p follows from the count
    other = groups.select("lang", F.col("source").alias("other"), F.col("p0").alias("other0"))
    alone = materialize(counts.join(other, "lang").filter("source <> other").groupBy("lang", "source", "other").agg(
        F.expr(f"sum(m * ({excess('p', 'other0')} - {excess('p0', 'other0')}))").alias("as_p"),
        F.expr(f"sum(m * ({excess('other0', 'p')} - {excess('other0', 'p0')}))").alias("as_q"),
    ), "divergence-alone")
    first = alone.select("lang", "source", F.col("other").alias("item"), F.col("as_p").alias("value"))
    second = alone.select("lang", F.col("other").alias("source"), F.col("source").alias("item"), F.col("as_q").alias("value"))
    q = held.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("q"), F.col("p0").alias("q0"))
    both = held.drop("q").join(q, ["lang", "term"]).filter("source <> item")
    both = both.groupBy("lang", "source", "item").agg(F.expr(f"sum({excess('p', 'q')} - {excess('p', 'q0')} - {excess('p0', 'q')} + {excess('p0', 'q0')})").alias("value"))
    every = base.unionByName(first).unionByName(second).unionByName(both)
    return every.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def source_divergence(docs: DataFrame, min_docs: int = MIN_DOCS, top_terms: int = TOP_TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank): ``pair`` rows compare a source with each
    other of its language, all ranks; ``term`` rows are the terms that a source overuses
    against its language, the ``top_terms`` first.

    Null lang, source and text are empty ones; a document without terms still makes its
    group; repeated rows are documents of their own; other columns are ignored. Where a
    language keeps no term, its pairs have value 0. An empty table gives no rows.
    """
    terms = materialize(term_counts(docs, min_docs), "divergence-terms")
    groups = materialize(source_totals(docs, terms), "divergence-groups")
    held = terms.select("lang", "term", F.col("n").alias("lang_n"), F.explode("s").alias("s")).select("lang", "term", "lang_n", "s.source", "s.n")
    held = held.join(groups, GROUP).select("lang", "source", "term", "p0", F.expr(share("n", "total")).alias("p"), F.expr(share("lang_n", "lang_total")).alias("q"))
    held = materialize(held, "divergence-held")
    over = held.filter("p > q").select("lang", "source", F.col("term").alias("item"), F.expr(excess("p", "q")).alias("value"))
    order = Window.partitionBy(*GROUP).orderBy(F.desc("value"), "item")
    ranked = lambda rows, part: rows.select("lang", "source", F.lit(part).alias("part"), "item", F.col("value").cast("long").alias("value"), F.row_number().over(order).alias("rank"))
    return ranked(pair_values(held, groups), "pair").unionByName(ranked(over, "term").filter(F.col("rank") <= top_terms))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(read(spark, sf_dir, "documents"))


#: Every pair and every kept term, without collapsing or sparse sums.
OP13_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
tok AS (
  SELECT id, lang, source, term, count(*) AS n FROM (SELECT id, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d) GROUP BY ALL),
kept AS (SELECT lang, term, sum(n) AS lang_c FROM tok GROUP BY ALL HAVING count(*) >= 3),
g AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT lang, count(*) AS v, sum(lang_c) AS lang_n FROM kept GROUP BY lang),
c AS (SELECT lang, source, term, sum(n) AS c FROM tok JOIN kept USING (lang, term) GROUP BY ALL),
p AS (
  SELECT lang, source, term, coalesce(c, 0) AS c,
         1 + (1000000000::HUGEINT * (coalesce(c, 0) + 1)) // (sum(coalesce(c, 0)) OVER (PARTITION BY lang, source) + v) AS p,
         1 + (1000000000::HUGEINT * (lang_c + 1)) // (lang_n + v) AS q
  FROM g JOIN kept USING (lang) JOIN v USING (lang) LEFT JOIN c USING (lang, source, term)),
s AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b USING (lang, term) WHERE a.source <> b.source GROUP BY ALL),
r AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q) // q)::BIGINT FROM p WHERE c > 0 AND p > q)
SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM r QUALIFY part = 'pair' OR rank <= 200
"""
