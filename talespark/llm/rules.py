"""Quality rules in DataFrame functions only: base statistics of every whole text,
and hashed n-gram log-likelihood ratios between a trusted target and the raw corpus.

There are two kinds of n-grams, each hashed into ``N_BUCKETS``: the character trigrams at
both edges of every word, and all character trigrams of every word, a shorter word being
one. Both multinomials of a kind are smoothed; a document's ratio is the mean over its
n-grams of the kind, and fixed thresholds decide: a text is kept if both reach theirs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_words, materialize, pick, read

N_BUCKETS = 1 << 14
#: Trusted-target documents: at most so many labelled rows, those of smallest id hash.
MAX_TARGET = 20_000
#: A document is kept if the mean log ratio of its word edges reaches this,
THRESHOLD = -1.0
#: and that of all its trigrams this.
WHOLE_THRESHOLD = -0.5
SMOOTHING = 1.0
WINDOW = 8
#: Trigrams are taken from pieces of at most so many characters, so that long words cost no more a character.
PIECE = 256


def edge_grams(word: str | Column) -> list[Column]:
    """Buckets of the first and the last three characters of a word."""
    return [F.pmod(F.xxhash64(F.lit("^"), F.substring(word, 1, 3)), F.lit(N_BUCKETS)).cast("int"), F.pmod(F.xxhash64(F.lit("$"), F.substring(word, -3, 3)), F.lit(N_BUCKETS)).cast("int")]


def pieces(word: Column) -> Column:
    """A word as pieces that have each of its trigrams once: a long one's overlap by two characters."""
    cut = F.regexp_extract_all(word, F.lit(f"(?s)(?=(.{{3,{PIECE}}})).{{1,{PIECE - 2}}}"), F.lit(1))
    return F.when(F.length(word) > PIECE, cut).otherwise(F.array(word))


def n_whole(word: Column) -> Column:
    return F.greatest(F.length(word) - 2, F.lit(1))


def whole_gram(piece: Column, i: Column) -> Column:
    """Bucket of a piece's i-th trigram (from 1), behind the buckets of edges."""
    return F.pmod(F.xxhash64(F.substring(piece, i, F.lit(3))), F.lit(N_BUCKETS)).cast("int") + N_BUCKETS


def let(value: str, name: str, body: str) -> str:
    """SQL in which ``name`` stands for ``value``, computed once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def repeated_words(words: str) -> Column:
    """Words inside windows of WINDOW (8) words that occur twice or more in the text.

    Windows are compared by 64-bit hashes, built by doubling: of 2, 4 and 8 words. A
    text without two equal runs of 4 words has no repeated window. In others,
    windows are sorted by (hash, position), those equal to a neighbour kept, and the
    words that they cover counted without overlap.
    """
    covered = "aggregate(transform(p, (x, i) -> IF(i + 1 < size(p), least(8, p[i + 1] - x), 8)), 0L, (a, x) -> a + x)"
    twins = "array_sort(transform(filter(s, (e, i) -> (i > 0 AND s[i - 1].h = e.h) OR (i + 1 < size(s) AND s[i + 1].h = e.h)), e -> e.p))"
    counted = let("array_sort(transform(w8, (x, i) -> struct(x AS h, i AS p)))", "s", let(twins, "p", covered))
    eights = "slice(zip_with(w4, slice(w4, 5, size(w4)), (x, y) -> xxhash64(x, y)), 1, size(w4) - 4)"
    closer = let(eights, "w8", f"IF(size(array_distinct(w8)) = size(w8), 0L, {counted})")
    fours = "slice(zip_with(w2, slice(w2, 3, size(w2)), (x, y) -> xxhash64(x, y)), 1, size(w2) - 3)"
    twos = f"zip_with({words}, slice({words}, 2, size({words})), (x, y) -> xxhash64(x, y))"
    return F.expr(let(twos, "w2", let(fours, "w4", f"IF(size(array_distinct(w4)) = size(w4), 0L, {closer})")))


def base_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, words and the base statistics of each text (null: no words)."""
    source = pick(docs, id_col, text_col).toDF("doc_id", "text").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    split = source.select("doc_id", "text", ascii_words("text").alias("words"), lines.alias("lines"))
    n = split.select(
        "doc_id",
        "words",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size("words") > WINDOW, repeated_words("words")).otherwise(F.lit(0)).cast("long").alias("n_repeat_words"),
    )
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return n.withColumn("base_failed", failed)


def ratio_weights(docs: DataFrame, trusted_ids: DataFrame) -> DataFrame:
    """(bucket, weight): log of smoothed target over smoothed raw probability, of edges
    below N_BUCKETS and of all trigrams from there on.

    Raw counts are of every document. The trusted ids are at most MAX_TARGET rows,
    so they are broadcast. Without trusted documents every weight is 0.
    """
    ids = pick(trusted_ids, "doc_id").filter(F.col("doc_id").isNotNull()).distinct()
    ids = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_TARGET).withColumn("target", F.lit(1))
    words = pick(docs, "doc_id", "text").join(F.broadcast(ids), "doc_id", "left").select("target", F.explode(ascii_words("text")).alias("word"))
    parts = words.select("target", "word", F.posexplode(pieces(F.col("word"))).alias("k", "piece"))
    # -1 and 0 stand for the edges of the word, once for its first piece
    grams = parts.select("target", "word", "piece", F.explode(F.sequence(F.when(F.col("k") == 0, -1).otherwise(1), n_whole(F.col("piece")))).alias("i"))
    first, last = edge_grams("word")
    gram = F.when(F.col("i") == -1, first).when(F.col("i") == 0, last).otherwise(whole_gram(F.col("piece"), F.col("i")))
    counts = grams.select("target", gram.alias("bucket")).groupBy("bucket").agg(F.count("*").alias("raw"), F.count("target").alias("target"))
    counts = materialize(counts, "rule-counts")  # at most 2 * N_BUCKETS rows
    kind = F.floor(F.col("bucket") / N_BUCKETS).alias("kind")
    totals = counts.groupBy(kind).agg(F.sum("raw").alias("raws"), F.sum("target").alias("targets"))
    p = lambda n, total: F.log((F.col(n) + SMOOTHING) / (F.col(total) + SMOOTHING * N_BUCKETS))
    weight = F.when(F.col("targets") > 0, p("target", "targets") - p("raw", "raws")).otherwise(0.0)
    return counts.withColumn("kind", kind).join(F.broadcast(totals), "kind").select("bucket", weight.alias("weight"))


def constant(weights: DataFrame) -> Column:
    """All 2 * N_BUCKETS weights in order, 0 for a bucket without one, as one constant array of a plan."""
    every = weights.sparkSession.range(2 * N_BUCKETS).select(F.col("id").cast("int").alias("bucket"))
    whole = every.join(weights, "bucket", "left").select(F.struct("bucket", F.coalesce("weight", F.lit(0.0)).alias("weight")).alias("x"))
    text = whole.agg(F.to_json(F.array_sort(F.collect_list("x")).getField("weight"))).first()[0]
    return F.from_json(F.lit(text), "array<double>")  # folded by the optimizer, once for a plan


def quality_rules(docs: DataFrame, trusted_ids: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", whole_threshold: float = WHOLE_THRESHOLD) -> DataFrame:
    """One row per document: doc_id, base statistics, base_failed, llr (of word edges),
    whole_llr (of all trigrams of its words), kept. ``id_col`` names the column that is
    given out as doc_id; trusted are rows whose doc_id is.

    ``kept`` is false where the base rules fail, else whether both mean log ratios
    reach their thresholds. Null and empty texts have no words, ratios of 0, and fail
    the base rules. Repeated rows and null ids are judged one by one; other columns
    are ignored; without trusted documents the base rules alone decide.
    """
    base = base_statistics(docs, id_col)
    weights = constant(ratio_weights(docs, trusted_ids))
    # looked up in the row, so that the sum over a document's words needs neither join nor shuffle
    by = lambda add: F.element_at(F.transform(F.array(weights), lambda w: F.aggregate("words", F.lit(0.0), lambda total, word: add(total, word, w))), 1)
    edges = by(lambda total, word, w: total + sum(F.get(w, g) for g in edge_grams(word)))
    inside = lambda piece, total, w: F.aggregate(F.sequence(F.lit(1), n_whole(piece)), total, lambda t, i: t + F.get(w, whole_gram(piece, i)))
    whole = by(lambda total, word, w: F.when(F.length(word) <= PIECE, inside(word, total, w)).otherwise(F.aggregate(pieces(word), total, lambda t, piece: inside(piece, t, w))))
    n = F.aggregate("words", F.lit(0), lambda n, word: n + n_whole(word))
    mean = lambda s, n: F.when(F.size("words") > 0, s / n).otherwise(0.0)
    out = base.withColumns({"llr": mean(edges, 2 * F.size("words")), "whole_llr": mean(whole, n)}).drop("words")
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= threshold) & (F.col("whole_llr") >= whole_threshold))


def trusted(labels: DataFrame) -> DataFrame:
    """Ids that a label marks as good."""
    return pick(labels, "doc_id", "quality").filter("quality = 1").select("doc_id")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(read(spark, sf_dir, "documents"), trusted(read(spark, sf_dir, "labels"))).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "llr", "whole_llr"
    )
