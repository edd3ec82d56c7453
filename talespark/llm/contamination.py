"""Benchmark decontamination in DataFrame functions only.

Test items are short, documents long, so containment of the item in the document
counts, not resemblance. Items are partitioned by size: one with m distinct
shingles, m in (2**(c-1), 2**c], belongs to class c and keeps a bottom-k MinHash
sketch with k = floor((1 - t) * 2**c) + 1 of its shingle hashes. A document that
contains at least the share t of an item's shingles lacks fewer than k of them, so
it holds at least one sketch value: probing every shingle of every document for
sketch values finds every pair that can qualify. Each candidate is then verified
by exact containment over the shingles' words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, pick, read, skewed_join

SHINGLE = 5
CONTAINMENT = 0.8
#: Rows of sketches (about 32 bytes each) that may be broadcast; above, the join shuffles.
BROADCAST_ROWS = 500_000


def plain_words(text: str) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.array_remove(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def shingles(words: str, length: int | str) -> Column:
    """Distinct space-joined runs of ``length`` words; none if there are fewer."""
    return F.expr(
        f"aggregate(transform(array({words}), ws -> array_distinct(transform(filter(sequence(1, greatest(size(ws), 1)), i -> i + {length} <= size(ws) + 1), "
        f"i -> array_join(slice(ws, i, {length}), ' ')))), cast(array() as array<string>), (a, x) -> x)"
    )


def shingle_hashes(words: str, length: int) -> str:
    """SQL for the 64-bit hashes of those runs in order, repeats included, for a length
    from 1 to 5. Runs are built from runs of 2 and 4 words."""
    nothing = "cast(array() as array<bigint>)"
    let = lambda value, name, body: f"element_at(transform(array({value}), {name} -> {body}), 1)"
    after = lambda a, b, k: f"zip_with({a}, slice({b}, {k + 1}, size({b})), (x, y) -> xxhash64(x, y))"
    w2, w4 = after("ws", "ws", 1), after("w2", "w2", 2)
    body = {
        1: "transform(ws, x -> xxhash64(x))",
        2: w2,
        3: let(w2, "w2", after("w2", "ws", 2)),
        4: let(w2, "w2", w4),
        5: let(w2, "w2", let(w4, "w4", after("w4", "ws", 4))),
    }[length]
    return let(words, "ws", f"IF(size(ws) < {length}, {nothing}, slice({body}, 1, size(ws) - {length - 1}))")


def item_shingles(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, length, shingles): runs of SHINGLE words, or the one run of all its
    words where an item has fewer. Items without a word have no row."""
    w = pick(items, id_col, text_col).toDF("item_id", "text").select("item_id", plain_words("text").alias("words"))
    w = w.filter(F.size("words") > 0).withColumn("length", F.least(F.size("words"), F.lit(SHINGLE)))
    return w.select("item_id", "length", shingles("words", "length").alias("shingles")).distinct()


def sketches(listed: DataFrame, threshold: float = CONTAINMENT) -> DataFrame:
    """(item_id, length, h): bottom-k MinHash values, k by the size class."""
    one = " ".join(f"WHEN {n} THEN element_at({shingle_hashes("split(s, ' ')", n)}, 1)" for n in range(1, SHINGLE + 1))
    hashed = listed.select("item_id", "length", F.expr(f"array_sort(transform(shingles, s -> CASE length {one} END))").alias("hs"))
    top = F.pow(F.lit(2.0), F.ceil(F.log2(F.size("hs"))))
    k = (F.floor(F.round((1 - F.lit(threshold)) * top, 6)) + 1).cast("int")
    return hashed.select("item_id", "length", F.explode(F.slice("hs", F.lit(1), k)).alias("h"))


def find_contaminated(docs: DataFrame, items: DataFrame, threshold: float = CONTAINMENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per (document, item) with containment of at least ``threshold``:
    doc_id, item_id, n_shingles (the item's), n_shared, containment.

    Whole texts are searched. Case, punctuation and white space are ignored. An item
    of fewer than SHINGLE words is contained where its whole word run occurs. Null
    and empty texts contain and are nothing. Null ids take no part. Where an id is
    repeated with several texts, an item is contained if any one of them contains it
    (the largest ``n_shared`` is given). Other columns are ignored.
    """
    source = pick(docs, id_col, text_col).toDF("doc_id", "text").filter(F.col("doc_id").isNotNull())
    listed = materialize(item_shingles(items).filter(F.col("item_id").isNotNull()), "items")
    sketch = materialize(sketches(listed, threshold), "sketches")
    # distinct item shapes: at most SHINGLE of them
    shapes = {r["length"]: r["n"] for r in sketch.groupBy("length").agg(F.count("*").alias("n")).collect()}
    if not shapes:
        return source.join(listed.select("item_id"), F.lit(False)).select("doc_id", "item_id", F.lit(0).alias("n_shingles"), F.lit(0).alias("n_shared"), F.lit(0.0).alias("containment"))
    words = source.select("doc_id", plain_words("text").alias("words"))
    # one scan for all lengths; a hash that meets an item of another length is told by the exact count
    hashes = F.concat(*(F.expr(shingle_hashes("words", length)) for length in sorted(shapes)))
    probe = sketch.select("item_id", "h")
    probe = F.broadcast(probe) if sum(shapes.values()) <= BROADCAST_ROWS else probe
    pairs = materialize(words.select("doc_id", F.explode(hashes).alias("h")).join(probe, "h").select("doc_id", "item_id").distinct(), "candidates")
    # a popular item has many candidates, so its shingles go to them by way of a broadcast
    popular = materialize(listed.join(pairs.groupBy("item_id").count(), "item_id"), "candidate-items")
    named = skewed_join(pairs, popular, "item_id", "count")
    # texts of candidate documents only; the item side is exact shingles in words
    wanted = materialize(pairs.select("doc_id").distinct(), "candidate-documents")
    texts = source.join(wanted, "doc_id").withColumn("words", plain_words("text"))
    both = named.join(texts.select("doc_id", "words"), "doc_id")
    grams = F.when(F.col("length") == SHINGLE, shingles("words", SHINGLE)).otherwise(shingles("words", "length"))
    counted = both.select("doc_id", "item_id", F.size("shingles").alias("n_shingles"), F.size(F.array_intersect("shingles", grams)).alias("n_shared"))
    best = counted.groupBy("doc_id", "item_id").agg(F.max("n_shingles").alias("n_shingles"), F.max("n_shared").alias("n_shared"))
    return best.withColumn("containment", F.col("n_shared") / F.col("n_shingles")).filter(F.col("containment") >= threshold)


def decontaminate(docs: DataFrame, items: DataFrame, threshold: float = CONTAINMENT) -> DataFrame:
    """The documents, all columns, that contain no test item. Null ids stay."""
    # written, so that its size is known before the texts would be shuffled for it
    bad = materialize(find_contaminated(docs, items, threshold).select(F.col("doc_id").alias("_bad")).distinct(), "contaminated")
    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    kept = plain.join(bad, plain[f"c{docs.columns.index('doc_id')}"] == F.col("_bad"), "left_anti")
    return kept.toDF(*docs.columns)


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


OP2_SQL = r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS ws FROM documents WHERE text IS NOT NULL),
i AS (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS ws FROM benchmark WHERE text IS NOT NULL),
ig AS (SELECT DISTINCT item_id, least(len(ws), 5) AS l, unnest(list_transform(range(1, len(ws) - least(len(ws), 5) + 2), lambda p: array_to_string(ws[p:p + least(len(ws), 5) - 1], ' '))) AS g FROM i WHERE len(ws) > 0),
n AS (SELECT item_id, count(*) AS n FROM ig GROUP BY 1),
dg AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(ws) - l + 2), lambda p: array_to_string(ws[p:p + l - 1], ' '))) AS g FROM w, (SELECT DISTINCT l FROM ig) s WHERE len(ws) >= l)
SELECT doc_id, item_id, any_value(n.n)::INTEGER AS n_shingles, count(*)::INTEGER AS n_shared, count(*) / any_value(n.n) AS containment
FROM dg JOIN ig USING (g) JOIN n USING (item_id) GROUP BY doc_id, item_id HAVING count(*) / any_value(n.n) >= 0.8
"""
