"""A corpus pipeline of five stages over ``documents``; each stage's output is
written as Parquet and read again as the next one's input.

Every stage takes (spark, docs, sf_dir) and works on all rows that it is given.
All but the last return the columns of ``documents``. A stage decides by rows, not by ids:
rows of one id, or without an id, are judged each by its own text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talespark.llm.common import materialize, pick, read, skewed_join
from talespark.llm.contamination import find_contaminated
from talespark.llm.langid import agreement_limit, fit, identify, training_rows
from talespark.llm.packing import pack_documents, with_digest
from talespark.llm.rules import quality_rules, trusted
from talespark.llm.simhash import near_copies


#: Stands for a row's id and text, in which all decisions are made.
KEY = "_key"


def _keyed(docs: DataFrame, *names: str) -> DataFrame:
    """The columns ``names`` and KEY, a 64-bit hash of id and text: rows of one id but
    different texts differ in it, rows equal in both do not."""
    return pick(docs, *dict.fromkeys(["doc_id", "text", *names])).withColumn(KEY, _key("doc_id", "text")).select(*names, KEY)


def _key(doc_id: str, text: str) -> Column:
    return F.xxhash64(F.col(doc_id).isNull(), doc_id, F.col(text).isNull(), text)


def _without(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows whose KEY is not among ``keys``, a written table. The join is the same at
    every size: rows are shuffled once by their keys, which spread evenly."""
    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    mine = _key(*(f"c{docs.columns.index(c)}" for c in ("doc_id", "text")))
    return plain.join(keys.select(F.col(KEY).alias("_out")).hint("merge"), mine == F.col("_out"), "left_anti").toDF(*docs.columns)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects rows that fail the quality rules, each by its own text: of a repeated or null
    id the rows that pass stay."""
    keyed = _keyed(docs, "doc_id", "text")
    judged = quality_rules(keyed, trusted(read(spark, sf_dir, "labels")), id_col=KEY)
    return _without(docs, materialize(judged.filter("NOT kept").select(F.col("doc_id").alias(KEY)).distinct(), "rejected"))


def keep_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects rows of no language (``und``), those whose language is ambiguous, and those
    whose codes agree too little with any one language (garbled, or half in another
    language); the rest stay, each row by its own text."""
    model = fit(training_rows(docs))
    judged = identify(_keyed(docs, "text"), model, id_col=KEY, agreement=True)
    out = (F.col("lang_pred") == "und") | F.col("ambiguous") | (F.col("agreement") < agreement_limit(docs, model))
    return _without(docs, materialize(judged.filter(out).select(KEY).distinct(), "rejected"))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each component of near copies: that of smallest id (null is the
    largest), of several texts of this id any one. A text that is near no other stays,
    whatever rows share its id; of rows equal in id and text one stays."""
    members = near_copies(_keyed(docs, "text").select(F.col(KEY).alias("doc_id"), "text"))
    members = materialize(members.select(F.col("doc_id").alias(KEY), "component_id").distinct(), "members")
    names = _keyed(docs, "doc_id").groupBy(KEY).agg(F.first("doc_id").alias("doc_id"), F.count("*").alias("n"))
    names = materialize(members.join(names, KEY), "named")
    first = F.min_by(KEY, F.struct(F.col("doc_id").isNull(), "doc_id", KEY)).alias("first")
    groups = materialize(names.groupBy("component_id").agg(first, F.count("*").alias("size")), "components")
    extra = skewed_join(names, groups.filter("size > 1"), "component_id", "size").filter(f"{KEY} <> first").select(KEY)
    kept = _without(docs, materialize(extra, "duplicates"))
    again = materialize(names.filter("n > 1").select(F.col(KEY).alias("_again")), "repeated")
    if not again.limit(1).count():
        return kept
    plain = kept.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    plain = plain.withColumn(KEY, _key(*(f"c{docs.columns.index(c)}" for c in ("doc_id", "text"))))
    once = plain.join(again, F.col(KEY) == F.col("_again"), "left_semi").dropDuplicates([KEY])
    return plain.join(again, F.col(KEY) == F.col("_again"), "left_anti").unionByName(once).drop(KEY).toDF(*docs.columns)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects rows that contain a test item, null ids included."""
    found = find_contaminated(_keyed(docs, "text").select(F.col(KEY).alias("doc_id"), "text"), read(spark, sf_dir, "benchmark"))
    return _without(docs, materialize(found.select(F.col("doc_id").alias(KEY)).distinct(), "contaminated"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into token sequences: one row per piece."""
    return with_digest(pack_documents(docs))


STAGES = [
    ("quality_rules", keep_quality),
    ("language_id", keep_language),
    ("simhash_near_dedup", keep_one_of_each),
    ("decontamination", drop_benchmark),
    ("packing", pack),
]

#: SQL cannot express the hashed ratio, the codes, the fingerprints or the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
