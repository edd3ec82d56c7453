"""Queries over rendered notes, schemas, current notes, merged histories and app states, and
SQL that states the same results."""

from __future__ import annotations

from pyspark.sql import functions as F

from talespark.operators import histories, planning, summaries
from talespark.plans.workflow import _t
from talespark.sources import state

TEMPLATE = "---\nid: {{id}}\n---\n{{?lang}}Language: {{lang}}\n{{/}}{{text}}\n{{?source}}From {{source}}{{/}}"
SCHEMA = {
    "type": "object",
    "required": ["lang", "source", "text"],
    "additionalProperties": False,
    "properties": {"lang": {"type": "string", "enum": ["en", "de", "fr"]}, "tags": {"type": "array", "items": {"type": "string", "minLength": 1}}, "source": {"type": "string"}, "text": {"type": "string", "maxLength": 600}},
}


def rendered_notes(spark, d):
    """A note for each document, with its whole text."""
    x = _t(spark, d, "documents").select("doc_id", F.col("doc_id").cast("string").alias("id"), "lang", "source", "text")
    return summaries.render_notes(x, TEMPLATE).select("doc_id", F.md5(F.col("note").cast("binary")).alias("note_md5"))


def schema_faults(spark, d):
    """Documents as JSON: some are cut, some have one more member or an empty tag."""
    k = F.col("doc_id")
    tags = F.when(k % 7 == 2, F.array(F.lit("a"), F.lit(""))).otherwise(F.array(F.lit("a")))
    x = _t(spark, d, "documents").select(k, F.to_json(F.struct("lang", tags.alias("tags"), "source", "text", F.when(k % 13 == 5, "x").alias("more"))).alias("json"))
    return x.select("doc_id", summaries.validate_schema(F.when(k % 17 == 4, '{"lang":').otherwise(F.col("json")), SCHEMA).alias("fault"))


def current_notes(spark, d):
    """Customers as threads, orders as their notes, most of another source or version."""
    c, k = F.col("c_custkey"), F.col("o_orderkey")
    threads = _t(spark, d, "customer").select(c.alias("thread"), F.concat(F.lit("f"), c % 4).alias("fingerprint"), F.when(c % 3 > 0, F.concat(F.lit("c"), c % 3)).alias("capture_sha256"), F.lit("s").alias("source_set_sha256"))
    h = F.md5(k.cast("string"))
    note_id = F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.when(k % 5 == 0, "5").otherwise("4"), F.substring(h, 13, 3)), F.concat(F.lit("a"), F.substring(h, 16, 3)), F.substring(h, 19, 12))
    notes = _t(spark, d, "orders").select(F.col("o_custkey").alias("thread"), F.concat(F.lit("f"), k % 4).alias("fingerprint"), F.when(k % 3 > 0, F.concat(F.lit("c"), k % 3)).alias("capture_sha256"), F.lit("s").alias("source_set_sha256"), F.when(k % 2 == 0, "2").otherwise("1").alias("version"), note_id.alias("note_id"))
    return planning.note_is_current(threads, notes, {"version": "2"})


def merged_histories(spark, d):
    """Orders as branches of their customer's thread, line items as their events."""
    o, n = F.col("o_orderkey").cast("string"), F.col("l_linenumber")
    branches = _t(spark, d, "orders").select(F.col("o_custkey").alias("thread"), F.md5(o).alias("sha256"), F.col("o_orderkey").alias("branch"), F.concat(F.lit("H"), o).alias("branch_id"), F.concat(F.lit("raw:/"), "o_orderstatus", F.lit("/"), o).alias("source_ref"))
    events = _t(spark, d, "lineitem").select(F.md5(F.col("l_orderkey").cast("string")).alias("sha256"), n.cast("long").alias("line_no"), F.format_string("L%06d", n).alias("local_id"))
    return histories.merge_histories(events, branches).select("thread", "branch", "line_no", "event_id", "raw_ref")


def branch_spans(spark, d):
    """Branches whose last time has a zone, has none, or is not given."""
    k = F.col("o_orderkey")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    last = F.when(k % 4 == 0, F.concat(day, F.lit("T10:00:00Z"))).when(k % 4 == 1, F.concat(F.lit("about "), day)).otherwise("")
    return histories.thread_spans(_t(spark, d, "orders").select(F.col("o_custkey").alias("thread"), k.alias("branch"), day.alias("started_at"), last.alias("last_event_at")))


def _states(spark, d):
    """An app-state file for each hundred customers; every 7th lacks its assignments."""
    k = F.col("c_custkey")
    ident = F.concat(F.lit("p"), k)
    project = F.struct(
        F.when(k % 13 == 3, "p x").when(k % 19 == 6, "other").otherwise(ident).alias("id"), F.when(k % 11 == 2, " ").otherwise(F.col("c_name")).alias("name"),
        F.when(k % 7 == 1, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("/r/"), k))).alias("rootPaths"), F.when(k % 23 == 9, "no time").otherwise("2024-05-06T07:08:09Z").alias("createdAt"),
    )
    given = F.struct(F.when(k % 3 == 0, "remote").otherwise("local").alias("projectKind"), F.when(k % 29 == 7, F.lit(None).cast("string")).when(k % 17 == 5, "gone").otherwise(ident).alias("projectId"))
    of = lambda key, v: F.map_from_entries(F.collect_list(F.struct(key.alias("k"), v.alias("v"))))
    g = _t(spark, d, "customer").groupBy(F.floor(k / 100).cast("long").alias("file")).agg(of(ident, project).alias("p"), of(F.concat(F.lit("t"), k), given).alias("a"), F.collect_list(F.when(k % 10 == 0, F.concat(F.lit("t"), k))).alias("f"))
    doc = F.struct(F.col("p").alias(state.MEMBERS[0]), F.when(F.col("file") % 7 != 3, F.col("a")).alias(state.MEMBERS[1]), F.col("f").alias(state.MEMBERS[2]))
    return g.select(F.col("file").alias("source"), F.concat(F.lit("﻿"), F.to_json(doc)).alias("value"))


def app_states(spark, d):
    """All rows of the files: projects, assignments, free threads and faults."""
    p, a, f, faults = state.app_state_tables(_states(spark, d))
    null = F.lit(None).cast("string")
    rows = p.select("source", F.lit("project").alias("kind"), F.col("project").alias("item"), F.element_at("roots", 1).alias("value"))
    rows = rows.unionByName(a.select("source", F.lit("assignment").alias("kind"), F.col("thread").alias("item"), F.concat_ws(" ", "project_kind", "project").alias("value")))
    rows = rows.unionByName(f.select("source", F.lit("free").alias("kind"), F.col("thread").alias("item"), null.alias("value")))
    return rows.unionByName(faults.select("source", F.lit("fault").alias("kind"), F.coalesce("item", "member").alias("item"), F.col("fault").alias("value")))


QUERIES = {f.__name__: f for f in (rendered_notes, schema_faults, current_notes, merged_histories, branch_spans, app_states)}

ORACLE_SQL = {
    "rendered_notes": r"""SELECT doc_id, md5('---' || chr(10) || 'id: ' || doc_id || chr(10) || '---' || chr(10) || CASE WHEN coalesce(lang, '') <> '' THEN 'Language: ' || lang || chr(10) ELSE '' END || coalesce(text, '') || chr(10)
 || CASE WHEN coalesce(source, '') <> '' THEN 'From ' || source ELSE '' END) AS note_md5 FROM documents""",
    "schema_faults": """SELECT doc_id, CASE WHEN doc_id % 17 = 4 THEN '$: no JSON' WHEN lang IS NULL THEN '$.lang: missing' WHEN source IS NULL THEN '$.source: missing' WHEN text IS NULL THEN '$.text: missing' WHEN doc_id % 13 = 5 THEN '$.more: not allowed'
 WHEN lang NOT IN ('en', 'de', 'fr') THEN '$.lang: not an allowed value' WHEN doc_id % 7 = 2 THEN '$.tags[1]: 0 is no allowed length' WHEN length(text) > 600 THEN '$.text: ' || length(text) || ' is no allowed length' END AS fault FROM documents""",
    "current_notes": """SELECT c_custkey AS thread, coalesce(bool_or(o_orderkey % 4 = c_custkey % 4 AND o_orderkey % 3 = c_custkey % 3 AND o_orderkey % 2 = 0 AND o_orderkey % 5 <> 0), false) AS current FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1""",
    "merged_histories": """SELECT o_custkey AS thread, o_orderkey AS branch, l_linenumber::BIGINT AS line_no, 'H' || o_orderkey || '-L' || lpad(l_linenumber::VARCHAR, 6, '0') AS event_id,
 'raw:/' || o_orderstatus || '/' || o_orderkey || '#L' || lpad(l_linenumber::VARCHAR, 6, '0') AS raw_ref FROM orders JOIN lineitem ON l_orderkey = o_orderkey""",
    "branch_spans": """WITH b AS (SELECT o_custkey AS thread, o_orderkey AS k, strftime(o_orderdate::DATE, '%Y-%m-%d') AS day FROM orders)
SELECT thread, arg_min(day, k) AS started_at, coalesce(arg_max(day || 'T10:00:00Z', (day, -k)) FILTER (k % 4 = 0), arg_max('about ' || day, k) FILTER (k % 4 = 1), '') AS last_event_at FROM b GROUP BY thread""",
    "app_states": """WITH c AS (SELECT c_custkey AS k, (c_custkey // 100)::BIGINT AS source, CASE WHEN c_custkey % 13 = 3 THEN 'id' WHEN c_custkey % 11 = 2 THEN 'name' WHEN c_custkey % 7 = 1 THEN 'roots' WHEN c_custkey % 23 = 9 THEN 'time' WHEN c_custkey % 19 = 6 THEN 'key' END AS bad FROM customer),
a AS (SELECT *, CASE WHEN k % 3 = 0 THEN 'remote' ELSE 'local' END AS kind, CASE WHEN k % 17 = 5 THEN 'gone' ELSE 'p' || k END AS project, CASE WHEN k % 29 = 7 THEN 'shape' WHEN k % 3 <> 0 AND (k % 17 = 5 OR bad IS NOT NULL) THEN 'unknown-project' END AS wrong FROM c WHERE source % 7 <> 3)
SELECT source, 'project' AS kind, 'p' || k AS item, '/r/' || k AS value FROM c WHERE bad IS NULL UNION ALL SELECT source, 'assignment', 't' || k, kind || ' ' || project FROM a WHERE wrong IS NULL UNION ALL SELECT source, 'free', 't' || k, NULL FROM c WHERE k % 10 = 0
UNION ALL SELECT source, 'fault', 'p' || k, bad FROM c WHERE bad IS NOT NULL UNION ALL SELECT source, 'fault', 't' || k, wrong FROM a WHERE wrong IS NOT NULL UNION ALL SELECT DISTINCT source, 'fault', 'thread-project-assignments', 'shape' FROM c WHERE source % 7 = 3""",
}
