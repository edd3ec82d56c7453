"""Queries over the steps between captures, threads, notes and the published index, and SQL
that states the same results. Tables stand for the library's own as in ``registry``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talespark.operators import attribution, capture, inputs, planning, projects, provenance, records, summaries, threads

NOW = "2024-01-20T00:00:00Z"
WATERMARK = "2024-01-10T09:00:00+09:00"


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def capture_states(spark, d):
    """Two thirds of the documents are registered, some with an older schema or digest; a
    real run and a dry one, with failed reads."""
    k = F.col("doc_id")
    docs = _t(spark, d, "documents").select(F.col("source").alias("source_id"), k.cast("string").alias("source_ref"), "doc_id", F.col("text").cast("binary").alias("content"))
    c = capture.with_digest(docs).drop("content")
    m = c.filter("doc_id % 3 <> 0").select("source_id", "source_ref", F.when(k % 4 == 0, "old").otherwise(F.col("sha256")).alias("sha256"), F.when(k % 5 == 0, 2).otherwise(3).alias("schema_version"), F.lit(1).alias("line_no"))
    now, failed = c.filter("doc_id % 7 <> 0"), c.filter("doc_id % 11 = 0")
    runs = [capture.diff_captures(now, m, failed, dry, 3).withColumn("dry_run", F.lit(dry)) for dry in (False, True)]
    return runs[0].unionByName(runs[1])


def merged_manifest(spark, d):
    o = _t(spark, d, "orders").select(F.col("o_orderpriority").alias("source_id"), F.col("o_orderkey").alias("source_ref"), F.col("o_orderstatus").alias("sha256"), F.lit(1).alias("line_no"))
    now = o.filter("source_ref % 3 <> 0").withColumn("sha256", F.when(F.col("source_ref") % 4 == 0, "new").otherwise(F.col("sha256"))).withColumn("line_no", F.lit(2))
    m = o.filter("source_ref % 5 <> 0")
    return capture.merge_manifest(m, now, capture.diff_captures(now, m))


def _thread_captures(spark, d):
    k = F.col("l_orderkey")
    return _t(spark, d, "lineitem").select(
        F.col("l_returnflag").alias("source_id"), F.concat_ws("/", k.cast("string"), F.col("l_linenumber").cast("string")).alias("source_ref"), F.col("l_partkey").cast("string").alias("capture_ref"),
        F.when(k % 10 == 1, "").when(k % 10 != 2, F.concat(F.lit("t"), k)).alias("thread_id"), F.when(k % 9 == 0, "not UTF-8").alias("error"),
    )


def thread_groups(spark, d):
    found, _ = capture.group_threads(_thread_captures(spark, d), _thread_captures(spark, d).filter("false"))
    return found.select("source_id", "thread_id", F.array_join("source_refs", ",").alias("source_refs"), F.array_join("capture_refs", ",").alias("capture_refs"))


def thread_failures(spark, d):
    raw = _t(spark, d, "supplier").select(F.lit("N").alias("source_id"), F.col("s_name").alias("source_ref"), F.lit("locked").alias("error"))
    return capture.group_threads(_thread_captures(spark, d), raw)[1]


def diagnostics_of_threads(spark, d):
    files = _t(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("thread"), F.array(F.col("l_linenumber")).alias("invalid_lines"), F.array("l_returnflag", "l_linestatus").alias("unknown_types"), F.array(F.col("l_suppkey").cast("string")).alias("metadata_ids")
    )
    x = records.thread_diagnostics(files)
    return x.select("thread", *(F.array_join(F.col(c).cast("array<string>"), ",").alias(c) for c in ("invalid_lines", "unknown_types", "metadata_ids")))


def _stamps(spark, d):
    """Event times in four writings: with a zone, without one, a date, unreadable."""
    e, k = _t(spark, d, "events"), F.col("event_id") % 4
    at = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    return e.select("event_id", F.when(k == 0, F.concat(at, F.lit("Z"))).when(k == 1, at).when(k == 2, F.substring(at, 1, 10)).otherwise("soon").alias("last_event_at"))


def thread_states(spark, d):
    """Times without a zone are local ones: the session's zone is UTC here."""
    x = _stamps(spark, d).select(
        F.col("event_id").cast("string").alias("thread_id"), F.array().cast("array<int>").alias("invalid_lines"), F.array(F.col("event_id").cast("string")).alias("metadata_ids"),
        (F.col("event_id") % 10 == 9).alias("internal"), (F.col("event_id") % 7).alias("user_messages"), F.lit("2024-01-01").alias("started_at"), "last_event_at",
    )
    return records.classify_threads(x, NOW).select("thread_id", "status", "reason")


def threads_in_time(spark, d):
    return planning.time_filter(_stamps(spark, d), WATERMARK, NOW).select("event_id", F.lit("daily").alias("mode")).unionByName(
        planning.time_filter(_stamps(spark, d), WATERMARK, NOW, backfill=True).select("event_id", F.lit("backfill").alias("mode"))
    )


def thread_marks(spark, d):
    c = _t(spark, d, "conversations")
    key = F.col("conv_id").alias("thread")
    m = c.select(key, "role", F.when(F.col("conv_id") % 5 == 0, F.concat(F.lit(" \n[review] "), "text")).otherwise(F.col("text")).alias("text"))
    meta = c.select(key, F.when((F.col("conv_id") % 6 == 0) & (F.col("turn") == 0), "SubAgent").alias("thread_source"))
    return records.thread_flags(m, meta, "thread", "[review]", ["subagent"])


def role_counts(spark, d):
    return threads.messages_by_role(threads.messages(_t(spark, d, "conversations")))


def root_events(spark, d):
    """Pages as events below roots; the roots "/" and "" hold nothing."""
    p = _t(spark, d, "pages").select("page_id", F.regexp_replace(F.regexp_replace("url", "^https?://", "/"), "[?#].*$", "").alias("path"))
    e = p.select("page_id", (F.col("page_id") % 20).alias("thread"), F.when(F.col("page_id") % 3 != 0, F.col("path")).alias("cwd"), F.when(F.col("page_id") % 6 == 0, "/").otherwise(F.col("path")).alias("thread_cwd"))
    roots = p.filter("page_id % 4 = 0").select(F.regexp_extract("path", "^(/[^/]+)", 1).alias("root")).union(p.select(F.repeat(F.lit("/"), F.col("page_id").cast("int") % 2)))
    return projects.select_for_roots(e, roots.distinct(), p.filter("page_id % 20 < 2").select((F.col("page_id") % 20).alias("thread"))).select("page_id")


def foreign_notes(spark, d):
    o = _t(spark, d, "orders").select(F.col("o_custkey").alias("thread"), F.pmod("o_orderkey", F.lit(25)).cast("int").alias("project"))
    return attribution.foreign_threads(o, _t(spark, d, "customer").select(F.col("c_custkey").alias("thread"), F.col("c_nationkey").alias("project")))


def budget_last(spark, d):
    c = _t(spark, d, "customer").select(F.col("c_custkey").alias("thread"), F.col("c_nationkey").alias("project"), F.col("c_acctbal").alias("started_at"))
    return attribution.last_served(c, 40).select("thread", "project", "turn")


def limited_plan(spark, d):
    o = _t(spark, d, "orders")
    plan = o.select(F.col("o_orderpriority").alias("source"), F.col("o_orderkey").alias("thread"), F.when(F.col("o_orderstatus") == "F", "current").otherwise("generate").alias("status"), F.lit(None).cast("string").alias("reason"))
    return attribution.apply_limit(plan, 500, ["source", "thread"])


def branched_sizes(spark, d):
    """Events of branched conversations carry their branch and reference."""
    c = _t(spark, d, "conversations")
    e = c.select(
        F.col("conv_id").alias("thread"), F.format_string("L%06d", F.col("turn") + 1).alias("local_id"), F.col("role").alias("kind"), F.lit("tool").alias("actor"), F.lit("").alias("name"), "text", F.lit("2024-01-01T00:00:00Z").alias("timestamp"),
        F.concat(F.lit("t"), "turn").alias("turn_id"), F.when(F.col("conv_id") % 3 == 0, F.concat(F.lit("H"), "conv_id")).alias("branch_id"), F.concat(F.lit("raw:/a/"), "conv_id", F.lit('"x')).alias("raw_ref"),
    )
    return e.select("thread", "local_id", inputs.event_size(True).alias("size"))


def run_flags(spark, d):
    o = _t(spark, d, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "current").when(F.col("o_orderkey") % 2 == 0, "excluded").when(F.col("o_custkey") % 10 == 0, "blocked").otherwise(F.when(F.col("o_custkey") % 4 == 0, "pending").otherwise("current"))
    e = o.select(F.pmod("o_custkey", F.lit(97)).cast("int").alias("source_id"), status.alias("status"), (F.col("o_orderkey") % 3 == 0).alias("generated"))
    return provenance.run_summary(e, _t(spark, d, "supplier").filter("s_suppkey % 5 = 0").select((F.col("s_suppkey") % 120).cast("int").alias("source_id")))


def provider_totals(spark, d):
    c = _t(spark, d, "customer")
    return provenance.run_totals(c.select(F.col("c_mktsegment").alias("provider"), F.col("c_nationkey").alias("source"), F.when(F.col("c_acctbal") < 0, "failed").otherwise("current").alias("status")), ["provider", "source"], "status")


def publish_faults(spark, d):
    p = _t(spark, d, "documents").select(F.col("doc_id").alias("id"), "source")
    cur = p.filter("doc_id % 3 = 0").unionByName(p.filter("doc_id % 30 = 0"))
    return provenance.index_faults(p.filter("doc_id % 2 = 0"), cur, "src1")


def index_state(spark, d):
    runs = _t(spark, d, "supplier").select(F.col("s_name").alias("source"), (F.col("s_suppkey") == 1).alias("complete"))
    own = runs.filter("complete").limit(1)
    parts = [provenance.index_complete(r, "mine", c).withColumn("case", F.lit(name)) for name, r, c in (("all", own, True), ("not mine", own, False), ("others", runs, True), ("alone", own.limit(0), True))]
    return reduce(DataFrame.unionByName, parts)


def index_check(spark, d):
    o = _t(spark, d, "orders")
    k = F.col("o_orderkey")
    h = F.md5(k.cast("string"))
    uuid = F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))
    version = F.when(k % 50 == 7, 1).otherwise(3).alias("schema_version")
    arts = o.select(k.cast("string").alias("id"), version, F.when(o.o_orderstatus == "F", "current").otherwise("inactive").alias("status"), F.concat(F.lit("data:/"), k).alias("ref"), h.alias("sha256"))
    files = o.filter("o_orderkey % 9 <> 0").select(F.concat(F.lit("data:/"), k).alias("ref"), F.when(k % 8 == 0, "changed").otherwise(h).alias("sha256"))
    acts = o.filter("o_orderkey % 4 = 0").select(F.when(k % 12 == 0, F.concat(F.lit("x"), uuid)).otherwise(uuid).alias("id"), version, F.when(k % 28 != 0, uuid).alias("run_id"))
    return provenance.validate_index(arts, acts, files, 3)


def index_totals(spark, d):
    li = _t(spark, d, "lineitem").select(F.col("l_partkey").alias("snapshot_ref"), F.col("l_suppkey").alias("sha256"))
    return provenance.index_counts(_t(spark, d, "part"), _t(spark, d, "orders"), li)


def note_files(spark, d):
    """Two notes for each second document start in one second with one title."""
    k = F.col("doc_id")
    at = F.concat(F.lit("2024-01-01T2"), F.floor(k / 2) % 4, F.lit(":00:00Z"))
    n = _t(spark, d, "documents").select(F.concat(F.lit("th-"), k).alias("thread"), at.alias("started_at"), F.when(k % 3 == 0, F.concat(F.lit("a-b-"), F.floor(k / 8))).otherwise(F.concat(F.lit("The Note, "), F.floor(k / 8))).alias("title"))
    have = _t(spark, d, "documents").filter("doc_id % 40 = 0").select(F.concat(F.lit("20240102T050000+0900-the-note-"), F.floor(k / 8), F.lit(".md")).alias("name"))
    return summaries.note_names(n, have).select("thread", "name")


def stage_sources(spark, d):
    """Everything that an activity read: parts, suppliers, customers, earlier outputs."""
    li, o = _t(spark, d, "lineitem"), _t(spark, d, "orders")
    rows = [li.select(F.col("l_orderkey").alias("activity"), F.col(c).alias("entity")) for c in ("l_partkey", "l_suppkey")] + [o.select(F.col("o_orderkey").alias("activity"), F.col("o_custkey").alias("entity"))]
    last = o.filter("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("activity"), (F.col("o_orderkey") - 1).alias("entity"))
    return provenance.used_entities(*rows, last)


def artifact_versions(spark, d):
    p = _t(spark, d, "part").select("p_partkey", F.when(F.col("p_size") % 2 == 0, "note").otherwise("decision").alias("kind"), F.when(F.col("p_size") > 6, (F.col("p_size") % 9).cast("string")).alias("version"))
    return summaries.check_artifact_version(p, {"note": ["3", "4", "5", "6"], "decision": ["1", "2"]}).select("p_partkey", "supported")


def note_numbers(spark, d):
    c = _t(spark, d, "conversations")
    e = c.select(F.col("conv_id").alias("thread"), F.when(F.col("role") == "user", "user_message").otherwise("event").alias("kind"), "text")
    return summaries.note_metrics(c.filter("turn % 2 = 1 AND conv_id % 3 <> 0").select(F.col("conv_id").alias("thread"), F.col("text").alias("note")), e)


def repeated_threads(spark, d):
    return planning.duplicate_threads(_t(spark, d, "orders").select(F.col("o_custkey").alias("thread")))


def coverage_faults(spark, d):
    """Half of every text is lost in some events."""
    c = _t(spark, d, "conversations").select(F.col("conv_id").alias("thread"), F.format_string("L%06d", F.col("turn")).alias("local_id"), "turn", "text")
    half = F.floor(F.length("text") / 2).cast("int")
    one = c.select("thread", "local_id", F.lit(0).alias("start"), F.substring(F.col("text"), F.lit(1), half).alias("text"))
    two = c.filter("turn % 5 <> 3").select("thread", "local_id", half.alias("start"), F.substring(F.col("text"), half + 1, F.length("text")).alias("text"))
    return inputs.check_coverage(two.unionByName(one), c)


QUERIES = {
    f.__name__: f
    for f in (
        capture_states, merged_manifest, thread_groups, thread_failures, diagnostics_of_threads, thread_states, threads_in_time, thread_marks, role_counts, root_events, foreign_notes, budget_last, limited_plan,
        branched_sizes, run_flags, provider_totals, publish_faults, index_state, index_check, index_totals, note_files, stage_sources, artifact_versions, note_numbers, repeated_threads, coverage_faults,
    )
}

_TC = """c AS (SELECT l_returnflag AS source_id, l_orderkey || '/' || l_linenumber AS source_ref, l_partkey::VARCHAR AS capture_ref, l_orderkey AS k FROM lineitem)"""
_STAMPS = """s AS (SELECT event_id, CASE event_id % 4 WHEN 2 THEN date_trunc('day', ts) WHEN 3 THEN NULL ELSE date_trunc('second', ts) END AS tm FROM events)"""
_IDLE = "tm <= TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 30 MINUTE"

ORACLE_SQL = {
    "capture_states": """WITH r AS (SELECT source, doc_id, dry_run, CASE WHEN doc_id % 11 = 0 THEN 'deferred' WHEN doc_id % 7 = 0 THEN CASE WHEN doc_id % 3 <> 0 THEN 'bronze-only' END
 WHEN doc_id % 3 <> 0 AND doc_id % 4 <> 0 AND doc_id % 5 <> 0 THEN 'unchanged' WHEN dry_run THEN 'planned' ELSE 'captured' END AS status FROM documents, (VALUES (true), (false)) v(dry_run))
SELECT source AS source_id, doc_id::VARCHAR AS source_ref, status, dry_run FROM r WHERE status IS NOT NULL""",
    "merged_manifest": """WITH o AS (SELECT o_orderpriority AS source_id, o_orderkey AS source_ref, o_orderstatus AS s FROM orders)
SELECT source_id, source_ref, CASE WHEN source_ref % 3 <> 0 AND source_ref % 4 = 0 THEN 'new' ELSE s END AS sha256, CASE WHEN source_ref % 3 <> 0 AND (source_ref % 5 = 0 OR source_ref % 4 = 0) THEN 2 ELSE 1 END AS line_no
FROM o WHERE source_ref % 5 <> 0 OR source_ref % 3 <> 0""",
    "thread_groups": f"""WITH {_TC} SELECT source_id, 't' || k AS thread_id, string_agg(DISTINCT source_ref, ',' ORDER BY source_ref) AS source_refs, string_agg(DISTINCT capture_ref, ',' ORDER BY capture_ref) AS capture_refs FROM c
WHERE k % 9 <> 0 AND k % 10 NOT IN (1, 2) GROUP BY 1, 2""",
    "thread_failures": f"""WITH {_TC} SELECT 'N' AS source_id, s_name AS source_ref, 'raw' AS stage, NULL::VARCHAR AS reason, 'locked' AS error FROM supplier
UNION ALL SELECT source_id, source_ref, 'normalize', CASE WHEN k % 9 <> 0 THEN 'missing-thread-metadata' END, CASE WHEN k % 9 = 0 THEN 'not UTF-8' END FROM c WHERE k % 9 = 0 OR k % 10 IN (1, 2)""",
    "diagnostics_of_threads": """WITH x AS (SELECT l_orderkey AS thread, list_sort(list(DISTINCT l_linenumber)) AS a, list_sort(list_distinct(flatten(list([l_returnflag, l_linestatus])))) AS b, list_sort(list(DISTINCT l_suppkey::VARCHAR)) AS c FROM lineitem GROUP BY 1)
SELECT thread, array_to_string(a, ',') AS invalid_lines, array_to_string(b, ',') AS unknown_types, array_to_string(c, ',') AS metadata_ids FROM x""",
    "thread_states": f"""WITH {_STAMPS}, r AS (SELECT event_id, CASE WHEN event_id % 10 = 9 THEN 'approval-or-internal' WHEN event_id % 7 = 0 THEN 'without-user-message' WHEN tm IS NULL THEN 'without-event-time' WHEN NOT {_IDLE} THEN 'active-conversation' END AS reason FROM s)
SELECT event_id::VARCHAR AS thread_id, CASE WHEN reason IS NULL THEN 'pending' WHEN reason = 'without-event-time' THEN 'failed' WHEN reason = 'active-conversation' THEN 'deferred' ELSE 'excluded' END AS status, reason FROM r""",
    "threads_in_time": f"""WITH {_STAMPS} SELECT event_id, CASE WHEN tm >= TIMESTAMP '2024-01-10 00:00:00' THEN 'daily' ELSE 'backfill' END AS mode FROM s WHERE {_IDLE}""",
    "thread_marks": """SELECT conv_id AS thread, conv_id % 5 = 0 AND bool_or(role = 'user' AND text IS NOT NULL) AS approval_review, conv_id % 6 = 0 AND bool_or(turn = 0) AS internal_source, bool_or(role = 'user') AS has_user_message FROM conversations GROUP BY conv_id""",
    "role_counts": "SELECT conv_id AS thread, coalesce(role, '') AS role, count(*) AS messages, sum(length(coalesce(text, '')))::BIGINT AS characters FROM conversations GROUP BY 1, 2",
    "root_events": """WITH p AS (SELECT page_id, regexp_replace(regexp_replace(url, '^https?://', '/'), '[?#].*$', '') AS path FROM pages), r AS (SELECT DISTINCT lower(regexp_extract(path, '^(/[^/]+)', 1)) AS root FROM p WHERE page_id % 4 = 0)
SELECT page_id FROM p WHERE page_id % 20 IN (SELECT DISTINCT page_id % 20 FROM p WHERE page_id % 20 < 2) OR (NOT page_id % 6 = 0 AND lower(regexp_extract(path, '^(/[^/]+)', 1)) IN (SELECT root FROM r WHERE root <> ''))""",
    "foreign_notes": "SELECT DISTINCT c_custkey AS thread, (o_orderkey % 25)::INTEGER AS project, c_nationkey AS owner FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderkey % 25 <> c_nationkey",
    "budget_last": "SELECT c_custkey AS thread, c_nationkey AS project, (row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey))::INTEGER AS turn FROM customer ORDER BY turn DESC, project DESC LIMIT 40",
    "limited_plan": """WITH x AS (SELECT o_orderpriority AS source, o_orderkey AS thread, o_orderstatus = 'F' AS done, row_number() OVER (PARTITION BY o_orderstatus = 'F' ORDER BY o_orderpriority, o_orderkey) AS n FROM orders)
SELECT source, thread, CASE WHEN done THEN 'current' WHEN n <= 500 THEN 'generate' ELSE 'deferred' END AS status, CASE WHEN NOT done AND n > 500 THEN 'limit' END AS reason FROM x""",
    "branched_sizes": """SELECT conv_id AS thread, 'L' || lpad((turn + 1)::VARCHAR, 6, '0') AS local_id, length('{"id": "L000000", "kind": "' || role || '", "actor": "tool", "name": "", "text": ' || to_json(coalesce(text, ''))::VARCHAR || ', "timestamp": "2024-01-01T00:00:00Z", "turnId": "t' || turn || '"'
 || CASE WHEN conv_id % 3 = 0 THEN ', "branchId": "H' || conv_id || '", "rawRef": ' || to_json('raw:/a/' || conv_id || '"x')::VARCHAR ELSE '' END || '}')::INTEGER AS size FROM conversations""",
    "run_flags": """WITH e AS (SELECT (o_custkey % 97)::INTEGER AS s, CASE WHEN o_orderstatus = 'F' THEN 'current' WHEN o_orderkey % 2 = 0 THEN 'excluded' WHEN o_custkey % 10 = 0 THEN 'blocked' WHEN o_custkey % 4 = 0 THEN 'pending' ELSE 'current' END AS st, o_orderkey % 3 = 0 AS g FROM orders),
f AS (SELECT (s_suppkey % 120)::INTEGER AS s, count(*) AS n FROM supplier WHERE s_suppkey % 5 = 0 GROUP BY 1), c AS (SELECT s, count(*) AS n, count(*) FILTER (g) AS g, count(*) FILTER (st = 'blocked') AS b, count(*) FILTER (st NOT IN ('current', 'excluded')) AS o FROM e GROUP BY 1)
SELECT coalesce(c.s, f.s) AS source_id, coalesce(c.n, 0) AS threads, coalesce(c.g, 0) AS generated, f.n IS NULL AND coalesce(b, 0) = 0 AS ok, f.n IS NULL AND coalesce(o, 0) = 0 AS complete FROM c FULL JOIN f ON c.s = f.s""",
    "provider_totals": "SELECT c_mktsegment AS provider, c_nationkey AS source, CASE WHEN c_acctbal < 0 THEN 'failed' ELSE 'current' END AS status, count(*) AS n FROM customer GROUP BY ROLLUP (1, 2, 3)",
    "publish_faults": """SELECT doc_id AS id, 'duplicate-id' AS fault FROM documents WHERE doc_id % 30 = 0 UNION ALL SELECT doc_id, 'foreign-owner' FROM documents WHERE doc_id % 6 = 0 AND source IS DISTINCT FROM 'src1'""",
    "index_state": """SELECT c AS "case", n AS sources, f AS complete FROM (VALUES ('all', 2::BIGINT, true), ('not mine', 2, false), ('alone', 1, true)) v(c, n, f) UNION ALL SELECT 'others', count(*) + 1, count(*) = 1 FROM supplier""",
    "index_check": """WITH o AS (SELECT o_orderkey AS k, o_orderstatus = 'F' AS cur, md5(o_orderkey::VARCHAR) AS h FROM orders), u AS (SELECT *, concat_ws('-', h[1:8], h[9:12], h[13:16], h[17:20], h[21:32]) AS uuid FROM o),
f AS (SELECT k::VARCHAR AS id, CASE WHEN k % 50 = 7 THEN 'schema-version' WHEN cur AND (k % 9 = 0 OR k % 8 = 0) THEN 'artifact-changed' END AS fault FROM u
 UNION ALL SELECT CASE WHEN k % 12 = 0 THEN 'x' ELSE '' END || uuid, CASE WHEN k % 50 = 7 THEN 'schema-version' WHEN k % 12 = 0 OR k % 28 = 0 THEN 'identity' END FROM u WHERE k % 4 = 0)
SELECT * FROM f WHERE fault IS NOT NULL""",
    "index_totals": "SELECT (SELECT count(*) FROM part) AS artifacts, (SELECT count(*) FROM orders) AS activities, (SELECT count(*) FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem)) AS snapshots",
    "note_files": """WITH n AS (SELECT 'th-' || doc_id AS thread, doc_id, strftime(make_timestamp(2024, 1, 1, 20 + (doc_id // 2 % 4)::INTEGER, 0, 0) + INTERVAL 9 HOUR, '%Y%m%dT%H%M%S+0900-') || CASE WHEN doc_id % 3 = 0 THEN 'a-b-' ELSE 'the-note-' END || doc_id // 8 AS base FROM documents),
x AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY thread) > 1 OR base IN (SELECT '20240102T050000+0900-the-note-' || doc_id // 8 FROM documents WHERE doc_id % 40 = 0) AS again FROM n)
SELECT thread, base || CASE WHEN again THEN '-' || substr(replace(thread, '-', ''), 1, 8) ELSE '' END || '.md' AS name FROM x""",
    "stage_sources": """SELECT DISTINCT l_orderkey AS activity, l_partkey AS entity, 'capture' AS role FROM lineitem UNION ALL SELECT DISTINCT l_orderkey, l_suppkey, 'events' FROM lineitem
UNION ALL SELECT o_orderkey, o_custkey, 'metadata' FROM orders UNION ALL SELECT o_orderkey, o_orderkey - 1, 'prior-output' FROM orders WHERE o_orderkey % 3 = 0""",
    "artifact_versions": "SELECT p_partkey, coalesce(CASE WHEN p_size > 6 THEN (p_size % 9)::VARCHAR END, '1') IN (SELECT unnest(CASE WHEN p_size % 2 = 0 THEN ['3', '4', '5', '6'] ELSE ['1', '2'] END)) AS supported FROM part",
    "note_numbers": """WITH n AS (SELECT conv_id, sum(strlen(text))::BIGINT AS b FROM conversations WHERE turn % 2 = 1 AND conv_id % 3 <> 0 GROUP BY 1)
SELECT conv_id AS thread, sum(strlen(text))::BIGINT AS event_bytes, count(*) FILTER (role = 'user') AS user_messages, any_value(n.b) AS note_bytes FROM conversations LEFT JOIN n USING (conv_id) GROUP BY 1""",
    "repeated_threads": "SELECT o_custkey AS thread, count(*) AS rows FROM orders GROUP BY 1 HAVING count(*) > 1",
    "coverage_faults": "SELECT conv_id AS thread, 'L' || lpad(turn::VARCHAR, 6, '0') AS local_id FROM conversations WHERE turn % 5 = 3 AND length(text) > 0",
}
