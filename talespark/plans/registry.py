"""Registered queries over the given tables, and SQL that states the same results.

Tables stand for the library's own as follows: ``documents`` for captured files
(thread = language), ``conversations`` for messages, ``events`` for timed events,
``nation`` and ``customer`` for projects and threads, ``orders`` and ``lineitem``
for activities and entities.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talespark.functions import text as T
from talespark.operators import attribution, capture, provenance, threads

_TIME = "yyyy-MM-dd HH:mm:ss.SSSSSS"


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _captures(spark, d):
    docs = _t(spark, d, "documents")
    return docs.select(F.col("source").alias("source_id"), F.concat_ws("/", F.lit("sessions"), "source", F.concat(F.col("doc_id").cast("string"), F.lit(".jsonl"))).alias("source_ref"), F.col("lang").alias("thread"), "doc_id", F.col("text").cast("binary").alias("content"))


def _manifest(spark, d):
    c = capture.with_digest(_captures(spark, d)).filter("doc_id % 7 <> 3")
    old = F.when(F.col("doc_id") % 3 == 0, F.sha2(F.concat(F.lit("old"), F.col("sha256")), 256)).otherwise(F.col("sha256"))
    gone = c.filter("doc_id % 11 = 0").withColumn("source_ref", F.concat(F.lit("archived_"), "source_ref"))
    return c.withColumn("sha256", old).unionByName(gone).withColumn("line_no", F.lit(1))


def conversation_summary(spark, d):
    e = threads.messages(_t(spark, d, "conversations"))
    mirrored = e.filter("ord % 2 = 0").withColumn("text", F.concat(F.lit("  "), "text", F.lit(" \n"))).withColumn("local_id", F.concat("local_id", F.lit("m")))
    return threads.thread_summary(threads.dedupe_messages(e.unionByName(mirrored)))


def capture_status(spark, d):
    return capture.diff_captures(capture.with_digest(_captures(spark, d)), _manifest(spark, d))


def capture_report(spark, d):
    c = capture.with_digest(_captures(spark, d))
    diff = capture.diff_captures(c, _manifest(spark, d), c.filter("doc_id % 5 = 1"))
    return capture.capture_report(diff, c.filter("doc_id % 4 = 0").select("source_id", "source_ref", "sha256"), c)


def exact_copies(spark, d):
    return capture.collapse_exact(capture.with_digest(_captures(spark, d)).select("thread", "sha256", "source_ref"))


def prefix_versions(spark, d):
    c = _captures(spark, d).select(F.concat("thread", F.lit("-"), F.floor(F.col("doc_id") / 10).cast("string")).alias("thread"), "content")
    halves = c.withColumn("content", F.substring(F.col("content").cast("string"), F.lit(1), F.length(F.col("content").cast("string")) / 2).cast("binary"))
    return capture.last_versions(capture.with_digest(c.unionByName(halves)))


def source_sets(spark, d):
    """A set for each thread: copies and versions of one conversation, here ten documents."""
    c = capture.with_digest(_captures(spark, d)).withColumn("source_id", F.concat_ws("-", "source_id", F.floor(F.col("doc_id") / 10).cast("string"))).groupBy("source_id").agg(F.collect_set("sha256").alias("digests"))
    return c.select("source_id", F.size("digests").alias("n"), capture.set_digest(F.col("digests")).alias("source_set_sha256"))


def redacted_texts(spark, d):
    docs = _t(spark, d, "documents")
    return docs.select("doc_id", F.size(T.secret_hits(F.col("text"))).alias("hits"), F.md5(T.redact(F.col("text")).cast("binary")).alias("redacted_md5"))


def normalized_texts(spark, d):
    return _t(spark, d, "documents").select("doc_id", F.md5(T.normalize_text(F.col("text")).cast("binary")).alias("text_md5"), T.slugify(F.substring("text", 1, 40)).alias("slug"))


def thread_keys(spark, d):
    return _t(spark, d, "customer").select("c_custkey", T.name_uuid(F.concat(F.lit("thread:"), F.col("c_custkey").cast("string"))).alias("thread_key"))


def page_paths(spark, d):
    p = _t(spark, d, "pages")
    return p.select("page_id", T.normalize_path(F.concat(F.lit("/mnt/c/"), F.regexp_replace("url", "^https?://", ""))).alias("path"), T.normalize_repo_url(F.concat(F.lit(" "), F.regexp_replace("url", r"^https?://([^/]+)/(.*)$", "git@$1:$2"), F.lit(".git"))).alias("repository"))


def page_projects(spark, d):
    p = _t(spark, d, "pages").select("page_id", F.regexp_replace(F.regexp_replace("url", "^https?://", "/"), "[?#].*$", "").alias("path"))
    roots = p.select(F.regexp_extract("path", "^(/[^/]+)", 1).alias("root")).union(p.select(F.regexp_extract("path", "^(/[^/]+/[a-z]+)", 1))).union(p.select(F.repeat(F.lit("/"), F.col("page_id").cast("int") % 3))).distinct()
    return attribution.within_roots(p, roots.withColumn("project", F.col("root"))).groupBy("page_id").agg(F.count("*").alias("projects"), F.max("project").alias("deepest"))


def memberships(spark, d):
    c = _t(spark, d, "customer")
    t = c.select(F.col("c_custkey").alias("thread"), F.when(F.col("c_custkey") % 3 == 0, F.col("c_nationkey")).alias("assigned"))
    o = _t(spark, d, "orders").select(F.col("o_custkey").alias("thread"), F.pmod(F.col("o_orderkey"), F.lit(25)).cast("int").alias("project")).filter("project < 3")
    return attribution.membership(t, t.filter("thread % 10 = 0"), o).select("thread", "kind", "project", F.array_join("candidates", ",").alias("candidates"))


def assignment_faults(spark, d):
    a = _t(spark, d, "customer").select(F.col("c_custkey").alias("thread"), F.col("c_nationkey").alias("project"))
    b = _t(spark, d, "supplier").select(F.col("s_suppkey").alias("thread"), F.col("s_nationkey").alias("project"))
    both = a.unionByName(b)
    known = _t(spark, d, "nation").filter("n_regionkey <> 2").select(F.col("n_nationkey").alias("project"))
    return attribution.double_assignments(both).select("thread", F.lit("two-projects").alias("fault")).unionByName(attribution.unknown_projects(both, known).select("thread", F.lit("unknown-project").alias("fault")))


def fair_order(spark, d):
    c = _t(spark, d, "orders").select(F.col("o_orderkey").alias("thread"), F.pmod("o_custkey", F.lit(25)).alias("project"), F.col("o_orderdate").alias("started_at"))
    return attribution.round_robin(c).select("thread", "project", "turn")


def budget_first(spark, d):
    c = _t(spark, d, "customer").select(F.col("c_custkey").alias("thread"), F.col("c_nationkey").alias("project"), F.col("c_acctbal").alias("started_at"))
    return attribution.first_served(c, 40).select("thread", "project", "turn")


def filled_context(spark, d):
    e = _t(spark, d, "events").select("event_id", "user_id", "ts", F.when(F.col("event_type") != "click", F.col("event_type")).alias("kind"))
    return threads.fill_context(e, "user_id", ["ts", "event_id"], "kind").select("event_id", "kind_filled")


def idle_sessions(spark, d):
    return threads.idle_sessions(_t(spark, d, "events"), "user_id", "ts").select("user_id", "events", F.date_format("first_at", _TIME).alias("first_at"), F.date_format("last_at", _TIME).alias("last_at"))


def derived_edges(spark, d):
    li = _t(spark, d, "lineitem")
    r = provenance.edge_counts(li.select(F.col("l_orderkey").alias("activity"), F.col("l_partkey").alias("entity")), li.select(F.col("l_orderkey").alias("activity"), F.col("l_suppkey").alias("entity")))
    return r.select(F.col("dst").alias("supplier"), "edges", "sources")


def run_totals(spark, d):
    return provenance.run_totals(_t(spark, d, "orders"), "o_orderpriority", "o_orderstatus")


def last_runs(spark, d):
    r = provenance.last_run(_t(spark, d, "orders"), "o_custkey", "o_orderdate", "o_orderkey", "o_orderstatus", "F")
    return r.select("o_custkey", F.date_format("o_orderdate", _TIME).alias("finished_at"), "o_orderkey", "o_orderstatus", "all_ok")


def published_index(spark, d):
    p = _t(spark, d, "documents").select(F.col("doc_id").alias("id"), "source", F.md5(F.col("text").cast("binary")).alias("version"))
    before = p.filter("id % 2 = 0").withColumn("status", F.when(F.col("id") % 10 == 0, "inactive").otherwise("current"))
    first = provenance.publish_index(before, p.filter("id % 4 <> 0 AND source = 'src2'").withColumn("status", F.lit("current")), "src2")
    return provenance.publish_index(first, p.filter("false").withColumn("status", F.lit("current")), "src1")


def planned_notes(spark, d):
    x = _t(spark, d, "documents").join(_t(spark, d, "labels"), "doc_id", "left")
    notes = x.select("doc_id", (F.col("doc_id") % 3 == 0).alias("fresh"), F.col("quality").isNotNull().alias("exists"), F.coalesce(F.col("quality") == 1, F.lit(False)).alias("reviewed"), F.coalesce(F.col("toxic") == 1, F.lit(False)).alias("edited"))
    flags = notes.withColumns({"deferred": F.col("doc_id") % 17 == 3, "selected": F.col("doc_id") % 11 != 5, "recoverable": F.col("doc_id") % 13 == 2})
    runs = {"plain": {}, "force": {"force": True}, "edited": {"allow_edited": True}, "scan": {"generate": False}, "dry": {"dry_run": True}}
    plans = [provenance.plan_notes(flags, **options).select("doc_id", F.lit(run).alias("run"), "status", "reason") for run, options in runs.items()]
    return reduce(DataFrame.unionByName, plans)


QUERIES = {
    f.__name__: f
    for f in (
        conversation_summary, capture_status, capture_report, exact_copies, prefix_versions, source_sets, redacted_texts, normalized_texts, thread_keys, page_paths, page_projects,
        memberships, assignment_faults, fair_order, budget_first, filled_context, idle_sessions, derived_edges, run_totals, last_runs, published_index, planned_notes,
    )
}

_SPACE = r"[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
_NORMAL = f"trim(regexp_replace(text, '{_SPACE}', ' ', 'g'))"
_QUOTED = [p.replace("'", "''") for p in T.SECRET_PATTERNS]
_REDACT = "text"
for _p in _QUOTED:
    _REDACT = f"regexp_replace({_REDACT}, '{_p}', '[REDACTED]', 'g')"
_HITS = " + ".join(f"regexp_matches(text, '{p}')::INTEGER" for p in _QUOTED)
_CAPTURES = "c AS (SELECT source AS source_id, 'sessions/' || source || '/' || doc_id || '.jsonl' AS source_ref, lang AS thread, doc_id, text, sha256(text) AS sha256 FROM documents)"
_STATUS = f"""{_CAPTURES}, m AS (SELECT source_id, source_ref, CASE WHEN doc_id % 3 = 0 THEN sha256('old' || sha256) ELSE sha256 END AS sha256 FROM c WHERE doc_id % 7 <> 3
 UNION ALL SELECT source_id, 'archived_' || source_ref, sha256 FROM c WHERE doc_id % 7 <> 3 AND doc_id % 11 = 0),
s AS (SELECT coalesce(c.source_id, m.source_id) AS source_id, coalesce(c.source_ref, m.source_ref) AS source_ref,
 CASE WHEN c.sha256 IS NULL THEN 'bronze-only' WHEN c.sha256 = m.sha256 THEN 'unchanged' ELSE 'captured' END AS status FROM c FULL JOIN m ON c.source_id = m.source_id AND c.source_ref = m.source_ref)"""

ORACLE_SQL = {
    "conversation_summary": f"""WITH f AS (SELECT conv_id AS thread, turn, role, any_value(text) AS text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, role, {_NORMAL} ORDER BY turn) AS rn FROM conversations) WHERE rn = 1 GROUP BY ALL)
SELECT thread, count(*) AS events, count(*) FILTER (role = 'user') AS user_messages, count(*) FILTER ({_HITS} > 0) AS with_secrets, sum(length({_REDACT}))::BIGINT AS redacted_chars,
 coalesce(arg_min(substr({_NORMAL}, 1, 100), turn) FILTER (role = 'user'), 'Untitled') AS title, CASE WHEN count(*) FILTER (role = 'user') > 0 THEN 'pending' ELSE 'without-user-message' END AS status FROM f GROUP BY thread""",
    "capture_status": f"WITH {_STATUS} SELECT * FROM s",
    "capture_report": f"""WITH {_STATUS}, r AS (SELECT s.*, s.source_ref IN (SELECT source_ref FROM c WHERE doc_id % 5 = 1) AS bad, s.source_ref IN (SELECT source_ref FROM c WHERE doc_id % 4 = 0) AS have FROM s),
t AS (SELECT source_id, have, CASE WHEN bad THEN 'deferred' ELSE status END AS status FROM r)
SELECT source_id, count(*) FILTER (status <> 'bronze-only') AS discovered, count(*) FILTER (status <> 'deferred') AS available, count(*) FILTER (status = 'captured') AS captured, 0::BIGINT AS planned, count(*) FILTER (status = 'unchanged') AS unchanged,
 count(*) FILTER (status = 'bronze-only') AS bronze_only, count(*) FILTER (status = 'captured' AND NOT have) AS created, count(*) FILTER (status = 'deferred') AS failed FROM t GROUP BY 1""",
    "exact_copies": f"WITH {_CAPTURES} SELECT thread, sha256, min(source_ref) AS source_ref FROM c GROUP BY 1, 2",
    "prefix_versions": """WITH v AS (SELECT DISTINCT lang || '-' || doc_id // 10 AS thread, text AS t FROM documents UNION SELECT DISTINCT lang || '-' || doc_id // 10, substr(text, 1, length(text) // 2) FROM documents),
n AS (SELECT *, lead(t) OVER (PARTITION BY thread ORDER BY t) AS nx FROM v) SELECT thread, sha256(t) AS sha256, strlen(t)::BIGINT AS byte_count FROM n WHERE nx IS NULL OR NOT starts_with(nx, t)""",
    "source_sets": """WITH g AS (SELECT concat_ws('-', source, doc_id // 10) AS source_id, list_sort(list(DISTINCT sha256(text))) AS l FROM documents GROUP BY 1) SELECT source_id, len(l)::INTEGER AS n, sha256('["' || array_to_string(l, '","') || '"]') AS source_set_sha256 FROM g""",
    "redacted_texts": f"SELECT doc_id, ({_HITS})::INTEGER AS hits, md5({_REDACT}) AS redacted_md5 FROM documents",
    "normalized_texts": f"SELECT doc_id, md5({_NORMAL}) AS text_md5, CASE WHEN s = '' THEN 'session-note' ELSE s END AS slug FROM (SELECT *, trim(regexp_replace(lower(substr(text, 1, 40)), '[^a-z0-9]+', '-', 'g'), '-') AS s FROM documents)",
    "thread_keys": """WITH h AS (SELECT c_custkey, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode('thread:' || c_custkey)) AS h FROM customer)
SELECT c_custkey, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', (((instr('0123456789abcdef', substr(h, 17, 1)) - 1) & 3) + 1)::INTEGER, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS thread_key FROM h""",
    "page_paths": r"""SELECT page_id, 'c:\' || lower(regexp_replace(replace(regexp_replace(url, '^https?://', ''), '/', '\'), '\\+$', '')) AS path,
 lower(regexp_replace(regexp_replace(url, '^https?://', 'https://'), '/+$', '')) AS repository FROM pages""",
    "page_projects": """WITH p AS (SELECT page_id, regexp_replace(regexp_replace(url, '^https?://', '/'), '[?#].*$', '') AS path FROM pages),
r AS (SELECT DISTINCT root FROM (SELECT regexp_extract(path, '^(/[^/]+)', 1) AS root FROM p UNION SELECT regexp_extract(path, '^(/[^/]+/[a-z]+)', 1) FROM p) WHERE root <> '')
SELECT page_id, count(*) AS projects, max(root) AS deepest FROM p JOIN r ON lower(rtrim(path, '/')) = lower(root) OR starts_with(lower(path), lower(root) || '/') GROUP BY 1""",
    "memberships": """WITH t AS (SELECT c_custkey AS thread, CASE WHEN c_custkey % 3 = 0 THEN c_nationkey END AS assigned FROM customer),
o AS (SELECT o_custkey AS thread, count(DISTINCT o_orderkey % 25) AS n, min(o_orderkey % 25) AS p, array_to_string(list_sort(list(DISTINCT o_orderkey % 25)), ',') AS l FROM orders WHERE o_orderkey % 25 < 3 GROUP BY 1),
k AS (SELECT thread, assigned, p, l, CASE WHEN thread % 10 = 0 THEN 'projectless' WHEN assigned IS NOT NULL THEN 'explicit' WHEN n = 1 THEN 'inferred' WHEN n > 1 THEN 'ambiguous' ELSE 'unmatched' END AS kind FROM t LEFT JOIN o USING (thread))
SELECT thread, kind, (CASE kind WHEN 'explicit' THEN assigned WHEN 'inferred' THEN p END)::INTEGER AS project, CASE kind WHEN 'ambiguous' THEN l ELSE '' END AS candidates FROM k""",
    "assignment_faults": """WITH a AS (SELECT c_custkey AS thread, c_nationkey AS project FROM customer UNION ALL SELECT s_suppkey, s_nationkey FROM supplier)
SELECT thread, 'two-projects' AS fault FROM a GROUP BY 1 HAVING count(DISTINCT project) > 1 UNION ALL SELECT thread, 'unknown-project' FROM a WHERE project NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey <> 2)""",
    "fair_order": "SELECT o_orderkey AS thread, o_custkey % 25 AS project, row_number() OVER (PARTITION BY o_custkey % 25 ORDER BY o_orderdate, o_orderkey)::INTEGER AS turn FROM orders",
    "budget_first": "SELECT c_custkey AS thread, c_nationkey AS project, (row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey))::INTEGER AS turn FROM customer ORDER BY turn, project LIMIT 40",
    "filled_context": "SELECT event_id, last_value(CASE WHEN event_type <> 'click' THEN event_type END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS kind_filled FROM events",
    "idle_sessions": """WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM g) SELECT user_id, count(*) AS events, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS first_at, strftime(max(ts), '%Y-%m-%d %H:%M:%S.%f') AS last_at FROM s GROUP BY user_id, n""",
    "derived_edges": """WITH u AS (SELECT DISTINCT l_orderkey AS a, l_partkey AS src FROM lineitem), g AS (SELECT DISTINCT l_orderkey AS a, l_suppkey AS dst FROM lineitem)
SELECT dst AS supplier, count(*) AS edges, count(DISTINCT src) AS sources FROM u JOIN g USING (a) GROUP BY 1""",
    "run_totals": "SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderpriority, o_orderstatus)",
    "last_runs": """SELECT o_custkey, strftime(max(o_orderdate), '%Y-%m-%d %H:%M:%S.%f') AS finished_at, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS o_orderstatus, bool_and(o_orderstatus = 'F') AS all_ok FROM orders GROUP BY 1""",
    "published_index": """WITH p AS (SELECT doc_id AS id, source, md5(text) AS version FROM documents), cur AS (SELECT * FROM p WHERE id % 4 <> 0 AND source = 'src2')
SELECT *, 'current' AS status FROM cur UNION ALL SELECT *, CASE WHEN source IN ('src1', 'src2') OR id % 10 = 0 THEN 'inactive' ELSE 'current' END FROM p WHERE id % 2 = 0 AND id NOT IN (SELECT id FROM cur)""",
    "planned_notes": """WITH n AS (SELECT doc_id, run, doc_id % 11 <> 5 AS sel, CASE WHEN doc_id % 17 = 3 THEN 'deferred' WHEN quality IS NOT NULL AND doc_id % 3 = 0 AND NOT (run = 'force' AND doc_id % 11 <> 5) THEN 'current'
 WHEN run = 'scan' OR doc_id % 11 = 5 THEN 'pending' WHEN quality = 1 THEN 'reviewed' WHEN quality IS NOT NULL AND toxic = 1 AND doc_id % 13 <> 2 AND run <> 'edited' THEN 'edited' WHEN run = 'dry' THEN 'planned' ELSE 'generate' END AS s
 FROM documents LEFT JOIN labels USING (doc_id), (VALUES ('plain'), ('force'), ('edited'), ('scan'), ('dry')) r(run))
SELECT doc_id, run, CASE WHEN s IN ('reviewed', 'edited') THEN 'blocked' ELSE s END AS status, CASE WHEN s IN ('reviewed', 'edited') THEN s || '-session-note' WHEN s IN ('pending', 'planned', 'generate') THEN 'session-note-needs-build' END AS reason FROM n""",
}
