"""Queries over logs, histories, inputs, plans and provenance, and their DuckDB SQL.

Log files are made from ``conversations`` by Spark (a header, then four records for
each message: turn, message, its mirrored copy, a tool record), so that reading them
back must give the messages again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from talespark.functions import text as T
from talespark.operators import attribution, capture, histories, inputs, planning, projects, provenance, records, summaries
from talespark.plans.registry import _NORMAL, _REDACT, _SPACE
from talespark.sources import logs

NOW, MARK = "2026-01-15T00:00:00Z", "2026-01-08T00:00:00Z"
BUDGET = 1200


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _stamp(c, n):
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    return F.concat(F.lit("2026-01-"), two(c % 28 + 1), F.lit("T"), two(F.pmod(n, F.lit(24))), F.lit(":"), two(c % 60), F.lit(":00Z"))


def _json(**parts):
    return F.to_json(F.struct(*(v.alias(k) for k, v in parts.items())))


def _numbered(spark, d):
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    return _t(spark, d, "conversations").withColumn("n", F.row_number().over(w))


def _log_files(spark, d):
    """(thread, content): one file for each conversation; every 7th ends in a broken line."""
    c, n, text, role = F.col("conv_id"), F.col("n"), F.col("text"), F.col("role")
    at = _stamp(c, n)
    user, spoken = role == "user", role.isin("user", "assistant")
    turn = _json(timestamp=at, type=F.lit("turn_context"), payload=F.struct(F.concat(F.lit("t"), n).alias("turn_id"), F.when(n % 3 == 0, "/work/x").otherwise("").alias("cwd")))
    said = _json(timestamp=at, type=F.lit("response_item"), payload=F.struct(F.lit("message").alias("type"), role.alias("role"), F.array(F.struct(F.lit("text").alias("type"), text.alias("text"))).alias("content")))
    copy = F.when(user, F.concat(F.lit("  "), text, F.lit("\n<environment_context>x"))).otherwise(F.concat(F.lit(" "), text))
    kind = F.when(user, "user_message").when(spoken, "agent_message").otherwise("token_count")
    again = _json(timestamp=at, type=F.lit("event_msg"), payload=F.struct(kind.alias("type"), copy.alias("message")))
    call = _json(timestamp=at, type=F.lit("response_item"), payload=F.struct(F.lit("function_call").alias("type"), F.lit("look").alias("name"), F.struct(n.alias("b"), c.alias("a")).alias("arguments")))
    done = _json(timestamp=at, type=F.lit("event_msg"), payload=F.struct(F.lit("task_complete").alias("type"), n.alias("turn")))
    rows = _numbered(spark, d).select("conv_id", "n", F.array_join(F.array(turn, said, again, F.when(role == "assistant", call).otherwise(done)), "\n").alias("block"))
    files = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("n", "block"))).alias("b"))
    head = _json(timestamp=_stamp(c, F.lit(0)), type=F.lit("session_meta"), payload=F.struct(c.cast("string").alias("id"), F.concat(F.lit("/work/"), c % 5).alias("cwd"), _stamp(c, F.lit(0)).alias("timestamp")))
    body = F.concat(head, F.lit("\n\n"), F.array_join(F.transform("b", lambda x: x["block"]), "\r\n"), F.when(c % 7 == 0, '\n{"type":').otherwise(""))
    return files.select(c.cast("string").alias("thread"), body.cast("binary").alias("content"))


def _log_events(spark, d):
    return records.log_events(logs.read_lines(_log_files(spark, d), "thread"), "thread")


def log_events(spark, d):
    e = _log_events(spark, d)
    return e.select("thread", "local_id", "kind", "actor", "name", "turn_id", "cwd", "timestamp", F.md5(F.col("text").cast("binary")).alias("text_md5"))


def log_threads(spark, d):
    parsed = records.parse_lines(logs.read_lines(_log_files(spark, d), "thread"))
    users = records.dedupe_events(records.classify_records(records.fill_context(parsed, "thread"), "thread"), "thread").filter("kind = 'user_message'").groupBy("thread").agg(F.count("*").alias("user_messages"))
    x = records.diagnostics(parsed, "thread").join(records.thread_metadata(parsed, "thread"), "thread", "left").join(users, "thread", "left")
    x = x.withColumn("user_messages", F.coalesce("user_messages", F.lit(0))).withColumn("internal", F.col("thread").cast("long") % 11 == 0)
    out = records.classify_threads(x, NOW)
    return out.select("thread", F.size("invalid_lines").alias("invalid"), "started_at", "last_event_at", "user_messages", "status", "reason")


def _events(spark, d):
    c, n = F.col("conv_id"), F.col("n")
    kind = F.when(F.col("role") == "system", "event").otherwise(F.concat("role", F.lit("_message")))
    actor = F.when(F.col("role") == "system", "tool").otherwise(F.col("role"))
    return _numbered(spark, d).select(
        c.cast("string").alias("thread"), n.alias("ord"), F.format_string("L%06d", n).alias("local_id"), kind.alias("kind"), actor.alias("actor"), F.lit("").alias("name"),
        F.coalesce("text", F.lit("")).alias("text"), _stamp(c, n).alias("timestamp"), F.concat(F.lit("t"), n).alias("turn_id"), F.lit("/Work/X/").alias("cwd"), F.lit("/Work").alias("thread_cwd"),
    )


def thread_fingerprints(spark, d):
    return histories.fingerprint_events(_events(spark, d), F.concat(F.lit("sessions/"), "thread"))


def history_branches(spark, d):
    docs = _t(spark, d, "documents").filter("text IS NOT NULL").select(F.concat("source", F.lit("-"), F.coalesce("lang", F.lit("none"))).alias("thread"), "doc_id", F.col("text").cast("binary").alias("content"))
    c = capture.with_digest(docs).groupBy("thread", "sha256").agg(F.min("doc_id").alias("doc_id"))
    at = F.when(F.col("doc_id") % 5 == 0, "unknown").otherwise(_stamp(F.col("doc_id"), F.col("doc_id")))
    b = histories.history_branches(c.withColumn("started_at", at))
    return b.select("thread", "doc_id", "branch", "branch_id")


def event_sizes(spark, d):
    return _events(spark, d).select("thread", "local_id", inputs.event_size().alias("size"))


def _chunks(spark, d):
    return inputs.chunk_events(inputs.split_events(inputs.prepare_events(_events(spark, d)), BUDGET), BUDGET)


def input_chunks(spark, d):
    return inputs.input_manifest(_chunks(spark, d))


def input_metrics(spark, d):
    """Split events and characters follow from sizes alone; chunks are counted by brute
    force in the tests."""
    return inputs.input_metrics(_chunks(spark, d)).select("thread", "split_events", "characters", "prepared_characters")


def _items(spark, d):
    e = _events(spark, d)
    text = F.concat(F.when(F.col("ord") % 6 == 0, F.lit("see `./missing/x` ")).otherwise(""), "text")
    end = F.when(F.col("ord") % 5 == 0, F.format_string("L%06d", F.col("ord") + 1)).otherwise(F.col("local_id"))
    return e.filter("thread % 4 <> 3 OR ord <> 2").select("thread", F.col("ord").alias("pos"), F.col("local_id").alias("start_id"), end.alias("end_id"), F.array("local_id", end).alias("event_ids"), text.alias("text"), F.lit("Note").alias("label"))


def timeline_faults(spark, d):
    return summaries.validate_timeline(_items(spark, d), _events(spark, d))


def timelines(spark, d):
    good = _items(spark, d).withColumn("end_id", F.col("start_id")).withColumn("text", F.coalesce(F.nullif(T.strip(F.col("text")), F.lit("")), F.lit("none")))
    t = summaries.render_timeline(good, _events(spark, d), "Times at +09:00.")
    return t.select("thread", F.md5(F.col("timeline").cast("binary")).alias("timeline_md5"))


def summary_faults(spark, d):
    e = _events(spark, d)
    k = F.col("thread").cast("long")
    cite = F.when((k % 9 == 0) & (F.col("ord") == 1), "L999999").otherwise(F.col("local_id"))
    item = F.struct(F.when((k % 8 == 0) & (F.col("ord") == 1), " ").otherwise(F.col("text")).alias("text"), F.lit("Note").alias("label"), F.array(cite).alias("event_ids"), F.lit(None).cast("string").alias("start_id"), F.lit(None).cast("string").alias("end_id"))
    state = F.struct(F.when(k % 2 == 0, "done").otherwise("open").alias("work_state"), F.when(k % 6 == 0, F.array(F.lit("x"))).otherwise(F.array().cast("array<string>")).alias("unresolved"), F.lit("").alias("continuation"), F.when(k % 7 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("L000001"))).alias("event_ids"))
    s = e.groupBy("thread").agg(F.collect_list(item).alias("items")).withColumn("state", state)
    return summaries.validate_summary(s, e.groupBy("thread").agg(F.collect_set("local_id").alias("event_ids")))


def note_front_matter(spark, d):
    note = F.concat(F.lit("---\nid: "), F.col("doc_id"), F.lit("\nsource: '"), F.coalesce("source", F.lit("")), F.lit("'\ntags: []\n  skipped: x\nsource: \""), F.coalesce("lang", F.lit("")), F.lit('"\n---\n'), F.coalesce(F.regexp_replace("text", "\r\n|\r", "\n"), F.lit("")))
    meta, body = logs.front_matter(note)
    return _t(spark, d, "documents").select("doc_id", meta["id"].alias("id"), meta["source"].alias("last_source"), meta["tags"].alias("tags"), F.size(meta).alias("keys"), F.md5(body.cast("binary")).alias("body_md5"))


def manifest_faults(spark, d):
    k = F.col("doc_id")
    ref = F.concat(F.when(k % 3 == 0, "archived_sessions/").when(k % 3 == 1, "sessions/").otherwise(""), F.when(k % 17 == 0, "../").otherwise(""), k, F.lit(".jsonl"))
    rows = _t(spark, d, "documents").select(
        k, F.when(k % 13 == 0, 9).otherwise(3).alias("schemaVersion"), F.lit("acme").alias("sourceProvider"), F.when(k % 19 == 0, "other").otherwise("main").alias("sourceId"), ref.alias("sourceRef"),
        F.when(k % 11 == 0, F.lit("x")).otherwise(F.sha2(k.cast("string"), 256)).alias("sha256"), F.when(k % 23 == 0, -1).otherwise(F.col("n_chars")).alias("byteCount"),
    )
    full = rows.withColumn("captureRef", F.concat(F.lit("raw:/acme/main/"), F.when(k % 3 == 2, "sessions/").otherwise(""), "sourceRef"))
    return logs.check_manifest(full, "main", "acme").filter("fault IS NOT NULL").select("doc_id", "fault")


def revalidated(spark, d):
    c = capture.with_digest(_t(spark, d, "documents").select(F.col("source").alias("thread"), F.col("doc_id").alias("source_ref"), F.col("text").cast("binary").alias("content"))).select("thread", "source_ref", "sha256")
    now = c.filter("source_ref % 97 <> 5").withColumn("sha256", F.when(F.col("source_ref") % 101 == 7, F.lit("changed")).otherwise(F.col("sha256")))
    return planning.revalidate(c.withColumn("thread", F.concat("thread", F.lit("-"), F.col("source_ref") % 50)), now)


def verified_captures(spark, d):
    c = capture.with_digest(_t(spark, d, "documents").select("source", F.col("doc_id").alias("source_ref"), F.col("text").cast("binary").alias("content")))
    m = c.select(F.col("source").alias("source_id"), "source_ref", F.when(F.col("source_ref") % 7 == 0, "x").otherwise(F.col("sha256")).alias("sha256"), F.lit(1).alias("line_no"))
    return capture.verify_captures(m, c.filter("source_ref % 5 <> 0").select("source_ref", "sha256"), c.filter("source_ref % 11 = 0"))


def scanned(spark, d):
    """Customers as threads with what a scan asks of each."""
    c = _t(spark, d, "customer")
    k = F.col("c_custkey")
    t = c.select(k.alias("thread"), F.when(k % 3 == 0, F.col("c_nationkey")).alias("assigned"))
    o = _t(spark, d, "orders").select(F.col("o_custkey").alias("thread"), F.pmod("o_orderkey", F.lit(25)).cast("int").alias("project")).filter("project < 3")
    m = attribution.membership(t, t.filter("thread % 10 = 0"), o)
    k = F.col("thread")
    change = F.when(k % 8 == 2, "unchanged").when(k % 8 == 3, "stale-generator").otherwise("eligible")
    more = {"in_time": k % 4 != 1, "internal": k % 9 == 2, "user_messages": k % 6, "project_user_messages": k % 2, "has_time": k % 16 != 7, "foreign": k % 23 == 8, "selected": k % 29 != 4, "change": change, "project_events": k % 7}
    return m.withColumns(more)


def scan_counts(spark, d):
    return planning.scan_candidates(scanned(spark, d))[1]


def registry_refresh(spark, d):
    n = _t(spark, d, "customer").select(F.col("c_custkey").cast("int").alias("n_nationkey"), F.col("c_name").alias("n_name"))
    k = F.col("n_nationkey").cast("int")
    root = F.concat(F.lit("/work/"), F.lower("n_name"))
    reg = n.filter(k % 5 != 0).select(k.alias("project"), F.concat(F.lit("old "), "n_name").alias("name"), F.array(root).alias("roots"), F.array(F.upper(root), F.lit("/was/")).alias("aliases"), _json(note=F.col("n_name")).alias("extra"))
    now = n.filter(k % 4 != 0).select(k.alias("project"), F.col("n_name").alias("name"), F.when(k % 2 == 0, F.array(root)).otherwise(F.array(F.lit("/new"))).alias("roots"))
    r = projects.refresh_registry(reg, now)
    return r.select("project", "name", F.array_join("roots", "|").alias("roots"), F.array_join("aliases", "|").alias("aliases"), "extra", "status", "method")


def membership_history(spark, d):
    o = _t(spark, d, "orders")
    first = o.groupBy("o_custkey").agg(F.min(F.pmod("o_orderkey", F.lit(3)).cast("int")).alias("p"))
    last = o.groupBy("o_custkey").agg(F.max(F.pmod("o_orderkey", F.lit(3)).cast("int")).alias("p"))
    see = lambda x, at: x.select(F.lit("s").alias("source_id"), F.col("o_custkey").alias("thread"), F.lit("explicit").alias("kind"), F.col("p").alias("project"), F.lit(at).alias("at"))
    empty = see(first, "").select("source_id", "thread", F.array(F.struct("kind", "project", "at")).alias("history")).limit(0)
    h = projects.append_history(projects.append_history(empty, see(first.filter("o_custkey % 5 <> 0"), "1")), see(last.filter("o_custkey % 7 <> 0"), "2"))
    return h.select("thread", F.array_join(F.transform("history", lambda x: F.concat_ws(":", x["at"], x["project"].cast("string"))), ",").alias("seen"))


def resolved_refs(spark, d):
    p = _t(spark, d, "pages").select("page_id", F.regexp_replace(F.regexp_replace("url", "^https?://", ""), "[?#].*$", "").alias("ref"))
    a = p.select(F.concat(F.substring_index("ref", "/", 1), F.lit("/")).alias("prefix"), F.lit("host/").alias("target")).union(p.filter("page_id % 2 = 0").select(F.concat(F.substring_index("ref", "/", 2), F.lit("/")), F.lit("lang/"))).distinct()
    return projects.resolve_refs(p, a).select("page_id", "target")


def note_changes(spark, d):
    c = _t(spark, d, "customer").select(F.col("c_custkey").alias("thread"), F.md5(F.col("c_custkey").cast("string").cast("binary")).alias("fingerprint"), F.col("c_nationkey").cast("string").alias("capture_sha256"), F.lit(None).cast("string").alias("source_set_sha256"))
    new = c.withColumn("generation", planning.generation_fingerprint({"model": "m", "version": 1}))
    k = F.col("thread")
    old = new.filter("thread % 5 <> 0").withColumn("fingerprint", F.when(k % 3 == 0, "late").otherwise(F.col("fingerprint"))).withColumn("generation", F.when(k % 4 == 0, "old").otherwise(F.col("generation")))
    return planning.classify_change(new, old).select("thread", "generation", "change")


def rebuild_plan(spark, d):
    li = _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("thread"), F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey").alias("note_id"), F.when(F.col("l_linenumber") < 7, F.col("l_linenumber")).cast("int").alias("version"), F.col("l_returnflag").alias("fingerprint"), F.col("l_partkey").alias("byte_count"))
    c = _t(spark, d, "orders").filter("o_orderkey % 3 <> 0").select(F.col("o_orderkey").alias("thread"), F.lit("R").alias("fingerprint")).union(_t(spark, d, "orders").select(-F.col("o_orderkey") - 1, F.lit("R")))
    return planning.rebuild_plan(c, li, 4)


def ledger_update(spark, d):
    o = _t(spark, d, "orders").select(F.col("o_orderkey").alias("thread"), "o_orderstatus", "o_custkey")
    old = o.filter("thread % 3 <> 0").select("thread", F.lit("current").alias("status"), F.lit("g1").alias("generation"), F.col("o_custkey").cast("string").alias("note_id"))
    res = o.filter("thread % 4 <> 0").select("thread", F.when(F.col("o_orderstatus") == "F", "failed").otherwise("current").alias("status"), F.lit("g2").alias("generation"), F.lit("new").alias("note_id"))
    return planning.update_ledger(old, res)


def _digests(spark, d):
    return capture.with_digest(_t(spark, d, "documents").select(F.col("doc_id").alias("id"), "source", F.col("text").cast("binary").alias("content"))).drop("content")


def entity_keys(spark, d):
    return provenance.make_entities(_digests(spark, d)).select("id", "version", "snapshot_ref", "entity_key")


def entity_faults(spark, d):
    e = provenance.make_entities(_digests(spark, d))
    s = e.groupBy("snapshot_ref").agg(F.min("sha256").alias("sha256"), F.min("byte_count").alias("byte_count"), F.min("id").alias("k"))
    kept = s.filter("k % 31 <> 3").withColumn("byte_count", F.when(F.col("k") % 37 == 5, F.col("byte_count") + 1).otherwise(F.col("byte_count")))
    bad = e.withColumn("version", F.when(F.col("id") % 41 == 1, "sha256:0").otherwise(F.col("version")))
    found = bad.unionByName(e.filter("id % 43 = 2"))
    return provenance.validate_entities(found, kept).unionByName(provenance.repeated_artifacts(found))


def relation_faults(spark, d):
    li = _t(spark, d, "lineitem")
    edges = li.select(F.col("l_orderkey").alias("activity"), F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"), F.when(F.col("l_partkey") % 50 == 0, "other").otherwise("derivedFrom").alias("type")).distinct()
    used = li.filter("l_linenumber <> 3").select(F.col("l_orderkey").alias("activity"), F.col("l_partkey").alias("entity"))
    made = li.filter("l_linenumber <> 5").select(F.col("l_orderkey").alias("activity"), F.col("l_suppkey").alias("entity"))
    return provenance.validate_relations(edges, used, made)


def copy_states(spark, d):
    f = _digests(spark, d).select(F.concat(F.lit("raw/"), "id").alias("path"), "id", "sha256")
    there = f.filter("id % 3 <> 0").withColumn("sha256", F.when(F.col("id") % 5 == 0, "x").otherwise(F.col("sha256"))).union(f.filter("id % 7 = 0").withColumn("path", F.concat(F.lit("more/"), "path")))
    return provenance.verify_copy(f, there)


def relocated(spark, d):
    a = _digests(spark, d).select("id", "source", F.col("id").alias("activity"), "sha256", F.when(F.col("id") % 6 == 0, "x").otherwise(F.col("sha256")).alias("now_sha256"))
    acts = a.select("activity", "source", (F.col("id") + 1).alias("entity"))
    own, _, ents = provenance.relocate_store(a, acts, a.select(F.col("id").alias("entity")), "src1")
    return ents.join(own.select(F.col("id").alias("entity"), "status"), "entity", "left")


QUERIES = {
    f.__name__: f
    for f in (
        log_events, log_threads, thread_fingerprints, history_branches, event_sizes, input_chunks, input_metrics, timeline_faults, timelines, summary_faults, note_front_matter, manifest_faults,
        revalidated, verified_captures, scan_counts, registry_refresh, membership_history, resolved_refs, note_changes, rebuild_plan, ledger_update, entity_keys, entity_faults, relation_faults, copy_states, relocated,
    )
}


def _sql_stamp(c, n):
    return f"'2026-01-' || lpad(({c} % 28 + 1)::VARCHAR, 2, '0') || 'T' || lpad(({n} % 24)::VARCHAR, 2, '0') || ':' || lpad(({c} % 60)::VARCHAR, 2, '0') || ':00Z'"


_STRIP = f"regexp_replace(text, '^{_SPACE}|{_SPACE}$', '', 'g')"
_NUM = "e AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS n FROM conversations)"
_EV = f"""{_NUM}, v AS (SELECT conv_id, conv_id::VARCHAR AS thread, n, 'L' || lpad(n::VARCHAR, 6, '0') AS id, CASE role WHEN 'system' THEN 'event' ELSE role || '_message' END AS kind,
 CASE role WHEN 'system' THEN 'tool' ELSE role END AS actor, coalesce(text, '') AS text, {_sql_stamp("conv_id", "n")} AS tm FROM e)"""
_GENERATOR = planning.generator_fingerprint({"model": "m", "version": 1})
_KINDS = """t AS (SELECT c_custkey AS thread, CASE WHEN c_custkey % 3 = 0 THEN c_nationkey END AS assigned FROM customer),
o AS (SELECT o_custkey AS thread, count(DISTINCT o_orderkey % 25) AS n FROM orders WHERE o_orderkey % 25 < 3 GROUP BY 1),
k AS (SELECT thread, CASE WHEN thread % 10 = 0 THEN 'projectless' WHEN assigned IS NOT NULL THEN 'explicit' WHEN n = 1 THEN 'inferred' WHEN n > 1 THEN 'ambiguous' ELSE 'unmatched' END AS kind FROM t LEFT JOIN o USING (thread))"""

SCANNED = f"""{_KINDS}, s AS (SELECT thread, kind, CASE WHEN thread % 16 = 7 THEN 'without-event-time' WHEN thread % 4 = 1 THEN 'time' WHEN thread % 9 = 2 THEN 'approval-or-internal' WHEN thread % 6 = 0 THEN 'without-user-message'
 WHEN kind = 'projectless' THEN kind WHEN thread % 23 = 8 THEN 'assigned-to-other-project' WHEN kind IN ('ambiguous', 'unmatched') THEN kind || '-project' WHEN kind = 'inferred' AND thread % 2 = 0 THEN 'without-project-user-message' WHEN thread % 29 = 4 THEN 'not-selected' END AS reason FROM k)"""
_STRIPPED = f"regexp_replace(regexp_replace(CASE WHEN n % 6 = 0 THEN 'see `./missing/x` ' ELSE '' END || text, '^{_SPACE}', ''), '{_SPACE}$', '')"
_ENDS = r"\r\n|[\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]"
_LINES = f"regexp_replace(regexp_replace(coalesce(nullif({_STRIPPED}, ''), 'none'), '{_ENDS}', chr(10), 'g'), '\\n([^\\n])', chr(10) || '    \\1', 'g')"

ORACLE_SQL = {
    "log_events": f"""WITH {_NUM}, m AS (SELECT conv_id, n, 4 * n AS line, role || '_message' AS kind, role AS actor, '' AS name, {_STRIP} AS t FROM e WHERE role IN ('user', 'assistant') AND {_STRIP} <> ''
 UNION ALL SELECT conv_id, n, 4 * n + 2, CASE role WHEN 'assistant' THEN 'tool_call' ELSE 'tool_result' END, CASE role WHEN 'assistant' THEN 'assistant' ELSE 'tool' END, CASE role WHEN 'assistant' THEN 'look' ELSE 'task_complete' END,
 CASE role WHEN 'assistant' THEN '{{"a":' || conv_id || ',"b":' || n || '}}' ELSE '{{"turn":' || n || '}}' END FROM e)
SELECT conv_id::VARCHAR AS thread, 'L' || lpad(line::VARCHAR, 6, '0') AS local_id, kind, actor, name, 't' || n AS turn_id, CASE WHEN n % 3 = 0 THEN '/work/x' ELSE '/work/' || (conv_id % 5) END AS cwd, {_sql_stamp("conv_id", "n")} AS timestamp, md5(t) AS text_md5 FROM m""",
    "log_threads": f"""WITH {_NUM}, g AS (SELECT conv_id AS c, max(n) AS n, count(*) FILTER (role = 'user' AND {_STRIP} <> '') AS user_messages FROM e GROUP BY 1), s AS (SELECT *, {_sql_stamp("c", "n")} AS last_event_at FROM g),
r AS (SELECT *, CASE WHEN c % 7 = 0 THEN 'invalid-jsonl' WHEN c % 11 = 0 THEN 'approval-or-internal' WHEN user_messages = 0 THEN 'without-user-message' WHEN last_event_at > '2026-01-14T23:30:00Z' THEN 'active-conversation' END AS reason FROM s)
SELECT c::VARCHAR AS thread, (c % 7 = 0)::INTEGER AS invalid, {_sql_stamp("c", "0")} AS started_at, last_event_at, user_messages,
 CASE WHEN reason IS NULL THEN 'pending' WHEN reason = 'invalid-jsonl' THEN 'failed' WHEN reason = 'active-conversation' THEN 'deferred' ELSE 'excluded' END AS status, reason FROM r""",
    "thread_fingerprints": f"""WITH {_EV} SELECT thread, sha256('{{"events":[' || string_agg('{{"actor":"' || actor || '","cwd":"\\\\work\\\\x","id":"' || id || '","kind":"' || kind || '","name":"","text":' || to_json({_NORMAL})::VARCHAR
 || ',"timestamp":"' || tm || '","turnId":"t' || n || '"}}', ',' ORDER BY n) || '],"id":"' || thread || '","sourceRef":"sessions/' || thread || '"}}') AS fingerprint FROM v GROUP BY thread""",
    "history_branches": f"""WITH c AS (SELECT source || '-' || coalesce(lang, 'none') AS thread, sha256(text) AS s, min(doc_id) AS doc_id FROM documents WHERE text IS NOT NULL GROUP BY 1, 2),
a AS (SELECT *, doc_id % 5 = 0 AS u, CASE WHEN doc_id % 5 = 0 THEN 'unknown' ELSE {_sql_stamp("doc_id", "doc_id")} END AS tm, count(*) OVER (PARTITION BY thread) AS n FROM c)
SELECT thread, doc_id, (row_number() OVER (PARTITION BY thread ORDER BY u, tm, s))::INTEGER AS branch, CASE WHEN n > 1 THEN 'H' || substr(s, 1, 16) END AS branch_id FROM a""",
    "event_sizes": f"""WITH {_EV} SELECT thread, id AS local_id, length('{{"id": "' || id || '", "kind": "' || kind || '", "actor": "' || actor || '", "name": "", "text": ' || to_json(text)::VARCHAR || ', "timestamp": "' || tm || '", "turnId": "t' || n || '"}}')::INTEGER AS size FROM v""",
    "input_metrics": f"""WITH {_EV}, r AS (SELECT *, {_REDACT} AS x FROM v) SELECT thread, count(*) FILTER (length('{{"id": "' || id || '", "kind": "' || kind || '", "actor": "' || actor || '", "name": "", "text": ' || to_json(x)::VARCHAR || ', "timestamp": "' || tm || '", "turnId": "t' || n || '"}}') + 2 > {BUDGET}) AS split_events,
 sum(length(x))::BIGINT AS characters, sum(length(x))::BIGINT AS prepared_characters FROM r GROUP BY thread""",
    "timeline_faults": f"""WITH {_EV}, i AS (SELECT thread, n, CASE WHEN n % 5 = 0 THEN n + 1 ELSE n END AS z FROM v WHERE conv_id % 4 <> 3 OR n <> 2),
f AS (SELECT i.thread, i.n::INTEGER AS pos, CASE WHEN b.n IS NULL THEN 'unknown-endpoint' WHEN i.n % 6 = 0 THEN 'path-not-in-source' WHEN i.n <> i.z THEN 'range' END AS fault FROM i LEFT JOIN v b ON b.thread = i.thread AND b.n = i.z)
SELECT * FROM f WHERE fault IS NOT NULL UNION ALL SELECT DISTINCT thread, NULL::INTEGER, 'user-message-missing' FROM v WHERE conv_id % 4 = 3 AND n = 2 AND kind = 'user_message'""",
    "timelines": f"""WITH {_EV}, i AS (SELECT *, {_LINES} AS x, strptime(tm, '%Y-%m-%dT%H:%M:%SZ') + INTERVAL 9 HOUR AS j FROM v WHERE conv_id % 4 <> 3 OR n <> 2), p AS (SELECT *, lag(j::DATE) OVER (PARTITION BY thread ORDER BY n) AS before FROM i),
b AS (SELECT thread, n, CASE WHEN before IS NOT DISTINCT FROM j::DATE THEN '' ELSE '### ' || j::DATE || chr(10) || chr(10) END || replace('- **' || strftime(j, '%H:%M:%S') || '**|  - Actor: ' || CASE actor WHEN 'user' THEN 'User' WHEN 'assistant' THEN 'AI' ELSE 'Tool' END
 || '|  - Type: Note|  - Text: ', '|', chr(10)) || x || replace('|  - EventRange: ' || id || ' -> ' || id || '|  - Sources: ' || id || CASE WHEN n % 5 = 0 THEN ', L' || lpad((n + 1)::VARCHAR, 6, '0') ELSE '' END, '|', chr(10)) AS block FROM p)
SELECT thread, md5('Times at +09:00.' || chr(10) || chr(10) || string_agg(block, chr(10) || chr(10) ORDER BY n)) AS timeline_md5 FROM b GROUP BY thread""",
    "summary_faults": f"""WITH {_EV} SELECT thread, CASE WHEN conv_id % 6 = 0 THEN 'done-but-open' WHEN conv_id % 7 = 0 THEN 'state-without-source' WHEN conv_id % 8 = 0 OR bool_or({_STRIP} = '') THEN 'item-without-source' WHEN conv_id % 9 = 0 THEN 'unknown-event' END AS fault FROM v GROUP BY conv_id, thread""",
    "note_front_matter": r"""SELECT doc_id, doc_id::VARCHAR AS id, coalesce(lang, '') AS last_source, '' AS tags, 3::INTEGER AS keys, md5(regexp_replace(coalesce(text, ''), '\r\n|\r', chr(10), 'g')) AS body_md5 FROM documents""",
    "manifest_faults": """WITH f AS (SELECT doc_id, CASE WHEN doc_id % 13 = 0 THEN 'schema-version' WHEN doc_id % 19 = 0 THEN 'source-id' WHEN doc_id % 11 = 0 THEN 'digest' WHEN doc_id % 23 = 0 OR n_chars IS NULL THEN 'size' WHEN doc_id % 17 = 0 THEN 'capture-ref' END AS fault FROM documents) SELECT * FROM f WHERE fault IS NOT NULL""",
    "revalidated": """SELECT source || '-' || (doc_id % 50) AS thread, bool_and(text IS NOT NULL AND doc_id % 97 <> 5 AND doc_id % 101 <> 7) AS valid FROM documents GROUP BY 1""",
    "verified_captures": """WITH f AS (SELECT doc_id AS source_ref, CASE WHEN doc_id % 11 = 0 THEN 'blocked' WHEN doc_id % 5 = 0 OR text IS NULL THEN 'missing' WHEN doc_id % 7 = 0 THEN 'digest' END AS fault FROM documents) SELECT * FROM f WHERE fault IS NOT NULL""",
    "scan_counts": f"""WITH {SCANNED} SELECT count(*) AS files, count(*) FILTER (reason IS NULL AND thread % 8 <> 2) AS eligible, count(*) FILTER (reason IS NULL AND thread % 8 = 2) AS unchanged, count(*) FILTER (reason IS NULL AND thread % 8 = 3) AS stale_generator,
 count(*) FILTER (reason IS NOT NULL) AS ignored, count(*) FILTER (reason = 'without-event-time') AS without_event_time, count(*) FILTER (reason = 'approval-or-internal') AS approval_or_internal, count(*) FILTER (reason = 'without-user-message') AS without_user_message,
 count(*) FILTER (kind = 'explicit' AND coalesce(reason IN ('not-selected', 'without-project-user-message'), true)) AS assigned, count(*) FILTER (reason = 'ambiguous-project') AS ambiguous, count(*) FILTER (reason = 'projectless') AS projectless,
 count(*) FILTER (reason IN ('unmatched-project', 'assigned-to-other-project')) AS unmatched FROM s""",
    "registry_refresh": """WITH n AS (SELECT n_nationkey::INTEGER AS k, n_name, '/work/' || lower(n_name) AS root, n_nationkey % 5 <> 0 AS r, n_nationkey % 4 <> 0 AS p FROM (SELECT c_custkey AS n_nationkey, c_name AS n_name FROM customer) WHERE n_nationkey % 20 <> 0)
SELECT k AS project, CASE WHEN p THEN n_name ELSE 'old ' || n_name END AS name, CASE WHEN p AND k % 2 = 1 THEN '/new' ELSE root END AS roots, CASE WHEN NOT r THEN '' WHEN p AND k % 2 = 0 THEN '/was/' ELSE upper(root) || '|/was/' END AS aliases,
 CASE WHEN r THEN '{"note":"' || n_name || '"}' END AS extra, CASE WHEN p THEN 'bound' ELSE 'inactive' END AS status, CASE WHEN p AND NOT r THEN 'new' WHEN p THEN 'project-id' END AS method FROM n""",
    "membership_history": """WITH g AS (SELECT o_custkey AS thread, min(o_orderkey % 3) AS a, max(o_orderkey % 3) AS b FROM orders GROUP BY 1 HAVING o_custkey % 5 <> 0 OR o_custkey % 7 <> 0)
SELECT thread, concat_ws(',', CASE WHEN thread % 5 <> 0 THEN '1:' || a END, CASE WHEN thread % 7 <> 0 AND (thread % 5 = 0 OR a <> b) THEN '2:' || b END) AS seen FROM g""",
    "resolved_refs": r"""WITH p AS (SELECT page_id, string_split(regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', ''), '/') AS s FROM pages), a AS (SELECT DISTINCT array_to_string(s[1:2], '/') AS two FROM p WHERE page_id % 2 = 0)
SELECT page_id, CASE WHEN list_has_any(s, ['', '.', '..']) OR contains(array_to_string(s, '/'), ':') OR contains(array_to_string(s, '/'), '\') THEN NULL
 WHEN len(s) > 2 AND array_to_string(s[1:2], '/') IN (SELECT two FROM a) THEN 'lang/' || array_to_string(s[3:], '/') WHEN len(s) > 1 THEN 'host/' || array_to_string(s[2:], '/') ELSE s[1] END AS target FROM p""",
    "note_changes": f"""SELECT c_custkey AS thread, sha256(md5(c_custkey::VARCHAR) || ':' || c_nationkey || '::{_GENERATOR}') AS generation, CASE WHEN c_custkey % 5 = 0 OR c_custkey % 3 = 0 THEN 'eligible' WHEN c_custkey % 4 = 0 THEN 'stale-generator' ELSE 'unchanged' END AS change FROM customer""",
    "rebuild_plan": """WITH n AS (SELECT l_orderkey AS thread, concat_ws('-', l_orderkey, l_linenumber, l_partkey) AS note_id, CASE WHEN l_linenumber < 7 THEN l_linenumber END AS v, l_returnflag AS f, l_partkey AS b FROM lineitem),
r AS (SELECT *, row_number() OVER (PARTITION BY thread ORDER BY coalesce(v, 0) DESC, note_id) AS rn FROM n),
g AS (SELECT thread, count(*) FILTER (v = 4) AS current, count(*) FILTER (v < 4) AS older, count(*) FILTER (v IS NULL OR v > 4) AS unknown, sum(b)::BIGINT AS note_bytes, any_value(note_id) FILTER (rn = 1) AS note_id, any_value(v) FILTER (rn = 1) AS v, any_value(f) FILTER (rn = 1) AS f FROM r GROUP BY 1),
c AS (SELECT o_orderkey AS thread FROM orders WHERE o_orderkey % 3 <> 0 UNION ALL SELECT -o_orderkey - 1 FROM orders)
SELECT coalesce(c.thread, g.thread) AS thread, CASE WHEN c.thread IS NULL THEN 'preserved' WHEN g.thread IS NULL THEN 'new' WHEN v = 4 AND f = 'R' THEN 'reusable' ELSE 'replaced' END AS action, note_id,
 coalesce(current, 0) AS current, coalesce(older, 0) AS older, coalesce(unknown, 0) AS unknown, coalesce(note_bytes, 0) AS note_bytes FROM c FULL JOIN g ON c.thread = g.thread""",
    "ledger_update": """WITH x AS (SELECT o_orderkey AS thread, o_orderkey % 3 <> 0 AS old, CASE WHEN o_orderkey % 4 <> 0 THEN CASE o_orderstatus WHEN 'F' THEN 'failed' ELSE 'current' END END AS r, o_custkey FROM orders)
SELECT thread, coalesce(r, 'current') AS status, CASE WHEN r = 'current' THEN 'g2' WHEN old THEN 'g1' END AS generation, CASE WHEN r = 'current' THEN 'new' WHEN old THEN o_custkey::VARCHAR END AS note_id FROM x WHERE old OR r IS NOT NULL""",
    "entity_keys": r"""WITH d AS (SELECT doc_id AS id, sha256(text) AS s FROM documents) SELECT id, 'sha256:' || s AS version, 'data:/blobs/' || substr(s, 1, 2) || '/' || s AS snapshot_ref, sha256(encode(id::VARCHAR) || '\x00'::BLOB || encode(s)) AS entity_key FROM d""",
    "entity_faults": """WITH d AS (SELECT doc_id AS id, sha256(text) AS s FROM documents), k AS (SELECT s, min(id) AS k FROM d GROUP BY 1), u AS (SELECT *, id % 41 = 1 AS bad FROM d UNION ALL SELECT *, false FROM d WHERE id % 43 = 2),
f AS (SELECT id, CASE WHEN bad THEN 'version' WHEN k % 31 = 3 THEN 'snapshot-missing' WHEN k % 37 = 5 THEN 'snapshot-corrupt' END AS fault FROM u JOIN k USING (s))
SELECT * FROM f WHERE fault IS NOT NULL UNION ALL SELECT id, 'duplicate-id' FROM d WHERE id % 43 = 2""",
    "relation_faults": """WITH x AS (SELECT DISTINCT l_orderkey AS activity, l_partkey AS src, l_suppkey AS dst FROM lineitem), u AS (SELECT DISTINCT l_orderkey AS activity, l_partkey AS src, 1 AS u FROM lineitem WHERE l_linenumber <> 3), g AS (SELECT DISTINCT l_orderkey AS activity, l_suppkey AS dst, 1 AS g FROM lineitem WHERE l_linenumber <> 5),
f AS (SELECT activity, src, dst, CASE WHEN src % 50 = 0 THEN 'type' WHEN g IS NULL THEN 'unknown-generated' WHEN u IS NULL THEN 'unknown-used' END AS fault FROM x LEFT JOIN u USING (activity, src) LEFT JOIN g USING (activity, dst)) SELECT * FROM f WHERE fault IS NOT NULL""",
    "copy_states": """SELECT 'raw/' || doc_id AS path, CASE WHEN doc_id % 3 = 0 THEN 'to-copy' WHEN doc_id % 5 = 0 THEN 'conflict' ELSE 'same' END AS state FROM documents UNION ALL SELECT 'more/raw/' || doc_id, 'extra' FROM documents WHERE doc_id % 7 = 0""",
    "relocated": """WITH o AS (SELECT doc_id AS id FROM documents WHERE source = 'src1'), r AS (SELECT id FROM o UNION SELECT id + 1 FROM o)
SELECT doc_id AS entity, CASE WHEN doc_id NOT IN (SELECT id FROM o) THEN NULL WHEN doc_id % 6 = 0 THEN 'protected' ELSE 'current' END AS status FROM documents WHERE doc_id IN (SELECT id FROM r)""",
}
