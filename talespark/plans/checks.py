"""Queries over checks of notes, scans, registries and references, and SQL that states the
same results. Tables stand for the library's own as in ``registry``.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from talespark.functions import text as T
from talespark.operators import histories, inputs, planning, provenance, records, summaries, threads
from talespark.plans.evidence import SCANNED, _numbered, scanned
from talespark.plans.registry import _NORMAL, _SPACE
from talespark.plans.workflow import _t
from talespark.sources import logs

MOVED = {"/old/raw": "/new/raw", "/old/raw/deep": "/far/deep", "/old/data": "/new/data"}
SETTINGS = {"generator": "g", "generatorModel": "m"}


def repository_forms(spark, d):
    """The same repositories as ssh, scp and https addresses, with slashes either way."""
    p, k = _t(spark, d, "pages"), F.col("page_id") % 4
    host, path = F.regexp_extract("url", "^https?://([^/]*)", 1), F.regexp_replace("url", "^https?://[^/]*/?", "")
    url = F.when(k == 0, F.concat(F.lit(" git@"), host, F.lit(":"), path, F.lit(".git/ "))).when(k == 1, F.concat(F.lit("SSH://git@"), host, F.lit("/"), path, F.lit(".GIT//"))).when(k == 2, F.concat("url", F.lit("/"))).otherwise(F.replace("url", F.lit("/"), F.lit("\\")))
    return p.select("page_id", T.normalize_git_remote(url).alias("remote"))


def event_locators(spark, d):
    """Every third conversation has branches."""
    c = _t(spark, d, "conversations")
    local = F.format_string("L%06d", F.col("turn") + 1)
    e = c.select(
        F.concat(F.lit("k"), "conv_id").alias("thread_key"), F.md5(F.col("conv_id").cast("string")).alias("sha256"), local.alias("local_id"), F.when(F.col("conv_id") % 2 == 0, F.concat(F.lit("raw:/p/"), "conv_id")).alias("capture_ref"),
        F.when(F.col("conv_id") % 3 == 0, F.concat(F.lit("H1-"), local)).alias("event_id"),
    )
    return histories.canonical_ids(e).select("canonical_id", "raw_locator")


def old_messages(spark, d):
    """Conversations as files of the old form: the header's time stands for missing ones."""
    n = _numbered(spark, d).select(F.col("conv_id").cast("string").alias("thread"), (F.col("n") + 1).cast("int").alias("line_no"), "conv_id", "role", "text")
    at = F.when(F.col("line_no") % 2 == 0, F.concat(F.lit("time "), "line_no"))
    said = n.select("thread", "line_no", F.to_json(F.struct(F.lit("message").alias("type"), "role", F.col("text").alias("content"), at.alias("timestamp"))).alias("raw"))
    head = n.filter("line_no = 2").select("thread", F.lit(1).alias("line_no"), F.to_json(F.struct(F.col("thread").alias("id"), F.lit("do").alias("instructions"), F.concat(F.lit("start "), "thread").alias("timestamp"))).alias("raw"))
    m = records.thread_messages(said.unionByName(head), "thread")
    return m.select("thread", "line_no", "role", F.md5(F.col("text").cast("binary")).alias("text_md5"), "timestamp")


def user_messages(spark, d):
    """Files with folders of threads and turns; each message comes twice, as a response item,
    of a third type each, and as an event."""
    n = _numbered(spark, d).select("conv_id", F.col("n").cast("int").alias("n"), "role", "text")
    base = F.concat(F.lit("/w/"), "conv_id")
    line = lambda no, *values: F.struct((3 * F.col("n") + no).alias("line_no"), F.to_json(F.struct(*values)).alias("raw"))
    payload = lambda kind, *values: (F.lit(kind).alias("type"), F.struct(*values).alias("payload"))
    head = F.when(F.col("n") > 1, F.lit(None)).when(F.col("conv_id") % 3 == 0, line(-2, F.lit("x").alias("id"), F.lit("").alias("instructions"), base.alias("cwd"))).otherwise(line(-2, *payload("session_meta", base.alias("cwd"))))
    turn = F.when(F.col("n") % 2 == 1, line(-1, *payload("turn_context", F.concat(F.lit("t"), "n").alias("turn_id"), F.when(F.col("n") % 4 == 1, F.concat(base, F.lit("/"), "n")).alias("cwd"))))
    kind = F.when(F.col("n") % 3 == 0, "message").when(F.col("n") % 3 == 2, "function_call")
    item = line(F.when(F.col("n") % 5 == 0, 1).otherwise(0), *payload("response_item", kind.alias("type"), "role", F.col("text").alias("content")))
    mirror = F.when(F.col("role").isin("user", "assistant"), line(F.when(F.col("n") % 5 == 0, 0).otherwise(1), *payload("event_msg", F.when(F.col("role") == "user", "user_message").otherwise("agent_message").alias("type"), F.col("text").alias("message"))))
    lines = n.select(F.col("conv_id").alias("thread"), F.explode(F.array_compact(F.array(head, turn, item, mirror))).alias("x")).select("thread", "x.*")
    m = threads.messages_of(records.thread_messages(lines, "thread"), "user")
    return m.select("thread", "line_no", "turn_id", "source", "cwd", F.md5(F.col("text").cast("binary")).alias("text_md5"))


def history_origins(spark, d):
    """Two headers a file; the first one counts, whatever form its base has."""
    k = F.col("doc_id")
    base = F.when(k % 3 == 0, F.concat(F.lit('{"b": 1, "a": "'), k, F.lit('"}'))).when(k % 3 == 1, F.concat(F.lit('"t'), k, F.lit('"'))).otherwise("null")
    lines = _t(spark, d, "documents").select(k.cast("string").alias("thread"), F.explode(F.array(*(F.struct(F.lit(i).alias("line_no"), F.concat(F.lit('{"type": "session_meta", "payload": {"history_base": '), b, F.lit("}}")).alias("raw")) for i, b in ((9, F.lit('"later"')), (2, base))))).alias("x"))
    return records.history_bases(records.parse_lines(lines.select("thread", "x.*")), "thread")


def merged_summaries(spark, d):
    """Events with three kinds of times; of these, one has a zone."""
    n = _numbered(spark, d).select(F.col("conv_id").alias("thread"), F.col("n").alias("ord"), F.format_string("L%06d", "n").alias("local_id"), F.coalesce("role", F.lit("")).alias("role"), "text")
    at = F.when(F.col("ord") % 3 == 0, "2024-01-01T00:00:00Z").when(F.col("ord") % 3 == 1, "2024-01-01T00:00:00")
    parts = n.select("thread", F.col("ord").alias("chunk"), F.array("text").alias("timeline"), F.when(F.col("role") != "system", F.array("role")).alias("limitations"))
    m = inputs.merge_partials(parts, n.filter("thread % 4 <> 0").withColumn("timestamp", at), "en")
    return m.select("thread", F.md5(F.array_join("timeline", "\n").cast("binary")).alias("timeline_md5"), F.array_join("limitations", "|").alias("limitations"))


def scan_excluded(spark, d):
    x = planning.scan_candidates(scanned(spark, d))[2]
    return x.select("thread", "reason", F.array_join(F.col("candidates").cast("array<string>"), ",").alias("candidates"))


def rebuild_counts(spark, d):
    return planning.scan_rebuild(scanned(spark, d))[1]


def rebuild_excluded(spark, d):
    x = planning.scan_rebuild(scanned(spark, d).withColumn("project", F.lit(5)))[2]
    return x.select("thread", "reason", F.array_join(F.col("candidates").cast("array<string>"), ",").alias("candidates"))


def summary_wording(spark, d):
    """Summaries of all messages, some with a phrase that notes avoid."""
    k = F.col("conv_id")
    text = F.concat(F.coalesce("text", F.lit("")), F.when((k % 13 == 1) & (F.col("turn") == 0), " the Actual Execution").otherwise(""))
    item = F.struct(text.alias("text"), F.lit("Note").alias("label"), F.array(F.lit("L1")).alias("event_ids"), F.lit(None).cast("string").alias("start_id"), F.lit(None).cast("string").alias("end_id"))
    more = F.when(F.col("thread") % 13 == 2, "uses supplied EVENTS").otherwise("")
    state = F.struct(F.lit("open").alias("work_state"), F.array(F.lit("x")).alias("unresolved"), more.alias("continuation"), F.array(F.lit("L1")).alias("event_ids"))
    s = _t(spark, d, "conversations").groupBy(k.alias("thread")).agg(F.collect_list(item).alias("items")).withColumn("state", state)
    return summaries.validate_summary(s, s.select("thread", F.array(F.lit("L1")).alias("event_ids")), summaries.AVOIDABLE)


def _notes(spark, d):
    """Documents as sound notes of versions 3 to 6, every fifth with two captures."""
    k = F.col("doc_id")
    h = F.md5(k.cast("string"))
    uuid = F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("4"), F.substring(h, 14, 3)), F.concat(F.lit("a"), F.substring(h, 18, 3)), F.substring(h, 21, 12))
    two = F.array(F.sha2(k.cast("string"), 256), F.sha2(F.concat(F.lit("x"), k), 256))
    version, none = 3 + k % 4, F.array().cast("array<string>")
    several = k % 5 == 0
    meta = {
        "schemaVersion": version.cast("string"), "type": F.when(version == 6, "sessionNote").otherwise("threadNote"), "reviewStatus": F.lit("unreviewed"), "sourceType": F.lit("codexChat"), "automatedValidation": F.lit("passed"), "id": uuid,
        "sourceCaptureRef": F.when(several, "raw:/a"), "sourceCaptureSha256": F.when(several, two[0]), "sourceSetSha256": F.when(several, F.sha2(F.concat(F.lit('["'), F.array_join(F.sort_array(two), '","'), F.lit('"]')), 256)),
        "promptId": F.concat(F.lit("{"), h, F.lit("}")), "promptVersion": F.lit("1"), "templateId": uuid, "templateVersion": F.lit("2"), "outputSchemaSha256": two[1], "sourceFingerprint": h, "status": F.lit("blocked"),
    }
    heads = F.when(version == 6, "# Session Note\n## Summary\n").otherwise("# Thread Note\n## Summary\n"), F.when(version >= 5, "## Timeline\n").otherwise("## Key Developments\n")
    body = F.concat(*heads, F.coalesce("text", F.lit("")), F.lit("\n## Last Known State\n- Work State: blocked now\n"))
    lists = {"thread_ids": F.array(k.cast("string")), "source_refs": F.array(F.lit("s")), "capture_refs": F.when(several, F.array(F.lit("raw:/a"), F.lit("raw:/b"))).otherwise(none), "capture_digests": F.when(several, two).otherwise(none)}
    made = F.create_map(*(x for key, v in meta.items() for x in (F.lit(key), v)))
    return _t(spark, d, "documents").select("doc_id", made.alias("meta"), body.alias("body"), *(v.alias(c) for c, v in lists.items()))


#: Every case changes one thing of the notes whose id leaves that remainder by 29.
NOTE_CASES = [
    ("version", "schemaVersion", "7"), ("type", "type", "note"), ("reviewStatus", "reviewStatus", ""), ("automatedValidation", "automatedValidation", "no"), ("sourceFingerprint", "sourceFingerprint", ""),
    ("promptId", "promptId", "zz"), ("templateVersion", "templateVersion", ""), ("outputSchemaSha256", "outputSchemaSha256", "0"), ("status", "status", "done"), ("captures", "sourceSetSha256", "0"),
]


def _changed(key, value):
    return F.transform_values("meta", lambda a, b: F.when(a == key, value).otherwise(b))


def note_faults(spark, d):
    n, k = _notes(spark, d), F.col("doc_id") % 29
    for i, (_, key, value) in enumerate(NOTE_CASES):
        n = n.withColumn("meta", F.when(k == i, _changed(key, value)).otherwise(F.col("meta")))
    n = n.withColumn("body", F.when(k == 10, F.regexp_replace("body", "\n## Summary\n", "\n## summary\n")).when(k == 11, F.regexp_replace("body", "- Work State: blocked", "- Work State: over")).otherwise(F.col("body")))
    n = n.withColumn("thread_ids", F.when(k == 12, F.array(F.lit("a"), F.lit("b"))).otherwise(F.col("thread_ids"))).withColumn("capture_digests", F.when(k == 13, F.slice("capture_digests", 1, 1)).otherwise(F.col("capture_digests")))
    n = n.withColumn("meta", F.when(k == 14, F.transform_values("meta", lambda a, b: F.when(a == "id", F.upper(b)).when(a == "sourceCaptureRef", "x").otherwise(b))).otherwise(F.col("meta")))
    return summaries.validate_notes(n).select("doc_id", "fault")


def staged_faults(spark, d):
    """Documents as staged notes of threads; every tenth thread has two notes or none."""
    k = F.col("doc_id")
    note_id = F.concat(F.lit("20240101T"), F.lpad((k % 10).cast("string"), 2, "0"), F.lit("0000+0900"))
    date = F.concat(F.lit("2024-01-01T"), F.lpad((k % 10).cast("string"), 2, "0"), F.lit(":00:00+09:00"))
    base = _notes(spark, d).withColumn("thread_ids", F.when(k % 10 != 4, F.array(F.when(k % 10 == 3, k - 1).otherwise(k).cast("string"))))
    own = {
        "schemaVersion": F.when(k % 31 == 5, "5").otherwise("6"), "type": F.lit("sessionNote"), "sessionNoteId": F.when(k % 31 == 6, "x").otherwise(note_id), "date": F.when(k % 31 == 7, "x").otherwise(date), "fileSlug": F.when(k % 31 == 8, "A").otherwise("slug"),
        "generator": F.lit("g"), "generatorModel": F.when(k % 31 == 9, "x").otherwise("m"), "status": F.when(k % 31 == 10, "done").otherwise("blocked"),
    }
    meta = F.map_concat(F.map_filter("meta", lambda a, _: ~a.isin(list(own))), F.create_map(*(x for key, v in own.items() for x in (F.lit(key), v))))
    body = F.concat(F.lit("# Session Note\n## Summary\n## Timeline\n## Last Known State\n- Work State: blocked\n"))
    n = base.select(F.concat(note_id, F.lit("-slug.md")).alias("name"), meta.alias("meta"), body.alias("body"), "thread_ids", F.when(k % 31 == 11, F.array(F.lit("s"), F.lit("s"))).otherwise(F.col("source_refs")).alias("source_refs"))
    start = F.concat(F.lit("2024-01-01T"), F.lpad((k % 10).cast("string"), 2, "0"), F.lit(":00:00+09:00"))
    c = _t(spark, d, "documents").filter("doc_id % 10 <> 3").select(
        k.cast("string").alias("thread"), F.lit("s").alias("source_ref"), start.alias("started_at"), F.when(k % 31 == 12, "x").otherwise(F.md5(k.cast("string"))).alias("fingerprint"),
        F.when(k % 5 == 0, F.when(k % 31 == 13, "raw:/c").otherwise("raw:/a")).alias("capture_ref"), F.lit(None).cast("string").alias("capture_sha256"), (k % 2 == 0).alias("strict"),
    )
    return summaries.validate_staged(n, c, SETTINGS).select("thread", "fault")


def registry_projects(spark, d):
    """Customers as projects, one registry file for each hundred."""
    k = F.col("c_custkey")
    path = F.concat(F.lit("/w/"), k)
    roots = F.when(k % 10 == 7, '"x"').when(k % 10 == 8, "null").otherwise(F.concat(F.lit('[{"path": "'), path, F.lit('", "status": "active"}]')))
    row = F.concat(F.lit('{"schemaVersion": '), F.when(k % 10 == 6, "1").otherwise("2"), F.lit(', "identityKind": "codexAppLocalProject", "projectId": '), F.when(k % 10 == 5, "null").otherwise(F.concat(F.lit('"p'), k, F.lit('"'))), F.lit(', "name": "'), F.col("c_name"), F.lit('", "roots": '), roots, F.lit("}"))
    row = F.when(k % 10 == 3, F.concat(row, F.lit("\n\n"), row)).when(k % 10 == 4, "[1]").when(k % 10 == 9, F.lit('{"projectId": ')).otherwise(row)
    files = _t(spark, d, "customer").groupBy(F.floor(k / 100).alias("file")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(k, row.alias("r")))), lambda x: x["r"]), "\n").cast("binary").alias("content"))
    good, bad = logs.registry_rows(files)
    return good.select("project", "name", F.array_join("roots", ",").alias("roots"), F.lit(None).cast("string").alias("fault")).unionByName(bad.select("project", F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("roots"), "fault"))


def moved_locators(spark, d):
    k = F.col("doc_id")
    kinds = ["/old/raw/", "/old/raw/deep/", "/old/rawer/", "/old/data/thread-notes/", "data:/p/src/", "data:/thread-notes/", "data:/p/src/thread-notes/", "/old/raw\\", "raw:/p/src/"]
    before = F.element_at(F.array(*map(F.lit, kinds)), (k % len(kinds) + 1).cast("int"))
    ref = F.when(k % 50 == 1, "/old/raw").when(k % 50 == 2, None).otherwise(F.concat(before, k))
    return _t(spark, d, "documents").select("doc_id", provenance.rewrite_locator(ref, MOVED, "data:/p/src/").alias("ref"))


def _states(spark, d):
    o = _t(spark, d, "orders")
    r = o.select(F.lit("p").alias("provider"), F.col("o_custkey").alias("source_id"), F.col("o_orderdate").alias("finished_at"), F.col("o_orderkey").alias("run"), F.when(F.col("o_orderkey") % 2 == 0, "pull").otherwise("clone").alias("mode"), (F.col("o_orderstatus") == "F").alias("complete"))
    k = F.col("c_custkey")
    return provenance.source_status(_t(spark, d, "customer").select(F.lit("p").alias("provider"), k.alias("source_id"), (k % 9 != 4).alias("initialized"), (k < 0).alias("migration_required")), r)


def source_states(spark, d):
    return _states(spark, d).select("source_id", "initialized", "migration_required", F.date_format("as_of", "yyyy-MM-dd").alias("as_of"), "last_mode", "complete")


def overall_state(spark, d):
    return provenance.overall_status(_states(spark, d))


QUERIES = {
    f.__name__: f
    for f in (
        repository_forms, event_locators, old_messages, user_messages, history_origins, merged_summaries, scan_excluded, rebuild_counts, rebuild_excluded, summary_wording, note_faults, staged_faults, registry_projects, moved_locators,
        source_states, overall_state,
    )
}

_N = "e AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS n FROM conversations)"
_TRIM = f"regexp_replace(text, '^{_SPACE}|{_SPACE}$', '', 'g')"
_REBUILT = """, r AS (SELECT thread, CASE WHEN kind = 'projectless' THEN kind WHEN thread % 23 = 8 THEN 'assigned-to-other-project' WHEN thread % 7 = 0 THEN 'unmatched-project' WHEN thread % 9 = 2 THEN 'approval-or-internal'
 WHEN thread % 6 = 0 OR thread % 2 = 0 THEN 'without-project-user-message' END AS reason FROM s)"""
_REPORTS = """r AS (SELECT o_custkey, max(o_orderdate) AS fin, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS run, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) = 'F' AS done FROM orders GROUP BY 1),
s AS (SELECT c_custkey AS source_id, c_custkey % 9 <> 4 AS initialized, c_custkey < 0 AS migration_required, strftime(fin, '%Y-%m-%d') AS as_of, CASE run % 2 WHEN 0 THEN 'pull' WHEN 1 THEN 'clone' END AS last_mode, coalesce(done, false) AS complete FROM customer LEFT JOIN r ON c_custkey = o_custkey)"""
_CASES = " ".join(f"WHEN doc_id % 29 = {i} THEN '{fault}'" for i, (fault, _, _) in enumerate(NOTE_CASES))

ORACLE_SQL = {
    "repository_forms": r"""WITH p AS (SELECT *, regexp_extract(url, '^https?://([^/]*)', 1) AS h, regexp_replace(url, '^https?://[^/]*/?', '') AS q FROM pages)
SELECT page_id, lower(CASE WHEN page_id % 4 < 2 THEN 'https://' || h || '/' || q ELSE regexp_replace(rtrim(url, '/'), '(?i)\.git$', '') END) AS remote FROM p""",
    "event_locators": """WITH c AS (SELECT *, 'L' || lpad((turn + 1)::VARCHAR, 6, '0') AS id FROM conversations)
SELECT 'k' || conv_id || ':' || md5(conv_id::VARCHAR) || ':' || CASE WHEN conv_id % 3 = 0 THEN 'H1-' ELSE '' END || id AS canonical_id, CASE WHEN conv_id % 2 = 0 THEN 'raw:/p/' || conv_id ELSE '' END || '#' || id AS raw_locator FROM c""",
    "old_messages": f"""WITH {_N}, m AS (SELECT conv_id, n, role, {_TRIM} AS t, row_number() OVER (PARTITION BY conv_id, role, {_NORMAL} ORDER BY n) AS again FROM e WHERE role IN ('user', 'assistant') AND {_TRIM} <> '')
SELECT conv_id::VARCHAR AS thread, (n + 1)::INTEGER AS line_no, role, md5(t) AS text_md5, CASE WHEN n % 2 = 1 THEN 'time ' || (n + 1) ELSE 'start ' || conv_id END AS timestamp FROM m WHERE again = 1""",
    "user_messages": f"""WITH {_N}, m AS (SELECT conv_id, n, n - 1 + n % 2 AS o, {_TRIM} AS t, row_number() OVER (PARTITION BY conv_id, n - 1 + n % 2, {_NORMAL} ORDER BY n) AS again FROM e WHERE role = 'user' AND {_TRIM} <> '')
SELECT conv_id AS thread, (3 * n)::INTEGER AS line_no, 't' || o AS turn_id, CASE WHEN n % 5 = 0 THEN 'event_msg' ELSE 'response_item' END AS source, '/w/' || conv_id || CASE WHEN o % 4 = 1 THEN '/' || o ELSE '' END AS cwd, md5(t) AS text_md5 FROM m WHERE again = 1""",
    "history_origins": """SELECT doc_id::VARCHAR AS thread, CASE doc_id % 3 WHEN 0 THEN '{"a":"' || doc_id || '","b":1}' WHEN 1 THEN 't' || doc_id ELSE '' END AS history_base FROM documents""",
    "merged_summaries": f"""WITH {_N}, t AS (SELECT conv_id, md5(coalesce(string_agg(text, chr(10) ORDER BY n), '')) AS timeline_md5, string_agg('L' || lpad(n::VARCHAR, 6, '0'), ', ' ORDER BY n) FILTER (n % 3 <> 0 AND conv_id % 4 <> 0) AS u FROM e GROUP BY 1),
f AS (SELECT conv_id, coalesce(role, '') AS r, min(n) AS first_n FROM e WHERE coalesce(role, '') <> 'system' GROUP BY 1, 2), l AS (SELECT conv_id, string_agg(r, '|' ORDER BY first_n) AS l FROM f GROUP BY 1)
SELECT conv_id AS thread, timeline_md5, concat_ws('|', l, 'Events with an unknown timestamp or time zone: ' || u) AS limitations FROM t LEFT JOIN l USING (conv_id)""",
    "scan_excluded": f"""WITH {SCANNED}, a AS (SELECT o_custkey AS thread, string_agg(DISTINCT (o_orderkey % 25)::VARCHAR, ',' ORDER BY (o_orderkey % 25)::VARCHAR) AS found FROM orders WHERE o_orderkey % 25 < 3 GROUP BY 1)
SELECT thread, reason, CASE WHEN reason IN ('ambiguous-project', 'without-project-user-message') THEN found ELSE '' END AS candidates FROM s LEFT JOIN a USING (thread) WHERE reason NOT IN ('time', 'not-selected')""",
    "rebuild_counts": f"""WITH {SCANNED}{_REBUILT}, w AS (SELECT reason, coalesce(reason IN ('projectless', 'assigned-to-other-project', 'unmatched-project'), false) AS other FROM r)
SELECT count(*) AS files, count(*) FILTER (NOT other) AS matched_project, count(*) FILTER (reason IS NULL) AS eligible, count(*) FILTER (reason = 'approval-or-internal') AS approval_or_internal, count(*) FILTER (reason = 'without-project-user-message') AS without_user_message,
 count(*) FILTER (other) AS unmatched_project FROM w""",
    "rebuild_excluded": f"""WITH {SCANNED}{_REBUILT} SELECT thread, reason, CASE WHEN reason IN ('approval-or-internal', 'without-project-user-message') THEN '5' ELSE '' END AS candidates FROM r WHERE reason IS NOT NULL""",
    "summary_wording": f"""WITH c AS (SELECT conv_id, coalesce(text, '') || CASE WHEN conv_id % 13 = 1 AND turn = 0 THEN ' the Actual Execution' ELSE '' END AS text FROM conversations)
SELECT conv_id AS thread, CASE WHEN bool_or({_TRIM} = '') THEN 'item-without-source' WHEN conv_id % 13 = 2 OR bool_or(contains(lower(text), 'actual execution') OR contains(lower(text), 'supplied events')) THEN 'avoidable-phrase' END AS fault FROM c GROUP BY 1""",
    "note_faults": f"""SELECT doc_id, CASE {_CASES} WHEN doc_id % 29 = 10 THEN 'heading ## Summary' WHEN doc_id % 29 = 11 THEN 'work-state' WHEN doc_id % 29 = 12 THEN 'source' WHEN doc_id % 29 = 13 AND doc_id % 5 = 0 THEN 'captures'
 WHEN doc_id % 29 = 14 AND doc_id % 4 > 0 THEN 'id' WHEN doc_id % 29 = 14 AND doc_id % 5 = 0 THEN 'captures' END AS fault FROM documents""",
    "staged_faults": """WITH n AS (SELECT doc_id AS k, doc_id % 31 AS m, doc_id % 10 AS z, CASE WHEN doc_id % 10 = 3 THEN doc_id - 1 WHEN doc_id % 10 <> 4 THEN doc_id END AS thread FROM documents),
b AS (SELECT thread FROM n WHERE thread IS NOT NULL GROUP BY 1 HAVING count(*) > 1), x AS (SELECT n.*, n.thread IN (SELECT thread FROM b) AS again, d.doc_id AS c FROM n LEFT JOIN documents d ON n.thread = d.doc_id AND d.doc_id % 10 <> 3),
f AS (SELECT thread::VARCHAR AS thread, CASE WHEN m = 5 THEN 'version' WHEN m = 10 THEN 'status' WHEN again THEN 'repeated' WHEN c IS NULL THEN NULL WHEN m = 11 THEN 'source-refs' WHEN m = 6 OR z = 3 THEN 'session-note-id' WHEN m = 7 THEN 'date'
 WHEN c % 2 = 1 THEN NULL WHEN m = 9 THEN 'generatorModel' WHEN m = 12 THEN 'sourceFingerprint' WHEN m = 13 AND c % 5 = 0 THEN 'sourceCaptureRef' WHEN m = 8 THEN 'file-slug' END AS fault FROM x)
SELECT * FROM f WHERE fault IS NOT NULL UNION ALL SELECT doc_id::VARCHAR, 'missing' FROM documents WHERE doc_id % 10 <> 3 AND doc_id NOT IN (SELECT thread FROM n WHERE thread IS NOT NULL)""",
    "registry_projects": """WITH c AS (SELECT c_custkey AS k, c_custkey % 10 AS z, c_name FROM customer), f AS (SELECT k, z, CASE z WHEN 4 THEN 'no-object' WHEN 5 THEN 'missing-id' WHEN 6 THEN 'version' WHEN 7 THEN 'roots' WHEN 9 THEN 'no-object' END AS fault, c_name FROM c)
SELECT CASE WHEN z IN (4, 5, 9) THEN '' ELSE 'p' || k END AS project, CASE WHEN fault IS NULL THEN c_name END AS name, CASE WHEN fault IS NULL THEN CASE WHEN z = 8 THEN '' ELSE '/w/' || k END END AS roots, fault FROM f
UNION ALL SELECT 'p' || k, NULL, NULL, 'duplicate-id' FROM f WHERE z = 3""",
    "moved_locators": r"""SELECT doc_id, CASE WHEN doc_id % 50 = 1 THEN '/new/raw' WHEN doc_id % 50 = 2 THEN NULL ELSE CASE doc_id % 9 WHEN 0 THEN '/new/raw/' WHEN 1 THEN '/far/deep/' WHEN 2 THEN '/old/rawer/' WHEN 3 THEN '/new/data/session-notes/'
 WHEN 4 THEN 'data:/' WHEN 5 THEN 'data:/session-notes/' WHEN 6 THEN 'data:/session-notes/' WHEN 7 THEN '/new/raw\' ELSE 'raw:/p/src/' END || doc_id END AS ref FROM documents""",
    "source_states": f"WITH {_REPORTS} SELECT * FROM s",
    "overall_state": f"WITH {_REPORTS} SELECT count(*) AS sources, bool_and(initialized) AS initialized, bool_or(migration_required) AS migration_required, bool_and(complete) AS complete FROM s",
}
