"""Queries over large files, long threads, times in all forms and mixed histories, and SQL
that states the same results. A few threads hold all rows of a table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talespark.functions import text as T
from talespark.operators import histories, inputs, provenance, segments
from talespark.plans.evidence import _EV, _digests, _events
from talespark.plans.registry import _NORMAL, _SPACE
from talespark.sources import lines
from talespark.sources.tables import shared_dir, written

#: Lines or events of a segment in these queries.
SEGMENT = 512


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def file_lines(spark, d):
    """All texts of a thousand documents in one file, each read by as many tasks as it has blocks."""
    import uuid

    docs = _t(spark, d, "documents").select(F.floor(F.col("doc_id") / 1000).cast("long").alias("file"), "doc_id", F.concat(F.coalesce("text", F.lit("")), F.when(F.col("doc_id") % 3 == 0, "\r").otherwise("")).alias("value"))
    root = f"{shared_dir(spark)}/log-files-{uuid.uuid4().hex}"
    docs.repartition("file").sortWithinPartitions("file", "doc_id").select("file", "value").write.partitionBy("file").text(root)
    got, _ = lines.file_lines(spark, root, "*.txt")
    return got.select(F.regexp_extract("path", r"/file=(-?\d+)/", 1).cast("long").alias("file"), "line_no", F.md5(F.col("raw").cast("binary")).alias("raw_md5"))


def _log_records(spark, d):
    """Line items as parsed lines of a few threads; one holds about half of all."""
    k, n = F.col("l_orderkey"), F.col("l_linenumber")
    at = F.concat(F.lit("at "), k)
    kind = F.when(k % 97 == 5, "session_meta").when((k + n) % 11 == 3, "turn_context").otherwise("response_item")
    cwd = F.when(k % 5 < 2, F.concat(F.lit("/w/"), (k + n) % 7)).otherwise("")
    x = _t(spark, d, "lineitem").select(
        "l_returnflag", k, n, (k * 8 + n).alias("line_no"), kind.alias("type"), ((k % 101 == 9) & (kind == "response_item")).alias("header"), at.alias("timestamp"),
        cwd.alias("cwd"), cwd.alias("p_cwd"), F.concat(F.lit("t"), k % 1000).alias("p_turn_id"), at.alias("p_timestamp"),
    )
    rows = x.withColumn("thread", F.when(k % 2 == 0, "hot").otherwise(F.col("l_returnflag")))
    return rows.groupBy("thread", "line_no").agg(*(F.min(c).alias(c) for c in ("type", "header", "timestamp", "cwd", "p_cwd", "p_turn_id", "p_timestamp")))


def long_contexts(spark, d):
    filled = segments.fill_context_by_segments(written(_log_records(spark, d), "records"), "thread", SEGMENT)
    return filled.select("thread", "line_no", "thread_cwd", "cwd", "turn_id", "header_at")


def long_chunks(spark, d):
    """Orders as events of a few threads, in chunks; every 50th is one part of several."""
    k = F.col("o_orderkey")
    rows = _t(spark, d, "orders").groupBy(k.alias("ord"), F.when(k % 3 == 0, "hot").otherwise(F.col("o_orderstatus")).alias("thread")).agg(F.min(F.col("o_custkey") % 400 + 90).cast("int").alias("size"))
    split = rows.select("thread", "ord", F.lit(1).alias("part"), "size", F.when(F.col("ord") % 50 == 7, 2).otherwise(1).alias("parts"))
    return segments.long_chunk_events(written(split, "parts"), 1200, SEGMENT).select("thread", "ord", "chunk")


def _forms():
    """An order's time in twelve forms; the last four name no zone or are no times."""
    day, k = F.col("o_orderdate"), F.col("o_orderkey")
    h, m, s = k % 24, k % 60, k % 59
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    f = lambda p: F.date_format(day, p)
    ext, basic = F.concat_ws(":", two(h), two(m), two(s)), F.concat(two(h), two(m), two(s))
    week = F.concat(F.extract(F.lit("YEAROFWEEK"), day).cast("string"), F.lit("-W"), two(F.weekofyear(day)), F.lit("-"), (F.weekday(day) + 1).cast("string"))
    return [
        F.concat(f("yyyy-MM-dd"), F.lit("T"), ext, F.lit("Z")),
        F.concat(f("yyyyMMdd"), F.lit("T"), basic, F.lit("Z")),
        F.concat(week, F.lit("T"), ext, F.lit("Z")),
        F.concat(F.replace(week, F.lit("-")), F.lit(" "), basic, F.lit("+0930")),
        F.concat(f("yyyy-MM-dd"), F.lit(" "), F.concat_ws(":", two(h), two(m)), F.lit("+09")),
        F.concat(f("yyyy-MM-dd"), F.lit("T"), two(h), F.lit("-03:30:30")),
        F.concat(f("yyyy-MM-dd"), F.lit("T"), ext, F.lit(",25+00:00")),
        F.concat(f("yyyy-MM-dd"), F.lit("T"), ext, F.lit(".5000009Z")),
        F.concat(f("yyyy-MM-dd"), F.lit("T"), ext),
        F.concat(F.lit("T"), ext, F.lit("Z")),
        F.concat(F.lit(" "), f("yyyy-MM-dd"), F.lit("T"), ext, F.lit("Z")),
        F.concat(f("yyyy-MM"), F.lit("-32T"), ext, F.lit("Z")),
    ]


def iso_times(spark, d):
    k, form = F.col("o_orderkey"), None
    for i, text in enumerate(_forms()):
        form = F.when(k % 12 == i, text) if form is None else form.when(k % 12 == i, text)
    return _t(spark, d, "orders").select(k, T.epoch_of(form).cast("double").alias("epoch"))


def mixed_fingerprints(spark, d):
    """Branched and plain events in one table, row by row."""
    e = _events(spark, d).withColumn("branch_id", F.when(F.col("ord") % 2 == 0, F.concat(F.lit("H"), F.col("thread"))).when(F.col("ord") % 3 == 0, ""))
    return histories.fingerprint_events(e, F.concat(F.lit("sessions/"), "thread"))


def message_fingerprints(spark, d):
    """Threads with their messages; every 5th thread has none."""
    e = _events(spark, d)
    k = F.col("thread").cast("long")
    head = e.select("thread").distinct().select("thread", F.concat(F.lit("at "), "thread").alias("started_at"), F.concat(F.lit("git@Host:r/"), "thread", F.lit(".git")).alias("repository_url"), F.concat(F.lit("sessions/"), "thread").alias("source_ref"), F.lit("/Base/").alias("cwd"))
    said = e.filter(k % 5 != 0).select("thread", "ord", F.col("actor").alias("role"), "text", "turn_id", "timestamp", F.when(F.col("ord") % 2 == 0, "/Work/X").alias("cwd"))
    return histories.fingerprint_threads(head, said)


def activity_faults(spark, d):
    """Entities of activities: repeats are sound, an empty id and another schema are not."""
    e = provenance.make_entities(_digests(spark, d))
    k = F.col("id")
    x = e.unionByName(e.filter("id % 4 = 0")).withColumn("schema_version", F.when(k % 29 == 3, 1).otherwise(2)).withColumn("id", F.when(k % 31 == 5, "").otherwise(k.cast("string")))
    return provenance.validate_entities(x, e.select("snapshot_ref", "sha256", "byte_count").distinct(), 2)


def version_faults(spark, d):
    """Edges whose ends are other versions than their activity's entities."""
    li = _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("activity"), F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"), (F.col("l_partkey") % 4).alias("v"), (F.col("l_suppkey") % 3).alias("w"))
    edges = li.select("activity", "src", F.when(F.col("src") % 10 == 3, -1).otherwise(F.col("v")).alias("src_version"), "dst", F.when(F.col("dst") % 7 == 2, -1).otherwise(F.col("w")).alias("dst_version"), F.lit("derivedFrom").alias("type")).distinct()
    used, made = li.select("activity", F.col("src").alias("entity"), F.col("v").alias("version")), li.select("activity", F.col("dst").alias("entity"), F.col("w").alias("version"))
    return provenance.validate_relations(edges, used, made)


def request_texts(spark, d):
    """Requests for the chunks of whole conversations: their characters and events."""
    chunks = inputs.chunk_events(inputs.split_events(_events(spark, d), 6000), 6000)
    r = inputs.render_requests(chunks, "head\n", "\ntail")
    return r.groupBy("thread").agg(F.sum(F.length("request") - 12).alias("characters"), F.sum(F.regexp_count("request", F.lit('"turnId": "t[0-9]+"'))).alias("events"))


def folded_paths(spark, d):
    """Paths and addresses with letters that only full case folding takes for their plain form."""
    k = F.col("page_id") % 4
    url = F.regexp_replace("url", "^https?://", "")
    other = F.when(k == 0, F.replace(url, F.lit("s"), F.lit("\u017f"))).when(k == 1, F.replace(F.upper(url), F.lit("ST"), F.lit("\ufb06"))).when(k == 2, F.replace(F.upper(url), F.lit("K"), F.lit("\u212a"))).otherwise(url)
    root, below = F.concat(F.lit("/mnt/C/STRA\u1e9eE/"), F.regexp_extract(other, "^[^/]+", 0)), F.concat(F.lit("c:\\Strasse\\"), url, F.lit("/\u039f\u0394\u039f\u03a3/"))
    return _t(spark, d, "pages").select(
        "page_id", T.normalize_path(F.concat(F.lit("/srv/\u039f\u0394\u039f\u03a3/"), other)).alias("path"), F.startswith(T.normalize_path(below), F.concat(T.normalize_path(root), F.lit("\\"))).alias("within"),
        T.normalize_repo_url(F.concat(F.lit("git@Gro\u00df:"), other, F.lit(".git"))).alias("repository"), T.normalize_git_remote(F.concat(F.lit("SSH://git@Gro\u00df/"), other, F.lit(".GIT/"))).alias("remote"),
    )


QUERIES = {f.__name__: f for f in (file_lines, long_contexts, long_chunks, iso_times, mixed_fingerprints, message_fingerprints, activity_faults, version_faults, request_texts, folded_paths)}

_RECORDS = """x AS (SELECT CASE WHEN l_orderkey % 2 = 0 THEN 'hot' ELSE l_returnflag END AS thread, l_orderkey * 8 + l_linenumber AS line_no, l_orderkey AS k, l_linenumber AS n, 'at ' || l_orderkey AS tm,
 CASE WHEN l_orderkey % 97 = 5 THEN 'session_meta' WHEN (l_orderkey + l_linenumber) % 11 = 3 THEN 'turn_context' ELSE 'response_item' END AS type, CASE WHEN l_orderkey % 5 < 2 THEN '/w/' || ((l_orderkey + l_linenumber) % 7) ELSE '' END AS cwd FROM lineitem),
r AS (SELECT DISTINCT thread, line_no, k, tm, type, cwd, type = 'response_item' AND k % 101 = 9 AS header FROM x)"""


def _times_sql() -> str:
    sql = ["base + {c}", "base + {c}", "base + {c}", "base + {c} - 34200", "base + {m} - 32400", "base + o_orderkey % 24 * 3600 + 12630", "base + {c} + 0.25", "base + {c} + 0.5"]
    m = "o_orderkey % 24 * 3600 + o_orderkey % 60 * 60"
    cases = " ".join(f"WHEN {i} THEN {x.format(c=m + ' + o_orderkey % 59', m=m)}" for i, x in enumerate(sql))
    return f"SELECT o_orderkey, (CASE o_orderkey % 12 {cases} END)::DOUBLE AS epoch FROM (SELECT o_orderkey, epoch(o_orderdate::DATE) AS base FROM orders)"


ORACLE_SQL = {
    "folded_paths": r"""WITH u AS (SELECT page_id, lower(regexp_replace(url, '^https?://', '')) AS u FROM pages)
SELECT page_id, '\srv\' || chr(959) || chr(948) || chr(959) || chr(963) || '\' || rtrim(replace(u, '/', '\'), '\') AS path, contains(u, '/') OR u <> '' AS within,
 'https://gross/' || rtrim(u, '/') AS repository, 'https://gross/' || u AS remote FROM u""",
    "file_lines": rf"""WITH f AS (SELECT doc_id // 1000 AS file, string_agg(coalesce(text, '') || CASE WHEN doc_id % 3 = 0 THEN chr(13) ELSE '' END || chr(10), '' ORDER BY doc_id) AS t FROM documents GROUP BY 1),
l AS (SELECT file, regexp_split_to_array(t, '\r\n|\r|\n') AS p FROM f), u AS (SELECT file, unnest(range(1, len(p) + 1)) AS line_no, unnest(p) AS raw FROM l),
s AS (SELECT file, line_no, regexp_replace(regexp_replace(raw, '^{_SPACE}', ''), '{_SPACE}$', '') AS raw FROM u) SELECT file, line_no, md5(raw) AS raw_md5 FROM s WHERE raw <> ''""",
    "long_contexts": f"""WITH {_RECORDS}, a AS (SELECT *, coalesce(last_value(CASE WHEN type = 'session_meta' OR header THEN nullif(cwd, '') END IGNORE NULLS) OVER w, '') AS thread_cwd FROM r WINDOW w AS (PARTITION BY thread ORDER BY line_no ROWS UNBOUNDED PRECEDING)),
b AS (SELECT *, CASE WHEN type = 'session_meta' OR header THEN thread_cwd WHEN type = 'turn_context' THEN coalesce(nullif(cwd, ''), thread_cwd) END AS at_ FROM a)
SELECT thread, line_no, thread_cwd, coalesce(nullif(last_value(at_ IGNORE NULLS) OVER w, ''), thread_cwd) AS cwd, coalesce(last_value(CASE WHEN type = 'turn_context' THEN 't' || (k % 1000) END IGNORE NULLS) OVER w, '') AS turn_id,
 coalesce(last_value(CASE WHEN type = 'session_meta' THEN tm END IGNORE NULLS) OVER w, first_value(CASE WHEN header THEN tm END IGNORE NULLS) OVER w, '') AS header_at FROM b WINDOW w AS (PARTITION BY thread ORDER BY line_no ROWS UNBOUNDED PRECEDING)""",
    "long_chunks": """WITH RECURSIVE e AS (SELECT o_orderkey AS ord, CASE WHEN o_orderkey % 3 = 0 THEN 'hot' ELSE o_orderstatus END AS thread, min(o_custkey % 400 + 90) AS size, o_orderkey % 50 = 7 AS alone FROM orders GROUP BY ALL),
n AS (SELECT *, row_number() OVER (PARTITION BY thread ORDER BY ord) AS i FROM e),
c AS (SELECT thread, i, ord, 1 AS chunk, 2 + size AS used, alone FROM n WHERE i = 1
 UNION ALL SELECT n.thread, n.i, n.ord, CASE WHEN n.alone OR c.alone OR c.used + 2 + n.size > 1200 THEN c.chunk + 1 ELSE c.chunk END, CASE WHEN n.alone OR c.alone OR c.used + 2 + n.size > 1200 THEN 2 + n.size ELSE c.used + 2 + n.size END, n.alone FROM c JOIN n ON n.thread = c.thread AND n.i = c.i + 1)
SELECT thread, ord, chunk::INTEGER AS chunk FROM c""",
    "iso_times": _times_sql(),
    "mixed_fingerprints": f"""WITH {_EV} SELECT thread, sha256('{{"events":[' || string_agg('{{"actor":"' || actor || CASE WHEN n % 2 = 0 THEN '","branchId":"H' || thread ELSE '' END || '","cwd":"\\\\work\\\\x","id":"' || id || '","kind":"' || kind || '","name":"","text":' || to_json({_NORMAL})::VARCHAR
 || ',"timestamp":"' || tm || '","turnId":"t' || n || '"}}', ',' ORDER BY n) || '],"id":"' || thread || '","sourceRef":"sessions/' || thread || '"}}') AS fingerprint FROM v GROUP BY thread""",
    "message_fingerprints": f"""WITH {_EV} SELECT thread, sha256('{{"id":"' || thread || '","messages":[' || coalesce(string_agg('{{"cwd":"\\\\' || CASE WHEN n % 2 = 0 THEN 'work\\\\x' ELSE 'base' END || '","role":"' || actor || '","text":' || to_json({_NORMAL})::VARCHAR
 || ',"timestamp":"' || tm || '","turnId":"t' || n || '"}}', ',' ORDER BY n) FILTER (conv_id % 5 <> 0), '') || '],"repositoryUrl":"https://host/r/' || thread || '","sourceRef":"sessions/' || thread || '","timestamp":"at ' || thread || '"}}') AS fingerprint FROM v GROUP BY thread""",
    "activity_faults": """WITH d AS (SELECT doc_id AS k FROM documents WHERE text IS NOT NULL UNION ALL SELECT doc_id FROM documents WHERE doc_id % 4 = 0 AND text IS NOT NULL),
f AS (SELECT CASE WHEN k % 31 = 5 THEN '' ELSE k::VARCHAR END AS id, CASE WHEN k % 29 = 3 THEN 'schema-version' WHEN k % 31 = 5 THEN 'identity' END AS fault FROM d) SELECT * FROM f WHERE fault IS NOT NULL""",
    "version_faults": """SELECT * FROM (SELECT DISTINCT l_orderkey AS activity, l_partkey AS src, CASE WHEN l_partkey % 10 = 3 THEN -1 ELSE l_partkey % 4 END AS src_version, l_suppkey AS dst, CASE WHEN l_suppkey % 7 = 2 THEN -1 ELSE l_suppkey % 3 END AS dst_version,
 CASE WHEN l_suppkey % 7 = 2 THEN 'unknown-generated' WHEN l_partkey % 10 = 3 THEN 'unknown-used' END AS fault FROM lineitem) WHERE fault IS NOT NULL""",
    "request_texts": f"""WITH RECURSIVE {_EV}, g AS (SELECT thread, length('{{"id": "' || id || '", "kind": "' || kind || '", "actor": "' || actor || '", "name": "", "text": ' || to_json(text)::VARCHAR || ', "timestamp": "' || tm || '", "turnId": "t' || n || '"}}') AS size, row_number() OVER (PARTITION BY thread ORDER BY n) AS i FROM v),
c AS (SELECT thread, i, 1 AS chunk, 2 + size AS used FROM g WHERE i = 1 UNION ALL SELECT g.thread, g.i, CASE WHEN used + 2 + size > 6000 THEN chunk + 1 ELSE chunk END, CASE WHEN used + 2 + size > 6000 THEN 2 + size ELSE used + 2 + size END FROM c JOIN g ON g.thread = c.thread AND g.i = c.i + 1),
t AS (SELECT thread, chunk, max(used) AS characters, count(*) AS events FROM c GROUP BY ALL) SELECT thread, sum(characters - 2)::BIGINT AS characters, sum(events)::BIGINT AS events FROM t GROUP BY thread""",
}
