"""Log files, manifests, app state, registries and notes as tables."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from talespark.functions.text import WHITESPACE, let, strip

# Manifest schema versions, and the folder that a bare reference means.
MANIFEST_VERSIONS = [1, 2, 3]
DEFAULT_FOLDER = "sessions"

MANIFEST_SCHEMA = "schemaVersion int, sourceProvider string, sourceId string, sourceRef string, captureRef string, sha256 string, byteCount long, capturedAt string, threadId string, lastEventAt string"


def below(path: Column, root: str) -> Column:
    """What follows ``root`` and a slash in a file's path; null if the file lies elsewhere."""
    tail = re.sub(r"^[a-z]+:/*", "/", root.rstrip("/")) + "/"
    at = F.instr(path, F.lit(tail))
    return F.when(at > 0, F.substring(path, at + len(tail), F.lit(2**31 - 1)))


def read_captures(spark: SparkSession, source_id: str, root: str, archived: bool = False) -> DataFrame:
    """(source_id, source_ref, content) of all .jsonl files below ``sessions`` and, if
    asked for, ``archived_sessions``. A file is one row, so below 2 GB."""
    out = None
    for folder in ("sessions", "archived_sessions")[: 2 if archived else 1]:
        base = f"{root.rstrip('/')}/{folder}"
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.jsonl").load(base)
        rows = files.select(F.lit(source_id).alias("source_id"), F.concat(F.lit(f"{folder}/"), below(F.col("path"), base)).alias("source_ref"), "content")
        out = rows if out is None else out.unionByName(rows)
    return out


def decoded(content: Column) -> Column:
    """UTF-8 text without a byte order mark; null if the bytes are not UTF-8."""
    return F.regexp_replace(F.try_validate_utf8(content.cast("string")), "^﻿", "")


def unreadable(captures: DataFrame) -> DataFrame:
    """Captures that are not UTF-8: they stay captured and fail as a whole."""
    return captures.filter(F.col("content").isNotNull() & decoded(F.col("content")).isNull())


def read_lines(captures: DataFrame, *keys: str) -> DataFrame:
    """(keys, line_no from 1, raw): physical lines only, blank ones left out but
    counted. Captures that are null or not UTF-8 give none."""
    lines = captures.select(*keys, F.posexplode(F.split(decoded(F.col("content")), "\r\n|\r|\n", -1)).alias("pos", "raw"))
    return lines.select(*keys, (F.col("pos") + 1).alias("line_no"), strip(F.col("raw")).alias("raw")).filter("raw <> ''")


def mirror_ref(ref: Column, source_id: Column, provider: str) -> Column:
    """``raw:/provider/source/path`` of a safe relative path (else null); a path in
    neither known folder is put below ``sessions``."""
    safe = is_safe(ref)
    known = ref.rlike("^(archived_)?sessions/")
    return F.when(safe, F.concat_ws("/", F.lit("raw:"), F.lit(provider), source_id, F.when(known, ref).otherwise(F.concat(F.lit(f"{DEFAULT_FOLDER}/"), ref))))


def is_safe(ref: Column) -> Column:
    """No empty, ``.`` or ``..`` part, no colon, no back slash."""
    parts = F.exists(F.split(ref, "/", -1), lambda p: p.isin("", ".", ".."))
    return ref.isNotNull() & ~ref.contains(":") & ~ref.contains("\\") & ~parts


def check_manifest(rows: DataFrame, source_id: str, provider: str) -> DataFrame:
    """Manifest rows with ``fault``: null, or the first rule that a row breaks. Version
    1 names content by digest, later versions by mirrored path."""
    by_path = mirror_ref(F.col("sourceRef"), F.col("sourceId"), provider)
    by_digest = F.concat(F.lit(f"raw:/{source_id}/"), F.col("sha256"))
    expected = F.when(F.col("schemaVersion") == 1, by_digest).otherwise(by_path)
    fault = (
        F.when(~F.coalesce(F.col("schemaVersion").isin(MANIFEST_VERSIONS), F.lit(False)), "schema-version")
        .when(~F.col("sourceId").eqNullSafe(F.lit(source_id)), "source-id")
        .when((F.col("schemaVersion") == 3) & ~F.col("sourceProvider").eqNullSafe(F.lit(provider)), "provider")
        .when(F.coalesce("sourceRef", F.lit("")) == "", "source-ref")
        .when(~F.coalesce(F.col("sha256").rlike("^[0-9a-f]{64}$"), F.lit(False)), "digest")
        .when(F.coalesce(F.col("byteCount"), F.lit(-1)) < 0, "size")
        .when(~F.col("captureRef").eqNullSafe(expected), "capture-ref")
    )
    return rows.withColumn("fault", fault)


def read_manifest(spark: SparkSession, path: str, source_id: str, provider: str) -> tuple[DataFrame, DataFrame]:
    """(valid rows, rejects) of a manifest file."""
    rows = check_manifest(spark.read.schema(f"{MANIFEST_SCHEMA}, _bad string").option("columnNameOfCorruptRecord", "_bad").json(path), source_id, provider)
    return rows.filter("fault IS NULL AND _bad IS NULL").drop("fault", "_bad"), rows.filter("fault IS NOT NULL OR _bad IS NOT NULL")


# Version and kind of projects in a registry file.
REGISTRY_VERSION = 2
REGISTRY_KIND = "codexAppLocalProject"


def registry_rows(captures: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, faults) of registry files (content): rows (line_no, project, name, roots,
    record) of lines that are sound; faults (line_no, project, fault): a line that is no JSON
    object, has no id, repeats an earlier line's id, has roots that are no list of objects,
    or is of another version or kind. Blank lines count as lines only; null or empty files
    have no rows. Numbers run within a file, repeats are those of all files together."""
    raw, get = F.col("raw"), lambda k: F.get_json_object("raw", f"$.{k}")
    lines = read_lines(captures).withColumn("project", F.coalesce(get("projectId"), F.lit("")))
    roots = F.from_json(get("roots"), "array<struct<path string, role string, status string>>")
    w = Window.partitionBy("project").orderBy("line_no", "raw")
    x = lines.withColumn("_n", F.row_number().over(w)).withColumn("_roots", get("roots"))
    listed = F.col("_roots").isNull() | F.coalesce(F.forall(F.from_json("_roots", "array<string>"), lambda r: F.json_object_keys(r).isNotNull()), F.lit(False))
    fault = (
        F.when(F.json_object_keys(raw).isNull(), "no-object").when(F.col("project") == "", "missing-id").when(F.col("_n") > 1, "duplicate-id").when(~listed, "roots")
        .when(~get("schemaVersion").eqNullSafe(F.lit(str(REGISTRY_VERSION))) | ~get("identityKind").eqNullSafe(F.lit(REGISTRY_KIND)), "version")
    )
    x = x.withColumn("fault", fault)
    none = F.array().cast("array<string>")
    good = x.filter("fault IS NULL").select("line_no", "project", get("name").alias("name"), F.coalesce(F.transform(roots, lambda r: r["path"]), none).alias("roots"), raw.alias("record"))
    return good, x.filter("fault IS NOT NULL").select("line_no", "project", "fault")


def read_registry(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``registry_rows`` of a registry file."""
    return registry_rows(spark.read.format("binaryFile").load(path).select("content"))


def front_matter(text: Column) -> tuple[Column, Column]:
    """(map of scalar values, body) of a note. Keys are taken from unindented lines
    ``key: value`` up to the closing rule; of repeated keys the last counts; an empty
    value or [] is ''. Without a leading rule the map is empty and all is body."""
    first, end = r"\A[ \t]*---[ \t]*(?:\n|\z)", r"(?s)\A(.*?)\n[ \t]*---[ \t]*(?:\n|\z)"
    rest = let(F.regexp_replace(text, "\r\n|\r", "\n"), lambda t: F.when(t.rlike(first), F.concat(F.lit("\n"), F.regexp_replace(t, first, ""))))
    closed = lambda r: r.rlike(end)
    parts = let(rest, lambda r: F.struct(F.when(closed(r), F.regexp_extract(r, end, 1)).otherwise(r).alias("head"), F.when(closed(r), F.regexp_replace(r, end, "")).when(r.isNotNull(), "").alias("body")))
    head, body = F.coalesce(parts["head"], F.lit("")), F.coalesce(parts["body"], text)
    good = F.filter(F.split(head, "\n", -1), lambda x: x.contains(":") & ~x.rlike("^[ \t]"))
    value = lambda x: strip(F.regexp_replace(x, "^[^:]*:", ""))
    plain = lambda x: F.when(value(x) == "[]", "").otherwise(F.regexp_replace(value(x), "^['\"]+|['\"]+$", ""))
    pairs = F.transform(good, lambda x: F.struct(strip(F.substring_index(x, ":", 1)).alias("key"), plain(x).alias("value")))
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    meta = F.aggregate(pairs, none, lambda m, x: F.map_concat(F.map_filter(m, lambda k, _: k != x["key"]), F.create_map(x["key"], x["value"])))
    return meta, body


# Lists in a note's front matter.
NOTE_LISTS = {"thread_ids": "sourceThreadIds", "source_refs": "sourceRefs", "capture_refs": "sourceCaptureRefs", "capture_digests": "sourceCaptureSha256s"}


def read_notes(spark: SparkSession, path: str) -> DataFrame:
    """(path, meta, body) of markdown notes, and their lists of sources."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").text(path, wholetext=True)
    meta, body = front_matter(F.col("value"))
    lists = (front_matter_list(F.col("value"), key).alias(name) for name, key in NOTE_LISTS.items())
    return files.select(F.input_file_name().alias("path"), meta.alias("meta"), body.alias("body"), *lists)


def front_matter_list(text: Column, key: str) -> Column:
    """The items ``- x`` below ``key:`` in a note's front matter."""
    block = F.regexp_extract(text, rf"(?m)^{re.escape(key)}:[ \t]*\r?\n((?:[ \t]+-[^\n]*(?:\n|\z))*)", 1)
    items = F.filter(F.split(block, "\n", -1), lambda x: x.rlike("^[ \t]+-"))
    return F.transform(items, lambda x: F.regexp_replace(strip(F.regexp_replace(x, "^[ \t]+-", "")), f"^['\"{WHITESPACE[1:-1]}]+|['\"]+$", ""))
