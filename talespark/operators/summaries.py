"""Checks and rendering of summaries, timelines and notes."""

from __future__ import annotations

import json
import re
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talespark.functions.text import epoch_of, fold, is_uuid, local_time, slugify, strip
from talespark.operators.capture import set_digest

# Where text is cut into lines, what a literal path is, quoted or not, tentative wordings, the label they contradict, and supported versions of artefacts.
LINE_END = "\r\n|[\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
QUOTED = r"`([^`\n]+)`"
LITERAL_PATH = r"^(?:[A-Za-z]:[\\/]|\.{1,2}[\\/]|\._)"
TENTATIVE = ["方向を示した", "イメージを示した", "気がしている"]
DECISION = "Explicit Decision"
AVOIDABLE = ["actual execution", "supplied events"]
NOTE_VERSIONS = ["3", "4", "5", "6"]
WORK_STATE = r"(?m)^- Work State: (in-progress|blocked|waiting-for-user|done)\b"
NOTE_VALUES = {"reviewStatus": "unreviewed", "sourceType": "codexChat", "automatedValidation": "passed"}
HEADINGS = ["# Session Note", "## Summary", "## Timeline", "## Last Known State"]
OLD_HEADINGS = {"# Session Note": (6, "# Thread Note"), "## Timeline": (5, "## Key Developments")}
UUID4 = "^[0-9a-f]{8}-[0-9a-f]{4}-4[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$"
SLUG = r"\A[a-z0-9]+(-[a-z0-9]+)*\z"
ACTORS = {"user": "User", "assistant": "AI", "tool": "Tool"}

KINDS = {"object": dict, "array": list, "string": str, "boolean": bool}


def schema_fault(value: Any, rule: dict[str, Any], at: str = "$") -> str | None:
    """The first way in which a value differs from a JSON schema (type, enum, pattern,
    lengths, required and extra properties)."""
    kind = rule.get("type")
    if kind in KINDS and not isinstance(value, KINDS[kind]):
        return f"{at}: not of type {kind}"
    if "enum" in rule and value not in rule["enum"]:
        return f"{at}: not an allowed value"
    if isinstance(value, (str, list)):
        low, high = ("minLength", "maxLength") if isinstance(value, str) else ("minItems", "maxItems")
        if not rule.get(low, 0) <= len(value) <= rule.get(high, len(value)):
            return f"{at}: {len(value)} is no allowed length"
    if isinstance(value, str) and "pattern" in rule and not re.search(rule["pattern"], value):
        return f"{at}: does not match the pattern"
    below: list[tuple[Any, dict[str, Any], str]] = []
    if isinstance(value, list):
        below = [(x, rule.get("items", {}), f"{at}[{i}]") for i, x in enumerate(value)]
    elif isinstance(value, dict):
        known = rule.get("properties", {})
        for missing in (k for k in rule.get("required", []) if k not in value):
            return f"{at}.{missing}: missing"
        for extra in (k for k in value if k not in known and rule.get("additionalProperties") is False):
            return f"{at}.{extra}: not allowed"
        below = [(v, known[k], f"{at}.{k}") for k, v in value.items() if k in known]
    return next((f for x in below if (f := schema_fault(*x))), None)


def validate_schema(texts: Column, schema: dict[str, Any]) -> Column:
    """The first fault of each JSON text, null if there is none."""

    @F.pandas_udf("string")
    def check(s: pd.Series) -> pd.Series:
        def one(text: str | None) -> str | None:
            try:
                return schema_fault(json.loads(text or ""), schema)
            except ValueError:
                return "$: no JSON"

        return s.map(one, na_action=None)

    return check(texts)


def validate_summary(summaries: DataFrame, allowed: DataFrame, phrases: list[str] | None = None) -> DataFrame:
    """(thread, fault): the first rule that a summary breaks, else null. Columns: thread,
    state (work_state, unresolved, continuation, event_ids) and items (text, label,
    event_ids, start_id, end_id); ``allowed`` has (thread, event_ids). ``phrases`` are those
    that no text of the summary may hold, whatever the case: ``AVOIDABLE`` for Japanese."""
    s = summaries.join(allowed.select("thread", F.col("event_ids").alias("allowed")), "thread", "left")
    items = F.col("items")
    cited = F.concat(F.col("state.event_ids"), F.flatten(F.transform(items, lambda i: i["event_ids"])))
    tentative = F.exists(items, lambda i: (i["label"] == DECISION) & i["text"].rlike("|".join(TENTATIVE)))
    ends = F.exists(items, lambda i: i["start_id"].isNotNull() & ~(F.array_contains(i["event_ids"], i["start_id"]) & F.array_contains(i["event_ids"], i["end_id"])))
    fault = (
        F.when((F.col("state.work_state") == "done") & ((F.size("state.unresolved") > 0) | (strip(F.col("state.continuation")) != "")), "done-but-open")
        .when(F.size("state.event_ids") == 0, "state-without-source")
        .when(F.exists(items, lambda i: (strip(i["text"]) == "") | (F.size(i["event_ids"]) == 0)), "item-without-source")
        .when(tentative, "tentative-decision").when(ends, "endpoint-not-cited")
        .when(F.size(F.array_except(cited, F.coalesce("allowed", F.array().cast("array<string>")))) > 0, "unknown-event")
    )
    for phrase in phrases or ():
        fault = fault.when(fold(F.to_json(F.struct("state", "items"))).contains(phrase), "avoidable-phrase")
    return s.select("thread", fault.alias("fault"))


def _ends(items: DataFrame, events: DataFrame) -> DataFrame:
    """Items with the events that they start and end at; events without a branch_id
    column have no branch."""
    branch = F.coalesce("branch_id", F.lit("")) if "branch_id" in events.columns else F.lit("")
    w = Window.partitionBy("thread").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    e = events.withColumn("users", F.sum(F.when(F.col("actor") == "user", 1).otherwise(0)).over(w)).withColumn("branch_id", branch)
    end = lambda p: e.select("thread", F.col("local_id").alias(f"{p}_id"), F.struct("ord", "kind", "actor", "turn_id", "branch_id", "timestamp", "users").alias(p))
    return items.join(end("start"), ["thread", "start_id"], "left").join(end("end"), ["thread", "end_id"], "left")


def validate_timeline(items: DataFrame, events: DataFrame) -> DataFrame:
    """(thread, pos, fault) of items (thread, pos, start_id, end_id, event_ids, text) that
    break a rule, and, with a null pos, of threads with a user message that no item
    starts at. Ends come first, then paths, order and ranges. "A user event between" is a
    difference of running counts. Items of one position share what their paths lack."""
    x = _ends(items, events)
    s, e = F.col("start"), F.col("end")
    day = lambda c: local_time(c["timestamp"], "day")
    unlike = (s["actor"] != e["actor"]) | (s["kind"] != e["kind"]) | (s["turn_id"] != e["turn_id"]) | (s["branch_id"] != e["branch_id"]) | s["kind"].isin("user_message", "assistant_message")
    times = epoch_of(s["timestamp"]).isNull() | epoch_of(e["timestamp"]).isNull() | (day(s) != day(e)) | (epoch_of(s["timestamp"]) > epoch_of(e["timestamp"]))
    uncited = ~(F.array_contains("event_ids", F.col("start_id")) & F.array_contains("event_ids", F.col("end_id")))
    fault = (
        F.when(s.isNull() | e.isNull(), "unknown-endpoint").when(uncited, "endpoint-not-cited").when(s["ord"] > e["ord"], "order")
        .when((F.col("start_id") != F.col("end_id")) & (unlike | times | (s["users"] != e["users"])), "range")
    )
    bad = x.withColumn("fault", fault).filter("fault IS NOT NULL").select("thread", "pos", "fault")
    slash = lambda c: fold(F.replace(F.replace(c, F.lit("\\\\"), F.lit("\\")), F.lit("\\"), F.lit("/")))
    quoted = items.select("thread", "pos", "event_ids", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(QUOTED), 1))).alias("lit")).filter(F.col("lit").rlike(LITERAL_PATH))
    cited = quoted.withColumn("local_id", F.explode("event_ids")).join(events.select("thread", "local_id", F.col("text").alias("source")), ["thread", "local_id"], "left")
    shown = cited.groupBy("thread", "pos", "lit").agg(F.coalesce(F.bool_or(F.contains(slash(F.col("source")), fold(F.replace("lit", F.lit("\\"), F.lit("/"))))), F.lit(False)).alias("ok"))
    first = bad.filter(F.col("fault").isin("unknown-endpoint", "endpoint-not-cited"))
    paths = shown.filter("NOT ok").select("thread", "pos", F.lit("path-not-in-source").alias("fault")).distinct().join(first, ["thread", "pos"], "left_anti")
    left = events.filter("kind = 'user_message'").join(items.select("thread", F.col("start_id").alias("local_id")), ["thread", "local_id"], "left_anti")
    missing = left.select("thread", F.lit(None).cast(dict(items.dtypes)["pos"]).alias("pos"), F.lit("user-message-missing").alias("fault")).distinct()
    return bad.join(paths, ["thread", "pos"], "left_anti").unionByName(paths).unionByName(missing)


def render_timeline(items: DataFrame, events: DataFrame, notice: str) -> DataFrame:
    """(thread, timeline): items in source order below a heading for each new day, and one
    for each new branch if there are branches, with times at +09:00 or Unknown, actor,
    label, text, range and sources without repeats."""
    x = _ends(items, events)
    day = F.coalesce(local_time(F.col("start.timestamp"), "day"), F.lit("Unknown date"))
    w = Window.partitionBy("thread").orderBy("start.ord", "pos")
    x = x.withColumn("day", day).withColumn("before", F.lag("day").over(w)).withColumn("branch", F.nullif("start.branch_id", F.lit("")))
    x = x.withColumn("new", F.col("branch").isNotNull() & ~F.last("branch", True).over(w.rowsBetween(Window.unboundedPreceding, -1)).eqNullSafe(F.col("branch")))
    clock = F.coalesce(local_time(F.col("start.timestamp"), "clock"), F.lit("Unknown"))
    until = F.when(F.col("start_id") != F.col("end_id"), F.concat(F.lit(" - "), local_time(F.col("end.timestamp"), "clock")))
    actor = F.col("start.actor")
    for k, v in ACTORS.items():
        actor = F.when(F.col("start.actor") == k, v).otherwise(actor)
    text = F.regexp_replace(F.regexp_replace(strip(F.col("text")), LINE_END, "\n"), "\n(?=[^\n])", "\n    ")
    history = F.when(F.col("new"), F.concat(F.lit("### History "), F.col("branch"), F.lit("\n\n"))).otherwise("")
    heading = F.when(F.col("before").eqNullSafe(F.col("day")) & ~F.col("new"), "").otherwise(F.concat(F.when(F.col("branch").isNotNull(), "#### ").otherwise("### "), F.col("day"), F.lit("\n\n")))
    block = F.concat(
        history, heading, F.lit("- **"), clock, F.coalesce(until, F.lit("")), F.lit("**\n  - Actor: "), actor, F.lit("\n  - Type: "), F.col("label"), F.lit("\n  - Text: "), text,
        F.lit("\n  - EventRange: "), F.col("start_id"), F.lit(" -> "), F.col("end_id"), F.lit("\n  - Sources: "), F.array_join(F.array_distinct("event_ids"), ", "),
    )
    blocks = F.array_sort(F.collect_list(F.struct(F.col("start.ord").alias("ord"), "pos", block.alias("b"))))
    return x.groupBy("thread").agg(F.concat(F.lit(f"{notice}\n\n"), F.array_join(F.transform(blocks, lambda b: b["b"]), "\n\n")).alias("timeline"))


def render_notes(notes: DataFrame, template: str) -> DataFrame:
    """Adds ``note``: the template's ``{{column}}`` places filled from columns. It is cut
    once on the driver, so inserted text is never read as a place again; a section
    ``{{?column}}...{{/}}`` stays only where the column is neither null nor empty."""

    def fill(part: str) -> Column:
        bits = re.split(r"\{\{(\w+)\}\}", part)
        return F.concat(*(F.coalesce(F.col(b), F.lit("")) if i % 2 else F.lit(b) for i, b in enumerate(bits)))

    cuts = re.split(r"\{\{\?(\w+)\}\}(.*?)\{\{/\}\}", template, flags=re.S)
    out = []
    for i in range(0, len(cuts), 3):
        out.append(fill(cuts[i]))
        if i + 2 < len(cuts):
            out.append(F.when(F.coalesce(F.col(cuts[i + 1]), F.lit("")) != "", fill(cuts[i + 2])).otherwise(""))
    return notes.withColumn("note", F.concat(*out))


def note_names(notes: DataFrame, existing: DataFrame, zone_hours: int = 9) -> DataFrame:
    """Adds ``name``, the file of a new note: the thread's start in a zone of whole hours, then
    the title if it is a slug, else its slug. Where ``existing`` (name) has that file, or a note of a
    smaller thread gets it, up to 8 letters and digits of the thread's id follow.
    Columns: thread, started_at, title. Notes without a readable start have no name."""
    at, title = F.col("started_at"), F.coalesce("title", F.lit(""))
    slug = F.when(title.rlike(SLUG), title).otherwise(slugify(title))
    stamp = F.concat(F.replace(local_time(at, "day", zone_hours), F.lit("-")), F.lit("T"), F.replace(local_time(at, "clock", zone_hours), F.lit(":")), F.lit(f"{zone_hours:+03d}00"))
    x = notes.withColumn("_base", F.concat(stamp, F.lit("-"), slug)).join(existing.select(F.regexp_replace("name", r"[.]md$", "").alias("_base"), F.lit(True).alias("_taken")).distinct(), "_base", "left")
    later = F.row_number().over(Window.partitionBy("_base", F.when(F.col("_base").isNull(), F.col("thread"))).orderBy("thread")) > 1
    short = F.substring(F.regexp_replace(F.col("thread").cast("string"), "[^A-Za-z0-9]", ""), 1, 8)
    suffix = F.when(F.coalesce("_taken", F.lit(False)) | later, F.concat(F.lit("-"), F.coalesce(F.nullif(short, F.lit("")), F.lit("thread")))).otherwise("")
    return x.withColumn("name", F.concat("_base", suffix, F.lit(".md"))).drop("_base", "_taken")


def _meta(key: str) -> Column:
    return F.coalesce(F.col("meta")[key], F.lit(""))


def _any(c: Column, rule: Any) -> Column:
    """Whether the rule holds for an item; a null item counts as empty."""
    return F.exists(c, lambda x: rule(F.coalesce(x, F.lit(""))))


def _state_fault() -> tuple[Column, Column]:
    """(the note's work state, '' if it names none, and whether ``status`` differs from it)."""
    named = F.regexp_extract("body", WORK_STATE, 1)
    return named, _meta("status") != named


def validate_notes(notes: DataFrame) -> DataFrame:
    """Adds ``fault`` to notes, null or the first rule that one breaks: version, a required
    value, id, capture (both fields or none), captures (several, with their set's digest),
    a generator's field, source, heading, work state and status. Columns: meta (map), body,
    and the lists thread_ids, source_refs, capture_refs, capture_digests. Nulls are empty."""
    lists = ("thread_ids", "source_refs", "capture_refs", "capture_digests")
    x = notes.withColumns({f"_{c}": F.coalesce(c, F.array().cast("array<string>")) for c in lists}).withColumn("body", F.coalesce("body", F.lit("")))
    version = F.coalesce(F.nullif(_meta("schemaVersion"), F.lit("")), F.lit("1"))
    n = _meta("schemaVersion").try_cast("int")
    fault = F.when(~version.isin(NOTE_VERSIONS), "version").when(_meta("type") != F.when(n >= 6, "sessionNote").otherwise("threadNote"), "type")
    for key, value in NOTE_VALUES.items():
        fault = fault.when(_meta(key) != value, key)
    digest = "^[0-9a-f]{64}$"
    ref, sha, refs, shas = _meta("sourceCaptureRef"), _meta("sourceCaptureSha256"), F.col("_capture_refs"), F.col("_capture_digests")
    one = ((ref == "") != (sha == "")) | ((ref != "") & ~(ref.startswith("raw:/") & sha.rlike(digest)))
    several = (F.size(refs) > 0) | (F.size(shas) > 0) | (_meta("sourceSetSha256") != "")
    unlike = (
        (F.size(refs) < 2) | (F.size(refs) != F.size(shas)) | (F.size(F.array_distinct(shas)) != F.size(shas)) | _any(refs, lambda x: ~x.startswith("raw:/")) | _any(shas, lambda x: ~x.rlike(digest))
        | (_meta("sourceSetSha256") != set_digest(shas)) | (ref != F.coalesce(F.get(refs, F.lit(0)), F.lit(""))) | (sha != F.coalesce(F.get(shas, F.lit(0)), F.lit("")))
    )
    fault = fault.when((n >= 4) & ~_meta("id").rlike(UUID4), "id").when((n >= 4) & one, "capture").when(several & unlike, "captures")
    for kind in ("prompt", "template"):
        fault = fault.when(~is_uuid(_meta(f"{kind}Id")), f"{kind}Id").when(_meta(f"{kind}Version") == "", f"{kind}Version")
    fault = fault.when(~_meta("outputSchemaSha256").rlike(digest), "outputSchemaSha256").when((F.size("_thread_ids") != 1) | (F.size("_source_refs") != 1), "source").when(_meta("sourceFingerprint") == "", "sourceFingerprint")
    for h in HEADINGS:
        since, old = OLD_HEADINGS.get(h, (0, h))
        fault = fault.when(~F.contains("body", F.when(n >= since, h).otherwise(old)), f"heading {h}")
    named, differs = _state_fault()
    fault = fault.when(named == "", "work-state").when(differs, "status")
    return x.withColumn("fault", fault).drop(*(f"_{c}" for c in lists))


def validate_staged(notes: DataFrame, candidates: DataFrame, settings: dict[str, str]) -> DataFrame:
    """(name, thread, fault) of a staged set, one fault for each pair of note and thread:
    what is wrong with the note itself, repeated (several notes of the thread), what differs
    from its candidate (source-refs, session-note-id, date, at +09:00, and for ``strict``
    ones the generator's ``settings``, fingerprint, capture and file-slug), and, without a
    name, missing (a candidate without a note). Columns: notes name, meta, body, thread_ids,
    source_refs; candidates thread (one row each), source_ref, started_at, fingerprint,
    capture_ref, capture_sha256, strict. A candidate without a readable start has no faults
    of time. Nulls are empty; notes without threads are no fault by that."""
    of = notes.select("name", "meta", F.coalesce("body", F.lit("")).alias("body"), F.coalesce("source_refs", F.array().cast("array<string>")).alias("source_refs"), F.explode_outer("thread_ids").alias("thread"))
    named, differs = _state_fault()
    backed = F.col("thread").isNotNull()
    fault = F.when(_meta("schemaVersion") != NOTE_VERSIONS[-1], "version").when(~_meta("id").rlike(UUID4), "id").when(_meta("type") != "sessionNote", "type")
    fault = fault.when(backed & (_meta("reviewStatus") != NOTE_VALUES["reviewStatus"]), "reviewStatus").when(backed & ((_meta("sourceType") != NOTE_VALUES["sourceType"]) | (F.size("source_refs") == 0)), "provenance")
    for h in HEADINGS:
        fault = fault.when(~F.contains("body", F.lit(h)), f"heading {h}")
    fault = fault.when((named != "") & differs, "status")
    again = of.filter(backed).groupBy("thread").agg(F.count("*").alias("_n")).filter("_n > 1")
    want = candidates.select("thread", F.struct("source_ref", "started_at", "fingerprint", "capture_ref", "capture_sha256", "strict").alias("c"))
    x = of.join(again, "thread", "left").join(want, "thread", "left")
    day, clock = local_time(F.col("c.started_at"), "day"), local_time(F.col("c.started_at"), "clock")
    note_id = F.concat(F.replace(day, F.lit("-")), F.lit("T"), F.replace(clock, F.lit(":")), F.lit("+0900"))
    fault = fault.when(F.col("_n").isNotNull(), "repeated").when(F.col("c").isNotNull() & ~F.col("source_refs").eqNullSafe(F.array("c.source_ref")), "source-refs")
    fault = fault.when((_meta("sessionNoteId") != note_id) | ~F.startswith("name", F.concat(note_id, F.lit("-"))), "session-note-id").when(_meta("date") != F.concat(day, F.lit("T"), clock, F.lit("+09:00")), "date")
    strict = F.coalesce(F.col("c.strict"), F.lit(False))
    for key, value in (settings | {"automatedValidation": NOTE_VALUES["automatedValidation"]}).items():
        fault = fault.when(strict & (_meta(key) != value), key)
    for key, col, always in (("sourceFingerprint", "fingerprint", True), ("sourceCaptureRef", "capture_ref", False), ("sourceCaptureSha256", "capture_sha256", False)):
        value = F.coalesce(F.col(f"c.{col}"), F.lit(""))
        fault = fault.when(strict & (F.lit(always) | (value != "")) & (_meta(key) != value), key)
    fault = fault.when(strict & (~_meta("fileSlug").rlike(SLUG) | (F.col("name") != F.concat(note_id, F.lit("-"), _meta("fileSlug"), F.lit(".md")))), "file-slug")
    wrong = x.select("name", "thread", fault.alias("fault")).filter("fault IS NOT NULL")
    missing = candidates.join(of.filter(backed).select("thread"), "thread", "left_anti").select(F.lit(None).cast("string").alias("name"), "thread", F.lit("missing").alias("fault"))
    return wrong.unionByName(missing)


def check_artifact_version(rows: DataFrame, supported: dict[str, list[str]]) -> DataFrame:
    """Adds ``supported`` by kind; an artefact without a version counts as "1"."""
    ok = F.lit(False)
    for kind, versions in supported.items():
        ok = F.when(F.col("kind") == kind, F.coalesce("version", F.lit("1")).isin(versions)).otherwise(ok)
    return rows.withColumn("supported", ok)


def note_metrics(notes: DataFrame, events: DataFrame) -> DataFrame:
    """Bytes of notes and of their conversations, and user messages, by thread."""
    n = notes.groupBy("thread").agg(F.sum(F.octet_length("note")).alias("note_bytes"))
    e = events.groupBy("thread").agg(F.sum(F.octet_length("text")).alias("event_bytes"), F.count_if(F.col("kind") == "user_message").alias("user_messages"))
    return e.join(n, "thread", "left")
