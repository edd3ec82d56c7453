"""Log lines to ordered events: parsing, classification, context, de-duplication."""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talespark.functions.text import clean_user_text, event_epoch, fold, normalize_text, strip

# Record and payload types.
RECORD_TYPES = ["session_meta", "turn_context", "response_item", "event_msg", "compacted", "world_state", "token_usage_record", "message", "reasoning", "function_call", "function_call_output"]
CALLS = ["custom_tool_call", "function_call", "tool_call"]
OUTPUTS = ["custom_tool_call_output", "function_call_output", "tool_call_output"]
SEARCHES = ["web_search_call", "tool_search_call"]
NOT_EVIDENCE = ["agent_reasoning", "token_count", "task_started", "thread_settings_applied", "context_compacted"]
DROPPED_KEYS = ["type", "last_agent_message"]

#: Labels read from a record and, with the prefix p_, from its payload.
LABELS = ["type", "timestamp", "role", "id", "cwd"]
PAYLOAD_LABELS = ["type", "timestamp", "role", "id", "session_id", "cwd", "turn_id", "phase", "name", "call_id", "message", "originator", "source", "thread_source"]
PARSED = [*LABELS, *(f"p_{x}" for x in PAYLOAD_LABELS), "content", "input", "output", "whole", "repository_url", "record_type", "history_base"]

# How a review of an approval starts, and the sources of internal threads.
APPROVAL_MARKER = "The following is the Codex agent history"
INTERNAL_SOURCES = ["approval_review", "subagent"]


def stable_json(value: Any) -> str:
    """Text of a payload: strings as they are, the rest compact with sorted keys."""
    if value is None or isinstance(value, str):
        return value or ""
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"))


def joined_content(content: Any) -> str:
    """A plain string, or the texts of a list's objects joined by newlines."""
    if isinstance(content, str):
        return content
    items = (x.get("text") or x.get("input_text") for x in content if isinstance(x, dict)) if isinstance(content, list) else ()
    return "\n".join(x for x in items if isinstance(x, str) and x)


def fields(raw: str) -> dict[str, Any]:
    """State (object, other, bad; null is bad) of one line and the fields that later steps name.
    Of repeated keys the last counts."""
    try:
        record = json.loads(raw or "")
    except (ValueError, RecursionError):
        return {"state": "bad"}
    if not isinstance(record, dict):
        return {"state": "other"}
    inner = record["payload"] if isinstance(record.get("payload"), dict) else {}
    out: dict[str, Any] = {"state": "object", "header": bool(record.get("id")) and not record.get("type") and "instructions" in record}
    out |= {k: str(record.get(k) or "") for k in LABELS} | {f"p_{k}": str(inner.get(k) or "") for k in PAYLOAD_LABELS}
    shown = inner if out["p_type"] in SEARCHES else {k: v for k, v in inner.items() if k not in DROPPED_KEYS} if out["type"] == "event_msg" and out["p_type"] not in ("user_message", "agent_message") else {}
    git = (record if out["header"] else inner).get("git")
    return out | {
        "content": joined_content((record if out["type"] == "message" else inner).get("content")),
        "input": stable_json(inner["input"] if "input" in inner else inner.get("arguments")),
        "output": stable_json(inner.get("output")),
        "whole": stable_json(shown) if shown else "",
        "repository_url": str(git.get("repository_url") or "") if isinstance(git, dict) else "",
        "record_type": str(record.get("record_type") or ""),
        "history_base": stable_json(inner.get("history_base")),
    }


def parse_lines(lines: DataFrame) -> DataFrame:
    """Lines (keys, line_no, raw) with ``state``, ``header`` and the fields in place of
    ``raw``. One Arrow pass; a lone surrogate in an escape becomes U+FFFD."""
    keys = [c for c in lines.columns if c != "raw"]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in lines.select(keys).schema] + ["state string", "header boolean"] + [f"{c} string" for c in PARSED])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        clean = lambda v: v.encode("utf-16", "surrogatepass").decode("utf-16", "replace") if isinstance(v, str) and not v.isascii() else v
        for pdf in batches:
            got = pd.DataFrame([{k: clean(v) for k, v in fields(x).items()} for x in pdf["raw"]], columns=["state", "header", *PARSED], index=pdf.index).astype(object)
            got = got.where(got.notna(), None)
            got["header"] = got["header"].map(bool)
            yield pd.concat([pdf[keys], got], axis=1)

    return lines.mapInPandas(run, schema)


def _given(c: Column) -> Column:
    return F.when(c != "", c)


def fill_context(parsed: DataFrame, key: str) -> DataFrame:
    """Adds ``turn_id``, ``thread_cwd``, ``cwd`` and ``header_at`` as of each line: two passes
    over one partitioning. A header sets the thread's folder and resets the turn's; a turn
    without a folder takes the thread's at that point. ``header_at`` is the time in the last
    session_meta, else in the first old header, so far, else empty."""
    w = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    meta, turn = F.col("type") == "session_meta", F.col("type") == "turn_context"
    thread = parsed.withColumn("thread_cwd", F.coalesce(F.last(F.when(meta, _given(F.col("p_cwd"))).when(F.col("header"), _given(F.col("cwd"))), True).over(w), F.lit("")))
    at = F.when(meta | F.col("header"), F.col("thread_cwd")).when(turn, F.coalesce(_given(F.col("p_cwd")), "thread_cwd"))
    turn_cwd = _given(F.last(at, True).over(w))
    turn_id = F.coalesce(F.last(F.when(turn, F.col("p_turn_id")), True).over(w), F.lit(""))
    header_at = F.coalesce(F.last(F.when(meta, F.col("p_timestamp")), True).over(w), F.first(F.when(F.col("header"), F.col("timestamp")), True).over(w), F.lit(""))
    return thread.withColumn("turn_id", turn_id).withColumn("cwd", F.coalesce(turn_cwd, "thread_cwd")).withColumn("header_at", header_at)


def classify_records(filled: DataFrame, key: str) -> DataFrame:
    """(key, line_no, kind, actor, name, text, timestamp, turn_id, cwd, said_at) of the lines
    that are events with a text. ``said_at`` is the time of a message: an old one without a
    time has its header's, an event has none but its own."""
    item, note, t = F.col("type") == "response_item", F.col("type") == "event_msg", F.col("p_type")
    old, role = F.col("type") == "message", F.when(F.col("type") == "message", F.col("role")).otherwise(F.col("p_role"))
    spoken = (old | (item & t.isin("", "message"))) & role.isin("user", "assistant")
    mirrored = note & t.isin("user_message", "agent_message")
    call, search, output = item & t.isin(CALLS), item & t.isin(SEARCHES), item & t.isin(OUTPUTS)
    other = note & ~t.isin("", "user_message", "agent_message", *NOT_EVIDENCE)
    speaker = F.when(mirrored, F.when(t == "user_message", "user").otherwise("assistant")).otherwise(role)
    ended = t.endswith("_end") | t.endswith("_complete")
    kind = F.when(spoken | mirrored, F.concat(speaker, F.lit("_message"))).when(call | search, "tool_call").when(output, "tool_result").when(other, F.when(ended, "tool_result").otherwise("event"))
    actor = F.when(spoken | mirrored, speaker).when(call | search, "assistant").otherwise("tool")
    name = (
        F.when(old, "legacy").when(spoken | (mirrored & (t == "agent_message")), F.col("p_phase")).when(mirrored, "")
        .when(call, F.coalesce(_given(F.col("p_name")), t)).when(output, F.coalesce(_given(F.col("p_name")), _given(F.col("p_call_id")), t)).otherwise(t)
    )
    text = F.when(spoken, F.col("content")).when(mirrored, F.col("p_message")).when(call, F.col("input")).when(output, F.col("output")).otherwise(F.col("whole"))
    said_at = F.when(old & (F.coalesce("timestamp", F.lit("")) == ""), F.col("header_at")).otherwise(F.col("timestamp"))
    out = filled.select(key, "line_no", kind.alias("kind"), actor.alias("actor"), name.alias("name"), text.alias("text"), "timestamp", "turn_id", "cwd", said_at.alias("said_at"))
    raw = F.col("text")
    clean = F.when(F.col("actor") == "user", clean_user_text(raw)).otherwise(strip(raw))
    return out.filter("kind IS NOT NULL").withColumn("text", clean).filter("text <> ''")


def dedupe_events(events: DataFrame, key: str) -> DataFrame:
    """The first of mirrored messages (kind, actor, turn, normalised text); tool events
    all stay. The key holds a digest in place of the text."""
    message = F.col("kind").isin("user_message", "assistant_message")
    keyed = events.withColumn("_key", F.when(message, F.sha2(normalize_text(F.col("text")), 256)).otherwise(F.col("line_no").cast("string")))
    w = Window.partitionBy(key, "kind", "actor", "turn_id", "_key").orderBy("line_no")
    return keyed.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n", "_key")


def with_event_ids(events: DataFrame) -> DataFrame:
    return events.withColumn("local_id", F.format_string("L%06d", "line_no"))


def log_events(lines: DataFrame, key: str) -> DataFrame:
    """All steps from lines to identified events. The key's partitioning is used by the
    context windows; de-duplication shuffles digests with the events."""
    return with_event_ids(dedupe_events(classify_records(fill_context(parse_lines(lines), key), key), key)).drop("said_at")


def thread_messages(lines: DataFrame, key: str) -> DataFrame:
    """(key, line_no, role, text, timestamp, turn_id, source, cwd): what users and assistants
    say, the first of messages with equal role, turn and normalised text. Any response item with
    such a role is a message, also one whose type makes another event or none. ``source`` is
    response_item, event_msg or legacy_message, ``cwd`` the turn's folder, else the thread's.
    Lines that are null or no record give none."""
    x = fill_context(parse_lines(lines), key)
    note, t, old = F.col("type") == "event_msg", F.col("p_type"), F.col("type") == "message"
    source = F.when(old, "legacy_message").when(F.col("type") == "response_item", "response_item").when(note & t.isin("user_message", "agent_message"), "event_msg")
    role = F.when(old, F.col("role")).when(note, F.when(t == "user_message", "user").otherwise("assistant")).otherwise(F.col("p_role"))
    text = F.when(note, F.col("p_message")).otherwise(F.col("content"))
    at = F.when(old & (F.col("timestamp") == ""), F.col("header_at")).otherwise(F.col("timestamp"))
    said = x.filter(source.isNotNull() & role.isin("user", "assistant")).select(key, "line_no", role.alias("role"), text.alias("text"), at.alias("timestamp"), "turn_id", source.alias("source"), "cwd")
    said = said.withColumn("text", F.when(F.col("role") == "user", clean_user_text(F.col("text"))).otherwise(strip(F.col("text")))).filter("text <> ''")
    first = dedupe_events(said.withColumns({"actor": F.col("role"), "kind": F.concat("role", F.lit("_message"))}), key)
    return first.drop("actor", "kind")


def history_bases(parsed: DataFrame, key: str) -> DataFrame:
    """(key, history_base) of each file with a session_meta: what the first one names as the
    history that it goes on from, JSON if it is no string, empty if it names none."""
    return parsed.filter("type = 'session_meta'").groupBy(key).agg(F.min_by("history_base", "line_no").alias("history_base"))


def thread_metadata(parsed: DataFrame, key: str) -> DataFrame:
    """One row per file with a header: the last session_meta, else the first old header."""
    meta = F.col("type") == "session_meta"
    get = lambda new, old: F.when(meta, F.col(new)).otherwise(F.col(old) if old else F.lit(""))
    row = F.struct(
        F.when(meta, F.coalesce(_given(F.col("p_id")), "p_session_id")).otherwise(F.col("id")).alias("thread_id"), get("p_timestamp", "timestamp").alias("started_at"), get("p_cwd", "cwd").alias("cwd"),
        get("p_originator", None).alias("originator"), get("p_source", None).alias("source"), get("p_thread_source", None).alias("thread_source"), F.col("repository_url"),
    )
    # of session_meta rows the last line wins, of old headers the first; the former before the latter
    rank = F.struct(meta.alias("m"), F.when(meta, F.col("line_no")).otherwise(-F.col("line_no")).alias("n"))
    return parsed.filter(meta | F.col("header")).groupBy(key).agg(F.max_by(row, rank).alias("r")).select(key, "r.*")


def diagnostics(parsed: DataFrame, key: str) -> DataFrame:
    """Per file: lines that are no JSON object, unknown record types, ids in headers, and
    the last record's time (in old files: the header's, or the last one given after it).
    A file has one row, in whichever order its lines come; nulls count as empty."""
    record, meta = F.col("state") == "object", F.col("type") == "session_meta"
    known = F.col("type").isin(RECORD_TYPES) | F.col("header") | ((F.col("type") == "") & (F.col("record_type") != ""))
    ids = F.when(meta, F.coalesce(_given(F.col("p_id")), _given(F.col("p_session_id")))).when(F.col("header"), F.col("id"))
    no = F.col("line_no")
    timed = F.when(record & (F.col("timestamp") != ""), no)
    # after an old header only a given time counts; without one the last record's does, given or not
    headed, given = F.min(F.when(F.col("header"), no)), F.max(timed)
    last = F.when(headed.isNull(), F.max_by("timestamp", F.when(record, no))).when(given > headed, F.max_by("timestamp", timed)).otherwise(F.min_by("timestamp", F.when(F.col("header"), no)))
    return parsed.groupBy(key).agg(
        F.sort_array(F.collect_list(F.when(~record, F.col("line_no")))).alias("invalid_lines"),
        F.sort_array(F.collect_set(F.when(record & ~known, F.col("type")))).alias("unknown_types"),
        F.sort_array(F.collect_set(ids)).alias("metadata_ids"),
        F.coalesce(last, F.lit("")).alias("last_event_at"),
    )


def thread_diagnostics(files: DataFrame) -> DataFrame:
    """(thread, invalid_lines, unknown_types, metadata_ids) of a thread: what ``diagnostics``
    found in any of its files, sorted, without repeats. Null arrays count as empty."""
    union = lambda c: F.sort_array(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)
    return files.groupBy("thread").agg(*(union(c) for c in ("invalid_lines", "unknown_types", "metadata_ids")))


def thread_flags(messages: DataFrame, metadata: DataFrame, key: str, review_prefix: str = APPROVAL_MARKER, internal_sources: list[str] = INTERNAL_SOURCES) -> DataFrame:
    """(key, approval_review, internal_source, has_user_message) of each key of
    ``metadata``. Messages (key, role, text) are those of all versions of a thread: it is
    a review if any user message starts with the prefix after leading white space, and
    internal if any row of ``metadata`` (key, thread_source) names one of the sources,
    whatever the case. Nulls count as empty."""
    user = F.col("role") == "user"
    review = F.coalesce(F.startswith(strip(F.col("text")), F.lit(review_prefix)), F.lit(False))
    said = messages.groupBy(key).agg(F.bool_or(user & review).alias("approval_review"), F.bool_or(user).alias("has_user_message"))
    named = fold(F.coalesce(F.col("thread_source"), F.lit(""))).isin([x.casefold() for x in internal_sources])
    flags = metadata.groupBy(key).agg(F.bool_or(named).alias("internal_source")).join(said, key, "left")
    no = F.lit(False)
    return flags.select(key, F.coalesce("approval_review", no).alias("approval_review"), "internal_source", F.coalesce("has_user_message", no).alias("has_user_message"))


def classify_threads(threads: DataFrame, now: str, idle_minutes: int = 30) -> DataFrame:
    """(status, reason) by fixed precedence. Columns: thread_id, invalid_lines,
    metadata_ids, internal, user_messages, started_at, last_event_at. A time without a
    zone is local (``event_epoch``); null or unreadable times fail."""
    last = event_epoch(F.col("last_event_at"))
    bad = (F.size("invalid_lines") > 0) | ~F.col("metadata_ids").eqNullSafe(F.array("thread_id"))
    reason = (
        F.when(bad, "invalid-jsonl").when(F.col("internal"), "approval-or-internal").when(F.col("user_messages") == 0, "without-user-message")
        .when(last.isNull() | event_epoch(F.col("started_at")).isNull(), "without-event-time").when(last > event_epoch(F.lit(now)) - idle_minutes * 60, "active-conversation")
    )
    status = F.when(reason.isNull(), "pending").when(reason.isin("invalid-jsonl", "without-event-time"), "failed").when(reason == "active-conversation", "deferred").otherwise("excluded")
    return threads.withColumn("status", status).withColumn("reason", reason)
