"""Model inputs: redaction, sizes, gapless splits, chunks, coverage, partial results."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talespark.functions.text import epoch_of, redact
from talespark.operators.histories import json_string

# Characters of one serialised array of events, and where texts may be cut.
BUDGET = 120_000
BOUNDARY = r"\n|[。！？]\s*|\s+"

KEYS = {"id": "local_id", "kind": "kind", "actor": "actor", "name": "name", "text": "text", "timestamp": "timestamp", "turnId": "turn_id"}


#: Keys that events of a conversation with several branches have too.
BRANCH_KEYS = {"branchId": "branch_id", "rawRef": "raw_ref"}


def has_branches(events: DataFrame) -> bool:
    return "branch_id" in events.columns


def prepare_events(events: DataFrame) -> DataFrame:
    """Secrets go before anything is cut, so no part boundary can show one; no folders."""
    return events.withColumn("text", redact(F.col("text"))).drop("cwd", "thread_cwd")


def json_chars(c: Column) -> Column:
    """Characters of a text as a JSON string with its quotes."""
    c = F.coalesce(c, F.lit(""))
    return F.length(c) + 2 + F.regexp_count(c, F.lit(r'["\\\n\r\t\x08\x0C]')) + 5 * F.regexp_count(c, F.lit(r"[\x00-\x07\x0B\x0E-\x1F]"))


def event_size(branches: bool = False) -> Column:
    """Characters of an event's JSON, one space behind colons and commas. With
    ``branches``, events that have a branch_id carry it and their raw_ref."""
    size = F.lit(2 + 2 * (len(KEYS) - 1))
    for key, col in KEYS.items():
        size = size + json_chars(F.col(col)) + len(key) + 4
    if branches:
        more = sum((json_chars(F.col(col)) + len(key) + 6 for key, col in BRANCH_KEYS.items()), F.lit(0))
        size = size + F.when(F.coalesce("branch_id", F.lit("")) != "", more).otherwise(0)
    return size


def cut(text: str, budget: int) -> list[tuple[int, int]]:
    """(start, end) of parts whose JSON takes at most ``budget`` characters each, ending
    behind a line, sentence or space of the second half where there is one."""
    wide = np.array([2 if c in '"\\\n\r\t\b\f' else 6 if c < " " else 1 for c in text])
    total = np.concatenate([[0], np.cumsum(wide)])
    parts, start = [], 0
    while start < len(text):
        end = int(np.searchsorted(total, total[start] + budget, "right")) - 1
        if end < len(text):
            half = start + (end - start) // 2
            ends = [half + m.end() for m in re.finditer(BOUNDARY, text[half:end])]
            end = ends[-1] if ends else end
        parts.append((start, end))
        start = end
    return parts


def split_events(prepared: DataFrame, budget: int = BUDGET) -> DataFrame:
    """Events with ``part`` of ``parts``, ``start``, ``end``, ``full_chars`` and ``size``; those
    beyond the budget in gapless parts. A budget too small for an event's metadata is an
    error. Null texts are empty; branch_id and raw_ref count where there are such columns."""
    sized = prepared.withColumn("size", event_size(has_branches(prepared))).withColumn("full_chars", F.length(F.coalesce("text", F.lit(""))))
    whole = sized.filter(F.col("size") + 2 <= budget)
    n = F.length("text")
    fits = whole.withColumns({"part": F.lit(1), "parts": F.lit(1), "start": F.lit(0), "end": n})
    big = sized.filter(F.col("size") + 2 > budget)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.to_dict("records"):
                text = row["text"] or ""
                size, n = row["size"] - (len(json.dumps(text, ensure_ascii=False)) - 2), len(text)
                note = {"index": n, "count": max(2, n), "start": n, "end": n, "fullTextCharacters": n}
                room = budget - 2 - size - len(', "textPart": ') - len(json.dumps(note))
                if room < 6 or not n:
                    raise ValueError(f"budget of {budget} characters is too small for event {row['local_id']}")
                cuts = cut(text, room)
                yield pd.DataFrame([row | {"text": text[a:b], "size": budget - 2, "part": i, "parts": len(cuts), "start": a, "end": b} for i, (a, b) in enumerate(cuts, 1)])

    return fits.unionByName(big.mapInPandas(run, fits.schema))


def chunk_events(split: DataFrame, budget: int = BUDGET) -> DataFrame:
    """Adds ``chunk`` (from 1 in each thread): events in order while their array fits,
    parts of split events alone. One exchange; a thread streams through its task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, chunk, used, alone = None, 0, 0, True
        for pdf in batches:
            out = np.zeros(len(pdf), np.int32)
            for i, (thread, size, parts) in enumerate(zip(pdf["thread"], pdf["size"], pdf["parts"])):
                if thread != now:
                    now, chunk, alone = thread, 0, True
                if parts > 1 or alone or used + 2 + size > budget:
                    chunk, used = chunk + 1, 2 + size
                else:
                    used += 2 + size
                alone = parts > 1
                out[i] = chunk
            yield pdf.assign(chunk=out)

    ordered = split.repartition("thread").sortWithinPartitions("thread", "ord", "part")
    return ordered.mapInPandas(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in split.schema) + ", chunk int")


def input_manifest(chunks: DataFrame) -> DataFrame:
    """One row per part: where its text lies in the event, and its digest."""
    return chunks.select("thread", "local_id", "chunk", "part", "parts", "start", "end", F.sha2("text", 256).alias("sha256"))


def check_coverage(chunks: DataFrame, prepared: DataFrame) -> DataFrame:
    """(thread, local_id) of events whose parts do not give their text again."""
    p = chunks.groupBy("thread", "local_id").agg(F.array_sort(F.collect_list(F.struct("start", "text"))).alias("p"))
    again = p.select("thread", "local_id", F.array_join(F.transform("p", lambda x: x["text"]), "").alias("again"))
    return prepared.join(again, ["thread", "local_id"], "left").filter(~F.col("text").eqNullSafe(F.col("again"))).select("thread", "local_id")


def input_metrics(chunks: DataFrame) -> DataFrame:
    """One row per thread: chunks, split events, all parts and those of split events,
    characters submitted, and characters of the prepared events (each counted once)."""
    split = F.col("parts") > 1
    return chunks.groupBy("thread").agg(
        F.max("chunk").alias("chunks"), F.count_if(split & (F.col("part") == 1)).alias("split_events"), F.count_if(split).alias("text_parts"), F.sum(F.length("text")).alias("characters"),
        F.count("*").alias("input_parts"), F.sum(F.when(F.col("part") == 1, F.col("full_chars"))).alias("prepared_characters"),
    )


def render_requests(chunks: DataFrame, head: str, tail: str = "") -> DataFrame:
    """(thread, chunk, request): the template's text around one array of events, parts of
    split events with their offsets, events of branches with these. A chunk is bounded by
    the budget."""
    text = lambda k, c: F.concat(F.lit(f'"{k}": '), json_string(F.coalesce(F.col(c), F.lit(""))))
    cols = [text(k, c) for k, c in KEYS.items()]
    if has_branches(chunks):
        cols += [F.when(F.coalesce("branch_id", F.lit("")) != "", text(k, c)) for k, c in BRANCH_KEYS.items()]
    place = {"index": "part", "count": "parts", "start": "start", "end": "end", "fullTextCharacters": "full_chars"}
    part = F.concat_ws(", ", *(F.concat(F.lit(f'"{k}": '), F.col(c).cast("string")) for k, c in place.items()))
    cols.append(F.when(F.col("parts") > 1, F.concat(F.lit('"textPart": {'), part, F.lit("}"))))
    row = F.struct("ord", "part", F.concat(F.lit("{"), F.concat_ws(", ", *cols), F.lit("}")).alias("json"))
    parts = F.transform(F.array_sort(F.collect_list(row)), lambda x: x["json"])
    return chunks.groupBy("thread", "chunk").agg(F.concat(F.lit(head), F.lit("["), F.array_join(parts, ", "), F.lit("]"), F.lit(tail)).alias("request"))


def render_reduction(partials: DataFrame, head: str, tail: str = "") -> DataFrame:
    """(thread, chunk, request) that asks for one summary of a thread's partial results
    (thread, chunk, result), an array in the order of the chunks; chunk is 0. Failed
    parts (null results) are left out."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("chunk", "result"))), lambda x: x["result"])
    asked = partials.filter("result IS NOT NULL").groupBy("thread").agg(F.concat(F.lit(head), F.lit("["), F.array_join(parts, ", "), F.lit("]"), F.lit(tail)).alias("request"))
    return asked.select("thread", F.lit(0).alias("chunk"), "request")


def render_repair(results: DataFrame, faults: DataFrame, head: str, tail: str = "") -> DataFrame:
    """(thread, chunk, request) for results (thread, chunk, result) that have faults (thread,
    fault): the faults, sorted, as lines behind ``head``, then the result."""
    said = faults.groupBy("thread").agg(F.array_join(F.sort_array(F.collect_set("fault")), "\n- ").alias("said"))
    return results.join(said, "thread").select("thread", "chunk", F.concat(F.lit(head), F.lit("\n- "), "said", F.lit("\n"), F.coalesce("result", F.lit("")), F.lit(tail)).alias("request"))


def summarize(requests: DataFrame, fn: Callable[[str], str]) -> DataFrame:
    """(thread, chunk, result, error): a model call for each request; a failed call is a
    row with its error and stops no other."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for thread, chunk, request in zip(pdf["thread"], pdf["chunk"], pdf["request"]):
                try:
                    rows.append((thread, chunk, fn(request), None))
                except Exception as e:  # any failure of the caller's function belongs to its row
                    rows.append((thread, chunk, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["thread", "chunk", "result", "error"])

    kind = dict(requests.dtypes)["thread"]
    return requests.select("thread", "chunk", "request").mapInPandas(run, f"thread {kind}, chunk int, result string, error string")


# How a note names events whose time or zone is unknown, by language.
UNKNOWN_TIMES = {"en": "Events with an unknown timestamp or time zone: ", "ja": "日時またはタイムゾーンが確認できないイベント："}


def merge_partials(partials: DataFrame, events: DataFrame | None = None, language: str = "en") -> DataFrame:
    """(thread, timeline, limitations): chunks' timelines one after another, limitations
    without repeats. With ``events`` (thread, ord, local_id, timestamp), threads with events
    whose time is unreadable or has no zone get one more limitation that lists them in
    order. Null arrays are empty."""
    given = lambda c: F.coalesce(F.col(c), F.array().cast(dict(partials.dtypes)[c])).alias(c)
    ordered = F.array_sort(F.collect_list(F.struct("chunk", given("timeline"), given("limitations"))))
    x = partials.groupBy("thread").agg(ordered.alias("p")).select("thread", F.flatten("p.timeline").alias("timeline"), F.flatten("p.limitations").alias("limitations"))
    if events is not None:
        ids = F.transform(F.array_sort(F.collect_list(F.struct("ord", "local_id"))), lambda e: e["local_id"])
        unknown = events.filter(epoch_of(F.col("timestamp")).isNull()).groupBy("thread").agg(F.concat(F.lit(UNKNOWN_TIMES[language]), F.array_join(ids, ", ")).alias("_unknown"))
        x = x.join(unknown, "thread", "left").withColumn("limitations", F.when(F.col("_unknown").isNull(), F.col("limitations")).otherwise(F.array_append("limitations", F.col("_unknown")))).drop("_unknown")
    return x.withColumn("limitations", F.array_distinct("limitations"))
