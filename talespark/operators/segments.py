"""Threads of any length: context and chunks by segments that run in parallel.

A thread is cut by its line numbers into segments. Each is summarised by what it hands on
(a carry); the carries of a thread, a row for each segment, are put together in order; then
every segment is finished on its own with what comes in. No task holds a thread.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talespark.operators.inputs import BUDGET
from talespark.operators.records import classify_records, dedupe_events, parse_lines, with_event_ids
from talespark.sources.tables import written

#: Lines or events of a segment.
SEGMENT = 65_536


def _given(c: Column) -> Column:
    return F.when(c != "", c)


def fill_context_by_segments(parsed: DataFrame, key: str, size: int = SEGMENT) -> DataFrame:
    """The columns that ``records.fill_context`` adds, by segments of ``size`` line numbers.

    A segment hands on its last thread folder, turn, header time and first old header, and
    its last turn folder, which may be "the thread's folder at the segment's start". Reads
    ``parsed`` twice, the first time few columns, so it should be a written table. Lines
    of a key have distinct numbers. An empty table gives no rows.
    """
    rows = parsed.withColumn("_seg", F.floor((F.col("line_no") - 1) / size).cast("long"))
    w = Window.partitionBy(key, "_seg").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    meta, turn = F.col("type") == "session_meta", F.col("type") == "turn_context"
    folder = F.when(meta, _given(F.col("p_cwd"))).when(F.col("header"), _given(F.col("cwd")))
    rows = rows.withColumn("_folder", F.last(folder, True).over(w))
    at = F.when(meta | F.col("header"), F.struct(F.col("_folder").alias("v"))).when(turn, F.struct(F.coalesce(_given(F.col("p_cwd")), "_folder").alias("v")))
    own = {
        "_at": F.last(at, True),
        "_turn": F.last(F.when(turn, F.col("p_turn_id")), True),
        "_meta": F.last(F.when(meta, F.col("p_timestamp")), True),
        "_head": F.first(F.when(F.col("header"), F.col("timestamp")), True),
    }
    rows = rows.withColumns({name: c.over(w) for name, c in own.items()})
    carry = rows.groupBy(key, "_seg").agg(F.max_by(F.struct("_folder", *own), "line_no").alias("c")).select(key, "_seg", "c.*")
    so_far = Window.partitionBy(key).orderBy("_seg").rowsBetween(Window.unboundedPreceding, -1)
    take = {"_folder0": F.last("_folder", True), "_turn0": F.last("_turn", True), "_meta0": F.last("_meta", True), "_head0": F.first("_head", True)}
    carry = carry.withColumns({name: c.over(so_far) for name, c in take.items()})
    carry = carry.withColumn("_given", F.when(F.col("_at").isNotNull(), F.coalesce("_at.v", "_folder0", F.lit(""))))
    carry = carry.withColumn("_at0", F.last("_given", True).over(so_far)).select(key, "_seg", "_at0", *take)
    x = rows.join(carry, [key, "_seg"])
    empty = F.lit("")
    thread_cwd = F.coalesce("_folder", "_folder0", empty)
    turn_cwd = _given(F.when(F.col("_at").isNotNull(), F.coalesce("_at.v", "_folder0", empty)).otherwise(F.col("_at0")))
    header_at = F.coalesce("_meta", "_meta0", "_head0", "_head", empty)
    return x.select(*(c for c in parsed.columns if c != "cwd"), thread_cwd.alias("thread_cwd"), F.coalesce("_turn", "_turn0", empty).alias("turn_id"), F.coalesce(turn_cwd, thread_cwd).alias("cwd"), header_at.alias("header_at"))


def long_log_events(lines: DataFrame, key: str, size: int = SEGMENT) -> DataFrame:
    """``records.log_events`` for threads of any length. Lines are parsed once; the
    parsed table is written."""
    filled = fill_context_by_segments(written(parse_lines(lines), "parsed"), key, size)
    return with_event_ids(dedupe_events(classify_records(filled, key), key)).drop("said_at")


def _grouped(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[tuple[tuple, pd.DataFrame]]:
    """Rows of sorted batches by runs of equal keys; a run may span batches."""
    now, held = None, []
    for pdf in batches:
        if not len(pdf):
            continue
        start = np.flatnonzero(np.r_[True, (pdf[keys].values[1:] != pdf[keys].values[:-1]).any(axis=1)])
        for a, b in zip(start, [*start[1:], len(pdf)]):
            k = tuple(pdf[keys].iloc[a])
            if held and k != now:
                yield now, pd.concat(held)
                held = []
            now = k
            held.append(pdf.iloc[a:b])
    if held:
        yield now, pd.concat(held)


def chunk_carry(sizes: np.ndarray, alone: np.ndarray, budget: int) -> tuple[list, list, list, list, int]:
    """What a segment makes of every state that may come in: (need, chunks, used, ends_alone,
    total). The first chunk that starts in the segment starts at the first event whose
    ``need`` is below the characters used so far; then so many chunks start, and the last has
    ``used`` characters. If there is none, ``total`` characters are added."""
    n = len(sizes)
    add = sizes + 2
    s = np.r_[0, np.cumsum(add)]
    later = np.full(n + 1, n)  # the next event that stands alone, at or behind each place
    for i in range(n - 1, -1, -1):
        later[i] = i if alone[i] else later[i + 1]
    full = np.searchsorted(s[1:], budget + s[:-1], "right")  # the event that no longer fits a chunk begun here
    count, used, ends = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, bool)
    for j in range(n - 1, -1, -1):
        k = j + 1 if alone[j] else max(j + 1, min(int(full[j]), int(later[j + 1])))
        if k >= n:
            count[j], used[j], ends[j] = 1, s[n] - s[j], alone[j]
        else:
            count[j], used[j], ends[j] = count[k] + 1, used[k], ends[k]
    need = np.where(alone, -1, budget - s[1:])
    stop = np.flatnonzero(need < 2)  # used is 2 at least
    last = int(stop[0]) + 1 if len(stop) else n
    return need[:last].tolist(), count[:last].tolist(), used[:last].tolist(), ends[:last].tolist(), int(s[n])


def long_chunk_events(split: DataFrame, budget: int = BUDGET, size: int = SEGMENT) -> DataFrame:
    """``inputs.chunk_events`` (adds ``chunk``) for threads of any length, by segments of
    ``size`` values of ``ord``. ``split`` is read twice, so it should be a written table."""
    rows = split.withColumn("_seg", F.floor(F.col("ord") / size).cast("long"))
    kind, columns = dict(split.dtypes)["thread"], split.columns
    schema = f"thread {kind}, _seg long, need array<long>, chunks array<long>, used array<long>, ends array<boolean>, total long"

    def summary(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for (thread, seg), pdf in _grouped(batches, ["thread", "_seg"]):
            yield pd.DataFrame([(thread, seg, *chunk_carry(pdf["size"].to_numpy(np.int64), pdf["parts"].to_numpy() > 1, budget))], columns=[x.split()[0] for x in schema.split(", ")])

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, chunk, used, alone = None, 0, 0, True
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                thread, seg, need, chunks, after, ends, total = r
                if thread != now:
                    now, chunk, used, alone = thread, 0, 0, True
                out.append((thread, seg, chunk, used, alone))
                first = 0 if alone else next((j for j, x in enumerate(need) if used > x), None)
                if first is None:
                    used += total
                else:
                    chunk, used, alone = chunk + int(chunks[first]), int(after[first]), bool(ends[first])
            yield pd.DataFrame(out, columns=["thread", "_seg", "_chunk", "_used", "_alone"])

    def finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, chunk, used, alone = None, 0, 0, True
        for pdf in batches:
            out = np.zeros(len(pdf), np.int32)
            for i, (thread, seg, n, parts, c0, u0, a0) in enumerate(zip(*(pdf[c] for c in ("thread", "_seg", "size", "parts", "_chunk", "_used", "_alone")))):
                if (thread, seg) != now:
                    now, chunk, used, alone = (thread, seg), c0, u0, a0
                if parts > 1 or alone or used + 2 + n > budget:
                    chunk, used = chunk + 1, 2 + n
                else:
                    used += 2 + n
                alone = parts > 1
                out[i] = chunk
            yield pdf[columns].assign(chunk=out)

    order = ["thread", "_seg", "ord", "part"]
    narrow = rows.select(*order, "size", "parts").repartition("thread", "_seg").sortWithinPartitions(*order)
    carry = written(narrow.select("thread", "_seg", "size", "parts").mapInPandas(summary, schema), "chunk-carry")
    states = written(carry.repartition("thread").sortWithinPartitions("thread", "_seg").mapInPandas(scan, f"thread {kind}, _seg long, _chunk int, _used long, _alone boolean"), "chunk-states")
    ready = rows.repartition("thread", "_seg").join(states, ["thread", "_seg"]).sortWithinPartitions(*order)
    return ready.mapInPandas(finish, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in split.schema) + ", chunk int")
