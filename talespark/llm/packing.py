"""Cost-balanced packing of tokenised documents into fixed-length sequences.

A sequence costs ``linear * tokens + quadratic * tokens**2`` for each piece in it
(attention stays inside a piece). Documents are taken in descending length; each
goes to the sequence of lowest cost that has room, and is cut only where no
sequence can hold it whole. Each task packs what it reads in groups of about
``group_tokens`` tokens, so no shuffle is needed, memory is bounded by one group,
and a lost task is simply run again. A group wastes less than one sequence.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pick, read

CAPACITY = 1024
GROUP_TOKENS = 1 << 20
#: Cost of a piece of n tokens: LINEAR * n + QUADRATIC * n * n.
LINEAR, QUADRATIC = 1.0, 1.0 / 1024


def default_vocabulary() -> str:
    """The byte-level BPE of ``byte_bpe_50k.json`` as ranks: the same ids, which tests
    hold against the JSON file's tokenizer on random Unicode and on long runs."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


#: The same pieces as public_tokenizers.PATTERN, without backtracking over long runs.
PIECES = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"


@lru_cache(maxsize=2)
def encoder(path: str) -> Callable[[str], list[int]]:
    """Text -> ids; made once for each worker process."""
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in Path(path).read_bytes().splitlines() if x)}
    return tiktoken.Encoding("byte_bpe", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def place(lengths: list[int], capacity: int) -> Iterator[tuple[int, int, int, int, int]]:
    """(item, start, length, sequence, offset) for items of the given token counts.

    The fewest sequences that can hold all tokens are opened. Whole sequences are
    cut off items that exceed one; rests go in descending order, those of equal length
    in the order given, to the sequence of lowest cost among all with room (the first
    of equal ones). A rest that no sequence can hold is cut over them, cheapest first.
    """
    rests, seq = [], 0
    for item, n in enumerate(lengths):
        whole = n // capacity
        for k in range(whole):
            yield item, k * capacity, capacity, seq, 0
            seq += 1
        if n % capacity:
            rests.append((n % capacity, item, whole * capacity))
    room = np.full(-(-sum(r[0] for r in rests) // capacity), capacity)
    cost = np.zeros(len(room))
    for n, item, start in sorted(rests, key=lambda r: (-r[0], r[1])):
        while n:
            fits = room >= n
            if not fits.any():
                fits = room > 0
            s = int(np.where(fits, cost, np.inf).argmin())
            take = min(n, int(room[s]))
            yield item, start, take, seq + s, capacity - int(room[s])
            room[s] -= take
            cost[s] += LINEAR * take + QUADRATIC * take * take
            n, start = n - take, start + take


def pack_documents(
    docs: DataFrame, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, end_id: int = 0, group_tokens: int = GROUP_TOKENS
) -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens, sequence_id, offset, ids.

    A document's ids are its whole text's (null: empty) followed by ``end_id``, so
    every document, empty ones too, has at least one piece. Pieces of a document
    cover its ids exactly once; ``offset`` is gapless from 0 in each sequence. Rows
    with equal or null ids are packed one by one like any others; other columns are
    ignored; an empty table gives no rows. ``ids`` holds little-endian unsigned
    32-bit values. Sequence ids depend on how the input is split among tasks.
    """
    vocabulary = vocabulary or default_vocabulary()
    source = pick(docs, id_col, text_col).toDF("doc_id", "text")
    kind = source.schema["doc_id"].dataType.simpleString()
    id_type = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]
    end = np.array([end_id], "<u4").tobytes()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary)
        base, done = TaskContext.get().partitionId() << 40, 0
        group: list[tuple[object, bytes]] = []
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal done
            got = sorted(place([len(ids) // 4 for _, ids in group], capacity), key=lambda p: (p[3], p[4]))
            top = max(p[3] for p in got) + 1
            cuts = [group[i][1][4 * s : 4 * (s + n)] for i, s, n, _, _ in got]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([group[p[0]][0] for p in got], id_type),
                    pa.array([p[1] for p in got], pa.int64()),
                    pa.array([p[2] for p in got], pa.int64()),
                    pa.array([len(group[p[0]][1]) // 4 for p in got], pa.int64()),
                    pa.array([base + done + p[3] for p in got], pa.int64()),
                    pa.array([p[4] for p in got], pa.int64()),
                    pa.array(cuts, pa.binary()),
                ],
                ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"],
            )
            done += top

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.array(encode(text.as_py() or ""), "<u4").tobytes() + end
                group.append((doc_id, ids))
                held += len(ids) // 4
                if held >= group_tokens:
                    yield from flush()
                    group, held = [], 0
        if group:
            yield from flush()

    return source.mapInArrow(pack, f"doc_id {kind}, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary")


def with_digest(pieces: DataFrame) -> DataFrame:
    """The pieces with ``ids_crc32`` in place of the ids."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_digest(pack_documents(read(spark, sf_dir, "documents")))
