"""Language-model scoring: a Katz back-off model of order 3 learned from the corpus.

    P(w | h) = r*(c(h w)) / c(h)             where h w was seen in training
             = alpha(h) * P(w | shorter h)   where h was seen, but not with w
             = P(w | shorter h)              where h was not seen
    P(w)     = r*(c(w)) / N                  where w was seen, else P(unknown)

h is the two tokens before w; a start mark stands before a document's first token,
which has this one token of history. r* is the Good-Turing discounted count.
alpha(h) is exactly what makes the words after h sum to 1: the mass left by the seen
words over the mass that the next lower order gives to the unseen ones. P(unknown)
is the unigram mass left. A token's probability is found by recursion from the
longest history down.

Everything is counted over the whole corpus, with no vocabulary cut. Documents are
read in blocks of about ``block_tokens`` tokens. A block sends its distinct n-grams
of each order, as hashes, with their counts to tables partitioned by hash range; a
partition adds up what all blocks sent and answers each block with the totals of the
n-grams it asked for. What moves is thus at most one entry for each block and
distinct n-gram, however frequent one is, packed in columns. Sums for alpha are sent
only for histories that occur in a document not learned from, since no other
document has an unseen n-gram.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, id_fold, materialize, pick, read

BLOCK_TOKENS = 1 << 20
#: Hash ranges are 2**RANGE_BITS at least; more where there are over RANGE_TOKENS tokens a range.
RANGE_BITS, RANGE_TOKENS = 8, 1 << 21
#: Blocks that a task of the exchange has on average.
TASK_BLOCKS = 2
ORDER = 3
#: Hashes sent have this many bits more than the token count: of the n-grams, about one
#: in 2**KEY_BITS is taken for another one.
KEY_BITS = 24
#: Counts up to K take their own Good-Turing ratio.
K = 5
CACHE_WORDS = 300_000
END, START = b"", b" "  # no word is empty or holds a space


def word_hash(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word, 1)


START_HASH = np.uint64(word_hash(START))


class Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        got = self[word] = word_hash(word)
        return got


def pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    h = (a * np.uint64(0x9E3779B97F4A7C15)) ^ (b + np.uint64(0x7F4A7C15F39CC060))
    for shift, k in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(k)
    return h ^ (h >> np.uint64(31))


def shrink(a: np.ndarray) -> bytes:
    """An array as compressed byte planes."""
    planes = np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def grow(data: bytes, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(planes.reshape(size, -1).T).view(kind).ravel()


def shrink_shares(x: np.ndarray) -> bytes:
    """Numbers from 0 to 1, in steps of 2**-40."""
    return shrink(np.rint(x * 2.0**40).astype("<i8"))


def grow_shares(data: bytes) -> np.ndarray:
    return grow(data, "<i8") / 2.0**40


def shrink_sorted(keys: np.ndarray) -> bytes:
    return shrink(np.diff(keys, prepend=np.uint64(0)))


def grow_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(grow(data, "<u8"), dtype=np.uint64)


# --- blocks -----------------------------------------------------------------

BLOCK = "block long, doc_ids array<long>, train array<boolean>, sizes array<int>, words binary, ids binary"


def make_blocks(docs: DataFrame, block_tokens: int) -> DataFrame:
    """Blocks of (doc_id, text, train): token ids are places in the block's sorted
    distinct word hashes. Every document ends with the end token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, first, made = Hashes(), TaskContext.get().partitionId() << 32, 0
        ids, train, parts, held = [], [], [], 0
        end = np.array([word_hash(END)], np.uint64)

        def flush() -> pa.RecordBatch:
            tokens = np.concatenate(parts)
            words, at = np.unique(tokens, return_inverse=True)
            row = [[first + made], [ids], [train], [[len(p) for p in parts]], [shrink_sorted(words)], [shrink(at.astype("<i4"))]]
            kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int32()), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds)], [x.split()[0] for x in BLOCK.split(", ")])

        for batch in batches:
            for doc_id, text, learn in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                found = (text.as_py() or "").encode("utf-8", "replace").lower().split()
                ids.append(doc_id)
                train.append(learn)
                parts.append(np.concatenate([np.fromiter(map(cache.__getitem__, found), np.uint64, len(found)), end]))
                held += len(found) + 1
                if held >= block_tokens:
                    yield flush()
                    made += 1
                    ids, train, parts, held = [], [], [], 0
        if ids:
            yield flush()

    return docs.select("doc_id", "text", "train").mapInArrow(run, BLOCK)


@dataclass
class Grams:
    """The distinct n-grams of one order in a block."""

    hash: np.ndarray
    of: np.ndarray  # of each token: the place here of the n-gram that it ends, -1 if there is none
    context: np.ndarray | None = None  # of each: the place, one order below, of all but its last token
    suffix: np.ndarray | None = None  # and of all but its first

    def count(self, tokens: np.ndarray) -> np.ndarray:
        return np.bincount(self.of[tokens & (self.of >= 0)], minlength=len(self.hash))


@dataclass
class Block:
    doc_ids: list
    sizes: np.ndarray
    learn: np.ndarray  # whether a token is of a training document
    grams: list[Grams]  # of order 1, 2, ...; as a context of order 2, the start mark comes after all words


def open_block(row: pd.Series) -> Block:
    sizes = np.asarray(row["sizes"], np.int64)
    words, ids = grow_sorted(row["words"]), grow(row["ids"], "<i4").astype(np.int64)
    first = np.cumsum(sizes) - sizes
    grams, hashes = [Grams(words, ids)], np.append(words, START_HASH)
    before = np.concatenate([[0], ids[:-1]])
    before[first] = len(words)
    for _ in range(ORDER - 1):
        tokens = np.flatnonzero(before >= 0)
        both, at, place = np.unique(before[tokens] * len(words) + ids[tokens], return_index=True, return_inverse=True)
        of = np.full(len(ids), -1)
        of[tokens] = place
        context = both // len(words)
        grams.append(Grams(pair_hash(hashes[context], words[both % len(words)]), of, context, grams[-1].of[tokens[at]]))
        before, hashes = np.concatenate([[-1], of[:-1]]), grams[-1].hash
        before[first] = -1
    return Block(list(row["doc_ids"]), sizes, np.repeat(np.asarray(row["train"], bool), sizes), grams)


@dataclass
class Ranges:
    """How hashes are shortened to keys of ``key`` bits and dealt to 2**``bits`` ranges."""

    bits: int
    key: int

    def sort(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(the order that sorts the keys, the keys in this order)."""
        keys = hashes >> np.uint64(64 - self.key)
        order = np.argsort(keys, kind="stable")
        return order, keys[order]

    def slices(self, keys: np.ndarray) -> Iterator[tuple[int, slice]]:
        """(range, part) of sorted keys, for the ranges that have any."""
        at = (keys >> np.uint64(self.key - self.bits)).astype(np.int64)
        starts = np.flatnonzero(np.diff(at, prepend=-1))
        for a, b in zip(starts, [*starts[1:], len(keys)]):
            yield int(at[a]), slice(a, b)


def ranges_for(tokens: int) -> Ranges:
    bits = max(RANGE_BITS, int(np.ceil(np.log2(max(tokens, 1) / RANGE_TOKENS))))
    return Ranges(bits, min(64, int(np.ceil(np.log2(max(tokens, 2)))) + KEY_BITS))


# --- counting ---------------------------------------------------------------


def ask_counts(blocks: DataFrame, ranges: Ranges) -> DataFrame:
    """(kind, range, block, keys, counts): kind is the order of the n-grams. The last bit
    of a count tells whether a document not learned from has the n-gram as a history."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for _, row in pdf.iterrows():
                b = open_block(row)
                for kind, g in enumerate(b.grams, 1):
                    wanted = np.zeros(len(g.hash) + 1, np.int64)  # one more for the start mark
                    if kind < ORDER:
                        longer = b.grams[kind]
                        wanted[longer.context[longer.of[~b.learn & (longer.of >= 0)]]] = 1
                    order, keys = ranges.sort(g.hash)
                    n = (2 * g.count(b.learn) + wanted[:-1])[order]
                    got = [(kind, at, row["block"], shrink_sorted(keys[s]), shrink(n[s].astype("<u4"))) for at, s in ranges.slices(keys)]
                    yield pd.DataFrame(got, columns=["kind", "range", "block", "keys", "counts"])

    return blocks.mapInPandas(run, "kind int, range int, block long, keys binary, counts binary")


def total_counts(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of one kind and range: to each block, for each of its keys, 4 times the total, plus 2
    if the key is wanted as a history, plus 1 if the block owns it (the first block that
    has it does); and one row of how many keys were counted 1, 2, ... K + 1 times, how
    many at all, and the sum."""
    pdf = pdf.sort_values("block")
    parts = [grow_sorted(x) for x in pdf["keys"]]
    keys, n = np.concatenate(parts), np.concatenate([grow(x, "<u4") for x in pdf["counts"]]).astype(np.int64)
    order = np.argsort(keys, kind="stable")
    new = np.concatenate([[True], np.diff(keys[order]) != 0])
    starts = np.flatnonzero(new)
    sums = np.add.reduceat(n[order] >> 1, starts)
    reply = np.empty(len(keys), np.int64)
    reply[order] = (4 * sums + 2 * np.maximum.reduceat(n[order] & 1, starts))[np.cumsum(new) - 1] + new
    cuts = np.cumsum([len(p) for p in parts])[:-1]
    out = pd.DataFrame({"kind": pdf["kind"], "range": pdf["range"], "block": pdf["block"], "reply": [shrink(x.astype("<i8")) for x in np.split(reply, cuts)], "stats": None})
    seen = np.bincount(np.minimum(sums, K + 2), minlength=K + 3)
    stats = [*seen[1 : K + 2].tolist(), int((sums > 0).sum()), int(sums.sum())]
    return pd.concat([out, pd.DataFrame({"kind": [pdf["kind"].iloc[0]], "range": [pdf["range"].iloc[0]], "block": [None], "reply": [None], "stats": [stats]})]).astype({"block": "Int64"})


def ratios(n: list[int]) -> np.ndarray:
    """Discounts r*/r of counts r = 0 (unused), 1 ... K, and last of any larger r, from
    the numbers ``n`` of n-grams counted 1, 2, ... K + 1 times.

    Up to K they are Katz's: Good-Turing ratios, rescaled so that they take the mass
    of the n-grams counted once. One that the counts leave undefined or outside
    (0.05, 0.999) becomes r / (r + 1). Katz leaves larger counts whole; here they lose a
    (K + 1)-th of what count K loses, since a history whose words are all frequent
    would else leave nothing to any other word, whose probability would be 0.
    """
    d = [1.0]
    share = (K + 1) * n[K] / n[0] if n[0] else 1.0
    for r in range(1, K + 1):
        x = ((r + 1) * n[r] / (r * n[r - 1]) - share) / (1 - share) if n[r - 1] and share < 1 else 0.0
        d.append(x if 0.05 < x < 0.999 else r / (r + 1))
    return np.array([*d, 1 - (1 - d[K]) / (K + 1)])


@dataclass
class Model:
    """What is the same for all n-grams; the tables hold the rest."""

    tokens: int
    types: int
    train_docs: int
    ratio: list[np.ndarray]  # of each order
    unknown: float

    def word_p(self, c: np.ndarray) -> np.ndarray:
        return np.where(c > 0, discounted(c, self.ratio[0]) / max(self.tokens, 1), self.unknown)


def discounted(c: np.ndarray, ratio: np.ndarray) -> np.ndarray:
    return c * ratio[np.minimum(c, K + 1)]


def make_model(stats: dict[int, list[int]], train_docs: int) -> Model:
    rows = [stats.get(k, [0] * (K + 3)) for k in range(1, ORDER + 1)]
    ratio, words = [ratios(x) for x in rows], rows[0]
    n, few = words[-1], sum((r + 1) * words[r] for r in range(K))
    kept = sum((r + 1) * words[r] * ratio[0][r + 1] for r in range(K)) + (n - few) * ratio[0][K + 1]
    return Model(n, words[-2], train_docs, ratio, 1 - kept / n if n else 1.0)


# --- scoring ----------------------------------------------------------------

PENDING = "part int, block long, doc_ids array<long>, docs binary, asks binary, kind int, range int, keys binary, seen binary, mass binary, asked binary"


def assemble(replies: pd.DataFrame, kind: int) -> np.ndarray:
    rows = replies[replies["kind"] == kind].sort_values("range")
    return np.concatenate([grow(x, "<i8") for x in rows["reply"]]) if len(rows) else np.zeros(0, np.int64)


def score_block(model: Model, ranges: Ranges):
    """cogroup function: a block and its totals -> what is known of each document's
    score, and for each history of the block the mass of the seen words it owns."""

    def run(left: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
        b, block = open_block(left.iloc[0]), int(left["block"].iloc[0])
        first = np.cumsum(b.sizes) - b.sizes
        rows, asks, asked_before = [], [], 0
        count = wanted = p = log_p = token_p = None  # of the order below, from the second round on
        for kind, g in enumerate(b.grams, 1):
            reply = np.empty(len(g.hash), np.int64)
            reply[ranges.sort(g.hash)[0]] = assemble(replies, kind)
            c, want, owned = reply >> 2, (reply & 2) > 0, (reply & 1) > 0
            if kind == 1:
                p = model.word_p(c)
                log_p = np.log10(p)
                token_p, base = log_p[g.of], np.log10((c + 1) / (model.tokens + model.types + 1))[g.of]
                known, hashes = (c > 0)[g.of].astype(np.int64), np.append(g.hash, START_HASH)
                count, wanted = np.append(c, model.train_docs), np.append(want, True)
                continue
            context, seen = count[g.context], c > 0
            p_seen = np.where(seen, discounted(c, model.ratio[kind - 1]) / np.maximum(context, 1), 1.0)
            log_p = np.where(seen, np.log10(p_seen), log_p[g.suffix])
            there = g.of >= 0
            token_p[there] = log_p[g.of[there]]
            # histories whose weight a document needs: those of its unseen n-grams
            ask = ~seen & (context > 0)
            asked = np.unique(g.context[ask])
            # histories to name: those asked for, and those wanted anywhere that have n-grams owned here
            own = owned & seen & wanted[g.context]
            named = np.unique(np.concatenate([g.context[own], asked]))
            at = np.searchsorted(named, g.context[own])
            mass_seen = np.bincount(at, p_seen[own], len(named))
            mass_below = np.bincount(at, p[g.suffix[own]], len(named))  # what is after a seen n-gram's first token is seen too
            flag = np.isin(named, asked).astype(np.uint8)
            order, keys = ranges.sort(hashes[named])
            rows += [(1, block, None, None, None, kind, r, shrink_sorted(keys[s]), shrink_shares(mass_seen[order[s]]), shrink_shares(mass_below[order[s]]), shrink(flag[order[s]])) for r, s in ranges.slices(keys)]
            # weights come back in the order of their keys, order by order
            rank = np.empty(len(asked), np.int64)
            rank[np.searchsorted(asked, named[order][flag[order] == 1])] = asked_before + np.arange(len(asked))
            token = np.flatnonzero(there)
            token = token[ask[g.of[token]]]
            asks.append(np.stack([np.searchsorted(first, token, side="right") - 1, rank[np.searchsorted(asked, g.context[g.of[token]])]]))
            asked_before += len(asked)
            count, wanted, p, hashes = c, want, p_seen, g.hash
        docs = (b.sizes, *(np.add.reduceat(x, first) for x in (known, base, token_p)))
        packed = b"".join(np.asarray(x, "<f8").tobytes() for x in docs)
        rows.append((0, block, b.doc_ids, packed, shrink(np.concatenate(asks, 1).astype("<i4").ravel()), None, None, None, None, None, None))
        return pd.DataFrame(rows, columns=[x.split()[0] for x in PENDING.split(", ")]).astype({"kind": "Int64", "range": "Int64"})

    return run


def weigh(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of one kind and range: log10 alpha of the histories that each block asked for."""
    parts = [grow_sorted(x) for x in pdf["keys"]]
    keys = np.concatenate(parts)
    nodes, at = np.unique(keys, return_inverse=True)
    seen, mass = (np.bincount(at, np.concatenate([grow_shares(x) for x in pdf[c]]), len(nodes)) for c in ("seen", "mass"))
    log_a = np.log10(np.maximum(1 - seen, 1e-300)) - np.log10(np.maximum(1 - mass, 1e-300))
    cuts = np.cumsum([len(p) for p in parts])[:-1]
    asked = [grow(x, "u1").astype(bool) for x in pdf["asked"]]
    return pd.DataFrame({"block": pdf["block"], "kind": pdf["kind"], "range": pdf["range"], "log_a": [shrink(x[f]) for x, f in zip(np.split(log_a[at], cuts), asked)]})


def finish(left: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
    """cogroup function: the documents of a block with their whole scores."""
    row = left.iloc[0]
    ids = list(row["doc_ids"])
    n_tokens, n_known, base, score = np.frombuffer(row["docs"], "<f8").reshape(4, len(ids))
    doc, need = grow(row["asks"], "<i4").reshape(2, -1)
    log_a = np.concatenate([np.zeros(0), *(grow(x, "<f8") for x in replies.sort_values(["kind", "range"])["log_a"])])
    whole = score + np.bincount(doc, log_a[need], len(ids))
    return pd.DataFrame({"doc_id": pd.array([None if i is None or i != i else int(i) for i in ids], "Int64"), "n_tokens": n_tokens.astype(np.int64), "n_known": n_known.astype(np.int64), "base_score": base, "score": whole})


def score_documents(docs: DataFrame, train: str = "train", block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """One row per document: doc_id, n_tokens, n_known, train_tokens, base_score, score.

    Learns from rows whose boolean column ``train`` is true (null: false) and scores
    all rows of (doc_id, text). Texts are read whole; A-Z is lower-cased; tokens are
    runs of characters outside ASCII white space, then one end token, so null and
    empty texts have one token. Without training rows every token is unknown with
    probability 1 and scores 0 (the base model then has one type and scores 0 too).
    Repeated rows count and are scored one by one; other columns are ignored.
    """
    rows = pick(docs, "doc_id", "text", train).toDF("doc_id", "text", "train").withColumn("train", F.coalesce("train", F.lit(False)))
    blocks = materialize(make_blocks(rows, block_tokens), "lm-blocks")
    size, train_docs, n = blocks.select(F.sum(F.expr("aggregate(sizes, 0L, (a, x) -> a + x)")), F.sum(F.expr("size(filter(train, x -> x))")), F.count("*")).first()
    ranges, tasks = ranges_for(size or 0), max(1, n // TASK_BLOCKS)
    counted = ask_counts(blocks, ranges).groupBy("kind", "range").applyInPandas(total_counts, "kind int, range int, block long, reply binary, stats array<long>")
    counted = materialize(counted, "lm-counts")
    stats = counted.filter("stats IS NOT NULL").groupBy("kind").agg(*(F.sum(F.get("stats", F.lit(i))).alias(f"s{i}") for i in range(K + 3))).collect()  # ORDER rows
    model = make_model({r["kind"]: list(r)[1:] for r in stats}, train_docs or 0)
    totals = counted.filter("block IS NOT NULL").select("block", "kind", "range", "reply")
    both = blocks.repartition(tasks, "block").groupBy("block").cogroup(totals.repartition(tasks, "block").groupBy("block"))
    pending = materialize(both.applyInPandas(score_block(model, ranges), PENDING), "lm-pending", "part")
    discard(blocks)
    discard(counted)
    weights = pending.filter("part = 1").select("block", "kind", "range", "keys", "seen", "mass", "asked")
    weights = materialize(weights.groupBy("kind", "range").applyInPandas(weigh, "block long, kind int, range int, log_a binary"), "lm-weights")
    done = pending.filter("part = 0").select("block", "doc_ids", "docs", "asks").repartition(tasks, "block").groupBy("block").cogroup(weights.repartition(tasks, "block").groupBy("block"))
    done = done.applyInPandas(finish, "doc_id long, n_tokens long, n_known long, base_score double, score double")
    return done.select("doc_id", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = pick(read(spark, sf_dir, "documents"), "doc_id", "text").withColumn("train", id_fold("doc_id", 7) != 2)
    return score_documents(docs).withColumn("held_out", id_fold("doc_id", 7) == 2).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
