"""SimHash near-duplicates over vantage-point trees.

Fingerprints within ``radius`` bits are linked and linked components numbered.
The 64 bits are cut into (radius + 1) / 2 parts (two halves for radius 3): of two
fingerprints within the radius, at least one part differs in at most 1 bit. For each
part a vantage-point tree over Hamming distance is grown from a bounded sample; its leaves are the shards. A fingerprint
lives in one leaf and also queries every leaf that the triangle bounds cannot rule
out (a branch is left out only if the distance to the vantage point and the radius
prove that nothing near can be there), so every pair is met in some leaf, where
all 64 bits are compared exactly. Tree size follows the number of fingerprints, so
that leaves stay near ``leaf_rows``; a leaf that grows beyond it is cut into tiles.
A tile returns a spanning forest of its links rather than all pairs.

``near_duplicates`` links by the fingerprint alone. ``near_copies`` links by the exact
similarity of five-word shingles. Its candidates are what the trees find for the
fingerprint, and, since a few changed words move that too far to be searched for, all
texts that agree in a band of MinHash values of their shingles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import HEAVY, discard, materialize, pick, read, skewed_join

SEED, WORDS, RADIUS = 42, 3, 3
#: Trees are grown (vantage points and radii only) from LEAF_SAMPLE fingerprints for each
#: leaf, LEAST_SAMPLE at least and SAMPLE at most.
LEAF_SAMPLE, LEAST_SAMPLE, SAMPLE = 8, 20_000, 1 << 18
LEAF_ROWS = 1500
#: Near copies: words of a shingle, and the similarity of shingle sets from which on they are.
COPY_WORDS, COPY_SHARE = 5, 0.8
SIGNATURE = ["s0", "s1", "s2", "s3"]
#: BANDS bands of BAND_ROWS MinHash values each. Of pairs at 0.8, 0.59 ** 24, so 3 in a
#: million, agree in no band.
BANDS, BAND_ROWS = 24, 4
#: Candidates whose 256 SimHash bits differ in more are left out unread. The share of
#: differing bits is the angle between shingle sets over pi: at a similarity of 0.8 it is
#: 0.15, so 39 bits with a standard deviation of 6, and 48 at most in texts of a few
#: shingles: 80 is 5 standard deviations above.
LOOSE_BITS = 80
#: Rows of a band or cluster that are compared at once, hashes of a block of texts, and the
#: rows and hashes that one call compares on average.
BLOCK_ROWS, BLOCK_HASHES, CALL_ROWS, CALL_HASHES = 1024, 1 << 21, 10_000, 50_000
#: Bit values (least first) of each byte.
BITS_OF_BYTE = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def majority(h: np.ndarray) -> np.ndarray:
    """The bits set in over half of the rows of ``h`` (n x k unsigned 64-bit words), as k
    such words."""
    k = h.shape[1] * 8
    counts = np.zeros(k * 256, np.int64)
    for lo in range(0, len(h), 1 << 16):  # bounds the memory of very long texts
        part = np.ascontiguousarray(h[lo : lo + (1 << 16)])
        cell = part.view(np.uint8).reshape(len(part), k) + 256 * np.arange(k)
        counts += np.bincount(cell.ravel(), minlength=k * 256)
    ones = counts.reshape(k, 256) @ BITS_OF_BYTE
    return np.packbits(2 * ones.ravel() > len(h), bitorder="little").view("<u8")


def remix(h: np.ndarray) -> np.ndarray:
    """Another 64 well-mixed bits of each hash (multiply and shift)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


#: Odd multipliers, one for each MinHash value.
MULTIPLIERS = np.random.default_rng(3).integers(0, 2**63, BANDS * BAND_ROWS, np.uint64) * np.uint64(2) + np.uint64(1)


def band_values(h: np.ndarray) -> np.ndarray:
    """A 64-bit value for each band: its number and BAND_ROWS MinHash values of the
    distinct hashes ``h``."""
    low = np.full(len(MULTIPLIERS), 2**64 - 1, np.uint64)
    for lo in range(0, len(h), 1 << 12):  # bounds the memory of very long texts
        x = h[lo : lo + (1 << 12), None] * MULTIPLIERS
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        low = np.minimum(low, x.min(0))
    value = np.arange(1, BANDS + 1, dtype=np.uint64)
    for column in low.reshape(BANDS, BAND_ROWS).T:
        value = remix(value * np.uint64(0x9E3779B97F4A7C15) ^ column)
    return value


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").lower().split()


def shingle_hashes(words: list[bytes], n_words: int) -> np.ndarray:
    """XXH64 of every run of ``n_words`` words (fewer words: of the whole sequence; none:
    nothing), in order, repeats included."""
    digest, seed = xxhash.xxh64_intdigest, SEED
    if not words:
        return np.zeros(0, np.uint64)
    joined, size = b" ".join(words), np.fromiter(map(len, words), np.int64, len(words))
    if len(words) <= n_words:
        return np.array([digest(joined, seed)], np.uint64)
    start = np.cumsum(size + 1) - size - 1
    end = (start + size)[n_words - 1 :]
    return np.array([digest(joined[a:b], seed) for a, b in zip(start.tolist(), end.tolist())], np.uint64)


def fingerprint(text: str | None, n_words: int = WORDS) -> int:
    """Majority bits of the XXH64 of every shingle; 0 without words."""
    h = shingle_hashes(words_of(text), n_words)
    planes = h.view(np.uint8).reshape(-1, 8).T
    ones = np.concatenate([np.bincount(plane, minlength=256) @ BITS_OF_BYTE for plane in planes])
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def copy_set(text: str | None) -> tuple[int, np.ndarray]:
    """(nid, hashes of the distinct five-word shingles, sorted). Texts have one nid if and
    only if (but for 64-bit collisions) they have the same shingles."""
    h = np.unique(shingle_hashes(words_of(text), COPY_WORDS))
    return xxhash.xxh64_intdigest(h.tobytes(), SEED), h


def copy_signature(h: np.ndarray) -> np.ndarray:
    """256 SimHash bits of distinct shingle hashes; zero if there are none."""
    wide = [h]
    for _ in SIGNATURE[1:]:
        wide.append(remix(wide[-1]))
    return majority(np.stack(wide, 1))


def with_copy_signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, nid, n, s0 to s3, bands) of (doc_id, text): fingerprint, identity and
    size of the shingle set, its signature and band values (none without words)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sets = [copy_set(t) for t in pdf["text"]]
            signed = np.array([copy_signature(h) for _, h in sets], np.uint64).reshape(-1, len(SIGNATURE)).view(np.int64)
            got = {"fp": [fingerprint(t) for t in pdf["text"]], "nid": [nid for nid, _ in sets]}
            got = {k: np.array(v, np.uint64).view(np.int64) for k, v in got.items()} | {c: signed[:, i] for i, c in enumerate(SIGNATURE)}
            bands = [band_values(h).view(np.int64) if len(h) else [] for _, h in sets]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], **got, "n": [len(h) for _, h in sets], "bands": pd.Series(bands, dtype=object)})

    return docs.mapInPandas(run, "doc_id long, fp long, nid long, n long, s0 long, s1 long, s2 long, s3 long, bands array<long>")


def with_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp long: the unsigned fingerprint's bits)."""
    source = pick(docs, id_col, text_col).toDF("doc_id", "text")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "fp": np.array([fingerprint(t) for t in pdf["text"]], np.uint64).astype(np.int64)})

    return source.mapInPandas(run, "doc_id long, fp long")


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b)


def grow(points: np.ndarray, leaves: int, rng: np.random.Generator) -> list:
    """A vantage-point tree as nested [vantage, median distance, near, far]; [] is a
    leaf. The vantage point is the candidate that spreads the points best."""
    if leaves <= 1 or len(points) < 8:
        return []
    tries = rng.choice(points, min(8, len(points)), replace=False)
    seen = [distance(points, v) for v in tries]
    best = int(np.argmax([d.std() for d in seen]))
    d = seen[best]
    mu = int(np.median(d))
    if (d <= mu).all():
        mu -= 1
    near = d <= mu
    if not near.any() or near.all():
        return []
    return [tries[best], mu, grow(points[near], leaves // 2, rng), grow(points[~near], leaves - leaves // 2, rng)]


def visit(tree: list, points: np.ndarray, r: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, leaf, home): the leaves that hold or may hold what is within r of each point."""
    rows, leaves, homes = [], [], []

    def walk(node: list, at: np.ndarray, home: np.ndarray, leaf: int) -> int:
        if not node:
            rows.append(at)
            leaves.append(np.full(len(at), leaf, np.int32))
            homes.append(home)
            return leaf + 1
        d = distance(points[at], node[0]).astype(np.int16)
        inside = d <= node[1]
        near, far = d - r <= node[1], d + r > node[1]  # else the triangle bound rules the branch out
        leaf = walk(node[2], at[near], home[near] & inside[near], leaf)
        return walk(node[3], at[far], home[far] & ~inside[far], leaf)

    walk(tree, np.arange(len(points)), np.ones(len(points), bool), 0)
    return np.concatenate(rows), np.concatenate(leaves), np.concatenate(homes)


def count_leaves(tree: list) -> int:
    return 1 if not tree else count_leaves(tree[2]) + count_leaves(tree[3])


def part_of(fp: np.ndarray, part: int, parts: int) -> np.ndarray:
    """The bits of one of ``parts`` nearly equal parts."""
    low, high = 64 * part // parts, 64 * (part + 1) // parts
    return (fp.view(np.uint64) >> np.uint64(low)) & np.uint64((1 << (high - low)) - 1)


def forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Smallest member of each of n nodes' component under links (a, b)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = np.minimum(new, new[new])
        if (new == label).all():
            return label
        label = new


def near_links(fps: DataFrame, radius: int = RADIUS, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """Links (a, b) whose components are those of all pairs within ``radius`` bits, for
    the distinct values of the one column ``fp``."""
    n = fps.count()
    if n < 2:
        return fps.select(F.col("fp").alias("a"), F.col("fp").alias("b")).limit(0)
    want = max(1, n // leaf_rows)
    size = min(SAMPLE, max(LEAST_SAMPLE, LEAF_SAMPLE * want))
    sample = np.array([r[0] for r in fps.orderBy(F.xxhash64("fp")).limit(size).collect()], np.int64)
    rng, parts = np.random.default_rng(1), max(1, (radius + 1) // 2)
    small = radius // parts
    trees = [grow(np.unique(part_of(sample, p, parts)), want, rng) for p in range(parts)]
    first = np.concatenate([[0], np.cumsum([count_leaves(t) for t in trees])])

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            fp = pdf["fp"].to_numpy()
            for lo in range(0, len(fp), 5000):
                part = np.ascontiguousarray(fp[lo : lo + 5000])
                for p, tree in enumerate(trees):
                    row, leaf, home = visit(tree, part_of(part, p, parts), small)
                    yield pd.DataFrame({"leaf": leaf + np.int32(first[p]), "fp": part[row], "home": home})

    dealt = materialize(fps.mapInPandas(deal, "leaf int, fp long, home boolean"), "leaves")
    # leaves: bounded by the trees, which the sample bounds
    sizes = dealt.groupBy("leaf").agg(F.count("*").alias("rows"), F.count_if("home").alias("homes"))
    tile = 4 * leaf_rows
    sizes = sizes.select("leaf", F.ceil(F.col("homes") / tile).cast("int").alias("kh"), F.ceil(F.col("rows") / (4 * tile)).cast("int").alias("kq")).filter("kh > 0")
    tagged = dealt.join(F.broadcast(sizes), "leaf").withColumn("x", F.xxhash64("fp", F.lit(1)))
    h, q = F.pmod("x", "kh"), F.pmod("x", "kq")
    homes = tagged.filter("home").select("leaf", h.alias("h"), F.explode(F.sequence(F.lit(0), F.col("kq") - 1)).alias("q"), "fp", "home")
    asks = tagged.select("leaf", F.explode(F.sequence(F.lit(0), F.col("kh") - 1)).alias("h"), q.alias("q"), "fp", F.lit(False).alias("home"))
    tiles = homes.union(asks)

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        home = pdf["home"].to_numpy()
        nodes, where = np.unique(pdf["fp"].to_numpy(np.int64), return_inverse=True)
        data, ask = np.unique(where[home]), np.unique(where[~home])
        value, got_a, got_b = nodes.view(np.uint64), [], []
        for lo in range(0, len(ask), 256):
            at = ask[lo : lo + 256]
            i, j = np.nonzero(np.bitwise_count(value[at][:, None] ^ value[data][None, :]) <= radius)
            i, j = at[i], data[j]
            got_a.append(i[i != j])
            got_b.append(j[i != j])
        a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (got_a, got_b))
        label = forest(a, b, len(nodes))
        child = np.flatnonzero(label != np.arange(len(nodes)))
        return pd.DataFrame({"a": nodes[child], "b": nodes[label[child]]})

    return tiles.groupBy("leaf", "h", "q").applyInPandas(compare, "a long, b long").distinct()


def blocks(df: DataFrame, key: str, k: str) -> DataFrame:
    """``df`` with ``tile``: the rows of one ``key`` are cut into ``k`` blocks by nid, and a
    tile holds two of them (or the one), so every two rows meet in a tile."""
    x = F.pmod(F.xxhash64("nid", F.lit(2)), F.col(k))
    cut = df.withColumn("_x", x).withColumn("_y", F.explode(F.sequence(F.lit(0).cast("long"), F.col(k) - 1)))
    return cut.withColumn("tile", F.xxhash64(key, F.least("_x", "_y"), F.greatest("_x", "_y"))).drop("_x", "_y")


def tile_links(pdf: pd.DataFrame, exact: bool) -> pd.DataFrame:
    """A spanning forest (a, b) of the links between rows of one tile: signatures within
    LOOSE_BITS and, if ``exact``, shingles shared at COPY_SHARE or more."""
    pdf = pdf.sort_values(["tile", "nid"])
    tile, nid = pdf["tile"].to_numpy(), pdf["nid"].to_numpy()
    nodes, where = np.unique(nid, return_inverse=True)
    signature = np.ascontiguousarray(pdf[SIGNATURE].to_numpy(np.int64)).view(np.uint64)
    sets = [np.frombuffer(x, np.uint64) for x in pdf["hashes"]] if exact else []
    size = np.array([len(x) for x in sets])
    label, at, d = np.arange(len(nodes)), np.arange(len(tile)), 1
    while len(at):
        at = at[at + d < len(tile)]
        at = at[tile[at] == tile[at + d]]  # rows are sorted, so no later one is in the tile either
        i, j = at, at + d
        link = label[where[i]] != label[where[j]]
        i, j = i[link], j[link]
        link = np.bitwise_count(signature[i] ^ signature[j]).sum(1, dtype=np.int64) <= LOOSE_BITS
        i, j = i[link], j[link]
        if exact:
            link = np.minimum(size[i], size[j]) >= (COPY_SHARE - 1e-9) * np.maximum(size[i], size[j])
            i, j = i[link], j[link]
            shared = np.array([len(np.intersect1d(sets[x], sets[y], assume_unique=True)) for x, y in zip(i, j)], np.int64)
            link = shared >= (COPY_SHARE - 1e-9) * (size[i] + size[j] - shared)
            i, j = i[link], j[link]
        if len(i):
            old = np.flatnonzero(label != np.arange(len(nodes)))
            label = forest(np.concatenate([old, where[i]]), np.concatenate([label[old], where[j]]), len(nodes))
        d += 1
    child = np.flatnonzero(label != np.arange(len(nodes)))
    return pd.DataFrame({"a": nodes[child], "b": nodes[label[child]]})


def candidate_clusters(nodes: DataFrame) -> DataFrame:
    """(nid, cluster) of the ``nodes`` (nid, fp, s0 to s3, bands) that have candidates:
    components of links by fingerprint (the trees) and by a common band, within LOOSE_BITS."""
    found = materialize(near_links(nodes.select("fp").distinct()), "near-links")
    # nodes whose fingerprints the trees have joined meet like nodes of one band
    group = materialize(components(found), "fingerprint-groups")
    near = group.union(group.select("root", "root").distinct()).toDF("fp", "g")
    near = nodes.select("nid", "fp").join(near.hint("merge"), "fp", "left").select("nid", F.xxhash64(F.coalesce("g", "fp"), F.lit(5)).alias("band"))
    banded = nodes.select("nid", F.explode("bands").alias("band")).union(near)
    shared = banded.groupBy("band").count().filter("count > 1").withColumn("k", F.ceil(F.col("count") / BLOCK_ROWS))
    rows = materialize(skewed_join(banded, materialize(shared, "shared-bands"), "band", "count").select("band", "k", "nid"), "bands")
    tiles = blocks(rows, "band", "k").join(nodes.select("nid", *SIGNATURE).hint("merge"), "nid")
    calls = max(1, rows.count() // CALL_ROWS)
    links = materialize(tiles.groupBy(F.pmod("tile", F.lit(calls))).applyInPandas(lambda pdf: tile_links(pdf, False), "a long, b long").distinct(), "band-links")
    found = materialize(components(links), "clusters")
    return found.union(found.select("root", "root").distinct()).toDF("nid", "cluster")


def exact_links(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Links (a, b: nid) whose components are those of all pairs of ``nodes`` (nid, rep, fp,
    n, s0 to s3, bands) that share five-word shingles at COPY_SHARE or more, by exact count
    over 64-bit hashes; only pairs that are no candidates are missed.

    The texts of the candidates' clusters are read again (``rep`` is the id of a document
    that has the shingles), and inside each cluster all pairs are decided."""
    members = materialize(candidate_clusters(nodes).join(nodes.select("nid", "rep", "n", *SIGNATURE).hint("merge"), "nid"), "members")
    sizes = members.groupBy("cluster").agg(F.count("*").alias("count"), F.ceil(F.greatest(F.sum("n") / BLOCK_HASHES, F.count("*") / BLOCK_ROWS)).alias("k"))
    calls = max(1, (members.agg(F.sum("n")).first()[0] or 0) // CALL_HASHES)
    members = materialize(skewed_join(members, materialize(sizes, "cluster-sizes"), "cluster", "count"), "members")

    def read_again(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, done = None, set()
        for pdf in batches:
            keep, hashes = [], []
            for k, (rep, nid, text) in enumerate(zip(pdf["rep"], pdf["nid"], pdf["text"])):
                last, done = (last, done) if rep == last else (rep, set())
                got, h = copy_set(text)
                if np.uint64(got).astype(np.int64) == nid and nid not in done:  # else another text of that id, or a repeated row
                    done.add(nid)
                    keep.append(k)
                    hashes.append(h.tobytes())
            yield pdf.iloc[keep].drop(columns=["rep", "text"]).assign(hashes=pd.Series(hashes, dtype=object).to_numpy())

    known = members.filter("rep IS NOT NULL").join(docs.filter("doc_id IS NOT NULL").withColumnRenamed("doc_id", "rep").hint("merge"), "rep")
    columns = ["nid", "cluster", "k", *SIGNATURE]
    sets = known.select(*columns, "rep", "text").mapInPandas(read_again, ", ".join(f"{c} long" for c in columns) + ", hashes binary")
    if members.filter("rep IS NULL").limit(1).count():

        def read_all(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                got = [copy_set(t) for t in pdf["text"]]
                yield pd.DataFrame({"nid": np.array([x for x, _ in got], np.uint64).view(np.int64), "hashes": [h.tobytes() for _, h in got]})

        nameless = docs.filter("doc_id IS NULL").select("text").distinct().mapInPandas(read_all, "nid long, hashes binary").dropDuplicates(["nid"])
        sets = sets.union(members.filter("rep IS NULL").join(nameless.hint("merge"), "nid").select(*columns, "hashes"))
    tiles = blocks(sets, "cluster", "k").select("tile", "nid", *SIGNATURE, "hashes")
    links = tiles.groupBy(F.pmod("tile", F.lit(calls))).applyInPandas(lambda pdf: tile_links(pdf, True), "a long, b long")
    return materialize(links.distinct(), "exact-links")


def with_least(edges: DataFrame, key: str, least: DataFrame) -> DataFrame:
    """``edges`` (a, b) and ``m`` of ``least`` (node, m) for the node in ``key``, null if it
    has none. Nodes with over a HEAVY-th of the edges, so fewer than HEAVY, are broadcast:
    their edges stay where they are. The other edges are shuffled."""
    n = edges.count()
    hot = edges.groupBy(F.col(key).alias("node")).count().filter(F.col("count") * HEAVY > n).select("node")
    hot = hot.join(least, "node", "left").select(F.col("node").alias("_hot"), F.col("m").alias("_m"))
    marked = edges.join(F.broadcast(hot), edges[key] == F.col("_hot"), "left")
    cold = marked.filter("_hot IS NULL").select("a", "b").join(least.hint("merge"), F.col(key) == F.col("node"), "left").select("a", "b", "m")
    return cold.union(marked.filter("_hot IS NOT NULL").select("a", "b", F.col("_m").alias("m")))


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node that each linked node reaches; links (a, b) of
    comparable ids. Alternates joining every larger neighbour, and every smaller one,
    to the smallest neighbour until all links lead to a root; each round is a written table."""
    edges = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
    edges = materialize(edges, "links")
    for _ in range(max_rounds):
        least = edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"))
        # large star: larger neighbours of b point to its least neighbour (or to b, if it has no smaller one)
        large = with_least(edges, "b", least).select("a", F.coalesce("m", "b").alias("b"))
        large = materialize(large.distinct(), "large-star")
        # small star: a and its smaller neighbours point to the least of them
        least = large.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"))
        small = with_least(large, "a", least).select(F.explode(F.array(F.struct(F.col("a").alias("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
        new = materialize(small.filter("a <> b").distinct(), "small-star")
        edges = new
        once = edges.count() == edges.select("a").distinct().count()
        if once and not edges.select(F.col("b").alias("a")).distinct().join(edges.select("a"), "a", "left_semi").limit(1).count():
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id, the
    smallest doc_id reachable over links (its own if none).

    Null texts and texts without words have fingerprint 0 and are linked like any
    others. Equal fingerprints are one node, so copies are never paired up. A null id
    is a member but never a component's id, unless all its members' ids are null.
    Repeated rows are kept; other columns are ignored; an empty table gives no rows.
    """
    marked = materialize(with_fingerprints(docs, id_col, text_col), "fingerprints")
    nodes = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("rep")), "nodes")
    links = materialize(near_links(nodes.select("fp"), radius), "near-links")
    out = with_components(marked, nodes, links, "fp")
    return out.select(F.col("doc_id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, component_id, the smallest doc_id reachable over
    pairs that share distinct five-word shingles (fewer words: the whole sequence) at a
    Jaccard similarity of COPY_SHARE or more, A-Z lower-cased (``exact_links``).

    Texts of equal shingles are always linked, texts without words with each other.
    Null ids, repeated rows, other columns and empty tables as in ``near_duplicates``.
    """
    source = pick(docs, id_col, text_col).toDF("doc_id", "text")
    marked = materialize(with_copy_signatures(source), "signatures")
    nodes = marked.groupBy("nid").agg(F.min("doc_id").alias("rep"), F.min("fp").alias("fp"), *(F.first(c).alias(c) for c in ["n", *SIGNATURE, "bands"]))
    nodes = materialize(nodes, "nodes")
    out = with_components(marked, nodes, exact_links(source, nodes), "nid")
    return out.select(F.col("doc_id").alias(id_col), "component_id")


def with_components(marked: DataFrame, nodes: DataFrame, links: DataFrame, key: str) -> DataFrame:
    """``marked`` and component_id, for ``nodes`` (key, rep: smallest doc_id) and links
    (a, b) between keys."""
    # links between nodes, as links between (smallest document, key)
    node = F.struct(F.coalesce("rep", F.lit(2**63 - 1)).alias("rep"), F.col(key).alias("key"))
    for e in "ab":
        links = links.join(nodes.select(F.col(key).alias(e), node.alias(f"{e}_node")).hint("merge"), e)
    roots = components(links.select(F.col("a_node").alias("a"), F.col("b_node").alias("b"))).select(F.col("node.key").alias(key), F.col("root.rep").alias("root"))
    roots = nodes.join(roots.hint("merge"), key, "left").select(key, F.coalesce("root", "rep").alias("component_id"), "rep")
    # a component without any id has none
    named = F.when(F.col("component_id") == 2**63 - 1, F.col("rep")).otherwise(F.col("component_id"))
    weighed = marked.groupBy(key).count().join(roots.hint("merge"), key).select(key, named.alias("component_id"), "count")
    return skewed_join(marked, materialize(weighed, "components"), key, "count")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))
