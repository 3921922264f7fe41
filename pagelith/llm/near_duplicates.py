"""N-gram Jaccard join: MinHash banding, then verification on full n-gram sets.

1. Each text gives the sorted set of hashes of its word n-grams, a MinHash signature
   and its band hashes. Texts with the same set are one class of copies.
2. Classes are shuffled on band hashes. Of buckets with the same members one is kept.
   Within a bucket, in blocks of bounded size, whole signatures are compared; pairs
   that agree in too few places to be linked go, so texts that merely share a band
   do not chain. A task gives a spanning forest of the others, never pairs.
3. Components of these forests bound where links can be. The n-gram sets of their
   members meet, in blocks of bounded bytes, and every pair is verified there. A task
   gives link counts and a forest again.
4. Components of the verified forests are the groups.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelith.llm.anchors import gram_hashes, mix
from pagelith.llm.common import discard, materialise

NGRAM = 5
THRESHOLD = (4, 5)  # similarity as a fraction
#: Of all linked pairs, how many band hashes should bring together.
RECALL = 0.9999
#: Members of a component, and bytes of their sets, that one task compares at once.
BLOCK, BLOCK_BYTES = 512, 16 << 20
#: So many edges or nodes are broadcast; beyond, only nodes of more than HUB edges are, whose number is bounded by it.
BROADCAST_EDGES, HUB = 200_000, 10_000
#: Members of a bucket whose signatures are compared at once.
BUCKET = 1024


def choose_bands(similarity: float, recall: float, unrelated: float = 0.3, most: int = 160) -> tuple[int, int]:
    """(bands, rows) with at most `most` hashes that reach the recall and bring fewest unrelated pairs together."""
    best = None
    for rows in range(1, 17):
        miss = 1 - similarity**rows
        bands = math.ceil(math.log(1 - recall) / math.log(miss))
        if bands * rows <= most:
            false = 1 - (1 - unrelated**rows) ** bands
            if best is None or false < best[0]:
                best = (false, bands, rows)
    if best is None:
        raise ValueError("no banding reaches that recall")
    return best[1], best[2]


def choose_agreement(similarity: float, places: int, recall: float) -> int:
    """The most places of two signatures that linked texts agree in with that recall (binomial tail)."""
    below = 0.0
    for k in range(places + 1):
        below += math.comb(places, k) * similarity**k * (1 - similarity) ** (places - k)
        if below > 1 - recall:
            return k
    return places


def grams(text: str | None, n: int = NGRAM) -> np.ndarray:
    """Sorted distinct 64-bit hashes of word n-grams; a shorter text is one n-gram of all its words."""
    words = (text or "").encode("utf-8", "surrogatepass").split()
    if not words:
        return np.zeros(0, np.uint64)
    known: dict[bytes, int] = {}
    values = np.array([known[w] if w in known else known.setdefault(w, xxhash.xxh3_64_intdigest(w)) for w in words], np.uint64)
    return np.unique(gram_hashes(values, min(n, len(words))))


def signature(found: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """Least value of each seeded permutation of the set."""
    out = np.full(len(seeds), np.iinfo(np.uint64).max, np.uint64)
    factor, shift = seeds | np.uint64(1), seeds >> np.uint64(7)
    with np.errstate(over="ignore"):
        for lo in range(0, len(found), 4096):
            out = np.minimum(out, (found[lo : lo + 4096, None] * factor + shift).min(0))
    return out


def set_key(found: np.ndarray) -> bytes:
    return hashlib.blake2b(found.tobytes(), digest_size=16).digest()


SIGNED = "doc_id long, set_key binary, size int, places binary, bands array<long>"


def sign(docs: DataFrame, bands: int, rows: int, n: int = NGRAM) -> DataFrame:
    """doc_id, a digest of the n-gram set (null if it is empty), its size, one byte of each place of the signature, and band hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds = mix(np.arange(1, bands * rows + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        band_seed = mix(np.arange(7, bands + 7, dtype=np.uint64))
        for b in batches:
            keys, sizes, places, hashes = [], [], [], []
            for text in b.column("text"):
                found = grams(text.as_py(), n)
                if not len(found):
                    keys.append(None)
                    sizes.append(0)
                    places.append(b"")
                    hashes.append([])
                    continue
                keys.append(set_key(found))
                sizes.append(len(found))
                with np.errstate(over="ignore"):
                    s = signature(found, seeds).reshape(bands, rows)
                    places.append((mix(s.ravel()) >> np.uint64(56)).astype(np.uint8).tobytes())
                    h = band_seed.copy()
                    for j in range(rows):
                        h = mix(h ^ s[:, j])
                hashes.append(h.view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(keys, pa.binary()), pa.array(sizes, pa.int32()), pa.array(places, pa.binary()), pa.array(hashes, pa.list_(pa.int64()))],
                ["doc_id", "set_key", "size", "places", "bands"],
            )

    rows_in = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows_in.mapInArrow(run, SIGNED)


def _with_least(edges: DataFrame, rows: int) -> DataFrame:
    """Edges with m, the least b of their a. rows bounds the edges; no node's edges meet in one task."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n"))
    if rows <= BROADCAST_EDGES:
        return edges.join(F.broadcast(least.select("a", "m")), "a")
    hub = max(HUB, rows // BROADCAST_EDGES)
    # at most rows / hub nodes have more than hub edges, no more than BROADCAST_EDGES: they are broadcast
    hubs = F.broadcast(least.where(F.col("n") > hub).select("a", "m"))
    others = edges.join(hubs.select("a"), "a", "left_anti").join(least.where(F.col("n") <= hub).select("a", "m"), "a")
    return edges.join(hubs, "a").unionByName(others)


def components(edges: DataFrame, label: str = "links") -> DataFrame:
    """Connected components of edges (a, b): node, root (its least node).

    Alternating large-star and small-star steps, whose number grows with the
    logarithm of the nodes. Each step is written as a table; a group is only ever
    aggregated to its least neighbour.
    """
    now = materialise(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), label)
    rows, before = now.count(), None
    while True:
        # large star: neighbours above a node go to the least of the node and its neighbours
        both = now.select("a", "b").unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _with_least(both, 2 * rows).where("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b")).where("a <> b").distinct()
        # small star: a node and its neighbours below go to the least of them
        ends = F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))
        small = _with_least(large, 2 * rows).select(F.explode(ends).alias("e")).select("e.a", "e.b").where("a <> b").distinct()
        new = materialise(small, label)
        state = new.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        discard(now)  # the next round reads only the new table
        if state == before or state[0] == 0:
            break
        before, now, rows = state, new, state[0]
    stars = new.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return stars.unionByName(new.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _grow(low: np.ndarray, step) -> np.ndarray:
    """Least member of each connected group; step(roots) is the least root among a member's neighbours."""
    while True:
        new = np.minimum(low, step(low))
        new = new[new]
        if (new == low).all():
            return low
        low = new


def _agreeing(least: int):
    """Rows (hash, i, j, side, node, places) sorted by hash, i, j -> a forest (a, b) of the pairs that agree in enough places."""

    def solve(nodes: np.ndarray, sides: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(nodes)
        near = np.zeros((n, n), bool)
        for lo in range(0, n, 256):
            same = np.zeros((min(256, n - lo), n), np.uint16)
            for k in range(places.shape[1]):
                same += places[lo : lo + 256, k, None] == places[None, :, k]
            near[lo : lo + 256] = same >= least
        if sides.any() and not sides.all():  # two blocks: only pairs across them
            near &= sides[:, None] != sides[None, :]
        np.fill_diagonal(near, True)
        root = _grow(np.arange(n), lambda low: np.where(near, low[None, :], n).min(1))
        child = np.flatnonzero(root != np.arange(n))
        return nodes[child], nodes[root[child]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        key = None

        def flush() -> pa.RecordBatch:
            a = b = np.zeros(0, np.int64)
            if len(held) > 1:
                places = np.frombuffer(b"".join(r[2] for r in held), np.uint8).reshape(len(held), -1)
                a, b = solve(np.array([r[1] for r in held], np.int64), np.array([r[0] for r in held], bool), places)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in ("hash", "i", "j", "side", "node", "places"))):
                if row[:3] != key:
                    if len(held) > 1:
                        yield flush()
                    held.clear()
                    key = row[:3]
                held.append(row[3:])
        yield flush()

    return run


def _placed(members: DataFrame, key: str, parts) -> DataFrame:
    """Members of each group dealt to its pairs of blocks (i, j), i <= j; side tells which of the two a member is of."""
    own = F.pmod(F.xxhash64(F.lit(9), "node"), F.col("parts")).cast("int")
    return (
        members.withColumn("parts", parts.cast("int"))
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .withColumn("i", F.least("own", "other"))
        .withColumn("j", F.greatest("own", "other"))
        .withColumn("side", (F.col("own") > F.col("other")).cast("int"))
        .drop("own", "other", "parts")
        .repartition(key, "i", "j")
        .sortWithinPartitions(key, "i", "j", "side", "node")
    )


def agreeing(classes: DataFrame, least: int, bucket: int = BUCKET) -> DataFrame:
    """Edges (a, b) that connect the classes which share a band and agree in at least `least` places."""
    banded = classes.select("node", F.explode(F.array_distinct("bands")).alias("hash"))
    digest = [F.bit_xor(F.xxhash64(F.lit(i), "node")).alias(f"d{i}") for i in (1, 2)]
    buckets = banded.groupBy("hash").agg(F.count(F.lit(1)).alias("k"), *digest).where("k > 1")
    # near copies share many bands: of the buckets with the same members one is enough
    buckets = buckets.groupBy("k", "d1", "d2").agg(F.min("hash").alias("hash")).select("hash", "k")
    members = banded.join(buckets, "hash").join(classes.select("node", "places"), "node")
    placed = _placed(members, "hash", F.ceil(F.col("k") / bucket)).select("hash", "i", "j", "side", "node", "places")
    return placed.mapInArrow(_agreeing(least), "a long, b long")


def _sets(n: int):
    """Rows (text, set_key, ...) -> the n-gram set of those whose set it is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [grams(t.as_py(), n) for t in b.column("text")]
            keep = np.array([set_key(f) == k.as_py() for f, k in zip(found, b.column("set_key"))], bool)
            rows = pa.array(np.flatnonzero(keep))
            columns = [b.column(c).take(rows) for c in ("root", "node", "copies")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([found[i].tobytes() for i in rows.to_pylist()], pa.binary())], ["root", "node", "copies", "grams"])

    return run


def _verify(fraction: tuple[int, int]):
    """Sorted rows (component, block pair, side, node, size, grams) -> node, copies of its partners, partner to join."""
    p, q = fraction

    def solve(sides: np.ndarray | None, copies: np.ndarray, sets: list[np.ndarray]):
        n = len(sets)
        sizes = np.array([len(s) for s in sets], np.int64)
        all_ = np.concatenate(sets)
        owner = np.repeat(np.arange(n), sizes)
        _, ids, times = np.unique(all_, return_inverse=True, return_counts=True)
        shared = times[ids] > 1
        ids, owner = ids[shared], owner[shared]
        _, ids = np.unique(ids, return_inverse=True)
        exact = np.float32 if sizes.max() < 1 << 24 else np.float64
        both = np.zeros((n, n), exact)
        width = int(ids.max()) + 1 if len(ids) else 0
        step = max(1, (8 << 20) // n)
        order = np.argsort(ids, kind="stable")
        ids, owner = ids[order], owner[order]
        for lo in range(0, width, step):  # at most 8M cells at once
            a, b = np.searchsorted(ids, [lo, lo + step])
            m = np.zeros((n, min(step, width - lo)), exact)
            m[owner[a:b], ids[a:b] - lo] = 1
            both += m @ m.T
        common = both.astype(np.int64)
        linked = q * common >= p * (sizes[:, None] + sizes[None, :] - common)
        np.fill_diagonal(linked, False)
        if sides is not None:  # two blocks: only pairs across them
            linked &= sides[:, None] != sides[None, :]
        return linked @ copies, _grow(np.arange(n), lambda low: np.where(linked, low[None, :], n).min(1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        key = None
        out: list[tuple[int, int, int]] = []

        def flush():
            if len(held) > 1:
                nodes = np.array([r[1] for r in held], np.int64)
                sides = None if key[1] == key[2] else np.array([r[0] for r in held])
                links, root = solve(sides, np.array([r[2] for r in held], np.int64), [np.frombuffer(r[3], np.uint64) for r in held])
                out.extend((int(a), int(b), int(nodes[r])) for a, b, r in zip(nodes, links, root) if b)
            held.clear()

        def emit():
            columns = list(zip(*out)) or [(), (), ()]
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["node", "links", "root"])

        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in ("root", "i", "j", "side", "node", "copies", "grams"))):
                if row[:3] != key:
                    flush()
                    key = row[:3]
                if not held or held[-1][1] != row[4]:  # a row that repeats gives its class twice
                    held.append(row[3:])
            if len(out) > 10_000:
                yield emit()
        flush()
        yield emit()

    return run


def near_duplicates(
    docs: DataFrame, similarity: tuple[int, int] = THRESHOLD, n: int = NGRAM, recall: float = RECALL, block: int = BLOCK
) -> DataFrame:
    """One row per input row: doc_id, class_id, n_links, copy_of.

    Words are runs of other characters than ASCII white space. copy_of is the least
    doc_id with the same n-gram set; class_id the least doc_id of the connected
    group of documents linked by a Jaccard similarity of at least `similarity`;
    n_links the number of other rows so linked, copies included. Null, empty or
    blank texts have no n-grams and no links: class_id and copy_of are their own
    doc_id. A null doc_id counts as the least long and is shown as null. Rows that
    repeat are copies of each other. Other columns are ignored; an empty table gives
    no rows; texts are read whole.
    """
    share = similarity[0] / similarity[1]
    bands, rows = choose_bands(share, recall)
    lowest = F.coalesce("doc_id", F.lit(-(2**63)).cast("long"))
    signed = materialise(sign(docs, bands, rows, n), "minhash")
    classes = materialise(
        signed.where("set_key IS NOT NULL")
        .groupBy("set_key")
        .agg(F.min(lowest).alias("rep"), F.count(F.lit(1)).alias("copies"), F.first(F.struct("size", "places", "bands")).alias("s"))
        .select("set_key", "rep", "copies", "s.*", F.xxhash64("set_key").alias("node")),
        "classes",
    )
    candidates = components(agreeing(classes, choose_agreement(share, bands * rows, recall)), "candidates")
    wanted = candidates.join(classes.select("node", "set_key", "rep", "copies", "size"), "node")
    # members by number and by bytes: a block of either bound, whatever the lengths of the texts
    need = F.greatest(F.count(F.lit(1)) / block, F.sum(F.col("size").cast("long") * 8) / BLOCK_BYTES)
    parts = wanted.groupBy("root").agg(F.ceil(need).alias("parts"))
    texts = docs.select(lowest.cast("long").alias("rep"), F.col("text").cast("string").alias("text"))
    members = texts.join(wanted, "rep").select("text", "set_key", "root", "node", "copies").mapInArrow(_sets(n), "root long, node long, copies long, grams binary")
    placed = _placed(members.join(parts.withColumnRenamed("parts", "p"), "root"), "root", F.col("p"))
    verified = materialise(
        placed.select("root", "i", "j", "side", "node", "copies", "grams").mapInArrow(_verify(similarity), "node long, links long, root long"), "verified"
    )
    links = verified.groupBy("node").agg(F.sum("links").alias("links"))
    groups = components(verified.select(F.col("node").alias("a"), F.col("root").alias("b")), "groups")
    info = classes.select("node", "set_key", "rep", "copies").join(links, "node", "left").join(groups, "node", "left")
    info = info.withColumn("root", F.coalesce("root", "node"))
    least = info.groupBy("root").agg(F.min("rep").alias("class"))
    info = info.join(least, "root").select("set_key", "class", "rep", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    shown = lambda c: F.when(F.col(c) == F.lit(-(2**63)).cast("long"), F.lit(None)).otherwise(F.col(c))
    own = signed.select("doc_id", "set_key")
    return own.join(info, "set_key", "left").select(
        "doc_id",
        F.when(F.col("set_key").isNull(), F.col("doc_id")).otherwise(shown("class")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("set_key").isNull(), F.col("doc_id")).otherwise(shown("rep")).alias("copy_of"),
    )


def op7_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    """near_duplicates() of all documents; nulls, repeats and empty tables as there."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
