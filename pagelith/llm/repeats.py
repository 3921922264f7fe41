"""Distributed search for repeated windows, shared by the two substring operators.

1. Each document picks anchors (anchors.py). Anchors travel as packed blocks, one
   for each bucket of their hash; a hash that a block of documents repeats travels
   once. Hashes met twice mark the positions that can lie in repeated windows.
2. Only at those positions the surrounding symbols are cut out. Within a block of
   documents, and then for each hash over all documents, the contexts right and
   left of the anchor are sorted by the operator's own method. Windows are equal
   if they share an offset from the anchor, a right prefix and a left prefix long
   enough, which the sorted order and its prefix lengths tell; the first by
   (doc_id, row, position) is the original. Only windows that the block does not
   remove are sent on, so a group of copies shrinks before it is shuffled. A hash
   that many blocks hold is common: its contexts are sorted in salted groups first.
   What they do not remove is cut into cells of some offsets, and the windows of a
   cell meet by a hash of the longer run of symbols they all share (the window but for
   one symbol less than the cell has offsets). So the prefix a group is made by grows with how common it is,
   and a phrase that stands among different texts does not bring them all together.
3. Ranges of removed windows go back to their documents.

Whole copies of a document are found by key first, and count as its windows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelith.llm import anchors as A
from pagelith.llm.common import row_keys

#: Symbols of a block of documents that is handled at once; a longer document is a block of its own.
BLOCK = 2_000_000
ANCHOR = np.dtype([("hash", "<u8"), ("key", "<i8"), ("pos", "<u4")])
MET = 1  # the hash was met twice already within a block of documents
#: A hash that so many blocks hold, or that a block repeats, is common.
MANY_BLOCKS = 1024
COMMON = np.uint32(1 << 31)  # set on positions of common hashes
SALTS = 64

@dataclass
class Kind:
    """How texts become symbols and contexts.

    symbols(list of texts) -> (uint64 values end to end, ends, cut), where
    cut(first, last) are the bytes of symbols first..last-1.
    order(group, contexts, shared) -> order, prefix lengths in symbols.
    encoder: contexts as comparable bytes, width bytes a symbol; None if they are that already.
    part(context, i, j): its symbols i..j-1.
    cell: offsets of a cell of a common hash.
    """

    length: int
    k: int
    symbols: Callable
    order: Callable
    encoder: Callable | None
    width: int
    same_document: bool
    part: Callable
    cell: int = 16


def _blocks(rows: Iterator[pa.RecordBatch], names: tuple[str, ...]) -> Iterator[dict[str, list]]:
    """Columns of some documents at a time, by size of text."""
    held: dict[str, list] = {n: [] for n in names}
    size = 0
    for b in rows:
        columns = [b.column(n).to_pylist() for n in names]
        for row in zip(*columns):
            for n, v in zip(names, row):
                held[n].append(v)
            size += len(row[0])
            if size >= BLOCK:
                yield held
                held, size = {n: [] for n in names}, 0
    if held[names[0]]:
        yield held


def _anchor_blocks(kind: Kind, buckets: int):
    """Blobs of anchors by bucket (whole = false), and positions of a document whose hashes the block repeats (whole = true)."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(rows, ("text", "k1", "doc_id")):
            values, ends, _ = kind.symbols(block["text"])
            doc, at, lo, hi, h = A.find(values, ends, kind.length, kind.k)
            if not len(doc):
                continue
            starts = np.concatenate([[0], ends[:-1]])
            keys = np.array(block["k1"], np.int64)[doc]
            out = np.zeros(len(doc), ANCHOR)
            out["hash"], out["key"], out["pos"] = h, keys, at - starts[doc]
            order = np.argsort(h, kind="stable")
            s = h[order]
            new = np.concatenate([[True], s[1:] != s[:-1]])
            twice = ~new
            twice[:-1] |= ~new[1:]
            lone, repeated = order[~twice], order[twice]
            heads = order[new & twice]
            bucket, key, blob, whole = [], [], [], []
            send = out[np.concatenate([lone, heads])]
            flag = np.concatenate([np.zeros(len(lone), np.uint8), np.full(len(heads), MET, np.uint8)])
            b = (send["hash"] % np.uint64(buckets)).astype(np.int64)
            by = np.argsort(b, kind="stable")
            cut = np.searchsorted(b[by], np.arange(buckets + 1))
            for j in range(buckets):
                rows_j = by[cut[j] : cut[j + 1]]
                if len(rows_j):
                    bucket.append(j)
                    key.append(0)
                    whole.append(False)
                    blob.append(flag[rows_j].tobytes() + send[rows_j].tobytes())
            mine = out[repeated]
            mine = mine[np.argsort(mine["key"], kind="stable")]
            edges = np.flatnonzero(np.concatenate([[True], mine["key"][1:] != mine["key"][:-1]])) if len(mine) else []
            for x, y in zip(edges, [*edges[1:], len(mine)]):
                key.append(int(mine["key"][x]))
                bucket.append(key[-1] % buckets)
                whole.append(True)
                blob.append((mine["pos"][x:y] | COMMON).tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(bucket, pa.int32()), pa.array(key, pa.int64()), pa.array(blob, pa.binary()), pa.array(whole, pa.bool_())], ["bucket", "k1", "blob", "whole"]
            )

    return run


def _met_twice(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a task's buckets: for each document, positions of the anchors whose hash was met twice."""
    parts, flags = [], []
    for b in rows:
        done = b.filter(b.column("whole"))
        yield pa.RecordBatch.from_arrays([done.column("k1"), done.column("blob")], ["k1", "blob"])
        for blob in b.filter(pc.invert(b.column("whole"))).column("blob").to_pylist():
            n = len(blob) // (ANCHOR.itemsize + 1)
            flags.append(np.frombuffer(blob, np.uint8, n))
            parts.append(np.frombuffer(blob, ANCHOR, n, n))
    if not parts:
        return
    all_, flag = np.concatenate(parts), np.concatenate(flags)
    del parts, flags
    order = np.argsort(all_["hash"], kind="stable")
    h = all_["hash"][order]
    same = h[1:] == h[:-1]
    twice = np.zeros(len(h), bool)
    twice[1:] |= same
    twice[:-1] |= same
    head = np.flatnonzero(np.concatenate([[True], ~same]))
    size = np.diff(np.append(head, len(h)))
    common = np.repeat((np.maximum.reduceat(flag[order], head) == MET) | (size > MANY_BLOCKS), size)
    at = np.flatnonzero(twice & (flag[order] == 0))
    found = all_[order[at]]
    found["pos"] |= np.where(common[at], COMMON, np.uint32(0))
    # a representative of a hash that its own block repeats was sent on by that block
    found = found[np.argsort(found["key"], kind="stable")]
    if not len(found):
        return
    edges = np.flatnonzero(np.concatenate([[True], found["key"][1:] != found["key"][:-1]]))
    ends = np.append(edges[1:], len(found))
    for lo in range(0, len(edges), 20_000):
        e = list(zip(edges[lo : lo + 20_000].tolist(), ends[lo : lo + 20_000].tolist()))
        yield pa.RecordBatch.from_arrays(
            [pa.array([int(found["key"][x]) for x, _ in e], pa.int64()), pa.array([found["pos"][x:y].tobytes() for x, y in e], pa.binary())], ["k1", "blob"]
        )


def _removed(group: np.ndarray, seg: list[bytes], lo: np.ndarray, hi: np.ndarray, doc: np.ndarray, key: np.ndarray, rank: np.ndarray, kind: Kind):
    """Contexts x offsets: is the window that begins so far before the anchor removed, and does its row hold it before?

    group is sorted; rank orders contexts by (doc_id, row key, position).
    """
    n, length, width = len(seg), kind.length, kind.width
    data = kind.encoder(seg) if kind.encoder else seg
    right = [t[h * width :] for t, h in zip(data, hi.tolist())]
    left = [np.frombuffer(t, f"u{width}", h)[::-1].tobytes() for t, h in zip(data, hi.tolist())]
    offsets = length - kind.k + 1
    removed, again = np.zeros((n, offsets), bool), np.zeros((n, offsets), bool)
    order_r, lcp_r = kind.order(group, right, kind.k)
    order_l, lcp_l = kind.order(group, left, 0)
    g_r, g_l = group[order_r], group[order_l]
    edge_r = np.concatenate([[True], g_r[1:] != g_r[:-1]])
    edge_l = np.concatenate([[True], g_l[1:] != g_l[:-1]])
    class_r, class_l = np.empty(n, np.int64), np.empty(n, np.int64)
    for o in range(offsets):
        valid = np.flatnonzero((lo <= o) & (o <= hi))
        if not len(valid):
            continue
        # a class of right contexts shares length - o symbols; of left contexts, o symbols
        class_r[order_r] = np.cumsum(edge_r | (lcp_r < length - o))
        class_l[order_l] = np.cumsum(edge_l | (lcp_l < o))
        both = class_r[valid] * (n + 1) + class_l[valid]
        by = np.lexsort((rank[valid], both))
        k = both[by]
        head = np.concatenate([[True], k[1:] != k[:-1]])
        least = valid[by[np.flatnonzero(head)[np.cumsum(head) - 1]]]
        mine = valid[by]
        removed[mine, o] = rank[least] < rank[mine] if kind.same_document else doc[least] < doc[mine]
        again[mine[1:], o] = ~head[1:] & (key[mine[1:]] == key[mine[:-1]])
    return removed, again


def _ranges(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first and last column of every run of True."""
    padded = np.pad(mask, ((0, 0), (1, 1))).astype(np.int8)
    step = np.diff(padded, axis=1)
    row, begin = np.nonzero(step == 1)
    _, end = np.nonzero(step == -1)
    return row, begin, end - 1


def _cells(mask: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, first and last column and cell of every run of True within a cell of columns."""
    found = [(row, a + lo, b + lo, np.full(len(row), lo // size)) for lo in range(0, mask.shape[1], size) for row, a, b in [_ranges(mask[:, lo : lo + size])]]
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 4


def _rank(doc: np.ndarray, key: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """Equal (doc, key, pos) - a row that repeats - share a rank."""
    order = np.lexsort((pos, key, doc))
    d, k, p = doc[order], key[order], pos[order]
    new = np.concatenate([[0], ((d[1:] != d[:-1]) | (k[1:] != k[:-1]) | (p[1:] != p[:-1])).astype(np.int64)])
    rank = np.empty(len(doc), np.int64)
    rank[order] = np.cumsum(new)
    return rank


CONTEXTS = "hash long, salt int, doc_id long, k1 long, pos long, lo int, hi int, seg binary, removed binary"
_CONTEXT_TYPES = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
_CONTEXT_NAMES = [c.split()[0] for c in CONTEXTS.split(", ")]


def _out(columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _CONTEXT_TYPES)], _CONTEXT_NAMES)


def _removed_rows(key: np.ndarray, pos: np.ndarray, removed: np.ndarray) -> tuple[list[int], list[bytes]]:
    """For each document key: pairs (first, last) of window starts removed."""
    row, a, b = _ranges(removed)
    if not len(row):
        return [], []
    pairs = np.stack([pos[row] - b, pos[row] - a], 1).astype("<i8")
    by = np.argsort(key[row], kind="stable")
    k, pairs = key[row][by], pairs[by]
    edges = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    return [int(k[x]) for x in edges], [pairs[x:y].tobytes() for x, y in zip(edges, [*edges[1:], len(k)])]


def _contexts(kind: Kind):
    """Cuts out contexts, sorts those of the block, and sends on the block's first occurrences."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(rows, ("text", "doc_id", "k1", "blobs")):
            values, ends, cut = kind.symbols(block["text"])
            starts = np.concatenate([[0], ends[:-1]])
            wanted = [np.unique(np.frombuffer(b"".join(x), "<u4")) for x in block["blobs"]]
            place = np.concatenate([(x & ~COMMON).astype(np.int64) + s for x, s in zip(wanted, starts.tolist())])
            often = np.concatenate([(x & COMMON) > 0 for x in wanted])
            doc, at, lo, hi, h = A.find(values, ends, kind.length, kind.k)
            keep = np.isin(at, place)
            doc, at, lo, hi, h = doc[keep], at[keep], lo[keep], hi[keep], h[keep]
            common = np.isin(at, place[often])
            if not len(doc):
                continue
            by = np.argsort(h, kind="stable")
            doc, at, lo, hi, h, common = doc[by], at[by], lo[by], hi[by], h[by], common[by]
            seg = [cut(a, b) for a, b in zip((at - hi).tolist(), (at - lo + kind.length).tolist())]
            ids = np.array([-(2**63) if x is None else x for x in block["doc_id"]], np.int64)[doc]
            keys, pos = np.array(block["k1"], np.int64)[doc], at - starts[doc]
            salt = np.where(common, keys % SALTS, -1)
            new = np.concatenate([[True], h[1:] != h[:-1]])
            group = np.cumsum(new)
            lone = new & np.append(new[1:], True)
            many = np.flatnonzero(~lone)
            offset = np.arange(kind.length - kind.k + 1)
            stay = (lo[:, None] <= offset) & (offset <= hi[:, None])
            if len(many):
                rank = _rank(ids[many], keys[many], pos[many])
                gone, again = _removed(group[many], [seg[i] for i in many.tolist()], lo[many], hi[many], ids[many], keys[many], rank, kind)
                stay[many] &= ~(gone | again)  # what befalls a row's first copy of a window befalls the others
                k, blobs = _removed_rows(keys[many], pos[many], gone)
                n = len(k)
                yield _out([k, [-1] * n, [0] * n, k, [0] * n, [0] * n, [0] * n, [None] * n, blobs])
            row, p, q = _ranges(stay)
            for x in range(0, len(row), 20_000):
                r, a, b = row[x : x + 20_000], p[x : x + 20_000], q[x : x + 20_000]
                part = [cut(i, j) for i, j in zip((at[r] - b).tolist(), (at[r] - a + kind.length).tolist())]
                yield _out([h[r].view(np.int64), salt[r], ids[r], keys[r], pos[r], a, b, part, [None] * len(r)])

    return run


def _settle(kind: Kind, final: bool, flush: int = 24 << 20):
    """Contexts sorted by hash -> removed window starts, whole groups at a time.

    Not final: a group is a hash and salt; what a salted group does not remove is sent
    on in cells, each under the hash of what its windows share. Rows that tell of
    removed windows pass through.
    """

    def solve(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(held)
        h, salt, ids, keys, pos, lo, hi = (t.column(c).to_numpy() for c in ("hash", "salt", "doc_id", "k1", "pos", "lo", "hi"))
        lo, hi = lo.astype(np.int64), hi.astype(np.int64)
        new = np.concatenate([[True], (h[1:] != h[:-1]) | ((salt[1:] != salt[:-1]) & (not final))])
        stay = np.zeros((len(h), 0), bool)
        many = np.flatnonzero(~(new & np.append(new[1:], True)))
        offset = np.arange(kind.length - kind.k + 1)
        if not final:
            stay = (lo[:, None] <= offset) & (offset <= hi[:, None]) & (salt >= 0)[:, None]
        if len(many):
            seg = t.column("seg").take(pa.array(many)).to_pylist()
            rank = _rank(ids[many], keys[many], pos[many])
            gone, again = _removed(np.cumsum(new)[many], seg, lo[many], hi[many], ids[many], keys[many], rank, kind)
            k, blobs = _removed_rows(keys[many], pos[many], gone)
            n = len(k)
            yield _out([k, [-1] * n, [0] * n, k, [0] * n, [0] * n, [0] * n, [None] * n, blobs])
            if not final:
                stay[many] &= ~(gone | again)
        if final:
            return
        row, p, q, cell = _cells(stay, kind.cell)
        for x in range(0, len(row), 20_000):
            r, a, b, c = row[x : x + 20_000], p[x : x + 20_000], q[x : x + 20_000], cell[x : x + 20_000]
            first = t.column("seg").take(pa.array(r)).to_pylist()
            part = [kind.part(s, i, j) for s, i, j in zip(first, (hi[r] - b).tolist(), (hi[r] - a + kind.length).tolist())]
            # in the part, the symbols that every window of the cell holds
            last = np.minimum((c + 1) * kind.cell, kind.length - kind.k + 1) - 1
            core = [kind.part(s, i, j) for s, i, j in zip(part, (b - c * kind.cell).tolist(), (b - last + kind.length).tolist())]
            group = np.array([xxhash.xxh3_64_intdigest(s, seed=i) for s, i in zip(core, c.tolist())], np.uint64)
            yield _out([group.view(np.int64), salt[r], ids[r], keys[r], pos[r], a, b, part, [None] * len(r)])

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for b in rows:
            yield b.filter(pc.is_valid(b.column("removed")))
            b = b.filter(pc.is_null(b.column("removed")))
            if not b.num_rows:
                continue
            held.append(b)
            size += b.nbytes
            if size >= flush:
                h = b.column("hash").to_numpy()
                cut = int(np.searchsorted(h, h[-1]))  # the last hash may go on
                if cut == 0:
                    continue
                held[-1] = b.slice(0, cut)
                yield from solve(held)
                held, size = [b.slice(cut)], 0
        if held:
            yield from solve(held)

    return run


def remove(docs: DataFrame, kind: Kind, finish: Callable, schema: str, buckets: int | None = None) -> DataFrame:
    """finish(texts, doc_ids, copies, list of (first, last) arrays) -> columns of the schema.

    The arrays hold window starts. Of a row's equal windows the first stands for the
    others, unless the rule is to remove within a document too.
    """
    spark = docs.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = row_keys(docs)
    lowest = F.coalesce("doc_id", F.lit(-(2**63)).cast("long"))
    own = keyed.select("k1", "k2", F.xxhash64(F.lit(5), "text").alias("k3"), lowest.alias("doc"))
    originals = own.groupBy("k2", "k3").agg(F.min_by("k1", "doc").alias("k1")).select("k1", F.lit(True).alias("original"))
    # texts are shuffled once by k1: all three joins below read that exchange
    blocks = keyed.join(originals, "k1").select("text", "k1", "doc_id").mapInArrow(_anchor_blocks(kind, buckets), "bucket int, k1 long, blob binary, whole boolean")
    met = blocks.repartition(buckets, "bucket").select("k1", "blob", "whole").mapInArrow(_met_twice, "k1 long, blob binary")
    wanted = met.groupBy("k1").agg(F.collect_list("blob").alias("blobs"))
    contexts = keyed.join(wanted, "k1").select("text", "k1", "doc_id", "blobs").mapInArrow(_contexts(kind), CONTEXTS)
    combined = contexts.repartition(buckets, "hash", "salt").sortWithinPartitions("hash", "salt").mapInArrow(_settle(kind, False), CONTEXTS)
    decided = combined.repartition(buckets, "hash").sortWithinPartitions("hash").mapInArrow(_settle(kind, True), CONTEXTS)
    gone = decided.groupBy("k1").agg(F.collect_list("removed").alias("removed"))
    copies = originals.join(gone, "k1", "left")
    all_ = keyed.join(copies, "k1", "left").select("text", "k1", "doc_id", F.isnull("original").alias("copy"), "removed")

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in schema.split(", ")]
        for b in rows:
            text, doc_id, copy, removed = (b.column(c).to_pylist() for c in ("text", "doc_id", "copy", "removed"))
            pairs = [np.frombuffer(b"".join(r), "<i8").reshape(-1, 2) if r else np.zeros((0, 2), np.int64) for r in removed]
            columns = finish(text, doc_id, copy, pairs)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)

    return all_.mapInArrow(run, schema)
