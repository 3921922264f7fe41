"""Packing: non-negative least squares over shallow length combinations.

A document of T tokens gives T // window full sequences and one remainder. The
histogram of remainders has fewer bins than a window has tokens, whatever the
corpus. On it: shallow combinations that fill a window exactly, repeat counts by
non-negative least squares, rounded down, and the residual packed greedily: exact
pairs first, then end to end with cuts. The plan is a bounded table; a document
finds its place from its rank among the remainders of its length, so nothing is
gathered but counts.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelith.llm.common import materialise

WINDOW = 2048
END_ID = 1
#: Rank offsets are broadcast up to this many bytes; beyond it they are joined by shuffle.
BROADCAST_BYTES = 32 << 20


def default_tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


# --- tokens --------------------------------------------------------------------------------------


#: Texts of these characters only are normalised by lower-casing alone, and split by UNITS.
SAFE = bytes([*range(9, 14), *range(32, 127), *range(0xC0, 0xD7), *range(0xD8, 0xF7), *range(0xF8, 0x100)])
#: The tokenizer's own split, on lower-cased safe text.
UNITS = re.compile("[a-zß-öø-ÿ]+|[0-9]|'(?:s|t|re|ve|m|ll|d)|[^\\sa-z0-9ß-öø-ÿ]+")


def is_safe(text: str) -> bool:
    try:
        return not text.encode("latin-1").translate(None, SAFE)
    except UnicodeEncodeError:
        return False


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if printable, else the next from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}


class _Units(dict):
    """Ids of units as bytes; one not met before is merged by the tokenizer's model."""

    def __init__(self, model, code: str, most: int):
        super().__init__()
        self.model, self.code, self.most, self.letters = model, code, most, byte_letters()

    def __missing__(self, unit: str) -> bytes:
        if len(self) > self.most:
            for u in list(self)[: self.most // 2]:
                del self[u]
        letters = unit if unit.isascii() else unit.encode().decode("latin-1").translate(self.letters)
        self[unit] = ids = array(self.code, [t.id for t in self.model.tokenize(letters)]).tobytes()
        return ids


class Encoder:
    """Ids of whole texts as bytes (16 or 32 bits each), equal to the tokenizer's own.

    The tokenizer merges within the units that its split makes, so the ids of a unit
    are looked up. Chunks between blanks with other than safe characters go to the
    tokenizer as they are, and texts with a special token's name go whole.
    """

    def __init__(self, path: str, cache: int = 150_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # each task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        top = max(self.tokenizer.get_vocab().values())
        self.type = "<u2" if top < 65536 else "<u4"
        self.units = _Units(self.tokenizer.model, "H" if top < 65536 else "I", cache)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.type).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _safe(self, text: str) -> bytes:
        return b"".join(map(self.units.__getitem__, UNITS.findall(text.lower())))

    def one(self, text: str) -> bytes:
        if any(s in text for s in self.special):
            return self._encode([text])[0]
        if is_safe(text):
            return self._safe(text)
        chunks = text.replace("\n", " ").split(" ")
        ok = [is_safe(c) for c in chunks]
        odd = iter(self._encode([c for c, x in zip(chunks, ok) if not x]))
        return b"".join([self._safe(c) if x else next(odd) for c, x in zip(chunks, ok)])


@lru_cache(maxsize=1)
def shared_encoder(path: str) -> Encoder:
    """One encoder for all tasks of a worker process, so that its units serve the next task too."""
    return Encoder(path)


# --- plan ----------------------------------------------------------------------------------------


def combinations(hist: np.ndarray, window: int, depth: int, limit: int) -> np.ndarray:
    """Length multisets (rows padded with 0) of at most depth parts that fill the window exactly.

    All pairs that occur, then triples and quadruples led by the commonest lengths,
    limit of each depth at most.
    """
    there = np.flatnonzero(hist[: window + 1])
    there = there[there > 0]
    out = [np.array([[a, window - a] + [0] * (depth - 2) for a in there if a <= window - a and hist[window - a]], np.int64).reshape(-1, depth)]
    by_count = there[np.argsort(-hist[there], kind="stable")]
    for size in range(3, depth + 1):
        lead = by_count[: max(2, int(round(limit ** (1 / (size - 1)))))]
        grid = np.stack(np.meshgrid(*[lead] * (size - 1), indexing="ij"), -1).reshape(-1, size - 1)
        last = window - grid.sum(1)
        ok = (last > 0) & (np.diff(grid, axis=1) >= 0).all(1)
        grid, last = grid[ok], last[ok]
        ok = hist[last] > 0
        rows = np.sort(np.concatenate([grid[ok], last[ok, None]], 1), 1)
        out.append(np.pad(np.unique(rows, axis=0), ((0, 0), (0, depth - size))) if len(rows) else np.zeros((0, depth), np.int64))
    return np.concatenate(out)


def nnls(combos: np.ndarray, hist: np.ndarray, steps: int = 400) -> np.ndarray:
    """min |A x - hist|^2, x >= 0, where column j of A counts the lengths of combination j.

    Accelerated projected gradient on the sparse A.
    """
    m = len(combos)
    if not m:
        return np.zeros(0)
    rows, cols = combos.ravel(), np.repeat(np.arange(m), combos.shape[1])
    ok = rows > 0
    rows, cols, bins = rows[ok], cols[ok], len(hist)
    apply = lambda x: np.bincount(rows, x[cols], bins)
    back = lambda r: np.bincount(cols, r[rows], m)
    v = np.ones(m)
    for _ in range(12):
        v = back(apply(v))
        top = np.linalg.norm(v)
        v /= top
    x = z = np.zeros(m)
    t, target = 1.0, hist.astype(float)
    for _ in range(steps):
        new = np.maximum(0, z - back(apply(z) - target) / (1.02 * top))
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z, x, t = new + (t - 1) / t2 * (new - x), new, t2
    return x


@dataclass
class Plan:
    """For each length: ranges of ranks with (first rank, first sequence, offset), then the stream.

    A rank k of length l in [lo, lo + n) is in sequence seq + (k - lo) at the
    offset. Ranks from stream_from[l] on lie end to end: they begin at token
    stream_at[l] + (k - stream_from[l]) * l of the stream, whose first sequence is
    stream_seq; its last, partial window is cut into powers of two.
    """

    window: int
    ranges: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]
    stream_from: np.ndarray
    stream_at: np.ndarray
    stream_seq: int
    stream_tokens: int
    sequences: int

    def stream_cuts(self) -> tuple[np.ndarray, np.ndarray]:
        """Of the last window: begins within it, and sizes."""
        rest = self.stream_tokens % self.window
        sizes = np.array([1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1], np.int64)
        return np.concatenate([[0], np.cumsum(sizes)])[:-1].astype(np.int64), sizes

    def place(self, length: int, rank: int) -> list[tuple[int, int, int, int]]:
        """Pieces (start in the remainder, length, sequence, offset)."""
        if rank < self.stream_from[length]:
            first, seq, offset = self.ranges[length]
            i = int(np.searchsorted(first, rank, side="right")) - 1
            return [(0, length, int(seq[i] + rank - first[i]), int(offset[i]))]
        at = int(self.stream_at[length] + (rank - self.stream_from[length]) * length)
        out, done, full = [], 0, self.stream_tokens // self.window
        begins, sizes = self.stream_cuts()
        while done < length:
            w, inside = divmod(at + done, self.window)
            if w < full:
                seq, offset, room = self.stream_seq + w, inside, self.window - inside
            else:
                i = int(np.searchsorted(begins, inside, side="right")) - 1
                seq, offset = self.stream_seq + full + i, inside - int(begins[i])
                room = int(sizes[i]) - offset
            n = min(room, length - done)
            out.append((done, n, seq, offset))
            done += n
        return out


def solve(hist: np.ndarray, window: int = WINDOW, depth: int = 4, limit: int = 20_000) -> Plan:
    """hist[l]: how many remainders have l tokens, 0 < l < window."""
    hist = np.asarray(hist, np.int64)
    combos = combinations(hist, window, depth, limit)
    counts = np.floor(nnls(combos, hist) + 1e-6).astype(np.int64)
    left = hist.copy()
    used = []
    exact = [(c, None) for c in combos[combos[:, 2] == 0]]  # greedy residual: pairs that fill exactly
    for combo, n in [(combos[j], counts[j]) for j in np.argsort(-counts, kind="stable") if counts[j]] + exact:
        lengths, need = np.unique(combo[combo > 0], return_counts=True)
        n = int(min([*(left[lengths] // need), *([] if n is None else [n])]))
        if n > 0:
            left[lengths] -= n * need
            used.append((combo[combo > 0], n))
    first = np.zeros(window + 1, np.int64)
    ranges: dict[int, list] = {}
    seq = 0
    for combo, n in used:
        offset = 0
        for length in combo.tolist():
            ranges.setdefault(length, []).append((int(first[length]), seq, offset))
            first[length] += n
            offset += length
        seq += n
    at, start = np.zeros(window + 1, np.int64), 0
    for length in range(window, 0, -1):  # longest first
        if length < len(left):
            at[length] = start
            start += int(left[length]) * length
    plan = Plan(window, {k: tuple(np.array(c, np.int64) for c in zip(*v)) for k, v in ranges.items()}, first, at, seq, start, 0)
    plan.sequences = seq + start // window + len(plan.stream_cuts()[0])
    return plan


# --- Spark ---------------------------------------------------------------------------------------

TOKENS = "doc_id long, ids binary, n long, part long, rank long, fulls long"
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def tokenised(docs: DataFrame, path: str, window: int) -> DataFrame:
    """Ids (unsigned 16 or 32 bits) with the row's rank, within its task, among remainders of its length."""

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, rank, fulls = shared_encoder(path), np.zeros(window, np.int64), 0
        for b in rows:
            ids, n, ranks, before = [], [], [], []
            size, end = int(encoder.type[-1]), np.array([END_ID], encoder.type).tobytes()
            for text in b.column("text"):
                raw = encoder.one(text.as_py())
                count = len(raw) // size + 1
                rest = count % window
                ids.append(raw + end)
                n.append(count)
                ranks.append(rank[rest])
                before.append(fulls)
                rank[rest] += 1
                fulls += count // window
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(ids, pa.binary()), pa.array(n, pa.int64()), b.column("part"), pa.array(ranks, pa.int64()), pa.array(before, pa.int64())],
                ["doc_id", "ids", "n", "part", "rank", "fulls"],
            )

    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        F.spark_partition_id().cast("long").alias("part"),
    )
    return rows.mapInArrow(batches, TOKENS)


def pack(docs: DataFrame, path: str | None = None, window: int = WINDOW) -> DataFrame:
    """Pieces of all documents: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Null or empty text has one token, the closing id. Rows that repeat are packed
    each on its own; a null doc_id is kept as null. Only doc_id and text are read.
    Texts of any length are cut at whole windows. An empty table gives no pieces.
    Sequences are full but for those of the last window, whose sizes are powers of
    two.
    """
    tokens = materialise(tokenised(docs, path or default_tokenizer_path(), window), "packing-ids")
    rest = (F.col("n") % window).cast("int")
    # per task and remainder: at most window rows a task
    counts = tokens.groupBy("part", rest.alias("rest")).agg(F.count(F.lit(1)).alias("k"), F.sum(F.floor(F.col("n") / window)).alias("full"))
    hist_rows = counts.groupBy("rest").agg(F.sum("k").alias("k"), F.sum("full").alias("full")).collect()  # <= window rows
    hist, total_full = np.zeros(window, np.int64), 0
    for r in hist_rows:
        hist[r["rest"]] = r["k"]
        total_full += r["full"]
    hist[0] = 0
    plan = solve(hist, window)
    plan.stream_seq += total_full
    plan.ranges = {k: (a, b + total_full, c) for k, (a, b, c) in plan.ranges.items()}

    from pyspark.sql import Window

    # ranks: sums over tasks before this one, for each remainder (its rows are tasks, not documents)
    before = Window.partitionBy("rest").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ranked = counts.withColumn("base", F.coalesce(F.sum("k").over(before), F.lit(0)))
    per_part = ranked.groupBy("part").agg(
        F.map_from_entries(F.collect_list(F.struct("rest", "base"))).alias("bases"), F.sum("full").alias("part_full")
    )
    fulls = per_part.select("part", "part_full")
    # one row a task: summed in blocks, so that no task sorts them all
    block = F.floor(F.col("part") / 1024)
    in_block = Window.partitionBy(block).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    blocks = fulls.groupBy(block.alias("block")).agg(F.sum("part_full").alias("s")).collect()  # a row for 1024 tasks
    starts, run = {}, 0
    for b in sorted(blocks, key=lambda r: r["block"]):
        starts[b["block"]] = run
        run += b["s"]
    offsets = per_part.withColumn("full_in_block", F.coalesce(F.sum("part_full").over(in_block), F.lit(0))).drop("part_full")
    n_parts = offsets.count()
    if n_parts * window * 24 <= BROADCAST_BYTES:
        offsets = F.broadcast(offsets)
    placed = tokens.join(offsets, "part").select(
        "doc_id", "ids", "n", (F.col("rank") + F.element_at("bases", rest)).alias("rank"), (F.col("fulls") + F.col("full_in_block")).alias("fulls"),
        F.floor(F.col("part") / 1024).alias("block"),
    )

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            out: list[tuple] = []
            for doc_id, raw, n, rank, full, block in zip(*(b.column(c).to_pylist() for c in ("doc_id", "ids", "n", "rank", "fulls", "block"))):
                ids = np.frombuffer(raw, "<u2" if len(raw) == 2 * n else "<u4").astype("<u4")
                pieces = [(i * window, window, starts[block] + full + i, 0) for i in range(n // window)]
                if n % window:
                    pieces += [(n - n % window + s, length, q, o) for s, length, q, o in plan.place(n % window, rank)]
                out += [(doc_id, s, length, zlib.crc32(ids[s : s + length].tobytes()), n, q, o) for s, length, q, o in pieces]
            names = [x.split()[0] for x in PIECES.split(", ")]
            columns = list(zip(*out)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)

    return placed.mapInArrow(batches, PIECES)


def op5_packing(spark, sf_dir: str) -> DataFrame:
    """pack() of all documents; nulls, repeats and empty tables as there."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))


