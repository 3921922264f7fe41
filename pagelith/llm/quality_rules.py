"""Quality rules: gradient-boosted trees over document statistics.

The statistics are computed once per document in Arrow batches. The trees are
trained on the driver from a bounded sample of labelled rows and sent to the tasks
as small numpy node arrays; every other number covers all documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelith.llm import trees

#: At most so many labelled documents train the trees; they are the first by a hash of doc_id.
MAX_LABELLED = 8000
#: A document goes when the trees find it this likely to be bad. Documents are kept in doubt.
REJECT_AT = 0.8
SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\x0b\x0c\r"
FEATURES = (
    "log_words", "mean_word", "symbol_per_word", "dup_line_share", "repeat_share", "upper_share",
    "distinct_share", "top_word_share", "pipe_per_word", "digit_share", "punct_share", "mean_line_words", "adjacent_share",
)
#: A larger value of these never makes a document better.
WORSE = ("symbol_per_word", "dup_line_share", "repeat_share", "upper_share", "adjacent_share")
UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
DIGITS = b"0123456789"


def statistics(text: str | None) -> tuple[tuple[int, int, int, int, int], list[float]]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) and the trees' features."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    spaces = len(raw) - len(raw.translate(None, SPACES))
    n_symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    lines = [x for x in raw.split(b"\n") if x.strip(SPACES)]
    n_dup = len(lines) - len(set(lines))
    ids: dict[bytes, int] = {}
    seq = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
    n_repeat = 0
    if n >= 3:
        pairs = seq[:-2] * len(ids) + seq[1:-1]
        if len(ids) > 2_000_000:  # three numbers of words would not fit 63 bits
            pairs = np.unique(pairs, return_inverse=True)[1]
        grams = pairs * len(ids) + seq[2:]
        order = np.argsort(grams, kind="stable")
        same = grams[order[1:]] == grams[order[:-1]]
        if same.any():
            again = np.zeros(n - 2, bool)
            again[order[1:][same]] = True
            again[order[:-1][same]] = True
            cover = np.zeros(n, bool)
            cover[:-2] |= again
            cover[1:-1] |= again
            cover[2:] |= again
            n_repeat = int(cover.sum())
    chars = len(text) - spaces
    counts = np.bincount(seq) if n else np.zeros(1)
    upper = len(raw) - len(raw.translate(None, UPPER))
    digits = len(raw) - len(raw.translate(None, DIGITS))
    d = max(n, 1)
    features = [
        np.log1p(n), chars / d, n_symbols / d, n_dup / max(len(lines), 1), n_repeat / d, upper / max(chars, 1),
        len(ids) / d, counts.max() / d, raw.count(b"|") / d, digits / max(chars, 1),
        (raw.count(b".") + raw.count(b",")) / d, min(n / max(len(lines), 1), 500), float((seq[1:] == seq[:-1]).sum()) / d,
    ]
    return (n, chars, n_symbols, n_dup, n_repeat), features


def base_failed(n_words: int, n_repeat: int) -> bool:
    return n_words < 50 or 100 * n_repeat > 50 * n_words


def train(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> trees.Forest:
    """Trees for P(quality = 0). Documents with no label or without a row in labels are not used."""
    picked = (
        labels.where("quality IS NOT NULL AND doc_id IS NOT NULL")
        .select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(max_labelled)
    )
    # at most max_labelled rows of two numbers: a proven bound
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(picked), "doc_id")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [statistics(t.as_py())[1] for t in b.column("text")]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("quality"), pa.array(found, pa.list_(pa.float64()))], ["doc_id", "quality", "x"]
            )

    # one row for each labelled doc_id, however often it stands in docs
    one = rows.mapInArrow(features, "doc_id long, quality int, x array<double>").groupBy("doc_id").agg(F.min(F.struct("quality", "x")).alias("r"))
    found = sorted((r["doc_id"], r["r"]["quality"], r["r"]["x"]) for r in one.collect())
    if not found:
        return trees.fit(np.zeros((0, len(FEATURES))), np.zeros(0))
    x, y = np.array([r[2] for r in found]), np.array([1 - min(max(r[1], 0), 1) for r in found])
    return trees.fit(x, y, trees=40, depth=4, monotone={FEATURES.index(f): 1 for f in WORSE})


OUT = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, bad_score double"
)


def judge(docs: DataFrame, forest: trees.Forest, reject_at: float = REJECT_AT) -> DataFrame:
    """One row per input row: counts, base rules and the verdict (see op6_quality_rules).

    Null or empty text: no words, base_failed. Only doc_id and text are read, so
    other columns cannot clash. Repeated rows give repeated results; an empty table
    gives none. Whole texts are read, of any length.
    """

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            found = [statistics(t.as_py()) for t in b.column("text")]
            if not found:
                continue
            n = np.array([c for c, _ in found], np.int64)
            failed = (n[:, 0] < 50) | (100 * n[:, 4] > 50 * n[:, 0])
            score = forest.score(np.array([x for _, x in found]))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), *(pa.array(n[:, j]) for j in range(5)), pa.array(failed), pa.array(~failed & (score < reject_at)), pa.array(score)],
                ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "bad_score"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(batches, OUT)


def keep(docs: DataFrame, forest: trees.Forest, reject_at: float = REJECT_AT) -> DataFrame:
    """The input rows, with all their columns, that judge keeps."""

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            if not b.num_rows:
                continue
            found = [statistics(t.as_py()) for t in b.column("text")]
            failed = np.array([base_failed(c[0], c[4]) for c, _ in found])
            score = forest.score(np.array([x for _, x in found]))
            yield b.filter(pa.array(~failed & (score < reject_at)))

    return docs.mapInArrow(batches, docs.schema)


def op6_quality_rules(spark, sf_dir: str) -> DataFrame:
    """judge() of all documents by trees learnt from labels; nulls, repeats and empty tables as there."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return judge(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
