"""Anchors, segments, dynamic-programming alignment, manifests."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagelith.functions import text as T
from pagelith.operators.grouped import grouped

ALIGNED, FALLBACK = 0.9, 0.98


def anchors(blocks: DataFrame) -> DataFrame:
    """doc_id, block_id, ord, label of sections and captions."""
    return blocks.withColumn("label", T.anchor_label(F.col("type"), F.col("text"))).where("label IS NOT NULL").select("doc_id", "block_id", "ord", "label")


def match_anchors(source: DataFrame, target: DataFrame) -> DataFrame:
    """The k-th source anchor of a label pairs with the k-th target anchor; the rest have one side null."""
    w = Window.partitionBy("doc_id", "label").orderBy("ord")
    one = lambda df, s: df.withColumn("k", F.row_number().over(w)).select("doc_id", "label", "k", F.col("block_id").alias(f"{s}_id"), F.col("ord").alias(f"{s}_ord"))
    return one(source, "source").join(one(target, "target"), ["doc_id", "label", "k"], "full_outer")


def override_anchors(pairs: DataFrame, overrides: DataFrame) -> DataFrame:
    """Manual pairs (doc_id, label, source_id, target_id, seq): the last per label wins; no target deletes."""
    w = Window.partitionBy("doc_id", "label").orderBy(F.col("seq").desc())
    last = overrides.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r", "seq")
    kept = pairs.join(last.select("doc_id", "label"), ["doc_id", "label"], "left_anti").select("doc_id", "label", "source_id", "target_id", F.lit("auto").alias("source"))
    manual = last.where("target_id IS NOT NULL").select("doc_id", "label", "source_id", "target_id", F.lit("manual").alias("source"))
    return kept.unionByName(manual)


def segments(blocks: DataFrame, pairs: DataFrame, side: str) -> DataFrame:
    """Segment of each block: how many paired anchors of its side come before it; anchors have a null segment."""
    at = pairs.select("doc_id", F.col(f"{side}_id").alias("block_id"), F.lit(1).alias("anchor"))
    b = blocks.join(at, ["doc_id", "block_id"], "left")
    w = Window.partitionBy("doc_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    n = F.sum(F.coalesce("anchor", F.lit(0))).over(w)
    return b.withColumn("segment", F.when(F.col("anchor").isNull(), n)).drop("anchor")


MOVES = (("1:1", 1, 1), ("2:1", 2, 1), ("1:2", 1, 2), ("1:0", 1, 0), ("0:1", 0, 1))


def align(scores: np.ndarray, penalty: float) -> list[tuple[str, int, int, float]]:
    """Moves (name, first row, first column, confidence) of the greatest total score.

    A merge scores both cells less the penalty and 1e-6; a skip costs the penalty. Of
    equal totals (within 1e-9) the one reached first, row by row, stays.
    """
    n, m = scores.shape
    best = np.full((n + 1, m + 1), -1e9)
    back: dict[tuple[int, int], tuple[int, int, str]] = {}
    best[0, 0] = 0
    for i in range(n + 1):
        for j in range(m + 1):
            for name, di, dj in MOVES:
                if i + di > n or j + dj > m:
                    continue
                gain = float(scores[i : i + di, j : j + dj].sum()) if di and dj else -penalty
                gain -= penalty + 1e-6 if di + dj == 3 else 0
                if best[i, j] + gain > best[i + di, j + dj] + 1e-9:
                    best[i + di, j + dj] = best[i, j] + gain
                    back[i + di, j + dj] = (i, j, name)
    out, at = [], (n, m)
    while at != (0, 0):
        i, j, name = back[at]
        cells = scores[i : at[0], j : at[1]]
        out.append((name, i, j, float(cells.mean()) if cells.size else 0.0))
        at = (i, j)
    return out[::-1]


ALIGNED_SCHEMA = "doc_id long, segment long, move string, i long, j long, confidence double"


def align_segments(scores: DataFrame, penalty: float = 0.8) -> DataFrame:
    """scores(doc_id, segment, i, j, score): the best alignment of each segment; scores are clipped to 0..1."""

    def solve(rows: list[dict]) -> list[tuple]:
        table = np.zeros((max(r["i"] for r in rows) + 1, max(r["j"] for r in rows) + 1))
        for r in rows:
            table[r["i"], r["j"]] = min(1.0, max(0.0, r["score"] or 0.0))
        return [(rows[0]["doc_id"], rows[0]["segment"], *move) for move in align(table, penalty)]

    return grouped(scores, ["doc_id", "segment"], ["i", "j"], solve, ALIGNED_SCHEMA)


def score_texts(sources: DataFrame, targets: DataFrame, score: Callable) -> DataFrame:
    """All pairs inside a segment with a score column: (doc_id, segment, i, j, score)."""
    s = sources.select("doc_id", "segment", F.col("pos").alias("i"), F.col("text").alias("a"))
    t = targets.select("doc_id", "segment", F.col("pos").alias("j"), F.col("text").alias("b"))
    return s.join(t, ["doc_id", "segment"]).select("doc_id", "segment", "i", "j", score(F.col("a"), F.col("b")).alias("score"))


def relation(n_source, n_target):
    return F.when((n_source == 1) & (n_target == 1), "1:1").when((n_source == 1) & (n_target > 1), "1:n").when((n_source > 1) & (n_target == 1), "n:1").otherwise("n:m")


def status(confidence):
    return F.when(confidence >= ALIGNED, "aligned").when(confidence > 0, "low-confidence").otherwise("unmatched")


def target_geometry(units: DataFrame) -> DataFrame:
    """units(doc_id, unit_id, source_conf, source_ready, target_ready, target_conf) -> confidence and status.

    Unmatched if either side has no rectangle; else the lesser confidence, an unset
    (0) source counting as 1.
    """
    source = F.when(F.col("source_conf") == 0, 1.0).otherwise(F.col("source_conf"))
    confidence = F.when(F.col("source_ready") & F.col("target_ready"), F.least(source, F.col("target_conf"))).otherwise(0.0)
    return units.withColumn("confidence", confidence).withColumn("status", status(F.col("confidence")))


def collapse_fallbacks(units: DataFrame, fallbacks: DataFrame) -> DataFrame:
    """Children of a parent of which one is below 0.9 give way to the parent's fallback of 0.98 or more."""
    w = Window.partitionBy("doc_id", "parent_id")
    u = units.withColumn("least", F.min("confidence").over(w))
    good = fallbacks.where(F.col("confidence") >= FALLBACK).select("doc_id", "parent_id", F.col("confidence").alias("fallback"))
    u = u.join(good, ["doc_id", "parent_id"], "left")
    gone = (F.col("least") < ALIGNED) & F.col("fallback").isNotNull()
    kept = u.where(~F.coalesce(gone, F.lit(False))).select("doc_id", "parent_id", "unit_id", "confidence", F.lit("group").alias("relation"))
    new = u.where(gone).groupBy("doc_id", "parent_id").agg(F.max("fallback").alias("confidence"))
    return kept.unionByName(new.select("doc_id", "parent_id", F.col("parent_id").alias("unit_id"), "confidence", F.lit("paragraph-fallback").alias("relation")))


def coverage(units: DataFrame) -> DataFrame:
    """Counts by status and the covered part of each document's units."""
    n = lambda s: F.count_if(F.col("status") == s)
    return units.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("total"), n("aligned").alias("aligned"), n("low-confidence").alias("low_confidence"), n("unmatched").alias("unmatched"),
        ((n("aligned") + n("low-confidence")) / F.count(F.lit(1))).alias("coverage"),
    )


def valid_spans(spans: DataFrame) -> DataFrame:
    """spans(doc_id, a, b, source, target): distinct spans that stand in both texts, once normalised."""
    norm = T.normalise_spaces
    s = spans.withColumn("na", norm(F.col("a"))).withColumn("nb", norm(F.col("b"))).where("na <> '' AND nb <> ''")
    ok = F.contains(norm(F.col("source")), F.col("na")) & F.contains(norm(F.col("target")), F.col("nb"))
    return s.where(ok).select("doc_id", "na", "nb").distinct()


def continuous(mappings: DataFrame) -> DataFrame:
    """mappings(doc_id, block_id, group, pos, sentence, n_sentences): are sentences 0.. each mapped once, in order?"""
    order = Window.partitionBy("doc_id", "block_id").orderBy("group", "pos")
    m = mappings.withColumn("ok", F.col("sentence") == F.row_number().over(order) - 1)
    return m.groupBy("doc_id", "block_id").agg((F.every("ok") & (F.count(F.lit(1)) == F.max("n_sentences"))).alias("continuous"))
