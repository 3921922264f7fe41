"""Rectangle joins. Each carries the page as equi key, so it plans as a hash or merge join with a residual test."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagelith.functions import geometry as G


def side(df: DataFrame, prefix: str, keys: list[str], others: list[str]) -> DataFrame:
    """Rectangle columns and others with a prefix; keys stay."""
    return df.select(*keys, *(F.col(c).alias(f"{prefix}{c}") for c in ["x", "y", "w", "h", *others]))


def overlap_join(a: DataFrame, b: DataFrame, keys: list[str], others_a: list[str], others_b: list[str], least: float = 0.0) -> DataFrame:
    """Pairs on the same page whose overlap exceeds `least`, with its area and the part of either."""
    both = side(a, "a_", keys, others_a).join(side(b, "b_", keys, others_b), keys)
    both = both.withColumn("overlap", G.overlap_area("a_", "b_")).where(F.col("overlap") > least)
    return both.withColumn("a_part", F.col("overlap") / F.greatest(F.lit(1), G.area("a_"))).withColumn("b_part", F.col("overlap") / F.greatest(F.lit(1), G.area("b_")))


def best_iou(a: DataFrame, b: DataFrame, keys: list[str], id_a: str, id_b: str) -> DataFrame:
    """For each a, the b with the best intersection over union; ties to the least id."""
    both = overlap_join(a, b, keys, [id_a], [id_b]).withColumn("iou", G.iou("a_", "b_"))
    w = Window.partitionBy(*keys, f"a_{id_a}").orderBy(F.col("iou").desc(), f"b_{id_b}")
    return both.withColumn("rank", F.row_number().over(w)).where("rank = 1").select(*keys, f"a_{id_a}", f"b_{id_b}", "iou")


def nested(a: DataFrame, keys: list[str], id_: str, share: float) -> DataFrame:
    """Rectangles of which `share` or more lies in another, larger one (ties: smaller id stays)."""
    pairs = overlap_join(a, a, keys, [id_], [id_]).where(F.col(f"a_{id_}") != F.col(f"b_{id_}"))
    larger = (G.area("b_") > G.area("a_")) | ((G.area("b_") == G.area("a_")) & (F.col(f"b_{id_}") < F.col(f"a_{id_}")))
    return pairs.where((F.col("a_part") >= share) & larger).select(*keys, F.col(f"a_{id_}").alias(id_)).distinct()


def point_coverage(points: DataFrame, rects: DataFrame, keys: list[str], id_: str) -> DataFrame:
    """Points inside each rectangle, and their part of the page's points."""
    total = points.groupBy(*keys).agg(F.count(F.lit(1)).alias("points"))
    inside = side(rects, "b_", keys, [id_]).join(points, keys).where(G.centre_in(F.col("px"), F.col("py"), "b_"))
    n = inside.groupBy(*keys, f"b_{id_}").agg(F.count(F.lit(1)).alias("inside"))
    return n.join(total, keys).select(*keys, F.col(f"b_{id_}").alias(id_), "inside", (F.col("inside") / F.col("points")).alias("share"))


def nearest(a: DataFrame, b: DataFrame, keys: list[str], id_a: str, id_b: str, distance: Column, most: float) -> DataFrame:
    """For each a the nearest b within `most`; distance is over a_ and b_ columns; ties to the least id."""
    both = side(a, "a_", keys, [id_a]).join(side(b, "b_", keys, [id_b]), keys).withColumn("distance", distance).where(F.col("distance") <= most)
    w = Window.partitionBy(*keys, f"a_{id_a}").orderBy("distance", f"b_{id_b}")
    return both.withColumn("rank", F.row_number().over(w)).where("rank = 1").select(*keys, f"a_{id_a}", f"b_{id_b}", "distance")


def top_pages(scores: DataFrame, most: int = 2) -> DataFrame:
    """Of (doc_id, target_page, source_page, score): the best source pages of each target page."""
    sums = scores.groupBy("doc_id", "target_page", "source_page").agg(F.sum("score").alias("score"))
    w = Window.partitionBy("doc_id", "target_page").orderBy(F.col("score").desc(), "source_page")
    return sums.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def vertical_clusters(rects: DataFrame, keys: list[str], gap: float) -> DataFrame:
    """Runs of rectangles, top down, that begin within `gap` of the lowest bottom so far."""
    w = Window.partitionBy(*keys).orderBy("y", "id").rowsBetween(Window.unboundedPreceding, -1)
    low = F.max(F.col("y") + F.col("h")).over(w)
    flag = F.when(low.isNull() | (F.col("y") - low > gap), 1).otherwise(0)
    r = rects.withColumn("flag", flag)
    run = F.sum("flag").over(Window.partitionBy(*keys).orderBy("y", "id").rowsBetween(Window.unboundedPreceding, 0)) - 1
    return r.withColumn("cluster", run).groupBy(*keys, "cluster").agg(*G.bounds(), F.count(F.lit(1)).alias("n"))
