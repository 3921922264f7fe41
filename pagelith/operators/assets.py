"""Proposed asset regions: exact bounds, captions, crops, duplicates, gates. All joins carry (doc_id, page).

Regions: doc_id, page, id, kind (figure, table, formula, code), x, y, w, h, caption_id.
Captions: doc_id, page, caption_id, kind, identity, x, y, w, h.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagelith.functions import geometry as G
from pagelith.functions import prose
from pagelith.operators import rects
from pagelith.operators.grouped import grouped

KEYS = ["doc_id", "page"]
BOX = ["x", "y", "w", "h"]


def caption_identity(text: Column) -> Column:
    """figure:3, table:iv or algorithm:2, else null."""
    p = r"(?i)(?:^|\n)\s*(fig(?:ure)?|table|algorithm)\s*[.]?\s*(\d+(?:[.-]\d+)*|[IVXLCDM]+)(?![A-Za-z0-9_])"
    kind = F.lower(F.regexp_extract(text, p, 1))
    return F.when(kind != "", F.concat(F.when(kind.startswith("fig"), "figure").otherwise(kind), F.lit(":"), F.lower(F.regexp_extract(text, p, 2))))


def exact_bounds(regions: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """Figures take the box of the bitmap with the best IoU that is about as large and as wide; the rest stay."""
    both = rects.overlap_join(regions.where("kind = 'figure'"), bitmaps, KEYS, ["id"], ["id"])
    small = F.least(F.greatest(F.lit(1), G.area("a_")), F.greatest(F.lit(1), G.area("b_")))
    size = F.greatest(F.lit(1), G.area("b_")) / F.greatest(F.lit(1), G.area("a_"))
    width = F.col("b_w") / F.greatest(F.lit(1), F.col("a_w"))
    fits = (F.col("overlap") / small >= 0.55) & size.between(0.25, 3.5) & width.between(0.7, 1.5)
    w = Window.partitionBy(*KEYS, "a_id").orderBy(F.desc("iou"), "b_id")
    best = both.where(fits).withColumn("iou", G.iou("a_", "b_")).withColumn("r", F.row_number().over(w)).where("r = 1")
    best = best.select(*KEYS, F.col("a_id").alias("id"), *(F.col(f"b_{c}").alias(f"new_{c}") for c in BOX))
    out = regions.join(best, [*KEYS, "id"], "left")
    return out.select(*KEYS, "id", "kind", *(F.coalesce(f"new_{c}", c).alias(c) for c in BOX), F.col("new_x").isNotNull().alias("snapped"))


def link_captions(regions: DataFrame, captions: DataFrame) -> DataFrame:
    """The caption of each region: its printed identity if only one caption has it, else overlap with the proposed
    caption box, else the nearest in the same lane, else the gap on the caption's usual side.

    regions also have label and cx, cy, cw, ch (the proposed caption box, or null). Adds caption_id and tier (0 to 3).
    """
    r = regions.select(*KEYS, "id", F.col("kind").alias("a_kind"), *(F.col(c).alias(f"a_{c}") for c in BOX), caption_identity(F.col("label")).alias("want"), *(F.col(f"c{c}").alias(f"p_{c}") for c in BOX))
    c = captions.select(*KEYS, "caption_id", F.col("kind").alias("c_kind"), "identity", *(F.col(c).alias(f"b_{c}") for c in BOX))
    both = r.join(c, KEYS).where("a_kind = c_kind")
    shared = lambda a: F.greatest(F.lit(0), F.least(F.col("b_x") + F.col("b_w"), F.col(f"{a}_x") + F.col(f"{a}_w")) - F.greatest("b_x", f"{a}_x")) / F.greatest(F.lit(1), F.least("b_w", f"{a}_w"))
    named = F.col("want").isNotNull() & (F.col("want") == F.col("identity"))
    n_named = F.count_if(named).over(Window.partitionBy(*KEYS, "id"))
    dy = F.abs(F.col("b_y") + F.col("b_h") / 2 - F.col("p_y") - F.col("p_h") / 2)
    dx = F.abs(F.col("b_x") + F.col("b_w") / 2 - F.col("p_x") - F.col("p_w") / 2)
    proposed = F.col("p_x").isNotNull()  # greatest() and least() skip nulls
    over = F.when(proposed, G.overlap_area("b_", "p_")).otherwise(0.0)
    near = proposed & (shared("p") >= 0.25) & (dy <= F.greatest(F.lit(144.0), F.col("p_h") * 4, F.col("b_h") * 4))
    gap = F.when(F.col("a_kind") == "figure", F.col("b_y") - F.col("a_y") - F.col("a_h")).otherwise(F.col("a_y") - F.col("b_y") - F.col("b_h"))
    tier = (
        F.when(named & (F.col("n_named") == 1), 0).when(over / F.greatest(F.lit(1), G.area("b_")) >= 0.2, 1).when(near, 2)
        .when(F.col("a_kind").isin("figure", "table", "code") & (shared("a") >= 0.2) & gap.between(-20, 80), 3)
    )
    rank = F.when(F.col("tier") == 1, -over).when(F.col("tier") == 2, F.hypot(dx, dy)).when(F.col("tier") == 3, F.abs(gap)).otherwise(0.0)
    both = both.withColumn("n_named", n_named).withColumn("tier", tier).where("tier IS NOT NULL").withColumn("rank", rank)
    w = Window.partitionBy(*KEYS, "id").orderBy("tier", "rank", "caption_id")
    return both.withColumn("r", F.row_number().over(w)).where("r = 1").select(*KEYS, "id", "caption_id", "tier")


def without_captions(regions: DataFrame, captions: DataFrame) -> DataFrame:
    """Cuts a figure above the captions in its lower half and a table or listing below those in its upper half."""
    both = rects.overlap_join(regions, captions, KEYS, ["id", "kind"], ["caption_id"])
    middle, centre = F.col("a_y") + F.col("a_h") / 2, F.col("b_y") + F.col("b_h") / 2
    cut = both.groupBy(*KEYS, F.col("a_id").alias("id")).agg(
        F.min(F.when(centre >= middle, F.col("b_y"))).alias("below"), F.max(F.when(centre <= middle, F.col("b_y") + F.col("b_h"))).alias("above")
    )
    r = regions.join(cut, [*KEYS, "id"], "left")
    bottom = F.col("y") + F.col("h")
    end = F.when((F.col("kind") == "figure") & F.col("below").isNotNull(), F.greatest(F.col("y"), F.col("below") - 2)).otherwise(bottom)
    top = F.when(F.col("kind").isin("table", "code") & F.col("above").isNotNull(), F.least(bottom, F.col("above") + 2)).otherwise(F.col("y"))
    return r.select(*KEYS, "id", "kind", "x", top.alias("y"), "w", (end - top).alias("h"))


def padded(regions: DataFrame, page_w: float, page_h: float) -> DataFrame:
    """Tables and formulas with their margins, inside the page."""
    table, formula = F.col("kind") == "table", F.col("kind") == "formula"
    side = F.when(table, 4.0).when(formula, 5.0).otherwise(0.0)
    above = F.when(table, 12.0).when(formula, 4.0).otherwise(0.0)
    below = F.when(table, 6.0).when(formula, F.least(F.lit(16.0), F.greatest(F.lit(6.0), F.col("h") * 0.18))).otherwise(0.0)
    free = ~(table | formula)
    l, t = F.when(free, F.col("x")).otherwise(F.greatest(F.lit(0.0), F.col("x") - side)), F.when(free, F.col("y")).otherwise(F.greatest(F.lit(0.0), F.col("y") - above))
    r = F.when(free, F.col("x") + F.col("w")).otherwise(F.least(F.lit(page_w), F.col("x") + F.col("w") + side))
    b = F.when(free, F.col("y") + F.col("h")).otherwise(F.least(F.lit(page_h), F.col("y") + F.col("h") + below))
    return regions.select(*KEYS, "id", "kind", l.alias("x"), t.alias("y"), (r - l).alias("w"), (b - t).alias("h"))


KEPT = "doc_id long, page long, id long, kind string, x double, y double, w double, h double, caption_id string"


def deduplicated(regions: DataFrame) -> DataFrame:
    """First fit in id order: a region of the same kind that is mostly inside a kept one, or shares its caption and
    place, is the same; of the two the captioned, then the larger, stays."""

    def inter(a: dict, b: dict) -> float:
        return max(0.0, min(a["x"] + a["w"], b["x"] + b["w"]) - max(a["x"], b["x"])) * max(0.0, min(a["y"] + a["h"], b["y"] + b["h"]) - max(a["y"], b["y"]))

    def same(a: dict, b: dict) -> bool:
        o, sizes = inter(a, b), (a["w"] * a["h"], b["w"] * b["h"])
        if a["kind"] != b["kind"]:
            return False
        if o / max(1, min(sizes)) >= 0.8:
            return True
        dx = abs(a["x"] + a["w"] / 2 - b["x"] - b["w"] / 2) <= min(a["w"], b["w"]) * 0.2
        dy = abs(a["y"] + a["h"] / 2 - b["y"] - b["h"] / 2) <= min(a["h"], b["h"]) * 0.25
        return bool(a["caption_id"]) and a["caption_id"] == b["caption_id"] and dx and dy and o / max(1, *sizes) >= 0.45

    def run(rows: list[dict]) -> list[tuple]:
        kept: list[dict] = []
        for r in rows:
            i = next((i for i, k in enumerate(kept) if same(k, r)), None)
            if i is None:
                kept.append(r)
            elif (bool(r["caption_id"]), r["w"] * r["h"]) > (bool(kept[i]["caption_id"]), kept[i]["w"] * kept[i]["h"]):
                kept[i] = r
        return [tuple(float(k[n]) if t == "double" else k[n] for n, t in (f.split() for f in KEPT.split(", "))) for k in kept]

    return grouped(regions, KEYS, ["id"], run, KEPT)


def without_nested_formulas(regions: DataFrame) -> DataFrame:
    """Formulas of which 0.75 lies in a figure, table or listing go."""
    inside = rects.overlap_join(regions.where("kind = 'formula'"), regions.where("kind IN ('figure', 'table', 'code')"), KEYS, ["id"], [])
    return regions.join(inside.where("a_part >= 0.75").select(*KEYS, F.col("a_id").alias("id")).distinct(), [*KEYS, "id"], "left_anti")


def thin_formula_rows(regions: DataFrame) -> DataFrame:
    """Formula boxes (0..1000) that look like rows of a page: very wide and thin, or in runs of six alike."""
    f = regions.where("kind = 'formula'")
    c = f.where("w >= 320 AND h <= 40")
    w = Window.partitionBy(*KEYS).orderBy("y", "id")
    step = F.col("y") - F.lag("y").over(w)
    alike = (
        (F.abs(F.col("x") - F.lag("x").over(w)) <= 20) & (F.abs(F.col("w") - F.lag("w").over(w)) <= 30) & (F.abs(F.col("h") - F.lag("h").over(w)) <= 10)
        & (step > 0) & (step <= F.greatest(F.lit(34.0), F.col("h") * 2.2))
    )
    c = c.withColumn("run", F.sum(F.when(F.coalesce(alike, F.lit(False)), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    c = c.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(*KEYS, "run"))).where("n >= 6").select(*KEYS, "id")
    return f.where("w >= 650 AND h <= 24").select(*KEYS, "id").unionByName(c).distinct()


def geometry_gate(regions: DataFrame, captions: DataFrame, page_w: float, page_h: float) -> DataFrame:
    """Issues of each region, in order: edge, coverage, another's caption, its own caption."""
    own = captions.select(*KEYS, "caption_id", *(F.col(c).alias(f"b_{c}") for c in BOX))
    r = regions.select("*", *(F.col(c).alias(f"a_{c}") for c in BOX)).join(own, [*KEYS, "caption_id"], "left")
    foreign = rects.overlap_join(regions, captions, KEYS, ["id", "caption_id"], ["caption_id"]).where(~F.col("a_caption_id").eqNullSafe(F.col("b_caption_id")))
    r = r.join(foreign.select(*KEYS, F.col("a_id").alias("id"), F.lit(True).alias("foreign")).distinct(), [*KEYS, "id"], "left")
    right, bottom, part = F.col("x") + F.col("w"), F.col("y") + F.col("h"), F.col("w") * F.col("h") / (page_w * page_h)
    large = (part > 0.5) | (F.col("h") / page_h > 0.78)
    gap = F.greatest(F.col("b_y") - bottom, F.col("y") - F.col("b_y") - F.col("b_h"), F.lit(0.0))
    inside = (F.col("b_w") > 0) & (F.col("b_h") > 0) & (F.col("b_x") >= 0) & (F.col("b_y") >= 0) & (F.col("b_x") + F.col("b_w") <= page_w) & (F.col("b_y") + F.col("b_h") <= page_h)
    beside = F.least(right, F.col("b_x") + F.col("b_w")) > F.greatest("x", "b_x")
    over = F.when(F.col("b_x").isNotNull(), G.overlap_area("a_", "b_")).otherwise(0.0)
    anchored = F.coalesce((F.col("kind") != "formula") & inside & (over == 0) & (gap <= 48) & beside, F.lit(False))
    issues = F.array_compact(F.array(
        F.when((F.col("x") < 0) | (F.col("y") <= 0) | (right > page_w) | (bottom > page_h), F.lit("page-edge-touch")),
        F.when((F.col("w") <= 0) | (F.col("h") <= 0) | (large & ~anchored) | (part > 0.9) | (F.col("h") / page_h > 0.94), F.lit("page-coverage-excessive")),
        F.when(large & F.coalesce("foreign", F.lit(False)), F.lit("foreign-caption-overlap")), F.when(over > 0, F.lit("caption-overlap")),
    ))
    return r.select(*KEYS, "id", issues.alias("issues"))


def portrait_pages(regions: DataFrame, texts: DataFrame, page_w: float, page_h: float) -> DataFrame:
    """Pages with three portraits or more whose text (doc_id, page, text) tells of three degrees or more."""
    p = regions.where((F.col("kind") == "figure") & prose.is_portrait(F.col("w"), F.col("h"), F.lit(page_w), F.lit(page_h), F.col("caption_id").isNotNull()))
    many = p.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n")).where("n >= 3")
    whole = texts.groupBy(*KEYS).agg(F.array_join(F.sort_array(F.collect_list("text")), "\n").alias("text")).where(prose.degree_phrases(F.col("text")) >= 3)
    return many.join(whole.select(*KEYS), KEYS, "left_semi").select(*KEYS)


def shown_width(w: Column, kind: Column, region_mode: Column, spanning: Column, captioned: Column, row_size: Column, policy: str, paper: float, margin: float | None = None, gutter: float = 12.0) -> Column:
    """Display width: never wider than its place; a captioned column asset grows to a readable share in one column."""
    content = paper - 2 * (margin if margin is not None else max(36.0, paper * 0.1))
    alone = F.when((region_mode == "double") & ~spanning, (content - gutter) / 2).otherwise(content)
    place = F.when(row_size > 1, (F.lit(content) - gutter * (row_size - 1)) / row_size).otherwise(alone)
    grows = (row_size == 1) & ~spanning & captioned & kind.isin("figure", "table", "code") & F.lit(policy == "single-column")
    floor = F.when(kind == "table", content * 0.9).otherwise(content * 0.78)
    return F.when(grows, F.least(F.lit(content), F.greatest(w, floor))).otherwise(F.least(w, place))
