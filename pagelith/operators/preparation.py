"""Passes over a document's units and regions before translation: roles, furniture, formulas, lanes, and the target's flow.

units(doc_id, unit_id, kind, ord, page, x, y, w, h, text): pages count from 0; a unit without a
place has null page and rectangle. regions(doc_id, region_id, kind, page, x, y, w, h).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagelith.functions.prose import EDGE_L, EDGE_R
from pagelith.functions.text import strip
from pagelith.operators.rewrites import bind, lines, n_words

# Fixed values.
AFFILIATION = rf"(?i){EDGE_L}(?:university|institute|institution|laborator(?:y|ies)|department|school|college|academy|faculty|cent(?:er|re)|email|e-mail){EDGE_R}|@"
FULL_NAME = rf"{EDGE_L}[A-Z][A-Za-z'’-]+(?:\s+[A-Z][A-Za-z'’-]+)+{EDGE_R}"
NAME_LIST = rf"(?i),|{EDGE_L}and{EDGE_R}|&"
FUNCTION_WORD = rf"(?i){EDGE_L}(?:the|a|an|and|or|of|to|in|for|with|that|this|is|are|was|were|as|by|from|on|at{{}}){EDGE_R}"
FORMULA_SIGN = "[=+*/∑∫√≤≥≈≠⌈⌉⎧⎨⎩λ𝑎-𝑧𝛼-𝜔α-ωΑ-Ω0-9-]"
STRUCTURAL = ("title", "heading", "caption", "table-title")
HEADS = ("abstract", "keywords", "heading")


def _over(kind: Column, value: Column) -> Column:
    """The least value of a document's first-page units for which kind holds."""
    return F.min(F.when(kind & (F.col("page") == 0), value)).over(Window.partitionBy("doc_id"))


def document_title(units: DataFrame) -> DataFrame:
    """Of the titles the topmost on the first page stays; the others are headings."""
    place = F.struct("y", "ord", "unit_id")
    first = _over(F.col("kind") == "title", place)
    own = (F.col("page") == 0) & (place == F.col("first"))
    return units.withColumn("first", first).withColumn("kind", F.when((F.col("kind") == "title") & ~F.coalesce(own, F.lit(False)), "heading").otherwise(F.col("kind"))).drop("first")


def scoped_authors(units: DataFrame) -> DataFrame:
    """Authors and affiliations stand on the first page above its first heading; others are paragraphs."""
    top = F.coalesce(_over(F.col("kind") == "heading", F.col("y")), F.lit(float("inf")))
    scoped = F.coalesce((F.col("page") == 0) & (F.col("y") < F.col("top")), F.lit(False))
    named = F.col("kind").isin("author", "affiliation")
    return units.withColumn("top", top).withColumn("kind", F.when(named & ~scoped, "paragraph").otherwise(F.col("kind"))).drop("top")


def front_matter(units: DataFrame, page_width: float, page_height: float) -> DataFrame:
    """Short centred paragraphs between title and body of the first page become affiliations or authors."""
    body = F.coalesce(_over(F.col("kind").isin(*HEADS), F.col("y")), F.lit(page_height * 0.38))
    title_end = _over(F.col("kind") == "title", F.struct("ord", (F.col("y") + F.col("h")).alias("bottom")))["bottom"]
    text = strip(F.regexp_replace("text", r"\s+", " "))
    names = F.size(F.regexp_extract_all(text, F.lit(FULL_NAME), F.lit(0)))
    here = (
        (F.col("kind") == "paragraph") & (F.col("page") == 0) & (F.col("y") < F.col("body")) & (F.col("y") <= page_height * 0.34)
        & F.coalesce(F.col("y") >= F.col("title_end") - 2, F.lit(True)) & (F.abs(F.col("x") + F.col("w") / 2 - page_width / 2) <= page_width * 0.14) & F.length(text).between(1, 320)
    )
    role = F.when(text.rlike(AFFILIATION), "affiliation").when((names >= 2) | ((names >= 1) & text.rlike(NAME_LIST)), "author").otherwise(F.col("kind"))
    return units.withColumn("body", body).withColumn("title_end", title_end).withColumn("kind", F.when(F.coalesce(here, F.lit(False)), role).otherwise(F.col("kind"))).drop("body", "title_end")


def without_variable_lines(text: Column) -> Column:
    """One to four single letters on a line of their own go, where another line is prose."""
    prose = lambda l: (n_words(l) >= 3) & l.rlike(FUNCTION_WORD.format("|each"))
    left = lambda ls: strip(F.array_join(F.filter(ls, lambda l: ~l.rlike(r"^\s*[A-Za-z](?:\s+[A-Za-z]){0,3}\s*$")), "\n"))
    return bind(lines(text), lambda ls: F.when((F.size(ls) > 1) & F.exists(ls, prose), left(ls)).otherwise(text))


def without_repeated_lines(units: DataFrame, repeated: DataFrame, normal, page_height: float) -> DataFrame:
    """Lines that repeated(doc_id, line) holds in the form normal(line) go; a lone line only in a margin after the first page."""
    known = repeated.groupBy("doc_id").agg(F.collect_set("line").alias("known"))
    has = lambda l: F.array_contains(F.coalesce("known", F.array().cast("array<string>")), normal(l))
    margin = (F.col("page") > 0) & ((F.col("y") < page_height * 0.12) | (F.col("y") + F.col("h") > page_height * 0.92))
    alone = lambda ls: F.when(margin & has(F.get(ls, F.lit(0))), "").otherwise(F.col("text"))
    many = lambda ls: strip(F.array_join(F.filter(ls, lambda l: ~has(l)), "\n"))
    kept = bind(lines(F.col("text")), lambda ls: F.when(F.size(ls) == 1, alone(ls)).otherwise(many(ls)))
    blank = F.isnull("known") | (strip("text") == "")
    return units.join(known, "doc_id", "left").withColumn("text", F.when(blank, F.col("text")).otherwise(kept)).drop("known")


# --- formulas ------------------------------------------------------------------------------------------


def _span(a: str, b: str, at: str, size: str) -> Column:
    """Overlap of two rectangles along an axis, not below 0."""
    end = lambda s: F.col(f"{s}.{at}") + F.col(f"{s}.{size}")
    return F.greatest(F.lit(0.0), F.least(end(a), end(b)) - F.greatest(F.col(f"{a}.{at}"), F.col(f"{b}.{at}")))


def _gap(a: str, b: str) -> Column:
    """Vertical distance of two rectangles, 0 if they meet."""
    return F.greatest(F.lit(0.0), F.col(f"{a}.y") - F.col(f"{b}.y") - F.col(f"{b}.h"), F.col(f"{b}.y") - F.col(f"{a}.y") - F.col(f"{a}.h"))


def _share(a: str, b: str) -> Column:
    """Of a's area, how much b covers."""
    return _span(a, b, "x", "w") * _span(a, b, "y", "h") / F.greatest(F.lit(1.0), F.col(f"{a}.w") * F.col(f"{a}.h"))


def _beside(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows a of left beside rows b of right on the same page."""
    return left.alias("a").join(right.alias("b"), (F.col("a.doc_id") == F.col("b.doc_id")) & (F.col("a.page") == F.col("b.page")))


def near_formulas(units: DataFrame, regions: DataFrame) -> DataFrame:
    """doc_id, unit_id of units within 48 above or below a formula that they overlap sideways by a tenth."""
    near = (_span("a", "b", "x", "w") >= 0.1 * F.least("a.w", "b.w")) & (_gap("a", "b") <= 48)
    return _beside(units, regions.where("kind = 'formula'")).where(near).select("a.doc_id", "a.unit_id").distinct()


def formula_fragments(units: DataFrame, regions: DataFrame) -> DataFrame:
    """doc_id, unit_id of nearly wordless or shattered texts with formula signs, a twentieth of which a formula covers."""
    text = strip(F.coalesce("text", F.lit("")))
    filled = F.filter(F.transform(lines(text), lambda l: strip(l)), lambda l: l != "")
    shattered = bind(filled, lambda ls: (F.size(ls) >= 3) & (F.size(F.filter(ls, lambda l: F.length(l) <= 16)) / F.size(ls) >= 0.7)) & ~text.rlike(FUNCTION_WORD.format(""))
    like = units.where(((n_words(text) <= 2) | shattered) & text.rlike(FORMULA_SIGN))
    return _beside(like, regions.where("kind = 'formula'")).where(_share("a", "b") >= 0.05).select("a.doc_id", "a.unit_id").distinct()


def formulas_over_structure(units: DataFrame, regions: DataFrame) -> DataFrame:
    """doc_id, region_id of formulas that cover half of a title, heading or caption."""
    heads = units.where(F.col("kind").isin(*STRUCTURAL))
    return _beside(heads, regions.where("kind = 'formula'")).where(_share("a", "b") >= 0.5).select("b.doc_id", "b.region_id").distinct()


def formulas_over_algorithms(regions: DataFrame) -> DataFrame:
    """doc_id, region_id of formulas that repeat an algorithm's rows.

    A fifth within the algorithm is enough; a formula at most 8 from it counts if another one lies so within.
    """
    pairs = _beside(regions.where("kind = 'formula'"), regions.where("kind = 'algorithm'"))
    pairs = pairs.select(
        "a.doc_id", "a.region_id", F.col("b.region_id").alias("algorithm"), (_share("a", "b") >= 0.2).alias("inside"), (_gap("a", "b") <= 8).alias("near"),
        (_span("a", "b", "x", "w") >= 0.45 * F.least("a.w", "b.w")).alias("aligned"),
    )
    others = F.count_if("inside").over(Window.partitionBy("doc_id", "algorithm")) - F.col("inside").cast("int")
    found = pairs.withColumn("others", others).where(F.col("aligned") & (F.col("inside") | ((F.col("others") > 0) & F.col("near"))))
    return found.select("doc_id", "region_id").distinct()


def formula_prose_like(kind: Column, text: Column) -> Column:
    """A long paragraph of words."""
    return (kind == "paragraph") & bind(strip(F.regexp_replace(text, r"\s+", " ")), lambda t: (F.length(t) >= 45) & (n_words(t) >= 6))


def formula_width(formulas: DataFrame, bands: DataFrame) -> DataFrame:
    """Full-lane formulas grow to the narrowest full-width band(doc_id, page, x, y, w, h) whose height, 24 more either way, holds their centre."""
    centre = F.col("a.y") + F.col("a.h") / 2
    holds = (centre >= F.col("b.y") - 24) & (centre <= F.col("b.y") + F.col("b.h") + 24)
    best = _beside(formulas, bands).where(holds).groupBy("a.doc_id", "a.region_id").agg(F.min(F.struct("b.w", "b.x")).alias("band"))
    left = F.least("x", F.coalesce("band.x", "x"))
    right = F.greatest(F.col("x") + F.col("w"), F.coalesce(F.col("band.x") + F.col("band.w"), F.col("x") + F.col("w")))
    return formulas.join(best, ["doc_id", "region_id"], "left").withColumn("w", right - left).withColumn("x", left).drop("band")


# --- lanes ---------------------------------------------------------------------------------------------


def source_column(x: Column, w: Column, page_width: float) -> Column:
    """left, right, or span from 55 % of the page's width on and where there is no rectangle."""
    return F.when(w >= page_width * 0.55, "span").when(x + w / 2 < page_width / 2, "left").when(x + w / 2 >= page_width / 2, "right").otherwise("span")


def lane_bounds(units: DataFrame, page_width: float) -> DataFrame:
    """units with `lane` ('left', 'right', 'span') -> left and right bound of each page's lane.

    Narrow scraps across the centre do not count; a lane keeps clear of the gutter and the outer margin.
    """
    middle, gutter, margin = page_width / 2, page_width * 0.012, page_width * 0.07
    scrap = (F.col("lane") != "span") & (F.col("w") < page_width * 0.15) & (F.col("x") < middle) & (F.col("x") + F.col("w") > middle)
    b = units.where(~scrap).groupBy("doc_id", "page", "lane").agg(F.min("x").alias("x"), F.max(F.col("x") + F.col("w")).alias("right"))
    narrow = (F.col("lane") == "span") & (F.col("right") - F.col("x") < page_width * 0.6)
    left = F.when(narrow, page_width * 0.08).when(F.col("lane") == "left", F.greatest("x", F.lit(margin))).when(F.col("lane") == "right", F.greatest("x", F.lit(middle + gutter))).otherwise(F.col("x"))
    right = F.when(narrow, page_width * 0.92).when(F.col("lane") == "left", F.least("right", F.lit(middle - gutter))).when(F.col("lane") == "right", F.least("right", F.lit(page_width - margin))).otherwise(F.col("right"))
    return b.select("doc_id", "page", "lane", left.alias("x"), right.alias("right"))


def table_in_lane(x: Column, w: Column, caption_centre: Column, page_width: float) -> Column:
    """struct(x, w) of a one-lane table cut at the gutter on its caption's side."""
    middle, gutter = page_width / 2, max(6.0, page_width * 0.012)
    cut = F.when((caption_centre < middle) & (x + w > middle - gutter), F.struct(x.alias("x"), (F.lit(middle - gutter) - x).alias("w"))).when(
        (caption_centre >= middle) & (x < middle + gutter), F.struct(F.lit(middle + gutter).alias("x"), (x + w - middle - gutter).alias("w"))
    )
    same = F.struct(x.cast("double").alias("x"), w.cast("double").alias("w"))
    return F.when(w >= page_width * 0.62, same).otherwise(F.coalesce(cut, same))


def caption_clearance(kind: Column, y: Column, h: Column, caption_y: Column, caption_h: Column) -> Column:
    """struct(y, h) with 4 between a table and the caption above it, or a figure and the caption below; null captions change nothing."""
    end, top, low = y + h, caption_y + caption_h + 4, caption_y - 4
    table = (kind == "table") & (y >= top - 5) & (y < top) & (top < end - 12)
    figure = (kind == "figure") & (end <= caption_y + 1) & (end > low) & (low > y + 12)
    same = F.struct(y.cast("double").alias("y"), h.cast("double").alias("h"))
    return F.when(table, F.struct(top.alias("y"), (end - top).alias("h"))).when(figure, F.struct(y.cast("double").alias("y"), (low - y).alias("h"))).otherwise(same)


# --- the target's flow and geometry -------------------------------------------------------------------


def flow(units: DataFrame, gap: int = 12, per_line: int = 72, line_height: int = 24, least: int = 64) -> DataFrame:
    """Units stacked from 16 down, each as high as its text needs: doc_id, unit_id, y, h; one without text shows its kind."""
    shown = F.concat(F.lit("["), F.col("kind"), F.lit("]"))
    text = F.when(strip(F.coalesce("text", F.lit(""))) == "", shown).otherwise(strip("text"))
    h = F.greatest(F.lit(least), F.greatest(F.lit(1), F.ceil(F.length(text) / per_line)) * line_height + 32).cast("long")
    above = Window.partitionBy("doc_id").orderBy(F.col("ord").asc_nulls_last(), F.coalesce("page", F.lit(0)), "unit_id").rowsBetween(Window.unboundedPreceding, -1)
    return units.withColumn("h", h).select("doc_id", "unit_id", (16 + F.coalesce(F.sum(F.col("h") + gap).over(above), F.lit(0))).cast("long").alias("y"), "h")


def layout_errors(placed: DataFrame, counts: DataFrame, bottom: float) -> DataFrame:
    """Blocks of placed(doc_id, page, col, block_id, y, h) beyond the bottom by more than half a unit, and documents whose number differs from counts(doc_id, n)."""
    over = placed.where(F.col("y") + F.col("h") > bottom + 0.5).select("doc_id", "page", "col", "block_id", (F.col("y") + F.col("h") - bottom).alias("overflow"))
    n = placed.groupBy("doc_id").agg(F.count(F.lit(1)).alias("m"))
    off = counts.join(n, "doc_id", "left").withColumn("d", F.coalesce("m", F.lit(0)) - F.col("n")).where("d <> 0")
    return over.unionByName(off.select("doc_id", F.lit(-1).cast(over.schema["page"].dataType).alias("page"), F.lit("span").alias("col"), F.lit("count-mismatch").alias("block_id"), F.col("d").cast("double").alias("overflow")))


def merged_geometry(parts: DataFrame, key: str) -> DataFrame:
    """parts(key, ord, page, x, y, w, h) -> key, page, rects in order."""
    rects = F.sort_array(F.collect_list(F.struct("ord", "x", "y", "w", "h")))
    return parts.groupBy(key, "page").agg(F.transform(rects, lambda r: F.struct(r["x"].alias("x"), r["y"].alias("y"), r["w"].alias("w"), r["h"].alias("h"))).alias("rects"))


def slice_geometry(chars: DataFrame, key: str) -> DataFrame:
    """chars(key, item, ord, page, x, y, w, h) -> the rectangle of each item once, by page."""
    one = chars.groupBy(key, "item").agg(F.min(F.struct("ord", "page", "x", "y", "w", "h")).alias("c")).select(key, "c.*")
    return merged_geometry(one, key)


def with_source(found: Column, confidence: Column, reason: Column) -> Column:
    """struct(confidence, status, reason) of a unit whose source geometry was found or not."""
    status = F.when(~found, "unmatched").when(confidence >= 0.9, "aligned").otherwise("low-confidence")
    return F.struct(
        F.when(found, confidence).otherwise(0.0).alias("confidence"), status.alias("status"), F.when(found, reason).otherwise(F.coalesce(reason, F.lit("source-geometry-missing"))).alias("reason")
    )


def permitted(changes: DataFrame, issues: DataFrame) -> DataFrame:
    """Of changes(page, region_id, field) those that an error of issues(page, region_id, severity, fields) allows; one without a region allows all of its page."""
    allow = issues.where("severity = 'error'").select("page", F.col("region_id").alias("issue_region"), F.explode("fields").alias("field"))
    c = changes.alias("c").join(allow.alias("i"), (F.col("c.page") == F.col("i.page")) & (F.col("c.field") == F.col("i.field")) & (F.col("issue_region").isNull() | (F.col("issue_region") == F.col("c.region_id"))), "left_semi")
    return c.select("c.*")
