"""Lines to columns, bands, regions, blocks, links and furniture: windows by document or page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagelith.functions.geometry import bounds

TERMINAL = "[.!?。！？:：]$"


def islands(df: DataFrame, keys: list[str], order: list, starts: Column, name: str) -> DataFrame:
    """Numbers runs from 0: a row where `starts` is true (or null) begins a run."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.sum(F.when(F.coalesce(starts, F.lit(True)), 1).otherwise(0)).over(w) - 1)


def previous(column: str, keys: list[str], order: list) -> Column:
    return F.lag(column).over(Window.partitionBy(*keys).orderBy(*order))


def reading_bands(lines: DataFrame) -> DataFrame:
    """Adds band and reading (order) to lines(doc_id, page, lane, x, y, ...); lane full, left or right.

    A band breaks where full-width and lane lines change in visual order. Inside a
    band the right lane follows the left.
    """
    keys, visual = ["doc_id", "page"], ["y", "x", "line_no"]
    full = F.col("lane") == "full"
    lines = lines.withColumn("full_", full)
    lines = islands(lines, keys, visual, F.col("full_") != previous("full_", keys, visual), "band").drop("full_")
    order = Window.partitionBy(*keys).orderBy("band", F.when(F.col("lane") == "right", 1).otherwise(0), *visual)
    return lines.withColumn("reading", F.row_number().over(order) - 1)


def classify_lane(x1: Column, x2: Column, y: Column, text: Column, page_width: Column) -> Column:
    """full, left or right from the span, the centre and front-matter words."""
    span, mid = x2 - x1, (x1 + x2) / 2
    author = text.rlike("(?i)[,，]|university|大学|学院|laboratory|\\blab\\b")
    centred = (y < 180) & (F.abs(mid - page_width / 2) <= page_width * 0.08) & ((span > page_width * 0.28) | author) & (x1 > page_width * 0.18) & (x2 < page_width * 0.82)
    named = F.trim(text).rlike("(?i)^(abstract|摘要|key ?words|关键词)[\\s—\\-:：]") & (span > page_width * 0.45)
    return F.when((span > page_width * 0.5) | centred | named, "full").when(mid > page_width * 0.5, "right").otherwise("left")


def layout_mode(lines: DataFrame) -> DataFrame:
    """single, double or mixed per page: double needs a left and a right line side by side."""
    keys = ["doc_id", "page"]
    left = lines.where("lane = 'left'").select(*keys, F.col("y").alias("ly"), F.col("h").alias("lh"))
    right = lines.where("lane = 'right'").select(*keys, F.col("y").alias("ry"), F.col("h").alias("rh"))
    beside = left.join(right, keys).where("ly < ry + rh AND ry < ly + lh").select(*keys).distinct().withColumn("beside", F.lit(True))
    page = lines.groupBy(*keys).agg(F.bool_or(F.col("lane") == "full").alias("full"))
    mode = F.when(F.col("beside").isNull(), "single").when(F.col("full"), "mixed").otherwise("double")
    return page.join(beside, keys, "left").select(*keys, mode.alias("mode"))


def layout_regions(blocks: DataFrame) -> DataFrame:
    """Runs of (page, mode) in block order with bounding box and unit ids; a single-lane page is full-width."""
    order = ["ord"]
    mode = F.when(F.col("lane").isin("left", "right"), "double").otherwise("full-width")
    b = blocks.withColumn("mode", mode)
    start = (F.col("page") != previous("page", ["doc_id"], order)) | (F.col("mode") != previous("mode", ["doc_id"], order))
    b = islands(b, ["doc_id"], order, start, "region")
    units = F.transform(F.sort_array(F.collect_list(F.struct("ord", "block_id"))), lambda u: u["block_id"])
    return b.groupBy("doc_id", "region", "page", "mode").agg(*bounds(), F.count(F.lit(1)).alias("n_units"), units.alias("unit_ids"))


def group_lines(lines: DataFrame) -> DataFrame:
    """Lines of a lane to blocks: a break where the role changes or the gap exceeds the lane's own measure.

    lines(doc_id, page, lane, line_no, x, y, w, h, role, text). The measure is the
    largest of 1.4 median line distances, 1.5 median heights and 18.
    """
    keys, order = ["doc_id", "page", "lane"], ["y", "line_no"]
    l = lines.withColumn("gap", F.col("y") - previous("y", keys, order)).withColumn("space", F.col("gap") - previous("h", keys, order))
    measure = l.groupBy(*keys).agg(
        F.greatest(F.coalesce(F.median("gap"), F.lit(12.0)) * 1.4, F.median("h") * 1.5, F.lit(18.0)).alias("measure")
    )
    l = l.join(measure, keys)
    start = (F.col("space") > F.col("measure")) | (F.col("role") != previous("role", keys, order))
    l = islands(l, keys, order, start, "block")
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("y", "line_no", "text"))), lambda t: t["text"]), "\n")
    return l.groupBy(*keys, "block", "role").agg(*bounds(), F.count(F.lit(1)).alias("n_lines"), text.alias("text"))


def links(blocks: DataFrame) -> DataFrame:
    """Previous and next block, and the section that owns each block."""
    w = Window.partitionBy("doc_id").orderBy("ord")
    section = F.last(F.when(F.col("type") == "section", F.col("block_id")), ignorenulls=True)
    return blocks.select(
        "doc_id", "block_id", F.lag("block_id").over(w).alias("prev_id"), F.lead("block_id").over(w).alias("next_id"),
        section.over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("section_id"),
    )


def continuation_groups(blocks: DataFrame) -> DataFrame:
    """Joins a paragraph to the one before if that one, on the page before or in the left lane, has no end mark.

    blocks(doc_id, block_id, ord, page, lane, type, text). Chains join as one group.
    """
    order = ["ord"]
    prev = lambda c: previous(c, ["doc_id"], order)
    open_ = (F.col("type") == "paragraph") & (prev("type") == "paragraph") & ~F.trim(prev("text")).rlike(TERMINAL)
    across = (F.col("page") == prev("page") + 1) | ((F.col("page") == prev("page")) & (prev("lane") == "left") & (F.col("lane") == "right"))
    b = islands(blocks, ["doc_id"], order, ~(open_ & across), "piece")
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", "text"))), lambda t: t["text"]), " ")
    return b.groupBy("doc_id", "piece").agg(F.count(F.lit(1)).alias("n_blocks"), F.min_by("block_id", "ord").alias("block_id"), text.alias("text"))


def repeated_furniture(blocks: DataFrame, least: int = 2) -> DataFrame:
    """Last lines of 6 to 180 characters, made alike, that are met at least `least` times in a document."""
    last = F.regexp_replace(F.lower(F.trim(F.element_at(F.split("text", "\n"), -1))), r"\s+", " ")
    keyed = blocks.select("doc_id", "page", last.alias("line")).where(F.length("line").between(6, 180))
    return keyed.groupBy("doc_id", "line").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("page").alias("pages")).where(F.col("n") >= least)


def page_furniture(blocks: DataFrame, top: float, bottom: float, least: int = 2) -> DataFrame:
    """Margin blocks whose text, digits aside, repeats on at least `least` pages."""
    margin = blocks.where((F.col("y") < top) | (F.col("y") + F.col("h") > bottom))
    keyed = margin.withColumn("key", F.regexp_replace(F.lower(F.trim("text")), "[0-9]+", "#"))
    often = keyed.groupBy("doc_id", "key").agg(F.countDistinct("page").alias("pages")).where(F.col("pages") >= least)
    return keyed.join(often, ["doc_id", "key"]).select("doc_id", "block_id", "pages")


def suspicious_sections(blocks: DataFrame) -> DataFrame:
    """Headings that read as prose become paragraphs."""
    t = F.trim("text")
    bad = (F.col("type") == "section") & (t.rlike(r"[.!?;,]$") | (F.size(F.split(t, r"\s+")) > 14) | t.rlike(r"^\d+\s+[a-z]"))
    return blocks.withColumn("type", F.when(bad, "paragraph").otherwise(F.col("type")))


def flow_layout(blocks: DataFrame, gap: float) -> DataFrame:
    """Stacked virtual layout: each block begins where the ones before it end."""
    w = Window.partitionBy("doc_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    return blocks.withColumn("top", F.coalesce(F.sum(F.col("h") + gap).over(w), F.lit(0.0)))
