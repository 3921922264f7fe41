"""Ends of tables and formulas against the text around them.

regions(doc_id, region_id, kind, page, x, y, w, h); blocks(doc_id, block_id, kind, page, x, y, w, h, text), the
rectangle being that of the block's text on the page. Regions and blocks meet on a page only; a region without
neighbours, or with null bounds, comes back as it is. Null texts are empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelith.functions.prose import count, is_table_note, word_count
from pagelith.functions.text import strip
from pagelith.operators.preparation import FUNCTION_WORD, _beside, _share, _span, formula_prose_like

# Fixed value.
MATH_INK = r"[=+*/∑∏∫√≤≥≈≠<>×÷\d]|(?:^|\s)-(?:\s|$)"


def _in_lane() -> Column:
    """Region a and block b overlap sideways by a quarter of the narrower one."""
    return _span("a", "b", "x", "w") >= 0.25 * F.least("a.w", "b.w")


def _with(regions: DataFrame, found: DataFrame, height: Column) -> DataFrame:
    """regions with the height that follows from found(doc_id, region_id, ...), where it is not null."""
    extra = [c for c in found.columns if c not in ("doc_id", "region_id")]
    return regions.join(found, ["doc_id", "region_id"], "left").withColumn("h", F.coalesce(height, F.col("h"))).drop(*extra).select(*regions.columns)


def is_prose_line(line: Column) -> Column:
    return (word_count(line, 3) >= 8) & (count(line, FUNCTION_WORD.format("|while")) >= 2)


def tables_before_prose(regions: DataFrame, blocks: DataFrame, line_tops: DataFrame) -> DataFrame:
    """A table ends 2 above the first line of prose in it, if that leaves 12 and 45 % of its height.

    line_tops(doc_id, block_id, line_no, top): where a block's lines begin on its page, from 0. A first prose
    line without one counts only in a block of one line. Notes of tables are no prose, nor is what begins in the
    table's first 24 (or 35 %) or its last 2.
    """
    ls = F.split("text", r"\r?\n")
    at = F.array_position(F.transform(ls, is_prose_line), True)
    prose = (
        blocks.where((F.col("kind") == "paragraph") & ~is_table_note(F.col("text")))
        .select("doc_id", "block_id", "page", "x", "w", "y", F.size(ls).alias("n"), (at - 1).cast("int").alias("line_no")).where("line_no >= 0")
        .join(line_tops.select("doc_id", "block_id", "line_no", "top"), ["doc_id", "block_id", "line_no"], "left")
        .withColumn("top", F.coalesce("top", F.when(F.col("n") == 1, F.col("y"))))
    )
    within = (F.col("b.top") > F.col("a.y") + F.least(F.lit(24.0), F.col("a.h") * 0.35)) & (F.col("b.top") < F.col("a.y") + F.col("a.h") - 2)
    found = _beside(regions.where("kind = 'table'"), prose).where(_in_lane() & within).groupBy("a.doc_id", "a.region_id").agg(F.min("b.top").alias("cut"))
    left = F.col("cut") - F.col("y") - 2
    return _with(regions, found, F.when((left >= 12) & (left >= F.col("h") * 0.45), left))


def tables_through_tail(regions: DataFrame, blocks: DataFrame) -> DataFrame:
    """A table grows to 2 below the notes that touch it and below a line that crosses its end.

    Notes begin at most 4 below the table's end; a crossing line begins in its last 18 and ends at most 12 below it.
    """
    end, low = F.col("a.y") + F.col("a.h"), F.col("b.y") + F.col("b.h")
    note = is_table_note(strip(F.coalesce("b.text", F.lit("")))) & (F.col("b.y") <= end + 4) & (low > F.col("a.y") + 12)
    crossing = (F.col("b.y") < end) & (F.col("b.y") >= end - 18) & (low > end) & (low <= end + 12)
    found = _beside(regions.where("kind = 'table'"), blocks).where(_in_lane() & (note | crossing)).groupBy("a.doc_id", "a.region_id").agg(F.max(low + 2).alias("tail"))
    return _with(regions, found, F.greatest(F.col("h"), F.col("tail") - F.col("y")))


def formulas_of_prose(regions: DataFrame, glyphs: DataFrame, blocks: DataFrame) -> DataFrame:
    """doc_id, region_id of regions over text that reads as prose without mathematics.

    glyphs(doc_id, page, ord, place, ch, x, y, w, h): characters in the order of ord and place, those with their
    centre in the region count. No characters prove nothing, and a region that covers half of an equation block stays.
    """
    equations = _beside(blocks.where("kind = 'equation'"), regions).where(_share("a", "b") >= 0.5).select("a.doc_id", "b.region_id").distinct()
    cx, cy = F.col("b.x") + F.col("b.w") / 2, F.col("b.y") + F.col("b.h") / 2
    inside = cx.between(F.col("a.x"), F.col("a.x") + F.col("a.w")) & cy.between(F.col("a.y"), F.col("a.y") + F.col("a.h"))
    chars = F.sort_array(F.collect_list(F.struct("b.ord", "b.place", "b.ch")))
    under = _beside(regions, glyphs).where(inside).groupBy("a.doc_id", "a.region_id").agg(F.array_join(F.transform(chars, lambda c: c["ch"]), "").alias("t"))
    t = F.col("t")
    prose = (word_count(t, 3) >= 3) & (count(t, FUNCTION_WORD.format("|shown")) >= 1) & ~t.rlike(MATH_INK)
    return under.withColumn("t", strip(F.regexp_replace("t", r"\s+", " "))).where(prose).select("doc_id", "region_id").join(equations, ["doc_id", "region_id"], "left_anti")


def formulas_between_prose(regions: DataFrame, blocks: DataFrame, padding: Column) -> DataFrame:
    """Formulas with padding above and below, which ends 2 before prose that it would reach; y and h change.

    Prose that ends at most 1 below the formula's top is above it, prose that begins at most 1 above its end
    is below it. Where less than 8 would be left the padding stays whole. Other kinds get no padding.
    """
    f = regions.where("kind = 'formula'").withColumn("pad", padding)
    prose = blocks.where(formula_prose_like(F.col("kind"), F.col("text")))
    low = F.col("b.y") + F.col("b.h")
    near = _beside(f, prose).where(_span("a", "b", "x", "w") > 0).groupBy("a.doc_id", "a.region_id").agg(
        F.max(F.when(low <= F.col("a.y") + 1, low)).alias("above"), F.min(F.when(F.col("b.y") >= F.col("a.y") + F.col("a.h") - 1, F.col("b.y"))).alias("below")
    )
    padded = f.join(near, ["doc_id", "region_id"], "left").withColumn("t", F.col("y") - F.col("pad")).withColumn("e", F.col("y") + F.col("h") + F.col("pad"))
    top, end = F.greatest(F.col("t"), F.col("above") + 2), F.least(F.col("e"), F.col("below") - 2)
    fits = end > top + 8
    put = {"y": F.when(fits, top).otherwise(F.col("t")), "h": F.when(fits, end - top).otherwise(F.col("e") - F.col("t"))}
    return padded.select(*(put.get(c, F.col(f"`{c}`")).alias(c) for c in regions.columns)).unionByName(regions.where("kind IS DISTINCT FROM 'formula'"))
