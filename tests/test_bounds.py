"""Literal cases of the ends of tables and formulas."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagelith.operators import bounds as B
from pagelith.plans import registry

REGION = "doc_id int, region_id string, kind string, page int, x double, y double, w double, h double"
BLOCK = "doc_id int, block_id string, kind string, page int, x double, y double, w double, h double, text string"
PROSE = "The results of the method are shown in the table and agree with earlier reports from others."


def regions(spark, *rows):
    return spark.createDataFrame([(1, *r) for r in rows], REGION)


def blocks(spark, *rows):
    return spark.createDataFrame([(1, *r) for r in rows], BLOCK)


def block(name, y, text, kind="paragraph", x=50.0, w=200.0, h=12.0, page=0):
    return (name, kind, page, x, y, w, h, text)


def heights(df):
    return {r.region_id: (r.y, r.h) for r in df.collect()}


TABLE = ("t", "table", 0, 50.0, 100.0, 200.0, 100.0)
NOWHERE = ("none", "table", None, None, None, None, None)


def test_a_table_ends_before_prose(spark):
    none = spark.createDataFrame([], "doc_id int, block_id string, line_no int, top double")
    t = regions(spark, TABLE, NOWHERE)
    cut = lambda tops, *bs: heights(B.tables_before_prose(t, blocks(spark, *bs), tops))
    assert cut(none, block("a", 160.0, PROSE), block("b", 180.0, PROSE)) == {"t": (100.0, 58.0), "none": (None, None)}
    assert cut(none, block("a", 140.0, PROSE))["t"] == (100.0, 100.0), "less than 45 % would be left"
    assert cut(none, block("a", 160.0, PROSE, x=260.0), block("n", 160.0, "(1) " + PROSE), block("h", 160.0, PROSE, kind="heading"), block("0", 160.0, None))["t"] == (100.0, 100.0)
    two = block("two", 150.0, "3 4 5\n" + PROSE)
    assert cut(none, two)["t"] == (100.0, 100.0), "no line is known"
    assert cut(spark.createDataFrame([(1, "two", 1, 172.0)], none.schema), two)["t"] == (100.0, 70.0)
    assert B.tables_before_prose(t.where("false"), blocks(spark, two), none).count() == 0


def test_a_table_takes_its_notes_and_the_line_across_its_end(spark):
    t = regions(spark, TABLE, ("f", "formula", 0, 50.0, 100.0, 200.0, 100.0))
    grown = lambda *bs: heights(B.tables_through_tail(t, blocks(spark, *bs)))["t"][1]
    assert grown(block("note", 203.0, "* Values are means over all runs that ended well")) == 117.0
    assert grown(block("late", 206.0, "* Values are means over all runs that ended well")) == 100.0
    assert grown(block("line", 195.0, "12 13 14")) == 109.0
    assert grown(block("tall", 195.0, "12 13 14", h=20.0), block("inside", 150.0, "1 2"), block("lane", 195.0, "12", x=300.0), block("null", 300.0, None)) == 100.0
    assert heights(B.tables_through_tail(t, blocks(spark, block("line", 195.0, "1"))))["f"] == (100.0, 100.0)


def test_text_under_a_formula_tells_whether_it_is_one(spark):
    r = regions(spark, *((n, "formula", 0, 50.0, y, 200.0, 20.0) for n, y in (("prose", 100.0), ("maths", 200.0), ("empty", 300.0), ("equation", 400.0))))
    rows = [(c, "a" + str(i), y) for y, text in ((104.0, "the words are here"), (204.0, "the sum is x = here too"), (404.0, "the words are here")) for i, c in enumerate(text)]
    glyphs = spark.createDataFrame([(1, 0, int(y), int(i[1:]), c, 60.0 + 5 * int(i[1:]), y, 5.0, 8.0) for c, i, y in rows], "doc_id int, page int, ord int, place int, ch string, x double, y double, w double, h double")
    b = blocks(spark, block("e", 404.0, "", kind="equation"))
    assert [x.region_id for x in B.formulas_of_prose(r, glyphs, b).collect()] == ["prose"]
    assert B.formulas_of_prose(r, glyphs.where("false"), b).count() == 0


def test_padding_stops_at_prose(spark):
    r = regions(spark, ("f", "formula", 0, 50.0, 100.0, 200.0, 20.0), ("t", "table", 0, 50.0, 100.0, 200.0, 20.0))
    pad = lambda *bs: heights(B.formulas_between_prose(r, blocks(spark, *bs), F.lit(10.0)))
    assert pad(block("above", 84.0, PROSE), block("below", 124.0, PROSE)) == {"f": (98.0, 24.0), "t": (100.0, 20.0)}
    assert pad(block("label", 84.0, "(1)"), block("lane", 84.0, PROSE, x=300.0))["f"] == (90.0, 40.0)


def test_the_queries_change_some_regions(spark, data):
    for name in ("tables_cut_at_prose", "tables_to_their_tail", "formula_padding"):
        assert registry.QUERIES[name](spark, data).select("h").distinct().count() > 3, name  # without a change there are three heights
    assert registry.QUERIES["regions_of_prose"](spark, data).count() > 0
