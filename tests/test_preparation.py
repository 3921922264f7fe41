"""Literal cases of the passes before translation, crops and checks of targets."""

from __future__ import annotations

import hashlib

import duckdb
import pytest
from engines import same
from pyspark.sql import functions as F

from pagelith.functions import targets as G
from pagelith.operators import crops as C
from pagelith.operators import preparation as Q
from pagelith.operators import sequential
from pagelith.plans import preparation_queries

UNIT = "doc_id int, unit_id string, kind string, ord int, page int, x double, y double, w double, h double, text string"


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def units(spark, *rows):
    return spark.createDataFrame([(1, *r) for r in rows], UNIT)


def kinds(df):
    return {r.unit_id: r.kind for r in df.collect()}


def test_titles_and_authors_by_place(spark):
    u = units(
        spark, ("low", "title", 0, 0, 0.0, 90.0, 10.0, 9.0, ""), ("top", "title", 1, 0, 0.0, 40.0, 10.0, 9.0, ""), ("later", "title", 2, 1, 0.0, 10.0, 10.0, 9.0, ""),
        ("nowhere", "title", 3, None, None, None, None, None, ""), ("head", "heading", 4, 0, 0.0, 200.0, 10.0, 9.0, ""), ("above", "author", 5, 0, 0.0, 60.0, 10.0, 9.0, ""),
        ("below", "author", 6, 0, 0.0, 200.0, 10.0, 9.0, ""), ("other", "affiliation", 7, 2, 0.0, 20.0, 10.0, 9.0, ""),
    )
    got = kinds(Q.document_title(u))
    assert [got[k] for k in ("low", "top", "later", "nowhere")] == ["heading", "title", "heading", "heading"]
    got = kinds(Q.scoped_authors(u))
    assert [got[k] for k in ("above", "below", "other")] == ["author", "paragraph", "paragraph"]
    assert Q.document_title(u.where("false")).count() == Q.scoped_authors(u.where("false")).count() == 0


def test_front_matter(spark):
    place = (0, 206.0, 100.0, 200.0, 12.0)
    u = units(
        spark, ("t", "title", 0, 0, 100.0, 40.0, 412.0, 30.0, "A Title"), ("a", "paragraph", 1, *place, "Ann Lee, Bob Ray"), ("b", "paragraph", 2, *place, "Department of Letters"),
        ("c", "paragraph", 3, *place, "nothing here"), ("side", "paragraph", 4, 0, 10.0, 100.0, 100.0, 12.0, "Ann Lee, Bob Ray"), ("over", "paragraph", 5, 0, 206.0, 50.0, 200.0, 12.0, "Ann Lee, Bob Ray"),
        ("h", "heading", 6, 0, 50.0, 300.0, 200.0, 12.0, "1 Intro"), ("null", "paragraph", 7, *place, None),
    )
    got = kinds(Q.front_matter(u, 612.0, 792.0))
    assert [got[k] for k in ("a", "b", "c", "side", "over", "null")] == ["author", "affiliation", "paragraph", "paragraph", "paragraph", "paragraph"]


@pytest.mark.parametrize(
    ("text", "expected"),
    [("The value of the sum is large\ni\ni j k l\nand more", "The value of the sum is large\nand more"), ("i\nj", "i\nj"), ("The value of the sum", "The value of the sum")],
)
def test_variable_lines(spark, text, expected):
    assert one(spark, Q.without_variable_lines(F.lit(text))) == expected


def test_label_clusters(spark):
    chart = "Some prose stands here.\n1\n2 x\n3\nspeedup\ny 4\nzz\nw 5"
    assert one(spark, C.without_label_cluster(F.lit(chart))) == "Some prose stands here."
    assert one(spark, C.without_label_cluster(F.lit("Prose it is.\nPOLY unit\nMSM\nઁ x\nrest"))) == "Prose it is."
    assert one(spark, C.without_label_cluster(F.lit("Prose it is.\nand goes on"))) == "Prose it is.\nand goes on"


def test_formulas_on_algorithms(spark):
    r = "doc_id int, region_id string, kind string, page int, x double, y double, w double, h double"
    rows = [("alg", "algorithm", 100.0, 100.0, 200.0, 100.0), ("in", "formula", 110.0, 120.0, 100.0, 10.0), ("next", "formula", 110.0, 205.0, 100.0, 10.0), ("far", "formula", 110.0, 240.0, 100.0, 10.0)]
    df = spark.createDataFrame([(1, i, k, 0, *box) for i, k, *box in rows], r)
    assert {x.region_id for x in Q.formulas_over_algorithms(df).collect()} == {"in", "next"}
    assert {x.region_id for x in Q.formulas_over_algorithms(df.where("region_id <> 'in'")).collect()} == set()


def test_lane_and_clearance(spark):
    box = lambda c: tuple(one(spark, c))
    lit = lambda *v: (F.lit(x) for x in v)
    assert box(Q.table_in_lane(*lit(50.0, 300.0, 100.0), 612.0)) == (50.0, pytest.approx(306 - 612 * 0.012 - 50))
    assert box(Q.table_in_lane(*lit(280.0, 300.0, 500.0), 612.0))[0] == pytest.approx(306 + 612 * 0.012)
    assert box(Q.table_in_lane(*lit(50.0, 500.0, 100.0), 612.0)) == (50.0, 500.0)
    assert box(Q.caption_clearance(*lit("table", 100.0, 80.0, 88.0, 12.0))) == (104.0, 76.0)
    assert box(Q.caption_clearance(*lit("figure", 100.0, 80.0, 180.0, 12.0))) == (100.0, 76.0)
    assert box(Q.caption_clearance(F.lit("table"), *lit(100.0, 80.0), F.lit(None).cast("double"), F.lit(None).cast("double"))) == (100.0, 80.0)


@pytest.mark.parametrize(
    ("answer", "expected"),
    [
        ('{"latex": "$x_1 = y$", "confidence": 0.5}', ("x_1 = y", 0.5)), ('```json\n{"latex": "a+b", "confidence": "85"}\n```', ("a+b", 0.85)), ('{"latex": "ab", "confidence": 1}', None),
        ('{"latex": "\\\\input{x} y", "confidence": 1}', None), ('{"latex": "a+b", "confidence": 101}', None), ("no json", None), ('{"confidence": 1}', None),
    ],
)
def test_formula_answers(spark, answer, expected):
    got = one(spark, C.formula_answer(F.lit(answer)))
    assert (got and tuple(got)) == expected


def test_target_checks(spark):
    source = "We use a pytorchlib [3, 4] for the model of it."
    left = one(spark, G.untranslated_words(F.lit("paragraph"), F.lit(source), F.lit("正文 standards pytorchlib（internal things） a.b@example.com standards")))
    assert left == ["standards"]
    assert one(spark, G.untranslated_words(F.lit("author"), F.lit(source), F.lit("standards"))) == []
    assert one(spark, G.heading_number_first(F.lit("heading"), F.lit("2.1 Costs"), F.lit("成本 2.1 分析"))) == "2.1 成本 分析"
    assert one(spark, G.heading_number_first(F.lit("heading"), F.lit("2.1 Costs"), F.lit("2.1 成本"))) == "2.1 成本"
    assert one(spark, G.heading_number_first(F.lit("heading"), F.lit("2.1 Costs"), F.lit("成本 12.1"))) == "成本 12.1"
    assert one(spark, G.normal_target(F.lit("Ａ ﬁ　x\ty"))) == "Afixy" and one(spark, G.normal_target(F.lit("a b"))) == "ab"
    assert [tuple(t) for t in one(spark, G.terms(F.lit("以及模型（Big Model, BM）、模型（Big Model）和轨迹（Trace）")))] == [("模型", "Big Model", "BM"), ("轨迹", "Trace", None)]
    assert one(spark, G.exponent_count(F.lit("an area of 5 mm 2."), F.lit("5 mm²"), F.lit("2"), F.lit(0))) == 1
    assert one(spark, G.hash_matches(F.lit("x").cast("binary"), F.lit(hashlib.sha256(b"x").hexdigest())))


def test_stand_ins_keep_numbers_and_labels(spark):
    made = lambda k, t: one(spark, C.stand_in_translation(F.lit(k), F.lit(t)))
    assert made("section", "2.1 Costs of it") == "2.1 节"
    assert made("caption", "Figure 3: of 7") == "图 3：模拟说明（保留数字：7）"
    assert made("paragraph", "Of 5 and 5 and 6") == "结构保真的模拟译文。（保留数字：5、6）"


def test_units_are_cut_at_blank_lines_and_closers():
    text = "a" * 60 + ".\n\n" + "b" * 30 + " " + "c" * 40
    assert sequential.split_oversized(text, 100) == ["a" * 60 + ".", "b" * 30 + " " + "c" * 40]
    assert sequential.split_oversized("a" * 60 + ".') " + "b" * 60, 100) == ["a" * 60 + ".')", "b" * 60]
    assert sequential.split_oversized("a" * 99 + ". " + "b" * 9, 100) == ["a" * 99 + ".", "b" * 9]
    assert sequential.split_oversized("a\nb" * 40, 100) == [("a\nb" * 40)[:100].strip(), ("a\nb" * 40)[100:].strip()]


def test_headings_may_end_with_a_line_break(spark, tmp_path):
    """The 30 characters of a segment may end at a line break, with or without blanks around it, in each kind of source."""
    ends = ["\n", " \n", "\n ", "\n\n", " ", "\u00a0", "\u3000\n", "\r\n", "x"]
    texts = [*(f"{'word ' * 5}{'w' * (5 - len(e))}{e}and what follows" for e in ends), "\n \u00a0\nabc", "\n" * 40, "", None]
    c = duckdb.connect()
    c.sql("create table conversations (conv_id bigint, turn integer, text varchar)")
    c.executemany("insert into conversations values (?, ?, ?)", [(i, turn, t) for i, t in enumerate(texts * 4) for turn in range(6)])
    c.sql(f"copy conversations to '{tmp_path}/conversations.parquet' (format parquet)")
    same(preparation_queries.heading_numbers_first(spark, str(tmp_path)), preparation_queries.ORACLES["heading_numbers_first"], c)
