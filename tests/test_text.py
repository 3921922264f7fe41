"""Literal cases of line repairs, wrapped joins, answers, packages and image rectangles."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from pagelith.functions import hashing
from pagelith.functions import prose as P
from pagelith.operators import page_plans, rewrites, work
from pagelith.sources import runs


def value(spark, f, text):
    return spark.createDataFrame([(text,)], "t string").select(f(F.col("t"))).first()[0]


def test_heading_parts(spark):
    parts = lambda t: [(p.number, p.level, p.text) for p in value(spark, rewrites.heading_parts, t)]
    assert parts("2 Background 2.1 Motivation") == [("2", 1, "Background"), ("2.1", 2, "Motivation")]
    assert parts("IV. Results") == [("IV", 1, "Results")]
    assert parts("C. Costs") == [("C", 2, "Costs")]
    assert parts("Plain words") == [(None, 1, "Plain words")]
    assert parts("1.2.3 Deep  words") == [("1.2.3", 3, "Deep words")] and parts(" ") == []


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("x = 3\nThe value of the sum\nm P . where it holds", "The value of the sum\nwhere it holds"),
        ("The value of it\nco-operate with others", "The value of it\nco-operate with others"),
        ("The value of it\nto the end of it\n(see the text)", "The value of it\nto the end of it\n(see the text)"),
        ("The value is y =\nx + two of them", "The value is y =\nx + two of them"),
        ("The value of it\nx + two of them\n3) three of them", "The value of it\ntwo of them\n3) three of them"),
        ("  a\nb ", "a\nb"),
    ],
)
def test_math_lines(spark, text, expected):
    assert value(spark, rewrites.without_math_lines, text) == expected


def test_math_before_prose_and_tails(spark):
    assert value(spark, rewrites.math_before_prose, "a\nb = 2\nThe cost of the plan is\nlow")
    assert not value(spark, rewrites.math_before_prose, "The cost of the plan\na\nb\nc")
    assert value(spark, rewrites.without_trailing_formula, "Some words here\nx = y\n(3)") == "Some words here"
    assert value(spark, rewrites.without_trailing_formula, "Some words here\n(3)") == "Some words here\n(3)"


def test_subscripts_and_biography(spark):
    assert value(spark, rewrites.join_subscripts, "We set Gain and Loss here\nmax\nmax") == "We set Gain_max and Loss_max here"
    assert value(spark, rewrites.join_subscripts, "We set Gain and Loss here\nmax\nmax\nMAX\nend") == "We set Gain and Loss here\nmax\nmax\nMAX\nend"
    assert value(spark, rewrites.join_subscripts, "one word\nmax") == "one word\nmax"
    assert value(spark, rewrites.biography_start, "text\nAnn B. Lee received the degree") == 5
    assert value(spark, rewrites.biography_start, "nobody here") is None


def test_log_keeps_two_hundred(spark):
    rows = [(1, i, "batch-progress" if i % 10 == 0 else "note", i % 20) for i in range(500)]
    got = work.ai_log(spark.createDataFrame(rows, "project int, seq int, type string, batch int")).collect()
    progress = [r.seq for r in got if r.type == "batch-progress"]
    assert len(got) == 200 and sorted(progress) == [480, 490] and min(r.seq for r in got) == 500 - 1 - 199 - (199 - 2) // 9 + 2


@pytest.mark.parametrize(("left", "right", "expected"), [("effic", "ient use", "effic ient use"), ("in", "put", "input"), ("GP", "U-X now", "GPU-X now"), ("translat", "ion x", "translation x"), ("", "b", "b")])
def test_footnotes(spark, left, right, expected):
    assert spark.range(1).select(P.join_footnote(F.lit(left), F.lit(right))).first()[0] == expected


def test_notice_is_dropped(spark):
    text = "Keep\nPermission to make digital or hard copies\nof this\nhttps://doi.org/1\nAlso keep\n© 2020 Copyright held"
    assert spark.range(1).select(P.without_boilerplate(F.lit(text))).first()[0] == "Keep\nAlso keep"


def test_merged_captions(spark):
    got = spark.range(1).select(P.caption_parts(F.lit("Figure 9: One. Table 2. Two"))).first()[0]
    assert [(p.kind, p.text) for p in got] == [("figure", "Figure 9: One."), ("table", "Table 2. Two")]


@pytest.mark.parametrize(
    ("box", "expected"),
    [([0.1, 0.2, 0.3, 0.4], [100, 200, 300, 400]), ([700, 700, 900, 900], [700, 700, 200, 200]), ([-20, 10, 100, 100], [0, 10, 80, 100]), ([-200, 0, 10, 10], None), ([1, 2, 3], None)],
)
def test_boxes(spark, box, expected):
    got = spark.range(1).select(page_plans.repaired_box(F.array(*(F.lit(float(v)) for v in box)))).first()[0]
    assert got == (None if expected is None else pytest.approx(expected))


def test_confidence(spark):
    words = ["0.8", "85%", "90/100", "very high", "weak", "95", "junk", '{"score":95}']
    got = [r[0] for r in spark.createDataFrame(list(enumerate(words)), "i int, v string").orderBy("i").select(page_plans.confidence(F.col("v"))).collect()]
    assert got == pytest.approx([0.8, 0.85, 0.9, 0.95, 0.5, 0.95, 0.5, 0.95])


def test_event_stream(spark):
    frames = 'data: {"choices":[{"delta":{"content":"a"}}]}\n\ndata: {"choices":[{"delta":{"content":"b"}}]}\n\ndata: [DONE]\n\n'
    got = spark.createDataFrame([(0, frames), (1, frames[:60])], "i int, f string").orderBy("i").select(page_plans.stream_text(F.col("f"))).collect()
    assert [r[0] for r in got] == ["ab", None]


def test_patches_apply_whole_or_not(spark):
    regions = spark.createDataFrame([(1, 0, "a", "figure", 1.0, 1.0, 5.0, 5.0, False, True), (2, 0, "a", "figure", 1.0, 1.0, 5.0, 5.0, True, True)], "doc_id long, page long, id string, type string, x double, y double, w double, h double, locked boolean, may_move boolean")
    moves = spark.createDataFrame([(d, 0, 1, "move", "a", 9.0, 1.0, 5.0, 5.0) for d in (1, 2)], "doc_id long, page long, seq long, op string, id string, x double, y double, w double, h double")
    assert sorted((r.doc_id, r.x, r.applied) for r in page_plans.apply_patches(regions, moves).collect()) == [(1, 9.0, True), (2, 1.0, False)]


def test_package_round_trip(spark):
    p = work.packages({"units": spark.createDataFrame([(1, "a", 2)], "project long, id string, n int")})
    assert work.package_errors(p).count() == 0
    assert work.package_errors(p.withColumn("payload", F.concat("payload", F.lit(" ")))).first()["errors"] == ["checksum"]
    assert spark.range(1).select(hashing.fnv1a_rounded(F.lit("abc"))).first()[0] == "1a47e90c"


def test_image_rectangles(spark):
    ops = [(1, 0, 0, "save", None), (1, 0, 1, "transform", [10.0, 0.0, 0.0, 20.0, 5.0, 6.0]), (1, 0, 2, "paint", None), (1, 0, 3, "restore", None), (1, 0, 4, "paint", None)]
    df = spark.createDataFrame(ops, "doc_id long, page long, seq long, op string, args array<double>")
    got = sorted((r.x, r.y, r.w, r.h) for r in runs.image_regions(df, (1.0, 0.0, 0.0, -1.0, 0.0, 100.0)).collect())
    assert got == [(0.0, 99.0, 1.0, 1.0), (5.0, 74.0, 10.0, 20.0)]
