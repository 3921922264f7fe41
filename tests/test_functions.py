"""Literal cases of the text, hash and geometry functions."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from pagelith.functions import geometry, hashing
from pagelith.functions import text as T


def values(spark, texts, expression):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[0] for r in rows.orderBy("i").select(expression(F.col("t"))).collect()]


@pytest.mark.parametrize(
    ("text", "expected"),
    [("Figure 3. Overview", True), ("Fig. 2: The model", True), ("Figure 11. The sub-task size", False), ("figure it out", False), ("Figure 4 shows", False), ("Figure 4 Shows", True), ("FIGURE IV", True)],
)
def test_figure_caption(spark, text, expected):
    assert values(spark, [text], T.is_figure_caption) == [expected]


def test_table_and_algorithm_captions(spark):
    assert values(spark, ["Table 1: Results", "table 2 is", "Table 9"], T.is_table_caption) == [True, False, True]
    assert values(spark, ["Algorithm 1 pReduce", "Algorithm 2 shows x", "Algorithm 3."], T.is_algorithm_caption) == [True, False, True]


def test_formula(spark):
    assert values(spark, ["E = m * c", "whether it contains P_i + P_t = 3, where", "", "y = a x + b (3)"], T.is_display_formula) == [True, False, False, True]


def test_protected_tokens(spark):
    assert values(spark, ["[1, 2] gave 3.5% and -4 in ⟦X⟧ x2 a-5"], T.protected_tokens) == [["[1, 2]", "3.5%", "-4", "⟦X⟧", "5"]]


def test_labels(spark):
    assert values(spark, ["Fig. 2 x", "图 3", "Table 4", "(5)", "none", None], T.numbered_label) == ["fig2", "fig3", "tab4", "eq5", None, None]
    assert values(spark, ["1.2 Title", "Title"], T.section_number) == ["1.2", None]


def test_sentences(spark):
    assert values(spark, ["See Fig. 1 of 2.5 cm. Then e.g. this! Last"], T.sentences) == [["See Fig. 1 of 2.5 cm.", "Then e.g. this!", "Last"]]


def test_redaction(spark):
    assert values(spark, ["sk-abc1 Authorization: Bearer tok, bearer q"], T.safe_error_message) == ["[redacted] Authorization: [redacted], Bearer [redacted]"]


def test_fnv1a(spark):
    assert values(spark, ["abc", ""], hashing.fnv1a) == ["1a47e90b", "811c9dc5"]


def test_cache_key(spark):
    assert values(spark, ["a b:c/é(1)"], lambda t: hashing.cache_key(F.lit("k"), t)) == ["k:a%20b%3Ac%2F%C3%A9(1)"]


def test_rectangles(spark):
    r = spark.createDataFrame([(0, 0, 10, 10, 5, 5, 10, 10), (0, 0, 1, 1, 5, 5, 1, 1)], "a_x int, a_y int, a_w int, a_h int, b_x int, b_y int, b_w int, b_h int")
    got = [tuple(x) for x in r.select(geometry.overlap_area("a_", "b_"), geometry.overlaps("a_", "b_", 4.0)).collect()]
    assert got == [(25, True), (0, True)]
