"""Sequential and stateful operators against plain Python, and streams against their batch twins."""

from __future__ import annotations

import itertools
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pagelith import streaming
from pagelith.operators import alignment, audit, gates, graphs, reader, sequential, work
from pagelith.plans import fixtures, table_queries


def best_total(scores: np.ndarray, penalty: float) -> float:
    n, m = scores.shape

    def go(i: int, j: int) -> float:
        if (i, j) == (n, m):
            return 0.0
        out = -1e9
        for name, di, dj in alignment.MOVES:
            if i + di <= n and j + dj <= m:
                gain = scores[i : i + di, j : j + dj].sum() - (penalty + 1e-6 if di + dj == 3 else 0) if di and dj else -penalty
                out = max(out, gain + go(i + di, j + dj))
        return out

    return go(0, 0)


@given(st.integers(0, 10_000))
@settings(max_examples=40, deadline=None)
def test_alignment_is_best(seed):
    r = np.random.default_rng(seed)
    scores = r.random((r.integers(1, 5), r.integers(1, 5))).round(2)
    moves = alignment.align(scores, 0.8)
    total = 0.0
    for name, i, j, _ in moves:
        di, dj = next((a, b) for n, a, b in alignment.MOVES if n == name)
        total += scores[i : i + di, j : j + dj].sum() - (0.8 + 1e-6 if di + dj == 3 else 0) if di and dj else -0.8
    assert total == pytest.approx(best_total(scores, 0.8), abs=1e-6)


def test_first_writer_wins_ties():
    assert [m[0] for m in alignment.align(np.zeros((1, 1)), 0.0)] == ["1:1"]


@given(st.text(alphabet="ab1 .[],-⟦⟧%", max_size=60))
@settings(max_examples=200, deadline=None)
def test_mask_and_restore_round_trip(text):
    masked, found = sequential.mask(text)
    if "⟦PP" not in text:
        assert sequential.restore(masked, found) == text


def test_lost_marker_is_put_back():
    masked, found = sequential.mask("It is 5 of [2].")
    assert sequential.restore(masked.replace("⟦PP0_1⟧", "").rstrip(), found) == "It is 5 of [2] ."


@given(st.text(alphabet="ab .\n", max_size=900))
@settings(max_examples=60, deadline=None)
def test_splits_lose_nothing(text):
    assert "".join(sequential.split_for_repair(text)) == text
    pieces = sequential.split_oversized(text, 100)
    assert all(0 < len(p) <= 100 for p in pieces)
    assert "".join("".join(pieces).split()) == "".join(text.split())


def test_page_lines_first_fit_and_gutter():
    run = lambda s, x, y, w=40.0: {"str": s, "x": x, "y": y, "w": w, "h": 10.0}
    lines = sequential.page_lines([run("b", 95, 11), run("a", 50, 10), run("far", 300, 10), run("next", 50, 30), run(" ", 0, 0)], 612.0)
    assert [l["text"] for l in lines] == ["a b", "far", "next"]


def test_merge_boxes_to_fixpoint():
    assert sequential.merge_boxes([(0, 0, 40, 40), (100, 0, 40, 40), (45, 0, 50, 40), (500, 500, 5, 5)], 8, 100) == [(0, 0, 140, 40, 3)]


def test_find_range_ignores_blanks():
    assert sequential.find_range("a b  c d", "bc") == (2, 6)
    assert sequential.find_range("abab", "ab", 1) == (2, 4)
    assert sequential.find_range("abc", "x") is None


def test_paginate_keeps_order_and_height(spark, data):
    rows = table_queries.paginate(spark, data).collect()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    for placed in by.values():
        order = [(r.page, r.col, r.top) for r in placed]
        assert order == sorted(order) and [r.ord for r in placed] == sorted(r.ord for r in placed)
        assert all(r.top + r.h <= 700.0 + 1e-9 or r.overflow for r in placed)


def test_reducer_rejects_and_completes():
    s = dict(work.IDLE)
    for kind, n in [("START_PARSE", 0), ("PARSE_DONE", 0), ("LAYOUT_DONE", 0), ("GLOSSARY_DONE", 0), ("START_TRANSLATION", 2), ("BLOCKS_VALIDATED", 2), ("TRANSLATION_DONE", 0), ("COMPOSITION_DONE", 0), ("COMPILE_DONE", 0), ("QUALITY_STARTED", 0), ("QUALITY_PASSED", 0)]:
        s = work.reduce_event(s, {"type": kind, "count": n})
    assert (s["stage"], s["status"]) == ("completed", "completed")
    with pytest.raises(ValueError):
        work.reduce_event(dict(work.IDLE), {"type": "PARSE_DONE"})
    with pytest.raises(ValueError):
        work.reduce_event(work.IDLE | {"stage": "translating", "total": 1}, {"type": "BLOCKS_VALIDATED", "count": 2})


def test_stream_state_equals_batch(spark, data, tmp_path):
    events = table_queries.task_events(spark, data)
    events.repartition(1).sortWithinPartitions("seq").write.parquet(str(tmp_path / "in"))
    q = streaming.task_states(streaming.read_log(spark, str(tmp_path / "in"), events.schema)).writeStream.outputMode("update").format("memory").queryName("states").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(map(tuple, spark.table("states").collect())) == sorted(map(tuple, work.replay(events).collect()))


def test_stream_windows_equal_batch(spark, data, tmp_path):
    e = spark.read.parquet(f"{data}/events.parquet").selectExpr("event_id", "cast(ts as timestamp) ts", "user_id", "event_type", "value")
    e.write.parquet(str(tmp_path / "in"))
    q = streaming.windows(streaming.read_log(spark, str(tmp_path / "in"), e.schema), "1 hour").writeStream.outputMode("complete").format("memory").queryName("tumbling").trigger(availableNow=True).start()
    q.awaitTermination(120)
    short = lambda rows: sorted((r.begin, r.event_type, r.n) for r in rows)
    assert short(spark.table("tumbling").collect()) == short(streaming.windows(e, "1 hour").collect())


def test_chains_and_cycles(spark):
    links = spark.createDataFrame([(1, i, i + 1) for i in range(9)] + [(2, 5, 6)], "doc_id long, a long, b long")
    got = {(r.doc_id, r.node): (r.head, r.pos) for r in graphs.chains(links).collect()}
    assert got[(1, 9)] == (0, 9) and got[(2, 6)] == (5, 1) and len(got) == 12
    edges = spark.createDataFrame([(1, 1, 2), (1, 2, 1), (2, 1, 2), (3, 4, 4)], "doc_id long, a long, b long")
    assert sorted(r.doc_id for r in graphs.cyclic(edges).collect()) == [1, 3]


def test_lock_replay(spark):
    rows = [(1, 0, "en", 0), (1, 1, "en", 100), (1, 2, "zh", 120), (1, 3, "zh", 200), (1, 4, "zh", 270)]
    df = spark.createDataFrame(rows, "project long, seq long, side string, at long")
    assert [r.sync for r in sorted(reader.replay_lock(df).collect(), key=lambda r: r.seq)] == [True, False, True, False, True]


def test_locate_before_first(spark):
    index = spark.createDataFrame([(1, "a", 10.0, 20.0), (1, "b", 30.0, 40.0)], "doc_id long, block_id string, top double, bottom double")
    probes = spark.createDataFrame([(1, 0, 5.0), (1, 1, 10.0), (1, 2, 99.0)], "doc_id long, probe long, at double")
    assert {r.probe: r.block_id for r in reader.locate(index, probes).collect()} == {0: "a", 1: "a", 2: "b"}


def test_overrides_last_wins(spark):
    pairs = spark.createDataFrame([(1, "fig1", "s1", "t1"), (1, "tab1", "s2", "t2")], "doc_id long, label string, source_id string, target_id string")
    over = spark.createDataFrame([(1, "fig1", "s1", "t9", 1), (1, "fig1", "s1", "t8", 2), (1, "tab1", None, None, 3)], "doc_id long, label string, source_id string, target_id string, seq long")
    assert [tuple(r) for r in alignment.override_anchors(pairs, over).collect()] == [(1, "fig1", "s1", "t8", "manual")]


def test_collapse_to_fallback(spark):
    units = spark.createDataFrame([(1, "p", "g1", 0.95), (1, "p", "g2", 0.5), (1, "q", "g3", 0.95)], "doc_id long, parent_id string, unit_id string, confidence double")
    falls = spark.createDataFrame([(1, "p", 0.99), (1, "q", 0.99)], "doc_id long, parent_id string, confidence double")
    assert sorted((r.unit_id, r.relation) for r in alignment.collapse_fallbacks(units, falls).collect()) == [("g3", "group"), ("p", "paragraph-fallback")]


def test_seeded_errors_raise_their_rules(spark):
    b = "doc_id long, block_id string, type string, text string, ord long"
    source = spark.createDataFrame([(1, "e1", "section", "1 Intro", 0), (1, "e2", "paragraph", "Speed is 18.3 and $a$ $b$.", 1), (1, "e3", "figure", "Figure 1. X", 2)], b)
    target = spark.createDataFrame([(1, "z1", "section", "2 Intro", 0), (1, "z2", "paragraph", "x", 1)], b)
    pairs = spark.createDataFrame([(1, "e1", "z1", "以下为译文 y")], "doc_id long, source_id string, target_id string, text string")
    terms = spark.createDataFrame([(1, "t", "ABC")], "doc_id long, term string, abbr string")
    issues = audit.rule_audit(source, target, pairs, terms).collect()
    assert {i.rule for i in issues if i.severity == "error"} == {"R1", "R2", "R3", "R4", "R7"}
    assert {i.rule for i in issues if i.severity == "warn"} == {"R5", "R6", "R8"}


def test_batches_respect_caps(spark, data):
    r = random.Random(1)
    rows = [(d, f"{d}-{i}", i, r.randint(1, 70)) for d, i in itertools.product(range(4), range(40))]
    df = spark.createDataFrame(rows, "doc_id long, block_id string, ord long, tokens long")
    totals = work.batch_totals(work.batches(df, shared=5, max_tokens=60, max_blocks=4), df, shared=5).collect()
    assert sum(t.blocks for t in totals) == len(rows)
    assert all(t.blocks <= 4 and (t.tokens <= 60 or (t.oversized and t.blocks == 1)) for t in totals)


def test_empty_tables(spark, data):
    empty = fixtures.blocks(spark, data).where("false")
    assert audit.label_sequence(empty, empty).count() == 0
    assert gates.marker_difference(empty.selectExpr("doc_id", "block_id marker"), empty.selectExpr("doc_id", "block_id marker")).count() == 0
