"""Literal cases of asset regions, stores, requests and reader commands."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagelith.operators import assets, reader, store

BOX = "doc_id long, page long, id long, kind string, x double, y double, w double, h double, caption_id string"


def regions(spark, *rows):
    return spark.createDataFrame([(1, 0, *r) for r in rows], BOX)


def test_duplicates_keep_the_captioned_then_the_larger(spark):
    r = regions(spark, (1, "figure", 0.0, 0.0, 10.0, 10.0, None), (2, "figure", 0.0, 0.0, 9.0, 10.0, "c"), (3, "figure", 50.0, 50.0, 5.0, 5.0, None), (4, "table", 0.0, 0.0, 10.0, 10.0, None))
    assert sorted(x.id for x in assets.deduplicated(r).collect()) == [2, 3, 4]


def test_exact_bounds_need_like_size(spark):
    r = regions(spark, (1, "figure", 0.0, 0.0, 100.0, 100.0, None), (2, "table", 0.0, 0.0, 100.0, 100.0, None))
    close, wide = regions(spark, (9, "b", 5.0, 5.0, 95.0, 100.0, None)), regions(spark, (9, "b", 0.0, 0.0, 200.0, 100.0, None))
    assert {x.id: (x.x, x.snapped) for x in assets.exact_bounds(r, close).collect()} == {1: (5.0, True), 2: (0.0, False)}
    assert not any(x.snapped for x in assets.exact_bounds(r, wide).collect())


def test_printed_identity_beats_nearness(spark):
    r = regions(spark, (1, "figure", 0.0, 0.0, 100.0, 50.0, None)).withColumn("label", F.lit("Figure 2")).withColumns({"cx": F.lit(0.0), "cy": F.lit(52.0), "cw": F.lit(100.0), "ch": F.lit(10.0)})
    c = spark.createDataFrame([(1, 0, "a", "figure", "figure:1", 0.0, 52.0, 100.0, 10.0), (1, 0, "b", "figure", "figure:2", 0.0, 90.0, 100.0, 10.0)], "doc_id long, page long, caption_id string, kind string, identity string, x double, y double, w double, h double")
    assert [(x.caption_id, x.tier) for x in assets.link_captions(r, c).collect()] == [("b", 0)]
    assert [(x.caption_id, x.tier) for x in assets.link_captions(r.withColumn("label", F.lit("")), c).collect()] == [("a", 1)]


def test_thin_rows(spark):
    rows = [(i, "formula", 100.0, 100.0 + 20 * i, 400.0, 20.0, None) for i in range(6)] + [(9, "formula", 100.0, 900.0, 700.0, 20.0, None), (10, "formula", 100.0, 700.0, 400.0, 20.0, None)]
    assert sorted(x.id for x in assets.thin_formula_rows(regions(spark, *rows)).collect()) == [0, 1, 2, 3, 4, 5, 9]


def test_region_without_caption_has_no_caption_issue(spark):
    r = regions(spark, (1, "figure", 10.0, 10.0, 50.0, 50.0, None))
    c = spark.createDataFrame([(1, 0, "a", "figure", 300.0, 300.0, 10.0, 10.0)], "doc_id long, page long, caption_id string, kind string, x double, y double, w double, h double")
    assert assets.geometry_gate(r, c, 600.0, 800.0).first().issues == []


def test_requests_fall_back_where_ambiguous(spark):
    u = spark.createDataFrame([(1, "u1", "paragraph", "One. Two 3.5!", 0), (1, "u2", "paragraph", "a_b = c; d", 1), (1, "u3", "figure", "x", 2), (1, "u4", "heading", " ", 3)], "doc_id long, unit_id string, kind string, text string, ord long")
    got = {r.block_id: r for r in store.requests(u).collect()}
    assert set(got) == {"u1", "u2"} and [s.id for s in got["u1"].sentences] == ["u1-s-1", "u1-s-2"] and got["u1"].tokens == ["3.5"]
    assert got["u2"].mode == "paragraph-fallback" and [s.text for s in got["u2"].sentences] == ["a_b = c; d"]


def test_groups_and_fallback(spark):
    rows = [(1, "b", "sentence-candidates", [(["s1"], ["t", "u"]), (["s2", "s3"], ["v"])]), (1, "p", "paragraph-fallback", [(["p"], ["x"]), (["p"], ["y"])])]
    got = {r.unit_id: (r.relation, r.target_ids, r.target) for r in store.groups(spark.createDataFrame(rows, "doc_id long, block_id string, mode string, groups array<struct<sources:array<string>,targets:array<string>>>")).collect()}
    assert got == {"b-g-1": ("1:n", ["b-g-1-t-1", "b-g-1-t-2"], "tu"), "b-g-2": ("n:1", ["b-g-2-t-1"], "v"), "p": ("paragraph-fallback", ["p-t-1"], "xy")}


def test_clears_and_commits(spark):
    t = spark.createDataFrame([("p", 1, "english-pdf"), ("p", 2, "chinese-pdf"), ("p", 3, "vision-layout"), ("q", 4, "chinese-pdf")], "project_id string, key long, kind string")
    p = t.where("project_id = 'p'")
    assert sorted(r.key for r in store.without_outputs(t, p).collect()) == [1, 3, 4]
    assert sorted(r.key for r in store.without_derived(t, p).collect()) == [1, 4]
    out = t.where("key IN (2, 3)").withColumn("plan_digest", F.lit("d"))
    plans = spark.createDataFrame([("p", "d")], "project_id string, digest string")
    assert [(r.key, r.code) for r in store.commit_errors(out, plans).collect()] == [(3, "kind-not-allowed")]
    assert {r.code for r in store.commit_errors(out, plans.withColumn("digest", F.lit("e"))).collect()} == {"kind-not-allowed", "stale-plan"}


def test_order_errors(spark):
    blocks = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (1, 2, "c"), (1, 3, "d")], "doc_id long, ord long, block_id string")
    placed = spark.createDataFrame([(1, 0, "b"), (1, 1, "a"), (1, 2, "c"), (1, 3, "a")], "doc_id long, pos long, block_id string")
    assert sorted((r.block_id, r.code) for r in store.order_errors(placed, blocks).collect()) == [("a", "split"), ("b", "out-of-order"), ("c", "out-of-order"), ("d", "missing")]


def test_sync_commands(spark):
    index = "doc_id long, block_id string, top double, bottom double"
    source, target = spark.createDataFrame([(1, "s1", 0.0, 50.0), (1, "s2", 50.0, 90.0)], index), spark.createDataFrame([(1, "t1", 400.0, 500.0)], index)
    units = spark.createDataFrame([(1, 0, ["s1", "s2"], ["t1"])], "doc_id long, unit long, source_ids array<string>, target_ids array<string>")
    probes = spark.createDataFrame([(1, 7, 60.0)], "doc_id long, probe long, at double")
    assert [tuple(r) for r in reader.sync_commands(probes, source, target, units, 300.0).collect()] == [(1, 7, "s2", 0, "t1", 300.0)]


def test_repair_plan(spark):
    from pagelith.operators import gates

    issues = spark.createDataFrame(
        [(1, "overlap", "crowded side by side", True, "f1", "fig"), (1, "layout_drift", "orphan heading", True, "f2", "head"), (1, "overlap", "x", True, "seen", "text"), (1, "overlap", "x", False, "f4", "text"), (2, "overlap", "x", True, "f5", "text"), (2, "missing_text", "x", True, "f6", "text")],
        "doc_id long, type string, evidence string, blocking boolean, fingerprint string, unit_id string",
    )
    units = spark.createDataFrame([(d, u, k) for d in (1, 2) for u, k in (("fig", "figure"), ("head", "heading"), ("text", "paragraph"))], "doc_id long, unit_id string, kind string")
    seen = spark.createDataFrame([(1, "seen")], "doc_id long, fingerprint string")
    assert sorted((r.doc_id, r.unit_id, r.action) for r in gates.repair_plan(issues, units, seen).collect()) == [(1, "fig", "asset-scale"), (1, "fig", "stack-assets"), (1, "head", "page-break")]


def test_run_history(spark):
    from pagelith.operators import gates

    runs = spark.createDataFrame([(1, r, list(range(70))) for r in range(10)], "doc_id long, run long, attempts array<int>")
    got = gates.run_history(runs).collect()
    assert sorted(r.run for r in got) == list(range(2, 10)) and all(r.attempts == list(range(6, 70)) for r in got)
