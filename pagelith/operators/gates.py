"""Quality gates: alignment, markers, structure, content coverage, footers, repairs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagelith.functions import geometry as G
from pagelith.functions import text as T


def _rows(df: DataFrame, condition: Column, code: str, severity: str = "error", entity: str = "unit_id") -> DataFrame:
    return df.where(condition).select("doc_id", F.lit(code).alias("code"), F.col(entity).cast("string").alias("entity"), F.lit(severity).alias("severity"))


def alignment_gate(units: DataFrame) -> DataFrame:
    """units(doc_id, unit_id, source_ready, target_ready, status, relation) -> issues."""
    ready = F.col("source_ready") & F.col("target_ready")
    return reduce(DataFrame.unionByName, [
        _rows(units, ~F.col("source_ready"), "source-geometry-missing"),
        _rows(units, ~F.col("target_ready"), "target-geometry-missing"),
        _rows(units, ready & (F.col("status") == "unmatched"), "unit-unmatched"),
        _rows(units, ready & (F.col("status") == "low-confidence"), "unit-low-confidence", "warn"),
        _rows(units, F.col("relation") == "paragraph-fallback", "paragraph-fallback", "warn"),
    ])


def gate_result(docs: DataFrame, issues: DataFrame) -> DataFrame:
    """pass: no error; verified: no issue at all."""
    n = issues.groupBy("doc_id").agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count(F.lit(1)).alias("n"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return docs.select("doc_id").distinct().join(n, "doc_id", "left").select("doc_id", (zero("errors") == 0).alias("pass"), (zero("n") == 0).alias("verified"))


def marker_difference(required: DataFrame, emitted: DataFrame) -> DataFrame:
    """Markers (doc_id, marker) that only one side has, and those a side has twice."""
    one = lambda df, s: df.groupBy("doc_id", "marker").agg(F.count(F.lit(1)).alias(s))
    both = one(required, "r").join(one(emitted, "e"), ["doc_id", "marker"], "full_outer")
    kinds = F.array_compact(F.array(
        F.when(F.col("e").isNull(), F.lit("missing")), F.when(F.col("r").isNull(), F.lit("unexpected")),
        F.when(F.col("r") > 1, F.lit("duplicate-required")), F.when(F.col("e") > 1, F.lit("duplicate-emitted")),
    ))
    return both.select("doc_id", "marker", F.explode(kinds).alias("code"))


def structure(units: DataFrame, regions: DataFrame, region_units: DataFrame, assets: DataFrame) -> DataFrame:
    """Referential integrity of prepared structure.

    units(doc_id, unit_id, region_id, kind, asset_id), regions(doc_id, region_id),
    region_units(doc_id, region_id, pos, unit_id), assets(doc_id, asset_id, kind,
    caption_id). Issues: doc_id, code, entity, severity.
    """
    twice = lambda df, c, code: _rows(df.groupBy("doc_id", c).agg(F.count(F.lit(1)).alias("n")), F.col("n") > 1, code, entity=c)
    missing = lambda df, other, code, entity: _rows(df.join(other, [c for c in other.columns], "left_anti"), F.lit(True), code, entity=entity)
    known, refs = units.select("doc_id", "unit_id").distinct(), region_units
    owners = refs.join(known, ["doc_id", "unit_id"]).select("doc_id", "unit_id", F.col("region_id").alias("owner")).distinct()
    n_owners = owners.groupBy("doc_id", "unit_id").agg(F.count(F.lit(1)).alias("n"), F.min("owner").alias("owner"))
    owned = units.join(n_owners, ["doc_id", "unit_id"], "left")
    with_asset = units.where("asset_id IS NOT NULL")
    asset_units = with_asset.groupBy("doc_id", "asset_id").agg(F.count(F.lit(1)).alias("n"), F.collect_set("kind").alias("kinds"))
    a = assets.join(asset_units, ["doc_id", "asset_id"], "left")
    captions = assets.where("caption_id IS NOT NULL")
    caption_units = units.select("doc_id", F.col("unit_id").alias("caption_id"), F.col("kind").alias("caption_kind")).distinct()
    parts = [
        twice(units, "unit_id", "duplicate-unit-id"), twice(regions, "region_id", "duplicate-region-id"), twice(assets, "asset_id", "duplicate-asset-id"),
        missing(refs, known, "unknown-unit-reference", "unit_id"),
        _rows(refs.groupBy("doc_id", "region_id", "unit_id").agg(F.count(F.lit(1)).alias("n")), F.col("n") > 1, "duplicate-region-reference"),
        missing(units.where("region_id IS NOT NULL"), regions.select("doc_id", "region_id").distinct(), "missing-region-owner", "unit_id"),
        _rows(owned, F.col("n").isNull(), "unit-without-region"),
        _rows(owned, F.col("n") > 1, "multiple-region-owners"),
        _rows(owned, (F.col("n") == 1) & (F.col("owner") != F.col("region_id")), "region-owner-mismatch"),
        missing(with_asset, assets.select("doc_id", "asset_id").distinct(), "missing-asset-record", "asset_id"),
        _rows(a, F.col("n").isNull(), "missing-asset-unit", entity="asset_id"),
        _rows(a, F.col("n") > 1, "multiple-asset-units", entity="asset_id"),
        _rows(a, F.exists("kinds", lambda k: k != F.col("kind")), "asset-kind-mismatch", entity="asset_id"),
        missing(captions, caption_units.select("doc_id", "caption_id").distinct(), "missing-caption-unit", "caption_id"),
        _rows(captions.join(caption_units, ["doc_id", "caption_id"]), ~F.col("caption_kind").isin("caption", "table-title"), "invalid-caption-unit-kind", entity="caption_id"),
        _rows(captions.groupBy("doc_id", "caption_id").agg(F.count(F.lit(1)).alias("n")), F.col("n") > 1, "multiple-caption-owners", entity="caption_id"),
    ]
    return reduce(DataFrame.unionByName, parts)


def content_coverage(expected: DataFrame, found: DataFrame, least: float = 0.85) -> DataFrame:
    """Part of expected texts (doc_id, text; 4 characters or more once compact) that the document's found text contains."""
    whole = found.groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", "text"))), lambda t: t["text"]), "\n").alias("all"))
    whole = whole.select("doc_id", T.compact(F.col("all")).alias("all"))
    # a document's texts meet in one row: its text is not copied to each of its blocks
    e = expected.select("doc_id", T.compact(F.col("text")).alias("t")).where(F.length("t") >= 4).groupBy("doc_id").agg(F.collect_list("t").alias("ts"))
    hits = F.size(F.filter("ts", lambda t: F.contains(F.coalesce("all", F.lit("")), t))).cast("long")
    out = e.join(whole, "doc_id", "left").select("doc_id", F.size("ts").cast("long").alias("expected"), hits.alias("hits"))
    return out.withColumn("coverage", F.col("hits") / F.col("expected")).withColumn("pass", F.col("hits") / F.col("expected") >= least)


def footer_overflows(rects: DataFrame, pages: DataFrame) -> DataFrame:
    """Rectangles that end more than 2 below the printable bottom."""
    bottom = F.col("page_h") - F.greatest(F.lit(36.0), F.col("page_w") * 0.1)
    return rects.join(pages, ["doc_id", "page"]).where(F.col("y") + F.col("h") > bottom + 2)


def issue_fingerprint(page: Column, kind: Column, box: Column, evidence: Column) -> Column:
    tens = F.transform(box, lambda v: (F.floor(v / 10 + 0.5) * 10).cast("long").cast("string"))
    return F.concat_ws("|", page.cast("string"), kind, F.array_join(tens, "|"), F.lower(F.trim(evidence)))


def mapped_unit(issues: DataFrame, units: DataFrame) -> DataFrame:
    """The unit with the greatest overlap with each issue's box, on the same page."""
    both = issues.select("doc_id", "page", "issue_id", *(F.col(c).alias(f"a_{c}") for c in "xywh")).join(
        units.select("doc_id", "page", "unit_id", *(F.col(c).alias(f"b_{c}") for c in "xywh")), ["doc_id", "page"]
    )
    sums = both.withColumn("o", G.overlap_area("a_", "b_")).where("o > 0").groupBy("doc_id", "issue_id", "unit_id").agg(F.sum("o").alias("overlap"))
    w = Window.partitionBy("doc_id", "issue_id").orderBy(F.col("overlap").desc(), "unit_id")
    return sums.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")


def safe_prefix(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """Responses in request order up to the first that is missing, out of order or invalid.

    requests(doc_id, ord, block_id), responses(doc_id, ord, block_id, valid).
    """
    r = responses.select("doc_id", "ord", F.col("block_id").alias("got"), "valid")
    both = requests.join(r, ["doc_id", "ord"], "left").withColumn("ok", F.coalesce((F.col("got") == F.col("block_id")) & F.col("valid"), F.lit(False)))
    w = Window.partitionBy("doc_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("accepted", F.every("ok").over(w)).select("doc_id", "ord", "block_id", "accepted")


def token_losses(pairs: DataFrame) -> DataFrame:
    """Protected tokens that occur fewer times in the target: (doc_id, block_id, token, required, received)."""
    count = lambda c, n: pairs.select("doc_id", "block_id", F.explode(T.protected_tokens(F.col(c))).alias("token")).groupBy("doc_id", "block_id", "token").agg(F.count(F.lit(1)).alias(n))
    both = count("source", "required").join(count("target", "received"), ["doc_id", "block_id", "token"], "left")
    return both.withColumn("received", F.coalesce("received", F.lit(0))).where("received < required")


#: Issues that moving or scaling cannot mend, and evidence of text out of place (fixed values).
NOT_REPAIRABLE = ("asset_changed", "asset_missing", "formula_changed", "table_changed", "missing_text", "untranslated_body", "unreadable_glyphs", "review_incomplete")
OUT_OF_PLACE = r"(?i)(?:scattered text|stray (?:text|punctuation)|author.*body|mixed\s+(?:with|into)\s+(?:the\s+)?body|作者单位.*正文混排|正文混排|散落文本|孤立标点)"
ALONE, CROWDED = "(?i)orphan|isolated|孤立|单独|页末", "(?i)side.by.side|grid|narrow|crowd|并排|过窄|拥挤"
ASSET_KINDS = ("figure", "table", "formula", "code")


def repair_plan(issues: DataFrame, units: DataFrame, seen: DataFrame) -> DataFrame:
    """Bounded actions (doc_id, unit_id, action) for blocking issues.

    issues(doc_id, type, evidence, blocking, fingerprint, unit_id), units(doc_id,
    unit_id, kind), seen(doc_id, fingerprint) of earlier attempts. A document with a
    blocking issue of content gets no action at all.
    """
    b = issues.where("blocking")
    lost = b.where(F.col("type").isin(*NOT_REPAIRABLE)).select("doc_id").distinct()
    b = b.join(lost, "doc_id", "left_anti").join(seen, ["doc_id", "fingerprint"], "left_anti")
    b = b.where(~((F.col("type") == "layout_drift") & F.col("evidence").rlike(OUT_OF_PLACE))).join(units, ["doc_id", "unit_id"])
    kind, evidence = F.col("kind"), F.col("evidence")
    asset = kind.isin(*ASSET_KINDS)
    actions = F.array_compact(F.array(
        F.when(kind == "heading", F.when(evidence.rlike(ALONE), "page-break").otherwise("heading-spacing")),
        F.when(asset, F.lit("asset-scale")), F.when(asset & evidence.rlike(CROWDED), F.lit("stack-assets")),
        F.when((kind != "heading") & ~asset & F.col("type").isin("overlap", "clipped_text", "layout_drift"), F.lit("page-break")),
    ))
    return b.select("doc_id", "unit_id", F.explode(actions).alias("action")).distinct()


def run_history(runs: DataFrame, most_runs: int = 8, most_attempts: int = 64) -> DataFrame:
    """Of runs(doc_id, run, attempts array): the last runs, each with its last attempts."""
    w = Window.partitionBy("doc_id").orderBy(F.col("run").desc())
    kept = runs.withColumn("r", F.row_number().over(w)).where(F.col("r") <= most_runs).drop("r")
    n = F.least(F.size("attempts"), F.lit(most_attempts))
    return kept.withColumn("attempts", F.when(n > 0, F.slice("attempts", -n, n)).otherwise(F.col("attempts")))
