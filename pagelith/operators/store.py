"""Project tables: lookups, clears, guarded commits, translation requests and their groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagelith.functions import prose
from pagelith.functions import text as T
from pagelith.operators.work import OUTPUT_KINDS

#: Kinds that are cropped or rebuilt, never translated (fixed values).
IMMUTABLE = ("figure", "table", "formula", "code", "page-furniture")
UNTRANSLATED = ("author", "reference", *IMMUTABLE)
COMMITTED = tuple(OUTPUT_KINDS)


def lookup(table: DataFrame, **key) -> DataFrame:
    """Rows with the key; the filter reaches the scan."""
    for c, v in key.items():
        table = table.where(F.col(c) == F.lit(v))
    return table


def lookup_many(table: DataFrame, keys: DataFrame) -> DataFrame:
    """The bulk form: keys that the table lacks have nulls."""
    return keys.join(table, keys.columns, "left")


def project_rows(table: DataFrame, project, order: str) -> DataFrame:
    return lookup(table, project_id=project).orderBy(order)


def cleared(table: DataFrame, projects: DataFrame, keep: tuple[str, ...] = (), drop: tuple[str, ...] = ()) -> DataFrame:
    """The table without the projects' rows, but for kinds in keep; with drop, only those kinds go."""
    gone = table.join(projects.select("project_id").distinct(), "project_id", "left_semi")
    if keep:
        gone = gone.where(~F.col("kind").isin(*keep))
    if drop:
        gone = gone.where(F.col("kind").isin(*drop))
    return table.join(gone.select("project_id", "key"), ["project_id", "key"], "left_anti")


def without_outputs(table: DataFrame, projects: DataFrame) -> DataFrame:
    return cleared(table, projects, drop=COMMITTED)


def without_derived(table: DataFrame, projects: DataFrame) -> DataFrame:
    return cleared(table, projects, keep=("english-pdf",))


def commit_errors(outputs: DataFrame, plans: DataFrame) -> DataFrame:
    """Why outputs(project_id, key, kind, plan_digest) may not be committed; a commit writes only if there is no row.

    plans(project_id, digest) are the accepted ones.
    """
    twice = outputs.groupBy("project_id", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("project_id", "key", F.lit("duplicate-key").alias("code"))
    kind = outputs.where(~F.col("kind").isin(*COMMITTED)).select("project_id", "key", F.lit("kind-not-allowed").alias("code"))
    stale = outputs.join(plans, "project_id", "left").where(~F.col("plan_digest").eqNullSafe(F.col("digest"))).select("project_id", "key", F.lit("stale-plan").alias("code"))
    return twice.unionByName(kind).unionByName(stale)


def requests(units: DataFrame, title_terms: DataFrame | None = None) -> DataFrame:
    """Ordered requests from units(doc_id, unit_id, kind, text, ord): kind, sentences with ids, protected tokens.

    A text whose sentences do not rebuild it, or that mixes technical signs, is one
    sentence: the paragraph itself.
    """
    u = units.where(~F.col("kind").isin(*UNTRANSLATED) & (F.length(T.strip(F.coalesce("text", F.lit("")))) > 0)).withColumn("source", T.strip(F.col("text")))
    s = T.sentences(F.regexp_replace("source", r"\s*\n+\s*", " "))
    flat = lambda c: F.regexp_replace(c, "[\\s　]+", "")
    u = u.withColumn("parts", s)
    ambiguous = F.col("source").rlike("[_=]") & F.col("source").rlike("[:;；]")
    good = (F.size("parts") > 0) & (flat(F.array_join("parts", "")) == flat(F.col("source"))) & ~ambiguous
    whole = F.array(F.struct(F.col("unit_id").alias("id"), F.col("source").alias("text")))
    each = F.transform("parts", lambda p, i: F.struct(F.concat(F.col("unit_id"), F.lit("-s-"), (i + 1).cast("string")).alias("id"), p.alias("text")))
    tokens = F.array_distinct(T.protected_tokens(F.col("source")))
    if title_terms is not None:
        terms = title_terms.groupBy("doc_id").agg(F.sort_array(F.collect_set("term")).alias("terms"))
        u = u.join(terms, "doc_id", "left")
        mine = F.filter(F.coalesce("terms", F.array().cast("array<string>")), lambda t: F.contains(F.col("source"), t))
        tokens = F.array_distinct(F.concat(T.protected_tokens(F.col("source")), mine))
    return u.select(
        "doc_id", F.col("unit_id").alias("block_id"), "ord", prose.translation_kind(F.col("kind")).alias("kind"), "source",
        F.when(good, "sentence-candidates").otherwise("paragraph-fallback").alias("mode"), F.when(good, each).otherwise(whole).alias("sentences"), tokens.alias("tokens"),
    )


def groups(responses: DataFrame) -> DataFrame:
    """responses(doc_id, block_id, mode, groups array<struct<sources array<string>, targets array<string>>>) -> alignment units with target ids."""
    g = responses.select("doc_id", "block_id", "mode", F.posexplode("groups").alias("k", "g"))
    unit = F.concat_ws("-g-", "block_id", (F.col("k") + 1).cast("string"))
    n_s, n_t = F.size("g.sources"), F.size("g.targets")
    kind = F.when((n_s == 1) & (n_t == 1), "1:1").when((n_s == 1) & (n_t > 1), "1:n").when((n_s > 1) & (n_t == 1), "n:1").otherwise("n:m")
    targets = F.transform("g.targets", lambda t, i: F.concat(unit, F.lit("-t-"), (i + 1).cast("string")))
    whole = F.array(F.concat("block_id", F.lit("-t-1")))
    fall = F.col("mode") == "paragraph-fallback"
    rows = g.select(
        "doc_id", "block_id", F.when(fall, F.col("block_id")).otherwise(unit).alias("unit_id"), F.when(fall, "paragraph-fallback").otherwise(kind).alias("relation"),
        F.when(fall, whole).otherwise(targets).alias("target_ids"), F.array_join("g.targets", "").alias("target"), F.col("k").cast("long").alias("ord"), fall.alias("fall"),
    )
    w = Window.partitionBy("doc_id", "block_id").orderBy("ord")
    text = F.array_join(F.collect_list("target").over(Window.partitionBy("doc_id", "block_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), "")
    rows = rows.withColumn("r", F.row_number().over(w)).withColumn("target", F.when(F.col("fall"), text).otherwise(F.col("target")))
    return rows.where("NOT fall OR r = 1").drop("r", "fall")


def order_errors(placed: DataFrame, blocks: DataFrame) -> DataFrame:
    """placed(doc_id, pos, block_id) against blocks(doc_id, ord, block_id): missing, split by others, or out of order."""
    span = placed.groupBy("doc_id", "block_id").agg(F.min("pos").alias("first"), F.max("pos").alias("last"), F.count(F.lit(1)).alias("n"))
    b = blocks.join(span, ["doc_id", "block_id"], "left")
    w = Window.partitionBy("doc_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    b = b.withColumn("before", F.max("last").over(w))
    codes = F.array_compact(F.array(
        F.when(F.col("first").isNull(), F.lit("missing")), F.when(F.col("last") - F.col("first") + 1 != F.col("n"), F.lit("split")),
        F.when(F.col("first") < F.col("before"), F.lit("out-of-order")),
    ))
    return b.select("doc_id", "block_id", F.explode(codes).alias("code"))


def allowed_models(listed: DataFrame, allow: list[str]) -> DataFrame:
    """The listed models that are allowed; the list is a few names."""
    return listed.where(F.col("id").isin(*allow))
