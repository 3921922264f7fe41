"""Passes that join a unit to the one it continues, split headings, and look above captions.

units(doc_id, unit_id, kind, ord, page, x, y, w, h, text) as in preparation: null text is empty, a unit
without a place (null page or rectangle) neither continues a unit nor is continued.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelith.functions.text import strip
from pagelith.operators.rewrites import heading_parts

# Fixed values.
URL_PATH = r"^[A-Za-z0-9._~%+-]+(?:/[A-Za-z0-9._~%+-]+)+(?:\s*[.,;:])?$"
OPEN_URL = r"(?i)https?://\S+/\s*$"
ABSTRACT = r"(?i)^\s*(?:abstract|摘要)\s*[.：:—-]"
ABSTRACT_LABEL = r"(?i)^\s*(?:abstract|摘要)\s*(?:[.：:—-]\s*)?"
KEYWORDS_LABEL = r"(?i)^\s*(?:index\s+terms|key\s*words?|关键词)\s*(?:[.：:—-]\s*)?"
CONTINUES = r"^[\s·•]"


def _claims(pairs: DataFrame, *order: str) -> DataFrame:
    """doc_id, taker, item: in the given order, which names the taker, a pair holds if neither its taker nor its item is in one that holds already.

    pairs are a document's few neighbours on a page; they are folded in one array a document.
    """
    none = F.array().cast("array<string>")
    held = F.struct(none.alias("takers"), none.alias("items"))

    def step(a: Column, p: Column) -> Column:
        more = F.struct(F.array_append(a["takers"], p["taker"]).alias("takers"), F.array_append(a["items"], p["item"]).alias("items"))
        return F.when(F.array_contains(a["takers"], p["taker"]) | F.array_contains(a["items"], p["item"]), a).otherwise(more)

    listed = pairs.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct(*order, "item"))).alias("pairs"))
    folded = listed.select("doc_id", F.aggregate("pairs", held, step).alias("held"))
    return folded.select("doc_id", F.explode(F.arrays_zip("held.takers", "held.items")).alias("p")).select("doc_id", F.col("p.takers").alias("taker"), F.col("p.items").alias("item"))


def _joined(units: DataFrame, heads: DataFrame, tails: DataFrame, glue) -> DataFrame:
    """units without tails(doc_id, unit_id); the text of a unit in heads(doc_id, unit_id, tail) becomes glue(text, tail)."""
    text = F.when(F.col("tail").isNotNull(), glue(F.col("text"), F.col("tail"))).otherwise(F.col("text"))
    return units.join(heads, ["doc_id", "unit_id"], "left").withColumn("text", text).drop("tail").join(tails, ["doc_id", "unit_id"], "left_anti")


def join_url_fragments(units: DataFrame, page_height: float) -> DataFrame:
    """A paragraph that is the path of a URL goes to the end of the unit above whose text breaks off in that URL.

    The unit lies at most 28 above the fragment, on its page or the one before, and overlaps half of the
    narrower one sideways; of several the nearest. Fragments choose in order, each unit takes one.
    """
    flat = strip(F.regexp_replace("text", r"\s+", " "))
    fragments = (
        units.where(F.col("kind").isin("paragraph", "list-item") & (F.length(flat) <= 100) & flat.rlike(URL_PATH))
        .select("doc_id", F.col("unit_id").alias("taker"), F.col("ord").alias("taker_ord"), F.col("x").alias("fx"), F.col("w").alias("fw"),
                (F.col("page") * page_height + F.col("y")).alias("top"), F.explode(F.array("page", F.col("page") - 1)).alias("page"))
    )
    owners = units.where(F.col("text").rlike(OPEN_URL))
    overlap = F.greatest(F.lit(0.0), F.least(F.col("x") + F.col("w"), F.col("fx") + F.col("fw")) - F.greatest("x", "fx"))
    gap = F.col("top") - (F.col("page") * page_height + F.col("y") + F.col("h"))
    near = fragments.join(owners, ["doc_id", "page"]).where((overlap >= 0.5 * F.least("w", "fw")) & gap.between(-2, 28) & (F.col("taker") != F.col("unit_id")))
    claims = _claims(near.select("doc_id", "taker", "taker_ord", gap.alias("gap"), "ord", F.col("unit_id").alias("item")), "taker_ord", "taker", "gap", "ord")
    path = F.regexp_replace(flat, r"\s+([.,;:])$", "$1")
    found = claims.join(units.select("doc_id", F.col("unit_id").alias("taker"), path.alias("tail")), ["doc_id", "taker"])
    return _joined(units, found.select("doc_id", F.col("item").alias("unit_id"), "tail"), claims.select("doc_id", F.col("taker").alias("unit_id")), lambda t, p: F.concat(F.regexp_replace(t, r"\s+$", ""), p))


def abstract_and_keywords(units: DataFrame) -> DataFrame:
    """First-page abstracts and keywords without their labels; keywords take the list that goes on below them.

    A paragraph that is labelled an abstract becomes one. A unit that was a label only goes. The list is the
    topmost paragraph of the page that begins with white space or a bullet from 2 above to 22 below the keywords' end.
    """
    here = (F.col("page") == 0) & F.col("x").isNotNull() & (F.col("text") != "")
    kind = F.when(here & (F.col("kind") == "paragraph") & F.col("text").rlike(ABSTRACT), "abstract").otherwise(F.col("kind"))
    label = F.when(F.col("kind") == "abstract", ABSTRACT_LABEL).when(F.col("kind") == "keywords", KEYWORDS_LABEL)
    bare = strip(F.regexp_replace(F.col("text"), F.coalesce(label, F.lit("^$")), F.lit("")))
    labelled = here & label.isNotNull()
    units = units.withColumn("kind", kind).where(~F.coalesce(labelled & (bare == ""), F.lit(False))).withColumn("text", F.when(labelled, bare).otherwise(F.col("text")))
    heads = units.where("kind = 'keywords' AND text <> ''").select("doc_id", "page", F.col("unit_id").alias("taker"), F.col("ord").alias("taker_ord"), (F.col("y") + F.col("h")).alias("end"))
    lists = units.where((F.col("kind") == "paragraph") & F.col("text").rlike(CONTINUES))
    below = heads.join(lists, ["doc_id", "page"]).where((F.col("y") >= F.col("end") - 2) & (F.col("y") - F.col("end") <= 22))
    claims = _claims(below.select("doc_id", "taker", "taker_ord", "y", "ord", F.col("unit_id").alias("item")), "taker_ord", "taker", "y", "ord")
    found = claims.join(units.select("doc_id", F.col("unit_id").alias("item"), strip("text").alias("tail")), ["doc_id", "item"])
    return _joined(units, found.select("doc_id", F.col("taker").alias("unit_id"), "tail"), claims.select("doc_id", F.col("item").alias("unit_id")), lambda t, p: F.concat(strip(t), F.lit(" "), p))


def heading_units(units: DataFrame) -> DataFrame:
    """Each part of a heading as a unit with number and level; all but the first are children of the first.

    Adds parent_id, source_id, number and level. Parts follow the unit in steps of a thousandth of ord. Other
    units and headings without text stay as they are.
    """
    split = units.select("*", F.posexplode_outer(F.when((F.col("kind") == "heading") & F.col("text").isNotNull(), heading_parts(F.col("text")))).alias("part", "p"))
    later = F.coalesce(F.col("part") > 0, F.lit(False))
    unit_id = F.when(later, F.concat("unit_id", F.lit("-heading-"), (F.col("part") + 1).cast("string"))).otherwise(F.col("unit_id"))
    put = {"unit_id": unit_id, "ord": F.col("ord") + F.coalesce("part", F.lit(0)) / 1000, "text": F.coalesce("p.text", "text")}
    return split.select(
        *(put[c].alias(c) if c in put else F.col(f"`{c}`") for c in units.columns),
        F.when(later, F.col("unit_id")).alias("parent_id"), F.col("unit_id").alias("source_id"), F.col("p.number").alias("number"), F.col("p.level").alias("level"),
    )


def content_bottom(captions: DataFrame, blocks: DataFrame, page_height: float) -> DataFrame:
    """doc_id, caption_id, bottom: the lowest end of a block at least 18 above the caption, null if there is none.

    Blocks in the page's top 8 % do not count, nor those that overlap less than a quarter of the narrower one sideways.
    """
    a, b = captions.alias("a"), blocks.alias("b")
    end = F.col("b.y") + F.col("b.h")
    overlap = F.greatest(F.lit(0.0), F.least(F.col("b.x") + F.col("b.w"), F.col("a.x") + F.col("a.w")) - F.greatest("b.x", "a.x"))
    above = (end <= F.col("a.y") - 18) & (F.col("b.y") >= page_height * 0.08) & (overlap / F.greatest(F.lit(1.0), F.least("b.w", "a.w")) >= 0.25)
    same_page = (F.col("a.doc_id") == F.col("b.doc_id")) & (F.col("a.page") == F.col("b.page")) & (F.col("a.caption_id") != F.col("b.block_id"))
    return a.join(b, same_page & above, "left").groupBy("a.doc_id", "a.caption_id").agg(F.max(end).alias("bottom"))
