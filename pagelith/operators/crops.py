"""Crops of figures, tables and code moved off the text around them, answers about formulas, and issues of regions.

regions(doc_id, region_id, kind, page, x, y, w, h); lines and blocks have doc_id, page and a rectangle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelith.functions.prose import EDGE_L, EDGE_R
from pagelith.functions.text import strip, structural_numbers
from pagelith.operators.preparation import _beside, _span
from pagelith.operators.rewrites import bind, n_words
from pagelith.operators.rewrites import lines as lines_of

# Fixed values.
STRAY_GLYPH = "[\\u0700-\\u08ff\\u0a80-\\u0bff]"
LABEL = rf"(?i)^(?:def\s+\w+\s*\(|return{EDGE_R}|pre-?processing{EDGE_R})|^(?-i:[A-Z][A-Z0-9-]*)(?:\s+(?-i:[A-Z][A-Z0-9-]*)){{0,5}}$|^(?:POLY|MSM|INTT|NTT|PMULT|PADD|PDBL|MUX)(?:\s+.*)?$"
CHART_TERM = rf"(?i){EDGE_L}(?:proportion|speedup|benchmark|mod(?:add|reduce|exp|inv)|mmac|rsa|json|tendermint|trace generation){EDGE_R}"
UNSAFE_LATEX = r"(?i)\\(?:documentclass|begin\s*\{document\}|input|include|write|html)"
CORRECTABLE = ("caption-unmatched", "caption-overlap", "foreign-caption-overlap", "page-edge-touch", "page-coverage-excessive")
REJECTABLE = ("body-prose-density", "implausible-formula-cluster")
LAYOUT_POLICY, LAYOUT_PROFILE = "single-column", "zh-single-column-v1"


def region_lines(regions: DataFrame, lines: DataFrame) -> DataFrame:
    """regions with `ls`, the lines that each meets, from top to bottom: structs (y, bottom, text)."""
    line = F.struct(F.col("b.y").alias("y"), (F.col("b.y") + F.col("b.h")).alias("bottom"), F.col("b.text").alias("text"))
    meets = (_span("a", "b", "x", "w") > 0) & (_span("a", "b", "y", "h") > 0)
    met = _beside(regions, lines).where(meets).groupBy("a.doc_id", "a.region_id").agg(F.sort_array(F.collect_list(line)).alias("ls"))
    none = F.array().cast(met.schema["ls"].dataType)
    return regions.join(met, ["doc_id", "region_id"], "left").withColumn("ls", F.coalesce("ls", none))


def _with_top(top: Column) -> Column:
    """struct(y, h) of a region that begins at top, if more than 12 is left of it."""
    end = F.col("y") + F.col("h")
    same = F.struct(F.col("y").cast("double").alias("y"), F.col("h").cast("double").alias("h"))
    return F.when(top < end - 12, F.struct(top.alias("y"), (end - top).alias("h"))).otherwise(same)


def _with_end(end: Column, if_: Column) -> Column:
    same = F.struct(F.col("y").cast("double").alias("y"), F.col("h").cast("double").alias("h"))
    return F.when(if_, F.struct(F.col("y").cast("double").alias("y"), (end - F.col("y")).alias("h"))).otherwise(same)


def without_top_furniture(page_height: float) -> Column:
    """Of a figure or table high on its page: below the running head's lines, 4 clear. Reads ls."""
    head = F.filter("ls", lambda l: (l["y"] < page_height * 0.1) & (l["y"] < F.col("y") + 40) & (n_words(l["text"]) >= 4) & (F.length(strip(l["text"])) >= 24))
    top = F.array_max(F.transform(head, lambda l: l["bottom"])) + 4
    return _with_top(F.when(F.col("kind").isin("figure", "table") & (F.col("y") <= page_height * 0.12), top))


def without_trailing_prose() -> Column:
    """Of a table or code: down to the last line before prose that white space of 4 parts from it, after three lines at least. Reads ls."""
    few = F.when(F.col("kind") == "table", 7).otherwise(4)

    def prose(l: Column, i: Column) -> Column:
        before = F.get("ls", i - 1)["bottom"]
        like = (n_words(l["text"]) >= few) | ((n_words(l["text"]) >= 3) & l["text"].rlike(r"[.!?]\s*$"))
        return (i >= 3) & (l["y"] - before >= 4) & like & (F.least(F.col("y") + F.col("h"), before + 2) > F.col("y") + 12)

    at = F.array_position(F.transform("ls", prose), True).cast("int")
    end = F.least(F.col("y") + F.col("h"), F.get("ls", at - 2)["bottom"] + 2)
    return _with_end(end, F.col("kind").isin("table", "code") & (F.size("ls") >= 4) & (at > 0))


def without_caption_rest() -> Column:
    """Of a table: below the lines, three at most, in which its caption goes on. Reads ls."""
    head = F.slice("ls", 1, 3)

    def goes_on(l: Column, i: Column) -> Column:
        text = strip(F.regexp_replace(l["text"], r"\s+", " "))
        top = F.when(i == 0, F.col("y")).otherwise(F.get("ls", i - 1)["bottom"] + 3)
        words, numbers = (F.size(F.regexp_extract_all(text, F.lit(p), F.lit(0))) for p in ("[A-Za-z]{2,}", r"\d+(?:[.]\d+)?"))
        return (l["y"] - top <= 18) & (words >= 4) & (numbers <= 2) & (text.rlike(r"^[\p{Ll}(]") | text.rlike(r"[.!?]\s*$"))

    stop = F.array_position(F.transform(head, goes_on), False).cast("int")
    n = F.when(stop == 0, F.size(head)).otherwise(stop - 1)
    return _with_top(F.when((F.col("kind") == "table") & (n > 0), F.get("ls", n - 1)["bottom"] + 3))


def cut_at_captions(regions: DataFrame, captions: DataFrame) -> DataFrame:
    """Tables end 3 above the next caption(doc_id, page, block_id, x, y, w, h) inside them that is not their own (caption_id)."""
    inside = (F.col("a.kind") == "table") & (_span("a", "b", "x", "w") > 0) & (F.col("b.y") > F.col("a.y") + 12) & (F.col("b.y") < F.col("a.y") + F.col("a.h"))
    own = F.coalesce(F.col("b.block_id") == F.col("a.caption_id"), F.lit(False))
    next_ = _beside(regions, captions).where(inside & ~own).groupBy("a.doc_id", "a.region_id").agg(F.min("b.y").alias("next"))
    out = regions.join(next_, ["doc_id", "region_id"], "left")
    return out.withColumn("h", F.when(F.col("next") - 3 > F.col("y") + 12, F.col("next") - 3 - F.col("y")).otherwise(F.col("h"))).drop("next")


def clear_of_text_above(regions: DataFrame, blocks: DataFrame) -> DataFrame:
    """Figures begin 6 below the lowest of blocks (no captions, no labels) that ends at their top edge, 4 above to 2 below it."""
    end = F.col("b.y") + F.col("b.h")
    touching = (F.col("a.kind") == "figure") & (_span("a", "b", "x", "w") > 0) & (end >= F.col("a.y") - 4) & (end <= F.col("a.y") + 2)
    low = _beside(regions, blocks).where(touching).groupBy("a.doc_id", "a.region_id").agg(F.max(end).alias("low"))
    return regions.join(low, ["doc_id", "region_id"], "left").withColumn("c", _with_top(F.col("low") + 6)).withColumn("y", F.col("c.y")).withColumn("h", F.col("c.h")).drop("c", "low")


def without_label_cluster(text: Column) -> Column:
    """A diagram's labels at the end of prose go: from the first stray glyph on with the labels before it, or six short lines with numbers and chart terms."""
    is_label = lambda l: (F.length(l) <= 64) & (l != "") & ~l.rlike(r"[.!?;:]\s*$") & l.rlike(LABEL)
    short = lambda l: (l != "") & (F.length(l) <= 42) & ~l.rlike(r"[.!?;:]\s*$") & ((F.size(F.regexp_extract_all(l, F.lit("[A-Za-z][A-Za-z0-9_.-]*"), F.lit(0))) <= 5) | l.rlike(r"^[\d\s.,%+\-×]+$"))

    def tail_run(ls: Column, like) -> Column:
        """How many of the last lines are like that."""
        stop = F.array_position(F.transform(F.reverse(ls), lambda l: like(strip(l))), False).cast("int")
        return F.when(stop == 0, F.size(ls)).otherwise(stop - 1)

    def cut(ls: Column) -> Column:
        stray = F.array_position(F.transform(ls, lambda l: l.rlike(STRAY_GLYPH)), True).cast("int")
        before = F.slice(ls, F.lit(1), F.greatest(stray - 1, F.lit(0)))
        head = lambda n: strip(F.array_join(F.slice(ls, F.lit(1), n), "\n"))
        n = tail_run(F.slice(ls, F.lit(2), F.size(ls)), short)
        tail = F.slice(ls, F.size(ls) - n + 1, n)
        chart = (F.size(ls) >= 7) & (n >= 6) & (F.size(F.filter(tail, lambda l: l.rlike("[0-9]"))) >= 3) & F.exists(tail, lambda l: l.rlike(CHART_TERM))
        return F.when(stray > 1, head(F.size(before) - tail_run(before, is_label))).when(chart, head(F.size(ls) - n)).otherwise(text)

    return bind(lines_of(text), cut)


def formula_answer(answer: Column) -> Column:
    """A model's JSON (fenced or not) as struct(latex, confidence), null if it is not usable.

    The formula loses its dollar signs and must have 3 to 1200 characters and no command that
    reads or writes files; a confidence up to 100 is a percentage.
    """
    fenced = F.regexp_extract(strip(answer), r"(?is)^```(?:json)?\s*(.*?)\s*```$", 1)
    parsed = F.from_json(F.when(fenced != "", fenced).otherwise(strip(answer)), "struct<latex:string,confidence:string>")
    latex = strip(F.regexp_replace(strip(parsed["latex"]), r"^\$+|\$+$", ""))
    raw = parsed["confidence"].try_cast("double")
    confidence = F.when((raw > 1) & (raw <= 100), raw / 100).otherwise(raw)
    good = F.length(latex).between(3, 1200) & ~latex.rlike(UNSAFE_LATEX) & confidence.between(0, 1)
    return F.when(good, F.struct(latex.alias("latex"), confidence.alias("confidence")))


def is_correctable(reason: Column) -> Column:
    return reason.isin(*CORRECTABLE)


def region_issues(unresolved: DataFrame, regions: DataFrame) -> DataFrame:
    """Errors of unresolved(doc_id, page, region_id, reason): code, fields that a patch may change, and a fingerprint on a grid of 10."""
    boxed = F.when(F.col("reason").isin("caption-unmatched", "caption-overlap"), F.array(*map(F.lit, ["bbox", "captionBBox", "captionLink"])))
    fields = boxed.when(is_correctable(F.col("reason")), F.array(F.lit("bbox"))).otherwise(F.array().cast("array<string>"))
    grid = [(F.floor(F.col(c) / 10 + 0.5) * 10).cast("long").cast("string") for c in ("x", "y", "w", "h")]
    joined = unresolved.join(regions.select("doc_id", "page", "region_id", "x", "y", "w", "h"), ["doc_id", "page", "region_id"])
    return joined.select(
        "doc_id", "page", "region_id", F.concat(F.lit("source-plan."), "reason").alias("code"), fields.alias("fields"),
        F.concat_ws("|", F.col("page").cast("string"), "reason", F.col("region_id").cast("string"), *grid).alias("fingerprint"),
    )


def without_rejected(regions: DataFrame, unresolved: DataFrame) -> DataFrame:
    """regions without those that a local proof shows to be none."""
    return regions.join(unresolved.where(F.col("reason").isin(*REJECTABLE)).select("doc_id", "page", "region_id"), ["doc_id", "page", "region_id"], "left_anti")


def rejections(regions: DataFrame, unresolved: DataFrame) -> DataFrame:
    """The actions that without_rejected records: doc_id, page, region_id, action, reason."""
    gone = unresolved.where(F.col("reason").isin(*REJECTABLE)).join(regions.select("doc_id", "page", "region_id"), ["doc_id", "page", "region_id"], "left_semi")
    return gone.select("doc_id", "page", "region_id", F.lit("remove-rejected-region").alias("action"), "reason")


def asset_manifest(assets: DataFrame) -> DataFrame:
    """assets(asset_id, kind, bytes, width_mode, caption_id) with content hashes in place of the bytes; a lane's width where none is given."""
    return assets.select("asset_id", "kind", F.sha2("bytes", 256).alias("sha256"), F.coalesce("width_mode", F.lit("column")).alias("width_mode"), "caption_id")


def uses_current_layout(policy: Column, profile: Column) -> Column:
    return F.coalesce((policy == LAYOUT_POLICY) & (profile == LAYOUT_PROFILE), F.lit(False))


def stand_in_translation(kind: Column, text: Column) -> Column:
    """A made-up target for trials: it keeps a heading's number, a caption's label and every number of the source."""
    source = strip(text)
    label = r"(?i)^(fig(?:ure)?\.?|table|algorithm)\s*([0-9]+)"
    name = F.lower(F.regexp_extract(source, label, 1))
    sign = F.when(name.startswith("fig"), "图").when(name.startswith("table"), "表").otherwise("算法")
    caption = F.when(source.rlike(label), F.concat(sign, F.lit(" "), F.regexp_extract(source, label, 2), F.lit("：模拟说明")))
    caption = caption.when(source.rlike("^[图表]\\s*[0-9]+"), F.concat(F.regexp_extract(source, "^([图表])", 1), F.lit(" "), F.regexp_extract(source, "^[图表]\\s*([0-9]+)", 1), F.lit("：模拟说明")))
    made = (
        F.when(kind == "title", "结构保真的模拟论文标题").when(kind == "authors", "模拟作者与机构信息")
        .when(kind == "abstract", "摘要——本文研究零知识虚拟机（Zero-Knowledge Virtual Machine, zkVM）的硬件加速。")
        .when(kind == "section", F.regexp_replace(source, r"^([0-9]+(?:\.[0-9]+)*+).*", "$1 节")).when(kind == "caption", caption.otherwise("模拟图表说明")).otherwise("结构保真的模拟译文。")
    )
    lost = F.array_except(structural_numbers(source), structural_numbers(made))
    return F.when(F.size(lost) > 0, F.concat(made, F.lit("（保留数字："), F.array_join(lost, "、"), F.lit("）"))).otherwise(made)


def recovery_instruction(reason: Column, codes: Column, details: Column) -> Column:
    """What a repeated request says of the answer that failed; empty without a reason."""
    listed = lambda a, sep: F.when(F.size(a) > 0, F.array_join(a, sep)).otherwise("none")
    residual = F.when(
        F.array_contains(codes, "untranslated-residual"),
        "UNTRANSLATED_RESIDUAL_FIX: Translate every ordinary lowercase English word named by the validation details into Chinese.\n"
        "Do not copy those rejected words into the target unless they are protected tokens, identifiers, names, or standard abbreviations.",
    )
    whole = F.concat_ws(
        "\n", F.lit("RECOVERY_REQUEST: Correct the previous failed block and return the complete JSON response again."), F.concat(F.lit("RECOVERY_REASON: "), reason),
        F.concat(F.lit("VALIDATION_CODES: "), listed(codes, ", ")), F.concat(F.lit("VALIDATION_DETAILS: "), listed(details, " | ")), residual,
        F.lit("Preserve every protected_tokens item exactly, satisfy every alignment requirement, and do not omit content."),
    )
    return F.when(reason.isNull(), "").otherwise(whole)
