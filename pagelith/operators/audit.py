"""Rule audit of a source and a target document, rule by rule.

Blocks: doc_id, block_id, type, text, ord. Pairs: doc_id, source_id, target_id, text.
Terms: doc_id, term, abbr. Issues: doc_id, rule, severity, block_id, detail. Every rule
is partial aggregation by doc_id or an anti join on (doc_id, block_id).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelith.functions import text as T

COUNTED = ("figure", "table", "equation", "reference")
UNPAIRED_TYPES = ("figure", "table", "equation")


def _issue(df: DataFrame, rule: str, severity: Column | str, block: Column | None = None, detail: Column | None = None) -> DataFrame:
    return df.select(
        "doc_id", F.lit(rule).alias("rule"), (F.lit(severity) if isinstance(severity, str) else severity).alias("severity"),
        (block if block is not None else F.lit(None).cast("string")).alias("block_id"), (detail if detail is not None else F.lit("")).alias("detail"),
    )


def _ordered(blocks: DataFrame, value: Column, name: str) -> DataFrame:
    """Non-null values in block order, one array per document."""
    pairs = F.sort_array(F.collect_list(F.when(value.isNotNull(), F.struct(F.col("ord"), value.alias("v")))))
    return blocks.groupBy("doc_id").agg(F.transform(pairs, lambda p: p["v"]).alias(name))


def _sides(a: DataFrame, b: DataFrame, name: str) -> DataFrame:
    empty = F.array().cast("array<string>")
    both = a.withColumnRenamed(name, "s").join(b.withColumnRenamed(name, "t"), "doc_id", "full_outer")
    return both.select("doc_id", F.coalesce("s", empty).alias("s"), F.coalesce("t", empty).alias("t"))


def label_sequence(source: DataFrame, target: DataFrame) -> DataFrame:
    """R1: figure, table and equation labels must be the same sequence."""
    label = T.numbered_label(F.col("text"))
    both = _sides(_ordered(source, label, "v"), _ordered(target, label, "v"), "v")
    return _issue(both.where(F.col("s") != F.col("t")), "R1", "error", detail=F.concat_ws("|", F.array_join("s", ","), F.array_join("t", ",")))


def section_sets(source: DataFrame, target: DataFrame) -> DataFrame:
    """R2: section numbers of either side must be on the other."""
    number = F.when(F.col("type") == "section", T.section_number(F.trim("text")))
    both = _sides(_ordered(source, number, "v"), _ordered(target, number, "v"), "v")
    keep = lambda a, b: F.filter(a, lambda v: ~F.array_contains(F.col(b), v))
    both = both.withColumn("missing", keep("s", "t")).withColumn("extra", keep("t", "s"))
    wrong = both.where((F.size("missing") > 0) | (F.size("extra") > 0))
    return _issue(wrong, "R2", "error", detail=F.concat_ws("|", F.array_join("missing", ","), F.array_join("extra", ",")))


def type_counts(source: DataFrame, target: DataFrame) -> DataFrame:
    """R3: as many figures, tables, equations and references on both sides."""
    one = lambda df, sign: df.where(F.col("type").isin(*COUNTED)).select("doc_id", "type", F.lit(sign).alias("n"))
    both = one(source, 1).unionByName(one(target, -1)).groupBy("doc_id", "type").agg(F.sum("n").alias("n"))
    return _issue(both.where("n <> 0"), "R3", "error", detail=F.concat_ws(":", "type", F.col("n").cast("string")))


def unpaired(source: DataFrame, pairs: DataFrame, allowed: DataFrame | None = None) -> DataFrame:
    """Text blocks without a pair; allowed (doc_id, block_id) only warn."""
    text_blocks = source.where(~F.col("type").isin(*UNPAIRED_TYPES)).select("doc_id", "block_id")
    paired = pairs.select("doc_id", F.col("source_id").alias("block_id")).distinct()
    missing = text_blocks.join(paired, ["doc_id", "block_id"], "left_anti")
    if allowed is not None:
        missing = missing.join(allowed.select("doc_id", "block_id", F.lit(True).alias("ok")).distinct(), ["doc_id", "block_id"], "left")
    severity = F.when(F.col("ok"), "warn").otherwise("error") if allowed is not None else "error"
    return _issue(missing, "R4", severity, F.col("block_id"), F.lit("unpaired"))


def pairing(source: DataFrame, pairs: DataFrame, allowed: DataFrame | None = None) -> DataFrame:
    """R4: every text block has a translation that is not empty."""
    empty = pairs.where(F.length(F.trim(F.coalesce("text", F.lit("")))) == 0)
    return unpaired(source, pairs, allowed).unionByName(_issue(empty, "R4", "error", F.col("source_id"), F.lit("empty")))


def formula_marks(source: DataFrame, target: DataFrame, pairs: DataFrame, tolerance: int = 2) -> DataFrame:
    """R5: the number of dollar signs; target text counts in blocks and in pairs."""
    n = F.length("text") - F.length(F.replace("text", F.lit("$"), F.lit("")))
    one = lambda df, side: df.select("doc_id", F.lit(side).alias("side"), F.coalesce(n, F.lit(0)).alias("n"))
    all_ = one(source, 1).unionByName(one(target, 0)).unionByName(one(pairs, 0))
    sums = all_.groupBy("doc_id").agg(F.sum(F.when(F.col("side") == 1, F.col("n")).otherwise(0)).alias("s"), F.sum(F.when(F.col("side") == 0, F.col("n")).otherwise(0)).alias("t"))
    return _issue(sums.where(F.abs(F.col("s") - F.col("t")) > tolerance), "R5", "warn", detail=F.concat_ws(":", F.col("s").cast("string"), F.col("t").cast("string")))


def abbreviations(target: DataFrame, pairs: DataFrame, terms: DataFrame) -> DataFrame:
    """R6: a term's abbreviation stands somewhere in the target."""
    texts = target.select("doc_id", "text").unionByName(pairs.select("doc_id", "text"))
    wanted = terms.where(F.length("abbr") > 0).select("doc_id", "term", "abbr")
    seen = texts.join(wanted, "doc_id").where(F.contains(F.coalesce("text", F.lit("")), F.col("abbr"))).select("doc_id", "term", "abbr").distinct()
    return _issue(wanted.join(seen, ["doc_id", "term", "abbr"], "left_anti"), "R6", "warn", detail=F.col("abbr"))


def pollution(pairs: DataFrame) -> DataFrame:
    """R7: a translator's remarks or refusals in a translation."""
    return _issue(pairs.where(F.coalesce("text", F.lit("")).rlike(T.POLLUTION)), "R7", "error", F.col("source_id"))


def missing_numbers(source: DataFrame, target: DataFrame, pairs: DataFrame) -> DataFrame:
    """R8: numbers of the source, by value, that the target lacks; detail is how many."""
    values = lambda df: df.select("doc_id", F.explode(T.numbers(F.coalesce("text", F.lit("")))).alias("v")).distinct()
    there = values(target).unionByName(values(pairs)).distinct()
    missing = values(source).join(there, ["doc_id", "v"], "left_anti").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    return _issue(missing, "R8", "warn", detail=F.col("n").cast("string"))


def _dollars() -> Column:
    return F.coalesce(F.length("text") - F.length(F.replace("text", F.lit("$"), F.lit(""))), F.lit(0))


def _profile(blocks: DataFrame, side: str) -> DataFrame:
    """All that R1, R2, R3, R5 and R8 need of a side, one row per document."""
    ordered = lambda v: F.transform(F.sort_array(F.collect_list(F.when(v.isNotNull(), F.struct(F.col("ord"), v.alias("v"))))), lambda p: p["v"])
    section = F.when(F.col("type") == "section", T.section_number(F.trim("text")))
    return blocks.groupBy("doc_id").agg(
        ordered(T.numbered_label(F.col("text"))).alias(f"{side}_labels"), ordered(section).alias(f"{side}_sections"), F.sum(_dollars()).alias(f"{side}_dollars"),
        F.array_distinct(F.flatten(F.collect_list(T.numbers(F.coalesce("text", F.lit("")))))).alias(f"{side}_numbers"),
        *(F.count_if(F.col("type") == t).alias(f"{side}_{t}") for t in COUNTED),
    )


def rule_audit(source: DataFrame, target: DataFrame, pairs: DataFrame, terms: DataFrame, allowed: DataFrame | None = None) -> DataFrame:
    """All issues of R1 to R8: the rules above, with each side aggregated once and joined by document."""
    text = F.coalesce("text", F.lit(""))
    p = pairs.groupBy("doc_id").agg(
        F.sum(_dollars()).alias("p_dollars"), F.array_distinct(F.flatten(F.collect_list(T.numbers(text)))).alias("p_numbers"),
        F.collect_list(F.when(text.rlike(T.POLLUTION), F.col("source_id"))).alias("polluted"), F.collect_list(F.when(F.length(F.trim(text)) == 0, F.col("source_id"))).alias("empty"),
    )
    d = _profile(source, "s").join(_profile(target, "t"), "doc_id", "full_outer").join(p, "doc_id", "full_outer")
    strings, doubles = (lambda c: F.coalesce(c, F.array().cast("array<string>"))), (lambda c: F.coalesce(c, F.array().cast("array<double>")))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    row = lambda rule, severity, detail, block=None: F.struct(
        F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), (F.lit(None).cast("string") if block is None else block).alias("block_id"), detail.alias("detail")
    )
    beside = lambda a, b: F.concat_ws("|", F.array_join(a, ","), F.array_join(b, ","))
    sl, tl, ss, ts = (strings(F.col(c)) for c in ("s_labels", "t_labels", "s_sections", "t_sections"))
    missing, extra = F.filter(ss, lambda v: ~F.array_contains(ts, v)), F.filter(ts, lambda v: ~F.array_contains(ss, v))
    counts = [F.when(zero(f"s_{t}") != zero(f"t_{t}"), row("R3", "error", F.concat_ws(":", F.lit(t), (zero(f"s_{t}") - zero(f"t_{t}")).cast("string")))) for t in COUNTED]
    s_d, t_d = zero("s_dollars"), zero("t_dollars") + zero("p_dollars")
    lost = F.size(F.array_except(doubles(F.col("s_numbers")), F.array_union(doubles(F.col("t_numbers")), doubles(F.col("p_numbers")))))
    found = F.array_compact(F.array(
        F.when(sl != tl, row("R1", "error", beside(sl, tl))), F.when((F.size(missing) > 0) | (F.size(extra) > 0), row("R2", "error", beside(missing, extra))), *counts,
        F.when(F.abs(s_d - t_d) > 2, row("R5", "warn", F.concat_ws(":", s_d.cast("string"), t_d.cast("string")))), F.when(lost > 0, row("R8", "warn", lost.cast("string"))),
    ))
    each = F.concat(
        found, F.transform(strings(F.col("polluted")), lambda b: row("R7", "error", F.lit(""), b)), F.transform(strings(F.col("empty")), lambda b: row("R4", "error", F.lit("empty"), b))
    )
    of_documents = d.select("doc_id", F.explode(each).alias("i")).select("doc_id", "i.rule", "i.severity", "i.block_id", "i.detail")
    return reduce(DataFrame.unionByName, [of_documents, unpaired(source, pairs, allowed), abbreviations(target, pairs, terms)])


def summary(docs: DataFrame, issues: DataFrame) -> DataFrame:
    """errors, warns and pass of each document (no error)."""
    counts = issues.groupBy("doc_id").agg(
        F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warn").alias("warns")
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    out = docs.select("doc_id").distinct().join(counts, "doc_id", "left").select("doc_id", zero("errors"), zero("warns"))
    return out.withColumn("pass", F.col("errors") == 0)


def combine_issues(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def resolve(issues: DataFrame, resolved: DataFrame, keys: list[str]) -> DataFrame:
    """Marks the issues that the keys of resolved name."""
    marks = resolved.select(*keys, F.lit(True).alias("resolved")).distinct()
    return issues.join(marks, keys, "left").withColumn("resolved", F.coalesce("resolved", F.lit(False)))


def approved(issues: DataFrame) -> DataFrame:
    """A document is approved if every error is resolved."""
    return issues.groupBy("doc_id").agg(F.every((F.col("severity") != "error") | F.col("resolved")).alias("approved"))
