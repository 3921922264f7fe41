"""Benchmark decontamination by template canonicalisation, in DataFrame expressions only.

Numbers, units and names become typed placeholders; windows of template tokens are
hashed and joined with the benchmark's; only keys and places go through that join.
Where a window meets, the whole item is laid beside the document: tokens are compared
one by one, and slots must map one to one, so a question asked with other values is
caught and a mere likeness of form is not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelith.llm.common import materialise, row_keys

WINDOW = 4
COVERAGE = 0.6
#: With fewer literal tokens than this beside the document, slots must hold equal values.
EVIDENCE = 2
#: Benchmark windows, and places where they were met, are broadcast up to this many rows of a few numbers; beyond, they are joined by shuffle.
BROADCAST_ROWS = 1_000_000
#: Benchmark texts are broadcast up to this many bytes.
BROADCAST_BYTES = 32 << 20

NUMBER, UNIT, NAME = "", "", ""
UNITS = (
    "km|cm|mm|nm|m|kg|mg|g|lb|lbs|oz|ml|l|ms|s|sec|seconds?|min|minutes?|h|hours?|days?|weeks?|months?|years?|miles?|"
    "feet|foot|ft|inch|inches|yards?|percent|%|dollars?|euros?|pounds?|cents?|usd|eur|gbp|hz|khz|mhz|ghz|kb|mb|gb|tb|w|kw|v|degrees?"
)
SPACE = " \t\n\x0b\x0c\r"


def template_text(text: Column) -> Column:
    """Text with placeholders, lower-cased, without punctuation; white space stays, so tokens stay aligned.

    Repeated groups are possessive: a list of any length is matched in a loop, not by recursion.
    """
    own = F.lit(False)
    for c in (NUMBER, UNIT, NAME):
        own = own | text.contains(c)
    t = F.when(own, F.translate(text, NUMBER + UNIT + NAME, "")).otherwise(text)
    # the look ahead fails at most places at once, before the look behind is tried
    t = F.regexp_replace(t, r"(?=[-+0-9])(?<![\p{L}\p{N}_])[+-]?[0-9]++(?:[.,:/][0-9]++)*+", NUMBER)
    t = F.regexp_replace(t, rf"(?i)({NUMBER} ?)(?:{UNITS})(?![\p{{L}}\p{{N}}])", f"$1{UNIT}")
    t = F.regexp_replace(t, rf"(?=\p{{Lu}}\p{{Ll}})(?<=[\p{{Ll}}\p{{N}}{NUMBER},;] )\p{{Lu}}\p{{Ll}}[\p{{L}}'’-]*+", NAME)
    t = F.regexp_replace(F.lower(t), rf"[^\p{{L}}\p{{N}}{NUMBER}{UNIT}{NAME}\s]+", "")
    return F.btrim(t, F.lit(SPACE))


def plain_text(text: Column) -> Column:
    """The same tokens with their own values."""
    return F.btrim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}\s]+", ""), F.lit(SPACE))


def tokens(text: Column) -> Column:
    return F.split(text, r"\s+")


def width_of(n: int, window: int = WINDOW, coverage: float = COVERAGE) -> int:
    """Width of the windows of an item of n tokens: a run that is left whichever one token is changed, if one may be."""
    return min(window, n // 2 if n - 1 >= coverage * n else n)


def _windows(df: DataFrame, toks: Column, widths: list[int]) -> DataFrame:
    """df without its texts, with n (tokens) and ws: hashes of the windows at all n positions, one width after the other.

    A window's hash is made of those of two shorter ones. Windows that the end cuts short
    have hashes too, which equal no whole window's. Explode ws with an outer generator: for
    an inner one the optimiser would filter on its size first, and copy what makes it.
    """
    split = lambda k: 1 << ((k - 1).bit_length() - 1)  # noqa: E731  the first of the two
    needed, todo = {1}, list(widths)
    while todo:
        k = todo.pop()
        if k not in needed:
            needed.add(k)
            todo += [split(k), k - split(k)]
    df = df.withColumn("w1", F.transform(toks, lambda t: F.xxhash64(t))).drop("text")
    for k in sorted(needed - {1}):
        first, rest = split(k), F.col(f"w{k - split(k)}")
        df = df.withColumn(f"w{k}", F.transform(f"w{first}", lambda x, i: F.xxhash64(x, F.get(rest, i + first))))  # noqa: B023
    ws = F.concat(*(F.col(f"w{k}") for k in widths))
    return df.withColumn("n", F.size("w1")).withColumn("ws", ws).drop(*(f"w{k}" for k in needed))


def is_slot(token: Column) -> Column:
    return token.contains(NUMBER) | token.contains(UNIT) | token.contains(NAME)


def _laid(dt: Column, dr: Column, shift: Column) -> Column:
    """Item positions whose template tokens stand in the document at the shift; none without evidence (see leaks)."""
    there = lambda i: shift + i
    matched = F.filter(
        F.sequence(F.lit(0), F.size("it") - 1),
        lambda i: (there(i) >= 0) & (there(i) < F.size(dt)) & (F.get("it", i) == F.get(dt, there(i))),
    )

    def evident(m: Column) -> Column:
        literals = F.size(F.filter(m, lambda i: ~is_slot(F.get("it", i))))
        return F.when(literals >= EVIDENCE, m).when(literals > 0, F.filter(m, lambda i: F.get("ir", i) == F.get(dr, there(i)))).otherwise(F.array().cast("array<int>"))

    def consistent(m: Column) -> Column:
        slots = F.filter(m, lambda i: is_slot(F.get("it", i)))
        count = lambda f: F.size(F.array_distinct(F.transform(slots, f)))
        pairs = count(lambda i: F.struct(F.get("ir", i), F.get(dr, there(i))))
        own, theirs = count(lambda i: F.get("ir", i)), count(lambda i: F.get(dr, there(i)))
        return F.when((pairs == own) & (pairs == theirs), m).otherwise(F.array().cast("array<int>"))

    for step in (evident, consistent):
        matched = F.element_at(F.transform(F.array(matched), step), 1)
    return matched


def leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, coverage: float = COVERAGE) -> DataFrame:
    """k1, k2 (row key), item_id, coverage of the items found in each document.

    An item is found if its slots map one to one and at least `coverage` of its tokens
    stand in the document, each beside its neighbours, a run of `window` of them unbroken
    (n // 2 in an item of n < 2 * window tokens) that holds a literal token. Windows are
    made at every position, so the offset does not matter. With k tokens changed such a
    run is left wherever they stand if n >= window * (k + 1); a copy with more changes,
    each less than a window from the next, is not met. What stands at several shifts is
    put together, but not single tokens: items of less than 4 tokens must reach the
    coverage at one shift. Slots alone are no evidence: where fewer than EVIDENCE literal
    tokens of an item stand at a shift, slots count only with equal values, and an item of
    slots only ("42") is found nowhere. An item of one literal token is found where that
    token stands. Null and empty texts and items match nothing; rows that repeat are found
    alike. Whole texts of any length are read; the join carries a key and a place.
    """
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    items = items.select("item_id", tokens(template_text(F.col("text"))).alias("it"), tokens(plain_text(F.col("text"))).alias("ir")).where(
        F.element_at("it", 1) != ""
    )
    shape = items.agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("it")).alias("size"), F.sum(F.length(F.array_join("ir", " "))).alias("bytes")).first()
    width = F.least(F.lit(window), F.when(F.size("it") - 1 >= coverage * F.size("it"), F.floor(F.size("it") / 2)).otherwise(F.size("it"))).cast("int")
    # at most `window` numbers
    widths = sorted({r["w"] for r in items.select(width.alias("w")).distinct().collect()} or {window})
    literal = F.exists(F.slice("it", F.col("ipos") + 1, F.col("width")), lambda t: ~is_slot(t))
    wins = (
        _windows(items.withColumn("width", width), F.col("it"), widths)
        .select("item_id", "it", "n", "width", F.posexplode_outer("ws").alias("p", "hash"))
        .select("item_id", "it", "n", "width", "hash", (F.col("p") % F.col("n")).alias("ipos"), F.get(F.lit(widths), F.floor(F.col("p") / F.col("n")).cast("int")).alias("of"))
        .where((F.col("of") == F.col("width")) & (F.col("ipos") + F.col("width") <= F.col("n")))
        .where(literal)
        .select("item_id", "ipos", "hash")
        .distinct()
    )
    small = (shape["size"] or 0) <= BROADCAST_ROWS
    texts_small = 4 * (shape["bytes"] or 0) <= BROADCAST_BYTES
    wins = F.broadcast(wins) if small else wins
    items = F.broadcast(items) if texts_small else items

    keyed = row_keys(docs)
    spots = _windows(keyed.select("k1", "k2", "text"), tokens(template_text(F.col("text"))), widths)
    met = (
        spots.select("k1", "k2", "n", F.posexplode_outer("ws").alias("p", "hash"))
        .join(wins, "hash")
        .groupBy("k1", "k2", "item_id")
        .agg(F.collect_set(F.col("p") % F.col("n") - F.col("ipos")).alias("shifts"))
    )
    met = materialise(met, "met")
    places = met.agg(F.sum(F.size("shifts") + 4)).first()[0] or 0
    met = F.broadcast(met) if places <= BROADCAST_ROWS else met
    # one array element binds the document's tokens, so that they are split once
    sides = F.array(F.struct(tokens(template_text(F.col("text"))).alias("dt"), tokens(plain_text(F.col("text"))).alias("dr")))
    laid = F.element_at(F.transform(sides, lambda x: F.transform("shifts", lambda s: _laid(x["dt"], x["dr"], s))), 1)
    found = keyed.select("k1", "k2", "text").join(met, ["k1", "k2"]).join(items, "item_id").select("k1", "k2", "item_id", F.size("it").alias("of"), laid.alias("laid"))
    at_one = F.array_max(F.transform("laid", lambda m: F.size(m)))
    return (
        found.select("k1", "k2", "item_id", (F.when(F.col("of") < 4, at_one).otherwise(F.size(F.array_distinct(F.flatten("laid")))) / F.col("of")).alias("coverage"))
        .where(F.col("coverage") >= coverage)
        .groupBy("k1", "k2", "item_id")
        .agg(F.max("coverage").alias("coverage"))
    )


def judge(docs: DataFrame, benchmark: DataFrame, **parameters) -> DataFrame:
    """One row per input row: doc_id, contaminated, n_items, item_ids (sorted), coverage (the best, or 0).

    Rows that repeat get equal rows; null text, an empty benchmark or an empty table
    leave nothing to find. Only doc_id and text (item_id and text) are read, so other
    columns cannot clash.
    """
    found = leaks(docs, benchmark, **parameters).groupBy("k1", "k2").agg(F.sort_array(F.collect_set("item_id")).alias("item_ids"), F.max("coverage").alias("coverage"))
    own = row_keys(docs).select("k1", "k2", "doc_id")
    return own.join(found, ["k1", "k2"], "left").select(
        "doc_id",
        F.isnotnull("item_ids").alias("contaminated"),
        F.when(F.isnotnull("item_ids"), F.size("item_ids")).otherwise(0).cast("long").alias("n_items"),
        F.coalesce("item_ids", F.array().cast("array<bigint>")).alias("item_ids"),
        F.coalesce("coverage", F.lit(0.0)).alias("coverage"),
    )


def op3_decontamination(spark, sf_dir: str) -> DataFrame:
    """judge() of all documents against all benchmark items: rows, nulls, ties and empty tables as there."""
    return judge(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
