"""Checks and repairs of translated text, terms and prompts, as Column expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from pagelith.functions.prose import EDGE_L, EDGE_R
from pagelith.functions.text import needs_translation, occurrences, strip

# Fixed values.
FLATTENED_EXPONENT = r"(?:^|[\s(])(?:pm|nm|μm|µm|mm|cm|dm|m|dam|hm|km|in|ft|yd|mi)\s+([23])(?=$|[\s,.;:)])"
SUPERSCRIPT = {"2": "²", "3": "³"}
ADDRESSES = rf"(?i)https?://\S+|{EDGE_L}\S+@\S+{EDGE_R}"
BRACKETED = "[（(][^()（）]{0,240}[）)]"
LOWERCASE = rf"{EDGE_L}[a-z]{{8,}}(?:-[a-z]{{4,}})*+{EDGE_R}"
TERM = "([一-龥][一-龥A-Za-z· -]{0,30}?)（([A-Za-z][A-Za-z0-9 -]{2,60}?)(?:,\\s*([A-Za-z0-9-]{2,10}))?）"
TERM_LEAD = "^(?:(?:以及|并且|或者|和|与|及|、|,|，)\\s*+)++"
OUTPUT_LIMIT = "DeepSeekOutputLimitError"


def unique_in_order(values: Column) -> Column:
    return F.array_distinct(values)


def flattened_exponents(source: Column) -> Column:
    """The digits that follow a unit of length, as in `mm 2`."""
    return F.array_distinct(F.regexp_extract_all(source, F.lit(FLATTENED_EXPONENT), F.lit(1)))


def exponent_count(source: Column, target: Column, token: Column, count: Column) -> Column:
    """count, and the token's superscripts in the target if the source has it after a unit."""
    sign = F.when(token == "2", "²").when(token == "3", "³")
    return count + F.when(F.array_contains(flattened_exponents(source), token), F.coalesce(occurrences(target, sign), F.lit(0))).otherwise(0)


@pandas_udf(StringType())
def _nfkc(text):
    return text.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


def normal_target(text: Column) -> Column:
    """Compatibility forms made one, white space gone; texts of ASCII letters stay in the engine."""
    whole = F.when(text.rlike(r"^[\x00-\x7F]*$"), text).otherwise(_nfkc(text))
    return F.regexp_replace(whole, "[\\s   　﻿]+", "")


def heading_number_first(kind: Column, source: Column, segment: Column) -> Column:
    """A heading's section number moved to the front of its one target segment, if it stands elsewhere in it."""
    number = F.regexp_extract(source, r"^\s*(\d+(?:\.\d+)*+)" + EDGE_R, 1)
    literal = F.replace(number, F.lit("."), F.lit("\\."))
    inner = F.concat(F.lit(r"(?<![\d.])"), literal, F.lit(r"(?![\d.])"))
    leads = F.rlike(strip(segment), F.concat(F.lit("^"), literal, F.lit(r"(?:\s|[：:、.．])")))
    there = F.rlike(strip(segment), inner)
    at = F.regexp_instr(strip(segment), inner)
    rest = F.concat(F.substr(strip(segment), F.lit(1), at - 1), F.substr(strip(segment), at + F.length(number)))
    moved = F.concat_ws(" ", number, strip(F.regexp_replace(rest, r"\s{2,}", " ")))
    return F.when((kind == "heading") & (number != "") & ~leads & there, strip(moved)).otherwise(segment)


def is_anchored(source: Column, word: Column) -> Column:
    """Does a citation follow the word (of letters and hyphens) at once?"""
    return F.rlike(source, F.concat(F.lit(EDGE_L), word, F.lit(EDGE_R + r"\s*(?:[,;:]\s*)?\[\s*\d+(?:\s*[-,]\s*\d+)*+\s*\]")))


def untranslated_words(kind: Column, source: Column, target: Column) -> Column:
    """Distinct long lower-case words left in the target, but for those that the source cites."""
    prose = F.regexp_replace(F.regexp_replace(target, ADDRESSES, " "), BRACKETED, " ")
    found = F.filter(F.array_distinct(F.regexp_extract_all(prose, F.lit(LOWERCASE), F.lit(0))), lambda w: ~is_anchored(source, w))
    return F.when(needs_translation(kind, source), found).otherwise(F.array().cast("array<string>"))


def terms(text: Column) -> Column:
    """`name（English, ABBR）` as distinct structs (zh, en, abbr), leading conjunctions gone."""
    group = lambda i: F.regexp_extract_all(text, F.lit(TERM), F.lit(i))
    made = F.transform(
        F.arrays_zip(group(1).alias("zh"), group(2).alias("en"), group(3).alias("abbr")),
        lambda t: F.struct(F.regexp_replace(strip(t["zh"]), TERM_LEAD, "").alias("zh"), strip(t["en"]).alias("en"), F.nullif(strip(t["abbr"]), F.lit("")).alias("abbr")),
    )
    named = F.filter(made, lambda t: (t["zh"] != "") & (t["en"] != ""))
    pair = lambda t: F.struct(t["zh"], t["en"])
    keys = F.transform(named, pair)
    return F.filter(named, lambda t, i: F.array_position(keys, pair(t)) == i + 1)


def system_prompt(*parts: Column) -> Column:
    """The parts that are not empty, a blank line between."""
    return F.concat_ws("\n\n", *(F.nullif(p, F.lit("")) for p in parts))


def session_key(base: Column, engine: Column, version: Column) -> Column:
    return F.concat(base, F.lit(":"), engine, F.lit("@"), version)


def is_output_limit(name: Column) -> Column:
    return name == OUTPUT_LIMIT


def blob_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def hash_matches(content: Column, expected: Column) -> Column:
    return F.coalesce(blob_hash(content) == expected, F.lit(False))
