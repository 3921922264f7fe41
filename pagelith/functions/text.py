"""Column predicates and extractors over text: captions, labels, numbers, protected tokens, sentences."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns and word lists that results depend on (fixed values). Word edges are ASCII, hence no \\b.
NUMERAL = r"(?:\d+(?:[.-]\d+)*|[IVXLCDM]+)"
FIGURE_HEAD = rf"(?i)^fig(?:ure)?\.?\s*{NUMERAL}"
FIGURE_SHORT = rf"(?i)^fig[.]\s*{NUMERAL}\s*[.:：\-–—]"
TABLE_HEAD = rf"(?i)^table\s*{NUMERAL}"
ALGORITHM_HEAD = rf"(?i)^algorithm\s*{NUMERAL}"
SENTENCE_AFTER_DOT = r"(?i)^[.]\s+(?:the|this|these|those|it|we|our|a|an)(?![A-Za-z0-9_])"
CAPTION_MARK = r"^[:：.\-–—]"
ALGORITHM_VERB = r"(?i)^(?:is|are|was|were|shows?|presents?|describes?|illustrates?|uses?|contains?|requires?)(?![A-Za-z0-9_])"
# possessive, so that a list of any length is matched in a loop
PROTECTED = r"⟦[^⟧]+⟧|\[\s*(?:\d+(?:\s*+[-,]\s*+\d++)*+)\s*\]|(?<![A-Za-z0-9])[-+]?(?:\d+\.\d+|\d+)(?:%|‰)?"
CITATION = r"^\[\s*(?:\d+(?:\s*+[-,]\s*+\d++)*+)\s*\]$"
NUMERIC = r"^[-+]?(?:\d+\.\d+|\d+)(?:%|‰)?$"
POLLUTION = "翻译说明|译文说明|作为翻译|以下为译文|抱歉,我无法"
FUNCTION_WORDS = (
    "a an and are as at be been by for from has have in into is it of on or that the their these this to was were which with"
).split()
FORMULA_WORDS = r"(?i)(?<![A-Za-z0-9_])(?:the|a|an|and|or|of|to|in|for|with|that|this|is|are|was|were|as|by|from|on|at|if|when|where|whether|we|need)(?![A-Za-z0-9_])"


#: What is trimmed: all white space, not blanks only.
SPACES = " \t\n\x0b\x0c\r\u00a0\u1680\u2028\u2029\u202f\u205f\u3000\ufeff"


def strip(text) -> Column:
    return F.btrim(F.col(text) if isinstance(text, str) else text, F.lit(SPACES))


def caption_suffix_ok(suffix: Column) -> Column:
    """Does what follows a caption's number read as a caption rather than a sentence?"""
    t = F.ltrim(suffix)
    return (
        F.when(F.length(t) == 0, True)
        .when(t.rlike(SENTENCE_AFTER_DOT), False)
        .when(t.rlike(CAPTION_MARK), True)
        .otherwise((F.length(t) < F.length(suffix)) & t.rlike("^[A-Z一-鿿]"))
    )


def _lines_any(text: Column, test) -> Column:
    return F.exists(F.split(text, r"\r?\n"), lambda line: test(strip(line)))


def is_figure_caption(text: Column) -> Column:
    return _lines_any(
        text, lambda t: t.rlike(FIGURE_SHORT) | (t.rlike(FIGURE_HEAD) & caption_suffix_ok(F.regexp_replace(t, FIGURE_HEAD, "")))
    )


def is_table_caption(text: Column) -> Column:
    return _lines_any(text, lambda t: t.rlike(TABLE_HEAD) & caption_suffix_ok(F.regexp_replace(t, TABLE_HEAD, "")))


def is_algorithm_caption(text: Column) -> Column:
    def test(t: Column) -> Column:
        suffix = F.regexp_replace(t, ALGORITHM_HEAD, "")
        s = F.ltrim(suffix)
        body = F.when(F.length(s) == 0, True).when(s.rlike(CAPTION_MARK), True).when(F.length(s) == F.length(suffix), False).otherwise(~s.rlike(ALGORITHM_VERB))
        return t.rlike(ALGORITHM_HEAD) & body

    return _lines_any(text, test)


def is_numbered_caption(text: Column) -> Column:
    return is_figure_caption(text) | is_table_caption(text) | is_algorithm_caption(text)


def is_display_formula(text: Column) -> Column:
    """A centred line that scores as mathematics and does not read as prose."""
    t = F.regexp_replace(strip(text), r"\s+", " ")
    n = lambda p: F.regexp_count(t, F.lit(p))
    words, relations = n("[A-Za-z]{3,}"), n("[=≠≈≤≥<>]")
    variables = n(r"(?:^|[\s,(])[A-Za-z](?:_[A-Za-z0-9]+)?(?=$|[\s,)=+*/^])")
    math = relations * 2 + n("[+*/^{}×÷√∑∫]") + F.least(variables, F.lit(3))
    return (
        F.when((F.length(t) == 0) | (F.length(t) > 180) | (words > 5), False)
        .when((words >= 3) & (n(FORMULA_WORDS) >= 1), False)
        .when((relations > 0) & (math >= 3), True)
        .when(t.rlike(r"(?i)\(\d+[a-z]?\)\s*$") & (math >= 3), True)
        .otherwise((words <= 2) & (math >= 5))
    )


def section_number(text: Column) -> Column:
    """`1.2` of `1.2 Title`, else null."""
    return F.nullif(F.regexp_extract(text, r"^\s*(\d+(?:\.\d+)*)\s", 1), F.lit(""))


def numbered_label(text: Column) -> Column:
    """fig3, tab2 or eq7 by the text's head, else null."""
    t = strip(text)
    part = lambda p, kind: F.when(t.rlike(p), F.concat(F.lit(kind), F.regexp_extract(t, p, 1)))
    return F.coalesce(
        part(r"(?i)^(?:fig(?:ure)?\.?)\s*(\d+)", "fig"), part(r"^图\s*(\d+)", "fig"), part(r"(?i)^(?:table)\s*(\d+)", "tab"), part(r"^表\s*(\d+)", "tab"),
        part(r"^\((\d+)\)\s*$", "eq"),
    )


def anchor_label(kind: Column, text: Column) -> Column:
    """Language-neutral label of a section or caption, else null."""
    t, number = strip(text), section_number(strip(text))
    section = (
        F.when(number.isNotNull(), F.concat(F.lit("sec"), number))
        .when(t.rlike("(?i)^(abstract|摘要)"), F.lit("abstract"))
        .when(t.rlike("(?i)^(references|bibliography|参考文献)"), F.lit("references"))
    )
    label = numbered_label(text)
    return F.when(kind == "section", section).when(label.startswith("fig") | label.startswith("tab"), label)


def numbers(text: Column) -> Column:
    """Numeric literals as doubles, in order."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"\d+(?:\.\d+)?"), F.lit(0)), lambda x: x.cast("double"))


def structural_numbers(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"[-+]?\d+(?:,\d{3})*+(?:\.\d+)?(?:[eE][-+]?\d+)?"), F.lit(0))


def protected_tokens(text: Column) -> Column:
    """Markers, citations and numbers, in order."""
    return F.regexp_extract_all(text, F.lit(PROTECTED), F.lit(0))


def is_citation(token: Column) -> Column:
    return token.rlike(CITATION)


def is_numeric(token: Column) -> Column:
    return token.rlike(NUMERIC)


def occurrences(text: Column, token: Column) -> Column:
    """Non-overlapping literal occurrences."""
    return F.when(F.length(token) == 0, 0).otherwise(F.floor((F.length(text) - F.length(F.replace(text, token, F.lit("")))) / F.length(token)))


def sentences(text: Column) -> Column:
    """Split after sentence ends and at line breaks; abbreviations and decimals stay whole."""
    t = F.regexp_replace(text, r"(?i)(Fig|Figs|Eq|Eqs|et al)\.", "$1\u0001")
    t = F.regexp_replace(t, r"(?i)(e|i)\.(g|e)\.", "$1\u0001$2\u0001")
    t = F.regexp_replace(t, r"(\d)\.(\d)", "$1\u0001$2")
    parts = F.split(t, r"(?<=[。！？!?;；.．])\s*|\n+")
    return F.filter(F.transform(parts, lambda p: strip(F.translate(p, "\u0001", "."))), lambda p: p != "")


def token_estimate(text: Column) -> Column:
    return F.ceil(F.length(text) / 2.5)


def needs_translation(kind: Column, text: Column) -> Column:
    """English prose of five words or more with a function word."""
    words = F.regexp_extract_all(text, F.lit("[A-Za-z]+(?:['’-][A-Za-z]+)*"), F.lit(0))
    return (kind != "author") & ~text.rlike("[㐀-鿿]") & (F.size(words) >= 5) & F.exists(words, lambda w: F.lower(w).isin(FUNCTION_WORDS))


def safe_error_message(text: Column, limit: int = 300) -> Column:
    """Keys and bearer tokens redacted, cut to the limit."""
    t = F.regexp_replace(text, "sk-[A-Za-z0-9_-]+", "[redacted]")
    t = F.regexp_replace(t, r"(?i)(Authorization\s*[:=]\s*)(?:Bearer\s+)?[^\s,;]+", "$1[redacted]")
    t = F.regexp_replace(t, r"(?i)\bBearer\s+[^\s,;]+", "Bearer [redacted]")
    return F.substring(t, 1, limit)


def normalise_spaces(text: Column) -> Column:
    return strip(F.regexp_replace(F.lower(text), "[\\s　]+", " "))


def compact(text: Column) -> Column:
    """Without white space, zero-width characters, punctuation and symbols."""
    return F.regexp_replace(text, "[\\s​-‍﻿\\p{P}\\p{S}]+", "")
