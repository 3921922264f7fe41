"""Predicates and rewrites over extracted text: notes, tables, algorithms, captions, furniture, wrapped lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagelith.functions.text import strip

# Word lists and patterns that results depend on (fixed values); edges are ASCII.
EDGE_L, EDGE_R = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"
COMMON = "the|a|an|and|or|of|to|in|for|with|that|this|is|are|was|were|as|by|from|on|at"
NOTE = r"(?:\(\d+[a-z]?\)|\[\d+[a-z]?\]|[*†‡])\s+"
PLACES = "university|institute|institution|laborator(?:y|ies)|department|school|college|academy|faculty|group|cent(?:er|re)"
ALGORITHM_LINE = rf"(?i)^(?:require|ensure|input|output|return|for{EDGE_R}|while{EDGE_R}|if{EDGE_R}|else{EDGE_R}|end{EDGE_R}|//)"
ALGORITHM_MATH = rf"(?i)[←→∑≫≪⌈⌉]|{EDGE_L}(?:do|then|end for|end if){EDGE_R}"
MATH_MARK = "[=+−∑∏∫√≤≥≈≠⟨⟩λα-ωΑ-Ω]"
TRANSLATION_KINDS = {
    "author": "author", "affiliation": "affiliation", "abstract": "abstract", "heading": "heading", "list-item": "list-item", "caption": "caption",
    "table-title": "table-title", "title": "title",
}


def count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def word_count(text: Column, least: int) -> Column:
    return count(text, f"[A-Za-z]{{{least},}}")


def common_words(text: Column, extra: str = "") -> Column:
    return count(text, f"(?i){EDGE_L}(?:{COMMON}{extra}){EDGE_R}")


def text_lines(text: Column) -> Column:
    """Trimmed lines that are not blank."""
    return F.filter(F.transform(F.split(text, r"\r?\n"), strip), lambda l: l != "")


def is_table_note(text: Column) -> Column:
    t = strip(text)
    marks = count(t, rf"(?im)(?:^|\n)\s*{NOTE}")
    return t.rlike(f"(?i)^{NOTE}") & ((marks >= 2) | ((marks == 1) & (word_count(t, 3) >= 6) & (count(t, "[=∑∏∫√≤≥≈≠]") == 0)))


def is_numeric_table_body(text: Column) -> Column:
    numbers, words = count(text, r"\d+(?:[.,]\d+)?"), word_count(text, 2)
    return (F.size(text_lines(text)) >= 3) & (numbers >= 6) & (numbers >= F.greatest(F.lit(4.0), words * 0.6))


def is_short_table_cell(text: Column) -> Column:
    t = strip(text)
    return (
        F.size(text_lines(t)).between(1, 4) & (F.length(t) <= 80) & (count(t, r"\d+(?:[.,]\d+)?") >= 1) & (word_count(t, 2) <= 8)
        & (common_words(t, "|has|have") <= 1) & ~t.rlike(r"[.!?;:]\s*$")
    )


def is_visual_labels(text: Column, share: float = 0.7) -> Column:
    """Four lines or more, of which most are short or numbers."""
    ls = text_lines(text)
    short = F.filter(ls, lambda l: (F.length(l) <= 32) | l.rlike(r"^[-+]?\d[\d.,%‰+\- ]*$"))
    return (F.size(ls) >= 4) & (F.size(short) / F.greatest(F.lit(1), F.size(ls)) >= share)


def has_caption_grammar(text: Column) -> Column:
    t = strip(text)
    letters, capitals = count(t, "[A-Za-z]"), count(t, "[A-Z]")
    joined = count(t, f"(?i){EDGE_L}(?:and|for|from|in|of|on|over|to|versus|via|with|without){EDGE_R}")
    linked = count(t, f"(?i){EDGE_L}(?:across|among|and|at|between|by|for|from|in|of|on|over|under|using|versus|via|when|with|without){EDGE_R}")
    return (
        F.when(t.rlike(r"[.!?]\s*$"), True)
        .when((letters >= 12) & (capitals / F.greatest(F.lit(1), letters) >= 0.85) & (word_count(t, 2) >= 4) & (joined >= 1), True)
        .otherwise(t.rlike(r"[)]\s*$") & (count(t, r"(?i)\(\s*\d+[a-z]?\s*\)") <= 1) & (linked >= 1))
    )


def is_algorithm_caption(text: Column) -> Column:
    return text.rlike(rf"(?i)^\s*(?:algorithm|算法)\s*\d+[A-Za-z]?{EDGE_R}")


def is_algorithm_body(kind: Column, text: Column) -> Column:
    """A quarter of the lines, at least one, are numbered, begin with a keyword or hold algorithm marks (each counts)."""
    ls = text_lines(text)
    n = lambda p: F.size(F.filter(ls, lambda l: l.rlike(p)))
    score = n(r"^\d+\s*:") + n(ALGORITHM_LINE) + n(ALGORITHM_MATH)
    return (kind == "equation") | ((F.size(ls) > 0) & (score >= F.greatest(F.lit(1), F.ceil(F.size(ls) * 0.25))))


def is_algorithm_boundary(kind: Column, text: Column) -> Column:
    """Captions, headings and running prose end an algorithm."""
    t, ls = strip(text), text_lines(text)
    first = F.coalesce(F.get(ls, F.lit(0)), F.lit(""))
    starts = first.rlike(r"^\d+\s*:") | first.rlike(ALGORITHM_LINE)
    prose_first = ~starts & (word_count(first, 3) >= 8) & (common_words(first, "|while") >= 2)
    instructions = F.exists(ls, lambda l: l.rlike(r"^\d+\s*:")) | first.rlike(r"(?i)^(?:require|ensure|input|output)\s*:")
    return (
        F.when(kind.isin("caption", "section", "title"), True).when(F.length(t) < 80, False).when(prose_first, True).when(instructions, False)
        .otherwise((word_count(t, 3) >= 12) & (common_words(t) >= 3))
    )


def is_bibliography_heading(text: Column) -> Column:
    return F.regexp_replace(strip(text), r"\s+", "").rlike("(?i)^(?:references|bibliography|参考文献)$")


def is_prose_formula(text: Column) -> Column:
    t = strip(F.regexp_replace(text, r"\s+", " "))
    return (F.length(t) >= 45) & (word_count(t, 3) >= 5) & (common_words(t) >= 2)


def is_formula_paragraph(text: Column, height: Column) -> Column:
    t = strip(text)
    return F.length(t).between(1, 80) & (height <= 72) & (word_count(t, 3) == 0) & t.rlike(MATH_MARK) & (count(t, rf"[\d{MATH_MARK[1:-1]}]") >= 2)


def front_matter_role(text: Column) -> Column:
    t = strip(F.regexp_replace(text, r"\s+", " "))
    names = count(t, rf"{EDGE_L}[A-Z][A-Za-z'’-]+(?:\s+[A-Z][A-Za-z'’-]+)+{EDGE_R}")
    return (
        F.when(F.length(t) == 0, F.lit(None)).when(t.rlike(f"(?i)@|{EDGE_L}(?:{PLACES}){EDGE_R}"), "affiliation")
        .when((names >= 2) | ((names >= 1) & t.rlike(f"(?i),|{EDGE_L}and{EDGE_R}|&")), "author")
    )


def is_title_continuation(text: Column) -> Column:
    t = strip(F.regexp_replace(text, r"\s+", " "))
    words = count(t, "[A-Za-z][A-Za-z-]*")
    place = f"(?i)@|{EDGE_L}(?:university|institute|department|school|college|group|cent(?:er|re)){EDGE_R}"
    return F.length(t).between(5, 100) & words.between(2, 14) & ~t.rlike(place) & ~t.rlike("[.!?;:]$")


def degree_phrases(text: Column) -> Column:
    """How often a page says that somebody received a degree; three make a biography page."""
    return count(text, rf"(?is){EDGE_L}received{EDGE_R}.{{0,160}}?{EDGE_L}degree{EDGE_R}")


def is_portrait(w: Column, h: Column, page_w: Column, page_h: Column, captioned: Column) -> Column:
    return ~captioned & (w / page_w).between(0.08, 0.22) & (h / page_h).between(0.08, 0.22) & (w / F.greatest(F.lit(1), h)).between(0.55, 1.5)


def translation_kind(kind: Column) -> Column:
    table = F.create_map(*(F.lit(x) for kv in TRANSLATION_KINDS.items() for x in kv))
    return F.coalesce(F.try_element_at(table, kind), F.lit("paragraph"))


# --- rewrites ---


def numeric_spacing(text: Column) -> Column:
    """Controls gone; spaced decimals, percent signs and wrapped identifiers joined."""
    t = F.regexp_replace(text, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", "")
    t = F.regexp_replace(t, r"(\d)\s*[.]\s*(?=\d)", "$1.")
    t = F.regexp_replace(t, r"(\d)\s*([%‰×])\s*", "$1$2")
    return F.regexp_replace(t, rf"{EDGE_L}([A-Za-z]+\d*)-[ \t]*\r?\n[ \t]*(\d+){EDGE_R}", "$1-$2")


def small_caps(text: Column, least: int = 2) -> Column:
    """`P ERFORMANCE C OMPARISON` joined on lines with at least `least` such words."""
    pattern = rf"{EDGE_L}([A-Z])\s+([A-Z]{{2,}}){EDGE_R}"
    return F.array_join(F.transform(F.split(text, r"\r?\n"), lambda l: F.when(count(l, pattern) >= least, F.regexp_replace(l, pattern, "$1$2")).otherwise(l)), "\n")


def fragment_key(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), r"\s+", ""), r"[.,;:()\[\]{}]", "")


def furniture_key(text: Column) -> Column:
    return F.lower(F.regexp_replace(strip(text), r"\s+", " "))


def join_caption(source: Column, more: Column) -> Column:
    return F.when(source.endswith("-") & more.rlike("^[a-z]"), F.concat(F.regexp_replace(source, "-$", ""), more)).otherwise(F.concat(source, F.lit(" "), more))


def join_reference(entry: Column, line: Column) -> Column:
    """A wrapped bibliography line: broken words, numbers and addresses are joined without a blank."""
    url = F.regexp_extract(entry, r"(?i)(https?://\S+)$", 1)
    address = (url.rlike("[./:]$") & line.rlike("^[A-Za-z0-9/?#]")) | (entry.rlike("(?i)https?:$") & line.startswith("//"))
    return (
        F.when(entry.endswith("-") & line.rlike("^[a-z]"), F.concat(F.regexp_replace(entry, "-$", ""), line))
        .when((entry.endswith("-") & line.rlike(r"^\d")) | address, F.concat(entry, line))
        .otherwise(F.concat(entry, F.lit(" "), line))
    )


def join_footnote(left: Column, right: Column) -> Column:
    """Halves of a table footnote line: no blank inside a split word."""
    a, b = F.rtrim(left), F.ltrim(right)
    head, tail = F.regexp_extract(a, "([A-Za-z]+)$", 1), F.regexp_extract(b, "^([A-Za-z]+(?:-[A-Za-z]+)?)", 1)
    suffix = tail.rlike("(?i)^(?:ile|ion|ions|ing|ed|er|ers|ly|ment|tion|sion|ness|able|al|ansfer)$")
    initials = head.rlike("^[A-Z]{1,3}$") & tail.rlike("^[A-Z](?:[A-Z]|-[A-Z])")
    split = (head != "") & (tail != "") & ((F.length(head) <= 2) | suffix | initials)
    return F.when(a == "", b).when(b == "", a).when(split, F.concat(a, b)).otherwise(F.concat(a, F.lit(" "), b))


NOTICE_START = rf"(?i)^Permission to make (?:digital or hard|digital|hard) copies{EDGE_R}"
NOTICE_END = rf"(?i){EDGE_L}doi\.org/"
BOILERPLATE = (
    r"(?i)^Corresponding author\s*:|^[*∗†‡]\s*This paper (?:has been|was) accepted" + EDGE_R + r"|^(?:©\s*)?\d{4}\s+Copyright" + EDGE_R + r"|^ACM ISBN" + EDGE_R
    + r"|^https?://doi\.org/|^DAC\s*[’']?\d{2}\s*,\s*(?:June|July|August)" + EDGE_R
)


def without_boilerplate(text: Column) -> Column:
    """Publisher's lines gone, and a permission notice up to its address: a fold over lines."""
    start = F.struct(F.lit(False).alias("inside"), F.array().cast("array<string>").alias("out"))

    def step(s: Column, line: Column) -> Column:
        t = strip(line)
        begins = t.rlike(NOTICE_START)
        inside = F.when(s["inside"], ~t.rlike(NOTICE_END)).otherwise(begins)
        drop = s["inside"] | begins | t.rlike(BOILERPLATE)
        return F.struct(inside.alias("inside"), F.when(drop, s["out"]).otherwise(F.concat(s["out"], F.array(line))).alias("out"))

    return strip(F.array_join(F.aggregate(F.split(text, r"\r?\n"), start, step, lambda s: s["out"]), "\n"))


def without_punctuation_rows(text: Column) -> Column:
    """Trailing lines of signs only go."""
    return strip(F.regexp_replace(text, r"(?:\r?\n[ \t]*[\p{P}\p{S}][\p{P}\p{S} \t]*)+$", ""))


def caption_parts(text: Column) -> Column:
    """`Figure 9: .. Table 2: ..` as structs (kind, text); none if fewer than two heads."""
    head = rf"(?i){EDGE_L}(?:Figure|Table)\s+\d+[A-Za-z]?\s*[:.]\s*"
    heads, gaps = F.regexp_extract_all(text, F.lit(head), F.lit(0)), F.split(text, head)
    parts = F.zip_with(heads, F.slice(gaps, 2, F.size(heads)), lambda h, g: F.struct(F.when(F.lower(h).startswith("f"), "figure").otherwise("table").alias("kind"), strip(F.concat(h, g)).alias("text")))
    return F.when(F.size(heads) >= 2, parts).otherwise(F.array().cast("array<struct<kind:string,text:string>>"))


def escape_markup(text: Column) -> Column:
    """Typesetting specials with a backslash before them."""
    return F.regexp_replace(text, r"([\\#$*_`<>@\[\]{}~^/=+-])", r"\\$1")


def escape_string(text: Column) -> Column:
    return F.regexp_replace(text, r'(["\\])', r"\\$1")
