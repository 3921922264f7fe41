"""Operators that are sequential inside a document or page: Arrow-batched, grouped by that key."""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from pagelith.operators.grouped import grouped

Y_TOLERANCE, X_GAP, GUTTER, GUTTER_SHARE = 4.0, 24.0, 10.0, 0.018
UNIT_CHARS, CHUNK_CHARS, CHUNK_LEAST = 1800, 340, 120
END = re.compile(r"[.!?;:]\s*$")
PUNCTUATION = re.compile(r"(\s*[。！？.!?][\"'”’）)]*)$")


@pandas_udf(StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """Compatibility-normalised text."""
    return text.map(lambda s: unicodedata.normalize("NFKC", s), na_action="ignore")


# --- lines of positioned text ---------------------------------------------------------------------

LINES = "doc_id long, page long, line_no long, x double, y double, w double, h double, text string"


def page_lines(items: list[dict], page_width: float | None) -> list[dict]:
    """Text runs of a page to lines.

    A run joins the first group whose first run is within the tolerance of its y;
    inside a group, by x, a wide gap or the page's gutter begins another line.
    """
    groups: list[tuple[float, list[dict]]] = []
    for it in items:
        if not (it["str"] or "").strip():
            continue
        home = next((g for g in groups if abs(g[0] - it["y"]) <= Y_TOLERANCE), None)
        if home is None:
            groups.append((it["y"], [it]))
        else:
            home[1].append(it)
    out = []
    for y, members in groups:
        run: list[dict] = []
        for it in sorted(members, key=lambda i: i["x"]):
            if run:
                end = run[-1]["x"] + run[-1]["w"]
                gap = it["x"] - end
                centre = page_width / 2 if page_width else None
                crosses = centre is not None and gap > max(GUTTER, page_width * GUTTER_SHARE) and end < centre < it["x"]
                if gap > X_GAP or crosses:
                    out.append((y, run))
                    run = []
            run.append(it)
        out.append((y, run))
    made = []
    for y, run in sorted(out, key=lambda r: r[0]):
        x = run[0]["x"]
        made.append({"x": x, "y": y, "w": max(i["x"] + i["w"] for i in run) - x, "h": max(i["h"] for i in run), "text": " ".join(i["str"] for i in run)})
    return made


def lines_of(items: DataFrame, page_width: float | None = None) -> DataFrame:
    """items(doc_id, page, item_no, str, x, y, w, h) -> lines, page by page."""

    def run(rows: list[dict]) -> list[tuple]:
        key = (rows[0]["doc_id"], rows[0]["page"])
        return [(*key, i, m["x"], m["y"], m["w"], m["h"], m["text"]) for i, m in enumerate(page_lines(rows, page_width))]

    return grouped(items, ["doc_id", "page"], ["item_no"], run, LINES)


# --- splitting long texts ---------------------------------------------------------------------------


#: Where a unit may end: a sentence with its closers, or a blank line (fixed values).
UNIT_END = re.compile(r"(?:[.!?。！？][\"')\]]*\s+|\n{2,})")


def split_oversized(text: str, most: int = UNIT_CHARS) -> list[str]:
    """Pieces of at most `most` characters: cut at the last unit end in the second half, else at the last blank there, else at the limit.

    A cut may fall one character beyond the limit, on white space; pieces are trimmed.
    """
    out, rest = [], text.strip()
    while len(rest) > most:
        window = rest[: most + 1]
        at = max((m.end() for m in UNIT_END.finditer(window)), default=0)
        if 2 * at < most:
            at = window.rfind(" ")
        at = at if 2 * at >= most else most
        out.append(rest[:at].strip())
        rest = rest[at:].strip()
    return [*out, rest] if rest else out


def split_for_repair(text: str) -> list[str]:
    """Chunks of at most 340 characters, cut after a sentence end and blank, else after a blank, else hard."""
    out, at = [], 0
    while at < len(text):
        if len(text) - at <= CHUNK_CHARS:
            out.append(text[at:])
            break
        window = text[at : at + CHUNK_CHARS]
        blanks = [i for i in range(len(window) - 1, min(CHUNK_LEAST, len(window) - 1) - 1, -1) if window[i].isspace()]
        cut = next((i + 1 for i in blanks if END.search(window[:i])), blanks[0] + 1 if blanks else len(window))
        out.append(text[at : at + cut])
        at += cut
    return out


def pieces(rows: DataFrame, key: str, text: str, split=split_oversized) -> DataFrame:
    """key, part (from 0), text of each piece."""
    made = pandas_udf(lambda s: s.map(split, na_action="ignore"), "array<string>")
    return rows.select(key, F.posexplode(made(F.col(text))).alias("part", "text"))


# --- protected tokens --------------------------------------------------------------------------------

TOKEN = re.compile(r"⟦[^⟧]+⟧|\[\s*(?:\d+(?:\s*[-,]\s*\d+)*)\s*\]|(?<![A-Za-z0-9])[-+]?(?:\d+\.\d+|\d+)(?:%|‰)?")


def mask(text: str, block: int = 0) -> tuple[str, list[str]]:
    """Each protected token becomes a marker of its own; longer tokens are found first."""
    tokens = sorted(dict.fromkeys(TOKEN.findall(text)), key=len, reverse=True)
    if not tokens:
        return text, []
    found: list[str] = []

    def put(m: re.Match) -> str:
        found.append(m.group(0))
        return f"⟦PP{block}_{len(found) - 1}⟧"

    return re.sub("|".join(map(re.escape, tokens)), put, text), found


def insert_before_end(segment: str, token: str) -> str:
    m = PUNCTUATION.search(segment)
    at = m.start(1) if m else len(segment)
    return f"{segment[:at].rstrip()} {token}{segment[at:]}"


def restore(text: str, found: list[str], block: int = 0) -> str:
    """Markers back to tokens; one that got lost goes before the text's end mark, unless its value stands there."""
    claimed: dict[str, int] = {}
    for i, token in enumerate(found):
        marker = f"⟦PP{block}_{i}⟧"
        if marker in text:
            continue
        if claimed.get(token, 0) < text.count(token):
            claimed[token] = claimed.get(token, 0) + 1
            continue
        text = insert_before_end(text, marker)
    for i, token in enumerate(found):
        text = text.replace(f"⟦PP{block}_{i}⟧", token)
    return text


MASKED = "block_id string, masked string, tokens array<string>"


def mask_blocks(blocks: DataFrame) -> DataFrame:
    def run(batches):
        for rows in batches:
            made = [mask(t or "") for t in rows.text]
            yield pd.DataFrame({"block_id": rows.block_id, "masked": [m for m, _ in made], "tokens": [t for _, t in made]})

    return blocks.select("block_id", "text").mapInPandas(run, MASKED)


# --- finding text in text ----------------------------------------------------------------------------


class _Signs(dict):
    """Code point -> its compatibility form without blanks."""

    def __missing__(self, code: int) -> str:
        self[code] = "".join(n for n in unicodedata.normalize("NFKC", chr(code)) if not n.isspace())
        return self[code]


SIGNS = _Signs()
_ASCII_SIGNS = np.array([len(SIGNS[c]) for c in range(128)])


def flat(text: str) -> str:
    """Characters normalised one by one, without blanks."""
    plain = text.isascii() or unicodedata.is_normalized("NFKC", text)  # then each of its characters is, too
    return "".join(text.split()) if plain else text.translate(SIGNS)


def origins(text: str) -> np.ndarray:
    """For each character of flat(text), its place in text."""
    if text.isascii():
        n = _ASCII_SIGNS[np.frombuffer(text.encode(), np.uint8)]
    else:
        codes, each = np.unique(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), return_inverse=True)
        n = np.array([len(SIGNS[c]) for c in codes.tolist()])[each]
    return np.repeat(np.arange(len(text)), n)


def squeeze(text: str) -> tuple[str, list[int]]:
    """Normalised text without blanks, and each character's place in the original."""
    return flat(text), origins(text).tolist()


def find_range(text: str, part: str, cursor: int = 0) -> tuple[int, int] | None:
    """Exact from the cursor on, else without regard to blanks."""
    i = text.find(part, cursor)
    if i >= 0 and part:
        return i, i + len(part)
    flat, at = squeeze(text)
    want, _ = squeeze(part)
    begin = next((k for k, p in enumerate(at) if p >= cursor), len(at))
    i = flat.find(want, begin) if want else -1
    return (at[i], at[i + len(want) - 1] + 1) if i >= 0 else None


FOUND = "doc_id long, pos long, first long, last long"


def match_segments(segments: DataFrame, texts: DataFrame) -> DataFrame:
    """segments(doc_id, pos, part) found one after another in texts(doc_id, text); none is -1."""

    whole = F.transform(F.sort_array(F.collect_list(F.struct("pos", "part"))), lambda p: F.struct(p["pos"].alias("pos"), p["part"].alias("part")))
    # one row a document: its text travels once, not with every segment
    rows = segments.groupBy("doc_id").agg(whole.alias("parts")).join(texts.select("doc_id", "text"), "doc_id")

    def run(rows: list[dict]) -> list[tuple]:
        cursor, out = 0, []
        for p in rows[0]["parts"]:
            hit = find_range(rows[0]["text"], p["part"], cursor)
            if hit:
                cursor = hit[1]
            out.append((rows[0]["doc_id"], p["pos"], *(hit or (-1, -1))))
        return out

    return grouped(rows, ["doc_id"], [], run, FOUND)


# --- pagination --------------------------------------------------------------------------------------

PLACED = "doc_id long, ord long, page long, col long, top double, h double, overflow boolean"


def paginate(blocks: DataFrame, height: float, columns: int = 2, gap: float = 0.0) -> DataFrame:
    """Fills columns in block order with blocks(doc_id, ord, h, atomic); an atomic block never splits, others split where a column ends."""

    def run(rows: list[dict]) -> list[tuple]:
        page = col = 0
        top, out = 0.0, []

        def turn():
            nonlocal page, col, top
            col, top = col + 1, 0.0
            if col == columns:
                page, col = page + 1, 0

        for r in rows:
            left, atomic = float(r["h"]), r["atomic"]
            if atomic and top and top + left > height:
                turn()
            while left > 0:
                if not atomic and top >= height:
                    turn()
                part = left if atomic else min(left, height - top)
                out.append((r["doc_id"], r["ord"], page, col, top, part, bool(atomic and part > height)))
                top, left = top + part + gap, left - part
        return out

    return grouped(blocks, ["doc_id"], ["ord"], run, PLACED)


# --- merging boxes to a fixpoint ---------------------------------------------------------------------

MERGED = "page long, x double, y double, w double, h double, n long"


def merge_boxes(boxes: list[tuple[float, float, float, float]], gap: float, least_area: float) -> list[tuple]:
    """Unites boxes within the gap of each other until none is; small ones go at last."""
    now = [(x, y, x + w, y + h, 1) for x, y, w, h in boxes]
    changed = True
    while changed:
        changed, out = False, []
        for b in now:
            for i, o in enumerate(out):
                if b[0] <= o[2] + gap and o[0] <= b[2] + gap and b[1] <= o[3] + gap and o[1] <= b[3] + gap:
                    out[i] = (min(b[0], o[0]), min(b[1], o[1]), max(b[2], o[2]), max(b[3], o[3]), b[4] + o[4])
                    changed = True
                    break
            else:
                out.append(b)
        now = out
    return [(x, y, x2 - x, y2 - y, n) for x, y, x2, y2, n in now if (x2 - x) * (y2 - y) >= least_area]


def merge_regions(rects: DataFrame, gap: float = 8.0, least_area: float = 1600.0) -> DataFrame:
    """rects(page, id, x, y, w, h), page by page, in id order."""

    def run(rows: list[dict]) -> list[tuple]:
        made = merge_boxes([tuple(float(r[c]) for c in "xywh") for r in rows], gap, least_area)
        return [(rows[0]["page"], *m) for m in made]

    return grouped(rects, ["page"], ["id"], run, MERGED)
