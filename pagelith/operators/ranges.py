"""Where a text lies in another, when it is not there letter by letter: ordered words, ordered signs, near matches."""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelith.operators.grouped import TYPES
from pagelith.operators.sequential import flat, origins

WORD = re.compile(r"\w+")
TINY = re.compile(r"[^\W\d_]{1,2}")
FORMULA = re.compile("[=+−∑∏∫≤≥<>]")
#: A publisher's notice may stand between two parts of a sentence (fixed values).
NOTICE = re.compile(r"Permission to make (?:digital or hard|digital|hard) copies\b", re.I)
NOTICE_END = re.compile(r"Copyright held by|ACM ISBN|doi[.]org/", re.I)
ORDERED, SIGNS, LEAST, MOST = 0.92, 0.90, 0.82, 0.95

Words = tuple[list[str], list[int], list[int]]


def folded(text: str) -> list[str]:
    """Its words, normalised and in lower case."""
    if text.isascii():
        found = WORD.findall(text.lower())
    elif unicodedata.is_normalized("NFKC", text):
        found = [w.lower() for w in WORD.findall(text)]
    else:
        found = [unicodedata.normalize("NFKC", w).lower() for w in WORD.findall(text)]
    return [w.removesuffix("_res") for w in found] if "_" in text else found


#: Which characters below 2^16 are part of a word.
LETTERS = np.array([WORD.match(chr(c)) is not None for c in range(1 << 16)])


def words_of(text: str) -> Words:
    """Folded words, where each begins, where it ends."""
    codes = np.frombuffer(text.encode(), np.uint8) if text.isascii() else np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    if len(codes) and codes.max() >> 16:
        spans = [m.span() for m in WORD.finditer(text)]
        return folded(text), [a for a, _ in spans], [b for _, b in spans]
    inside = np.zeros(len(codes) + 2, bool)
    inside[1:-1] = LETTERS[codes]
    edges = np.flatnonzero(inside[1:] != inside[:-1]).tolist()
    return folded(text), edges[::2], edges[1::2]


def stretches(places: list[int]) -> list[tuple[int, int]]:
    """Runs of consecutive numbers as (first, last)."""
    out: list[tuple[int, int]] = []
    for p in places:
        if out and p == out[-1][1] + 1:
            out[-1] = (out[-1][0], p)
        else:
            out.append((p, p))
    return out


def alike(a: str, b: str) -> bool:
    """Equal, or one is a beginning or end of the other that lacks four letters at most."""
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    return a == b or (len(short) >= 4 and len(long) - len(short) <= 4 and (long.endswith(short) or long.startswith(short)))


def ends_cut(word: str) -> set[str]:
    """Beginnings and ends of four letters or more that lack one to four."""
    return {part for k in range(1, min(4, len(word) - 4) + 1) for part in (word[:-k], word[k:])}


class Text:
    """A text whose words and signs are read once, however many parts are sought in it."""

    #: So many words are compared one by one before the index of all words is asked.
    NEAR = 24

    def __init__(self, text: str):
        self.text = text

    @cached_property
    def words(self) -> Words:
        return words_of(self.text)

    @cached_property
    def lines(self) -> str:
        """The words, each on a line of its own."""
        return "\n" + "\n".join(self.words[0]) + "\n"

    @cached_property
    def flat(self) -> str:
        return flat(self.text)

    @cached_property
    def origins(self) -> np.ndarray:
        return origins(self.text)

    @cached_property
    def places(self) -> dict[str, list[int]]:
        """Where each word stands, in order."""
        out: dict[str, list[int]] = {}
        for i, w in enumerate(self.words[0]):
            out.setdefault(w, []).append(i)
        return out

    @cached_property
    def longer(self) -> dict[str, list[str]]:
        """Cut word -> the text's words that it is alike to and shorter than."""
        out: dict[str, list[str]] = {}
        for w in self.places:
            for part in ends_cut(w):
                out.setdefault(part, []).append(w)
        return out

    def first_word(self, cursor: int) -> int:
        """The first word that ends after the cursor."""
        return bisect_right(self.words[2], cursor)

    def next_alike(self, word: str, at: int) -> int | None:
        """The first word alike from `at` on."""
        have = self.words[0]
        for i in range(at, min(at + self.NEAR, len(have))):
            if alike(have[i], word):
                return i
        hits = []
        for w in {word, *ends_cut(word), *self.longer.get(word, ())}:
            listed = self.places.get(w, ())
            k = bisect_left(listed, at)
            if k < len(listed):
                hits.append(listed[k])
        return min(hits, default=None)


def _text(text: str | Text) -> Text:
    return text if isinstance(text, Text) else Text(text)


def whole(text: str | Text, part: str, cursor: int = 0) -> tuple[int, int] | None:
    """As sequential.find_range: exact from the cursor on, else without regard to blanks."""
    t = _text(text)
    i = t.text.find(part, cursor)
    if i >= 0 and part:
        return i, i + len(part)
    want = flat(part)
    if not want or want not in t.flat:
        return None
    i = t.flat.find(want, int(np.searchsorted(t.origins, cursor)))
    return (int(t.origins[i]), int(t.origins[i + len(want) - 1]) + 1) if i >= 0 else None


def ordered_words(text: str | Text, part: str, cursor: int = 0) -> list[tuple[int, int]] | None:
    """Ranges of part's words found in order with something between them, or None.

    Up to a quarter of the words, two at least, may be missing if they have one or two
    letters; such a word may not jump over more than two. A short part may not jump
    over words of prose, a longer one not over much unless it is a publisher's notice.
    """
    t, want = _text(text), folded(part)
    if len(want) < 4:
        return None
    have, firsts, lasts = t.words
    at = t.first_word(cursor)
    if len(have) - at < len(want):
        return None
    places, skipped = [], 0
    for word in want:
        hit = at if at < len(have) and have[at] == word else t.next_alike(word, at)
        if hit != at:
            tiny = len(word) <= 2 and TINY.fullmatch(word) is not None
            if hit is None or (tiny and hit - at > 2):
                skipped += 1
                if not tiny or skipped > max(2, len(want) // 4):
                    return None
                continue
        places.append(hit)
        at = hit + 1
    if len(places) < 4:
        return None
    runs = stretches(places)
    if len(runs) < 2:
        return None
    between = "\n".join(t.text[lasts[a] : firsts[b]] for (_, a), (b, _) in zip(runs, runs[1:]))
    if len(want) < 6 and any(len(w) > 1 and any(c.isalpha() for c in w) for w in folded(between)):
        return None
    if places[-1] - places[0] + 1 > 3 * len(want) + 24 and not (NOTICE.search(between) and NOTICE_END.search(between)):
        return None
    return [(firsts[a], lasts[b]) for a, b in runs]


def ordered_signs(text: str | Text, part: str, cursor: int = 0) -> list[tuple[int, int]] | None:
    """Ranges of a short formula's signs found in order, with no word between them, or None."""
    want = flat(part)
    if not 3 <= len(want) <= 24 or not FORMULA.search(want):
        return None
    t = _text(text)
    at, places = int(np.searchsorted(t.origins, cursor)), []
    for c in want:
        hit = t.flat.find(c, at)
        if hit < 0:
            return None
        places.append(hit)
        at = hit + 1
    first, last, taken = places[0], places[-1], set(places)
    if last - first + 1 > 4 * len(want) + 12:
        return None
    rest = "".join(t.flat[i] for i in range(first, last + 1) if i not in taken)
    if any(sum(c.isalpha() for c in w) > 1 for w in folded(rest)):
        return None
    return [(a, b + 1) for a, b in stretches([int(t.origins[p]) for p in places])]


def least_edits(want: list[str], have: list[str]) -> list[int]:
    """For each word of have, the fewest edits between want and a stretch that ends there: whole columns as bits of a number."""
    masks: dict[str, int] = {}
    for i, w in enumerate(want):
        masks[w] = masks.get(w, 0) | 1 << i
    every, top = (1 << len(want)) - 1, 1 << (len(want) - 1)
    up, down, edits, out = every, 0, len(want), []
    for w in have:
        same = masks.get(w, 0)
        across = (((same & up) + up) ^ up) | same
        more, less = (down | ~(across | up)) & every, up & across
        edits += bool(more & top) - bool(less & top)
        more, less, same = more << 1, less << 1, same | down
        up, down = (less | ~(same | more)) & every, more & same & every
        out.append(edits)
    return out


def near_words(text: str | Text, part: str, cursor: int = 0) -> tuple[tuple[int, int], float] | None:
    """The stretch of words with the fewest edits to part's words, and 1 less edits by word; None below 0.82.

    One of as many pieces as there may be edits, and one more, stands there unchanged. Of the
    words that may not all be missing, the rarest tell where such a stretch can end.
    """
    t, want = _text(text), folded(part)
    have, firsts, lasts = t.words
    n, low = len(want), t.first_word(cursor)
    if n < 4 or len(have) - low < n * 0.5:
        return None
    most = next(e for e in range(n, -1, -1) if 1 - e / n >= LEAST)
    cuts = [n * i // (most + 1) for i in range(most + 2)]
    if not any("\n" + "\n".join(want[a:b]) + "\n" in t.lines for a, b in zip(cuts, cuts[1:])):
        return None
    listed = [t.places.get(w, []) for w in want]
    begins = [bisect_left(p, low) for p in listed]
    rarest = sorted(range(n), key=lambda i: len(listed[i]) - begins[i])[: most + 1]
    ends = sorted({p + n - i for i in rarest for p in listed[i][begins[i] :]})  # give or take `most`
    reach, best, k = n + most, None, 0
    while k < len(ends):
        a = last = ends[k]
        while k < len(ends) and ends[k] - most - reach <= last + most:
            last, k = ends[k], k + 1
        begin = max(low, a - most - reach)
        edits = least_edits(want, have[begin : last + most])
        for j in range(max(begin + 1, a - most), begin + len(edits) + 1):
            if edits[j - begin - 1] <= most and (best is None or edits[j - begin - 1] < best[0]):
                best = (edits[j - begin - 1], j)
        if best and not best[0]:
            break
    if best is None:
        return None
    end = best[1]
    begin = max(low, end - 2 * reach - 2)  # the cells that count for the stretch and its ties lie there
    row = [(0, j) for j in range(begin, end + 1)]  # (edits, where the stretch begins)
    for i, word in enumerate(want, 1):
        new = [(i, begin)]
        for j, other in enumerate(have[begin:end], 1):
            options = ((row[j - 1][0] + (word != other), row[j - 1][1]), (row[j][0] + 1, row[j][1]), (new[j - 1][0] + 1, new[j - 1][1]))
            new.append(min(options, key=lambda o: o[0]))
        row = new
    edits, begin = row[-1]
    return None if begin >= end else ((firsts[begin], lasts[end - 1]), min(MOST, 1 - edits / n))


def locate(text: str | Text, part: str, cursor: int = 0) -> tuple[list[tuple[int, int]], float]:
    """Ranges of part in text and how sure they are: as it is, by ordered words, by ordered signs, by nearness; none is 0."""
    t = _text(text)
    if hit := whole(t, part, cursor):
        return [hit], 1.0
    if found := ordered_words(t, part, cursor):
        return found, ORDERED
    if found := ordered_signs(t, part, cursor):
        return found, SIGNS
    if near := near_words(t, part, cursor):
        return [near[0]], near[1]
    return [], 0.0


PLACED = "doc_id long, pos long, first long, last long, pieces long, confidence double"
_SCHEMA = pa.schema([(n, TYPES[t]) for n, t in (f.split() for f in PLACED.split(", "))])


def place_listed(rows: DataFrame) -> DataFrame:
    """Parts of rows(doc_id, text, listed array<struct<pos, part>>) found one after another in the row's text, with a cursor that moves on; nothing is shuffled."""

    # one row a part, the text with its document's first only: a task keeps their order, and batches stay small
    # (the outer form, as Spark would make `listed` twice to filter what the other form drops)
    one = rows.select("doc_id", "text", F.posexplode_outer("listed").alias("n", "p")).where("n IS NOT NULL")
    one = one.select("doc_id", F.when(F.col("n") == 0, F.coalesce("text", F.lit(""))).alias("text"), F.col("p.pos").cast("long").alias("pos"), F.col("p.part").alias("part"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, cursor = Text(""), 0
        for b in batches:
            out = []
            for text, part in zip(b["text"].to_numpy(zero_copy_only=False), b["part"].to_numpy(zero_copy_only=False)):
                if text is not None:
                    t, cursor = Text(text), 0
                found, sure = locate(t, part, cursor)
                first, last = (found[0][0], found[-1][1]) if found else (-1, -1)
                cursor = max(cursor, last)
                out.append((first, last, len(found), sure))
            columns = [pa.array(c, kind) for c, kind in zip(list(zip(*out)) or [()] * 4, _SCHEMA.types[2:])]
            yield pa.RecordBatch.from_arrays([b["doc_id"].cast(pa.int64()), b["pos"], *columns], schema=_SCHEMA)

    return one.mapInArrow(run, PLACED)


def place_parts(parts: DataFrame, texts: DataFrame) -> DataFrame:
    """parts(doc_id, pos, part) found one after another in texts(doc_id, text), one text a document, with a cursor that moves on."""
    listed = F.sort_array(F.collect_list(F.struct("pos", "part")))
    return place_listed(parts.groupBy("doc_id").agg(listed.alias("listed")).join(texts.select("doc_id", "text"), "doc_id"))
