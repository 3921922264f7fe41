"""Substring dedup by prefix-partitioned suffix trees over words.

Suffixes are taken at anchors (see repeats.py) and split by their first words, which
an anchor's hash stands for. A prefix is as long as its group needs: where one is common,
the words that all windows of a cell share take its place, and a group that is still too
large for one tree is split by one word more, again and again. In each subtree an internal
node at least as deep as a window's words are equal windows, the repeats.
"""

from __future__ import annotations

import hashlib
from array import array

import numpy as np
import xxhash
from pyspark.sql import DataFrame

from pagelith.llm import ordering
from pagelith.llm.anchors import gram_hashes
from pagelith.llm.repeats import Kind, remove
from pagelith.llm.suffix_dedup import spans

LENGTH = 50
#: Words an anchor is chosen by.
GRAM = 10
#: Windows of a common prefix meet by the words they share but for this number less one.
CELL = 4
#: A subtree has at most so many leaves.
LEAVES = 4096


def words(text: str | None) -> list[bytes]:
    """Runs of other characters than ASCII white space."""
    return (text or "").encode("utf-8", "surrogatepass").split()


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 250_000:
            self.clear()
        self[word] = found = xxhash.xxh3_64_intdigest(word)
        return found


_hashes = _Hashes()


def word_symbols(texts: list[str]):
    each = [words(t) for t in texts]
    all_ = [w for ws in each for w in ws]
    values = np.array(array("Q", [_hashes[w] for w in all_]), np.uint64)
    ends = np.cumsum([len(ws) for ws in each]).astype(np.int64)
    return values, ends, lambda a, b: b" ".join(all_[a:b])


def intern(segments: list[bytes]) -> list[bytes]:
    """Four bytes a word: its number among the words of these segments."""
    numbers: dict[bytes, int] = {}
    return [array("I", [numbers.setdefault(w, len(numbers)) for w in s.split(b" ")]).tobytes() for s in segments]


def tree_order(group: np.ndarray, texts: list[bytes], shared: int):
    order, lcp = ordering.prefix_trees(group, texts, 4, LEAVES)
    return order, lcp // 4


def kind(length: int = LENGTH, gram: int = GRAM) -> Kind:
    return Kind(length, min(gram, length), word_symbols, tree_order, intern, 4, False, lambda s, i, j: b" ".join(s.split(b" ")[i:j]), CELL)


def with_equal_windows(text: str | None, pairs: np.ndarray, length: int) -> np.ndarray:
    """The (first, last) window starts of pairs, and of the document's windows equal to one of those."""
    if not len(pairs):
        return pairs
    values, _, _ = word_symbols([text])
    hashes = gram_hashes(values, length)
    gone = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(gone, pairs[:, 0], 1)
    np.add.at(gone, pairs[:, 1] + 1, -1)
    gone = np.isin(hashes, hashes[np.cumsum(gone)[:-1] > 0])
    edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
    return np.stack([edges[::2], edges[1::2] - 1], 1)


SCHEMA = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string"


def dedup_word_windows(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """Removes every word in a window of `length` words that also starts in a smaller doc_id's document.

    A null doc_id comes before all others; null or empty text has no words. Rows
    that share a doc_id remove nothing from each other. Whole texts count, of any
    length; other columns are ignored; an empty table gives no rows.
    """

    def finish(texts, doc_ids, copies, pairs):
        n_words, n_removed, digests, kept_texts = [], [], [], []
        for text, copy, p in zip(texts, copies, pairs):
            ws = words(text)
            found = ([(0, len(ws))] if len(ws) >= length else []) if copy else spans(with_equal_windows(text, p, length), length)
            kept, at = [], 0
            for a, b in found:
                kept += ws[at:a]
                at = b
            kept += ws[at:]
            raw = b" ".join(kept)
            n_words.append(len(ws))
            n_removed.append(sum(b - a for a, b in found))
            digests.append(hashlib.sha256(raw).hexdigest())
            kept_texts.append(raw.decode("utf-8", "surrogatepass"))
        return doc_ids, n_words, n_removed, digests, kept_texts

    return remove(docs, kind(length, gram), finish, SCHEMA)


def op4_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """dedup_word_windows() of all documents; nulls, repeats and empty tables as there."""
    found = dedup_word_windows(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_words", "n_removed", "kept_sha256")
