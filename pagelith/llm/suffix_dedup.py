"""Suffix-array dedup by deep-shallow sorting: repeated byte strings across and within documents.

Suffixes are taken at anchors (see repeats.py). A multikey quicksort to a shallow depth
comes first; suffixes that tie there, whose common prefix is long, are ordered by blind
tries, which compare each text once.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame

from pagelith.llm import anchors, ordering
from pagelith.llm.repeats import Kind, remove

LENGTH = 100
#: Bytes an anchor is chosen by.
GRAM = 24


def _raw(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def byte_symbols(texts: list[str]):
    raws = [_raw(t) for t in texts]
    joined = b"".join(raws)
    ends = np.cumsum([len(r) for r in raws]).astype(np.int64)
    return anchors.BYTE_VALUES[np.frombuffer(joined, np.uint8)], ends, lambda a, b: joined[a:b]


def kind(length: int = LENGTH, gram: int = GRAM) -> Kind:
    return Kind(length, min(gram, length), byte_symbols, ordering.deep_shallow, None, 1, True, lambda s, i, j: s[i:j])


def spans(pairs: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Maximal runs covered by windows that begin at first..last of each pair."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(map(tuple, pairs.tolist())):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b + length))
        else:
            out.append((a, b + length))
    return out


SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, removed array<struct<begin:long,end:long>>"


def dedup_substrings(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """Removes every byte covered by a string of `length` bytes that starts earlier too.

    Earlier: smaller doc_id, or the same document and an earlier start. A null
    doc_id comes before all others; null text is empty. Rows that repeat a doc_id
    and text are one document and give equal rows; rows that share a doc_id but not
    the text are separate documents, ordered by a hash of the row. Whole texts count,
    of any length; other columns are ignored; an empty table gives no rows.
    """

    def finish(texts, doc_ids, copies, pairs):
        n_bytes, n_removed, n_spans, digests, removed = [], [], [], [], []
        for text, copy, p in zip(texts, copies, pairs):
            raw = _raw(text)
            found = ([(0, len(raw))] if len(raw) >= length else []) if copy else spans(p, length)
            kept, at = [], 0
            for a, b in found:
                kept.append(raw[at:a])
                at = b
            kept.append(raw[at:])
            n_bytes.append(len(raw))
            n_removed.append(sum(b - a for a, b in found))
            n_spans.append(len(found))
            digests.append(hashlib.sha256(b"".join(kept)).hexdigest())
            removed.append([{"begin": a, "end": b} for a, b in found])
        return doc_ids, n_bytes, n_removed, n_spans, digests, removed

    return remove(docs, kind(length, gram), finish, SCHEMA)


def op1_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """dedup_substrings() of all documents; nulls, repeats and empty tables as there."""
    found = dedup_substrings(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
