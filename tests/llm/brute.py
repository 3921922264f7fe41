"""Plain-Python twins of the training-data operators, and small awkward tables."""

from __future__ import annotations

import hashlib
import random
from collections import Counter, defaultdict

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def sha(raw: bytes) -> str:
    return hashlib.sha256(raw).hexdigest()


def awkward(seed: int, n: int = 40) -> list[tuple]:
    """Documents with shared passages, copies, near copies, periodic and empty texts, and nulls."""
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdeé") for _ in range(r.randint(1, 4))) for _ in range(30)]
    words = lambda k: " ".join(r.choice(vocabulary) for _ in range(k))
    shared = [words(80) for _ in range(3)]
    texts: list[str | None] = [None, "", "   \n ", "x", words(60)]
    while len(texts) < n:
        k = r.random()
        if k < 0.15:
            texts.append(r.choice(texts))
        elif k < 0.3:
            w = (r.choice([t for t in texts if t and len(t) > 20]) if any(t and len(t) > 20 for t in texts) else words(50)).split(" ")
            w[r.randrange(len(w))] = "zzz"
            texts.append(" ".join(w))
        elif k < 0.4:
            texts.append("ab ba " * r.randint(20, 60))
        elif k < 0.7:
            texts.append(words(r.randint(0, 40)) + "\n" + r.choice(shared) + "  " + words(r.randint(0, 40)))
        else:
            texts.append(words(r.randint(1, 120)))
    r.shuffle(texts)
    return [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]


def bytes_dedup(rows: list[tuple], length: int) -> dict:
    seen: set = set()
    out = {}
    for doc_id, text, *_ in sorted(rows, key=lambda x: x[0]):
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - length + 1):
            w = raw[p : p + length]
            if w in seen:
                gone[p : p + length] = b"\1" * length
            seen.add(w)
        spans = sum(1 for i in range(len(gone)) if gone[i] and (i == 0 or not gone[i - 1]))
        out[doc_id] = (len(raw), sum(gone), spans, sha(bytes(b for b, g in zip(raw, gone) if not g)))
    return out


def words_dedup(rows: list[tuple], length: int) -> dict:
    first: dict = {}
    out = {}
    for doc_id, text, *_ in sorted(rows, key=lambda x: x[0]):
        ws = (text or "").encode().split()
        gone = bytearray(len(ws))
        for p in range(len(ws) - length + 1):
            if first.setdefault(tuple(ws[p : p + length]), doc_id) < doc_id:
                gone[p : p + length] = b"\1" * length
        out[doc_id] = (len(ws), sum(gone), sha(b" ".join(w for w, g in zip(ws, gone) if not g)))
    return out


def lines_dedup(rows: list[tuple], least: int, docs: int) -> dict:
    key = lambda l: l.strip(" \t\n\x0b\x0c\r").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    holders = defaultdict(set)
    for d, t, *_ in rows:
        for l in (t or "").split("\n"):
            if len(key(l)) >= least:
                holders[key(l)].add(d)
    out = {}
    for d, t, *_ in rows:
        ls = (t or "").split("\n")
        kept = [l for l in ls if not (len(holders.get(key(l), ())) >= docs and d != max(holders[key(l)]))]
        out[d] = (len(ls), len(ls) - len(kept), "\n".join(kept))
    return out


def shingles(text: str | None, n: int = 5) -> frozenset:
    w = (text or "").encode().split()
    k = min(n, len(w))
    return frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if w else frozenset()


def near(rows: list[tuple]) -> dict:
    sets = {d: shingles(t) for d, t, *_ in rows}
    parent, links, least = {d: d for d in sets}, Counter(), {}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        least.setdefault(sets[a], a)
        for b in ids[i + 1 :]:
            union = len(sets[a] | sets[b])
            if sets[a] and sets[b] and 5 * len(sets[a] & sets[b]) >= 4 * union:
                links[a] += 1
                links[b] += 1
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {d: (root(d), links[d], least[sets[d]] if sets[d] else d) for d in ids}


def base_statistics(text: str | None) -> tuple:
    text = text or ""
    ws = [w.decode() for w in text.encode().split()]
    grams = Counter(zip(ws, ws[1:], ws[2:]))
    again = {j for i in range(len(ws) - 2) if grams[tuple(ws[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    seen, dup = set(), 0
    for l in text.split("\n"):
        if l.encode().split():
            dup += l in seen
            seen.add(l)
    return len(ws), sum(map(len, ws)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(again)
