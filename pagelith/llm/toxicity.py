"""Toxicity by noisy-channel deobfuscation.

A character trigram model is counted over all documents. Tokens written with leet
characters, stretched letters or spaced-out letters become lattices of what may have
been meant; Viterbi finds the likeliest reading under the channel's costs and the
model. The restored words' beginnings and whole forms are the features of a logistic
score, learnt from a bounded sample of labelled documents.
"""

from __future__ import annotations

import itertools
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelith.llm.common import materialise

#: At most so many labelled documents train the score: the first by a hash of doc_id.
MAX_LABELLED = 12_000
#: At most so many features are weighed.
MAX_FEATURES = 20_000
#: Decoded tokens that a task remembers.
CACHED = 150_000
FOLDS = 5
BEGINNINGS = (4, 5, 6, 7)
MIN_TOXIC_DOCS, MIN_RATIO = 3, 4.0

#: What a character may stand for (fixed values).
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "li",
    "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "¡": "i", "*": "aeiou", "#": "h",
}
#: Letters of other scripts that look Latin (fixed values).
LOOKALIKES = str.maketrans("аеіокрсухвмнтѕјԁοαερυνικτ", "aeiokpcyxbmhtsjdoaepuvikt")
ZERO_WIDTH = re.compile("[­​-‏⁠﻿]")
SEPARATORS = ".-_*/~'"
EDGE = ".,;:?!\"'()[]{}…«»“”„"
#: Channel costs in nats.
COST_LEET, COST_KEPT, COST_DROP, COST_FEWER, COST_STRETCH = 0.5, 4.0, 0.5, 0.3, 3.0

ALPHABET = "\0abcdefghijklmnopqrstuvwxyzßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ9?"
SIZE = 64
INDEX = {c: i for i, c in enumerate(ALPHABET)}
_CLASS = np.zeros(256, np.int64)
for _b in range(256):
    _c = bytes([_b]).decode("latin-1")
    _CLASS[_b] = INDEX.get(_c, INDEX["9"] if _c.isdigit() else 0)


def symbol(c: str) -> int:
    return INDEX.get(c, INDEX["9"] if c.isdigit() else INDEX["?"] if not c.isspace() else 0)


# --- character model -------------------------------------------------------------------------------


def trigram_counts(texts: list[str | None]) -> np.ndarray:
    """Counts of three characters in a row, white space and signs standing for a word's edge."""
    joined = " \n ".join(t.lower() for t in texts if t).encode("latin-1", "replace")
    c = _CLASS[np.frombuffer(joined, np.uint8)]
    if len(c) < 3:
        return np.zeros(SIZE**3, np.int64)
    return np.bincount((c[:-2] * SIZE + c[1:-1]) * SIZE + c[2:], minlength=SIZE**3)


class CharModel:
    """Log-probability of a character after two others, smoothed by shorter contexts."""

    def __init__(self, counts: np.ndarray):
        three = counts.reshape(SIZE, SIZE, SIZE).astype(float)
        one = three.sum((0, 1)) + 0.5
        two = three.sum(0)
        p1 = one / one.sum()
        p2 = (two + 5 * p1) / (two.sum(1, keepdims=True) + 5)
        p3 = (three + 5 * p2[None]) / (three.sum(2, keepdims=True) + 5)
        self.log = np.log(p3).tolist()

    def __call__(self, a: int, b: int, c: int) -> float:
        return self.log[a][b][c]


def readings(run: str) -> list[tuple[str, float]]:
    """What a run of equal characters may be, and the cost."""
    c, n = run[0], len(run)
    if c.isalpha():
        kept = [(run, 0.0 if n < 3 else COST_STRETCH * (n - 2))]
        fewer = [(c, COST_FEWER if n > 2 else COST_STRETCH)] if n > 1 else []
        twice = [(c * 2, COST_FEWER)] if n > 2 else []
        return kept + fewer + twice
    options = [(run, COST_KEPT)]
    options += [(x, COST_LEET + (1.0 if c in "*#" else 0.0)) for x in LEET.get(c, "")]
    if n == 2:
        options += [(x * 2, COST_LEET) for x in LEET.get(c, "")]
    if c in SEPARATORS or c.isspace():
        options.append(("", COST_DROP))
    return options


class _Steps(dict):
    """Run -> its readings with their symbols, made once for each short run."""

    def __missing__(self, run: str) -> list[tuple[str, float, tuple[int, ...]]]:
        made = [(piece, cost, tuple(map(symbol, piece))) for piece, cost in readings(run)]
        if len(run) <= 4 and len(self) < 100_000:
            self[run] = made
        return made


_steps = _Steps()
RUNS = re.compile(r"(.)\1*", re.S)


def lattice(token: str) -> list[list[tuple[str, float]]]:
    """For each run of equal characters: what it may be, and the cost."""
    return [readings(m.group()) for m in RUNS.finditer(token)]


def decode(token: str, model: CharModel, edges: bool = False) -> str:
    """The likeliest reading of a token: Viterbi over states of the last two characters.

    edges: signs at its ends may also be plain punctuation, which costs nothing.
    """
    log = model.log
    states: dict[tuple[int, int], tuple[float, str]] = {(0, 0): (0.0, "")}
    steps = [_steps[m.group()] for m in RUNS.finditer(token)]
    if edges:
        outer = lambda runs: list(itertools.takewhile(lambda k: steps[k][0][0][0] in EDGE, runs))
        for k in {*outer(range(len(steps))), *outer(range(len(steps) - 1, -1, -1))}:
            steps[k] = [*steps[k], ("", 0.0, ())]
    for options in steps:
        new: dict[tuple[int, int], tuple[float, str]] = {}
        for (a, b), (score, text) in states.items():
            for piece, cost, symbols in options:
                s, x, y = score - cost, a, b
                for z in symbols:
                    s += log[x][y][z]
                    x, y = y, z
                if (x, y) not in new or s > new[x, y][0]:
                    new[x, y] = (s, text + piece)
        states = new
    return max((s + log[a][b][0], t) for (a, b), (s, t) in states.items())[1]


#: Edge signs that stand for no letter.
SOFT = "".join(c for c in EDGE if c not in LEET)
#: What the lattice has a second reading for: a letter again, or a sign that may be a letter or nothing.
CODED = re.compile(rf"([^\W\d_])\1|[{re.escape(''.join(LEET) + SEPARATORS)}]")
LETTER = re.compile(r"[^\W\d_]")
SPACED = re.compile(r"(?<!\S)(?:[^\s.\-_*/~][ .\-_*/~]+){2,}[^\s.\-_*/~](?!\w)")


def restore(token: str, model: CharModel) -> str:
    """A lower-cased token, bare of signs at its edges, as it was probably meant."""
    if not token.isascii():
        token = ZERO_WIDTH.sub("", token).translate(LOOKALIKES)
    bare = token.strip(EDGE)
    if not bare:
        return ""
    token = token.strip(SOFT)
    if not CODED.search(token) or not (LETTER.search(token) or not any(map(str.isdigit, token))):
        return bare
    return decode(token, model, edges=True).strip(EDGE)


def spaced(text: str, model: CharModel) -> list[str]:
    """Words spelt out with blanks or signs between the letters."""
    return [decode(re.sub(r"[ .\-_*/~]", "", m.group(0)), model).strip(EDGE) for m in SPACED.finditer(text)]


def features_of(word: str) -> list[str]:
    return [f"={word}", *(word[:n] for n in BEGINNINGS if len(word) > n - 1)] if len(word) >= 3 else []


# --- learning ---------------------------------------------------------------------------------------


def _words(text: str | None, model: CharModel, cache: dict[str, str]) -> set[str]:
    low = (text or "").lower()
    out = set()
    for t in set(low.split()):
        word = cache.get(t)
        if word is None:
            if len(cache) > CACHED:
                cache.clear()
            cache[t] = word = restore(t, model)
        out.add(word)
    out.update(spaced(low, model))
    return out


def fit_logistic(rows: list[np.ndarray], y: np.ndarray, n: int, ridge: float = 0.01, steps: int = 400) -> tuple[np.ndarray, float]:
    """Weights and bias for sets of feature numbers; accelerated gradient steps."""
    w, bias = np.zeros(n), math.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)) if len(y) else -2.0
    if not n or not len(y):
        return w, bias
    sizes = np.array([len(r) for r in rows])
    cols, owner = np.concatenate(rows).astype(np.int64), np.repeat(np.arange(len(rows)), sizes)
    lipschitz = 0.25 * max(1.0, float(np.bincount(cols, minlength=n).max()) * max(1, sizes.max())) / 4
    v, vb, t = w.copy(), bias, 1.0
    for _ in range(steps):
        z = np.bincount(owner, v[cols], len(rows)) + vb
        r = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
        nw = v - (np.bincount(cols, r[owner], n) + ridge * v) / (lipschitz + ridge)
        nb = vb - r.sum() / (0.25 * len(y))
        t2 = (1 + math.sqrt(1 + 4 * t * t)) / 2
        v, vb = nw + (t - 1) / t2 * (nw - w), nb + (t - 1) / t2 * (nb - bias)
        w, bias, t = nw, nb, t2
    return w, bias


def count_trigrams(docs: DataFrame) -> np.ndarray:
    """Over all documents; the result has SIZE**3 cells, whatever the corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SIZE**3, np.int64)
        for b in batches:
            total += trigram_counts(b.column("text").to_pylist())
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["gram", "n"])

    rows = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(SIZE**3, np.int64)
    for r in rows:
        out[r["gram"]] = r["n"]
    return out


class Scorer:
    def __init__(self, counts: np.ndarray, weights: dict[str, float], bias: float):
        self.counts, self.weights, self.bias = counts, weights, bias

    def run(self, texts: list[str | None], model: CharModel, cache: dict[str, tuple]) -> list[float]:
        out, weights = [], self.weights
        starts = {f[: BEGINNINGS[0]] for f in weights if f[0] != "="}  # a word with no such start and no whole form has no feature
        for text in texts:
            low = (text or "").lower()
            found: set[str] = set()
            for t in set(low.split()):
                hit = cache.get(t)
                if hit is None:
                    if len(cache) > CACHED:
                        cache.clear()
                    word = restore(t, model)
                    known = word[: BEGINNINGS[0]] in starts or f"={word}" in weights
                    cache[t] = hit = tuple(f for f in features_of(word) if f in weights) if known else ()
                if hit:
                    found.update(hit)
            for word in spaced(low, model):
                found.update(f for f in features_of(word) if f in weights)
            z = self.bias + sum(weights[f] for f in sorted(found))
            out.append(1 / (1 + math.exp(-max(-30.0, min(30.0, z)))))
        return out


def held_out_fold():
    return F.crc32(F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


def learn(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, max_features: int = MAX_FEATURES) -> Scorer:
    counts = count_trigrams(docs)
    picked = (
        labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL")
        .select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
        .where(~held_out_fold())
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(max_labelled)
    )
    # at most max_labelled rows of two numbers: a proven bound
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # one row for each labelled doc_id, however often it stands in docs
    sample = texts.join(F.broadcast(picked), "doc_id").groupBy("doc_id").agg(F.min(F.struct("toxic", "text")).alias("r")).select("doc_id", "r.toxic", "r.text")
    sample = materialise(sample, "toxicity-sample").repartition(16)

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, cache, toxic, clean, n = CharModel(counts), {}, Counter(), Counter(), [0, 0]
        for b in batches:
            for text, y in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist()):
                found = {f for w in _words(text, model, cache) for f in features_of(w)}
                (toxic if y == 1 else clean).update(found)
                n[y == 1] += 1
        for seen, at in ((toxic, 0), (clean, 1)):
            names, counts_ = ["", *seen], [n[1 - at], *seen.values()]
            zero = [0] * len(names)
            yield pa.RecordBatch.from_arrays(
                [pa.array(names), pa.array(counts_ if at == 0 else zero, pa.int64()), pa.array(counts_ if at else zero, pa.int64())], ["feature", "toxic", "clean"]
            )

    tallied = sample.select("text", "toxic").mapInArrow(tally, "feature string, toxic long, clean long").groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    tallied = materialise(tallied.where(f"feature = '' OR toxic >= {MIN_TOXIC_DOCS}"), "toxicity-features")
    total = tallied.where("feature = ''").first()
    n_toxic, n_clean = (total["toxic"], total["clean"]) if total else (0, 0)
    ratio = ((F.col("toxic") + 0.5) / (n_toxic + 1)) / ((F.col("clean") + 0.5) / (n_clean + 1))
    chosen = tallied.where("feature <> ''").withColumn("ratio", ratio).where(F.col("ratio") >= MIN_RATIO)
    chosen = [r["feature"] for r in chosen.orderBy((F.col("toxic") * F.log("ratio")).desc(), "feature").limit(max_features).collect()]
    number = {f: i for i, f in enumerate(chosen)}

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, cache = CharModel(counts), {}
        for b in batches:
            found = [sorted({number[f] for w in _words(t, model, cache) for f in features_of(w) if f in number}) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("toxic"), pa.array(found, pa.list_(pa.int32()))], ["doc_id", "toxic", "x"])

    rows = sorted((r["doc_id"], r["toxic"], r["x"]) for r in sample.select("doc_id", "toxic", "text").mapInArrow(pick, "doc_id long, toxic int, x array<int>").collect())
    w, bias = fit_logistic([np.array(x, np.int64) for _, _, x in rows], np.array([float(y == 1) for _, y, _ in rows]), len(chosen))
    return Scorer(counts, {f: float(w[i]) for f, i in number.items() if w[i]}, float(bias))


def score(docs: DataFrame, scorer: Scorer) -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted.

    Null and empty texts have no features and the score of the bias. Repeated rows
    give equal rows; an empty table gives none; only doc_id (for held_out) and text
    are read, and texts whole. A null doc_id has the fold of an empty text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, cache = CharModel(scorer.counts), {}
        for b in batches:
            s = np.array(scorer.run(b.column("text").to_pylist(), model, cache), float)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("held_out"), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"]
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out_fold().alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def op9_toxicity(spark, sf_dir: str) -> DataFrame:
    """score() of all documents, learnt from the labels outside the held-out fold; nulls, repeats and empty tables as there."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs, learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
