"""Plain-Python twins of the native operators, very long texts, clashing columns, and recall on a whole table."""

from __future__ import annotations

import datetime
import hashlib
import random
import sys
from pathlib import Path

import pytest
import regex
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
sys.path.insert(0, str(Path(__file__).parents[2]))
import brute

import corpus_pipeline
from pagelith.llm import decontamination as D
from pagelith.llm import html_extraction, line_dedup, near_duplicates, packing, pseudonyms, quality_rules, substring_dedup, suffix_dedup, toxicity


def frame(spark, rows, more=""):
    return spark.createDataFrame(rows, brute.SCHEMA + more)


# --- decontamination ---


def template(text: str) -> list[str]:
    t = text.translate({ord(c): None for c in D.NUMBER + D.UNIT + D.NAME})
    t = regex.sub(r"(?<![\p{L}\p{N}_])[+-]?[0-9]+(?:[.,:/][0-9]+)*", D.NUMBER, t)
    t = regex.sub(rf"(?i)(?<={D.NUMBER} ?)(?:{D.UNITS})(?![\p{{L}}\p{{N}}])", D.UNIT, t)
    t = regex.sub(rf"(?<=[\p{{Ll}}\p{{N}}{D.NUMBER},;] )\p{{Lu}}\p{{Ll}}[\p{{L}}'’-]*", D.NAME, t)
    return regex.sub(rf"[^\p{{L}}\p{{N}}{D.NUMBER}{D.UNIT}{D.NAME} \t\n]+", "", t.lower()).split()


def plain(text: str) -> list[str]:
    return regex.sub(r"[^\p{L}\p{N} \t\n]+", "", text.lower()).split()


def slot(token: str) -> bool:
    return any(c in token for c in (D.NUMBER, D.UNIT, D.NAME))


def found(doc: str, item: str, coverage: float = 0.6) -> bool:
    it, ir, dt, dr = template(item), plain(item), template(doc), plain(doc)
    n, width = len(it), D.width_of(len(it))
    placed, best = set(), 0
    for shift in range(-n, len(dt)):
        there = [0 <= shift + i < len(dt) and it[i] == dt[shift + i] for i in range(n)]
        if not any(all(there[p : p + width]) and any(not slot(x) for x in it[p : p + width]) for p in range(n - width + 1)):
            continue
        m = [i for i in range(n) if there[i]]
        literals = sum(not slot(it[i]) for i in m)
        if literals < D.EVIDENCE:
            m = [i for i in m if ir[i] == dr[shift + i]] if literals else []
        pairs = {(ir[i], dr[shift + i]) for i in m if slot(it[i])}
        if len({a for a, _ in pairs}) != len(pairs) or len({b for _, b in pairs}) != len(pairs):
            continue
        placed |= set(m)
        best = max(best, len(m))
    return n > 0 and (best if n < 4 else len(placed)) / n >= coverage


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_decontamination_against_brute_force(spark, seed):
    r = random.Random(seed)
    vocabulary = "alpha beta gamma delta 5 17 3.5 km Anna Boris of the, (and) zeta".split()
    words = lambda k: " ".join(r.choice(vocabulary) for _ in range(k))
    items = ["42", "alpha", "for 7", "3 5 9 11", *(words(r.randint(2, 20)) for _ in range(14))]
    docs = ["We saw 7 apples there.", "wait for 7 now", "wait for 8 now", "1 2 3 4 5 6 7 8 9", None, ""]
    for t in items:
        for _ in range(3):
            ws = t.split()
            for _ in range(r.randint(0, 2)):
                ws[r.randrange(len(ws))] = r.choice(vocabulary)
            swapped = {w: r.choice(["8", "99", "Carla", w]) for w in ws}
            ws = [swapped[w] if w[0].isdigit() or w in ("Anna", "Boris") else w for w in ws][: r.randint(1, len(ws) + 5)]
            docs.append(words(r.randint(0, 6)) + " " + " ".join(ws) + " " + words(r.randint(0, 6)))
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    rows = [(i, t, "", "", 0) for i, t in enumerate(docs)]
    got = {x.doc_id: x.item_ids for x in D.judge(frame(spark, rows), bench).collect()}
    assert got == {i: [j for j, t in enumerate(items) if found(d or "", t)] for i, d in enumerate(docs)}
    assert got[0] == [] and got[1] == [2] and got[2] == [] and got[3] == []


def test_large_benchmarks_are_joined_by_shuffle(spark, data, monkeypatch):
    docs, bench = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/benchmark.parquet")
    want = sorted(map(str, D.judge(docs, bench).collect()))
    monkeypatch.setattr(D, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(D, "BROADCAST_BYTES", 0)
    assert sorted(map(str, D.judge(docs, bench).collect())) == want


# --- pseudonyms ---


def prf(key, tag, rnd, value):
    return hashlib.sha256(f"{key}:{tag}:{rnd}:{value}".encode()).hexdigest()


def pair(key, tag, x, y, a, b):
    for r in range(pseudonyms.ROUNDS):
        if r % 2 == 0:
            x = (x + int(prf(key, tag, r, y)[:13], 16)) % a
        else:
            y = (y + int(prf(key, tag, r, x)[:13], 16)) % b
    return x, y


def letters(key, tag, text):
    x, y = text[: len(text) // 2], text[len(text) // 2 :]
    for r in range(pseudonyms.ROUNDS):
        digest, new = prf(key, tag, r, y), ""
        for i, c in enumerate(x):
            k = int(digest[i % 32 * 2 :][:2], 16)
            first, size = (48, 10) if "0" <= c <= "9" else (97, 26) if "a" <= c <= "z" else (65, 26) if "A" <= c <= "Z" else (0, 0)
            new += chr(first + (ord(c) - first + k) % size) if size else c
        x, y = y, new
    return x + y


def check_digit(payload: str) -> str:
    total = sum(int(c) if i % 2 else (int(c) * 2 - 9 if int(c) > 4 else int(c) * 2) for i, c in enumerate(payload[::-1]))
    return str(-total % 10)


def test_feistel_against_plain_python(spark):
    r = random.Random(3)
    texts = ["".join(r.choice("abcXYZ0189._") for _ in range(r.randint(0, 40))) for _ in range(60)]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", pseudonyms.permute_text("k", "tag", F.col("t")).alias("p")).collect()
    assert all(x.p == letters("k", "tag", x.t) for x in got)
    pairs = [(r.randrange(898), r.randrange(989901)) for _ in range(60)]
    got = spark.createDataFrame(pairs, "x long, y long").select("x", "y", pseudonyms.permute_pair("k", "t", F.col("x"), F.col("y"), 898, 989901).alias("p")).collect()
    assert all(tuple(x.p) == pair("k", "t", x.x, x.y, 898, 989901) for x in got)


def test_formats_against_plain_python(spark):
    r = random.Random(5)
    rows, want = [], []
    for _ in range(25):
        card = "".join(r.choice("0123456789") for _ in range(15))
        card += check_digit(card)
        new = card[0] + letters("k", "card", card[1:15])
        day = datetime.date(1000, 1, 1) + datetime.timedelta(r.randrange(945 * 773 - 2000))
        x, y = pair("k", "date", *divmod((day - datetime.date(1000, 1, 1)).days, 773), 945, 773)
        o = [r.randrange(256) for _ in range(4)]
        a, b = pair("k", "ip", o[0] * 256 + o[1], o[2] * 256 + o[3], 65536, 65536)
        rows.append(f"{card} on {day} at {'.'.join(map(str, o))}!")
        moved = datetime.date(1000, 1, 1) + datetime.timedelta(x * 773 + y)
        want.append(f"{new}{check_digit(new)} on {moved} at {a // 256}.{a % 256}.{b // 256}.{b % 256}!")
    got = pseudonyms.pseudonymise(frame(spark, [(i, t, "", "", 0) for i, t in enumerate(rows)]), "k").orderBy("doc_id").collect()
    assert [x.text for x in got] == want


# --- near duplicates ---


def test_recall_on_a_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = brute.near([(x.doc_id, x.text) for x in docs.collect()])
    got = {x.doc_id: tuple(x)[1:] for x in near_duplicates.near_duplicates(docs).collect()}
    linked = [d for d in want if want[d][1]]
    assert len(linked) > 50 and sum(got[d] == want[d] for d in linked) / len(linked) > 0.99 and all(got[d][1] <= want[d][1] for d in want)


def test_texts_that_share_a_band_do_not_chain(spark):
    """Neighbours of a long chain share half their words: candidates of bands, but no links and no large component."""
    r = random.Random(1)
    words = [f"w{i}" for i in range(4000)]
    texts = [" ".join(words[i * 30 : i * 30 + 100]) for i in range(120)]
    docs = frame(spark, [(i, t, "", "", 0) for i, t in enumerate(texts)])
    bands, rows = near_duplicates.choose_bands(0.8, near_duplicates.RECALL)
    cut = near_duplicates.choose_agreement(0.8, bands * rows, near_duplicates.RECALL)
    classes = near_duplicates.sign(docs, bands, rows).withColumn("node", F.xxhash64("set_key"))
    shared = classes.select("node", F.explode("bands").alias("h")).groupBy("h").count().where("count > 1").count()
    assert shared > 100 and near_duplicates.agreeing(classes, cut).count() < 10
    assert all(x.n_links == 0 for x in near_duplicates.near_duplicates(docs).collect()) and r


# --- all ten ---


def operators(spark):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, "one two three four five six seven"), (None, None)], "item_id long, text string")
    return {
        "op1": suffix_dedup.dedup_substrings,
        "op2": lambda d: html_extraction.extract_pages(d.withColumnRenamed("doc_id", "page_id").withColumn("html", F.col("text")).withColumn("url", F.lit("u"))),
        "op3": lambda d: D.judge(d, bench),
        "op4": substring_dedup.dedup_word_windows,
        "op5": packing.pack,
        "op6": lambda d: quality_rules.judge(d, quality_rules.train(d, labels)),
        "op7": near_duplicates.near_duplicates,
        "op8": line_dedup.dedup_lines,
        "op9": lambda d: toxicity.score(d, toxicity.learn(d, labels)),
        "op10": lambda d: pseudonyms.pseudonymise(d, "k"),
    }


NAMES = ("op1", "op2", "op3", "op4", "op5", "op6", "op7", "op8", "op9", "op10")
CLASH = ", k1 string, k2 string, row string, node string, pos int, hash int, hit int, size int, label string, score string, kept int, item_id int, shift int, toxic string, quality string, x int"


@pytest.mark.parametrize("name", NAMES)
def test_clashing_columns_nulls_repeats_and_empty_tables(spark, name):
    operator = operators(spark)[name]
    extra = ("a", "b", "c", "d", 1, 2, 3, 4, "e", "f", 5, 6, 7, "g", "h", 8)
    texts = [(1, "one two three four five six seven " * 12), (1, "one two three four five six seven " * 12), (2, None), (2, ""), (None, "x"), (None, None)]
    docs = frame(spark, [(d, t, None, None, None, *extra) for d, t in texts], CLASH)
    pieces = operator(docs).collect()
    assert len(pieces) == len(texts) if name != "op5" else sum(p.start == 0 for p in pieces) == len(texts)
    assert operator(docs.where("false")).count() == 0


@pytest.fixture(scope="module")
def long_texts():
    n = 200_000
    return [
        ",".join(str(i % 1000) for i in range(n // 4)), "a@" + ".".join("ab" for _ in range(n // 3)), "Ab9+/Zq3" * (n // 8), "word soup and more " * (n // 19),
        "x" * n, "4" * n, "1.1.1." * (n // 6), "1-2-3-" * (n // 6), " " * n, "@" * n, "+1 " * (n // 3), "ab\n" * (n // 3), "password=" + "k" * n,
        "said Alice Bob " * (n // 15), "<a " * (n // 3), "<svg><p>" * (n // 8), "<a \"> '" * (n // 7), "\n".join(f"a line of text that many documents hold, number {i}" for i in range(n // 50)),
    ]


@pytest.mark.parametrize("name", NAMES)
def test_very_long_texts(spark, long_texts, name):
    docs = frame(spark, [(i, t, "", "", 0) for i, t in enumerate([*long_texts, *long_texts[-1:] * 5])]).repartition(4)
    rows = operators(spark)[name](docs).collect()
    assert len(rows) >= docs.count()
    if name == "op8":
        assert sorted(r.n_dropped for r in rows if r.n_lines == 4000) == [0] + [4000] * 5
    if name == "op10":
        assert {r.doc_id: r.text for r in rows}[4] == long_texts[4]


def test_stages_take_long_texts_and_clashing_columns(spark, data, long_texts):
    extra = ("a", "b", "c", "d", 1, 2, 3, 4, "e", "f", 5, 6, 7, "g", "h", 8)
    docs = frame(spark, [(i, t, "", "", 0, *extra) for i, t in enumerate(long_texts)], CLASH)
    for _, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, data)
        assert out.columns == docs.columns and out.count() <= len(long_texts)
    assert {r.doc_id for r in packing.pack(docs).collect()} == set(range(len(long_texts)))
