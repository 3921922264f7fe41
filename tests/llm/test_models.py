"""Packing, quality, toxicity, HTML, decontamination and pseudonyms."""

from __future__ import annotations

import re
import sys
import zlib
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import brute

from pagelith.llm import decontamination, html_extraction, html_pages, html_tree, packing, pseudonyms, quality_rules, toxicity, trees


def frame(spark, rows):
    return spark.createDataFrame(rows, brute.SCHEMA)


# --- packing ---


@given(st.lists(st.integers(1, 31), max_size=300))
@settings(max_examples=60, deadline=None)
def test_plan_places_every_token_once(lengths):
    hist = np.bincount(lengths, minlength=32) if lengths else np.zeros(32, int)
    plan = packing.solve(hist, 32)
    cells: dict[int, set] = {}
    for length, n in enumerate(hist):
        for k in range(n):
            done = 0
            for start, size, seq, offset in plan.place(length, k):
                assert start == done and size > 0
                done += size
                spots = set(range(offset, offset + size))
                assert not spots & cells.setdefault(seq, set())
                cells[seq] |= spots
            assert done == length
    for spots in cells.values():
        fill = len(spots)
        assert spots == set(range(fill)) and (fill == 32 or fill & (fill - 1) == 0)


def test_least_squares_fits_a_fillable_histogram():
    hist = np.zeros(64, int)
    hist[[20, 44, 10, 54]] = [30, 30, 7, 7]
    combos = packing.combinations(hist, 64, 4, 1000)
    x = packing.nnls(combos, hist)
    fitted = np.bincount(combos.ravel(), np.repeat(x, 4), 64)
    fitted[0] = 0
    assert np.abs(fitted[[20, 44, 10, 54]] - hist[[20, 44, 10, 54]]).max() < 0.5 and (x >= 0).all()


def test_packing_round_trip(spark, data):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.default_tokenizer_path())
    docs = spark.read.parquet(f"{data}/documents.parquet").union(frame(spark, [(9001, None, "", "", 0), (9002, "", "", "", 0), (9003, "<|endoftext|> “q” ½", "", "", 0)]))
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    pieces = packing.pack(docs).collect()
    by, seqs = {}, {}
    for p in pieces:
        by.setdefault(p.doc_id, []).append(p)
        seqs.setdefault(p.sequence_id, []).append((p.offset, p.length))
    assert set(by) == set(texts)
    for d, ps in by.items():
        ids = [*t.encode(texts[d], add_special_tokens=False).ids, 1]
        at = 0
        for p in sorted(ps, key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids)
            assert zlib.crc32(np.array(ids[at : at + p.length], "<u4").tobytes()) == p.ids_crc32
            at += p.length
        assert at == len(ids)
    for spots in seqs.values():
        fill = 0
        for o, n in sorted(spots):
            assert o == fill
            fill += n
        assert fill <= 2048 and (fill == 2048 or fill & (fill - 1) == 0)


@given(st.text(alphabet="ab's.,'t 1\n\té“ßİ\x1c中<|>", max_size=40))
@settings(max_examples=300, deadline=None)
def test_encoder_equals_the_tokenizer(text):
    e = packing.shared_encoder(packing.default_tokenizer_path())
    assert np.frombuffer(e.one(text), e.type).tolist() == e.tokenizer.encode(text, add_special_tokens=False).ids


# --- quality ---


@given(st.text(alphabet="ab #|\n\t é", max_size=80))
@settings(max_examples=200, deadline=None)
def test_statistics(text):
    assert quality_rules.statistics(text)[0] == brute.base_statistics(text)


def test_quality_on_held_out_labels(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    half = labels.where("doc_id % 2 = 0")
    got = quality_rules.judge(docs, quality_rules.train(docs, half)).join(labels.where("doc_id % 2 = 1"), "doc_id").where("NOT base_failed").collect()
    right = sum(r.kept == (r.quality == 1) for r in got)
    assert len(got) > 100 and right / len(got) > 0.97


def test_monotone_features_hold():
    r = np.random.default_rng(0)
    x = r.random((600, 3))
    y = (x[:, 0] + 0.3 * r.standard_normal(600) > 0.5).astype(float)
    f = trees.fit(x, y, monotone={0: 1, 1: -1})
    line = np.tile(r.random(3), (50, 1))
    line[:, 0] = np.linspace(0, 1, 50)
    assert (np.diff(f.margin(line)) >= -1e-12).all()
    line = np.tile(r.random(3), (50, 1))
    line[:, 1] = np.linspace(0, 1, 50)
    assert (np.diff(f.margin(line)) <= 1e-12).all()
    assert ((f.score(x) > 0.5) == (y > 0)).mean() > 0.8


def test_quality_edges(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs = frame(spark, [(1, None, None, None, None), (None, "a " * 60, None, None, None), (3, " ".join(map(str, range(80))), None, None, None)])
    got = {r.doc_id: (r.n_words, r.base_failed, r.kept) for r in quality_rules.judge(docs, quality_rules.train(docs, labels)).collect()}
    assert got == {1: (0, True, False), None: (60, True, False), 3: (80, False, True)}
    assert quality_rules.judge(docs.where("false"), quality_rules.train(docs, labels)).count() == 0


# --- toxicity ---


@pytest.fixture(scope="module")
def scorer(spark):
    d = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    return toxicity.learn(docs, spark.read.parquet(f"{d}/labels.parquet")), docs, spark.read.parquet(f"{d}/labels.parquet")


def test_toxicity_held_out(scorer):
    s, docs, labels = scorer
    got = toxicity.score(docs, s).where("held_out").join(labels, "doc_id").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in got)
    caught = [r.predicted for r in got if r.toxic == 1]
    clean = [r.predicted for r in got if r.toxic == 0]
    assert sum(caught) / len(caught) > 0.8 and sum(clean) / len(clean) < 0.02


@pytest.mark.parametrize(("written", "meant"), [("1d10t", "idiot"), ("stuuupid", "stupid"), ("$cum", "scum"), ("l0s3r", "loser"), ("i-d-i-o-t", "idiot"), ("tr@sh", "trash"), ("the!!", "the"), ("2020", "2020")])
def test_deobfuscation(scorer, written, meant):
    assert toxicity.restore(written, toxicity.CharModel(scorer[0].counts)) == meant


def test_spaced_letters(scorer):
    assert toxicity.spaced("you i d i o t and l.o.s.e.r", toxicity.CharModel(scorer[0].counts)) == ["idiot", "loser"]


@pytest.mark.parametrize(("written", "meant"), [("stuupiid", "stupid"), ("looser.", "loser"), ("(the)", "the"), ("what!", "what"), ("2020-01-02", "2020-01-02")])
def test_lattice_decides(scorer, written, meant):
    assert toxicity.restore(written, toxicity.CharModel(scorer[0].counts)) == meant


def test_every_coded_token_is_decoded(monkeypatch):
    seen = []
    monkeypatch.setattr(toxicity, "decode", lambda token, model, edges=False: seen.append(token) or token)
    words = ["shiit", "fuucckk", "fuc*", "stupi!", "(unt", "<unt", "plain", "12-3"]
    for w in words:
        toxicity.restore(w, None)
    assert seen == words[:6]
    seen.clear()
    toxicity.spaced("a s s or i  d  i  o  t or s.-h.-i.-t and a b", None)
    assert seen == ["ass", "idiot", "shit"]
    assert toxicity.spaced("-" * 5000 + "a" + ". " * 5000 + "b", None) == []


def test_viterbi_is_best(scorer):
    import itertools

    model = toxicity.CharModel(scorer[0].counts)
    for token in ("l0s3r", "aaab", "1d1*t"):
        best = None
        for path in itertools.product(*toxicity.lattice(token)):
            a = b = 0
            score = 0.0
            for piece, cost in path:
                score -= cost
                for c in piece:
                    z = toxicity.symbol(c)
                    score += model(a, b, z)
                    a, b = b, z
            score += model(a, b, 0)
            best = max(best or (score, ""), (score, "".join(p for p, _ in path)))
        assert toxicity.decode(token, model) == best[1]


def test_toxicity_edges(spark):
    docs = frame(spark, [(1, None, None, None, None), (None, "", None, None, None)])
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    s = toxicity.learn(docs, labels)
    assert [0 <= r.score <= 1 and r.predicted == 0 for r in toxicity.score(docs, s).collect()] == [True, True]
    assert toxicity.score(docs.where("false"), s).count() == 0


# --- html ---


def test_extraction_on_unseen_layouts():
    model, made, exact = html_extraction.forest(), html_pages.Pages(99), 0
    for _ in range(60):
        page = made.page()
        nodes = html_tree.nodes_of(html_tree.parse(page))
        bad = np.zeros(len(nodes), bool)
        for i, n in enumerate(nodes):
            bad[i] = n.attributes.get("data-kind") == "0" or (n.parent is not None and bad[n.parent.order])
        exact += html_extraction.extract([page], model)[0] == "\n".join(html_extraction.blocks(nodes, ~bad))
    assert exact >= 54


def test_extraction_of_the_tables_pages(spark, data):
    rows = spark.read.parquet(f"{data}/pages.parquet").collect()
    got = {r.page_id: r for r in html_extraction.op2_html_extraction(spark, data).collect()}
    for r in rows:
        article = re.search("<article>(.*)</article>", r.html, re.S).group(1)
        import html

        parts = [" ".join(html.unescape(re.sub(r"<[^>]+>", " ", x)).split()) for x in re.split(r"<(?:p|h1|/p|/h1)>", re.sub("</?b>", "", article))]
        assert got[r.page_id].text == "\n".join(p for p in parts if p) and got[r.page_id].n_chars == len(got[r.page_id].text)


def test_decoding_never_contradicts():
    r = np.random.default_rng(1)
    nodes = html_tree.nodes_of(html_tree.parse("<div><section><p>a</p><p>b</p></section><div><p>c</p><ul><li>d<li>e</ul></div></div>"))
    for _ in range(200):
        odds = r.standard_normal(len(nodes))
        keep = html_extraction.decode(nodes, odds)
        assert all(keep[n.parent.order] for n in nodes if keep[n.order] and n.parent is not None)


def test_broken_markup():
    model = html_extraction.forest()
    odd = [None, "", "<", "<p", "<p>a<p>b</div></p>", "<script>x", "<article><h1>T &amp; &#233; &bogus;</h1><p>one<b>two</b> three\n four<br>five", "<!-- x", "</p></p>"]
    got = html_extraction.extract(odd, model)
    assert len(got) == len(odd) and got[0] == got[1] == got[5] == ""
    assert got[6] == "T & é &bogus;\nonetwo three four five"


# --- decontamination ---


def test_leaks_match_containment(spark):
    d = "/root/testdata/sf0.01"
    docs, bench = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/benchmark.parquet")
    clean = lambda t: " " + " ".join(re.sub(r"[^\w\s]", "", t.lower()).split()) + " "
    items = [(r.item_id, clean(r.text)) for r in bench.collect()]
    want = {r.doc_id: sorted(i for i, t in items if t in clean(r.text)) for r in docs.collect()}
    assert {r.doc_id: r.item_ids for r in decontamination.judge(docs, bench).collect()} == want


def test_slots_must_be_consistent(spark):
    bench = spark.createDataFrame([(1, "Alice has 12 apples and gives 5 km of rope to Bob, then asks how many 12 apples are left for Bob."), (2, None), (3, "Six of 3.")], "item_id long, text string")
    asked = "So it was. Alice has {} apples and gives {} miles of rope to {}, then asks how many {} apples are left for {}. Yes."
    docs = frame(spark, [(1, asked.format(99, 7, "Carl", 99, "Carl"), "", "", 0), (2, asked.format(99, 7, "Carl", 98, "Dan"), "", "", 0), (3, None, "", "", 0), (4, "it was so. Six of 9. yes", "", "", 0)])
    assert {r.doc_id: r.item_ids for r in decontamination.judge(docs, bench).collect()} == {1: [1], 2: [], 3: [], 4: [3]}
    assert decontamination.judge(docs, bench.where("false")).where("contaminated").count() == 0
    assert decontamination.judge(docs.where("false"), bench).count() == 0


def test_partial_and_edited_items_at_every_offset(spark):
    w = lambda a, n: [f"{a}{chr(97 + i)}" for i in range(n)]
    items = {n: w(f"item{chr(97 + n)}", n) for n in (3, 4, 5, 8, 9, 10, 16, 17)}
    bench = spark.createDataFrame([(n, " ".join(t)) for n, t in items.items()], "item_id long, text string")
    rows, want = [], {}
    for n, t in items.items():
        edited = [[*t[:i], "zzz", *t[i + 1 :]] for i in range(n)]
        parts = [t[i : i + -(-6 * n // 10)] for i in (0, n - -(-6 * n // 10))]
        twice = [[*t[:5], "zzz", *t[6:11], "zzz", *t[12:]]] if n > 15 else []
        for k, body in enumerate(edited + parts + twice):
            for offset in range(4):
                rows.append((len(rows), " ".join([*w("before", offset), *body, *w("after", 9)]), "", "", 0))
                want[len(rows) - 1] = [n]
    rows.append((len(rows), " ".join(items[16][:9]), "", "", 0))  # 9 of 16 is less than 0.6
    want[len(rows) - 1] = []
    assert {r.doc_id: r.item_ids for r in decontamination.judge(frame(spark, rows), bench).collect()} == want


# --- pseudonyms ---


def changed(spark, *texts, key="k"):
    rows = pseudonyms.pseudonymise(frame(spark, [(i, t, "", "", 0) for i, t in enumerate(texts)]), key).orderBy("doc_id").collect()
    return [r.text for r in rows], [r.n_found for r in rows]


def luhn(n: str) -> bool:
    return sum(int(c) if i % 2 == 0 else (int(c) * 2 - 9 if int(c) > 4 else int(c) * 2) for i, c in enumerate(n[::-1])) % 10 == 0


def test_equal_values_stay_linked_and_valid(spark):
    (a, b), n = changed(spark, "pay 4111 1111 1111 1111 now", "4111111111111111, 4111111111111112")
    new = b.split(",")[0]
    assert n == [1, 1] and re.sub(r"\D", "", a) == new != "4111111111111111" and luhn(new) and b.endswith("4111111111111112")
    (c,), _ = changed(spark, "4111111111111111", key="other")
    assert c != new


def test_formats_and_checks(spark):
    texts = ["2020-02-29 2021-02-29", "+1 (386) 555-3733", "61.131.143.218 999.1.1.1", "GB82 WEST 1234 5698 7654 32", "a.b12@ex.com", "123-45-6789 000-12-3456", None, "", "12 34"]
    got, n = changed(spark, *texts)
    assert n == [1, 1, 1, 1, 1, 1, 0, 0, 0] and got[0].endswith(" 2021-02-29") and got[2].endswith(" 999.1.1.1") and got[6] is None and got[7:] == ["", "12 34"]
    shape = lambda t: re.sub("[a-z]", "a", re.sub("[A-Z]", "A", re.sub(r"\d", "9", t)))
    assert [shape(g) for g, t in zip(got[1:6:4], texts[1:6:4])] == [shape(t) for t in texts[1:6:4]]
    iban = got[3].replace(" ", "")
    assert int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1 and iban[:2] == "GB"


def test_cards_and_ibans_with_more_behind_or_before(spark):
    card, iban = "4111 1111 1111 1111", "BE68 5390 0754 7034"
    (a, b), _ = changed(spark, card, iban)
    texts = [f"{card} 12/27", f"{card} 123", f"12 {card}", f"{iban} EUR", f"{iban} {card}", "4111 1111 1111 1112 12", "BE68 5390 0754 7035 EUR"]
    got, n = changed(spark, *texts)
    assert got == [f"{a} 12/27", f"{a} 123", f"12 {a}", f"{b} EUR", f"{b} {a}", *texts[5:]] and n == [1, 1, 1, 1, 1, 0, 0]


def test_whole_range_of_dates_and_tokens_in_capitals(spark):
    token = "9233a8ec" * 4
    got, n = changed(spark, "1899-05-03", "2099-12-31", "1000-01-01 2999-12-31", "3/14/1985", "03/14/1985", "4.7.1985", token, token.upper(), "2021-02-29 31.4.1985")
    assert n == [1, 1, 2, 1, 1, 1, 1, 1, 0] and "1899-05-03" not in got[0] and "2099-12-31" not in got[1] and got[7] == got[6].upper() != token.upper()
    assert [int(x) for x in got[3].split("/")] == [int(x) for x in got[4].split("/")] != [3, 14, 1985] and re.fullmatch(r"\d\d?\.\d\d?\.\d{4}", got[5])


def test_permutations_are_one_to_one(spark):
    pairs = spark.range(800 * 3).select(pseudonyms.permute_pair("k", "t", F.col("id") % 80, F.floor(F.col("id") / 80), 80, 30).alias("p"))
    assert pairs.distinct().count() == 2400
    texts = spark.range(1000).select(pseudonyms.permute_text("k", "t", F.lpad(F.col("id").cast("string"), 3, "0")).alias("p"))
    assert texts.distinct().count() == 1000 and texts.where("NOT p rlike '^[0-9]{3}$'").count() == 0


def test_native_plans(spark, data):
    for df in (pseudonyms.op10_pii_pseudonyms(spark, data), decontamination.op3_decontamination(spark, data)):
        assert not re.search("Python|Pandas|Arrow", df._jdf.queryExecution().executedPlan().toString())
