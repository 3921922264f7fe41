"""Approximate places of text, and regions that go on over a page."""

from __future__ import annotations

import random

from pagelith.operators import graphs, ranges, sequential
from pagelith.plans import text_queries
from pagelith.sources import runs


def test_ordered_words_skip_a_number():
    text = "The step requires 1024 - 15 = 1009 operations in all"
    assert ranges.ordered_words(text, "The step requires operations in all") == [(0, 17), (35, 52)]
    assert ranges.ordered_words("alpha beta other words here gamma delta", "alpha beta gamma delta") is None
    assert ranges.ordered_words(text, "no such words are there") is None


def test_ordered_signs():
    assert ranges.ordered_signs("so E 1 = m c holds", "E=mc") == [(3, 4), (7, 8), (9, 10), (11, 12)]
    assert ranges.ordered_signs("E word = m c", "E=mc") is None
    assert ranges.ordered_signs("E = m c", "E m c") is None


def test_near_words_against_all_stretches():
    r = random.Random(4)

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j - 1] + (x != y), row[j] + 1, new[j - 1] + 1))
            row = new
        return row[-1]

    for _ in range(60):
        part = [r.choice("abcdefgh") for _ in range(r.randint(4, 9))]
        text = [r.choice("abcdefgh") for _ in range(r.randint(4, 14))]
        if r.random() < 0.7:
            text[2:2] = [w for w in part if r.random() < 0.95]
        least = min(edits(part, text[i:j]) for i in range(len(text)) for j in range(i + 1, len(text) + 1))
        found = ranges.near_words(" ".join(text), " ".join(part))
        sure = 1 - least / len(part)
        assert (found is None) == (sure < 0.82) and (found is None or abs(found[1] - min(0.95, sure)) < 1e-9)


def test_locate_falls_back_in_order():
    assert ranges.locate("a b c", "b c") == ([(2, 5)], 1.0)
    assert ranges.locate("nothing", "some other longer text") == ([], 0.0)


def rows(spark, *r):
    return spark.createDataFrame(list(r), "doc_id long, page long, id string, type string, x double, y double, w double, h double, column string, label string, hint string")


def test_crossing_links_prefer_evidence(spark):
    r = rows(
        spark, (1, 0, "a", "table", 0.0, 800.0, 500.0, 150.0, "left", "Table 1", None), (1, 0, "b", "table", 0.0, 850.0, 500.0, 100.0, "left", None, None),
        (1, 1, "c", "table", 10.0, 50.0, 500.0, 100.0, "left", "Table 1", None), (1, 1, "d", "table", 0.0, 50.0, 500.0, 100.0, "left", "Table 2", None), (1, 1, "e", "figure", 0.0, 50.0, 500.0, 100.0, "left", None, None),
    )
    c = graphs.crossing_candidates(r)
    assert {(x.tail, x.head) for x in c.collect()} == {("a", "c"), ("b", "c"), ("b", "d")}
    assert {(x.tail, x.head, x.strong) for x in graphs.crossing_links(c).collect()} == {("a", "c", "same-numbered-caption"), ("b", "d", None)}


def test_group_errors(spark):
    r = rows(spark, *[(1, p, f"r{p}", "table", 0.0, 0.0, 1.0, 1.0, "left", None, None) for p in range(4)])
    m = spark.createDataFrame(
        [(1, 0, 0, "r0", "table", "head", None, 2), (1, 0, 1, "r1", "table", "tail", None, 2), (1, 1, 1, "r1", "table", "head", None, 3), (1, 1, 2, "r2", "table", "tail", None, 3),
         (1, 2, 2, "zz", "table", "head", None, 3), (1, 2, 3, "r3", "table", "tail", None, 3), (1, 3, 0, "r0", "table", "tail", None, 3)],
        "doc_id long, grp long, page long, id string, type string, role string, strong string, weak int",
    )
    assert {x.grp: x.code for x in graphs.group_errors(m, r).collect()} == {1: "multiple-group-membership", 2: "unknown-region", 3: "invalid-members"}


def test_a_text_is_read_once_for_all_its_parts(spark, monkeypatch):
    """Words and signs of the text are not made anew for each part, and nothing is shuffled to place them."""
    read = []
    monkeypatch.setattr(ranges, "words_of", lambda text, f=ranges.words_of: read.append(len(text)) or f(text))
    text = ranges.Text(". ".join(f"alpha{i} beta{i} gamma{i} delta{i} words{i} other{i} things{i}" for i in range(200)))
    cursor = 0
    for i in range(200):
        found, sure = ranges.locate(text, f"alpha{i} beta{i} gamma{i} words{i} other{i} things{i}", cursor)
        assert sure == ranges.ORDERED and len(found) == 2 and found[0][0] >= cursor
        cursor = found[-1][1]
    assert sum(n > 1000 for n in read) == 1
    rows = spark.createDataFrame([(1, "A b c. D e f g h.", [(0, "A b c."), (1, "D e g h.")]), (2, "", [])], "doc_id long, text string, listed array<struct<pos int, part string>>")
    placed = ranges.place_listed(rows)
    assert "Exchange" not in placed._jdf.queryExecution().executedPlan().toString()
    assert {tuple(r) for r in placed.collect()} == {(1, 0, 0, 6, 1, 1.0), (1, 1, 7, 16, 2, 0.92)}


def test_places_by_parts_and_by_lists_agree(spark, data):
    docs = text_queries.table(spark, data, "documents").where("text IS NOT NULL").select("doc_id", "text")
    listed = text_queries.approximate_places(spark, data)
    s = docs.select("doc_id", text_queries.F.posexplode(text_queries.T.sentences(text_queries.F.col("text"))).alias("pos", "part"))
    gap = text_queries.F.regexp_replace("part", r"^(\S+ \S+ \S+ )\S+ ", "$1")
    s = s.withColumn("part", text_queries.F.when(text_queries.F.col("pos") % 2 == 0, gap).otherwise(text_queries.F.col("part")))
    assert sorted(map(tuple, listed.collect())) == sorted(map(tuple, ranges.place_parts(s, docs).collect()))


def test_next_alike_beyond_the_near_words():
    r = random.Random(7)
    made = ["".join(r.choice("ab") for _ in range(r.randint(1, 9))) for _ in range(400)]
    t = ranges.Text(" ".join(made))
    for word in {*made[:80], "abababab", "c", "bbbbbbbbbbbb"}:
        for at in (0, 50, 399, 400):
            assert t.next_alike(word, at) == next((i for i in range(at, 400) if ranges.alike(made[i], word)), None)


def test_squeeze_keeps_places():
    for text in ("a b\tc\x1cd", "ﬁ x\u3000Ａ² é e\u0301", "", " "):
        flat, at = sequential.squeeze(text)
        assert len(flat) == len(at) and all(c in sequential.SIGNS[ord(text[i])] for c, i in zip(flat, at))


def test_boxes_of_stretches_are_those_of_their_characters(spark):
    """Runs that follow, overlap, repeat, jump back or have no width; ranges that cut them and one beyond."""
    r, rows, chars = random.Random(3), [], []
    for doc in range(12):
        source = 0
        for _ in range(30):
            n, x, y, width = r.choice([1, 2, 40, 333]), r.choice([50.0, 330.0, 114.0, r.uniform(0, 600)]), r.choice([40.0, 41.5, 58.0]), r.choice([64.0, 64.0, 7.3, 0.0])
            rows.append((doc, source, n, x, y, width / n, 12.0))
            chars += [(doc, source + k, x + k * (width / n), y, width / n, 12.0) for k in range(n)]
            source += n + 1
    of = "doc_id long, source long, {}x double, y double, w double, h double"
    ranges_ = spark.createDataFrame([(d, k, 150 * k, 150 * k + 170) for d in range(12) for k in range(40)], "doc_id long, range_id long, first long, last long")
    whole = runs.range_boxes(spark.createDataFrame(rows, of.format("n int, ")), ranges_).collect()
    single = runs.range_boxes(spark.createDataFrame(chars, of.format("")), ranges_).collect()
    by_key: dict = {}
    for c in chars:
        for k in range(40):
            if 150 * k <= c[1] < 150 * k + 170:
                out = by_key.setdefault((c[0], k), [])
                b = out[-1] if out else None
                if b and abs(c[3] - b[1]) <= 2 and c[2] <= b[0] + b[2] + 4 and b[0] <= c[2] + c[4] + 4:
                    left, right = min(b[0], c[2]), max(b[0] + b[2], c[2] + c[4])
                    b[0], b[2] = left, right - left
                else:
                    out.append([c[2], c[3], c[4], c[5]])
    expected = sorted((*k, *b) for k, boxes in by_key.items() for b in boxes)
    assert sorted(map(tuple, whole)) == sorted(map(tuple, single)) == expected


def test_no_row_per_character_is_shuffled(spark, data):
    plan = text_queries.range_boxes(spark, data)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("explode") == plan.count("posexplode(split") + 1 and "sequence(0, (n" not in plan
