"""Substring, line and near-duplicate operators against brute force, with awkward tables."""

from __future__ import annotations

import sys
from dataclasses import replace
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).parent))
import brute

from pagelith.llm import anchors, line_dedup, near_duplicates, ordering, suffix_dedup, substring_dedup


def frame(spark, rows):
    return spark.createDataFrame(rows, brute.SCHEMA)


def result(df, n):
    return {r[0]: tuple(r)[1 : n + 1] for r in df.collect()}


@pytest.mark.parametrize("seed", [1, 2, 3])
@pytest.mark.parametrize(("length", "gram"), [(30, 8), (12, 12)])
def test_suffix_dedup(spark, seed, length, gram):
    rows = brute.awkward(seed)
    got = result(suffix_dedup.dedup_substrings(frame(spark, rows).repartition(3), length, gram), 4)
    assert got == brute.bytes_dedup(rows, length)


@pytest.mark.parametrize("seed", [1, 2, 3])
@pytest.mark.parametrize(("length", "gram"), [(12, 4), (20, 10)])
def test_substring_dedup(spark, seed, length, gram):
    rows = brute.awkward(seed)
    got = result(substring_dedup.dedup_word_windows(frame(spark, rows).repartition(3), length, gram), 3)
    assert got == brute.words_dedup(rows, length)


@pytest.mark.parametrize("block", [100, 4_000_000])
def test_blocks_of_any_size_agree(spark, monkeypatch, block):
    from pagelith.llm import repeats

    monkeypatch.setattr(repeats, "BLOCK", block)
    rows = brute.awkward(7)
    assert result(suffix_dedup.dedup_substrings(frame(spark, rows), 30, 8), 4) == brute.bytes_dedup(rows, 30)


def test_full_table(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert result(suffix_dedup.op1_suffix_dedup(spark, data), 4) == brute.bytes_dedup(rows, 100)
    assert result(substring_dedup.op4_substring_dedup(spark, data), 3) == brute.words_dedup(rows, 50)


def test_repeated_rows_are_one_document(spark):
    text = "one two three four five six seven eight nine ten " * 3
    df = frame(spark, [(1, text, "en", "s", 1), (1, text, "en", "s", 1), (2, text, "en", "s", 1)])
    got = [(r.doc_id, r.n_removed) for r in substring_dedup.dedup_word_windows(df, 25, 5).collect()]
    assert sorted(got) == [(1, 0), (1, 0), (2, 30)]
    got = sorted((r.doc_id, r.n_removed) for r in suffix_dedup.dedup_substrings(df, 100, 24).collect())
    assert got[0] == got[1] and got[2] == (2, len(text))


def test_blind_tries_and_trees_order_alike():
    r = np.random.default_rng(5)
    for _ in range(100):
        texts = [bytes(r.integers(0, 3, r.integers(0, 12)).astype(np.uint8)) for _ in range(r.integers(1, 30))]
        group = np.sort(r.integers(0, 3, len(texts)))
        for order, lcp in (ordering.deep_shallow(group, texts, 3), ordering.prefix_trees(group, texts, 1, 4)):
            keys = [(group[i], texts[i]) for i in order]
            assert keys == sorted(keys)
            for j in range(1, len(keys)):
                same = keys[j][0] == keys[j - 1][0]
                assert lcp[j] == (ordering.common_prefix(keys[j - 1][1], keys[j][1]) if same else 0)


def test_equal_windows_pick_equal_anchors():
    r = np.random.default_rng(2)
    passage = anchors.mix(r.integers(0, 4, 300).astype(np.uint64))
    a, b = anchors.mix(r.integers(0, 4, 90).astype(np.uint64)), anchors.mix(r.integers(0, 4, 55).astype(np.uint64))
    one, two = np.concatenate([a, passage]), np.concatenate([b, passage])

    def windows(values):
        _, at, lo, hi, h = anchors.find(values, np.array([len(values)]), 40, 10)
        return {int(p - o): (int(o), int(x)) for p, l, u, x in zip(at, lo, hi, h) for o in range(l, u + 1)}

    x, y = windows(one), windows(two)
    assert len(x) == len(one) - 39 and all(x[90 + i] == y[55 + i] for i in range(300 - 39))


@pytest.mark.parametrize("seed", [1, 2])
def test_line_dedup(spark, seed):
    rows = brute.awkward(seed, 60)
    shared = ["\tThe SAME long line of text that many documents hold ", "short", "", "Én line with accents that is long enough to count"]
    rows = [(d, None if t is None else "\n".join([t, *shared[: d % 5]]), *rest) for d, t, *rest in rows]
    got = {r[0]: tuple(r)[1:4] for r in line_dedup.dedup_lines(frame(spark, rows), 40, 5).collect()}
    assert got == brute.lines_dedup(rows, 40, 5)


@pytest.mark.parametrize("block", [3, 512])
def test_near_duplicates(spark, block):
    rows = brute.awkward(11, 60)
    got = {r[0]: tuple(r)[1:] for r in near_duplicates.near_duplicates(frame(spark, rows), block=block).collect()}
    assert got == brute.near(rows)


@pytest.mark.parametrize("limits", [(200_000, 10_000), (5, 3)])
def test_components_of_a_long_path(spark, monkeypatch, limits):
    monkeypatch.setattr(near_duplicates, "BROADCAST_EDGES", limits[0])
    monkeypatch.setattr(near_duplicates, "HUB", limits[1])
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "a long, b long")
    got = {r.node: r.root for r in near_duplicates.components(edges).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}
    hubs = spark.createDataFrame([(7, i) for i in range(8, 90)] + [(i, 200) for i in range(100, 150)] + [(200, 89)], "a long, b long")
    assert {r.root for r in near_duplicates.components(hubs).collect()} == {7}


def test_bands_reach_recall():
    bands, rows = near_duplicates.choose_bands(0.8, 0.9999)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.9999 and bands * rows <= 160


@pytest.mark.parametrize("operator", [suffix_dedup.dedup_substrings, substring_dedup.dedup_word_windows, line_dedup.dedup_lines, near_duplicates.near_duplicates])
def test_empty_null_and_clashing_columns(spark, operator):
    schema = brute.SCHEMA + ", k1 string, row string, node string, pos int, hash int, gone string, original string"
    assert operator(spark.createDataFrame([], schema)).count() == 0
    extra = ("a", "b", "c", 1, 2, "d", "e")
    rows = [(None, "some text", None, None, None, *extra), (None, None, None, None, None, *extra), (3, "some text", None, None, None, *extra), (3, "some text", None, None, None, *extra)]
    assert operator(spark.createDataFrame(rows, schema)).count() == 4


def in_process(rows, kind):
    """The tasks of repeats.remove one after another: removed window starts by document key."""
    import pyarrow as pa

    from pagelith.llm import repeats

    def batch(table):
        return iter(table.combine_chunks().to_batches()) if table.num_rows else iter(())

    def run(task, table, schema=None):
        return pa.Table.from_batches(list(task(batch(table))), schema)

    docs = pa.table({"text": [t for _, t in rows], "k1": [d for d, _ in rows], "doc_id": [d for d, _ in rows]})
    met = run(repeats._met_twice, run(repeats._anchor_blocks(kind, 1), docs).select(["k1", "blob", "whole"]), pa.schema([("k1", pa.int64()), ("blob", pa.binary())]))
    blobs = {}
    for k, b in zip(met.column("k1").to_pylist(), met.column("blob").to_pylist()):
        blobs.setdefault(k, []).append(b)
    wanted = docs.filter(pa.array([d in blobs for d, _ in rows]))
    wanted = wanted.append_column("blobs", pa.array([blobs[d] for d in wanted.column("doc_id").to_pylist()], pa.list_(pa.binary())))
    schema = pa.schema(list(zip(repeats._CONTEXT_NAMES, repeats._CONTEXT_TYPES)))
    contexts = run(repeats._contexts(kind), wanted, schema).sort_by([("hash", "ascending"), ("salt", "ascending")])
    combined = run(repeats._settle(kind, False), contexts, schema).sort_by("hash")
    hot = [h for h, r in zip(combined.column("hash").to_pylist(), combined.column("removed").to_pylist()) if r is None]
    gone = {}
    for k, r in zip(*(run(repeats._settle(kind, True), combined, schema).column(c).to_pylist() for c in ("k1", "removed"))):
        if r:
            gone.setdefault(k, set()).update(p for a, b in np.frombuffer(r, "<i8").reshape(-1, 2).tolist() for p in range(a, b + 1))
    return gone, hot


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_common_hashes_in_cells(monkeypatch, seed):
    from pagelith.llm import repeats

    for name, value in (("MANY_BLOCKS", 1), ("SALTS", 2), ("BLOCK", 300)):
        monkeypatch.setattr(repeats, name, value)
    rows, seen = [], set()
    for d, t, *_ in brute.awkward(seed):
        if t and t not in seen:
            seen.add(t)
            rows.append((d, t))
    gone, _ = in_process(rows, replace(suffix_dedup.kind(30, 8), cell=3))
    for d, want in brute.bytes_dedup([(d, t, "", "", 0) for d, t in rows], 30).items():
        covered = {p + i for p in gone.get(d, ()) for i in range(30)}
        assert len(covered) == want[1]
    gone, _ = in_process(rows, replace(substring_dedup.kind(12, 4), cell=3))
    texts = dict(rows)
    for d, want in brute.words_dedup([(d, t, "", "", 0) for d, t in rows], 12).items():
        starts = np.array([(p, p) for p in sorted(gone.get(d, ()))], np.int64).reshape(-1, 2)
        covered = {p + i for a, b in substring_dedup.with_equal_windows(texts[d], starts, 12).tolist() for p in range(a, b + 1) for i in range(12)}
        assert len(covered) == want[1]


def test_a_common_phrase_brings_no_large_group_together():
    import random
    from collections import Counter

    r = random.Random(4)
    other = lambda n: "".join(r.choice("abcdefghij ") for _ in range(n))
    phrase = "the quick brown fox jumps over the lazy dog and then it sleeps"
    gone, hot = in_process([(i, other(200) + phrase + other(200)) for i in range(3000)], suffix_dedup.kind())
    assert not gone and max(Counter(hot).values(), default=0) < 30


def test_multikey_quicksort_is_shallow():
    r = np.random.default_rng(8)
    for _ in range(60):
        texts = [b"shared" + bytes(r.integers(0, 2, r.integers(0, 30)).astype(np.uint8)) for _ in range(r.integers(1, 60))]
        group = np.sort(r.integers(0, 4, len(texts)))
        order, head = ordering.multikey_quicksort(group, texts, 6, 16)
        keys = [(int(group[i]), texts[i][6:22].ljust(16, b"\0")) for i in order]
        assert keys == sorted(keys)
        assert head.tolist() == [i for i in range(len(keys)) if i == 0 or keys[i] != keys[i - 1]]
