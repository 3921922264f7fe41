"""Literal cases of the passes that join and split units."""

from __future__ import annotations

from pagelith.operators import continuations as C
from pagelith.plans import registry

UNIT = "doc_id int, unit_id string, kind string, ord int, page int, x double, y double, w double, h double, text string"
URL = "Code at https://host.org/group/ "


def units(spark, *rows):
    return spark.createDataFrame([(1, *r) for r in rows], UNIT)


def texts(df):
    return {r.unit_id: r.text for r in df.collect()}


def row(name, kind, order, y, text, page=0, x=50.0, w=200.0, h=12.0):
    return (name, kind, order, page, x, y, w, h, text)


def test_a_url_fragment_goes_to_the_nearest_open_url(spark):
    u = units(
        spark, row("far", "paragraph", 0, 100.0, URL), row("near", "paragraph", 1, 110.0, URL), row("path", "paragraph", 2, 124.0, " tool/v1.0 ,"),
        row("lane", "paragraph", 3, 110.0, URL, x=330.0), row("prose", "paragraph", 4, 126.0, "tool/v1.0 is here"), row("head", "heading", 5, 124.0, "a/b"),
    )
    got = texts(C.join_url_fragments(u, 792.0))
    assert "path" not in got and got["near"] == "Code at https://host.org/group/tool/v1.0,"
    assert got["far"] == got["lane"] == URL and got["head"] == "a/b" and len(got) == 5


def test_a_unit_takes_one_fragment_and_the_next_takes_another(spark):
    u = units(
        spark, row("a", "paragraph", 0, 100.0, URL), row("b", "paragraph", 1, 106.0, URL), row("first", "list-item", 2, 120.0, "x/1"), row("second", "list-item", 3, 121.0, "x/2"),
        row("third", "list-item", 4, 122.0, "x/3"),
    )
    got = texts(C.join_url_fragments(u, 792.0))
    assert got == {"b": URL.strip() + "x/1", "a": URL.strip() + "x/2", "third": "x/3"}


def test_a_url_goes_on_over_the_page_but_not_further_and_not_without_a_place(spark):
    u = units(
        spark, row("end", "paragraph", 0, 785.0, URL, h=7.0), row("next", "paragraph", 1, 10.0, "x/1", page=1), row("later", "paragraph", 2, 10.0, "x/2", page=2),
        ("nowhere", "paragraph", 3, None, None, None, None, None, "x/3"), ("empty", "paragraph", 4, 0, 50.0, 800.0, 200.0, 12.0, None),
    )
    got = texts(C.join_url_fragments(u, 792.0))
    assert got == {"end": URL.strip() + "x/1", "later": "x/2", "nowhere": "x/3", "empty": None}
    assert C.join_url_fragments(u.where("false"), 792.0).count() == 0


def test_labels_go_and_keywords_go_on(spark):
    u = units(
        spark, row("abs", "paragraph", 0, 100.0, "ABSTRACT: We show."), row("bare", "abstract", 1, 130.0, "Abstract"), row("key", "keywords", 2, 200.0, "Key words — a, b"),
        row("list", "paragraph", 3, 214.0, "• c, d"), row("body", "paragraph", 4, 215.0, "Text"), row("second", "paragraph", 5, 230.0, "• e"),
        row("other", "paragraph", 6, 100.0, "Abstract: of a later page", page=1), row("abstractly", "paragraph", 7, 300.0, "Abstract art is old"),
        ("nowhere", "abstract", 8, None, None, None, None, None, "Abstract: stays"), row("none", "paragraph", 9, 400.0, None),
    )
    done = C.abstract_and_keywords(u)
    assert texts(done) == {
        "abs": "We show.", "key": "a, b • c, d", "body": "Text", "second": "• e", "other": "Abstract: of a later page", "abstractly": "Abstract art is old", "nowhere": "Abstract: stays", "none": None,
    }
    assert {r.unit_id: r.kind for r in done.collect()}["abs"] == "abstract"
    assert C.abstract_and_keywords(u.where("false")).count() == 0


def test_parts_of_a_heading_are_units(spark):
    u = units(spark, row("h", "heading", 3, 0.0, "2 Methods 2.1 Data"), row("plain", "heading", 4, 0.0, "Thanks"), row("p", "paragraph", 5, 0.0, "1 One 1.1 Two"), row("no", "heading", 6, 0.0, None))
    got = [(r.unit_id, r.parent_id, r.source_id, round(r.ord, 6), r.number, r.level, r.text) for r in C.heading_units(u).orderBy("ord").collect()]
    assert got == [
        ("h", None, "h", 3.0, "2", 1, "Methods"), ("h-heading-2", "h", "h", 3.001, "2.1", 2, "Data"), ("plain", None, "plain", 4.0, None, 1, "Thanks"),
        ("p", None, "p", 5.0, None, None, "1 One 1.1 Two"), ("no", None, "no", 6.0, None, None, None),
    ]


def test_lowest_content_above_a_caption(spark):
    b = units(spark, row("head", "p", 0, 20.0, ""), row("a", "p", 1, 100.0, ""), row("b", "p", 2, 140.0, ""), row("lane", "p", 3, 160.0, "", x=330.0), row("close", "p", 4, 290.0, "")).withColumnRenamed("unit_id", "block_id")
    c = units(spark, row("c", "caption", 5, 300.0, ""), row("top", "caption", 6, 60.0, ""), ("nowhere", "caption", 7, None, None, None, None, None, "")).withColumnRenamed("unit_id", "caption_id")
    got = {r.caption_id: r.bottom for r in C.content_bottom(c, b, 792.0).collect()}
    assert got == {"c": 152.0, "top": None, "nowhere": None}


def test_the_queries_join_and_split_units(spark, data):
    q = {n: registry.QUERIES[n](spark, data).cache() for n in ("url_fragments", "abstract_keywords", "heading_children")}
    assert q["url_fragments"].where(r"text LIKE '%/a%/sub/p%.'").count() > 0
    assert q["abstract_keywords"].where("text LIKE 'k% • more'").count() > 0
    assert q["heading_children"].where("parent_id IS NOT NULL").count() > 0
