"""Queries over the passes that join and split units."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagelith.operators import continuations as C
from pagelith.plans import fixtures as V
from pagelith.plans.fixtures import with_views
from pagelith.plans.preparation_queries import _UV, HEIGHT, _units
from pagelith.plans.text_queries import _HEADS_SQL

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


@query(with_views("blocks", body=rf""", {_UV}, t AS (SELECT * REPLACE (CASE WHEN ord % 10 IN (2, 3) THEN text || ' see https://host.org/a' || ord || '/ ' WHEN ord % 10 = 4 THEN 'sub/p' || ord || ' .' ELSE text END AS text, CASE WHEN ord % 10 = 4 THEN 'list-item' ELSE kind END AS kind) FROM u),
    c AS (SELECT f.doc_id, f.unit_id AS frag, o.unit_id AS own, row_number() OVER (PARTITION BY f.doc_id, f.unit_id ORDER BY f.page * 792 + f.y - o.page * 792 - o.y - o.h, o.ord) AS k
        FROM t f JOIN t o ON f.doc_id = o.doc_id AND f.page - o.page BETWEEN 0 AND 1 AND f.ord % 10 = 4 AND o.ord % 10 IN (2, 3)
        WHERE greatest(0, least(o.x + o.w, f.x + f.w) - greatest(o.x, f.x)) >= 0.5 * least(o.w, f.w) AND f.page * 792 + f.y - o.page * 792 - o.y - o.h BETWEEN -2 AND 28)
    SELECT t.doc_id, t.unit_id, CASE WHEN c.own IS NULL THEN t.text ELSE rtrim(t.text) || replace(g.text, ' .', '.') END AS text FROM t LEFT JOIN c ON c.doc_id = t.doc_id AND c.own = t.unit_id AND c.k = 1
    LEFT JOIN t g ON g.doc_id = c.doc_id AND g.unit_id = c.frag WHERE NOT EXISTS (SELECT 1 FROM c d WHERE d.doc_id = t.doc_id AND d.frag = t.unit_id AND d.k = 1)"""))
def url_fragments(spark, d):
    last, n = F.col("ord") % 10, F.col("ord").cast("string")
    text = F.when(last.isin(2, 3), F.concat("text", F.lit(" see https://host.org/a"), n, F.lit("/ "))).when(last == 4, F.concat(F.lit("sub/p"), n, F.lit(" ."))).otherwise(F.col("text"))
    u = _units(spark, d).withColumn("text", text).withColumn("kind", F.when(last == 4, "list-item").otherwise(F.col("kind")))
    return C.join_url_fragments(u, HEIGHT).select("doc_id", "unit_id", "text")


@query(with_views("blocks", body=rf""", {_UV}, t AS (SELECT * REPLACE (CASE WHEN ord % 9 = 1 THEN 'Abstract — ' || trim(text) WHEN ord % 9 = 4 THEN 'Key words: k' || ord WHEN ord % 9 = 5 THEN '• more' WHEN ord % 9 = 7 THEN 'Index terms' ELSE text END AS text,
        CASE WHEN ord % 9 IN (4, 7) THEN 'keywords' WHEN ord % 9 IN (1, 5) THEN 'paragraph' ELSE kind END AS kind) FROM u),
    b AS (SELECT doc_id, unit_id, ord, page, y, h, CASE WHEN page = 0 AND ord % 9 = 1 THEN 'abstract' ELSE kind END AS kind,
        CASE WHEN page = 0 AND ord % 9 = 1 THEN trim(regexp_replace(text, '^Abstract — ', '')) WHEN page = 0 AND ord % 9 = 4 THEN 'k' || ord ELSE text END AS text FROM t WHERE NOT (page = 0 AND ord % 9 = 7)),
    p AS (SELECT h.doc_id, h.unit_id AS head, i.unit_id AS item, i.text AS more FROM b h JOIN b i ON h.doc_id = i.doc_id AND h.page = i.page AND h.ord % 9 = 4 AND i.ord % 9 = 5
        WHERE i.y >= h.y + h.h - 2 AND i.y - h.y - h.h <= 22 AND i.ord = h.ord + 1)
    SELECT b.doc_id, unit_id, kind, CASE WHEN head IS NULL THEN text ELSE text || ' ' || more END AS text FROM b LEFT JOIN p ON p.doc_id = b.doc_id AND head = unit_id
    WHERE NOT EXISTS (SELECT 1 FROM p q WHERE q.doc_id = b.doc_id AND q.item = b.unit_id)"""))
def abstract_keywords(spark, d):
    last, n = F.col("ord") % 9, F.col("ord").cast("string")
    text = (
        F.when(last == 1, F.concat(F.lit("Abstract — "), F.trim("text"))).when(last == 4, F.concat(F.lit("Key words: k"), n)).when(last == 5, "• more").when(last == 7, "Index terms").otherwise(F.col("text"))
    )
    kind = F.when(last.isin(4, 7), "keywords").when(last.isin(1, 5), "paragraph").otherwise(F.col("kind"))
    u = _units(spark, d).withColumn("text", text).withColumn("kind", kind)
    return C.abstract_and_keywords(u).select("doc_id", "unit_id", "kind", "text")


@query(with_views("blocks", body=_HEADS_SQL.replace("SELECT block_id, part, number, CASE", """, l AS (SELECT block_id, part, number, CASE""", 1).rstrip() + """),
    z AS (SELECT doc_id, b.block_id, ord, type, b.text, l.part, l.number, l.level, l.text AS own FROM blocks b LEFT JOIN l USING (block_id))
    SELECT doc_id, CASE WHEN part > 0 THEN block_id || '-heading-' || (part + 1) ELSE block_id END AS unit_id, CASE WHEN part > 0 THEN block_id END AS parent_id, block_id AS source_id,
        ord + coalesce(part, 0) / 1000 AS ord, number, level, coalesce(own, text) AS text FROM z"""))
def heading_children(spark, d):
    u = V.blocks(spark, d).withColumn("text", F.when(F.col("type") == "section", F.concat("text", F.lit(" 3.1 More Work C. Costs"))).otherwise(F.col("text")))
    u = u.select("doc_id", F.col("block_id").alias("unit_id"), F.when(F.col("type") == "section", "heading").otherwise("paragraph").alias("kind"), "ord", "text")
    return C.heading_units(u).select("doc_id", "unit_id", "parent_id", "source_id", "ord", "number", "level", "text")


@query(with_views("blocks", body="""
    SELECT a.doc_id, a.block_id AS caption_id, max(b.y + b.h) AS bottom FROM blocks a LEFT JOIN blocks b ON a.doc_id = b.doc_id AND a.page = b.page AND a.block_id <> b.block_id AND b.y + b.h <= a.y - 18 AND b.y >= 792 * 0.08
        AND greatest(0, least(b.x + b.w, a.x + a.w) - greatest(b.x, a.x)) / greatest(1, least(b.w, a.w)) >= 0.25 WHERE a.type IN ('figure', 'table') GROUP BY ALL"""))
def caption_content_bottom(spark, d):
    b = V.blocks(spark, d)
    return C.content_bottom(b.where("type IN ('figure', 'table')").withColumnRenamed("block_id", "caption_id"), b, HEIGHT)
