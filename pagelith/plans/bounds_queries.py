"""Queries over the ends of tables and formulas."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelith.operators import bounds as B
from pagelith.plans import fixtures as V
from pagelith.plans.fixtures import with_views
from pagelith.plans.preparation_queries import _FN, _SHARE, _SX, _W

QUERIES: dict = {}
ORACLES: dict = {}
_NOTED = r"regexp_matches(b.text, '^\(\d+[a-z]?\)\s+') AND len(regexp_extract_all(b.text, '(?m)^\s*(?:\(\d+[a-z]?\)|\[\d+[a-z]?\]|[*†‡])\s+')) = 1 AND {} >= 6 AND NOT regexp_matches(b.text, '[=∑∏∫√≤≥≈≠]')".format(_W.format("b.text"))


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


def _blocks(spark, d) -> DataFrame:
    """Blocks of which some are notes, some have a short line before their text."""
    b = V.blocks(spark, d)
    text = F.when(F.col("ord") % 6 == 5, F.concat(F.lit("(1) "), F.col("text"))).when(F.col("ord") % 5 == 0, F.concat(F.lit("x\n"), F.col("text"))).otherwise(F.col("text"))
    kind = F.when(F.col("ord") % 11 == 4, "equation").otherwise("paragraph")
    return b.select("doc_id", "block_id", kind.alias("kind"), "ord", "page", "x", "y", "w", "h", text.alias("text"))


def _regions(spark, d) -> DataFrame:
    """A region at every fourth block, of three heights."""
    b = V.blocks(spark, d).where("ord % 4 = 1")
    kind = F.when(F.col("ord") % 8 == 1, "table").otherwise("formula")
    return b.select("doc_id", F.concat(F.lit("r"), "block_id").alias("region_id"), kind.alias("kind"), "page", (F.col("x") - 10).alias("x"), (F.col("y") - 5).alias("y"), (F.col("w") + 20).alias("w"), (F.col("ord") % 6 * 9 + 16).cast("double").alias("h"))


_BR = r"""b AS (SELECT * REPLACE (CASE WHEN ord % 6 = 5 THEN '(1) ' || text WHEN ord % 5 = 0 THEN 'x' || chr(10) || text ELSE text END AS text), CASE WHEN ord % 11 = 4 THEN 'equation' ELSE 'paragraph' END AS kind FROM blocks),
    r AS (SELECT doc_id, 'r' || block_id AS region_id, CASE WHEN ord % 8 = 1 THEN 'table' ELSE 'formula' END AS kind, page, x - 10 AS x, y - 5 AS y, w + 20 AS w, (ord % 6 * 9 + 16)::DOUBLE AS h FROM blocks WHERE ord % 4 = 1)"""


@query(with_views("blocks", body=rf""", {_BR}, p AS (SELECT doc_id, page, x, w, h, CASE WHEN ord % 3 = 0 THEN y + 1 WHEN starts_with(text, 'x' || chr(10)) THEN NULL ELSE y END AS top FROM b
        WHERE kind = 'paragraph' AND NOT ({_NOTED}) AND {_W.format("text")} >= 8 AND len(regexp_extract_all(text, '{_FN.format("|while")}')) >= 2),
    c AS (SELECT a.doc_id, a.region_id, min(b.top) AS cut FROM r a JOIN p b ON a.doc_id = b.doc_id AND a.page = b.page AND a.kind = 'table' WHERE {_SX} >= 0.25 * least(a.w, b.w)
        AND b.top > a.y + least(24, a.h * 0.35) AND b.top < a.y + a.h - 2 GROUP BY ALL)
    SELECT doc_id, region_id, CASE WHEN cut - y - 2 >= 12 AND cut - y - 2 >= h * 0.45 THEN cut - y - 2 ELSE h END AS h FROM r LEFT JOIN c USING (doc_id, region_id)"""))
def tables_cut_at_prose(spark, d):
    b = _blocks(spark, d)
    tops = b.where("ord % 3 = 0").select("doc_id", "block_id", F.when(F.col("text").startswith("x\n"), 1).otherwise(0).alias("line_no"), (F.col("y") + 1).alias("top"))
    return B.tables_before_prose(_regions(spark, d), b, tops).select("doc_id", "region_id", "h")


@query(with_views("blocks", body=rf""", {_BR}, c AS (SELECT a.doc_id, a.region_id, max(b.y + b.h + 2) AS tail FROM r a JOIN b ON a.doc_id = b.doc_id AND a.page = b.page AND a.kind = 'table' WHERE {_SX} >= 0.25 * least(a.w, b.w)
        AND (({_NOTED} AND b.y <= a.y + a.h + 4 AND b.y + b.h > a.y + 12) OR (b.y < a.y + a.h AND b.y >= a.y + a.h - 18 AND b.y + b.h > a.y + a.h AND b.y + b.h <= a.y + a.h + 12)) GROUP BY ALL)
    SELECT doc_id, region_id, greatest(h, coalesce(tail - y, h)) AS h FROM r LEFT JOIN c USING (doc_id, region_id)"""))
def tables_to_their_tail(spark, d):
    return B.tables_through_tail(_regions(spark, d), _blocks(spark, d)).select("doc_id", "region_id", "h")


@query(with_views("blocks", body=rf""", {_BR}, q AS (SELECT DISTINCT a.doc_id, b.region_id FROM b a JOIN r b ON a.doc_id = b.doc_id AND a.page = b.page AND a.kind = 'equation' WHERE {_SHARE} >= 0.5),
    t AS (SELECT a.doc_id, a.region_id, trim(regexp_replace(string_agg(b.text || ' ', '' ORDER BY b.ord), '\s+', ' ', 'g')) AS t FROM r a JOIN b ON a.doc_id = b.doc_id AND a.page = b.page
        WHERE b.x + b.w / 2 BETWEEN a.x AND a.x + a.w AND b.y + b.h / 2 BETWEEN a.y AND a.y + a.h GROUP BY ALL)
    SELECT doc_id, region_id FROM t WHERE {_W.format("t")} >= 3 AND regexp_matches(t, '{_FN.format("|shown")}') AND NOT regexp_matches(t, '[=+*/∑∏∫√≤≥≈≠<>×÷\d]|(?:^|\s)-(?:\s|$)') AND (doc_id, region_id) NOT IN (SELECT (doc_id, region_id) FROM q)"""))
def regions_of_prose(spark, d):
    b = _blocks(spark, d)
    glyphs = b.withColumn("place", F.lit(0)).withColumn("ch", F.concat("text", F.lit(" ")))
    return B.formulas_of_prose(_regions(spark, d), glyphs, b)


@query(with_views("blocks", body=rf""", {_BR}, p AS (SELECT * FROM b WHERE kind = 'paragraph' AND length(trim(regexp_replace(text, '\s+', ' ', 'g'))) >= 45 AND {_W.format("text")} >= 6),
    g AS (SELECT a.doc_id, a.region_id, a.y - 9 AS t, a.y + a.h + 9 AS e, max(b.y + b.h) FILTER (b.y + b.h <= a.y + 1) AS above, min(b.y) FILTER (b.y >= a.y + a.h - 1) AS below
        FROM r a LEFT JOIN p b ON a.doc_id = b.doc_id AND a.page = b.page AND {_SX} > 0 WHERE a.kind = 'formula' GROUP BY ALL),
    k AS (SELECT *, greatest(t, coalesce(above + 2, t)) AS top, least(e, coalesce(below - 2, e)) AS low FROM g)
    SELECT r.doc_id, r.region_id, CASE WHEN k.t IS NULL THEN y WHEN low > top + 8 THEN top ELSE t END AS y, CASE WHEN k.t IS NULL THEN h WHEN low > top + 8 THEN low - top ELSE e - t END AS h
    FROM r LEFT JOIN k USING (doc_id, region_id)"""))
def formula_padding(spark, d):
    return B.formulas_between_prose(_regions(spark, d), _blocks(spark, d), F.lit(9.0)).select("doc_id", "region_id", "y", "h")
