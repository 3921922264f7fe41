"""Queries over the passes before translation, checks of targets, and project tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelith.functions import prose as P
from pagelith.functions import targets as G
from pagelith.functions.text import SPACES
from pagelith.operators import crops as C
from pagelith.operators import preparation as Q
from pagelith.operators import store, work
from pagelith.plans import fixtures as V
from pagelith.plans.fixtures import with_views
from pagelith.sources import table

QUERIES: dict = {}
ORACLES: dict = {}
WIDTH, HEIGHT = 612.0, 792.0


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


def _units(spark, d) -> DataFrame:
    """Blocks as units; their kinds follow from type and order."""
    b = V.blocks(spark, d)
    k = F.col("ord") % 23
    kind = (
        F.when(k == 0, "title").when(k == 2, "author").when(k == 4, "affiliation").when(F.col("type") == "section", "heading").when(F.col("type").isin("figure", "table"), "caption").otherwise("paragraph")
    )
    return b.select("doc_id", F.col("block_id").alias("unit_id"), kind.alias("kind"), "ord", "page", "x", "y", "w", "h", "text", F.when(F.col("lane") == "full", "span").otherwise(F.col("lane")).alias("lane"))


def _regions(spark, d) -> DataFrame:
    u = _units(spark, d).where("ord % 2 = 1")
    code = F.col("ord") % 8 == 3
    kind = F.when(code, "algorithm").otherwise("formula")
    return u.select("doc_id", F.concat(F.lit("r"), "unit_id").alias("region_id"), kind.alias("kind"), "page", (F.col("x") - 10).alias("x"), (F.col("y") - 9).alias("y"), (F.col("w") + 20).alias("w"), (F.col("h") + (F.col("ord") % 5) * 9 + F.when(code, 40).otherwise(0)).alias("h"))


_UV = """u AS (SELECT doc_id, block_id AS unit_id, CASE WHEN ord % 23 = 0 THEN 'title' WHEN ord % 23 = 2 THEN 'author' WHEN ord % 23 = 4 THEN 'affiliation' WHEN type = 'section' THEN 'heading'
    WHEN type IN ('figure', 'table') THEN 'caption' ELSE 'paragraph' END AS kind, ord, page, x, y, w, h, text, CASE lane WHEN 'full' THEN 'span' ELSE lane END AS lane FROM blocks)"""
_RV = """r AS (SELECT doc_id, 'r' || unit_id AS region_id, CASE WHEN ord % 8 = 3 THEN 'algorithm' ELSE 'formula' END AS kind, page, x - 10 AS x, y - 9 AS y, w + 20 AS w, h + (ord % 5) * 9 + CASE WHEN ord % 8 = 3 THEN 40 ELSE 0 END AS h FROM u WHERE ord % 2 = 1)"""
_SPAN = "greatest(0.0, least(a.{at} + a.{size}, b.{at} + b.{size}) - greatest(a.{at}, b.{at}))"
_SX, _SY = _SPAN.format(at="x", size="w"), _SPAN.format(at="y", size="h")
_GAP = "greatest(0.0, a.y - b.y - b.h, b.y - a.y - a.h)"
_SHARE = f"({_SX} * {_SY} / greatest(1.0, a.w * a.h))"
_W = r"len(regexp_extract_all({}, '[A-Za-z]{{3,}}'))"
_FN = r"(?i)\b(?:the|a|an|and|or|of|to|in|for|with|that|this|is|are|was|were|as|by|from|on|at{})\b"


@query(with_views("blocks", body=f", {_UV} SELECT doc_id, unit_id, CASE WHEN kind = 'title' AND (page > 0 OR row_number() OVER (PARTITION BY doc_id, kind, page ORDER BY y, ord) > 1) THEN 'heading' ELSE kind END AS kind FROM u"))
def title_roles(spark, d):
    return Q.document_title(_units(spark, d)).select("doc_id", "unit_id", "kind")


@query(with_views("blocks", body=f""", {_UV}, t AS (SELECT doc_id, min(y) AS top FROM u WHERE kind = 'heading' AND page = 0 GROUP BY doc_id)
    SELECT doc_id, unit_id, CASE WHEN kind IN ('author', 'affiliation') AND NOT (page = 0 AND y < coalesce(top, 1e9)) THEN 'paragraph' ELSE kind END AS kind FROM u LEFT JOIN t USING (doc_id)"""))
def scoped_author_roles(spark, d):
    return Q.scoped_authors(_units(spark, d)).select("doc_id", "unit_id", "kind")


_PEOPLE = ["Ann Lee and Bob Ray", "University of Somewhere", "mail me@x.org", ""]


@query(with_views("blocks", body=rf""", {_UV}, p AS (SELECT doc_id, unit_id, kind, page, x, y, w, h, ord, trim(regexp_replace(['Ann Lee and Bob Ray', 'University of Somewhere', 'mail me@x.org', ''][ord % 4 + 1] || ' ' || text, '\s+', ' ', 'g')) AS t FROM u),
    b AS (SELECT doc_id, min(y) FILTER (kind = 'heading' AND page = 0) AS body, min_by(y + h, ord) FILTER (kind = 'title' AND page = 0) AS bottom FROM u GROUP BY doc_id)
    SELECT doc_id, unit_id, CASE WHEN kind = 'paragraph' AND page = 0 AND y < coalesce(body, 792 * 0.38) AND y <= 792 * 0.34 AND coalesce(y >= bottom - 2, true) AND abs(x + w / 2 - 306) <= 612 * 0.14 AND length(t) BETWEEN 1 AND 320 THEN
        CASE WHEN regexp_matches(t, '(?i)\b(?:university|institute|institution|laborator(?:y|ies)|department|school|college|academy|faculty|cent(?:er|re)|email|e-mail)\b|@') THEN 'affiliation'
        WHEN len(regexp_extract_all(t, '\b[A-Z][A-Za-z''’-]+(?:\s+[A-Z][A-Za-z''’-]+)+\b')) >= 2 OR (len(regexp_extract_all(t, '\b[A-Z][A-Za-z''’-]+(?:\s+[A-Z][A-Za-z''’-]+)+\b')) >= 1 AND regexp_matches(t, '(?i),|\band\b|&')) THEN 'author'
        ELSE kind END ELSE kind END AS kind FROM p LEFT JOIN b USING (doc_id)"""))
def front_matter_units(spark, d):
    head = F.get(F.array(*map(F.lit, _PEOPLE)), (F.col("ord") % 4).cast("int"))
    u = _units(spark, d).withColumn("text", F.concat(head, F.lit(" "), F.col("text")))
    return Q.front_matter(u, WIDTH, HEIGHT).select("doc_id", "unit_id", "kind")


@query(with_views("lines", body=rf""", g AS (SELECT doc_id, line_no // 3 AS grp, string_agg(CASE WHEN line_no % 5 = 2 THEN 'i j' WHEN line_no % 7 = 3 THEN ' x ' ELSE line END, chr(10) ORDER BY line_no) AS t FROM lines GROUP BY ALL),
    s AS (SELECT *, string_split(t, chr(10)) AS ls FROM g)
    SELECT doc_id, grp, CASE WHEN len(ls) > 1 AND len(list_filter(ls, lambda l: {_W.format("l")} >= 3 AND regexp_matches(l, '{_FN.format("|each")}'))) > 0
        THEN trim(array_to_string(list_filter(ls, lambda l: NOT regexp_matches(l, '^\s*[A-Za-z](?:\s+[A-Za-z]){{0,3}}\s*$')), chr(10)), chr(32) || chr(9) || chr(10) || chr(13)) ELSE t END AS text FROM s"""))
def variable_lines(spark, d):
    line = F.when(F.col("line_no") % 5 == 2, "i j").when(F.col("line_no") % 7 == 3, " x ").otherwise(F.col("line"))
    g = V.lines(spark, d).groupBy("doc_id", F.floor(F.col("line_no") / 3).alias("grp")).agg(F.sort_array(F.collect_list(F.struct("line_no", line.alias("l")))).alias("ls"))
    return g.select("doc_id", "grp", Q.without_variable_lines(F.array_join(F.transform("ls", lambda x: x["l"]), "\n")).alias("text"))


@query(with_views("blocks", body=rf""", {_UV}, n AS (SELECT *, lower(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS norm FROM u), k AS (SELECT doc_id, list(DISTINCT norm) AS known FROM n WHERE ord % 7 = 0 GROUP BY doc_id)
    SELECT doc_id, unit_id, CASE WHEN ord % 2 = 1 THEN CASE WHEN list_contains(known, norm) THEN 'tail line' ELSE trim(text, chr(32) || chr(9) || chr(13)) || chr(10) || 'tail line' END
        WHEN page > 0 AND (y < 792 * 0.12 OR y + h > 792 * 0.92) AND list_contains(known, norm) THEN '' ELSE text END AS text FROM n LEFT JOIN k USING (doc_id) WHERE known IS NOT NULL AND trim(text) <> ''"""))
def repeated_lines_gone(spark, d):
    normal = lambda l: F.lower(Q.strip(F.regexp_replace(l, r"\s+", " ")))
    u = _units(spark, d)
    repeated = u.where("ord % 7 = 0").select("doc_id", normal(F.col("text")).alias("line"))
    u = u.withColumn("text", F.when(F.col("ord") % 2 == 1, F.concat(F.rtrim("text"), F.lit("\ntail line"))).otherwise(F.col("text")))
    return Q.without_repeated_lines(u, repeated, normal, HEIGHT).join(repeated.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", "unit_id", "text")


@query(with_views("blocks", body=f", {_UV}, {_RV} SELECT DISTINCT a.doc_id, a.unit_id FROM u a JOIN r b ON a.doc_id = b.doc_id AND a.page = b.page AND b.kind = 'formula' WHERE {_SX} >= 0.1 * least(a.w, b.w) AND {_GAP} <= 48"))
def units_near_formulas(spark, d):
    return Q.near_formulas(_units(spark, d), _regions(spark, d))


@query(with_views("blocks", body=rf""", {_UV}, {_RV}, t AS (SELECT doc_id, unit_id, page, x, y, w, h, CASE ord % 4 WHEN 0 THEN 'x =' || chr(10) || '3 y' || chr(10) || chr(10) || 'sum' WHEN 1 THEN 'a + bcd' ELSE text END AS t FROM u),
    c AS (SELECT *, list_filter(list_transform(string_split(t, chr(10)), lambda l: trim(l)), lambda l: l <> '') AS ls FROM t)
    SELECT DISTINCT a.doc_id, a.unit_id FROM c a JOIN r b ON a.doc_id = b.doc_id AND a.page = b.page AND b.kind = 'formula' WHERE {_SHARE} >= 0.05 AND regexp_matches(t, '[=+*/∑∫√≤≥≈≠⌈⌉⎧⎨⎩λ𝑎-𝑧𝛼-𝜔α-ωΑ-Ω0-9-]')
    AND ({_W.format("t")} <= 2 OR (len(ls) >= 3 AND len(list_filter(ls, lambda l: length(l) <= 16)) / len(ls) >= 0.7 AND NOT regexp_matches(t, '{_FN.format("")}')))"""))
def formula_fragments(spark, d):
    text = F.when(F.col("ord") % 4 == 0, "x =\n3 y\n\nsum").when(F.col("ord") % 4 == 1, "a + bcd").otherwise(F.col("text"))
    return Q.formula_fragments(_units(spark, d).withColumn("text", text), _regions(spark, d))


@query(with_views("blocks", body=f", {_UV}, {_RV} SELECT DISTINCT b.doc_id, b.region_id FROM u a JOIN r b ON a.doc_id = b.doc_id AND a.page = b.page AND b.kind = 'formula' WHERE a.kind IN ('title', 'heading', 'caption', 'table-title') AND {_SHARE} >= 0.5"))
def formulas_over_structure(spark, d):
    return Q.formulas_over_structure(_units(spark, d), _regions(spark, d))


@query(with_views("blocks", body=f""", {_UV}, {_RV}, p AS (SELECT a.doc_id, a.region_id, b.region_id AS alg, {_SHARE} >= 0.2 AS inside, {_GAP} <= 8 AS near, {_SX} >= 0.45 * least(a.w, b.w) AS aligned
    FROM r a JOIN r b ON a.doc_id = b.doc_id AND a.page = b.page AND a.kind = 'formula' AND b.kind = 'algorithm'), i AS (SELECT doc_id, alg, region_id FROM p WHERE inside)
    SELECT DISTINCT doc_id, region_id FROM p WHERE aligned AND (inside OR (near AND EXISTS (SELECT 1 FROM i WHERE i.doc_id = p.doc_id AND i.alg = p.alg AND i.region_id <> p.region_id)))"""))
def formulas_over_algorithms(spark, d):
    return Q.formulas_over_algorithms(_regions(spark, d))


@query(with_views("blocks", body=f""", {_UV}, {_RV}, f AS (SELECT * FROM r WHERE kind = 'formula'), bd AS (SELECT doc_id, page, x, y, w, h FROM u WHERE lane = 'span' AND ord % 3 = 0),
    m AS (SELECT a.doc_id, a.region_id, min({{'w': b.w, 'x': b.x}}) AS band FROM f a JOIN bd b ON a.doc_id = b.doc_id AND a.page = b.page WHERE a.y + a.h / 2 >= b.y - 24 AND a.y + a.h / 2 <= b.y + b.h + 24 GROUP BY ALL)
    SELECT doc_id, region_id, least(x, coalesce(band.x, x)) AS x, greatest(x + w, coalesce(band.x + band.w, x + w)) - least(x, coalesce(band.x, x)) AS w FROM f LEFT JOIN m USING (doc_id, region_id)"""))
def formula_widths(spark, d):
    bands = _units(spark, d).where("lane = 'span' AND ord % 3 = 0").select("doc_id", "page", "x", "y", "w", "h")
    return Q.formula_width(_regions(spark, d).where("kind = 'formula'"), bands).select("doc_id", "region_id", "x", "w")


@query(with_views("blocks", body=f""", {_UV}, b AS (SELECT doc_id, page, lane, min(x) AS x, max(x + w) AS r FROM u WHERE NOT (lane <> 'span' AND w < 612 * 0.15 AND x < 306 AND x + w > 306) GROUP BY ALL)
    SELECT doc_id, page, lane, CASE WHEN lane = 'span' AND r - x < 612 * 0.6 THEN 612 * 0.08::DOUBLE WHEN lane = 'left' THEN greatest(x, 612 * 0.07::DOUBLE) WHEN lane = 'right' THEN greatest(x, 306 + 612 * 0.012::DOUBLE) ELSE x END AS x,
    CASE WHEN lane = 'span' AND r - x < 612 * 0.6 THEN 612 * 0.92::DOUBLE WHEN lane = 'left' THEN least(r, 306 - 612 * 0.012::DOUBLE) WHEN lane = 'right' THEN least(r, 612 - 612 * 0.07::DOUBLE) ELSE r END AS "right" FROM b"""))
def lane_bounds(spark, d):
    return Q.lane_bounds(_units(spark, d), WIDTH)


@query(with_views("blocks", body=rf""", {_UV}, c AS (SELECT *, ord * 37 % 612 AS centre, 4.0 * (ord % 11) AS gap FROM u)
    SELECT doc_id, unit_id, CASE WHEN w >= 612 * 0.55 THEN 'span' WHEN x + w / 2 < 306 THEN 'left' ELSE 'right' END AS "column",
    CASE WHEN w < 612 * 0.62 AND centre >= 306 AND x < 306 + 612 * 0.012 THEN 306 + 612 * 0.012::DOUBLE ELSE x END AS table_x,
    CASE WHEN w >= 612 * 0.62 THEN w WHEN centre < 306 AND x + w > 306 - 612 * 0.012 THEN 306 - 612 * 0.012::DOUBLE - x WHEN centre >= 306 AND x < 306 + 612 * 0.012 THEN x + w - 306 - 612 * 0.012::DOUBLE ELSE w END AS table_w,
    CASE WHEN ord % 2 = 0 AND y + 1 >= y - gap + 1 AND y < y - gap + 4 AND y - gap + 4 < y + h + 20 - 12 THEN y - gap + 4 ELSE y END AS crop_y,
    CASE WHEN ord % 2 = 0 AND y + 1 >= y - gap + 1 AND y < y - gap + 4 AND y - gap + 4 < y + h + 20 - 12 THEN h + 20 - (4 - gap) WHEN ord % 2 = 1 AND gap - 3 <= 1 AND gap > 3 - 4 + 1 AND gap < 5 THEN h + 20 ELSE h + 20 END AS crop_h,
    kind = 'paragraph' AND length(trim(regexp_replace(text, '\s+', ' ', 'g'))) >= 45 AND {_W.format("text")} >= 6 AS prose_like FROM c"""))
def region_bounds(spark, d):
    x, y, w, h = (F.col(c) for c in ("x", "y", "w", "h"))
    gap = (4 * (F.col("ord") % 11)).cast("double")
    lane = Q.table_in_lane(x, w, (F.col("ord") * 37 % 612).cast("double"), WIDTH)
    # a table's caption ends `gap` above it; figures have theirs far below
    kind = F.when(F.col("ord") % 2 == 0, "table").otherwise("figure")
    crop = Q.caption_clearance(kind, y, h + 20, F.when(F.col("ord") % 2 == 0, y - gap - 12).otherwise(y + h + 90), F.lit(12.0))
    return _units(spark, d).select(
        "doc_id", "unit_id", Q.source_column(x, w, WIDTH).alias("column"), lane["x"].alias("table_x"), lane["w"].alias("table_w"), crop["y"].alias("crop_y"), crop["h"].alias("crop_h"),
        Q.formula_prose_like(F.col("kind"), F.col("text")).alias("prose_like"),
    )


@query(with_views("blocks", body=rf""", {_UV}, t AS (SELECT *, CASE WHEN trim(text) = '' OR ord % 9 = 1 THEN '[' || kind || ']' ELSE trim(text, chr(32) || chr(9) || chr(13)) END AS t FROM u),
    s AS (SELECT *, greatest(64, greatest(1, ceil(length(t) / 72)) * 24 + 32)::BIGINT AS hh FROM t)
    SELECT doc_id, unit_id, (16 + coalesce(sum(hh + 12) OVER (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS y, hh AS h FROM s"""))
def reader_flow(spark, d):
    return Q.flow(_units(spark, d).withColumn("text", F.when(F.col("ord") % 9 == 1, " ").otherwise(F.col("text"))))


@query(with_views("blocks", body=""", n AS (SELECT doc_id, count(*) AS m FROM blocks GROUP BY doc_id)
    SELECT doc_id, page, lane AS col, block_id, y + h - 700 AS overflow FROM blocks WHERE y + h > 700.5 UNION ALL SELECT doc_id, -1, 'span', 'count-mismatch', -1.0 FROM n WHERE doc_id % 3 = 0"""))
def placement_errors(spark, d):
    b = V.blocks(spark, d)
    n = b.groupBy("doc_id").agg((F.count(F.lit(1)) + F.when(F.col("doc_id") % 3 == 0, 1).otherwise(0)).alias("n"))
    return Q.layout_errors(b.select("doc_id", "page", F.col("lane").alias("col"), "block_id", "y", "h"), n, 700.0)


@query(with_views("blocks", body=""", i AS (SELECT doc_id, ord // 3 AS item, arg_min({'p': page, 'x': x, 'y': y}, ord) AS c, min(ord) AS o FROM blocks GROUP BY ALL)
    SELECT doc_id, c.p AS page, count(*)::BIGINT AS n, string_agg(c.x::INT || ',' || c.y::INT, ' ' ORDER BY o) AS corners FROM i GROUP BY doc_id, c.p"""))
def slice_rects(spark, d):
    g = Q.slice_geometry(V.blocks(spark, d).withColumn("item", F.floor(F.col("ord") / 3)), "doc_id")
    corner = lambda r: F.concat_ws(",", r["x"].cast("int"), r["y"].cast("int"))
    return g.select("doc_id", "page", F.size("rects").cast("long").alias("n"), F.array_join(F.transform("rects", corner), " ").alias("corners"))


@query(with_views("rects", body="""SELECT page, id, CASE WHEN x > 100 THEN round(w / 150.0, 2) ELSE 0.0 END::DOUBLE AS confidence, CASE WHEN x <= 100 THEN 'unmatched' WHEN round(w / 150.0, 2) >= 0.9 THEN 'aligned' ELSE 'low-confidence' END AS status,
    CASE WHEN id % 3 = 0 THEN 'given' WHEN x <= 100 THEN 'source-geometry-missing' END AS reason FROM rects"""))
def source_status(spark, d):
    r = V.rects(spark, d)
    s = Q.with_source(F.col("x") > 100, F.round(F.col("w") / 150.0, 2), F.when(F.col("id") % 3 == 0, "given"))
    return r.select("page", "id", s.alias("s")).select("page", "id", "s.confidence", "s.status", "s.reason")


@query(with_views("rects", body="""SELECT a.page, a.id AS region_id, f.field FROM rects a, (SELECT unnest(['bbox', 'type', 'label']) AS field) f WHERE EXISTS (SELECT 1 FROM rects b WHERE b.page = a.page AND b.y > 50
    AND (b.id % 4 = 0 OR b.id = a.id) AND (f.field = 'bbox' OR (f.field = 'type' AND b.x > 250)))"""))
def permitted_changes(spark, d):
    r = V.rects(spark, d)
    fields = F.when(F.col("x") > 250, F.array(F.lit("bbox"), F.lit("type"))).otherwise(F.array(F.lit("bbox")))
    issues = r.select("page", F.when(F.col("id") % 4 != 0, F.col("id")).alias("region_id"), F.when(F.col("y") > 50, "error").otherwise("warn").alias("severity"), fields.alias("fields"))
    changes = r.select("page", F.col("id").alias("region_id"), F.explode(F.array(*map(F.lit, ["bbox", "type", "label"]))).alias("field"))
    return Q.permitted(changes, issues)


# --- targets ------------------------------------------------------------------------------------------

#: What DuckDB's trim takes away: blanks of any width, no line breaks.
BLANKS = " \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
_WORDS = ["It has a size of 5 mm 2 and 3 km 3.", "We use pytorchlib [3] for the model of it.", "2.1 Plain heading of it", "The plain words are here for you."]


def _pairs(spark, d) -> DataFrame:
    c = table(spark, d, "conversations").where("text IS NOT NULL")
    k = ((F.col("conv_id") + F.col("turn")) % 4).cast("int")
    target = F.concat(F.col("text"), F.lit(" 5 mm² 2 pytorchlib 正文 2.1（internal standards） https://a.example/interesting"))
    return c.select("conv_id", "turn", F.get(F.array(*map(F.lit, _WORDS)), k).alias("source"), target.alias("target"), k.alias("k"))


_PV = "p AS (SELECT conv_id, turn, ({}) AS source, text || ' 5 mm² 2 pytorchlib 正文 2.1（internal standards） https://a.example/interesting' AS target, (conv_id + turn) % 4 AS k FROM conversations WHERE text IS NOT NULL)".format(
    "[" + ", ".join(f"'{w}'" for w in _WORDS) + "][(conv_id + turn) % 4 + 1]"
)


@query(f"""WITH {_PV}, q AS (SELECT *, list_distinct(regexp_extract_all(regexp_replace(regexp_replace(target, 'https?://\\S+|\\b\\S+@\\S+\\b', ' ', 'g'), '[（(][^()（）]{{0,240}}[）)]', ' ', 'g'), '\\b[a-z]{{8,}}(?:-[a-z]{{4,}})*\\b')) AS ws FROM p)
    SELECT conv_id, turn, CASE WHEN k IN (0, 1, 3) THEN array_to_string(list_sort(list_filter(ws, lambda w: NOT (k = 1 AND w = 'pytorchlib'))), ' ') ELSE '' END AS words,
    CASE k WHEN 0 THEN '2 3' ELSE '' END AS digits, (len(regexp_extract_all(target, '²')) * (k = 0)::INT + 1)::BIGINT AS squares FROM q""")
def target_words(spark, d):
    words = G.untranslated_words(F.lit("paragraph"), F.col("source"), F.col("target"))
    squares = G.exponent_count(F.col("source"), F.col("target"), F.lit("2"), F.lit(1))
    return _pairs(spark, d).select("conv_id", "turn", F.array_join(F.sort_array(words), " ").alias("words"), F.array_join(F.sort_array(G.flattened_exponents(F.col("source"))), " ").alias("digits"), squares.cast("long").alias("squares"))


@query(f"""WITH {_PV}, s AS (SELECT conv_id, turn, k, trim(regexp_replace(CASE turn % 3 WHEN 0 THEN 'Part 2.1  ' ELSE '' END || left(regexp_replace(target, '[0-9]', '', 'g'), 30), '^\\s+', '')) AS seg FROM p)
    SELECT conv_id, turn, CASE WHEN k = 2 AND turn % 3 = 0 THEN '2.1 ' || trim(regexp_replace('Part ' || substr(seg, 9), '\\s{{2,}}', ' ', 'g')) ELSE seg END AS heading FROM s""")
def heading_numbers_first(spark, d):
    led = F.concat(F.when(F.col("turn") % 3 == 0, "Part 2.1  ").otherwise(""), F.substring(F.regexp_replace("target", "[0-9]", ""), 1, 30))
    seg = F.btrim(F.regexp_replace(led, r"^[\t\n\f\r ]+", ""), F.lit(BLANKS))
    # the operator trims all white space where it moves a number, the SQL blanks only: a line break may end a segment
    end = F.rtrim(F.regexp_replace(F.regexp_extract(seg, rf"([{BLANKS}{SPACES}]*)\z", 1), r"[\t\n\f\r ]{2,}", " "), F.lit(BLANKS))
    heading = G.heading_number_first(F.lit("heading"), F.col("source"), seg)
    return _pairs(spark, d).select("conv_id", "turn", F.when(heading != seg, F.concat(heading, end)).otherwise(heading).alias("heading"))


@query("""SELECT conv_id, turn, regexp_replace(nfc_normalize(text), '\\s+', '', 'g') || 'ABfi1' AS text FROM conversations WHERE text IS NOT NULL AND regexp_matches(text, '^[\\x00-\\x7F]*$')""")
def normal_targets(spark, d):
    c = table(spark, d, "conversations").where("text IS NOT NULL AND text rlike '^[\\\\x00-\\\\x7F]*$'")
    return c.select("conv_id", "turn", G.normal_target(F.concat(F.col("text"), F.lit(" Ａ　Ｂ ﬁ①"))).alias("text"))


@query("""SELECT conv_id, turn, z.zh AS zh, z.en AS en, z.abbr AS abbr FROM (SELECT conv_id, turn, unnest([{'zh': '模型', 'en': 'Model M' || conv_id, 'abbr': 'MM'}, {'zh': '数据', 'en': 'Data Set', 'abbr': NULL}]) AS z FROM conversations WHERE text IS NOT NULL)""")
def extracted_terms(spark, d):
    c = table(spark, d, "conversations").where("text IS NOT NULL")
    text = F.concat(F.translate("text", "（）", ""), F.lit("。以及模型（Model M"), F.col("conv_id").cast("string"), F.lit(", MM）和数据（Data Set）, 数据（Data Set）"))
    return c.select("conv_id", "turn", F.explode(G.terms(text)).alias("t")).select("conv_id", "turn", "t.zh", "t.en", "t.abbr")


@query("""SELECT conv_id, turn, CASE WHEN role = 'system' THEN '' ELSE role || chr(10) || chr(10) END || 'task' AS prompt, conv_id || ':' || role || '@' || turn AS key, sha256(coalesce(text, '')) AS hash FROM conversations""")
def prompts_and_keys(spark, d):
    c = table(spark, d, "conversations")
    prompt = G.system_prompt(F.when(F.col("role") == "system", "").otherwise(F.col("role")), F.lit("task"), F.lit(None).cast("string"))
    key = G.session_key(F.col("conv_id").cast("string"), F.col("role"), F.col("turn").cast("string"))
    return c.select("conv_id", "turn", prompt.alias("prompt"), key.alias("key"), G.blob_hash(F.coalesce("text", F.lit("")).cast("binary")).alias("hash"))


# --- project tables -----------------------------------------------------------------------------------


@query(with_views("artifacts", body="""SELECT key, project_id, kind FROM artifacts WHERE NOT (project_id % 3 = 0 AND kind <> 'english-pdf')"""))
def derived_cleared(spark, d):
    a = V.artifacts(spark, d)
    return store.without_derived(a, a.where("project_id % 3 = 0").select("project_id")).select("key", "project_id", "kind")


@query(with_views("artifacts", body=f"""SELECT key, project_id, kind FROM artifacts WHERE NOT (project_id % 3 = 0 AND kind IN ({", ".join(f"'{k}'" for k in store.COMMITTED)}))"""))
def outputs_cleared(spark, d):
    a = V.artifacts(spark, d)
    return store.without_outputs(a, a.where("project_id % 3 = 0").select("project_id")).select("key", "project_id", "kind")


@query(with_views("artifacts", body="""SELECT project_id, key, kind FROM artifacts WHERE project_id = 7 ORDER BY key"""))
def project_artifacts(spark, d):
    return store.project_rows(V.artifacts(spark, d), 7, "key").select("project_id", "key", "kind")


@query(with_views("artifacts", body="""SELECT k.project_id, k.key, a.kind FROM (SELECT project_id, key + (key % 5 = 0)::INT * 1000000000 AS key FROM artifacts) k LEFT JOIN artifacts a ON a.project_id = k.project_id AND a.key = k.key"""))
def artifact_lookups(spark, d):
    a = V.artifacts(spark, d)
    keys = a.select("project_id", (F.col("key") + F.when(F.col("key") % 5 == 0, 1_000_000_000).otherwise(0)).alias("key"))
    return store.lookup_many(a, keys).select("project_id", "key", "kind")


@query(with_views("artifacts", body=f""", o AS (SELECT project_id, key, kind, CASE WHEN key % 4 = 0 THEN 'old' ELSE 'd' || project_id END AS plan FROM artifacts UNION ALL SELECT project_id, key, kind, 'd' || project_id FROM artifacts WHERE key % 9 = 0)
    SELECT project_id, key, 'duplicate-key' AS code FROM o GROUP BY ALL HAVING count(*) > 1 UNION ALL SELECT project_id, key, 'kind-not-allowed' FROM o WHERE kind NOT IN ({", ".join(f"'{k}'" for k in store.COMMITTED)})
    UNION ALL SELECT project_id, key, 'stale-plan' FROM o WHERE plan <> 'd' || project_id"""))
def commit_errors(spark, d):
    a = V.artifacts(spark, d)
    digest = F.concat(F.lit("d"), F.col("project_id").cast("string"))
    o = a.select("project_id", "key", "kind", F.when(F.col("key") % 4 == 0, "old").otherwise(digest).alias("plan_digest"))
    o = o.unionByName(a.where("key % 9 = 0").select("project_id", "key", "kind", digest.alias("plan_digest")))
    return store.commit_errors(o, a.select("project_id", digest.alias("digest")).distinct())


@query(with_views("blocks", body=""", p AS (SELECT doc_id, ord, block_id FROM blocks WHERE ord % 13 <> 5), q AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY CASE WHEN ord % 10 = 3 THEN ord + 4 ELSE ord END, ord) AS pos, ord, block_id FROM p),
    b AS (SELECT b.doc_id, b.ord, b.block_id, q.pos, max(q.pos) OVER (PARTITION BY b.doc_id ORDER BY b.ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM blocks b LEFT JOIN q USING (doc_id, block_id))
    SELECT doc_id, block_id, 'missing' AS code FROM b WHERE pos IS NULL UNION ALL SELECT doc_id, block_id, 'out-of-order' FROM b WHERE pos < before"""))
def order_errors(spark, d):
    from pyspark.sql import Window

    b = V.blocks(spark, d)
    at = F.when(F.col("ord") % 10 == 3, F.col("ord") + 4).otherwise(F.col("ord"))
    placed = b.where("ord % 13 <> 5").select("doc_id", F.row_number().over(Window.partitionBy("doc_id").orderBy(at, "ord")).alias("pos"), "block_id")
    return store.order_errors(placed, b.select("doc_id", "ord", "block_id"))


@query(with_views("blocks", body=""", g AS (SELECT doc_id, block_id, ord, ord % 3 + 1 AS s, ord % 2 + 1 AS t, ord % 11 = 4 AS fall FROM blocks)
    SELECT doc_id, block_id, CASE WHEN fall THEN block_id ELSE block_id || '-g-1' END AS unit_id,
    CASE WHEN fall THEN 'paragraph-fallback' WHEN s = 1 AND t = 1 THEN '1:1' WHEN s = 1 THEN '1:n' WHEN t = 1 THEN 'n:1' ELSE 'n:m' END AS relation, CASE WHEN fall THEN 1 ELSE t END::BIGINT AS n, repeat('x', t::INT) AS target FROM g"""))
def response_groups(spark, d):
    b = V.blocks(spark, d)
    fill = lambda v, n: F.transform(F.sequence(F.lit(1), n.cast("int")), lambda i: F.lit(v))
    g = F.array(F.struct(fill("s", F.col("ord") % 3 + 1).alias("sources"), fill("x", F.col("ord") % 2 + 1).alias("targets")))
    r = b.select("doc_id", "block_id", F.when(F.col("ord") % 11 == 4, "paragraph-fallback").otherwise("sentence-candidates").alias("mode"), g.alias("groups"))
    return store.groups(r).select("doc_id", "block_id", "unit_id", "relation", F.size("target_ids").cast("long").alias("n"), "target")


@query(with_views("ai_log", body="""SELECT project, count(*) FILTER (type = 'view') > 0 AND count(*) FILTER (type = 'view') = count(*) FILTER (tokens > 10) AND count(*) FILTER (elapsed < 0) = 0 AS ready FROM ai_log GROUP BY project"""))
def reader_ready(spark, d):
    e = V.ai_log(spark, d).groupBy("project").agg(F.count_if(F.col("type") == "view").alias("r"), F.count_if(F.col("tokens") > 10).alias("v"), F.count_if(F.col("elapsed") < 0).alias("f"))
    return e.select("project", work.can_enter_reader(F.col("r"), F.col("v"), F.col("f")).alias("ready"))


@query(r"""SELECT conv_id, turn, regexp_replace(text, '(["\\])', '\\\1', 'g') AS quoted FROM conversations WHERE text IS NOT NULL""")
def escaped_strings(spark, d):
    return table(spark, d, "conversations").where("text IS NOT NULL").select("conv_id", "turn", P.escape_string(F.concat("text", F.lit(""))).alias("quoted"))


# --- crops --------------------------------------------------------------------------------------------


def _crops(spark, d) -> DataFrame:
    """Every tenth block with what stands below it, as regions of all kinds."""
    u = _units(spark, d).where("ord % 10 = 2")
    kind = F.get(F.array(*map(F.lit, ["figure", "table", "code"])), (F.floor(F.col("ord") / 10) % 3).cast("int"))
    return u.select("doc_id", F.col("unit_id").alias("region_id"), kind.alias("kind"), "page", (F.col("x") - 10).alias("x"), (F.col("y") + F.col("ord") % 7 - 1).alias("y"), (F.col("w") + 20).alias("w"), (90.0 + F.col("ord") % 50).alias("h"))


_CV = """g AS (SELECT doc_id, unit_id AS region_id, ['figure', 'table', 'code'][(ord // 10) % 3 + 1] AS kind, page, x - 10 AS x, y + ord % 7 - 1 AS y, w + 20 AS w, 90.0 + ord % 50 AS h FROM u WHERE ord % 10 = 2),
    gl AS (SELECT a.doc_id, a.region_id, list({'y': b.y, 'bottom': b.y + b.h + b.ord % 3, 't': b.text} ORDER BY b.y, b.y + b.h + b.ord % 3, b.text) AS ls FROM g a JOIN u b ON a.doc_id = b.doc_id AND a.page = b.page
        WHERE least(a.x + a.w, b.x + b.w) > greatest(a.x, b.x) AND least(a.y + a.h, b.y + b.h + b.ord % 3) > greatest(a.y, b.y) GROUP BY ALL), c AS (SELECT * FROM g LEFT JOIN gl USING (doc_id, region_id))"""
_NW = r"len(regexp_extract_all({}, '[A-Za-z]{{3,}}'))"


@query(with_views("blocks", body=rf""", {_UV}, {_CV}, i AS (SELECT doc_id, region_id, kind, x, y, w, h, ls, generate_subscripts(ls, 1) AS n FROM c),
    f AS (SELECT doc_id, region_id, max(ls[n].bottom) FILTER (ls[n].y < 79.2 AND ls[n].y < y + 40 AND {_NW.format("ls[n].t")} >= 4 AND length(trim(ls[n].t)) >= 24) AS head,
        min(n) FILTER (n > 3 AND ls[n].y - ls[n - 1].bottom >= 4 AND ({_NW.format("ls[n].t")} >= CASE kind WHEN 'table' THEN 7 ELSE 4 END OR ({_NW.format("ls[n].t")} >= 3 AND regexp_matches(ls[n].t, '[.!?]\s*$'))) AND least(y + h, ls[n - 1].bottom + 2) > y + 12) AS prose,
        coalesce(min(n) FILTER (NOT (ls[n].y - CASE WHEN n = 1 THEN y ELSE ls[n - 1].bottom + 3 END <= 18 AND len(regexp_extract_all(ls[n].t, '[A-Za-z]{{2,}}')) >= 4 AND len(regexp_extract_all(ls[n].t, '[0-9]+(?:[.][0-9]+)?')) <= 2
            AND (regexp_matches(trim(ls[n].t), '^[\p{{Ll}}(]') OR regexp_matches(ls[n].t, '[.!?]\s*$')))) - 1, 3) AS led FROM i GROUP BY ALL)
    SELECT doc_id, region_id, CASE WHEN kind IN ('figure', 'table') AND y <= 792 * 0.12 AND head + 4 < y + h - 12 THEN head + 4 ELSE y END AS top,
    CASE WHEN kind IN ('table', 'code') AND len(ls) >= 4 AND prose IS NOT NULL THEN least(y + h, ls[prose - 1].bottom + 2) - y ELSE h END AS h,
    CASE WHEN kind = 'table' AND least(led, 3, len(ls)) > 0 AND ls[least(led, 3, len(ls))].bottom + 3 < y + h - 12 THEN ls[least(led, 3, len(ls))].bottom + 3 ELSE y END AS below FROM c LEFT JOIN f USING (doc_id, region_id)"""))
def crops_off_text(spark, d):
    lines = _units(spark, d).withColumn("h", F.col("h") + F.col("ord") % 3)
    r = C.region_lines(_crops(spark, d), lines.select("doc_id", "page", "x", "y", "w", "h", "text"))
    made = r.select("doc_id", "region_id", C.without_top_furniture(HEIGHT).alias("a"), C.without_trailing_prose().alias("b"), C.without_caption_rest().alias("c"))
    return made.select("doc_id", "region_id", F.col("a.y").alias("top"), F.col("b.h").alias("h"), F.col("c.y").alias("below"))


@query(with_views("blocks", body=f""", {_UV}, {_CV}, p AS (SELECT doc_id, page, unit_id, x, y, w, h FROM u WHERE kind = 'caption'),
    n AS (SELECT a.doc_id, a.region_id, min(b.y) AS nx FROM g a JOIN p b ON a.doc_id = b.doc_id AND a.page = b.page WHERE a.kind = 'table' AND {_SX} > 0 AND b.y > a.y + 12 AND b.y < a.y + a.h AND b.unit_id <> a.region_id GROUP BY ALL),
    e AS (SELECT a.doc_id, a.region_id, max(b.y + b.h + 4) AS low FROM g a JOIN u b ON a.doc_id = b.doc_id AND a.page = b.page WHERE a.kind = 'figure' AND b.kind <> 'caption' AND {_SX} > 0 AND b.y + b.h + 4 >= a.y - 4 AND b.y + b.h + 4 <= a.y + 2 GROUP BY ALL)
    SELECT doc_id, region_id, CASE WHEN nx - 3 > y + 12 THEN nx - 3 - y ELSE h END AS h, CASE WHEN low + 6 < y + h - 12 THEN low + 6 ELSE y END AS y FROM g LEFT JOIN n USING (doc_id, region_id) LEFT JOIN e USING (doc_id, region_id)"""))
def crops_between_blocks(spark, d):
    u, g = _units(spark, d), _crops(spark, d)
    cut = C.cut_at_captions(g.withColumn("caption_id", F.col("region_id")), u.where("kind = 'caption'").select("doc_id", "page", F.col("unit_id").alias("block_id"), "x", "y", "w", "h"))
    clear = C.clear_of_text_above(g, u.where("kind <> 'caption'").withColumn("h", F.col("h") + 4).select("doc_id", "page", "x", "y", "w", "h"))
    return cut.select("doc_id", "region_id", "h").join(clear.select("doc_id", "region_id", "y"), ["doc_id", "region_id"])


_REASONS = ["caption-unmatched", "foreign-caption-overlap", "body-prose-density", "other", "implausible-formula-cluster", "caption-overlap"]


def _unresolved(spark, d) -> DataFrame:
    r = V.rects(spark, d)
    reason = F.get(F.array(*map(F.lit, _REASONS)), ((F.col("x") / 10).cast("int") % 6).cast("int"))
    return r.where("id % 2 = 0").select((F.col("page") % 50).alias("doc_id"), "page", F.col("id").alias("region_id"), reason.alias("reason"))


def _rect_regions(spark, d) -> DataFrame:
    return V.rects(spark, d).select((F.col("page") % 50).alias("doc_id"), "page", F.col("id").alias("region_id"), "x", "y", "w", "h")


_NV = "n AS (SELECT *, [" + ", ".join(f"'{r}'" for r in _REASONS) + "][(x // 10) % 6 + 1] AS reason FROM rects WHERE id % 2 = 0)"


@query(with_views("rects", body=f""", {_NV} SELECT page % 50 AS doc_id, page, id AS region_id, 'source-plan.' || reason AS code,
    CASE WHEN reason IN ('caption-unmatched', 'caption-overlap') THEN 'bbox captionBBox captionLink' WHEN reason = 'foreign-caption-overlap' THEN 'bbox' ELSE '' END AS fields,
    concat_ws('|', page, reason, id, (floor(x / 10 + 0.5) * 10)::BIGINT, (floor(y / 10 + 0.5) * 10)::BIGINT, (floor(w / 10 + 0.5) * 10)::BIGINT, (floor(h / 10 + 0.5) * 10)::BIGINT) AS fingerprint FROM n"""))
def region_issues(spark, d):
    return C.region_issues(_unresolved(spark, d), _rect_regions(spark, d)).withColumn("fields", F.array_join("fields", " "))


@query(with_views("rects", body=f""", {_NV} SELECT r.page, r.id AS region_id, CASE WHEN reason IN ('body-prose-density', 'implausible-formula-cluster') THEN 'remove-rejected-region' ELSE 'kept' END AS action FROM rects r LEFT JOIN n ON n.page = r.page AND n.id = r.id"""))
def rejected_regions(spark, d):
    r, u = _rect_regions(spark, d), _unresolved(spark, d)
    kept = C.without_rejected(r, u).select("page", "region_id", F.lit("kept").alias("action"))
    return kept.unionByName(C.rejections(r, u).select("page", "region_id", "action"))


_TAILS = ["", "\nPOLY unit\nMSM\nab ઁ cd\nmore", "\n1\n2 x\n3\nspeedup\ny 4\nzz\nw 5", "\nThe end of it."]


@query(with_views("lines", body=r""", t AS (SELECT doc_id, line_no, 'Some prose stands here.' || chr(10) || replace(line, chr(13), '') || '.' AS a, line_no % 4 AS k FROM lines)
    SELECT doc_id, line_no, CASE k WHEN 0 THEN a WHEN 1 THEN trim(a, chr(32) || chr(10) || chr(9)) WHEN 2 THEN trim(a, chr(32) || chr(10) || chr(9)) ELSE a || chr(10) || 'The end of it.' END AS text FROM t"""))
def label_clusters(spark, d):
    tail = F.get(F.array(*map(F.lit, _TAILS)), (F.col("line_no") % 4).cast("int"))
    text = F.concat(F.lit("Some prose stands here.\n"), F.replace("line", F.lit("\r"), F.lit("")), F.lit("."), tail)
    return V.lines(spark, d).select("doc_id", "line_no", C.without_label_cluster(text).alias("text"))


@query(r"""SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber IN (3, 4, 6) THEN NULL ELSE 'x_' || l_partkey || ' = y' END AS latex, CASE WHEN l_linenumber IN (3, 4, 6) THEN NULL WHEN l_linenumber % 2 = 0 THEN (l_quantity + 1.5) / 100 ELSE l_discount END AS confidence FROM lineitem""")
def formula_answers(spark, d):
    li = table(spark, d, "lineitem")
    n = F.col("l_linenumber")
    latex = F.when(n == 3, "ab").when(n == 4, "\\\\\\\\input{x} = y").otherwise(F.concat(F.lit("$$ x_"), F.col("l_partkey").cast("string"), F.lit(" = y $")))
    sure = F.when(n == 6, "-1").when(n % 2 == 0, (F.col("l_quantity") + 1.5).cast("string")).otherwise(F.col("l_discount").cast("string"))
    body = F.concat(F.lit('{"latex": "'), latex, F.lit('", "confidence": '), sure, F.lit("}"))
    answer = F.when(n % 3 == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).otherwise(body)
    return li.select("l_orderkey", "l_linenumber", C.formula_answer(answer).alias("a")).select("l_orderkey", "l_linenumber", "a.latex", "a.confidence")


@query(with_views("blocks", body=r""", k AS (SELECT block_id, trim(text, chr(32) || chr(9) || chr(10) || chr(13)) AS s, CASE type WHEN 'figure' THEN 'caption' WHEN 'table' THEN 'caption' WHEN 'equation' THEN 'title' ELSE type END AS kind FROM blocks),
    m AS (SELECT *, CASE kind WHEN 'title' THEN '结构保真的模拟论文标题' WHEN 'section' THEN regexp_replace(s, '^([0-9]+(?:\.[0-9]+)*).*', '\1 节')
        WHEN 'caption' THEN CASE WHEN regexp_matches(s, '(?i)^(fig(?:ure)?\.?|table|algorithm)\s*[0-9]+') THEN CASE WHEN lower(s) LIKE 'fig%' THEN '图' WHEN lower(s) LIKE 'table%' THEN '表' ELSE '算法' END || ' ' || regexp_extract(s, '([0-9]+)', 1) || '：模拟说明' ELSE '模拟图表说明' END
        ELSE '结构保真的模拟译文。' END AS made FROM k),
    l AS (SELECT *, regexp_extract_all(s, '[-+]?[0-9]+(?:,[0-9]{3})*(?:\.[0-9]+)?(?:[eE][-+]?[0-9]+)?') AS a, regexp_extract_all(made, '[-+]?[0-9]+(?:,[0-9]{3})*(?:\.[0-9]+)?(?:[eE][-+]?[0-9]+)?') AS b FROM m)
    SELECT block_id, CASE WHEN len(list_filter(a, lambda x: NOT list_contains(b, x))) > 0 THEN made || '（保留数字：' || array_to_string(list_filter(a, lambda x, i: NOT list_contains(b, x) AND list_position(a, x) = i), '、') || '）' ELSE made END AS text FROM l"""))
def stand_in_translations(spark, d):
    kind = F.when(F.col("type").isin("figure", "table"), "caption").when(F.col("type") == "equation", "title").otherwise(F.col("type"))
    return V.blocks(spark, d).select("block_id", C.stand_in_translation(kind, F.col("text")).alias("text"))


@query("""SELECT conv_id, turn, CASE WHEN role = 'system' THEN '' ELSE concat_ws(chr(10), 'RECOVERY_REQUEST: Correct the previous failed block and return the complete JSON response again.', 'RECOVERY_REASON: ' || role,
    'VALIDATION_CODES: ' || CASE WHEN turn % 3 = 0 THEN 'none' WHEN turn % 3 = 1 THEN 'lost, order' ELSE 'order, untranslated-residual' END, 'VALIDATION_DETAILS: ' || CASE WHEN turn % 2 = 0 THEN 'none' ELSE 'a | b' END,
    CASE WHEN turn % 3 = 2 THEN 'UNTRANSLATED_RESIDUAL_FIX: Translate every ordinary lowercase English word named by the validation details into Chinese.' || chr(10) || 'Do not copy those rejected words into the target unless they are protected tokens, identifiers, names, or standard abbreviations.' END,
    'Preserve every protected_tokens item exactly, satisfy every alignment requirement, and do not omit content.') END AS text FROM conversations""")
def recovery_instructions(spark, d):
    none = F.array().cast("array<string>")
    codes = F.when(F.col("turn") % 3 == 0, none).when(F.col("turn") % 3 == 1, F.array(F.lit("lost"), F.lit("order"))).otherwise(F.array(F.lit("order"), F.lit("untranslated-residual")))
    details = F.when(F.col("turn") % 2 == 0, none).otherwise(F.array(F.lit("a"), F.lit("b")))
    reason = F.when(F.col("role") != "system", F.col("role"))
    return table(spark, d, "conversations").select("conv_id", "turn", C.recovery_instruction(reason, codes, details).alias("text"))


@query(with_views("artifacts", body="""SELECT key AS asset_id, kind, sha256(key::VARCHAR) AS sha256, CASE WHEN key % 2 = 0 THEN 'span' ELSE 'column' END AS width_mode, CASE WHEN key % 3 = 0 THEN key END AS caption_id, key % 2 = 0 AND key % 3 = 0 AS current FROM artifacts"""))
def asset_manifests(spark, d):
    a = V.artifacts(spark, d)
    k = F.col("key")
    m = C.asset_manifest(a.select(k.alias("asset_id"), "kind", k.cast("string").cast("binary").alias("bytes"), F.when(k % 2 == 0, "span").alias("width_mode"), F.when(k % 3 == 0, k).alias("caption_id")))
    policy, profile = F.when(F.col("width_mode") == "span", "single-column"), F.when(F.col("caption_id").isNotNull(), "zh-single-column-v1")
    return m.withColumn("current", C.uses_current_layout(policy, profile))
