"""Queries over rectangles, graphs, reader, state, streams and sequential operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagelith import streaming
from pagelith.functions import text as T
from pagelith.operators import alignment, assets, gates, graphs, reader, rects, sequential, work
from pagelith.plans import fixtures as V
from pagelith.plans.fixtures import with_views
from pagelith.sources import table

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


_OVER = "greatest(0, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) * greatest(0, least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y))"


@query(with_views("rects", body=f"SELECT a.page, a.id AS a_id, b.id AS b_id, ({_OVER})::BIGINT AS overlap FROM rects a JOIN rects b ON a.page = b.page AND a.id < b.id WHERE {_OVER} > 0"))
def rect_overlap_join(spark, d):
    r = V.rects(spark, d)
    j = rects.overlap_join(r, r, ["page"], ["id"], ["id"]).where("a_id < b_id")
    return j.select("page", "a_id", "b_id", F.col("overlap").cast("long").alias("overlap"))


@query(with_views("rects", body=f"""SELECT DISTINCT a.page, a.id FROM rects a JOIN rects b ON a.page = b.page AND a.id <> b.id WHERE {_OVER} / greatest(1, a.w * a.h) >= 0.6
    AND (b.w * b.h > a.w * a.h OR (b.w * b.h = a.w * a.h AND b.id < a.id)) AND {_OVER} > 0"""))
def nested_regions(spark, d):
    return rects.nested(V.rects(spark, d), ["page"], "id", 0.6)


@query(with_views("rects", body=f"""SELECT page, a_id, b_id, iou FROM (SELECT *, row_number() OVER (PARTITION BY page, a_id ORDER BY iou DESC, b_id) AS r FROM (
    SELECT a.page, a.id AS a_id, b.id AS b_id, ({_OVER}) / (a.w * a.h + b.w * b.h - ({_OVER})) AS iou FROM rects a JOIN rects b ON a.page = b.page AND a.id % 2 = 1 AND b.id % 2 = 0 WHERE {_OVER} > 0)) WHERE r = 1"""))
def best_iou_snap(spark, d):
    r = V.rects(spark, d)
    return rects.best_iou(r.where("id % 2 = 1"), r.where("id % 2 = 0"), ["page"], "id", "id")


@query(with_views("rects", body="""SELECT page, a_id, b_id, distance::DOUBLE AS distance FROM (SELECT *, row_number() OVER (PARTITION BY page, a_id ORDER BY distance, b_id) AS r FROM (
    SELECT a.page, a.id AS a_id, b.id AS b_id, abs((a.x + a.w / 2) - (b.x + b.w / 2)) + abs(a.y - b.y - b.h) AS distance FROM rects a JOIN rects b ON a.page = b.page AND a.id % 2 = 1 AND b.id % 2 = 0) WHERE distance <= 200) WHERE r = 1"""))
def caption_nearest(spark, d):
    r = V.rects(spark, d)
    distance = F.abs((F.col("a_x") + F.col("a_w") / 2) - (F.col("b_x") + F.col("b_w") / 2)) + F.abs(F.col("a_y") - F.col("b_y") - F.col("b_h"))
    return rects.nearest(r.where("id % 2 = 1"), r.where("id % 2 = 0"), ["page"], "id", "id", distance, 200.0).withColumn("distance", F.col("distance").cast("double"))


@query(with_views("rects", body="""SELECT page, id, inside, inside / points AS share FROM (SELECT b.page, b.id, count(*)::BIGINT AS inside FROM rects b JOIN rects p ON p.page = b.page
    AND p.x + 5 BETWEEN b.x AND b.x + b.w AND p.y + 5 BETWEEN b.y AND b.y + b.h GROUP BY b.page, b.id) JOIN (SELECT page, count(*) AS points FROM rects GROUP BY page) USING (page)"""))
def point_in_rect_coverage(spark, d):
    r = V.rects(spark, d)
    return rects.point_coverage(r.select("page", (F.col("x") + 5).alias("px"), (F.col("y") + 5).alias("py")), r, ["page"], "id")


@query(with_views("rects", body="""SELECT page, cluster::BIGINT AS cluster, min(x) AS x, min(y) AS y, max(x + w) - min(x) AS w, max(y + h) - min(y) AS h, count(*)::BIGINT AS n FROM (
    SELECT *, sum(f) OVER (PARTITION BY page ORDER BY y, id ROWS UNBOUNDED PRECEDING) - 1 AS cluster FROM (SELECT *, CASE WHEN y - max(y + h) OVER (PARTITION BY page ORDER BY y, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= 4 THEN 0 ELSE 1 END AS f FROM rects)) GROUP BY page, cluster"""))
def vertical_clusters(spark, d):
    return rects.vertical_clusters(V.rects(spark, d), ["page"], 4.0).withColumn("cluster", F.col("cluster").cast("long"))


@query("""SELECT doc_id, target_page, source_page, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, target_page ORDER BY score DESC, source_page) AS rank FROM (
    SELECT l_suppkey AS doc_id, l_partkey % 20 AS target_page, l_orderkey % 30 AS source_page, sum(l_quantity::BIGINT)::BIGINT AS score FROM lineitem GROUP BY ALL)) WHERE rank <= 2""")
def page_map_top2(spark, d):
    s = table(spark, d, "lineitem").select(
        F.col("l_suppkey").alias("doc_id"), (F.col("l_partkey") % 20).alias("target_page"), (F.col("l_orderkey") % 30).alias("source_page"), F.col("l_quantity").cast("long").alias("score")
    )
    return rects.top_pages(s).withColumn("rank", F.col("rank").cast("long"))


@query(with_views("rects", body=f"""SELECT page AS doc_id, issue_id, unit_id, overlap FROM (SELECT *, row_number() OVER (PARTITION BY page ORDER BY overlap DESC, unit_id) AS r FROM (
    SELECT a.page, a.id AS issue_id, b.id AS unit_id, ({_OVER})::DOUBLE AS overlap FROM rects a JOIN rects b ON a.page = b.page WHERE a.id = 1 AND b.id > 1 AND {_OVER} > 0)) WHERE r = 1"""))
def issue_unit_mapping(spark, d):
    r = V.rects(spark, d).withColumn("doc_id", F.col("page"))
    issues, units = r.where("id = 1").withColumnRenamed("id", "issue_id"), r.where("id > 1").withColumnRenamed("id", "unit_id")
    return gates.mapped_unit(issues, units).withColumn("overlap", F.col("overlap").cast("double"))


@query(with_views("rects", body="SELECT page, id FROM rects WHERE y + h > 120 - greatest(36.0, 612 * 0.1) + 2"))
def footer_overflow(spark, d):
    r = V.rects(spark, d).withColumn("doc_id", F.col("page"))
    pages = r.select("doc_id", "page").distinct().withColumn("page_w", F.lit(612.0)).withColumn("page_h", F.lit(120.0))
    return gates.footer_overflows(r, pages).select("page", "id")


@query(with_views("blocks", body="""SELECT p.doc_id, p.probe, p."at", coalesce((SELECT max_by(b.block_id, (b.y + 800 * b.page, b.block_id)) FROM blocks b WHERE b.doc_id = p.doc_id AND b.y + 800 * b.page <= p."at"),
    (SELECT min_by(b.block_id, (b.y + 800 * b.page, b.block_id)) FROM blocks b WHERE b.doc_id = p.doc_id)) AS block_id FROM (SELECT doc_id, k AS probe, (k * 97.0)::DOUBLE AS "at" FROM (SELECT DISTINCT doc_id FROM blocks), range(8) t(k)) p"""))
def asof_block(spark, d):
    b = V.blocks(spark, d)
    probes = b.select("doc_id").distinct().select("doc_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(7).cast("long"))).alias("probe"))
    return reader.locate(reader.position_index(b, 800.0), probes.withColumn("at", F.col("probe") * 97.0))


@query("""WITH a AS (SELECT o_custkey AS doc_id, (o_orderkey % 1000)::DOUBLE AS source, max((o_orderkey * 7 % 1300)::DOUBLE) AS target, (o_orderkey % 1000)::BIGINT AS id FROM orders GROUP BY ALL),
    p AS (SELECT doc_id, k AS probe, (k * 211.0)::DOUBLE AS "at" FROM (SELECT DISTINCT doc_id FROM a), range(5) t(k)),
    x AS (SELECT p.*, (SELECT max(source) FROM a WHERE a.doc_id = p.doc_id AND source <= "at") AS lo, (SELECT min(source) FROM a WHERE a.doc_id = p.doc_id AND source >= "at") AS hi FROM p),
    y AS (SELECT doc_id, probe, "at", coalesce(lo, hi) AS lo, coalesce(hi, lo) AS hi FROM x)
    SELECT y.doc_id, probe, "at", CASE WHEN hi > lo THEN l.target + least(1.0, greatest(0.0, ("at" - lo) / (hi - lo))) * (h.target - l.target) ELSE l.target END AS target, CASE WHEN abs("at" - lo) <= abs(hi - "at") THEN l.id ELSE h.id END AS unit_id
    FROM y JOIN a l ON l.doc_id = y.doc_id AND l.source = lo JOIN a h ON h.doc_id = y.doc_id AND h.source = hi""")
def sync_interpolation(spark, d):
    o = table(spark, d, "orders")
    a = o.select(F.col("o_custkey").alias("doc_id"), (F.col("o_orderkey") % 1000).cast("double").alias("source"), (F.col("o_orderkey") * 7 % 1300).cast("double").alias("target"))
    a = a.groupBy("doc_id", "source").agg(F.max("target").alias("target")).withColumn("id", F.col("source").cast("long"))
    p = a.select("doc_id").distinct().select("doc_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(4).cast("long"))).alias("probe")).withColumn("at", F.col("probe") * 211.0)
    return reader.interpolate(a, p)


@query(with_views("ai_log", body="""SELECT project, count(*)::BIGINT AS n, median(elapsed / tokens) AS ms_per_token FROM (SELECT *, row_number() OVER (PARTITION BY project ORDER BY "at" DESC, seq DESC) AS r FROM ai_log WHERE tokens > 0 AND elapsed > 0)
    WHERE r <= 8 GROUP BY project HAVING count(*) >= 2"""))
def throughput_median8(spark, d):
    return work.eta(V.ai_log(spark, d))


@query(with_views("ai_log", body="""SELECT project, seq, type FROM (SELECT *, row_number() OVER (PARTITION BY project ORDER BY seq DESC) AS r FROM (
    SELECT *, row_number() OVER (PARTITION BY project, CASE WHEN type = 'view' THEN coalesce(tokens, 0) % 3 ELSE seq END, type = 'view' ORDER BY seq DESC) AS q FROM ai_log) WHERE q = 1 OR type <> 'view') WHERE r <= 200"""))
def ai_log_fold(spark, d):
    e = V.ai_log(spark, d).withColumn("kind", F.col("type")).withColumn("batch", F.coalesce("tokens", F.lit(0)) % 3 - 10)
    e = e.withColumn("type", F.when(F.col("kind") == "view", "batch-progress").otherwise(F.col("kind")))
    return work.ai_log(e).select("project", "seq", F.col("kind").alias("type"))


_STAGED = ["START_PARSE", "PARSE_DONE", "LAYOUT_DONE", "GLOSSARY_DONE", "START_TRANSLATION", "BLOCKS_VALIDATED", "TRANSLATION_DONE", "COMPOSITION_DONE", "COMPILE_DONE", "QUALITY_STARTED", "PAUSED", "RESUME", "STOP_REQUESTED", "STOPPED"]


def task_events(spark, d):
    """Events of a user in order, typed in turn, with now and then one out of turn."""
    from pyspark.sql import Window

    e = V.ai_log(spark, d)
    n = F.row_number().over(Window.partitionBy("project").orderBy("seq")) - 1
    i = F.when(F.col("seq") % 9 == 0, F.col("seq") % 14).otherwise(n % 14)
    return e.select("project", "seq", F.get(F.array(*map(F.lit, _STAGED)), i.cast("int")).alias("type"), F.lit(1).cast("long").alias("count"))


@query()
def task_reducer(spark, d):
    return work.replay(task_events(spark, d))


@query(with_views("artifacts", body="""SELECT DISTINCT key FROM artifacts WHERE project_id % 3 = 0 AND kind <> 'english-pdf' AND (
    (kind IN ('raw-vision-response', 'vision-layout') AND project_id % 2 = 0 AND pages[1] IN (1, 2)) OR (kind IN ('chinese-pdf', 'quality-report'))
    OR (kind = 'accepted-page-plan' AND pages[1] IN (1, 2)) OR (kind = 'formula-ocr' AND project_id % 2 = 0 AND pages[1] IN (1, 2)))"""))
def invalidation_plan(spark, d):
    a = V.artifacts(spark, d)
    c = a.where("project_id % 3 = 0").select("project_id").distinct()
    facets = F.when(F.col("project_id") % 2 == 0, F.array(F.lit("source-analysis"))).otherwise(F.array(F.lit("caption-link")))
    return work.invalidation(a, c.select("project_id", facets.alias("facets"), F.array(F.lit(1), F.lit(2)).alias("pages")))


@query(with_views("artifacts", body="""SELECT project_id, kind, max("at") AS "at", max_by(key, ("at", key)) AS key FROM artifacts GROUP BY project_id, kind"""))
def artifact_upsert(spark, d):
    a = V.artifacts(spark, d).select("project_id", "kind", "at", "key")
    last = a.groupBy("project_id", "kind", "at").agg(F.max("key").alias("key"))
    return work.upsert(last.where("key % 2 = 0"), last.where("key % 2 = 1"), ["project_id", "kind"], "at").groupBy("project_id", "kind").agg(F.max("at").alias("at"), F.max_by("key", F.struct("at", "key")).alias("key"))


@query("""WITH t AS (SELECT p_size AS doc_id, CASE p_partkey % 3 WHEN 0 THEN 'model' WHEN 1 THEN 'detected' ELSE 'user' END AS st, p_partkey AS seq, p_type AS source, p_name AS target FROM part),
    r AS (SELECT *, lower(trim(source)) AS term, CASE st WHEN 'model' THEN 0 WHEN 'detected' THEN 1 ELSE 2 END AS rk FROM t), g AS (SELECT doc_id, term, max_by(target, (rk, seq)) AS target, max_by(st, (rk, seq)) AS source_type, min((rk, seq)) AS f FROM r GROUP BY doc_id, term)
    SELECT doc_id, term, target, source_type, row_number() OVER (PARTITION BY doc_id ORDER BY f) AS position FROM g""")
def glossary_merge(spark, d):
    p = table(spark, d, "part")
    kind = F.when(F.col("p_partkey") % 3 == 0, "model").when(F.col("p_partkey") % 3 == 1, "detected").otherwise("user")
    t = p.select(F.col("p_size").alias("doc_id"), kind.alias("source_type"), F.col("p_partkey").alias("seq"), F.col("p_type").alias("source"), F.col("p_name").alias("target"))
    return work.merge_glossary(t).select("doc_id", "term", "target", "source_type", F.col("position").cast("long").alias("position"))


@query(with_views("blocks", body=r"""SELECT doc_id, term, min_by(block_id, ord) AS block_id FROM (SELECT b.*, t.term FROM blocks b, (VALUES ('the'), ('and'), ('ing'), ('figure')) t(term)
    WHERE regexp_matches(lower(text), '(?:^|[^\p{L}\p{N}_])' || term || '(?:$|[^\p{L}\p{N}_])')) GROUP BY doc_id, term"""))
def first_occurrence(spark, d):
    b = V.blocks(spark, d)
    terms = b.select("doc_id").distinct().select("doc_id", F.explode(F.array(*map(F.lit, ["the", "and", "ing", "figure"]))).alias("term"))
    return work.first_occurrences(b, terms)


@query("""WITH RECURSIVE m AS (SELECT DISTINCT l_suppkey % 5 AS doc_id, l_orderkey AS grp, l_partkey % 400 AS node FROM lineitem), r(doc_id, node) AS (
    SELECT DISTINCT doc_id, node FROM m WHERE node = 7 UNION SELECT b.doc_id, b.node FROM r JOIN m a ON a.doc_id = r.doc_id AND a.node = r.node JOIN m b ON b.doc_id = a.doc_id AND b.grp = a.grp) SELECT doc_id, node FROM r""")
def reanalysis_closure(spark, d):
    m = table(spark, d, "lineitem").select((F.col("l_suppkey") % 5).alias("doc_id"), F.col("l_orderkey").alias("grp"), (F.col("l_partkey") % 400).alias("node")).distinct()
    return graphs.spread(m, m.where("node = 7").select("doc_id", "node"))


@query("""WITH RECURSIVE e AS (SELECT DISTINCT o_custkey AS doc_id, o_orderkey % 40 AS a, (o_orderkey * 3 + 1) % 40 AS b FROM orders), r AS (
    SELECT doc_id, a, b FROM e UNION SELECT r.doc_id, r.a, e.b FROM r JOIN e ON e.doc_id = r.doc_id AND e.a = r.b) SELECT DISTINCT doc_id FROM r WHERE a = b""")
def order_cycle(spark, d):
    o = table(spark, d, "orders")
    return graphs.cyclic(o.select(F.col("o_custkey").alias("doc_id"), (F.col("o_orderkey") % 40).alias("a"), ((F.col("o_orderkey") * 3 + 1) % 40).alias("b")))


def _page_ends(spark, d):
    r = V.rects(spark, d)
    base = r.select((F.col("page") % 97).alias("doc_id"), F.floor(F.col("page") / 97).alias("page"), F.when(F.col("id") % 2 == 0, "table").otherwise("figure").alias("type"), (F.col("page") * 10 + F.col("id")).alias("id"), F.col("x").cast("double").alias("x"), "y")
    return base.where("y >= 70"), base.where("y <= 30")


@query(with_views("rects", body=""", b AS (SELECT page % 97 AS doc_id, page // 97 AS page, CASE WHEN id % 2 = 0 THEN 'table' ELSE 'figure' END AS type, page * 10 + id AS id, x::DOUBLE AS x, y FROM rects),
    c AS (SELECT t.doc_id, h.page, t.type, t.id AS tail, h.id AS head, abs(t.x - h.x) AS d FROM b t JOIN b h ON h.doc_id = t.doc_id AND h.type = t.type AND h.page = t.page + 1 WHERE t.y >= 70 AND h.y <= 30 AND abs(t.x - h.x) <= 100)
    SELECT doc_id, type, page, tail, head, d FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, type, page, tail ORDER BY d, head) AS rt, row_number() OVER (PARTITION BY doc_id, type, page, head ORDER BY d, tail) AS rh FROM c) WHERE rt = 1 AND rh = 1"""))
def crosspage_links(spark, d):
    return graphs.page_links(*_page_ends(spark, d))


@query("""WITH RECURSIVE n AS (SELECT o_custkey AS doc_id, o_orderkey AS a, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS b FROM orders), l AS (SELECT * FROM n WHERE b IS NOT NULL AND (a + b) % 3 <> 0),
    c AS (SELECT doc_id, a AS head, a AS node, 0 AS pos FROM l WHERE NOT EXISTS (SELECT 1 FROM l x WHERE x.doc_id = l.doc_id AND x.b = l.a) UNION ALL SELECT c.doc_id, c.head, l.b, c.pos + 1 FROM c JOIN l ON l.doc_id = c.doc_id AND l.a = c.node)
    SELECT doc_id, node, head, pos FROM c""")
def crosspage_chains(spark, d):
    from pyspark.sql import Window

    nxt = F.lead("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    links = table(spark, d, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("a"), nxt.alias("b")).where("b IS NOT NULL AND (a + b) % 3 <> 0")
    return graphs.chains(links)


@query("SELECT time_bucket(INTERVAL '1 hour', ts) AS begin, event_type, count(*)::BIGINT AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_tumbling(spark, d):
    return streaming.windows(table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), "1 hour").withColumn("total", F.round("total", 4))


@query("""SELECT b AS begin, event_type, count(*)::BIGINT AS n, round(sum(value), 4) AS total FROM (SELECT *, unnest([time_bucket(INTERVAL '30 minutes', ts), time_bucket(INTERVAL '30 minutes', ts) - INTERVAL '30 minutes']) AS b FROM events) GROUP BY ALL""")
def stream_sliding(spark, d):
    return streaming.windows(table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), "1 hour", "30 minutes").withColumn("total", F.round("total", 4))


@query("""SELECT min(ts) AS begin, max(ts) + INTERVAL '20 minutes' AS "end", user_id, count(*)::BIGINT AS n FROM (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM (
    SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL '20 minutes' THEN 0 ELSE 1 END AS s FROM events)) GROUP BY user_id, k""")
def stream_sessions(spark, d):
    return streaming.sessions(table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), "20 minutes")


@query(with_views("turn_pairs", body="""SELECT conv_id, turn, CASE WHEN length(source) = 1 AND length(target) = 1 THEN '1:1' WHEN length(source) % 3 = 1 AND length(target) % 3 = 1 THEN '1:1' WHEN length(source) % 3 = 1 AND length(target) % 3 > 1 THEN '1:n'
    WHEN length(source) % 3 > 1 AND length(target) % 3 = 1 THEN 'n:1' ELSE 'n:m' END AS relation FROM turn_pairs"""))
def relation_classes(spark, d):
    t = V.turn_pairs(spark, d)
    return t.select("conv_id", "turn", alignment.relation(F.length("source") % 3, F.length("target") % 3).alias("relation"))


@query(with_views("turn_pairs", body=r"""SELECT DISTINCT conv_id AS doc_id, lower(trim(a)) AS na, lower(trim(b)) AS nb FROM (SELECT *, string_split(source, ' ')[1] AS a, string_split(target, ' ')[1] AS b FROM turn_pairs)
    WHERE trim(a) <> '' AND trim(b) <> '' AND contains(trim(regexp_replace(lower(source), '[\s　]+', ' ', 'g')), trim(regexp_replace(lower(a), '[\s　]+', ' ', 'g')))""".replace("lower(trim(a))", "trim(regexp_replace(lower(a), '[\\s　]+', ' ', 'g'))").replace("lower(trim(b))", "trim(regexp_replace(lower(b), '[\\s　]+', ' ', 'g'))")))
def span_validation(spark, d):
    t = V.turn_pairs(spark, d)
    word = lambda c: F.get(F.split(c, " "), F.lit(0))
    return alignment.valid_spans(t.select(F.col("conv_id").alias("doc_id"), word("source").alias("a"), word("target").alias("b"), "source", "target"))


def _segment_scores(spark, d):
    """Positions of the two sides of each conversation pair's sentences, scored by shared length."""
    t = V.turn_pairs(spark, d)
    side = lambda c: t.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("segment"), F.posexplode(T.sentences(F.col(c))).alias("pos", "text"))
    score = lambda a, b: 1 - F.abs(F.length(a) - F.length(b)) / F.greatest(F.length(a), F.length(b))
    return alignment.score_texts(side("source"), side("target"), score)


@query()
def sentence_dp(spark, d):
    return alignment.align_segments(_segment_scores(spark, d), 0.85)


@query()
def block_dp(spark, d):
    return alignment.align_segments(_segment_scores(spark, d), 0.8)


@query()
def parse_page(spark, d):
    b = V.blocks(spark, d)
    items = b.select("doc_id", "page", F.col("ord").alias("item_no"), F.col("text").alias("str"), "x", (F.col("y") + F.col("ord") % 3).alias("y"), "w", "h")
    return sequential.lines_of(items, 612.0)


@query()
def mask_restore(spark, d):
    return sequential.mask_blocks(V.blocks(spark, d))


#: A table of rests that lose a piece each round; cut is how much goes.
_SPLIT = """WITH RECURSIVE r AS (SELECT {key} AS key, -1 AS part, {first} AS rest, '' AS piece FROM {source} WHERE text IS NOT NULL UNION ALL
    SELECT key, part + 1, {trim_rest}, {trim_piece} FROM (SELECT *, {cut} AS cut FROM (SELECT *, {a} AS a, {b} AS b FROM r WHERE rest <> ''))) SELECT key AS {name}, part, piece AS text FROM r WHERE part >= 0"""
_BARE = "trim({}, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"


@query(_SPLIT.format(
    key="doc_id", name="doc_id", source="documents", first=_BARE.format("text"), trim_rest=_BARE.format("substr(rest, cut + 1)"), trim_piece=_BARE.format("left(rest, cut)"),
    a=r"""length(regexp_extract(left(rest, 1801), '(?s)^(.*(?:[.!?。！？]["'')\]]*\s+|\n{2,}))', 1))""", b="length(regexp_extract(left(rest, 1801), '(?s)^(.*) ', 1))",
    cut="CASE WHEN length(rest) <= 1800 THEN length(rest) WHEN 2 * a >= 1800 THEN a WHEN 2 * b >= 1800 THEN b ELSE 1800 END",
))
def oversized_split(spark, d):
    return sequential.pieces(table(spark, d, "documents"), "doc_id", "text")


@query(_SPLIT.format(
    key="conv_id || '-' || turn", name="key", source="conversations", first="text", trim_rest="substr(rest, cut + 1)", trim_piece="left(rest, cut)",
    a=r"""length(regexp_extract(left(rest, 340), '(?s)^(.*[.!?;:]\s*\s)', 1))""", b=r"length(regexp_extract(left(rest, 340), '(?s)^(.*\s)', 1))",
    cut="CASE WHEN length(rest) <= 340 THEN length(rest) WHEN a > 120 THEN a WHEN b > 120 THEN b ELSE 340 END",
))
def repair_chunks(spark, d):
    return sequential.pieces(table(spark, d, "conversations").withColumn("key", F.concat_ws("-", "conv_id", "turn")), "key", "text", sequential.split_for_repair)


@query()
def source_geometry(spark, d):
    docs = table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", "text")
    parts = docs.select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("pos", "part"))
    return sequential.match_segments(parts, docs)


@query()
def paginate(spark, d):
    b = V.blocks(spark, d)
    h = F.ceil(F.length("text") * 6 / F.col("w")) * 12.0
    return sequential.paginate(b.where("w > 0").select("doc_id", "ord", h.alias("h"), F.col("type").isin("figure", "table").alias("atomic")), 700.0)


@query()
def region_merge(spark, d):
    return sequential.merge_regions(V.rects(spark, d))


def _assets(spark, d):
    r = V.rects(spark, d).withColumn("doc_id", F.col("page"))
    kind = F.get(F.array(*map(F.lit, ["figure", "table", "formula", "code"])), (F.col("id") % 4).cast("int"))
    box = [F.col(c).cast("double").alias(c) for c in ("x", "y", "w", "h")]
    caption = F.when(F.col("id") % 3 == 1, F.concat(F.lit("c"), F.col("id").cast("string")))
    regions = r.select("doc_id", "page", "id", kind.alias("kind"), *box, caption.alias("caption_id"))
    captions = r.where("id % 3 = 1").select("doc_id", "page", F.concat(F.lit("c"), F.col("id").cast("string")).alias("caption_id"), kind.alias("kind"), F.concat(F.lit("figure:"), F.col("id").cast("string")).alias("identity"),
                                            F.col("x").cast("double").alias("x"), (F.col("y") + F.when(F.col("id") % 2 == 0, 20).otherwise(32)).cast("double").alias("y"), F.col("w").cast("double").alias("w"), F.lit(10.0).alias("h"))
    return regions, captions


_AS = """rg AS (SELECT page, id, ['figure', 'table', 'formula', 'code'][id % 4 + 1] AS kind, x::DOUBLE AS x, y::DOUBLE AS y, w::DOUBLE AS w, h::DOUBLE AS h, CASE WHEN id % 3 = 1 THEN 'c' || id END AS caption_id FROM rects),
    cp AS (SELECT page, 'c' || id AS caption_id, ['figure', 'table', 'formula', 'code'][id % 4 + 1] AS kind, x::DOUBLE AS x, (y + CASE WHEN id % 2 = 0 THEN 20 ELSE 32 END)::DOUBLE AS y, w::DOUBLE AS w, 10.0::DOUBLE AS h FROM rects WHERE id % 3 = 1)"""


@query(with_views("rects", body=f""", {_AS} SELECT page, id, y1 AS y, e1 - y1 AS h FROM (SELECT page, id, CASE WHEN kind IN ('table', 'code') AND above IS NOT NULL THEN least(y + h, above + 2) ELSE y END AS y1,
    CASE WHEN kind = 'figure' AND below IS NOT NULL THEN greatest(y, below - 2) ELSE y + h END AS e1 FROM rg LEFT JOIN (SELECT a.page, a.id, min(CASE WHEN b.y + b.h / 2 >= a.y + a.h / 2 THEN b.y END) AS below,
    max(CASE WHEN b.y + b.h / 2 <= a.y + a.h / 2 THEN b.y + b.h END) AS above FROM rg a JOIN cp b ON a.page = b.page AND {_OVER} > 0 GROUP BY a.page, a.id) USING (page, id))"""))
def crop_without_captions(spark, d):
    return assets.without_captions(*_assets(spark, d)).select("page", "id", "y", "h")


@query(with_views("rects", body=f", {_AS} SELECT page, id FROM rg a WHERE kind <> 'formula' OR NOT EXISTS (SELECT 1 FROM rg b WHERE b.page = a.page AND b.kind <> 'formula' AND ({_OVER}) / greatest(1, a.w * a.h) >= 0.75)"))
def nested_formulas(spark, d):
    return assets.without_nested_formulas(_assets(spark, d)[0]).select("page", "id")


@query(with_views("rects", body=f""", {_AS} SELECT page, id, array_to_string(list_filter([CASE WHEN x < 0 OR y <= 0 OR x + w > 300 OR y + h > 120 THEN 'page-edge-touch' END, CASE WHEN w <= 0 OR h <= 0 OR (large AND NOT anch) OR part > 0.9 OR h / 120 > 0.94 THEN 'page-coverage-excessive' END,
    CASE WHEN large AND frn THEN 'foreign-caption-overlap' END, CASE WHEN ov > 0 THEN 'caption-overlap' END], lambda v: v IS NOT NULL), ',') AS issues FROM (SELECT *, part > 0.5 OR h / 120 > 0.78 AS large FROM (
    SELECT a.page, a.id, a.x, a.y, a.w, a.h, a.w * a.h / 36000.0 AS part, CASE WHEN b.x IS NULL THEN 0 ELSE {_OVER} END AS ov, coalesce(a.kind <> 'formula' AND b.x >= 0 AND b.y >= 0 AND b.x + b.w <= 300 AND b.y + b.h <= 120 AND ({_OVER}) = 0 AND greatest(b.y - a.y - a.h, a.y - b.y - b.h, 0) <= 48
      AND least(a.x + a.w, b.x + b.w) > greatest(a.x, b.x), false) AS anch, EXISTS (SELECT 1 FROM cp f WHERE f.page = a.page AND f.caption_id IS DISTINCT FROM a.caption_id AND {_OVER.replace('b.', 'f.')} > 0) AS frn
    FROM rg a LEFT JOIN cp b ON b.page = a.page AND b.caption_id = a.caption_id))"""))
def geometry_gate(spark, d):
    return assets.geometry_gate(*_assets(spark, d), 300.0, 120.0).select("page", "id", F.array_join("issues", ",").alias("issues"))


@query(with_views("rects", body=f""", {_AS} SELECT page, id, caption_id, 3::BIGINT AS tier FROM (SELECT *, row_number() OVER (PARTITION BY page, id ORDER BY abs(gap), caption_id) AS r FROM (SELECT a.page, a.id, b.caption_id,
    CASE WHEN a.kind = 'figure' THEN b.y - a.y - a.h ELSE a.y - b.y - b.h END AS gap FROM rg a JOIN cp b ON a.page = b.page AND a.kind = b.kind AND a.kind <> 'formula' AND greatest(0, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) / greatest(1, least(a.w, b.w)) >= 0.2) WHERE gap BETWEEN -20 AND 80) WHERE r = 1"""))
def caption_links(spark, d):
    regions, captions = _assets(spark, d)
    none = F.lit(None).cast("double")
    r = regions.withColumn("label", F.lit("no label")).withColumns({f"c{c}": none for c in ("x", "y", "w", "h")})
    return assets.link_captions(r, captions).select("page", "id", "caption_id", F.col("tier").cast("long").alias("tier"))


@query(with_views("rects", body=f""", {_AS} SELECT page, id, greatest(0.0, x - s) AS x, greatest(0.0, y - t) AS y, least(300.0, x + w + s) - greatest(0.0, x - s) AS w, least(120.0, y + h + b) - greatest(0.0, y - t) AS h FROM (
    SELECT *, CASE kind WHEN 'table' THEN 4 ELSE 5 END AS s, CASE kind WHEN 'table' THEN 12 ELSE 4 END AS t, CASE kind WHEN 'table' THEN 6.0 ELSE least(16.0, greatest(6.0, h * 0.18)) END AS b FROM rg WHERE kind IN ('table', 'formula'))"""))
def padded_crops(spark, d):
    return assets.padded(_assets(spark, d)[0].where("kind IN ('table', 'formula')"), 300.0, 120.0).select("page", "id", "x", "y", "w", "h")


@query()
def region_dedup(spark, d):
    return assets.deduplicated(_assets(spark, d)[0])


@query()
def raster_bounds(spark, d):
    regions, _ = _assets(spark, d)
    return assets.exact_bounds(regions, regions.where("id % 2 = 1"))
