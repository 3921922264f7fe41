"""Queries over text, audit, layout and gates, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagelith.functions import hashing as H
from pagelith.functions import text as T
from pagelith.operators import alignment, audit, gates, layout, work
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


def _audit_parts(spark, d):
    return V.blocks(spark, d), V.target_blocks(spark, d), V.pairs(spark, d), V.terms(spark, d)


_LABEL = r"""CASE WHEN regexp_matches(trim(text), '(?i)^(?:fig(?:ure)?\.?)\s*(\d+)') THEN 'fig' || regexp_extract(trim(text), '(?i)^(?:fig(?:ure)?\.?)\s*(\d+)', 1)
    WHEN regexp_matches(trim(text), '(?i)^table\s*(\d+)') THEN 'tab' || regexp_extract(trim(text), '(?i)^table\s*(\d+)', 1)
    WHEN regexp_matches(trim(text), '^\((\d+)\)\s*$') THEN 'eq' || regexp_extract(trim(text), '^\((\d+)\)\s*$', 1) END"""
_SEC = r"CASE WHEN type = 'section' THEN nullif(regexp_extract(trim(text), '^\s*(\d+(?:\.\d+)*)\s', 1), '') END"
_R1 = f"""r1 AS (SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, 'R1' AS rule, 'error' AS severity, CAST(NULL AS VARCHAR) AS block_id,
    coalesce(a.v, '') || '|' || coalesce(b.v, '') AS detail
    FROM (SELECT doc_id, string_agg(l, ',' ORDER BY ord) AS v FROM (SELECT doc_id, ord, {_LABEL} AS l FROM blocks) GROUP BY doc_id) a
    FULL JOIN (SELECT doc_id, string_agg(l, ',' ORDER BY ord) AS v FROM (SELECT doc_id, ord, {_LABEL} AS l FROM targets) GROUP BY doc_id) b ON a.doc_id = b.doc_id
    WHERE coalesce(a.v, '') <> coalesce(b.v, ''))"""
_R2 = f"""sn AS (SELECT doc_id, ord, {_SEC} AS n FROM blocks), tn AS (SELECT doc_id, ord, {_SEC} AS n FROM targets),
    mi AS (SELECT doc_id, string_agg(n, ',' ORDER BY ord) AS v FROM sn s WHERE n IS NOT NULL AND NOT EXISTS (SELECT 1 FROM tn t WHERE t.doc_id = s.doc_id AND t.n = s.n) GROUP BY doc_id),
    ex AS (SELECT doc_id, string_agg(n, ',' ORDER BY ord) AS v FROM tn t WHERE n IS NOT NULL AND NOT EXISTS (SELECT 1 FROM sn s WHERE t.doc_id = s.doc_id AND t.n = s.n) GROUP BY doc_id),
    r2 AS (SELECT coalesce(mi.doc_id, ex.doc_id) AS doc_id, 'R2' AS rule, 'error' AS severity, CAST(NULL AS VARCHAR) AS block_id,
    coalesce(mi.v, '') || '|' || coalesce(ex.v, '') AS detail FROM mi FULL JOIN ex ON mi.doc_id = ex.doc_id)"""
_R3 = """r3 AS (SELECT doc_id, 'R3' AS rule, 'error' AS severity, CAST(NULL AS VARCHAR) AS block_id, type || ':' || sum(n)::BIGINT AS detail
    FROM (SELECT doc_id, type, 1 AS n FROM blocks UNION ALL SELECT doc_id, type, -1 FROM targets)
    WHERE type IN ('figure', 'table', 'equation', 'reference') GROUP BY doc_id, type HAVING sum(n) <> 0)"""
_R4 = """r4 AS (SELECT doc_id, 'R4' AS rule, 'error' AS severity, block_id, 'unpaired' AS detail FROM blocks b WHERE type NOT IN ('figure', 'table', 'equation')
    AND NOT EXISTS (SELECT 1 FROM pairs p WHERE p.doc_id = b.doc_id AND p.source_id = b.block_id)
    UNION ALL SELECT doc_id, 'R4', 'error', source_id, 'empty' FROM pairs WHERE trim(text) = '')"""
_DOLLAR = "length(text) - length(replace(text, '$', ''))"
_R5 = f"""r5 AS (SELECT doc_id, 'R5' AS rule, 'warn' AS severity, CAST(NULL AS VARCHAR) AS block_id, sum(s)::BIGINT || ':' || sum(t)::BIGINT AS detail FROM (
    SELECT doc_id, {_DOLLAR} AS s, 0 AS t FROM blocks UNION ALL SELECT doc_id, 0, {_DOLLAR} FROM targets UNION ALL SELECT doc_id, 0, {_DOLLAR} FROM pairs)
    GROUP BY doc_id HAVING abs(sum(s) - sum(t)) > 2)"""
_R6 = """r6 AS (SELECT doc_id, 'R6' AS rule, 'warn' AS severity, CAST(NULL AS VARCHAR) AS block_id, abbr AS detail FROM terms m WHERE length(abbr) > 0
    AND NOT EXISTS (SELECT 1 FROM targets t WHERE t.doc_id = m.doc_id AND contains(t.text, m.abbr))
    AND NOT EXISTS (SELECT 1 FROM pairs p WHERE p.doc_id = m.doc_id AND contains(p.text, m.abbr)))"""
_R7 = "r7 AS (SELECT doc_id, 'R7' AS rule, 'error' AS severity, source_id AS block_id, '' AS detail FROM pairs WHERE contains(text, '以下为译文'))"
_NUM = r"unnest(regexp_extract_all(text, '\d+(?:\.\d+)?'))::DOUBLE AS v"
_R8 = f"""nb AS (SELECT DISTINCT doc_id, {_NUM} FROM blocks), nt AS (SELECT DISTINCT doc_id, v FROM (SELECT doc_id, {_NUM} FROM targets UNION ALL SELECT doc_id, {_NUM} FROM pairs)),
    r8 AS (SELECT doc_id, 'R8' AS rule, 'warn' AS severity, CAST(NULL AS VARCHAR) AS block_id, count(*)::VARCHAR AS detail FROM (
    SELECT doc_id, v FROM nb EXCEPT SELECT doc_id, v FROM nt) GROUP BY doc_id)"""
_BASE = ("blocks", "targets", "pairs", "terms")


def _rule_sql(fragment: str, name: str) -> str:
    return with_views(*_BASE, body=f", {fragment} SELECT * FROM {name}")


def _register_rules() -> None:
    rules = {
        "audit_r1": (_R1, lambda b, t, p, m: audit.label_sequence(b, t)), "audit_r2": (_R2, lambda b, t, p, m: audit.section_sets(b, t)),
        "audit_r3": (_R3, lambda b, t, p, m: audit.type_counts(b, t)), "audit_r4": (_R4, lambda b, t, p, m: audit.pairing(b, p)),
        "audit_r5": (_R5, lambda b, t, p, m: audit.formula_marks(b, t, p)), "audit_r6": (_R6, lambda b, t, p, m: audit.abbreviations(t, p, m)),
        "audit_r7": (_R7, lambda b, t, p, m: audit.pollution(p)), "audit_r8": (_R8, lambda b, t, p, m: audit.missing_numbers(b, t, p)),
    }
    for name, (fragment, f) in rules.items():
        QUERIES[name] = lambda spark, d, f=f: f(*_audit_parts(spark, d))
        ORACLES[name] = _rule_sql(fragment, name.removeprefix("audit_"))


_register_rules()
_ALL = ", ".join([_R1, _R2, _R3, _R4, _R5, _R6, _R7, _R8]) + ", issues AS (" + " UNION ALL ".join(f"SELECT * FROM r{i}" for i in range(1, 9)) + ")"


@query(with_views(*_BASE, body=f""", {_ALL} SELECT d.doc_id, coalesce(sum((severity = 'error')::INT), 0)::BIGINT AS errors, coalesce(sum((severity = 'warn')::INT), 0)::BIGINT AS warns,
    coalesce(sum((severity = 'error')::INT), 0) = 0 AS pass FROM (SELECT DISTINCT doc_id FROM blocks) d LEFT JOIN issues i ON i.doc_id = d.doc_id GROUP BY d.doc_id"""))
def audit_summary(spark, d):
    b, t, p, m = _audit_parts(spark, d)
    return audit.summary(b, audit.rule_audit(b, t, p, m))


@query(with_views(*_BASE, body=f""", {_ALL} SELECT rule, severity, count(*)::BIGINT AS n, count(DISTINCT doc_id)::BIGINT AS docs FROM issues GROUP BY ROLLUP (rule, severity)"""))
def issue_rollup(spark, d):
    issues = audit.rule_audit(*_audit_parts(spark, d))
    return issues.rollup("rule", "severity").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("docs"))


@query(with_views(*_BASE, body=f""", {_ALL} SELECT doc_id, bool_and(severity <> 'error' OR rule = 'R3') AS approved FROM issues GROUP BY doc_id"""))
def issue_resolution(spark, d):
    issues = audit.rule_audit(*_audit_parts(spark, d))
    return audit.approved(audit.resolve(issues, issues.where("rule = 'R3'"), ["doc_id", "rule", "detail"]))


@query(with_views("lines", body="SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (trim(line) = ''))::BIGINT AS n_blank, max(length(line))::BIGINT AS longest FROM lines GROUP BY doc_id"))
def lines_scan(spark, d):
    return V.lines(spark, d).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_lines"), F.count_if(F.trim("line") == "").alias("n_blank"), F.max(F.length("line")).cast("long").alias("longest"))


# look-behind, which the second engine lacks: signs after letters or digits are set aside, and words eaten first
_PROT = r"""SELECT block_id, pos, translate(tok, chr(1) || chr(2), '-+') AS token FROM (SELECT block_id, tok, row_number() OVER (PARTITION BY block_id ORDER BY i) - 1 AS pos FROM (
    SELECT block_id, unnest(ts) AS tok, unnest(range(len(ts))) AS i FROM (SELECT block_id, regexp_extract_all(
    regexp_replace(regexp_replace(text, '([A-Za-z0-9])-', '\1' || chr(1), 'g'), '([A-Za-z0-9])\+', '\1' || chr(2), 'g'),
    '⟦[^⟧]+⟧|\[\s*(?:\d+(?:\s*[-,\x01]\s*\d+)*)\s*\]|[A-Za-z][A-Za-z0-9]*|[-+]?(?:\d+\.\d+|\d+)[%‰]?') AS ts FROM blocks)) WHERE NOT regexp_matches(tok, '^[A-Za-z]'))"""


@query(with_views("blocks", body=_PROT))
def protected_tokens(spark, d):
    return V.blocks(spark, d).select("block_id", F.posexplode(T.protected_tokens(F.col("text"))).alias("pos", "token")).withColumn("pos", F.col("pos").cast("long"))


@query(with_views("blocks", body=r"SELECT block_id, len(regexp_extract_all(text, '\d+(?:\.\d+)?'))::BIGINT AS n, list_max(list_transform(regexp_extract_all(text, '\d+(?:\.\d+)?'), lambda x: x::DOUBLE)) AS largest FROM blocks"))
def structural_numbers(spark, d):
    n = T.numbers(F.col("text"))
    return V.blocks(spark, d).select("block_id", F.size(n).cast("long").alias("n"), F.array_max(n).alias("largest"))


@query(with_views("blocks", body=f"SELECT block_id, {_SEC} AS number FROM blocks WHERE {_SEC} IS NOT NULL"))
def section_numbers(spark, d):
    b = V.blocks(spark, d).where("type = 'section'")
    return b.select("block_id", T.section_number(F.trim("text")).alias("number")).where("number IS NOT NULL")


@query(with_views("blocks", body=f"SELECT block_id, {_LABEL} AS label FROM blocks WHERE {_LABEL} IS NOT NULL"))
def caption_labels(spark, d):
    return V.blocks(spark, d).select("block_id", T.numbered_label(F.col("text")).alias("label")).where("label IS NOT NULL")


def _suffix(head: str) -> str:
    s = f"regexp_replace(t, '{head}', '')"
    return rf"""(regexp_matches(t, '{head}') AND CASE WHEN ltrim({s}) = '' THEN true WHEN regexp_matches(ltrim({s}), '(?i)^[.]\s+(?:the|this|these|those|it|we|our|a|an)\b') THEN false
      WHEN regexp_matches(ltrim({s}), '^[:：.\-–—]') THEN true ELSE length(ltrim({s})) < length({s}) AND regexp_matches(ltrim({s}), '^[A-Z一-鿿]') END)"""


_NUMERAL = r"(?:\d+(?:[.-]\d+)*|[IVXLCDM]+)"


@query(with_views("blocks", body=rf"""SELECT block_id, {_suffix(rf'(?i)^fig(?:ure)?\.?\s*{_NUMERAL}')} OR regexp_matches(t, '(?i)^fig[.]\s*{_NUMERAL}\s*[.:：\-–—]') AS figure,
    {_suffix(rf'(?i)^table\s*{_NUMERAL}')} AS is_table FROM (SELECT block_id, trim(text) AS t FROM blocks)"""))
def caption_predicates(spark, d):
    return V.blocks(spark, d).select("block_id", T.is_figure_caption(F.col("text")).alias("figure"), T.is_table_caption(F.col("text")).alias("is_table"))


@query(with_views("blocks", body=r"""SELECT block_id, CASE WHEN length(t) = 0 OR length(t) > 180 OR wds > 5 THEN false WHEN wds >= 3 AND fun >= 1 THEN false WHEN rel > 0 AND m >= 3 THEN true
    WHEN regexp_matches(t, '(?i)\(\d+[a-z]?\)\s*$') AND m >= 3 THEN true ELSE wds <= 2 AND m >= 5 END AS formula FROM (SELECT *, rel * 2 + ops AS m FROM (
    SELECT block_id, t, len(regexp_extract_all(t, '[A-Za-z]{3,}')) AS wds, len(regexp_extract_all(t, '[=≠≈≤≥<>]')) AS rel, len(regexp_extract_all(t, '[+*/^{}×÷√∑∫]')) AS ops,
    len(regexp_extract_all(t, '(?i)\b(?:the|a|an|and|or|of|to|in|for|with|that|this|is|are|was|were|as|by|from|on|at|if|when|where|whether|we|need)\b')) AS fun
    FROM (SELECT block_id, trim(regexp_replace('x = 2 * ' || text || ' (' || line_no || ')', '\s+', ' ', 'g')) AS t FROM blocks)))"""))
def display_formulas(spark, d):
    b = V.blocks(spark, d)
    made = F.concat(F.lit("x = 2 * "), F.col("text"), F.lit(" ("), F.col("line_no").cast("string"), F.lit(")"))
    return b.select("block_id", T.is_display_formula(made).alias("formula"))


@query("SELECT doc_id, ceil(length(text) / 2.5)::BIGINT AS tokens FROM documents WHERE text IS NOT NULL")
def token_estimate(spark, d):
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", T.token_estimate(F.col("text")).cast("long").alias("tokens"))


@query(r"""SELECT event_id, substr(regexp_replace(regexp_replace(regexp_replace(m, 'sk-[A-Za-z0-9_-]+', '[redacted]', 'g'),
    '(Authorization\s*[:=]\s*)(?:Bearer\s+)?[^\s,;]+', '\1[redacted]', 'gi'), '\bBearer\s+[^\s,;]+', 'Bearer [redacted]', 'gi'), 1, 300) AS message
    FROM (SELECT event_id, 'call sk-' || event_id || 'x failed; Authorization: Bearer k' || user_id || ', bearer t' || event_id || ' ' || event_type AS m FROM events)""")
def secret_redaction(spark, d):
    e = table(spark, d, "events")
    m = F.concat(F.lit("call sk-"), "event_id", F.lit("x failed; Authorization: Bearer k"), "user_id", F.lit(", bearer t"), "event_id", F.lit(" "), "event_type")
    return e.select("event_id", T.safe_error_message(m).alias("message"))


@query("""WITH c AS (SELECT conv_id, turn, regexp_extract_all(text, '[A-Za-z]+(?:[''’-][A-Za-z]+)*') AS ws FROM conversations WHERE text IS NOT NULL)
    SELECT conv_id, turn, len(ws) >= 5 AND list_has_any(list_transform(ws, lambda w: lower(w)), ['a', 'an', 'and', 'are', 'as', 'at', 'be', 'been', 'by', 'for', 'from', 'has', 'have', 'in', 'into',
    'is', 'it', 'of', 'on', 'or', 'that', 'the', 'their', 'these', 'this', 'to', 'was', 'were', 'which', 'with']) AS needed FROM c""")
def target_language_required(spark, d):
    c = table(spark, d, "conversations").where("text IS NOT NULL")
    return c.select("conv_id", "turn", T.needs_translation(F.col("role"), F.col("text")).alias("needed"))


@query(with_views("blocks", body=r"""SELECT block_id, len(ps)::BIGINT AS n, ps[1] AS head FROM (SELECT block_id, list_filter(list_transform(string_split(
    regexp_replace(regexp_replace(regexp_replace(text, '(\d)\.(\d)', '\1' || chr(1) || '\2', 'g'), '([。！？!?;；.．])\s*', '\1' || chr(2), 'g'), '\n+', chr(2), 'g'), chr(2)),
    lambda p: trim(replace(p, chr(1), '.'))), lambda p: p <> '') AS ps FROM blocks)"""))
def sentence_split(spark, d):
    b = V.blocks(spark, d).select("block_id", T.sentences(F.col("text")).alias("s"))
    return b.select("block_id", F.size("s").cast("long").alias("n"), F.get("s", F.lit(0)).alias("head"))


@query(with_views("blocks", body="""SELECT doc_id, region, page, mode, min(x) AS x, min(y) AS y, max(x + w) - min(x) AS w, max(y + h) - min(y) AS h, count(*)::BIGINT AS n_units FROM (
    SELECT *, sum(s) OVER (PARTITION BY doc_id ORDER BY ord) - 1 AS region FROM (SELECT *, CASE WHEN lag(page) OVER v = page AND lag(mode) OVER v = mode THEN 0 ELSE 1 END AS s FROM (
    SELECT *, CASE WHEN lane = 'full' THEN 'full-width' ELSE 'double' END AS mode FROM blocks) WINDOW v AS (PARTITION BY doc_id ORDER BY ord))) GROUP BY doc_id, region, page, mode"""))
def layout_regions(spark, d):
    return layout.layout_regions(V.blocks(spark, d)).drop("unit_ids").withColumn("region", F.col("region").cast("long"))


@query(with_views("blocks", body="""SELECT block_id, band::BIGINT AS band, row_number() OVER (PARTITION BY doc_id, page ORDER BY band, CASE WHEN lane = 'right' THEN 1 ELSE 0 END, y, x, line_no) - 1 AS reading FROM (
    SELECT *, sum(s) OVER (PARTITION BY doc_id, page ORDER BY y, x, line_no ROWS UNBOUNDED PRECEDING) - 1 AS band FROM (SELECT *, CASE WHEN (lag(lane) OVER v = 'full') = (lane = 'full') THEN 0 ELSE 1 END AS s
    FROM blocks WINDOW v AS (PARTITION BY doc_id, page ORDER BY y, x, line_no)))"""))
def reading_bands(spark, d):
    return layout.reading_bands(V.blocks(spark, d)).select("block_id", F.col("band").cast("long").alias("band"), F.col("reading").cast("long").alias("reading"))


@query(with_views("blocks", body="""SELECT doc_id, page, CASE WHEN bool_or(l.doc_id IS NOT NULL) = false THEN 'single' WHEN bool_or(b.lane = 'full') THEN 'mixed' ELSE 'double' END AS mode FROM blocks b
    LEFT JOIN (SELECT DISTINCT a.doc_id, a.page FROM blocks a JOIN blocks r ON a.doc_id = r.doc_id AND a.page = r.page AND a.lane = 'left' AND r.lane = 'right' AND a.y < r.y + r.h + 12 AND r.y < a.y + a.h + 12) l
    USING (doc_id, page) GROUP BY doc_id, page""".replace("l.doc_id IS NOT NULL", "l.p IS NOT NULL").replace("SELECT DISTINCT a.doc_id, a.page FROM", "SELECT DISTINCT a.doc_id, a.page, 1 AS p FROM")))
def layout_modes(spark, d):
    return layout.layout_mode(V.blocks(spark, d).withColumn("h", F.col("h") + 12))


@query(with_views("blocks", body="""SELECT doc_id, page, lane, block::BIGINT AS block, type AS role, min(x) AS x, min(y) AS y, max(x + w) - min(x) AS w, max(y + h) - min(y) AS h, count(*)::BIGINT AS n_lines,
    string_agg(text, chr(10) ORDER BY y, line_no) AS text FROM (SELECT *, sum(s) OVER (PARTITION BY doc_id, page, lane ORDER BY y, line_no ROWS UNBOUNDED PRECEDING) - 1 AS block FROM (
    SELECT g.*, CASE WHEN space > greatest(coalesce(mg, 12.0) * 1.4, mh * 1.5, 18.0) OR space IS NULL OR type <> prev THEN 1 ELSE 0 END AS s FROM (
    SELECT *, y - lag(y) OVER v - lag(h) OVER v + lag(y) OVER v - lag(y) OVER v AS space, lag(type) OVER v AS prev FROM blocks WINDOW v AS (PARTITION BY doc_id, page, lane ORDER BY y, line_no)) g
    JOIN (SELECT doc_id, page, lane, median(gap) AS mg, median(h) AS mh FROM (SELECT *, y - lag(y) OVER v AS gap FROM blocks WINDOW v AS (PARTITION BY doc_id, page, lane ORDER BY y, line_no)) GROUP BY ALL) m
    USING (doc_id, page, lane))) GROUP BY doc_id, page, lane, block, type""".replace(" - lag(h) OVER v + lag(y) OVER v - lag(y) OVER v", " - lag(h) OVER v")))
def block_grouping(spark, d):
    g = layout.group_lines(V.blocks(spark, d).withColumn("role", F.col("type")))
    return g.withColumn("block", F.col("block").cast("long"))


@query(with_views("blocks", body="""SELECT doc_id, block_id, lag(block_id) OVER v AS prev_id, lead(block_id) OVER v AS next_id,
    last_value(CASE WHEN type = 'section' THEN block_id END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY ord ROWS UNBOUNDED PRECEDING) AS section_id FROM blocks WINDOW v AS (PARTITION BY doc_id ORDER BY ord)"""))
def block_links(spark, d):
    return layout.links(V.blocks(spark, d))


@query(with_views("blocks", body="""SELECT doc_id, piece::BIGINT AS piece, count(*)::BIGINT AS n_blocks, min_by(block_id, ord) AS block_id, string_agg(text, ' ' ORDER BY ord) AS text FROM (
    SELECT *, sum(CASE WHEN type = 'paragraph' AND pt = 'paragraph' AND NOT regexp_matches(trim(ptext), '[.!?。！？:：]$') AND (page = pp + 1 OR (page = pp AND pl = 'left' AND lane = 'right')) THEN 0 ELSE 1 END)
    OVER (PARTITION BY doc_id ORDER BY ord ROWS UNBOUNDED PRECEDING) - 1 AS piece FROM (SELECT *, lag(type) OVER v AS pt, lag(text) OVER v AS ptext, lag(page) OVER v AS pp, lag(lane) OVER v AS pl
    FROM blocks WINDOW v AS (PARTITION BY doc_id ORDER BY ord))) GROUP BY doc_id, piece"""))
def paragraph_continuation(spark, d):
    return layout.continuation_groups(V.blocks(spark, d)).withColumn("piece", F.col("piece").cast("long"))


@query(with_views("lines", body=r"""SELECT doc_id, line, count(*)::BIGINT AS n, count(DISTINCT page)::BIGINT AS pages FROM (SELECT doc_id, line_no // 40 AS page,
    regexp_replace(lower(trim(line)), '\s+', ' ', 'g') AS line FROM lines) WHERE length(line) BETWEEN 6 AND 180 GROUP BY doc_id, line HAVING count(*) >= 2"""))
def repeated_furniture(spark, d):
    return layout.repeated_furniture(V.lines(spark, d).select("doc_id", F.floor(F.col("line_no") / 40).alias("page"), F.col("line").alias("text")))


@query(with_views("blocks", body="""SELECT b.doc_id, b.block_id, k.pages FROM (SELECT *, regexp_replace(lower(trim(text)), '[0-9]+', '#', 'g') AS key FROM blocks WHERE y < 90 OR y + h > 700) b JOIN (
    SELECT doc_id, key, count(DISTINCT page)::BIGINT AS pages FROM (SELECT *, regexp_replace(lower(trim(text)), '[0-9]+', '#', 'g') AS key FROM blocks WHERE y < 90 OR y + h > 700) GROUP BY doc_id, key HAVING count(DISTINCT page) >= 2) k
    ON b.doc_id = k.doc_id AND b.key = k.key"""))
def page_furniture(spark, d):
    return layout.page_furniture(V.blocks(spark, d), 90, 700)


@query(with_views("blocks", body="SELECT doc_id, block_id, coalesce(sum(h + 6) OVER (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0)::DOUBLE AS top FROM blocks"))
def flow_layout(spark, d):
    return layout.flow_layout(V.blocks(spark, d), 6.0).select("doc_id", "block_id", "top")


@query(with_views("blocks", "targets", body=f""", a AS (SELECT doc_id, block_id, ord, CASE WHEN type = 'section' THEN 'sec' || ({_SEC}) ELSE CASE WHEN ({_LABEL}) LIKE 'eq%' THEN NULL ELSE {_LABEL} END END AS label FROM blocks),
    b AS (SELECT doc_id, block_id, ord, CASE WHEN type = 'section' THEN 'sec' || ({_SEC}) ELSE CASE WHEN ({_LABEL}) LIKE 'eq%' THEN NULL ELSE {_LABEL} END END AS label FROM targets),
    x AS (SELECT *, row_number() OVER (PARTITION BY doc_id, label ORDER BY ord) AS k FROM a WHERE label IS NOT NULL), y AS (SELECT *, row_number() OVER (PARTITION BY doc_id, label ORDER BY ord) AS k FROM b WHERE label IS NOT NULL)
    SELECT coalesce(x.doc_id, y.doc_id) AS doc_id, coalesce(x.label, y.label) AS label, x.block_id AS source_id, y.block_id AS target_id FROM x FULL JOIN y ON x.doc_id = y.doc_id AND x.label = y.label AND x.k = y.k"""))
def anchor_occurrence_join(spark, d):
    a, b = alignment.anchors(V.blocks(spark, d)), alignment.anchors(V.target_blocks(spark, d))
    return alignment.match_anchors(a, b).select("doc_id", "label", "source_id", "target_id")


@query(with_views("blocks", body="""SELECT doc_id, block_id, CASE WHEN type = 'section' THEN NULL ELSE s END AS segment FROM (
    SELECT *, (sum((type = 'section')::INT) OVER (PARTITION BY doc_id ORDER BY ord ROWS UNBOUNDED PRECEDING))::BIGINT AS s FROM blocks)"""))
def segment_assignment(spark, d):
    b = V.blocks(spark, d)
    return alignment.segments(b, b.where("type = 'section'").select("doc_id", F.col("block_id").alias("source_id")), "source").select("doc_id", "block_id", F.col("segment").cast("long").alias("segment"))


@query(with_views("blocks", "pairs", body=""", u AS (SELECT doc_id, source_id AS unit_id, CASE WHEN ord % 3 = 0 THEN 0.0 ELSE 0.8 + (ord % 5) / 20.0 END AS sc, ord % 9 <> 1 AS sr, text <> '' AS tr, CASE WHEN ord % 4 = 0 THEN 0.85 ELSE 1.0 END AS tc FROM pairs),
    c AS (SELECT *, CASE WHEN sr AND tr THEN least(CASE WHEN sc = 0 THEN 1.0 ELSE sc END, tc) ELSE 0.0 END AS conf FROM u), s AS (SELECT *, CASE WHEN conf >= 0.9 THEN 'aligned' WHEN conf > 0 THEN 'low' ELSE 'unmatched' END AS st FROM c)
    SELECT doc_id, count(*)::BIGINT AS total, (count(*) FILTER (st = 'aligned'))::BIGINT AS aligned, (count(*) FILTER (st = 'low'))::BIGINT AS low_confidence, (count(*) FILTER (st = 'unmatched'))::BIGINT AS unmatched,
    (count(*) FILTER (st <> 'unmatched')) / count(*) AS coverage FROM s GROUP BY doc_id"""))
def manifest_coverage(spark, d):
    return alignment.coverage(_units(spark, d))


def _units(spark, d):
    o = F.col("ord")
    u = V.pairs(spark, d).select(
        "doc_id", F.col("source_id").alias("unit_id"), F.when(o % 3 == 0, 0.0).otherwise(F.lit(0.8) + (o % 5) / 20.0).alias("source_conf"), (o % 9 != 1).alias("source_ready"),
        (F.col("text") != "").alias("target_ready"), F.when(o % 4 == 0, 0.85).otherwise(1.0).alias("target_conf"), F.when(o % 11 == 2, "paragraph-fallback").otherwise("1:1").alias("relation"),
    )
    return alignment.target_geometry(u)


@query(with_views("pairs", body=""", u AS (SELECT doc_id, source_id AS unit_id, CASE WHEN ord % 3 = 0 THEN 0.0 ELSE 0.8 + (ord % 5) / 20.0 END AS sc, ord % 9 <> 1 AS sr, text <> '' AS tr, CASE WHEN ord % 4 = 0 THEN 0.85 ELSE 1.0 END AS tc, ord FROM pairs),
    s AS (SELECT *, CASE WHEN sr AND tr THEN least(CASE WHEN sc = 0 THEN 1.0 ELSE sc END, tc) ELSE 0.0 END AS conf FROM u)
    SELECT doc_id, code, unit_id AS entity, severity FROM (SELECT doc_id, unit_id, 'source-geometry-missing' AS code, 'error' AS severity FROM s WHERE NOT sr UNION ALL SELECT doc_id, unit_id, 'target-geometry-missing', 'error' FROM s WHERE NOT tr
    UNION ALL SELECT doc_id, unit_id, 'unit-unmatched', 'error' FROM s WHERE sr AND tr AND conf <= 0 UNION ALL SELECT doc_id, unit_id, 'unit-low-confidence', 'warn' FROM s WHERE sr AND tr AND conf > 0 AND conf < 0.9
    UNION ALL SELECT doc_id, unit_id, 'paragraph-fallback', 'warn' FROM s WHERE ord % 11 = 2)"""))
def alignment_gate(spark, d):
    return gates.alignment_gate(_units(spark, d))


@query(with_views("blocks", "targets", body="""SELECT coalesce(r.doc_id, e.doc_id) AS doc_id, coalesce(r.m, e.m) AS marker, CASE WHEN e.m IS NULL THEN 'missing' ELSE 'unexpected' END AS code
    FROM (SELECT doc_id, block_id || '-t-1' AS m FROM blocks) r FULL JOIN (SELECT doc_id, substr(block_id, 2) || '-t-' || (1 + (ord % 8 = 7)::INT) AS m FROM targets) e ON r.doc_id = e.doc_id AND r.m = e.m WHERE r.m IS NULL OR e.m IS NULL"""))
def marker_symmetric_diff(spark, d):
    r = V.blocks(spark, d).select("doc_id", F.concat("block_id", F.lit("-t-1")).alias("marker"))
    e = V.target_blocks(spark, d).select("doc_id", F.concat(F.substring("block_id", 2, 100), F.lit("-t-"), F.when(F.col("ord") % 8 == 7, "2").otherwise("1")).alias("marker"))
    return gates.marker_difference(r, e)


@query(with_views("blocks", "targets", body=r""", f AS (SELECT doc_id, regexp_replace(string_agg(text, chr(10) ORDER BY ord), '[\s\p{P}\p{S}]+', '', 'g') AS a FROM targets GROUP BY doc_id),
    e AS (SELECT doc_id, regexp_replace(text, '[\s\p{P}\p{S}]+', '', 'g') AS t FROM blocks) SELECT e.doc_id, count(*)::BIGINT AS expected, (count(*) FILTER (contains(coalesce(a, ''), t)))::BIGINT AS hits,
    (count(*) FILTER (contains(coalesce(a, ''), t))) / count(*) AS coverage, (count(*) FILTER (contains(coalesce(a, ''), t))) / count(*) >= 0.85 AS pass FROM e LEFT JOIN f USING (doc_id) WHERE length(t) >= 4 GROUP BY e.doc_id"""))
def content_coverage(spark, d):
    return gates.content_coverage(V.blocks(spark, d), V.target_blocks(spark, d))


@query(with_views("blocks", body=""", un AS (SELECT doc_id, CASE WHEN ord % 29 = 7 THEN doc_id || '-0' ELSE block_id END AS unit_id, CASE WHEN ord % 31 = 4 THEN 'none' ELSE lane END AS region_id, type AS kind, CASE WHEN type = 'figure' THEN 'a' || block_id END AS asset_id FROM blocks),
    ru AS (SELECT doc_id, lane AS region_id, ord AS pos, CASE WHEN ord % 23 = 3 THEN 'ghost' || ord ELSE block_id END AS unit_id FROM blocks),
    ass AS (SELECT doc_id, 'a' || block_id AS asset_id, CASE WHEN ord % 2 = 0 THEN 'figure' ELSE 'table' END AS kind, CASE WHEN ord % 3 = 0 THEN doc_id || '-5' END AS caption_id FROM blocks WHERE type = 'figure'),
    ow AS (SELECT doc_id, unit_id, count(DISTINCT r.region_id) AS n, min(r.region_id) AS owner FROM ru r SEMI JOIN un USING (doc_id, unit_id) GROUP BY doc_id, unit_id)
    SELECT code, count(*)::BIGINT AS n FROM (SELECT doc_id, 'duplicate-unit-id' AS code, unit_id AS e FROM un GROUP BY doc_id, unit_id HAVING count(*) > 1 UNION ALL SELECT doc_id, 'unknown-unit-reference', unit_id FROM ru ANTI JOIN un USING (doc_id, unit_id)
    UNION ALL SELECT doc_id, 'missing-region-owner', unit_id FROM un WHERE region_id = 'none' UNION ALL SELECT un.doc_id, 'unit-without-region', un.unit_id FROM un ANTI JOIN ow USING (doc_id, unit_id)
    UNION ALL SELECT un.doc_id, 'multiple-region-owners', un.unit_id FROM un JOIN ow USING (doc_id, unit_id) WHERE n > 1 UNION ALL SELECT un.doc_id, 'region-owner-mismatch', un.unit_id FROM un JOIN ow USING (doc_id, unit_id) WHERE n = 1 AND owner <> region_id
    UNION ALL SELECT doc_id, 'asset-kind-mismatch', asset_id FROM ass WHERE kind <> 'figure' UNION ALL SELECT doc_id, 'missing-caption-unit', caption_id FROM ass WHERE caption_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM un WHERE un.doc_id = ass.doc_id AND un.unit_id = ass.caption_id)
    UNION ALL SELECT ass.doc_id, 'invalid-caption-unit-kind', caption_id FROM ass JOIN (SELECT DISTINCT doc_id, unit_id, kind AS k FROM un) u ON u.doc_id = ass.doc_id AND u.unit_id = ass.caption_id WHERE k NOT IN ('caption', 'table-title')
    UNION ALL SELECT doc_id, 'multiple-caption-owners', caption_id FROM ass WHERE caption_id IS NOT NULL GROUP BY doc_id, caption_id HAVING count(*) > 1) GROUP BY code"""))
def structure_invariants(spark, d):
    b, o = V.blocks(spark, d), F.col("ord")
    units = b.select(
        "doc_id", F.when(o % 29 == 7, F.concat(F.col("doc_id").cast("string"), F.lit("-0"))).otherwise(F.col("block_id")).alias("unit_id"), F.when(o % 31 == 4, "none").otherwise(F.col("lane")).alias("region_id"),
        F.col("type").alias("kind"), F.when(F.col("type") == "figure", F.concat(F.lit("a"), "block_id")).alias("asset_id"),
    )
    regions = b.select("doc_id", F.explode(F.array(F.lit("full"), F.lit("left"), F.lit("right"))).alias("region_id")).distinct()
    refs = b.select("doc_id", F.col("lane").alias("region_id"), o.alias("pos"), F.when(o % 23 == 3, F.concat(F.lit("ghost"), o.cast("string"))).otherwise(F.col("block_id")).alias("unit_id"))
    assets = b.where("type = 'figure'").select(
        "doc_id", F.concat(F.lit("a"), "block_id").alias("asset_id"), F.when(o % 2 == 0, "figure").otherwise("table").alias("kind"), F.when(o % 3 == 0, F.concat(F.col("doc_id").cast("string"), F.lit("-5"))).alias("caption_id"),
    )
    return gates.structure(units, regions, refs, assets).groupBy("code").agg(F.count(F.lit(1)).alias("n"))


@query(with_views("blocks", body="""SELECT doc_id, ord, block_id, bool_and(ok) OVER (PARTITION BY doc_id ORDER BY ord ROWS UNBOUNDED PRECEDING) AS accepted FROM (
    SELECT doc_id, ord, block_id, ord % 19 <> 11 AND ord % 37 <> 20 AS ok FROM blocks)"""))
def safe_prefix(spark, d):
    b = V.blocks(spark, d).select("doc_id", "ord", "block_id")
    return gates.safe_prefix(b, b.where("ord % 37 <> 20").withColumn("valid", F.col("ord") % 19 != 11))


@query(with_views("blocks", "targets", body=", s AS (" + _PROT + "), t AS (" + _PROT.replace("FROM blocks", "FROM (SELECT substr(block_id, 2) AS block_id, text FROM targets)") + """)
    SELECT a.block_id, a.token, a.n AS required, coalesce(b.n, 0)::BIGINT AS received FROM (SELECT block_id, token, count(*)::BIGINT AS n FROM s GROUP BY ALL) a
    LEFT JOIN (SELECT block_id, token, count(*)::BIGINT AS n FROM t GROUP BY ALL) b USING (block_id, token) WHERE coalesce(b.n, 0) < a.n"""))
def token_losses(spark, d):
    t = V.target_blocks(spark, d).select("doc_id", F.substring("block_id", 2, 100).alias("block_id"), F.col("text").alias("target"))
    both = V.blocks(spark, d).select("doc_id", "block_id", F.col("text").alias("source")).join(t, ["doc_id", "block_id"], "left")
    return gates.token_losses(both).drop("doc_id")


@query(with_views("blocks", body="""SELECT block_id, 'translation-cache-v2:h' || doc_id || ':p1:model%2Fa:disabled:g%20x:' || block_id || ':' || type || '%3A%20' || lane AS key FROM blocks"""))
def cache_key(spark, d):
    k = H.translation_key(F.concat(F.lit("h"), "doc_id"), F.lit("p1"), F.lit("model/a"), F.lit("disabled"), F.lit("g x"), F.col("block_id"), F.concat("type", F.lit(": "), "lane"))
    return V.blocks(spark, d).select("block_id", k.alias("key"))


@query(with_views("blocks", body="""SELECT b.doc_id, (count(*) FILTER (ord % 7 <> 6))::BIGINT AS hits, (count(*) FILTER (ord % 7 = 6))::BIGINT AS misses FROM blocks b GROUP BY b.doc_id"""))
def cache_hit_miss(spark, d):
    b = V.blocks(spark, d).select("doc_id", "ord", F.sha2(F.concat_ws(":", "doc_id", "block_id"), 256).alias("key"))
    split = work.cache_split(b, b.where("ord % 7 <> 6"))
    return split.groupBy("doc_id").agg(F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses"))


@query(with_views("blocks", body="SELECT doc_id, block_id FROM blocks WHERE ord % 4 = 3 OR ord % 5 = 2"))
def resume_pending(spark, d):
    b = V.blocks(spark, d).select("doc_id", "block_id", "ord")
    done = b.where("ord % 4 <> 3").withColumn("status", F.when(F.col("ord") % 5 == 2, "failed").otherwise("done"))
    return work.pending(b, done, ["doc_id", "block_id"]).select("doc_id", "block_id")


@query("WITH RECURSIVE " + with_views("blocks", body="""SELECT doc_id, batch::BIGINT AS batch, count(*)::BIGINT AS blocks, sum(tokens)::BIGINT AS tokens, bool_or(over) AS oversized FROM p GROUP BY doc_id, batch""").removeprefix("WITH ").replace(
    " SELECT doc_id, batch::BIGINT", """, r AS (SELECT doc_id, ord, ceil(length(text) / 2.5)::BIGINT AS tokens FROM blocks),
    p AS (SELECT doc_id, ord, tokens, 0 AS batch, tokens > 400 AS over, CASE WHEN tokens > 400 THEN 0 ELSE 1 END AS n, CASE WHEN tokens > 400 THEN 0 ELSE tokens END AS used, CASE WHEN tokens > 400 THEN 1 ELSE 0 END AS cur FROM r WHERE ord = 0
    UNION ALL SELECT doc_id, ord, tokens, b, tokens > 400, CASE WHEN tokens > 400 THEN 0 ELSE CASE WHEN f THEN 0 ELSE n END + 1 END, CASE WHEN tokens > 400 THEN 0 ELSE CASE WHEN f THEN 0 ELSE used END + tokens END, CASE WHEN tokens > 400 THEN b + 1 ELSE b END
    FROM (SELECT r.doc_id, r.ord, r.tokens, p.n, p.used, p.n > 0 AND (r.tokens > 400 OR p.n >= 8 OR p.used + r.tokens > 400) AS f, p.cur + (p.n > 0 AND (r.tokens > 400 OR p.n >= 8 OR p.used + r.tokens > 400))::INT AS b FROM p JOIN r ON r.doc_id = p.doc_id AND r.ord = p.ord + 1))
    SELECT doc_id, batch::BIGINT""", 1))
def translation_batches(spark, d):
    r = V.blocks(spark, d).select("doc_id", "block_id", "ord", T.token_estimate(F.col("text")).cast("long").alias("tokens"))
    placed = work.batches(r, max_tokens=400)
    return work.batch_totals(placed, r).withColumn("batch", F.col("batch").cast("long"))
