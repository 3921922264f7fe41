"""Derived views over the tables, as DataFrames and as SQL fragments of the same meaning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagelith.sources import table


def lines(spark: SparkSession, d: str) -> DataFrame:
    """One row per line of a document."""
    docs = table(spark, d, "documents").where("text IS NOT NULL")
    return docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).withColumn("line_no", F.col("line_no").cast("long"))


def block_text(n: Column, line: Column) -> Column:
    """Every eleventh line becomes a figure, table, heading, reference or equation head."""
    k = F.floor(n / 11) + 1
    c = lambda *parts: F.concat(*(p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts))
    return (
        F.when(n % 11 == 0, c("Figure ", k, ". ", line))
        .when(n % 11 == 3, c(k, ".", n % 3 + 1, " ", F.regexp_replace(F.substring(line, 1, 24), "[^A-Za-z ]", "")))
        .when(n % 11 == 5, c("Table ", k, ": ", line))
        .when(n % 11 == 7, c("[", n % 9 + 1, "] ", line))
        .when(n % 11 == 9, c("(", n, ")"))
        .otherwise(line)
    )


def block_type(t: Column) -> Column:
    """First rule that fits."""
    heading = t.rlike(r"^\d+(\.\d+)* ") & (F.length(t) < 80) & ~t.rlike("[.!?]$") & ~t.rlike("[,;]")
    return (
        F.when(heading, "section").when(t.rlike(r"(?i)^fig(ure)?\.? *\d+"), "figure").when(t.rlike(r"(?i)^table *\d+"), "table")
        .when(t.rlike(r"^\(\d+\) *$"), "equation").when(t.rlike(r"^\[\d+\]"), "reference").otherwise("paragraph")
    )


def blocks(spark: SparkSession, d: str) -> DataFrame:
    """Non-blank lines as positioned, typed blocks."""
    n = F.col("line_no")
    lane = F.when(n % 5 == 0, "full").when(n % 5 <= 2, "left").otherwise("right")
    w = Window.partitionBy("doc_id").orderBy("line_no")
    b = lines(spark, d).where(F.trim("line") != "").select(
        "doc_id", "line_no", F.concat_ws("-", "doc_id", "line_no").alias("block_id"), F.floor(n / 40).alias("page"),
        (F.row_number().over(w) - 1).cast("long").alias("ord"), lane.alias("lane"), F.when(n % 5 >= 3, 330.0).otherwise(50.0).alias("x"),
        (40 + 18 * (n % 40)).cast("double").alias("y"), F.least(F.when(n % 5 == 0, 512).otherwise(232), 6 * F.length("line")).cast("double").alias("w"),
        F.lit(12.0).alias("h"), block_text(n, F.col("line")).alias("text"),
    )
    return b.withColumn("type", block_type(F.col("text")))


def target_blocks(spark: SparkSession, d: str) -> DataFrame:
    """A deterministic edit of blocks: every 7th dropped, e to E, digits gone from every 5th."""
    t = F.replace("text", F.lit("e"), F.lit("E"))
    b = blocks(spark, d).where("ord % 7 <> 6").withColumn("text", F.when(F.col("ord") % 5 == 4, F.regexp_replace(t, "[0-9]", "")).otherwise(t))
    return b.withColumn("type", block_type(F.col("text"))).withColumn("block_id", F.concat(F.lit("t"), F.col("block_id")))


def pairs(spark: SparkSession, d: str) -> DataFrame:
    """Source and target block with the target's text; some empty, some with a translator's remark."""
    t = target_blocks(spark, d)
    text = F.when(F.col("ord") % 13 == 5, "").when(F.col("ord") % 17 == 3, F.concat(F.lit("以下为译文 "), F.col("text"))).otherwise(F.col("text"))
    return t.select("doc_id", "ord", F.substring("block_id", 2, 100).alias("source_id"), F.col("block_id").alias("target_id"), text.alias("text"))


def terms(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.lit("first").alias("term"), F.substring("text", 1, 4).alias("abbr"))


def turn_pairs(spark: SparkSession, d: str) -> DataFrame:
    """A user's turn beside the assistant's next."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = table(spark, d, "conversations").withColumn("next_role", F.lead("role").over(w)).withColumn("target", F.lead("text").over(w))
    return c.where("role = 'user' AND next_role = 'assistant'").select("conv_id", "turn", F.col("text").alias("source"), "target")


def ai_log(spark: SparkSession, d: str) -> DataFrame:
    """Events as a task log."""
    e = table(spark, d, "events")
    return e.select(
        F.col("user_id").alias("project"), F.col("event_id").alias("seq"), F.col("ts").alias("at"), F.col("event_type").alias("type"), F.col("value").alias("elapsed"),
        F.get_json_object("props", "$.k").cast("long").alias("tokens"),
    )


def rects(spark: SparkSession, d: str) -> DataFrame:
    """Line items as rectangles on a page per order."""
    r = lambda c: F.round(c).cast("int")
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_discount", "l_tax")
    return table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("page"), F.row_number().over(w).cast("long").alias("id"), r(10 * F.col("l_quantity")).alias("x"), r(1000 * F.col("l_discount")).alias("y"),
        r(40 + 1000 * F.col("l_tax")).alias("w"), F.lit(30).alias("h"),
    )


def artifacts(spark: SparkSession, d: str) -> DataFrame:
    """Orders as artifacts of a customer's project."""
    o = table(spark, d, "orders")
    kinds = ["english-pdf", "vision-layout", "accepted-page-plan", "formula-ocr", "chinese-pdf", "quality-report", "raw-vision-response"]
    kind = F.get(F.array(*map(F.lit, kinds)), (F.col("o_orderkey") % 7).cast("int"))
    return o.select(F.col("o_orderkey").alias("key"), F.col("o_custkey").alias("project_id"), kind.alias("kind"), F.array((F.col("o_orderkey") % 4).cast("int")).alias("pages"), F.col("o_orderdate").alias("at"))


SQL = {
    "lines": """lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
        unnest(range(len(string_split(text, chr(10)))))::BIGINT AS line_no FROM documents WHERE text IS NOT NULL)""",
    "raw_blocks": r"""raw_blocks AS (SELECT doc_id, line_no, doc_id || '-' || line_no AS block_id, line_no // 40 AS page,
        row_number() OVER (PARTITION BY doc_id ORDER BY line_no) - 1 AS ord,
        CASE WHEN line_no % 5 = 0 THEN 'full' WHEN line_no % 5 <= 2 THEN 'left' ELSE 'right' END AS lane,
        CASE WHEN line_no % 5 >= 3 THEN 330.0 ELSE 50.0 END::DOUBLE AS x, (40 + 18 * (line_no % 40))::DOUBLE AS y,
        least(CASE WHEN line_no % 5 = 0 THEN 512 ELSE 232 END, 6 * length(line))::DOUBLE AS w, 12.0::DOUBLE AS h,
        CASE line_no % 11 WHEN 0 THEN 'Figure ' || (line_no // 11 + 1) || '. ' || line
          WHEN 3 THEN (line_no // 11 + 1) || '.' || (line_no % 3 + 1) || ' ' || regexp_replace(substr(line, 1, 24), '[^A-Za-z ]', '', 'g')
          WHEN 5 THEN 'Table ' || (line_no // 11 + 1) || ': ' || line WHEN 7 THEN '[' || (line_no % 9 + 1) || '] ' || line
          WHEN 9 THEN '(' || line_no || ')' ELSE line END AS text
        FROM lines WHERE trim(line) <> '')""",
}
_TYPE = r"""CASE WHEN regexp_matches(text, '^\d+(\.\d+)* ') AND length(text) < 80 AND NOT regexp_matches(text, '[.!?]$') AND NOT regexp_matches(text, '[,;]') THEN 'section'
    WHEN regexp_matches(text, '(?i)^fig(ure)?\.? *\d+') THEN 'figure' WHEN regexp_matches(text, '(?i)^table *\d+') THEN 'table'
    WHEN regexp_matches(text, '^\(\d+\) *$') THEN 'equation' WHEN regexp_matches(text, '^\[\d+\]') THEN 'reference' ELSE 'paragraph' END AS type"""
SQL["blocks"] = f"blocks AS (SELECT *, {_TYPE} FROM raw_blocks)"
SQL["targets"] = f"""targets AS (SELECT * EXCLUDE (text, block_id), 't' || block_id AS block_id, text, {_TYPE} FROM (
    SELECT * EXCLUDE (text), CASE WHEN ord % 5 = 4 THEN regexp_replace(replace(text, 'e', 'E'), '[0-9]', '', 'g') ELSE replace(text, 'e', 'E') END AS text
    FROM raw_blocks WHERE ord % 7 <> 6))"""
SQL["pairs"] = """pairs AS (SELECT doc_id, ord, substr(block_id, 2) AS source_id, block_id AS target_id,
    CASE WHEN ord % 13 = 5 THEN '' WHEN ord % 17 = 3 THEN '以下为译文 ' || text ELSE text END AS text FROM targets)"""
SQL["terms"] = "terms AS (SELECT doc_id, 'first' AS term, substr(text, 1, 4) AS abbr FROM documents WHERE text IS NOT NULL)"
SQL["turn_pairs"] = """turn_pairs AS (SELECT conv_id, turn, text AS source, target FROM (SELECT *, lead(role) OVER w AS next_role, lead(text) OVER w AS target
    FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user' AND next_role = 'assistant')"""
SQL["ai_log"] = """ai_log AS (SELECT user_id AS project, event_id AS seq, ts AS "at", event_type AS type, value AS elapsed, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS tokens FROM events)"""
SQL["rects"] = """rects AS (SELECT l_orderkey AS page, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_discount, l_tax) AS id, round(10 * l_quantity)::INT AS x, round(1000 * l_discount)::INT AS y,
    round(40 + 1000 * l_tax)::INT AS w, 30 AS h FROM lineitem)"""
SQL["artifacts"] = """artifacts AS (SELECT o_orderkey AS key, o_custkey AS project_id, ['english-pdf', 'vision-layout', 'accepted-page-plan', 'formula-ocr', 'chinese-pdf',
    'quality-report', 'raw-vision-response'][o_orderkey % 7 + 1] AS kind, [(o_orderkey % 4)::INT] AS pages, o_orderdate AS "at" FROM orders)"""
NEEDS = {
    "raw_blocks": ["lines"], "blocks": ["lines", "raw_blocks"], "targets": ["lines", "raw_blocks"], "pairs": ["lines", "raw_blocks", "targets"],
}


def with_views(*names: str, body: str) -> str:
    """body after the WITH clauses of the views that it names."""
    order: list[str] = []
    for n in names:
        for x in [*NEEDS.get(n, []), n]:
            if x not in order:
                order.append(x)
    return f"WITH {', '.join(SQL[x] for x in order)} {body}"
