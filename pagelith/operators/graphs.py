"""Edges, closures and chains. Loops write each round as a table, so a lost executor costs one round."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _write(df: DataFrame) -> DataFrame:
    spark = df.sparkSession
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = tempfile.mkdtemp(prefix="pagelith-")
        spark.sparkContext.setCheckpointDir(at)
    path = f"{at}/graph-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(members: DataFrame, seeds: DataFrame) -> DataFrame:
    """Fixpoint: members(doc_id, grp, node); a seeded node (doc_id, node) reaches all members of its groups, and so on."""
    reached = _write(seeds.select("doc_id", "node").distinct())
    n = reached.count()
    while True:
        groups = members.join(reached, ["doc_id", "node"], "left_semi").select("doc_id", "grp").distinct()
        more = members.join(groups, ["doc_id", "grp"], "left_semi").select("doc_id", "node")
        reached = _write(reached.unionByName(more).distinct())
        now = reached.count()
        if now == n:
            return reached
        n = now


def cyclic(edges: DataFrame) -> DataFrame:
    """Documents whose edges(doc_id, a, b) hold a cycle: what is left once nodes without predecessors are peeled off."""
    left = _write(edges.select("doc_id", "a", "b").distinct())
    n = left.count()
    while n:
        heads = left.select("doc_id", F.col("b").alias("a")).distinct()
        left = _write(left.join(heads, ["doc_id", "a"], "left_semi"))
        now = left.count()
        if now == n:
            break
        n = now
    return left.select("doc_id").distinct()


def chains(links: DataFrame) -> DataFrame:
    """links(doc_id, a, b), each node in at most one link either way: chain head, node and position, by pointer doubling."""
    nodes = links.select("doc_id", F.col("a").alias("node")).unionByName(links.select("doc_id", F.col("b").alias("node"))).distinct()
    up = links.select("doc_id", F.col("b").alias("node"), F.col("a").alias("head"))
    state = nodes.join(up, ["doc_id", "node"], "left").select("doc_id", "node", F.coalesce("head", "node").alias("head"), F.when(F.col("head").isNull(), 0).otherwise(1).alias("pos"))
    state = _write(state)
    while True:
        step = state.select("doc_id", F.col("node").alias("head"), F.col("head").alias("h2"), F.col("pos").alias("p2"))
        new = _write(state.join(step, ["doc_id", "head"]).select("doc_id", "node", F.col("h2").alias("head"), (F.col("pos") + F.col("p2")).alias("pos")))
        if new.exceptAll(state).isEmpty():
            return new
        state = new


def page_links(tails: DataFrame, heads: DataFrame, most: float = 100.0) -> DataFrame:
    """The nearest head on the next page of the same type for each tail, one to one by mutual choice.

    tails and heads: doc_id, page, type, id, x (left edge).
    """
    t = tails.select("doc_id", "type", (F.col("page") + 1).alias("page"), F.col("id").alias("tail"), F.col("x").alias("tx"))
    both = t.join(heads.select("doc_id", "type", "page", F.col("id").alias("head"), F.col("x").alias("hx")), ["doc_id", "type", "page"])
    both = both.withColumn("d", F.abs(F.col("tx") - F.col("hx"))).where(F.col("d") <= most)
    best = lambda key, other: F.row_number().over(Window.partitionBy("doc_id", "type", "page", key).orderBy("d", other))
    return both.withColumn("rt", best("tail", "head")).withColumn("rh", best("head", "tail")).where("rt = 1 AND rh = 1").select("doc_id", "type", "page", "tail", "head", "d")


#: Regions that may go on over a page, and where a page's foot and head begin in 0..1000 (fixed values).
CROSSING, FOOT, HEAD, CLOSE = ("figure", "table", "code"), 900, 120, 100


def crossing_candidates(regions: DataFrame) -> DataFrame:
    """Pairs of a region at a page's foot and one of its type at the next page's head, with the evidence for them.

    regions(doc_id, page, id, type, x, y, w, h, column, label, hint). A pair is a
    candidate with strong evidence (a continued or equal label), or with three weak
    ones, two if the hints agree; contradicting hints or numbers rule it out.
    """
    p = r"(?i)(?<![A-Za-z0-9_])(fig(?:ure)?|table|algorithm|code)\s*\.?\s*(\d+(?:[.-]\d+)*|[IVXLCDM]+)(?![A-Za-z0-9_])"
    kind = F.lower(F.regexp_extract("label", p, 1))
    number = F.when(kind != "", F.concat(F.when(kind.startswith("fig"), "figure").otherwise(kind), F.lit(":"), F.lower(F.regexp_extract("label", p, 2))))
    label = F.nullif(F.lower(F.trim(F.regexp_replace("label", r"\s+", " "))), F.lit(""))
    r = regions.where(F.col("type").isin(*CROSSING)).select("doc_id", "page", "type", "id", "x", "w", "column", label.alias("label"), number.alias("number"), F.coalesce("hint", F.lit("")).alias("hint"), (F.col("y") + F.col("h") >= FOOT).alias("foot"), (F.col("y") <= HEAD).alias("head"))
    t = r.where("foot").select("doc_id", "type", (F.col("page") + 1).alias("page"), *(F.col(c).alias(f"t_{c}") for c in ("id", "x", "w", "column", "label", "number", "hint")))
    h = r.where("head").select("doc_id", "type", "page", *(F.col(c).alias(f"h_{c}") for c in ("id", "x", "w", "column", "label", "number", "hint")))
    against = (F.col("t_hint").isin("none", "ends")) | (F.col("h_hint").isin("none", "starts")) | F.coalesce(F.col("t_number") != F.col("h_number"), F.lit(False))
    both = t.join(h, ["doc_id", "type", "page"]).where(~against)
    same = F.coalesce(F.col("t_label") == F.col("h_label"), F.lit(False))
    on = F.concat_ws(" ", F.coalesce("t_label", F.lit("")), F.coalesce("h_label", F.lit(""))).rlike(r"(?i)(?<![A-Za-z0-9_])cont(?:inued|\.)?(?![A-Za-z0-9_])")
    d = F.abs(F.col("h_x") - F.col("t_x")) + F.abs(F.col("h_w") - F.col("t_w"))
    weak = 1 + (F.col("t_column") == F.col("h_column")).cast("int") + (d <= CLOSE).cast("int") + ((F.col("type") == "table") & same).cast("int")
    agree = F.col("t_hint").isin("starts", "continues") & F.col("h_hint").isin("continues", "ends")
    strong = F.when(on, "continued-label").when(same, "same-numbered-caption")
    out = both.select("doc_id", "type", "page", F.col("t_id").alias("tail"), F.col("h_id").alias("head"), d.alias("d"), weak.alias("weak"), agree.alias("agree"), strong.alias("strong"))
    return out.where(F.col("strong").isNotNull() | (F.col("weak") >= F.when(F.col("agree"), 2).otherwise(3)))


LINKS = "doc_id long, page long, tail string, head string, strong string"


def crossing_links(candidates: DataFrame) -> DataFrame:
    """One-to-one links: the best candidates first, each tail and head once. page is the head's."""
    from pagelith.operators.grouped import grouped

    c = candidates.select(
        "doc_id", F.col("page").cast("long").alias("page"), F.col("tail").cast("string").alias("tail"), F.col("head").cast("string").alias("head"), "strong",
        F.col("strong").isNull().cast("int").alias("o1"), (~F.col("agree")).cast("int").alias("o2"), (-F.col("weak")).alias("o3"), F.col("d").alias("o4"),
    )

    def run(rows: list[dict]) -> list[tuple]:
        tails, heads, out = set(), set(), []
        for r in rows:
            t, h = (r["page"] - 1, r["tail"]), (r["page"], r["head"])
            if t not in tails and h not in heads:
                tails.add(t)
                heads.add(h)
                out.append((r["doc_id"], r["page"], r["tail"], r["head"], r["strong"]))
        return out

    return grouped(c, ["doc_id"], ["o1", "o2", "o3", "o4", "page", "tail", "head"], run, LINKS)


def group_errors(members: DataFrame, regions: DataFrame) -> DataFrame:
    """First fault of each proposed group: members(doc_id, grp, page, id, type, role, strong, weak).

    Members must be a head, continuations and a tail on consecutive pages, be known
    regions of the group's type, belong to no earlier group, and have strong evidence or
    two weak kinds.
    """
    known = regions.select("doc_id", "page", "id", "type", F.lit(True).alias("known")).distinct()
    first = Window.partitionBy("doc_id", "page", "id").orderBy("grp")
    m = members.join(known, ["doc_id", "page", "id", "type"], "left").withColumn("claim", F.first("grp").over(first))
    roles = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("page", "role"))), lambda r: r["role"]), ",")
    g = m.groupBy("doc_id", "grp").agg(
        roles.alias("roles"), F.count(F.lit(1)).alias("n"), (F.max("page") - F.min("page") + 1).alias("span"), F.countDistinct("page").alias("pages"),
        F.bool_or(F.col("known").isNull()).alias("unknown"), F.bool_or(F.col("claim") != F.col("grp")).alias("claimed"), F.max("strong").alias("strong"), F.max("weak").alias("weak"),
    )
    code = (
        F.when(~F.col("roles").rlike("^head(,continuation)*,tail$") | (F.col("span") != F.col("n")) | (F.col("pages") != F.col("n")), "invalid-members")
        .when(F.col("unknown"), "unknown-region").when(F.col("claimed"), "multiple-group-membership")
        .when(F.col("strong").isNull() & (F.col("weak") < 2), "insufficient-evidence")
    )
    return g.select("doc_id", "grp", code.alias("code")).where("code IS NOT NULL")
