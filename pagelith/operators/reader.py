"""Reader synchronisation: position index, as-of lookup, bracketing interpolation, replayed locks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagelith.operators.grouped import grouped


def position_index(blocks: DataFrame, page_height: float) -> DataFrame:
    """Absolute top and bottom of blocks(doc_id, block_id, page, y, h)."""
    top = F.col("page") * page_height + F.col("y")
    return blocks.select("doc_id", "block_id", top.alias("top"), (top + F.col("h")).alias("bottom"))


def locate(index: DataFrame, probes: DataFrame) -> DataFrame:
    """The last block that begins at or above each probe(doc_id, probe, at); the first block if none does.

    One union and two windows by document; no pair of rows is made.
    """
    i = index.select("doc_id", F.col("top").alias("at"), F.col("block_id"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("probe"))
    p = probes.select("doc_id", F.col("at"), F.lit(None).cast("string").alias("block_id"), F.lit(1).alias("kind"), F.col("probe").cast("long").alias("probe"))
    before = Window.partitionBy("doc_id").orderBy("at", "kind", "block_id").rowsBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy("doc_id").orderBy("at", "kind", "block_id").rowsBetween(0, Window.unboundedFollowing)
    u = i.unionByName(p).withColumn("b", F.last("block_id", ignorenulls=True).over(before)).withColumn("f", F.first("block_id", ignorenulls=True).over(after))
    return u.where("kind = 1").select("doc_id", "probe", "at", F.coalesce("b", "f").alias("block_id"))


def interpolate(anchors: DataFrame, probes: DataFrame) -> DataFrame:
    """Target position of each probe between its bracketing anchors(doc_id, id, source, target).

    Beyond the ends, the end anchor's target. The nearer anchor names the unit.
    """
    a = anchors.select("doc_id", F.col("source").alias("at"), F.struct("source", "target", "id").alias("a"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("probe"))
    none = F.lit(None).cast(a.schema["a"].dataType)
    p = probes.select("doc_id", "at", none.alias("a"), F.lit(1).alias("kind"), F.col("probe").cast("long").alias("probe"))
    w = Window.partitionBy("doc_id").orderBy("at", "kind", "a")
    u = a.unionByName(p)
    u = u.withColumn("lo", F.last("a", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rev = Window.partitionBy("doc_id").orderBy(F.col("at").desc(), "kind", F.col("a").desc())
    u = u.withColumn("hi", F.last("a", ignorenulls=True).over(rev.rowsBetween(Window.unboundedPreceding, 0))).where("kind = 1")
    u = u.withColumn("p", F.coalesce("lo", "hi")).withColumn("n", F.coalesce("hi", "lo"))
    span = F.col("n.source") - F.col("p.source")
    ratio = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col("at") - F.col("p.source")) / span))
    target = F.when(span > 0, F.col("p.target") + ratio * (F.col("n.target") - F.col("p.target"))).otherwise(F.col("p.target"))
    nearer = F.abs(F.col("at") - F.col("p.source")) <= F.abs(F.col("n.source") - F.col("at"))
    return u.select("doc_id", "probe", "at", target.alias("target"), F.when(nearer, F.col("p.id")).otherwise(F.col("n.id")).alias("unit_id"))


def clamp(target, height, viewport):
    return F.least(F.greatest(F.lit(0.0), height - viewport), F.greatest(F.lit(0.0), target))


LOCK = "project long, seq long, side string, at long, sync boolean"


def replay_lock(scrolls: DataFrame, lock_ms: int = 150) -> DataFrame:
    """Which scrolls(project, seq, side, at) pass: the same side waits until the lock of the last pass ends."""

    def run(rows: list[dict]) -> list[tuple]:
        side, until, out = None, 0, []
        for r in rows:
            ok = not (r["side"] == side and r["at"] < until)
            if ok:
                side, until = r["side"], r["at"] + lock_ms
            out.append((r["project"], r["seq"], r["side"], r["at"], ok))
        return out

    return grouped(scrolls, ["project"], ["at", "seq"], run, LOCK)


def reader_units(units: DataFrame, blocks: DataFrame) -> DataFrame:
    """units(doc_id, unit_id, block_id) without dangling blocks, and how many blocks each unit keeps."""
    kept = units.join(blocks.select("doc_id", "block_id").distinct(), ["doc_id", "block_id"], "left_semi")
    n = kept.groupBy("doc_id", "unit_id").agg(F.count(F.lit(1)).alias("n_blocks"))
    return units.select("doc_id", "unit_id").distinct().join(n, ["doc_id", "unit_id"], "left").withColumn("n_blocks", F.coalesce("n_blocks", F.lit(0)))


def unit_index(units: DataFrame) -> DataFrame:
    """units(doc_id, unit, source_ids, target_ids) -> (doc_id, side, block_id, unit); of units that share a block the last."""
    one = lambda side: units.select("doc_id", "unit", F.lit(side).alias("side"), F.explode(f"{side}_ids").alias("block_id"))
    return one("source").unionByName(one("target")).groupBy("doc_id", "side", "block_id").agg(F.max("unit").alias("unit"))


def sync_commands(probes: DataFrame, source: DataFrame, target: DataFrame, units: DataFrame, viewport: float) -> DataFrame:
    """probes(doc_id, probe, at) on the source side -> the block there, its unit, and the scroll position that centres the unit's first target block."""
    at = locate(source, probes).join(unit_index(units).where("side = 'source'").drop("side"), ["doc_id", "block_id"])
    first = units.where(F.size("target_ids") > 0).select("doc_id", "unit", F.get("target_ids", F.lit(0)).alias("target_id"))
    goal = target.select("doc_id", F.col("block_id").alias("target_id"), ((F.col("top") + F.col("bottom")) / 2).alias("centre"))
    out = at.join(first, ["doc_id", "unit"]).join(goal, ["doc_id", "target_id"])
    return out.select("doc_id", "probe", "block_id", "unit", "target_id", F.greatest(F.lit(0.0), F.col("centre") - viewport / 2).alias("scroll"))
