"""Work batches, caches, invalidation, glossary, task state, throughput."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagelith.operators.grouped import grouped

MAX_TOKENS, MAX_BLOCKS = 4000, 8
#: Artifact kinds that any formal or layout change makes stale; kinds that a page plan owns (fixed values).
OUTPUT_KINDS = "chinese-pdf typst-source typst-preview alignment-manifest quality-report project-package structure-diagnostic".split()
PLAN_KINDS = "recovered-page-plan accepted-page-plan accepted-document-plan vision-correction-patch".split()
SOURCE_KINDS = "raw-vision-response vision-layout".split()


def batches(requests: DataFrame, shared: int = 0, max_tokens: int = MAX_TOKENS, max_blocks: int = MAX_BLOCKS) -> DataFrame:
    """Greedy ordered packing of requests(doc_id, block_id, ord, tokens) under a token and a block cap.

    A block that alone, with the shared tokens, exceeds the cap is a batch of its own,
    marked oversized. Returns doc_id, block_id, ord, batch, oversized. The fold runs
    over one document's array of token counts, in the JVM.
    """
    start = F.struct(F.lit(0).alias("batch"), F.lit(0).alias("n"), F.lit(shared).cast("long").alias("used"), F.array().cast("array<struct<ord:bigint,batch:int,over:boolean>>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        over = x["tokens"] + shared > max_tokens
        full = (s["n"] > 0) & (over | (s["n"] >= max_blocks) | (s["used"] + x["tokens"] > max_tokens))
        batch = s["batch"] + F.when(full, 1).otherwise(0)
        n, used = F.when(full, 0).otherwise(s["n"]), F.when(full, F.lit(shared)).otherwise(s["used"])
        row = F.struct(x["ord"].alias("ord"), batch.alias("batch"), over.alias("over"))
        return F.struct(
            F.when(over, batch + 1).otherwise(batch).alias("batch"), F.when(over, 0).otherwise(n + 1).alias("n"),
            F.when(over, F.lit(shared)).otherwise(used + x["tokens"]).cast("long").alias("used"), F.concat(s["out"], F.array(row)).alias("out"),
        )

    ordered = F.sort_array(F.collect_list(F.struct(F.col("ord").cast("long").alias("ord"), F.col("tokens").cast("long").alias("tokens"))))
    placed = requests.groupBy("doc_id").agg(ordered.alias("xs")).select("doc_id", F.explode(F.aggregate("xs", start, step, lambda s: s["out"])).alias("b"))
    placed = placed.select("doc_id", F.col("b.ord").alias("ord"), F.col("b.batch").alias("batch"), F.col("b.over").alias("oversized"))
    return requests.select("doc_id", "block_id", F.col("ord").cast("long").alias("ord")).join(placed, ["doc_id", "ord"])


def batch_totals(placed: DataFrame, requests: DataFrame, shared: int = 0) -> DataFrame:
    t = placed.join(requests.select("doc_id", "block_id", "tokens"), ["doc_id", "block_id"])
    return t.groupBy("doc_id", "batch").agg(F.count(F.lit(1)).alias("blocks"), (F.sum("tokens") + shared).alias("tokens"), F.bool_or("oversized").alias("oversized"))


def split_batch(placed: DataFrame, failed: DataFrame) -> DataFrame:
    """Halves the failed batches (doc_id, batch): the first half keeps the larger share."""
    w = Window.partitionBy("doc_id", "batch")
    p = placed.join(failed.select("doc_id", "batch").distinct(), ["doc_id", "batch"])
    p = p.withColumn("pos", F.row_number().over(w.orderBy("ord"))).withColumn("size", F.count(F.lit(1)).over(w))
    return p.select("doc_id", "block_id", "batch", F.when(F.col("pos") <= F.ceil(F.col("size") / 2), 0).otherwise(1).alias("half"))


def cache_split(requests: DataFrame, cache: DataFrame, key: str = "key") -> DataFrame:
    """Requests with hit true where the cache holds the key."""
    return requests.join(cache.select(key, F.lit(True).alias("hit")).distinct(), key, "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


def upsert(table: DataFrame, rows: DataFrame, keys: list[str], at: str) -> DataFrame:
    """Last write per key wins; of equal times, the new row."""
    both = table.withColumn("new_", F.lit(0)).unionByName(rows.withColumn("new_", F.lit(1)))
    w = Window.partitionBy(*keys).orderBy(F.col(at).desc(), F.col("new_").desc())
    return both.withColumn("r_", F.row_number().over(w)).where("r_ = 1").drop("r_", "new_")


def pending(requests: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """What a resumed session has still to do."""
    return requests.join(done.where("status = 'done'").select(*keys).distinct(), keys, "left_anti")


def invalidation(artifacts: DataFrame, changes: DataFrame) -> DataFrame:
    """Keys of artifacts that a change makes stale.

    artifacts(key, project_id, kind, pages array<int>), changes(project_id, facets
    array<string>, pages array<int>). A source change implies page plans and assets;
    the source file itself never goes.
    """
    facets = F.array_distinct(F.concat("facets", F.when(F.array_contains("facets", "source-analysis"), F.array(F.lit("page-plan"), F.lit("asset-geometry"))).otherwise(F.array().cast("array<string>"))))
    c = changes.select("project_id", facets.alias("facets"), F.col("pages").alias("changed"))
    has = lambda *names: F.arrays_overlap("facets", F.array(*map(F.lit, names)))
    anywhere = F.size("changed") == 0
    touched = anywhere | F.coalesce(F.arrays_overlap("pages", "changed"), F.lit(False))
    unbound = F.size(F.coalesce("pages", F.array().cast("array<int>"))) == 0
    stale = (
        (F.col("kind").isin(SOURCE_KINDS) & has("source-analysis") & (touched | unbound))
        | (F.col("kind").isin(OUTPUT_KINDS) & (F.size("facets") > 0))
        | (F.col("kind").isin(PLAN_KINDS) & has("page-plan", "caption-link", "cross-page-group") & touched)
        | ((F.col("kind") == "formula-ocr") & has("asset-geometry") & touched)
    )
    return artifacts.join(c, "project_id").where((F.col("kind") != "english-pdf") & stale).select("key").distinct()


def stale_translations(translations: DataFrame, changes: DataFrame) -> DataFrame:
    """changes(project_id, facets, units array<string>): no units means all of the project."""
    c = changes.where(F.array_contains("facets", "semantic-content")).select("project_id", "units")
    return translations.join(c, "project_id").where((F.size("units") == 0) | F.array_contains("units", F.col("block_id"))).select("key").distinct()


def merge_glossary(terms: DataFrame) -> DataFrame:
    """terms(doc_id, source_type, seq, source, target): user over detected over model, later over earlier; first position kept."""
    rank = F.when(F.col("source_type") == "model", 0).when(F.col("source_type") == "detected", 1).otherwise(2)
    t = terms.withColumn("rank", rank).withColumn("term", F.trim(F.lower("source"))).where("term <> ''")
    best = F.max_by(F.struct("source", "target", "source_type"), F.struct("rank", "seq")).alias("best")
    first = F.min(F.struct("rank", "seq")).alias("first")
    return t.groupBy("doc_id", "term").agg(best, first).select(
        "doc_id", "term", "best.*", F.row_number().over(Window.partitionBy("doc_id").orderBy("first")).alias("position")
    )


def first_occurrences(blocks: DataFrame, terms: DataFrame) -> DataFrame:
    """The first block, in order, that contains each whole term."""
    t = terms.select("doc_id", "term")
    pattern = F.concat(F.lit(r"(?:^|[^\p{L}\p{N}_])\Q"), F.col("term"), F.lit(r"\E(?=$|[^\p{L}\p{N}_])"))
    hits = blocks.join(t, "doc_id").where(F.contains(F.lower("text"), F.col("term"))).where(F.rlike(F.lower("text"), pattern))
    return hits.groupBy("doc_id", "term").agg(F.min_by("block_id", "ord").alias("block_id"))


def eta(samples: DataFrame, last: int = 8, least: int = 2) -> DataFrame:
    """Median milliseconds a token over the last samples with positive tokens and time; none under `least`.

    samples(project, at, seq, tokens, elapsed, remaining).
    """
    good = samples.where("tokens > 0 AND elapsed > 0")
    w = Window.partitionBy("project").orderBy(F.col("at").desc(), F.col("seq").desc())
    recent = good.withColumn("r", F.row_number().over(w)).where(F.col("r") <= last)
    out = recent.groupBy("project").agg(F.count(F.lit(1)).alias("n"), F.median(F.col("elapsed") / F.col("tokens")).alias("ms_per_token"))
    return out.where(F.col("n") >= least)


#: Events that only a given stage allows, and the stage they lead to (fixed values).
STAGES = {
    "START_PARSE": ("idle", "parsing"), "PARSE_DONE": ("parsing", "analyzing-layout"), "LAYOUT_DONE": ("analyzing-layout", "building-glossary"),
    "GLOSSARY_DONE": ("building-glossary", "translating"), "COMPOSITION_DONE": ("composing", "compiling"), "COMPILE_DONE": ("compiling", "aligning"),
    "ALIGNMENT_DONE": ("aligning", "aligning"), "QUALITY_STARTED": ("aligning", "validating"), "QUALITY_PASSED": ("validating", "completed"),
}


def reduce_event(state: dict, event: dict) -> dict:
    """The next task state; ValueError if the event is not allowed."""
    kind, s = event["type"], dict(state)
    if kind == "START_TRANSLATION":
        return s | {"stage": "translating", "status": "running", "completed": 0, "total": int(event.get("count") or 0), "failed": 0}
    if kind == "FAILED":
        return s | {"status": "failed"}
    if kind in STAGES and s["stage"] == STAGES[kind][0]:
        status = {"START_PARSE": "running", "QUALITY_PASSED": "completed"}.get(kind, s["status"])
        return s | {"stage": STAGES[kind][1], "status": status}
    if kind == "BLOCKS_VALIDATED" and s["stage"] == "translating":
        done = s["completed"] + int(event.get("count") or 0)
        if done <= s["total"]:
            return s | {"completed": done}
    if kind == "TRANSLATION_DONE" and s["stage"] == "translating" and s["completed"] == s["total"] and not s["failed"]:
        return s | {"stage": "composing"}
    moves = {
        "PAUSED": (("running", "pausing"), "paused"), "STOP_REQUESTED": (("running",), "stopping"), "STOPPED": (("stopping",), "stopped"),
        "INTERRUPTED": (("running", "stopping", "pausing"), "stopped"), "RESUME": (("stopped", "paused", "failed"), "running"),
    }
    if kind in moves and s["status"] in moves[kind][0]:
        return s | {"status": moves[kind][1]}
    raise ValueError(f"{kind} is not allowed from {s['stage']}")


IDLE = {"stage": "idle", "status": "idle", "completed": 0, "total": 0, "failed": 0}
STATE = "project long, stage string, status string, completed long, total long, rejected long"


def replay(events: DataFrame) -> DataFrame:
    """The last state of each project from events(project, seq, type, count); events not allowed are counted."""

    def fold(rows: list[dict]) -> list[tuple]:
        state, rejected = dict(IDLE), 0
        for e in rows:
            try:
                state = reduce_event(state, e)
            except ValueError:
                rejected += 1
        return [(rows[0]["project"], state["stage"], state["status"], state["completed"], state["total"], rejected)]

    return grouped(events, ["project"], ["seq"], fold, STATE)


def ai_log(events: DataFrame, keep: int = 200) -> DataFrame:
    """The last `keep` entries of a project's log, of a batch's progress rows only the latest."""
    latest = Window.partitionBy("project", F.when(F.col("type") == "batch-progress", F.col("batch")).otherwise(F.col("seq"))).orderBy(F.col("seq").desc())
    e = events.withColumn("r", F.row_number().over(latest)).where("r = 1 OR type <> 'batch-progress'").drop("r")
    w = Window.partitionBy("project").orderBy(F.col("seq").desc())
    return e.withColumn("r", F.row_number().over(w)).where(F.col("r") <= keep)


def can_enter_reader(required, validated, failed, *flags: Column) -> Column:
    out = (required > 0) & (validated == required) & (failed == 0)
    for f in flags:
        out = out & f
    return out


def secrets(rows: DataFrame, text: str) -> DataFrame:
    """Rows that must not be exported; an export is allowed if there is none."""
    return rows.where(F.col(text).rlike(r"sk-[A-Za-z0-9_-]{8,}|(?i)bearer\s+[A-Za-z0-9._-]{8,}|(?i)(api[_-]?key|password|secret)\s*[:=]\s*\S+"))


PACKAGE_SCHEMA = "project.v1"


def packages(tables: dict[str, DataFrame], key: str = "project") -> DataFrame:
    """One JSON text per project, made of each table's sorted rows, with its checksum."""
    from pagelith.functions.hashing import fnv1a_rounded

    out = None
    for name, df in tables.items():
        rows = df.groupBy(key).agg(F.sort_array(F.collect_list(F.to_json(F.struct(*(c for c in df.columns if c != key))))).alias(name))
        out = rows if out is None else out.join(rows, key, "full_outer")
    body = F.concat(
        F.lit(f'{{"schema":"{PACKAGE_SCHEMA}"'),
        *(F.concat(F.lit(f',"{n}":['), F.array_join(F.coalesce(F.col(n), F.array().cast("array<string>")), ","), F.lit("]")) for n in tables), F.lit("}"),
    )
    return out.select(key, body.alias("payload")).withColumn("checksum", fnv1a_rounded(F.col("payload")))


def package_errors(rows: DataFrame) -> DataFrame:
    """Packages whose schema or checksum is wrong, or that hold a secret."""
    from pagelith.functions.hashing import fnv1a_rounded

    secret = F.col("payload").rlike(r"(?i)\"(?:apikey|authorization|reasoning_content)\"|(?:^|[^A-Za-z0-9])sk-[A-Za-z0-9_-]+|\bAuthorization\b")
    errors = F.array_compact(F.array(
        F.when(F.coalesce(F.get_json_object("payload", "$.schema"), F.lit("")) != PACKAGE_SCHEMA, F.lit("schema")),
        F.when(fnv1a_rounded(F.col("payload")) != F.col("checksum"), F.lit("checksum")), F.when(secret, F.lit("secret")),
    ))
    return rows.withColumn("errors", errors).where(F.size("errors") > 0)
