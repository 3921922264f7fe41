"""Corpus pipeline: documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept. The
first four return the columns of documents, the last the pieces of sequences. Null
texts are empty texts; a document that lines are dropped from has n_chars made anew.
Extra columns pass through the first four stages whatever their names, since only
doc_id and text are read; an empty table leaves every stage empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelith.llm import decontamination, line_dedup, near_duplicates, packing, quality_rules
from pagelith.llm.common import materialise, read, row_keys


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or that the trees reject go. Rows that repeat stay or go together."""
    return quality_rules.keep(docs, quality_rules.train(docs, read(spark, sf_dir, "labels")))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many documents share go, but for those of the largest doc_id."""
    found = line_dedup.dedup_lines(docs, carry=True)
    columns = {"text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("long")}
    return found.select(*((columns[c] if c in columns else F.col("row").getField(c)).alias(c) for c in docs.columns))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the least doc_id of each group of near duplicates stays."""
    lowest = F.coalesce("doc_id", F.lit(-(2**63)).cast("long"))
    groups = near_duplicates.near_duplicates(docs)
    stay = groups.where(F.col("doc_id").eqNullSafe(F.col("class_id"))).select(lowest.alias("doc")).distinct()
    # rows that repeat: one of them, without another shuffle of texts
    kept = row_keys(docs, carry=True).withColumn("doc", lowest).join(stay, "doc", "left_semi").dropDuplicates(["doc", "k1", "k2"])
    return kept.select(*((F.col("text") if c == "text" else F.col("row").getField(c)).alias(c) for c in docs.columns))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go; all rows of an equal doc_id and text together."""
    leaks = decontamination.leaks(docs, read(spark, sf_dir, "benchmark")).select("k1", "k2").distinct()
    kept = row_keys(docs, carry=True).join(leaks, ["k1", "k2"], "left_anti")
    return kept.select(*((F.col("text") if c == "text" else F.col("row").getField(c)).alias(c) for c in docs.columns))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The tokens of all documents in sequences; a null text is one end token, a row that repeats is packed again."""
    return packing.pack(docs)


STAGES = [
    ("quality rules", quality),
    ("line dedup", lines),
    ("near duplicates", near),
    ("decontamination", decontaminate),
    ("packing", pack),
]

#: SQL cannot express the trees, the shingle join or the tokens; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents, each stage's rows written as Parquet and read again."""
    docs = read(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialise(docs, f"stage-{i}")
    return docs
