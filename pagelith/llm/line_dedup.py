"""Line dedup: explode normalised lines, hash, count distinct documents per hash, drop, reassemble.

Everything is a DataFrame expression. Only hashes of lines are shuffled for the
count; texts move once, by row key, to be put together again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelith.llm.common import row_keys

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SPACE = " \t\n\x0b\x0c\r"


def line_key(line):
    return F.translate(F.btrim(line, F.lit(SPACE)), UPPER, UPPER.lower())


def _line_hashes(keyed: DataFrame, min_chars: int) -> DataFrame:
    """One row per line that is long enough: row key, document, position, 128-bit hash."""
    lines = keyed.select("k1", "k2", "doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    # small letters have the length of capitals, so only lines that are long enough are put into small letters
    long = lines.where(F.length(F.btrim("line", F.lit(SPACE))) >= min_chars)
    return long.select("k1", "k2", "doc_id", "pos", line_key(F.col("line")).alias("key")).select(
        "k1", "k2", "doc_id", "pos", F.xxhash64(F.lit(3), "key").alias("h1"), F.xxhash64(F.lit(4), "key").alias("h2")
    )


def dedup_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, salts: int = 16, carry: bool = False) -> DataFrame:
    """Drops lines whose key is in at least min_docs documents, except in the largest doc_id that holds it.

    Input: documents(doc_id, text, ...). Returns doc_id, n_lines, n_dropped, kept_text;
    with carry, also the input row as a struct named row.
    Null or empty text is one empty line. Rows that repeat a doc_id are the same
    document when lines are counted, and each gives its own result row. A null
    doc_id counts as one more document, below all others. Empty table: empty
    result. Columns other than doc_id and text are ignored. Very long texts and
    ties need no special case: positions decide.
    """
    keyed = row_keys(docs)
    whole = row_keys(docs, carry=True) if carry else keyed
    doc = F.coalesce(F.col("doc_id"), F.lit(-(2**63)).cast("long"))
    # the salt, of the document, splits lines that a large part of all documents share, and keeps equal documents together
    salt = F.coalesce(F.pmod(F.xxhash64(F.lit(6), doc), F.lit(salts)).cast("int"), F.lit(0))
    lines = (
        _line_hashes(keyed, min_chars)
        .select("k1", "k2", "pos", "h1", "h2", doc.alias("doc"), salt.alias("salt"))
        .repartition("h1", "h2", "salt")
    )
    # lines are hashed and shuffled once: the count names every column that the join needs (some place of the line),
    # so that both read the same exchange
    place = F.coalesce(F.max("k1"), F.max("k2"), F.max("pos"))
    frequent = (
        lines.groupBy("h1", "h2", "salt", "doc")
        .agg(place.alias("place"))
        .groupBy("h1", "h2", "salt")
        .agg(F.count("place").alias("n"), F.max("doc").alias("keeper"))
        .groupBy("h1", "h2")
        .agg(F.sum("n").alias("n_docs"), F.max("keeper").alias("keeper"), F.collect_list("salt").alias("held"))
        .where(F.col("n_docs") >= min_docs)
        .select("h1", "h2", "keeper", F.explode("held").alias("salt"))
    )
    dropped = (
        lines.join(frequent, ["h1", "h2", "salt"])
        .where(F.col("doc") != F.col("keeper"))
        .groupBy("k1", "k2")
        .agg(F.collect_set("pos").alias("gone"))
    )
    parts, kept = F.split("text", "\n"), ["row"] if carry else []
    gone = F.coalesce(F.col("gone"), F.array().cast("array<int>"))
    stay = F.array_except(F.sequence(F.lit(0), F.size("parts") - 1), F.col("gone"))
    return (
        whole.join(dropped, ["k1", "k2"], "left")
        .select("doc_id", "text", parts.alias("parts"), gone.alias("gone"), *kept)
        .select(
            "doc_id",
            *kept,
            F.size("parts").cast("long").alias("n_lines"),
            F.size("gone").cast("long").alias("n_dropped"),
            F.when(F.size("gone") == 0, F.col("text")).otherwise(F.array_join(F.transform(stay, lambda i: F.get("parts", i)), "\n")).alias("kept_text"),
        )
    )


def op8_line_dedup(spark, sf_dir: str) -> DataFrame:
    """dedup_lines() of all documents, with a digest of the text that is left; nulls, repeats and empty tables as there."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


OP8_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS rid, doc_id AS shown, coalesce(doc_id, -9223372036854775808) AS doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents
), lines AS (
  SELECT rid, shown, doc_id, unnest(parts) AS line, unnest(range(len(parts))) AS pos FROM docs
), keyed AS (
  SELECT rid, shown, doc_id, pos, line,
         translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
), frequent AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 40
  GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), judged AS (
  SELECT k.*, (f.key IS NOT NULL AND k.doc_id <> f.keeper) AS dropped
  FROM keyed k LEFT JOIN frequent f ON k.key = f.key
)
SELECT min(shown) AS doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (dropped))::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256
FROM judged GROUP BY rid
"""
