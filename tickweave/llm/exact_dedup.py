"""Exact de-duplication by progressive refinement (operator 4), DataFrame functions only.

Three refinements, each over what the one before left together:

1. byte length (ASCII lower-casing keeps it, so it needs no normalised text),
2. a 64-bit hash of the normalised first ``prefix`` characters,
3. SHA-256 of the whole normalised text - read only for rows whose (length, prefix hash) is shared.

Every refinement is a count with map-side combine, so a group that holds a third of all rows reaches
a reducer as one row per input split; rows meet their group's count in a join that AQE can split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickweave.llm.common import LOWER, UPPER, documents, saved

PREFIX_CHARS = 256


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, all else as it is.  ``lower`` does that for pure ASCII texts (and is the
    faster of the two); others take the letter-by-letter ``translate``."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 prefix: int = PREFIX_CHARS) -> DataFrame:
    """(id, keep_id, group_size, kept, text_sha256), one row per input row.

    Null text counts as empty. Of equal texts the row with the largest id stays (a null id is the
    smallest); of repeated rows with that id exactly one stays. Empty input gives no rows. Columns
    besides the two named are not read, whatever their names."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), text.alias("t"))
    rows = rows.select("id", "t", F.octet_length("t").alias("len"))
    shared_len = rows.groupBy("len").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("len")
    head = F.xxhash64(ascii_lower(F.substring("t", 1, prefix))).alias("head")
    shared = saved(
        rows.groupBy("len", head).agg(F.count(F.lit(1)).alias("n"))  # before the join: a hot length is few rows
        .join(shared_len, "len", "left_semi").filter("n > 1")
        .select("len", "head", F.lit(True).alias("shared")), "op4-shared")

    # the whole text is read here; its digest is the group key only of rows that share length and prefix
    keys = rows.select("id", "len", head, F.sha2(ascii_lower(F.col("t")), 256).alias("sha"))
    keys = saved(keys.join(shared, ["len", "head"], "left")
                 .select("id", "sha", F.coalesce("shared", F.lit(False)).alias("shared")), "op4-keys")
    alone = keys.filter(~F.col("shared")).select(
        "id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "sha")
    same_id = keys.filter("shared").groupBy("sha", "id").agg(F.count(F.lit(1)).alias("c"))
    groups = same_id.groupBy("sha").agg(F.max("id").alias("keep_id"), F.sum("c").alias("group_size"))
    together = (
        same_id.join(groups, "sha")
        .select("id", "keep_id", "group_size", "sha", F.explode(F.sequence(F.lit(1).cast("long"), "c")).alias("i"))
        .select("id", "keep_id", "group_size",
                (F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("i") == 1)).alias("kept"), "sha"))
    return alone.unionByName(together).select(
        F.col("id").alias(id_col), "keep_id", "group_size", "kept", F.col("sha").alias("text_sha256"))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(documents(spark, sf_dir))


OP4_SQL = """
WITH d AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
  FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
       sha256(t) AS text_sha256
FROM d WINDOW g AS (PARTITION BY t)
"""
