"""Exact deduplication by progressive refinement: length, then prefix hash, then full hash."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, materialize, table


def exact_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = 64, buckets: int = 1 << 16, digest: bool = False
) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    1. Rows are counted by text length; a length that occurs once (and no other equal to it modulo
       ``buckets``, which bounds the broadcast) is settled.
    2. Among the others, rows are counted by (length, hash of the first prefix_chars characters).
    3. Surviving groups are folded into at most ``buckets`` numbers (so the broadcast is bounded
       whatever the corpus), and only rows whose bucket survives have their whole text hashed, in
       the scan itself: no text is ever shuffled. Groups are formed on (length, prefix hash,
       SHA-256); the row with the largest id of each group stays.

    Counting uses partial aggregates, and the only join on the group key is a plain equi-join that
    adaptive execution can split when one text holds a large part of all rows.

    Texts are compared after lower-casing A-Z; null counts as empty. Rows that repeat an id and a
    text are the same document: all of them are marked kept if their id is the largest. A null id
    is below all others and stays only where all ids of the group are null. Empty tables give
    empty results; other columns are ignored. text_sha256 is null for rows that step 3 never
    read, unless digest asks for every row's hash.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).withColumns(
        {"len": F.char_length(text), "prefix": F.xxhash64(ascii_lower(F.substring(text, 1, prefix_chars)))}
    )
    narrow = materialize(base.select("len", "prefix"), "dedup-narrow")
    lengths = narrow.groupBy("len").count().filter("count > 1").select(F.pmod("len", F.lit(buckets)).alias("residue")).distinct()
    groups = (
        narrow.join(F.broadcast(lengths), F.pmod(narrow["len"], F.lit(buckets)) == lengths["residue"], "left_semi")  # at most `buckets` rows
        .groupBy("len", "prefix")
        .count()
        .filter("count > 1")
    )
    bucket = F.pmod(F.xxhash64("len", "prefix"), F.lit(buckets)).cast("int")
    surviving = groups.select(bucket.alias("bucket")).distinct().withColumn("hit", F.lit(True))

    full = F.sha2(ascii_lower(text), 256)
    rows = (
        base.withColumn("bucket", bucket)
        .join(F.broadcast(surviving), "bucket", "left")  # at most `buckets` rows
        .select("doc_id", "len", "prefix", F.coalesce("hit", F.lit(False)).alias("hit"), (full if digest else F.when(F.col("hit"), full)).alias("text_sha256"))
    )
    rows = materialize(rows, "dedup-rows")
    keys = ["len", "prefix", "text_sha256"]
    found = rows.filter("hit").groupBy(*keys).agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    found = materialize(found.filter("group_size > 1"), "dedup-groups")  # so the join's two sides are dealt for it alone
    copies = rows.filter("hit").join(found, keys, "left")
    alone = rows.filter("not hit").withColumns({"keep_id": F.col("doc_id"), "group_size": F.lit(1).cast("long")})
    return copies.unionByName(alone.select(*copies.columns)).select(
        "doc_id",
        F.when(F.col("group_size") > 1, F.col("keep_id")).otherwise(F.col("doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        F.when(F.col("group_size") > 1, F.col("doc_id").eqNullSafe(F.col("keep_id"))).otherwise(F.lit(True)).alias("kept"),
        "text_sha256",
    )


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"), digest=True)


OP1_SQL = """
WITH d AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
), g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(t) AS text_sha256
FROM d JOIN g USING (t)
"""
