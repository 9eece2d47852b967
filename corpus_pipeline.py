"""The corpus pipeline: five stages over documents, each written as Parquet and read again by the next."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kvtable.llm import decontaminate, jaccard_join, language_id, line_dedup, mixing
from kvtable.llm.common import is_training, removed_at_exit, shared_dir, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _keyed(docs: DataFrame) -> DataFrame:
    """The documents with a 128-bit key of id and text, by which decisions find their rows: ids may be null or repeat."""
    return docs.select(*COLUMNS).withColumns({"key1": F.xxhash64("doc_id", "text"), "key2": F.xxhash64(F.lit(1), "doc_id", "text")})


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose text has a language: a letter, and one language that is likelier than all others together.

    Null and empty texts and texts without a letter go. Repeated rows and null ids are kept or go by
    their text alone; where no row has a language to learn from, all go. Null languages are not learned from."""
    model = language_id.fit(docs.filter(is_training(F.col("doc_id"))))
    scored = language_id.predict(docs.select(*COLUMNS), model, keep=COLUMNS)
    return scored.filter("lang_pred != 'und' AND score > 0.5").select(*COLUMNS)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes repeated passages of lines. A document of which nothing is left was a copy, and goes.

    Null and empty texts stay as they are. Rows that repeat an id and a text are one document and
    keep the same lines; of different rows the first by id has the first occurrence, null ids before all others."""
    done = line_dedup.line_dedup(docs.select(*COLUMNS), passages=True).filter("n_removed = 0 OR text != ''")
    changed = F.col("n_removed") > 0
    n_chars = F.when(changed, F.char_length("text").cast("long")).otherwise(F.col("row.n_chars"))
    return done.select("doc_id", "text", F.col("row.lang").alias("lang"), F.col("row.source").alias("source"), n_chars.alias("n_chars"))


def join_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies: the one with the smallest id; one without an id only where none has one.

    Null and empty texts are near copies of nothing and stay. Of different texts with one id, each
    stays or goes by itself (ties: the smaller key); rows that repeat an id and a text are one document, and stay or go together."""
    rows = _keyed(docs)
    groups = jaccard_join.jaccard_join(rows.select(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "key1", "key2").alias("id"), "text"), id_col="id")
    gone = groups.filter(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select("doc_id.key1", "doc_id.key2").distinct()
    return rows.join(gone, ["key1", "key2"], "left_anti").select(*COLUMNS)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes documents that passages of the benchmark contaminate.

    Null and empty texts stay; every row goes by its own text, whatever its id. An empty benchmark removes nothing."""
    rows = _keyed(docs)
    found = decontaminate.decontaminate(rows.select(F.struct("key1", "key2").alias("key"), "text"), table(spark, sf_dir, "benchmark"), id_col="key")
    gone = found.filter("contaminated").select("doc_id.key1", "doc_id.key2").distinct()
    return rows.join(gone, ["key1", "key2"], "left_anti").select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: one row a slot with its shard, source, place in the source's slots, block, text and the ids of the documents in it, in order.

    Documents without words are in no slot. A null source is a source of its own, null ids are listed as
    null, repeated rows count each; an empty table gives an empty mix."""
    made = mixing.mix(docs).mixed
    return made.select("shard", "source", "slot", "block", F.col("pieces.doc_id").alias("doc_ids"), "text")


STAGES = [
    ("language", identify_language),
    ("lines", dedup_lines),
    ("near_copies", join_near_copies),
    ("benchmark", remove_benchmark),
    ("mix", mix_sources),
]

#: Learned models and hash draws are not expressible in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; every stage's result is written to the shared folder, and removed when the session ends."""
    docs = table(spark, sf_dir, "documents")
    folder = removed_at_exit(spark, f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}")
    for name, stage in STAGES:
        path = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
