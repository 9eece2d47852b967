"""Benchmark decontamination with a distributed positional inverted index."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bit_filter, in_filter, materialize, table
from .wordhash import PLAIN, chunks, coded, lists, longs, starts_of

KEY = ["key1", "key2"]
#: Numbers that terms are folded into; bounds what is sent to the tasks (1 MB of bits).
TERM_BUCKETS = 1 << 23


def as_bytes(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, a 128-bit key of the text, and the text's bytes. All that is found out depends on the text alone, so equal texts share a key."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    return docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("key1"), F.xxhash64(F.lit(1), text).alias("key2"), text.alias("text"))


def windows_of(items: DataFrame, n: int) -> DataFrame:
    """item, terms: the windows of n words (all words, where an item has fewer) of the items (item, text), as 64-bit hashes of the words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, end, data, offsets in chunks(batch.column("text")):
                codes, doc = coded(data, offsets, PLAIN)
                words = np.bincount(doc, minlength=end - at)
                count = np.where(words, np.maximum(words - n + 1, 1), 0)  # windows of each item
                of = np.repeat(np.arange(end - at), count)
                first = starts_of(words)[of] + np.arange(len(of)) - starts_of(count)[of]
                length = np.minimum(words, n)[of]
                span = np.repeat(first - starts_of(length), length) + np.arange(length.sum())
                yield pa.RecordBatch.from_arrays([batch.column("item").slice(at, end - at).take(pa.array(of)), lists(codes[span], length)], ["item", "terms"])

    return items.mapInArrow(run, "item string, terms array<long>")


def term_counts(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """term, n: how often each of the terms (one row each) occurs in the texts. One row a term and chunk of texts is shuffled."""
    packed = bit_filter(terms, TERM_BUCKETS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in chunks(batch.column("text")):
                codes = coded(data, offsets, PLAIN)[0]
                found, n = np.unique(codes[in_filter(packed, codes)], return_counts=True)
                yield pa.RecordBatch.from_arrays([longs(found), longs(n)], ["term", "n"])

    counted = texts.select("text").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    return terms.join(counted, "term", "left").select("term", F.coalesce("n", F.lit(0)).alias("n"))


def build_index(texts: DataFrame, terms: DataFrame, window: int) -> DataFrame:
    """The inverted index: the postings of the terms by document, each with the words around it.

    doc_id, key1, key2, n_words, postings: array of (term, pos, around), where around[window - 1] is
    the term itself and 0 stands before the first and after the last word. Terms that share a bit with one of
    the wanted have postings too; they meet none when the index is joined."""
    packed = bit_filter(terms, TERM_BUCKETS)
    posting = T.StructType([T.StructField("term", T.LongType()), T.StructField("pos", T.IntegerType()), T.StructField("around", T.ArrayType(T.LongType()))])
    schema = T.StructType([*texts.schema.fields[:-1], T.StructField("n_words", T.LongType()), T.StructField("postings", T.ArrayType(posting))])
    reach = np.arange(1 - window, window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offsets in chunks(batch.column("text")):
                codes, doc = coded(data, offsets, PLAIN)
                words = np.bincount(doc, minlength=end - first)
                at = np.flatnonzero(in_filter(packed, codes))
                span = at[:, None] + reach
                inside = np.clip(span, 0, max(0, len(codes) - 1))
                around = np.where((span == inside) & (doc[inside] == doc[at][:, None]), codes[inside], np.uint64(0)) if len(at) else np.zeros((0, len(reach)), np.uint64)
                pos = (at - starts_of(words)[doc[at]]).astype(np.int32)
                fields = [longs(codes[at]), pa.array(pos), lists(around.ravel(), np.full(len(at), len(reach)))]
                values = pa.StructArray.from_arrays(fields, ["term", "pos", "around"])
                counts = np.bincount(doc[at], minlength=end - first)
                postings = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)), pa.int32()), values)
                kept = [batch.column(i).slice(first, end - first) for i in range(batch.num_columns - 1)]
                yield pa.RecordBatch.from_arrays([*kept, longs(words), postings], schema.fieldNames())

    return texts.mapInArrow(run, schema)


def matches(index: DataFrame, anchors: DataFrame, window: int, slop: int = 0) -> DataFrame:
    """key1, key2, wid1, wid2, start, end, exact: where a window's anchors (term, offset, wid1, wid2, terms, needed) stand at their offsets, give or take slop words.

    Each posting of an anchor votes for the start it implies; a start that all of a window's anchors
    vote for is a candidate, and the words kept around the posting verify the phrase."""
    flat = index.filter(F.size("postings") > 0).select(*KEY, F.inline("postings"))
    at = flat.join(anchors, "term").withColumn("start", F.col("pos") - F.col("offset"))
    same = F.slice("around", F.lit(window) - F.col("offset"), F.size("terms")) == F.col("terms")
    columns = [*KEY, "wid1", "wid2", "offset", "needed"]
    at = at.select(*columns, "start", F.size("terms").alias("n"), same.alias("same"))
    if slop:
        at = at.select("*", F.explode(F.array(*map(F.lit, range(-slop, slop + 1)))).alias("off"))
        at = at.select(*columns, (F.col("start") + F.col("off")).alias("start"), "n", (F.col("same") & (F.col("off") == 0)).alias("same"))
    else:
        at = at.filter("same")
    found = at.groupBy(*KEY, "wid1", "wid2", "start").agg(F.size(F.collect_set("offset")).alias("votes"), F.first("needed").alias("needed"), F.first("n").alias("n"), F.bool_or("same").alias("exact"))
    return found.filter("votes = needed").select(*KEY, "wid1", "wid2", "start", (F.col("start") + F.col("n")).alias("end"), "exact")


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    window: int = 13,
    anchors: int = 2,
    share: int = 20,
    slop: int = 0,
) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_hit, items (sorted ids), near_items, contaminated.

    Two scans of the texts, whatever the size of the benchmark:

    1. The benchmark's windows and their terms are tables. The terms are counted over all documents, and every window's ``anchors`` rarest terms chosen.
    2. The positional postings of these terms are stored once, and joined with the anchors of all
       windows by term; the offset-adjusted lists of a window are intersected, and the phrase is verified.

    n_hit counts document words inside any occurrence of a window; a document is contaminated if
    n_hit > 0 and share * n_hit >= n_words. near_items lists items with a window whose anchors all
    stand within slop words of their places (empty unless slop is given). Only bits of a fixed size pass through the driver.

    Words are runs of 0-9, A-Z, a-z (lower-cased) and non-ASCII characters, and compare by 64-bit
    hashes. An item of fewer words than the window is one window; an item without words or with
    null text never occurs. An item whose id is null makes hits but is not listed; items that share an id are listed
    once. Null documents have no words. Equal texts are looked up once; repeated rows each give a
    row. Texts of any length are read whole. An empty benchmark leaves every document clean, an empty table gives an empty result.
    Other columns are ignored.
    """
    texts = as_bytes(docs, id_col, text_col)
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))
    listed = windows_of(items, window).withColumns({"wid1": F.xxhash64("terms"), "wid2": F.xxhash64(F.lit(1), "terms")})
    listed = materialize(listed, "benchmark-windows")
    windows = listed.select("wid1", "wid2", "terms").dropDuplicates(["wid1", "wid2"])
    terms = materialize(windows.select(F.explode("terms").alias("term")).distinct(), "benchmark-terms")
    counts = materialize(term_counts(texts, terms), "benchmark-term-counts")
    ranked = windows.select("wid1", "wid2", "terms", F.posexplode("terms").alias("offset", "term")).join(counts, "term")
    ranked = ranked.groupBy("wid1", "wid2").agg(F.first("terms").alias("terms"), F.slice(F.array_sort(F.collect_list(F.struct("n", "offset", "term"))), 1, anchors).alias("own"))  # a window has few terms
    chosen = ranked.select("wid1", "wid2", "terms", F.size("own").alias("needed"), F.inline("own")).select("wid1", "wid2", "terms", "needed", "offset", "term")
    chosen = materialize(chosen, "benchmark-anchors")
    index = materialize(build_index(texts, chosen.select("term"), window), "positional-index")
    hits = materialize(matches(index, chosen, window, slop), "benchmark-matches")

    spans = hits.filter("exact").groupBy(*KEY).agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("spans"))
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end"))
    covered = F.aggregate(
        "spans", zero, lambda s, x: F.struct((s["n"] + F.greatest(x["end"] - F.greatest(x["start"], s["end"]), F.lit(0))).alias("n"), F.greatest(s["end"], x["end"]).alias("end"))
    )["n"]
    spans = spans.select(*KEY, covered.alias("n_hit"))
    named = hits.select(*KEY, "wid1", "wid2", "exact").distinct().join(listed.filter("item IS NOT NULL").select("wid1", "wid2", "item").distinct(), ["wid1", "wid2"])
    chosen_items = lambda of, name: F.array_sort(F.collect_set(F.when(of, F.col("item")))).alias(name)
    named = named.groupBy(*KEY).agg(chosen_items(F.col("exact"), "items"), chosen_items(~F.col("exact"), "near_items"))
    found = materialize(spans.join(named, KEY, "full"), "benchmark-hits")  # so the join's two sides are dealt for it alone
    none = F.array().cast("array<string>")
    out = index.select("doc_id", *KEY, "n_words").join(found, KEY, "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("items", none).alias("items"), F.coalesce("near_items", none).alias("near_items")
    )
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("n_words")))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    listed = F.sha2(F.array_join("items", ","), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), listed.alias("items_sha256"), "contaminated")


OP10_SQL = r"""
WITH dw AS (
  SELECT doc_id, row_number() OVER () AS rid,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), iw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), win AS (
  SELECT DISTINCT item_id, n, array_to_string(w[s + 1 : s + n], ' ') AS win
  FROM (SELECT item_id, w, least(13, len(w)) AS n, unnest(range(0, len(w) - least(13, len(w)) + 1)) AS s FROM iw WHERE len(w) > 0)
), pos AS (
  SELECT rid, n, s, array_to_string(w[s + 1 : s + n], ' ') AS win
  FROM (SELECT rid, w, n, unnest(range(0, len(w) - n + 1)) AS s FROM dw, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)
), hit AS (SELECT rid, s, n, item_id FROM pos JOIN win USING (n, win)
), covered AS (
  SELECT rid, count(*) AS n_hit FROM (SELECT DISTINCT rid, unnest(range(s, s + n)) AS p FROM (SELECT DISTINCT rid, s, n FROM hit)) GROUP BY rid
), listed AS (
  SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, item_id::VARCHAR AS item FROM hit) GROUP BY rid
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN covered USING (rid) LEFT JOIN listed USING (rid)
"""
