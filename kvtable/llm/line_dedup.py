"""Line deduplication by content-defined chunks of lines."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, table

#: A boundary follows where the rolling hash over this many line hashes is 0 modulo DIVISOR.
ROLLING = 2
DIVISOR = 2
MASK = (1 << 64) - 1
FACTOR = 0x9E3779B97F4A7C15
#: Numbers that hashes of repeated chunks are folded into; bounds what is sent to the tasks (128 KB of bits).
BUCKETS = 1 << 20


class Chunker:
    """Cuts texts into chunks of whole lines. Only a chunk that counts may be removed: one of at least long_words words, or of several lines and at least few_words words."""

    def __init__(self, long_words: int, few_words: int):
        self.long_words, self.few_words = long_words, few_words

    def cut(self, lines: list[bytes]) -> list[tuple[int, int, int]]:
        """(first line, line after the last, words) of each chunk.

        A boundary depends on the lines just before it, and on whether the chunk has few_words words
        yet, so an insertion shifts only the boundaries that follow closely. A line of long_words
        words is a chunk of its own."""
        words = [len(x.split()) for x in lines]
        out = []
        first = total = before = 0
        for i, line in enumerate(lines):
            h = xxhash.xxh3_64_intdigest(line)
            rolling = (before * FACTOR + h) & MASK if i >= ROLLING - 1 else h
            before = h
            total += words[i]
            long_next = i + 1 < len(lines) and words[i + 1] >= self.long_words
            here = total >= self.few_words and (rolling >> 32) % DIVISOR == 0
            if here or words[i] >= self.long_words or long_next or i + 1 == len(lines):
                out.append((first, i + 1, total))
                first, total = i + 1, 0
        return out

    def counts(self, chunk: tuple[int, int, int]) -> bool:
        first, end, words = chunk
        return words >= self.long_words or (end - first > 1 and words >= self.few_words)

    def units(self, lines: list[bytes]) -> list[tuple[int, int, int]]:
        """What may be removed: (first line, line after the last, words)."""
        return [c for c in self.cut(lines) if self.counts(c)]


class Passages(Chunker):
    """Chunks are lines of long_words words and the runs of shorter lines between them, so a boundary depends on its two lines alone.

    What may be removed are the long lines and, within each run, all passages of two lines or more
    with few_words words that are the shortest from their first line on or up to their last line.
    They depend on nothing outside themselves, and every line of any longer passage of the run lies
    in one of them, so a repeated passage is found whole wherever it stands."""

    def cut(self, lines: list[bytes]) -> list[tuple[int, int, int]]:
        words = [len(x.split()) for x in lines]
        out = []
        first = total = 0
        for i, n in enumerate(words):
            total += n
            if i + 1 == len(lines) or n >= self.long_words or words[i + 1] >= self.long_words:
                out.append((first, i + 1, total))
                first, total = i + 1, 0
        return out

    def units(self, lines: list[bytes]) -> list[tuple[int, int, int]]:
        out = []
        for first, end, total in self.cut(lines):
            if end - first == 1:
                if total >= self.long_words:
                    out.append((first, end, total))
            elif total >= self.few_words:
                sums = [0]
                for line in lines[first:end]:
                    sums.append(sums[-1] + len(line.split()))
                n, found = end - first, set()
                j = 2
                for i in range(n - 1):  # the shortest from line i on
                    j = max(j, i + 2)
                    while j < n and sums[j] - sums[i] < self.few_words:
                        j += 1
                    if sums[j] - sums[i] < self.few_words:
                        break
                    found.add((i, j))
                i = 0
                for j in range(2, n + 1):  # the shortest up to line j
                    while i + 2 < j and sums[j] - sums[i + 1] >= self.few_words:
                        i += 1
                    if sums[j] - sums[i] >= self.few_words:
                        found.add((i, j))
                out += [(first + i, first + j, sums[j] - sums[i]) for i, j in sorted(found)]
        return out


def _hash(chunk: bytes) -> int:
    h = xxhash.xxh3_64_intdigest(chunk)
    return h - (1 << 64) if h >> 63 else h


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", long_words: int = 25, few_words: int = 10, passages: bool = False) -> DataFrame:
    """One row per row of docs: row (the whole input row), doc_id, text (what is left), n_chunks, n_removed, words_removed.

    1. Texts are cut into content-defined chunks of lines; chunks that count are counted by a
       64-bit hash over the whole corpus, with partial aggregates. With passages, all short passages
       of the text stand in place of chunks (see Passages), and a line goes if it lies in one that
       occurs earlier; every line that goes has an equal one that stays.
    2. Hashes that occur again are folded into at most BUCKETS numbers, sent to the tasks as bits.
       Only chunks that these do not rule out are written with their bytes.
    3. Chunks are grouped by hash and bytes (the byte comparison). The first occurrence, by id and
       place, stays; all others are removed. The chunks are matched with their group by an
       equi-join, which adaptive execution splits where one chunk is very frequent.
    4. Texts meet the list of their removed chunks and are put together without their lines;
       n_removed counts the chunks that lose lines.

    Null text stays null and is never a copy; empty text stays empty. Lines are what '\\n' separates;
    chunks compare by bytes. Rows that repeat an id and a text are the same document, so both keep
    what one keeps. Null ids come first. Very long texts are cut like any other; an empty table gives an empty result. Extra
    columns are kept inside row, whatever their names.
    """
    chunker = (Passages if passages else Chunker)(long_words, few_words)
    text = F.col(text_col).cast("string")
    base = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("doc_id"), F.xxhash64(F.col(id_col), text).alias("key1"), F.xxhash64(F.lit(1), F.col(id_col), text).alias("key2"))
    text_of_row = F.col("row")[text_col].cast("string").cast("binary").alias("text")
    keys = ["key1", "key2"]

    def count_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for value in batch.column("text"):
                if raw := value.as_py():
                    lines = raw.split(b"\n")
                    found += [_hash(b"\n".join(lines[c[0] : c[1]])) for c in chunker.units(lines)]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64())], ["hash"])

    hashes = base.select(text_of_row).mapInArrow(count_chunks, "hash long")
    again = hashes.groupBy("hash").count().filter("count > 1").select(F.pmod("hash", F.lit(BUCKETS)).cast("int").alias("bucket")).distinct()
    bits = np.zeros(BUCKETS, bool)
    bits[[r["bucket"] for r in again.collect()]] = True  # at most BUCKETS rows
    packed = np.packbits(bits)

    narrow = base.select("doc_id", *keys, text_of_row)
    schema = T.StructType([*narrow.schema.fields[:-1], T.StructField("at", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("hash", T.LongType()), T.StructField("chunk", T.BinaryType())])

    def suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(packed).astype(bool)
        for batch in batches:
            rows, at, ends, hashes, chunks = [], [], [], [], []
            for i, value in enumerate(batch.column("text")):
                if raw := value.as_py():
                    lines = raw.split(b"\n")
                    for first, end, _ in chunker.units(lines):
                        chunk = b"\n".join(lines[first:end])
                        h = _hash(chunk)
                        if bits[h % BUCKETS]:
                            rows.append(i)
                            at.append(first)
                            ends.append(end)
                            hashes.append(h)
                            chunks.append(chunk)
            take = pa.array(rows, pa.int64())
            kept = [batch.column(i).take(take) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(at, pa.int32()), pa.array(ends, pa.int32()), pa.array(hashes, pa.int64()), pa.array(chunks, pa.binary())], schema.fieldNames())

    found = materialize(narrow.mapInArrow(suspects, schema), "line-chunks")
    place = F.struct("doc_id", *keys, "at")
    groups = found.groupBy("hash", "chunk").agg(F.count("*").alias("n"), F.min(place).alias("first")).filter("n > 1")
    groups = materialize(groups, "line-groups")  # so the join's two sides are dealt for it alone
    same = (found["hash"] == groups["hash"]) & (found["chunk"] == groups["chunk"])
    removed = found.join(groups, same).filter(place != F.col("first")).select(*keys, "at", "end")
    removed = removed.groupBy(*keys).agg(F.collect_set(F.struct("at", "end")).alias("gone"))
    removed = removed.select(*keys, F.col("gone.at").alias("at"), F.col("gone.end").alias("end"))

    place_in_row = docs.columns.index(text_col) if docs.schema[text_col].dataType == T.StringType() else None  # then the row has the text, which travels once
    joined = base.join(removed, keys, "left").select("row", "doc_id", "at", "end", *([text_of_row] if place_in_row is None else []))
    out = T.StructType([*joined.schema.fields[:2], T.StructField("text", T.StringType()), *(T.StructField(x, T.LongType()) for x in ("n_chunks", "n_removed", "words_removed"))])

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, n_chunks, n_removed, words_removed = [], [], [], []
            column = batch.column(4) if place_in_row is None else batch.column(0).field(place_in_row).cast(pa.binary())
            for value, at, end in zip(column, batch.column("at").to_pylist(), batch.column("end").to_pylist(), strict=True):
                raw = value.as_py()
                lines = raw.split(b"\n") if raw else []
                cut = chunker.cut(lines)
                drop = {i for a, b in zip(at or (), end or (), strict=True) for i in range(a, b)}
                if drop:
                    raw = b"\n".join(x for i, x in enumerate(lines) if i not in drop)
                texts.append(raw)
                n_chunks.append(len(cut))
                n_removed.append(sum(not drop.isdisjoint(range(c[0], c[1])) for c in cut) if drop else 0)
                words_removed.append(sum(len(lines[i].split()) for i in drop))
            strings = pa.array(texts, pa.binary()).cast(pa.string())
            counts = [pa.array(x, pa.int64()) for x in (n_chunks, n_removed, words_removed)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), strings, *counts], out.fieldNames())

    return joined.mapInArrow(rebuild, out)


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup(docs, passages=True).select("doc_id", "text", "n_chunks", "n_removed", "words_removed")
