"""Mixing sources to target weights: packed blocks, multinomial shards, permuted block indexes."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, table

#: Weights of the sources in order of their names, repeating.
WEIGHTS = (3, 1, 2)
SPACES = " \t\n\x0b\x0c\r"


def words_of(text: Column) -> Column:
    """The maximal runs of characters other than space and U+0009 to U+000D, for a text that has one."""
    return F.split(F.btrim(text, F.lit(SPACES)), r"[\x20\x09-\x0D]+")


def count_words(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.when(F.coalesce(F.btrim(text, F.lit(SPACES)), F.lit("")) == "", F.lit(0)).otherwise(F.size(words_of(text))).cast("long")


def let(value: Column, use) -> Column:
    """use(value), with the value computed once."""
    return F.transform(F.array(value), use)[0]


def grid(n: int) -> tuple[int, int]:
    """Sides a, b of a grid of at least n cells with few spare ones, neither side far above sqrt(n)."""
    high = max(1, math.isqrt(n))
    sides = np.arange(max(1, high // 4, high - (1 << 20)), high + 1)
    a = int(sides[-1 - int(np.argmin((-n % sides)[::-1]))])
    return a, max(1, -(-n // a))


def permuted(df: DataFrame, out: str, index: Column, n: Column, *key: Column, sides: tuple[Column, Column] | None = None) -> DataFrame:
    """Adds a column: a pseudorandom permutation of 0..n-1, chosen by the key, at one index.

    A Feistel network over a grid of at least n cells (sides: its two sides, as from grid): each
    half in turn is shifted, modulo its side, by a hash of the other, so the network permutes the
    cells. A cell from n on is sent through again until it falls below n (cycle walking). A walk meets each
    spare cell once at most, so as many steps as there are spare cells always suffice; they are taken
    only by the indexes that walk, of which there are no more than spare cells.

    The first pass is a chain of plain columns; only walks use higher-order functions.
    """
    rounds = range(4)
    shift = lambda i, half: F.xxhash64(*key, F.lit(i), half)
    names = [f"__{x}" for x in ("n", "a", "b", "left", "right", "cell")]
    n_, a, b, left, right, cell = map(F.col, names)
    df = df.withColumn("__n", n)
    df = df.withColumn("__a", sides[0] if sides else F.greatest(F.ceil(F.sqrt(n_.cast("double"))).cast("long"), F.lit(1)))
    df = df.withColumn("__b", sides[1] if sides else F.greatest(F.ceil(n_ / a).cast("long"), F.lit(1)))
    df = df.withColumns({"__left": F.floor(index / b).cast("long"), "__right": F.pmod(index, b)})
    for i in rounds:
        df = df.withColumn("__left", F.pmod(left + F.pmod(shift(2 * i, right), a), a))
        df = df.withColumn("__right", F.pmod(right + F.pmod(shift(2 * i + 1, left), b), b))
    df = df.withColumn("__cell", left * b + right)

    def round_(i: int):
        # A factory, as a second parameter of a lambda would be taken for the array index.
        return lambda s: let(
            F.pmod(s["l"] + F.pmod(shift(2 * i, s["r"]), a), a), lambda q: F.struct(q.alias("l"), F.pmod(s["r"] + F.pmod(shift(2 * i + 1, q), b), b).alias("r"))
        )

    def through(x: Column) -> Column:
        step = F.struct(F.floor(x / b).cast("long").alias("l"), F.pmod(x, b).alias("r"))
        for i in rounds:
            step = let(step, round_(i))
        return let(step, lambda s: s["l"] * b + s["r"])

    walk = F.aggregate(F.sequence(F.lit(1).cast("long"), F.greatest(a * b - n_, F.lit(1))), cell, lambda x, _: F.when(x < n_, x).otherwise(through(x)))
    return df.withColumn(out, F.when(cell < n_, cell).otherwise(walk)).drop(*names)


def alias_table(weights: list[int]) -> list[tuple[int, float, int]]:
    """(column, probability, other): a uniform column, kept with its probability and else changed for the other, is a draw by weight."""
    n, total = len(weights), sum(weights)
    scaled = [w * n / total for w in weights]
    low, high = [i for i in range(n) if scaled[i] < 1], [i for i in range(n) if scaled[i] >= 1]
    out = [(i, 1.0, i) for i in range(n)]
    while low and high:
        i, j = low.pop(), high[-1]
        out[i] = (i, scaled[i], j)
        scaled[j] -= 1 - scaled[i]
        if scaled[j] < 1:
            low.append(high.pop())
    return out


@dataclass
class Mix:
    """sources: source, sid, source_size, target, words, blocks, slots. placed: one row a document, with its place in its source.

    draws: shard, sid, first, n: how many slots each shard drew of each source, and the index of the first.
    slots: one row a slot of the mix: shard, sid, slot, block, part (words that are taken of the block; null: all).
    spans: one row for each document's part of a slot: shard, sid, slot, block, left (its place in the block), start (the
    document's place in its source), n (its words).
    mixed: the mix itself, one row a slot: shard, sid, source, slot, block, text (the block's words, one space between
    each two) and pieces (left, start, doc_id, text), the parts of the text by the document that they come from.
    Write it with partitionBy("shard") for one folder a shard.
    taken: one row a document, with the number of its words in all spans."""

    sources: DataFrame
    placed: DataFrame
    draws: DataFrame
    slots: DataFrame
    spans: DataFrame
    mixed: DataFrame
    taken: DataFrame


def targets(sizes: list[int], share: float, most: float, weights: list[float]) -> list[float]:
    """Shares share * sum(sizes) by weight; none above most * size, the excess shared anew among the others by weight."""
    out = [0.0] * len(sizes)
    left, open_ = share * sum(sizes), list(range(len(sizes)))
    while open_:
        unit = left / sum(weights[i] for i in open_)
        full = [i for i in open_ if unit * weights[i] > most * sizes[i]]
        if not full:
            for i in open_:
                out[i] = unit * weights[i]
            break
        for i in full:
            out[i] = float(most * sizes[i])
            left -= out[i]
            open_.remove(i)
    return out


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[float, ...] = WEIGHTS,
    share: float = 1.5,
    most: float = 2,
    block_words: int = 64,
    shard_slots: int = 4096,
    seed: int = 11,
) -> Mix:
    """Mixes whole sources: every source gives round(target) words, a document at most ``most`` times its size.

    * Words are packed: documents stand one after the other within their source, in an order of a
      hash of the id, and the source is cut into blocks of block_words (its last block is shorter).
      Places come from a two-level prefix sum, over (source, hash bucket) and within each bucket,
      so a source with a third of all rows is no single task.
    * Every output shard draws the sources of its shard_slots slots by weight, so its source counts
      are a multinomial draw. A source's slots are numbered through the shards by a prefix sum; what
      the draws gave it beyond its target is cut, and what they left short stands in shards at the end, so that totals hold.
    * A source's slots go through its blocks in a pseudorandom order, another one in each epoch;
      the short block ends the epoch, and the last slot takes only the words still missing, so that
      each source's words are its target to within one word.
    * Slots and blocks are joined by block index: spans say which words of which document stand in
      each slot, mixed has the texts, and what a document gives is the sum of its spans.

    Only the sources' sizes (one row a source) pass through the driver. Null sources are a source of
    their own, last in order; documents of no words are taken 0 times; repeated rows each count; very long texts are cut
    like any other; other columns are ignored; an empty table gives empty results. Reruns agree.
    """
    spark = docs.sparkSession
    text = F.col(text_col).cast("string")
    whole_docs = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), count_words(text).alias("size"), text.alias("text"))
    sized = materialize(whole_docs.drop("text"), "mix-sizes")
    found = sized.groupBy("source").agg(F.sum("size").alias("n"), F.count("*").alias("rows")).collect()  # one row a source
    found.sort(key=lambda r: (r["source"] is None, (r["source"] or "").encode()))
    aims = targets([r["n"] for r in found], share, most, [weights[i % len(weights)] for i in range(len(found))])
    plan = []
    for sid, (r, aim) in enumerate(zip(found, aims, strict=True)):
        size = r["n"]
        words = min(round(aim), int(most * size))
        blocks = -(-size // block_words)
        epochs, rest = divmod(words, size) if size else (0, 0)
        plan.append((sid, r["source"], size, aim, words, blocks, epochs * blocks + -(-rest // block_words), epochs, rest, *grid(max(1, blocks - 1))))
    sources = spark.createDataFrame(plan, "sid int, source string, source_size long, target double, words long, blocks long, slots long, epochs long, rest long, a long, b long")

    # Places of the documents within their sources.
    buckets = max(1, min(1 << 16, sum(r["rows"] for r in found) // 256))
    names = F.broadcast(sources.select("sid", F.col("source").alias("name")))

    def dealt(docs: DataFrame) -> DataFrame:
        rows = docs.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "size"), F.lit(buckets)))
        return rows.join(names, F.col("source").eqNullSafe(F.col("name"))).drop("name", "source")

    before = Window.partitionBy("sid").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = dealt(sized).groupBy("sid", "bucket").agg(F.sum("size").alias("n")).withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")

    def place(docs: DataFrame, *ties: Column) -> DataFrame:
        """Adds start. Documents of one id and size may stand in any order unless ties tell them apart."""
        within = Window.partitionBy("sid", "bucket").orderBy("doc_id", "size", *ties).rowsBetween(Window.unboundedPreceding, -1)
        rows = dealt(docs).withColumn("inside", F.coalesce(F.sum("size").over(within), F.lit(0))).join(bases, ["sid", "bucket"])
        return rows.withColumn("start", F.col("base") + F.col("inside")).drop("base", "inside", "bucket")

    placed = place(sized).select("doc_id", "sid", "size", "start")

    # Every shard draws its sources, a slot at a time; rows of counts are what goes on.
    total = sum(p[6] for p in plan)
    shards = -(-total // shard_slots)
    tasks = max(1, min(1 << 14, total // (8 * shard_slots)))  # a number: rows this small would all be put in one task
    chances = F.broadcast(spark.createDataFrame(alias_table([p[6] for p in plan]) if total else [], "column long, chance double, other long"))
    draws = spark.range(0, shards, 1, tasks).select(F.col("id").alias("shard"), F.explode(F.sequence(F.lit(0).cast("long"), F.least(F.lit(shard_slots), F.lit(total) - F.col("id") * shard_slots) - 1)).alias("at"))
    unit = lambda what: F.xxhash64(F.lit(seed), F.lit(what), "shard", "at")
    draws = draws.withColumn("column", F.pmod(unit("column"), F.lit(max(1, len(plan))))).join(chances, "column")
    draws = draws.select("shard", F.when(F.pmod(unit("coin"), F.lit(1 << 30)) / (1 << 30) < F.col("chance"), F.col("column")).otherwise(F.col("other")).cast("int").alias("sid"))
    draws = materialize(draws.groupBy("shard", "sid").agg(F.count("*").alias("n")), "mix-draws")
    band = F.floor(F.col("shard") / max(64, -(-shards // 65_536)))
    drawn = draws.withColumn("band", band)
    by_band = Window.partitionBy("sid").orderBy("band").rowsBetween(Window.unboundedPreceding, -1)
    in_band = Window.partitionBy("sid", "band").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    band_sums = drawn.groupBy("sid", "band").agg(F.sum("n").alias("of_band")).withColumn("before", F.coalesce(F.sum("of_band").over(by_band), F.lit(0))).drop("of_band")
    drawn = drawn.withColumn("inside", F.coalesce(F.sum("n").over(in_band), F.lit(0))).join(band_sums, ["sid", "band"])
    drawn = drawn.select("shard", "sid", (F.col("before") + F.col("inside")).alias("first"), "n")
    got = {r["sid"]: r["n"] for r in draws.groupBy("sid").agg(F.sum("n").alias("n")).collect()}  # one row a source
    short, at = [], shards * shard_slots
    for p in plan:
        first = got.get(p[0], 0)
        while first < p[6]:
            n = min(p[6] - first, shard_slots - at % shard_slots)
            short.append((at // shard_slots, p[0], first, n))
            first, at = first + n, at + n
    drawn = drawn.unionByName(spark.createDataFrame(short, "shard long, sid int, first long, n long"))
    # The sources carry no broadcast hint here, as what is derived from them would inherit it.
    limits = sources.select("sid", "slots", "blocks", "epochs", "rest", "a", "b")
    drawn = drawn.join(limits, "sid").withColumn("n", F.least("n", F.col("slots") - F.col("first"))).filter("n > 0")
    drawn = drawn.repartition(tasks, "sid", "shard")
    slots = drawn.select("*", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1)).alias("slot"))
    slots = slots.withColumns({"epoch": F.floor(F.col("slot") / F.col("blocks")), "index": F.pmod("slot", F.col("blocks"))})
    whole = F.col("blocks") - 1
    slots = permuted(slots, "mixed", F.least(F.col("index"), F.greatest(whole - 1, F.lit(0))), F.greatest(whole, F.lit(1)), F.lit(seed), F.col("sid"), F.col("epoch"), sides=(F.col("a"), F.col("b")))
    slots = slots.select(
        "sid",
        "slot",
        "shard",
        F.when(F.col("index") == whole, whole).otherwise(F.col("mixed")).alias("block"),
        F.when((F.col("epoch") == F.col("epochs")) & (F.col("index") == F.floor(F.col("rest") / block_words)), F.pmod("rest", F.lit(block_words))).alias("part"),
    )

    # Which words of which document stand in each block, and so in each slot.
    start, end = F.col("start"), F.col("start") + F.col("size")
    last = F.floor((end - 1) / block_words)
    within = placed.filter("size > 0").select("sid", "start", "size", F.explode(F.sequence(F.floor(start / block_words), last)).alias("block"))
    left = F.greatest(start - F.col("block") * block_words, F.lit(0))
    within = within.select("sid", "block", "start", left.alias("left"), (F.least(end - F.col("block") * block_words, F.lit(block_words)) - left).alias("n"))
    # The estimate of the slots' size comes from the few rows of the sources, so the join must be told not to broadcast them.
    spans = within.join(slots.hint("merge"), ["sid", "block"]).withColumn("n", F.least("n", F.coalesce(F.col("part") - F.col("left"), F.col("n"))))
    spans = spans.filter("n > 0").select("shard", "sid", "slot", "block", "left", "start", "n")

    # The documents' words, cut at the ends of blocks and put together by block.
    def cut(words: Column):
        def piece(block: Column) -> Column:
            left = F.greatest(start - block * block_words, F.lit(0))
            n = F.least(end - block * block_words, F.lit(block_words)) - left
            own = F.slice(words, (F.greatest(block * block_words - start, F.lit(0)) + 1).cast("int"), n.cast("int"))
            return F.struct(block.alias("block"), left.alias("left"), start.alias("start"), F.col("doc_id").alias("doc_id"), F.array_join(own, " ").alias("text"))

        return F.transform(F.sequence(F.floor(start / block_words), last), piece)

    pieces = place(whole_docs.filter("size > 0"), F.xxhash64("text"), F.col("text"))
    pieces = pieces.select("sid", F.explode(let(words_of(F.col("text")), cut)).alias("piece"))
    pieces = pieces.select("sid", "piece.block", F.struct("piece.left", "piece.start", "piece.doc_id", "piece.text").alias("piece"))
    blocks = pieces.groupBy("sid", "block").agg(F.array_sort(F.collect_list("piece")).alias("pieces"))  # at most block_words pieces

    # Every slot gets its block; the last one of a source only the words still missing.
    first_words = lambda p: F.struct(
        p["left"].alias("left"), p["start"].alias("start"), p["doc_id"].alias("doc_id"), F.call_function("substring_index", p["text"], F.lit(" "), (F.col("part") - p["left"]).cast("int")).alias("text")
    )
    taken_pieces = F.when(F.col("part").isNull(), F.col("pieces")).otherwise(F.transform(F.filter("pieces", lambda p: p["left"] < F.col("part")), first_words))
    filled = blocks.join(slots.hint("merge"), ["sid", "block"]).select("shard", "sid", "slot", "block", taken_pieces.alias("pieces"))
    mixed = filled.join(F.broadcast(sources.select("sid", "source")), "sid").select("shard", "sid", "source", "slot", "block", F.array_join(F.col("pieces.text"), " ").alias("text"), "pieces")

    given = spans.groupBy("sid", "start").agg(F.sum("n").alias("taken"))
    taken = placed.filter("size > 0").join(given, ["sid", "start"], "left").withColumn("taken", F.coalesce("taken", F.lit(0).cast("long")))
    nothing = placed.filter("size = 0").withColumn("taken", F.lit(0).cast("long"))
    taken = taken.unionByName(nothing).join(F.broadcast(sources), "sid").select("doc_id", "source", "size", "source_size", "target", "taken")
    return Mix(sources, placed, drawn.select("shard", "sid", "first", "n"), slots, spans, mixed, taken)


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).taken.select("doc_id", "size", "source_size", "target", "taken")
