"""N-gram Jaccard self-join with PartEnum signatures."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bit_filter, in_filter, materialize, table
from .components import components
from .partenum import NAME, Bands, bucket_of, forest, names_of, shared, shingle_sets, signatures
from .wordhash import chunks, lists, longs

#: Signatures that one task of the signature shuffle gets.
BUCKET_SIGNATURES = 1_000_000
#: Owners up to which a signature's pairs are listed one by one.
FEW = 8
#: Sets and elements that one block of a cell holds.
BLOCK_SETS = 512
BLOCK_ELEMENTS = 256_000
#: Numbers that the ids of candidates are folded into; bounds what is sent to the tasks (1 MB of bits).
ID_BUCKETS = 1 << 23
#: Signatures that are packed at a time.
CHUNK_SIGNATURES = 250_000


def _names(x: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(16), len(x), [None, pa.py_buffer(np.ascontiguousarray(x))]).cast(pa.binary())


def _bytes_of(docs: DataFrame, text_col: str):
    return F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text")


def named_rows(docs: DataFrame, id_col: str, text_col: str, length: int) -> DataFrame:
    """doc_id, n_shingles, set_id: one row a document; set_id (128 bits) names its set of shingles, null for an empty set."""
    source = docs.select(F.col(id_col).alias("doc_id"), _bytes_of(docs, text_col))
    schema = T.StructType([source.schema["doc_id"], T.StructField("n_shingles", T.LongType()), T.StructField("set_id", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, end, data, offsets in chunks(batch.column("text")):
                elements, sizes = shingle_sets(data, offsets, length)
                full = np.flatnonzero(sizes)
                names = _names(names_of(elements, sizes[full])) if len(full) else pa.array([], pa.binary())
                place = np.full(len(sizes), -1)
                place[full] = np.arange(len(full))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, end - at), longs(sizes), names.take(pa.array(place, mask=place < 0))], schema.fieldNames())

    return source.mapInArrow(run, schema)


def signature_findings(docs: DataFrame, text_col: str, length: int, bands: Bands, buckets: int) -> DataFrame:
    """kind, a, b, tag, n, sig. pair: sets a < b share n signatures under a tag that few sets have; many: set a has signature sig, which many have, b first.

    Signatures travel packed, one row a bucket and chunk of texts; a bucket is one part of the hash
    range, so it is bounded whatever the text, and a single signature has a row a set and chunk at most."""
    source = docs.select(_bytes_of(docs, text_col))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sigs: list[np.ndarray] = []
        owners: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            s, o = np.concatenate(sigs), np.concatenate(owners)
            sigs.clear()
            owners.clear()
            names, o = np.unique(o, return_inverse=True)
            key = bucket_of(s, buckets) * len(names) + o
            order = np.argsort(key, kind="stable")
            s, key = s[order], key[order]
            run = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))  # one set's signatures in one bucket
            lengths = np.diff(np.append(run, len(key))).astype(np.uint32)
            at, o = np.divmod(key[run], len(names))
            cut = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
            ends = np.append(cut[1:], len(at))
            first = np.append(run, len(key))
            pack = lambda x, i, j: pa.array([x[a:b].tobytes() for a, b in zip(i, j, strict=True)], pa.binary())
            return pa.RecordBatch.from_arrays([longs(at[cut]), pack(s, first[cut], first[ends]), pack(names[o], cut, ends), pack(lengths, cut, ends)], ["bucket", "sigs", "owners", "lengths"])

        for batch in batches:
            for _, _, data, offsets in chunks(batch.column("text")):
                elements, sizes = shingle_sets(data, offsets, length)
                if not len(elements):
                    continue
                sizes = sizes[sizes > 0]
                names = names_of(elements, sizes)
                once = np.zeros(len(names), bool)
                once[np.unique(names, return_index=True)[1]] = True  # copies of other chunks meet in the bucket
                s, o, *_ = signatures(elements[np.repeat(once, sizes)], sizes[once], bands)
                sigs.append(s)
                owners.append(names[once][o])
                if sum(map(len, sigs)) > CHUNK_SIGNATURES:
                    yield flush()
        if sigs:
            yield flush()

    def reduce(packed: pa.Table) -> pa.Table:
        join = lambda name, kind: np.frombuffer(b"".join(x.as_py() for x in packed.column(name)), kind)
        names, which = np.unique(join("owners", NAME), return_inverse=True)
        owners = np.repeat(which, join("lengths", np.uint32))
        (a, b, tag, n), (owner, hub, its_tag, sig) = shared(join("sigs", np.uint64), owners, FEW)
        kinds = pa.DictionaryArray.from_arrays(pa.array(np.repeat([0, 1], [len(a), len(owner)])), ["pair", "many"]).cast(pa.string())
        both = lambda x, y: np.concatenate([x, y])
        ones, none = np.ones(len(owner), np.int64), np.zeros(len(a), np.int64)
        return pa.table({"kind": kinds, "a": _names(names[both(a, owner)]), "b": _names(names[both(b, hub)]), "tag": longs(both(tag, its_tag)), "n": longs(both(n, ones)), "sig": longs(both(none, sig))})

    packed = source.mapInArrow(emit, "bucket long, sigs binary, owners binary, lengths binary")
    return packed.groupBy("bucket").applyInArrow(reduce, "kind string, a binary, b binary, tag long, n long, sig long")


def candidate_sets(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str, length: int, bands: Bands) -> DataFrame:
    """set_id, elements, tags, common, hub of the wanted sets (set_id, doc_id of one document that has it, hub).

    Texts are read again, but shingled only where the folded id is a wanted one."""
    packed = bit_filter(wanted.select(F.xxhash64("doc_id")), ID_BUCKETS)
    source = docs.select(F.xxhash64(F.col(id_col)).alias("fold"), _bytes_of(docs, text_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = np.flatnonzero(in_filter(packed, batch.column("fold").to_numpy()))
            for _, _, data, offsets in chunks(batch.column("text").take(pa.array(hit))):
                elements, sizes = shingle_sets(data, offsets, length)
                if not len(elements):
                    continue
                sizes = sizes[sizes > 0]
                _, _, of, tags, common = signatures(elements, sizes, bands)
                order = np.argsort(of, kind="stable")
                n_tags = np.bincount(of, minlength=len(sizes))
                yield pa.RecordBatch.from_arrays([_names(names_of(elements, sizes)), lists(elements, sizes), lists(tags[order], n_tags), lists(common[order], n_tags)], ["set_id", "elements", "tags", "common"])

    found = source.mapInArrow(run, "set_id binary, elements array<long>, tags array<long>, common array<long>")
    return found.join(wanted.select("set_id", "hub"), "set_id").dropDuplicates(["set_id"])


def hub_links(sets: DataFrame, num: int, den: int) -> DataFrame:
    """left, right: the sets that are linked with the hub chosen for them. One comparison a set, by a join that can be split where a hub is frequent."""
    hubs = sets.select("hub").filter("hub IS NOT NULL").distinct()
    hubs = sets.select(F.col("set_id").alias("hub"), F.col("elements").alias("theirs")).join(hubs, "hub", "left_semi")
    hubs = materialize(hubs, "join-hub-sets")  # so the join's two sides are dealt for it alone
    pairs = sets.filter("hub IS NOT NULL").select("set_id", "hub", "elements").join(hubs, "hub")
    both = F.size(F.array_intersect("elements", "theirs"))
    pairs = pairs.select("set_id", "hub", both.alias("both"), (F.size("elements") + F.size("theirs")).alias("sum"))
    return pairs.filter(F.col("both") * den >= (F.col("sum") - F.col("both")) * num).select(F.col("hub").alias("left"), F.col("set_id").alias("right"))


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id.

    Two documents link when their sets of word shingles have den * |A & B| >= num * |A | B|;
    component_id is the smallest doc_id reachable by links. No link between different texts is lost:

    1. Documents with equal sets are one class from here on, so copies are never paired.
    2. PartEnum signatures of all sets meet in buckets of the hash range. A signature that few sets
       have gives their pairs, a number in proportion to its sets. A pair that shares fewer
       signatures than both sets have in common with any partner is no link, and is dropped.
    3. A signature that many sets have (a frequent passage) is dropped for every set that must have
       another signature in common with each of its partners. Where it cannot be dropped its owners
       stay candidates of each other.
    4. Every set is compared with one hub, the first owner of most of its signatures. Sets that are
       linked so are one group from here on: versions of one text are joined by a comparison each,
       and pairs within a group are no candidates any more.
    5. What is left, candidates of different groups, is cut into components and these into blocks
       of bounded size; every pair of blocks is a cell, a task that compares sets by exact
       intersection, skips what is already joined, and returns at most one link a set.
    6. Components of all links give component_id. Nothing but counts and bits of a fixed size passes through the driver.

    A text of fewer words than a shingle is one shingle; null and empty texts, and texts without
    words, have an empty set and are linked with nothing: their component is their own id. Rows
    that repeat an id or a text are linked (distance 0). Rows with null ids take part; a component of null ids only
    has a null component. Texts of any length are read whole, in slices. An empty table gives an empty result. Other columns are ignored.
    """
    bands = Bands(num, den)
    rows = materialize(named_rows(docs, id_col, text_col, shingle), "join-rows")
    classes = materialize(rows.filter("set_id IS NOT NULL").groupBy("set_id").agg(F.min("doc_id").alias("doc_id"), F.max("n_shingles").alias("n")), "join-classes")
    total = classes.agg(F.sum("n")).first()[0] or 0
    buckets = max(64, int(total * 0.6 / BUCKET_SIGNATURES))
    found = materialize(signature_findings(docs, text_col, shingle, bands, buckets), "join-findings")

    # The sets that have candidates, each with the hub that it shares most signatures with.
    pairs = found.filter("kind = 'pair'").groupBy("a", "b", "tag").agg(F.sum("n").alias("n"))
    pairs = materialize(pairs, "join-pairs")
    many = found.filter("kind = 'many'")
    votes = pairs.select(F.col("b").alias("set_id"), F.col("a").alias("hub"), "n").union(many.select("a", "b", "n"))
    votes = votes.groupBy("set_id", "hub").agg(F.sum("n").alias("n"))
    votes = votes.groupBy("set_id").agg(F.max_by(F.when(F.col("hub") != F.col("set_id"), F.col("hub")), F.struct(F.col("hub") != F.col("set_id"), "n", "hub")).alias("hub"))
    owners = votes.union(pairs.select("a", F.lit(None).cast("binary"))).groupBy("set_id").agg(F.max("hub").alias("hub"))
    wanted = materialize(classes.join(owners, "set_id").select("set_id", "doc_id", "n", "hub"), "join-wanted")
    sets = materialize(candidate_sets(docs, wanted, id_col, text_col, shingle, bands), "join-sets")
    first_links = materialize(hub_links(sets, num, den), "join-links")
    groups = components(first_links)
    groups = wanted.join(groups.select(F.col("node").alias("set_id"), "component"), "set_id", "left").select("set_id", "n", F.coalesce("component", "set_id").alias("label"))
    groups = materialize(groups, "join-groups")
    label = lambda of, out: groups.select(F.col("set_id").alias(of), F.col("label").alias(out))

    # Candidates of different groups.
    counted = many.groupBy("a", "tag").agg(F.count("*").alias("many"))
    least = sets.select(F.col("set_id").alias("a"), F.explode(F.arrays_zip("tags", "common")).alias("x")).select("a", F.col("x.tags").alias("tag"), F.col("x.common").alias("common"))
    least = least.join(counted, ["a", "tag"], "left").select("a", "tag", (F.col("common") - F.coalesce("many", F.lit(0))).alias("least"))
    least = materialize(least, "join-least")
    apart = pairs.join(label("a", "la"), "a").join(label("b", "lb"), "b").filter("la != lb").select("a", "b", "tag", "n")
    apart = apart.join(least.withColumnRenamed("least", "of_a"), ["a", "tag"]).join(least.select(F.col("a").alias("b"), "tag", F.col("least").alias("of_b")), ["b", "tag"])
    apart = apart.filter("n >= of_a AND n >= of_b").select(F.col("a").alias("left"), F.col("b").alias("right"))
    stuck = many.join(least.filter("least <= 0").select("a", "tag"), ["a", "tag"], "left_semi").select("a", "sig").join(label("a", "label"), "a")
    stuck = materialize(stuck, "join-many")
    hubs = stuck.groupBy("sig").agg(F.min("a").alias("hub"), F.min("label").alias("low"), F.max("label").alias("high")).filter("low != high").select("sig", "hub")
    stars = stuck.join(materialize(hubs, "join-hubs"), "sig").filter("a != hub").select(F.col("hub").alias("left"), F.col("a").alias("right")).distinct()
    near = components(apart.union(stars))

    near = near.join(groups.select(F.col("set_id").alias("node"), "n", "label"), "node")
    sizes = near.groupBy("component").agg(F.greatest(F.ceil(F.count("*") / BLOCK_SETS), F.ceil(F.sum("n") / BLOCK_ELEMENTS)).cast("int").alias("blocks"))
    sizes = materialize(sizes, "join-sizes")
    placed = near.join(sizes, "component").withColumn("block", F.pmod(F.xxhash64("node", F.lit("block")), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    cells = placed.select("node", "component", "label", "block", other).select("node", "component", "label", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    # A component of one block costs little; many of them share a task.
    cells = cells.join(sets.select(F.col("set_id").alias("node"), "elements"), "node")

    def compare(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        elements = rows.column("elements").combine_chunks()
        names = rows.column("node")
        links = []
        if len(names) > 1:
            labels = np.unique(np.array(rows.column("label").to_pylist(), object), return_inverse=True)[1]
            links = forest(elements.flatten().to_numpy().view(np.uint64), elements.value_lengths().to_numpy().astype(np.int64), labels, num, den)
        return pa.table({"left": names.take(pa.array([x for x, _ in links], pa.int64())), "right": names.take(pa.array([y for _, y in links], pa.int64()))})

    links = materialize(cells.groupBy("component", "i", "j").applyInArrow(compare, "left binary, right binary"), "join-links")
    joined = components(first_links.union(links))
    smallest = joined.join(classes.select(F.col("set_id").alias("node"), "doc_id"), "node").groupBy("component").agg(F.min("doc_id").alias("component_id"))
    smallest = joined.join(materialize(smallest, "join-smallest"), "component").select(F.col("node").alias("set_id"), "component_id")
    ids = classes.select("set_id", "doc_id").join(smallest, "set_id", "left").select("set_id", F.coalesce("component_id", "doc_id").alias("component_id"))
    ids = materialize(ids, "join-ids")  # so the join's two sides are dealt for it alone
    with_words = rows.filter("set_id IS NOT NULL").join(ids, "set_id").select("doc_id", "n_shingles", "component_id")
    without = rows.filter("set_id IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return with_words.unionByName(without)


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents"))


OP7_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, row_number() OVER () AS rid,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), s AS (
  SELECT DISTINCT rid, n, array_to_string(w[i + 1 : i + n], ' ') AS shingle
  FROM (SELECT rid, w, least(5, len(w)) AS n, unnest(range(0, len(w) - least(5, len(w)) + 1)) AS i FROM d WHERE len(w) > 0)
), size AS (SELECT rid, count(*) AS n FROM s GROUP BY rid
), link AS (
  SELECT a.rid AS l, b.rid AS r
  FROM (SELECT a.rid AS l, b.rid AS r, count(*) AS n FROM s a JOIN s b ON a.shingle = b.shingle AND a.n = b.n AND a.rid <> b.rid GROUP BY ALL) x
  JOIN size a ON a.rid = l JOIN size b ON b.rid = r WHERE 100 * x.n >= 80 * (a.n + b.n - x.n)
), reach AS (SELECT rid AS l, rid AS r FROM d UNION SELECT reach.l, link.r FROM reach JOIN link ON reach.r = link.l
)
SELECT d.doc_id, coalesce(any_value(size.n), 0)::BIGINT AS n_shingles, min(o.doc_id) AS component_id
FROM d LEFT JOIN size USING (rid) JOIN reach ON reach.l = d.rid JOIN d o ON o.rid = reach.r GROUP BY d.rid, d.doc_id
"""
