"""Quality classifier: a byte-level convolutional network in numpy.

Every byte of a document is embedded; learned filters run over overlapping chunks (CHUNK bytes,
one chunk every STRIDE bytes) that cover the whole document; the largest response of each filter
is kept (max-pooling) and a logistic unit combines those into one probability.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import is_training, materialize, table

STRIDE = 8
CHUNK = 2 * STRIDE
EMBEDDED = 8
FILTERS = 32
SHAPES = {"embedding": (256, EMBEDDED), "filters": (CHUNK * EMBEDDED, FILTERS), "bias": (FILTERS,), "weights": (FILTERS,), "offset": (1,)}
SIZES = {k: int(np.prod(s)) for k, s in SHAPES.items()}
#: Bytes that one forward pass takes at a time (or one document, if that is longer).
STEP_BYTES = 1 << 18
Model = dict[str, np.ndarray]


def initial(seed: int) -> Model:
    rng = np.random.default_rng(seed)
    scale = {"embedding": 0.5, "filters": 1 / np.sqrt(CHUNK * EMBEDDED / 2), "bias": 0.0, "weights": 0.3, "offset": 0.0}
    return {k: (rng.standard_normal(s) * scale[k]).astype(np.float32) for k, s in SHAPES.items()}


def pack(model: Model) -> list[float]:
    return np.concatenate([model[k].ravel() for k in SHAPES]).tolist()


def unpack(flat) -> Model:
    parts = np.split(np.asarray(flat, np.float32), np.cumsum(list(SIZES.values()))[:-1])
    return {k: p.reshape(s).copy() for (k, s), p in zip(SHAPES.items(), parts, strict=True)}


def padded(text: bytes) -> bytes:
    """At least one chunk, and a whole number of strides."""
    return text.ljust(max(CHUNK, -(-len(text) // STRIDE) * STRIDE), b"\0")


def forward(texts: list[bytes], model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, filter responses by chunk, first chunk of each text, pooled responses by text."""
    blocks = [padded(t) for t in texts]
    codes = np.frombuffer(b"".join(blocks), np.uint8)
    x = model["embedding"][codes].reshape(-1, STRIDE * EMBEDDED)
    halves = model["filters"].reshape(2, STRIDE * EMBEDDED, FILTERS)
    response = x @ halves[0]
    response[:-1] += (x @ halves[1])[1:]
    ends = np.cumsum([len(b) // STRIDE for b in blocks])
    response[ends - 1] = -np.inf  # a chunk must not reach into the next text
    starts = np.concatenate([[0], ends[:-1]])
    pooled = np.maximum(np.maximum.reduceat(response, starts, axis=0) + model["bias"], 0)
    return codes, response, starts, pooled


def probability(pooled: np.ndarray, model: Model) -> np.ndarray:
    return 1 / (1 + np.exp(-(pooled @ model["weights"] + model["offset"][0]).astype(np.float64)))


def scores(texts: list[bytes], model: Model) -> list[float]:
    out: list[float] = []
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (size == 0 or size + len(texts[end]) <= STEP_BYTES):
            size += max(CHUNK, len(texts[end]))
            end += 1
        out += probability(forward(texts[at:end], model)[3], model).tolist()
        at = end
    return out


def gradient(texts: list[bytes], labels: np.ndarray, model: Model) -> Model:
    """Of the mean log loss. Only the chunks that win the pooling pass it on."""
    codes, response, starts, pooled = forward(texts, model)
    n = len(texts)
    error = ((probability(pooled, model) - labels) / n).astype(np.float32)
    back = np.outer(error, model["weights"]) * (pooled > 0)
    bounds = [*starts[1:], len(response)]
    winner = np.array([s + response[s:e].argmax(axis=0) for s, e in zip(starts, bounds, strict=True)])
    span = (winner * STRIDE)[:, :, None] + np.arange(CHUNK)  # text, filter, byte
    chunk_codes = codes[span]
    chunks = model["embedding"][chunk_codes].reshape(n, FILTERS, CHUNK * EMBEDDED)
    out = {"weights": error @ pooled, "offset": error.sum(keepdims=True), "bias": back.sum(axis=0), "filters": np.einsum("tf,tfd->df", back, chunks)}
    to_bytes = (back[:, :, None] * model["filters"].T[None]).reshape(-1, EMBEDDED)
    out["embedding"] = np.stack([np.bincount(chunk_codes.ravel(), to_bytes[:, i], 256) for i in range(EMBEDDED)], axis=1)
    return out


def descend(texts: list[bytes], labels: np.ndarray, model: Model, epochs: int, batch: int = 32, rate: float = 5e-3, seed: int = 0) -> Model:
    """Adam over mini-batches."""
    rng = np.random.default_rng(seed)
    model = {k: v.copy() for k, v in model.items()}
    first, second = ({k: np.zeros_like(v) for k, v in model.items()} for _ in range(2))
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(texts))
        for at in range(0, len(order), batch):
            own = order[at : at + batch]
            step += 1
            for k, g in gradient([texts[i] for i in own], labels[own], model).items():
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.01 * (g * g - second[k])
                model[k] -= (rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
    return model


def fit(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    sample_rows: int = 4000,
    shards: int = 4,
    rounds: int = 6,
    epochs: int = 2,
    seed: int = 7,
) -> Model | None:
    """Fits the network on about sample_rows whole labelled documents, chosen by a hash of the id.

    The sample is dealt to ``shards`` groups; in each round every group descends from the common
    model in a task of its own, and the models are averaged. None where no labelled row exists.
    """
    marked = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("label")).filter("label IN (0, 1) AND doc_id IS NOT NULL")
    total = marked.count()
    if not total:
        return None
    unit = F.pmod(F.xxhash64("doc_id", F.lit("quality sample")), F.lit(1_000_000)) / 1_000_000
    marked = marked.filter(unit < min(1.0, sample_rows / total))  # about sample_rows, so the broadcast is bounded
    sample = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"))
    sample = sample.join(F.broadcast(marked), "doc_id").withColumn("shard", F.pmod(F.xxhash64("doc_id", F.lit("quality shard")), F.lit(shards)))
    sample = materialize(sample, "quality-sample")
    model = initial(seed)
    for i in range(rounds):
        now = pack(model)

        def train(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
            rows = rows.sort_values(["doc_id", "label"])
            own = descend(rows["text"].tolist(), rows["label"].to_numpy(np.float32), unpack(now), epochs, rate=5e-3 / (1 + i), seed=seed + i)
            return pd.DataFrame({"shard": [key[0]], "n": [len(rows)], "model": [pack(own)]})

        found = sample.groupBy("shard").applyInPandas(train, "shard long, n long, model array<float>").orderBy("shard").collect()  # one row a shard
        if not found:
            return None
        model = unpack(np.average([r["model"] for r in found], axis=0, weights=[r["n"] for r in found]))
    return model


def score(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, score. A map over the scan, without a shuffle.

    Null text counts as empty; empty and very short texts are padded to one chunk and scored like
    any other. Texts of any length are read whole. Repeated rows each give a row; other columns are
    ignored. Without a model (no labels) every score is 0.5.
    """
    source = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"))
    if model is None:
        return source.select("doc_id", F.lit(0.5).alias("score"))
    flat = pack(model)
    schema = T.StructType([source.schema["doc_id"], T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = unpack(flat)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores(batch.column("text").to_pylist(), own), pa.float64())], schema.fieldNames())

    return source.mapInArrow(run, schema)


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    training = is_training(F.col("doc_id"))
    model = fit(docs.filter(training), table(spark, sf_dir, "labels").filter(training))
    scored = score(docs, model)
    held_out = F.coalesce(~training, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
