"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()

#: Regular expressions of the two kinds of words, as Java and Python both read them.
SPACED_WORD = r"[^\x20\x09-\x0D]+"
PLAIN_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
PLAIN_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only. Pure ASCII text (as many bytes as characters) takes the fast built-in."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where it is unset, a temporary one in local mode (tests), and an error on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="kvtable-checkpoints-"))
        found = spark.sparkContext.getCheckpointDir()
    return found


def removed_at_exit(spark: SparkSession, path: str) -> str:
    """The path, which is deleted when the session's JVM ends."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cuts lineage: writes the rows as a table in the shared folder and reads them back.

    The table survives lost executors. It is removed when the session's JVM ends."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(removed_at_exit(df.sparkSession, path))


def bit_filter(values: DataFrame, bits: int) -> np.ndarray:
    """Which numbers modulo ``bits`` (a multiple of 32) occur in the only column, as packed bits: at most bits / 32 rows pass through the driver."""
    at = values.select(F.pmod(F.col(values.columns[0]), F.lit(bits)).alias("at"))
    word, bit = F.floor(F.col("at") / 32), F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("at", F.lit(32)).cast("int"))
    found = at.groupBy(word.alias("word")).agg(F.bit_or(bit).alias("bits")).toPandas()
    packed = np.zeros(bits // 32, np.uint32)
    packed[found["word"].to_numpy(np.int64)] = found["bits"].to_numpy(np.int64)
    return packed


def in_filter(packed: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Whether each number (as long) may be one that the filter has."""
    at = np.mod(values.view(np.int64), len(packed) * 32)
    return (packed[at // 32] >> (at % 32).astype(np.uint32)) & np.uint32(1) != 0


def is_training(doc_id: Column) -> Column:
    """The fold that models may learn from: crc32 of the id as text, modulo 4, is not 2."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 != 2
