"""What the operators of this subpackage share: reading tables, cutting lineage, ranks, word hashes."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Word breaks of the contracts: space and the five ASCII controls from tab to carriage return.
SPACES = " \t\n\x0b\f\r"
SPACE_CLASS = "[\\x20\\x09-\\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder; the path may be of any store that Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder, which spark.checkpoint.dir names. Only a local session gets a folder of our own."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and read it back, so that lost executors cost no recomputation."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


class Tables:
    """Tables in the shared checkpoint folder: written once, read often, and dropped as soon as they have served.

    Unlike a checkpoint, a table is read by columns, and its size is known when a join is planned.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.folder = spark, f"{shared_folder(spark)}/tables-{uuid.uuid4().hex}"
        self.paths: dict[str, str] = {}

    def write(self, name: str, df: DataFrame) -> DataFrame:
        path = f"{self.folder}/{len(self.paths)}-{name}"
        self.paths[name] = path
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Delete tables; shuffle files of the jobs that are over go with the collection of the driver's garbage."""
        jvm = self.spark.sparkContext._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(self.paths[name])
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        jvm.System.gc()


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ranked(df: DataFrame, key: str, order: list[str], rank: str) -> DataFrame:
    """Add a rank, gapless from 0 within each key, though a key may hold most of the rows.

    df has to be stable when it is read again (a checkpoint): its partitions are the blocks. Rows are numbered inside
    (key, block), and a running sum over the blocks' counts of a key gives each block its start. No task gets more than
    the rows of one block for one key.
    """
    blocks = df.withColumn("__block", F.spark_partition_id())
    starts = (
        blocks.groupBy(key, "__block").agg(F.count(F.lit(1)).alias("__n"))
        .withColumn("__start", F.coalesce(F.sum("__n").over(Window.partitionBy(key).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .drop("__n")
    )
    inside = blocks.withColumn("__k", F.row_number().over(Window.partitionBy(key, "__block").orderBy(*order)) - 1)
    return inside.join(starts, [key, "__block"]).withColumn(rank, F.col("__start") + F.col("__k")).drop("__block", "__k", "__start")


def sized_broadcast(df: DataFrame, rows: int) -> DataFrame:
    """broadcast() for a side that its own making bounds at the given number of rows; a larger one is joined by shuffle."""
    return F.broadcast(df) if df.count() <= rows else df


# Word hashes with numpy: a whole batch of texts is one byte array, so that no Python runs for each word.

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BREAK = np.zeros(256, dtype=bool)
_BREAK[[ord(c) for c in SPACES]] = True
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_SLOT = 16


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over the whole number."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= _MIX1
    x ^= x >> np.uint64(27)
    x *= _MIX2
    x ^= x >> np.uint64(31)
    return x


def word_hashes(text: str | None) -> np.ndarray:
    """64-bit hashes of a text's words in order, A-Z lower-cased. Equal words have equal hashes in every process.

    A word is read as its little-endian 8-byte pieces; each piece is mixed with its place, and a word's hash is the mixed
    sum of its pieces and its length.
    """
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), dtype=np.uint8)
    if not len(data):
        return np.zeros(0, np.uint64)
    inside = np.empty(len(data) + 2, bool)
    inside[0] = inside[-1] = False
    np.logical_not(_BREAK[data], out=inside[1:-1])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    first, last = edge[::2], edge[1::2]
    if not len(first):
        return np.zeros(0, np.uint64)
    size = last - first
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = _LOWER[data]
    out = mix(size.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    todo = np.arange(len(first))
    at, place = first.copy(), 0
    grams = np.lib.stride_tricks.as_strided(padded.view(), (len(data) + 1, 8), (1, 1))
    while len(todo):
        piece = np.ascontiguousarray(grams[at]).view("<u8").ravel()
        left = last[todo] - at
        short = left < 8
        piece = np.where(short, piece & ((np.uint64(1) << (np.uint64(8) * np.minimum(left, 7).astype(np.uint64))) - np.uint64(1)), piece)
        out[todo] += mix(piece + np.uint64((place + 1) * 0xD6E8FEB86659FD93 & 0xFFFFFFFFFFFFFFFF))
        more = left > 8
        todo, at, place = todo[more], at[more] + 8, place + 1
    return mix(out)
