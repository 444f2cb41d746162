"""The store of posts, laid out so that a batch reads what its own sources may have stored.

Posts lie in folders by batch and by bucket of their source. Each batch leaves a Bloom filter of its keys for each bucket, as
bitmaps of a fixed size. What comes in asks the filters of its buckets; of the store's files, only those of buckets in which some
key may be stored are read, for their keys, and compared exactly. A filter that is full makes more to compare, never another result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postloom.operators.dedup import first_of
from postloom.shared import exists, remove

#: Bits of one bitmap of Spark's bitmap functions.
_BITMAP = 32_768
_HASHES = 3
KEY = ["source_id", "dedup_key"]


class PostStore:
    """Posts (source_id, dedup_key, ord, ...) in a folder. A store keeps the numbers of buckets and bitmaps that it began with.

    A filter has `bitmaps` * 4096 bytes for a bucket: at 32, 100,000 keys of a bucket and batch are told apart with an error of two per cent.
    Null sources and keys equal nothing: such posts are always new, and the first of a batch is taken.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64, bitmaps: int = 32) -> None:
        self.spark, self.posts, self.filters, self.buckets, self.bitmaps = spark, f"{path}/posts", f"{path}/filters", buckets, bitmaps

    def read(self) -> DataFrame:
        """All posts, with their batch and bucket."""
        return self.spark.read.parquet(self.posts)

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64("source_id"), F.lit(self.buckets)).cast("int").alias("bucket")

    def _bits(self, keys: DataFrame) -> DataFrame:
        """A row for each hash of each key: its bucket, bitmap and bit."""
        places = F.array(*[F.pmod(F.xxhash64(F.lit(k), *KEY), F.lit(self.bitmaps * _BITMAP)) for k in range(_HASHES)])
        at = keys.select(*KEY, self._bucket(), F.explode(places).alias("at"))
        return at.select(*KEY, "bucket", F.floor(F.col("at") / _BITMAP).cast("int").alias("bitmap"), (F.col("at") % _BITMAP).alias("bit"))

    def _touched(self, df: DataFrame) -> list[int]:
        return [r[0] for r in df.select("bucket").distinct().collect()]  # no more than buckets

    def _maybe(self, keys: DataFrame, before: int | None) -> DataFrame:
        """Of some keys, those that the filters don't rule out, with their buckets."""
        bits = self._bits(keys)
        filters = self.spark.read.parquet(self.filters).where(F.col("bucket").isin(self._touched(keys.select(self._bucket()))))
        filters = filters if before is None else filters.where(F.col("batch") < before)
        merged = filters.groupBy("bucket", "bitmap").agg(F.bitmap_or_agg("bits").alias("bits"))  # at most buckets * bitmaps rows of 4096 bytes
        byte = F.conv(F.hex(F.substring("bits", F.floor(F.col("bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        is_set = F.coalesce(F.try_mod(F.floor(byte / F.pow(F.lit(2), F.col("bit") % 8)), F.lit(2)) == 1, F.lit(False))
        small = self.buckets * self.bitmaps * 4096 <= 64_000_000
        return bits.join(F.broadcast(merged) if small else merged, ["bucket", "bitmap"], "left").groupBy("bucket", *KEY).agg(F.bool_and(is_set).alias("maybe")).where("maybe").drop("maybe")

    def stored_keys(self, buckets: list[int], before: int | None = None) -> DataFrame:
        """The keys of some buckets: other buckets' files are not read."""
        rows = self.read().where(F.col("bucket").isin(buckets))
        return (rows if before is None else rows.where(F.col("batch") < before)).select(*KEY)

    def new_posts(self, incoming: DataFrame, before: int | None = None) -> DataFrame:
        """The first of each key that the store lacks (J5), or that its batches before a number lack."""
        first = first_of(incoming, KEY, ["ord"])
        if not exists(self.spark, self.filters):
            return first
        maybe = self._maybe(first.select(*KEY).dropna(), before)
        buckets = self._touched(maybe)
        if not buckets:
            return first
        known = self.stored_keys(buckets, before).join(maybe.select(*KEY), KEY, "left_semi").distinct()
        return first.join(known, KEY, "left_anti")

    def append(self, incoming: DataFrame, batch: int) -> None:
        """Stores what is new as a batch of its own. A batch that is stored again replaces what its last attempt left."""
        new = self.new_posts(incoming, batch).withColumn("bucket", self._bucket())
        new.hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.posts}/batch={batch}")
        keys = self.spark.read.schema(incoming.select(*KEY).schema).parquet(f"{self.posts}/batch={batch}")
        bits = self._bits(keys.dropna()).groupBy("bucket", "bitmap").agg(F.bitmap_construct_agg("bit").alias("bits"))
        bits.hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.filters}/batch={batch}")

    def drop(self) -> None:
        remove(self.spark, self.posts)
        remove(self.spark, self.filters)
