"""Sharding by longest-processing-time scheduling: groups that stay together go, by falling size, to the least-loaded shard.

Groups are rows of equal text. A group of at least 1/`parts` of all bytes is a unit by itself (there are at most `parts` of
them); smaller groups are gathered by their hash into `parts` bundles of whole groups, each a unit. So the heap orders a
bounded number of units at any input size, and no unit but a large group can tilt a shard. Law: bytes.

Defined results: a null text has no bytes and is grouped with the empty text; repeated rows are placed one by one, in one
shard; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postloom.llm.common import cut, ranked, table

SHARDS = 8
PARTS = 8192


def schedule(units: list[tuple[int, int]], shards: int) -> dict[int, int]:
    """Unit to shard, for (size, unit) pairs: the largest first, each to the shard with the least so far."""
    heap = [(0, s) for s in range(shards)]
    out = {}
    for size, unit in sorted(units, key=lambda x: (-x[0], x[1])):
        load, shard = heap[0]
        heapq.heapreplace(heap, (load + size, shard))
        out[unit] = shard
    return out


def shard(docs: DataFrame, shards: int = SHARDS, parts: int = PARTS) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot (gapless from 0 in a shard)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = cut(docs.select(F.col("doc_id").cast("long"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.md5(text.cast("binary")).alias("__group")))
    groups = rows.groupBy("__group").agg(F.sum("size").alias("__bytes"))
    groups = groups.withColumn("__bundle", F.pmod(F.xxhash64("__group"), F.lit(parts)))
    total = rows.agg(F.sum("size")).first()[0] or 0
    large = F.col("__bytes") * parts >= total
    # at most `parts` large groups, as their bytes make up at most all bytes, and `parts` bundles
    own = groups.where(large).select("__group", "__bytes").orderBy("__group").collect()
    bundles = groups.where(~large).groupBy("__bundle").agg(F.sum("__bytes").alias("__bytes")).collect()
    units = [(r["__bytes"], k) for k, r in enumerate(own)] + [(r["__bytes"], len(own) + r["__bundle"]) for r in bundles]
    to = schedule(units, shards)
    spark = docs.sparkSession
    of_group = spark.createDataFrame([(r["__group"], to[k]) for k, r in enumerate(own)], "__group string, __own int")
    of_bundle = spark.createDataFrame([(r["__bundle"], to[len(own) + r["__bundle"]]) for r in bundles], "__bundle long, __shared int")
    placed = (
        rows.withColumn("__bundle", F.pmod(F.xxhash64("__group"), F.lit(parts)))
        .join(F.broadcast(of_group), "__group", "left").join(F.broadcast(of_bundle), "__bundle", "left")
        .select("doc_id", "size", "text_crc32", F.coalesce("__own", "__shared").alias("shard"))
    )
    return ranked(cut(placed), "shard", ["doc_id", "text_crc32"], "slot")


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long"), F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {"op8_sharding": op8_sharding}
ORACLE_SQL: dict[str, str] = {}
