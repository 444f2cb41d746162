"""The job of a crawl's results: normalise, filter, de-duplicate, cap, count."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postloom.operators.dedup import dedup_key
from postloom.operators.filters import passes
from postloom.operators.metrics import bookkeeping
from postloom.operators.normalize import normalize_posts

ORDERS = ("filter-first", "dedup-first")


def judged(posts: DataFrame, source: str, start: str | None = None, end: str | None = None, post_type: str | None = None, most: int | None = None, order: str = "filter-first") -> DataFrame:
    """Canonical posts (with source and ord) with a disposition: extracted, filtered, duplicate, capped or failed.

    Filtered posts take no part in de-duplication, and neither they nor duplicates count towards the cap; with dedup-first,
    duplicates are found before the filter. ord is a post's own within its source. A source of any size is spread: its last
    post within the cap is found from the first ones of each task, and the windows are keyed by post.
    """
    keyed = posts.withColumn("__ok", passes(start, end, post_type)).withColumn("__key", dedup_key())
    key = [source, "__key"] if order == "dedup-first" else [source, "__key", "__ok"]
    nth = F.row_number().over(Window.partitionBy(*key).orderBy("ord"))
    keyed = keyed.withColumn("__first", nth == 1)
    over = F.lit(False)
    if most:
        live = keyed.where("__ok and __first").select(F.col(source).alias("__source"), F.col("ord").alias("__last"))
        firsts = live.withColumn("__nth", F.row_number().over(Window.partitionBy("__source").orderBy("__last"))).where(F.col("__nth") <= most)
        last = firsts.groupBy("__source").agg(F.max("__last").alias("__last"), F.count(F.lit(1)).alias("__n")).where(F.col("__n") == most).select("__source", "__last")
        keyed = keyed.join(last, F.col(source).eqNullSafe(F.col("__source")), "left")
        over = F.coalesce(F.col("ord") > F.col("__last"), F.lit(False))
    if order == "dedup-first":
        why = F.when(~F.col("__first"), "duplicate").when(~F.col("__ok"), "filtered")
    else:
        why = F.when(~F.col("__ok"), "filtered").when(~F.col("__first"), "duplicate")
    return keyed.withColumn("disposition", why.when(over, "capped").otherwise("extracted")).drop("__ok", "__key", "__first", "__source", "__last")


def slice_of(parsed: DataFrame, as_of: Column, **options) -> DataFrame:
    """Each source's bookkeeping over parsed posts (source, ord, page_id, page_name, source_url and the parsed fields)."""
    canonical = normalize_posts(parsed, F.col("page_name"), F.col("page_id"), F.col("source_url"), as_of, keep=("source", "ord"))
    return bookkeeping(judged(canonical, "source", **options))
