"""Duplicates of posts and addresses. The first in order stays, so every input has an ord column."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postloom.functions.time import iso_and_epoch
from postloom.functions.urls import SITE, classify_source
from postloom.shared import checkpointed


def _text(x: Column) -> Column:
    return F.coalesce(x.cast("string"), F.lit(""))


def fingerprint() -> Column:
    """B1: of page, second of publication and the first 200 characters, of a canonical post."""
    stamp = F.coalesce(F.col("timestamp").cast("string"), F.substring(iso_and_epoch(F.col("published_at"))[0], 1, 19))
    return F.sha2(F.concat(_text(F.col("page_id")), F.lit("|"), _text(stamp), F.lit("|"), F.substring(_text(F.col("text")), 1, 200)), 256)


def content_fingerprint() -> Column:
    """B2: of the first 200 characters, beside the full time of publication."""
    return F.concat(F.substring(F.sha2(F.substring(_text(F.col("text")), 1, 200), 256), 1, 16), F.lit("|"), _text(iso_and_epoch(F.col("published_at"))[0]))


def dedup_key() -> Column:
    """By the post's id, else by its fingerprint."""
    return F.when(F.coalesce(F.col("post_id"), F.lit("")) != "", F.concat(F.lit("id:"), F.col("post_id"))).otherwise(F.concat(F.lit("fp:"), fingerprint()))


def storage_key() -> Column:
    """The post's id, else a digest of the sorted JSON of its stable fields, with 500 characters of its text."""
    quoted = lambda x: F.when(x.isNull(), "null").otherwise(F.regexp_extract(F.to_json(F.struct(x.alias("v"))), '(?s)^\\{"v":(.*)\\}$', 1))
    url = F.coalesce(F.nullif(F.col("post_url"), F.lit("")), F.col("source_url"))
    parts = (
        ("page_id", F.col("page_id")), ("post_url", url), ("published_at", iso_and_epoch(F.col("published_at"))[0]), ("text", F.substring(F.trim(_text(F.col("text"))), 1, 500)),
    )
    pieces = [x for k, (name, value) in enumerate(parts) for x in (F.lit(("{" if not k else ", ") + f'"{name}": '), quoted(value))]
    return F.when(F.coalesce(F.col("post_id"), F.lit("")) != "", F.col("post_id")).otherwise(F.concat(F.lit("fp:"), F.sha2(F.concat(*pieces, F.lit("}")), 256)))


def first_of(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("__nth", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__nth = 1").drop("__nth")


def dedup_posts(posts: DataFrame, within: list[str] | None = None) -> DataFrame:
    """The first post of each key, within the given columns."""
    return first_of(posts.withColumn("__key", dedup_key()), [*(within or []), "__key"], ["ord"]).drop("__key")


#: Posts that one task decides in their order, at most.
WHOLE = 200_000


def _in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The posts that stay, of parts that come one after another, each in order."""
    part, keys, contents = None, set(), set()
    for b in batches:
        stays = []
        for p, k, c in zip(*(b.column(x).to_pylist() for x in ("__part", "__k", "__c"))):
            if p != part:
                part, keys, contents = p, set(), set()
            stays.append(k not in keys and c not in contents)
            if stays[-1]:
                keys.add(k)
                contents.add(c)
        yield b.filter(pa.array(stays, pa.bool_()))


def _decided(rows: DataFrame, parts: int | None = None) -> DataFrame:
    """What stays of rows (__part, __k, __c, __at, ...): a part, of at most WHOLE rows, is decided by one task."""
    dealt = rows.repartition("__part") if parts is None else rows.repartition(parts)
    return dealt.sortWithinPartitions("__part", "__at").mapInArrow(_in_order, rows.schema)


def _parts(rows: DataFrame) -> DataFrame:
    """rows (__k, __c, __at) with __part, equal for all that hang together by keys and contents.

    Labels are hashes of keys. Each step takes the least label of a content's posts, then of a key's, then the label of the
    key that a label is the hash of, so that labels reach twice as far with each step. Equal hashes only join parts.
    """
    now = checkpointed(rows.withColumn("__own", F.xxhash64("__k")).withColumn("__part", F.col("__own")))
    while True:
        by_content = now.groupBy("__c").agg(F.min("__part").alias("__low"))
        lower = now.join(by_content, "__c")
        by_key = checkpointed(lower.groupBy("__own").agg(F.min("__low").alias("__new")))
        jumped = by_key.select(F.col("__own").alias("__new"), F.col("__new").alias("__far"))
        by_key = by_key.join(jumped, "__new", "left").select("__own", F.least("__new", "__far").alias("__new"))
        after = checkpointed(now.join(by_key, "__own").withColumn("__moved", F.col("__part") != F.col("__new")).withColumn("__part", F.col("__new")).drop("__new"))
        if after.where("__moved").isEmpty():
            return after.drop("__own", "__moved")
        now = after.drop("__moved")


def dedup_across_sources(posts: DataFrame, source: str = "source", order: tuple[str, ...] = ("source", "ord"), whole: int = WHOLE) -> DataFrame:
    """Within each source by key, then in order over all: a post goes if a post that stays before it has its key or content.

    At most `whole` posts are decided by one task, in their order. Of more, a round decides those that are the first of both
    their key and their content, which stay, and those that share either with them, which go; what is left falls into parts that
    share neither keys nor contents, each decided in its order by one task, all parts at once. Only a part of more than `whole`
    posts takes another round. Firsts are cut from their lineage, so that a join on a key or content of very many posts (as
    that of posts without text and date) can be split.
    """
    inside = dedup_posts(posts, [source])
    todo = checkpointed(inside.select("*", dedup_key().alias("__k"), content_fingerprint().alias("__c"), F.struct(*order).alias("__at"), F.lit(0).cast("long").alias("__part")))
    columns = ["__part", "__k", "__c", "__at"]
    if todo.count() <= whole:
        return _decided(todo, 1).drop(*columns)
    left, kept = todo.select("__k", "__c", "__at"), []
    while not left.isEmpty():
        first_k, first_c = checkpointed(left.groupBy("__k").agg(F.min("__at").alias("__fk"))), checkpointed(left.groupBy("__c").agg(F.min("__at").alias("__fc")))
        stays = checkpointed(left.join(first_k, "__k").join(first_c, "__c").where("__at = __fk and __at = __fc").select("__k", "__c", "__at"))
        kept.append(stays.select("__at"))
        left = checkpointed(left.join(stays.select("__k"), "__k", "left_anti").join(stays.select("__c"), "__c", "left_anti"))
        if left.count() <= whole:
            kept.append(_decided(left.withColumn("__part", F.lit(0).cast("long")).select(*columns), 1).select("__at"))
            break
        parts = _parts(left)
        large = checkpointed(parts.groupBy("__part").agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > whole).select("__part"))
        kept.append(_decided(parts.join(large, "__part", "left_anti").select(*columns)).select("__at"))
        left = parts.join(large, "__part", "left_semi").select("__k", "__c", "__at")
    return todo.join(reduce(DataFrame.union, kept), "__at", "left_semi").drop(*columns)


def store(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """The posts to append: not stored for the source yet, and the first of their key in the batch."""
    from postloom.operators.joins import not_stored

    return first_of(not_stored(incoming, stored), ["source_id", "dedup_key"], ["ord"])


def judge_urls(urls: DataFrame, site: str = SITE) -> DataFrame:
    """Each address (ord, url) with its canonical form and code: null for the first good one, or why it is not taken."""
    trimmed = F.trim(F.coalesce(F.col("url"), F.lit("")))
    seen = urls.withColumn("url", trimmed).withColumn("__v", classify_source(trimmed, site))
    alone = F.concat(F.lit("#"), F.col("ord").cast("string"))  # addresses without a canonical form don't gather in one task
    nth = F.row_number().over(Window.partitionBy(F.coalesce("__v.normalized_url", alone)).orderBy("ord"))
    code = F.when(~F.col("__v.valid"), "invalid_url").when(F.col("__nth") > 1, "duplicate_url")
    return seen.withColumn("__nth", nth).select("ord", "url", F.col("__v.normalized_url").alias("normalized_url"), code.alias("code"), F.when(F.col("url") != "", F.col("__v.reason")).otherwise("empty").alias("reason"))


def bulk_lines(df: DataFrame, key: str, column: str) -> DataFrame:
    """The lines of a text, trimmed, without blank ones, each once in any case, in order."""
    lines = df.select(key, F.posexplode(F.split(column, "\r?\n")).alias("ord", "line")).withColumn("line", F.trim("line")).where("line <> ''")
    return first_of(lines.withColumn("__low", F.lower("line")), [key, "__low"], ["ord"]).drop("__low")


def union_all(frames: list[DataFrame]) -> DataFrame:
    """All rows of all frames; columns that one lacks are null."""
    out = frames[0]
    for x in frames[1:]:
        out = out.unionByName(x, allowMissingColumns=True)
    return out
