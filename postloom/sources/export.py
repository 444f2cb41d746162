"""Exports of canonical posts: JSON, CSV, JSON Lines, and the four sheets of a workbook as tables."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postloom import schemas
from postloom.functions.text import as_json, joined
from postloom.functions.time import iso, iso_and_epoch

def _edge(name: str, kind: str) -> Column:
    """A field as files have it: times as ISO text."""
    return iso_and_epoch(F.col(name))[0] if kind.startswith("timestamp") else F.col(name)


def canonical(posts: DataFrame) -> DataFrame:
    """All 33 fields in order, as files have them."""
    return posts.select(*[_edge(f.name, f.dataType.simpleString()).alias(f.name) for f in schemas.CANONICAL_POST])


def flat(posts: DataFrame) -> DataFrame:
    """The 28 flat columns as text; null is empty, lists stand between bars."""
    kinds = dict(posts.dtypes)

    def cell(c: str) -> Column:
        x = joined(F.col(c)) if kinds[c].startswith("array") else _edge(c, kinds[c]).cast("string")
        return F.coalesce(x, F.lit("")).alias(c)

    return posts.select(*[cell(c) for c in schemas.FLAT_COLUMNS])


#: Posts up to which a JSON export is one file, and of an array in a larger one.
ONE_FILE = 100_000


def _packed(compression: str | None) -> dict[str, str | int]:
    """The writer's options of a compression, "gzip" for one. Readers tell it by the files' names, and can't divide such files."""
    return {"compression": compression or "none", "maxRecordsPerFile": ONE_FILE if compression else 0}


def write_json(posts: DataFrame, path: str, one_file: bool | None = None, compression: str | None = None, most: int = ONE_FILE) -> None:
    """JSON arrays, null fields kept. A small export is one file in the order of the posts, and a larger one if one_file asks
    for it; else each file is an array of its own, of `most` posts or fewer, so that no task writes all of it or reads more than that.
    """
    n = posts.limit(most + 1 if one_file is None else 1).count()
    one_file = n <= most if one_file is None else one_file
    rows = canonical(posts)
    if not n:
        return rows.sparkSession.createDataFrame([("[]",)], "value string").coalesce(1).write.mode("overwrite").options(**_packed(compression)).text(path)
    size = None if one_file else most

    def framed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def one(b: pa.RecordBatch, at: int, last: bool) -> pa.RecordBatch:
            place = [(at + i) % size if size else at + i for i in range(b.num_rows)]
            ends = ["]" if size and k == size - 1 else "" for k in place]
            if last:
                ends[-1] = "]"
            return pa.RecordBatch.from_arrays([pc.binary_join_element_wise(pa.array(["," if k else "[" for k in place]), b.column("value"), pa.array(ends), "")], ["value"])

        at, held = 0, None
        for b in (b for b in batches if b.num_rows):
            if held is not None:
                yield one(held, at, False)
                at += held.num_rows
            held = b
        if held is not None:
            yield one(held, at, True)

    value = F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("value")
    lines = rows.select(F.monotonically_increasing_id().alias("i"), value).coalesce(1).sortWithinPartitions("i").select("value") if one_file else rows.select(value)
    lines.mapInArrow(framed, "value string").write.mode("overwrite").options(**_packed(compression) | {"maxRecordsPerFile": size or 0}).text(path)


def write_jsonl(posts: DataFrame, path: str, compression: str | None = None) -> None:
    """A JSON object a line, null fields kept."""
    canonical(posts).write.mode("overwrite").options(**_packed(compression), ignoreNullFields="false").json(path)


_CSV = {"header": "true", "quote": '"', "escape": '"', "emptyValue": "", "nullValue": "", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}


def write_csv(posts: DataFrame, path: str, compression: str | None = None) -> None:
    """The flat columns with a byte-order mark, quotes where they are needed. Each part file has the header."""
    rows = flat(posts)
    rows.withColumnRenamed(rows.columns[0], "﻿" + rows.columns[0]).write.mode("overwrite").options(**_CSV, **_packed(compression)).csv(path)


def cli_rows(posts: DataFrame) -> DataFrame:
    """All 33 columns as text, lists as JSON."""
    rows = canonical(posts)
    kinds = dict(rows.dtypes)
    return rows.select(*[F.coalesce(as_json(F.col(c)) if kinds[c].startswith("array") else F.col(c).cast("string"), F.lit("")).alias(c) for c in rows.columns])


def write_cli_csv(posts: DataFrame, path: str, compression: str | None = None) -> None:
    cli_rows(posts).write.mode("overwrite").options(**_CSV, **_packed(compression)).csv(path)


def metadata(posts: DataFrame, job_id: str, source: str, exported_at: str, schema_version: str = "1.0", filename: str = "posts.csv") -> DataFrame:
    """Key and value rows of the Metadata sheet."""
    values = {
        "exported_at": F.lit(exported_at), "job_id": F.lit(job_id), "source": F.lit(source), "format": F.lit("xlsx"), "filename": F.lit(filename), "posts_count": F.col("n").cast("string"),
        "sheets": F.lit("Posts, Engagement, Media, Metadata"), "schema_version": F.lit(schema_version), "generator": F.lit("postloom"),
    }
    rows = F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in values.items()])
    return posts.agg(F.count(F.lit(1)).alias("n")).select(F.inline(rows))


def workbook(posts: DataFrame, job_id: str, source: str, exported_at: str) -> dict[str, DataFrame]:
    """The four sheets as tables."""
    return {"Posts": flat(posts), "Engagement": posts.select(*schemas.ENGAGEMENT_COLUMNS), "Media": posts.select(*schemas.MEDIA_COLUMNS), "Metadata": metadata(posts, job_id, source, exported_at)}


def write_batches(posts: DataFrame, path: str, rows: int = 500, partitions: int | None = None) -> None:
    """Newest first, in files of at most `rows` rows; file order is the order of the posts.

    Tasks put their files in place themselves: otherwise the driver moves them one by one, when all are written.
    """
    n = partitions or int(posts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.desc_nulls_last("published_at"), F.desc("id" if "id" in posts.columns else "post_id")]
    posts.repartitionByRange(n, *order).sortWithinPartitions(*order).write.mode("overwrite").options(**{"maxRecordsPerFile": rows, "mapreduce.fileoutputcommitter.algorithm.version": "2"}).parquet(path)


FORMATS = ("json", "jsonl", "csv", "excel", "xlsx")


def export(posts: DataFrame, fmt: str, path: str, job_id: str = "", source: str = "", exported_at: str = "", compression: str | None = None) -> None:
    """Dispatch by format; unknown formats are errors. Text formats may be compressed; sheets are Parquet in any case."""
    if fmt not in FORMATS:
        raise ValueError(f"format must be one of {FORMATS}")
    if fmt == "csv":
        write_csv(posts, path, compression=compression)
    elif fmt == "json":
        write_json(posts, path, compression=compression)
    elif fmt == "jsonl":
        write_jsonl(posts, path, compression=compression)
    else:
        for name, sheet in workbook(posts, job_id, source, exported_at).items():
            sheet.write.mode("overwrite").parquet(f"{path}/{name}")


def export_gate(jobs: DataFrame, requests: DataFrame) -> DataFrame:
    """Export requests (job_id, owner_id, format) with why they are refused, or null."""
    known = jobs.select(F.col("id").alias("job_id"), F.col("owner_id").alias("__owner"), "status")
    out = requests.join(known, "job_id", "left")
    refused = (
        F.when(~F.col("format").isin(*FORMATS), "unknown_format").when(F.col("__owner").isNull() | (F.col("__owner") != F.col("owner_id")), "not_found")
        .when(F.col("status").isin("queued", "running"), "job_not_finished")
    )
    return out.select("job_id", "owner_id", "format", refused.alias("refused"))


def posts_from_store(posts: DataFrame, engagement: DataFrame) -> DataFrame:
    """Canonical posts from stored posts and their metrics; null lists come back as []."""
    out = posts.join(engagement, "id", "left")
    for c in ("hashtags", "mentions", "external_links"):
        out = out.withColumn(c, F.coalesce(c, F.array().cast("array<string>")))
    return out.withColumn("published", iso(F.col("published_at")))


def store_rows(posts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The rows of posts, metrics and media that canonical posts (with id, job_id, source_id, dedup_key) make.

    Metrics only where there is one, media only where a field has something; further media come from a list `media`.
    """
    empty = lambda c: F.when(F.size(c) > 0, F.col(c)).alias(c)
    base = [c for c in posts.columns if c not in (*schemas.METRICS, "scraped_at", "media", "hashtags", "mentions", "external_links")]
    rows = posts.select(*base, *[empty(c) for c in ("hashtags", "mentions", "external_links")])
    metrics = posts.select("id", *schemas.METRICS).where(F.coalesce(*schemas.METRICS).isNotNull())
    some = F.concat(*[F.coalesce(c, F.lit("")) for c in ("media_type", "media_url", "thumbnail_url", "video_url")]) != ""
    media = posts.where(some).select(F.col("id").alias("post_ref"), F.lit(0).alias("ord"), "media_type", F.col("media_url").alias("url"), "thumbnail_url", "video_url")
    if "media" in posts.columns:
        more = posts.select(F.col("id").alias("post_ref"), F.posexplode("media").alias("pos", "m"))
        media = media.union(more.select("post_ref", F.col("pos") + 1, "m.media_type", F.coalesce("m.media_url", "m.url"), "m.thumbnail_url", "m.video_url"))
    return rows, metrics, media


def error_rows(errors: DataFrame) -> DataFrame:
    """Error rows with the default code, and the source's address where they have none."""
    return errors.select("job_id", "source_id", F.coalesce("url", "source_url").alias("source_url"), F.coalesce("code", F.lit("scrape_error")).alias("code"), F.coalesce("message", F.lit("")).alias("message"))
