"""Parsed posts to canonical posts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postloom import schemas
from postloom.functions import classify, numbers, text


def normalize_posts(parsed: DataFrame, page_name: Column | None = None, page_id: Column | None = None, source_url: Column | None = None, as_of: Column | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """The canonical 33 fields of each parsed post, and the columns to keep. One projection of native expressions."""
    null = F.lit(None).cast("string")
    source, name, pid = (x if x is not None else null for x in (source_url, page_name, page_id))
    body = text.clean_text(F.col("text"))
    first = parsed.withColumns({"__text": body, "__links": text.unique(F.coalesce(F.col("external_links"), F.array().cast("array<string>")))})
    kind = classify.post_type(
        F.coalesce("has_video", F.lit(False)) | F.coalesce(F.col("video_url") != "", F.lit(False)), F.col("video_url"),
        F.coalesce("has_image", F.lit(False)) | F.coalesce(F.col("thumbnail_url") != "", F.lit(False)) | F.coalesce(F.col("media_url") != "", F.lit(False)), F.col("media_url"),
        F.col("thumbnail_url"), F.col("has_link_preview"), F.col("__links"), F.col("__text"),
    )
    first = first.withColumn("__kind", classify.upgraded(kind, F.col("video_url"), F.col("media_url"), F.col("thumbnail_url")))
    named = F.coalesce("mentions", F.array().cast("array<string>"))
    made = {
        "source_url": source, "page_name": name, "page_id": pid, "profile_url": source, "post_type": F.col("__kind"), "timestamp": F.unix_seconds(F.col("published_at").cast("timestamp")),
        "text": F.col("__text"), "caption": null, "hashtags": text.hashtags(F.col("__text")), "mentions": text.unique(F.concat(named, text.mentions(F.col("__text")))), "external_links": F.col("__links"),
        "reactions": numbers.reactions_total(F.col("reactions"), [F.col(c) for c in schemas.REACTION_COUNTS]), "media_type": classify.media_type(F.col("__kind")),
        "transcript": null, "transcript_language": null, "scraped_at": as_of if as_of is not None else F.current_timestamp(),
    }
    fields = [made.get(f.name, F.col(f.name)).cast(f.dataType).alias(f.name) for f in schemas.CANONICAL_POST]
    return first.select(*fields, *keep)
