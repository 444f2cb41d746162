"""The record types: parsed posts, canonical posts of 33 fields, and the flat column orders of exports."""

from __future__ import annotations

from pyspark.sql import types as T

REACTIONS = ("like", "love", "care", "haha", "wow", "sad", "angry")
REACTION_COUNTS = tuple(f"reaction_{r}_count" for r in REACTIONS)
METRICS = ("likes", "reactions", "comments_count", "shares", "views_count", *REACTION_COUNTS)
POST_TYPES = ("text", "image", "video", "link")
PLANS = ("basic", "pro", "team", "enterprise")
#: What a plan allows; None has no ceiling.
PLAN_LIMITS = {
    "basic": {"urls": 5, "max_posts": 500, "concurrent_jobs": 1},
    "pro": {"urls": 50, "max_posts": 5_000, "concurrent_jobs": 3},
    "team": {"urls": 150, "max_posts": 100_000, "concurrent_jobs": 10},
    "enterprise": {"urls": None, "max_posts": None, "concurrent_jobs": 10},
}


_KINDS = {"string": T.StringType(), "bigint": T.LongType(), "boolean": T.BooleanType(), "timestamp": T.TimestampType(), "array<string>": T.ArrayType(T.StringType())}


def _struct(**kinds: str) -> T.StructType:
    return T.StructType([T.StructField(name, _KINDS[kind]) for name, kind in kinds.items()])


#: A post as it is read from a page, before normalisation.
PARSED_POST = _struct(
    post_id="string", post_url="string", text="string", published_at="timestamp", published_at_raw="string", **{m: "bigint" for m in METRICS},
    has_image="boolean", has_video="boolean", has_link_preview="boolean", thumbnail_url="string", media_url="string", video_url="string",
    external_links="array<string>", mentions="array<string>",
)

#: The canonical post. The order of the fields is part of the format.
CANONICAL_POST = _struct(
    post_id="string", source_url="string", post_url="string", page_name="string", page_id="string", profile_url="string", post_type="string",
    published_at="timestamp", timestamp="bigint", text="string", caption="string", hashtags="array<string>", mentions="array<string>", external_links="array<string>",
    **{m: "bigint" for m in METRICS},
    media_type="string", thumbnail_url="string", media_url="string", video_url="string", transcript="string", transcript_language="string", scraped_at="timestamp",
)

#: The flat columns of CSV exports and of the Posts sheet, and the columns of the other sheets.
FLAT_COLUMNS = (
    "post_id", "page_name", "post_url", "published_at", "text", "post_type", "likes", "comments_count", "shares", "views_count", "thumbnail_url", "media_url",
    "page_id", "profile_url", "reactions", *REACTION_COUNTS, "hashtags", "mentions", "external_links", "media_type", "video_url", "transcript",
)
ENGAGEMENT_COLUMNS = ("post_id", *METRICS)
MEDIA_COLUMNS = ("post_id", "media_type", "thumbnail_url", "media_url", "video_url")
