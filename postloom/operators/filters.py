"""Predicates and projections over posts, jobs and pages."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postloom import schemas
from postloom.functions.urls import safe_http

JOB_STATUSES = ("queued", "running", "completed", "failed")


def check_options(urls: list[str], max_posts: int | None = None, start: str | None = None, end: str | None = None, post_type: str | None = None) -> None:
    """raises ValueError for options that no job may have."""
    if not urls or not all(isinstance(u, str) and u.strip() for u in urls):
        raise ValueError("urls must be a list of addresses that aren't empty")
    if max_posts is not None and (isinstance(max_posts, bool) or not isinstance(max_posts, int) or max_posts < 0):
        raise ValueError("max_posts must be a whole number from 0")
    first, last = (date.fromisoformat(x) if x else None for x in (start, end))
    if first and last and first > last:
        raise ValueError("start is after end")
    if post_type is not None and post_type not in (*schemas.POST_TYPES, "all"):
        raise ValueError(f"post_type must be one of {schemas.POST_TYPES} or all")


def passes(start: str | None = None, end: str | None = None, post_type: str | None = None) -> Column:
    """within the dates, both included, and of the type. A missing date or type fails a set bound or type."""
    out, day = F.lit(True), F.to_date("published_at")
    if start:
        out = out & F.coalesce(day >= F.lit(start).cast("date"), F.lit(False))
    if end:
        out = out & F.coalesce(day <= F.lit(end).cast("date"), F.lit(False))
    if post_type and post_type != "all":
        out = out & F.coalesce(F.col("post_type") == post_type, F.lit(False))
    return out


def date_type_filter(posts: DataFrame, start: str | None = None, end: str | None = None, post_type: str | None = None) -> DataFrame:
    return posts.where(passes(start, end, post_type))


def statuses(given: str) -> list[str]:
    """a comma list of statuses, trimmed, in lower case; unknown ones are errors."""
    wanted = [s.strip().lower() for s in given.split(",") if s.strip()]
    if odd := [s for s in wanted if s not in (*JOB_STATUSES, "paused")]:
        raise ValueError(f"unknown status {odd}")
    return wanted


def with_status(jobs: DataFrame, given: str) -> DataFrame:
    wanted = statuses(given)
    return jobs.where(F.col("status").isin(wanted)) if wanted else jobs


def of_owner(df: DataFrame, owner_id: int | None) -> DataFrame:
    """rows of an owner; all rows for none."""
    return df if owner_id is None else df.where(F.col("owner_id") == owner_id)


def job_of_owner(jobs: DataFrame, job_id: int, owner_id: int | None) -> DataFrame:
    """A job, if it is the owner's."""
    return of_owner(jobs.where(F.col("id") == job_id), owner_id)


def wanted_of(query: str) -> str:
    """A query as it is looked for."""
    return query.strip().lower()


def searched_text(df: DataFrame, columns: list[str]) -> Column:
    """The columns that are searched, joined by spaces without empty ones, in lower case."""
    kinds = dict(df.dtypes)
    parts = [F.nullif(F.array_join(c, " ") if kinds[c].startswith("array") else F.col(c).cast("string"), F.lit("")) for c in columns]
    return F.lower(F.concat_ws(" ", *parts))


def search(df: DataFrame, query: str, columns: list[str]) -> DataFrame:
    """rows whose columns, joined by spaces without empty ones, hold the query in any case."""
    wanted = wanted_of(query)
    return df.where(searched_text(df, columns).contains(wanted)) if wanted else df


POST_SEARCH = ["page_name", "page_id", "post_id", "text", "caption", "hashtags", "mentions"]


def suggestions(targets: DataFrame, query: str) -> DataFrame:
    """targets that hold the query in any case."""
    return targets.where(F.lower("target").contains(query.strip().lower()))


def has_signal(posts: DataFrame) -> DataFrame:
    """F8: posts with an id, text, media or a media flag."""
    some = [F.coalesce(F.col(c) != "", F.lit(False)) for c in ("post_id", "text", "thumbnail_url", "media_url", "video_url")]
    flags = [F.coalesce(F.col(c), F.lit(False)) for c in ("has_image", "has_video")]
    out = some[0]
    for x in (*some[1:], *flags):
        out = out | x
    return posts.where(out)


def may_hold_posts(pages: DataFrame, html: str = "html") -> DataFrame:
    """pages with the literal that every embedded post has; asked before any parsing."""
    return pages.where(F.col(html).contains('"post_id"'))


def safe_links(df: DataFrame, column: str) -> DataFrame:
    """rows whose address is safe to open, trimmed."""
    return df.withColumn(column, safe_http(F.col(column))).where(F.col(column).isNotNull())


def reaction_breakdown(posts: DataFrame, key: str = "id") -> DataFrame:
    """a row for each reaction over 0 of a post, with the post's largest."""
    counts = F.array(*[F.struct(F.lit(r).alias("reaction"), F.coalesce(F.col(f"reaction_{r}_count"), F.lit(0)).alias("n")) for r in schemas.REACTIONS])
    some = F.filter(counts, lambda x: x["n"] > 0)
    return posts.select(key, F.array_max(F.transform(some, lambda x: x["n"])).alias("most"), F.inline(some))


def summaries(jobs: DataFrame) -> DataFrame:
    """P5: jobs as they are listed; any status outside the four shows as failed."""
    return jobs.withColumn("status", F.when(F.col("status").isin(*JOB_STATUSES), F.col("status")).otherwise("failed"))
