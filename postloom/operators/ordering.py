"""Firsts, caps, stale rounds, sorting and paging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postloom.operators.scan import running


def capped(df: DataFrame, keys: list[str], order: list[str], most: int | None) -> DataFrame:
    """The first rows of each key; all of them without a cap."""
    if not most:
        return df
    return df.withColumn("__nth", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("__nth") <= most).drop("__nth")


def resume_states(states: DataFrame) -> DataFrame:
    """The latest checkpoint of each source and job, unless it is running."""
    nth = F.row_number().over(Window.partitionBy("source_id", "job_id").orderBy(F.desc("id")))
    return states.withColumn("__nth", nth).where("__nth = 1 and status <> 'running'").drop("__nth")


def recent_targets(jobs: DataFrame, most: int = 4) -> DataFrame:
    """The targets of the newest jobs, each once. jobs: id, created_at, urls."""
    flat = jobs.select("id", "created_at", F.posexplode("urls").alias("pos", "target"))
    newest = flat.groupBy("target").agg(F.max(F.struct("created_at", "id", (-F.col("pos")).alias("pos"))).alias("at"))
    return newest.orderBy(F.desc("at"), "target").limit(most).select("target")


def stale_at(rounds: DataFrame, stale_rounds: int = 3) -> DataFrame:
    """The round at which each source has had no new item for so many rounds. rounds: source, round, new_items."""
    streaks = running(rounds.select("source", "round", "new_items"), "source", ["round"], since={"streak": F.col("new_items") > 0})
    return streaks.where(F.col("streak") >= stale_rounds).groupBy("source").agg(F.min("round").alias("round"))


def pagination_stop(rounds: DataFrame, most_items: int | None, most_rounds: int, stale_rounds: int = 3) -> DataFrame:
    """Why and where each source's paging stops, and how many items are kept.

    rounds: source, round (from 1), items, has_more, cancelled, failed. Within a round: cancelled, failed, stale, cap, end.
    """
    got = F.when(F.col("cancelled") | F.col("failed"), 0).otherwise(F.col("items"))
    columns = ["source", "round", "items", "has_more", "cancelled", "failed"]
    flagged = running(rounds.select(*columns), "source", ["round"], sums={"__total": got}, since={"__streak": got > 0})
    over = F.lit(False) if most_items is None else F.col("__total") >= most_items
    reason = (
        F.when(F.col("cancelled"), "cancelled").when(F.col("failed"), "fetch_error").when(F.col("__streak") >= stale_rounds, "stale").when(over, "item_cap").when(~F.col("has_more"), "no_more")
        .when(F.col("round") >= most_rounds, "max_rounds")
    )
    first = flagged.withColumn("__reason", reason).where(F.col("__reason").isNotNull()).groupBy("source").agg(F.min(F.struct("round", F.col("__reason").alias("reason"), F.col("__total").alias("total"))).alias("s"))
    kept = F.col("s.total") if most_items is None else F.least(F.col("s.total"), F.lit(most_items))
    rounds_done = F.when(F.col("s.reason") == "cancelled", F.col("s.round") - 1).otherwise(F.col("s.round"))
    return first.select("source", F.col("s.reason").alias("stop_reason"), rounds_done.alias("total_rounds"), kept.alias("items_kept"))


def changed_progress(progress: DataFrame) -> DataFrame:
    """Rows whose counters differ from the row before of the job; the first always."""
    rows = running(progress, "job_id", ["seq"], before={"__before": F.struct("counters")})
    return rows.where("__before is null or not (__before.counters <=> counters)").drop("__before")


def page_of(df: DataFrame, order: list[Column], page: int, size: int, most: int) -> DataFrame:
    """L1, L2: a page of rows in order; pages count from 1, and a page has at most `most` rows."""
    size = max(1, min(size, most))
    return df.orderBy(*order).offset((max(1, page) - 1) * size).limit(size)


def newest_posts(posts: DataFrame, page: int = 1, size: int = 50) -> DataFrame:
    """L1: newest first, without a date last."""
    return page_of(posts, [F.desc_nulls_last("published_at"), F.desc("id")], page, size, 200)


def newest_jobs(jobs: DataFrame, page: int = 1, size: int = 20) -> DataFrame:
    """L2."""
    return page_of(jobs, [F.desc("created_at"), F.desc("id")], page, size, 100)


def sort_key(kind: str) -> Column:
    """L3: what the post table sorts by; a missing metric counts as -1, a missing date as 0. Dates are milliseconds."""
    if kind != "date":
        return F.coalesce(F.col({"likes": "likes", "comments": "comments_count", "shares": "shares"}[kind]), F.lit(-1)).cast("long")
    stamp = F.when(F.col("timestamp") > 1_000_000_000_000, F.col("timestamp")).otherwise(F.col("timestamp") * 1000)
    published = F.col("published_at")
    return F.coalesce(stamp, F.unix_millis(published.cast("timestamp")), F.lit(0)).cast("long")


def sorted_posts(posts: DataFrame, kind: str, descending: bool = True) -> DataFrame:
    key = sort_key(kind)
    return posts.orderBy(F.desc(key) if descending else F.asc(key), "id")


def latest_errors(errors: DataFrame, job_id: int | None = None, most: int = 50) -> DataFrame:
    """The newest errors of a job, or of each job."""
    if job_id is not None:
        return errors.where(F.col("job_id") == job_id).orderBy(F.desc("id")).limit(most)
    return errors.withColumn("__nth", F.row_number().over(Window.partitionBy("job_id").orderBy(F.desc("id")))).where(F.col("__nth") <= most).drop("__nth")


def users_in_order(users: DataFrame) -> DataFrame:
    """L7."""
    return users.orderBy("created_at", "id")


