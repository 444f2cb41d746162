"""Roll-ups: job figures, usage, dashboards, request rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postloom.functions.text import path_family
from postloom.functions.time import iso
from postloom.operators.scan import running

SUMS = {"total_likes": "likes", "total_reactions": "reactions", "total_comments": "comments_count", "total_shares": "shares", "total_views": "views_count"}


def _sum(c: str) -> Column:
    return F.coalesce(F.sum(c), F.lit(0))


def job_kpi(posts: DataFrame, engagement: DataFrame) -> DataFrame:
    """A1 to A4: figures of each job in one pass over posts and their metrics; no views are null."""
    rows = posts.join(engagement, "id", "left")
    kinds = {f"n_{k}": F.count_if(F.col("post_type") == k) for k in ("image", "link", "text")}
    video = F.count_if(F.coalesce(F.col("post_type") == "video", F.lit(False)) | (F.col("video_url").isNotNull() & F.col("post_type").isNull()))
    out = rows.groupBy("job_id").agg(
        F.count(F.lit(1)).alias("total_posts"), *[_sum(c).alias(n) for n, c in SUMS.items()], video.alias("n_video"), *[x.alias(n) for n, x in kinds.items()],
        F.min("published_at").alias("__first"), F.max("published_at").alias("__last"),
    )
    return out.withColumns({"total_views": F.nullif("total_views", F.lit(0)), "earliest": iso(F.col("__first")), "latest": iso(F.col("__last"))}).drop("__first", "__last")


def type_histogram(posts: DataFrame) -> DataFrame:
    """A2: posts by type of each job, without those of no type."""
    return posts.where("post_type <> ''").groupBy("job_id", "post_type").agg(F.count(F.lit(1)).alias("n"))


COUNTERS = ("discovered", "extracted", "duplicates_removed", "skipped", "failed")


def source_rollup(sources: DataFrame, storage_duplicates: DataFrame | None = None) -> DataFrame:
    """A5: the five counters of a job's sources; duplicates also count those found on storing."""
    out = sources.groupBy("job_id").agg(*[_sum(c).alias(c) for c in COUNTERS])
    if storage_duplicates is not None:
        more = storage_duplicates.groupBy("job_id").agg(F.sum("duplicates").alias("__more"))
        out = out.join(more, "job_id", "left")
    else:
        out = out.withColumn("__more", F.lit(0))
    return out.withColumn("duplicates", F.col("duplicates_removed") + F.coalesce("__more", F.lit(0))).drop("__more")


def finalize(jobs: DataFrame, posts: DataFrame, errors: DataFrame, sources: DataFrame) -> DataFrame:
    """Jobs with the counts that their rows have, and their last status. Each table is counted before it is joined."""
    count = lambda df, name: df.groupBy(F.col("job_id").alias("id")).agg(F.count(F.lit(1)).alias(name))
    done = sources.where(F.col("status").isin("completed", "failed", "cancelled"))
    out = jobs.join(count(posts, "posts_processed"), "id", "left").join(count(errors, "__errors"), "id", "left").join(count(done, "pages_completed"), "id", "left")
    cancelled = F.coalesce(F.col("cancel_requested"), F.lit(False))
    return out.select(
        "id", F.coalesce("posts_processed", F.lit(0)).alias("posts_processed"), (F.coalesce("__errors", F.lit(0)) + cancelled.cast("int")).alias("errors_count"),
        F.coalesce("pages_completed", F.lit(0)).alias("pages_completed"), F.when(cancelled, "failed").otherwise("completed").alias("status"),
    )


def bookkeeping(rows: DataFrame, source: str = "source") -> DataFrame:
    """Counts of each source from rows with a disposition: extracted, filtered, duplicate, capped or failed.

    Duplicates are also among the skipped; discovered is the sum of extracted, skipped and failed.
    """
    n = lambda *kinds: F.count_if(F.col("disposition").isin(*kinds))
    out = rows.groupBy(source).agg(
        F.count(F.lit(1)).alias("discovered"), n("extracted").alias("extracted"), n("duplicate").alias("duplicates_removed"), n("filtered", "duplicate", "capped").alias("skipped"), n("failed").alias("failed"),
    )
    return out.withColumn("balanced", F.col("discovered") == F.col("extracted") + F.col("skipped") + F.col("failed"))


def usage(users: DataFrame, jobs: DataFrame, posts: DataFrame, as_of: Column) -> DataFrame:
    """Of each user, active jobs, and jobs and posts since midnight, beside the limits of the plan."""
    from postloom.operators.joins import posts_of_owners, with_limits

    midnight = F.date_trunc("day", as_of)
    by_jobs = jobs.groupBy(F.col("owner_id").alias("id")).agg(F.count_if(F.col("status").isin("queued", "running")).alias("active_jobs"), F.count_if(F.col("created_at") >= midnight).alias("jobs_today"))
    by_posts = posts_of_owners(posts, jobs, midnight).groupBy(F.col("owner_id").alias("id")).agg(F.count(F.lit(1)).alias("posts_today"))
    out = with_limits(users).join(by_jobs, "id", "left").join(by_posts, "id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return out.select("id", "plan", zero("active_jobs"), zero("posts_today"), zero("jobs_today"), "max_urls", "max_posts", "concurrent_jobs")


def dashboard_kpi(posts: DataFrame, by: str = "job_id") -> DataFrame:
    """The dashboard's own rules: a type or a media type makes a video or an image, links make a link."""
    is_ = lambda kind: (F.lower(F.coalesce("media_type", F.lit(""))) == kind) | (F.coalesce("post_type", F.lit("")) == kind)
    links = (F.coalesce("post_type", F.lit("")) == "link") | F.coalesce(F.size("external_links") > 0, F.lit(False))
    total = lambda c: F.sum(F.coalesce(c, F.lit(0)))
    return posts.groupBy(by).agg(
        total("likes").alias("likes"), total("comments_count").alias("comments"), total("shares").alias("shares"), F.count_if(is_("video")).alias("videos"), F.count_if(is_("image")).alias("images"), F.count_if(links).alias("links"),
    )


def seen_in_rounds(rounds: DataFrame) -> DataFrame:
    """A10: distinct posts of each round of a capture, and the most so far. rounds: capture, round, post_id."""
    counts = rounds.groupBy("capture", "round").agg(F.count_distinct("post_id").alias("seen"))
    return running(counts, "capture", ["round"], peaks={"most_so_far": F.col("seen")})


def duplicate_lines(df: DataFrame, key: str, column: str) -> DataFrame:
    """Lines of a list that repeat another in any case, blank ones aside."""
    lines = F.filter(F.transform(F.split(column, "\r?\n"), lambda x: F.lower(F.trim(x))), lambda x: x != "")
    return df.select(key, (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("duplicates"))


#: Upper ends of the buckets in which durations are counted, in seconds.
BUCKETS = (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0, 30.0, 60.0)


def bucket_counts(value: Column, ends: tuple[float, ...] = BUCKETS) -> Column:
    """An aggregate: how many values are at most each end, then how many there are. Counts of parts add up to those of the whole."""
    return F.array(*[F.count_if(value <= e) for e in ends], F.count(value))


def histogram_quantile(share: float, counts: Column, ends: tuple[float, ...] = BUCKETS) -> Column:
    """The quantile of bucket_counts(), by a line through the bucket that it falls in; beyond the last end, that end; null for nothing.

    The first bucket begins at 0.
    """
    n = F.element_at(counts, -1)
    rank, out = n * share, F.lit(ends[-1])
    for k in range(len(ends) - 1, -1, -1):
        upto, before, begin = F.get(counts, F.lit(k)), F.get(counts, F.lit(k - 1)) if k else F.lit(0), ends[k - 1] if k else 0.0
        out = F.when((upto >= rank) & (upto > before), begin + (ends[k] - begin) * (rank - before) / (upto - before)).otherwise(out)
    return F.when(n > 0, out)


def request_rates(events: DataFrame, seconds: int = 300, ends: tuple[float, ...] = BUCKETS) -> DataFrame:
    """By window and path family, requests a second, the share of failures, and the 95th percentile of the value.

    events: ts, path, failed, value. The percentile is that of a histogram, as the dashboard has it.
    """
    out = events.groupBy(F.window("ts", f"{seconds} seconds").alias("w"), path_family(F.col("path")).alias("family")).agg(
        F.count(F.lit(1)).alias("__n"), F.count_if("failed").alias("__bad"), bucket_counts(F.col("value"), ends).alias("__counts"),
    )
    rate = F.col("__n") / seconds
    return out.select(
        F.col("w.start").alias("start"), "family", rate.alias("rate"), (F.col("__bad") / seconds / F.greatest(rate, F.lit(1e-6))).alias("failure_share"), histogram_quantile(0.95, F.col("__counts"), ends).alias("p95"),
    )


def capped_families(events: DataFrame, most: int = 500) -> DataFrame:
    """Events with their path's family, families beyond the most common ones as other. The kept list has at most `most` rows."""
    labelled = events.withColumn("family", path_family(F.col("path")))
    top = labelled.groupBy("family").agg(F.count(F.lit(1)).alias("__n")).orderBy(F.desc("__n"), "family").limit(most).select("family", F.lit(True).alias("__known"))
    return labelled.join(F.broadcast(top), "family", "left").withColumn("family", F.when(F.col("__known"), F.col("family")).otherwise("other")).drop("__known")


def outcome_rates(jobs: DataFrame, seconds: int = 86_400) -> DataFrame:
    """Finished jobs a second, by window and outcome."""
    done = jobs.where(F.col("status").isin("completed", "failed"))
    return done.groupBy(F.window("created_at", f"{seconds} seconds").alias("w"), "status").agg((F.count(F.lit(1)) / seconds).alias("rate")).select(F.col("w.start").alias("start"), "status", "rate")


def counts_by(df: DataFrame, key: str) -> DataFrame:
    """Rows of each key."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
