"""Joins of the relational store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postloom import schemas
from postloom.functions.text import dom_text
from postloom.shared import checkpointed


def with_engagement(posts: DataFrame, engagement: DataFrame) -> DataFrame:
    """Posts with their metrics, null where there is no row."""
    return posts.join(engagement, "id", "left")


def with_media(posts: DataFrame, media: DataFrame) -> DataFrame:
    """Posts with the list of their media, in order; [] where there is none."""
    lists = media.groupBy(F.col("post_ref").alias("id")).agg(F.sort_array(F.collect_list(F.struct("ord", "media_type", "url", "thumbnail_url", "video_url"))).alias("media"))
    return posts.join(lists, "id", "left").withColumn("media", F.coalesce("media", F.array().cast(lists.schema["media"].dataType)))


def engagement_of_job(engagement: DataFrame, posts: DataFrame, job_id: int | None = None) -> DataFrame:
    """Metrics of a job's posts."""
    chosen = posts if job_id is None else posts.where(F.col("job_id") == job_id)
    return engagement.join(chosen.select("id", "job_id"), "id")


def posts_of_owners(posts: DataFrame, jobs: DataFrame, since: Column | None = None) -> DataFrame:
    """Posts with the owner of their job, of the days from since on."""
    out = posts.join(jobs.select(F.col("id").alias("job_id"), "owner_id"), "job_id")
    return out if since is None else out.where(F.col("scraped_at") >= since)


def not_stored(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """Incoming posts whose key the source hasn't stored."""
    return incoming.join(stored.select("source_id", "dedup_key").distinct(), ["source_id", "dedup_key"], "left_anti")


def with_mirror(primary: DataFrame, mirror: DataFrame, key: str) -> DataFrame:
    """All primary rows, and the mirror's whose key the primary lacks."""
    return primary.unionByName(mirror.join(primary.select(key), key, "left_anti"), allowMissingColumns=True)


def plan_table(spark: SparkSession) -> DataFrame:
    rows = [(p, x["urls"], x["max_posts"], x["concurrent_jobs"]) for p, x in schemas.PLAN_LIMITS.items()]
    return spark.createDataFrame(rows, "plan string, max_urls long, max_posts long, concurrent_jobs long")


def plan_name(plan: Column) -> Column:
    low = F.lower(F.coalesce(plan, F.lit("")))
    return F.when(low.isin(*schemas.PLANS), low).otherwise("basic")


def with_limits(users: DataFrame) -> DataFrame:
    """Users with the limits of their plan; unknown plans are basic. The table of plans has four rows."""
    return users.withColumn("plan", plan_name(F.col("plan"))).join(F.broadcast(plan_table(users.sparkSession)), "plan", "left")


def plan_gate(requests: DataFrame, users: DataFrame, jobs: DataFrame) -> DataFrame:
    """requests (owner_id, n_urls, max_posts) with the first limit of the owner's plan that they go over, or null."""
    active = jobs.where(F.col("status").isin("queued", "running")).groupBy("owner_id").agg(F.count(F.lit(1)).alias("active"))
    limits = with_limits(users).select(F.col("id").alias("owner_id"), "max_urls", F.col("max_posts").alias("most_posts"), "concurrent_jobs")
    out = requests.join(limits, "owner_id", "left").join(active, "owner_id", "left")
    violation = (
        F.when(F.col("n_urls") > F.col("max_urls"), "urls").when((F.col("most_posts") > 0) & (F.col("max_posts") > F.col("most_posts")), "max_posts")
        .when(F.coalesce("active", F.lit(0)) >= F.col("concurrent_jobs"), "concurrent_jobs")
    )
    return out.withColumn("violation", violation).select(*requests.columns, "violation")


#: Jobs to delete that are so few that every task may hold them.
FEW_JOBS = 10_000


def without_job(tables: dict[str, DataFrame], job_ids: DataFrame) -> dict[str, DataFrame]:
    """The tables without the jobs (column job_id) and all that hangs on them.

    Tables are never sorted: what is deleted is hashed, and they run past it. A few jobs go to every task; more of them, and the
    deleted posts, are shuffled, so that a task's memory follows its part of what is deleted, not of the tables.
    """
    keys = {"jobs": "id"}
    gone = job_ids.select("job_id")
    gone = F.broadcast(gone) if gone.limit(FEW_JOBS + 1).count() <= FEW_JOBS else gone.hint("shuffle_hash")
    out = {name: df.join(gone.withColumnRenamed("job_id", keys.get(name, "job_id")), keys.get(name, "job_id"), "left_anti") for name, df in tables.items() if keys.get(name, "job_id") in df.columns}
    for name in tables.keys() - out.keys():  # children of posts
        posts = tables["posts"].join(gone, "job_id", "left_semi").select("id")
        out[name] = tables[name].join(posts.hint("shuffle_hash"), "id", "left_anti")
    return out


#: Code points of a gram, by which texts that hold each other find each other.
GRAM = 8
#: Pairs of texts that a page may have for all of them to be compared.
FEW = 64


def containments(texts: DataFrame, q: int = GRAM) -> DataFrame:
    """Pairs (page_key, held, holder) of different texts of a page, of which one holds the other. texts: page_key, text, each once.

    A text that holds another has all its grams, the one that the fewest texts of the page have among them; so each text asks
    those that have its rarest gram, and is then looked for in them. A text of fewer than q code points is a gram of its own
    length, and where a page has such texts, its texts have grams of those lengths too.
    """
    t = texts.select("page_key", F.col("text").alias("__text"), F.xxhash64("text").alias("__id"), F.length("text").alias("__n")).where("__n > 0")
    sizes = t.groupBy("page_key").agg(F.collect_set(F.least("__n", F.lit(q))).alias("__sizes"))  # at most q numbers
    pieces = t.join(sizes, "page_key").select("page_key", "__id", "__n", F.split("__text", "").alias("__c"), F.explode("__sizes").alias("__size")).where("__size <= __n")
    at = lambda i: F.xxhash64(F.col("__size"), F.array_join(F.slice("__c", i + 1, F.col("__size")), ""))
    grams = pieces.select("page_key", "__id", "__n", "__size", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(0), F.col("__n") - F.col("__size")), at))).alias("__gram"))
    grams = checkpointed(grams)
    counts = grams.groupBy("page_key", "__gram").agg(F.count(F.lit(1)).alias("__df"))
    own = grams.where(F.col("__size") == F.least("__n", F.lit(q))).join(counts, ["page_key", "__gram"])
    rarest = own.groupBy("page_key", F.col("__id").alias("__held")).agg(F.min(F.struct("__df", "__gram")).alias("__g")).select("page_key", "__held", F.col("__g.__gram").alias("__gram"))
    met = grams.select("page_key", "__gram", F.col("__id").alias("__holder")).join(rarest, ["page_key", "__gram"]).where("__held <> __holder").select("page_key", "__held", "__holder")
    text_of = lambda kind: t.select("page_key", F.col("__id").alias(f"__{kind}"), F.col("__text").alias(kind))
    pairs = met.join(text_of("held"), ["page_key", "__held"]).join(text_of("holder"), ["page_key", "__holder"])
    return pairs.where(F.contains("holder", "held")).select("page_key", "held", "holder")


def drop_dom_copies(posts: DataFrame, q: int = GRAM) -> DataFrame:
    """Without posts that lack an id and whose text holds, or is held by, that of an earlier post of the page with an id.

    posts: page_key, ord, post_id, text. Equal texts of a page count once. On a page of at most FEW pairs, each text without an id
    is compared with each that has one; on others they meet by containments(), never all with all, and only on pages that have
    posts of both kinds. posts are made once, and read again.
    """
    mine = checkpointed(posts.withColumn("__own", dom_text(F.col("text"))))
    shown = F.coalesce(F.col("text") != "", F.lit(False))
    known = checkpointed(mine.where((F.col("post_id") != "") & shown).groupBy("page_key", "__own").agg(F.min("ord").alias("__first")))
    asked = checkpointed(mine.where((F.coalesce("post_id", F.lit("")) == "") & shown).select("page_key", "__own").distinct())
    n = known.groupBy("page_key").agg(F.count(F.lit(1)).alias("__known")).join(asked.groupBy("page_key").agg(F.count(F.lit(1)).alias("__asked")), "page_key")
    both = checkpointed(n.select("page_key", (F.col("__known") * F.col("__asked") <= FEW).alias("__few")))
    texts = known.select("page_key", "__own").union(asked).distinct().join(both.where("not __few"), "page_key", "left_semi")
    pairs = checkpointed(containments(texts.withColumnRenamed("__own", "text"), q))
    some = asked.join(both.where("__few"), "page_key", "left_semi").join(known.withColumnRenamed("__own", "__other"), "page_key")
    compared = some.where(F.contains("__own", "__other") | F.contains("__other", "__own")).select("page_key", "__own", "__first")
    of_known = lambda a, b: pairs.select("page_key", F.col(a).alias("__own"), F.col(b).alias("__other")).join(known.withColumnRenamed("__own", "__other"), ["page_key", "__other"]).select("page_key", "__own", "__first")
    blank = asked.where("__own = ''").join(known.groupBy("page_key").agg(F.min("__first").alias("__first")), "page_key").select("page_key", "__own", "__first")  # held by all
    from_blank = known.where("__own = ''").select("page_key", "__first").join(asked, "page_key").select("page_key", "__own", "__first")  # held in all
    first = known.select("page_key", "__own", "__first").union(of_known("held", "holder")).union(of_known("holder", "held")).union(compared).union(blank).union(from_blank)
    first = first.groupBy("page_key", "__own").agg(F.min("__first").alias("__first"))
    gone = (F.coalesce("post_id", F.lit("")) == "") & shown & F.coalesce(F.col("__first") < F.col("ord"), F.lit(False))
    return mine.join(first, ["page_key", "__own"], "left").where(~gone).select(*posts.columns)
