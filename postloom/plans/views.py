"""The given tables as users, jobs, sources, posts, metrics, rounds and progress.

Columns are written as SQL expressions that Spark and DuckDB read alike, so that a query's SQL starts from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from postloom.sources.readers import table

#: A line's key: order and line number repeat, so part, supplier and quantity are in it too.
_LINE = "(((l_orderkey * 8 + l_linenumber) * 200000 + l_partkey) * 1000 + l_suppkey) * 64 + CAST(floor(l_quantity) AS BIGINT)"
_VIDEO = "l_returnflag = 'R' OR l_linenumber % 8 = 0"
COLUMNS = {
    "users": ("customer", {
        "id": "c_custkey", "name": "c_name", "balance": "c_acctbal",
        "plan": "CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'basic' WHEN 'BUILDING' THEN 'Pro' WHEN 'FURNITURE' THEN 'team' WHEN 'HOUSEHOLD' THEN 'enterprise' WHEN 'MACHINERY' THEN 'free' END",
        "created_at": "DATE '2024-01-01' + CAST(c_custkey % 300 AS INT)",
    }),
    "jobs": ("orders", {
        "id": "o_orderkey", "owner_id": "o_custkey", "created_at": "o_orderdate", "max_posts": "o_orderkey % 7000", "n_urls": "o_custkey % 60", "cancel_requested": "o_orderkey % 17 = 0",
        "status": "CASE WHEN o_orderstatus = 'F' THEN 'completed' WHEN o_orderstatus = 'P' THEN 'failed' WHEN o_orderpriority LIKE '1%' THEN 'running' WHEN o_orderpriority LIKE '2%' THEN 'queued' ELSE 'paused' END",
        "target": "concat('https://www.social.example/Page', CAST(o_custkey % 97 AS STRING))",
    }),
    "posts": ("lineitem", {
        "id": _LINE, "job_id": "l_orderkey", "source_id": "l_suppkey", "ord": "l_linenumber",
        "post_id": "CASE WHEN l_partkey % 11 = 0 THEN NULL ELSE CAST(l_partkey % 50 AS STRING) END",
        "published_at": "CASE WHEN (l_orderkey + l_linenumber) % 13 = 0 THEN NULL ELSE l_shipdate END", "scraped_at": "l_shipdate",
        "post_type": "CASE WHEN l_returnflag = 'R' THEN 'video' WHEN l_returnflag = 'A' THEN 'image' WHEN l_linenumber % 4 = 0 THEN NULL WHEN l_linestatus = 'O' THEN 'link' ELSE 'text' END",
        "media_type": "CASE WHEN l_linenumber % 5 = 0 THEN 'Video' WHEN l_linenumber % 5 = 1 THEN 'image' END",
        "video_url": f"CASE WHEN {_VIDEO} THEN concat('https://v.example/', CAST(l_partkey AS STRING)) END",
        "media_url": "CASE WHEN l_returnflag = 'A' THEN concat('https://i.example/', CAST(l_partkey AS STRING)) END", "thumbnail_url": "CASE WHEN l_linenumber = 3 THEN 'https://i.example/t' END",
        "has_link": "l_partkey % 3 = 0",
    }),
    "engagement": ("lineitem", {
        "id": _LINE, "likes": "CASE WHEN l_linenumber % 7 = 3 THEN NULL ELSE CAST(floor(l_quantity * 3) AS BIGINT) END", "reactions": "CAST(floor(l_quantity * 4) AS BIGINT)",
        "comments_count": "CASE WHEN l_partkey % 5 = 0 THEN NULL ELSE CAST(floor(l_quantity) AS BIGINT) END", "shares": "l_partkey % 9",
        "views_count": "CASE WHEN l_linestatus = 'O' THEN CAST(floor(l_extendedprice) AS BIGINT) ELSE 0 END",
        "reaction_like_count": "l_partkey % 4", "reaction_love_count": "l_suppkey % 3", "reaction_care_count": "CAST(NULL AS BIGINT)", "reaction_haha_count": "l_linenumber % 2", "reaction_wow_count": "l_orderkey % 3",
        "reaction_sad_count": "CAST(0 AS BIGINT)", "reaction_angry_count": "CASE WHEN l_linenumber = 1 THEN l_partkey % 6 END",
    }),
    "texts": ("documents", {
        "ord": "doc_id", "source": "source", "post_id": "CASE WHEN doc_id % 4 = 0 THEN NULL ELSE CAST(doc_id % 700 AS STRING) END", "post_url": "concat('https://www.social.example/Page/posts/', CAST(doc_id % 700 AS STRING), '?ref=x')",
        "page_id": "source", "page_name": "concat('Page ', source)", "source_url": "concat('https://www.social.example/', source)", "text": "text",
        "published_at": "CAST(DATE '2024-01-01' + CAST(doc_id % 400 AS INT) AS TIMESTAMP)", "lang": "lang",
    }),
    "rounds": ("conversations", {"source": "conv_id", "round": "turn + 1", "items": "CASE WHEN length(text) % 3 = 0 THEN CAST(0 AS BIGINT) ELSE CAST(length(text) % 7 AS BIGINT) END", "has_more": "length(text) % 11 <> 0", "cancelled": "length(text) % 29 = 0", "failed": "length(text) % 31 = 0"}),
    "requests": ("events", {"ts": "ts", "path": "concat('/api/', event_type, '/', CAST(user_id % 5 AS STRING))", "failed": "event_type = 'error'", "value": "value", "job_id": "user_id", "seq": "event_id", "counters": "event_type"}),
    "pages": ("pages", {"page_key": "page_id", "url": "url", "html": "html"}),
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    source, columns = COLUMNS[name]
    return table(spark, sf_dir, source).selectExpr(*[f"{e} AS {c}" for c, e in columns.items()])


def sql(*names: str) -> str:
    """The views as the beginning of a WITH clause."""
    return "WITH " + ", ".join(f"{n}_v AS (SELECT {', '.join(f'{e} AS {c}' for c, e in COLUMNS[n][1].items())} FROM {COLUMNS[n][0]})" for n in names)


#: Sources have no table of their own: the suppliers of an order's lines, with counters from quantities.
_SOURCES = {
    "discovered": "CAST(sum(floor(l_quantity)) AS BIGINT)", "extracted": "CAST(sum(floor(l_quantity / 2)) AS BIGINT)", "duplicates_removed": "CAST(sum(l_linenumber) AS BIGINT)", "skipped": "count(*) * 2", "failed": "CAST(sum(l_linenumber % 2) AS BIGINT)",
    "errors_count": "CAST(min(l_linenumber) AS BIGINT)",
    "status": "CASE WHEN min(l_linenumber) % 4 = 0 THEN 'completed' WHEN min(l_linenumber) % 4 = 1 THEN 'running' WHEN min(l_linenumber) % 4 = 2 THEN 'failed' ELSE 'cancelled' END",
}
SOURCES_SQL = f"sources_v AS (SELECT l_orderkey AS job_id, l_suppkey AS source_id, {', '.join(f'{e} AS {c}' for c, e in _SOURCES.items())} FROM lineitem GROUP BY l_orderkey, l_suppkey)"


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("job_id"), F.col("l_suppkey").alias("source_id")).agg(*[F.expr(e).alias(c) for c, e in _SOURCES.items()])
