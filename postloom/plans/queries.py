"""Registered queries over the given tables, each beside the SQL that says what it returns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postloom import schemas
from postloom.functions import classify, numbers, text, time, urls
from postloom.operators import dedup, filters, joins, metrics, ordering, paging, search, updates
from postloom.plans import slices, views
from postloom.shared import new_folder
from postloom.sources import export, extract, readers
from postloom.streaming import streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
AS_OF = "TIMESTAMP '2024-06-15 10:00:00'"


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def v(spark: SparkSession, sf: str, *names: str) -> list[DataFrame]:
    return [views.view(spark, sf, n) for n in names]


S = views.sql
_ISO = "strftime({}, '%Y-%m-%dT%H:%M:%SZ')"


def parsed_texts(spark: SparkSession, sf: str) -> DataFrame:
    t = views.view(spark, sf, "texts")
    have = set(t.columns)
    return t.select("source", "ord", "page_id", "page_name", "source_url", *[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schemas.PARSED_POST if f.name != "source_url"])


# The clean text of posts, as SQL: white space as Python has it, then control characters.
_WS = "[\\t-\\r\\x1C-\\x20\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]+"
_T = f"nullif(trim(regexp_replace(trim(regexp_replace(text, '{_WS}', ' ', 'g')), '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]', '', 'g')), '')"
_FP = "sha256(coalesce(page_id, '') || '|' || coalesce(CAST(CAST(epoch(published_at) AS BIGINT) AS VARCHAR), '') || '|' || substr(coalesce(t, ''), 1, 200))"
_KEY = f"CASE WHEN coalesce(post_id, '') <> '' THEN 'id:' || post_id ELSE 'fp:' || {_FP} END"
_JUDGED = f"""{S("texts")}, n AS (SELECT *, {_T} AS t FROM texts_v),
k AS (SELECT *, {_KEY} AS key, coalesce(CAST(published_at AS DATE) BETWEEN DATE '2024-02-01' AND DATE '2024-12-31', false) AND t IS NOT NULL AS ok FROM n),
f AS (SELECT *, row_number() OVER (PARTITION BY source, key, ok ORDER BY ord) = 1 AS first FROM k),
p AS (SELECT *, sum(CASE WHEN ok AND first THEN 1 ELSE 0 END) OVER (PARTITION BY source ORDER BY ord) AS place FROM f),
d AS (SELECT *, CASE WHEN NOT ok THEN 'filtered' WHEN NOT first THEN 'duplicate' WHEN place > 30 THEN 'capped' ELSE 'extracted' END AS disposition FROM p)"""


@query(f"""{_JUDGED} SELECT source, count(*) AS discovered, count(*) FILTER (disposition = 'extracted') AS extracted, count(*) FILTER (disposition = 'duplicate') AS duplicates_removed,
count(*) FILTER (disposition IN ('filtered', 'duplicate', 'capped')) AS skipped, count(*) FILTER (disposition = 'failed') AS failed, true AS balanced FROM d GROUP BY source""")
def flagship_slice(spark, sf):
    """P1, F1, B4, W2, A7."""
    return slices.slice_of(parsed_texts(spark, sf), F.expr(AS_OF), start="2024-02-01", end="2024-12-31", post_type="text", most=30)


@query(f"{_JUDGED} SELECT source, ord, disposition FROM d")
def w2_capped_posts(spark, sf):
    canonical = _canonical(spark, sf)
    return slices.judged(canonical, "source", "2024-02-01", "2024-12-31", "text", 30).select("source", "ord", "disposition")


def _canonical(spark, sf):
    from postloom.operators.normalize import normalize_posts

    return normalize_posts(parsed_texts(spark, sf), F.col("page_name"), F.col("page_id"), F.col("source_url"), F.expr(AS_OF), keep=("source", "ord"))


@query(f"""{S("texts")} SELECT ord, post_id, source_url, post_url, page_name, page_id, source_url AS profile_url, CASE WHEN {_T} IS NOT NULL THEN 'text' END AS post_type, CAST(epoch(published_at) AS BIGINT) AS timestamp, {_T} AS text,
list_aggregate(list_distinct_ordered, 'string_agg', '|') AS hashtags FROM (SELECT *, list_filter(regexp_extract_all({_T}, '#[A-Za-z0-9_\\x{{80}}-\\x{{FFFF}}]+'), lambda x, i: list_position(regexp_extract_all({_T}, '#[A-Za-z0-9_\\x{{80}}-\\x{{FFFF}}]+'), x) = i) AS list_distinct_ordered FROM texts_v)""")
def p1_normalized_posts(spark, sf):
    c = _canonical(spark, sf)
    tags = F.when(F.size("hashtags") > 0, text.joined(F.col("hashtags")))
    return c.select("ord", "post_id", "source_url", "post_url", "page_name", "page_id", "profile_url", "post_type", "timestamp", "text", tags.alias("hashtags"))


@query(f"SELECT doc_id, {_T} AS clean FROM documents")
def c1_clean_text(spark, sf):
    return readers.table(spark, sf, "documents").select("doc_id", text.clean_text(F.col("text")).alias("clean"))


def _listed(pattern: str, item: str = "x") -> str:
    one = f"list_transform(regexp_extract_all({_T}, '{pattern}'), lambda x: {item})"
    return f"coalesce(array_to_string(list_filter({one}, lambda x, i: list_position({one}, x) = i), '|'), '')"


@query(f"SELECT doc_id, {_listed('#[A-Za-z0-9_\\x{80}-\\x{FFFF}]+')} AS tags FROM documents")
def c2_hashtags(spark, sf):
    return readers.table(spark, sf, "documents").select("doc_id", text.joined(text.hashtags(text.clean_text(F.col("text")))).alias("tags"))


_STRIP = "regexp_replace(x, '[.,;:!?]+$', '')"


@query(f"SELECT doc_id, {_listed('@[A-Za-z0-9_.\\-\\x{80}-\\x{FFFF}]+', _STRIP)} AS names FROM documents")
def c3_mentions(spark, sf):
    return readers.table(spark, sf, "documents").select("doc_id", text.joined(text.mentions(text.clean_text(F.col("text")))).alias("names"))


@query("""SELECT doc_id, array_to_string(list_filter(w, lambda x, i: x <> '' AND list_position(w, x) = i), '|') AS words FROM (SELECT doc_id, string_split(text, ' ') AS w FROM documents)""")
def c5_unique_items(spark, sf):
    return readers.table(spark, sf, "documents").select("doc_id", text.joined(text.unique(F.split("text", " "))).alias("words"))


_TITLE = "regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '<[^>]*>', '', 'g')"
_UNESC = "replace(replace(replace(replace(replace({}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&amp;', '&')"


@query(f"SELECT page_id AS page_key, url, nullif(trim(regexp_replace({_UNESC.format(_TITLE)}, '{_WS}', ' ', 'g')), '') AS page_name, CAST(NULL AS VARCHAR) AS page_id, url AS profile_url, CAST(NULL AS VARCHAR) AS og_image FROM pages")
def x1_page_meta(spark, sf):
    return extract.page_meta(views.view(spark, sf, "pages")).withColumn("page_id", F.col("page_id").cast("string"))


@query("SELECT page_id AS page_key, len(regexp_extract_all(html, '(?i)<article'))::BIGINT AS n FROM pages WHERE regexp_matches(html, '(?i)<article')")
def x2_post_roots(spark, sf):
    parts = extract.dom_parts(views.view(spark, sf, "pages"))
    return parts.where("error is null").groupBy("page_key").agg(F.count(F.lit(1)).alias("n"))


def _tagless(element: str) -> str:
    """The words of the given pages' one element of a kind: tags become spaces."""
    words = f"regexp_replace(regexp_extract(html, '(?s)<{element}\\b[^>]*>(.*)</{element}>', 1), '<[^>]*>', ' ', 'g')"
    for name, sign in (("&quot;", '"'), ("&#x27;", "''"), ("&#39;", "''"), ("&lt;", "<"), ("&gt;", ">"), ("&middot;", "\u00b7"), ("&copy;", "\u00a9"), ("&amp;", "&")):
        words = f"replace({words}, '{name}', '{sign}')"
    return f"nullif(trim(regexp_replace({words}, '{_WS}', ' ', 'g')), '')"


@query(f"""SELECT page_id AS page_key, 1 AS ord, NULL::VARCHAR AS post_id, NULL::VARCHAR AS post_url, {_tagless('title')} AS page_name, 'text' AS post_type, {_tagless('article')} AS text, NULL::BIGINT AS likes, NULL::BIGINT AS comments_count FROM pages WHERE contains(html, '<article')""")
def x15_extracted_posts(spark, sf):
    posts, _ = extract.extract(views.view(spark, sf, "pages"), F.expr(AS_OF))
    return posts.select("page_key", "ord", "post_id", "post_url", "page_name", "post_type", "text", "likes", "comments_count")


@query(f"""SELECT page_id AS page_key, 0 AS ord, array_to_string(regexp_extract_all(regexp_extract(html, '(?s)<article\\b[^>]*>(.*)</article>', 1), 'href="(https?://[^"]+)"', 1), '|') AS links, array_to_string(regexp_extract_all({_tagless('article')}, '@([A-Za-z0-9_.-]+)', 1), '|') AS names
FROM pages WHERE contains(html, '<article')""")
def x8_links_and_mentions(spark, sf):
    parts = extract.posts_from_parts(extract.dom_parts(views.view(spark, sf, "pages")), F.expr(AS_OF))
    return parts.select("page_key", "ord", text.joined(F.col("external_links")).alias("links"), text.joined(F.col("mentions")).alias("names"))


def _markers(verdict: str) -> str:
    return classify.marker_pattern(verdict).replace("'", "''")


_SHOWN = "lower(regexp_replace(regexp_replace(substr(html, 1, 400000), '(?is)<script\\b[^>]*>.*?</script>', '', 'g'), '(?is)<style\\b[^>]*>.*?</style>', '', 'g'))"


@query(f"""SELECT page_id AS page_key, CASE WHEN length(html) < 200 THEN 'empty' WHEN regexp_matches({_SHOWN}, '{_markers("not_found")}') THEN 'not_found' WHEN regexp_matches({_SHOWN}, '{_markers("wall")}') THEN 'wall'
WHEN regexp_matches({_SHOWN}, '{_markers("traffic")}') THEN 'traffic' ELSE 'ok' END AS verdict FROM (SELECT page_id, CASE WHEN page_id % 5 = 0 THEN replace(html, '<article>', '<article>Log in to see more of this. ') WHEN page_id % 5 = 1 THEN replace(html, '<article>', '<b>captcha</b><article>') WHEN page_id % 7 = 3 THEN substr(html, 1, 150) ELSE html END AS html FROM pages)""")
def k3_page_verdicts(spark, sf):
    p = views.view(spark, sf, "pages").withColumn("html", F.expr("CASE WHEN page_key % 5 = 0 THEN replace(html, '<article>', '<article>Log in to see more of this. ') WHEN page_key % 5 = 1 THEN replace(html, '<article>', '<b>captcha</b><article>') WHEN page_key % 7 = 3 THEN substr(html, 1, 150) ELSE html END"))
    return p.select("page_key", classify.page_verdict(F.col("html")).alias("verdict"))


_SCALED = "regexp_extract(x, '(?i)(?:^|[^0-9.])([0-9][0-9.,]*)\\s*([km])\\b', {})"
_NUM = "regexp_extract(x, '(?:^|[^0-9.])([0-9][0-9.,]*)\\b', 1)"


@query(f"""WITH s AS (SELECT event_id, CASE event_id % 6 WHEN 0 THEN value || 'K likes' WHEN 1 THEN 'All reactions: ' || event_id WHEN 2 THEN '1,' || (100 + event_id % 900) || ' Comments' WHEN 3 THEN value || ' M views' WHEN 4 THEN event_type || ' 1.2.' || event_id ELSE event_type END AS x FROM (SELECT event_id, event_type, CAST(CAST(value AS DECIMAL(18, 2)) AS VARCHAR) AS value FROM events))
SELECT event_id, CASE WHEN {_SCALED.format(1)} <> '' THEN CAST(trunc(TRY_CAST(replace({_SCALED.format(1)}, ',', '') AS DOUBLE) * CASE lower({_SCALED.format(2)}) WHEN 'k' THEN 1000.0::DOUBLE ELSE 1000000.0::DOUBLE END) AS BIGINT)
WHEN {_NUM} <> '' THEN CAST(trunc(TRY_CAST(replace({_NUM}, ',', '') AS DOUBLE)) AS BIGINT) END AS n FROM s""")
def n1_parse_count(spark, sf):
    e = readers.table(spark, sf, "events").withColumn("value", F.col("value").cast("decimal(18,2)").cast("string"))
    x = F.expr("CASE event_id % 6 WHEN 0 THEN concat(value, 'K likes') WHEN 1 THEN concat('All reactions: ', event_id) WHEN 2 THEN concat('1,', 100 + event_id % 900, ' Comments') WHEN 3 THEN concat(value, ' M views') WHEN 4 THEN concat(event_type, ' 1.2.', event_id) ELSE event_type END")
    return e.select("event_id", numbers.parse_count(x).alias("n"))


@query("""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN event_id END AS comments, CASE WHEN event_id % 2 = 0 THEN event_id * 1000 END AS views FROM events""")
def n2_count_near(spark, sf):
    x = F.concat(F.lit("a long way of words before it all "), F.when(F.col("event_id") % 3 == 0, F.concat("event_id", F.lit(" Comments"))).otherwise("no such"), F.lit(" and then some more words to keep apart "), F.when(F.col("event_id") % 2 == 0, F.concat("event_id", F.lit("K views"))).otherwise("none"))
    return readers.table(spark, sf, "events").select("event_id", numbers.count_near(x, ("comment",)).alias("comments"), numbers.count_near(x, ("seen", "view")).alias("views"))


@query("SELECT event_id, TRY_CAST(CASE WHEN event_id % 3 = 0 THEN ' ' || event_id || ' ' WHEN event_id % 3 = 1 THEN event_type END AS BIGINT) AS n FROM events")
def n3_int_or_none(spark, sf):
    return readers.table(spark, sf, "events").select("event_id", numbers.int_or_none(F.expr("CASE WHEN event_id % 3 = 0 THEN concat(' ', event_id, ' ') WHEN event_id % 3 = 1 THEN event_type END")).alias("n"))


_PARTS = " + ".join(f"coalesce({c}, 0)" for c in schemas.REACTION_COUNTS)


@query(f"{S('engagement')} SELECT id, coalesce(CASE WHEN reactions % 2 = 0 THEN reactions END, nullif({_PARTS}, 0)) AS total FROM engagement_v")
def n4_reactions_total(spark, sf):
    (e,) = v(spark, sf, "engagement")
    return e.select("id", numbers.reactions_total(F.when(F.col("reactions") % 2 == 0, F.col("reactions")), [F.col(c) for c in schemas.REACTION_COUNTS]).alias("total"))


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 = 0 THEN 'unbounded' WHEN greatest(0, o_orderkey % 50 - o_custkey % 60) = 0 THEN 'exhausted' WHEN (o_orderkey % 50 - o_custkey % 60) * 2 >= o_orderkey % 50 THEN 'healthy' ELSE 'warning' END AS tone FROM orders")
def n6_usage_tone(spark, sf):
    o = readers.table(spark, sf, "orders")
    return o.select(F.col("o_orderkey").alias("id"), numbers.usage_tone(F.col("o_custkey") % 60, F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderkey") % 50)).alias("tone"))


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 9 > 0 THEN least(greatest((o_custkey % 12)::DOUBLE / (o_orderkey % 9), 0.0), 1.0)::DOUBLE END AS progress FROM orders")
def n8_job_progress(spark, sf):
    o = readers.table(spark, sf, "orders")
    return o.select(F.col("o_orderkey").alias("id"), numbers.progress(F.col("o_custkey") % 12, F.col("o_orderkey") % 9).alias("progress"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN microsecond(ts) % 1000000 = 0 THEN '' ELSE '.' || strftime(ts, '%f') END || 'Z' AS iso, CAST(floor(epoch(ts)) AS BIGINT) AS epoch FROM events")
def c4_iso_times(spark, sf):
    """C4, D1."""
    ts = F.col("ts").cast("timestamp")
    return readers.table(spark, sf, "events").select("event_id", time.iso(ts).alias("iso"), time.iso_and_epoch(ts)[1].alias("epoch"))


@query("SELECT event_id, CASE WHEN event_id % 4 = 3 THEN NULL ELSE strftime(date_trunc('second', ts) - CASE WHEN event_id % 4 = 1 THEN INTERVAL 6 HOUR ELSE INTERVAL 0 HOUR END, '%Y-%m-%dT%H:%M:%SZ') END AS iso FROM events")
def d2_parse_iso(spark, sf):
    s = F.date_format(F.col("ts"), "yyyy-MM-dd'T'HH:mm:ss")
    x = F.when(F.col("event_id") % 4 == 0, F.concat(s, F.lit("Z"))).when(F.col("event_id") % 4 == 1, F.concat(s, F.lit("+06:00"))).when(F.col("event_id") % 4 == 2, s).otherwise(F.col("event_type"))
    return readers.table(spark, sf, "events").select("event_id", time.iso(time.parse_iso(x)).alias("iso"))


_UNIT = "CASE event_id % 8 WHEN 0 THEN 's' WHEN 1 THEN 'min' WHEN 2 THEN 'hours' WHEN 3 THEN 'd' WHEN 4 THEN 'wk' WHEN 5 THEN 'mo' WHEN 6 THEN 'yr' ELSE 'eons' END"
_SECONDS = "CASE event_id % 8 WHEN 1 THEN 60 WHEN 2 THEN 3600 WHEN 3 THEN 86400 WHEN 4 THEN 604800 WHEN 5 THEN 2592000 WHEN 6 THEN 31536000 END"


@query(f"""SELECT event_id, strftime(CASE WHEN event_id % 10 = 9 THEN make_timestamp(CAST((1700000000 + event_id) * 1000000 AS BIGINT)) WHEN event_id % 10 = 8 THEN TIMESTAMP '2024-06-14 17:30:00' WHEN event_id % 10 = 7 THEN {AS_OF} WHEN user_id % 30 > 0 THEN {AS_OF} - to_seconds(CAST((user_id % 30) * {_SECONDS} AS BIGINT)) END, '%Y-%m-%dT%H:%M:%SZ') AS iso FROM events""")
def d3_parse_timestamp(spark, sf):
    x = F.expr(f"CASE WHEN event_id % 10 = 9 THEN CAST(1700000000 + event_id AS STRING) WHEN event_id % 10 = 8 THEN 'Yesterday at  5:30 PM' WHEN event_id % 10 = 7 THEN 'Just now' ELSE concat(user_id % 30, ' ', {_UNIT}, CASE WHEN event_id % 3 = 0 THEN ' ago' ELSE '' END) END")
    return readers.table(spark, sf, "events").select("event_id", time.iso(time.parse_timestamp(x, F.expr(AS_OF))).alias("iso"))


_DAY = "DATE '2023-08-01' + CAST(event_id % 500 AS INT)"


@query(f"""SELECT event_id, strftime(CASE event_id % 4 WHEN 0 THEN CAST(d AS TIMESTAMP) + INTERVAL 20 HOUR + INTERVAL 5 MINUTE WHEN 1 THEN CAST(d AS TIMESTAMP) WHEN 2 THEN CAST(d AS TIMESTAMP) + INTERVAL 21 HOUR + INTERVAL 29 MINUTE
ELSE (CASE WHEN make_date(2024, month(d), CASE WHEN day(d) > 28 THEN 28 ELSE day(d) END) > {AS_OF} + INTERVAL 1 DAY THEN make_date(2023, month(d), CASE WHEN day(d) > 28 THEN 28 ELSE day(d) END) ELSE make_date(2024, month(d), CASE WHEN day(d) > 28 THEN 28 ELSE day(d) END) END)::TIMESTAMP END, '%Y-%m-%dT%H:%M:%SZ') AS iso FROM (SELECT event_id, {_DAY} AS d FROM events)""")
def d4_absolute_times(spark, sf):
    e = readers.table(spark, sf, "events").withColumn("d", F.expr(_DAY))
    safe = F.make_date(F.year("d"), F.month("d"), F.least(F.dayofmonth("d"), F.lit(28)))
    x = (
        F.when(F.col("event_id") % 4 == 0, F.concat(F.date_format("d", "MMMM d, yyyy"), F.lit(" at 8:05 PM"))).when(F.col("event_id") % 4 == 1, F.date_format("d", "MMM d, yyyy"))
        .when(F.col("event_id") % 4 == 2, F.concat(F.date_format("d", "d MMMM yyyy"), F.lit(" at 21:29"))).otherwise(F.date_format(safe, "d MMMM"))
    )
    return e.select("event_id", time.iso(time.absolute(x, F.expr(AS_OF))).alias("iso"))


#: A text of each form of dates, on both sides of the year's end, and when it is, seen from AS_OF.
_DATED = {
    "August 15, 2023 at 3:05 PM": "2023-08-15 15:05:00", "Aug 15, 2023 at 15:05": "2023-08-15 15:05:00", "March 3 at 9:30 AM": "2024-03-03 09:30:00", "Dec 24 at 9:30 PM": "2023-12-24 21:30:00",
    "Jan 2, 2022": "2022-01-02 00:00:00", "15 August 2023 at 15:05": "2023-08-15 15:05:00", "3 Mar at 21:15": "2024-03-03 21:15:00", "3 March at 9:15 pm": "2024-03-03 21:15:00", "7 July 2021": "2021-07-07 00:00:00",
    "5 May": "2024-05-05 00:00:00", "16 June": "2024-06-16 00:00:00", "17 June": "2023-06-17 00:00:00", "2023-02-03": "2023-02-03 00:00:00", "2023-02-03 04:05:06": "2023-02-03 04:05:06",
    "2023-02-03T04:05:06Z": "2023-02-03 04:05:06", "2023-02-03T04:05:06+02:00": "2023-02-03 02:05:06", "33 March": None, "no date": None,
}


@query(f"SELECT doc_id, ({[v or '' for v in _DATED.values()]})[doc_id % {len(_DATED)} + 1] AS at FROM documents")
def d4_forms_of_dates(spark, sf):
    said = F.get(F.array(*map(F.lit, _DATED)), (F.col("doc_id") % len(_DATED)).cast("int"))
    at = time.absolute(F.col("said"), F.expr(AS_OF))
    return readers.table(spark, sf, "documents").select("doc_id", said.alias("said")).select("doc_id", F.coalesce(F.date_format(at, "yyyy-MM-dd HH:mm:ss"), F.lit("")).alias("at"))


@query("SELECT event_id, strftime(make_timestamp(CAST(1700000000 + event_id AS BIGINT) * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS iso FROM events")
def d5_epoch_guess(spark, sf):
    n = F.expr("CASE WHEN event_id % 2 = 0 THEN 1700000000 + event_id ELSE (1700000000 + event_id) * 1000 END")
    return readers.table(spark, sf, "events").select("event_id", time.iso(time.epoch_guess(n)).alias("iso"))


@query(f"{S('posts')} SELECT days, count(*) AS n FROM posts_v, (VALUES (7), (30), (90), (365)) AS w(days) WHERE published_at >= DATE '1998-01-01' - days AND published_at < DATE '1998-01-02' GROUP BY days")
def d6_preset_windows(spark, sf):
    (p,) = v(spark, sf, "posts")
    today, day = F.lit("1998-01-01").cast("date"), F.to_date("published_at")
    spans = {n: time.preset_window(n, today) for n in (7, 30, 90, 365)}
    counts = p.agg(*[F.count_if(day.between(a, z)).alias(f"d{n}") for n, (a, z) in spans.items()])
    return counts.select(F.inline(F.array(*[F.struct(F.lit(n).alias("days"), F.col(f"d{n}").alias("n")) for n in spans])))


_BASE = "regexp_replace(regexp_replace(url, '[?#].*$', ''), '/+$', '')"


@query(f"SELECT page_id, {_BASE} || CASE WHEN regexp_matches({_BASE}, '^https?://[^/]*$') THEN '/' ELSE '' END || '?a=' || (page_id % 7) || '&a=z+1' AS url FROM pages")
def u1_post_urls(spark, sf):
    x = F.concat(F.regexp_replace("url", "[?#].*$", ""), F.lit("/?fbclid=1&a="), F.col("page_id") % 7, F.lit("&b=&Ref=q&a=z%201#top"))
    return readers.table(spark, sf, "pages").select("page_id", urls.normalize_post_url(x).alias("url"))


_RAW_URL = "CASE o_orderkey % 9 WHEN 0 THEN concat('https://www.social.example/Page', CAST(o_custkey % 97 AS STRING), '/') WHEN 1 THEN concat('social.example/pg/Page', CAST(o_custkey % 97 AS STRING)) WHEN 2 THEN concat('//m.social.example/profile.php?id=', CAST(10000 + o_custkey AS STRING)) WHEN 3 THEN 'https://www.social.example/groups/9' WHEN 4 THEN 'ftp://social.example/x' WHEN 5 THEN 'https://other.example/Page' WHEN 6 THEN concat('https://social.example/Page', CAST(o_custkey % 97 AS STRING), '/Photos?x=1') WHEN 7 THEN concat('https://social.example/people/Some-One/', CAST(100000 + o_custkey AS STRING)) ELSE '  ' END"
_NORMAL_URL = "CASE WHEN o_orderkey % 9 IN (0, 1, 6) THEN 'https://www.social.example/Page' || (o_custkey % 97) WHEN o_orderkey % 9 = 2 THEN 'https://www.social.example/profile.php?id=' || (10000 + o_custkey) WHEN o_orderkey % 9 = 7 THEN 'https://www.social.example/people/Some-One/' || (100000 + o_custkey) END"
_REASON = "CASE o_orderkey % 9 WHEN 3 THEN 'reserved_path' WHEN 4 THEN 'scheme_not_http' WHEN 5 THEN 'not_site' WHEN 8 THEN 'malformed' END"


@query(f"SELECT o_orderkey AS id, {_NORMAL_URL} IS NOT NULL AS valid, {_NORMAL_URL} AS normalized_url, {_REASON} AS reason FROM orders")
def u2_source_urls(spark, sf):
    return readers.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), urls.classify_source(F.expr(_RAW_URL)).alias("u")).select("id", "u.*")


@query(f"SELECT o_orderkey AS id, CASE WHEN o_orderkey % 9 IN (0, 1, 6) THEN 'Page' || (o_custkey % 97) WHEN o_orderkey % 9 = 2 THEN '' || (10000 + o_custkey) ELSE '' || (100000 + o_custkey) END AS handle, CASE o_orderkey % 9 WHEN 2 THEN '' || (10000 + o_custkey) WHEN 7 THEN '' || (100000 + o_custkey) END AS page_id FROM orders WHERE {_NORMAL_URL} IS NOT NULL")
def u3_handles_and_page_ids(spark, sf):
    """U3, U4."""
    n = readers.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), urls.classify_source(F.expr(_RAW_URL))["normalized_url"].alias("n")).where("n is not null")
    return n.select("id", urls.handle(F.col("n")).alias("handle"), urls.page_id(F.col("n")).alias("page_id"))


_HREF = "CASE event_id % 7 WHEN 0 THEN concat('/story.php?id=1&story_fbid=', event_id) WHEN 1 THEN concat('/Page/posts/', event_id, '?x=1') WHEN 2 THEN concat('/photos/a.1/', event_id, '/?type=3') WHEN 3 THEN concat('/watch/?v=', event_id) WHEN 4 THEN concat('/reel/', event_id) WHEN 5 THEN concat('/Page/videos/', event_id) ELSE '/Page/about' END"


@query("SELECT event_id, CASE WHEN event_id % 7 < 6 THEN CAST(event_id AS VARCHAR) END AS post_id FROM events")
def u5_post_ids(spark, sf):
    return readers.table(spark, sf, "events").select("event_id", urls.post_id(F.expr(_HREF)).alias("post_id"))


@query("SELECT page_id, url AS target FROM pages")
def u6_unshimmed_links(spark, sf):
    return readers.table(spark, sf, "pages").select("page_id", urls.unshim(F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("https://l.social.example/l.php?h=1&u="), F.url_encode("url"))).otherwise(F.col("url"))).alias("target"))


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'https://www.social.example/x/' || event_id WHEN 1 THEN 'https://cdn.example/' || event_id WHEN 2 THEN 'https://www.social.example/Page/p' || event_id ELSE 'http://a.example/' || event_id END AS url FROM events")
def u7_absolute_urls(spark, sf):
    href = F.expr("CASE event_id % 4 WHEN 0 THEN concat('/x/', event_id) WHEN 1 THEN concat('//cdn.example/', event_id) WHEN 2 THEN concat('p', event_id) ELSE concat('http://a.example/', event_id) END")
    return readers.table(spark, sf, "events").select("event_id", urls.absolute(href, F.lit("https://www.social.example/Page/top?x=1")).alias("url"))


@query("SELECT page_id, CASE WHEN page_id % 3 = 0 THEN url END AS url FROM pages WHERE page_id % 3 = 0")
def f10_safe_links(spark, sf):
    p = readers.table(spark, sf, "pages").select("page_id", F.when(F.col("page_id") % 3 == 0, F.concat(F.lit(" "), "url", F.lit(" "))).when(F.col("page_id") % 3 == 1, F.lit("javascript:alert(1)")).otherwise("https://").alias("url"))
    return filters.safe_links(p, "url")


_KIND = "CASE WHEN post_type = 'video' OR video_url IS NOT NULL THEN 'video' WHEN has_link AND post_type IS DISTINCT FROM 'image' THEN 'link' WHEN post_type = 'image' OR media_url IS NOT NULL OR thumbnail_url IS NOT NULL THEN 'image' WHEN has_link THEN 'link' ELSE 'text' END"


@query(f"{S('posts')} SELECT id, {_KIND} AS post_type, CASE WHEN {_KIND} IN ('video', 'image') THEN {_KIND} END AS media_type FROM posts_v")
def k1_post_types(spark, sf):
    """K1, K2."""
    (p,) = v(spark, sf, "posts")
    links = F.when(F.col("has_link"), F.array(F.lit("https://a.example"))).otherwise(F.array().cast("array<string>"))
    kind = classify.post_type(F.col("post_type") == "video", F.col("video_url"), F.col("post_type") == "image", F.col("media_url"), F.col("thumbnail_url"), F.lit(False), links, F.lit("x"))
    kind = classify.upgraded(kind, F.col("video_url"), F.col("media_url"), F.col("thumbnail_url"))
    return p.select("id", kind.alias("post_type"), classify.media_type(kind).alias("media_type"))


@query("SELECT event_id, CASE event_type WHEN 'error' THEN 'timeout' WHEN 'view' THEN 'rate_limited' ELSE 'scrape_failed' END AS code FROM events")
def k4_error_codes(spark, sf):
    return readers.table(spark, sf, "events").select("event_id", classify.error_code(F.expr("CASE event_type WHEN 'error' THEN 'Timeout' WHEN 'view' THEN 'RateLimited' ELSE 'Odd' END")).alias("code"))


@query(f"{S('texts')} SELECT ord, page_name AS name, lower(trim(regexp_replace(replace(text || ' Shared with Public', 'Shared with Public', ''), '{_WS}', ' ', 'g'))) AS dom FROM texts_v")
def c8_page_names_and_dom_text(spark, sf):
    """C8, C11."""
    (t,) = v(spark, sf, "texts")
    return t.select("ord", text.page_name(F.concat("page_name", F.lit("  | Social ")), "Social").alias("name"), text.dom_text(F.concat("text", F.lit(" Shared with Public"))).alias("dom"))


@query(f"""{S('requests')}, l AS (SELECT regexp_replace(path, '/[0-9]+', '/{{id}}', 'g') AS family FROM requests_v),
t AS (SELECT family, row_number() OVER (ORDER BY count(*) DESC, family) <= 3 AS known FROM l GROUP BY family) SELECT CASE WHEN known THEN family ELSE 'other' END AS family, count(*) AS n FROM l JOIN t USING (family) GROUP BY 1""")
def c12_path_families(spark, sf):
    (r,) = v(spark, sf, "requests")
    return metrics.counts_by(metrics.capped_families(r, 3), "family")


@query("""SELECT doc_id, array_to_string(w, '|') AS joined, '[' || array_to_string(list_transform(w, lambda x: '"' || replace(x, '\\', '\\\\') || '"'), ',') || ']' AS json FROM (SELECT doc_id, regexp_extract_all(text, '[a-zA-Z]+') AS w FROM documents)""")
def m1_lists(spark, sf):
    """M1, M2."""
    w = F.regexp_extract_all("text", F.lit("[a-zA-Z]+"), F.lit(0))
    return readers.table(spark, sf, "documents").select("doc_id", text.joined(w).alias("joined"), text.as_json(w).alias("json"))


# Filters and searches


@query(f"{S('posts')} SELECT id FROM posts_v WHERE post_type = 'image' AND CAST(published_at AS DATE) BETWEEN DATE '1995-01-01' AND DATE '1997-06-30'")
def f1_date_type_filter(spark, sf):
    (p,) = v(spark, sf, "posts")
    filters.check_options(["https://www.social.example/a"], 10, "1995-01-01", "1997-06-30", "image")
    return filters.date_type_filter(p, "1995-01-01", "1997-06-30", "image").select("id")


@query(f"{S('jobs')} SELECT id, status FROM jobs_v WHERE status IN ('running', 'failed')")
def f3_jobs_by_status(spark, sf):
    return filters.with_status(views.view(spark, sf, "jobs"), " Running, failed,").select("id", "status")


@query(f"{S('jobs')} SELECT id AS job_id, owner_id + id % 2 AS owner_id, CASE id % 3 WHEN 0 THEN 'csv' WHEN 1 THEN 'xlsx' ELSE 'pdf' END AS format, CASE WHEN id % 3 = 2 THEN 'unknown_format' WHEN id % 2 = 1 THEN 'not_found' WHEN status IN ('queued', 'running') THEN 'job_not_finished' END AS refused FROM jobs_v")
def s10_export_gate(spark, sf):
    """Each job asked for by its owner or another."""
    (j,) = v(spark, sf, "jobs")
    asked = j.select(F.col("id").alias("job_id"), (F.col("owner_id") + F.col("id") % 2).alias("owner_id"), F.expr("CASE id % 3 WHEN 0 THEN 'csv' WHEN 1 THEN 'xlsx' ELSE 'pdf' END").alias("format"))
    return export.export_gate(j, asked)


@query(f"{S('jobs')} SELECT id, owner_id, status FROM jobs_v WHERE owner_id = 7")
def s2_jobs_of_owner(spark, sf):
    return filters.of_owner(views.view(spark, sf, "jobs"), 7).select("id", "owner_id", "status")


@query(f"{S('jobs')} SELECT id, owner_id, status, 'own' AS asked FROM jobs_v WHERE id = (SELECT max(id) FROM jobs_v) UNION ALL SELECT id, owner_id, status, 'any' FROM jobs_v WHERE id = (SELECT max(id) FROM jobs_v)")
def s2_job_of_owner(spark, sf):
    """One job, asked for by its owner, by another, and without an owner."""
    jobs = views.view(spark, sf, "jobs")
    newest = jobs.agg(F.max_by("id", "id").alias("id"), F.max_by("owner_id", "id").alias("owner_id")).first()
    asked = {"own": newest["owner_id"], "other": newest["owner_id"] + 1, "any": None}
    return dedup.union_all([filters.job_of_owner(jobs, newest["id"], owner).select("id", "owner_id", "status", F.lit(k).alias("asked")) for k, owner in asked.items()])


@query(f"{S('texts')} SELECT ord FROM texts_v WHERE contains(lower(concat_ws(' ', nullif(page_name, ''), nullif(page_id, ''), nullif(post_id, ''), nullif(text, ''))), 'eatio')")
def f5_post_search(spark, sf):
    return filters.search(views.view(spark, sf, "texts"), "  EATIO ", ["page_name", "page_id", "post_id", "text"]).select("ord")


@query(f"{S('texts')} SELECT ord FROM texts_v WHERE contains(lower(concat_ws(' ', nullif(page_name, ''), nullif(page_id, ''), nullif(post_id, ''), nullif(text, ''))), 'eatio')")
def f5_indexed_search(spark, sf):
    """By the trigrams of the query."""
    rows = views.view(spark, sf, "texts").select("ord", "page_name", "page_id", "post_id", "text")
    return search.TrigramTable(rows, "ord", ["page_name", "page_id", "post_id", "text"], new_folder(spark, "trigrams")).write().search("  EATIO ").select("ord")


@query(f"{S('jobs')} SELECT DISTINCT target FROM jobs_v WHERE contains(lower(target), 'page8')")
def f7_indexed_suggestions(spark, sf):
    targets = views.view(spark, sf, "jobs").select("target").distinct()
    return search.TrigramTable(targets, "target", ["target"], new_folder(spark, "trigrams")).write().search("PAGE8")


@query(f"{S('jobs')} SELECT id FROM jobs_v WHERE contains(lower(concat_ws(' ', CAST(id AS VARCHAR), target)), 'page9')")
def f6_job_search(spark, sf):
    return filters.search(views.view(spark, sf, "jobs"), "Page9", ["id", "target"]).select("id")


@query(f"{S('jobs')} SELECT DISTINCT target FROM jobs_v WHERE contains(lower(target), 'page8')")
def f7_suggestions(spark, sf):
    return filters.suggestions(views.view(spark, sf, "jobs").select("target").distinct(), "PAGE8")


@query(f"{S('posts')} SELECT id FROM posts_v WHERE post_id IS NOT NULL OR thumbnail_url IS NOT NULL OR media_url IS NOT NULL OR video_url IS NOT NULL OR coalesce(post_type = 'video', false)")
def f8_has_signal(spark, sf):
    (p,) = v(spark, sf, "posts")
    return filters.has_signal(p.withColumns({"text": F.lit(None).cast("string"), "has_image": F.lit(None).cast("boolean"), "has_video": F.col("post_type") == "video"})).select("id")


@query("SELECT page_id AS page_key FROM pages WHERE page_id % 2 = 0")
def f9_pages_with_posts(spark, sf):
    p = views.view(spark, sf, "pages").withColumn("html", F.when(F.col("page_key") % 2 == 0, F.concat("html", F.lit('{"post_id":"1"}'))).otherwise(F.col("html")))
    return filters.may_hold_posts(p).select("page_key")


@query(f"""{S('engagement')}, u AS (SELECT id, reaction, n FROM (SELECT id, unnest([{", ".join(f"{{'reaction': '{r}', 'n': coalesce(reaction_{r}_count, 0)}}" for r in schemas.REACTIONS)}], recursive := true) FROM engagement_v)) SELECT id, max(n) OVER (PARTITION BY id) AS most, reaction, n FROM u WHERE n > 0""")
def f11_reaction_breakdown(spark, sf):
    return filters.reaction_breakdown(views.view(spark, sf, "engagement"))


_LIMITS = "limits AS (SELECT * FROM (VALUES ('basic', 5, 500, 1), ('pro', 50, 5000, 3), ('team', 150, 100000, 10), ('enterprise', NULL, NULL, 10)) AS l(plan, max_urls, max_posts, concurrent_jobs)), u AS (SELECT v.*, coalesce(l.plan, 'basic') AS p FROM users_v v LEFT JOIN limits l ON lower(v.plan) = l.plan)"


@query(f"""{S('users', 'jobs')}, {_LIMITS}, a AS (SELECT owner_id, count(*) AS active FROM jobs_v WHERE status IN ('queued', 'running') GROUP BY 1)
SELECT j.id, j.owner_id, j.n_urls, j.max_posts, CASE WHEN j.n_urls > l.max_urls THEN 'urls' WHEN l.max_posts > 0 AND j.max_posts > l.max_posts THEN 'max_posts' WHEN coalesce(active, 0) >= l.concurrent_jobs THEN 'concurrent_jobs' END AS violation
FROM jobs_v j LEFT JOIN u ON u.id = j.owner_id LEFT JOIN limits l ON l.plan = u.p LEFT JOIN a ON a.owner_id = j.owner_id""")
def f12_plan_gate(spark, sf):
    u, j = v(spark, sf, "users", "jobs")
    return joins.plan_gate(j.select("id", "owner_id", "n_urls", "max_posts"), u, j)


@query(f"{S('jobs')} SELECT id, owner_id, CASE WHEN status = 'paused' THEN 'failed' ELSE status END AS status FROM jobs_v")
def p5_job_summaries(spark, sf):
    return filters.summaries(views.view(spark, sf, "jobs")).select("id", "owner_id", "status")


# Joins


@query(f"{S('posts', 'engagement')} SELECT p.id, p.job_id, e.likes, e.shares FROM posts_v p LEFT JOIN (SELECT * FROM engagement_v WHERE id % 3 > 0) e ON p.id = e.id")
def j1_posts_with_engagement(spark, sf):
    p, e = v(spark, sf, "posts", "engagement")
    return joins.with_engagement(p, e.where("id % 3 > 0")).select("id", "job_id", "likes", "shares")


@query(f"{S('posts')} SELECT id, concat_ws('|', media_url, video_url) AS urls, concat_ws('|', CASE WHEN media_url IS NOT NULL THEN media_type END, CASE WHEN video_url IS NOT NULL THEN media_type END) AS kinds FROM posts_v")
def j2_posts_with_media(spark, sf):
    (p,) = v(spark, sf, "posts")
    row = lambda k, url: p.where(f"{url} is not null").select(F.col("id").alias("post_ref"), F.lit(k).alias("ord"), "media_type", F.col(url).alias("url"), "thumbnail_url", "video_url")
    return joins.with_media(p, row(0, "media_url").union(row(1, "video_url"))).select("id", text.joined(F.col("media.url")).alias("urls"), F.concat_ws("|", "media.media_type").alias("kinds"))


@query(f"{S('posts', 'engagement')} SELECT job_id, coalesce(sum(likes), 0)::BIGINT AS likes, count(*) AS n FROM engagement_v JOIN posts_v USING (id) GROUP BY job_id")
def j3_engagement_of_jobs(spark, sf):
    p, e = v(spark, sf, "posts", "engagement")
    return joins.engagement_of_job(e, p).groupBy("job_id").agg(F.coalesce(F.sum("likes"), F.lit(0)).alias("likes"), F.count(F.lit(1)).alias("n"))


@query(f"{S('posts', 'jobs')} SELECT owner_id, count(*) AS n FROM posts_v p JOIN jobs_v j ON p.job_id = j.id WHERE scraped_at >= TIMESTAMP '1997-01-01' GROUP BY owner_id")
def j4_posts_of_owners(spark, sf):
    p, j = v(spark, sf, "posts", "jobs")
    return metrics.counts_by(joins.posts_of_owners(p, j, F.expr("TIMESTAMP_NTZ '1997-01-01 00:00:00'")), "owner_id")


_INCOMING = f"{S('posts')}, k AS (SELECT *, coalesce('id:' || post_id, 'fp:' || CAST(id AS VARCHAR)) AS dedup_key FROM posts_v), stored AS (SELECT * FROM k WHERE job_id % 2 = 0), incoming AS (SELECT * FROM k WHERE job_id % 2 = 1)"


def _incoming(spark, sf):
    (p,) = v(spark, sf, "posts")
    k = p.withColumn("dedup_key", F.coalesce(F.concat(F.lit("id:"), "post_id"), F.concat(F.lit("fp:"), F.col("id").cast("string")))).withColumn("ord", F.col("id"))
    return k.where("job_id % 2 = 1"), k.where("job_id % 2 = 0")


@query(f"{_INCOMING} SELECT id FROM incoming i WHERE NOT EXISTS (SELECT 1 FROM stored s WHERE s.source_id = i.source_id AND s.dedup_key = i.dedup_key)")
def j5_not_stored(spark, sf):
    return joins.not_stored(*_incoming(spark, sf)).select("id")


@query(f"{_INCOMING} SELECT min(id) AS id, source_id, dedup_key FROM incoming i WHERE NOT EXISTS (SELECT 1 FROM stored s WHERE s.source_id = i.source_id AND s.dedup_key = i.dedup_key) GROUP BY source_id, dedup_key")
def b7_stored_posts(spark, sf):
    return dedup.store(*_incoming(spark, sf)).select("id", "source_id", "dedup_key")


@query("SELECT s_name AS name, 'primary' AS origin FROM supplier UNION ALL SELECT c_name, 'mirror' FROM customer WHERE c_name NOT IN (SELECT s_name FROM supplier)")
def j6_union_with_mirror(spark, sf):
    s = readers.table(spark, sf, "supplier").select(F.col("s_name").alias("name"), F.lit("primary").alias("origin"))
    c = readers.table(spark, sf, "customer").select(F.col("c_name").alias("name"), F.lit("mirror").alias("origin"))
    return joins.with_mirror(s, c, "name").orderBy("name")


@query(f"{S('users')}, {_LIMITS} SELECT u.id, u.p AS plan, max_urls::BIGINT AS max_urls, max_posts::BIGINT AS max_posts, concurrent_jobs::BIGINT AS concurrent_jobs FROM u JOIN limits l ON l.plan = u.p")
def j7_plan_limits(spark, sf):
    return joins.with_limits(views.view(spark, sf, "users")).select("id", "plan", "max_urls", "max_posts", "concurrent_jobs")


@query(f"{S('jobs', 'posts', 'engagement')} SELECT 'jobs' AS target, id FROM jobs_v WHERE id % 5 <> 0 UNION ALL SELECT 'posts', id FROM posts_v WHERE job_id % 5 <> 0 UNION ALL SELECT 'engagement', id FROM engagement_v e WHERE e.id NOT IN (SELECT id FROM posts_v WHERE job_id % 5 = 0)")
def j8_cascading_delete(spark, sf):
    j, p, e = v(spark, sf, "jobs", "posts", "engagement")
    left = joins.without_job({"jobs": j, "posts": p, "engagement": e}, j.where("id % 5 = 0").select(F.col("id").alias("job_id")))
    return dedup.union_all([x.select(F.lit(k).alias("target"), F.col("id").cast("long").alias("id")) for k, x in left.items()])


_DOM_ROWS = "SELECT conv_id AS page_key, turn AS ord, CASE WHEN turn % 2 = 0 THEN CAST(turn + 1 AS STRING) END AS post_id, CASE WHEN conv_id % 3 = 0 AND turn % 2 = 1 THEN concat('  ', first) ELSE text END AS text FROM (SELECT *, first_value(text) OVER (PARTITION BY conv_id ORDER BY turn) AS first FROM {})"


@query(f"""WITH p AS ({_DOM_ROWS.format("conversations")}), c AS (SELECT *, lower(trim(regexp_replace(text, '{_WS}', ' ', 'g'))) AS t FROM p)
SELECT page_key, ord FROM c a WHERE NOT (post_id IS NULL AND coalesce(text, '') <> '' AND EXISTS (SELECT 1 FROM c b WHERE b.page_key = a.page_key AND b.ord < a.ord AND b.post_id IS NOT NULL AND b.text <> '' AND (contains(b.t, a.t) OR contains(a.t, b.t))))""")
def j9_dom_copies(spark, sf):
    return joins.drop_dom_copies(spark.sql(_DOM_ROWS.format("{rows}"), rows=readers.table(spark, sf, "conversations"))).select("page_key", "ord")


# Aggregations

_A1 = ", ".join(f"coalesce(sum({c}), 0)::BIGINT AS {n}" for n, c in metrics.SUMS.items() if n != "total_views")


@query(f"""{S('posts', 'engagement')} SELECT job_id, count(*) AS total_posts, {_A1}, nullif(coalesce(sum(views_count), 0), 0)::BIGINT AS total_views, count(*) FILTER (coalesce(post_type = 'video', false) OR (video_url IS NOT NULL AND post_type IS NULL)) AS n_video,
count(*) FILTER (post_type = 'image') AS n_image, count(*) FILTER (post_type = 'link') AS n_link, count(*) FILTER (post_type = 'text') AS n_text, {_ISO.format('min(published_at)')} AS earliest, {_ISO.format('max(published_at)')} AS latest FROM posts_v LEFT JOIN engagement_v USING (id) GROUP BY job_id""")
def a1_job_kpi(spark, sf):
    """A1, A3, A4."""
    return metrics.job_kpi(*v(spark, sf, "posts", "engagement"))


@query(f"{S('posts')} SELECT job_id, post_type, count(*) AS n FROM posts_v WHERE post_type <> '' GROUP BY ALL")
def a2_type_histogram(spark, sf):
    return metrics.type_histogram(views.view(spark, sf, "posts"))


@query(f"WITH {views.SOURCES_SQL}, m AS (SELECT l_orderkey AS job_id, sum(l_linenumber)::BIGINT AS more FROM lineitem WHERE l_linenumber > 4 GROUP BY 1) SELECT job_id, {', '.join(f'sum({c})::BIGINT AS {c}' for c in metrics.COUNTERS)}, (sum(duplicates_removed) + coalesce(max(more), 0))::BIGINT AS duplicates FROM sources_v LEFT JOIN m USING (job_id) GROUP BY job_id")
def a5_source_rollup(spark, sf):
    found = readers.table(spark, sf, "lineitem").where("l_linenumber > 4").select(F.col("l_orderkey").alias("job_id"), F.col("l_linenumber").cast("long").alias("duplicates"))
    return metrics.source_rollup(views.sources(spark, sf), found)


@query(f"""{S('jobs', 'posts')}, {views.SOURCES_SQL}, p AS (SELECT job_id, count(*) AS n FROM posts_v GROUP BY 1), e AS (SELECT user_id AS job_id, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1), s AS (SELECT job_id, count(*) AS n FROM sources_v WHERE status IN ('completed', 'failed', 'cancelled') GROUP BY 1)
SELECT j.id, coalesce(p.n, 0) AS posts_processed, coalesce(e.n, 0) + cancel_requested::INT AS errors_count, coalesce(s.n, 0) AS pages_completed, CASE WHEN cancel_requested THEN 'failed' ELSE 'completed' END AS status FROM jobs_v j LEFT JOIN p ON p.job_id = j.id LEFT JOIN e ON e.job_id = j.id LEFT JOIN s ON s.job_id = j.id""")
def a6_finalized_jobs(spark, sf):
    j, p = v(spark, sf, "jobs", "posts")
    errors = readers.table(spark, sf, "events").where("event_type = 'error'").select(F.col("user_id").alias("job_id"))
    return metrics.finalize(j, p, errors, views.sources(spark, sf))


@query(f"""{S('users', 'jobs', 'posts')}, {_LIMITS}, jj AS (SELECT owner_id, count(*) FILTER (status IN ('queued', 'running')) AS a, count(*) FILTER (created_at >= TIMESTAMP '1998-01-01') AS t FROM jobs_v GROUP BY 1),
pp AS (SELECT owner_id, count(*) AS n FROM posts_v p JOIN jobs_v j ON p.job_id = j.id WHERE scraped_at >= TIMESTAMP '1998-01-01' GROUP BY 1)
SELECT u.id, u.p AS plan, coalesce(a, 0) AS active_jobs, coalesce(pp.n, 0) AS posts_today, coalesce(t, 0) AS jobs_today, max_urls::BIGINT AS max_urls, l.max_posts::BIGINT AS max_posts, concurrent_jobs::BIGINT AS concurrent_jobs FROM u JOIN limits l ON l.plan = u.p LEFT JOIN jj ON jj.owner_id = u.id LEFT JOIN pp ON pp.owner_id = u.id""")
def a8_usage(spark, sf):
    u, j, p = v(spark, sf, "users", "jobs", "posts")
    return metrics.usage(u, j, p, F.expr("TIMESTAMP_NTZ '1998-01-01 09:30:00'"))


@query(f"""{S('posts', 'engagement')} SELECT job_id, sum(coalesce(likes, 0))::BIGINT AS likes, sum(coalesce(comments_count, 0))::BIGINT AS comments, sum(coalesce(shares, 0))::BIGINT AS shares, count(*) FILTER (lower(coalesce(media_type, '')) = 'video' OR coalesce(post_type, '') = 'video') AS videos,
count(*) FILTER (lower(coalesce(media_type, '')) = 'image' OR coalesce(post_type, '') = 'image') AS images, count(*) FILTER (coalesce(post_type, '') = 'link' OR has_link) AS links FROM posts_v LEFT JOIN engagement_v USING (id) GROUP BY job_id""")
def a9_dashboard_kpi(spark, sf):
    p, e = v(spark, sf, "posts", "engagement")
    return metrics.dashboard_kpi(joins.with_engagement(p, e).withColumn("external_links", F.when(F.col("has_link"), F.array(F.lit("x")))))


@query("WITH s AS (SELECT user_id AS capture, event_id % 10 AS round, count(DISTINCT props) AS seen FROM events GROUP BY ALL) SELECT *, max(seen) OVER (PARTITION BY capture ORDER BY round) AS most_so_far FROM s")
def a10_seen_in_rounds(spark, sf):
    e = readers.table(spark, sf, "events").select(F.col("user_id").alias("capture"), (F.col("event_id") % 10).alias("round"), F.col("props").alias("post_id"))
    return metrics.seen_in_rounds(e)


@query("SELECT d.doc_id, CASE WHEN text IS NOT NULL THEN coalesce(n, 0) END AS duplicates FROM documents d LEFT JOIN (SELECT doc_id, (count(*) - count(DISTINCT lower(l)))::BIGINT AS n FROM (SELECT doc_id, trim(unnest(string_split(text, chr(10)))) AS l FROM documents) WHERE l <> '' GROUP BY doc_id) USING (doc_id)")
def a11_duplicate_lines(spark, sf):
    return metrics.duplicate_lines(readers.table(spark, sf, "documents"), "doc_id", "text")


#: Ends of buckets for the values of events, and the SQL of a histogram's quantile: the bucket that holds the rank, and a line through it.
ENDS = (1.0, 2.5, 5.0, 10.0, 25.0, 50.0, 75.0, 90.0)
_P95 = f"""h AS (SELECT *, list_transform(list_zip({[0.0, *ENDS[:-1]]}, {list(ENDS)}), lambda e: {{'low': e[1], 'high': e[2], 'before': CASE WHEN e[1] = 0 THEN 0 ELSE len(list_filter(vs, lambda v: v <= e[1])) END, 'upto': len(list_filter(vs, lambda v: v <= e[2]))}}) AS b FROM g),
q AS (SELECT *, list_filter(b, lambda e: e.upto >= 0.95 * len(vs) AND e.upto > e.before) AS f FROM h),
p AS (SELECT *, CASE WHEN len(vs) = 0 THEN NULL WHEN len(f) = 0 THEN {ENDS[-1]}::DOUBLE ELSE f[1].low + (f[1].high - f[1].low) * (0.95 * len(vs) - f[1].before) / (f[1].upto - f[1].before) END AS p95 FROM q)"""


@query(f"{S('requests')}, g AS (SELECT {_ISO.format('time_bucket(INTERVAL 5 MINUTE, ts)')} AS start, regexp_replace(path, '/[0-9]+', '/{{id}}', 'g') AS family, count(*) / 300.0::DOUBLE AS rate, (count(*) FILTER (failed) / 300.0::DOUBLE) / greatest(count(*) / 300.0::DOUBLE, 1e-6) AS failure_share, list(value) FILTER (value IS NOT NULL) AS vs FROM requests_v GROUP BY ALL), {_P95} SELECT start, family, rate, failure_share, p95 FROM p")
def a12_request_rates(spark, sf):
    out = metrics.request_rates(views.view(spark, sf, "requests").withColumn("ts", F.col("ts").cast("timestamp")), ends=ENDS)
    return out.select(time.iso(F.col("start")).alias("start"), "family", "rate", "failure_share", "p95")


@query(f"{S('jobs')} SELECT {_ISO.format("date_trunc('day', created_at)")} AS start, status, count(*) / 86400.0::DOUBLE AS rate FROM jobs_v WHERE status IN ('completed', 'failed') GROUP BY ALL")
def a13_outcome_rates(spark, sf):
    return metrics.outcome_rates(views.view(spark, sf, "jobs").withColumn("created_at", F.col("created_at").cast("timestamp"))).select(time.iso(F.col("start")).alias("start"), "status", "rate")


@query(f"{S('posts')} SELECT job_id, count(*) AS n FROM posts_v GROUP BY job_id")
def a14_counts(spark, sf):
    return metrics.counts_by(views.view(spark, sf, "posts"), "job_id")


# Order


@query(f"{S('jobs')}, s AS (SELECT id, owner_id % 40 AS source_id, id % 3 AS job_id, status FROM jobs_v) SELECT id, source_id, job_id, status FROM (SELECT *, row_number() OVER (PARTITION BY source_id, job_id ORDER BY id DESC) AS n FROM s) WHERE n = 1 AND status <> 'running'")
def w3_resume_states(spark, sf):
    s = views.view(spark, sf, "jobs").select("id", (F.col("owner_id") % 40).alias("source_id"), (F.col("id") % 3).alias("job_id"), "status")
    return ordering.resume_states(s)


@query(f"{S('jobs')} SELECT target FROM (SELECT target, max((created_at, id)) AS newest FROM jobs_v GROUP BY target) ORDER BY newest DESC LIMIT 4")
def w4_recent_targets(spark, sf):
    return ordering.recent_targets(views.view(spark, sf, "jobs").withColumn("urls", F.array("target")))


_STREAK = "g AS (SELECT *, sum((items > 0)::INT) OVER (PARTITION BY source ORDER BY round) AS grp FROM rounds_v), t AS (SELECT *, sum((items = 0)::INT) OVER (PARTITION BY source, grp ORDER BY round) AS streak FROM g)"


@query(f"{S('rounds')}, {_STREAK} SELECT source, min(round) AS round FROM t WHERE streak >= 2 GROUP BY source")
def w5_stale_rounds(spark, sf):
    return ordering.stale_at(views.view(spark, sf, "rounds").withColumnRenamed("items", "new_items"), 2)


@query(f"{S('requests')} SELECT seq FROM (SELECT *, lag(counters) OVER (PARTITION BY job_id ORDER BY seq) AS b FROM requests_v) WHERE b IS NULL OR b IS DISTINCT FROM counters")
def w6_changed_progress(spark, sf):
    return ordering.changed_progress(views.view(spark, sf, "requests")).select("seq")


@query(f"{S('posts')} SELECT id, {_ISO.format('published_at')} AS published FROM posts_v ORDER BY published_at DESC NULLS LAST, id DESC LIMIT 50 OFFSET 50")
def l1_newest_posts(spark, sf):
    return ordering.newest_posts(views.view(spark, sf, "posts"), 2, 50).select("id", time.iso(F.col("published_at")).alias("published"))


@query(f"{S('jobs')} SELECT id, status FROM jobs_v ORDER BY created_at DESC, id DESC LIMIT 100")
def l2_newest_jobs(spark, sf):
    return ordering.newest_jobs(views.view(spark, sf, "jobs"), 1, 500).select("id", "status")


@query(f"{S('posts', 'engagement')} SELECT id, coalesce(likes, -1) AS by_likes, coalesce(comments_count, -1) AS by_comments, coalesce(CAST(epoch(published_at) AS BIGINT) * 1000, 0) AS by_date FROM posts_v LEFT JOIN engagement_v USING (id)")
def l3_sort_keys(spark, sf):
    p, e = v(spark, sf, "posts", "engagement")
    rows = joins.with_engagement(p, e).withColumn("timestamp", F.when(F.col("id") % 2 == 0, F.unix_seconds(F.col("published_at").cast("timestamp"))))
    return ordering.sorted_posts(rows, "likes").select("id", ordering.sort_key("likes").alias("by_likes"), ordering.sort_key("comments").alias("by_comments"), ordering.sort_key("date").alias("by_date"))


@query("SELECT event_id AS id, user_id AS job_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events WHERE event_type = 'error') WHERE n <= 50")
def l5_latest_errors(spark, sf):
    return ordering.latest_errors(readers.table(spark, sf, "events").where("event_type = 'error'").select(F.col("event_id").alias("id"), F.col("user_id").alias("job_id")))


@query(f"{S('users')} SELECT id, row_number() OVER (ORDER BY created_at, id) AS place FROM users_v")
def l7_users_in_order(spark, sf):
    """Places from the counts of ranges."""
    users = views.view(spark, sf, "users")
    return paging.Ordered(users.select("id", "created_at"), [F.col("created_at"), F.col("id")], new_folder(spark, "users")).places().select("id", "place")


@query(f"{S('posts')} SELECT id, {_ISO.format('published_at')} AS published FROM posts_v ORDER BY published_at DESC NULLS LAST, id DESC LIMIT 50 OFFSET 1950")
def l1_page_by_counts(spark, sf):
    """The fortieth page, from the ranges that hold it."""
    posts = paging.Ordered(views.view(spark, sf, "posts").select("id", "published_at"), [F.desc_nulls_last("published_at"), F.desc("id")], new_folder(spark, "pages"))
    return posts.page(40, 50, 200).select("id", time.iso(F.col("published_at")).alias("published"))


# Duplicates


@query(f"{S('texts')}, n AS (SELECT *, {_T} AS t FROM texts_v) SELECT ord, {_FP} AS fp, substr(sha256(substr(coalesce(t, ''), 1, 200)), 1, 16) || '|' || coalesce(strftime(published_at, '%Y-%m-%dT%H:%M:%S+00:00'), '') AS content, {_KEY} AS key FROM n")
def b1_fingerprints(spark, sf):
    """B1, B2, B3."""
    return _canonical(spark, sf).select("ord", dedup.fingerprint().alias("fp"), dedup.content_fingerprint().alias("content"), dedup.dedup_key().alias("key"))


@query(f"{S('texts')}, n AS (SELECT *, {_T} AS t FROM texts_v), k AS (SELECT *, {_KEY} AS key FROM n) SELECT min(ord) AS ord, key FROM k GROUP BY key")
def b4_first_posts(spark, sf):
    """W1, B4."""
    return dedup.dedup_posts(_canonical(spark, sf)).select("ord", dedup.dedup_key().alias("key"))


@query(f"""{S('texts')}, n AS (SELECT *, {_T} AS t FROM texts_v), k AS (SELECT *, substr(coalesce(t, ''), 1, 200) AS head FROM n),
i AS (SELECT source, head, min(ord) AS ord FROM k GROUP BY source, head) SELECT arg_min(ord, (source, ord)) AS ord FROM i GROUP BY head""")
def b5_across_sources(spark, sf):
    """Keys by text alone here, so that a post's key and content agree and the greedy rule has a closed form."""
    c = _canonical(spark, sf).withColumns({"post_id": F.lit(None).cast("string"), "page_id": F.lit(None).cast("string"), "timestamp": F.lit(None).cast("long"), "published_at": F.lit(None).cast("timestamp")})
    return dedup.dedup_across_sources(c).select("ord")


@query(f"""{S('texts').replace("WITH ", "WITH RECURSIVE ", 1)}, n AS MATERIALIZED (SELECT source, ord, (ord % 97)::VARCHAR AS k, substr(coalesce({_T}, ''), 1, 200) AS c FROM texts_v),
i AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY source, ord) AS i FROM (SELECT *, row_number() OVER (PARTITION BY source, k ORDER BY ord) AS nth FROM n) WHERE nth = 1),
r AS (SELECT 0::BIGINT AS i, []::VARCHAR[] AS ks, []::VARCHAR[] AS cs, NULL::BIGINT AS ord UNION ALL
SELECT i.i, CASE WHEN list_contains(ks, k) OR list_contains(cs, c) THEN ks ELSE list_append(ks, k) END, CASE WHEN list_contains(ks, k) OR list_contains(cs, c) THEN cs ELSE list_append(cs, c) END,
CASE WHEN list_contains(ks, k) OR list_contains(cs, c) THEN NULL ELSE i.ord END FROM r JOIN i ON i.i = r.i + 1) SELECT ord FROM r WHERE ord IS NOT NULL""")
def b5_chains_across_sources(spark, sf):
    """Keys and contents that cross: a post dropped for its content no longer keeps others of its key away."""
    c = _canonical(spark, sf).withColumns({"post_id": (F.col("ord") % 97).cast("string"), "timestamp": F.lit(None).cast("long"), "published_at": F.lit(None).cast("timestamp")})
    return dedup.dedup_across_sources(c).select("ord")


_JSON = "CASE WHEN {0} IS NULL THEN 'null' ELSE to_json({0})::VARCHAR END"


@query(f"""{S('texts')}, n AS (SELECT *, {_T} AS t FROM texts_v) SELECT ord, CASE WHEN coalesce(post_id, '') <> '' THEN post_id ELSE 'fp:' || sha256('{{"page_id": ' || {_JSON.format('page_id')} || ', "post_url": ' || {_JSON.format("coalesce(post_url, source_url)")} || ', "published_at": ' || {_JSON.format("strftime(published_at, '%Y-%m-%dT%H:%M:%S+00:00')")} || ', "text": ' || {_JSON.format("substr(trim(coalesce(t, '')), 1, 500)")} || '}}') END AS key FROM n""")
def b6_storage_keys(spark, sf):
    return _canonical(spark, sf).select("ord", dedup.storage_key().alias("key"))


@query(f"""WITH u AS (SELECT o_orderkey AS ord, trim({_RAW_URL}) AS url, {_NORMAL_URL} AS normalized_url, {_REASON} AS reason FROM orders), n AS (SELECT *, row_number() OVER (PARTITION BY normalized_url ORDER BY ord) AS k FROM u)
SELECT ord, url, normalized_url, CASE WHEN normalized_url IS NULL THEN 'invalid_url' WHEN k > 1 THEN 'duplicate_url' END AS code, CASE WHEN url = '' THEN 'empty' ELSE reason END AS reason FROM n""")
def b8_judged_urls(spark, sf):
    return dedup.judge_urls(readers.table(spark, sf, "orders").select(F.col("o_orderkey").alias("ord"), F.expr(_RAW_URL).alias("url")))


@query("SELECT doc_id, k AS ord, l AS line FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, lower(l) ORDER BY k) AS n FROM (SELECT doc_id, generate_subscripts(x, 1) - 1 AS k, trim(unnest(x)) AS l FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents)) WHERE l <> '') WHERE n = 1")
def b9_bulk_lines(spark, sf):
    return dedup.bulk_lines(readers.table(spark, sf, "documents"), "doc_id", "text")


@query("SELECT name, n FROM (SELECT c_name AS name, NULL::BIGINT AS n FROM customer UNION ALL SELECT s_name, s_suppkey FROM supplier)")
def b10_union_all(spark, sf):
    c = readers.table(spark, sf, "customer").select(F.col("c_name").alias("name"))
    return dedup.union_all([c, readers.table(spark, sf, "supplier").select(F.col("s_name").alias("name"), F.col("s_suppkey").alias("n"))]).select("name", "n")


# Updates


@query(f"""{S('jobs')}, {views.SOURCES_SQL} SELECT 'job' AS kind, id, CASE WHEN status = 'running' THEN 'failed' ELSE status END AS status FROM jobs_v UNION ALL SELECT 'error', id, 'suspended_by_restart' FROM jobs_v WHERE status = 'running' UNION ALL SELECT 'resumable', id, 'queued' FROM jobs_v WHERE status = 'queued'
UNION ALL SELECT 'source', s.job_id * 100000 + source_id, CASE WHEN s.status = 'running' AND j.status = 'running' THEN 'failed' ELSE s.status END FROM sources_v s JOIN jobs_v j ON j.id = s.job_id""")
def r1_orphan_sweep(spark, sf):
    j, s, e, q = updates.sweep_orphans(views.view(spark, sf, "jobs"), views.sources(spark, sf))
    row = lambda kind, df, key, status: df.select(F.lit(kind).alias("kind"), F.expr(key).alias("id"), F.expr(status).alias("status"))
    return row("job", j, "id", "status").union(row("error", e, "job_id", "code")).union(row("resumable", q, "id", "'queued'")).union(row("source", s, "job_id * 100000 + source_id", "status"))


@query(f"""{S('jobs')} SELECT id, CASE WHEN id % 2 = 0 THEN 'pause' ELSE 'resume' END AS action, CASE WHEN id % 2 = 0 AND status IN ('queued', 'running') THEN 'paused' WHEN id % 2 = 1 AND status = 'paused' THEN 'queued' ELSE status END AS status,
CASE WHEN NOT ((id % 2 = 0 AND status IN ('queued', 'running')) OR (id % 2 = 1 AND status = 'paused')) THEN 'invalid_state' END AS error FROM jobs_v""")
def r2_transitions(spark, sf):
    (j,) = v(spark, sf, "jobs")
    return updates.transition(j, j.select("id", F.expr("CASE WHEN id % 2 = 0 THEN 'pause' ELSE 'resume' END").alias("action")))


@query(f"WITH {views.SOURCES_SQL} SELECT source_id, job_id, CASE WHEN source_id % 7 = 0 THEN 'failed' ELSE status END AS status, CASE WHEN source_id % 7 = 0 THEN 'timeout' END AS error_code, errors_count + (source_id % 7 = 0)::INT AS errors_count FROM sources_v")
def r3_failed_sources(spark, sf):
    s = views.sources(spark, sf).withColumn("error_code", F.lit(None).cast("string"))
    hit = s.where("source_id % 7 = 0").select("source_id", "job_id", F.lit("timeout").alias("code"), F.lit("late").alias("message"))
    states = s.select(F.col("job_id").alias("id"), "source_id", "job_id", "status", F.lit(0).alias("consecutive_errors"))
    return updates.fail_sources(s, states, hit)[0]


@query(f"WITH {views.SOURCES_SQL} SELECT job_id AS id, source_id, job_id, CASE WHEN source_id % 7 = 0 THEN 'failed' ELSE status END AS status, CASE WHEN source_id % 7 = 0 THEN 3 ELSE 2 END AS consecutive_errors FROM sources_v")
def r3_failed_checkpoints(spark, sf):
    """The other result of a source's failure: its checkpoint."""
    s = views.sources(spark, sf).withColumn("error_code", F.lit(None).cast("string"))
    hit = s.where("source_id % 7 = 0").select("source_id", "job_id", F.lit("timeout").alias("code"), F.lit("late").alias("message"))
    states = s.select(F.col("job_id").alias("id"), "source_id", "job_id", "status", F.lit(2).alias("consecutive_errors"))
    return updates.fail_sources(s, states, hit)[1]


@query(f"WITH {views.SOURCES_SQL} SELECT source_id, job_id, CASE WHEN source_id % 3 = 0 THEN extracted + 1 ELSE extracted END AS extracted, CASE WHEN source_id % 3 = 0 AND job_id % 2 = 0 THEN 'created' ELSE status END AS status FROM sources_v UNION ALL SELECT -1, -1, 5, 'created'")
def r4_merged_checkpoints(spark, sf):
    """R4, and a checkpoint of a new source."""
    s = views.sources(spark, sf).select("source_id", "job_id", "extracted", "status")
    new = s.where("source_id % 3 = 0").select("source_id", "job_id", (F.col("extracted") + 1).alias("extracted"), F.when(F.col("job_id") % 2 == 0, "created").alias("status"))
    extra = s.sparkSession.createDataFrame([(-1, -1, 5, "created")], "source_id long, job_id long, extracted long, status string")
    return updates.merge(s, new.union(extra), ["source_id", "job_id"])


@query(f"WITH {views.SOURCES_SQL} SELECT source_id, job_id, 'created' AS status, 0::BIGINT AS consecutive_errors, CAST(NULL AS VARCHAR) AS error_code FROM sources_v")
def r5_reset_states(spark, sf):
    return updates.reset_for_resume(views.sources(spark, sf).select("source_id", "job_id", "status"))


@query(f"""{S('rounds')}, x AS (SELECT *, CASE WHEN cancelled OR failed THEN 0 ELSE items END AS got FROM rounds_v), g AS (SELECT *, sum(got) OVER w AS total, sum((got > 0)::INT) OVER w AS grp FROM x WINDOW w AS (PARTITION BY source ORDER BY round)),
t AS (SELECT *, sum((got = 0)::INT) OVER (PARTITION BY source, grp ORDER BY round) AS streak FROM g), r AS (SELECT *, CASE WHEN cancelled THEN 'cancelled' WHEN failed THEN 'fetch_error' WHEN streak >= 3 THEN 'stale' WHEN total >= 12 THEN 'item_cap' WHEN NOT has_more THEN 'no_more' WHEN round >= 6 THEN 'max_rounds' END AS reason FROM t),
f AS (SELECT source, min(round) AS round FROM r WHERE reason IS NOT NULL GROUP BY source) SELECT f.source, reason AS stop_reason, CASE WHEN reason = 'cancelled' THEN r.round - 1 ELSE r.round END AS total_rounds, least(total, 12)::BIGINT AS items_kept FROM f JOIN r ON r.source = f.source AND r.round = f.round""")
def r6_pagination_stops(spark, sf):
    return ordering.pagination_stop(views.view(spark, sf, "rounds"), 12, 6)


@query(f"{S('users')} SELECT id, CASE WHEN coalesce(plan, 'free') = 'free' THEN 'basic' ELSE plan END AS plan FROM users_v")
def r7_backfilled_plans(spark, sf):
    return updates.backfill_plans(views.view(spark, sf, "users")).select("id", "plan")


# Exports


def _stored(spark, sf):
    p, e = v(spark, sf, "posts", "engagement")
    have = set(p.columns) | set(e.columns)
    rows = joins.with_engagement(p, e)
    links = F.when(F.col("has_link"), F.array(F.lit("https://a.example"), F.lit(None).cast("string"), F.lit("x|y")))
    made = {"external_links": links, "source_url": F.concat(F.lit("https://www.social.example/"), F.col("source_id").cast("string"))}
    return rows.select("id", "job_id", "source_id", *[made.get(f.name, F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schemas.CANONICAL_POST])


def _cell(c: str) -> str:
    known = {"post_id", "post_type", "likes", "comments_count", "shares", "views_count", "thumbnail_url", "media_url", "reactions", *schemas.REACTION_COUNTS, "media_type", "video_url"}
    if c == "published_at":
        return "coalesce(strftime(published_at, '%Y-%m-%dT%H:%M:%S+00:00'), '') AS published_at"
    if c == "external_links":
        return "CASE WHEN has_link THEN 'https://a.example||x|y' ELSE '' END AS external_links"
    return f"coalesce(CAST({c} AS VARCHAR), '') AS {c}" if c in known else f"'' AS {c}"


@query(f"{S('posts', 'engagement')} SELECT {', '.join(_cell(c) for c in schemas.FLAT_COLUMNS)} FROM posts_v LEFT JOIN engagement_v USING (id)")
def p2_flat_posts(spark, sf):
    """What S5 writes and the Posts sheet of S7 holds."""
    return export.flat(_stored(spark, sf))


@query(f"{S('posts', 'engagement')} SELECT coalesce(post_id, '') AS post_id, CASE WHEN has_link THEN '[\"https://a.example\",null,\"x|y\"]' ELSE '' END AS external_links, coalesce(CAST(likes AS VARCHAR), '') AS likes, coalesce(strftime(published_at, '%Y-%m-%dT%H:%M:%S+00:00'), '') AS published_at FROM posts_v LEFT JOIN engagement_v USING (id)")
def s8_cli_rows(spark, sf):
    return export.cli_rows(_stored(spark, sf)).select("post_id", "external_links", "likes", "published_at")


@query(f"{S('posts', 'engagement')} SELECT {', '.join(schemas.ENGAGEMENT_COLUMNS)} FROM posts_v LEFT JOIN engagement_v USING (id)")
def s7_engagement_sheet(spark, sf):
    return export.workbook(_stored(spark, sf), "1", "x", "2024-06-15T10:00:00+00:00")["Engagement"]


@query(f"{S('posts')} SELECT {', '.join(schemas.MEDIA_COLUMNS)} FROM posts_v")
def s7_media_sheet(spark, sf):
    return export.workbook(_stored(spark, sf), "1", "x", "2024-06-15T10:00:00+00:00")["Media"]


@query("SELECT unnest(['exported_at', 'job_id', 'source', 'format', 'filename', 'posts_count', 'sheets', 'schema_version', 'generator']) AS key, unnest(['2024-06-15T10:00:00+00:00', '1', 'x', 'xlsx', 'posts.csv', (SELECT count(*) FROM lineitem)::VARCHAR, 'Posts, Engagement, Media, Metadata', '1.0', 'postloom']) AS value")
def p4_metadata_sheet(spark, sf):
    return export.metadata(_stored(spark, sf), "1", "x", "2024-06-15T10:00:00+00:00")


@query(f"{S('posts', 'engagement')} SELECT p.id, p.post_type, e.likes, CASE WHEN has_link THEN 3 ELSE 0 END AS n_links, {_ISO.format('published_at')} AS published FROM posts_v p LEFT JOIN (SELECT * FROM engagement_v WHERE id % 3 > 0) e ON p.id = e.id")
def p3_posts_from_store(spark, sf):
    s = _stored(spark, sf)
    e = s.select("id", *schemas.METRICS).where("id % 3 > 0")
    return export.posts_from_store(s.drop(*schemas.METRICS), e).select("id", "post_type", "likes", F.size("external_links").alias("n_links"), "published")


_ANY = "coalesce(media_type, '') || coalesce(media_url, '') || coalesce(thumbnail_url, '') || coalesce(video_url, '') <> ''"


@query(f"""{S('posts', 'engagement')} SELECT 'posts' AS target, id, coalesce(post_id, '') || CASE WHEN has_link THEN '|https://a.example||x|y' ELSE '' END AS said FROM posts_v
UNION ALL SELECT 'engagement', id, concat_ws('|', likes, reactions) FROM engagement_v WHERE likes IS NOT NULL OR reactions IS NOT NULL UNION ALL SELECT 'media', id, concat_ws('|', media_type, media_url, thumbnail_url, video_url) FROM posts_v WHERE {_ANY}""")
def s11_store_rows(spark, sf):
    """The rows that go to each of the three tables, with what is in them."""
    posts, metrics_rows, media = export.store_rows(_stored(spark, sf).withColumn("dedup_key", dedup.storage_key()))
    said = (
        posts.select(F.lit("posts").alias("target"), "id", F.concat_ws("|", F.coalesce("post_id", F.lit("")), F.when(F.col("external_links").isNotNull(), text.joined(F.col("external_links")))).alias("said")),
        metrics_rows.select(F.lit("engagement").alias("target"), "id", F.concat_ws("|", F.col("likes").cast("string"), F.col("reactions").cast("string")).alias("said")),
        media.select(F.lit("media").alias("target"), F.col("post_ref").alias("id"), F.concat_ws("|", "media_type", "url", "thumbnail_url", "video_url").alias("said")),
    )
    return dedup.union_all(list(said))


@query("SELECT user_id AS job_id, event_id AS source_id, CASE WHEN event_id % 2 = 0 THEN 'https://e.example/' || event_id ELSE 'https://s.example' END AS source_url, CASE WHEN event_id % 3 = 0 THEN 'timeout' ELSE 'scrape_error' END AS code, event_type AS message FROM events")
def s12_error_rows(spark, sf):
    e = readers.table(spark, sf, "events").selectExpr("user_id AS job_id", "event_id AS source_id", "CASE WHEN event_id % 2 = 0 THEN concat('https://e.example/', event_id) END AS url", "'https://s.example' AS source_url", "CASE WHEN event_id % 3 = 0 THEN 'timeout' END AS code", "event_type AS message")
    return export.error_rows(e)


# Batch twins of the streams


@query("""WITH n AS (SELECT user_id AS job_id, event_id % 6 AS source_id, max(event_id) AS seq FROM events GROUP BY 1, 2)
SELECT job_id, count(*) AS sources, sum(seq % 11)::BIGINT AS discovered, sum(seq % 7)::BIGINT AS extracted, sum(seq % 5)::BIGINT AS duplicates_removed, sum(seq % 3)::BIGINT AS skipped, sum(seq % 2)::BIGINT AS failed FROM n GROUP BY 1""")
def t4_latest_counters(spark, sf):
    e = readers.table(spark, sf, "events").select(F.col("user_id").alias("job_id"), (F.col("event_id") % 6).alias("source_id"), F.col("event_id").alias("seq"), *[(F.col("event_id") % k).alias(c) for c, k in zip(streams.COUNTERS, (11, 7, 5, 3, 2))])
    newest = streams.latest_counters(e.where("seq % 4 > 0"), e.where("seq % 4 = 0"))
    return newest.groupBy("job_id").agg(F.count(F.lit(1)).alias("sources"), *[F.sum(c).alias(c) for c in streams.COUNTERS])


@query("""WITH w AS (SELECT unnest(list_transform(range(0, 5), lambda i: time_bucket(INTERVAL 1 MINUTE, ts) - to_minutes(i))) AS start, event_type, value FROM events) SELECT strftime(start, '%Y-%m-%dT%H:%M:%SZ') AS start, count(*) / 300.0::DOUBLE AS rate, count(*) FILTER (event_type = 'error') / count(*)::DOUBLE AS failure_share, quantile_disc(value, 0.95) AS p95 FROM w GROUP BY ALL""")
def t5_sliding_rates(spark, sf):
    out = streams.rates(views.view(spark, sf, "requests").withColumn("ts", F.col("ts").cast("timestamp")), None)
    return out.select(time.iso(F.col("start")).alias("start"), "rate", "failure_share", "p95")


@query("""WITH w AS (SELECT unnest(list_transform(range(0, 5), lambda i: time_bucket(INTERVAL 1 MINUTE, ts) - to_minutes(i))) AS start, event_type FROM events),
r AS (SELECT start, count(*) FILTER (event_type = 'error') > 0.05 * count(*) AS over FROM w GROUP BY start)
SELECT strftime(start, '%Y-%m-%dT%H:%M:%SZ') AS start FROM r WHERE (SELECT count(*) FROM r x WHERE x.over AND x.start BETWEEN r.start - INTERVAL 4 MINUTE AND r.start) = 5""")
def t5_alerts(spark, sf):
    out = streams.alerts(streams.rates(views.view(spark, sf, "requests").withColumn("ts", F.col("ts").cast("timestamp"))))
    return out.select(time.iso(F.col("start")).alias("start"))


def _visits(spark, sf):
    return readers.table(spark, sf, "events").select(F.col("user_id").alias("key"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"))


def _windows(seconds: int) -> str:
    """Each visit n of a user with the time its window was opened."""
    return f"""WITH RECURSIVE v AS MATERIALIZED (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
r AS (SELECT user_id, event_id, n, ts, ts AS opened, true AS first FROM v WHERE n = 1 UNION ALL
SELECT v.user_id, v.event_id, v.n, v.ts, CASE WHEN v.ts - r.opened >= to_seconds({seconds}) THEN v.ts ELSE r.opened END, v.ts - r.opened >= to_seconds({seconds}) FROM r JOIN v ON v.user_id = r.user_id AND v.n = r.n + 1)"""


@query(f"{_windows(86_400)} SELECT event_id AS seq, strftime(opened, '%Y-%m-%d %H:%M:%S.%f') AS served_from, first FROM r")
def t1_served_visits(spark, sf):
    out = streams.served(_visits(spark, sf), 86_400)
    return out.select("seq", F.date_format("served_from", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("served_from"), "first")


@query(f"{_windows(21_600)} SELECT event_id AS seq FROM r WHERE first")
def t2_once_per_window(spark, sf):
    return streams.once_per_window(_visits(spark, sf), 21_600).select("seq")


_LET = "(event_type <> shown AND ts - last >= INTERVAL 8 HOUR OR silent)"


@query(f"""WITH RECURSIVE v AS MATERIALIZED (SELECT user_id, event_id, ts, event_type, row_number() OVER w AS n, coalesce(ts - lag(ts) OVER w >= INTERVAL 3 DAY, false) AS silent FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
r AS (SELECT user_id, event_id, n, ts AS last, event_type AS shown, true AS let FROM v WHERE n = 1 UNION ALL
SELECT v.user_id, v.event_id, v.n, CASE WHEN {_LET} THEN ts ELSE last END, CASE WHEN {_LET} THEN event_type ELSE shown END, {_LET}
FROM r JOIN v ON v.user_id = r.user_id AND v.n = r.n + 1) SELECT event_id AS seq FROM r WHERE let""")
def t3_throttled_progress(spark, sf):
    """A user who is silent for three days is forgotten."""
    e = views.view(spark, sf, "requests").select("job_id", F.col("ts").cast("timestamp").alias("ts"), "counters", "seq")
    return streams.throttled(e, 8 * 3600, 3 * 86_400).select("seq")


@query(f"""{S('rounds')}, g AS (SELECT *, sum(items) OVER w AS total, sum((items > 0)::INT) OVER w AS grp FROM rounds_v WINDOW w AS (PARTITION BY source ORDER BY round)),
t AS (SELECT *, sum((items = 0)::INT) OVER (PARTITION BY source, grp ORDER BY round) AS streak FROM g), s AS (SELECT *, CASE WHEN streak >= 3 THEN 'stale' WHEN total >= 12 THEN 'item_cap' END AS reason FROM t)
SELECT source, round, (least(total, 12) - least(total - items, 12))::BIGINT AS taken, reason AS stop_reason FROM (SELECT *, count(reason) OVER (PARTITION BY source ORDER BY round ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM s) WHERE before = 0""")
def t7_capped_rounds(spark, sf):
    return streams.capped(views.view(spark, sf, "rounds").select("source", "round", "items"), 12)
