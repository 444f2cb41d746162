"""Registered queries of extraction: each puts a page's number into a page of one kind, and its SQL says what comes out.

The given pages have one container each and no media, counts, scripts or feeds; so the rows are the given ones, and their
HTML is made of them here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postloom import schemas
from postloom.functions import text
from postloom.plans.queries import AS_OF, query
from postloom.sources import extract, readers

PAGE = "https://www.social.example/Page"


def built(spark: SparkSession, sf: str, html: str) -> DataFrame:
    """The given pages with html as the SQL expression says, of i, the page's number."""
    rows = readers.table(spark, sf, "pages").select(F.col("page_id").alias("page_key"), F.lit(PAGE).alias("url"), F.col("page_id").alias("i"))
    return rows.withColumn("html", F.expr(html)).drop("i")


def dom(*inside: str) -> str:
    """A page with one container that holds the parts, SQL expressions of i."""
    return "concat('<html><head><title>T</title></head><body><div role=\"article\" data-href=\"/Page/posts/', i + 1000, '\"><h3><a href=\"/Page\">Page</a></h3>', " + ", ".join(inside) + ", '</div></body></html>')"


def dom_posts(spark: SparkSession, sf: str, *inside: str) -> DataFrame:
    return extract.posts_from_parts(extract.dom_parts(built(spark, sf, dom(*inside))), F.expr(AS_OF))


_TEXT = "'<p>Note ', i % 7, ' by @user', i % 5, '</p><script>var x = 1;</script><a href=\"/comment/1\">Comment</a><a href=\"#\">See more</a>'"


@query(f"""SELECT page_id AS page_key, CASE page_id % 5 WHEN 0 THEN 'Tom & Co ' || page_id WHEN 1 THEN 'Page ' || page_id WHEN 2 THEN 'Head ' || page_id WHEN 3 THEN 'Top ' || page_id ELSE 'h' || page_id END AS page_name,
CASE WHEN page_id % 5 = 0 THEN CAST(1234567 + page_id AS VARCHAR) END AS page_id, CASE WHEN page_id % 5 = 0 THEN 'https://www.social.example/people/Tom/' || (1234567 + page_id) ELSE '{PAGE}' END AS profile_url,
CASE WHEN page_id % 5 = 0 THEN 'https://i.example/' || page_id || '.png' END AS og_image FROM pages""")
def x1_page_names(spark, sf):
    """By og:title, by the title, by a link in a heading or a header, by the handle."""
    html = """CASE i % 5 WHEN 0 THEN concat('<meta property="og:title" content="Tom &amp; Co ', i, ' | social.example"><meta content="https://www.social.example/people/Tom/', 1234567 + i, '" property="og:url"><meta name="og:image" content="https://i.example/', i, '.png"><title>T</title>')
WHEN 1 THEN concat('<title>Page ', i, ' - social.example</title><h3><a href="/x">no</a></h3>') WHEN 2 THEN concat('<title></title><h3><a href="/x">Head <b>', i, '</b></a></h3>')
WHEN 3 THEN concat('<header><a href="/y">Top ', i, '</a></header>') ELSE '<p>nothing</p>' END"""
    pages = built(spark, sf, html).withColumn("handle", F.concat(F.lit("h"), F.col("page_key").cast("string")))
    return extract.page_meta(pages).select("page_key", "page_name", "page_id", "profile_url", "og_image")


@query("""SELECT page_id AS page_key, CASE page_id % 6 WHEN 0 THEN 'a b|c' WHEN 1 THEN 'd e' WHEN 2 THEN 'f' WHEN 4 THEN 'g|h' WHEN 5 THEN 'long enough text' END AS bodies FROM pages WHERE page_id % 6 <> 3""")
def x2_root_kinds(spark, sf):
    """Each kind of container, none inside another; marks of a preview that lie too high in the page (3) give none."""
    deep = "<div><div><div><div><div>"
    html = f"""concat('<html><body>', CASE i % 6 WHEN 0 THEN '<article>a<article>b</article></article><div role="article">no</div><article>c</article>' WHEN 1 THEN '<div role="article">d<span role="article">e</span></div><div data-ft="1">no</div>'
WHEN 2 THEN '{deep}<p data-ad-preview="message">f</p>{deep.replace("<", "</")}<div data-ft="1">no</div>' WHEN 3 THEN '<p data-ad-preview="message">no</p><div data-ft="1">no</div>'
WHEN 4 THEN '<div data-ft="1">g</div><div class="story">a story of some length</div><div data-ft="2">h</div>' ELSE '<div class="x userContent">long enough text</div><div class="story">short</div>' END, '</body></html>')"""
    parts = extract.dom_parts(built(spark, sf, html))
    bodies = parts.groupBy("page_key").agg(F.array_sort(F.collect_list(F.struct("ord", "body"))).alias("b"))  # the few containers of a page
    return bodies.select("page_key", F.array_join("b.body", "|").alias("bodies"))


@query("SELECT page_id AS page_key, CAST(page_id + 1000 AS VARCHAR) AS post_id, 'https://www.social.example/Page/posts/' || (page_id + 1000) AS post_url FROM pages")
def x3_post_addresses(spark, sf):
    return dom_posts(spark, sf, _TEXT).select("page_key", "post_id", "post_url")


@query("SELECT page_id AS page_key, 'Note ' || (page_id % 7) || ' by @user' || (page_id % 5) AS text FROM pages")
def x4_visible_text(spark, sf):
    return dom_posts(spark, sf, _TEXT).select("page_key", "text")


@query("""SELECT page_id AS page_key, CASE page_id % 4 WHEN 0 THEN 1700000000 + page_id * 60 WHEN 1 THEN epoch(TIMESTAMP '2024-08-15 15:00:00')::BIGINT WHEN 2 THEN epoch(TIMESTAMP '2024-06-15 10:00:00')::BIGINT - (page_id % 20 + 1) * 3600 END AS published
FROM pages""")
def x5_post_times(spark, sf):
    """By data-utime, by a date in a label, by a relative time in an abbr, and none."""
    time = "CASE i % 4 WHEN 0 THEN concat('<abbr data-utime=\"', 1700000000 + i * 60, '\">x</abbr>') WHEN 1 THEN '<a aria-label=\"August 15, 2024 at 3:00 PM\">t</a>' WHEN 2 THEN concat('<abbr>', i % 20 + 1, ' hours ago</abbr>') ELSE '' END"
    return dom_posts(spark, sf, time, "'<p>words</p>'").select("page_key", F.unix_timestamp("published_at").alias("published"))


@query("""SELECT page_id AS page_key, CASE WHEN page_id % 3 = 0 THEN 'https://www.social.example/img/' || page_id || '.jpg' END AS media_url, CASE WHEN page_id % 3 = 1 THEN 'https://v.example/' || page_id || '.mp4' END AS video_url,
CASE page_id % 3 WHEN 0 THEN 'https://www.social.example/img/' || page_id || '.jpg' WHEN 2 THEN 'https://i.example/card.png' END AS thumbnail_url, page_id % 3 = 0 AS has_image, page_id % 3 = 1 AS has_video, page_id % 3 = 2 AS has_link_preview FROM pages""")
def x6_media(spark, sf):
    """The largest picture of content, a video, or the card of a link."""
    media = """CASE i % 3 WHEN 0 THEN concat('<img src="/img/icons/e.png" width="900" height="900"><img src="/img/s.jpg" width="100" height="90"><img src="/img/', i, '.jpg" width="640" height="480"><img src="/t.png" width="20" height="20">')
WHEN 1 THEN concat('<video src="https://v.example/', i, '.mp4"></video>') ELSE '<div class="attachment"><img src="https://i.example/card.png"></div>' END"""
    return dom_posts(spark, sf, media).select("page_key", "media_url", "video_url", "thumbnail_url", "has_image", "has_video", "has_link_preview")


@query("""SELECT page_id AS page_key, page_id % 50 + 1100 AS comments_count, page_id % 9 AS shares, page_id % 40 AS reaction_like_count, CASE WHEN page_id % 2 = 0 THEN page_id % 8 END AS reaction_wow_count, (page_id % 6) * 1000 + 500 AS views_count FROM pages""")
def x7_engagement(spark, sf):
    """Counts of labels, of which the last one wins, with and without units, and counts beside pictures of reactions."""
    counts = """'<span aria-label="7 comments"></span><span aria-label="1,1', lpad(CAST(i % 50 AS STRING), 2, '0'), ' comments"></span><span aria-label="', i % 9, ' shares"></span><span aria-label="Like: ', i % 40, '"></span><span aria-label="', i % 6, '.5K views"></span>',
CASE WHEN i % 2 = 0 THEN concat('<span aria-label="Wow: ', i % 8, '"></span>') ELSE '' END"""
    return dom_posts(spark, sf, counts).select("page_key", "comments_count", "shares", "reaction_like_count", "reaction_wow_count", "views_count")


@query("""SELECT page_id AS page_key, 'https://out' || (page_id % 3) || '.example.org/a?b=' || page_id || '|https://x.org/a' AS links, 'Ann B|user' || (page_id % 5) AS names FROM pages""")
def x8_shimmed_links(spark, sf):
    """Links to other hosts, those behind the site's redirect decoded, once each; people by their links and by @names."""
    inside = """'<p>See <a href="https://out', i % 3, '.example.org/a?b=', i, '">o</a> <a href="https://l.social.example/l.php?u=https%3A%2F%2Fx.org%2Fa">x</a> <a href="https://x.org/a">x</a> <a href="https://m.social.example/y">y</a>
<a href="/people/Ann-B/1234567">Ann B</a> with @user', i % 5, '</p>'"""
    got = extract.once_each(dom_posts(spark, sf, inside))
    return got.select("page_key", text.joined(F.col("external_links")).alias("links"), text.joined(F.col("mentions")).alias("names"))


_SCRIPT = """concat('<html><title>P</title><script>{"post_id":"', i + 5000, '","creation_time":', 1700000000 + i, ',"message":{"text":"Morning \\\\u0041ll @bob', i % 5, '"},"reaction_count":{"count":', i % 30, '},"comment_count":{"total":1,"count":', i % 12, '},"owner_id":"77","uri":"https://scontent.x\\\\/', i, '.jpg"} {"post_id":"', i + 5000, '"}</script></html>')"""


@query("""SELECT page_id AS page_key, CAST(page_id + 5000 AS VARCHAR) AS post_id, 'https://www.social.example/permalink.php?story_fbid=' || (page_id + 5000) || '&id=77' AS post_url, 'Morning All @bob' || (page_id % 5) AS text, 1700000000 + page_id AS published,
page_id % 30 AS reactions, page_id % 12 AS comments_count, CAST(NULL AS BIGINT) AS shares, 'https://scontent.x/' || page_id || '.jpg' AS media_url, 'bob' || (page_id % 5) AS names FROM pages""")
def x9_script_posts(spark, sf):
    got = extract.script_posts(built(spark, sf, _SCRIPT))
    return got.select("page_key", "post_id", "post_url", "text", F.unix_timestamp("published_at").alias("published"), "reactions", "comments_count", "shares", "media_url", text.joined(F.col("mentions")).alias("names"))


@query("""SELECT page_id AS page_key, CAST(page_id + 5000 AS VARCHAR) AS post_id, 'Words ' || page_id || CASE page_id % 7 WHEN 5 THEN ' ' || chr(128512) WHEN 6 THEN ' ' || chr(65533) ELSE '' END AS text, page_id % 9 AS shares, page_id % 2 = 0 AS has_image, page_id % 2 = 1 AS has_video, page_id % 3 = 0 AS has_link_preview FROM pages""")
def x9_script_text_forms(spark, sf):
    """Each form of a text around an id: in ranges, messages, other keys and contents; pairs of surrogates, and a half of one."""
    form = """CASE i % 7 WHEN 0 THEN concat('"delight_ranges":[],"text":"Words ', i, '"') WHEN 1 THEN concat('"message":{"x":1,"text":"Words ', i, '"}') WHEN 2 THEN concat('"message_text":"Words ', i, '"')
WHEN 3 THEN concat('"text_value":"Words ', i, '"') WHEN 4 THEN concat('"content":{"text":"Words ', i, '"}') WHEN 5 THEN concat('"message":{"text":"Words ', i, ' \\\\ud83d\\\\ude00"}') ELSE concat('"message":{"text":"Words ', i, ' \\\\ud83d"}') END"""
    html = f"""concat('<html><script>{{"post_id":"', i + 5000, '",', {form}, ',"share_count":{{"count":', i % 9, '}},"__typename":"', if(i % 2 = 0, 'Photo', 'Video'), '","story_attachment_style":"', if(i % 3 = 0, 'share', 'album'), '"}}</script></html>')"""
    return extract.script_posts(built(spark, sf, html)).select("page_key", "post_id", "text", "shares", "has_image", "has_video", "has_link_preview")


def _story(number: str, more: str = "''") -> str:
    return f"""concat('{{"__typename":"Story","post_id":"', {number}, '","creation_time":', 1700000000 + i, ',"permalink_url":"/Page/posts/', {number}, '","message":{{"text":"Feed ', i % 7, '"}},"feedback":{{"reaction_count":{{"count":', i % 30, '}}}},"x":[{{"comments":{{"total_count":', i % 11, '}}}}]', {more}, '}}')"""


def _feed(*nodes: str) -> str:
    edges = ", ',', ".join(f"'{{\"node\":', {n}, '}}'" for n in nodes)
    return f"concat('{{\"data\":{{\"user\":{{\"timeline_list_feed_units\":{{\"edges\":[', {edges}, ']}}}}}}}}', chr(10), '{{\"data\":{{\"page_info\":{{\"has_next_page\":', if(i % 2 = 0, 'true', 'false'), ',\"end_cursor\":\"c', i, '\"}}}}}}', if(i % 3 = 0, '{{bad {{\"data\":{{\"page_info\":{{\"end_cursor\":\"never\"}}}}}}', ''))"


def _bodies(spark: SparkSession, sf: str, *nodes: str) -> DataFrame:
    return built(spark, sf, _feed(*nodes)).withColumnRenamed("html", "body")


@query("""SELECT page_id AS page_key, ord, CAST(page_id + 9000 + ord AS VARCHAR) AS post_id, 'https://www.social.example/Page/posts/' || (page_id + 9000 + ord) AS post_url, 'Feed ' || (page_id % 7) AS text, page_id % 30 AS reactions, page_id % 30 AS likes,
page_id % 11 AS comments_count, 0::BIGINT AS shares FROM pages, (SELECT unnest([0, 1]) AS ord)""")
def x10_feed_posts(spark, sf):
    """M4, M5: two stories, of which the second comes again; counts that are stated, and counts further down."""
    rows = extract.feed_rows(_bodies(spark, sf, _story("i + 9000"), _story("i + 9001"), _story("i + 9001")))
    return extract.feed_posts(rows).select("page_key", F.col("ord").cast("int").alias("ord"), "post_id", "post_url", "text", "reactions", "likes", "comments_count", "shares")


@query("""SELECT page_id AS page_key, ord, CAST(page_id + 9000 + ord AS VARCHAR) AS post_id, CASE WHEN ord = 0 AND page_id % 4 < 3 THEN 'https://scontent.x/' || page_id || '.jpg' END AS thumbnail_url, CASE WHEN ord = 0 AND page_id % 4 IN (0, 2) THEN 'https://scontent.x/' || page_id || '.jpg' END AS media_url,
CASE WHEN ord = 0 AND page_id % 4 = 1 THEN 'https://v.x/' || page_id || '.mp4' END AS video_url, ord = 0 AND page_id % 4 IN (0, 2) AS has_image, ord = 0 AND page_id % 4 = 1 AS has_video FROM pages, (SELECT unnest([0, 1]) AS ord) WHERE ord = 0 OR page_id % 2 = 1""")
def x10_feed_media(spark, sf):
    """Stories under data.node and on its time line; a photo, a video, an album of photos, and none."""
    media = """CASE i % 4 WHEN 0 THEN concat(',"attachments":[{"media":{"__typename":"Photo","image":{"uri":"https://scontent.x/', i, '.jpg"}}}]')
WHEN 1 THEN concat(',"attachments":[{"media":{"__typename":"Video","image":{"uri":"https://scontent.x/', i, '.jpg"},"playable_url":"https://v.x/', i, '.mp4"}}]')
WHEN 2 THEN concat(',"attachments":[{"media":{"__typename":"Album"},"styles":{"attachment":{"all_subattachments":{"nodes":[{"media":{"__typename":"Photo","image":{"uri":"https://scontent.x/', i, '.jpg"}}},{"media":{"__typename":"Photo","image":{"uri":"https://scontent.x/second.jpg"}}}]}}}}]') ELSE '' END"""
    first, second = _story("i + 9000", media), _story("i + 9001")
    body = f"""if(i % 2 = 0, concat('{{"data":{{"node":', {first}, '}}}}'), concat('{{"data":{{"node":{{"__typename":"User","timeline_list_feed_units":{{"edges":[{{"node":', {first}, '}},{{"node":', {second}, '}}]}}}}}}}}'))"""
    rows = extract.feed_rows(built(spark, sf, body).withColumnRenamed("html", "body"))
    return extract.feed_posts(rows).select("page_key", F.col("ord").cast("int").alias("ord"), "post_id", "thumbnail_url", "media_url", "video_url", "has_image", "has_video")


@query("SELECT page_id AS page_key, page_id % 2 = 0 AS next_page, 'c' || page_id AS cursor, 1::BIGINT AS stories FROM pages")
def x11_feed_cursors(spark, sf):
    """M3, M6: documents up to the first bad one, and the last page_info among them."""
    rows = extract.feed_rows(_bodies(spark, sf, _story("i + 9000")))
    return extract.page_info(rows).join(rows.where("not is_info").groupBy("page_key").agg(F.count(F.lit(1)).alias("stories")), "page_key")


_BOTH = f"""CASE WHEN i % 3 = 0 THEN {dom(_TEXT)} WHEN i % 3 = 1 THEN {_SCRIPT} ELSE concat({dom(_TEXT)}, {_SCRIPT}) END"""


@query("SELECT page_id AS page_key, CAST(page_id + CASE WHEN page_id % 3 = 1 THEN 5000 ELSE 1000 END AS VARCHAR) AS post_id FROM pages")
def x12_dom_or_script(spark, sf):
    posts, _ = extract.extract(built(spark, sf, _BOTH), F.expr(AS_OF), way="http")
    return posts.select("page_key", "post_id")


@query("""SELECT page_id AS page_key, post_id, post_text AS text FROM (
SELECT page_id, CAST(page_id + 9000 AS VARCHAR) AS post_id, 'Feed ' || (page_id % 7) AS post_text FROM pages UNION ALL
SELECT page_id, CAST(page_id + 5000 AS VARCHAR), 'Morning All @bob' || (page_id % 5) FROM pages UNION ALL
SELECT page_id, CAST(page_id + 1000 AS VARCHAR), 'Note ' || (page_id % 7) || ' by @user' || (page_id % 5) FROM pages WHERE page_id % 2 = 0)""")
def x13_merged_posts(spark, sf):
    """Feed, script and container of one page; where the container has the feed post's id, the feed's is taken."""
    contained = f"if(i % 2 = 0, {dom(_TEXT)}, replace({dom(_TEXT)}, concat('/posts/', i + 1000), concat('/posts/', i + 9000)))"
    html = f"concat({contained}, {_SCRIPT}, '<script type=\"application/json\" data-feed=\"1\">', {_feed(_story('i + 9000'))}, '</script>')"
    pages = built(spark, sf, html)
    posts = extract.merged(extract.feed_posts(extract.feed_rows(extract.feed_bodies(pages))), extract.script_posts(pages), extract.posts_from_parts(extract.dom_parts(pages), F.expr(AS_OF)))
    return posts.select("page_key", "post_id", "text")


@query("""SELECT page_id AS page_key, 'extraction_failure' AS code, 'https://www.social.example/Page' AS source_url, 1::BIGINT AS kept FROM pages WHERE page_id % 4 = 0""")
def x14_isolated_errors(spark, sf):
    """A story that can't be read becomes an error row; the other story of its page stays."""
    bad = _story("i + 9001", """if(i % 4 = 0, ',"attachments":5', '')""")
    pages = built(spark, sf, f"concat('<html><script data-feed=\"1\">', {_feed(_story('i + 9000'), bad)}, '</script></html>')")
    posts, errors = extract.extract(pages, F.expr(AS_OF))
    kept = posts.where(F.col("post_id") == (F.col("page_key") + 9000).cast("string")).groupBy("page_key").agg(F.count(F.lit(1)).alias("kept"))
    return errors.select("page_key", "code", "source_url").join(kept, "page_key")


@query("""SELECT page_id AS page_key, CASE WHEN page_id % 2 = 0 THEN 'feed_json' ELSE 'html' END AS content_type, CAST(page_id + CASE WHEN page_id % 2 = 0 THEN 9000 ELSE 1000 END AS VARCHAR) AS post_id FROM pages""")
def s3_pages_by_content(spark, sf):
    """A body is read as what it is: HTML, or the answer of a feed."""
    pages = readers.typed(built(spark, sf, f"if(i % 2 = 0, {_feed(_story('i + 9000'))}, {dom(_TEXT)})"))
    posts, _ = extract.extract(pages, F.expr(AS_OF))
    return pages.select("page_key", "content_type").join(posts.select("page_key", "post_id"), "page_key")


_WHOLE = dom(
    """'<p>Post ', i % 7, ' #tag', i % 3, ' by @user', i % 5, ' see <a href="https://out.example.org/', i, '">o</a></p><abbr data-utime="', 1700000000 + i, '">x</abbr>'""",
    """'<span aria-label="', i % 40, ' comments"></span><span aria-label="', i % 9, ' shares"></span><span aria-label="Like: ', i % 11, '"></span><span aria-label="Wow: ', i % 4, '"></span><span aria-label="', i % 6, '.5K views"></span>'""",
    """'<img src="/img/', i, '.jpg" width="640" height="480">'""",
)
_NO = ("caption", "reaction_love_count", "reaction_care_count", "reaction_haha_count", "reaction_sad_count", "reaction_angry_count", "video_url", "transcript", "transcript_language", "likes", "page_id")


@query(f"""SELECT page_id AS page_key, CAST(page_id + 1000 AS VARCHAR) AS post_id, '{PAGE}' AS source_url, '{PAGE}/posts/' || (page_id + 1000) AS post_url, 'T' AS page_name, '{PAGE}' AS profile_url, 'image' AS post_type, 1700000000 + page_id AS published,
1700000000 + page_id AS timestamp, 'Post ' || (page_id % 7) || ' #tag' || (page_id % 3) || ' by @user' || (page_id % 5) || ' see o x' AS text, '#tag' || (page_id % 3) AS hashtags, 'user' || (page_id % 5) || '|@user' || (page_id % 5) AS mentions, 'https://out.example.org/' || page_id AS external_links,
nullif(page_id % 11 + page_id % 4, 0) AS reactions, page_id % 40 AS comments_count, page_id % 9 AS shares, (page_id % 6) * 1000 + 500 AS views_count, page_id % 11 AS reaction_like_count, page_id % 4 AS reaction_wow_count,
'image' AS media_type, 'https://www.social.example/img/' || page_id || '.jpg' AS thumbnail_url, 'https://www.social.example/img/' || page_id || '.jpg' AS media_url, epoch({AS_OF})::BIGINT AS scraped,
{", ".join(f"CAST(NULL AS VARCHAR) AS {c}" for c in _NO)} FROM pages""")
def x15_canonical_posts(spark, sf):
    """The whole slice, page to canonical post: all 33 fields."""
    posts, _ = extract.extract(built(spark, sf, _WHOLE), F.expr(AS_OF))
    lists = {c: text.joined(F.col(c)).alias(c) for c in ("hashtags", "mentions", "external_links")}
    made = lists | {"published_at": F.unix_timestamp("published_at").alias("published"), "scraped_at": F.unix_timestamp("scraped_at").alias("scraped")} | {c: F.col(c).cast("string").alias(c) for c in _NO}
    return posts.select("page_key", *[made.get(f.name, F.col(f.name)) for f in schemas.CANONICAL_POST])
