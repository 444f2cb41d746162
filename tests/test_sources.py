from __future__ import annotations

import csv
import io
import json
from datetime import datetime
from pathlib import Path

from pyspark.sql import functions as F

from postloom import catalog, schemas
from postloom.sources import export, extract, readers
from tests.test_operators import posts

NOW = datetime(2026, 9, 21, 10)


def read_parts(folder: Path) -> str:
    return "".join(p.read_text(encoding="utf-8") for p in sorted(folder.glob("part-*")))


def sample(spark):
    return posts(spark, [{"post_id": "1", "text": 'a "b", c\nd', "hashtags": ["#x", None, "#y"], "mentions": [], "likes": 3, "published_at": datetime(2024, 1, 2)}, {"post_id": "2", "text": " é ", "hashtags": [], "mentions": []}])


def test_csv(spark, tmp_path):
    export.export(sample(spark).coalesce(1), "csv", str(tmp_path / "c"))
    body = read_parts(tmp_path / "c")
    assert body.startswith("﻿")
    rows = list(csv.reader(io.StringIO(body.lstrip("﻿"))))
    assert rows[0] == list(schemas.FLAT_COLUMNS) and len(rows) == 3
    first = dict(zip(rows[0], rows[1]))
    assert first["text"] == 'a "b", c\nd' and first["hashtags"] == "#x||#y" and first["shares"] == "" and rows[2][rows[0].index("text")] == " é "


def test_json_and_lines_round_trip(spark, tmp_path):
    export.export(sample(spark), "json", str(tmp_path / "a"))
    got = json.loads(read_parts(tmp_path / "a"))
    assert len(got) == 2 and list(got[0]) == [f.name for f in schemas.CANONICAL_POST] and got[0]["published_at"] == "2024-01-02T00:00:00+00:00"
    assert readers.read_posts(spark, str(tmp_path / "a")).orderBy("post_id").first()["hashtags"] == ["#x", None, "#y"]
    export.export(sample(spark).limit(0), "json", str(tmp_path / "e"))
    assert json.loads(read_parts(tmp_path / "e")) == []
    export.export(sample(spark), "jsonl", str(tmp_path / "l"))
    assert {json.loads(x)["post_id"] for x in read_parts(tmp_path / "l").splitlines()} == {"1", "2"}


def test_large_json_is_an_array_a_part(spark, tmp_path):
    many = spark.range(40).select(F.col("id").cast("string").alias("post_id")).repartition(4)
    rows = many.select(*[(F.col("post_id") if f.name == "post_id" else F.lit(None)).cast(f.dataType).alias(f.name) for f in schemas.CANONICAL_POST])
    export.write_json(rows, str(tmp_path / "p"), one_file=False)
    parts = [json.loads(p.read_text()) for p in (tmp_path / "p").glob("part-*") if p.stat().st_size]
    assert len(parts) == 4 and sorted(int(r["post_id"]) for x in parts for r in x) == [*range(40)]
    assert readers.read_posts(spark, str(tmp_path / "p")).count() == 40


def test_workbook_and_batches(spark, tmp_path):
    export.export(sample(spark), "xlsx", str(tmp_path / "x"), "7", "s", "2024-06-15T10:00:00+00:00")
    assert dict(spark.read.parquet(str(tmp_path / "x/Metadata")).collect())["posts_count"] == "2"
    export.write_batches(sample(spark).union(sample(spark)), str(tmp_path / "b"), 1, 1)
    assert len(list((tmp_path / "b").glob("part-*"))) == 4


DOM = """<html><head><title>Page One | Social</title></head><body>
<div role="article" data-href="/Page/posts/111"><h3><a href="/Page">Page</a></h3><abbr data-utime="1700000000">x</abbr><p>Hello #tag <a href="https://l.social.example/l.php?u=https%3A%2F%2Fx.org%2Fa">x.org</a></p>
<a href="/comment/1">Comment</a><span aria-label="1.2K Comments"></span><span aria-label="7 shares"></span><span aria-label="Like: 40"></span><img src="/img/a.jpg" width="640" height="480"><img src="/icons/e.png">
<div role="article">nested</div></div>
<div role="article"><p>Second one</p><a aria-label="August 15, 2024 at 3:00 PM">t</a><a href="/people/Ann-B/1234567">Ann B</a><div class="attachment"><img src="https://i.org/card.png"></div></div></body></html>"""


def pages(spark, *htmls):
    return spark.createDataFrame([(i, "https://www.social.example/Page", h) for i, h in enumerate(htmls)], "page_key long, url string, html string")


def test_dom_posts(spark):
    got = extract.posts_from_parts(extract.dom_parts(pages(spark, DOM)), F.lit(NOW)).orderBy("ord").collect()
    assert len(got) == 2
    a, b = got
    assert (a.post_id, a.post_url, a.published_at) == ("111", "https://www.social.example/Page/posts/111", datetime(2023, 11, 14, 22, 13, 20))
    assert (a.comments_count, a.shares, a.reaction_like_count, a.media_url, a.has_image) == (1200, 7, 40, "https://www.social.example/img/a.jpg", True)
    assert a.external_links == ["https://x.org/a"] and a.text.startswith("x Hello #tag") and "Comment" not in a.text
    assert b.published_at == datetime(2024, 8, 15, 15) and b.mentions == ["Ann B"] and b.has_link_preview and b.thumbnail_url == "https://i.org/card.png"


SCRIPT = '<html><title>P</title><script>{"post_id":"55","creation_time":1700000000,"message":{"text":"Good morning \\u0041ll @bob https://x.org/q"},"reaction_count":{"count":12},"comment_count":{"total":1,"count":3},"owner_id":"77","uri":"https://scontent.x\\/a.jpg"} {"post_id":"55"}</script></html>'


def test_script_posts(spark):
    (r,) = extract.script_posts(pages(spark, SCRIPT, "<p>none</p>")).collect()
    assert (r.post_id, r.text, r.reactions, r.likes, r.comments_count, r.shares) == ("55", "Good morning All @bob https://x.org/q", 12, 12, 3, None)
    assert r.post_url == "https://www.social.example/permalink.php?story_fbid=55&id=77" and r.media_url == "https://scontent.x/a.jpg" and r.mentions == ["bob"] and r.external_links == ["https://x.org/q"]


STORY = {"__typename": "Story", "post_id": "9", "creation_time": 1700000000, "permalink_url": "/Page/posts/9", "message": {"text": "Feed text"}, "feedback": {"reaction_count": {"count": 4}},
         "x": [{"comments": {"total_count": 6}}], "attachments": [{"media": {"__typename": "Photo"}, "styles": {"attachment": {"media": {"photo_image": {"uri": "https://i/p.jpg"}}}}}]}
FEED = json.dumps({"data": {"user": {"timeline_list_feed_units": {"edges": [{"node": STORY}, {"node": STORY}]}}}}) + "\n" + json.dumps({"data": {"page_info": {"has_next_page": True, "end_cursor": "c1"}}}) + "{bad"


def test_feed_posts(spark):
    bodies = spark.createDataFrame([(1, "https://www.social.example/Page", FEED)], "page_key long, url string, body string")
    rows = extract.feed_rows(bodies)
    (r,) = extract.feed_posts(rows).collect()
    assert (r.post_id, r.post_url, r.text, r.reactions, r.likes, r.comments_count, r.shares, r.thumbnail_url, r.has_image) == ("9", "https://www.social.example/Page/posts/9", "Feed text", 4, 4, 6, 0, "https://i/p.jpg", True)
    assert tuple(extract.page_info(rows).first()) == (1, True, "c1")


def test_merge_prefers_feed(spark):
    html = DOM.replace("Page/posts/111", "Page/posts/9").replace("</body>", f'<script type="application/json" data-feed="1">{FEED}</script></body>')
    got, errors = extract.extract(pages(spark, html), F.lit(NOW))
    rows = got.orderBy("ord").collect()
    assert [r.post_id for r in rows] == ["9", None] and rows[0].text == "Feed text" and rows[0].page_name == "Page One | Social" and errors.count() == 0


def test_references_that_were_cut_short(spark):
    cut = "<article><h1>a&amp;&amp</h1><p>b &lt;c&gt; &copy; &copy=1 &amplt; &nosuch; &#39; &#39 x&y & z</p><script>p&q&amp</script></article>"
    (r,) = extract.dom_parts(pages(spark, cut)).collect()
    assert r.shown == "a&&amp b <c> © &copy=1 &amplt; &nosuch; ' &#39 x&y & z" and r.body.endswith("p&q&amp")


def test_links_and_mentions_stand_as_often_as_found(spark):
    twice = '<article><p>Ask @bob or @bob</p><a href="https://x.org/a">one</a><a href="https://x.org/a">two</a></article>'
    (r,) = extract.posts_from_parts(extract.dom_parts(pages(spark, twice)), F.lit(NOW)).collect()
    assert r.mentions == ["bob", "bob"] and r.external_links == ["https://x.org/a"] * 2
    got, _ = extract.extract(pages(spark, twice), F.lit(NOW))
    assert (got.first().mentions, got.first().external_links) == (["bob", "@bob"], ["https://x.org/a"])


def test_links_and_mentions_once_each(spark):
    rows = catalog.QUERIES["x8_shimmed_links"](spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == 50 and all(r.links == f"https://out{r.page_key % 3}.example.org/a?b={r.page_key}|https://x.org/a" for r in rows)
    again = """<article><p>Ask @bob, @ann or @bob</p><a href="https://x.org/b">b</a><a href="https://l.social.example/l.php?u=https%3A%2F%2Fx.org%2Fa">a</a><a href="https://x.org/a">a</a>
<a href="https://x.org/b">b</a><a href="/people/Ann-B/1234567">Ann B</a><a href="/people/Ann-B/1234567">Ann B</a></article>"""
    parsed = extract.posts_from_parts(extract.dom_parts(pages(spark, again, "<article>none</article>")), F.lit(NOW))
    one, none = extract.once_each(parsed).orderBy("page_key").collect()
    assert (one.external_links, one.mentions) == (["https://x.org/b", "https://x.org/a"], ["Ann B", "bob", "ann"]) and (none.external_links, none.mentions) == ([], [])


def test_large_json_has_bounded_arrays_and_may_be_compressed(spark, tmp_path):
    rows = spark.range(25).repartition(2).select(*[(F.col("id").cast("string") if f.name == "post_id" else F.lit(None)).cast(f.dataType).alias(f.name) for f in schemas.CANONICAL_POST])
    export.write_json(rows, str(tmp_path / "p"), most=5)
    parts = [json.loads(p.read_text()) for p in (tmp_path / "p").glob("part-*")]
    assert max(map(len, parts)) == 5 and sorted(int(r["post_id"]) for x in parts for r in x) == [*range(25)]
    for fmt in ("json", "jsonl", "csv"):
        export.export(rows, fmt, str(tmp_path / fmt), compression="gzip")
        assert all(p.suffix == ".gz" for p in (tmp_path / fmt).glob("part-*"))
    assert {r.post_id for r in readers.read_posts(spark, str(tmp_path / "json")).collect()} == {str(k) for k in range(25)}


def test_compressed_lines_and_tables_are_in_files_of_bounded_size(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(export, "ONE_FILE", 5)
    rows = spark.range(12).repartition(1).select(*[(F.col("id").cast("string") if f.name == "post_id" else F.lit(None)).cast(f.dataType).alias(f.name) for f in schemas.CANONICAL_POST])
    export.write_jsonl(rows, str(tmp_path / "l"), "gzip")
    export.write_cli_csv(rows, str(tmp_path / "c"), "gzip")
    for folder, n in (("l", 12), ("c", 15)):  # each table has its header
        assert len(list((tmp_path / folder).glob("part-*.gz"))) == 3 and spark.read.text(str(tmp_path / folder)).count() == n


def test_parts_of_pages_are_made_a_few_at_a_time(spark, monkeypatch):
    monkeypatch.setattr(extract, "PAGES", 3)
    many = pages(spark, *[f"<article>{k}</article>" * (k % 3) for k in range(20)])
    parts = extract.dom_parts(many)
    assert sorted((r.page_key, r.ord, r.shown) for r in parts.collect()) == [(k, i, str(k)) for k in range(20) for i in range(k % 3)]
    assert "MapInArrow" in parts._jdf.queryExecution().toString()
