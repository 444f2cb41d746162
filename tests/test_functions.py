from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from postloom.functions import classify, numbers, text, time, urls


def one(spark, values, f, kind="string"):
    rows = [(i, v) for i, v in enumerate(values)]
    return [r[0] for r in spark.createDataFrame(rows, f"i int, x {kind}").select("i", f(F.col("x")).alias("y")).orderBy("i").select("y").collect()]


def test_clean_text(spark):
    got = one(spark, ["  a  b\n", "\x07", None, "", "c\x85d　e"], text.clean_text)
    assert got == ["a b", None, None, None, "c d e"]


def test_hashtags_and_mentions(spark):
    assert one(spark, ["#a #b #a #é😀", None, "no"], text.hashtags) == [["#a", "#b", "#é"], [], []]
    assert one(spark, ["@ann. hi @ann, x@y.org @.", None], text.mentions) == [["@ann", "@y.org", "@"], []]


def test_unique_keeps_order(spark):
    assert one(spark, [["b", "", None, "a", "b"], None], text.unique, "array<string>") == [["b", "a"], []]


def test_decode_json_text(spark):
    assert one(spark, ["a\\nb", "\\ud83d\\ude00", "x\\ud83d!", "  ", "café"], text.decode_json_text) == ["a\nb", "😀", "x�!", None, "café"]


@pytest.mark.parametrize(("given", "want"), [
    ("1.2K likes", 1200), ("3.4M", 3400000), ("1,234", 1234), ("42 Comments", 42), ("Share", None), ("", None), ("2.5Kb", 2), ("1.2.3", None), ("1.001K", 1000), ("12k", 12000), ("All reactions: 15", 15), (None, None),
])
def test_parse_count(spark, given, want):
    assert one(spark, [given], numbers.parse_count) == [want]


def test_count_near(spark):
    assert one(spark, ["5 likes and 3 Comments", "comments: none", "a comment here ......................... comment 7"], lambda x: numbers.count_near(x, ("comment",))) == [3, None, 7]


def test_int_or_none(spark):
    assert one(spark, ["5", " 6 ", "1.5", "x", None], numbers.int_or_none) == [5, 6, None, None, None]


NOW = datetime(2026, 9, 21, 10, 0, 0)


@pytest.mark.parametrize(("given", "want"), [
    ("Just now", NOW), ("3 h", datetime(2026, 9, 21, 7)), ("2 d ago", datetime(2026, 9, 19, 10)), ("1 w", datetime(2026, 9, 14, 10)), ("5 s", None), ("0 h", None), ("1700000000", datetime(2023, 11, 14, 22, 13, 20)),
    ("Yesterday at 5:30 PM", datetime(2026, 9, 20, 17, 30)), ("August 2, 2024 at 8:00 AM", datetime(2024, 8, 2, 8)), ("Aug 2 at 8:00 AM", datetime(2026, 8, 2, 8)), ("December 5", None), ("5 December", datetime(2025, 12, 5)),
    ("2 August 2024", datetime(2024, 8, 2)), ("2024-08-02T08:00:00Z", datetime(2024, 8, 2, 8)), ("2024-08-02T08:00:00+06:00", datetime(2024, 8, 2, 2)), ("2024-08-02", datetime(2024, 8, 2)), ("soon", None), ("", None), (None, None),
])
def test_parse_timestamp(spark, given, want):
    assert one(spark, [given], lambda x: time.parse_timestamp(x, F.lit(NOW))) == [want]


def test_iso(spark):
    assert one(spark, [datetime(2024, 1, 2, 3, 4, 5), datetime(2024, 1, 2, 3, 4, 5, 120000)], time.iso, "timestamp") == ["2024-01-02T03:04:05Z", "2024-01-02T03:04:05.120000Z"]
    assert one(spark, ["2024-01-02T03:04:05Z", "bad", "2024-01-02", None], lambda x: time.iso(time.parse_iso(x))) == ["2024-01-02T03:04:05Z", None, "2024-01-02T00:00:00Z", None]


@pytest.mark.parametrize(("given", "want"), [
    ("https://x.org/a/?fbclid=1&b=2#f", "https://x.org/a?b=2"), ("https://x.org", "https://x.org/"), ("https://x.org/a?b=&c=1&REF=z&c=2", "https://x.org/a?c=1&c=2"), ("not-a-url", "not-a-url"), ("", None), (None, None), ("https://x.org/a//b/", "https://x.org/a//b"),
])
def test_post_url(spark, given, want):
    assert one(spark, [given], urls.normalize_post_url) == [want]


@pytest.mark.parametrize(("given", "want"), [
    ("https://www.social.example/Some.Page/", "https://www.social.example/Some.Page"), ("m.social.example/pg/Page", "https://www.social.example/Page"), ("//social.example/Page/photos", "https://www.social.example/Page"),
    ("https://social.example/profile.php?id=12345", "https://www.social.example/profile.php?id=12345"), ("https://social.example/people/A-B/123456", "https://www.social.example/people/A-B/123456"),
    ("", "malformed"), (None, "malformed"), ("ftp://social.example/x", "scheme_not_http"), ("https://other.org/x", "not_site"), ("https://badsocial.example/x", "not_site"), ("https://social.example/", "empty_path"), ("https://social.example/login", "reserved_path"),
    ("https://social.example/pg", "missing_handle"), ("https://social.example/profile.php?id=1", "invalid_profile_id"), ("https://social.example/people/A", "invalid_people_path"), ("https://social.example/Page/posts/5", "reserved_path"), ("https://social.example/a(b", "segments_invalid"),
])
def test_source_url(spark, given, want):
    (got,) = one(spark, [given], urls.classify_source)
    assert (got["normalized_url"] or got["reason"]) == want and got["valid"] == want.startswith("https")


def test_other_urls(spark):
    assert one(spark, ["/story.php?a=1&story_fbid=5", "/x/posts/7", "/photos/a.1/9/", "/about"], urls.post_id) == ["5", "7", "9", None]
    assert one(spark, ["https://l.social.example/l.php?u=https%3A%2F%2Fx.org%2Fa&h=1", "https://x.org"], urls.unshim) == ["https://x.org/a", "https://x.org"]
    assert one(spark, ["/a", "//c.org/x", "b", "https://d.org"], lambda h: urls.absolute(h, F.lit("https://s.org/p/q?z=1"))) == ["https://s.org/a", "https://c.org/x", "https://s.org/p/b", "https://d.org"]
    assert one(spark, [" https://x.org/a ", "javascript:1", "https://", "http://x\x01.org", None], urls.safe_http) == ["https://x.org/a", None, None, None, None]


def test_page_verdict(spark):
    pad = "<p>" + "word " * 60 + "</p>"
    given = ["short", pad + "Page not found", pad + "Please log in to continue", pad + "captcha", pad + "<script>captcha</script>", None]
    assert one(spark, given, classify.page_verdict) == ["empty", "not_found", "wall", "traffic", "ok", "empty"]
