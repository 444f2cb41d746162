"""Kinds of posts, pages and failures, as Column to Column."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from postloom.functions.urls import SITE


def _some(x: Column) -> Column:
    return F.coalesce(x != "", F.lit(False))


def _yes(x: Column) -> Column:
    return F.coalesce(x, F.lit(False))


def post_type(has_video: Column, video_url: Column, has_image: Column, media_url: Column, thumbnail_url: Column, has_link_preview: Column, external_links: Column, text: Column) -> Column:
    """K1: video, then link, then image, then link, then text; else null."""
    video, image, links = _yes(has_video), _yes(has_image), F.coalesce(F.size(external_links) > 0, F.lit(False))
    return (
        F.when(video | _some(video_url), "video").when(_yes(has_link_preview) | (links & ~image & ~video), "link")
        .when(image | _some(media_url) | _some(thumbnail_url), "image").when(links, "link").when(_some(text), "text")
    )


def upgraded(kind: Column, video_url: Column, media_url: Column, thumbnail_url: Column) -> Column:
    """K2: a text post with media is a video or an image."""
    return F.when((kind == "text") & _some(video_url), "video").when((kind == "text") & (_some(media_url) | _some(thumbnail_url)), "image").otherwise(kind)


def media_type(kind: Column) -> Column:
    return F.when(kind.isin("video", "image"), kind)


#: What pages say that are not to be read, by verdict, in order of priority. {site} is the site's name.
MARKERS = {
    "not_found": (
        "this content isn't available", "content is not available", "this page isn't available", "sorry, this page isn't available", "the link you followed may be broken",
        "the page you requested cannot be displayed", "page not found", "post is not available",
    ),
    "wall": (
        'id="login_form"', 'name="login_form"', 'action="/login/', "<title>log in to {site}</title>", "<title>log into {site}</title>", "you must log in to continue", "please log in to continue",
        "you need to log in to continue", "log in to see more of", "to see more from", "log in or create an account", "must log in to see", "log in to {site} to continue", "please login to view",
        "join {site}", "create new account", "log into {site}", "continue with {site}", "enter the phone number or email", "see more of this page",
    ),
    "traffic": (
        "unusual traffic", "automated access", "security check", "captcha", "verify you're", "confirm you're not a robot", "confirm you are not a robot", "try again in a few minutes",
        "temporarily blocked", "suspicious activity", "we noticed unusual activity", "you have been blocked", "your account has been blocked",
    ),
}


def marker_pattern(verdict: str, site: str = SITE) -> str:
    return "|".join(re.sub(r"([.()\[\]{}?+*|^$\\])", r"\\\1", m.replace("{site}", site)) for m in MARKERS[verdict])


def page_verdict(html: Column, site: str = SITE, bound: int = 400_000) -> Column:
    """K3: empty, not_found, wall, traffic or ok, by what a page shows outside scripts and styles in its first part."""
    shown = F.regexp_replace(F.substring(html, 1, bound), "(?is)<script\\b[^>]*>.*?</script>", "")
    shown = F.lower(F.regexp_replace(shown, "(?is)<style\\b[^>]*>.*?</style>", ""))
    out = F.when(F.coalesce(F.length(html), F.lit(0)) < 200, "empty")
    for verdict in MARKERS:
        out = out.when(shown.rlike(marker_pattern(verdict, site)), verdict)
    return out.otherwise("ok")


#: Codes of failures by their class.
ERROR_CODES = {
    "InvalidUrl": "invalid_url", "UnsupportedUrl": "unsupported_url", "PageUnavailable": "page_unavailable", "AuthRequired": "auth_required", "RateLimited": "rate_limited", "Timeout": "timeout",
    "ExtractionFailure": "extraction_failure",
}


def error_code(failure: Column) -> Column:
    """K4: the code of a failure's class, scrape_failed for others."""
    out = F.lit("scrape_failed")
    for name, code in ERROR_CODES.items():
        out = F.when(failure == name, code).otherwise(out)
    return out
