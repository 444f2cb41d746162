"""URL functions, as Column to Column. The site whose pages are read is a parameter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from postloom.functions.text import let

SITE = "social.example"
#: Parameters that only track, which post addresses lose.
TRACKING = ("fbclid", "ref", "source", "medium", "__cft__", "__tn__", "hc_entry", "action_type")
#: First path segments that are no page or profile.
RESERVED = (
    "login", "login.php", "checkpoint", "recover", "reg", "register", "register.php", "r.php", "signup", "accounts", "dialog", "consent", "privacy", "privacycenter", "cookies", "cookie_policy",
    "terms", "legal", "policies", "help", "help.php", "settings", "settings.php", "security", "data", "download", "watch", "reel", "reels", "stories", "story", "story.php", "photo", "photo.php",
    "video", "videos", "video.php", "live", "gaming", "groups", "events", "marketplace", "jobs", "offers", "places", "pages", "showcase", "plugins", "share", "sharer", "sharer.php", "share.php",
    "search", "search.php", "findfriends", "find-friends", "friends", "messages", "messenger", "notifications", "business", "creators", "developers", "careers", "company", "climate", "graph", "api",
    "ajax", "oauth", "external", "intl", "fundraisers", "fundraising", "pay", "payments", "m", "l", "d", "k", "i", "x", "t", "u", "q", "c", "n", "s", "permalink.php", "redir", "redirect",
)
#: Tabs of a page, which may follow its handle.
TABS = (
    "about", "about_profile_transparency", "photos", "albums", "videos", "reels", "reels_tab", "posts", "followers", "following", "friends", "likes", "reviews", "events", "notes", "timeline",
    "featured", "shops", "shop", "community", "info", "mentions", "media", "map", "offers", "contact", "about_contact_and_basic_info", "about_places", "about_relationship",
    "about_family_and_relationships", "about_details", "about_work_and_education", "about_life_events", "about_username", "about_contact", "about_likes", "groups", "checkins", "maha_info",
    "professional_skills",
)
_PARTS = "^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\\?([^#]*))?(?:#.*)?$"


def _part(url: Column, k: int) -> Column:
    return F.regexp_extract(url, _PARTS, k)


def parts_of(url: Column) -> Column:
    """struct<scheme, net, path, query> of an address, each taken from it once."""
    return F.struct(F.lower(_part(url, 1)).alias("scheme"), _part(url, 2).alias("net"), _part(url, 3).alias("path"), _part(url, 4).alias("query"))


def _host_of(net: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(net, "^.*@", ""), ":[0-9]*$", ""))


def host(url: Column) -> Column:
    """The host in lower case, without user and port."""
    return _host_of(_part(url, 2))


def _plus(x: Column) -> Column:
    return F.try_url_decode(x)


def _without_tracking(query: Column) -> Column:
    value = lambda p: F.coalesce(_plus(F.substring(p, F.instr(p, "=") + 1, F.length(p))), F.lit(""))
    pairs = F.transform(F.filter(F.split(query, "&"), lambda p: p.contains("=")), lambda p: F.struct(F.coalesce(_plus(F.substring_index(p, "=", 1)), F.lit("")).alias("k"), value(p).alias("v")))
    kept = F.filter(pairs, lambda x: (x["v"] != "") & ~F.lower(x["k"]).isin(*TRACKING))
    items = F.transform(kept, lambda x: F.struct(x["k"].alias("k"), F.concat(F.url_encode(x["k"]), F.lit("="), F.url_encode(x["v"])).alias("q")))

    def together(items: Column) -> Column:
        keys = F.array_distinct(F.transform(items, lambda x: x["k"]))
        return F.array_join(F.flatten(F.transform(keys, lambda k: F.transform(F.filter(items, lambda x: x["k"] == k), lambda x: x["q"]))), "&")

    return let(items, together)


def normalize_post_url(url: Column) -> Column:
    """Without tracking and blank parameters, fragment and closing slashes. Repeated parameters stand together."""

    def joined(p: Column) -> Column:
        front = F.concat(F.when(p["scheme"] != "", F.concat(p["scheme"], F.lit(":"))).otherwise(""), F.when(p["net"] != "", F.concat(F.lit("//"), p["net"])).otherwise(""))
        path = let(F.regexp_replace(p["path"], "/+$", ""), lambda x: F.when(x == "", "/").otherwise(x))
        return F.concat(front, path, let(_without_tracking(p["query"]), lambda q: F.when(q != "", F.concat(F.lit("?"), q)).otherwise("")))

    return F.when(url.isNotNull() & (url != ""), let(parts_of(url), joined))


def classify_source(url: Column, site: str = SITE) -> Column:
    """struct<valid, normalized_url, reason> of an address of a page or profile; reason is a code, null if it is valid.

    The address is taken apart once, then its segments once; the rules read their fields.
    """
    whole = lambda s: F.when(s == "", s).when(s.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), s).when(s.startswith("//"), F.concat(F.lit("https:"), s)).otherwise(F.concat(F.lit("https://"), s))
    segments = lambda path: F.split(F.regexp_replace(F.regexp_replace(path, "^/+", ""), "/$", ""), "/")
    ids = lambda query: F.filter(F.transform(F.split(query, "&"), lambda p: F.when(p.startswith("id="), F.substring(p, 4, F.length(p)))), lambda x: x.isNotNull() & (x != ""))

    def fields(full: Column) -> Column:
        return let(parts_of(full), lambda u: F.struct((full == "").alias("empty"), u["scheme"].alias("scheme"), _host_of(u["net"]).alias("host"), u["path"].alias("path"), segments(u["path"]).alias("segments"), ids(u["query"]).alias("ids")))

    return let(let(let(F.trim(F.coalesce(url, F.lit(""))), whole), fields), lambda p: _judged(p, f"https://www.{site}/", site))


def _judged(p: Column, root: str, site: str) -> Column:
    """The rules of classify_source() over an address's fields."""
    segments, at = p["segments"], p["host"]
    first, second, third, n = F.get(segments, F.lit(0)), F.get(segments, F.lit(1)), F.get(segments, F.lit(2)), F.size(segments)
    handle_ok = lambda h: h.rlike("^[^\\s/?#%\\x00-\\x1F\\x7F()]{1,255}$") & ~h.isin(".", "..")
    one_id = (F.size(p["ids"]) == 1) & F.coalesce(F.get(p["ids"], F.lit(0)).rlike("^[0-9]{5,20}$"), F.lit(False))
    people = (n == 3) & F.coalesce(second.rlike("^[^\\s/?#\\x00-\\x1F]{1,200}$") & third.rlike("^[0-9]{5,20}$"), F.lit(False))
    tabs = F.forall(F.slice(segments, 2, F.greatest(n, F.lit(1))), lambda x: (x == "") | F.lower(x).isin(*TABS))
    reason = (
        F.when(p["empty"], "malformed").when(~p["scheme"].isin("http", "https"), "scheme_not_http").when((at != site) & ~at.endswith(f".{site}"), "not_site")
        .when(F.regexp_replace(p["path"], "/", "") == "", "empty_path")
        .when(first == "profile.php", F.when((n == 1) & one_id, None).otherwise("invalid_profile_id"))
        .when(first == "people", F.when(people, None).otherwise("invalid_people_path"))
        .when(first == "pg", F.when(n != 2, "missing_handle").when(handle_ok(second), None).otherwise("segments_invalid"))
        .when(first.isin(*RESERVED), "reserved_path").when(~handle_ok(first) | F.lower(first).isin(*RESERVED), "segments_invalid").when(~tabs, "reserved_path")
    )
    target = (
        F.when(first == "profile.php", F.concat(F.lit(f"{root}profile.php?id="), F.get(p["ids"], F.lit(0)))).when(first == "people", F.concat(F.lit(f"{root}people/"), second, F.lit("/"), third))
        .when(first == "pg", F.concat(F.lit(root), second)).otherwise(F.concat(F.lit(root), first))
    )
    return let(reason, lambda r: F.struct(r.isNull().alias("valid"), F.when(r.isNull(), target).alias("normalized_url"), r.alias("reason")))


def handle(normalized_url: Column) -> Column:
    """The last segment of a canonical source address, or the id of a profile address."""
    by_id = F.regexp_extract(normalized_url, "profile\\.php\\?id=([0-9]+)", 1)
    last = F.element_at(F.split(F.regexp_replace(_part(normalized_url, 3), "/+$", ""), "/"), -1)
    return F.coalesce(F.nullif(by_id, F.lit("")), F.nullif(last, F.lit("")))


def page_id(url: Column) -> Column:
    """U4: the numeric id in an address, if it has one."""
    found = [F.regexp_extract(url, p, 1) for p in ("/profile\\.php\\?[^\"'\\s]*id=([0-9]+)", "/people/[^\"'\\s/]+/([0-9]+)")]
    return F.coalesce(*[F.nullif(x, F.lit("")) for x in found])


#: Forms of post addresses, by priority.
POST_ID_FORMS = (
    "/story\\.php\\?[^\"'\\s]*story_fbid=([0-9]+)", "/permalink\\.php\\?[^\"'\\s]*story_fbid=([0-9]+)", "/photo\\.php\\?[^\"'\\s]*fbid=([0-9]+)", "/watch/\\?[^\"'\\s]*v=([0-9]+)",
    "/reel/([0-9]+)", "/posts/([0-9]+)", "/photos/(?:[^/\"'\\s]*/)*?([0-9]+)(?:[?/]|$)", "/videos/(?:[^/\"'\\s]*/)*?([0-9]+)(?:[?/]|$)",
)


def post_id(href: Column) -> Column:
    """The id of the post that an address points to."""
    return F.coalesce(*[F.nullif(F.regexp_extract(href, p, 1), F.lit("")) for p in POST_ID_FORMS])


def unshim(href: Column, hosts: tuple[str, ...] = (f"l.{SITE}", f"lm.{SITE}")) -> Column:
    """Where a link through the site's redirect goes."""
    target = F.try_url_decode(F.regexp_extract(_part(href, 4), "(?:^|&)u=([^&]*)", 1))
    return F.when(host(href).isin(*hosts) & _part(href, 3).startswith("/l.php") & (target != ""), target).otherwise(href)


def absolute(href: Column, page: Column) -> Column:
    """An address as seen from a page."""
    scheme, net, path = _part(page, 1), _part(page, 2), _part(page, 3)
    origin, folder = F.concat(scheme, F.lit("://"), net), F.regexp_replace(path, "[^/]*$", "")
    return (
        F.when(href.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), href).when(href.startswith("//"), F.concat(scheme, F.lit(":"), href)).when(href.startswith("/"), F.concat(origin, href))
        .when(href.startswith("?"), F.concat(origin, path, href)).when(href.startswith("#"), F.concat(F.regexp_replace(page, "#.*$", ""), href))
        .otherwise(F.concat(origin, F.when(folder == "", "/").otherwise(folder), href))
    )


def safe_http(url: Column) -> Column:
    """the trimmed address if it is http(s), has a host and no control character; else null."""
    s = F.trim(url)
    return F.when(s.rlike("^(?i)https?://") & ~s.rlike("[\\x00-\\x1F\\x7F]") & (host(s) != ""), s)
