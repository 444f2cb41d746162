"""Text functions of posts, as Column to Column."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Python has it, which Java's \\s lacks in part.
SPACE = "[\\t-\\r\\x1C-\\x20\\x85\\xA0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000]"
_CONTROL = "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]"


def let(x: Column, rule: Callable[[Column], Column]) -> Column:
    """A rule over a value that is made once, however often the rule has it."""
    return F.get(F.transform(F.array(x), rule), F.lit(0))


def squeeze(x: Column) -> Column:
    """White space collapsed to single spaces, none at the ends."""
    return F.trim(F.regexp_replace(x, f"{SPACE}+", " "))


def clean_text(x: Column) -> Column:
    """One-spaced, without control characters, null if nothing is left."""
    return F.nullif(F.trim(F.regexp_replace(squeeze(x), _CONTROL, "")), F.lit(""))


def _none(x: Column) -> Column:
    return F.coalesce(x, F.array().cast("array<string>"))


def hashtags(text: Column) -> Column:
    """#tags in order, each once; [] for null."""
    return _none(F.array_distinct(F.regexp_extract_all(text, F.lit("#[A-Za-z0-9_\\u0080-\\uFFFF]+"), F.lit(0))))


def mentions(text: Column) -> Column:
    """@names in order without closing punctuation, each once."""
    found = F.regexp_extract_all(text, F.lit("@[A-Za-z0-9_.\\-\\u0080-\\uFFFF]+"), F.lit(0))
    return _none(F.array_distinct(F.transform(found, lambda m: F.regexp_replace(m, "[.,;:!?]+$", ""))))


def unique(items: Column) -> Column:
    """Each item once, in order, without null and empty ones; [] for null."""
    return _none(F.array_distinct(F.filter(items, lambda x: x.isNotNull() & (x != ""))))


def decode_json_text(x: Column) -> Column:
    """The text of a JSON string's inside, trimmed, null if empty. Lone halves of pairs become U+FFFD."""
    repaired = F.regexp_replace(x, "(?i)(\\\\ud[89ab][0-9a-f]{2})(?!\\\\ud[c-f][0-9a-f]{2})", "\\\\ufffd")
    repaired = F.regexp_replace(repaired, "(?i)(?<!\\\\ud[89ab][0-9a-f]{2})\\\\ud[c-f][0-9a-f]{2}", "\\\\ufffd")
    got = F.from_json(F.concat(F.lit('{"x":"'), repaired, F.lit('"}')), "x string")["x"]
    return F.nullif(F.trim(F.coalesce(got, x)), F.lit(""))


def page_name(x: Column, site: str) -> Column:
    """A page title without the site's name at its end."""
    return F.nullif(F.trim(F.regexp_replace(squeeze(x), f"{SPACE}+[|\\-\\u2013]{SPACE}+{site}{SPACE}*$", "")), F.lit(""))


#: Phrases that page furniture puts around a post's text.
FURNITURE = ("Verified account", "Shared with Public", "Instagram")


def dom_text(x: Column) -> Column:
    """C11: text of a container without page furniture, one-spaced, in lower case."""
    for phrase in FURNITURE:
        x = F.replace(x, F.lit(phrase), F.lit(""))
    return F.lower(squeeze(x))


def path_family(path: Column) -> Column:
    """A path with its ids made placeholders."""
    x = F.regexp_replace(path, "\\b[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\\b", "{uuid}")
    return F.regexp_replace(x, "/[0-9]+", "/{id}")


def joined(items: Column) -> Column:
    """M1: items between bars, null ones empty."""
    return F.array_join(items, "|", "")


def as_json(items: Column) -> Column:
    """M2: a list as a JSON string."""
    return F.to_json(items)
