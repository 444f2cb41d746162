"""Numbers that pages show to readers, as Column to Column."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from postloom.functions.text import squeeze

_SCALED = "(?i)(?<![0-9.])([0-9][0-9.,]*)\\s*([km])\\b"
_PLAIN = "(?<![0-9.])([0-9][0-9.,]*)\\b"


def parse_count(x: Column) -> Column:
    """The first number with k or m, else the first number; null if there is none or it is malformed.

    The product is made in doubles and cut, as the rule has it (1.001K is 1000).
    """
    s = squeeze(x)
    scaled, unit, plain = F.regexp_extract(s, _SCALED, 1), F.lower(F.regexp_extract(s, _SCALED, 2)), F.regexp_extract(s, _PLAIN, 1)
    number = lambda t: F.replace(t, F.lit(","), F.lit("")).try_cast("double")
    times = F.when(unit == "k", 1000.0).when(unit == "m", 1_000_000.0).otherwise(1.0)
    return F.when(scaled != "", number(scaled) * times).when(plain != "", number(plain)).try_cast("bigint")


def count_near(text: Column, keywords: tuple[str, ...]) -> Column:
    """The count within 12 characters of the first keyword, and of its first place, that gives one."""

    def of(word: str) -> Column:
        gaps = F.split(text, f"(?i){word}", -1)
        ends = F.transform(F.sequence(F.lit(1), F.greatest(F.size(gaps) - 1, F.lit(1))), lambda i: F.length(F.array_join(F.slice(gaps, 1, i), "")) + (i - 1) * len(word))
        spots = F.when(F.size(gaps) > 1, ends)
        windows = F.transform(spots, lambda p: F.substring(text, F.greatest(p - 12, F.lit(0)) + 1, F.least(p, F.lit(12)) + len(word) + 12))
        return F.get(F.filter(F.transform(windows, parse_count), lambda c: c.isNotNull()), F.lit(0))

    return F.coalesce(*[of(w) for w in keywords])


def int_or_none(x: Column) -> Column:
    """A whole number from text, null for anything else."""
    return F.trim(x.cast("string")).try_cast("bigint")


def reactions_total(reactions: Column, parts: list[Column]) -> Column:
    """The stated total, else the sum of the parts if there is any."""
    return F.coalesce(reactions, F.nullif(reduce(lambda a, b: a + b, [F.coalesce(p, F.lit(0)) for p in parts]), F.lit(0)))


def usage_tone(current: Column, most: Column) -> Column:
    """How much of an allowance is left."""
    left = F.greatest(F.lit(0), most - current)
    return F.when(most.isNull(), "unbounded").when(left == 0, "exhausted").when(left * 2 >= most, "healthy").otherwise("warning")


def progress(done: Column, total: Column) -> Column:
    """A share between 0 and 1, null without a total."""
    return F.when(total > 0, F.least(F.greatest(done / total, F.lit(0.0)), F.lit(1.0)))
