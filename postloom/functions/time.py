"""Dates and times, as Column to Column. The session's time zone is UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from postloom.functions.text import let, squeeze


def iso(ts: Column) -> Column:
    """C4: ISO text with Z; six digits of a second only where there are microseconds."""
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    return F.when(F.date_format(ts, "SSSSSS") == "000000", F.concat(whole, F.lit("Z"))).otherwise(F.concat(whole, F.lit("."), F.date_format(ts, "SSSSSS"), F.lit("Z")))


def iso_and_epoch(ts: Column) -> tuple[Column, Column]:
    """ISO text with +00:00, and the epoch's seconds."""
    return F.regexp_replace(iso(ts), "Z$", "+00:00"), F.unix_seconds(ts)


def parse_iso(x: Column) -> Column:
    """A timestamp from ISO text, UTC if it names no zone; null if it can't be read."""
    s = F.trim(x)
    dated = s.rlike("^\\d{4}-\\d{2}-\\d{2}([T ]\\d{2}:\\d{2}(:\\d{2}(\\.\\d{1,6})?)?(Z|[+-]\\d{2}:?\\d{2})?)?$")
    return F.when(dated, F.try_to_timestamp(s))


#: Seconds of the units of relative times.
UNITS = {
    "s": 1, "sec": 1, "second": 1, "m": 60, "min": 60, "minute": 60, "h": 3600, "hr": 3600, "hour": 3600, "d": 86400, "day": 86400,
    "w": 604800, "wk": 604800, "week": 604800, "mo": 2592000, "mon": 2592000, "month": 2592000, "y": 31536000, "yr": 31536000, "year": 31536000,
}
NOW_WORDS = ("just now", "now", "just posted", "recently", "just shared")
#: Absolute forms, in the order in which they are tried: pattern of the text, format, whether it has a year.
_CLOCK12, _CLOCK24 = "\\d{1,2}:\\d{2} [ap]m", "\\d{1,2}:\\d{2}"
_FORMS = (
    (f"[a-z]+ \\d{{1,2}}, \\d{{4}} at {_CLOCK12}", "{M} d, y 'at' h:m a", True),
    (f"[a-z]+ \\d{{1,2}}, \\d{{4}} at {_CLOCK24}", "{M} d, y 'at' H:m", True),
    (f"[a-z]+ \\d{{1,2}} at {_CLOCK12}", "{M} d 'at' h:m a", False),
    ("[a-z]+ \\d{1,2}, \\d{4}", "{M} d, y", True),
    (f"\\d{{1,2}} [a-z]+ \\d{{4}} at {_CLOCK24}", "d {M} y 'at' H:m", True),
    (f"\\d{{1,2}} [a-z]+ at {_CLOCK24}", "d {M} 'at' H:m", False),
    (f"\\d{{1,2}} [a-z]+ at {_CLOCK12}", "d {M} 'at' h:m a", False),
    ("\\d{1,2} [a-z]+ \\d{4}", "d {M} y", True),
    ("\\d{1,2} [a-z]+", "d {M}", False),
)


def absolute(x: Column, as_of: Column) -> Column:
    """A timestamp from the forms of dates; forms without a year take this year, or the last if that is over a day ahead."""

    def spelled(s: Column) -> Column:
        """The text as it is, in lower case, and with the capitals that the formats want."""
        tidy = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.initcap(F.lower(s)), " At ", " at "), " Am$", " AM"), " Pm$", " PM")
        return F.struct(s.alias("s"), F.lower(s).alias("low"), tidy.alias("tidy"))

    return let(let(F.trim(x), spelled), lambda t: _absolute(t["s"], t["low"], t["tidy"], as_of))


def _absolute(s: Column, low: Column, tidy: Column, as_of: Column) -> Column:
    def read(form: str, has_year: bool) -> Column:
        def one(month: str, year: Column | None) -> Column:
            fmt = form.replace("{M}", month)
            return F.try_to_timestamp(tidy, F.lit(fmt)) if year is None else F.try_to_timestamp(F.concat(year.cast("string"), F.lit(" "), tidy), F.lit(f"y {fmt}"))

        names = ("MMMM", "MMM")
        if has_year:
            return F.coalesce(*[one(m, None) for m in names])
        this = F.coalesce(*[one(m, F.year(as_of)) for m in names])
        last = F.coalesce(*[one(m, F.year(as_of) - 1) for m in names])
        return F.when(this > as_of + F.expr("interval 1 day"), last).otherwise(this)

    out = F.lit(None).cast("timestamp")
    for pattern, form, has_year in reversed(_FORMS):
        out = F.when(low.rlike(f"^{pattern}$"), read(form, has_year)).otherwise(out)
    zoned = s.rlike("^\\d{4}-\\d{2}-\\d{2}([T ]\\d{2}:\\d{2}:\\d{2}|T\\d{2}:\\d{2}:\\d{2}(Z|[+-]\\d{2}:?\\d{2}))?$")
    return F.when(zoned, F.try_to_timestamp(s)).otherwise(out)


def relative(x: Column, as_of: Column) -> Column:
    """Now-words and "<n> <unit> [ago]"; null for anything else."""
    s = F.lower(squeeze(x))
    parts = "^([0-9]+)\\s*([a-z]+?)\\s*(?:ago)?$"
    amount, unit = F.regexp_extract(s, parts, 1).try_cast("bigint"), F.regexp_replace(F.regexp_extract(s, parts, 2), "s+$", "")
    seconds = F.lit(None).cast("bigint")
    for name, n in UNITS.items():
        seconds = F.when(unit == name, n).otherwise(seconds)
    ago = F.timestamp_seconds(F.unix_micros(as_of) / 1_000_000 - amount * seconds)
    return F.when(s.isin(*NOW_WORDS), as_of).when((amount > 0) & (amount < 100_000) & seconds.isNotNull(), ago)


def parse_timestamp(x: Column, as_of: Column) -> Column:
    """D3: now-words, epoch seconds, relative times, yesterday at a clock time, absolute forms; else null."""
    s = squeeze(x)
    epoch = F.when(F.length(s) <= 12, F.timestamp_seconds(s.try_cast("bigint")))
    clock = F.regexp_extract(F.lower(s), "^yesterday\\s+at\\s+(.+)$", 1)
    at = F.coalesce(F.try_to_timestamp(F.upper(clock), F.lit("h:m a")), F.try_to_timestamp(clock, F.lit("H:m")))
    yesterday = F.date_trunc("day", as_of) - F.expr("interval 1 day") + F.make_dt_interval(F.lit(0), F.hour(at), F.minute(at))
    return F.when(s.rlike("^[0-9]{9,13}$"), epoch).otherwise(F.coalesce(relative(x, as_of), F.when(clock != "", yesterday), absolute(s, as_of)))


def epoch_guess(n: Column) -> Column:
    """A timestamp from seconds, or from milliseconds if over 1e12."""
    return F.timestamp_micros(F.when(n > 1_000_000_000_000, n * 1000).otherwise(n * 1_000_000).cast("bigint"))


def preset_window(days: int, today: Column) -> tuple[Column, Column]:
    """First and last date of the last n days."""
    return F.date_sub(today, days), today
