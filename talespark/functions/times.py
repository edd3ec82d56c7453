"""ISO 8601 times as column expressions, in all forms: extended and basic dates, week
dates, any one character between date and time, times down to hours, fractions behind a
point or comma, and offsets down to seconds.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from talespark.functions.basic import let

_DATES = (
    r"(?<y1>\d{4})-(?<m1>\d{2})-(?<d1>\d{2})",
    r"(?<y2>\d{4})(?<m2>\d{2})(?<d2>\d{2})",
    r"(?<y3>\d{4})-W(?<w3>\d{2})(?:-(?<e3>\d)(?!\d))?",
    # digits behind a basic week date: an odd number of three or more belongs to what follows
    r"(?<y4>\d{4})W(?<w4>\d{2})(?:(?<e4>\d)(?=(?:\d(?:\d\d)*)?(?!\d))|(?=(?:\d{3}(?:\d\d)*)?(?!\d)))",
)


def _clock(p: str) -> str:
    """Hours, or with minutes, or with seconds; colons in all places or none. A fraction may
    stand behind any of them, counts as one of a second, and may lack its digits."""
    return rf"(?:(?<{p}ha>\d\d)(?::(?<{p}ma>\d\d)(?::(?<{p}sa>\d\d))?)?(?:[.,](?<{p}fa>\d*))?|(?<{p}hb>\d\d)(?<{p}mb>\d\d)(?<{p}sb>\d\d)?(?:[.,](?<{p}fb>\d*))?)"


_GROUPS = ["y1", "m1", "d1", "y2", "m2", "d2", "y3", "w3", "e3", "y4", "w4", "e4", *(f"{p}{x}{k}" for p in "t" for k in "ab" for x in "hmsf"), "sign", *(f"{p}{x}{k}" for p in "z" for k in "ab" for x in "hmsf")]
_AT = {name: i for i, name in enumerate(_GROUPS, 1)}
_NAMED = rf"(?s)\A(?:{'|'.join(_DATES)})(?:.{_clock('t')}(?:(?<sign>[+-]){_clock('z')})?)?\z"


def _numbered(pattern: str) -> str:
    """The same pattern with plain groups; they stand in the order of ``_GROUPS``."""
    for name in _GROUPS:
        pattern = pattern.replace(f"(?<{name}>", "(")
    return pattern


PATTERN = _numbered(_NAMED)


def _read(c: Column, value: Callable[[Column, Column, Column], Column]) -> Column:
    """``value`` of (seconds since 1970 as if at offset 0, the offset's seconds or null, the
    date) of a valid text, else null. The pattern is matched once."""
    text = F.replace(c, F.lit("Z"), F.lit("+00:00"))
    fields = F.when(text.rlike(PATTERN), F.split(F.regexp_replace(text, PATTERN, "|".join(f"${i}" for i in _AT.values())), "[|]", -1))

    def parse(p: Column) -> Column:
        got = lambda name: F.nullif(F.get(p, F.lit(_AT[name] - 1)), F.lit(""))
        num = lambda *names: F.coalesce(*(got(n) for n in names), F.lit("0")).cast("int")
        micros = lambda *names: F.rpad(F.substring(F.coalesce(*(got(n) for n in names), F.lit("0")), 1, 6), 6, "0").cast("int") / F.lit(1_000_000)
        year = F.coalesce(*(got(f"y{i}") for i in "1234"))
        day = lambda *parts: F.try_to_date(F.concat_ws("-", *parts), "yyyy-MM-dd")
        plain = day(year, F.coalesce(got("m1"), got("m2")), F.coalesce(got("d1"), got("d2")))
        week, weekday = num("w3", "w4"), F.coalesce(got("e3"), got("e4"), F.lit("1")).cast("int")
        fourth = day(year, F.lit("01"), F.lit("04"))  # always in week 1
        monday = F.date_add(F.date_sub(fourth, F.weekday(fourth)), (week - 1) * 7)
        # a week is one of the year that its Thursday is in
        week_ok = week.between(1, 53) & weekday.between(1, 7) & (F.year(F.date_add(monday, 3)) == year.cast("int"))
        date = F.when(F.coalesce(got("w3"), got("w4")).isNotNull(), F.when(week_ok, F.date_add(monday, weekday - 1))).otherwise(plain)
        h, m, s = num("tha", "thb"), num("tma", "tmb"), num("tsa", "tsb")
        seconds = F.datediff(date, F.lit("1970-01-01").cast("date")).cast("long") * 86400 + h * 3600 + m * 60 + s + micros("tfa", "tfb")
        size = num("zha", "zhb") * 3600 + num("zma", "zmb") * 60 + num("zsa", "zsb") + micros("zfa", "zfb")
        offset = F.when(got("sign") == "-", -size).when(got("sign") == "+", size)
        valid = (year != "0000") & date.isNotNull() & (h < 24) & (m < 60) & (s < 60) & (size < 86400)
        return F.when(valid, value(seconds, offset, date))

    return let(fields, parse)


def epoch_of(c: Column) -> Column:
    """Seconds of a time that names its zone; null for null, times without a zone and all
    other texts. Digits of a fraction beyond six are dropped."""
    return _read(c, lambda seconds, offset, _: seconds - offset)


def event_epoch(c: Column) -> Column:
    """Seconds of a time or date between white space; without a zone it is read in the
    session's zone (``spark.sql.session.timeZone``). Null for null and for other texts."""
    naive = lambda s: F.unix_micros(F.to_utc_timestamp(F.timestamp_micros(F.round(s * 1_000_000).cast("long")), F.current_timezone())) / F.lit(1_000_000)
    return _read(c, lambda seconds, offset, _: F.coalesce(seconds - offset, naive(seconds)))
