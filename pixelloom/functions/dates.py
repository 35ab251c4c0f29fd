"""Date texts of a catalogue: they stay text, since some of them name no real instant."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pixelloom.functions.paths import stem

#: A year of 1970 to 2099, month and day, separated (by any of - _ . /, not necessarily alike) or
#: all compact, and perhaps a compact time after one separator; no word boundary is asked for.
FILENAME_DATE = (
    r"(19[7-9][0-9]|20[0-9]{2})(?:[-_./](0[1-9]|1[0-2])[-_./](0[1-9]|[12][0-9]|3[01])|(0[1-9]|1[0-2])(0[1-9]|[12][0-9]|3[01]))"
    r"(?:[ Tt_-]?([01][0-9]|2[0-3])([0-5][0-9])([0-5][0-9]))?"
)
EXIF_DATE = r"^([0-9]+)[:/-]([0-9]+)[:/-]([0-9]+)(?: (.*))?$"


def _div(x: Column, n: int) -> Column:
    """Whole quotient, rounded down, of bigints."""
    return F.call_function("div", x - F.pmod(x, F.lit(n).cast("bigint")), F.lit(n).cast("bigint"))


def unix_to_iso(seconds: Column) -> Column:
    """Seconds since 1970 (negative ones too) as ``YYYY-MM-DDTHH:MM:SSZ``; NULL stays NULL.  Counts
    beyond what a timestamp holds come out as the far years that they are."""

    bind = lambda x, body: F.get(F.transform(F.array(x), body), F.lit(0))  # noqa: E731 - x once a row

    def date(z: Column) -> Column:
        # Days counted from a 1st of March, so that a leap day ends its year.
        era, of_era = _div(z, 146_097), F.pmod(z, F.lit(146_097).cast("bigint"))

        def in_year(n: Column) -> Column:
            day = n[0] - (365 * n[1] + _div(n[1], 4) - _div(n[1], 100))
            return bind(F.array(day, _div(5 * day + 2, 153), n[1]), lambda v: written(v[0], v[1], v[2]))

        def written(day: Column, month: Column, year: Column) -> Column:
            m = month + F.when(month < 10, 3).otherwise(-9)
            return F.format_string("%04d-%02d-%02d", year + era * 400 + F.when(m <= 2, 1).otherwise(0), m, day - _div(153 * month + 2, 5) + 1)

        year = bind(of_era, lambda n: F.array(n, _div(n - _div(n, 1_460) + _div(n, 36_524) - _div(n, 146_096), 365)))
        return bind(year, in_year)

    def text(s: Column) -> Column:
        t = F.pmod(s, F.lit(86_400).cast("bigint"))
        return F.concat(bind(_div(s, 86_400) + 719_468, date), F.format_string("T%02d:%02d:%02dZ", _div(t, 3_600), _div(t, 60) % 60, t % 60))

    s = seconds.cast("bigint")
    return F.when(s.isNotNull(), text(s))


def stripped(text: Column) -> Column:
    """Text without white space of any kind at its ends."""
    return F.regexp_replace(text, r"^\p{IsWhite_Space}+|\p{IsWhite_Space}+$", "")


def normalize_exif(value: Column) -> Column:
    """EXIF date text as ISO: the date part checked for month and day range and padded, the time part
    passed through as it is.  NULL for a missing or malformed date, a year of 0, or no time part."""
    text = stripped(value)
    y, m, d = (F.regexp_extract(text, EXIF_DATE, i).try_cast("int") for i in (1, 2, 3))
    time = stripped(F.regexp_extract(text, EXIF_DATE, 4))
    ok = text.rlike(EXIF_DATE) & (y != 0) & m.between(1, 12) & d.between(1, 31) & (time != "")
    return F.when(ok, F.concat(F.format_string("%04d-%02d-%02d", y, m, d), F.lit("T"), time))


def filename_date(name: Column) -> Column:
    """The leftmost date in a name as ISO text, at midnight if no time follows; NULL without one."""
    g = lambda i: F.regexp_extract(name, FILENAME_DATE, i)
    part = lambda i: F.when(g(i) == "", "00").otherwise(g(i))
    text = F.concat(g(1), F.lit("-"), g(2), g(4), F.lit("-"), g(3), g(5), F.lit("T"), part(6), F.lit(":"), part(7), F.lit(":"), part(8))
    return F.when(name.rlike(FILENAME_DATE), text)


def resolve_date(original: Column, created: Column, sidecar: Column, path: Column, mtime: Column) -> tuple[Column, Column]:
    """(date, source): the first there is of both EXIF dates, the sidecar's, the file name's and mtime."""
    named = filename_date(stem(path))
    date = F.coalesce(original, created, sidecar, named, unix_to_iso(mtime))
    source = F.when(original.isNotNull() | created.isNotNull(), "exif").when(sidecar.isNotNull(), "sidecar").when(named.isNotNull(), "filename").otherwise("mtime")
    return date, source


def month_folder(date: Column) -> Column:
    r"""``YYYY\MM`` of an ISO date text of at least seven characters, else ``undated``."""
    iso = (F.length(date) >= 7) & (F.substring(date, 5, 1) == "-")
    return F.when(F.coalesce(iso, F.lit(False)), F.concat(F.substring(date, 1, 4), F.lit("\\"), F.substring(date, 6, 2))).otherwise("undated")


def local_display(seconds: Column) -> Column:
    """Epoch seconds for display in the session's zone; a dash for 0 and for NULL."""
    return F.when(F.coalesce(seconds, F.lit(0)) == 0, "—").otherwise(F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd HH:mm:ss"))
