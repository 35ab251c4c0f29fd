"""Expressions on numbers, codes and small texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def arrow_udf(run: Callable, kind: str) -> Callable[..., Column]:
    """A function on pandas batches as a column function.  It is made when it is used: a type's text
    can only be read once there is a session, and modules are imported before."""
    return F.pandas_udf(run, kind)


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two 64-bit codes."""
    return F.bit_count(a.bitwiseXOR(b))


def fold_gradient(grid: Column) -> Column:
    """The 64-bit difference hash of a grid of 8 rows of 9 grey values, row by row, highest bit first:
    a bit is set where a value is greater than the one right of it.  NULL unless there are 72."""
    bit = lambda i: F.when(F.get(grid, F.floor(i / 8).cast("int") * 9 + i % 8) > F.get(grid, F.floor(i / 8).cast("int") * 9 + i % 8 + 1), F.lit(1).cast("bigint")).otherwise(F.lit(0).cast("bigint"))
    return F.when(F.size(grid) == 72, F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("bigint"), lambda acc, i: F.shiftleft(acc, 1).bitwiseOR(bit(i))))


def gps_degrees(d: Column, m: Column, s: Column, ref: Column) -> Column:
    """Signed degrees of three parts; negative for a reference of S or W in either case."""
    return (d + m / 60 + s / 3600) * F.when(F.upper(ref).isin("S", "W"), -1.0).otherwise(1.0)


def geo_pair(lat: Column, lon: Column) -> tuple[Column, Column]:
    """A sidecar's location: a missing half counts as 0, and 0, 0 is no location."""
    la, lo = F.coalesce(lat, F.lit(0.0)), F.coalesce(lon, F.lit(0.0))
    none = (la == 0) & (lo == 0)
    return F.when(~none, la), F.when(~none, lo)


def parse_int(text: Column) -> Column:
    """A whole decimal text as bigint; NULL for anything else, white space included."""
    return F.when(text.rlike(r"^[+-]?[0-9]+$"), text.try_cast("bigint"))


def human_bytes(n: Column) -> Column:
    """Above a MiB with one decimal, above a KiB without, else bytes."""
    return F.when(n > 1_048_576, F.format_string("%.1f MB", n / 1_048_576)).when(n > 1_024, F.format_string("%.0f KB", n / 1_024)).otherwise(F.concat(n.cast("string"), F.lit(" B")))


def megabytes(n: Column) -> Column:
    return F.format_string("%.1f MB", n / 1_048_576)


def clamp_edge(n: Column) -> Column:
    """A thumbnail's edge, from 64 to 1024."""
    return F.greatest(F.lit(64), F.least(F.lit(1024), n))


def data_url(image: Column) -> Column:
    """A JPEG as a data URL, without the line breaks that Spark's ``base64`` may insert."""
    return F.concat(F.lit("data:image/jpeg;base64,"), F.regexp_replace(F.base64(image), "[\r\n]", ""))


def decided_label(label: Column, flip: bool) -> Column:
    """What a review key makes of a label: keep, or turn round; an undecided one becomes photo."""
    return F.when(label == ("photo" if flip else "non_photo"), "non_photo").otherwise("photo")
