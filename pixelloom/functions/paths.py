"""Expressions on catalogue paths.  Paths are data with Windows habits: ``/`` and ``\\`` separate
alike and ASCII letters compare in either case; nothing here asks the running system."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(c: Column) -> Column:
    """Lower case of A to Z only; ``lower`` would also fold letters such as the Kelvin sign."""
    return F.translate(c, UPPER, LOWER)


def backslashed(c: Column) -> Column:
    return F.translate(c, "/", "\\")


def trimmed(c: Column) -> Column:
    """With backslashes and without trailing ones."""
    return F.rtrim(backslashed(c), F.lit("\\"))


def folded(c: Column) -> Column:
    """The form in which two paths compare."""
    return ascii_lower(trimmed(c))


def file_name(c: Column) -> Column:
    return F.element_at(F.split(backslashed(c), "\\\\"), -1)


def parent(c: Column) -> Column:
    """All before the last separator; an empty string if there is none."""
    return F.regexp_extract(backslashed(c), r"^(.*)\\[^\\]*$", 1)


def extension(c: Column) -> Column:
    """Without its dot; empty if there is none or the name is nothing but ``.name``."""
    return F.regexp_extract(c, r"[^\\/]\.([^.\\/]*)$", 1)


def stem(c: Column) -> Column:
    """The file name without its extension; a leading dot belongs to the stem."""
    return F.regexp_replace(file_name(c), r"^(.+)\.[^.]*$", "$1")


def components(c: Column) -> Column:
    return F.filter(F.split(backslashed(c), "\\\\"), lambda s: s != "")


def ancestors(c: Column) -> Column:
    """Folded prefixes of a path, one per component and the shortest first; the last is the path."""
    # The components are bound to a lambda's variable, so that they are split once and not for each
    # prefix.  Joining slices is quadratic in the depth, which is small.
    prefixes = lambda parts: F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts), F.lit(1))), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "\\"))
    every = F.flatten(F.transform(F.array(components(folded(c))), prefixes))
    return F.filter(every, lambda p: p != "")


def is_under(path: Column, root: Column) -> Column:
    """Whether a path is a root or lies below it, whole folder names compared.  An empty root holds
    every path that starts with a separator.  NULL if either is."""
    p, r = ascii_lower(backslashed(path)), folded(root)
    return (p == r) | p.startswith(F.concat(r, F.lit("\\")))
