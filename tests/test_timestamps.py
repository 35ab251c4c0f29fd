import re
from datetime import UTC, datetime, timedelta
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from pixelloom.operators import timestamps as T

VALUES = "id bigint, source string, value string, zone string, windows boolean, _all string, notation int"


def instant(spark, value, zone=None, windows=False):
    df = spark.createDataFrame([(1, "s", value, zone, windows, "x", 5)], VALUES)
    return T.normalise(df).first()["epoch_s"]


def utc(*a):
    return int(datetime(*a, tzinfo=UTC).timestamp())


CASES = [
    ("2015:10:03 02:47:08", "Europe/Berlin", utc(2015, 10, 3, 0, 47, 8)),
    ("2015-10-03T02:47:08Z", "Europe/Berlin", utc(2015, 10, 3, 2, 47, 8)),
    ("2015-10-03t02:47z", None, utc(2015, 10, 3, 2, 47)),
    ("2015-10-03 02:47:08,999+05:45", None, utc(2015, 10, 2, 21, 2, 8)),
    ("2015-10-03 02:47:08.5-0330", None, utc(2015, 10, 3, 6, 17, 8)),
    ("2015-10-03T02:47:08+02", None, utc(2015, 10, 3, 0, 47, 8)),
    ("2015-10-03T02:47:08+02:00[Europe/Berlin]", "Asia/Tokyo", utc(2015, 10, 3, 0, 47, 8)),
    ("2015-10-03T02:47:08[Asia/Tokyo]", "Europe/Berlin", utc(2015, 10, 2, 17, 47, 8)),
    ("13.02.2011 10:54:28", "Etc/UTC", utc(2011, 2, 13, 10, 54, 28)),
    ("Sat, 03 Oct 2015 02:47:08 +0200", None, utc(2015, 10, 3, 0, 47, 8)),
    ("02-JAN-2010 17:36:09", "Etc/UTC", utc(2010, 1, 2, 17, 36, 9)),
    ("December 16, 2009 1:36:16 AM", "Etc/UTC", utc(2009, 12, 16, 1, 36, 16)),
    ("Apr 11, 2014, 12:23:54\u202fAM UTC", None, utc(2014, 4, 11, 0, 23, 54)),
    ("2008:01:09 12:21:22 PM", "Etc/UTC", utc(2008, 1, 9, 12, 21, 22)),
    ("20080109_192122", "Etc/UTC", utc(2008, 1, 9, 19, 21, 22)),
    ("20080109T192122Z", None, utc(2008, 1, 9, 19, 21, 22)),
    ("20080109192122", "Etc/UTC", utc(2008, 1, 9, 19, 21, 22)),
    ("\x002015:10:03 02:47:08\x00 ", "Etc/UTC", utc(2015, 10, 3, 2, 47, 8)),
    ("1443840428", None, 1443840428),
    ("1443840428.999", None, 1443840428),
    ("1443840428123", None, 1443840428),
    # a wall time that occurs twice, and one that was skipped
    ("2015:10:25 02:30:00", "Europe/Berlin", utc(2015, 10, 25, 0, 30)),
    ("2015:03:29 02:30:00", "Europe/Berlin", utc(2015, 3, 29, 1, 30)),
    ("2015:04:05 01:45:00", "Australia/Lord_Howe", utc(2015, 4, 4, 14, 45)),
    # no instant
    ("2015:10:03 02:47:08", None, None),
    ("2015-02-29T10:00:00Z", None, None),
    ("2015-04-31 10:00:00Z", None, None),
    ("2015-10-03T24:00:00Z", None, None),
    ("2015-10-03T13:00:00 PM", "Etc/UTC", None),
    ("2015-10-03", "Etc/UTC", None),
    ("2015-10", "Etc/UTC", None),
    ("0000:00:00 00:00:00", "Etc/UTC", None),
    ("2007-12-31T23:59:59Z", None, None),
    ("2026-01-01T00:00:00Z", None, None),
    ("2025-12-31T23:59:59.999Z", None, utc(2025, 12, 31, 23, 59, 59)),
    ("", "Etc/UTC", None),
    ("   ", "Etc/UTC", None),
    ("unknown", "Etc/UTC", None),
    ("9" * 400, "Etc/UTC", None),
    (None, "Etc/UTC", None),
]


def test_known_values(spark):
    df = spark.createDataFrame([(i, "s", v, z, False, None, None) for i, (v, z, _) in enumerate(CASES)], VALUES)
    got = {r["id"]: r["epoch_s"] for r in T.normalise(df).collect()}
    assert [(v, z, got[i]) for i, (v, z, _) in enumerate(CASES)] == CASES


@pytest.mark.parametrize("pad", [" " * 300, "\0" * 300, "\t \u3000\0" * 100])
def test_padding_counts_for_nothing(spark, pad):
    for value in (pad + "2015-10-03 02:47:08", "2015-10-03 02:47:08" + pad, "2015-10-03" + pad + "02:47:08"):
        assert instant(spark, value, "Etc/UTC") == utc(2015, 10, 3, 2, 47, 8)
    assert instant(spark, "2015-10-03 02:47:08" + pad + "x" * 300, "Etc/UTC") is None


@pytest.mark.parametrize(("value", "want"), [("1443840428123456", 1443840428), ("1443840428123456789", 1443840428), (str((1443840428 + 11644473600) * 10**7 + 3), 1443840428), ("-1", None), ("0", None), ("4102445000", None)])
def test_counts(spark, value, want):
    assert instant(spark, value, windows=True) == want


def test_mixture_decides_by_source(spark):
    rows = [(i, "de", "25/12/2015 10:00:00", "Etc/UTC") for i in range(20)] + [(i, "us", "12/25/2015 10:00:00", "Etc/UTC") for i in range(20, 40)]
    rows += [(100, "de", "03/04/2015 10:00:00", "Etc/UTC"), (101, "us", "03/04/2015 10:00:00", "Etc/UTC"), (102, "none", "03/04/2015 10:00:00", "Etc/UTC"), (103, "none", "04/04/2015 10:00:00", "Etc/UTC")]
    df = spark.createDataFrame(rows, "id bigint, source string, value string, zone string").withColumn("windows", F.lit(False))
    got = {r["id"]: r for r in T.normalise(df).collect()}
    assert got[100]["epoch_s"] == utc(2015, 4, 3, 10) and got[101]["epoch_s"] == utc(2015, 3, 4, 10)
    assert got[102]["epoch_s"] is None and got[102]["ambiguous"]
    assert got[103]["epoch_s"] == utc(2015, 4, 4, 10) and not got[103]["ambiguous"]  # both readings agree


def tables(spark, files):
    roots = spark.createDataFrame([(1, r"D:\Photos"), (2, r"D:\Photos\Over seas" + "\\"), (3, r"D:\None")], "id bigint, path string")
    zones = spark.createDataFrame([(1, "Europe/Berlin"), (2, "Asia/Tokyo")], "root_id bigint, tz string")
    df = spark.createDataFrame(files, "id bigint, path string, exif_datetime string, sidecar_taken_time string, mtime bigint, resolved_date string, zone string, source string")
    return df, roots, zones


def test_zone_is_that_of_the_innermost_root(spark):
    p = [r"d:/photos\a.jpg", r"D:\Photos2\a.jpg", r"D:\PHOTOS\over SEAS\x\a.jpg", r"D:\None\a.jpg", None, "D:/Photos"]
    df, roots, zones = tables(spark, [(i, x, "2015:07:01 12:00:00", "2015-07-01 12:00", None, "bad", "?", "?") for i, x in enumerate(p)])
    got = {(r["file_id"], r["field"]): r["epoch_s"] for r in T.catalogue_instants(df, roots, zones).collect()}
    noon = utc(2015, 7, 1, 12)
    assert {k: v for k, v in got.items() if k[1] == "exif_datetime"} == {(0, "exif_datetime"): noon - 7200, (2, "exif_datetime"): noon - 9 * 3600, (5, "exif_datetime"): noon - 7200}
    assert all(got[i, "sidecar_taken_time"] == noon for i in range(6))


def test_many_roots_are_joined_to_the_same_result(spark, monkeypatch):
    df, roots, zones = tables(spark, [(i, rf"D:\Photos\{x}\a{i}.jpg", "2015:07:01 12:00:00", None, 1443840428, None, "", "") for i, x in enumerate(["a", "Over Seas", "b"])])
    want = sorted(T.catalogue_instants(df, roots, zones).collect())
    monkeypatch.setattr(T, "MAX_LITERAL_ROOTS", 1)
    assert sorted(T.catalogue_instants(df, roots, zones).collect()) == want and len(want) == 6


def test_empty_tables(spark):
    df, roots, zones = tables(spark, [])
    assert T.catalogue_instants(df, roots, zones).count() == 0
    df, roots, zones = tables(spark, [(1, "D:\\Photos\\a", "2015:07:01 12:00:00", None, None, None, "", "")])
    assert T.catalogue_instants(df, roots.limit(0), zones).count() == 0


# An independent reader of the notations in the test tables, value by value.
MONTH = {m: i + 1 for i, m in enumerate("jan feb mar apr may jun jul aug sep oct nov dec".split())}


def brute(text, zone, windows):
    s = " ".join(text.replace("\0", " ").split())
    if re.fullmatch(r"\d+(\.\d+)?", s) and len(s.split(".")[0]) != 14:
        n = int(s.split(".")[0])
        for unit in (1, 10**3, 10**6, 10**9):
            if T.FIRST <= n // unit < T.LAST:
                return n // unit
        w = n // 10**7 - T.WINDOWS_TO_UNIX_S
        return w if windows and T.FIRST <= w < T.LAST else None
    s = re.sub(r"\[.*\]$", "", re.sub(r"^[A-Z][a-z]{2}, ", "", s))
    offset = None
    if m := re.search(r" ?(?:Z|z|UTC|GMT)$", s):
        offset, s = timedelta(0), s[: m.start()]
    elif (m := re.search(r" ?([+-])(\d\d):?(\d\d)?$", s)) and ":" in s[: m.start()] + "x" and len(s[: m.start()]) > 12:
        offset, s = timedelta(hours=int(m[2]), minutes=int(m[3] or 0)) * (-1 if m[1] == "-" else 1), s[: m.start()]
    half = re.search(r" ([AP])M$", s)
    s = s[: half.start()] if half else s
    s = re.sub(r"[.,]\d+$", "", s) if s.count(":") >= 2 else s
    n = re.findall(r"\d+", s)
    if m := re.fullmatch(r"(\d{4})(\d\d)(\d\d)[T_]?(\d\d)(\d\d)(\d\d)", s):
        f = [*map(int, m.groups())]
    elif m := re.search(r"[A-Za-z]{3,}", s):
        word = MONTH.get(m[0][:3].lower())
        if not word or len(n) < 4:
            return None
        d, y = (int(n[0]), int(n[1]))
        f = [y, word, d, *map(int, n[2:])]
    elif len(n) >= 5:
        f = [*map(int, n)] if len(n[0]) == 4 else [int(n[2]), int(n[1]), int(n[0]), *map(int, n[3:])]
    else:
        return None
    if half:
        if not 1 <= f[3] <= 12:
            return None
        f[3] = f[3] % 12 + (12 if half[1] == "P" else 0)
    try:
        wall = datetime(*f)
    except (ValueError, TypeError):
        return None
    if offset is None and zone is None:
        return None
    at = (wall - offset).replace(tzinfo=UTC) if offset is not None else wall.replace(tzinfo=ZoneInfo(zone))
    e = int(at.timestamp())
    return e if T.FIRST <= e < T.LAST else None


def test_whole_table_against_brute_force(spark, sf):
    R = lambda n: spark.read.parquet(f"{sf}/{n}.parquet")
    values = T.catalogue_values(R("files"), R("scan_roots"), R("root_zones"))
    want = set()
    for r in values.collect():
        e = brute(r["value"], r["zone"], r["windows"])
        if e is not None:
            want.add((r["id"], r["source"], e))
    got = {tuple(r) for r in T.catalogue_instants(R("files"), R("scan_roots"), R("root_zones")).collect()}
    assert got == want and len(want) > 500


def test_repeated_and_skipped_wall_times_are_marked(spark):
    rows = [("2015-10-25 02:30", "Europe/Berlin", "repeated"), ("2015-03-29 02:30", "Europe/Berlin", "skipped"), ("2015-10-25 03:30", "Europe/Berlin", None), ("2015-04-05 01:45", "Australia/Lord_Howe", "repeated"), ("2015-10-25 02:30+01:00", "Europe/Berlin", None), ("1443840428", "Europe/Berlin", None), ("2012-04-01 02:30", "Etc/UTC", None)]
    df = spark.createDataFrame([(i, "s", v, z, False, None, None) for i, (v, z, _) in enumerate(rows)], VALUES)
    assert [r["fold"] for r in T.normalise(df).orderBy("id").collect()] == [f for *_, f in rows]
