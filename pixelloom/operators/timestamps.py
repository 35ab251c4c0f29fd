"""Mixed timestamp notations, precisions and time zones, brought to one instant in UTC.

A value is read by every notation that fits it; each valid reading is a candidate.  Values with
one candidate are evidence for how often a source uses that notation; expectation-maximisation
over those mixtures gives a value with several candidates the posterior of each.  The likeliest
reading is taken if its posterior reaches ``min_posterior``, otherwise the value is marked
ambiguous and keeps no instant.

All parsing is built from Spark expressions.  The mixture is fitted on counts by source and set of
candidates: their number is bounded by the notations below, not by the data.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelloom.functions.paths import ancestors, folded
from pixelloom.functions.skew import lookup
from pixelloom.session import Staging, seen_in, settings, staging

FIRST, LAST = 1_199_145_600, 1_767_225_600  # 2008-01-01 and 2026-01-01, in seconds since 1970
#: Roots up to this many go into the plan as a literal map; more are joined.
MAX_LITERAL_ROOTS = 500

#: Seconds from the Windows to the Unix epoch, and the English month names.
WINDOWS_TO_UNIX_S = 11_644_473_600
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
MONTH_WORD = "(?:jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sept?(?:ember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)"

#: White space of any kind and NUL, which camera software pads with.
BLANK = r"[\s\x00\u0085   -​    　﻿]+"
TIME = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,]\d+)?)?(?: ?([AaPp])\.?[Mm]\.?)?"
ZONE = r"(?: ?(Z|z|UTC|utc|GMT|gmt|UT)?(?:([+-])(\d{2})(?::?(\d{2})(?::?\d{2})?)?)?)(?: ?[\[(]([A-Za-z0-9_+/-]+)[\])])?"
WEEKDAY = r"(?:(?:mon|tues?|wed(?:nes)?|thu(?:rs)?|fri|sat(?:ur)?|sun)(?:day)?,? )?"

#: Notations of a date with a time: pattern, and the groups of year, month and day; time (four
#: groups) and zone (five) follow the third group.
WRITTEN = {
    "ymd": (rf"^(\d{{4}})([-:/.])(\d{{1,2}})\2(\d{{1,2}})(?:[Tt _]){TIME}{ZONE}$", (1, 3, 4), 5),
    "dmy": (rf"^(\d{{1,2}})([-/.])(\d{{1,2}})\2(\d{{4}})(?:[Tt]|,? ){TIME}{ZONE}$", (4, 3, 1), 5),
    "mdy": (rf"^(\d{{1,2}})([-/.])(\d{{1,2}})\2(\d{{4}})(?:[Tt]|,? ){TIME}{ZONE}$", (4, 1, 3), 5),
    "d_month_y": (rf"(?i)^{WEEKDAY}(\d{{1,2}})(?:st|nd|rd|th|\.)?[ -]({MONTH_WORD})\.?,?[ -](\d{{4}}),?(?: at)?(?:[T ]){TIME}{ZONE}$", (3, 2, 1), 4),
    "month_d_y": (rf"(?i)^{WEEKDAY}({MONTH_WORD})\.? (\d{{1,2}})(?:st|nd|rd|th)?,? (\d{{4}}),?(?: at)? {TIME}{ZONE}$", (3, 1, 2), 4),
    "compact": (r"^(\d{4})(\d{2})(\d{2})[Tt _-]?(\d{2})(\d{2})(?:(\d{2})(?:[.,]\d+)?)?()" + ZONE + "$", (1, 2, 3), 4),
}
#: What a match begins with once its groups are written out, and the type of readings.
MARK = "\x01"
READINGS = "array<struct<notation:string,epoch_s:bigint,fold:string>>"
#: Counts: units to the second and seconds from the count's epoch to 1970.
UNIX_COUNTS = {"unix_s": (1, 0), "unix_ms": (1_000, 0), "unix_us": (1_000_000, 0), "unix_ns": (1_000_000_000, 0)}
WINDOWS_COUNTS = {"windows_100ns": (10_000_000, WINDOWS_TO_UNIX_S)}


def _number(text: Column) -> Column:
    """An integer of a matched group of digits; 0 for an empty one, which is never cast: a cast that
    fails costs more than everything else."""
    return F.when(text != "", text.cast("bigint")).otherwise(F.lit(0).cast("bigint"))


def _days_since_1970(y: Column, m: Column, d: Column) -> Column:
    """Day number of a civil date of the Gregorian calendar, in integer arithmetic (years above 0)."""
    shifted = y - F.when(m <= 2, 1).otherwise(0)
    era_year = F.pmod(shifted, F.lit(400))
    era = F.floor(shifted / 400)
    day_of_year = F.floor((153 * (m + F.when(m > 2, -3).otherwise(9)) + 2) / 5) + d - 1
    return era * 146_097 + era_year * 365 + F.floor(era_year / 4) - F.floor(era_year / 100) + day_of_year - 719_468


def _month_length(y: Column, m: Column) -> Column:
    leap = ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)
    return F.when(m == 2, F.when(leap, 29).otherwise(28)).when(m.isin(4, 6, 9, 11), 30).otherwise(31)


def _month_number(word: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, MONTHS)), F.substring(F.lower(word), 1, 3))


def wall_to_epoch(wall_s: Column, zone: Column) -> Column:
    """Seconds since 1970 of a wall time (given as if it were UTC) in an IANA zone.  A wall time that
    occurs twice is the earlier instant; a skipped one is read with the offset before the change."""
    return F.unix_seconds(F.to_utc_timestamp(F.timestamp_seconds(wall_s), zone))


def _count(text: Column, units: int, shift: int) -> Column:
    # ``div`` is integral; a division in doubles would round the largest counts.
    return F.call_function("div", text, F.lit(units).cast("bigint")) - shift


def _in_years(epoch: Column) -> Column:
    return epoch.between(FIRST, LAST - 1)


def _fold(epoch: Column, wall: Column, zone: Column) -> Column:
    """'skipped' for a wall time that its zone's clocks never showed, 'repeated' for one that they
    showed twice (after a change by up to three hours), else NULL."""
    local = lambda e: F.unix_seconds(F.from_utc_timestamp(F.timestamp_seconds(e), zone))
    later = F.lit(False)
    for step in (1_800, 3_600, 7_200, 10_800):
        later = later | (local(epoch + step) == wall)
    return F.when(local(epoch) != wall, "skipped").when(later, "repeated")


def with_readings(values: DataFrame, folds: bool = False) -> DataFrame:
    """Adds ``_all``, every valid reading of ``value``: ``array<struct<notation string, epoch_s bigint>>``,
    those of an instant within 2008 to 2025.  ``zone`` is the IANA zone of wall times, NULL where there
    is none; ``windows`` says whether counts from the Windows epoch may occur.  With ``folds`` a reading
    has ``fold``, too (see :func:`_fold`).

    One projection builds on the other, so that each step is compiled and evaluated once a value: how
    the text begins rules most notations out, one match gives the groups, and these the readings."""
    c = F.col
    d = values.withColumn("_text", F.trim(F.regexp_replace("value", BLANK, " ")))
    t = c("_text")
    kind = (
        F.when(t.rlike(r"^\+?\d+(?:\.\d*)?$"), F.when(F.length(t).isin(12, 14), "digits").otherwise("count"))
        .when(t.rlike(r"^\d{4}[-:/.]"), "ymd")
        .when(t.rlike(r"^\d{8}"), "compact")
        .when(t.rlike(r"^\d{1,2}[-/.]\d"), "dmy")
        .when(t.rlike(rf"(?i)^{WEEKDAY}\d"), "d_month_y")
        .when(t.rlike(r"^[A-Za-z]"), "month_d_y")
    )
    d = d.withColumn("_kind", kind)

    def groups(name: str) -> Column:
        pattern, (iy, im, iday), time = WRITTEN[name]
        # A text that doesn't match stays as it is, without the mark in front.
        return F.regexp_replace(t, pattern, MARK + "|".join(f"${i}" for i in (iy, im, iday, *range(time, time + 9))))

    hit = F.when(c("_kind").isin("digits", "compact"), groups("compact"))
    for name in ("ymd", "dmy", "d_month_y", "month_d_y"):
        hit = hit.when(c("_kind") == name, groups(name))
    d = d.withColumn("_hit", hit)
    # Year, month, day, hour, minute, second, half of the day, Z, sign, two parts of an offset, region.
    d = d.withColumn("_g", F.when(F.startswith("_hit", F.lit(MARK)), F.split(F.substring("_hit", 2, 1_000_000), "\\|")))
    g = c("_g")
    whole = F.regexp_extract(t, r"^\+?(\d{1,19})(?:\.\d*)?$", 1)
    whole = F.when(c("_kind").isin("digits", "count") & (whole != ""), whole.try_cast("bigint"))
    numbers = {"_y": 0, "_d": 2, "_hour": 3, "_min": 4, "_sec": 5, "_oh": 9, "_om": 10}
    month = F.when(c("_kind").isin("d_month_y", "month_d_y"), _month_number(g[1])).otherwise(_number(g[1]))
    d = d.withColumns({n: _number(g[i]) for n, i in numbers.items()} | {"_m": month, "_half": F.lower(g[6]), "_whole": whole})

    half = c("_half")
    hour = F.when(half == "", c("_hour")).when(half == "a", c("_hour") % 12).otherwise(c("_hour") % 12 + 12)
    timely = (c("_min") <= 59) & (c("_sec") <= 59) & F.when(half == "", c("_hour") <= 23).otherwise(c("_hour").between(1, 12)) & (c("_oh") <= 18) & (c("_om") <= 59)
    day = lambda y, m, dd: F.when((y >= 1) & m.between(1, 12) & (dd >= 1) & (dd <= _month_length(y, m)), _days_since_1970(y, m, dd))
    first = F.when(g.isNotNull() & timely, day(c("_y"), c("_m"), c("_d")))
    second = F.when((c("_kind") == "dmy") & timely, day(c("_y"), c("_d"), c("_m")))
    # A region counts only in the form Area/City; anything else in brackets is a comment.
    region = F.when(g[11].rlike(r"^[A-Z][A-Za-z_]+/[A-Za-z_+/-]+\d*$"), g[11]).otherwise(c("zone"))
    offset = F.when(g[8] != "", (c("_oh") * 3600 + c("_om") * 60) * F.when(g[8] == "-", -1).otherwise(1)).when(g[7] != "", 0)
    time = hour * 3600 + c("_min") * 60 + c("_sec")
    d = d.withColumns({"_wall1": first * 86_400 + time, "_wall2": second * 86_400 + time, "_offset": offset, "_at": F.when(offset.isNull(), region)})
    epoch = lambda wall: F.coalesce(wall - c("_offset"), F.when(c("_at").isNotNull(), wall_to_epoch(wall, c("_at")))).cast("bigint")
    counted = F.lit(None).cast("struct<notation:string,epoch_s:bigint>")
    for name, unit in (UNIX_COUNTS | WINDOWS_COUNTS).items():
        at = _count(c("_whole"), *unit)
        ok = _in_years(at) & (c("windows") if name in WINDOWS_COUNTS else F.lit(True))
        counted = F.coalesce(counted, F.when(ok, F.struct(F.lit(name).alias("notation"), at.alias("epoch_s"))))
    d = d.withColumns({"_e1": epoch(c("_wall1")), "_e2": epoch(c("_wall2")), "_counted": counted})

    def one(ok: Column, notation: Column, at: Column, wall: Column | None) -> Column:
        fold = [(F.lit(None).cast("string") if wall is None else F.when(c("_at").isNotNull(), _fold(at, wall, c("_at")))).alias("fold")] if folds else []
        entry = F.array(F.struct(notation.alias("notation"), at.alias("epoch_s"), *fold))
        return F.when(F.coalesce(ok, F.lit(False)), entry).otherwise(F.array().cast(READINGS if folds else READINGS.replace(",fold:string", "")))

    named = F.when(c("_kind") == "digits", "compact").otherwise(c("_kind"))
    every = F.concat(
        one(_in_years(c("_e1")), named, c("_e1"), c("_wall1")),
        one(_in_years(c("_e2")), F.lit("mdy"), c("_e2"), c("_wall2")),
        # The years bound a count to one unit.
        one(c("_counted").isNotNull(), c("_counted.notation"), c("_counted.epoch_s"), None),
    )
    return d.select(*[c(x) for x in values.columns], every.alias("_all"))


def root_zones(spark: SparkSession, roots: DataFrame, zones: DataFrame) -> DataFrame:
    """(root string, tz string): folded root paths with their zone.  A path listed twice takes the
    smallest root id; a root without a zone stays, since it still hides the roots around it."""
    r = roots.select(F.col("id").alias("_id"), folded(F.col("path")).alias("root")).filter(F.length("root") > 0)
    z = zones.groupBy(F.col("root_id").alias("_id")).agg(F.min("tz").alias("tz"))
    return r.join(z, "_id", "left").groupBy("root").agg(F.min_by("tz", "_id").alias("tz"))


def with_zone(files: DataFrame, zones: DataFrame, path: str = "path", out: str = "zone") -> DataFrame:
    """Adds the zone of the innermost root that holds a path; NULL under no root or for a NULL path.

    Roots are looked up by the path's own ancestors, so the work per file is its depth, however many
    roots there are.  Up to ``MAX_LITERAL_ROOTS`` of them travel in the plan and nothing is shuffled."""
    known = zones.limit(MAX_LITERAL_ROOTS + 1).collect()
    if len(known) <= MAX_LITERAL_ROOTS:
        if not known:
            return files.withColumn(out, F.lit(None).cast("string"))
        table = F.create_map(*[F.lit(x) for r in known for x in (r["root"], r["tz"])])
        hit = F.filter(F.reverse(ancestors(F.col(path))), lambda a: F.map_contains_key(table, a))
        return files.withColumn(out, F.element_at(table, F.get(hit, F.lit(0))))
    paths = files.select(F.col(path).alias("_p")).filter("_p is not null").distinct()
    steps = paths.select("_p", F.posexplode(ancestors(F.col("_p"))).alias("_depth", "root"))
    best = steps.join(zones, "root").groupBy("_p").agg(F.max_by("tz", "_depth").alias(out))
    return files.join(best, files[path] == best["_p"], "left").drop("_p")


def fit_mixture(counts: dict[tuple[str, ...], int], rounds: int = 200) -> dict[tuple[str, ...], tuple[str, float]]:
    """Expectation-maximisation on one source's numbers of values by candidate notations; the likeliest
    notation and its posterior by candidates.  Notations that no value of the source distinguishes
    share their posterior equally, and so stay ambiguous."""
    names = sorted({k for kinds in counts for k in kinds})
    weight = dict.fromkeys(names, 1 / max(1, len(names)))
    for _ in range(rounds):
        mass = dict.fromkeys(names, 0.0)
        for kinds, n in counts.items():
            total = sum(weight[k] for k in kinds) or 1.0
            for k in kinds:
                mass[k] += n * weight[k] / total
        total = sum(mass.values()) or 1.0
        new = {k: v / total for k, v in mass.items()}
        moved = max((abs(new[k] - weight[k]) for k in names), default=0.0)
        weight = new
        if moved < 1e-9:
            break
    best = {kinds: max(kinds, key=lambda k: (weight[k], k)) for kinds in counts}
    return {kinds: (k, weight[k] / (sum(weight[x] for x in kinds) or 1.0)) for kinds, k in best.items()}


def normalise(values: DataFrame, min_posterior: float = 0.9) -> DataFrame:
    """Instants of values in mixed notations.

    ``values`` has id bigint, source string, value string, zone string (of wall times without one)
    and windows boolean (whether counts from the Windows epoch may occur).  Result: id, source,
    value, epoch_s (NULL if nothing fits or it is ambiguous), notation, posterior, ambiguous, fold.
    ``fold`` is 'repeated' for a wall time that its zone's clocks showed twice (epoch_s is the earlier
    one), 'skipped' for one they never showed (read with the offset before the change), else NULL.
    One row for each row of the input: NULL, empty, blank, over-long and meaningless values come out
    with NULL epoch_s and ambiguous false; repeated rows stay repeated.  Readings by different
    notations that name the same instant are no ambiguity."""
    with staging(values.sparkSession, "instants") as area:
        out = _chosen(area, values.select("id", "source", "value", "zone", "windows"), ["id", "source", "value"], folds=True)
    return out.select(
        "id", "source", "value",
        F.when(F.col("posterior") >= min_posterior, F.col("_one.epoch_s")).alias("epoch_s"),
        F.col("_one.notation").alias("notation"), "posterior",
        F.coalesce(F.col("posterior") < min_posterior, F.lit(False)).alias("ambiguous"), F.col("_one.fold").alias("fold"),
    )


def _chosen(area: Staging, values: DataFrame, keep: list[str], folds: bool = False) -> DataFrame:
    """Values with ``_one``, the reading of the highest posterior (NULL without any), and ``posterior``.

    Every value is parsed once, into a staged table.  Sources are fitted apart, each on its counts by
    candidate set, whose number the notations bound; what was fitted meets the values that have
    several candidates, if there are any."""
    # Readings that agree are one candidate, but no evidence for the first of their notations.
    agree = F.when(F.size("_all") <= 1, True).otherwise(F.size(F.array_distinct(F.col("_all.epoch_s"))) == 1)
    read = with_readings(values, folds).select(*keep, "_all", F.when(agree, F.lit(None).cast("string")).otherwise(F.array_join(F.col("_all.notation"), ",")).alias("_several"))
    # One method for the whole chain would be too large for the JVM to compile; projections are split.
    with settings(area.spark, **{"spark.sql.codegen.hugeMethodLimit": "8000"}):
        read = area.write(read, several=F.count("_several"))
    first = lambda d: d.select(*keep, F.get("_all", F.lit(0)).alias("_one"), F.when(F.size("_all") > 0, 1.0).alias("posterior"))
    if not seen_in(read, "several"):
        return first(read)
    counts = read.groupBy("source", F.array_join(F.col("_all.notation"), ",").alias("kinds")).agg(F.count("*").alias("n")).filter("kinds <> ''")

    def fit(own: pd.DataFrame) -> pd.DataFrame:
        got = fit_mixture({tuple(k.split(",")): n for k, n in zip(own["kinds"], own["n"])})
        rows = [(own["source"].iloc[0], ",".join(k), *p) for k, p in got.items() if len(k) > 1]
        return pd.DataFrame(rows, columns=["source", "_several", "_pick", "_sure"])

    fitted = area.write(counts.groupBy("source").applyInPandas(fit, "source string, _several string, _pick string, _sure double"))
    open_ = read.filter("_several is not null")
    key = F.concat_ws("\0", F.coalesce("source", F.lit("")), "_several")
    met = lookup(open_.withColumn("_k", key), fitted.withColumn("_k", key).select("_k", "_pick", "_sure"), "_k", seen_in(read, "several"))
    chosen = F.get(F.filter("_all", lambda x: x["notation"] == F.col("_pick")), F.lit(0))
    return first(read.filter("_several is null")).unionByName(met.select(*keep, chosen.alias("_one"), F.col("_sure").alias("posterior")))


#: The timestamp fields of a catalogue: whose zone a wall time without one has.
FIELDS = {"exif_datetime": "root", "sidecar_taken_time": "utc", "mtime": "utc", "resolved_date": "root"}


def catalogue_values(files: DataFrame, roots: DataFrame, zones: DataFrame) -> DataFrame:
    """The four timestamp fields of ``files`` as rows for :func:`normalise`, NULL values left out."""
    f = files.select("id", "path", *[F.col(c).cast("string").alias(c) for c in FIELDS])
    f = with_zone(f, root_zones(files.sparkSession, roots, zones))
    each = [F.struct(F.lit(c).alias("source"), F.col(c).alias("value"), F.lit(z).alias("of"), F.lit(c == "mtime").alias("windows")) for c, z in FIELDS.items()]
    # The zone is worked out once a file, below the explode, which leaves NULL values out itself.
    f = f.select("id", "zone", F.explode(F.filter(F.array(*each), lambda v: v["value"].isNotNull())).alias("_v"))
    return f.select("id", "_v.source", "_v.value", F.when(F.col("_v.of") == "root", F.col("zone")).otherwise("UTC").alias("zone"), "_v.windows")


def catalogue_instants(files: DataFrame, roots: DataFrame, zones: DataFrame, min_posterior: float = 0.9) -> DataFrame:
    """(file_id, field, epoch_s): the instant of every timestamp field that denotes one."""
    with staging(files.sparkSession, "instants") as area:
        out = _chosen(area, catalogue_values(files, roots, zones), ["id", "source"])
    # An explode drops what has no instant.
    kept = F.when(F.col("posterior") >= min_posterior, F.array("_one")).otherwise(F.array().cast("array<struct<notation:string,epoch_s:bigint>>"))
    return out.select(F.col("id").alias("file_id"), F.col("source").alias("field"), F.explode(kept).alias("_one")).select("file_id", "field", "_one.epoch_s")
