"""Queries of the general data-processing operators (p1 and p3), each over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelloom.operators import geo, timestamps
from pixelloom.plans.tables import table


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """(file_id, field, epoch_s) of every timestamp field that denotes an instant."""
    return timestamps.catalogue_instants(*(table(spark, folder, t) for t in ("files", "scan_roots", "root_zones")))


def p1_notations(spark: SparkSession, folder: str) -> DataFrame:
    """(field, notation, n_values, n_ambiguous): what the fitted mixtures chose, by field."""
    done = timestamps.normalise(timestamps.catalogue_values(*(table(spark, folder, t) for t in ("files", "scan_roots", "root_zones"))))
    return done.groupBy(F.col("source").alias("field"), F.coalesce("notation", F.lit("none")).alias("notation")).agg(F.count("*").alias("n_values"), F.count_if("ambiguous").alias("n_ambiguous"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """(file_id, place_id) of every place that contains a file's location."""
    pairs = geo.points_in_regions(geo.locations(table(spark, folder, "files")), table(spark, folder, "places"))
    return pairs.select(F.col("id").alias("file_id"), "place_id")


def p1_ambiguous(spark: SparkSession, folder: str) -> DataFrame:
    """(source, notation, n_values, n_ambiguous, n_repeated, n_skipped) of dates with two readings.

    The days of files.mtime, written day first by one source, month first by another and either way by
    a third, at two o'clock in a zone whose clocks change at that hour."""
    f = table(spark, folder, "files").filter(F.col("mtime").between(timestamps.FIRST, timestamps.LAST - 1))
    kind = F.when(F.col("id") % 4 == 0, "day first").when(F.col("id") % 4 == 1, "month first").otherwise("either")
    day_first = (F.col("id") % 4).isin(0, 2)
    text = F.date_format(F.timestamp_seconds("mtime"), "dd/MM/yyyy"), F.date_format(F.timestamp_seconds("mtime"), "MM/dd/yyyy")
    value = F.concat(F.when(day_first, text[0]).otherwise(text[1]), F.lit(" 02:30:00"))
    done = timestamps.normalise(f.select("id", kind.alias("source"), value.alias("value"), F.lit("Europe/Berlin").alias("zone"), F.lit(False).alias("windows")))
    notation = F.when(F.col("ambiguous"), "open").otherwise(F.col("notation"))
    return done.groupBy("source", notation.alias("notation")).agg(F.count("*").alias("n_values"), F.count_if("ambiguous").alias("n_ambiguous"), F.count_if(~F.col("ambiguous") & (F.col("fold") == "repeated")).alias("n_repeated"), F.count_if(~F.col("ambiguous") & (F.col("fold") == "skipped")).alias("n_skipped"))


def p3_near_centres(spark: SparkSession, folder: str) -> DataFrame:
    """(file_id, place_id, distance_m) of the circles' centres within 2 km of a file's location."""
    p = table(spark, folder, "places").filter("kind = 'circle'")
    centres = p.select(F.col("place_id").alias("id"), F.col("center_lat").alias("lat"), F.col("center_lon").alias("lon"))
    near = geo.points_near(geo.locations(table(spark, folder, "files")), centres, 2_000.0)
    return near.select(F.col("id").alias("file_id"), F.col("near_id").alias("place_id"), F.round("distance_m", 3).alias("distance_m"))


QUERIES = {q.__name__: q for q in (p1_found, p1_notations, p1_ambiguous, p3_found, p3_near_centres)}

_LOCATION = """
  SELECT id, CASE WHEN own THEN gps_lat ELSE sidecar_lat END AS lat, CASE WHEN own THEN gps_lon ELSE sidecar_lon END AS lon
  FROM (SELECT *,
          coalesce(NOT isnan(gps_lat) AND NOT isnan(gps_lon) AND abs(gps_lat) <= 90 AND abs(gps_lon) <= 180 AND NOT (gps_lat = 0 AND gps_lon = 0), false) AS own,
          coalesce(NOT isnan(sidecar_lat) AND NOT isnan(sidecar_lon) AND abs(sidecar_lat) <= 90 AND abs(sidecar_lon) <= 180 AND NOT (sidecar_lat = 0 AND sidecar_lon = 0), false) AS other
        FROM files) WHERE own OR other
"""

ORACLES = {
    # What the mixtures must come to: a source with one habit settles its open values by those of its
    # values that can only be read one way; a source of both leaves them open.
    "p1_ambiguous": """
WITH v AS (SELECT CASE WHEN id % 4 = 0 THEN 'day first' WHEN id % 4 = 1 THEN 'month first' ELSE 'either' END AS source, id % 4 IN (0, 2) AS day_first, make_timestamp(mtime * 1000000)::DATE AS d
           FROM files WHERE mtime >= 1199145600 AND mtime < 1767225600),
o AS (SELECT *, day(d) > 12 OR day(d) = month(d) AS plain FROM v),
n AS (SELECT source, CASE WHEN source = 'either' AND NOT plain THEN 'open'
                          WHEN day(d) = month(d) THEN 'dmy' WHEN day_first THEN 'dmy' ELSE 'mdy' END AS notation,
             month(d) = 10 AND dayofweek(d) = 0 AND day(d) > 24 AS again, month(d) = 3 AND dayofweek(d) = 0 AND day(d) > 24 AS never FROM o)
SELECT source, notation, count(*) AS n_values, count(*) FILTER (notation = 'open') AS n_ambiguous, count(*) FILTER (again AND notation <> 'open') AS n_repeated, count(*) FILTER (never AND notation <> 'open') AS n_skipped
FROM n GROUP BY source, notation
""",
    "p3_near_centres": f"""
WITH l AS ({_LOCATION}), c AS (SELECT l.id AS file_id, p.place_id,
       2 * 6371008.8 * asin(least(1.0, sqrt(pow(sin(radians(p.center_lat - lat) / 2), 2) + cos(radians(lat)) * cos(radians(p.center_lat)) * pow(sin(radians(p.center_lon - lon) / 2), 2)))) AS m
     FROM l JOIN places p ON p.kind = 'circle' AND abs(p.center_lat - lat) < 0.05)
SELECT file_id, place_id, round(m, 3) AS distance_m FROM c WHERE m <= 2000
""",
    # Independent of the grid: every location against every place.  A ring's corners are taken
    # relative to the point's longitude, which makes the 180th meridian an ordinary one.
    "p3_found": f"""
WITH l AS ({_LOCATION}),
c AS (SELECT l.id AS file_id, p.place_id FROM l JOIN places p ON p.kind = 'circle'
      AND 2 * 6371008.8 * asin(least(1.0, sqrt(pow(sin(radians(p.center_lat - lat) / 2), 2) + cos(radians(lat)) * cos(radians(p.center_lat)) * pow(sin(radians(p.center_lon - lon) / 2), 2)))) <= p.radius_m),
e AS (SELECT place_id, unnest(ring_lat) AS la, unnest(ring_lon) AS lo,
             unnest(list_concat(ring_lat[2:], ring_lat[1:1])) AS lb, unnest(list_concat(ring_lon[2:], ring_lon[1:1])) AS lp
      FROM places WHERE kind = 'polygon'),
w AS (SELECT *, (lp - lo + 540) - 360 * floor((lp - lo + 540) / 360) - 180 AS turn FROM e),
poles AS (SELECT place_id, abs(sum(turn)) > 180 AND sum(la) > 0 AS north, min(least(la, lb)) AS s, max(greatest(la, lb)) AS n, abs(sum(turn)) > 180 AS polar FROM w GROUP BY place_id),
x AS (SELECT l.id AS file_id, w.place_id, l.lat, poles.north, la, lb,
             (lo - lon + 540) - 360 * floor((lo - lon + 540) / 360) - 180 AS a, (lp - lon + 540) - 360 * floor((lp - lon + 540) / 360) - 180 AS b
      FROM l JOIN poles ON polar OR lat BETWEEN s AND n JOIN w USING (place_id)),
g AS (SELECT file_id, place_id FROM x GROUP BY file_id, place_id
      HAVING (sum(CASE WHEN (a <= 0) <> (b <= 0) AND abs(b - a) < 180 AND la + (lb - la) * (-a / (b - a)) > lat THEN 1 ELSE 0 END) % 2 = 1) <> any_value(north))
SELECT file_id, place_id FROM c UNION ALL SELECT file_id, place_id FROM g
""",
}
