"""Points near points and points in regions, on grid cells sized by the radius of what is sought.

Every region (circle or polygon) gets a cell size per axis, the smallest power of ``BASE`` not
below its extent, so that it touches at most two cells on an axis, however small or large it is.
Points are hashed once per cell size in use; equal cells meet in an equi-join and the exact great
circle distance or point-in-polygon test decides.  Latitude and longitude have cell sizes of their
own, so a small circle beside a pole, which spans all longitudes, stays narrow in latitude.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelloom.session import seen_in, staging

EARTH_M = 6_371_008.8
BASE = 4.0
FINEST = 11  # 360 degrees / 4^11: about 10 m on the equator
#: Region cells of up to so many bytes, edges included, are broadcast (they are summed first); more are
#: joined by a shuffle with salted hot cells.
MAX_BROADCAST_BYTES = 16_000_000
SALTS = 32


def usable(lat: Column, lon: Column) -> Column:
    """Whether a pair is a place on earth: numbers in range and not the placeholder 0, 0."""
    numbers = lat.isNotNull() & lon.isNotNull() & ~F.isnan(lat) & ~F.isnan(lon)
    return F.coalesce(numbers & (F.abs(lat) <= 90) & (F.abs(lon) <= 180) & ~((lat == 0) & (lon == 0)), F.lit(False))


def locations(files: DataFrame) -> DataFrame:
    """(id, lat, lon): a file's gps pair if usable, else its sidecar pair; files with neither are left out."""
    f = files.select("id", *[F.col(c).cast("double").alias(c) for c in ("gps_lat", "gps_lon", "sidecar_lat", "sidecar_lon")])
    own, other = usable(F.col("gps_lat"), F.col("gps_lon")), usable(F.col("sidecar_lat"), F.col("sidecar_lon"))
    pick = lambda axis: F.when(own, F.col(f"gps_{axis}")).when(other, F.col(f"sidecar_{axis}"))
    return f.select("id", pick("lat").alias("lat"), pick("lon").alias("lon")).filter("id is not null and lat is not null")


def wrapped(degrees: Column) -> Column:
    """A difference of longitudes, the shorter way round: from -180 to below 180."""
    return F.pmod(degrees + 180.0, F.lit(360.0)) - 180.0


def great_circle_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in metres by the haversine form, which stays exact for short distances."""
    h = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2.0) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2.0)
    return 2 * EARTH_M * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def in_polygon(lat: Column, lon: Column, edges: Column, north_pole: Column) -> Column:
    """Whether a point lies in a ring of edges (lat1, lon1, lat2, lon2): the parity of the edges that
    its meridian crosses to the north, turned round if the ring runs around the north pole."""

    def crossed(count: Column, e: Column) -> Column:
        a, b = wrapped(e["lon1"] - lon), wrapped(e["lon2"] - lon)
        meets = ((a <= 0) != (b <= 0)) & (F.abs(b - a) < 180)
        return count + F.when(meets & (e["lat1"] + (e["lat2"] - e["lat1"]) * (-a / (b - a)) > lat), 1).otherwise(0)

    return (F.aggregate(edges, F.lit(0), crossed) % 2 == 1) != north_pole


def _level(extent: Column, whole: float) -> Column:
    """The finest level whose cells (``whole`` / BASE^level degrees) are at least as large as an extent."""
    fits = F.floor(F.log(F.lit(whole) / F.greatest(extent, F.lit(1e-9))) / math.log(BASE))
    return F.greatest(F.lit(0), F.least(F.lit(FINEST), fits)).cast("int")


def regions(places: DataFrame) -> DataFrame:
    """Places as regions with their bounding box: place_id, kind, centre, radius_m, edges,
    north_pole, lat_lo, lat_hi, lon_lo, lon_span.

    Left out, since they hold no point: an unknown kind, a circle with a missing, NaN or
    out-of-range centre or radius, a ring with under three corners, halves of unequal length or a
    missing or NaN corner."""
    p = places.select(
        "place_id", "kind", F.col("center_lat").alias("c_lat"), F.col("center_lon").alias("c_lon"), "radius_m",
        F.when((F.size("ring_lat") >= 3) & (F.size("ring_lat") == F.size("ring_lon")), F.arrays_zip(F.col("ring_lat").alias("lat"), F.col("ring_lon").alias("lon"))).alias("ring"),
    )
    sound = lambda x: x.isNotNull() & ~F.isnan(x)
    circle = (F.col("kind") == "circle") & sound(F.col("c_lat")) & sound(F.col("c_lon")) & sound(F.col("radius_m")) & (F.abs("c_lat") <= 90) & (F.col("radius_m") >= 0)
    polygon = (F.col("kind") == "polygon") & F.forall("ring", lambda v: sound(v["lat"]) & sound(v["lon"]))
    # Circles: the box of a spherical cap, a little enlarged against rounding.
    angle = F.col("radius_m") / EARTH_M * (1 + 1e-9) + 1e-12
    low, high = F.degrees(F.radians("c_lat") - angle), F.degrees(F.radians("c_lat") + angle)
    half = F.when((low <= -90) | (high >= 90), 180.0).otherwise(F.degrees(F.asin(F.least(F.lit(1.0), F.sin(angle) / F.cos(F.radians("c_lat"))))))
    c = p.filter(circle).select(
        "place_id", "kind", "c_lat", "c_lon", "radius_m", F.lit(None).cast("array<struct<lat1:double,lon1:double,lat2:double,lon2:double>>").alias("edges"), F.lit(False).alias("north_pole"),
        F.greatest(low, F.lit(-90.0)).alias("lat_lo"), F.least(high, F.lit(90.0)).alias("lat_hi"), (F.col("c_lon") - half).alias("lon_lo"), (2 * half).alias("lon_span"),
    )
    # Polygons: corners unrolled in longitude from the first one; a ring that doesn't come back to
    # its first longitude runs around a pole, and then covers all of them up to that pole.
    corners = F.col("ring")
    nxt = lambda i: F.get(corners, (i + 1) % F.size(corners))
    edges = F.transform(corners, lambda v, i: F.struct(v["lat"].alias("lat1"), v["lon"].alias("lon1"), nxt(i)["lat"].alias("lat2"), nxt(i)["lon"].alias("lon2")))
    g = p.filter(polygon).withColumn("edges", edges)
    unrolled = F.aggregate(
        "edges", F.struct(F.lit(0.0).alias("at"), F.lit(0.0).alias("lo"), F.lit(0.0).alias("hi")),
        lambda acc, e: F.struct((acc["at"] + wrapped(e["lon2"] - e["lon1"])).alias("at"), F.least(acc["lo"], acc["at"] + wrapped(e["lon2"] - e["lon1"])).alias("lo"), F.greatest(acc["hi"], acc["at"] + wrapped(e["lon2"] - e["lon1"])).alias("hi")),
    )
    g = g.withColumn("_u", unrolled).withColumn("_around", F.abs("_u.at") > 180)
    g = g.withColumn("_north", F.col("_around") & (F.aggregate("ring", F.lit(0.0), lambda s, v: s + v["lat"]) > 0))
    lows, highs = F.array_min(F.transform("ring", lambda v: v["lat"])), F.array_max(F.transform("ring", lambda v: v["lat"]))
    g = g.select(
        "place_id", "kind", "c_lat", "c_lon", "radius_m", "edges", F.col("_north").alias("north_pole"),
        F.when(F.col("_around") & ~F.col("_north"), -90.0).otherwise(lows).alias("lat_lo"), F.when(F.col("_north"), 90.0).otherwise(highs).alias("lat_hi"),
        F.when(F.col("_around"), -180.0).otherwise(F.get(F.col("ring.lon"), F.lit(0)) + F.col("_u.lo")).alias("lon_lo"), F.when(F.col("_around"), 360.0).otherwise(F.col("_u.hi") - F.col("_u.lo")).alias("lon_span"),
    )
    return c.unionByName(g)


def _cell(level_lat: Column, level_lon: Column, i: Column, j: Column) -> Column:
    """One number for a cell: both levels and both indices."""
    return F.shiftleft(level_lat.cast("bigint") * 16 + level_lon.cast("bigint"), 50) + F.shiftleft(i.cast("bigint"), 25) + j.cast("bigint")


def _index(degrees: Column, whole: float, level: Column) -> Column:
    return F.floor(degrees / F.lit(whole) * F.pow(F.lit(BASE), level.cast("double"))).cast("bigint")


def region_cells(r: DataFrame) -> DataFrame:
    """Regions with every cell they may touch (``cell``), at most two on each axis."""
    r = r.withColumn("_a", _level(F.col("lat_hi") - F.col("lat_lo"), 180.0)).withColumn("_o", _level(F.col("lon_span"), 360.0))
    rows = F.sequence(_index(F.col("lat_lo") + 90, 180.0, F.col("_a")), _index(F.col("lat_hi") + 90, 180.0, F.col("_a")))
    first = _index(F.col("lon_lo") + 180, 360.0, F.col("_o"))
    last = _index(F.col("lon_lo") + 180 + F.col("lon_span"), 360.0, F.col("_o"))
    n = F.pow(F.lit(BASE), F.col("_o").cast("double")).cast("bigint")
    columns = F.array_distinct(F.transform(F.sequence(first, F.least(last, first + n - 1)), lambda j: F.pmod(j, n)))
    return r.withColumn("_i", F.explode(rows)).withColumn("_j", F.explode(columns)).withColumn("cell", _cell(F.col("_a"), F.col("_o"), F.col("_i"), F.col("_j"))).drop("_i", "_j")


def points_in_regions(points: DataFrame, places: DataFrame) -> DataFrame:
    """(id, place_id) for every point (id, lat, lon) and every place that contains it.

    Points with a missing, NaN or out-of-range half are in no region.  Repeated points and repeated
    places give repeated pairs; an empty side gives an empty result."""
    return _met(points, places).select("id", "place_id")


def _met(points: DataFrame, places: DataFrame) -> DataFrame:
    """(id, place_id, lat, lon, c_lat, c_lon) of points in regions, the region's centre with them."""
    spark = points.sparkSession
    p = points.select("id", F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon"))
    p = p.filter(F.col("lat").between(-90, 90) & F.col("lon").between(-180, 180) & ~F.isnan("lat") & ~F.isnan("lon"))
    with staging(spark, "regions") as area:
        cells = area.write(region_cells(regions(places)), bytes=F.sum(120 + 32 * F.coalesce(F.size("edges"), F.lit(0))))
    # Pairs of levels: bounded by the square of FINEST, whatever the data.
    levels = [(r["_a"], r["_o"]) for r in cells.select("_a", "_o").distinct().collect()]
    few = seen_in(cells, "bytes") <= MAX_BROADCAST_BYTES
    lon = F.when(F.col("lon") >= 180, F.col("lon") - 360).otherwise(F.col("lon"))
    # A point on the pole belongs to the northernmost row that a box touching it has, too.
    levels = levels or [(0, 0)]  # no region, and no point meets one
    hashed = [_cell(F.lit(a), F.lit(o), _index(F.col("lat") + 90, 180.0, F.lit(a)), _index(lon + 180, 360.0, F.lit(o))) for a, o in levels]
    p = p.withColumn("cell", F.explode(F.array(*hashed)))
    side = cells.drop("_a", "_o", "lon_lo", "lon_span")
    if few:
        met = p.join(F.broadcast(side), "cell")
    else:
        # A hot cell's points are spread over SALTS tasks; only the cells of regions are repeated.
        p = p.withColumn("_salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))
        met = p.join(side.withColumn("_salt", F.explode(F.array(*map(F.lit, range(SALTS))))), ["cell", "_salt"])
    inside = F.when(F.col("kind") == "circle", great_circle_m(F.col("lat"), F.col("lon"), F.col("c_lat"), F.col("c_lon")) <= F.col("radius_m")).otherwise(in_polygon(F.col("lat"), F.col("lon"), F.col("edges"), F.col("north_pole")))
    return met.filter(F.col("lat").between(F.col("lat_lo") - 1e-9, F.col("lat_hi") + 1e-9)).filter(inside).select("id", "place_id", "lat", "lon", "c_lat", "c_lon")


def points_near(points: DataFrame, others: DataFrame, radius_m: float) -> DataFrame:
    """(id, near_id, distance_m) for every point of ``points`` and every one of ``others`` (id, lat, lon)
    within a radius: the radius makes a circle of each other point, and its cells meet the points.
    Repeated points count once; points that are no place on earth are near nothing."""
    near = others.select(F.col("id").alias("place_id"), F.lit("circle").alias("kind"), F.col("lat").cast("double").alias("center_lat"), F.col("lon").cast("double").alias("center_lon"), F.lit(float(radius_m)).alias("radius_m"), *[F.lit(None).cast("array<double>").alias(c) for c in ("ring_lat", "ring_lon")])
    out = _met(points.select("id", "lat", "lon").distinct(), near.distinct())
    return out.select("id", F.col("place_id").alias("near_id"), great_circle_m(F.col("lat"), F.col("lon"), F.col("c_lat"), F.col("c_lon")).alias("distance_m"))
