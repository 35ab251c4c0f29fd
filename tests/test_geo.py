import math
import random

import pytest
from pyspark.sql import functions as F

from pixelloom.operators import geo as G

PLACES = "place_id bigint, name string, kind string, center_lat double, center_lon double, radius_m double, ring_lat array<double>, ring_lon array<double>"


def places(spark, rows):
    return spark.createDataFrame([(i, "p", k, *v) for i, (k, *v) in enumerate(rows)], PLACES)


def points(spark, rows):
    return spark.createDataFrame([(i, *(None if x is None else float(x) for x in p), "c", 1) for i, p in enumerate(rows)], "id bigint, lat double, lon double, cell string, place_id int")


def circle(lat, lon, r):
    return ("circle", *(None if x is None else float(x) for x in (lat, lon, r)), None, None)


def ring(*corners):
    return ("polygon", None, None, None, [float(a) for a, _ in corners], [float(b) for _, b in corners])


def distance(a, b, c, d):
    a, b, c, d = map(math.radians, (a, b, c, d))
    return 2 * G.EARTH_M * math.asin(min(1, math.sqrt(math.sin((c - a) / 2) ** 2 + math.cos(a) * math.cos(c) * math.sin((d - b) / 2) ** 2)))


def pairs(spark, pts, pls):
    return {(r["id"], r["place_id"]) for r in G.points_in_regions(points(spark, pts), places(spark, pls)).collect()}


def test_circles_against_brute_force(spark):
    rnd = random.Random(3)
    spot = lambda: (math.degrees(math.asin(rnd.uniform(-1, 1))), rnd.uniform(-180, 180))
    pls = [circle(*spot(), 10 ** rnd.uniform(1, 6.5)) for _ in range(150)]
    pls += [circle(90, 0, 5e5), circle(-90, 10, 2e5), circle(89.99, 170, 3000), circle(0, 180, 1e4), circle(10, -180, 1e4), circle(5, 5, 0.0), circle(3, 3, 2.1e7)]
    pts = [spot() for _ in range(300)] + [(90.0, 12.0), (-90.0, 0.0), (0.0, 180.0), (0.0, -180.0), (5.0, 5.0), (10.0, 179.99)]
    for p in pls[:100]:
        pts.append((max(-90, min(90, p[1] + rnd.gauss(0, p[3] / 2e5))), (p[2] + rnd.gauss(0, p[3] / 2e5) + 180) % 360 - 180))
    want = {(i, j) for i, (a, b) in enumerate(pts) for j, p in enumerate(pls) if distance(a, b, p[1], p[2]) <= p[3]}
    assert pairs(spark, pts, pls) == want and len(want) > 300


def test_polygons_at_the_meridian_and_around_poles(spark):
    pls = [
        ring((10, 170), (10, -170), (20, -170), (20, 170)),  # over the 180th meridian
        ring((20, 170), (20, -170), (10, -170), (10, 170)),  # turning the other way
        ring((70, 0), (80, 90), (70, 180), (80, -90)),  # around the north pole
        ring((-70, -90), (-80, 180), (-70, 90), (-80, 0)),  # around the south pole
        ring((0, 0), (0, 10), (10, 10), (5, 5), (10, 0)),  # concave
    ]
    pts = [(15, 175), (15, -175), (15, 165), (25, 179), (89, 33), (76, 46), (72, 45), (-89, 0), (-60, 10), (2, 5), (9, 5), (8, 1)]
    assert pairs(spark, pts, pls) == {(0, 0), (0, 1), (1, 0), (1, 1), (4, 2), (5, 2), (7, 3), (9, 4), (11, 4)}


def test_what_is_no_place_or_point_is_left_out(spark):
    nan = math.nan
    bad = [circle(None, 1, 5), circle(nan, 1, 5), circle(1, 1, nan), circle(1, 1, None), circle(1, 1, -5), ("square", 1.0, 1.0, 9e9, None, None), ring((0, 0), (1, 1)), ("polygon", None, None, None, [0.0, 1.0, 2.0], [0.0, 1.0]), ("polygon", None, None, None, [0.0, nan, 2.0], [0.0, 1.0, 5.0]), (None, 1.0, 1.0, 5.0, None, None)]
    assert pairs(spark, [(1, 1), (0.5, 0.4)], bad) == set()
    assert pairs(spark, [(None, 1), (nan, 1), (91, 1), (1, 181), (1, None)], [circle(1, 1, 1e7)]) == set()
    assert pairs(spark, [], [circle(1, 1, 5)]) == set()


def test_repeated_rows_repeat_pairs(spark):
    p = points(spark, [(1, 1)])
    assert G.points_in_regions(p.unionByName(p), places(spark, [circle(1, 1, 5)])).count() == 2


def test_shuffled_join_gives_the_same(spark, sf, monkeypatch):
    R = lambda n: spark.read.parquet(f"{sf}/{n}.parquet")
    run = lambda: sorted(map(tuple, G.points_in_regions(G.locations(R("files")), R("places")).collect()))
    want = run()
    monkeypatch.setattr(G, "MAX_BROADCAST_BYTES", 10)
    assert run() == want


def test_locations(spark):
    nan = math.nan
    rows = [(1, 5.0, 6.0, 1.0, 1.0), (2, 0.0, 0.0, 1.0, 2.0), (3, 5.0, nan, 3.0, 4.0), (4, 91.0, 0.0, None, 4.0), (5, None, None, 7.0, 181.0), (None, 1.0, 1.0, 1.0, 1.0), (6, 0.0, 5.0, nan, nan)]
    df = spark.createDataFrame(rows, "id bigint, gps_lat double, gps_lon double, sidecar_lat double, sidecar_lon double")
    assert sorted(map(tuple, G.locations(df).collect())) == [(1, 5.0, 6.0), (2, 1.0, 2.0), (3, 3.0, 4.0), (6, 0.0, 5.0)]


@pytest.mark.parametrize("radius", [50.0, 2e5])
def test_points_near_points(spark, radius):
    rnd = random.Random(1)
    a = [(rnd.uniform(-2, 2), (rnd.uniform(178, 182) + 180) % 360 - 180) for _ in range(80)]
    df = points(spark, a)
    got = {(r["id"], r["near_id"]) for r in G.points_near(df, df, radius).collect()}
    assert got == {(i, j) for i, p in enumerate(a) for j, q in enumerate(a) if distance(*p, *q) <= radius}
    assert G.points_near(df, df.filter(F.lit(False)), radius).count() == 0
