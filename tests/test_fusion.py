import math

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewake.functions import geo, rings
from tidewake.operators.assign import assign_by_rounds, assign_one_to_one, greedy_pairs
from tidewake.operators.spatial import within_distance
from tidewake.plans import fusion

PAIRS = "scene_id string, det_id long, mmsi long, distance_m double"


def _vincenty(lon1, lat1, lon2, lat2):
    a, f = 6378137.0, 1 / 298.257223563
    b = a * (1 - f)
    u1, u2 = (math.atan((1 - f) * math.tan(math.radians(x))) for x in (lat1, lat2))
    lam = big = math.radians(lon2 - lon1)
    for _ in range(200):
        s = math.hypot(math.cos(u2) * math.sin(lam), math.cos(u1) * math.sin(u2) - math.sin(u1) * math.cos(u2) * math.cos(lam))
        if s == 0:
            return 0.0
        c = math.sin(u1) * math.sin(u2) + math.cos(u1) * math.cos(u2) * math.cos(lam)
        sig = math.atan2(s, c)
        sa = math.cos(u1) * math.cos(u2) * math.sin(lam) / s
        ca2 = 1 - sa * sa
        cm = c - 2 * math.sin(u1) * math.sin(u2) / ca2 if ca2 else 0.0
        k = f / 16 * ca2 * (4 + f * (4 - 3 * ca2))
        old, lam = lam, big + (1 - k) * f * sa * (sig + k * s * (cm + k * c * (2 * cm * cm - 1)))
        if abs(lam - old) < 1e-13:
            break
    uu = ca2 * (a * a - b * b) / (b * b)
    x = 1 + uu / 16384 * (4096 + uu * (-768 + uu * (320 - 175 * uu)))
    y = uu / 1024 * (256 + uu * (-128 + uu * (74 - 47 * uu)))
    d = y * s * (cm + y / 4 * (c * (2 * cm * cm - 1) - y / 6 * cm * (4 * s * s - 3) * (4 * cm * cm - 3)))
    return b * x * (sig - d)


def test_distance_and_projection_against_the_ellipsoid(spark):
    pts = [(lon, lat, lon + dx, lat + dy) for lon, lat in ((120.9, 25.0), (25.2, 59.5), (51.1, 8.7), (104.7, 1.3)) for dx, dy in ((0.001, 0.002), (-0.03, 0.01), (0.0, 0.04), (0.2, -0.1))]
    df = spark.createDataFrame(pts, "lon double, lat double, lon2 double, lat2 double").withColumn("d", F.expr(geo.distance("lon", "lat", "lon2", "lat2")))
    for r in df.collect():
        want = _vincenty(r.lon, r.lat, r.lon2, r.lat2)
        assert abs(r.d - want) < (0.001 if want < 5000 else 0.2)
    steps = spark.createDataFrame([(25.0, 59.9, m, math.radians(az)) for m in (0.0, 300.0, 4000.0, 28_000.0) for az in (0, 45, 133, 290)], "lon double, lat double, m double, az double")
    steps = steps.withColumn("y", F.expr(geo.project_lat("lat", "m", "az"))).withColumn("x", F.expr(geo.project_lon("lon", "lat", "y", "m", "az")))
    for r in steps.collect():
        assert abs(_vincenty(r.lon, r.lat, r.x, r.y) - r.m) < max(0.01, r.m * 2e-5)


def test_gate_and_envelope(spark):
    r = spark.range(1).select(fusion.gate_m(F.lit(10.0)).alias("g"), fusion.envelope_m(F.lit(10.0), F.lit(-600.0)).alias("e"), fusion.gate_m(F.lit(None).cast("double")).alias("n")).first()
    assert (round(r.g, 4), round(r.e, 3), r.n) == (662.9996, 1434.666, 200.0)


@pytest.mark.parametrize(("assigned", "margin", "discriminating", "want"), [(True, 5.0, True, "matched"), (False, None, True, "indeterminate"), (False, 0.0, True, "indeterminate"), (False, 942.0, True, "dark"), (False, 942.0, False, "indeterminate"), (False, -3.0, True, "indeterminate")])
def test_three_states(spark, assigned, margin, discriminating, want):
    assert spark.range(1).select(fusion.classify(F.lit(assigned), F.lit(margin).cast("double"), F.lit(discriminating)).alias("s")).first().s == want


def test_one_vessel_serves_one_detection(spark):
    got = greedy_pairs(pd.DataFrame([(1, 7, 900.0), (2, 7, 20.0), (1, 8, 950.0)], columns=["det_id", "mmsi", "distance_m"]))
    assert sorted(zip(got["det_id"], got["mmsi"])) == [(1, 8), (2, 7)]
    tie = greedy_pairs(pd.DataFrame([(2, 7, 5.0), (1, 7, 5.0)], columns=["det_id", "mmsi", "distance_m"]))
    assert list(tie["det_id"]) == [1]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 5), st.integers(0, 5), st.integers(0, 4)), max_size=20, unique_by=lambda t: t[:2]))
def test_greedy_is_the_fixpoint_of_mutually_first_pairs(rows):
    pdf = pd.DataFrame(rows, columns=["det_id", "mmsi", "distance_m"])
    left, won = sorted(rows, key=lambda r: (r[2], r[0], r[1])), []
    while left:
        first_d, first_v = {}, {}
        for r in left:
            first_d.setdefault(r[0], r)
            first_v.setdefault(r[1], r)
        take = [r for r in left if first_d[r[0]] == r == first_v[r[1]]]
        won += take
        left = [r for r in left if all(r[0] != t[0] and r[1] != t[1] for t in take)]
    got = greedy_pairs(pdf) if len(pdf) else pdf
    assert sorted(zip(got["det_id"], got["mmsi"])) == sorted(r[:2] for r in won)


def test_rounds_equal_the_walk(spark):
    rows = [(f"s{i % 3}", (i * 7) % 11, (i * 5) % 9, float((i * 13) % 17)) for i in range(60)]
    df = spark.createDataFrame(rows, PAIRS).dropDuplicates(["scene_id", "det_id", "mmsi"])
    assert sorted(map(tuple, assign_by_rounds(df).collect())) == sorted(map(tuple, assign_one_to_one(df).collect()))


def test_cell_join_equals_the_nested_loop(spark):
    left = spark.createDataFrame([(i % 2, i, 24.5 + (i * 37 % 400) / 1000, 59.4 + (i * 53 % 300) / 1000) for i in range(300)], "g int, id long, lon double, lat double")
    right = spark.createDataFrame([(i % 2, i, 24.5 + (i * 41 % 400) / 1000, 59.4 + (i * 59 % 300) / 1000, float(200 + i * 97 % 9000)) for i in range(60)], "g int, rid long, r_lon double, r_lat double, r double")
    got = within_distance(left, right, F.col("r"), ["g"]).select("id", "rid").collect()
    loop = left.join(right.withColumnRenamed("g", "h"), (F.col("g") == F.col("h")) & F.expr(f"{geo.distance('lon', 'lat', 'r_lon', 'r_lat')} <= r")).select("id", "rid").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, loop)) and len(got) > 100
    anti = within_distance(left, right, F.col("r"), ["g"], "left_anti").count()
    assert anti == 300 - len({r.id for r in loop})


def test_rings(spark):
    square = "SRID=4326;POLYGON((0 0, 4 0, 4 4, 0 4, 0 0))"
    df = spark.createDataFrame([(square, 2.0, 2.0), (square, 4.0, 1.0), (square, 4.1, 1.0), (None, 0.0, 0.0)], "w string, x double, y double").withColumn("ring", rings.parse_wkt(F.col("w")))
    got = df.select(rings.covers(F.col("ring"), F.col("x"), F.col("y")).alias("c"), rings.area(F.col("ring")).alias("a")).collect()
    assert [r.c for r in got[:3]] == [True, True, False] and got[0].a == 16.0
    again = df.limit(1).select(rings.parse_geojson(rings.to_geojson(F.col("ring"))).alias("r"), "ring").first()
    assert again.r == again.ring
    box = (0.0, 0.0, 10.0, 10.0)
    assert rings.coverage([], box) == 0.0
    assert rings.coverage([square, "POLYGON((2 2, 6 2, 6 6, 2 6, 2 2))"], box) == pytest.approx(0.28)
    assert rings.coverage(["POLYGON((-5 -5, 15 -5, 15 5, -5 5, -5 -5))"], box) == pytest.approx(0.5)
    assert rings.coverage(["POLYGON((0 0, 10 0, 5 10, 0 0))", "POLYGON((0 10, 10 10, 5 0, 0 10))"], box) == pytest.approx(0.75)
