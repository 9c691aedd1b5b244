"""Scenes that see alike (one instant, one footprint) are worked on once; results are as for each alone."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewake.functions import rings
from tidewake.operators import overlay
from tidewake.plans import fusion, scheduling, views

_SLANT = ((120.83, 24.97), (122.23, 25.07), (122.23, 26.05), (120.83, 25.95), (120.83, 24.97))
_BOX_COLUMNS = "min_lon double, min_lat double, max_lon double, max_lat double"
_RING = "array<struct<lon: double, lat: double>>"


def test_points_on_a_slanting_edge_are_covered(spark):
    df = spark.createDataFrame([(list(_SLANT), 121.1114, 24.990099999999998), (list(_SLANT), 121.1114, 24.9900), (list(_SLANT), 122.23, 25.5), (list(_SLANT), 121.5, 25.5)], f"ring {_RING}, x double, y double")
    got = [r[0] for r in df.select(rings.covers(F.col("ring"), F.col("x"), F.col("y"))).collect()]
    assert got == [True, False, True, True]


def test_one_mosaic_is_united_once(spark, monkeypatch):
    square = lambda side: [(0.0, 0.0), (side, 0.0), (side, 10.0), (0.0, 10.0), (0.0, 0.0)]
    rows = [("r", f"a{k:02}", 0, square(9.0 - k % 2)) for k in range(20)] + [("r", f"b{k:02}", 300_000_000, square(4.0)) for k in range(20)] + [("r", "c", 90_000_000_000, None)]
    scenes = spark.createDataFrame(rows, f"roi string, id string, sensed_us long, ring {_RING}")
    boxes = spark.createDataFrame([("r", 0.0, 0.0, 10.0, 10.0)], "name string, sar_min_lon double, sar_min_lat double, sar_max_lon double, sar_max_lat double")
    plain = {r.anchor: round(r.coverage, 9) for r in scheduling.coverage(scheduling.mosaics(scenes), boxes).collect()}
    met, coverage = [], scheduling.coverage
    monkeypatch.setattr(scheduling, "coverage", lambda m, b: (met.append(m.count()), coverage(m, b))[1])
    got = {r.anchor: round(r.coverage, 9) for r in scheduling.scene_coverage(scenes, boxes).collect()}
    assert got == plain and len(got) == 41
    assert met == [5]  # two sides at 0 and one at 300 s, the latter alone, and nothing


def test_one_footprint_meets_the_land_once(spark, monkeypatch):
    box = (120.83, 24.97, 122.23, 26.05)
    scenes = spark.createDataFrame([(f"s{k}", *box, list(_SLANT)) for k in range(30)], f"id string, {_BOX_COLUMNS}, ring {_RING}")
    land = spark.createDataFrame([(1, 121.0, 25.2, 121.1, 25.3, [(121.0, 25.2), (121.1, 25.2), (121.1, 25.3), (121.0, 25.3), (121.0, 25.2)])], f"id long, {_BOX_COLUMNS}, ring {_RING}")
    met, intersected = spark.sparkContext.accumulator(0), overlay._intersected

    def counted(a: pa.Array, b: pa.Array) -> pa.Array:
        met.add(len(a))
        return intersected(a, b)

    monkeypatch.setattr(overlay, "intersection", lambda a, b: F.arrow_udf(counted, f"array<{_RING}>")(a, b))
    got = views.land_in_scenes(scenes, land).collect()
    assert len(got) == 30 and all(abs(r.area - 0.01) < 1e-9 for r in got)
    assert met.value == 1


def _passes(spark, copies: int):
    """Two instants with ``copies`` scenes each of one footprint and one scene farther off, and vessels in, near and outside."""
    near, far = (120.8, 24.9, 121.2, 25.3), (121.3, 24.9, 121.6, 25.3)
    ring = lambda b: [(b[0], b[1]), (b[2], b[1]), (b[2], b[3]), (b[0], b[3]), (b[0], b[1])]
    rows = [(f"s{at}{k:02}", at * 600_000_000, *near, ring(near)) for at in (1, 2) for k in range(copies)] + [(f"t{at}", at * 600_000_000, *far, ring(far)) for at in (1, 2)]
    scenes = spark.createDataFrame(rows, f"id string, sensed_us long, {_BOX_COLUMNS}, ring {_RING}")
    fixes = [(k * 10 + j, k, (500 + 60 * j + k % 7) * 1_000_000, 120.3 + k * 0.05 + 0.2 * (j % 2), 25.0 + (k % 5) * 0.05, float(k % 9), 45.0) for k in range(36) for j in range(6)]
    return scenes, spark.createDataFrame(fixes, "id long, mmsi long, time_us long, lon double, lat double, sog double, cog double")


def test_fixes_are_kept_by_instant_and_not_by_scene(spark):
    counts, by_scene = {}, {}
    for copies in (1, 8):
        scenes, positions = _passes(spark, copies)
        fixes, seen = fusion.placed_fixes(positions, scenes)
        counts[copies] = fixes.count()
        rows = fusion.projected_fixes(positions, scenes).collect()
        by_scene[copies] = {(r.scene_id, r.mmsi): tuple(r)[1:] for r in rows}
        assert len(rows) == len(by_scene[copies])
    assert counts[8] == counts[1]
    assert {k[0] for k in by_scene[8]} == {f"s{at}{k:02}" for at in (1, 2) for k in range(8)} | {"t1", "t2"}
    for (scene, mmsi), row in by_scene[8].items():
        assert by_scene[1][(scene[:2] + "00" if scene[0] == "s" else scene, mmsi)] == row
    # the plain way: all pairs within age and pad, nearest in time first
    scenes, positions = _passes(spark, 1)
    pairs = scenes.withColumnRenamed("id", "scene_id").crossJoin(positions).filter(F.abs(F.col("time_us") - F.col("sensed_us")) <= 1_800_000_000)
    pairs = pairs.filter(rings.distance(F.col("ring"), "lon", "lat") <= 30_000.0)
    first = pairs.withColumn("_k", F.row_number().over(Window.partitionBy("scene_id", "mmsi").orderBy(F.abs(F.col("time_us") - F.col("sensed_us")), "time_us", "id"))).filter("_k = 1")
    plain = {(r.scene_id, r.mmsi): r.id for r in first.collect()}
    got = {(r.scene_id, r.mmsi): r.id for r in fusion.nearest_fixes(positions, scenes).collect()}
    assert got == plain and 20 < len(plain) < 4 * 36
