"""Fixes are kept small, worked on in waves of blocks, and looked for among the facts that matter only."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from tests.test_shared_looks import _passes
from tidewake.operators.spatial import nearest_in_time, reigns
from tidewake.plans import fusion
from tidewake.session import stable
from tidewake.sources import store


def _inputs(spark):
    scenes, positions = _passes(spark, 4)
    fixes, seen = fusion.placed_fixes(positions, scenes)
    sea = positions.select("id", F.concat(F.lit("s"), (F.col("id") % 2 + 1).cast("string"), F.lit("0"), (F.col("id") % 4).cast("string")).alias("scene_id"), "lon", "lat")
    return scenes.withColumn("scene_id", F.col("id")), fixes, seen, sea


def test_waves_give_the_same_and_leave_nothing(spark):
    scenes, fixes, seen, sea = _inputs(spark)
    ships = spark.createDataFrame([(k, 70 if k % 3 else 20) for k in range(36)] + [(4, 71)], "mmsi long, ship_type int")
    folder = os.path.dirname(seen._written)
    works = (lambda f, s, of: fusion.dark_margins(of(sea), f, s), lambda f, s, of: fusion.large_recall(of(sea), f, of(scenes), ships, seen=s))
    rows = lambda frames: [sorted(map(tuple, d.collect())) for d in frames]
    whole = rows(fusion.in_waves(fixes, seen, *works))
    before, sizes = set(os.listdir(folder)), []
    parts = fusion.in_waves(fixes, seen, lambda f, s, of: (sizes.append(f.count()), works[0](f, s, of))[1], works[1], most=40)
    assert rows(parts) == whole and any(r[1] for r in whole[1]) and any(r[2] is not None for r in whole[0])
    assert len(sizes) >= 2 and sum(sizes) == fixes.count() and max(sizes) < fixes.count()
    assert len(set(os.listdir(folder)) - before) == 2 * len(sizes)  # the results alone


def test_recall_counts_as_each_vessel_tested_alone(spark):
    scenes, fixes, seen, sea = _inputs(spark)
    ships = spark.createDataFrame([(k, 70) for k in range(36)], "mmsi long, ship_type int")
    got = {r.scene_id: r.recall_large_total for r in fusion.large_recall(sea, fixes, scenes.drop("scene_id"), ships, seen=seen).collect()}
    of_scene = fixes.join(fusion.places(seen), "place").join(scenes, "scene_id").filter("sog >= 1").filter(fusion._in_footprint(scenes, "r_lon", "r_lat"))
    want = {r.scene_id: r.n for r in of_scene.groupBy("scene_id").agg(F.count("*").alias("n")).collect()}
    assert {k: v for k, v in got.items() if v} == want and len(want) >= 4


def test_facts_stand_in_few_buckets(spark):
    facts = spark.createDataFrame([(k, k % 5, k * 10_000_000, 121.0, 25.0) for k in range(1_080)], "id long, mmsi long, time_us long, lon double, lat double")
    at = spark.createDataFrame([(0, 3_600_000_000)], "at int, sensed_us long")
    spans = reigns(facts, "mmsi", 1_800_000_000, instants=at)
    assert spans.count() == spans.select("id").distinct().count() == 1_080
    far = spark.createDataFrame([(0, 400_000_000_000)], "at int, sensed_us long")
    assert reigns(facts, "mmsi", 1_800_000_000, instants=far).count() == 0
    moved = facts.withColumn("lon", F.col("lon") + F.col("id") / 1e4)
    near = nearest_in_time(moved, at, "mmsi", 1_800_000_000, "at", within=F.col("time_us") > 3_605_000_000)
    assert {r.mmsi: r.id for r in near.collect()} == {k % 5: k for k in range(361, 366)}


def test_a_stored_fusion_leaves_its_tables_alone(spark, tmp_path):
    (tmp_path / "t.parquet").write_text("x")
    made = []

    def fuse():
        made.append(stable(spark.range(9).select(F.col("id"), F.lit("a").alias("scene_id"))))
        return fusion.Fused(made[0], made[0])

    assert store.stored(spark, str(tmp_path), fuse).detections.count() == 9
    assert not os.path.exists(made[0]._written)
