"""What the fusion leaves on disk: shuffles, tables on the way, pairs that no walk can take."""

from __future__ import annotations

import os
import time

from pyspark.sql import functions as F

from tidewake.operators.assign import assign_one_to_one
from tidewake.plans import fusion
from tidewake.session import settled, stable


def _shuffles(spark) -> int:
    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return sum(blocks.apply(k).getName().startswith("shuffle_") for k in range(blocks.size()))


def test_a_stable_table_keeps_no_shuffle(spark):
    before = _shuffles(spark)
    kept = [stable(spark.range(20_000).repartition(4, F.col("id") % 1000 + n)) for n in range(5)]
    until = time.time() + 20
    while _shuffles(spark) > before and time.time() < until:
        time.sleep(0.2)
    assert _shuffles(spark) <= before
    assert [t.count() for t in kept] == [20_000] * 5


def test_tables_on_the_way_are_removed(spark):
    on_the_way = []

    def make():
        on_the_way.append(stable(spark.range(10)))
        return settled(lambda: on_the_way[0].filter("id > 3")).filter("id > 5")

    out = settled(make)
    assert not os.path.exists(on_the_way[0]._written) and os.path.exists(out._written)
    assert sorted(r.id for r in out.collect()) == [6, 7, 8, 9]


def _crowd(spark):
    """Two scenes with detections near and far from one another, amid very many vessels."""
    spots = [(f"s{k % 2}", k, 121.0 + (k * 37 % 40) / 2_000, 25.0 + (k * 53 % 40) / 2_000) for k in range(24)] + [(f"s{k % 2}", 100 + k, 121.25 + k / 50, 25.3) for k in range(6)]
    fixes = [(f"s{k % 2}", k, 121.0 + (k * 41 % 900) / 2_200, 25.0 + (k * 61 % 700) / 2_000, float(200 + k * 97 % 1_100), 1.0) for k in range(12_000)]
    few = [("s0", 50_000 + k, 121.65, 25.0 + k / 1e4, 900.0, 1.0) for k in range(2)]
    sea = spark.createDataFrame([*spots, *(("s0", 200 + k, 121.65, 25.0 + k / 1e3) for k in range(5))], "scene_id string, id long, lon double, lat double")
    return sea, spark.createDataFrame(fixes + few, "scene_id string, mmsi long, r_lon double, r_lat double, gate_m double, delta_s double")


def test_contested_pairs_give_the_same_assignment(spark):
    sea, fixes = _crowd(spark)
    every, needed = fusion.match_pairs(sea, fixes).cache(), fusion.contested_pairs(sea, fixes).cache()
    got, want = (sorted(tuple(r) for r in assign_one_to_one(pairs).collect()) for pairs in (needed, every))
    assert got == want and 25 <= len(want) < sea.count()
    alone = lambda pairs: pairs.filter("det_id between 100 and 199").count()
    assert 6 <= alone(needed) <= 12 < alone(every)  # without rivals the first pair is enough, or two that tie
    assert needed.count() < every.count()


def test_fixes_out_of_reach_are_left(spark):
    box = "min_lon double, min_lat double, max_lon double, max_lat double"
    scenes = spark.createDataFrame([("a", 0, 121.0, 25.0, 121.4, 25.4)], f"id string, sensed_us long, {box}")
    rows = [("block a", 1, 123.0, 25.1), ("look a", 2, 121.401, 25.1), ("look a", 3, 121.45, 25.1), ("look a", 4, 121.2, 25.2)]
    fixes = spark.createDataFrame([(*r, 300.0) for r in rows], "place string, mmsi long, r_lon double, r_lat double, gate_m double")
    blocks, looks = fusion.within_reach(fixes, fusion.sights(scenes), F.col("gate_m"))
    assert [r.mmsi for r in blocks.collect()] == [1] and sorted(r.mmsi for r in looks.collect()) == [2, 4]
