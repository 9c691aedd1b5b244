import os
import time

import pytest
from pyspark.sql import functions as F

from tidewake.sources import files, versions
from tidewake.streaming import ingest

SCENE, DETECTION, SHIP = "id string, status string", "id long, scene_id string", "mmsi long, updated_us long"


def _records(spark, scenes, detections, ships):
    return {k: spark.createDataFrame(r, s) for k, r, s in (("scene", scenes, SCENE), ("detection", detections, DETECTION), ("ship", ships, SHIP))}


def _now(spark, root):
    v = versions.current(spark, root)
    return tuple(sorted(map(tuple, versions.read(spark, root, t, v).collect())) for t in ("scenes", "detections", "ships"))


def test_import_is_all_or_nothing(spark, tmp_path):
    root = str(tmp_path / "db")
    with pytest.raises(ValueError, match="stored"):
        versions.read(spark, root, "scenes")
    first = _records(spark, [("A", "x"), ("B", "x")], [(1, "A"), (2, "B"), (3, None)], [(7, 5), (8, 5)])
    assert versions.import_records(spark, root, first)[0] == 0
    old = _now(spark, root)
    again = _records(spark, [("A", "y"), ("C", "y")], [(11, "A"), (12, "C")], [(7, 5), (8, 6), (9, 1)])
    assert versions.import_records(spark, root, again, dry_run=True) == (1, None)
    with pytest.raises(ValueError, match="1 stored"):
        versions.import_records(spark, root, again)
    broken = {**again, "ship": again["ship"].withColumn("updated_us", F.raise_error(F.lit("lost")).cast("long"))}
    with pytest.raises(Exception, match="lost"):
        versions.import_records(spark, root, broken, force=True)
    assert _now(spark, root) == old and len(versions.history(spark, root)) == 1
    n, v = versions.import_records(spark, root, again, force=True)
    new = ([("A", "y"), ("B", "x"), ("C", "y")], [(2, "B"), (3, None), (11, "A"), (12, "C")], [(7, 5), (8, 6), (9, 1)])
    got = _now(spark, root)
    assert n == 1 and v.number == 2 and got[0] == new[0] and sorted(got[1]) == sorted(new[1]) and got[2] == new[2]
    versions.roll_back(spark, root)
    assert _now(spark, root) == old


def test_writers_that_meet_and_writers_that_die(spark, tmp_path):
    root = str(tmp_path / "db")
    df = lambda n: {"t": spark.range(n)}
    base = versions.replace(spark, root, df(1))
    versions.replace(spark, root, df(2), base)
    with pytest.raises(RuntimeError, match="meanwhile"):
        versions.replace(spark, root, df(3), base)
    assert versions.read(spark, root, "t").count() == 2
    open(f"{root}/_pointers/0000000003", "w").close()
    assert versions.read(spark, root, "t").count() == 2
    v = versions.replace(spark, root, {"u": spark.range(5).limit(0)})
    assert v.number == 4 and versions.read(spark, root, "t").count() == 2 and versions.read(spark, root, "u").count() == 0
    assert versions.forget(spark, root, 2) == 1 and versions.forget(spark, root, 1) == 0 and versions.read(spark, root, "t").count() == 2


def test_land_with_another_box(spark, tmp_path):
    root = str(tmp_path / "land")
    square = lambda a, b: [(a, a), (b, a), (b, b), (a, b), (a, a)]
    land = files.with_bounds(spark.createDataFrame([(1, square(0.0, 2.0)), (2, square(5.0, 6.0))], "id long, ring array<struct<lon: double, lat: double>>"))
    versions.reload_land(spark, root, land, [(1.0, 1.0, 9.0, 9.0)])
    held = versions.read(spark, root, "land")
    assert {(r.id, r.min_lon, r.max_lon) for r in held.collect()} == {(1, 1.0, 2.0), (2, 5.0, 6.0)}
    versions.reload_land(spark, root, land, [(0.0, 0.0, 1.0, 1.0)])
    assert held.count() == 2 and {(r.id, r.min_lon, r.max_lon) for r in versions.read(spark, root, "land").collect()} == {(1, 0.0, 1.0)}


ROWS = "mmsi long, seq long, time_us long, ship_name string, ship_type int, callsign string"


def _run(spark, tmp_path, name, forget):
    stream = spark.readStream.schema(ROWS).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    out = ingest.latest_identities(stream, forget)
    done = out.writeStream.outputMode("update").foreachBatch(lambda b, n: b.write.mode("overwrite").json(f"{tmp_path}/{name}/batch={n}"))
    done.option("checkpointLocation", str(tmp_path / f"{name}-cp")).trigger(availableNow=True).start().awaitTermination(120)


@pytest.mark.parametrize("forget", [2.0, None, 3600.0])
def test_silent_vessels_are_forgotten(spark, tmp_path, forget):
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    put = lambda rows: spark.createDataFrame(rows, ROWS).coalesce(1).write.json(str(tmp_path / "in"), mode="append")
    put([(1, 1, 100, "A", 70, None), (1, 2, None, "NO TIME", None, None), (2, 3, 100, "B", None, "X")])
    _run(spark, tmp_path, "out", forget)
    time.sleep(3)
    put([(1, 4, 50, None, None, "C"), (2, 5, 200, None, 9, None)])
    _run(spark, tmp_path, "out", forget)
    got = sorted(((r.mmsi, r.updated_us, r.ship_name, r.ship_type, r.callsign) for r in spark.read.schema("mmsi long, updated_us long, ship_name string, ship_type int, callsign string").json(str(tmp_path / "out")).collect()), key=repr)
    first = [(1, 100, "A", 70, None), (2, 100, "B", None, "X")]
    assert got == sorted(first + ([(1, 50, None, None, "C"), (2, 200, None, 9, None)] if forget == 2.0 else [(2, 200, "B", 9, "X")]), key=repr)


def test_whole_days_are_dropped(spark, tmp_path):
    day = ingest._DAY
    out = str(tmp_path / "p")
    rows = spark.createDataFrame([(k, k * day + 5) for k in range(-1, 6)], "id long, time_us long").withColumn("day", F.floor(F.col("time_us") / day).cast("long"))
    for n in (0, 1):
        rows.write.partitionBy("day").parquet(f"{out}/batch={n}")
    now = 6 * day + 7
    assert ingest.drop_days(spark, out, now, 3) == 8 and ingest.drop_days(spark, out, now, 3) == 0
    left = ingest.read_positions(spark, out)
    assert sorted({r.id for r in left.collect()}) == [3, 4, 5] and sorted({r.id for r in ingest.retain(left, now, 3).collect()}) == [4, 5]
    assert os.path.isdir(f"{out}/batch=1/day=3") and not os.path.isdir(f"{out}/batch=1/day=2")
