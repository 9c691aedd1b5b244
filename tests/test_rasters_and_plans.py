import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewake.operators import raster
from tidewake.plans import fusion, scheduling

HOUR = scheduling.HOUR


def test_tiles_cover_and_end_flush(spark):
    df = spark.createDataFrame([("a", 800, 2000), ("b", 300, 300), ("c", 801, 1600)], "scene_id string, width long, height long")
    got = {}
    for r in raster.tiles(df, 800, 160).collect():
        got.setdefault(r.scene_id, set()).add((r.x_off, r.y_off))
    assert got["a"] == {(0, 0), (0, 640), (0, 1200)} and got["b"] == {(0, 0)}
    assert got["c"] == {(x, y) for x in (0, 1) for y in (0, 640, 800)}


def test_merge_by_overlap_and_distance(spark):
    b = pd.DataFrame([(0, 0, 20, 20, 0.9), (2, 2, 22, 22, 0.8), (12, 0, 14, 2, 0.7), (40, 40, 60, 60, 0.6), (100, 100, 300, 300, 0.5)], columns=["x1", "y1", "x2", "y2", "confidence"])
    assert raster.merge_boxes(b)["confidence"].tolist() == [0.9, 0.6, 0.5]
    rng = np.random.default_rng(1)
    xy = rng.uniform(0, 200, (120, 2))
    many = pd.DataFrame({"x1": xy[:, 0], "y1": xy[:, 1], "x2": xy[:, 0] + rng.uniform(4, 30, 120), "y2": xy[:, 1] + rng.uniform(4, 30, 120), "confidence": rng.permutation(120) / 120})
    keep = []
    for r in many.sort_values("confidence", ascending=False).itertuples(index=False):
        if all(raster.iou(r, k) < 0.5 and np.hypot((r[0] + r[2] - k[0] - k[2]) / 2, (r[1] + r[3] - k[1] - k[3]) / 2) >= 15 for k in keep):
            keep.append(r)
    assert raster.merge_boxes(many)["confidence"].tolist() == [k.confidence for k in keep]
    df = spark.createDataFrame(many.assign(scene_id="s"))
    assert raster.suppress(df).count() == len(keep)


def test_detection_over_tiles(spark):
    chip = np.zeros((2000, 800), np.uint8)
    chip[700:720, 100:120] = 250
    rows = [("s", x, y, 800, 800, chip[y : y + 800, x : x + 800].tobytes()) for x, y in ((0, 0), (0, 640), (0, 1200))]
    got = raster.detect(spark.createDataFrame(rows, "scene_id string, x_off long, y_off long, w int, h int, pixels binary")).collect()
    assert [(r.x1, r.y1, r.x2, r.y2) for r in got] == [(100.0, 700.0, 120.0, 720.0)]


def test_arrays():
    db = np.array([[-25.0, 0.0, -12.5, np.nan, 5.0]])
    assert raster.to_uint8(db).tolist() == [[0, 255, 128, 0, 255]]
    p = np.arange(256, dtype=np.uint8).reshape(16, 16)
    assert (raster.restretch(p, (-25, 0), (-25, 0)) == p).all()
    with pytest.raises(ValueError, match="inside"):
        raster.restretch(p, (-25, 0), (-30, 0))
    a = np.random.default_rng(2).random((9, 11))
    padded = np.pad(a, 1, mode="edge")
    want = sum(padded[i : i + 9, j : j + 11] for i in range(3) for j in range(3)) / 9
    assert np.allclose(raster.box_mean(a, 3), want)
    assert np.allclose(raster.lee_filter(np.ones((6, 6))), 1)
    assert raster.max_pool(np.arange(35, dtype=np.uint8).reshape(5, 7), 3).tolist() == [[16, 19, 20], [30, 33, 34]]
    assert raster.stitch([(0, 0, np.ones((1, 2))), (2, 0, np.full((1, 1), 5.0))], 3, 1).tolist() == [[1, 1, 5]]
    v, m = raster.split_mask(np.zeros((2, 2, 2)))
    assert v.shape == m.shape == (2, 2) and raster.split_mask(np.zeros((2, 2)))[1] is None


def test_calibration():
    lines, pix, val = np.array([0, 10]), [np.array([0, 4]), np.array([0, 4])], [np.array([1.0, 5.0]), np.array([2.0, 6.0])]
    lut = raster.expand_lut(lines, pix, val, 13, 6)
    assert lut[0].tolist() == [1, 2, 3, 4, 5, 5] and lut[5, 0] == 1.5 and lut[12, 0] == pytest.approx(2.2)
    out = raster.calibrate(np.array([[0, 10]]), np.array([[1.0, 1.0]]))
    assert np.isnan(out[0, 0]) and out[0, 1] == 20.0


def test_label_windows(spark):
    labels = spark.createDataFrame([("s", 10.0, 10.0, 5.0, 5.0, 15.0, 15.0, True), ("s", 150.0, 20.0, 146.0, 16.0, 154.0, 24.0, False), ("s", 100.0, 5.0, 96.0, 1.0, 104.0, 9.0, True)], "scene_id string, col double, row double, x1 double, y1 double, x2 double, y2 double, keep boolean")
    windows = spark.createDataFrame([("s", 0, 0), ("s", 100, 0)], "scene_id string, x_off long, y_off long")
    got = raster.labels_in_windows(labels, windows, 100).collect()
    assert [(r.x_off, [(b.cx, b.w) for b in r.boxes]) for r in got] == [(0, [(0.1, 0.1)])]
    chips = spark.createDataFrame([(i, i < 6) for i in range(40)], "chip_id long, positive boolean")
    assert raster.cap_backgrounds(chips, 0.25).count() == 8
    assert raster.cap_backgrounds(chips, 0.9).count() == 40 and raster.cap_backgrounds(chips.filter("not positive"), 0.25).count() == 0
    split = raster.hold_out(chips, "chip_id", 0.5).groupBy("split").count().collect()
    assert {r["split"] for r in split} == {"train", "val"}


def test_first_by_is_the_sorted_head(spark):
    rows = [(i, (i * 2654435761) % (1 << 52) if i % 5 else 7 + (3 << 20)) for i in range(400)] + [(i, (9 << 36) + (i << 3)) for i in range(400, 600)]
    df = spark.createDataFrame(rows, "id long, at long")
    in_order = [i for _, i in sorted((at, i) for i, at in rows)]
    for keep in (0, 1, 40, 79, 80, 81, 333, 500, 600, 1000):
        got = raster.first_by(df, F.col("at"), "id", spark.createDataFrame([(keep,)], "_keep long"))
        assert got.columns == ["id", "at"] and {r.id for r in got.collect()} == set(in_order[:keep])
    assert raster.first_by(df.limit(0), F.col("at"), "id", spark.createDataFrame([(3,)], "_keep long")).count() == 0


def test_cost_totals_have_a_row_for_all(spark):
    scenes = spark.createDataFrame([("a", "x", 0.0, 0.0, 1.0, 1.0), ("b", "x", 0.0, 0.0, 0.5, 0.5), ("c", "y", 0.0, 60.0, 0.0, 60.0)], "id string, roi string, min_lon double, min_lat double, max_lon double, max_lat double")
    costs = scheduling.pass_costs(scenes)
    assert {r.id: (r.width, r.height, r.tiles) for r in costs.collect()}["c"] == (1, 1, 1)
    monthly = spark.createDataFrame([("x", 10.0), ("z", 5.0)], "name string, pu_month double")
    got = {r.roi: (r.passes, r.pu_month) for r in scheduling.cost_totals(costs, monthly).collect()}
    assert got == {"x": (2, 10.0), "y": (1, None), None: (3, 15.0)}


def test_next_pass_rules(spark):
    df = spark.createDataFrame([("a", 0), ("a", 10), ("a", 10), ("a", 30), ("b", 0), ("b", 5)], "roi string, sensed_us long")
    got = {r.roi: r.next_us for r in scheduling.next_pass(df, 44).collect()}
    assert got == {"a": 45 + 3 * HOUR, "b": None}
    assert {r.roi: r.next_us for r in scheduling.next_pass(df, 45).collect()}["a"] == 60 + 3 * HOUR


def test_gap_buckets_and_gates(spark):
    assert [scheduling.gap_buckets(*x) for x in ((6, 60), (6, 50), (0, 60), (6, 0))] == [6, 8, 0, 0]
    now = 100 * HOUR

    def gate(lo, hi, gap):
        h = spark.createDataFrame([tuple(None if x is None else int(now - x * HOUR) for x in (lo, hi, gap))], "min_us long, max_us long, last_gap_end_us long")
        r = scheduling.survey_gate(scheduling.fused_gate(h, now), now, now - 2 * HOUR).first()
        return r.fused_ready, r.survey_ready

    assert gate(None, None, None) == (False, False)
    assert gate(9, 0.1, None) == (True, True)
    assert gate(9, 1.5, None) == (False, True)
    assert gate(9, 0.1, 3) == (False, True)
    assert gate(9, 0.1, 6) == (True, True)
    positions = spark.createDataFrame([(now - int(h * HOUR),) for h in (0.5, 1.0, 1.5, 2.5, 5.5, 4.2)], "time_us long")
    assert scheduling.ais_health(positions, now).first().last_gap_end_us == now - 3 * HOUR
    edge = positions.filter(F.col("time_us") != now - int(1.5 * HOUR))  # a fix exactly an hour old is in the newest bucket
    assert scheduling.ais_health(edge, now).first().last_gap_end_us == now - HOUR


def test_coverage_and_targets(spark):
    w = "POLYGON((0 0, {0} 0, {0} 10, 0 10, 0 0))"
    scenes = [("r", "a", 0, w.format(9)), ("r", "b", 300_000_000, "SRID=4326;" + w.format(4)), ("r", "c", 9 * HOUR, w.format(5)), ("r", "d", 12 * HOUR, None)]
    df = spark.createDataFrame(scenes, "roi string, id string, sensed_us long, footprint_wkt string")
    boxes = spark.createDataFrame([("r", 0.0, 0.0, 10.0, 10.0)], "name string, sar_min_lon double, sar_min_lat double, sar_max_lon double, sar_max_lat double")
    cov = scheduling.coverage(scheduling.mosaics(df), boxes)
    assert {r.anchor: round(r.coverage, 6) for r in cov.collect()} == {"a": 0.9, "b": 0.4, "c": 0.5, "d": 0.0}
    t = scheduling.target_scene(cov, 13 * HOUR).first()
    assert t.target == "a" and round(t.best_coverage, 6) == 0.9
    ok = spark.range(1).select(*(fusion.coverage_ok(F.lit(10 * HOUR), F.lit(a * HOUR), F.lit(b * HOUR), 2.0) for a, b in ((8, 12), (9, 12), (8, 11)))).first()
    assert tuple(ok) == (True, False, False)


def test_spans_are_near_equal(spark):
    for total, most in ((5407, 2400), (2400, 2400), (1, 2400), (7201, 2400)):
        s = spark.range(1).select(scheduling.spans(F.lit(total), most).alias("s")).first().s
        assert sum(x.length for x in s) == total and max(x.length for x in s) <= most and max(x.length for x in s) - min(x.length for x in s) <= 1
        assert [x.offset for x in s] == [sum(y.length for y in s[:k]) for k in range(len(s))]


def test_views(spark):
    from tidewake.plans import views

    now = 10 * HOUR
    rows = [("analyzing", None), ("warming_up", now + HOUR), ("scheduled", now + 26 * HOUR), ("scheduled", now + 5_400_000_000), ("scheduled", now + 60_000_000), ("awaiting_publication", now), ("unknown", None)]
    df = spark.createDataFrame(rows, "state string, next_us long")
    got = [r[0] for r in df.select(views.region_status(F.col("state"), F.col("next_us"), now)).collect()]
    assert got == ["Analyzing", "AIS warm-up", "1d 2h", "1h 30m", "1m 0s", "Due", "Due"]
    v = spark.createDataFrame([(1, 70), (2, 30), (3, None)], "mmsi long, ship_type int")
    d = spark.createDataFrame([(1, None, "matched"), (None, 2, "indeterminate"), (None, 3, "dark")], "matched_mmsi long, candidate_mmsi long, match_state string")
    ids = lambda f: sorted(r.mmsi for r in f.collect())
    assert ids(views.visible_vessels(v, d, "fused", False)) == [1, 2] and ids(views.visible_vessels(v, None, "fused", True)) == [1]
    assert ids(views.visible_vessels(v, None, "fused", False)) == [1, 2, 3] and ids(views.visible_vessels(v, d, "survey", False)) == []
    one = spark.range(1).select(views.sighting_label(F.lit(True)), views.gap_flagged(F.lit(1)), views.gap_flagged(F.lit(2))).first()
    assert tuple(one) == ("MATCH", False, True)


def test_feed_and_tiles(spark, tmp_path):
    import json

    from tidewake.sources import feeds

    lines = [json.dumps({"MessageType": "PositionReport", "MetaData": {"latitude": lat, "longitude": 121.0}}) for lat in (25.0, 25.1, 60.0, 25.2)] + ["junk"]
    (tmp_path / "feed.jsonl").write_text("\n".join(lines))
    spark.dataSource.register(feeds.FeedSource)
    stream = spark.readStream.format("message_feed").option("path", str(tmp_path / "feed.jsonl")).option("rows", "2").option("boxes", "[[[24.9, 120.7], [26.3, 122.4]]]").load()
    q = stream.writeStream.format("memory").queryName("feed").option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="0 seconds").start()
    try:
        for _ in range(100):
            q.processAllAvailable()
            if spark.table("feed").count() >= 3:
                break
    finally:
        q.stop()
    assert spark.table("feed").count() == 3

    tries = []

    def fetch(r):
        tries.append(r["x_off"])
        if len(tries) == 1:
            raise feeds.BusyError("0")
        return bytes([r["x_off"]])

    plan = spark.createDataFrame([("s", k, 0, 1, 1) for k in range(6)], "scene_id string, x_off int, y_off int, w int, h int")
    got = feeds.fetch_tiles(plan, fetch, 2, wait=lambda s: None).collect()
    assert sorted((r.x_off, bytes(r.pixels)) for r in got) == [(k, bytes([k])) for k in range(6)]


def test_sinks_and_lookup(spark, tmp_path):
    r = raster.stripes(spark.createDataFrame([("a", 5000)], "id string, height int"), 2048).collect()
    assert [(x.y_off, x.h) for x in r] == [(0, 2048), (2048, 2048), (4096, 904)]
    chips = spark.createDataFrame([("c1", "train", b"p", [(0.5, 0.5, 0.1, 0.2)]), ("c2", "val", b"q", [])], "chip_id string, split string, pixels binary, boxes array<struct<cx: double, cy: double, w: double, h: double>>")
    raster.write_chips(chips, str(tmp_path / "chips"))
    back = {x.chip_id: x.labels for x in spark.read.parquet(str(tmp_path / "chips")).collect()}
    assert back == {"c1": "0 0.500000 0.500000 0.100000 0.200000", "c2": ""}
    known = spark.createDataFrame([("d/S1A_X.SAFE", "sc1")], "GRD_product_identifier string, scene_id string")
    found = raster.scene_for_product(spark.createDataFrame([("S1A_X.SAFE.zip",), ("S1B",)], "product string"), known)
    assert {x.product: x.scene_id for x in found.collect()} == {"S1A_X.SAFE.zip": "sc1", "S1B": None}
