import json

import pytest
from pyspark.sql import functions as F

from tidewake.functions import labels
from tidewake.operators import writes
from tidewake.sources import ais_json, files, registry, transfer
from tidewake.streaming import ingest


def _message(kind, body, mmsi=416000123, time="2026-07-26 10:00:01.123456789 +0000 UTC", **meta):
    return json.dumps({"MessageType": kind, "MetaData": {"MMSI": mmsi, "time_utc": time, **meta}, "Message": {kind: body}})


LINES = [
    _message("PositionReport", {"Sog": 12.5, "Cog": 90, "TrueHeading": 91, "NavigationalStatus": 0, "Latitude": 25.1, "Longitude": 121.0}),
    _message("StandardClassBPositionReport", {"UserID": 412345678, "Sog": 3, "NavigationalStatus": 5, "Latitude": 25.2, "Longitude": 121.1}, mmsi=0),
    _message("ExtendedClassBPositionReport", {"Latitude": 25.3, "Longitude": 121.2, "Name": " NAME  ", "Type": 36}),
    _message("PositionReport", {"Latitude": None, "Longitude": 121.0}),
    _message("PositionReport", {"Latitude": 25.0, "Longitude": 121.0}, time="yesterday"),
    _message("ShipStaticData", {"Name": "EVER @ A LONG SHIP NAME OVER", "Type": 70, "CallSign": "BABC"}),
    _message("StaticDataReport", {"PartNumber": False, "ReportA": {"Name": "PART A"}, "ReportB": {"ShipType": 30, "CallSign": "X"}}),
    _message("StaticDataReport", {"PartNumber": 1, "ReportA": {"Name": "PART A"}, "ReportB": {"ShipType": 30, "CallSign": "X"}}),
    _message("ShipStaticData", {"Name": "  "}),
    "not json", "{}",
]


def test_envelopes(spark):
    env = ais_json.decode(spark.createDataFrame([(x,) for x in LINES], "value string"))
    p = {(r.mmsi, r.lat): r for r in ais_json.positions(env).collect()}
    assert sorted(p) == [(412345678, 25.2), (416000123, 25.1), (416000123, 25.3)]
    assert (p[416000123, 25.1].nav_status, p[416000123, 25.1].sog, p[416000123, 25.1].time_us % 1_000_000) == (0, 12.5, 123456)
    assert p[412345678, 25.2].nav_status is None and p[416000123, 25.3].cog is None
    i = sorted(((r.ship_name, r.ship_type, r.callsign) for r in ais_json.identities(env).collect()), key=repr)
    assert i == sorted([("NAME", 36, None), ("EVER @ A LONG SHIP N", 70, "BABC"), ("PART A", None, None), (None, 30, "X")], key=repr)


def test_subscription_has_every_box():
    s = ais_json.subscription([dict(zip(registry.REGION_COLUMNS, r)) for r in registry.region_rows()], "k")
    assert len(s["BoundingBoxes"]) == 12 and s["BoundingBoxes"][0] == [[24.9, 120.7], [26.3, 122.4]] and len(s["FilterMessageTypes"]) == 5


def test_stream_writes_what_a_batch_reads(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.txt").write_text("\n".join(LINES[:5]))
    (src / "b.txt").write_text("\n".join(LINES[5:]))
    q = ingest.start_positions(ingest.envelope_stream(spark, str(src), 1), str(tmp_path / "out"), str(tmp_path / "cp"), str(tmp_path / "dead"), availableNow=True)
    q.awaitTermination()
    want = ais_json.positions(ais_json.decode(spark.createDataFrame([(x,) for x in LINES], "value string")))
    assert ingest.read_positions(spark, str(tmp_path / "out")).count() == want.count() == 3
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "dead")).collect()) == ["not json", "{}"]


MESSAGES = [(1, 1, 100, "A", 70, None), (1, 2, 90, "OLD", 1, "LATE"), (1, 3, 100, "SAME", None, None), (1, 4, 110, None, 71, "CALL"), (2, 5, 5, None, None, "Z"), (2, 6, 6, "B", None, None)]


def test_latest_identity_stream_equals_batch(spark, tmp_path):
    schema = "mmsi long, seq long, time_us long, ship_name string, ship_type int, callsign string"
    df = spark.createDataFrame(MESSAGES, schema)
    for k in range(3):
        df.filter(F.col("seq").between(2 * k + 1, 2 * k + 2)).coalesce(1).write.json(str(tmp_path / "in"), mode="append")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    q = ingest.latest_identities(stream).writeStream.outputMode("update").format("memory").queryName("ids").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    live = spark.table("ids").groupBy("mmsi").agg(F.max_by(F.struct("*"), "updated_us").alias("r")).select("r.*")
    batch = ingest.latest_identities_batch(df)
    rows = lambda d: sorted(tuple(r[c] for c in ("mmsi", "updated_us", "ship_name", "ship_type", "callsign")) for r in d.collect())
    assert rows(batch) == [(1, 110, "A", 71, "CALL"), (2, 6, "B", None, "Z")]
    assert rows(live) == rows(batch)


def test_source_health_and_small_rules(spark):
    log = [("ais", "connected", 0, None), ("ais", "message", 5, None), ("ais", "disconnected", 10, "eof"), ("ais", "connected", 20, None), ("sar", "error", 7, "boom"), ("new", "connected", 90, None)]
    df = spark.createDataFrame([(s, k, t * 1_000_000, r) for s, k, t, r in log], "source string, kind string, at_us long, reason string")
    got = {r.source: r for r in ingest.source_health(df, 100_000_000).collect()}
    assert (got["ais"].state, got["ais"].reconnects, got["ais"].lag_s, got["ais"].last_error) == ("stale", 1, 95.0, "eof")
    assert (got["sar"].state, got["new"].state, got["new"].lag_s) == ("error", "connected", None)
    assert [ingest.backoff(k) for k in (0, 1, 5, 9)] == [1.0, 2.0, 30.0, 30.0] and ingest.backoff(5, 12) == 1.0
    b = ingest.TokenBucket(1.0, 2)
    assert [b.allow("k", t) for t in (0, 0, 0, 1.0, 1.0)] == [True, True, False, True, False]
    kept = ingest.retain(spark.createDataFrame([(0,), (1,)], "time_us long"), 86_400_000_000 + 1, 1)
    assert [r.time_us for r in kept.collect()] == [1]


def test_labels(spark):
    errors = ["coverage 0.1", "HTTP 403", "Read timed out", "raised", "odd", "", None]
    df = spark.createDataFrame([(e,) for e in errors], "e string")
    assert [r[0] for r in df.select(labels.failure_reason(F.col("e"))).collect()] == ["Swath missed the box", "Imagery access rejected", "Imagery fetch timed out", "No AIS reference in window", "Analysis error", None, None]
    assert [r[0] for r in df.select(labels.is_unreachable(F.col("e"))).collect()] == [False, True, True, False, False, False, False]
    conf = spark.createDataFrame([(0.6,), (0.599,), (0.25,), (0.249,)], "c double")
    assert [r[0] for r in conf.select(labels.confidence_bucket(F.col("c"))).collect()] == ["high", "medium", "medium", "low"]
    one = spark.range(1)
    assert one.select(labels.flag_emoji(F.lit("tw"))).first()[0] == "\U0001f1f9\U0001f1fc"
    assert [one.select(labels.gap_text(F.lit(ms))).first()[0] for ms in (45 * 60_000, 65 * 60_000, 0)] == ["45M", "1H5M", "0M"]
    assert one.select(labels.redact(F.lit("key=abcdef and abc"), ["abc", "abcdef"])).first()[0] == "key=[redacted] and [redacted]"
    text = spark.createDataFrame([("2026-07-26T10:00:01+09:00",), ("2026-07-26 10:00:01.5",), ("x",), (None,)], "t string")
    us = [r[0] for r in text.select(labels.utc_micros(F.col("t"))).collect()]
    assert us[1] - us[0] == 500_000 and us[2:] == [None, None]
    cast = spark.createDataFrame([("1.9", "TRUE"), ("junk", "no"), ("", "0")], "a string, b string")
    got = cast.select(labels.optional_int(F.col("a")), labels.csv_bool(F.col("b")), labels.csv_double(F.col("a"))).collect()
    assert [tuple(r)[:2] for r in got] == [(1, True), (None, None), (None, False)] and got[1][2] != got[1][2]


def test_flags(spark):
    from tidewake.plans.routes import with_flag

    ids = [416000123, 412345678, 422123456, 271123456, 273123456, 468123456, 230123456, 248123456, 219123456, 353136000, 636123456, 538123456, 613123456, 626123456]
    none = [982320123, 992476010, 111232500, 823201234, 970123456, 972123456, 974123456, 2320123, 23201234]
    got = {r.mmsi: r.flag_iso2 for r in with_flag(spark.createDataFrame([(i,) for i in ids + none], "mmsi long"), registry.flag_table(spark)).collect()}
    assert [got[i] for i in ids] == ["TW", "CN", "IR", "TR", "RU", "SY", "FI", "MT", "DK", "PA", "LR", "MH", "CM", "GA"] and not any(got[i] for i in none)
    with pytest.raises(ValueError, match="known"):
        registry.region("atlantis")


def test_writes(spark, tmp_path):
    old = spark.createDataFrame([(1, 10, "a", None), (2, 10, "b", 5)], "k long, t long, x string, y int")
    new = spark.createDataFrame([(1, 11, None, 7), (2, 10, "late", 9), (3, 1, "c", None)], "k long, t long, x string, y int")
    rows = lambda d: sorted(map(tuple, d.collect()))
    assert rows(writes.upsert_keep(old, new, "k", "t", ["x", "y"])) == [(1, 11, "a", 7), (2, 10, "b", 5), (3, 1, "c", None)]
    assert rows(writes.upsert(old, new, "k", "t")) == [(1, 11, None, 7), (2, 10, "b", 5), (3, 1, "c", None)]
    assert rows(writes.upsert(old, new, "k")) == rows(new)
    path = str(tmp_path / "d")
    det = spark.createDataFrame([("S1", 1), ("S2", 2)], "scene_id string, id long")
    det.write.partitionBy("scene_id").parquet(path)
    writes.replace_scene(spark.createDataFrame([("S1", 9)], "scene_id string, id long"), path)
    assert sorted((r.scene_id, r.id) for r in spark.read.parquet(path).collect()) == [("S1", 9), ("S2", 2)]
    scenes = spark.createDataFrame([("S1", "r", "processing", None), ("S2", "q", "processed", None)], "id string, roi string, status string, error string")
    assert sorted((r.id, r.status) for r in writes.reap(scenes).collect()) == [("S1", "failed"), ("S2", "processed")]
    s, d = writes.delete_scenes(scenes, det, roi="r")
    assert ([r.id for r in s.collect()], [r.id for r in d.collect()]) == (["S2"], [2])
    with pytest.raises(ValueError, match="exactly one"):
        writes.delete_scenes(scenes, det)
    m = writes.StatusMessage()
    assert m.toggle(1)["active"] is False and m.post("hello", "info", None, 2)["active"] and not m.toggle(3)["active"]
    with pytest.raises(ValueError, match="level"):
        m.post("x", "loud", None, 4)


def test_transfer_round_trip(spark, tmp_path):
    scenes = spark.createDataFrame([("S1", "r", 5), ("S2", "r", 4), ("S3", "q", 1)], "id string, roi string, sensed_us long")
    det = spark.createDataFrame([(1, "S1", 7, None), (2, "S3", 8, None), (3, "S2", None, 9)], "id long, scene_id string, matched_mmsi long, candidate_mmsi long")
    ships = spark.createDataFrame([(7, "a"), (8, "b"), (9, None)], "mmsi long, ship_name string")
    out = transfer.export_records(scenes, det, ships, ["r"])
    kinds = [json.loads(r.value)["kind"] for r in out.collect()]
    assert kinds == ["meta", "scene", "scene", "detection", "detection", "ship", "ship"]
    transfer.write_records(out, str(tmp_path / "x"))
    got = transfer.read_records(spark, str(tmp_path / "x"), *(d.schema.simpleString()[7:-1].replace(":", " ") for d in (scenes, det, ships)))
    assert sorted(r.id for r in got["scene"].collect()) == ["S1", "S2"] and sorted(r.mmsi for r in got["ship"].collect()) == [7, 9]
    assert transfer.import_conflicts(scenes, got["scene"]) == 2
    spark.createDataFrame([('{"kind":"scene"}',)], "value string").write.text(str(tmp_path / "bad"))
    with pytest.raises(ValueError, match="header"):
        transfer.read_records(spark, str(tmp_path / "bad"), "id string", "id long, scene_id string", "mmsi long")


def test_catalogue_and_land_files(spark, tmp_path):
    entries = [{"id": f"e{i}", "name": f"S1A_IW_GRDH_{i}", "sensed_us": i, "footprint_wkt": "POLYGON((0 0, 2 0, 2 2, 0 2, 0 0))" if i % 2 else None} for i in range(10)]
    (tmp_path / "c.jsonl").write_text("\n".join(map(json.dumps, entries)))
    got = files.search_scenes(spark, str(tmp_path / "c.jsonl"), 1, 8, "GRDH", (1.0, 1.0, 3.0, 3.0), 2).collect()
    assert [r.id for r in got] == ["e3", "e5"]
    square = [[0, 0], [4, 0], [4, 4], [0, 4], [0, 0]]
    far = [[x + 50, y] for x, y in square]
    (tmp_path / "land.json").write_text(json.dumps({"type": "FeatureCollection", "features": [{"type": "Feature", "geometry": {"type": "Polygon", "coordinates": [r]}} for r in (square, far)]}))
    land = files.read_geojson(spark, str(tmp_path / "land.json"))
    assert sorted((r.id, r.min_lon, r.max_lat) for r in land.collect()) == [(0, 0.0, 4.0), (1, 50.0, 4.0)]
    clipped = files.clip_land(land, [(1.0, 1.0, 9.0, 2.0), (4.0, 0.0, 6.0, 6.0)]).collect()
    assert [(r.id, r.min_lon, r.max_lat) for r in clipped] == [(0, 1.0, 2.0)]
    files.write_geojson(land, str(tmp_path / "out"))
    lines = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert [x["id"] for x in lines] == [0, 1] and lines[0]["geometry"]["coordinates"] == [[[float(a), float(b)] for a, b in square]]
    assert files.retry_delay(3, None) == 8.0 and files.retry_delay(0, "7") == 7.0
