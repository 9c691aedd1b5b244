"""Queries and plans over small hand-made tables, held to brute force."""

import datetime as dt
import json
import math
import struct

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from tidewake.functions import rings
from tidewake.plans import fusion, scheduling
from tidewake.queries import QUERIES
from tidewake.sources import files, registry
from tidewake.sources.adapter import domain

_START = dt.datetime(2024, 1, 1)


def _tables(folder, events, orders=(), suppliers=range(1, 11)):
    """Base tables: events are (event_id, user_id, time_us, value), orders (key, custkey, price, date)."""
    put = lambda name, columns: pq.write_table(pa.table(columns), f"{folder}/{name}.parquet")
    stamp = lambda v: pa.array(v, pa.timestamp("us"))
    events = list(events)
    put("events", {
        "event_id": pa.array([e[0] for e in events], pa.int64()), "ts": stamp([_START + dt.timedelta(microseconds=e[2] * 240) for e in events]), "user_id": pa.array([e[1] for e in events], pa.int64()),
        "event_type": pa.array(["view"] * len(events)), "value": pa.array([float(e[3]) for e in events]), "props": pa.array(['{"k": 25}'] * len(events)),
    })
    put("customer", {"c_custkey": pa.array([1, 2], pa.int64()), "c_name": ["A", "B"], "c_nationkey": pa.array([0, 0], pa.int32()), "c_acctbal": [0.0, 0.0], "c_mktsegment": ["X", "BUILDING"]})
    keys = list(suppliers)
    put("supplier", {"s_suppkey": pa.array(keys, pa.int64()), "s_name": [f"N{k}" for k in keys], "s_nationkey": pa.array([0] * len(keys), pa.int32()), "s_acctbal": [0.0] * len(keys)})
    put("nation", {"n_nationkey": pa.array([0], pa.int32()), "n_name": ["L"], "n_regionkey": pa.array([0], pa.int32())})
    orders = list(orders)
    put("orders", {
        "o_orderkey": pa.array([o[0] for o in orders], pa.int64()), "o_custkey": pa.array([o[1] for o in orders], pa.int64()), "o_orderstatus": pa.array(["O"] * len(orders)),
        "o_totalprice": pa.array([float(o[2]) for o in orders]), "o_orderdate": stamp([o[3] for o in orders]), "o_orderpriority": pa.array(["1"] * len(orders)),
    })
    return str(folder)


def _metres(a, b):
    """Distance by the local radii at mid-latitude, in plain Python."""
    e2, mid = 0.00669437999014, math.radians((a["lat"] + b["lat"]) / 2)
    w = 1 - e2 * math.sin(mid) ** 2
    dx = 6378137 / math.sqrt(w) * math.cos(mid) * math.radians(a["lon"] - b["lon"])
    return math.hypot(dx, 6378137 * (1 - e2) / w**1.5 * math.radians(a["lat"] - b["lat"]))


def test_match_counts_meet_every_fix(spark, tmp_path):
    early = [(k, 40 + k % 7, k * 1_000_000, 0) for k in range(201, 241)]  # before the first pass, by vessels elsewhere
    data = _tables(tmp_path, [(k, k % 9, 900_000_000 + k * 7_000_000, 0) for k in range(1, 141)] + early)
    fixes, found = ([r.asDict() for r in t.collect()] for t in domain(spark, data, "ais_positions", "sar_detections"))
    want = {}
    for g in range(4):
        a, b = [r for r in found if r["id"] % 4 == g], [r for r in fixes if r["id"] % 4 == g]
        left, right = sum(any(_metres(x, y) <= 900 for y in b) for x in a), sum(any(_metres(x, y) <= 900 for x in a) for y in b)
        want[g] = (left, len(a) - left, right, len(b) - right)
    assert sum(map(sum, want.values())) == len(fixes) + len(found) and all(v[0] and v[2] and v[3] for v in want.values())
    got = QUERIES["j14_match_counts"](spark, data).collect()
    assert {r["grp"]: (r["left_hit"], r["left_miss"], r["right_hit"], r["right_miss"]) for r in got} == want


def _cost(name):
    """Processing units of one fetch of a region's imaging box."""
    r = registry.region(name)
    x0, y0, x1, y1 = (r[f"sar_{c}"] for c in ("min_lon", "min_lat", "max_lon", "max_lat"))
    width, height = round((x1 - x0) * 111320 * math.cos(math.radians((y0 + y1) / 2)) / 10), round((y1 - y0) * 111320 / 10)
    return width * height / 262144 * 2 / 3


def _reasons(spark, data):
    return {r["id"]: r["reason"] for r in QUERIES["st16_decisions"](spark, data).collect()}


def test_decisions_read_the_whole_ledger(spark, tmp_path):
    before, month = dt.datetime(2001, 6, 30), dt.datetime(2001, 7, 2)
    fix = [(1, 1, 0, 0)]
    got = _reasons(spark, _tables(tmp_path, fix, [(4, 7, 26e6, before)], range(1, 31)))
    assert {k: got[f"S{k}"] for k in (1, 3, 7, 17, 27)} == {1: "already analyzed", 3: "already running", 7: "already spent", 17: "new pass", 27: "new pass"}
    # the month leaves room for the cheaper of the two regions alone
    costs = {k: _cost(registry.REGIONS[k % 12][0]) for k in (17, 27)}
    low, high = sorted(costs, key=costs.get)
    left = (costs[low] + costs[high]) / 2
    got = _reasons(spark, _tables(tmp_path, fix, [(4, 7, 26e6, before), (6, 7, (25_000 - left) * 1e3, month)], range(1, 31)))
    assert (got["S7"], got[f"S{low}"], got[f"S{high}"]) == ("already spent", "new pass", "over ceiling")


def test_every_decision_branch(spark):
    rows = [("processed", True, 0.0, 1.0), ("processing", True, 0.0, 1.0), ("failed", True, 0.0, 1.0), (None, False, 24_990.0, 10.5), (None, False, 24_990.0, 10.0), ("failed", False, 0.0, 1.0)]
    facts = spark.createDataFrame(rows, "status string, has_pu_spend boolean, month_to_date_pu double, pu_cost double").coalesce(1)
    assert [(r["reason"], r["analyze"]) for r in scheduling.decide(facts).collect()] == [
        ("already analyzed", False), ("already running", False), ("already spent", False), ("over ceiling", False), ("new pass", True), ("retry", True),
    ]


def test_ticker_counts_the_last_analysis(spark, tmp_path):
    # S12 is the last processed pass; vessel 2 was 300 metres away from detection 1 and a kilometre from 95, vessel 3 is detection 100
    at = 900_000_000 + 12 * 90_000_000
    data = _tables(tmp_path, [(1, 2, at, 0), (95, 2, at + 60_000_000, 0), (100, 3, at, 10)], [(4, 7, 1, dt.datetime(2001, 6, 30))], range(1, 13))
    last = QUERIES["v06_ticker"](spark, data).filter("rank = 0").collect()
    assert [r["text"] for r in last] == [f"{registry.region('north_taiwan')['label']} analysis complete · 3 contacts · 2 dark"]


def _nearest(point, every):
    """Metres to the edges of rings, by fine steps along them."""
    spots = [(p[0] + k / 2000 * (q[0] - p[0]), p[1] + k / 2000 * (q[1] - p[1])) for r in every for p, q in zip(r, r[1:]) for k in range(2001)]
    return min(_metres({"lon": x, "lat": y}, {"lon": point[0], "lat": point[1]}) for x, y in spots)


def test_land_and_footprints_are_polygons(spark, tmp_path):
    triangle = [[121.0, 25.0], [121.4, 25.0], [121.0, 25.4], [121.0, 25.0]]
    outer, hole = [[121.6, 25.0], [121.8, 25.0], [121.8, 25.2], [121.6, 25.2], [121.6, 25.0]], [[121.65, 25.05], [121.65, 25.15], [121.75, 25.15], [121.75, 25.05], [121.65, 25.05]]
    shapes = [{"type": "Polygon", "coordinates": [triangle]}, {"type": "MultiPolygon", "coordinates": [[outer, hole], [[[x + 1, y] for x, y in triangle]]]}]
    (tmp_path / "land.json").write_text(json.dumps({"type": "FeatureCollection", "features": [{"type": "Feature", "geometry": g} for g in shapes]}))
    land = files.read_geojson(spark, str(tmp_path / "land.json"))
    assert sorted((r.id, len(r.ring), len(r.holes)) for r in land.collect()) == [(0, 4, 0), (1, 4, 0), (1, 5, 1)]

    # the footprint leaves out what lies above the line from (120, 25.5) to (123, 26)
    foot = [(120.0, 24.0), (123.0, 24.0), (123.0, 26.0), (120.0, 25.5), (120.0, 24.0)]
    scenes = spark.createDataFrame([("S", 0, "north_taiwan", 120.0, 24.0, 123.0, 26.0, [dict(zip(("lon", "lat"), p)) for p in foot])], "id string, sensed_us long, roi string, min_lon double, min_lat double, max_lon double, max_lat double, ring array<struct<lon: double, lat: double>>")
    spots = {
        1: (121.35, 25.35, False), 2: (121.1, 25.1, True), 3: (121.7, 25.1, False), 4: (121.62, 25.1, True), 5: (121.65000, 25.1, True), 6: (122.1, 25.1, True), 7: (120.5, 25.9, None),
        8: (121.2 + 4e-6, 25.2, True), 9: (121.2 + 2e-4, 25.2 + 2e-4, False), 10: (122.9, 25.98, False), 11: (120.1, 25.55, None),
    }
    detections = spark.createDataFrame([(k, "S", x, y, 0.5) for k, (x, y, _) in spots.items()], "id long, scene_id string, lon double, lat double, confidence double")
    got = {r["id"]: r["on_land"] for r in fusion.clip_and_mask(detections, scenes, land).collect()}
    assert got == {k: v for k, (_, _, v) in spots.items() if v is not None}

    far = detections.join(land.filter("id = 1 AND size(holes) = 1").select("ring", "holes")).select("id", rings.distance(F.col("ring"), "lon", "lat", F.col("holes")).alias("m")).collect()
    for r in far:
        x, y, _ = spots[r["id"]]
        want = 0.0 if r["id"] in (4, 5) else _nearest((x, y), [outer, hole])
        assert abs(r["m"] - want) <= max(2.0, want * 1e-3)
    assert fusion.near_boxes(detections, land, 300.0, "left_anti").count() == sum(not v for _, _, v in spots.values()) - 1

    files.write_geojson(files.clip_land(land, [(121.5, 24.9, 121.9, 25.1)]), str(tmp_path / "out"))
    (line,) = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert [sorted({tuple(p) for p in r}) for r in line["geometry"]["coordinates"]] == [[(121.6, 25.0), (121.6, 25.1), (121.8, 25.0), (121.8, 25.1)], [(121.65, 25.05), (121.65, 25.1), (121.75, 25.05), (121.75, 25.1)]]


def test_shapefile_keeps_holes(spark, tmp_path):
    outer, hole = [(0.0, 0.0), (0.0, 4.0), (4.0, 4.0), (4.0, 0.0), (0.0, 0.0)], [(1.0, 1.0), (2.0, 1.0), (2.0, 2.0), (1.0, 2.0), (1.0, 1.0)]
    body = struct.pack("<i4d2i2i", 5, 0, 0, 4, 4, 2, 10, 0, 5) + b"".join(struct.pack("<2d", *p) for p in outer + hole)
    (tmp_path / "land.shp").write_bytes(bytes(100) + struct.pack(">ii", 1, len(body) // 2) + body)
    (row,) = files.read_shapefile(spark, str(tmp_path / "land.shp"), [(0.0, 0.0, 1.0, 1.0)]).collect()
    assert [tuple(p) for p in row.ring] == outer and [[tuple(p) for p in r] for r in row.holes] == [hole]
