"""Rules held to brute force or to published values: flags, margins, footprints, filters, guards."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewake.functions import rings
from tidewake.operators import raster, spatial, writes
from tidewake.plans import fusion, routes
from tidewake.session import stable
from tidewake.sources import feeds, registry, store, transfer
from tidewake.streaming import ingest

from .test_whole_jobs import _metres

# published assignments, and identities that no ship has
FLAGS = {
    416000123: "TW", 412345678: "CN", 422123456: "IR", 271123456: "TR", 273123456: "RU", 468123456: "SY", 230123456: "FI", 248123456: "MT", 219123456: "DK", 353136000: "PA",
    636123456: "LR", 538123456: "MH", 613123456: "CM", 626123456: "GA", 201000001: "AL", 775000001: "VE", 303000001: "US", 501000001: "FR", 619000001: "CI",
    982320123: None, 992476010: None, 111232500: None, 823201234: None, 970123456: None, 972123456: None, 974123456: None, 2320123: None, 23201234: None, 217123456: None,
}


def test_flags(spark):
    rows = spark.createDataFrame([(m,) for m in FLAGS], "mmsi long")
    assert {r.mmsi: r.flag_iso2 for r in routes.with_flag(rows, registry.flag_table(spark)).collect()} == FLAGS
    every = registry.flag_rows()
    assert len({m for m, _, _ in every}) == len(every) == 292 and [m for m, _, _ in every] == sorted(m for m, _, _ in every)
    assert all(201 <= m <= 775 and len(iso) == 2 and country for m, iso, country in every)


@pytest.mark.parametrize("vessels", [0, 1, 60])
def test_margins_match_brute_force(spark, vessels):
    rng = random.Random(vessels)
    point = lambda: (121 + rng.random() * 1.2, 25 + rng.random())
    sea = [("S", k, *point()) for k in range(50)] + [("T", 99, 121.0, 25.0)]
    fixes = [("S", 500 + k, *point(), rng.choice([200.0, 900.0, 7000.0])) for k in range(vessels)]
    fixes += [("S", 900, *fixes[0][2:])] if fixes else []
    got = fusion.dark_margins(
        spark.createDataFrame(sea, "scene_id string, id long, lon double, lat double"), spark.createDataFrame(fixes, "scene_id string, mmsi long, r_lon double, r_lat double, envelope_m double")
    ).collect()
    assert len(got) == len(sea)
    place = {r[1]: {"lon": r[2], "lat": r[3]} for r in sea}
    for r in got:
        want = min(((_metres(place[r.det_id], {"lon": f[2], "lat": f[3]}) - f[4], f[1]) for f in fixes if r.scene_id == "S"), default=(None, None))
        assert r.nearest_mmsi == want[1] and (want[0] is None and r.margin_m is None or abs(r.margin_m - want[0]) < 1e-6)


def test_nearest_fix_within_the_pad_of_a_tilted_footprint(spark):
    """The nearest fix in time lies within the pad of the box but not of the ring: the next one counts."""
    ring = [(120.0, 24.0), (123.0, 27.0), (123.0, 27.1), (120.0, 24.1), (120.0, 24.0)]
    scenes = spark.createDataFrame([("S", 10_000_000, 120.0, 24.0, 123.0, 27.1, [dict(zip(("lon", "lat"), p)) for p in ring])], "id string, sensed_us long, min_lon double, min_lat double, max_lon double, max_lat double, ring array<struct<lon: double, lat: double>>")
    facts = [
        (1, 7, 10_000_001, 122.9, 24.1), (2, 7, 9_000_000, 121.5, 25.55), (3, 7, 12_000_000, 121.5, 25.5),  # the second is nearer than the third
        (4, 8, 9_000_000, 121.5, 25.5), (5, 8, 11_000_000, 121.5, 25.5), (6, 8, 9_000_000, 121.4, 25.4),  # equally far: the earlier, then the smaller id
        (7, 9, 10_000_000, 122.9, 24.1), (8, 11, 9_999_999_999, 121.5, 25.5),  # never within the pad; too late
    ]
    rows = spark.createDataFrame([(*f, 5.0, 90.0) for f in facts], "id long, mmsi long, time_us long, lon double, lat double, sog double, cog double")
    got = fusion.nearest_fixes(rows, scenes).collect()
    assert {r.mmsi: r.id for r in got} == {7: 2, 8: 4}


def test_cells_do_not_lose_facts(spark):
    rng = random.Random(5)
    facts = [(k, k % 5, rng.randrange(0, 4_000), rng.uniform(-179, 179), rng.uniform(-80, 80)) for k in range(400)]
    boxes = [(i, rng.randrange(0, 4_000), x, y, x + 30.0, y + 25.0) for i, (x, y) in enumerate((rng.uniform(-170, 130), rng.uniform(-75, 50)) for _ in range(12))]
    f = spark.createDataFrame(facts, "id long, mmsi long, time_us long, lon double, lat double")
    i = spark.createDataFrame(boxes, "scene int, sensed_us long, x0 double, y0 double, x1 double, y1 double")
    keep = F.col("lon").between(F.col("x0"), F.col("x1")) & F.col("lat").between(F.col("y0"), F.col("y1"))
    got = spatial.nearest_in_time(f, i, "mmsi", 1_000, "scene", keep, ("x0", "y0", "x1", "y1"), 1_000.0, 2.0).collect()
    want = {}
    for s, at, x0, y0, x1, y1 in boxes:
        for k, m, t, x, y in facts:
            if abs(t - at) <= 1_000 and x0 <= x <= x1 and y0 <= y <= y1:
                want[s, m] = min(want.get((s, m), (math.inf,)), (abs(t - at), t, k))
    assert {(r.scene, r.mmsi): r.id for r in got} == {k: v[2] for k, v in want.items()} and len(want) > 10


def test_speckle_filter_weighs_by_the_variance_of_the_image():
    a = np.random.default_rng(3).gamma(1.0, 0.05, (23, 31))
    a[10:13, 14:17] += 3
    pad = np.pad(a, 2, mode="edge")
    want = np.empty_like(a)
    for y in range(a.shape[0]):
        for x in range(a.shape[1]):
            w = pad[y : y + 5, x : x + 5]
            want[y, x] = w.mean() + w.var() / (w.var() + a.var()) * (a[y, x] - w.mean())
    assert np.allclose(raster.lee_filter(a, 5), want, atol=1e-9)


def test_imports_are_guarded(spark):
    old, new = (spark.createDataFrame([(k,) for k in ids], "id string") for ids in (["a", "b"], ["b", "c"]))
    with pytest.raises(ValueError, match="replace 1 "):
        transfer.guard_import(old, new)
    assert transfer.guard_import(old, new, force=True) == (1, True) and transfer.guard_import(old, new, dry_run=True) == (1, False)
    assert transfer.guard_import(old.limit(0), new) == (0, True)


def test_the_stored_table_follows_its_input(spark, tmp_path):
    def fuse(n):
        d = spark.createDataFrame([(k, f"S{k % 3}") for k in range(n)], "id long, scene_id string")
        return fusion.Fused(stable(d), d.select("scene_id").distinct())

    (tmp_path / "t.parquet").write_bytes(b"1")
    a = store.stored(spark, str(tmp_path), lambda: fuse(7))
    assert store.stored(spark, str(tmp_path), lambda: fuse(9)).detections.count() == a.detections.count() == 7
    (tmp_path / "t.parquet").write_bytes(b"22")
    assert store.stored(spark, str(tmp_path), lambda: fuse(9)).detections.count() == 9


def test_polygon_texts(spark):
    texts = {
        "POLYGON((0 0, 4 0, 4 4, 0 4, 0 0), (1 1, 2 1, 2 2, 1 1))": [(5, 1)], "SRID=4326;MULTIPOLYGON(((0 0,1 0,1 1,0 0)),((5 5,7 5,7 7.5,5 5),(6 6,6.5 6,6.5 6.2,6 6)))": [(4, 0), (4, 1)],
        "POLYGON Z((0 0 9, 1 0 9, 1 1 9, 0 0 9))": [(4, 0)], "POINT(1 2)": None, "": None,
    }
    rows = spark.createDataFrame([(t,) for t in texts] + [(None,)], "t string")
    got = {r.t: r.p for r in rows.select("t", rings.parse_polygons(F.col("t")).alias("p")).collect()}
    assert {t: p and [(len(x[0]), len(x) - 1) for x in p] for t, p in got.items()} == {**texts, None: None}
    open_ring = spark.createDataFrame([([(0.0, 0.0), (2.0, 0.0), (2.0, 0.0), (2.0, 2.0)],), ([(0.0, 0.0), (1.0, 1.0), (0.0, 0.0)],)], f"r {rings.RING}")
    tidy = [r.r for r in open_ring.select(rings.tidy(F.col("r")).alias("r")).collect()]
    assert [tuple(p) for p in tidy[0]] == [(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 0.0)] and tidy[1] is None


def test_a_feed_that_breaks_waits_and_goes_on(tmp_path):
    waits, now = [], [0.0]
    r = feeds.FeedReader({"path": str(tmp_path / "f"), "rows": "2"}, waits.append, lambda: now[0])
    at = r.initialOffset()
    for _ in range(3):
        rows, at = r.read(at)
        assert list(rows) == [] and at == {"byte": 0}
    (tmp_path / "f").write_text("a\nb\nc\n")
    rows, at = r.read(at)
    assert [x for (x,) in rows] == ["a", "b"]
    now[0] = 60.0
    (tmp_path / "f").rename(tmp_path / "g")
    assert r.read(at)[1] == at and waits == [1.0, 2.0, 4.0, 1.0]
    (tmp_path / "g").rename(tmp_path / "f")
    rows, end = r.read(at)
    assert [x for (x,) in rows] == ["c"] == [x for (x,) in r.readBetweenOffsets(at, end)]


def test_binary_columns_travel_and_the_header_comes_first(spark, tmp_path):
    scenes = spark.createDataFrame([("S1", "r", 5, bytes(range(256))), ("S2", "r", 4, None)], "id string, roi string, sensed_us long, overview_png binary")
    none = spark.createDataFrame([], "id long, scene_id string, matched_mmsi long, candidate_mmsi long")
    ships = spark.createDataFrame([], "mmsi long, ship_name string")
    shapes = [", ".join(f"{n} {t}" for n, t in d.dtypes) for d in (scenes, none, ships)]
    transfer.write_records(transfer.export_records(scenes, none, ships, ["r"]), str(tmp_path / "x"))
    back = transfer.read_records(spark, str(tmp_path / "x"), *shapes)["scene"]
    assert {r.id: r.overview_png and bytes(r.overview_png) for r in back.collect()} == {"S1": bytes(range(256)), "S2": None}
    (tmp_path / "y").mkdir()
    (tmp_path / "y" / "part-0.txt").write_text('{"kind":"scene","id":"S9"}\n{"kind":"meta","version":1}\n')
    with pytest.raises(ValueError, match="header"):
        transfer.read_records(spark, str(tmp_path / "y"), *shapes)


def test_values_live_for_a_while():
    cache, made = ingest.TtlCache(10), []
    for now in (0, 9.9, 10, 19):
        cache.get("k", now, lambda: made.append(1))
    assert len(made) == 2


def test_status_row_is_the_fold_of_its_commands(spark):
    rng = random.Random(6)
    for n in (0, 1, 2, 7, 30):
        log = [(k, rng.choice(["post", "toggle", "toggle", "clear"]), f"m{k}", "info", None, 100 + k) for k in range(n)]
        fold = writes.StatusMessage()
        for k, command, message, level, title, at in log:
            fold.post(message, level, title, at) if command == "post" else fold.toggle(at) if command == "toggle" else fold.clear(at)
        (got,) = writes.status_of(spark.createDataFrame(log, "seq long, command string, message string, level string, title string, at_us long")).collect()
        assert {k: got[k] for k in ("message", "level", "title", "active", "updated_us")} == fold.row
