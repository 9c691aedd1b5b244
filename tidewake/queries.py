"""Queries over the test tables for the engine's operators, each with its SQL where it has one.

``QUERIES`` maps a name to a function of (session, folder); ``ORACLES`` holds the equivalent
DuckDB text over the same tables.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewake import oracle_text as sql
from tidewake.functions import geo, labels
from tidewake.operators.assign import assign_one_to_one
from tidewake.operators.spatial import match_counts, near_boxes, within_distance
from tidewake.params import DEFAULT as P
from tidewake.plans import fusion, routes, scheduling, views
from tidewake.session import stable
from tidewake.sources import registry, store
from tidewake.sources.adapter import domain, oracle
from tidewake.sources.registry import NAV_STATUS, REGION_COLUMNS, SHIP_TYPES, flag_rows, region_rows, values_sql

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

NOW = 10_800_000_000
LEDGER_NOW = 995_587_200_000_000
ROI = "north_taiwan"
_BOX = ("min_lon", "min_lat", "max_lon", "max_lat")
_TAIWAN = registry.region(ROI)
_IN = geo.strictly_in_box("lon", "lat", tuple(_TAIWAN[f"ais_{c}"] for c in _BOX))
_MODES = values_sql([(r[0], r[10]) for r in region_rows()], ("roi", "mode"))
_REGIONS = values_sql(region_rows(), REGION_COLUMNS)
_FLAGS = values_sql(flag_rows(), ("mid", "flag_iso2", "flag_country"))


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return put


def _d(*names):
    """Decorator: pass the named domain tables; to a fusion's queries, footprints by box and tilt."""

    def wrap(f):
        return lambda spark, sf_dir: f(spark, *domain(spark, sf_dir, *names, sheared=names == _DOMAIN))

    return wrap


def _r(c: str, n: int) -> F.Column:
    return F.round(F.col(c), n).alias(c)


# reads ------------------------------------------------------------------------------------------


@query("s24_regions", oracle(f" SELECT r.*, (SELECT count(*) FROM sar_scenes s WHERE s.roi = r.name) AS scenes FROM {_REGIONS} r", "sar_scenes"))
@_d("sar_scenes")
def _regions(spark, scenes):
    taken = scenes.groupBy(F.col("roi").alias("name")).agg(F.count("*").alias("scenes"))
    return registry.regions(spark).join(taken, "name", "left").withColumn("scenes", F.coalesce("scenes", F.lit(0)))


@query("p03_vessel_count", oracle(f" SELECT count(DISTINCT mmsi) AS vessels FROM ais_positions WHERE time_us > {NOW - 14_400_000_000} AND {_IN}", "ais_positions"))
@_d("ais_positions")
def _count(spark, positions):
    return routes.vessel_count(positions, ROI, NOW)


@query("j08_vessels", oracle(f""" SELECT n.id, n.mmsi, n.time_us, n.lon, n.lat, n.sog, n.cog, n.true_heading, n.nav_status, m.ship_name, m.ship_type, m.callsign, f.flag_iso2, f.flag_country
FROM (SELECT *, row_number() OVER (PARTITION BY mmsi ORDER BY abs(time_us - 5000000000), time_us, id) AS rn FROM ais_positions WHERE abs(time_us - 5000000000) <= 1800000000 AND {_IN}) n
LEFT JOIN ship_metadata m ON m.mmsi = n.mmsi LEFT JOIN {_FLAGS} f ON length(n.mmsi::VARCHAR) = 9 AND f.mid = n.mmsi // 1000000 WHERE rn = 1""", "ais_positions", "ship_metadata"))
@_d("ais_positions", "ship_metadata")
def _vessels(spark, positions, ships):
    return routes.vessels(positions, ships, registry.flag_table(spark), ROI, 5_000_000_000, 30)


_ONE = (201 + 7 * 7919 % 574) * 1_000_000 + 7


@query("t01_track", oracle(f" SELECT p.mmsi, time_us, lon, lat, sog, cog, ship_name, ship_type FROM ais_positions p LEFT JOIN ship_metadata m ON m.mmsi = p.mmsi WHERE p.mmsi = {_ONE} AND time_us > {NOW - 7_200_000_000} ORDER BY time_us", "ais_positions", "ship_metadata"))
@_d("ais_positions", "ship_metadata")
def _track(spark, positions, ships):
    return routes.track(positions, ships, _ONE, NOW, 2)


@query("s26_snapshot", oracle(f" SELECT id, mmsi, time_us, lon, lat FROM ais_positions WHERE time_us BETWEEN 3200000000 AND 6800000000 AND {_IN}", "ais_positions"))
@_d("ais_positions")
def _snapshot(spark, positions):
    return routes.snapshot(positions, ROI, 5_000_000_000, 0.5).select("id", "mmsi", "time_us", "lon", "lat")


def _bin(v: str, lo: float, hi: float) -> str:
    return f"(CASE WHEN {v} < {lo!r}e0 THEN 0 WHEN {v} >= {hi!r}e0 THEN 6 ELSE cast(floor(({v} - {lo!r}e0) / ({hi!r}e0 - {lo!r}e0) * 5e0) AS BIGINT) + 1 END)"


@query("a17_density", oracle(f" SELECT {_bin('lon', 120.90, 122.20)}::BIGINT AS lon_bin, {_bin('lat', 24.95, 25.60)}::BIGINT AS lat_bin, count(DISTINCT mmsi) AS vessels FROM ais_positions GROUP BY 1, 2", "ais_positions"))
@_d("ais_positions")
def _density(spark, positions):
    return routes.density(positions, ROI)


@query("a18_continuity", oracle(f""", b AS (SELECT DISTINCT mmsi, cast(floor((time_us - {NOW - 21_600_000_000}) * 30 / 21600000000e0) AS INT) AS bin FROM ais_positions),
s AS (SELECT *, bin - coalesce(lag(bin) OVER (PARTITION BY mmsi ORDER BY bin), -1) - 1 AS gap FROM b WHERE bin BETWEEN 0 AND 29)
SELECT mmsi, count(*) AS filled, greatest(max(gap), 29 - max(bin)) AS longest, cast(greatest(max(gap), 29 - max(bin)) * 720000 AS BIGINT) AS gap_ms FROM s GROUP BY mmsi""", "ais_positions"))
@_d("ais_positions")
def _continuity(spark, positions):
    return routes.continuity(positions, NOW)


# fusion -----------------------------------------------------------------------------------------

_CHANCE_U1 = "((sea.id * 7919 + k * 104729) % 10007 / 1.0007e4)"
_CHANCE_U2 = "((sea.id * 6007 + k * 15485863) % 9973 / 9.973e3)"
_FUSE = f""", sc AS (SELECT s.*, coalesce(m.mode, 'fused') AS mode FROM sar_scenes s LEFT JOIN {_MODES} m ON m.roi = s.roi),
fs AS (SELECT * FROM sc WHERE mode = 'fused'),
ins AS (SELECT d.* FROM sar_detections d JOIN sc ON sc.id = d.scene_id WHERE {sql.in_foot('d.lon', 'd.lat', 'sc')}),
ev AS (SELECT ins.*, EXISTS (SELECT 1 FROM land_polygons l WHERE {sql.off_land('ins.lon', 'ins.lat')} <= 1e0) AS on_land FROM ins),
sea AS (SELECT ev.* FROM ev JOIN fs ON fs.id = ev.scene_id WHERE NOT on_land),
f0 AS (SELECT fs.id AS scene_id, fs.sensed_us, p.mmsi, p.time_us, p.lon, p.lat, p.sog, p.cog,
       row_number() OVER (PARTITION BY fs.id, p.mmsi ORDER BY abs(p.time_us - fs.sensed_us), p.time_us, p.id) AS rn
       FROM fs JOIN ais_positions p ON p.time_us BETWEEN fs.sensed_us - 1800000000 AND fs.sensed_us + 1800000000
       WHERE {sql.off_foot('p.lon', 'p.lat', 'fs')} <= 30000e0),
f1 AS (SELECT *, (sensed_us - time_us) / 1e6 AS lead_s, sog * 0.514444e0 * ((sensed_us - time_us) / 1e6) AS step FROM f0 WHERE rn = 1),
f2 AS (SELECT *, {sql.moved_lat('lat', 'step', 'radians(cog)')} AS new_lat FROM f1),
dr AS (SELECT scene_id, mmsi, sog, -lead_s AS delta_s,
       CASE WHEN sog IS NULL OR cog IS NULL OR sog < 0.5e0 THEN lon ELSE {sql.moved_lon('lon', 'lat', 'new_lat', 'step', 'radians(cog)')} END AS r_lon,
       CASE WHEN sog IS NULL OR cog IS NULL OR sog < 0.5e0 THEN lat ELSE new_lat END AS r_lat,
       200e0 + 90e0 * coalesce(sog, 0e0) * 0.514444e0 AS gate_m,
       200e0 + 90e0 * coalesce(sog, 0e0) * 0.514444e0 + 0.25e0 * coalesce(sog, 0e0) * 0.514444e0 * abs(lead_s) AS envelope_m FROM f2),
dist AS (SELECT sea.scene_id, sea.id AS det_id, dr.mmsi, dr.delta_s, dr.gate_m, dr.envelope_m, {sql.metres('dr.r_lon', 'dr.r_lat', 'sea.lon', 'sea.lat')} AS distance_m FROM sea JOIN dr ON dr.scene_id = sea.scene_id),
pairs AS (SELECT * FROM dist WHERE distance_m <= gate_m),
ordered AS (SELECT *, row_number() OVER (PARTITION BY scene_id ORDER BY distance_m, det_id, mmsi) AS k FROM pairs),
walk AS (SELECT DISTINCT scene_id, 0::BIGINT AS k, []::BIGINT[] AS ds, []::BIGINT[] AS vs, NULL::BIGINT AS det_id, NULL::BIGINT AS mmsi, NULL::DOUBLE AS distance_m, NULL::DOUBLE AS delta_s, false AS won FROM ordered
  UNION ALL SELECT o.scene_id, o.k, CASE WHEN list_contains(w.ds, o.det_id) OR list_contains(w.vs, o.mmsi) THEN w.ds ELSE list_append(w.ds, o.det_id) END,
  CASE WHEN list_contains(w.ds, o.det_id) OR list_contains(w.vs, o.mmsi) THEN w.vs ELSE list_append(w.vs, o.mmsi) END, o.det_id, o.mmsi, o.distance_m, o.delta_s,
  NOT (list_contains(w.ds, o.det_id) OR list_contains(w.vs, o.mmsi)) FROM walk w JOIN ordered o ON o.scene_id = w.scene_id AND o.k = w.k + 1),
assigned AS (SELECT scene_id, det_id, mmsi, distance_m, delta_s FROM walk WHERE won),
margins AS (SELECT sea.scene_id, sea.id AS det_id, x.margin_m, x.mmsi AS nearest_mmsi FROM sea LEFT JOIN (
  SELECT det_id, mmsi, distance_m - envelope_m AS margin_m, row_number() OVER (PARTITION BY det_id ORDER BY distance_m - envelope_m, mmsi) AS rn FROM dist) x ON x.det_id = sea.id AND x.rn = 1),
per AS (SELECT scene_id, greatest(1, 750 // count(*)) AS per FROM sea GROUP BY 1),
pr0 AS (SELECT sea.scene_id, sea.lon, sea.lat, {_CHANCE_U1} * 4000e0 AS m, {_CHANCE_U2} * 2e0 * pi() AS az FROM sea JOIN per ON per.scene_id = sea.scene_id, LATERAL (SELECT unnest(generate_series(1, per.per)) AS k) g),
pr1 AS (SELECT *, {sql.moved_lat('lat', 'm', 'az')} AS p_lat FROM pr0),
pr2 AS (SELECT scene_id, {sql.moved_lon('lon', 'lat', 'p_lat', 'm', 'az')} AS p_lon, p_lat FROM pr1),
water AS (SELECT pr2.* FROM pr2 JOIN fs ON fs.id = pr2.scene_id WHERE {sql.in_foot('p_lon', 'p_lat', 'fs')}
  AND NOT EXISTS (SELECT 1 FROM land_polygons l WHERE {sql.off_land('p_lon', 'p_lat')} <= 300e0)
  AND NOT EXISTS (SELECT 1 FROM ev WHERE ev.scene_id = pr2.scene_id AND {sql.metres('pr2.p_lon', 'pr2.p_lat', 'ev.lon', 'ev.lat')} <= 600e0)),
rated AS (SELECT scene_id, count(*) AS probes, count(*) FILTER (WHERE EXISTS (SELECT 1 FROM dr WHERE dr.scene_id = water.scene_id AND {sql.metres('water.p_lon', 'water.p_lat', 'dr.r_lon', 'dr.r_lat')} <= dr.gate_m)) AS hits FROM water GROUP BY 1),
chance AS (SELECT s.scene_id, coalesce(probes, 0) AS probes, coalesce(hits, 0) AS probe_hits, CASE WHEN coalesce(probes, 0) > 0 THEN hits / probes END AS chance_rate FROM (SELECT DISTINCT scene_id FROM sea) s LEFT JOIN rated USING (scene_id)),
present AS (SELECT dr.scene_id, dr.r_lon, dr.r_lat FROM dr JOIN ship_metadata m ON m.mmsi = dr.mmsi JOIN fs ON fs.id = dr.scene_id WHERE {sql.in_foot('dr.r_lon', 'dr.r_lat', 'fs')} AND dr.sog >= 1e0 AND m.ship_type BETWEEN 60 AND 89),
recall AS (SELECT fs.id AS scene_id, coalesce(n, 0) AS recall_large_total, coalesce(found, 0) AS recall_large_detected FROM fs LEFT JOIN (
  SELECT scene_id, count(*) AS n, count(*) FILTER (WHERE EXISTS (SELECT 1 FROM sea WHERE sea.scene_id = present.scene_id AND {sql.metres('sea.lon', 'sea.lat', 'present.r_lon', 'present.r_lat')} <= 500e0)) AS found FROM present GROUP BY 1) x ON x.scene_id = fs.id),
labelled AS (SELECT ev.*, m.margin_m, m.nearest_mmsi, a.mmsi AS matched_mmsi, a.distance_m, a.delta_s,
  CASE WHEN m.det_id IS NULL THEN NULL WHEN a.mmsi IS NOT NULL THEN 'matched' WHEN m.margin_m IS NULL OR m.margin_m <= 0 THEN 'indeterminate' WHEN coalesce(c.chance_rate <= 0.1e0, false) THEN 'dark' ELSE 'indeterminate' END AS match_state
  FROM ev LEFT JOIN margins m ON m.det_id = ev.id LEFT JOIN assigned a ON a.det_id = ev.id LEFT JOIN chance c ON c.scene_id = ev.scene_id),
final AS (SELECT id, scene_id, lon, lat, confidence, on_land, match_state, CASE match_state WHEN 'dark' THEN true WHEN 'matched' THEN false END AS is_dark, matched_mmsi, distance_m AS match_distance_m, delta_s AS match_time_delta_s, margin_m AS dark_margin_m,
  CASE WHEN match_state = 'indeterminate' AND margin_m <= 0 THEN nearest_mmsi END AS candidate_mmsi, CASE WHEN confidence >= 0.6e0 THEN 'high' WHEN confidence >= 0.25e0 THEN 'medium' ELSE 'low' END AS confidence_bucket FROM labelled)
"""
_DOMAIN = ("ais_positions", "sar_detections", "sar_scenes", "ship_metadata", "land_polygons")


def _fuse_sql(tail: str) -> str:
    return oracle(_FUSE + tail, *_DOMAIN)


def _fused(spark, positions, detections, scenes, ships, land, summary=True):
    return fusion.fuse(positions, detections, scenes, ships, land, registry.regions(spark).select(F.col("name").alias("roi"), "mode"), summary=summary)


def _stored(spark, sf_dir):
    """Fused detections and scenes of a folder, written once per session in the shared folder, by scene."""
    return store.stored(spark, sf_dir, lambda: _fused(spark, *domain(spark, sf_dir, *_DOMAIN, sheared=True)))


def _inputs(spark, positions, detections, scenes, land):
    """(all clipped detections, fused sea detections, fused scenes, projected fixes by place, sights); detections and fixes computed once."""
    s = scenes.join(F.broadcast(registry.regions(spark).select(F.col("name").alias("roi"), "mode")), "roi").filter("mode = 'fused'")
    every = fusion.kept_detections(detections, scenes, land)
    sea = every.filter(~F.col("on_land")).join(s.select(F.col("id").alias("scene_id")), "scene_id", "left_semi")
    return every, sea, s, *fusion.placed_fixes(positions, s)


@query("fusion", _fuse_sql("SELECT id, scene_id, round(lon, 6) AS lon, round(lat, 6) AS lat, confidence, confidence_bucket, on_land, match_state, is_dark, matched_mmsi, candidate_mmsi, round(match_distance_m, 3) AS match_distance_m, match_time_delta_s, round(dark_margin_m, 3) AS dark_margin_m FROM final"))
@_d(*_DOMAIN)
def flagship(spark, *t):
    out = _fused(spark, *t, summary=False).detections
    return out.select("id", "scene_id", _r("lon", 6), _r("lat", 6), "confidence", "confidence_bucket", "on_land", "match_state", "is_dark", "matched_mmsi", "candidate_mmsi", _r("match_distance_m", 3), "match_time_delta_s", _r("dark_margin_m", 3))


@query("st24_scene_summary", _fuse_sql("""SELECT sc.id AS scene_id, sc.roi, sc.mode, coalesce(n.total, 0) AS total, CASE WHEN sc.mode = 'fused' THEN coalesce(n.dark, 0) END AS dark, CASE WHEN sc.mode = 'fused' THEN coalesce(n.ind, 0) END AS indeterminate,
round(c.chance_rate, 9) AS chance_rate, CASE WHEN sc.mode = 'fused' THEN coalesce(c.chance_rate <= 0.1e0, false) END AS discriminating, r.recall_large_total, r.recall_large_detected
FROM sc LEFT JOIN (SELECT scene_id, count(*) AS total, count(*) FILTER (WHERE is_dark) AS dark, count(*) FILTER (WHERE match_state = 'indeterminate') AS ind FROM final WHERE NOT on_land GROUP BY 1) n ON n.scene_id = sc.id
LEFT JOIN chance c ON c.scene_id = sc.id LEFT JOIN recall r ON r.scene_id = sc.id"""))
@_d(*_DOMAIN)
def _summary(spark, *t):
    out = _fused(spark, *t).scenes
    return out.select("scene_id", "roi", "mode", "total", "dark", "indeterminate", _r("chance_rate", 9), "discriminating", "recall_large_total", "recall_large_detected")


@query("c02_projected_fixes", _fuse_sql("SELECT scene_id, mmsi, sog, delta_s, round(r_lon, 6) AS r_lon, round(r_lat, 6) AS r_lat, round(gate_m, 3) AS gate_m, round(envelope_m, 3) AS envelope_m FROM dr"))
@_d(*_DOMAIN)
def _fixes(spark, positions, detections, scenes, ships, land):
    s = scenes.join(F.broadcast(registry.regions(spark).select(F.col("name").alias("roi"), "mode")), "roi").filter("mode = 'fused'")
    fixes = fusion.projected_fixes(positions, s)
    return fixes.select("scene_id", "mmsi", "sog", "delta_s", _r("r_lon", 6), _r("r_lat", 6), _r("gate_m", 3), _r("envelope_m", 3))


@query("j06_match_pairs", _fuse_sql("SELECT scene_id, det_id, mmsi, round(distance_m, 3) AS distance_m, delta_s FROM pairs"))
@_d(*_DOMAIN)
def _pairs(spark, positions, detections, scenes, ships, land):
    _, sea, _, fixes, seen = _inputs(spark, positions, detections, scenes, land)
    return fusion.match_pairs(sea, fixes, seen=seen).select("scene_id", "det_id", "mmsi", _r("distance_m", 3), "delta_s")


@query("c01_assignment", _fuse_sql("SELECT scene_id, det_id, mmsi, round(distance_m, 3) AS distance_m FROM assigned"))
@_d(*_DOMAIN)
def _assignment(spark, positions, detections, scenes, ships, land):
    _, sea, _, fixes, seen = _inputs(spark, positions, detections, scenes, land)
    (won,) = fusion.in_waves(fixes, seen, lambda f, s, of: assign_one_to_one(fusion.contested_pairs(of(sea), f, seen=s)))
    return won.select("scene_id", "det_id", "mmsi", _r("distance_m", 3))


@query("j07_dark_margins", _fuse_sql("SELECT scene_id, det_id, round(margin_m, 3) AS margin_m, nearest_mmsi FROM margins"))
@_d(*_DOMAIN)
def _margins(spark, positions, detections, scenes, ships, land):
    _, sea, _, fixes, seen = _inputs(spark, positions, detections, scenes, land)
    (margins,) = fusion.in_waves(fixes, seen, lambda f, s, of: fusion.dark_margins(of(sea), f, s))
    return margins.select("scene_id", "det_id", _r("margin_m", 3), "nearest_mmsi")


@query("a25_chance_rate", _fuse_sql("SELECT scene_id, probes, probe_hits, round(chance_rate, 9) AS chance_rate FROM chance"))
@_d(*_DOMAIN)
def _chance(spark, positions, detections, scenes, ships, land):
    every, sea, s, fixes, seen = _inputs(spark, positions, detections, scenes, land)
    (rates,) = fusion.in_waves(fixes, seen, lambda f, sights, of: fusion.chance_rates(of(sea), of(every), f, s, land, seen=sights))
    return rates.select("scene_id", "probes", "probe_hits", _r("chance_rate", 9))


@query("a24_large_recall", _fuse_sql("SELECT * FROM recall"))
@_d(*_DOMAIN)
def _recall(spark, positions, detections, scenes, ships, land):
    positions = positions.join(fusion.large_ships(ships, positions).select("mmsi"), "mmsi", "left_semi")  # each vessel's fix is found by its own
    _, sea, s, fixes, seen = _inputs(spark, positions, detections, scenes, land)
    s = s.withColumn("scene_id", F.col("id"))
    (recall,) = fusion.in_waves(fixes, seen, lambda f, sights, of: fusion.large_recall(of(sea), f, of(s), ships, seen=sights))
    return recall


@query("j09_land_mask", _fuse_sql("SELECT id, scene_id, on_land FROM ev"))
@_d(*_DOMAIN)
def _mask(spark, positions, detections, scenes, ships, land):
    return fusion.clip_and_mask(detections, scenes, land).select("id", "scene_id", "on_land")


@query("j14_match_counts", oracle(f""", a AS (SELECT id % 4 AS grp, lon, lat FROM sar_detections), b AS (SELECT id % 4 AS grp, lon, lat FROM ais_positions)
SELECT g.grp, (SELECT count(*) FROM a WHERE a.grp = g.grp AND EXISTS (SELECT 1 FROM b WHERE b.grp = a.grp AND {sql.metres('a.lon', 'a.lat', 'b.lon', 'b.lat')} <= 900e0)) AS left_hit,
(SELECT count(*) FROM a WHERE a.grp = g.grp AND NOT EXISTS (SELECT 1 FROM b WHERE b.grp = a.grp AND {sql.metres('a.lon', 'a.lat', 'b.lon', 'b.lat')} <= 900e0)) AS left_miss,
(SELECT count(*) FROM b WHERE b.grp = g.grp AND EXISTS (SELECT 1 FROM a WHERE b.grp = a.grp AND {sql.metres('a.lon', 'a.lat', 'b.lon', 'b.lat')} <= 900e0)) AS right_hit,
(SELECT count(*) FROM b WHERE b.grp = g.grp AND NOT EXISTS (SELECT 1 FROM a WHERE b.grp = a.grp AND {sql.metres('a.lon', 'a.lat', 'b.lon', 'b.lat')} <= 900e0)) AS right_miss
FROM (SELECT unnest(generate_series(0, 3))::BIGINT AS grp) g""", "ais_positions", "sar_detections"))
@_d("ais_positions", "sar_detections")
def _counts(spark, positions, detections):
    a = detections.select((F.col("id") % 4).alias("grp"), "lon", "lat")
    b = positions.select((F.col("id") % 4).alias("grp"), "lon", "lat")
    return match_counts(a, b, 900.0, ["grp"])


@query("j12_clear_of_land", oracle(f" SELECT id FROM sar_detections d WHERE NOT EXISTS (SELECT 1 FROM land_polygons l WHERE {sql.off_land('d.lon', 'd.lat')} <= 300e0)", "sar_detections", "land_polygons"))
@_d("sar_detections", "land_polygons")
def _clear(spark, detections, land):
    return near_boxes(detections, land, 300.0, "left_anti").select("id")


@query("j13_separated", oracle(f" SELECT d.id FROM sar_detections d WHERE NOT EXISTS (SELECT 1 FROM sar_detections o WHERE o.scene_id = d.scene_id AND o.id > d.id AND {sql.metres('d.lon', 'd.lat', 'o.lon', 'o.lat')} <= 600e0)", "sar_detections"))
@_d("sar_detections")
def _separated(spark, detections):
    o = detections.select("scene_id", F.col("id").alias("o_id"), F.col("lon").alias("r_lon"), F.col("lat").alias("r_lat"))
    near = within_distance(detections.select("id", "scene_id", "lon", "lat"), o, F.lit(600.0), ["scene_id"]).filter("o_id > id")
    return detections.join(near.select("id").distinct(), "id", "left_anti").select("id")


# scene routes -----------------------------------------------------------------------------------


_COUNTS = "SELECT scene_id, count(*) AS detection_count, count(*) FILTER (WHERE is_dark) AS dark_count, count(*) FILTER (WHERE match_state = 'matched') AS matched_count, count(*) FILTER (WHERE match_state = 'indeterminate') AS indeterminate_count, count(*) FILTER (WHERE on_land) AS on_land_count FROM final GROUP BY 1"


@query("t03_scenes", _fuse_sql(f"""SELECT s.id, s.roi, s.sensed_us, s.platform, s.status, s.overview_png IS NOT NULL AS has_overview, {sql.FAILURE.format('s.error')} AS failure_reason, coalesce(detection_count, 0) AS detection_count, coalesce(dark_count, 0) AS dark_count, coalesce(matched_count, 0) AS matched_count, coalesce(indeterminate_count, 0) AS indeterminate_count, coalesce(on_land_count, 0) AS on_land_count
FROM (SELECT * FROM sar_scenes ORDER BY sensed_us DESC, id LIMIT 50) s LEFT JOIN ({_COUNTS}) n ON n.scene_id = s.id"""))
def _scenes(spark, sf_dir):
    return routes.scene_list(*domain(spark, sf_dir, "sar_scenes"), _stored(spark, sf_dir).detections, None, 50)


@query("t04_detections", _fuse_sql("SELECT f.id, round(lon, 6) AS lon, round(lat, 6) AS lat, confidence, confidence_bucket, match_state, is_dark, matched_mmsi, a.ship_name AS matched_name, a.ship_type AS matched_type, candidate_mmsi, b.ship_name AS candidate_name, b.ship_type AS candidate_type, round(match_distance_m, 3) AS match_distance_m, match_time_delta_s, round(dark_margin_m, 3) AS dark_margin_m, on_land FROM final f LEFT JOIN ship_metadata a ON a.mmsi = f.matched_mmsi LEFT JOIN ship_metadata b ON b.mmsi = f.candidate_mmsi WHERE scene_id = 'S12'"))
def _scene_detections(spark, sf_dir):
    out = routes.scene_detections(_stored(spark, sf_dir).detections, *domain(spark, sf_dir, "ship_metadata"), "S12", include_land=True)
    return out.withColumns({"lon": F.round("lon", 6), "lat": F.round("lat", 6), "match_distance_m": F.round("match_distance_m", 3), "dark_margin_m": F.round("dark_margin_m", 3)})


@query("t02_sightings", _fuse_sql(f"SELECT f.id AS det_id, f.scene_id, coalesce(r.label, s.roi) AS roi_label, s.sensed_us, round(f.lon, 6) AS lon, round(f.lat, 6) AS lat, coalesce(matched_mmsi = {_ONE}, false) AS matched, confidence FROM final f JOIN sar_scenes s ON s.id = f.scene_id LEFT JOIN {_REGIONS} r ON r.name = s.roi WHERE NOT on_land AND (matched_mmsi = {_ONE} OR candidate_mmsi = {_ONE}) ORDER BY s.sensed_us DESC, f.id LIMIT 20"))
def _sightings(spark, sf_dir):
    out = routes.sightings(_stored(spark, sf_dir).detections, *domain(spark, sf_dir, "sar_scenes"), registry.regions(spark), _ONE)
    return out.withColumns({"lon": F.round("lon", 6), "lat": F.round("lat", 6)})


@query("a07_last_processed", oracle(" SELECT roi, max(processed_us) AS last_processed_us FROM sar_scenes GROUP BY 1", "sar_scenes"))
@_d("sar_scenes")
def _last(spark, scenes):
    return routes.last_processed(scenes)


@query("t05_most_recent", _fuse_sql(f"SELECT s.id, s.roi, s.processed_us, coalesce(detection_count, 0) AS detection_count, coalesce(dark_count, 0) AS dark_count FROM (SELECT * FROM sar_scenes WHERE status = 'processed' ORDER BY processed_us DESC NULLS FIRST, id DESC LIMIT 1) s LEFT JOIN ({_COUNTS}) n ON n.scene_id = s.id"))
def _recent(spark, sf_dir):
    return routes.most_recent_analysis(*domain(spark, sf_dir, "sar_scenes"), _stored(spark, sf_dir).detections)


@query("a09_latest_sensed", oracle(f" SELECT max(sensed_us) AS latest_sensed_us FROM sar_scenes WHERE roi = '{ROI}' AND status = 'processed'", "sar_scenes"))
@_d("sar_scenes")
def _latest(spark, scenes):
    return routes.latest_sensed(scenes, ROI)


@query("v01_contact_views", _fuse_sql(f"""SELECT f.id, CASE WHEN on_land THEN 'masked' WHEN sc.mode = 'survey' OR match_state IS NULL THEN 'contact' ELSE match_state END AS state, concat(CASE WHEN sc.mode = 'survey' THEN 'SC-' ELSE 'DR-' END, f.id::VARCHAR) AS contact_id, coalesce(matched_mmsi, candidate_mmsi) AS contact_mmsi,
CASE (CASE WHEN on_land THEN 'masked' WHEN sc.mode = 'survey' OR match_state IS NULL THEN 'contact' ELSE match_state END) WHEN 'dark' THEN 1 WHEN 'indeterminate' THEN 2 WHEN 'matched' THEN 3 WHEN 'contact' THEN 4 ELSE 5 END::BIGINT AS list_rank FROM final f JOIN sc ON sc.id = f.scene_id"""))
def _contacts(spark, sf_dir):
    f = _stored(spark, sf_dir)
    d = f.detections.join(f.scenes.select("scene_id", "mode"), "scene_id")
    state = labels.contact_state(F.col("on_land"), F.col("mode"), F.col("match_state"))
    return d.select("id", state.alias("state"), labels.contact_id(F.col("mode"), F.col("id")).alias("contact_id"), labels.contact_mmsi(F.col("matched_mmsi"), F.col("candidate_mmsi")).alias("contact_mmsi"), labels.contact_rank(state).alias("list_rank"))


@query("a16_confidence_histogram", oracle(" SELECT b::INT AS bin, count(*) AS n FROM (SELECT CASE WHEN confidence >= 1e0 THEN 7 WHEN confidence < 0.1e0 THEN -1 ELSE (SELECT count(*) FROM (VALUES (0.2e0), (0.25e0), (0.3e0), (0.4e0), (0.5e0), (0.6e0), (0.8e0)) e(x) WHERE x <= confidence) END AS b FROM sar_detections) WHERE b >= 0 GROUP BY 1", "sar_detections"))
@_d("sar_detections")
def _histogram(spark, detections):
    return routes.confidence_histogram(detections)


def _arms(pairs) -> str:
    return " ".join(f"WHEN {lo} <= c AND c <= {hi} THEN '{label}'" for lo, hi, label in pairs)


@query("f08_code_labels", oracle(f" SELECT mmsi, CASE {_arms(SHIP_TYPES).replace(' c ', ' ship_type ').replace('= c', '= ship_type')} END AS ship_type_label, CASE {_arms((k, k, v) for k, v in enumerate(NAV_STATUS)).replace(' c ', ' (mmsi % 16) ').replace('= c', '= (mmsi % 16)')} END AS nav_label FROM ship_metadata", "ship_metadata"))
@_d("ship_metadata")
def _codes(spark, ships):
    return ships.select("mmsi", labels.ship_type_label(F.col("ship_type")).alias("ship_type_label"), labels.nav_status_label(F.col("mmsi") % 16).alias("nav_label"))


@query("j21_flags", oracle(f" SELECT m.mmsi, f.flag_iso2, f.flag_country FROM ship_metadata m LEFT JOIN {_FLAGS} f ON length(m.mmsi::VARCHAR) = 9 AND f.mid = m.mmsi // 1000000", "ship_metadata"))
@_d("ship_metadata")
def _flags(spark, ships):
    return routes.with_flag(ships.select("mmsi"), registry.flag_table(spark))


# scheduling and ledger --------------------------------------------------------------------------


@query("a12_next_pass", oracle(f""", t AS (SELECT DISTINCT roi, sensed_us FROM sar_scenes), g AS (SELECT *, sensed_us - lag(sensed_us) OVER (PARTITION BY roi ORDER BY sensed_us) AS gap FROM t),
m AS (SELECT roi, count(*) AS passes, max(sensed_us) AS last_us, median(gap) AS i FROM g GROUP BY 1)
SELECT roi, passes, CASE WHEN passes >= 3 AND i > 0 THEN cast(last_us + greatest(floor(({NOW} - last_us) / i) + 1, 0) * i + 10800000000 AS BIGINT) END AS next_us FROM m""", "sar_scenes"))
@_d("sar_scenes")
def _next(spark, scenes):
    return scheduling.next_pass(scenes, NOW)


@query("a13_upper_median", oracle(" SELECT roi, list_sort(list(sensed_us))[count(*) // 2 + 1] AS upper_median FROM sar_scenes GROUP BY 1", "sar_scenes"))
@_d("sar_scenes")
def _upper(spark, scenes):
    return scheduling.upper_median(scenes, "roi", "sensed_us")


@query("w03_passes", oracle(""", f AS (SELECT *, CASE WHEN coalesce(sensed_us - lag(sensed_us) OVER (PARTITION BY roi ORDER BY sensed_us, id) > 1200000000, true) THEN 1 ELSE 0 END AS fresh FROM sar_scenes),
n AS (SELECT *, sum(fresh) OVER (PARTITION BY roi ORDER BY sensed_us, id ROWS UNBOUNDED PRECEDING)::BIGINT AS pass_no FROM f)
SELECT roi, pass_no, min(sensed_us) AS first_us, max(sensed_us) AS last_us, count(*) AS scenes FROM n GROUP BY 1, 2""", "sar_scenes"))
@_d("sar_scenes")
def _passes(spark, scenes):
    return scheduling.sessionise(scenes)


@query("st09_feed_health", oracle(f""" SELECT (SELECT min(time_us) FROM ais_positions) AS min_us, (SELECT max(time_us) FROM ais_positions) AS max_us,
(SELECT max({NOW} - (k - 1) * 3600000000) FROM (SELECT unnest(generate_series(1, 6)) AS k) b WHERE NOT EXISTS (SELECT 1 FROM ais_positions WHERE time_us >= {NOW} - k * 3600000000 AND time_us < {NOW} - (k - 1) * 3600000000))::BIGINT AS last_gap_end_us""", "ais_positions"))
@_d("ais_positions")
def _health(spark, positions):
    return scheduling.ais_health(positions, NOW)


_GATE = f""", h AS (SELECT (SELECT min(time_us) FROM ais_positions) AS min_us, (SELECT max(time_us) FROM ais_positions) AS max_us, (SELECT max({NOW} - (k - 1) * 3600000000) FROM (SELECT unnest(generate_series(1, 6)) AS k) b WHERE NOT EXISTS (SELECT 1 FROM ais_positions WHERE time_us >= {NOW} - k * 3600000000 AND time_us < {NOW} - (k - 1) * 3600000000))::BIGINT AS gap_us),
gate AS (SELECT CASE WHEN max_us IS NULL THEN false WHEN ({NOW} - max_us) / 3.6e9 > 1 THEN false ELSE ({NOW} - coalesce(gap_us, {NOW} - 21600000000)) / 3.6e9 >= 6 END AS fused_ready, coalesce(({NOW} - min_us) / 3.6e9 >= 6, false) AS survey_ready FROM h)"""


@query("st12_held_regions", oracle(f"{_GATE} SELECT r.name, r.mode FROM {_REGIONS} r, gate WHERE NOT CASE WHEN r.mode = 'survey' THEN survey_ready ELSE fused_ready END", "ais_positions"))
@_d("ais_positions")
def _held(spark, positions):
    return _held_frame(spark, positions).select("name", "mode")


def _held_frame(spark, positions):
    health = scheduling.ais_health(positions, NOW)
    gate = scheduling.survey_gate(scheduling.fused_gate(health, NOW), NOW, NOW - scheduling.HOUR)
    return scheduling.held_regions(registry.regions(spark), gate)


@query("st18_schedule", oracle(f"""{_GATE}, t AS (SELECT DISTINCT roi, sensed_us FROM sar_scenes), g AS (SELECT *, sensed_us - lag(sensed_us) OVER (PARTITION BY roi ORDER BY sensed_us) AS gap FROM t),
m AS (SELECT roi, count(*) AS passes, max(sensed_us) AS last_us, median(gap) AS i FROM g GROUP BY 1),
nx AS (SELECT roi, CASE WHEN passes >= 3 AND i > 0 THEN cast(last_us + greatest(floor(({NOW} - last_us) / i) + 1, 0) * i + 10800000000 AS BIGINT) END AS next_us FROM m),
l AS (SELECT roi, max(sensed_us) AS latest_us, max(processed_us) AS last_processed_us, bool_or(status = 'processing') AS analyzing FROM sar_scenes GROUP BY 1)
SELECT r.name, r.label, r.mode, latest_us, last_processed_us, next_us, CASE WHEN coalesce(analyzing, false) THEN 'analyzing' WHEN NOT CASE WHEN r.mode = 'survey' THEN survey_ready ELSE fused_ready END THEN 'warming_up' WHEN next_us IS NULL THEN 'unknown' WHEN next_us <= {NOW} THEN 'awaiting_publication' ELSE 'scheduled' END AS state
FROM {_REGIONS} r CROSS JOIN gate LEFT JOIN l ON l.roi = r.name LEFT JOIN nx ON nx.roi = r.name""", "ais_positions", "sar_scenes"))
@_d("ais_positions", "sar_scenes")
def _schedule(spark, positions, scenes):
    return scheduling.schedule(registry.regions(spark), scenes, _held_frame(spark, positions), NOW)


_GRID = f"""SELECT name, mode, passes_per_month, w AS width, h AS height, ceil(w / 2400)::BIGINT * ceil(h / 2400)::BIGINT AS tiles, round(w * h / 262144e0 * (1e0 / 3e0) * 2e0, 6) AS pu, round(w * h / 262144e0 * (1e0 / 3e0) * 2e0 * passes_per_month, 6) AS pu_month
FROM (SELECT *, greatest(round_even((sar_max_lon - sar_min_lon) * 111320e0 * cos(radians((sar_min_lat + sar_max_lat) / 2e0)) / 10e0, 0)::BIGINT, 1) AS w, greatest(round_even((sar_max_lat - sar_min_lat) * 111320e0 / 10e0, 0)::BIGINT, 1) AS h FROM {_REGIONS})"""


#: The fetch of every scene's box.
_SCENE_GRID = """SELECT id, roi, w AS width, h AS height, ceil(w / 2400)::BIGINT * ceil(h / 2400)::BIGINT AS tiles, w * h / 262144e0 * (1e0 / 3e0) * 2e0 AS pu
FROM (SELECT *, greatest(round_even((max_lon - min_lon) * 111320e0 * cos(radians((min_lat + max_lat) / 2e0)) / 10e0, 0)::BIGINT, 1) AS w,
  greatest(round_even((max_lat - min_lat) * 111320e0 / 10e0, 0)::BIGINT, 1) AS h FROM sar_scenes)"""


@query("st16_decisions", oracle(f""", spent AS (SELECT DISTINCT scene_id FROM pu_ledger), g AS ({_GRID}), m AS (SELECT coalesce(sum(pu), 0e0) AS pu FROM pu_ledger WHERE spent_us >= epoch_us(date_trunc('month', make_timestamp({LEDGER_NOW})))),
f AS (SELECT s.id, CASE WHEN s.sensed_us % 4 = 0 AND status = 'failed' THEN NULL ELSE status END AS status, sp.scene_id IS NOT NULL AS has_pu_spend, m.pu AS month_to_date_pu, g.pu AS pu_cost FROM sar_scenes s CROSS JOIN m LEFT JOIN g ON g.name = s.roi LEFT JOIN spent sp ON sp.scene_id = s.id)
SELECT id, CASE WHEN status = 'processed' THEN 'already analyzed' WHEN status = 'processing' THEN 'already running' WHEN has_pu_spend THEN 'already spent' WHEN month_to_date_pu + pu_cost > 25000e0 THEN 'over ceiling' WHEN status IS NULL THEN 'new pass' ELSE 'retry' END AS reason,
coalesce(status, '') NOT IN ('processed', 'processing') AND NOT has_pu_spend AND month_to_date_pu + pu_cost <= 25000e0 AS analyze FROM f""", "sar_scenes", "pu_ledger"))
@_d("sar_scenes", "pu_ledger")
def _decisions(spark, scenes, ledger):
    spent = scheduling.spent_scenes(ledger).select(F.col("scene_id").alias("id"), F.lit(True).alias("has_pu_spend"))
    month = scheduling.month_to_date(ledger, LEDGER_NOW).withColumnRenamed("pu", "month_to_date_pu")
    cost = scheduling.monthly_cost(registry.regions(spark)).select(F.col("name").alias("roi"), F.col("pu").alias("pu_cost"))
    facts = scenes.join(spent, "id", "left").join(F.broadcast(cost), "roi", "left").crossJoin(F.broadcast(month)).select(
        "id", F.when(~((F.col("sensed_us") % 4 == 0) & (F.col("status") == "failed")), F.col("status")).alias("status"), F.coalesce("has_pu_spend", F.lit(False)).alias("has_pu_spend"),
        "month_to_date_pu", "pu_cost",
    )
    return scheduling.decide(facts).select("id", "reason", "analyze")


@query("a06_pu_by_roi", oracle(" SELECT roi, round(sum(pu), 3) AS pu, count(*) AS entries, max(spent_us) AS last_us FROM pu_ledger GROUP BY 1", "pu_ledger"))
@_d("pu_ledger")
def _by_roi(spark, ledger):
    return scheduling.pu_by_roi(ledger).withColumn("pu", F.round("pu", 3))


@query("a23_pu_status", oracle(f", m AS (SELECT coalesce(sum(pu), 0e0) AS pu FROM pu_ledger WHERE spent_us >= epoch_us(date_trunc('month', make_timestamp({LEDGER_NOW})))) SELECT round(m.pu, 3) AS month_pu, round((SELECT sum(pu) FROM pu_ledger), 3) AS total_pu, (SELECT count(*) FROM pu_ledger) AS entries, round(30000e0 - m.pu, 3) AS budget_left, round(25000e0 - m.pu, 3) AS ceiling_left FROM m", "pu_ledger"))
@_d("pu_ledger")
def _status(spark, ledger):
    out = scheduling.pu_status(ledger, LEDGER_NOW)
    return out.select(_r("month_pu", 3), _r("total_pu", 3), "entries", _r("budget_left", 3), _r("ceiling_left", 3))


@query("t06_recent_spending", oracle(" SELECT * FROM pu_ledger ORDER BY spent_us DESC, id DESC LIMIT 25", "pu_ledger"))
@_d("pu_ledger")
def _recent_spending(spark, ledger):
    return scheduling.recent_spending(ledger, 25)


@query("c07_fetch_grid", oracle(f" SELECT id, roi, width, height, tiles, round(pu, 6) AS pu FROM ({_SCENE_GRID})", "sar_scenes"))
@_d("sar_scenes")
def _grid(spark, scenes):
    return scheduling.pass_costs(scenes).withColumn("pu", F.round("pu", 6))


@query("a19_cost_totals", oracle(f", m AS ({_GRID}), c AS (SELECT roi, count(*) AS passes, sum(tiles)::BIGINT AS tiles, round(sum(pu), 3) AS pu FROM ({_SCENE_GRID}) GROUP BY ROLLUP (roi)) "
"SELECT c.*, round(CASE WHEN c.roi IS NULL THEN (SELECT sum(pu_month) FROM m) ELSE m.pu_month END, 3) AS pu_month FROM c LEFT JOIN m ON m.name = c.roi", "sar_scenes"))
@_d("sar_scenes")
def _cost_totals(spark, scenes):
    out = scheduling.cost_totals(scheduling.pass_costs(scenes), scheduling.monthly_cost(registry.regions(spark)))
    return out.withColumns({"pu": F.round("pu", 3), "pu_month": F.round("pu_month", 3)})


@query("a20_respend", oracle(f", g AS ({_GRID}) SELECT round(sum(g.pu), 1) AS respend_pu FROM g WHERE g.name IN (SELECT roi FROM sar_scenes WHERE status = 'failed')", "sar_scenes"))
@_d("sar_scenes")
def _respend(spark, scenes):
    return scheduling.respend(registry.regions(spark), scenes.filter("status = 'failed'"))


@query("t09_eligible_scenes", oracle(" SELECT id, sensed_us FROM sar_scenes WHERE sensed_us - 7200000000 >= 0 AND sensed_us + 7200000000 <= 16000000000", "sar_scenes"))
@_d("sar_scenes")
def _eligible(spark, scenes):
    return scheduling.eligible_scenes(scenes, 0, 16_000_000_000).select("id", "sensed_us")


# views ------------------------------------------------------------------------------------------

_STATE = "CASE WHEN on_land THEN 'masked' WHEN sc.mode = 'survey' OR match_state IS NULL THEN 'contact' ELSE match_state END"


@query("a22_state_counts", _fuse_sql(f"SELECT CASE state WHEN 'dark' THEN 1 WHEN 'indeterminate' THEN 2 WHEN 'matched' THEN 3 WHEN 'contact' THEN 4 ELSE 5 END::BIGINT AS list_rank, state, count(*) AS n FROM (SELECT {_STATE} AS state FROM final f JOIN sc ON sc.id = f.scene_id) GROUP BY 1, 2"))
def _state_counts(spark, sf_dir):
    f = _stored(spark, sf_dir)
    d = f.detections.join(f.scenes.select("scene_id", "mode"), "scene_id")
    state = labels.contact_state(F.col("on_land"), F.col("mode"), F.col("match_state"))
    return views.state_counts(d.select(state.alias("state")).withColumn("list_rank", labels.contact_rank(F.col("state"))))


@query("v05_pass_cards", _fuse_sql("""SELECT roi, id, place, CASE WHEN status = 'failed' THEN 'FAILED' WHEN status = 'processing' THEN 'PROCESSING' WHEN place = 1 THEN 'LATEST' WHEN mode = 'survey' THEN 'SURVEY' WHEN dark > 0 THEN concat(dark::VARCHAR, ' DARK') ELSE 'CLEAR' END AS flag
FROM (SELECT sc.roi, sc.id, sc.status, sc.mode, row_number() OVER (PARTITION BY sc.roi ORDER BY sensed_us DESC, sc.id)::INT AS place, coalesce(n.dark, 0) AS dark FROM sc LEFT JOIN (SELECT scene_id, count(*) FILTER (WHERE is_dark) AS dark FROM final GROUP BY 1) n ON n.scene_id = sc.id) WHERE place <= 5"""))
def _cards(spark, sf_dir):
    f, (scenes,) = _stored(spark, sf_dir), domain(spark, sf_dir, "sar_scenes")
    counts = f.detections.groupBy("scene_id").agg(F.count_if("is_dark").alias("dark_count"))
    s = scenes.select("id", "roi", "sensed_us", "status").join(f.scenes.select(F.col("scene_id").alias("id"), "mode"), "id")
    return views.pass_cards(s.join(counts.withColumnRenamed("scene_id", "id"), "id", "left"))


@query("v09_region_status", ORACLES["st18_schedule"].replace("SELECT r.name, r.label, r.mode, latest_us, last_processed_us, next_us, CASE", "SELECT name, CASE WHEN state = 'analyzing' THEN 'Analyzing' WHEN state = 'warming_up' THEN 'AIS warm-up' ELSE 'Due' END AS status FROM (SELECT r.name, next_us, CASE") + ")")
@_d("ais_positions", "sar_scenes")
def _region_status(spark, positions, scenes):
    rows = scheduling.schedule(registry.regions(spark), scenes, _held_frame(spark, positions), NOW)
    return rows.select("name", views.region_status(F.col("state"), F.col("next_us"), NOW).alias("status"))


@query("v06_ticker", f"""WITH s AS ({ORACLES['st18_schedule']}), r AS ({ORACLES['t05_most_recent']})
SELECT 0 AS rank, '' AS name, processed_us AS at_us, concat(g.label, ' analysis complete · ', detection_count, ' contacts', CASE WHEN g.mode = 'fused' THEN concat(' · ', dark_count, ' dark') ELSE '' END) AS text FROM r JOIN {_REGIONS} g ON g.name = r.roi
UNION ALL SELECT 1, name, latest_us, concat(label, ' · analyzing pass') FROM s WHERE state = 'analyzing'
UNION ALL SELECT 2, name, latest_us, concat(label, ' · awaiting product publication') FROM (SELECT * FROM s WHERE state = 'awaiting_publication' ORDER BY name LIMIT 3)
UNION ALL SELECT 3, '', NULL, concat(count(*) FILTER (WHERE state = 'scheduled'), '/', count(*), ' regions scheduled for next pass') FROM s""")
def _ticker(spark, sf_dir):
    regions, (positions, scenes) = registry.regions(spark), domain(spark, sf_dir, "ais_positions", "sar_scenes")
    rows = scheduling.schedule(regions, scenes, _held_frame(spark, positions), NOW)
    recent = routes.most_recent_analysis(scenes, _stored(spark, sf_dir).detections)
    recent = recent.join(regions.select(F.col("name").alias("roi"), "label", "mode"), "roi").select("label", "mode", "processed_us", "detection_count", "dark_count")
    return views.ticker(rows, recent)
