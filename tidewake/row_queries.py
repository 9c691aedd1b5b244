"""More queries over the test tables: ingest, writes, transfer, tiles, labels and displays, each with its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidewake.functions import geo, labels, rings
from tidewake.operators import overlay, raster, regions, stripes, writes
from tidewake.plans import routes, scheduling, views
from tidewake.queries import _BOX, _DOMAIN, _GATE, _GRID, _MODES, _ONE, _REGIONS, _SCENE_GRID, LEDGER_NOW, NOW, ROI, _d, _fuse_sql, _held_frame, _r, _stored, query
from tidewake.session import shared_folder
from tidewake.sources import ais_json, registry, transfer, versions
from tidewake.sources.adapter import domain, oracle
from tidewake.streaming import ingest


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ingest -----------------------------------------------------------------------------------------


@query("st01_positions", oracle(" SELECT mmsi, time_us, lon, lat, sog, cog, true_heading, nav_status FROM ais_positions", "ais_positions"))
@_d("ais_positions")
def _positions(spark, positions):
    return ais_json.positions(ais_json.decode(ais_json.to_envelopes(positions)))


#: Identity messages of four kinds, as text, from the customers.
_MESSAGES = """
SELECT CASE c_custkey % 4
  WHEN 0 THEN concat('{"MessageType":"ShipStaticData","MetaData":{"MMSI":', c_custkey, ',"time_utc":"2024-01-01 00:00:07.5 +0000 UTC"},"Message":{"ShipStaticData":{"Name":" ', c_name, ' ","Type":', c_custkey % 100, ',"CallSign":"C', c_custkey, '"}}}')
  WHEN 1 THEN concat('{"MessageType":"ExtendedClassBPositionReport","MetaData":{"MMSI":', c_custkey, ',"time_utc":"2024-01-01 00:00:07.5 +0000 UTC"},"Message":{"ExtendedClassBPositionReport":{"Name":"', c_name, '","Type":', c_custkey % 100, ',"Latitude":1.5,"Longitude":2.5}}}')
  WHEN 2 THEN concat('{"MessageType":"StaticDataReport","MetaData":{"MMSI":', c_custkey, ',"time_utc":"2024-01-01 00:00:07.5 +0000 UTC"},"Message":{"StaticDataReport":{"PartNumber":false,"ReportA":{"Name":"', c_name, '"},"ReportB":{"ShipType":9,"CallSign":"NO"}}}}')
  ELSE concat('{"MessageType":"StaticDataReport","MetaData":{"MMSI":', c_custkey, ',"time_utc":"2024-01-01 00:00:07.5 +0000 UTC"},"Message":{"StaticDataReport":{"PartNumber":1,"ReportA":{"Name":"no"},"ReportB":{"ShipType":', c_custkey % 100, ',"CallSign":"C', c_custkey, '"}}}}') END AS value FROM {customer}
"""


@query("st02_identities", """SELECT c_custkey AS mmsi, 1704067207500000 AS time_us, CASE WHEN c_custkey % 4 < 3 THEN substring(c_name, 1, 20) END AS ship_name,
CASE WHEN c_custkey % 4 <> 2 THEN (c_custkey % 100)::SMALLINT END AS ship_type, CASE WHEN c_custkey % 4 IN (0, 3) THEN substring(concat('C', c_custkey), 1, 7) END AS callsign FROM customer WHERE c_custkey > 0""")
def _identities(spark, sf_dir):
    lines = spark.sql(_MESSAGES.replace("{", "{{").replace("}", "}}").replace("{{customer}}", "{customer}"), customer=_table(spark, sf_dir, "customer"))
    return ais_json.identities(ais_json.decode(lines))


_SAID = """SELECT o_custkey AS mmsi, o_orderkey AS seq, {us}(o_orderdate) + o_orderkey % 1000 AS time_us, CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority END AS ship_name,
CASE WHEN o_orderkey % 4 = 1 THEN cast(o_orderkey % 90 AS int) END AS ship_type, CASE WHEN o_orderkey % 5 = 2 THEN concat('C', cast(o_orderkey AS {str})) END AS callsign FROM {orders}"""


def _said(spark, sf_dir):
    text = _SAID.replace("{us}(o_orderdate)", "unix_micros(cast(o_orderdate AS timestamp))").replace("{str}", "string")
    return spark.sql(text, orders=_table(spark, sf_dir, "orders"))


_SAID_SQL = _SAID.replace("{us}", "epoch_us").replace("{str}", "varchar").replace("{orders}", "orders")


@query("st04_latest_identity", f"""WITH m AS ({_SAID_SQL}), b AS (SELECT *, max(time_us) OVER (PARTITION BY mmsi ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM m)
SELECT mmsi, max(time_us) AS updated_us, arg_max(ship_name, time_us) FILTER (WHERE ship_name IS NOT NULL) AS ship_name, arg_max(ship_type, time_us) FILTER (WHERE ship_type IS NOT NULL) AS ship_type,
arg_max(callsign, time_us) FILTER (WHERE callsign IS NOT NULL) AS callsign FROM b WHERE before IS NULL OR time_us > before GROUP BY 1""")
def _latest(spark, sf_dir):
    return ingest.latest_identities_batch(_said(spark, sf_dir))


@query("st06_retention", "SELECT event_id AS id, epoch_us(ts) AS time_us FROM events WHERE epoch_us(ts) >= 1706313600000000 - 5 * 86400000000")
def _retention(spark, sf_dir):
    rows = _table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("time_us"))
    return ingest.retain(rows, 1_706_313_600_000_000, 5)


_LOG = "SELECT concat('feed-', cast(user_id % 4 AS {str})) AS source, CASE event_id % 9 WHEN 0 THEN 'connected' WHEN 1 THEN 'disconnected' WHEN 2 THEN 'error' ELSE 'message' END AS kind, event_id * 1000000 AS at_us, CASE WHEN event_id % 9 = 2 THEN concat('e', cast(event_id AS {str})) WHEN event_id % 9 = 1 THEN 'closed' END AS reason FROM {events}"


@query("st13_source_health", f"""WITH l AS ({_LOG.replace('{str}', 'varchar').replace('{events}', 'events')}), p AS (SELECT source, arg_max(kind, at_us) FILTER (WHERE kind <> 'message') AS kind, max(at_us) FILTER (WHERE kind = 'connected') AS c, max(at_us) FILTER (WHERE kind = 'message') AS m,
greatest(count(*) FILTER (WHERE kind = 'connected') - 1, 0) AS reconnects, arg_max(reason, at_us) FILTER (WHERE kind IN ('disconnected', 'error')) AS last_error FROM l GROUP BY 1)
SELECT source, CASE WHEN kind = 'connected' AND (10010000000 - coalesce(m, c)) / 1e6 > 60 THEN 'stale' ELSE kind END AS state, round((10010000000 - m) / 1e6, 1) AS lag_s, reconnects, last_error FROM p""")
def _source_health(spark, sf_dir):
    log = spark.sql(_LOG.replace("{str}", "string"), events=_table(spark, sf_dir, "events"))
    return ingest.source_health(log, 10_010_000_000)


# writes -----------------------------------------------------------------------------------------

_OLD = "SELECT c_custkey AS mmsi, c_name AS ship_name, CASE WHEN c_custkey % 3 > 0 THEN c_mktsegment END AS callsign, CASE WHEN c_custkey % 7 > 0 THEN 694224000000000 + c_custkey * 86400000000 END AS updated_us FROM {customer}"
_NEW = "SELECT o_custkey AS mmsi, CASE WHEN o_orderkey % 2 = 0 THEN concat('N', cast(o_orderkey AS {str})) END AS ship_name, CASE WHEN o_orderkey % 3 = 0 THEN 'X' END AS callsign, {us} AS updated_us FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS k FROM {orders}) o WHERE k = 1"


def _old_new(spark, sf_dir):
    new = _NEW.replace("{str}", "string").replace("{us}", "unix_micros(cast(o_orderdate AS timestamp))")
    return spark.sql(_OLD, customer=_table(spark, sf_dir, "customer")), spark.sql(new, orders=_table(spark, sf_dir, "orders"))


_BOTH = f"WITH o AS ({_OLD.replace('{customer}', 'customer')}), n AS ({_NEW.replace('{str}', 'varchar').replace('{us}', 'epoch_us(o_orderdate)').replace('{orders}', 'orders')}), b AS (SELECT o.mmsi AS m, n.mmsi AS k, o.ship_name AS a1, n.ship_name AS b1, o.callsign AS a2, n.callsign AS b2, o.updated_us AS a3, n.updated_us AS b3 FROM o FULL JOIN n ON n.mmsi = o.mmsi)"


@query("d11_keep_unknown", _BOTH + " SELECT coalesce(m, k) AS mmsi, CASE WHEN b3 > coalesce(a3, -1) THEN b3 ELSE a3 END AS updated_us, CASE WHEN b3 > coalesce(a3, -1) THEN coalesce(b1, a1) ELSE a1 END AS ship_name, CASE WHEN b3 > coalesce(a3, -1) THEN coalesce(b2, a2) ELSE a2 END AS callsign FROM b")
def _upsert_keep(spark, sf_dir):
    return writes.upsert_keep(*_old_new(spark, sf_dir), "mmsi", "updated_us", ["ship_name", "callsign"])


@query("d12_newer_wins", _BOTH + " SELECT coalesce(m, k) AS mmsi, CASE WHEN m IS NULL OR b3 > coalesce(a3, -1) THEN b1 ELSE a1 END AS ship_name, CASE WHEN m IS NULL OR b3 > coalesce(a3, -1) THEN b2 ELSE a2 END AS callsign, CASE WHEN m IS NULL OR b3 > coalesce(a3, -1) THEN b3 ELSE a3 END AS updated_us FROM b")
def _upsert(spark, sf_dir):
    return writes.upsert(*_old_new(spark, sf_dir), "mmsi", "updated_us")


@query("d07_begin", oracle(" SELECT id, roi, sensed_us, CASE WHEN sensed_us % 360000000 = 0 THEN 'processing' ELSE status END AS status, CASE WHEN sensed_us % 360000000 = 0 THEN NULL ELSE error END AS error FROM sar_scenes", "sar_scenes"))
@_d("sar_scenes")
def _begin(spark, scenes):
    rows = scenes.select("id", "roi", "sensed_us", "status", "error")
    return writes.begin(rows, rows.filter("sensed_us % 360000000 = 0"))


_OUTCOMES = "SELECT concat('S', cast(o_custkey % 120 AS {str})) AS scene_id, o_orderkey AS seq, CASE WHEN o_orderstatus = 'F' THEN 'failed' ELSE 'processed' END AS status, concat('token abc123 in ', o_orderpriority) AS error, o_orderkey * 1000 AS processed_us FROM {orders}"


@query("d08_finish", oracle(f""", o AS ({_OUTCOMES.replace('{str}', 'varchar').replace('{orders}', 'orders')}), l AS (SELECT scene_id, arg_max(status, seq) AS st, arg_max(error, seq) AS er, arg_max(processed_us, seq) AS pr FROM o GROUP BY 1)
SELECT id, coalesce(st, status) AS status, CASE WHEN st = 'failed' THEN replace(er, 'abc123', '[redacted]') WHEN st IS NULL THEN error END AS error, CASE WHEN st = 'processed' THEN pr ELSE processed_us END AS processed_us FROM sar_scenes LEFT JOIN l ON l.scene_id = id""", "sar_scenes"))
def _finish(spark, sf_dir):
    (scenes,) = domain(spark, sf_dir, "sar_scenes")
    log = spark.sql(_OUTCOMES.replace("{str}", "string"), orders=_table(spark, sf_dir, "orders"))
    return writes.finish(scenes.select("id", "status", "error", "processed_us"), log, ["abc123"])


@query("d09_reap", oracle(" SELECT id, CASE WHEN status = 'processing' THEN 'failed' ELSE status END AS status, CASE WHEN status = 'processing' THEN 'interrupted by restart' ELSE error END AS error FROM sar_scenes", "sar_scenes"))
@_d("sar_scenes")
def _reap(spark, scenes):
    return writes.reap(scenes.select("id", "status", "error"))


@query("d14_delete_region", oracle(f" SELECT 'scene' AS kind, id AS ref FROM sar_scenes WHERE roi <> '{ROI}' UNION ALL SELECT 'detection', d.id::VARCHAR FROM sar_detections d JOIN sar_scenes s ON s.id = d.scene_id WHERE s.roi <> '{ROI}'", "ais_positions", "sar_scenes", "sar_detections"))
@_d("sar_scenes", "sar_detections")
def _delete(spark, scenes, detections):
    s, d = writes.delete_scenes(scenes, detections, roi=ROI)
    return s.select(F.lit("scene").alias("kind"), F.col("id").alias("ref")).union(d.select(F.lit("detection"), F.col("id").cast("string")))


@query("d14_delete_month", oracle(f" SELECT id, roi, round(pu, 3) AS pu FROM pu_ledger WHERE NOT (roi = '{ROI}' AND spent_us >= epoch_us(date_trunc('month', make_timestamp({LEDGER_NOW - 200 * 86_400_000_000}))))", "pu_ledger"))
@_d("pu_ledger")
def _delete_month(spark, ledger):
    return writes.delete_spending(ledger, scope="month", now_us=LEDGER_NOW - 200 * 86_400_000_000, roi=ROI).select("id", "roi", _r("pu", 3))


@query("d14_delete_box", oracle(""", p AS (SELECT *, lon BETWEEN 121 AND 121.5 AND lat BETWEEN 25 AND 25.5 AS gone FROM ais_positions), v AS (SELECT mmsi, bool_and(gone) AS lost FROM p GROUP BY 1)
SELECT 'position' AS kind, id AS ref FROM p WHERE NOT gone UNION ALL SELECT 'ship', m.mmsi FROM ship_metadata m LEFT JOIN v ON v.mmsi = m.mmsi WHERE NOT coalesce(lost, false)""", "ais_positions", "ship_metadata"))
@_d("ais_positions", "ship_metadata")
def _delete_box(spark, positions, ships):
    p, s = writes.delete_messages(positions, ships, box=(121.0, 25.0, 121.5, 25.5))
    return p.select(F.lit("position").alias("kind"), F.col("id").alias("ref")).union(s.select(F.lit("ship"), "mmsi"))


@query("d18_added_columns", "SELECT n_nationkey, n_name, NULL::BOOLEAN AS on_land, NULL::DOUBLE AS chance_rate FROM nation")
def _added(spark, sf_dir):
    return writes.add_columns(_table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), "n_name string, on_land boolean, chance_rate double")


#: The ledger's last day, early in a month: something is spent and some of the ceiling is left.
_SPENDING = LEDGER_NOW + 13 * 86_400_000_000
_MONTH = f"SELECT coalesce(sum(pu), 0e0) AS pu FROM pu_ledger WHERE spent_us >= epoch_us(date_trunc('month', make_timestamp({_SPENDING})))"
_CHARGED = f""", spent AS (SELECT DISTINCT scene_id FROM pu_ledger), g AS ({_GRID}), m AS ({_MONTH}), t AS (SELECT s.id, s.roi, CASE WHEN status IN ('processed', 'processing') THEN false ELSE sp.scene_id IS NULL AND m.pu + g.pu <= 25000e0 END AS go, g.pu AS pu_cost FROM sar_scenes s CROSS JOIN m JOIN g ON g.name = s.roi LEFT JOIN spent sp ON sp.scene_id = s.id)"""


@query("d10_charge", oracle(f"{_CHARGED} SELECT roi, id AS scene_id, round(pu_cost, 6) AS pu, {_SPENDING} AS spent_us FROM t WHERE go", "sar_scenes", "pu_ledger"))
@_d("sar_scenes", "pu_ledger")
def _charge(spark, scenes, ledger):
    cost = scheduling.monthly_cost(registry.regions(spark)).select(F.col("name").alias("roi"), F.col("pu").alias("pu_cost"))
    spent = scheduling.spent_scenes(ledger).select(F.col("scene_id").alias("id"), F.lit(True).alias("has_pu_spend"))
    facts = scenes.join(spent, "id", "left").join(F.broadcast(cost), "roi").withColumn("has_pu_spend", F.coalesce("has_pu_spend", F.lit(False)))
    facts = facts.crossJoin(F.broadcast(scheduling.month_to_date(ledger, _SPENDING).withColumnRenamed("pu", "month_to_date_pu")))  # one row
    return scheduling.charge(scheduling.decide(facts).withColumnRenamed("id", "scene_id"), _SPENDING).withColumn("pu", F.round("pu", 6))


_COMMANDS = "SELECT event_id AS seq, CASE event_id % 11 WHEN 0 THEN 'post' WHEN 5 THEN CASE WHEN event_id % 3 = 0 THEN 'clear' ELSE 'post' END ELSE 'toggle' END AS command, concat('m', cast(event_id AS {str})) AS message, CASE WHEN event_id % 2 = 0 THEN 'warning' ELSE 'critical' END AS level, cast(NULL AS {str}) AS title, event_id * 10 AS at_us, user_id % 5 AS grp FROM {events}"


@query("d16_status", f"""WITH l AS ({_COMMANDS.replace('{str}', 'varchar').replace('{events}', 'events')}), s AS (SELECT * FROM l WHERE command <> 'toggle' ORDER BY seq DESC LIMIT 1), t AS (SELECT count(*) AS n, max(l.at_us) AS last_at FROM l, s WHERE l.command = 'toggle' AND s.command = 'post' AND l.seq > s.seq)
SELECT CASE WHEN command = 'post' THEN message END AS message, CASE WHEN command = 'post' THEN level ELSE 'warning' END AS level, title, command = 'post' AND n % 2 = 0 AS active, coalesce(last_at, at_us) AS updated_us FROM s, t""")
def _status_row(spark, sf_dir):
    log = spark.sql(_COMMANDS.replace("{str}", "string"), events=_table(spark, sf_dir, "events"))
    return writes.status_of(log.drop("grp"))


# transfer ---------------------------------------------------------------------------------------


@query("u01_named_vessels", _fuse_sql("SELECT matched_mmsi AS mmsi FROM final WHERE matched_mmsi IS NOT NULL UNION SELECT candidate_mmsi FROM final WHERE candidate_mmsi IS NOT NULL"))
def _named(spark, sf_dir):
    return transfer.named_vessels(_stored(spark, sf_dir).detections)


@query("u02_orphans", oracle(" SELECT DISTINCT scene_id FROM pu_ledger EXCEPT SELECT id FROM sar_scenes", "sar_scenes", "pu_ledger"))
@_d("sar_scenes", "pu_ledger")
def _orphans(spark, scenes, ledger):
    return transfer.orphans(ledger, scenes)


_OWN = f"final f JOIN sar_scenes s ON s.id = f.scene_id WHERE s.roi = '{ROI}'"
#: The fields of an exported line, of all kinds.
_LINE = """kind string, version int, id string, name string, roi string, sensed_us long, min_lon double, min_lat double, max_lon double, max_lat double, platform string, status string,
processed_us long, error string, overview_png string, scene_id string, lon double, lat double, confidence double, confidence_bucket string, on_land boolean, match_state string, is_dark boolean,
matched_mmsi long, candidate_mmsi long, match_distance_m double, match_time_delta_s double, dark_margin_m double, mmsi long, ship_name string, ship_type int, callsign string, updated_us long"""
_PLACES = {"min_lon": 6, "min_lat": 6, "max_lon": 6, "max_lat": 6, "lon": 6, "lat": 6, "match_distance_m": 3, "dark_margin_m": 3}


@query("u05_export", _fuse_sql(f"""SELECT 0 AS rank, NULL::VARCHAR AS k1, 0::BIGINT AS k2, NULL::VARCHAR AS k3, 2 AS n_fields, 'meta' AS kind, 1 AS version
UNION ALL BY NAME SELECT 1 AS rank, roi AS k1, sensed_us AS k2, id AS k3, 14 AS n_fields, 'scene' AS kind, id, name, roi, sensed_us, round(min_lon, 6) AS min_lon, round(min_lat, 6) AS min_lat,
  round(max_lon, 6) AS max_lon, round(max_lat, 6) AS max_lat, platform, status, processed_us, error, to_base64(overview_png) AS overview_png FROM sar_scenes WHERE roi = '{ROI}'
UNION ALL BY NAME SELECT 2 AS rank, f.scene_id AS k1, f.id AS k2, 15 AS n_fields, 'detection' AS kind, f.id::VARCHAR AS id, f.scene_id, round(f.lon, 6) AS lon, round(f.lat, 6) AS lat, confidence, confidence_bucket, on_land,
  match_state, is_dark, matched_mmsi, candidate_mmsi, round(match_distance_m, 3) AS match_distance_m, match_time_delta_s, round(dark_margin_m, 3) AS dark_margin_m FROM {_OWN}
UNION ALL BY NAME SELECT 3 AS rank, m.mmsi AS k2, 6 AS n_fields, 'ship' AS kind, m.mmsi, ship_name, ship_type, callsign, updated_us FROM ship_metadata m
  WHERE m.mmsi IN (SELECT matched_mmsi FROM {_OWN} UNION SELECT candidate_mmsi FROM {_OWN})"""))
def _export(spark, sf_dir):
    """Every exported line, taken apart again: the order keys, the number of fields, and all fields."""
    scenes, ships = domain(spark, sf_dir, "sar_scenes", "ship_metadata")
    lines = transfer.export_records(scenes.drop("ring"), _stored(spark, sf_dir).detections, ships, [ROI])
    fields = F.size(F.json_object_keys("value")).alias("n_fields")
    out = lines.select("rank", "k1", "k2", "k3", fields, F.from_json("value", _LINE).alias("v")).select("rank", "k1", "k2", "k3", "n_fields", "v.*")
    return out.withColumns({c: F.round(c, n) for c, n in _PLACES.items()})


_TAKEN = f"(SELECT id FROM sar_scenes WHERE roi = '{ROI}')"


@query("d13_import", oracle(f""" SELECT 'scene' AS kind, id AS ref, CASE WHEN roi = '{ROI}' THEN 'imported' ELSE status END AS told, sensed_us AS at FROM sar_scenes
UNION ALL SELECT 'detection', (id + CASE WHEN scene_id IN {_TAKEN} THEN 1000000000 ELSE 0 END)::VARCHAR, scene_id, id FROM sar_detections
UNION ALL SELECT 'ship', mmsi::VARCHAR, CASE WHEN mmsi IN (SELECT id FROM sar_detections WHERE scene_id IN {_TAKEN}) THEN 'NEW' ELSE callsign END, updated_us + CASE WHEN mmsi IN (SELECT id FROM sar_detections WHERE scene_id IN {_TAKEN}) THEN 5 ELSE 0 END FROM ship_metadata""", "ais_positions", "sar_scenes", "sar_detections", "ship_metadata"))
@_d("sar_scenes", "sar_detections", "ship_metadata")
def _import(spark, scenes, detections, ships):
    """A region's scenes, detections and vessels, exported elsewhere with other values, over the stored tables."""
    root = f"{shared_folder(spark)}/tidewake-import-{uuid.uuid4().hex}"
    scenes, detections = scenes.drop("ring"), detections.withColumns({"matched_mmsi": F.col("id"), "candidate_mmsi": F.lit(None).cast("long")})
    versions.replace(spark, root, {"scenes": scenes, "detections": detections, "ships": ships})
    theirs = scenes.withColumn("status", F.lit("imported")), detections.withColumn("id", F.col("id") + 1_000_000_000), ships.withColumns({"callsign": F.lit("NEW"), "updated_us": F.col("updated_us") + 5})
    transfer.write_records(transfer.export_records(*theirs, [ROI]), f"{root}/export")
    records = transfer.read_records(spark, f"{root}/export", *(", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema) for df in (scenes, detections, ships)))
    _, version = versions.import_records(spark, root, records, force=True)
    s, d, v = (versions.read(spark, root, t, version) for t in ("scenes", "detections", "ships"))
    parts = (("scene", s, "id", "status", "sensed_us"), ("detection", d, "id", "scene_id", "matched_mmsi"), ("ship", v, "mmsi", "callsign", "updated_us"))
    s, d, v = (df.select(F.lit(kind).alias("kind"), F.col(ref).cast("string").alias("ref"), F.col(told).alias("told"), F.col(at).cast("long").alias("at")) for kind, df, ref, told, at in parts)
    return s.union(d).union(v)


@query("p02_shaped", oracle(" SELECT id, roi, cast(sensed_us AS VARCHAR) AS sensed_us, NULL::DOUBLE AS chance_rate FROM sar_scenes", "sar_scenes"))
@_d("sar_scenes")
def _shaped(spark, scenes):
    return routes.shaped(scenes, "id string, roi string, sensed_us string, chance_rate double")


@query("p08_scenes_of_region", _fuse_sql(f"SELECT s.id, s.sensed_us, coalesce(n, 0) AS detection_count FROM (SELECT * FROM sar_scenes WHERE roi = '{ROI}' ORDER BY sensed_us DESC, id LIMIT 10) s LEFT JOIN (SELECT scene_id, count(*) AS n FROM final GROUP BY 1) f ON f.scene_id = s.id"))
def _of_region(spark, sf_dir):
    return routes.scene_list(*domain(spark, sf_dir, "sar_scenes"), _stored(spark, sf_dir).detections, ROI).select("id", "sensed_us", "detection_count")


@query("a10_spent_scenes", oracle(" SELECT id, EXISTS (SELECT 1 FROM pu_ledger l WHERE l.scene_id = s.id) AS spent FROM sar_scenes s", "sar_scenes", "pu_ledger"))
@_d("sar_scenes", "pu_ledger")
def _spent(spark, scenes, ledger):
    spent = scheduling.spent_scenes(ledger).withColumn("spent", F.lit(True))
    return scenes.select(F.col("id").alias("scene_id")).join(spent, "scene_id", "left").select(F.col("scene_id").alias("id"), F.coalesce("spent", F.lit(False)).alias("spent"))


@query("a21_scene_lists", oracle(" SELECT scene_id, string_agg(id::VARCHAR, ',' ORDER BY id) AS ids FROM sar_detections GROUP BY 1", "ais_positions", "sar_detections"))
@_d("sar_detections")
def _lists(spark, detections):
    return routes.rows_by_scene(detections, "id").select("scene_id", F.array_join(F.transform("ids", lambda i: i.cast("string")), ",").alias("ids"))


@query("p19_recent_scenes", oracle(" SELECT id, sensed_us FROM sar_scenes WHERE sensed_us >= 5000000000", "sar_scenes"))
@_d("sar_scenes")
def _recent(spark, scenes):
    return scheduling.recent_scenes(scenes, 5_000_000_000 + 7 * 86_400_000_000).select("id", "sensed_us")


_AT = 16_000_000_000
_TAIWAN = registry.region(ROI)
_BX = {c: repr(float(_TAIWAN[f"sar_{c}"])) + "e0" for c in ("min_lon", "min_lat", "max_lon", "max_lat")}
#: Share of the box that the footprints of each mosaic cover: slabs between all corners and crossings, the union's length in the middle of each.
_COVERED = f"""fp AS (SELECT a.id AS anchor, a.roi, s.min_lon AS x0, s.max_lon AS x1, s.tilt / (s.max_lon - s.min_lon) AS m, s.min_lat - s.tilt / (s.max_lon - s.min_lon) * s.min_lon AS c0,
  s.max_lat - s.tilt - s.tilt / (s.max_lon - s.min_lon) * s.min_lon AS c1 FROM sar_scenes a JOIN sar_scenes s ON s.roi = a.roi AND s.sensed_us BETWEEN a.sensed_us - 60000000 AND a.sensed_us + 600000000),
ln AS (SELECT anchor, m, c0 AS c FROM fp UNION SELECT anchor, m, c1 FROM fp UNION SELECT anchor, 0e0, {_BX['min_lat']} FROM fp UNION SELECT anchor, 0e0, {_BX['max_lat']} FROM fp),
br AS (SELECT anchor, greatest(x0, {_BX['min_lon']}) AS x FROM fp UNION SELECT anchor, least(x1, {_BX['max_lon']}) FROM fp UNION SELECT a.anchor, (b.c - a.c) / (a.m - b.m) FROM ln a JOIN ln b ON a.anchor = b.anchor AND a.m > b.m),
sl AS (SELECT anchor, x AS l, lead(x) OVER (PARTITION BY anchor ORDER BY x) AS r FROM br WHERE x BETWEEN {_BX['min_lon']} AND {_BX['max_lon']}),
iv AS (SELECT sl.anchor, l, r, greatest(c0 + m * (l + r) / 2, {_BX['min_lat']}) AS s, least(c1 + m * (l + r) / 2, {_BX['max_lat']}) AS e FROM sl JOIN fp ON fp.anchor = sl.anchor AND (l + r) / 2 BETWEEN fp.x0 AND fp.x1),
un AS (SELECT anchor, l, r, greatest(0e0, e - greatest(s, coalesce(max(e) OVER (PARTITION BY anchor, l ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), s))) AS len FROM iv WHERE e > s),
covered AS (SELECT id AS anchor, coalesce(u.area, 0e0) / (({_BX['max_lon']} - {_BX['min_lon']}) * ({_BX['max_lat']} - {_BX['min_lat']})) AS coverage FROM sar_scenes LEFT JOIN (SELECT anchor, sum((r - l) * len) AS area FROM un GROUP BY 1) u ON u.anchor = id)"""


def _coverage(spark, scenes):
    """Coverage of one box, in which all footprints of the test tables lie, for every region's passes."""
    boxes = registry.regions(spark).select("name", *(F.lit(float(_TAIWAN[f"sar_{c}"])).alias(f"sar_{c}") for c in ("min_lon", "min_lat", "max_lon", "max_lat")))
    return scheduling.scene_coverage(scenes, boxes)


@query("a11_coverage", oracle(f", {_COVERED} SELECT anchor, round(coverage, 9) AS coverage FROM covered", "sar_scenes"))
@_d("sar_scenes")
def _mosaic_coverage(spark, scenes):
    return _coverage(spark, scenes).select("anchor", _r("coverage", 9))


_L = "l.min_lon, l.min_lat, l.max_lon, l.max_lat"
#: Area of a box under a sloping strip: its length is linear between the places where the strip's edges meet the box's.
_IN_STRIP = """strips AS (SELECT s.id AS scene_id, l.id AS land_id, b.*, greatest(b.bx0, s.min_lon) AS x0, least(b.bx1, s.max_lon) AS x1, s.tilt / (s.max_lon - s.min_lon) AS m, s.min_lat - s.tilt / (s.max_lon - s.min_lon) * s.min_lon AS c0,
  s.max_lat - s.tilt - s.tilt / (s.max_lon - s.min_lon) * s.min_lon AS c1
  FROM sar_scenes s, land_polygons l, LATERAL (SELECT l.min_lon AS bx0, l.max_lon AS bx1, l.min_lat AS by0, (l.min_lat + l.max_lat) / 2 AS by1 UNION ALL SELECT l.min_lon, (l.min_lon + l.max_lon) / 2, (l.min_lat + l.max_lat) / 2, l.max_lat) b),
ends AS (SELECT *, unnest([x0, x1, (by0 - c0) / m, (by1 - c0) / m, (by0 - c1) / m, (by1 - c1) / m]) AS x FROM strips WHERE x0 < x1),
steps AS (SELECT *, lead(x) OVER (PARTITION BY scene_id, land_id, by0 ORDER BY x) AS nx FROM ends WHERE x BETWEEN x0 AND x1)
SELECT scene_id, land_id, round(sum((nx - x) * greatest(0e0, least(c1 + m * (x + nx) / 2, by1) - greatest(c0 + m * (x + nx) / 2, by0))) * 12392.1424e0 * cos(radians(25.5e0)), 6) AS area_km2 FROM steps WHERE nx > x GROUP BY 1, 2 HAVING area_km2 > 0"""


@query("g10_land_in_scenes", oracle(f", {_IN_STRIP}", "sar_scenes", "land_polygons"))
@_d("sar_scenes", "land_polygons")
def _land_in_scenes(spark, scenes, land):
    return views.land_in_scenes(scenes, land).select("scene_id", "land_id", F.round(F.col("area") * 12392.1424 * F.cos(F.radians(F.lit(25.5))), 6).alias("area_km2")).filter("area_km2 > 0")


_CHOICE = f""", {_COVERED}, c AS (SELECT r.name, r.mode, (SELECT min(time_us) FROM ais_positions WHERE lon > r.ais_min_lon AND lon < r.ais_max_lon AND lat > r.ais_min_lat AND lat < r.ais_max_lat) AS lo,
(SELECT max(time_us) FROM ais_positions WHERE lon > r.ais_min_lon AND lon < r.ais_max_lon AND lat > r.ais_min_lat AND lat < r.ais_max_lat) AS hi FROM {_REGIONS} r),
s AS (SELECT c.*, x.id, x.sensed_us, coalesce(cv.coverage, 0e0) AS cover, c.mode = 'survey' OR coalesce(x.sensed_us - 7200000000 >= lo AND x.sensed_us + 7200000000 <= hi, false) AS ok, x.sensed_us > {_AT} - 10800000000 AS young FROM c LEFT JOIN sar_scenes x ON x.roi = c.name AND x.sensed_us >= {_AT} - 604800000000 LEFT JOIN covered cv ON cv.anchor = x.id),
per AS (SELECT name, mode, lo, hi, count(id) AS passes, count(*) FILTER (WHERE ok AND id IS NOT NULL) AS good, count(*) FILTER (WHERE ok AND young) AS skipped, max(cover) FILTER (WHERE ok AND NOT young) AS best_coverage,
  arg_max(id, (sensed_us, id)) FILTER (WHERE ok AND NOT young AND cover >= 0.85e0) AS pick FROM s GROUP BY 1, 2, 3, 4),
chosen AS (SELECT name, mode, CASE WHEN mode <> 'survey' AND {_AT} - hi > 7200000000 THEN NULL ELSE pick END AS scene_id, CASE WHEN mode <> 'survey' AND {_AT} - hi > 7200000000 THEN 'messages are stale' WHEN pick IS NOT NULL THEN NULL WHEN passes = 0 THEN 'no recent pass' WHEN mode <> 'survey' AND lo IS NULL THEN 'no messages in the region' WHEN good = 0 THEN 'no bracketed pass' ELSE 'no pass covers enough' END AS reason,
  skipped, round(best_coverage, 6) AS best_coverage FROM per)"""


def _chosen(spark, positions, scenes):
    return scheduling.choose_scenes(scenes, _coverage(spark, scenes).select("anchor", "coverage"), positions, registry.regions(spark), _AT)


@query("st19_scene_choice", oracle(f"{_CHOICE} SELECT * FROM chosen", "ais_positions", "sar_scenes"))
@_d("ais_positions", "sar_scenes")
def _choice(spark, positions, scenes):
    return _chosen(spark, positions, scenes).withColumn("best_coverage", F.round("best_coverage", 6))


@query("st15_sweep", oracle(f"""{_CHOICE}, g AS ({_GRID}), spent AS (SELECT DISTINCT scene_id FROM pu_ledger), d AS (SELECT c.name, c.scene_id, c.reason, x.status, sp.scene_id IS NOT NULL AS spent, g.pu, m.pu AS month_pu, g.name IN ('malta_hurds_bank', 'kharg_island') AS held FROM chosen c CROSS JOIN ({_MONTH}) m JOIN g ON g.name = c.name LEFT JOIN sar_scenes x ON x.id = c.scene_id LEFT JOIN spent sp ON sp.scene_id = c.scene_id)
SELECT name, scene_id, CASE WHEN held THEN 'held' WHEN scene_id IS NULL THEN reason WHEN status = 'processed' THEN 'already analyzed' WHEN status = 'processing' THEN 'already running' WHEN spent THEN 'already spent' WHEN month_pu + pu > 25000e0 THEN 'over ceiling' WHEN status IS NULL THEN 'new pass' ELSE 'retry' END AS reason,
NOT held AND scene_id IS NOT NULL AND coalesce(status, '') NOT IN ('processed', 'processing') AND NOT spent AND month_pu + pu <= 25000e0 AS analyze, round(pu, 6) AS pu_cost FROM d""", "ais_positions", "sar_scenes", "pu_ledger"))
@_d("ais_positions", "sar_scenes", "pu_ledger")
def _sweep(spark, positions, scenes, ledger):
    regions = registry.regions(spark)
    held = regions.filter(F.col("name").isin("malta_hurds_bank", "kharg_island")).select("name", F.lit("warming up").alias("reason"))
    out = scheduling.sweep(_chosen(spark, positions, scenes), held, scenes, ledger, regions, _SPENDING)
    return out.withColumn("pu_cost", F.round("pu_cost", 6))


@query("st23_refuse_skipped", oracle(f""", x AS (SELECT min(time_us) AS lo, max(time_us) AS hi FROM ais_positions)
SELECT s.id, s.roi, CASE WHEN m.mode = 'survey' THEN 'survey region' ELSE 'not bracketed' END AS reason FROM sar_scenes s JOIN {_MODES} m ON m.roi = s.roi, x WHERE s.status = 'processed' AND (m.mode = 'survey' OR NOT coalesce(s.sensed_us - 7200000000 >= lo AND s.sensed_us + 7200000000 <= hi, false))""", "ais_positions", "sar_scenes"))
@_d(*_DOMAIN)
def _refused(spark, positions, detections, scenes, ships, land):
    return views.skipped_scenes(positions, scenes, registry.regions(spark).select(F.col("name").alias("roi"), "mode"))


@query("st23_refuse", _fuse_sql("""SELECT f.id, f.scene_id, f.on_land, f.match_state, f.is_dark, f.matched_mmsi, f.candidate_mmsi, round(f.dark_margin_m, 3) AS dark_margin_m
FROM final f JOIN sc ON sc.id = f.scene_id JOIN sar_scenes s ON s.id = f.scene_id CROSS JOIN (SELECT min(time_us) AS lo, max(time_us) AS hi FROM ais_positions) x
WHERE s.status = 'processed' AND sc.mode <> 'survey' AND s.sensed_us - 1800000000 >= lo AND s.sensed_us + 1800000000 <= hi"""))
@_d(*_DOMAIN)
def _refused_again(spark, positions, detections, scenes, ships, land):
    modes = registry.regions(spark).select(F.col("name").alias("roi"), "mode")
    again, _ = views.refuse(positions, detections, scenes, ships, land, modes, bracket_h=0.5)
    return again.detections.select("id", "scene_id", "on_land", "match_state", "is_dark", "matched_mmsi", "candidate_mmsi", _r("dark_margin_m", 3))


@query("st25_health_report", oracle(f"""{_GATE} SELECT h.min_us, h.max_us, h.gap_us AS last_gap_end_us, fused_ready, survey_ready, 12 AS regions, (SELECT count(*) FROM {_REGIONS} r WHERE CASE WHEN r.mode = 'survey' THEN survey_ready ELSE fused_ready END) AS ready,
(SELECT string_agg(r.name, ',' ORDER BY r.name) FROM {_REGIONS} r WHERE NOT CASE WHEN r.mode = 'survey' THEN survey_ready ELSE fused_ready END) AS held FROM h, gate""", "ais_positions"))
@_d("ais_positions")
def _health_report(spark, positions):
    health = scheduling.ais_health(positions, NOW)
    gate = scheduling.survey_gate(scheduling.fused_gate(health, NOW), NOW, NOW - scheduling.HOUR)
    out = views.health_report(health, gate, registry.regions(spark))
    return out.select("min_us", "max_us", "last_gap_end_us", "fused_ready", "survey_ready", F.col("regions").cast("int").alias("regions"), "ready", F.when(F.size("held") > 0, F.array_join("held", ",")).alias("held"))


@query("t13_land_by_region", oracle(f" SELECT r.name, count(*) AS polygons FROM land_polygons l JOIN {_REGIONS} r ON l.min_lon <= r.ais_max_lon AND r.ais_min_lon <= l.max_lon AND l.min_lat <= r.ais_max_lat AND r.ais_min_lat <= l.max_lat GROUP BY 1", "land_polygons"))
@_d("land_polygons")
def _land(spark, land):
    return views.land_by_region(land, registry.regions(spark))


_K = "cast(n_nationkey AS double)"


@query("g15_region_wkt", f"""WITH b AS (SELECT n_regionkey, n_nationkey, {_K} AS x0, 0e0 - {_K} AS y0, {_K} + 2 AS x1, {_K} * 2 + 1 AS y1 FROM nation) SELECT n_regionkey, concat('MULTIPOLYGON(', string_agg(concat('((', x0, ' ', y0, ',', x1, ' ', y0, ',', x1, ' ', y1, ',', x0, ' ', y1, ',', x0, ' ', y0, '))'), ',' ORDER BY n_nationkey), ')') AS wkt FROM b GROUP BY 1""")
def _region_wkt(spark, sf_dir):
    return _nation_boxes(spark, sf_dir).groupBy("n_regionkey").agg(F.sort_array(F.collect_list(F.struct("n_nationkey", "ring"))).alias("r")).select("n_regionkey", rings.multi_wkt(F.col("r.ring")).alias("wkt"))


def _nation_boxes(spark, sf_dir):
    k = F.col("n_nationkey").cast("double")
    return _table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey", rings.box_ring(k, F.negative(k) + 0.0, k + 2.0, k * 2.0 + 1.0).alias("ring"))


@query("g12_parsed_polygons", """WITH n AS (SELECT n_regionkey, 3e0 * n_nationkey + 1 AS h FROM nation) SELECT n_regionkey, count(*) AS polygons, 0::BIGINT AS holes, sum(2 * h) AS area FROM n GROUP BY 1""")
def _parsed(spark, sf_dir):
    rows = _region_wkt(spark, sf_dir).select("n_regionkey", F.explode(rings.parse_polygons(F.concat(F.lit("SRID=4326;"), F.col("wkt")))).alias("p"))
    return rows.groupBy("n_regionkey").agg(F.count("*").alias("polygons"), F.sum(F.size("p") - 1).alias("holes"), F.sum(rings.area(rings.tidy(F.col("p")[0]))).alias("area"))


@query("g13_ewkt", f"""SELECT n_nationkey, concat('SRID=4326;POLYGON((', x0, ' ', y0, ',', x1, ' ', y0, ',', x1, ' ', y1, ',', x0, ' ', y1, ',', x0, ' ', y0, '))') AS wkt FROM (SELECT n_nationkey, {_K} AS x0, 0e0 - {_K} AS y0, {_K} + 2 AS x1, {_K} * 2 + 1 AS y1 FROM nation)""")
def _ewkt(spark, sf_dir):
    return _nation_boxes(spark, sf_dir).select("n_nationkey", rings.to_ewkt(F.col("ring")).alias("wkt"))


@query("s21_overviews", oracle(" SELECT id, processed_us, octet_length(overview_png) AS bytes FROM sar_scenes WHERE overview_png IS NOT NULL AND processed_us > 7000000000", "sar_scenes"))
@_d("sar_scenes")
def _overviews(spark, scenes):
    return routes.overviews(scenes, 7_000_000_000).select("id", "processed_us", F.octet_length("overview_png").cast("long").alias("bytes"))


@query("s22_points", oracle(" SELECT scene_id, count(*) AS n, round(sum(lon), 6) AS lon, round(sum(lat), 6) AS lat FROM sar_detections GROUP BY 1", "ais_positions", "sar_detections"))
@_d("sar_detections")
def _points(spark, detections):
    lists = detections.groupBy("scene_id").agg(F.collect_list("lon").alias("xs"), F.collect_list("lat").alias("ys"))
    return routes.points(lists, "xs", "ys").groupBy("scene_id").agg(F.count("*").alias("n"), F.round(F.sum("lon"), 6).alias("lon"), F.round(F.sum("lat"), 6).alias("lat"))


# rasters and labels -----------------------------------------------------------------------------


def _tile_sql(side: str, tile: int, step: int) -> str:
    return f"(SELECT unnest(CASE WHEN {side} > {tile} THEN generate_series(0, {side} - {tile}, {step}) ELSE [0] END) AS o UNION SELECT greatest({side} - {tile}, 0))"


def _over_scenes(select: str) -> str:
    return oracle(f", g AS ({_SCENE_GRID}) {select}", "sar_scenes")


@query("c09_tiles", _over_scenes(f"SELECT g.id, x.o AS x_off, y.o AS y_off FROM g, LATERAL {_tile_sql('g.width', 800, 640)} x, LATERAL {_tile_sql('g.height', 800, 640)} y"))
@_d("sar_scenes")
def _tiles(spark, scenes):
    return raster.tiles(scheduling.pass_costs(scenes), 800, 160).select("id", "x_off", "y_off")


@query("c10_windows", _over_scenes(f"SELECT g.id, x.o AS x_off, y.o AS y_off FROM g, LATERAL {_tile_sql('g.width', 512, 512)} x, LATERAL {_tile_sql('g.height', 512, 512)} y"))
@_d("sar_scenes")
def _windows(spark, scenes):
    return raster.tiles(scheduling.pass_costs(scenes), 512).select("id", "x_off", "y_off")


@query("c08_spans", _over_scenes("""SELECT id, i * (width // n) + least(i, width % n) AS "offset", width // n + CASE WHEN i < width % n THEN 1 ELSE 0 END AS length
FROM (SELECT *, unnest(generate_series(0, n - 1)) AS i FROM (SELECT id, width, ceil(width / 2400)::BIGINT AS n FROM g))"""))
@_d("sar_scenes")
def _spans(spark, scenes):
    rows = scheduling.pass_costs(scenes).withColumn("s", F.explode(scheduling.spans(F.col("width"), 2400)))
    return rows.select("id", "s.offset", "s.length")


_PIX = "d.lon, d.lat, s.min_lon, s.min_lat, s.max_lon, s.max_lat"


@query("g16_pixels", oracle(" SELECT d.id, round((d.lon - s.min_lon) / (s.max_lon - s.min_lon) * 4096, 6) AS px, round((s.max_lat - d.lat) / (s.max_lat - s.min_lat) * 2048, 6) AS py, round(d.lon, 9) AS lon, round(d.lat, 9) AS lat FROM sar_detections d JOIN sar_scenes s ON s.id = d.scene_id", "ais_positions", "sar_detections", "sar_scenes"))
@_d("sar_detections", "sar_scenes")
def _pixels(spark, detections, scenes):
    rows = detections.join(scenes.select(F.col("id").alias("scene_id"), *_BOX), "scene_id")
    rows = rows.withColumn("px", F.expr(geo.lon_to_pixel("lon", "4096", _BOX))).withColumn("py", F.expr(geo.lat_to_pixel("lat", "2048", _BOX)))
    back = rows.withColumn("b_lon", F.expr(geo.pixel_to_lon("px", "4096", _BOX))).withColumn("b_lat", F.expr(geo.pixel_to_lat("py", "2048", _BOX)))
    return back.select("id", _r("px", 6), _r("py", 6), F.round("b_lon", 9).alias("lon"), F.round("b_lat", 9).alias("lat"))


@query("c26_crops", oracle(" SELECT d.id, round((d.lon - s.min_lon) / (s.max_lon - s.min_lon) * 1024 - 1024 * 0.09 / 2, 6) AS x, round((s.max_lat - d.lat) / (s.max_lat - s.min_lat) * 768 - 1024 * 0.09 * 168 / 300 / 2, 6) AS y, round(1024 * 0.09, 6)::DOUBLE AS w, round(1024 * 0.09 * 168 / 300, 6)::DOUBLE AS h FROM sar_detections d JOIN sar_scenes s ON s.id = d.scene_id", "ais_positions", "sar_detections", "sar_scenes"))
@_d("sar_detections", "sar_scenes")
def _crops(spark, detections, scenes):
    rows = detections.join(scenes.select(F.col("id").alias("scene_id"), *_BOX), "scene_id").withColumn("c", views.crop(F.col("lon"), F.col("lat"), _BOX, F.lit(1024.0), F.lit(768.0)))
    return rows.select("id", *(F.round(f"c.{k}", 6).alias(k) for k in ("x", "y", "w", "h")))


@query("c13_buckets", oracle(" SELECT CASE WHEN confidence >= 0.6 THEN 'high' WHEN confidence >= 0.25 THEN 'medium' ELSE 'low' END AS bucket, count(*) AS n FROM sar_detections GROUP BY 1", "ais_positions", "sar_detections"))
@_d("sar_detections")
def _buckets(spark, detections):
    return detections.groupBy(labels.confidence_bucket(F.col("confidence")).alias("bucket")).agg(F.count("*").alias("n"))


@query("c18_max_pool", "SELECT (event_id % 331) // 4 AS x, (user_id % 47) // 4 AS y, max(value) AS v FROM events GROUP BY 1, 2")
def _pool(spark, sf_dir):
    return raster.pool_pixels(_table(spark, sf_dir, "events").select((F.col("event_id") % 331).alias("x"), (F.col("user_id") % 47).alias("y"), F.col("value").alias("v")), 4)


@query("a15_mask_share", "SELECT concat('S', user_id % 9) AS scene_id, round(avg(CASE WHEN value > 250 THEN 255 ELSE 0 END) / 255, 9) AS share FROM events GROUP BY 1")
def _mask_share(spark, sf_dir):
    e = _table(spark, sf_dir, "events").select(F.concat(F.lit("S"), (F.col("user_id") % 9).cast("string")).alias("scene_id"), F.when(F.col("value") > 250, 255).otherwise(0).alias("mask"))
    return raster.mask_share(e).withColumn("share", F.round("share", 9))


@query("c22_sigma_db", "SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber > 1 THEN round(10 * log10(l_quantity * l_quantity / ((1 + l_discount) * (1 + l_discount))), 9) END AS db FROM lineitem")
def _sigma(spark, sf_dir):
    dn = F.when(F.col("l_linenumber") > 1, F.col("l_quantity")).otherwise(0.0)
    db = raster.sigma_db(dn, 1 + F.col("l_discount"))
    return _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.when(~F.isnan(db), F.round(db, 9)).alias("db"))


_LABELS = "SELECT concat('S', cast(l_suppkey % 5 AS {str})) AS scene_id, cast(l_partkey % 1500 AS double) AS col, cast(l_orderkey % 1300 AS double) AS row, CASE WHEN l_linenumber = 2 THEN NULL ELSE l_quantity * 4 END AS length_m, CASE WHEN l_linenumber = 6 THEN NULL ELSE l_returnflag <> 'R' OR l_partkey % 3 > 0 END AS is_vessel, CASE WHEN l_partkey % 11 = 0 THEN 'LOW' WHEN l_linestatus = 'O' THEN 'high' ELSE 'MEDIUM' END AS confidence FROM {lineitem}"
_LABELS_SQL = _LABELS.replace("{str}", "varchar").replace("{lineitem}", "lineitem")


def _label_rows(spark, sf_dir):
    rows = spark.sql(_LABELS.replace("{str}", "string"), lineitem=_table(spark, sf_dir, "lineitem"))
    x1, y1, x2, y2 = raster.label_box(F.col("col"), F.col("row"), F.col("length_m"))
    return raster.keep_labels(rows.withColumns({"x1": x1, "y1": y1, "x2": x2, "y2": y2}))


_KEPT = f"(SELECT *, col - side / 2 AS x1, row - side / 2 AS y1, col + side / 2 AS x2, row + side / 2 AS y2 FROM (SELECT *, CASE WHEN length_m IS NULL THEN 8e0 ELSE greatest(length_m / 10, 4e0) END AS side, coalesce(is_vessel, false) AND upper(confidence) IN ('HIGH', 'MEDIUM') AS keep FROM ({_LABELS_SQL})))"


@query("p21_kept_labels", f"SELECT scene_id, keep, count(*) AS n, round(sum(x2 - x1), 6) AS width FROM {_KEPT} GROUP BY 1, 2")
def _kept(spark, sf_dir):
    return _label_rows(spark, sf_dir).groupBy("scene_id", "keep").agg(F.count("*").alias("n"), F.round(F.sum(F.col("x2") - F.col("x1")), 6).alias("width"))


_SHAPES = "(SELECT concat('S', i) AS scene_id, x.o AS x_off, y.o AS y_off FROM (SELECT unnest(generate_series(0, 4)) AS i), LATERAL " + _tile_sql("1500", 128, 128) + " x, LATERAL " + _tile_sql("1300", 128, 128) + " y)"


@query("c24_label_windows", f"""SELECT w.scene_id, w.x_off, w.y_off, count(*) FILTER (WHERE keep) AS boxes, round(sum((greatest(least(x1 - x_off, 128), 0) + greatest(least(x2 - x_off, 128), 0)) / 256) FILTER (WHERE keep), 6) AS cx
FROM {_SHAPES} w JOIN {_KEPT} l ON l.scene_id = w.scene_id AND l.col >= w.x_off AND l.col < w.x_off + 128 AND l.row >= w.y_off AND l.row < w.y_off + 128 GROUP BY 1, 2, 3 HAVING bool_and(keep)""")
def _label_windows(spark, sf_dir):
    shapes = spark.range(5).select(F.concat(F.lit("S"), F.col("id").cast("string")).alias("scene_id"), F.lit(1500).alias("width"), F.lit(1300).alias("height"))
    out = raster.labels_in_windows(_label_rows(spark, sf_dir), raster.tiles(shapes, 128).drop("width", "height"), 128)
    return out.select("scene_id", "x_off", "y_off", F.size("boxes").cast("long").alias("boxes"), F.round(F.aggregate("boxes", F.lit(0.0), lambda s, b: s + b["cx"]), 6).alias("cx"))


@query("c14_located", oracle(f" SELECT scene_id, round(s.min_lon + (x1 + x2) / 2 / 1500 * (s.max_lon - s.min_lon), 9) AS lon, round(s.max_lat - (y1 + y2) / 2 / 1300 * (s.max_lat - s.min_lat), 9) AS lat, confidence FROM {_KEPT} l JOIN sar_scenes s ON s.id = l.scene_id", "sar_scenes"))
def _located(spark, sf_dir):
    (scenes,) = domain(spark, sf_dir, "sar_scenes")
    out = raster.located(_label_rows(spark, sf_dir), scenes.withColumns({"width": F.lit(1500), "height": F.lit(1300)}))
    return out.select("scene_id", _r("lon", 9), _r("lat", 9), "confidence")


#: Vectors as lines of images: 64 lines an image, digital numbers from the components, a calibration table from every 16th line.
_IMAGES = """WITH px AS (SELECT vec_id // 64 AS raster, vec_id % 64 AS y, unnest(generate_series(0, 63)) AS x, unnest(embedding)::DOUBLE AS c FROM embeddings),
t AS (SELECT raster, y AS line, max(40e0 + 100e0 * abs(c)) FILTER (WHERE x = 0) AS a, max(40e0 + 100e0 * abs(c)) FILTER (WHERE x = 31) AS b, max(40e0 + 100e0 * abs(c)) FILTER (WHERE x = 63) AS d FROM px WHERE y % 16 = 0 GROUP BY 1, 2),
ends AS (SELECT raster, max(y) AS last, greatest(max(y) // 16 * 16 - 16, 0) AS least_line FROM px GROUP BY 1),
along AS (SELECT raster, line, x, CASE WHEN x <= 31 THEN a + (b - a) * x / 31e0 ELSE b + (d - b) * (x - 31) / 32e0 END AS s FROM t, generate_series(0, 63) g(x)),
lin AS (SELECT px.raster, px.y, px.x, floor(256e0 * abs(px.c)) AS dn, CASE WHEN floor(256e0 * abs(px.c)) = 0 THEN 0e0 ELSE pow(floor(256e0 * abs(px.c)) / (n.s + coalesce(f.s - n.s, 0e0) * (px.y - n.line) / 16e0), 2) END AS v
  FROM px JOIN ends e ON e.raster = px.raster JOIN along n ON n.raster = px.raster AND n.x = px.x AND n.line = least(px.y // 16 * 16, e.least_line) LEFT JOIN along f ON f.raster = px.raster AND f.x = px.x AND f.line = n.line + 16),
spread AS (SELECT raster, var_pop(v) AS var FROM lin GROUP BY 1),
near AS (SELECT p.raster, p.y, p.x, sum(n.v) / 25e0 AS m, sum(n.v * n.v) / 25e0 AS m2 FROM lin p JOIN ends e ON e.raster = p.raster, generate_series(-2, 2) i(dy), generate_series(-2, 2) j(dx), lin n
  WHERE n.raster = p.raster AND n.y = least(greatest(p.y + dy, 0), e.last) AND n.x = least(greatest(p.x + dx, 0), 63) GROUP BY 1, 2, 3),
smooth AS (SELECT lin.raster, lin.y, lin.x, dn, m + greatest(m2 - m * m, 0e0) / (greatest(m2 - m * m, 0e0) + var + 1e-12) * (v - m) AS f FROM lin JOIN near USING (raster, y, x) JOIN spread ON spread.raster = lin.raster),
lines AS (SELECT raster, y, x, CASE WHEN dn = 0 OR f <= 0 THEN 0 ELSE round_even((greatest(least(10e0 * log10(greatest(f, 1e-300)), 0e0), -25e0) + 25e0) / 25e0 * 255e0, 0)::INT END AS p FROM smooth)"""


def _image_lines(spark, sf_dir):
    """(lines, calibration table) of the images."""
    v = _table(spark, sf_dir, "embeddings").select(F.expr("vec_id div 64").alias("raster"), (F.col("vec_id") % 64).alias("y"), "embedding")
    lines = v.select("raster", "y", F.transform("embedding", lambda c: F.floor(F.abs(c.cast("double")) * 256.0).cast("double")).alias("dn"))
    at = (0, 31, 63)
    sigmas = F.array(*(F.abs(F.col("embedding")[i].cast("double")) * 100.0 + 40.0 for i in at)).alias("sigmas")
    return lines, v.filter("y % 16 = 0").select("raster", F.col("y").alias("line"), F.array(*(F.lit(float(i)) for i in at)).alias("pixels"), sigmas)


def _joined(c) -> F.Column:
    return F.array_join(F.transform(c, lambda p: p.cast("string")), ",").alias("pixels")


@query("c20_rendered_lines", f"{_IMAGES} SELECT raster, y, string_agg(p, ',' ORDER BY x) AS pixels FROM lines GROUP BY 1, 2")
def _rendered(spark, sf_dir):
    return stripes.rendered(*_image_lines(spark, sf_dir), rows=24).select("raster", "y", _joined("pixels"))


@query("c19_other_window", f"{_IMAGES} SELECT raster, y, string_agg(round_even((greatest(least(p / 255e0 * 25e0 - 25e0, -3e0), -20e0) + 20e0) / 17e0 * 255e0, 0)::INT, ',' ORDER BY x) AS pixels FROM lines GROUP BY 1, 2")
def _other_window(spark, sf_dir):
    out = stripes.rendered(*_image_lines(spark, sf_dir), rows=24)
    return out.select("raster", "y", _joined(stripes.in_window(F.col("pixels"), (-25.0, 0.0), (-20.0, -3.0))))


#: Connected bright pixels of the images, by walking from every pixel to its neighbours, and their boxes.
_REGION_BOXES = f"""{_IMAGES.replace("WITH px", "WITH RECURSIVE px", 1)},
bright AS (SELECT raster, y, x, p FROM lines WHERE p >= 216),
reach AS (SELECT raster, y, x, y * 64 + x AS root FROM bright
  UNION SELECT b.raster, b.y, b.x, r.root FROM reach r JOIN bright b ON b.raster = r.raster AND abs(b.y - r.y) + abs(b.x - r.x) = 1),
named AS (SELECT raster, y, x, min(root) AS root FROM reach GROUP BY 1, 2, 3),
boxes AS (SELECT raster, min(x)::DOUBLE AS x1, min(y)::DOUBLE AS y1, max(x) + 1e0 AS x2, max(y) + 1e0 AS y2, count(*) AS n, sum(p)::DOUBLE / count(*) / 255e0 AS confidence
  FROM named JOIN bright USING (raster, y, x) GROUP BY raster, root HAVING count(*) >= 4)"""


def _image_regions(spark, sf_dir):
    return regions.bright_regions(stripes.rendered(*_image_lines(spark, sf_dir), rows=24), 216, rows=24)


@query("c15_regions_over_seams", f"{_REGION_BOXES} SELECT * FROM boxes")
def _regions_over_seams(spark, sf_dir):
    return _image_regions(spark, sf_dir)


@query(
    "c12_merged_boxes",
    f"""{_REGION_BOXES},
placed AS (SELECT *, row_number() OVER (PARTITION BY raster ORDER BY confidence DESC, y1, x1, y2, x2) AS i FROM boxes),
walk AS (SELECT DISTINCT raster, 0::BIGINT AS i, []::STRUCT(x1 DOUBLE, y1 DOUBLE, x2 DOUBLE, y2 DOUBLE, confidence DOUBLE)[] AS kept FROM placed
  UNION ALL SELECT b.raster, b.i, CASE WHEN len([k FOR k IN w.kept IF sqrt(pow((k.x1 + k.x2) / 2 - (b.x1 + b.x2) / 2, 2) + pow((k.y1 + k.y2) / 2 - (b.y1 + b.y2) / 2, 2)) < 6e0
    OR greatest(least(k.x2, b.x2) - greatest(k.x1, b.x1), 0) * greatest(least(k.y2, b.y2) - greatest(k.y1, b.y1), 0) * 1.5e0 >= 0.5e0 * ((k.x2 - k.x1) * (k.y2 - k.y1) + (b.x2 - b.x1) * (b.y2 - b.y1))]) > 0
    THEN w.kept ELSE list_append(w.kept, {{'x1': b.x1, 'y1': b.y1, 'x2': b.x2, 'y2': b.y2, 'confidence': b.confidence}}) END
  FROM walk w JOIN placed b ON b.raster = w.raster AND b.i = w.i + 1),
ended AS (SELECT raster, unnest(kept, recursive := true) FROM walk QUALIFY row_number() OVER (PARTITION BY raster ORDER BY i DESC) = 1)
SELECT raster, x1, y1, x2, y2, confidence FROM ended""",
)
def _merged_boxes(spark, sf_dir):
    return regions.suppress_by_rounds(_image_regions(spark, sf_dir), "raster", min_px=6.0)


@query("t15_hold_out", "SELECT c_custkey, CASE WHEN ('0x' || substring(md5(concat('5:', c_custkey)), 1, 13))::BIGINT / 4503599627370496e0 < 0.2e0 THEN 'val' ELSE 'train' END AS split FROM customer")
def _hold_out(spark, sf_dir):
    return raster.hold_out(_table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey", 0.2, 5)


@query("c25_backgrounds", """WITH c AS (SELECT c_custkey, c_custkey % 4 = 0 AS positive, ('0x' || substring(md5(concat('3:', c_custkey)), 1, 13))::BIGINT AS h FROM customer), k AS (SELECT *, row_number() OVER (PARTITION BY positive ORDER BY h, c_custkey) AS place FROM c)
SELECT c_custkey AS chip_id, positive FROM k WHERE positive OR place <= (SELECT floor(count(*) * 0.25e0 / 0.75e0) FROM c WHERE positive)""")
def _backgrounds(spark, sf_dir):
    chips = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("chip_id"), (F.col("c_custkey") % 4 == 0).alias("positive"))
    return raster.cap_backgrounds(chips, 0.25, 3)


# displays ---------------------------------------------------------------------------------------


@query("v04_large_hulls", oracle(f" SELECT mmsi FROM ship_metadata WHERE ship_type BETWEEN 60 AND 89", "ship_metadata"))
@_d("ship_metadata")
def _large(spark, ships):
    return views.visible_vessels(ships, None, "fused", True).select("mmsi")


@query("j26_named_by_contacts", _fuse_sql("SELECT mmsi FROM ship_metadata WHERE mmsi IN (SELECT coalesce(matched_mmsi, CASE WHEN match_state = 'indeterminate' THEN candidate_mmsi END) FROM final WHERE confidence >= 0.6)"))
def _visible(spark, sf_dir):
    shown = _stored(spark, sf_dir).detections.filter("confidence >= 0.6")
    return views.visible_vessels(*domain(spark, sf_dir, "ship_metadata"), shown, "fused", True).select("mmsi")


@query("v07_gaps", oracle(f""", b AS (SELECT DISTINCT mmsi, cast(floor((time_us - {NOW - 21_600_000_000}) * 30 / 21600000000e0) AS INT) AS bin FROM ais_positions), s AS (SELECT *, bin - coalesce(lag(bin) OVER (PARTITION BY mmsi ORDER BY bin), -1) - 1 AS gap FROM b WHERE bin BETWEEN 0 AND 29)
SELECT mmsi, greatest(max(gap), 29 - max(bin)) >= 2 AS flagged, CASE WHEN greatest(max(gap), 29 - max(bin)) * 12 >= 60 THEN concat(greatest(max(gap), 29 - max(bin)) * 12 // 60, 'H', greatest(max(gap), 29 - max(bin)) * 12 % 60, 'M') ELSE concat(greatest(max(gap), 29 - max(bin)) * 12, 'M') END AS gap FROM s GROUP BY 1""", "ais_positions"))
@_d("ais_positions")
def _gaps(spark, positions):
    return routes.continuity(positions, NOW).select("mmsi", views.gap_flagged(F.col("longest")).alias("flagged"), labels.gap_text(F.col("gap_ms")).alias("gap"))


@query("v08_sighting_labels", _fuse_sql(f"SELECT label, count(*) AS n FROM (SELECT CASE WHEN coalesce(matched_mmsi = {_ONE}, false) THEN 'MATCH' ELSE 'CANDIDATE' END AS label FROM final f JOIN sar_scenes s ON s.id = f.scene_id WHERE NOT on_land AND (matched_mmsi = {_ONE} OR candidate_mmsi = {_ONE}) ORDER BY s.sensed_us DESC, f.id LIMIT 100) GROUP BY 1"))
def _sighting_labels(spark, sf_dir):
    rows = routes.sightings(_stored(spark, sf_dir).detections, *domain(spark, sf_dir, "sar_scenes"), registry.regions(spark), _ONE, 100)
    return rows.groupBy(views.sighting_label(F.col("matched")).alias("label")).agg(F.count("*").alias("n"))


@query("f09_times", oracle(f""", m AS (SELECT id, time_us, ({NOW} - time_us) // 60000000 AS ago FROM ais_positions WHERE time_us <= {NOW}) SELECT id, CASE WHEN ago < 1 THEN 'just now' WHEN ago < 60 THEN concat(ago, 'm ago') WHEN ago < 1440 THEN concat(ago // 60, 'h ago') ELSE concat(ago // 1440, 'd ago') END AS ago,
concat(CASE WHEN a < 1 THEN 'under a minute' WHEN a < 60 THEN concat(a, ' min') ELSE concat(a // 60, 'h ', a % 60, 'm') END, CASE WHEN time_us <= 5000000000 THEN ' before this pass' ELSE ' after this pass' END) AS age, upper(strftime(make_timestamp(time_us), '%d %b %H:%M:%SZ')) AS stamp,
CASE WHEN time_us - 4000000000 < 1000000 THEN 'any time now' WHEN (time_us - 4000000000) // 3600000000 > 0 THEN concat((time_us - 4000000000) // 3600000000, 'h ', (time_us - 4000000000) // 60000000 % 60, 'm') ELSE concat((time_us - 4000000000) // 60000000, 'm ', (time_us - 4000000000) // 1000000 % 60, 's') END AS due
FROM (SELECT *, abs(time_us - 5000000000) // 60000000 AS a FROM m)""", "ais_positions"))
@_d("ais_positions")
def _times(spark, positions):
    t = F.col("time_us")
    rows = positions.filter(t <= NOW)
    return rows.select("id", labels.ago(t, F.lit(NOW)).alias("ago"), labels.age(t, F.lit(5_000_000_000), False).alias("age"), labels.stamp(t, True).alias("stamp"), views.countdown(t - 4_000_000_000).alias("due"))
