"""Read routes: one function per public view, each a DataFrame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidewake.functions import geo
from tidewake.functions.labels import failure_reason
from tidewake.operators.spatial import nearest_in_time
from tidewake.params import DEFAULT, Params
from tidewake.sources.registry import region


def with_flag(df: DataFrame, flags: DataFrame, mmsi: str = "mmsi") -> DataFrame:
    """Adds flag_iso2 and flag_country by the prefix of a nine-digit identity; null for all others."""
    text = F.col(mmsi).cast("string")
    prefix = F.when(F.length(text) == 9, F.substring(text, 1, 3).cast("int"))
    return df.withColumn("_mid", prefix).join(F.broadcast(flags), F.col("_mid") == F.col("mid"), "left").drop("_mid", "mid")


def _in_region(roi: str) -> Column:
    r = region(roi)
    return F.expr(geo.strictly_in_box("lon", "lat", tuple(r[f"ais_{c}"] for c in ("min_lon", "min_lat", "max_lon", "max_lat"))))


def vessel_count(positions: DataFrame, roi: str, now_us: int, p: Params = DEFAULT) -> DataFrame:
    """Exact number of vessels heard in the trailing window, strictly inside the region's box."""
    recent = positions.filter((F.col("time_us") > now_us - p.active_window_min * 60_000_000) & _in_region(roi))
    return recent.agg(F.countDistinct("mmsi").alias("vessels"))


def vessels(positions: DataFrame, ships: DataFrame, flags: DataFrame, roi: str, at_us: int, minutes: int) -> DataFrame:
    """Each vessel's fix nearest to an instant, within a window on both sides, with identity and flag."""
    spark = positions.sparkSession
    instant = spark.range(1).select(F.lit(0).alias("at"), F.lit(at_us).cast("long").alias("sensed_us"))
    near = nearest_in_time(positions.filter(_in_region(roi)), F.broadcast(instant), "mmsi", minutes * 60_000_000, "at").drop("at", "sensed_us")
    return with_flag(near.join(ships.select("mmsi", "ship_name", "ship_type", "callsign"), "mmsi", "left"), flags)


def track(positions: DataFrame, ships: DataFrame, mmsi: int, now_us: int, hours: int, p: Params = DEFAULT) -> DataFrame:
    """One vessel's fixes of the last hours, oldest first. Hours outside 1 to the retention are an error."""
    if not 1 <= hours <= 24 * p.retention_days:
        raise ValueError(f"hours must be in 1..{24 * p.retention_days}")
    own = positions.filter((F.col("mmsi") == mmsi) & (F.col("time_us") > now_us - hours * 3_600_000_000))
    named = own.join(ships.filter(F.col("mmsi") == mmsi).select("mmsi", "ship_name", "ship_type"), "mmsi", "left")
    return named.select("mmsi", "time_us", "lon", "lat", "sog", "cog", "ship_name", "ship_type").orderBy("time_us")


def sightings(detections: DataFrame, scenes: DataFrame, regions: DataFrame, mmsi: int, limit: int = 20) -> DataFrame:
    """Sea detections matched to a vessel, or whose candidate it is, newest pass first."""
    if not 1 <= limit <= 100:
        raise ValueError("limit must be in 1..100")
    own = detections.filter(~F.col("on_land") & ((F.col("matched_mmsi") == mmsi) | (F.col("candidate_mmsi") == mmsi)))
    s = scenes.select(F.col("id").alias("scene_id"), "roi", "sensed_us", "platform")
    joined = own.join(s, "scene_id").join(F.broadcast(regions.select(F.col("name").alias("roi"), "label")), "roi", "left")
    out = joined.select(
        F.col("id").alias("det_id"), "scene_id", F.coalesce("label", "roi").alias("roi_label"), "sensed_us", "lon", "lat",
        F.coalesce(F.col("matched_mmsi") == mmsi, F.lit(False)).alias("matched"), "confidence",
    )
    return out.orderBy(F.desc("sensed_us"), "det_id").limit(limit)


def scene_counts(detections: DataFrame) -> DataFrame:
    """Counts per scene; the dark count has no land filter."""
    return detections.groupBy("scene_id").agg(
        F.count("*").alias("detection_count"), F.count_if("is_dark").alias("dark_count"), F.count_if(F.col("match_state") == "matched").alias("matched_count"),
        F.count_if(F.col("match_state") == "indeterminate").alias("indeterminate_count"), F.count_if("on_land").alias("on_land_count"),
    )


def scene_list(scenes: DataFrame, detections: DataFrame, roi: str | None = None, limit: int = 10) -> DataFrame:
    """Newest scenes with their counts; counted first, joined after, so no wide group-by."""
    if not 1 <= limit <= 50:
        raise ValueError("limit must be in 1..50")
    own = scenes if roi is None else scenes.filter(F.col("roi") == roi)
    newest = own.orderBy(F.desc("sensed_us"), "id").limit(limit)
    counts = scene_counts(detections.join(F.broadcast(newest.select(F.col("id").alias("scene_id"))), "scene_id", "left_semi"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    out = newest.join(counts, newest["id"] == counts["scene_id"], "left")
    return out.select(
        "id", "roi", "sensed_us", "platform", "status", F.col("overview_png").isNotNull().alias("has_overview"), failure_reason(F.col("error")).alias("failure_reason"),
        *map(zero, ("detection_count", "dark_count", "matched_count", "indeterminate_count", "on_land_count")),
    ).orderBy(F.desc("sensed_us"), "id")


def overviews(scenes: DataFrame, since_us: int | None = None) -> DataFrame:
    """(id, processed_us, overview_png) of the scenes that have an overview; with ``since_us``, of those processed later only."""
    own = scenes.filter(F.col("overview_png").isNotNull())
    own = own if since_us is None else own.filter(F.col("processed_us") > since_us)
    return own.select("id", "processed_us", "overview_png")


def points(df: DataFrame, lons: str, lats: str) -> DataFrame:
    """Two arrays of equal length as a table: (lon, lat) rows beside the other columns."""
    other = [c for c in df.columns if c not in (lons, lats)]
    return df.select(*other, F.inline(F.arrays_zip(F.col(lons).alias("lon"), F.col(lats).alias("lat"))))


def scene_detections(detections: DataFrame, ships: DataFrame, scene_id: str, include_land: bool = False) -> DataFrame:
    """One scene's detections with both vessels' identities, most confident first."""
    own = detections.filter(F.col("scene_id") == scene_id)
    own = own if include_land else own.filter(~F.col("on_land"))
    role = lambda r: ships.select(F.col("mmsi").alias(f"{r}_mmsi"), F.col("ship_name").alias(f"{r}_name"), F.col("ship_type").alias(f"{r}_type"))
    out = own.join(role("matched"), "matched_mmsi", "left").join(role("candidate"), "candidate_mmsi", "left")
    cols = ["id", "lon", "lat", "confidence", "confidence_bucket", "match_state", "is_dark", "matched_mmsi", "matched_name", "matched_type", "candidate_mmsi", "candidate_name", "candidate_type", "match_distance_m", "match_time_delta_s", "dark_margin_m", "on_land"]
    return out.select(*cols).orderBy(F.desc("confidence"), "id")


def last_processed(scenes: DataFrame) -> DataFrame:
    return scenes.groupBy("roi").agg(F.max("processed_us").alias("last_processed_us"))


def most_recent_analysis(scenes: DataFrame, detections: DataFrame) -> DataFrame:
    """The processed scene with the latest processing time (null first, as the store sorts)."""
    top = scenes.filter("status = 'processed'").orderBy(F.desc_nulls_first("processed_us"), F.desc("id")).limit(1)
    counts = scene_counts(detections.join(F.broadcast(top.select(F.col("id").alias("scene_id"))), "scene_id", "left_semi"))
    out = top.join(counts, top["id"] == counts["scene_id"], "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return out.select("id", "roi", "processed_us", zero("detection_count"), zero("dark_count"))


#: The edges of the confidence histogram.
CONFIDENCE_EDGES = (0.1, 0.2, 0.25, 0.3, 0.4, 0.5, 0.6, 0.8, 1.0)


def confidence_histogram(detections: DataFrame, edges: tuple[float, ...] = CONFIDENCE_EDGES) -> DataFrame:
    """Detections per bin: bin k starts at edge k, the last one holds the last edge itself; what lies below the first goes."""
    least, *inner, most = edges
    bin_ = sum((F.when(F.col("confidence") >= e, 1).otherwise(0) for e in inner[1:]), F.when(F.col("confidence") >= inner[0], 1).otherwise(0))
    last = F.when(F.col("confidence") >= most, len(inner)).otherwise(bin_)
    return detections.filter(F.col("confidence") >= least).groupBy(last.cast("int").alias("bin")).agg(F.count("*").alias("n"))


def shaped(df: DataFrame, model: str) -> DataFrame:
    """The columns that a response model declares, cast to its types: others go, missing ones are null."""
    fields = spark_fields(model)
    return df.select(*((F.col(n).cast(t) if n in df.columns else F.lit(None).cast(t)).alias(n) for n, t in fields))


def spark_fields(model: str) -> list[tuple[str, str]]:
    """(name, type) of a schema in DDL."""
    return [(f.name, f.dataType.simpleString()) for f in StructType.fromDDL(model).fields]


def rows_by_scene(rows: DataFrame, column: str) -> DataFrame:
    """Per scene, the ascending list of a column's values."""
    return rows.groupBy("scene_id").agg(F.sort_array(F.collect_list(column)).alias(f"{column}s"))


def latest_sensed(scenes: DataFrame, roi: str) -> DataFrame:
    return scenes.filter((F.col("roi") == roi) & (F.col("status") == "processed")).agg(F.max("sensed_us").alias("latest_sensed_us"))


def snapshot(positions: DataFrame, roi: str, sensed_us: int, window_h: float) -> DataFrame:
    """All fixes in a region's box within a closed window, in time order."""
    w = int(window_h * 3_600_000_000)
    return positions.filter(F.col("time_us").between(sensed_us - w, sensed_us + w) & _in_region(roi)).orderBy("time_us", "id")


def density(positions: DataFrame, roi: str, bins: int = 5) -> DataFrame:
    """Vessels per longitude and latitude bin of the imaging box: is reception even across it?"""
    r = region(roi)
    bin_ = lambda v, lo, hi: F.expr(f"width_bucket({v}, {r[lo]!r}D, {r[hi]!r}D, {bins})")
    own = positions.select("mmsi", bin_("lon", "sar_min_lon", "sar_max_lon").alias("lon_bin"), bin_("lat", "sar_min_lat", "sar_max_lat").alias("lat_bin"))
    return own.groupBy("lon_bin", "lat_bin").agg(F.countDistinct("mmsi").alias("vessels"))


def continuity(positions: DataFrame, now_us: int, bins: int = 30, window_h: int = 6) -> DataFrame:
    """Per vessel: the longest run of empty bins in a strip of the last hours, in milliseconds.

    A gap-and-islands plan: the filled bins and both ends in order, and the widest step.
    """
    width = window_h * 3_600_000_000
    at = F.floor((F.col("time_us") - (now_us - width)) * bins / F.lit(float(width))).cast("int")
    filled = positions.select("mmsi", at.alias("bin")).filter(F.col("bin").between(0, bins - 1)).distinct()
    w = W.partitionBy("mmsi").orderBy("bin")
    steps = filled.withColumn("before", F.col("bin") - F.coalesce(F.lag("bin").over(w), F.lit(-1)) - 1)
    out = steps.groupBy("mmsi").agg(F.count("*").alias("filled"), F.greatest(F.max("before"), F.lit(bins - 1) - F.max("bin")).alias("longest"))
    return out.select("mmsi", "filled", "longest", (F.col("longest") * (width // bins // 1000)).cast("long").alias("gap_ms"))
