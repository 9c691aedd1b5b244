"""File sources and sinks: land polygons, chips, labels, calibration tables, the scene catalogue."""

from __future__ import annotations

import struct
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewake.functions import rings
from tidewake.functions.labels import csv_bool, csv_double

LABELS = "scene_id string, detect_scene_row string, detect_scene_column string, top string, left string, bottom string, right string, vessel_length_m string, is_vessel string, confidence string"


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """(id, ring, holes, min_lon, min_lat, max_lon, max_lat) of the polygons of a feature collection.

    A MultiPolygon gives one row per part, with its feature's id.
    """
    shape = "features array<struct<geometry: struct<type: string, coordinates: string>>>"
    f = spark.read.schema(shape).option("multiLine", True).json(path).select(F.posexplode("features").alias("id", "f"))
    text, kind = F.col("f.geometry.coordinates"), F.col("f.geometry.type")
    one = "array<array<array<double>>>"
    parts = F.when(kind == "Polygon", F.array(F.from_json(text, one))).when(kind == "MultiPolygon", F.from_json(text, f"array<{one}>"))
    f = f.select(F.col("id").cast("long").alias("id"), F.explode(parts).alias("part"))
    every = F.transform("part", lambda r: F.transform(r, lambda p: F.struct(p[0].alias("lon"), p[1].alias("lat"))))
    f = f.filter(F.size("part") > 0).select("id", every.alias("rings"))
    return with_bounds(f.select("id", F.col("rings")[0].alias("ring"), F.slice("rings", F.lit(2), F.size("rings")).alias("holes")))


def with_bounds(polygons: DataFrame) -> DataFrame:
    lon, lat = F.transform("ring", lambda p: p["lon"]), F.transform("ring", lambda p: p["lat"])
    return polygons.withColumns({"min_lon": F.array_min(lon), "min_lat": F.array_min(lat), "max_lon": F.array_max(lon), "max_lat": F.array_max(lat)})


def write_geojson(polygons: DataFrame, path: str) -> None:
    """One feature a line, in id order (the order of file names and lines)."""
    feature = F.to_json(F.struct(F.lit("Feature").alias("type"), F.col("id"), F.from_json(rings.to_geojson(F.col("ring"), F.col("holes") if "holes" in polygons.columns else None), "type string, coordinates array<array<array<double>>>").alias("geometry")))
    polygons.orderBy("id").select(feature.alias("value")).write.mode("overwrite").text(path)


def clip_land(polygons: DataFrame, boxes: list[tuple[float, float, float, float]]) -> DataFrame:
    """Polygons clipped to each box that they overlap; what has no area goes."""
    spark = polygons.sparkSession
    b = spark.createDataFrame([(i, *x) for i, x in enumerate(boxes)], "box int, b_min_lon double, b_min_lat double, b_max_lon double, b_max_lat double")
    touch = (F.col("min_lon") <= F.col("b_max_lon")) & (F.col("b_min_lon") <= F.col("max_lon")) & (F.col("min_lat") <= F.col("b_max_lat")) & (F.col("b_min_lat") <= F.col("max_lat"))
    pairs = polygons.join(F.broadcast(b), touch)

    def run(batches):
        for pdf in batches:
            out = []
            gaps = []
            for r in pdf.itertuples():
                box = (r.b_min_lon, r.b_min_lat, r.b_max_lon, r.b_max_lat)
                cut = [rings.clip_to_box([(p["lon"], p["lat"]) for p in ring], box) for ring in (r.ring, *r.holes)]
                closed = [[{"lon": x, "lat": y} for x, y in ring + ring[:1]] for ring in cut]
                out.append(closed[0])
                gaps.append([ring for ring in closed[1:] if ring])
            yield pdf[["id"]].assign(ring=out, holes=gaps)

    holes = F.col("holes") if "holes" in polygons.columns else F.array().cast(f"array<{rings.RING}>")
    pairs = pairs.select("id", "ring", holes.alias("holes"), "b_min_lon", "b_min_lat", "b_max_lon", "b_max_lat")
    clipped = pairs.mapInPandas(run, f"id long, ring {rings.RING}, holes array<{rings.RING}>")
    return with_bounds(clipped.filter(rings.area(F.col("ring")) > 0))


def read_shapefile(spark: SparkSession, path: str, boxes: list[tuple[float, float, float, float]]) -> DataFrame:
    """Polygons (ring, holes) of a shapefile's records that overlap a box; others are skipped before their points are read.

    Outer rings run clockwise, holes the other way; a hole belongs to the first outer ring that holds it.
    """

    def parse(raw: bytes) -> Iterator[tuple[int, list[dict], list[list[dict]]]]:
        at = 100
        while at + 8 <= len(raw):
            number, words = struct.unpack(">ii", raw[at : at + 8])
            body = raw[at + 8 : at + 8 + 2 * words]
            at += 8 + 2 * words
            if struct.unpack("<i", body[:4])[0] != 5:
                continue
            box = struct.unpack("<4d", body[4:36])
            if not any(box[0] <= b[2] and b[0] <= box[2] and box[1] <= b[3] and b[1] <= box[3] for b in boxes):
                continue
            parts, points = struct.unpack("<2i", body[36:44])
            starts = [*struct.unpack(f"<{parts}i", body[44 : 44 + 4 * parts]), points]
            xy = struct.unpack(f"<{2 * points}d", body[44 + 4 * parts : 44 + 4 * parts + 16 * points])
            every = [[(xy[2 * i], xy[2 * i + 1]) for i in range(lo, hi)] for lo, hi in zip(starts, starts[1:])]
            outer = [r for r in every if rings.turn(r) <= 0] or every
            holes: list[list] = [[] for _ in outer]
            for r in every:
                if r not in outer and (at_outer := next((k for k, o in enumerate(outer) if all(rings.holds(o, p) for p in r)), None)) is not None:
                    holes[at_outer].append(r)
            named = lambda r: [{"lon": x, "lat": y} for x, y in r]
            for r, gaps in zip(outer, holes):
                yield number, named(r), [named(g) for g in gaps]

    def run(batches):
        import pandas as pd

        for pdf in batches:
            for content in pdf["content"]:
                yield pd.DataFrame(list(parse(content)), columns=["id", "ring", "holes"])

    return with_bounds(spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, f"id long, ring {rings.RING}, holes array<{rings.RING}>"))


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """Label rows: everything is text first, then cast leniently."""
    raw = spark.read.schema(LABELS).option("header", True).csv(path)
    num = {"row": "detect_scene_row", "col": "detect_scene_column", "vessel_length_m": "vessel_length_m"}
    return raw.select("scene_id", *(csv_double(F.col(c)).alias(n) for n, c in num.items()), csv_bool(F.col("is_vessel")).alias("is_vessel"), "confidence")


def read_calibration(spark: SparkSession, path: str) -> DataFrame:
    """(line, pixels, values) of the calibration vectors of XML files, by line."""
    raw = spark.read.format("xml").option("rowTag", "calibrationVector").schema("line int, pixel string, sigmaNought string").load(path)
    numbers = lambda c, kind: F.transform(F.split(F.trim(F.col(c)), r"\s+"), lambda x: x.cast(kind))
    return raw.select("line", numbers("pixel", "int").alias("pixels"), numbers("sigmaNought", "double").alias("values")).orderBy("line")


def pick_members(names: DataFrame) -> DataFrame:
    """Per archive: the shortest raster name of the vertical channel and the shortest calibration file."""
    low = F.lower("name")
    pick = lambda cond: F.min(F.when(cond, F.struct(F.length("name").alias("n"), "name")))["name"]
    raster = low.rlike(r"measurement/.*-vv-.*\.tiff?$")
    xml = low.rlike(r"annotation/calibration/calibration-.*-vv-.*\.xml$")
    return names.groupBy("archive").agg(pick(raster).alias("raster"), pick(xml).alias("calibration"))


def read_chips(spark: SparkSession, path: str) -> DataFrame:
    """Arrays (.npy) beside their JSON sidecars, joined on the stem."""
    stem = lambda c: F.regexp_extract(c, r"([^/]+)\.(?:npy|json)$", 1)
    arrays = spark.read.format("binaryFile").option("pathGlobFilter", "*.npy").load(path).select(stem(F.col("path")).alias("stem"), F.col("content").alias("npy"))
    meta = spark.read.option("wholetext", True).option("pathGlobFilter", "*.json").text(path).select(stem(F.col("_metadata.file_path")).alias("stem"), F.col("value").alias("meta"))
    return arrays.join(meta, "stem")


CATALOGUE = "id string, name string, sensed_us long, footprint_wkt string"


def search_scenes(spark: SparkSession, path: str, start_us: int, end_us: int, product: str, box: tuple[float, float, float, float], most: int = 200) -> DataFrame:
    """The earliest entries of a window whose name holds the product and whose footprint's box meets the box.

    Entries are JSON lines, read and split by Spark: time and name are filtered in the scan.
    """
    found = spark.read.schema(CATALOGUE).json(path.split(","))
    found = found.filter((F.col("sensed_us") > start_us) & (F.col("sensed_us") < end_us) & F.col("name").contains(product))
    shaped = with_bounds(found.withColumn("ring", rings.parse_wkt(F.col("footprint_wkt"))))
    meets = (F.col("min_lon") <= box[2]) & (F.col("max_lon") >= box[0]) & (F.col("min_lat") <= box[3]) & (F.col("max_lat") >= box[1])
    out = shaped.filter(meets).orderBy("sensed_us", "id").limit(most)
    return out.select("id", "name", "sensed_us", "footprint_wkt", F.substring("name", 1, 3).alias("platform"))


def tile_request(box: tuple[float, float, float, float], width: int, height: int, start: str, end: str, script: str) -> dict:
    """Body of one imagery request: bounds, size, time range and the script that scales to bytes."""
    return {
        "input": {"bounds": {"bbox": list(box), "properties": {"crs": "http://www.opengis.net/def/crs/EPSG/0/4326"}}, "data": [{"dataFilter": {"timeRange": {"from": start, "to": end}}}]},
        "output": {"width": width, "height": height, "responses": [{"identifier": "default", "format": {"type": "image/png"}}]},
        "evalscript": script,
    }


def retry_delay(attempt: int, retry_after: str | None, most: float = 60.0) -> float:
    """Seconds before the next try: what the service says, else doubling."""
    try:
        return min(most, max(0.0, float(retry_after)))
    except (TypeError, ValueError):
        return min(most, float(2**attempt))
