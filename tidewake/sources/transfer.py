"""Tagged records: export and import of scenes, detections and ships as gzipped JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = 1


def named_vessels(detections: DataFrame) -> DataFrame:
    """The vessels that any detection was matched to or names as its candidate."""
    return detections.select(F.col("matched_mmsi").alias("mmsi")).union(detections.select("candidate_mmsi")).dropna().distinct()


def orphans(rows: DataFrame, scenes: DataFrame) -> DataFrame:
    """Scene ids of rows whose scene is missing."""
    return rows.select("scene_id").distinct().join(scenes.select(F.col("id").alias("scene_id")), "scene_id", "left_anti")


def export_records(scenes: DataFrame, detections: DataFrame, ships: DataFrame, rois: list[str]) -> DataFrame:
    """(kind_rank, sort keys, value) lines: a header, scenes by (roi, time, id), detections by (scene, id), ships by identity.

    Ships are those that a detection of these scenes matched or names as candidate.
    """
    spark = scenes.sparkSession
    own = scenes.filter(F.col("roi").isin(*rois))
    d = detections.join(own.select(F.col("id").alias("scene_id")), "scene_id", "left_semi")
    named = named_vessels(d)
    s = ships.join(named, "mmsi", "left_semi")
    line = lambda kind, df: F.to_json(F.struct(F.lit(kind).alias("kind"), *df.columns), {"ignoreNullFields": "false"})
    none = F.lit(None).cast("string")
    head = spark.range(1).select(F.lit(0).alias("rank"), none.alias("k1"), F.lit(0).cast("long").alias("k2"), none.alias("k3"), F.to_json(F.struct(F.lit("meta").alias("kind"), F.lit(VERSION).alias("version"))).alias("value"))
    return (
        head.union(own.select(F.lit(1), "roi", F.col("sensed_us").cast("long"), "id", line("scene", own)))
        .union(d.select(F.lit(2), "scene_id", F.col("id").cast("long"), none, line("detection", d)))
        .union(s.select(F.lit(3), none, F.col("mmsi").cast("long"), none, line("ship", s)))
        .orderBy("rank", "k1", "k2", "k3")
    )


def write_records(records: DataFrame, path: str) -> None:
    """Range-partitioned files in record order: the order is that of the file names and lines."""
    records.select("value").write.mode("overwrite").option("compression", "gzip").text(path)


def read_records(spark: SparkSession, path: str, scene_schema: str, detection_schema: str, ship_schema: str) -> dict[str, DataFrame]:
    """The three tables of an export, after validation."""
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("line"))
    raw = raw.withColumn("kind", F.get_json_object("value", "$.kind"))
    validate(raw)
    part = lambda kind, schema: raw.filter(F.col("kind") == kind).select(F.from_json("value", schema).alias("r")).select("r.*")
    out = {"scene": part("scene", scene_schema), "detection": part("detection", detection_schema), "ship": part("ship", ship_schema)}
    if orphans(out["detection"], out["scene"]).limit(1).count():
        raise ValueError("a detection's scene is missing")
    return out


def validate(raw: DataFrame) -> None:
    """One header of the known version, on the first line, and a known kind on every line. Binary columns travel as base64."""
    r = raw.agg(
        F.min_by("kind", F.struct("file", "line")).alias("first"), F.count_if(F.col("kind") == "meta").alias("heads"), F.max(F.when(F.col("kind") == "meta", F.get_json_object("value", "$.version").cast("int"))).alias("version"),
        F.count_if(F.coalesce(~F.col("kind").isin("meta", "scene", "detection", "ship"), F.lit(True))).alias("strange"),
    ).first()
    if r.heads != 1 or r.version != VERSION or r.first != "meta":
        raise ValueError("no header of a known version")
    if r.strange:
        raise ValueError("a record has no known kind")


def guard_import(old_scenes: DataFrame, new_scenes: DataFrame, *, force: bool = False, dry_run: bool = False) -> tuple[int, bool]:
    """(stored scenes that an import would replace, whether to write).

    Counted before anything is written: replacing is an error unless forced, and a dry run
    never writes.
    """
    n = import_conflicts(old_scenes, new_scenes)
    if n and not force and not dry_run:
        raise ValueError(f"the import would replace {n} stored scenes; force it or leave them out")
    return n, not dry_run


def import_conflicts(old_scenes: DataFrame, new_scenes: DataFrame) -> int:
    """How many stored scenes an import would replace."""
    return new_scenes.join(old_scenes.select("id"), "id", "left_semi").count()
