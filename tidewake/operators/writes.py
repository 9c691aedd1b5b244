"""Writes on plain Parquet: what other stores do by UPDATE and MERGE becomes a new version of a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidewake.functions.labels import redact


def replace_scene(fresh: DataFrame, path: str) -> None:
    """Replace the detections of the scenes in ``fresh``: only their partitions are rewritten."""
    fresh.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("scene_id").parquet(path)


def upsert(old: DataFrame, new: DataFrame, key: str, newer: str | None = None) -> DataFrame:
    """New rows over old ones by key. With ``newer``, a new row wins only when strictly newer there."""
    rank = [F.desc("_new")] if newer is None else [F.desc_nulls_last(newer), F.asc("_new")]
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    first = F.row_number().over(W.partitionBy(key).orderBy(*rank))
    return both.withColumn("_k", first).filter("_k = 1").drop("_k", "_new")


def upsert_keep(old: DataFrame, new: DataFrame, key: str, newer: str, columns: list[str]) -> DataFrame:
    """Strictly newer rows fill the columns that they know; unknown ones keep their old value."""
    n = new.select(key, F.col(newer).alias("_t"), *(F.col(c).alias(f"_{c}") for c in columns))
    joined = old.join(n, key, "full_outer")
    wins = F.col("_t").isNotNull() & (F.col(newer).isNull() | (F.col("_t") > F.col(newer)))
    pick = [F.when(wins, F.coalesce(f"_{c}", c)).otherwise(F.col(c)).alias(c) for c in columns]
    return joined.select(key, F.when(wins, F.col("_t")).otherwise(F.col(newer)).alias(newer), *pick)


def latest_status(log: DataFrame) -> DataFrame:
    """Scene states from an append-only log of (scene_id, seq, status, error): the last row counts."""
    return log.groupBy("scene_id").agg(F.max_by(F.struct("*"), "seq").alias("r")).select("r.*")


def begin(scenes: DataFrame, started: DataFrame) -> DataFrame:
    """Scenes after an analysis has begun: new over old by id, processing and without an error."""
    cols = [c for c in scenes.columns if c in started.columns]
    fresh = started.select(*cols).withColumn("status", F.lit("processing")).withColumn("error", F.lit(None).cast("string"))
    return upsert(scenes, fresh, "id")


def finish(scenes: DataFrame, outcomes: DataFrame, secrets: list[str] | None = None) -> DataFrame:
    """Scenes after their last outcome (scene_id, seq, status, error, processed_us).

    Failed ones keep a redacted error of at most 500 characters, others none.
    """
    last = latest_status(outcomes).select(F.col("scene_id").alias("id"), F.col("status").alias("_status"), F.col("error").alias("_error"), F.col("processed_us").alias("_processed"))
    told = F.when(F.col("_status") == "failed", redact(F.col("_error"), secrets or []))
    known = F.col("_status").isNotNull()
    pick = {"status": F.coalesce("_status", "status"), "error": F.when(known, told).otherwise(F.col("error")), "processed_us": F.when(known & (F.col("_status") == "processed"), F.col("_processed")).otherwise(F.col("processed_us"))}
    return scenes.join(last, "id", "left").withColumns(pick).drop("_status", "_error", "_processed").select(*scenes.columns)


def add_columns(df: DataFrame, columns: str) -> DataFrame:
    """``df`` with the columns of a DDL text that it lacks, null; those it has stay as they are."""
    have = {c.lower() for c in df.columns}
    new = [f for f in StructType.fromDDL(columns).fields if f.name.lower() not in have]
    return df.select("*", *(F.lit(None).cast(f.dataType).alias(f.name) for f in new))


def reap(scenes: DataFrame) -> DataFrame:
    """Scenes that were in flight when the process ended have failed."""
    cut = F.col("status") == "processing"
    return scenes.withColumn("error", F.when(cut, F.lit("interrupted by restart")).otherwise(F.col("error"))).withColumn("status", F.when(cut, F.lit("failed")).otherwise(F.col("status")))


def reset_match(detections: DataFrame) -> DataFrame:
    """Detections without their match columns' values."""
    kinds = dict(detections.dtypes)
    cols = ("match_state", "is_dark", "matched_mmsi", "candidate_mmsi", "match_distance_m", "match_time_delta_s", "dark_margin_m")
    return detections.withColumns({c: F.lit(None).cast(kinds[c]) for c in cols if c in kinds})


def delete_scenes(scenes: DataFrame, detections: DataFrame, *, roi: str | None = None, scene_id: str | None = None, everything: bool = False) -> tuple[DataFrame, DataFrame]:
    """Scenes and detections that stay. Exactly one selector; detections follow their scene."""
    if (roi is not None) + (scene_id is not None) + everything != 1:
        raise ValueError("give exactly one of roi, scene_id, everything")
    gone = F.lit(True) if everything else F.col("roi") == roi if roi is not None else F.col("id") == scene_id
    left = scenes.filter(~F.coalesce(gone, F.lit(False)))
    return left, detections.join(left.select(F.col("id").alias("scene_id")), "scene_id", "left_semi")


def delete_messages(positions: DataFrame, ships: DataFrame, *, mmsi: int | None = None, box: tuple[float, float, float, float] | None = None) -> tuple[DataFrame, DataFrame]:
    """Positions and identities that stay after a delete of one vessel, of a box, or of everything.

    Identities go with their last position; with no selector all go.
    """
    if mmsi is not None and box is not None:
        raise ValueError("give a vessel or a box")
    gone = F.lit(True)
    if mmsi is not None:
        gone = F.col("mmsi") == mmsi
    elif box is not None:
        gone = F.col("lon").between(box[0], box[2]) & F.col("lat").between(box[1], box[3])
    left = positions.filter(~F.coalesce(gone, F.lit(False)))
    touched = positions.filter(gone).select("mmsi").distinct()
    lost = touched.join(left.select("mmsi").distinct(), "mmsi", "left_anti")
    return left, ships.join(lost, "mmsi", "left_anti")


def delete_spending(ledger: DataFrame, *, scope: str, now_us: int | None = None, roi: str | None = None, scene_id: str | None = None) -> DataFrame:
    """Ledger rows that stay after a reset of this month, of everything, or of one scene."""
    own = F.lit(True) if roi is None else F.col("roi") == roi
    if scope == "month":
        own = own & (F.col("spent_us") >= F.unix_micros(F.date_trunc("month", F.timestamp_micros(F.lit(now_us)))))
    elif scope == "scene":
        own = F.col("scene_id") == scene_id
    elif scope != "all":
        raise ValueError("scope is month, all or scene")
    return ledger.filter(~own)


def status_of(log: DataFrame) -> DataFrame:
    """The status row after a log of commands (seq, command, message, level, title, at_us): one row, whatever the log.

    A toggle only counts while there is a message; without one the default stands: inactive,
    level warning.
    """
    sets = log.filter(F.col("command").isin("post", "clear"))
    last = sets.agg(F.max_by(F.struct("*"), "seq").alias("l"))
    after = log.crossJoin(F.broadcast(last)).filter((F.col("command") == "toggle") & (F.col("l.command") == "post") & (F.col("seq") > F.col("l.seq")))  # one row
    toggles = after.agg(F.count("*").alias("n"), F.max("at_us").alias("at"))
    posted = F.coalesce(F.col("l.command") == "post", F.lit(False))
    return last.crossJoin(toggles).select(
        F.when(posted, F.col("l.message")).alias("message"), F.when(posted, F.col("l.level")).otherwise(F.lit("warning")).alias("level"), F.when(posted, F.col("l.title")).alias("title"),
        (posted & (F.col("n") % 2 == 0)).alias("active"), F.coalesce("at", "l.at_us").alias("updated_us"),
    )


class StatusMessage:
    """The one-row status table as a fold over commands; the default is an inactive empty message."""

    LEVELS = ("info", "warning", "critical")

    def __init__(self):
        self.row = {"message": None, "level": "warning", "title": None, "active": False, "updated_us": None}

    def post(self, message: str, level: str, title: str | None, now_us: int) -> dict:
        if not message or not message.strip():
            raise ValueError("a message is needed")
        if level not in self.LEVELS:
            raise ValueError(f"level must be one of {', '.join(self.LEVELS)}")
        if title is not None and not 1 <= len(title.strip()) <= 24:
            raise ValueError("a title has 1 to 24 characters")
        self.row = {"message": message.strip(), "level": level, "title": title and title.strip(), "active": True, "updated_us": now_us}
        return self.row

    def toggle(self, now_us: int) -> dict:
        if self.row["message"]:
            self.row = self.row | {"active": not self.row["active"], "updated_us": now_us}
        return self.row

    def clear(self, now_us: int) -> dict:
        self.row = self.row | {"message": None, "level": "warning", "title": None, "active": False, "updated_us": now_us}
        return self.row
