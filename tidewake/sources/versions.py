"""Sets of tables in versions: what is replaced is written beside what is read, then a pointer names it.

``<root>/_pointers/<number>`` holds a JSON object of table name to folder; the highest number that isn't
empty is the current version. Readers see a whole version or the one before, never half of
one, and a writer that fails or is lost leaves the current one as it was.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewake.operators.writes import upsert


@dataclass(frozen=True)
class Version:
    number: int
    folders: dict[str, str]


def _fs(spark: SparkSession, at: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def _numbers(spark: SparkSession, root: str) -> list[tuple[int, int]]:
    """(number, bytes) of the pointers, in order."""
    fs, path = _fs(spark, f"{root}/_pointers")
    return sorted((int(f.getPath().getName()), f.getLen()) for f in fs.listStatus(path)) if fs.exists(path) else []


def history(spark: SparkSession, root: str) -> list[Version]:
    """The published versions, oldest first; a pointer that its writer left empty isn't one."""
    out = []
    for number, size in _numbers(spark, root):
        if size:
            fs, path = _fs(spark, f"{root}/_pointers/{number:010d}")
            stream = fs.open(path)
            try:
                out.append(Version(number, json.loads(stream.readUTF())))
            finally:
                stream.close()
    return out


def current(spark: SparkSession, root: str) -> Version | None:
    every = history(spark, root)
    return every[-1] if every else None


def read(spark: SparkSession, root: str, table: str, version: Version | None = None) -> DataFrame:
    """A table of a version, by default the current one. Read several tables by one version to have them of one state."""
    v = version or current(spark, root)
    if v is None or table not in v.folders:
        raise ValueError(f"no table {table} is stored here")
    return spark.read.parquet(f"{root}/{v.folders[table]}")


def _publish(spark: SparkSession, root: str, folders: dict[str, str], base: int) -> Version:
    numbers = _numbers(spark, root)
    if any(size and number > base for number, size in numbers):
        raise RuntimeError("another version was published meanwhile")
    number = max((n for n, _ in numbers), default=0) + 1
    fs, path = _fs(spark, f"{root}/_pointers/{number:010d}")
    try:
        stream = fs.create(path, False)
    except Py4JJavaError as e:
        raise RuntimeError("another version was published meanwhile") from e
    try:
        stream.writeUTF(json.dumps(folders))
    finally:
        stream.close()
    return Version(number, folders)


def replace(spark: SparkSession, root: str, tables: dict[str, DataFrame], base: Version | None = None) -> Version:
    """Write the tables as a new version and publish it; tables that aren't named stay as they are in ``base``.

    ``base`` is the version that the new tables were made from (by default the current one): when
    another writer has published since, nothing is and an error is raised.
    """
    base = base or current(spark, root)
    name = f"v-{uuid.uuid4().hex}"
    for table, df in tables.items():
        df.write.parquet(f"{root}/{name}/{table}")
    return _publish(spark, root, {**(base.folders if base else {}), **{t: f"{name}/{t}" for t in tables}}, base.number if base else 0)


def roll_back(spark: SparkSession, root: str) -> Version:
    """Publish the version before the current one again."""
    every = history(spark, root)
    if len(every) < 2:
        raise ValueError("there is no version before")
    return _publish(spark, root, every[-2].folders, every[-1].number)


def forget(spark: SparkSession, root: str, keep: int = 2) -> int:
    """Delete the folders that none of the last ``keep`` versions names; the number of folders deleted.

    Folders that were never published stay: a writer may still be at work in them.
    """
    every = history(spark, root)
    old, kept = every[:-keep], every[-keep:]
    live = {f for v in kept for f in v.folders.values()}
    gone = {f for v in old for f in v.folders.values()} - live
    for v in old:
        fs, path = _fs(spark, f"{root}/_pointers/{v.number:010d}")
        fs.delete(path, False)
    for folder in gone:
        fs, path = _fs(spark, f"{root}/{folder}")
        fs.delete(path, True)
    return len(gone)


# what is replaced as one ------------------------------------------------------------------------


def import_records(spark: SparkSession, root: str, records: dict[str, DataFrame], *, force: bool = False, dry_run: bool = False) -> tuple[int, Version | None]:
    """(stored detections that the import replaces, the version written) for the tables of ``transfer.read_records``.

    Scenes replace stored ones by id and all their detections go with them; vessels replace older
    ones (by updated_us). Replacing detections is an error unless forced; a dry run writes nothing.
    """
    base = current(spark, root)
    if base is None:
        n, tables = 0, {"scenes": records["scene"], "detections": records["detection"], "ships": records["ship"]}
    else:
        old = {t: read(spark, root, t, base) for t in ("scenes", "detections", "ships")}
        taken = records["scene"].select(F.col("id").alias("scene_id")).distinct()
        n = old["detections"].join(taken, "scene_id", "left_semi").count()
        kept = old["detections"].join(taken, "scene_id", "left_anti")
        tables = {
            "scenes": upsert(old["scenes"], records["scene"], "id").select(*old["scenes"].columns),
            "detections": kept.select(*old["detections"].columns).unionByName(records["detection"], allowMissingColumns=True).select(*old["detections"].columns),
            "ships": upsert(old["ships"], records["ship"], "mmsi", "updated_us").select(*old["ships"].columns),
        }
    if dry_run:
        return n, None
    if n and not force:
        raise ValueError(f"the import would replace {n} stored detections; force it or leave their scenes out")
    return n, replace(spark, root, tables, base)


def reload_land(spark: SparkSession, root: str, polygons: DataFrame, boxes: list[tuple[float, float, float, float]]) -> Version:
    """Replace the land polygons by others, clipped to the boxes: the old ones are read until these are whole."""
    from tidewake.sources.files import clip_land

    return replace(spark, root, {"land": clip_land(polygons, boxes)})
