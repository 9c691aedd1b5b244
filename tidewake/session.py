"""Session helpers shared by queries, tests and the benchmark."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()
#: Tables that ``stable`` wrote inside a call of ``settled``, a list a call.
_ON_THE_WAY: list[list[DataFrame]] = []
#: Removes a query's shuffle files when it ends, not when the driver collects garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def build_session(cpus: int | str = "*", shuffle_partitions: int = 8, memory: str = "12g") -> SparkSession:
    """A local session with the settings that the engine expects (UTC, AQE)."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("tidewake")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", memory)
        .config("spark.driver.host", "127.0.0.1")
        .getOrCreate()
    )


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in the Python workers, once per application.

    The package is zipped on the driver and handed to ``addPyFile``, which every
    executor fetches from the driver, so no shared local path is assumed.
    """
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    target = os.path.join(tempfile.mkdtemp(prefix="tidewake-"), "tidewake_pkg.zip")
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, str(p.relative_to(root.parent)))
    sc.addPyFile(target)
    _SHIPPED.add(sc.applicationId)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or the checkpoint folder already set.

    On a cluster neither may be missing; only a local session makes a temporary one.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        if not named and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="tidewake-shared-"))
    return named or sc._jsc.sc().getCheckpointDir().get()


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """What is written inside leaves no shuffles behind."""
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def stable(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back: computed once for all its consumers, safe from lost executors.

    The shuffles behind it are removed as soon as it is written.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tidewake-stable-{uuid.uuid4().hex}"
    with shuffles_removed(spark):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    if _ON_THE_WAY:
        _ON_THE_WAY[-1].append(out)
    return out


def settled(make: Callable[[], DataFrame]) -> DataFrame:
    """What ``make`` returns, as ``stable``; the tables that it wrote on the way are removed."""
    out = only_on_the_way(lambda: stable(make()))
    if _ON_THE_WAY:
        _ON_THE_WAY[-1].append(out)
    return out


def only_on_the_way[T](make: Callable[[], T]) -> T:
    """What ``make`` returns; all tables that ``stable`` wrote in it are removed, but for the one that it returns."""
    _ON_THE_WAY.append([])
    out = None
    try:
        out = make()
    finally:
        discard(*(t for t in _ON_THE_WAY.pop() if t is not out))
    return out


def together(parts: list[DataFrame]) -> DataFrame:
    """``stable`` frames as one, which ``discard`` takes; ``_parts`` are the frames."""
    out = reduce(DataFrame.unionByName, parts)
    out._parts = parts
    return out


def discard(*frames: DataFrame) -> None:
    """Remove the folders of ``stable`` frames, or of several ``together``, that nothing reads any more."""
    for df in (part for frame in frames for part in getattr(frame, "_parts", [frame])):
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._written)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def spread_out(df: DataFrame) -> DataFrame:
    """``df`` over all of the session's shuffle partitions: for few bytes that mean much work, which adaptive execution would put into one task."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
