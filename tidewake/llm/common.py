"""Helpers shared by the corpus operators: shared storage, hashing, packed exchange.

Conventions kept by every operator of this subpackage:

* inputs are DataFrames; columns are addressed by parameter and nothing else of the
  input is touched, so extra columns (even with the names of working columns) pass;
* a null text counts as empty;
* intermediate tables go to the folder named by ``spark.checkpoint.dir`` as Parquet, so
  a lost executor costs a recomputation and never a result.
"""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewake.session import shared_folder, ship_package

#: Upper bound, in bytes, of what one Arrow batch hands to a Python worker.
BATCH_BYTES = 16 << 20
#: ASCII white space, the class [\x20\x09-\x0D] of the contracts.
SPACE = "[\\x20\\x09-\\x0D]+"
NOT_SPACE = "[^\\x20\\x09-\\x0D]+"


def prepare(spark: SparkSession, batch_bytes: int = BATCH_BYTES) -> None:
    """Ship the package and bound the Arrow batches by bytes (long texts)."""
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(batch_bytes))


#: Spark's own switch: the shuffle files of an execution go when it ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialise(df: DataFrame, name: str, free: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives executors.

    With ``free``, the shuffles behind ``df`` are removed as soon as the table is written.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tidewake-{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, "false")
    if free:
        spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if free:
            spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def discard(*frames: DataFrame) -> None:
    """Remove the folders of materialised frames that nothing reads any more."""
    for df in frames:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._written)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


#: Share of a table's rows from which one key counts as heavy, and the least rows of such a key.
HEAVY_SHARE = 1000
HEAVY_ROWS = 256


def heavy_keys(df: DataFrame, key: str, least: int = HEAVY_ROWS) -> list[tuple[int, int]]:
    """(key, rows) of the keys that hold a thousandth of the rows or more: a thousand keys at most."""
    total = df.count()
    counts = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("rows"))
    return [tuple(r) for r in counts.filter(F.col("rows") >= max(least, -(-total // HEAVY_SHARE))).collect()]


def join_unskewed(left: DataFrame, right: DataFrame, key: str, how: str = "inner", least: int = HEAVY_ROWS, also: tuple[str, ...] = ()) -> DataFrame:
    """``left`` joined with ``right``, which has one row per key, however often a key occurs in ``left``.

    ``also`` names columns that must be equal too, where the key is a hash of them.

    Rows of heavy keys stay where they are and meet the heavy keys' rows (a thousand at most)
    by broadcast; the others meet by a shuffle. ``left`` is read three times: materialise it.
    """
    heavy = [k for k, _ in heavy_keys(left, key, least)]
    on = [key, *also]
    if not heavy:
        return left.join(right, on, how)
    hot = F.coalesce(F.col(key).isin(heavy), F.lit(False))
    return left.filter(~hot).join(right, on, how).unionByName(left.filter(hot).join(F.broadcast(right.filter(hot)), on, how))


def unused(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


#: Most bits of a membership filter: it is broadcast, 8 MB at most whatever the number of keys.
FILTER_BITS = 1 << 26
_MAP_BITS = 1 << 15  # positions of one row of Spark's bitmap aggregate


def flagged(df: DataFrame, value: Column, keys: DataFrame, key: str) -> tuple[DataFrame, str]:
    """``df`` with a boolean column, false only where ``value`` is none of the ``keys``; and its name.

    A bitmap over hashes, wide enough that few others are true while there are fewer than
    about two million keys; with many more it filters less, and stays as large. ``keys`` is
    read twice: materialise it.
    """
    bits = min(FILTER_BITS, max(_MAP_BITS, 1 << (32 * keys.count()).bit_length()))
    slot = lambda c: F.pmod(c, F.lit(bits))
    number, bitmap, mine, hit = (unused(df, n) for n in ("_number", "_bitmap", "_slot", "_hit"))
    at = keys.select(slot(F.col(key)).alias("at"))
    maps = at.groupBy(F.floor(F.col("at") / _MAP_BITS).cast("long").alias(number)).agg(F.bitmap_construct_agg(F.col("at") % _MAP_BITS).alias(bitmap))
    told = df.withColumn(mine, slot(value)).withColumn(number, F.floor(F.col(mine) / _MAP_BITS).cast("long"))
    told = told.join(F.broadcast(maps), number, "left")  # bits / 32,768 rows of 4 KB: a proven bound
    byte = F.expr(f"cast(conv(hex(substring(`{bitmap}`, cast(`{mine}` % {_MAP_BITS} div 8 as int) + 1, 1)), 16, 10) as int)")
    told = told.withColumn(hit, F.coalesce(F.getbit(byte, F.col(mine) % 8) == 1, F.lit(False)))
    return told.drop(number, bitmap, mine), hit


def without_rows(docs: DataFrame, gone: DataFrame, id_col: str, row_hash: Column) -> DataFrame:
    """``docs`` without the rows that ``gone`` (gone_id, gone_hash; materialised) tells; null identifiers are equal.

    Only rows whose hash may be among those that go are shuffled.
    """
    ident, mark = unused(docs, "gone_id"), unused(docs, "gone_hash")
    told = gone.select(F.col("gone_id").alias(ident), F.col("gone_hash").alias(mark))
    rows, hit = flagged(docs, row_hash, gone, "gone_hash")
    asked = rows.filter(F.col(hit)).drop(hit)
    left = asked.join(told, asked[id_col].cast("long").eqNullSafe(F.col(ident)) & (row_hash == F.col(mark)), "left_anti")
    return rows.filter(~F.col(hit)).drop(hit).union(left)


def shuffle_width(spark: SparkSession) -> int:
    """Number of shuffle partitions of the session: operators scale with it."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def text_bytes(col: str | Column) -> Column:
    """The text's UTF-8 bytes, empty for null."""
    c = F.col(col) if isinstance(col, str) else col
    return F.coalesce(c.cast("binary"), F.lit(b""))


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (multiply, shift, xor): spreads every input bit over the word."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
