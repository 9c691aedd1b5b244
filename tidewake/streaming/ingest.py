"""Structured Streaming ingest: envelopes to position files and keyed latest identities."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidewake.sources import ais_json

_DAY = 86_400_000_000
_IDENTITY = ("ship_name", "ship_type", "callsign")


def envelope_stream(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """Envelope lines from text files of a folder, oldest first."""
    return spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(path)


def start_positions(stream: DataFrame, out: str, checkpoint: str, dead_letters: str | None = None, **trigger):
    """Append every position of the stream as Parquet, by day.

    Delivery is at least once with a file per batch that replaces itself on replay, where a
    live table would lose a failed batch. Lines that aren't envelopes go to ``dead_letters``.
    Duplicates are kept: every report is a row.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        rows = ais_json.positions(ais_json.decode(batch)).withColumn("day", F.floor(F.col("time_us") / _DAY).cast("long"))
        rows.write.mode("overwrite").partitionBy("day").parquet(f"{out}/batch={number}")
        if dead_letters:
            bad = batch.filter(F.get_json_object("value", "$.MessageType").isNull())
            bad.write.mode("overwrite").text(f"{dead_letters}/batch={number}")
        batch.unpersist()

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "1 second"})).start()


def read_positions(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.parquet(out)


def drop_days(spark: SparkSession, out: str, now_us: int, days: int) -> int:
    """Delete the day folders of ``start_positions`` whose every row retention drops; their number.

    The day that holds the limit stays: ``retain`` leaves its older rows out when it is read.
    """
    first = (now_us - days * _DAY) // _DAY
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{out}/batch=*/day=*")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    old = [f.getPath() for f in fs.globStatus(path) or [] if (day := f.getPath().getName()[4:]).lstrip("-").isdigit() and int(day) < first]
    for p in old:
        fs.delete(p, True)
    return len(old)


_STATE = "updated_us long, ship_name string, ship_type int, callsign string"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Latest(StatefulProcessor):
    """Newer messages fill what they know; a message not newer than all before it is ignored."""

    def __init__(self, forget_after_s: float | None):
        self.ttl_ms = None if forget_after_s is None else int(forget_after_s * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("held", _STATE, self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues):
        new = pd.concat(list(rows)).sort_values("seq", kind="stable").dropna(subset=["time_us"])
        old = self.held.get() if self.held.exists() else None
        before = new["time_us"].cummax().shift()
        if old is not None:
            before = before.fillna(old[0]).clip(lower=old[0])
        live = new[before.isna() | (new["time_us"] > before)]
        if len(live):
            known = [live[c].dropna() for c in _IDENTITY]
            said = [v.iloc[-1] if len(v) else (old[i] if old is not None else None) for i, v in enumerate(known, 1)]
            row = (int(live["time_us"].iloc[-1]), said[0], None if said[1] is None else int(said[1]), said[2])
            self.held.update(row)
            yield pd.DataFrame({"mmsi": [key[0]], "updated_us": [row[0]], "ship_name": [row[1]], "ship_type": pd.array([row[2]], "Int32"), "callsign": [row[3]]})

    def close(self) -> None:
        pass


def latest_identities(stream: DataFrame, forget_after_s: float | None = None) -> DataFrame:
    """Keyed state per vessel over (mmsi, seq, time_us, identity columns); seq is the order of arrival.

    A row is put out whenever a vessel's identity becomes newer. With ``forget_after_s``, the state of a
    vessel that has told nothing new for so long (by the clock) goes, and it is a new one when it comes
    back. Messages without a time are ignored. Sets the session's state store to RocksDB,
    which this kind of state needs; queries that have started keep theirs. Where state can be
    forgotten, batches without rows go on by the clock: for a trigger that ends (availableNow),
    turn ``spark.sql.streaming.noDataMicroBatches.enabled`` off.
    """
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKSDB)
    mode = "None" if forget_after_s is None else "ProcessingTime"
    return stream.groupBy("mmsi").transformWithStateInPandas(_Latest(forget_after_s), f"mmsi long, {_STATE}", "update", mode)


def latest_identities_batch(messages: DataFrame) -> DataFrame:
    """The same result from a finished table, by windows: a message counts when it is newer than all that arrived before."""
    w = W.partitionBy("mmsi").orderBy("seq")
    before = F.max("time_us").over(w.rowsBetween(W.unboundedPreceding, -1))
    live = messages.withColumn("_before", before).filter(F.col("_before").isNull() | (F.col("time_us") > F.col("_before")))
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("time_us"))).alias(c)
    return live.groupBy("mmsi").agg(F.max("time_us").alias("updated_us"), *(last(c) for c in _IDENTITY))


def retain(positions: DataFrame, now_us: int, days: int) -> DataFrame:
    """Rows that retention keeps: only strictly older ones go."""
    return positions.filter(F.col("time_us") >= now_us - days * _DAY)


def backoff(attempt: int, connected_s: float = 0.0, first: float = 1.0, most: float = 30.0) -> float:
    """Seconds before the next connection: doubling, started anew after a connection of ten seconds."""
    return first if connected_s >= 10 else min(most, first * 2**attempt)


def source_health(events: DataFrame, now_us: int, stale_after_s: int = 60) -> DataFrame:
    """Per source, from a log of (source, kind, at_us, reason): state, lag, reconnects, last error.

    ``connected`` turns stale when nothing was heard for longer than the limit, counted from
    the connection where no message came yet. Reconnects count from the second connection.
    """
    last = lambda k, c="at_us": F.max_by(c, F.when(F.col("kind") == k, F.col("at_us")))
    per = events.groupBy("source").agg(
        F.max_by("kind", F.when(F.col("kind") != "message", F.col("at_us"))).alias("kind"), last("connected").alias("connected_us"), last("message").alias("message_us"),
        F.greatest(F.count_if(F.col("kind") == "connected") - 1, F.lit(0)).alias("reconnects"), F.max_by("reason", F.when(F.col("kind").isin("disconnected", "error"), F.col("at_us"))).alias("last_error"),
    )
    silent = (F.lit(now_us) - F.coalesce("message_us", "connected_us")) / F.lit(1e6)
    state = F.when((F.col("kind") == "connected") & (silent > stale_after_s), "stale").otherwise(F.col("kind"))
    return per.select("source", state.alias("state"), F.round((F.lit(now_us) - F.col("message_us")) / F.lit(1e6), 1).alias("lag_s"), "reconnects", "last_error")


class TtlCache:
    """Values that are made anew once they are older than their time to live."""

    def __init__(self, ttl_s: float = 600.0):
        self.ttl, self.held = ttl_s, {}

    def get(self, key, now: float, make):
        value, at = self.held.get(key, (None, None))
        if at is None or now - at >= self.ttl:
            value = make()
            self.held[key] = (value, now)
        return value


class TokenBucket:
    """Requests per key with continuous refill."""

    def __init__(self, rate_per_s: float, burst: float):
        self.rate, self.burst, self.held = rate_per_s, burst, {}

    def allow(self, key: str, now: float) -> bool:
        tokens, at = self.held.get(key, (self.burst, now))
        tokens = min(self.burst, tokens + (now - at) * self.rate)
        ok = tokens >= 1
        self.held[key] = (tokens - ok, now)
        return ok
