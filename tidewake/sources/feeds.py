"""Live-shaped sources: a replayed message feed for streams and a tile fetcher for imagery."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

from tidewake.sources.files import retry_delay
from tidewake.streaming.ingest import backoff


class FeedSource(DataSource):
    """Stream source ``message_feed``: envelope lines, a bounded number a batch.

    ``boxes`` (JSON list of [[lat, lon], [lat, lon]]) is the subscription: lines outside all
    boxes never leave the source. A socket client would replace ``_lines``.
    """

    @classmethod
    def name(cls) -> str:
        return "message_feed"

    def schema(self) -> str:
        return "value string"

    def simpleStreamReader(self, schema) -> FeedReader:
        return FeedReader(self.options)


class FeedReader(SimpleDataSourceStreamReader):
    """Offsets are bytes, so a batch reads its own lines only.

    A read that fails waits, longer each time, and gives an empty batch; the wait starts anew
    after a connection of ten seconds.
    """

    def __init__(self, options, wait: Callable[[float], None] = time.sleep, clock: Callable[[], float] = time.monotonic):
        self.path, self.most = options["path"], int(options.get("rows", "100"))
        self.boxes = json.loads(options.get("boxes", "null"))
        self.wait, self.clock, self.failures, self.since = wait, clock, 0, None

    def initialOffset(self) -> dict:
        return {"byte": 0}

    def _lines(self, start: int, end: int | None = None) -> tuple[list[str], int]:
        """Lines from a place on, up to another or ``rows`` of them, and where they end."""
        out = []
        with open(self.path, "rb") as f:
            f.seek(start)
            while (f.tell() < end) if end is not None else (len(out) < self.most):
                line = f.readline()
                if not line:
                    break
                out.append(line.decode("utf-8", "replace").rstrip("\n"))
            return out, f.tell()

    def _wanted(self, line: str) -> bool:
        if self.boxes is None:
            return True
        try:
            meta = json.loads(line).get("MetaData", {})
            lat, lon = float(meta["latitude"]), float(meta["longitude"])
        except (ValueError, KeyError, TypeError):
            return False
        return any(min(a[0], b[0]) <= lat <= max(a[0], b[0]) and min(a[1], b[1]) <= lon <= max(a[1], b[1]) for a, b in self.boxes)

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        try:
            lines, end = self._lines(start["byte"])
        except OSError:
            held = self.clock() - self.since if self.since is not None else 0.0
            self.failures = 0 if held >= 10 else self.failures
            self.wait(backoff(self.failures, held))
            self.failures, self.since = self.failures + 1, None
            return iter([]), start
        self.since = self.clock() if self.since is None else self.since
        return iter([(x,) for x in lines if self._wanted(x)]), {"byte": end}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter([(x,) for x in self._lines(start["byte"], end["byte"])[0] if self._wanted(x)])


def feed_stream(spark: SparkSession, path: str, boxes: list, rows: int = 100) -> DataFrame:
    """The feed's lines inside the subscription's boxes, at most ``rows`` a batch."""
    spark.dataSource.register(FeedSource)
    return spark.readStream.format("message_feed").option("path", path).option("rows", str(rows)).option("boxes", json.dumps(boxes)).load()


def fetch_tiles(plan: DataFrame, fetch: Callable[[dict], bytes], parallel: int = 4, tries: int = 4, wait: Callable[[float], None] = time.sleep) -> DataFrame:
    """(scene_id, x_off, y_off, w, h) tiles to rows with pixels, a bounded number at a time.

    ``fetch`` raises ``BusyError`` when the service asks to come back later; other errors
    end the task, which Spark tries again.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for r in b.to_dict("records"):
                for k in range(tries):
                    try:
                        out.append(fetch(r))
                        break
                    except BusyError as e:
                        if k == tries - 1:
                            raise
                        wait(retry_delay(k, e.retry_after))
            yield b.assign(pixels=out)

    return plan.repartition(parallel).mapInPandas(run, plan.schema.simpleString()[7:-1].replace(":", " ") + ", pixels binary")


class BusyError(Exception):
    def __init__(self, retry_after: str | None = None):
        super().__init__("the service is busy")
        self.retry_after = retry_after
