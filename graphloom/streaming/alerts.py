"""Alerts as scans arrive (RUL-13, WIN-08, INC-03): one state per project, scans taken in the order in which they ended."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from graphloom.shipping import on_path

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUTPUT = "project_id string, scan_id string, alert string"
FIGURES = "at long, scan_id string, health long, circular_count long, breaking_count long"


def judged(last: tuple | None, scan: tuple, drop: int) -> Iterator[str]:
    """The alerts of a scan (at, scan_id, health, circular_count, breaking_count) after the one before it."""
    if last is not None:
        if scan[2] - last[2] <= -drop:
            yield "health-drop"
        if scan[3] - last[3] > 0:
            yield "new-circular"
    if scan[4] > 0:
        yield "breaking-changes"


class Alerts(StatefulProcessor):
    """Scans wait, by id, until the watermark has passed them; then they are compared in order with the last one
    before. What is not after that last scan, a repeated or a late one, is passed over, so nothing alerts twice.
    State is the last scan and those within the watermark's delay."""

    def __init__(self, drop: int):
        self.drop = drop

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", FIGURES)
        self.waiting = handle.getMapState("waiting", "scan_id string", FIGURES)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        last = self.last.get() if self.last.exists() else None
        for batch in rows:
            for at, scan_id, *figures in batch[["at", "scan_id", "health", "circular_count", "breaking_count"]].itertuples(index=False):
                if last is None or (int(at), scan_id) > (last[0], last[1]):
                    self.waiting.updateValue((scan_id,), (int(at), scan_id, *map(int, figures)))
                    self.handle.registerTimer(int(at))
        yield pd.DataFrame({"project_id": [], "scan_id": [], "alert": []}, dtype=object)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        due = expiredTimerInfo.getExpiryTimeInMs()
        last = self.last.get() if self.last.exists() else None
        out = []
        for scan in sorted(tuple(v) for v in self.waiting.values() if v[0] <= due):
            out += [(key[0], scan[1], alert) for alert in judged(last, scan, self.drop)]
            last = scan
            self.waiting.removeKey((scan[1],))
        if last is not None:
            self.last.update(last)
        yield pd.DataFrame(out, columns=["project_id", "scan_id", "alert"], dtype=object)

    def close(self) -> None:
        pass


def alert_stream(scans: DataFrame, drop: int = 5, late: str = "1 hour") -> DataFrame:
    """(project_id, scan_id, alert) of a stream of scans (project_id, scan_id, finished_at timestamp, health, circular_count,
    breaking_count), once the watermark has passed them: `late` is how long a scan may be late. Rows with a null among these
    columns take no part. The session must keep state in RocksDB, as this kind of state needs."""
    spark = scans.sparkSession
    on_path(spark)
    if "RocksDB" not in spark.conf.get("spark.sql.streaming.stateStore.providerClass", ""):
        raise ValueError(f"set spark.sql.streaming.stateStore.providerClass to {PROVIDER}")
    rows = scans.select("project_id", "scan_id", "finished_at", *[F.col(c).cast("long").alias(c) for c in ("health", "circular_count", "breaking_count")]).dropna()
    rows = rows.withColumn("at", F.unix_millis("finished_at")).withWatermark("finished_at", late)
    return rows.groupBy("project_id").transformWithStateInPandas(Alerts(drop), OUTPUT, "Append", "EventTime")
