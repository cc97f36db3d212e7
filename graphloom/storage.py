"""A store of snapshots with a commit (SNK-09, SRC-20, SNK-10, SNK-11): staged tables that one small file publishes.

A snapshot's tables are written to a folder of their own. Nobody reads it until an entry of the log names it, and an entry is
written aside and moved into place, so a reader sees a snapshot whole or not at all; a writer that dies leaves the ones
before it as they were. Entries have names of their own, so writers never replace each other's.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators.diff import newest

RUN = "kind string, project_id string, scan_id string, finished_at string, folder string, tables array<string>, message string, metrics map<string,double>"


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._fs().mkdirs(self._path(f"{self.root}/log"))

    def _path(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def _fs(self):
        return self._path(self.root).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _publish(self, entry: Mapping) -> None:
        name = uuid.uuid4().hex
        aside, place = self._path(f"{self.root}/staged-{name}"), self._path(f"{self.root}/log/{name}.json")
        stream = self._fs().create(aside, True)
        try:
            stream.write(bytearray(json.dumps(dict(entry)).encode("utf-8")))
        finally:
            stream.close()
        if not self._fs().rename(aside, place):
            raise OSError(f"could not publish {place}")

    def commit(self, tables: Mapping[str, DataFrame], project: str = "default", scan_id: str | None = None, metrics: Mapping[str, float] | None = None, finished_at: str | None = None) -> str:
        """Writes the tables and publishes them together; the scan's id."""
        scan_id = scan_id or uuid.uuid4().hex
        folder = f"data/{uuid.uuid4().hex}"
        for name, df in tables.items():
            df.write.parquet(f"{self.root}/{folder}/{name}")
        self._publish({"kind": "success", "project_id": project, "scan_id": scan_id, "finished_at": finished_at or _now(), "folder": folder, "tables": sorted(tables), "metrics": dict(metrics or {})})
        return scan_id

    def fail(self, message: str, project: str = "default", scan_id: str | None = None, finished_at: str | None = None) -> None:
        """Records a scan that failed; the last success stays the one that is read."""
        self._publish({"kind": "error", "project_id": project, "scan_id": scan_id or uuid.uuid4().hex, "finished_at": finished_at or _now(), "message": message})

    def runs(self) -> DataFrame:
        """(project_id, scan_id, kind, finished_at, folder, tables, message, metrics) of all scans; the folder is null
        once its tables were pruned. Of entries for one scan, the latest counts."""
        log = self.spark.read.schema(RUN).json(f"{self.root}/log")
        last = log.where("kind <> 'pruned'").groupBy("project_id", "scan_id").agg(F.max_by(F.struct("kind", "finished_at", "folder", "tables", "message", "metrics"), F.struct("finished_at", "folder")).alias("r"))
        gone = log.where("kind = 'pruned'").select("folder", F.lit(True).alias("_gone")).distinct()
        rows = last.select("project_id", "scan_id", "r.*").join(gone, "folder", "left")
        return rows.withColumn("folder", F.when(F.col("_gone").isNull(), F.col("folder"))).select("project_id", "scan_id", "kind", "finished_at", "folder", "tables", "message", "metrics")

    def metrics(self) -> DataFrame:
        """A row per success, its figures as columns of doubles, kept when tables are pruned."""
        rows = self.runs().where("kind = 'success'")
        names = [r[0] for r in rows.select(F.explode(F.map_keys("metrics"))).distinct().orderBy("col").limit(1000).collect()]
        return rows.select("project_id", "scan_id", "finished_at", *[F.col("metrics")[n].alias(n) for n in names])

    def latest(self, project: str = "default", n: int = 1, before: str | None = None) -> list[tuple[str, dict[str, DataFrame]]]:
        """(scan_id, tables) of the newest successes whose tables are there, newest first; `before` names a scan and
        asks for those that finished before it."""
        rows = self.runs().where((F.col("project_id") == project) & (F.col("kind") == "success") & F.col("folder").isNotNull())
        if before is not None:
            at = self.runs().where((F.col("project_id") == project) & (F.col("scan_id") == before)).first()
            rows = rows.where(F.struct("finished_at", "scan_id") < F.struct(F.lit(at["finished_at"] if at else None), F.lit(before)))
        found = newest(rows, n).orderBy(F.desc("finished_at"), F.desc("scan_id")).collect()
        return [(r["scan_id"], {t: self.spark.read.parquet(f"{self.root}/{r['folder']}/{t}") for t in r["tables"]}) for r in found]

    def prune(self, keep: int = 20) -> int:
        """SNK-10: drops the tables of successes beyond the newest `keep` of each project; their entries stay. The
        entry that they are gone comes first, so that no reader is sent to a folder that goes."""
        rows = self.runs().where("kind = 'success' and folder is not null").select("project_id", "scan_id", "finished_at", "folder")
        old = rows.join(newest(rows, keep).select("folder"), "folder", "left_anti").collect()
        for r in old:
            self._publish({"kind": "pruned", "project_id": r["project_id"], "scan_id": r["scan_id"], "folder": r["folder"]})
            self._fs().delete(self._path(f"{self.root}/{r['folder']}"), True)
        return len(old)


def _now() -> str:
    return datetime.now(timezone.utc).isoformat(timespec="microseconds")
