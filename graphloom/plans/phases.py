"""Phases of a scan (AGG-29, SNK-08, UDX-03): how long each took and how many rows it wrote, told as it ends."""

from __future__ import annotations

import resource
import time
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.sinks.reports import progress

#: The tables that a scan of one repository writes, in their order.
SCAN = ("files", "ts", "py", "part-nodes", "part-edges", "part-calls", "part-routes", "linked", "nodes", "edges", "churn", "coverage", "hotspots", "secrets", "issues")


class Phases:
    """Listens to `Steps`: rows are counted by the write itself, so a phase is not run again to be measured.

    `tell` gets a line of progress after each phase; the share done is that of `expected` phases.
    """

    def __init__(self, tell: Callable[[str], None] | None = None, expected: Sequence[str] = SCAN):
        self.tell, self.expected, self.done = tell, frozenset(expected), {}
        self.began = time.monotonic()

    def __call__(self, phase: str, seconds: float, rows: int) -> None:
        ms, before = self.done.get(phase, (0.0, 0))
        self.done[phase] = (ms + 1000 * seconds, before + rows)
        if self.tell:
            known = sum(p in self.expected for p in self.done)
            self.tell(progress(phase, 100 * known / max(1, len(self.expected))))

    def run(self, spark: SparkSession, run: int) -> tuple[DataFrame, DataFrame]:
        """(run, phase, ms, rows) and (run, total_ms, peak_rss: the driver's, in bytes) so far."""
        phases = spark.createDataFrame([(run, p, ms, n) for p, (ms, n) in self.done.items()], "run long, phase string, ms double, rows long")
        peak = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss * 1024
        return phases, spark.createDataFrame([(run, 1000 * (time.monotonic() - self.began), peak)], "run long, total_ms double, peak_rss long")


def means(phases: DataFrame, runs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """AGG-29 over repeated runs: (phase, ms), the mean over all runs, of which some may lack the phase; and one row
    (total_ms: the mean, peak_rss: the largest). No runs give no phases and a row of nulls."""
    whole = runs.agg(F.avg("total_ms").alias("total_ms"), F.max("peak_rss").alias("peak_rss"), F.count(F.lit(1)).alias("n"))
    each = phases.groupBy("phase").agg(F.sum("ms").alias("ms")).join(whole.select("n").where("n > 0")).select("phase", (F.col("ms") / F.col("n")).alias("ms"))
    return each, whole.drop("n")
