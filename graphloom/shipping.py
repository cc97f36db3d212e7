"""Puts this package on the path of Python workers that start from elsewhere."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def on_path(spark: SparkSession) -> None:
    """Workers that start from now on find the package, where executors see its folder. Elsewhere it is installed
    or sent with the job, as any package is."""
    paths = spark.sparkContext.environment.get("PYTHONPATH", "")
    if ROOT not in paths.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(p for p in (ROOT, paths) if p)
