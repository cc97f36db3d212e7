"""Facts of files kept between scans (INC-01, INC-02): known by path and content, replaced as a whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.storage import Store

#: To be raised whenever extractors find other facts: tables of other versions are passed over.
VERSION = 3


class FactsCache:
    """A table of facts per extractor below one folder.

    Only files that no entry has with this path and content are parsed. What a scan did not ask for leaves the
    table. It is published by a Store, so scans that run at once, or die, harm no one; two versions are kept, as
    a reader may still be at the one before.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.store = Store(spark, f"{folder.rstrip('/')}/facts-{VERSION}")

    def facts(self, files: DataFrame, name: str, facts: Column) -> DataFrame:
        """(path, facts, parsed) of files (path, content): `facts` of the content, parsed now or before."""
        files = files.withColumn("sha", F.sha1("content"))
        held = self.store.latest(name)
        fresh = files
        if held:
            known = held[0][1]["facts"]
            fresh = files.join(known.select("path", "sha"), ["path", "sha"], "left_anti")
        rows = fresh.select("path", "sha", facts.alias("facts"), F.lit(True).alias("parsed"))
        if held:
            rows = rows.unionByName(known.join(files.select("path", "sha"), ["path", "sha"], "left_semi").withColumn("parsed", F.lit(False)))
        self.store.commit({"facts": rows}, name)
        self.store.prune(2)
        return self.store.latest(name)[0][1]["facts"].select("path", "facts", "parsed")
