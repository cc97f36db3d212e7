"""Connected components of an edge table by alternating stars, DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import Scratch


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, name: str = "components", rounds: int = 60) -> DataFrame:
    """(node, root): every node of `edges` (u, v longs) with the smallest node that it reaches.

    Null ends and loops are left out, repeated and reversed edges count once; no edges give no rows.
    Each round joins every edge with the smallest neighbour of one end: the large star links higher
    neighbours to that minimum, the small star the lower ones. Minima are partial aggregates, and
    the join is one that adaptive execution can split, so a node with a third of all edges does not
    meet in one task. Stops when the edge set no longer changes, and
    raises if it still does after `rounds` rounds.
    """
    spark = edges.sparkSession
    scratch = Scratch(spark, name)
    now = scratch.put(edges.where("u is not null and v is not null and u <> v").select(F.greatest("u", "v").cast("long").alias("u"), F.least("u", "v").cast("long").alias("v")).distinct(), "0")
    before, last = _signature(now), 0
    for k in range(1, rounds + 1):
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        now = scratch.put(small, str(k))
        scratch.drop(str(last))
        last, after = k, _signature(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components have not settled after {rounds} rounds")
    return now.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "node").union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
