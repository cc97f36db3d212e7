"""Graph operators (GRF-*, SET-01, WIN-01): traversals are loops of joins over the frontier only."""

from __future__ import annotations

import tempfile
import time
import uuid
from collections.abc import Callable
from itertools import count

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.functions.text import edge_id
from graphloom.schema import IMPACT_FORWARD, IMPACT_REVERSE


class Steps:
    """Loop results written to the shared folder: lineage stays short and executors may go. `told` hears the name,
    seconds and rows of every table."""

    def __init__(self, spark: SparkSession, name: str, told: Callable[[str, float, int], None] | None = None):
        root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
        if not root:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            spark.sparkContext.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='graphloom-')}")
            root = spark.sparkContext.getCheckpointDir()
        self.spark, self.told, self.root = spark, told, f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"

    def counted(self, df: DataFrame, name: str) -> tuple[DataFrame, int]:
        """The written table and its rows, counted while they are written."""
        rows = Observation(name)
        return self.put(df.observe(rows, F.count(F.lit(1)).alias("n")), name), rows.get["n"]

    def put(self, df: DataFrame, name: str) -> DataFrame:
        rows, began = Observation(f"rows of {name}"), time.monotonic()
        seen = df.observe(rows, F.count(F.lit(1)).alias("n")) if self.told else df
        seen.write.mode("overwrite").parquet(f"{self.root}/{name}")
        if self.told:
            self.told(name, time.monotonic() - began, rows.get["n"])
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")


def first_wins(df: DataFrame, *keys: str, order: str = "ord") -> DataFrame:
    """WIN-01, SET-06: of the rows with one key, the earliest; an aggregate, not a sort per key."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.col(order)).alias("_r"))
    return best.select(*keys, "_r.*").select(*df.columns)


def last_wins(df: DataFrame, *keys: str, order: str = "ord") -> DataFrame:
    """WIN-04."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order)).alias("_r"))
    return best.select(*keys, "_r.*").select(*df.columns)


def union_fragments(*parts: DataFrame) -> DataFrame:
    """SET-01: fragments in their order, the first row of an id stays. SET-02 is the union alone."""
    whole = None
    for i, part in enumerate(parts):
        part = part.withColumn("_part", F.lit(i))
        whole = part if whole is None else whole.unionByName(part)
    ordered = whole.withColumn("_at", F.struct("_part", "ord"))
    return first_wins(ordered, "id", order="_at").drop("_part", "_at")


def with_edge_ids(edges: DataFrame) -> DataFrame:
    return edges.withColumn("id", edge_id(F.col("kind"), F.col("src"), F.col("dst")))


def dependents(edges: DataFrame) -> DataFrame:
    """(at, next): who is affected directly if `at` changes (GRF-02 under the impact kinds); rows may repeat, as
    every level of a traversal makes its own rows distinct."""
    back = edges.where(F.col("kind").isin(*IMPACT_REVERSE)).select(F.col("dst").alias("at"), F.col("src").alias("next"))
    ahead = edges.where(F.col("kind").isin(*IMPACT_FORWARD)).select(F.col("src").alias("at"), F.col("dst").alias("next"))
    return back.unionByName(ahead).where("at <> next")


#: Levels of a traversal after which the tables of visited nodes are written as one, so that plans stay short.
LEVELS = 50
#: Up to this many rows of a level are broadcast to the steps, so that these stay where they are.
FEW = 200_000


def reach(steps: DataFrame, seeds: DataFrame, name: str = "reach", most: int | None = None) -> DataFrame:
    """(seed, id, depth): what each seed reaches over (at, next), itself at depth 0.

    Breadth first with a visited set: a level joins only the last level's nodes, and what was seen is dropped.
    Where the last level, and the most that it can lead to, are few, they go to the steps and the visited nodes, which
    are then read but not shuffled; larger ones meet them by a shuffle. Cycles end, levels are written out and counted as they are,
    all seeds advance together, until a level is empty. Raises if more than `most` levels are reached.
    """
    kept = Steps(seeds.sparkSession, name)
    steps = kept.put(steps, "steps")
    seen, n = kept.counted(seeds.select(F.col("id").alias("seed"), "id", F.lit(0).alias("depth")).distinct(), "0")
    widest = steps.groupBy("at").count().agg(F.max("count")).first()[0] or 0
    frontier = seen
    for depth in count(1):
        ahead = steps.join(F.broadcast(frontier) if n <= FEW else frontier, F.col("id") == F.col("at")).select("seed", F.col("next").alias("id")).distinct()
        if n * widest <= FEW:  # the known ones among them are as few, so both sides of the last join are small
            known = seen.join(F.broadcast(ahead), ["seed", "id"], "left_semi").select("seed", "id")
            fresh = ahead.join(F.broadcast(known), ["seed", "id"], "left_anti")
        else:
            fresh = ahead.join(seen, ["seed", "id"], "left_anti")
        fresh, n = kept.counted(fresh.withColumn("depth", F.lit(depth)), str(depth))
        if not n:
            break
        if most is not None and depth > most:
            raise RuntimeError(f"more than {most} levels are reached")
        seen = seen.unionByName(fresh)
        if depth % LEVELS == 0:
            seen = kept.put(seen, f"seen-{depth}")
        frontier = fresh
    return seen


def impact(nodes: DataFrame, edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """GRF-03: (seed, id, kind, name, depth) of all that a change to each seed affects.

    The seed itself is left out. Ids without a node are walked through but not returned (T-10).
    """
    found = reach(dependents(edges), seeds, "impact").where("depth > 0")
    return found.join(nodes.select("id", "kind", "name"), "id").select("seed", "id", "kind", "name", "depth")


def impact_size(nodes: DataFrame, edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """AGG-07."""
    sizes = impact(nodes, edges, seeds).groupBy("seed").agg(F.count("*").alias("impact"))
    return seeds.select(F.col("id").alias("seed")).distinct().join(sizes, "seed", "left").select(F.col("seed").alias("id"), F.coalesce("impact", F.lit(0)).alias("impact"))


def impact_subgraph(nodes: DataFrame, edges: DataFrame, seeds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """GRF-04: seeds and dependents, and every edge among them."""
    ids = reach(dependents(edges), seeds, "subgraph").select("id").distinct()
    inside = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return nodes.join(ids, "id", "left_semi"), inside


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """AGG-06, GRF-02: fan-in and fan-out over edges that count once each."""
    once = edges.select("id", "src", "dst").distinct()
    ins = once.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("fan_in"))
    outs = once.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("fan_out"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return nodes.select("id").join(ins, "id", "left").join(outs, "id", "left").select("id", zero("fan_in"), zero("fan_out"))


def view(nodes: DataFrame, edges: DataFrame, keep: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """PRJ-12, AGG-24: nodes other than files and folders, and the edges between them."""
    kept = nodes.where(~F.col("kind").isin("File", "Directory") if keep is None else keep)
    ids = kept.select("id")
    return kept, edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")


def context(nodes: DataFrame, edges: DataFrame, node: str) -> DataFrame:
    """GRF-11, QRY-05: edges into and out of a node; of a file, those of its symbols as well."""
    own = nodes.where((F.col("id") == node) | ((F.lit(node).startswith("File:")) & (F.col("file") == F.substring(F.lit(node), 6, 100_000)))).select("id")
    ends = edges.withColumn("_end", F.explode(F.array_distinct(F.array("src", "dst"))))
    return ends.join(own.withColumnRenamed("id", "_end"), "_end", "left_semi").select("id", "src", "dst", "kind").distinct()


def file_impact(nodes: DataFrame, edges: DataFrame, file_id: str) -> DataFrame:
    """GRF-10: a file's symbols, its direct importers and all that its symbols affect."""
    path = file_id.removeprefix("File:")
    symbols = nodes.where((F.col("file") == path) & (F.col("id") != file_id))
    importers = edges.where((F.col("kind") == "IMPORTS") & (F.col("dst") == file_id)).select(F.col("src").alias("id"))
    ids = symbols.select("id").union(importers).union(impact(nodes, edges, symbols.select("id")).select("id")).distinct()
    return nodes.join(ids, "id", "left_semi")


def _thin(left: DataFrame, looped: DataFrame) -> DataFrame:
    """(id, before, after) of nodes with one edge in and one out, to others, and none to themselves."""
    ins = left.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("n"), F.min("src").alias("before")).where("n = 1").select("id", "before")
    outs = left.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("n"), F.min("dst").alias("after")).where("n = 1").select("id", "after")
    return ins.join(outs, "id").join(looped, "id", "left_anti")


def contracted(kept: Steps, left: DataFrame, looped: DataFrame, name: str) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """Edges without the inner nodes of paths, nodes on a circle of their own, and the nodes taken out, per round.

    A node with one edge in and one out lies on its path and nothing else, so the path becomes an edge. Neighbours may not go
    at once: those go whose hash is above that of their neighbours, a third of a path on average, so a path of n
    nodes takes some log n rounds. A path that comes back to where it started is a circle.
    """
    taken: list[DataFrame] = []
    for k in count():
        thin, n = kept.counted(_thin(left, looped).withColumn("h", F.xxhash64("id", F.lit(k))), f"{name}-thin-{k}")
        if not n:
            return left, looped, taken
        rank = F.struct("h", "id")
        near = thin.select(F.col("id").alias("n"), rank.alias("r"))
        above = lambda rows, side: rows.join(near.withColumnRenamed("n", side), side, "left").where(F.col("r").isNull() | (F.col(side) == F.col("id")) | (rank > F.col("r"))).drop("r")
        gone = kept.put(above(above(thin, "before"), "after").select("id", "before", "after"), f"{name}-gone-{k}")
        out = gone.select("id")
        rest = left.join(out.withColumnRenamed("id", "src"), "src", "left_anti").join(out.withColumnRenamed("id", "dst"), "dst", "left_anti")
        joined = rest.select("src", "dst").unionByName(gone.select(F.col("before").alias("src"), F.col("after").alias("dst"))).distinct()
        joined = kept.put(joined, f"{name}-joined-{k}")
        looped = kept.put(looped.unionByName(joined.where("src = dst").select(F.col("src").alias("id"))).distinct(), f"{name}-looped-{k}")
        left = joined.where("src <> dst")
        taken.append(gone)


def strongly_connected(edges: DataFrame, rounds: int | None = None) -> DataFrame:
    """GRF-05: (id, component) of the nodes on cycles of (src, dst), component the smallest member.

    Paths are contracted to edges first and nodes without an edge in or out within what is left trimmed, again and
    again. Then every node takes the largest colour that reaches it; in each colour, what reaches its root backwards is
    a component, which leaves the graph. Last, what was taken out of a path belongs to the component that both
    of its ends are in. Self-loops are components of one. Every loop ends when nothing changes any more: rings and chains take
    a logarithm of their length in rounds, only what branches takes as many as it is deep; one that takes more than
    `rounds` raises. Nodes are numbered for all that, and named again at the end: numbers are hashed, compared and
    moved for a fraction of what ids take.
    """

    def due(k: int) -> None:
        if rounds is not None and k >= rounds:
            raise RuntimeError(f"components have not settled after {rounds} rounds")

    spark = edges.sparkSession
    kept = Steps(spark, "scc")
    named = kept.put(edges.select("src", "dst").where("src is not null and dst is not null"), "named")
    ids = named.select(F.col("src").alias("id")).distinct().unionByName(named.select(F.col("dst").alias("id")).distinct()).distinct()
    numbers = kept.put(ids.select("id", F.monotonically_increasing_id().alias("n")), "numbers")
    number = lambda rows, end: rows.join(numbers.select(F.col("id").alias(end), F.col("n").alias(f"{end}_n")), end).drop(end)
    base = kept.put(number(number(named, "src"), "dst").select(F.col("src_n").alias("src"), F.col("dst_n").alias("dst")).distinct(), "base")
    looped = base.where("src = dst").select(F.col("src").alias("id"))
    left, n = kept.counted(base.where("src <> dst"), "left-0")
    found: list[DataFrame] = []
    taken: list[DataFrame] = []
    for k in count(1):
        for t in count():
            left, looped, gone = contracted(kept, left, looped, f"path-{k}-{t}")
            taken += gone
            both = left.select(F.col("src").alias("id")).distinct().join(left.select(F.col("dst").alias("id")).distinct(), "id")
            before = left.count()
            left, n = kept.counted(left.join(both.withColumnRenamed("id", "src"), "src", "left_semi").join(both.withColumnRenamed("id", "dst"), "dst", "left_semi"), f"trim-{k}-{t}")
            if n == before:
                break
            due(t + 1)
        if not n:
            break
        due(k - 1)
        colours = kept.put(left.select(F.col("src").alias("id")).distinct().withColumn("colour", F.col("id")), f"colour-{k}-0")
        for t in count(1):
            sent = left.join(colours.withColumnRenamed("id", "src"), "src").groupBy(F.col("dst").alias("id")).agg(F.max("colour").alias("sent"))
            now = kept.put(colours.join(sent, "id", "left").select("id", F.greatest("colour", "sent").alias("colour"), (F.col("sent") > F.col("colour")).alias("moved")), f"colour-{k}-{t}")
            moved = not now.where("moved").isEmpty()
            colours = now.drop("moved")
            if not moved:
                break
            due(t)
        tinted = left.join(colours.select(F.col("id").alias("src"), F.col("colour").alias("c1")), "src").join(colours.select(F.col("id").alias("dst"), F.col("colour").alias("c2")), "dst").where("c1 = c2")
        back = tinted.select(F.col("dst").alias("at"), F.col("src").alias("next"))
        roots = colours.where("id = colour").select("id")
        reached = kept.put(reach(back, roots, f"scc-back-{k}").select("seed", "id"), f"reached-{k}")
        real = reached.groupBy("seed").agg(F.count("*").alias("n")).where("n > 1").select("seed")
        members = kept.put(reached.join(real, "seed").select("id", F.col("seed").alias("root")), f"members-{k}")
        found.append(members)
        out = members.select("id").union(roots).distinct()
        left, n = kept.counted(left.join(out.withColumnRenamed("id", "src"), "src", "left_anti").join(out.withColumnRenamed("id", "dst"), "dst", "left_anti"), f"left-{k}")
    placed = looped.select("id", F.col("id").alias("root"))
    for members in found:
        placed = placed.join(members.select("id"), "id", "left_anti").unionByName(members)
    placed = kept.put(placed, "placed")
    for k, gone in enumerate(reversed(taken)):
        ends = gone.join(placed.select(F.col("id").alias("before"), F.col("root").alias("a")), "before").join(placed.select(F.col("id").alias("after"), F.col("root").alias("b")), "after")
        placed = kept.put(placed.unionByName(ends.where("a = b").select("id", F.col("a").alias("root"))), f"placed-{k}")
    members = placed.withColumnRenamed("id", "n").join(numbers, "n").select("id", "root")
    smallest = members.groupBy("root").agg(F.min("id").alias("component"))
    return members.join(smallest, "root").select("id", "component")


def layout(nodes: DataFrame, kinds: list[str]) -> DataFrame:
    """PRJ-20, WIN-11: a column per kind 260 apart, a row per node 136 apart."""
    order = F.array_position(F.array(*[F.lit(k) for k in kinds]), F.col("kind"))
    rank = F.when(order > 0, order - 1).otherwise(len(kinds))
    row = F.row_number().over(Window.partitionBy("kind").orderBy("ord", "id")) - 1
    return nodes.select("id", "kind", (rank * 260).cast("long").alias("x"), (row * 136).cast("long").alias("y"))
