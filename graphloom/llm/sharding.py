"""Minimum-cost-flow resharding: fewest bytes move from old shards to new capacities, other files stay."""

from __future__ import annotations

import heapq
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from graphloom.llm.common import Scratch, without

ADDED = ("shard", "slot", "_size", "_file", "_row")
#: Up to this many files (about 200 bytes each) their table is broadcast; beyond, it is joined by shuffle.
BROADCAST_FILES = 20_000


def min_cost_flow(supply: Sequence[int], demand: Sequence[int], cost: Callable[[int, int], int]) -> dict[tuple[int, int], int]:
    """Units to ship from each supply to each demand at the least total cost; the totals must agree.

    Successive shortest paths with potentials over the bipartite network. Its size is that of the
    shard lists, whatever the rows.
    """
    if sum(supply) != sum(demand):
        raise ValueError("supply and demand differ")
    n, m = len(supply), len(demand)
    left, want = list(supply), list(demand)
    flow: dict[tuple[int, int], int] = {}
    potential = [0] * (n + m)
    price = [[cost(i, j) for j in range(m)] for i in range(n)]
    while any(left):
        far = float("inf")
        dist, via = [far] * (n + m), [-1] * (n + m)
        queue = []
        for i in range(n):
            if left[i]:
                dist[i] = 0
                queue.append((0, i))
        heapq.heapify(queue)
        while queue:
            d, x = heapq.heappop(queue)
            if d > dist[x]:
                continue
            steps = ((n + j, price[x][j]) for j in range(m)) if x < n else ((i, -price[i][x - n]) for i in range(n) if flow.get((i, x - n), 0))
            for y, c in steps:
                to = d + c + potential[x] - potential[y]
                if to < dist[y]:
                    dist[y], via[y] = to, x
                    heapq.heappush(queue, (to, y))
        end = min((n + j for j in range(m) if want[j]), key=lambda y: dist[y] + potential[y])
        path, x = [end], end
        while via[x] != -1:
            x = via[x]
            path.append(x)
        path.reverse()
        amount = min(left[path[0]], want[end - n])
        for a, b in zip(path, path[1:], strict=False):
            if a >= n:
                amount = min(amount, flow[b, a - n])
        for a, b in zip(path, path[1:], strict=False):
            key, by = ((a, b - n), amount) if a < n else ((b, a - n), -amount)
            flow[key] = flow.get(key, 0) + by
        left[path[0]] -= amount
        want[end - n] -= amount
        top = max(d for d in dist if d < far)
        potential = [p + min(d, top) for p, d in zip(potential, dist, strict=True)]
    return {k: v for k, v in flow.items() if v}


@dataclass
class Plan:
    """flow: bytes by (old, new); cuts: (old, new, from, to), which bytes of an old shard, in the order of its
    files, each transfer takes; moved: bytes that change their shard."""

    flow: dict[tuple[int, int], int]
    cuts: list[tuple[int, int, int, int]]
    moved: int


#: Beyond any shard's bytes.
END = 1 << 62


def plan_moves(supply: Sequence[int], n_new: int, capacities: Sequence[int] | None = None) -> Plan:
    """From the bytes of each old shard, the transfers that move the fewest bytes.

    Without capacities, new shards take equal shares. With capacities, which must hold all bytes, a shard
    may take less, so that old shards within theirs are left alone. What stays comes first in an old
    shard, so the files at its end are those that move.
    """
    total = sum(supply)
    demand = [total // n_new + (j < total % n_new) for j in range(n_new)] if capacities is None else list(capacities)
    spare = sum(demand) - total
    if spare < 0 or len(demand) != n_new:
        raise ValueError(f"{len(demand)} capacities of {sum(demand)} bytes for {n_new} shards and {total} bytes")
    n = len(supply)
    flow = min_cost_flow([*supply, spare], demand, lambda i, j: int(i != j and i < n))
    flow = {(i, j): v for (i, j), v in flow.items() if i < n}
    cuts = []
    for i in range(n):
        goals = sorted((j for k, j in flow if k == i), key=lambda j: (j != i, j)) or [i % n_new]
        at = 0
        for j in goals:
            last = j == goals[-1]
            cuts.append((i, j, at if at else -1, END if last else at + flow[i, j]))
            at += flow.get((i, j), 0)
    return Plan(flow, cuts, sum(v for (i, j), v in flow.items() if i != j))


def lay_out(docs: DataFrame, size: Column, shard: Column, path: str) -> StructType:
    """Writes docs as files below one folder per shard, without a shuffle; returns the schema to read them with.
    Input columns named like one of ADDED give way."""
    rows = without(docs, *ADDED).withColumn("_size", size.cast("long")).withColumn("shard", shard.cast("int"))
    rows.write.mode("overwrite").option("compression", "zstd").partitionBy("shard").parquet(path)
    return rows.schema


def _read(spark: SparkSession, schema: StructType, path: str, files: Sequence[str] | None = None) -> DataFrame:
    """The rows of a layout, or of some of its files, with their file and place in it."""
    reader = spark.read.schema(schema)
    rows = reader.parquet(path) if files is None else reader.option("basePath", path).parquet(*files)
    return rows.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))


def _few(files: DataFrame) -> DataFrame:
    return F.broadcast(files) if files.limit(BROADCAST_FILES + 1).count() <= BROADCAST_FILES else files


def reshard(spark: SparkSession, path: str, schema: StructType, n_old: int, n_new: int, to: str, capacities: Sequence[int] | None = None) -> tuple[DataFrame, Plan]:
    """The rows of the layout at `path` with shard (0 to n_new - 1) and slot (gapless from 0 within the
    shard), and the plan; only affected files are written again, below `to`.

    The driver sees the bytes of each old shard, solves the flow and cuts each old shard's bytes, in the order
    of its files, into transfers. A file that lies within what stays is left in place. One within a
    transfer moves as it is; one that a cut crosses is split at the row in whose middle the cut lies. So shards
    miss their share by a row's bytes for each transfer, and a shard of any size, even one of equal keys, is
    split. A slot is the row's place in its file after the rows of the shard's files before, kept in a
    table of files; no shard is sorted or numbered by one task. An empty layout gives no rows. What is
    listed on the driver are names of files, as for any scan.
    """
    scratch = Scratch(spark, "reshard")
    rows = _read(spark, schema, path)
    per_file = lambda df: df.groupBy(F.col("_file").alias("file"), "shard").agg(F.sum("_size").alias("bytes"), F.count("*").alias("rows"))
    files = scratch.put(per_file(rows), "files")
    held = {r.shard: r.bytes for r in files.groupBy("shard").agg(F.sum("bytes").alias("bytes")).collect()}
    plan = plan_moves([held.get(i, 0) for i in range(n_old)], n_new, capacities)
    cuts = spark.createDataFrame(plan.cuts, "shard int, new int, from long, to long")
    end = F.sum("bytes").over(Window.partitionBy("shard").orderBy("file"))
    placed = files.withColumn("end", end).withColumn("start", F.col("end") - F.col("bytes")).join(F.broadcast(cuts), "shard")
    placed = placed.groupBy("file", "shard", "bytes", "rows", "start").agg(F.min(F.when((F.col("from") <= F.col("start")) & (F.col("end") <= F.col("to")), F.col("new"))).alias("new"))
    placed = scratch.put(placed, "placed")
    names = lambda df: [r.file for r in df.select("file").collect()]
    stay, move, split = (placed.where(c) for c in ("new = shard", "new <> shard", "new is null"))
    columns = [c for c in schema.fieldNames() if c != "shard"]
    again = []
    if moved := names(move):
        goal = move.select(F.col("file").alias("_file"), "new")
        again.append(_read(spark, schema, path, moved).join(_few(goal), "_file").select(*columns, F.col("new").alias("shard")))
    if crossed := names(split):
        start = split.select(F.col("file").alias("_file"), "start")
        before = F.sum("_size").over(Window.partitionBy("_file").orderBy("_row")) - F.col("_size")
        parts = _read(spark, schema, path, crossed).join(_few(start), "_file").withColumn("_at", 2 * (F.col("start") + before) + F.col("_size"))
        goal = cuts.select(F.col("shard").alias("_old"), "new", "from", "to")
        met = (F.col("shard") == F.col("_old")) & (F.col("_at") >= 2 * F.col("from")) & (F.col("_at") / 2 < F.col("to"))
        again.append(parts.join(F.broadcast(goal), met).select(*columns, F.col("new").alias("shard")))
    table, kept = [], []
    if left := names(stay):
        kept.append(_read(spark, schema, path, left))
        table.append(stay.select("file", "shard", "rows"))
    if again:
        both = again[0] if len(again) == 1 else again[0].unionByName(again[1])
        both.write.mode("overwrite").option("compression", "zstd").partitionBy("shard").parquet(to)
        written = _read(spark, schema, to)
        kept.append(written)
        table.append(scratch.put(per_file(written), "written").select("file", "shard", "rows"))
    if not kept:
        return rows.drop("_file", "_row", "_size").withColumn("slot", F.lit(0).cast("long")), plan
    manifest = table[0] if len(table) == 1 else table[0].union(table[1])
    base = F.sum("rows").over(Window.partitionBy("shard").orderBy("file")) - F.col("rows")
    manifest = scratch.put(manifest.select(F.col("file").alias("_file"), base.alias("_base")), "manifest")
    every = kept[0] if len(kept) == 1 else kept[0].unionByName(kept[1])
    slots = every.join(_few(manifest), "_file").withColumn("slot", F.col("_base") + F.col("_row"))
    return slots.drop("_file", "_row", "_base", "_size"), plan
