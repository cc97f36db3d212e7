"""Exact top-k inner products: vectors in buckets of like length, pruned by local cosine thresholds."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import Scratch, batches, lists

PACKED = "part int, seq long, kind int, dim int, n int, ids binary, data binary"
FOUND = "query_id long, vec_id long, score long"
#: Rows of a bucket, queries of a block, vectors that set the first thresholds, bytes of candidates a task holds.
BUCKET, BLOCK, SEEDS, PART_BYTES = 2048, 512, 4096, 64 << 20
#: From this local cosine threshold on, coordinates prune; below, lengths do.
STEEP = 0.6
FOCUS = 3
EXACT = float(1 << 53)


def products(q: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Integer inner products of int64 rows: by floating point where that is exact, else by integers of any size, which saturate."""
    if not q.size or not p.size:
        return np.zeros((len(q), len(p)), np.int64)
    bound = float(np.abs(q.astype(np.float64)).max()) * float(np.abs(p.astype(np.float64)).max()) * q.shape[1]
    if bound < EXACT:
        return (q.astype(np.float64) @ p.astype(np.float64).T).astype(np.int64)
    if bound < 2.0**62:
        return q @ p.T
    return np.clip(q.astype(object) @ p.astype(object).T, -(1 << 63), (1 << 63) - 1).astype(np.int64)


@dataclass
class Bucket:
    """Vectors of like length, longest first, with what pruning needs."""

    ids: np.ndarray
    rows: np.ndarray

    def __post_init__(self) -> None:
        real = self.rows.astype(np.float64)
        self.lengths = np.sqrt((real * real).sum(axis=1))
        order = np.argsort(-self.lengths, kind="stable")
        self.ids, self.rows, self.lengths = self.ids[order], self.rows[order], self.lengths[order]
        self.longest = float(self.lengths[0]) if len(order) else 0.0
        self.units = np.ascontiguousarray((real[order] / np.maximum(self.lengths, 1e-300)[:, None]).T)

    def survivors(self, unit: np.ndarray, length: float, floor: float) -> np.ndarray | slice:
        """Rows that may reach the product `floor` with a query. None that does is ever left out.

        The local threshold is the cosine that even the bucket's longest vector would need. Above 1
        the bucket is out. If it is steep, each of the query's largest coordinates bounds that
        coordinate of any vector within the angle; if not, only vectors long enough are left.
        """
        if floor <= 0 or not length:
            return slice(0, len(self.ids)) if floor <= 0 else slice(0, 0)
        need = floor / (length * self.longest) if self.longest else 2.0
        if need > 1 + 1e-9:
            return slice(0, 0)
        if need < STEEP:
            return slice(0, int(np.searchsorted(-self.lengths, -(floor / length) * (1 - 1e-9), side="right")))
        need = min(need, 1.0)
        keep = np.ones(len(self.ids), bool)
        for f in np.argsort(-np.abs(unit))[:FOCUS]:
            middle, reach = unit[f] * need, np.sqrt(max(0.0, 1 - unit[f] ** 2) * (1 - need**2)) + 1e-9
            if unit[f] >= need:  # the whole cap beyond the angle on that side is feasible
                keep &= self.units[f] >= middle - reach
            elif -unit[f] >= need:
                keep &= self.units[f] <= middle + reach
            else:
                keep &= (self.units[f] >= middle - reach) & (self.units[f] <= middle + reach)
        return np.flatnonzero(keep)


def search(queries: Bucket, floors: np.ndarray, buckets: list[Bucket], k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(scores, ids) of the k best of each query over the buckets; the order of equal scores is by id."""
    best = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in queries.ids]
    floors = floors.astype(np.float64).copy()
    for bucket in sorted(buckets, key=lambda b: -b.longest):
        picks = [bucket.survivors(queries.units[:, i], queries.lengths[i], floors[i]) for i in range(len(queries.ids))]
        wide = [i for i, x in enumerate(picks) if isinstance(x, slice) and x.stop]
        dense = dict(zip(wide, products(queries.rows[wide], bucket.rows[: max(picks[i].stop for i in wide)]), strict=True)) if wide else {}
        for i, pick in enumerate(picks):
            if i in dense:
                scores, ids = dense[i][pick], bucket.ids[pick]
            elif isinstance(pick, slice) or not len(pick):
                continue
            else:
                scores, ids = products(queries.rows[i : i + 1], bucket.rows[pick])[0], bucket.ids[pick]
            good = np.flatnonzero((scores >= floors[i]) & (ids != queries.ids[i]))
            if not len(good):
                continue
            scores, ids = np.concatenate([best[i][0], scores[good]]), np.concatenate([best[i][1], ids[good]])
            order = np.lexsort((ids, -scores))[:k]
            best[i] = scores[order], ids[order]
            if len(order) == k:
                floors[i] = max(floors[i], float(scores[order[-1]]))
    return best


def _pack(part: int, seq: int, kind: int, ids: list, rows: list) -> dict:
    matrix = np.array(rows, np.int64)
    return {"part": part, "seq": seq, "kind": kind, "dim": matrix.shape[1], "n": len(ids), "ids": np.array(ids, np.int64).tobytes(), "data": matrix.tobytes()}


def _unpack(row: dict) -> Bucket:
    return Bucket(np.frombuffer(row["ids"], np.int64), np.frombuffer(row["data"], np.int64).reshape(row["n"], row["dim"]))


def quantised(vector: str, scale: float = 256.0) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long"))


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, id_column: str = "vec_id", vector: str = "embedding", scale: float = 256.0) -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest integer products of each query with all other rows.

    Components become floor(scale * x). Rows whose vector or id is null, or whose vector holds null or
    non-finite components, take no part. Rows with the query's id are its own and not candidates;
    queries that repeat an id and vector count once, repeated candidates once each. Vectors of another
    dimension than the query's are no candidates. Ties go to the smaller id; with fewer than k
    candidates all are returned; no rows or no queries give no rows. Components and scores beyond a
    long saturate.

    The SEEDS longest vectors (a fixed number) give every query a first floor on its k-th product.
    Candidates are dealt by length and id, so equal lengths or equal vectors split, and packed into
    buckets; a task holds PART_BYTES of them at most and reads the queries in blocks.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "topk")
    from graphloom.llm.common import all_finite

    valid = vectors.where(all_finite(vector) & F.col(id_column).isNotNull()).select(F.col(id_column).cast("long").alias("vec_id"), quantised(vector, scale).alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    valid = valid.withColumn("length", F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))))
    with batches(spark, 4096):
        valid = scratch.put(valid, "valid")
        n, cells = valid.agg(F.count("*"), F.sum(F.size("v"))).first()
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")) if n > 20_000 else 2, -(-8 * (cells or 0) // PART_BYTES))
        seeds: dict[int, tuple[list, list]] = {}
        for row in valid.orderBy(F.desc("length"), "vec_id").limit(SEEDS).collect():
            ids, rows = seeds.setdefault(len(row["v"]), ([], []))
            ids.append(row["vec_id"])
            rows.append(row["v"])

        def buckets(stream):
            part, held, seq = TaskContext.get().partitionId(), {}, 0
            for batch in stream:
                for vec_id, v in zip(batch.column("vec_id").to_pylist(), batch.column("v").to_pylist(), strict=True):
                    ids, rows = held.setdefault(len(v), ([], []))
                    ids.append(vec_id)
                    rows.append(v)
                    if len(ids) >= BUCKET:
                        yield pa.RecordBatch.from_pylist([_pack(part, seq, 0, *held.pop(len(v)))], schema=arrow)
                        seq += 1
            for ids, rows in held.values():
                yield pa.RecordBatch.from_pylist([_pack(part, seq, 0, ids, rows)], schema=arrow)
                seq += 1

        def blocks(stream):
            held, start = {}, TaskContext.get().partitionId() << 32
            seq = start
            for batch in stream:
                for vec_id, v in zip(batch.column("vec_id").to_pylist(), batch.column("v").to_pylist(), strict=True):
                    ids, rows = held.setdefault(len(v), ([], []))
                    ids.append(vec_id)
                    rows.append(v)
                    if len(ids) >= BLOCK:
                        yield pa.RecordBatch.from_pylist([_pack(0, seq, 1, *held.pop(len(v)))], schema=arrow)
                        seq += 1
            for ids, rows in held.values():
                yield pa.RecordBatch.from_pylist([_pack(0, seq, 1, ids, rows)], schema=arrow)
                seq += 1

        arrow = pa.schema([("part", pa.int32()), ("seq", pa.int64()), ("kind", pa.int32()), ("dim", pa.int32()), ("n", pa.int32()), ("ids", pa.binary()), ("data", pa.binary())])
        by_length = valid.select("vec_id", "v", "length").repartitionByRange(parts, F.desc("length"), F.col("vec_id")).sortWithinPartitions(F.desc("length"), "vec_id")
        candidates = scratch.put(by_length.select("vec_id", "v").mapInArrow(buckets, PACKED), "buckets")
        queries = scratch.put(valid.where("q").select("vec_id", "v").distinct().mapInArrow(blocks, PACKED), "queries")
    every = queries.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))

    def answer(stream):
        part, buckets, first = None, {}, {d: Bucket(np.array(i, np.int64), np.array(v, np.int64)) for d, (i, v) in seeds.items()}
        for batch in stream:
            for row in batch.to_pylist():
                if row["part"] != part:
                    part, buckets = row["part"], {}
                if row["kind"] == 0:
                    buckets.setdefault(row["dim"], []).append(_unpack(row))
                    continue
                block, found = _unpack(row), []
                if row["dim"] not in buckets:
                    continue
                lowest = np.full(len(block.ids), -np.inf)
                if row["dim"] in first:
                    seeded = search(block, lowest, [first[row["dim"]]], k)
                    lowest = np.array([s[-1] if len(s) == k else -np.inf for s, _ in seeded], np.float64)
                for query, (scores, ids) in zip(block.ids, search(block, lowest, buckets[row["dim"]], k), strict=True):
                    found.append((np.full(len(ids), query), ids, scores))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([x[c] for x in found]).astype(np.int64)) for c in range(3)], names=["query_id", "vec_id", "score"])

    with batches(spark, 8):
        met = candidates.unionByName(every).repartition(parts, "part").sortWithinPartitions("part", "kind", "seq")
        found = scratch.put(met.mapInArrow(answer, FOUND), "found")
    scratch.drop("valid", "buckets", "queries")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")).cast("int"))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
