"""Embedding near-duplicates by collision counting over sorted one-dimensional projections."""

from __future__ import annotations

from math import comb, erf, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import Scratch, all_finite, batches, lists
from graphloom.llm.components import components

PROJECTIONS, WIDTH, RECALL, SEED, BLOCK = 48, 1.5, 0.999, 7, 2048
#: Projections whose ranges decide which blocks meet, in how many deviations of a pair at the threshold; cells
#: to a deviation of all vectors by which rows are put in order before they are packed.
RANGED, DEVIATIONS, CELLS = 3, 3.5, 1.5
#: Rows that are counted at a time, so that their counters stay in a processor's cache, and projections after
#: which rows that no partner can bring to the count any more are dropped.
STRIP, STAGE = 128, 24


def calibrate(threshold: float, projections: int = PROJECTIONS, width: float = WIDTH, recall: float = RECALL) -> tuple[float, int]:
    """(half-width, count): a pair exactly at the cosine threshold collides at least `count` times with
    probability `recall` or more, and a closer one more often.

    On a Gaussian direction, unit vectors at that cosine differ by a normal of deviation
    d = sqrt(2 - 2 cos); the window is width * d to each side, so collisions are binomial.
    """
    d = sqrt(max(2 - 2 * threshold, 1e-12))
    p = erf(width / sqrt(2))
    tail, least = 0.0, projections
    for c in range(projections, -1, -1):
        tail += comb(projections, c) * p**c * (1 - p) ** (projections - c)
        least = c
        if tail >= recall:
            break
    return width * d, least


def directions(dim: int, projections: int = PROJECTIONS, seed: int = SEED) -> np.ndarray:
    return np.random.default_rng((seed, dim)).standard_normal((dim, projections))


def unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(axis=-1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=-1, keepdims=True))


def collisions(ha: np.ndarray, hb: np.ndarray, half: float, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the pairs of which at least `least` query-centred windows collide.

    Each projection of the other block is sorted; a window is then a run of ranks, which are kept in steps
    of a 255th of the block and widened to whole steps, so no collision is missed. Counts are made strip
    by strip of the rows. Halfway, a strip's columns that no row can still link with are dropped.
    """
    n, m = len(ha), len(hb)
    step = -(-m // 255)
    ranks, lows, runs = np.empty((ha.shape[1], m), np.uint8), np.empty((ha.shape[1], n), np.uint8), np.empty((ha.shape[1], n), np.uint8)
    for i in range(ha.shape[1]):
        order = np.argsort(hb[:, i], kind="stable")
        ordered = hb[order, i]
        ranks[i, order] = np.arange(m) // step
        low, high = np.searchsorted(ordered, ha[:, i] - half, side="left"), np.searchsorted(ordered, ha[:, i] + half, side="right") - 1
        lows[i], runs[i] = np.minimum(low // step, 255), np.where(high >= low, high // step - low // step + 1, 0)
    rows, columns = [], []
    for a in range(0, n, STRIP):
        z = min(a + STRIP, n)
        on = np.arange(m)
        counts = np.zeros((z - a, m), np.uint8)
        offset, hit = np.empty((z - a, m), np.uint8), np.empty((z - a, m), bool)
        for first, last in ((0, STAGE), (STAGE, ha.shape[1])):
            for i in range(first, min(last, ha.shape[1])):
                np.subtract(ranks[i][None, on], lows[i, a:z, None], out=offset)
                np.less(offset, runs[i, a:z, None], out=hit)
                np.add(counts, hit, out=counts, casting="unsafe")
            rest = max(0, ha.shape[1] - last)
            alive = (counts >= max(0, least - rest)).any(0)
            if rest and not alive.all():
                on, counts = on[alive], counts[:, alive]
                offset, hit = np.empty(counts.shape, np.uint8), np.empty(counts.shape, bool)
        i, j = np.nonzero(counts >= least)
        rows.append(i + a)
        columns.append(on[j])
    return np.concatenate(rows) if rows else np.zeros(0, np.int64), np.concatenate(columns) if columns else np.zeros(0, np.int64)


def local_roots(links: np.ndarray) -> np.ndarray:
    """Smallest index that each node of a boolean adjacency matrix (rows, then columns) reaches."""
    n, m = links.shape
    rows, cols = np.arange(n), np.arange(n, n + m)
    while True:
        low = np.where(links.any(1), np.where(links, cols[None, :], n + m).min(1), rows)
        new_rows = np.minimum(rows, low)
        low = np.where(links.any(0), np.where(links, new_rows[:, None], n + m).min(0), cols)
        new_cols = np.minimum(cols, low)
        if (new_rows == rows).all() and (new_cols == cols).all():
            return np.concatenate([rows, cols])
        rows, cols = new_rows, new_cols


def linked_roots(links: np.ndarray) -> np.ndarray:
    """local_roots, computed over the rows and columns that have a link at all."""
    rows, cols = np.flatnonzero(links.any(1)), np.flatnonzero(links.any(0))
    at = np.concatenate([rows, cols + len(links)])
    root = np.arange(sum(links.shape))
    if len(at):
        root[at] = at[local_roots(links[np.ix_(rows, cols)])]
    return root


def near_vectors(vectors: DataFrame, threshold: float = 0.93, id_column: str = "vec_id", label: str = "label", vector: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept), a row for every input row.

    Rows link if their labels are equal and not null and the cosine in double precision is at least
    `threshold`. Rows whose label or vector is null, or whose vector is empty, zero or holds null or
    non-finite components, and vectors of another dimension, link with nothing: n_links 0, their own
    component. Equal vectors of a label form a class that is compared once and counted in full, so a
    hot vector never meets itself. A component bears its smallest id; rows with a null id link but
    lend no id (null if all are null). Rows that repeat an id count one by one. An empty table gives
    no rows.

    Classes of a label are put in order by cells of their first RANGED projections and packed into blocks of
    at most BLOCK vectors, so a hot label splits. Blocks whose ranges lie further apart in one of these
    projections than a linked pair can (but for one in two thousand, at the threshold) never meet; a pair of
    blocks is one row, whose answer holds a row per vector, not per pair. Vectors are known by two
    64-bit hashes.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "near-vectors")
    half, least = calibrate(threshold)
    far = half / WIDTH * DEVIATIONS
    base = vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("v"))
    good = all_finite("v") & F.col("label").isNotNull() & F.coalesce(F.exists("v", lambda x: x != 0), F.lit(False))
    plain = F.transform("v", lambda x: x + F.lit(0.0))
    base = base.withColumn("c1", F.when(good, F.xxhash64("label", plain))).withColumn("c2", F.when(good, F.xxhash64(F.lit("c2"), "label", plain)))
    classes = base.where("c1 is not null").groupBy("c1", "c2").agg(F.count("*").alias("n"), F.min("vec_id").alias("first"), F.first("label").alias("label"), F.first("v").alias("v"))
    classes = classes.withColumn("c", F.monotonically_increasing_id())
    arrow = pa.schema([("c", pa.int64()), ("c1", pa.int64()), ("c2", pa.int64()), ("n", pa.int64()), ("first", pa.int64()), ("label", pa.string()), ("dim", pa.int32()), ("cells", pa.list_(pa.int32())), ("h", pa.list_(pa.float64())), ("v", pa.binary())])

    def project(stream):
        for batch in stream:
            dims, cells, ranged, units = [], [], [], []
            for v in lists(batch.column("v")):
                if len(v) != known[0]:
                    known[:] = [len(v), directions(len(v))[:, :RANGED]]
                u = unit(v)
                h = u @ known[1]
                dims.append(len(v))
                cells.append(np.floor(h * CELLS).astype(np.int32))
                ranged.append(h)
                units.append(u.tobytes())
            yield pa.RecordBatch.from_arrays([*[batch.column(c).cast(pa.int64()) for c in ("c", "c1", "c2", "n", "first")], batch.column("label").cast(pa.string()), pa.array(dims, pa.int32()), pa.array(cells, pa.list_(pa.int32())), pa.array(ranged, pa.list_(pa.float64())), pa.array(units, pa.binary())], schema=arrow)

    known: list = [0, None]
    kinds = "c long, c1 long, c2 long, n long, first long, label string, dim int, cells array<int>, h array<double>, v binary"
    packed_kinds = "label string, dim int, low array<double>, high array<double>, b long, c binary, n binary, v binary"
    packed = pa.schema([("label", pa.string()), ("dim", pa.int32()), ("low", pa.list_(pa.float64())), ("high", pa.list_(pa.float64())), ("b", pa.int64()), ("c", pa.binary()), ("n", pa.binary()), ("v", pa.binary())])

    def pack(stream):
        from pyspark import TaskContext

        held, seq = [], TaskContext.get().partitionId() << 32

        def out():
            h = np.array([x["h"] for x in held])
            return pa.RecordBatch.from_pylist([{"label": held[0]["label"], "dim": held[0]["dim"], "low": h.min(0).tolist(), "high": h.max(0).tolist(), "b": seq, "c": np.array([x["c"] for x in held], np.int64).tobytes(), "n": np.array([x["n"] for x in held], np.int64).tobytes(), "v": b"".join(x["v"] for x in held)}], schema=packed)

        for batch in stream:
            for row in batch.select(["label", "dim", "h", "c", "n", "v"]).to_pylist():
                if held and (len(held) >= BLOCK or (row["label"], row["dim"]) != (held[0]["label"], held[0]["dim"])):
                    yield out()
                    held, seq = [], seq + 1
                held.append(row)
        if held:
            yield out()

    order = ["label", "dim", *[F.element_at("cells", i + 1) for i in range(RANGED)], F.element_at("h", RANGED), "c"]
    with batches(spark, 2000):
        classes = scratch.put(classes.mapInArrow(project, kinds), "classes")
        dealt = classes.repartitionByRange(*order).sortWithinPartitions(*order)
        blocks = scratch.put(dealt.mapInArrow(pack, packed_kinds), "blocks")
    ends = blocks.select("label", "dim", "low", "high", "b")
    other = ends.toDF("label2", "dim2", "low2", "high2", "b2")
    meet = (F.col("label") == F.col("label2")) & (F.col("dim") == F.col("dim2")) & (F.col("b") <= F.col("b2"))
    for i in range(RANGED):
        meet &= (F.col("low2")[i] - F.col("high")[i] <= far) & (F.col("low")[i] - F.col("high2")[i] <= far)
    pairs = ends.join(other, meet).select(F.col("b").alias("a"), F.col("b2").alias("z"), "dim")
    left = blocks.select(F.col("b").alias("a"), F.col("c").alias("ca"), F.col("n").alias("na"), F.col("v").alias("va"))
    right = blocks.select(F.col("b").alias("z"), F.col("c").alias("cz"), F.col("n").alias("nz"), F.col("v").alias("vz"))

    def compare(stream):
        for batch in stream:
            for row in batch.to_pylist():
                same, dim = row["a"] == row["z"], row["dim"]
                ca, na, va = np.frombuffer(row["ca"], np.int64), np.frombuffer(row["na"], np.int64), np.frombuffer(row["va"]).reshape(-1, dim)
                cz, nz, vz = np.frombuffer(row["cz"], np.int64), np.frombuffer(row["nz"], np.int64), np.frombuffer(row["vz"]).reshape(-1, dim)
                d = directions(dim)
                i, j = collisions(va @ d, vz @ d, half, least)
                links = np.zeros((len(ca), len(cz)), bool)
                for at in range(0, len(i), 1 << 16):
                    x, y = i[at : at + (1 << 16)], j[at : at + (1 << 16)]
                    links[x, y] = np.einsum("ij,ij->i", va[x], vz[y]) >= threshold
                if same:
                    links |= links.T
                    np.fill_diagonal(links, False)
                both, sums, joined = (ca, [links @ nz], links | np.eye(len(ca), dtype=bool)) if same else (np.concatenate([ca, cz]), [links @ nz, na @ links], links)
                root = linked_roots(joined)[: len(both)]
                total = np.concatenate(sums)
                on = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array(both[on]), pa.array(total[on]), pa.array(np.concatenate([ca, cz])[root[on]])], names=["c", "links", "root"])

    met = pairs.join(left, "a").join(right, "z")
    with batches(spark, 2):
        links = scratch.put(met.repartition("a", "z").mapInArrow(compare, "c long, links long, root long"), "links")
    scratch.drop("blocks")
    roots = components(links.select(F.col("c").alias("u"), F.col("root").alias("v")), "vector-components")
    linked = links.groupBy("c").agg(F.sum("links").alias("links"))
    sized = classes.select("c", "c1", "c2", "n", "first").join(linked, "c", "left").join(roots.withColumnRenamed("node", "c"), "c", "left").withColumn("root", F.coalesce("root", "c"))
    named = sized.groupBy("root").agg(F.min("first").alias("component"))
    sized = sized.join(named, "root").select("c1", "c2", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component")
    out = base.select("vec_id", "c1", "c2").join(sized, ["c1", "c2"], "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
