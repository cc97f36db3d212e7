"""Whitening of vectors by LOBPCG: leading eigenvectors of a covariance that is never formed.

The covariance meets the algorithm only as products with blocks of directions, V B = sum of c (c' B) / n
over centred rows c: each one is a pass over the vectors, summed in tasks and then by Spark. The driver
holds a few blocks of dimension x (3 * block) numbers, whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import all_finite, without
from graphloom.shipping import on_path

#: Directions beside the wanted ones, for faster convergence of the last of these.
GUARD = 8
#: A residual |V u - e u| is certified at this share of the largest eigenvalue.
TOLERANCE = 1e-12
ROUNDS = 400
#: Eigenvalues up to this share of the largest count as no variance: no component is reported for them.
FLAT = 1e-10
#: Fixed point entries beyond +-2^46 saturate there.
WIDEST = float(1 << 46)
LONG = 1 << 63


def fixed_point(column: str, scale: int = 64, offset: int = 1_000_000) -> Column:
    """The vector's entries as longs floor(scale * c) + offset; null for vectors that aren't all finite."""
    whole = F.transform(column, lambda c: F.floor(F.greatest(F.lit(-WIDEST), F.least(F.lit(WIDEST), scale * c.cast("double")))).cast("long") + F.lit(offset).cast("long"))
    return F.when(all_finite(column), whole)


@dataclass
class Whitening:
    """What a fit found: n rows with per-dimension sums, unit eigenvectors (a column each) by falling
    eigenvalue, the covariance's trace, and the number of passes that products took."""

    n: int
    sums: list[int]
    most: int
    vectors: np.ndarray
    values: np.ndarray
    trace: float
    passes: int
    residuals: np.ndarray

    @property
    def projection(self) -> np.ndarray:
        return self.vectors / np.sqrt(self.values)

    @property
    def fits(self) -> bool:
        """Whether n * x - S stays exact in 64 bits for every entry."""
        return 2 * self.n * self.most < LONG >> 1

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exactly."""
        return x * self.n - np.array(self.sums, np.int64) if self.fits else x.astype(object) * self.n - np.array(self.sums, object)

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S / n: the difference is taken in whole numbers, so nothing cancels."""
        return (self.deviations(x).astype(np.float64)) / self.n


def _rows(batch: pa.RecordBatch, column: str, d: int) -> np.ndarray:
    return batch.column(batch.schema.get_field_index(column)).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, d)


def _moments(vectors: DataFrame, column: str, d: int) -> tuple[int, list[int], int]:
    """(rows, sum of each entry, largest absolute entry), exact however large."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, most = 0, [0] * d, [0] * d
        for batch in stream:
            x = _rows(batch, column, d)
            if len(x):
                n += len(x)
                top = np.abs(x).max(0)
                own = x.sum(0).tolist() if int(top.max()) * len(x) < LONG >> 1 else x.astype(object).sum(0).tolist()
                total, most = [a + b for a, b in zip(total, own, strict=True)], [max(a, b) for a, b in zip(most, top.tolist(), strict=True)]
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(d), pa.int32()), pa.array([n] * d, pa.int64()), pa.array(total, pa.decimal128(38)), pa.array(most, pa.int64())], names=["i", "n", "s", "top"])

    found = vectors.select(column).mapInArrow(run, "i int, n long, s decimal(38,0), top long").groupBy("i").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.max("top").alias("top")).orderBy("i").collect()
    return (found[0].n, [int(r.s) for r in found], max(r.top for r in found)) if found else (0, [], 0)


def _summed(vectors: DataFrame, column: str, d: int, of: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum of of(rows) over blocks of rows: a matrix per task, then sums by row and place in Spark."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in stream:
            x = _rows(batch, column, d)
            if len(x):
                total = of(x) if total is None else total + of(x)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(total.tolist(), pa.list_(pa.float64()))], names=["i", "part"])

    cells = vectors.select(column).mapInArrow(run, "i int, part array<double>").select("i", F.posexplode("part").alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v"))
    rows = cells.groupBy("i").agg(F.array_sort(F.collect_list(F.struct("j", "v"))).alias("row")).orderBy("i").select(F.transform("row", lambda c: c["v"]).alias("row")).collect()
    return np.array([r.row for r in rows])


def _basis(*blocks: np.ndarray) -> np.ndarray:
    """Orthonormal columns that span the blocks; directions that earlier ones hold already are left out."""
    held = np.linalg.qr(blocks[0])[0]
    for block in blocks[1:]:
        size = np.linalg.norm(block, axis=0)
        block = block[:, size > 0] / size[size > 0]
        for _ in range(2):
            block = block - held @ (held.T @ block)
        size = np.linalg.norm(block, axis=0)
        block = block[:, size > 1e-8] / size[size > 1e-8]
        if block.shape[1]:
            u, s, _ = np.linalg.svd(block, full_matrices=False)
            u = u[:, s > 1e-8 * s[0]]
            u = np.linalg.qr(u - held @ (held.T @ u))[0]
            held = np.hstack([held, u])[:, : len(held)]
    return held


def lobpcg(product: Callable[[np.ndarray], np.ndarray], d: int, k: int, tolerance: float = TOLERANCE, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(values, unit vectors, residuals, products) of the k largest eigenvalues of a symmetric matrix known by its products.

    Each round takes the Ritz vectors of the space of iterate, residual and previous direction blocks.
    Residuals come from the round's own product, never from a recurrence; the loop ends when those of the k
    wanted vectors are certified, or the space is the whole one, and raises after `rounds` rounds.
    """
    wide = min(d, k + GUARD)
    space, before = _basis(np.random.default_rng(7).standard_normal((d, wide))), 0
    for done in range(1, rounds + 1):
        image = product(space)
        small = space.T @ image
        values, y = np.linalg.eigh((small + small.T) / 2)
        values, y = values[::-1][:wide], y[:, ::-1][:, :wide]
        x = space @ y
        residual = image @ y - x * values
        sizes = np.linalg.norm(residual, axis=0)
        if values[0] <= 0 or (sizes[:k] <= tolerance * values[0]).all() or space.shape[1] == d:
            return values[:k], x[:, :k], sizes[:k], done
        previous = space[:, before:] @ y[before:] if before else residual[:, :0]
        space, before = _basis(x, residual[:, sizes > tolerance * values[0] / 10], previous), wide
    raise RuntimeError(f"residuals are not certified after {rounds} rounds")


def fit(vectors: DataFrame, column: str, k: int = 32) -> Whitening | None:
    """Up to k principal components of a column of long vectors, over all of its rows.

    Null vectors take no part. Where lengths differ, the most frequent length (of ties the smaller) is
    the fit list; others and empty vectors take no part. Returns None for an empty fit list. Components of no variance (fewer rows or ranks than k,
    equal rows) are left out, so there may be none. Repeated rows count as often as they occur.
    """
    on_path(vectors.sparkSession)
    sized = vectors.select(F.col(column).alias("_x"), F.size(column).alias("_d")).where("_x is not null and _d > 0")
    most = sized.groupBy("_d").count().orderBy(F.desc("count"), "_d").first()
    if most is None:
        return None
    d = most["_d"]
    rows = sized.where(F.col("_d") == d)
    n, sums, top = _moments(rows, "_x", d)
    model = Whitening(n, sums, top, np.zeros((d, 0)), np.zeros(0), 0.0, 0, np.zeros(0))

    def product(block: np.ndarray) -> np.ndarray:
        def of(x: np.ndarray) -> np.ndarray:
            c = model.centred(x)
            return c.T @ (c @ block)

        return _summed(rows, "_x", d, of) / n

    model.trace = float(_summed(rows, "_x", d, lambda x: (model.centred(x) ** 2).sum(keepdims=True).reshape(1, 1))[0, 0]) / n
    if model.trace <= 0:
        return model
    values, vectors_, residuals, passes = lobpcg(product, d, min(k, d))
    real = values > FLAT * values[0]
    sign = np.sign(vectors_[np.abs(vectors_).argmax(0), np.arange(len(values))])
    return Whitening(n, sums, top, (vectors_ * sign)[:, real], values[real], model.trace, passes, residuals[real])


def identity_error(vectors: DataFrame, column: str, model: Whitening) -> float:
    """The largest absolute entry of the whitened rows' covariance minus the identity, by one more pass."""
    rows = vectors.where(F.size(column) == len(model.sums))
    found = _summed(rows, column, len(model.sums), lambda x: (lambda w: w.T @ w)(model.centred(x) @ model.projection)) / model.n
    return float(np.abs(found - np.eye(len(model.values))).max())


def transform(vectors: DataFrame, column: str, model: Whitening | None) -> DataFrame:
    """vectors with `whitened` (array<double>: an entry per component) and `deviation` (long: the exact sum of
    (n * x - S)^2; null beyond a long).

    Both are null for null vectors and vectors of another length than the fit's; input columns of these names
    give way. Other columns pass through. The model is a constant of the tasks, so a task that runs again gives the same.
    """
    rest = without(vectors, "whitened", "deviation")
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rest.schema.fields) + "whitened array<double>, deviation long"
    if model is None:
        return rest.withColumns({"whitened": F.lit(None).cast("array<double>"), "deviation": F.lit(None).cast("long")})
    d, into = len(model.sums), model.projection
    small = 4 * d * (model.n * model.most) ** 2 < LONG

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            own = batch.column(batch.schema.get_field_index(column))
            have = np.array([v is not None and len(v) == d for v in own], bool)
            x = own.filter(pa.array(have)).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, d)
            moved = model.deviations(x)
            # squares of differences: bounded by the true ones, which are far under the entries' own size
            far = moved if small or not len(x) or d * float(np.abs(moved).max()) ** 2 < LONG >> 1 else moved.astype(object)
            squares = iter((far * far).sum(1).tolist())
            white = iter((moved.astype(np.float64) / model.n @ into).tolist())
            exact = [next(squares) if h else None for h in have]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([next(white) if h else None for h in have], pa.list_(pa.float64())), pa.array([v if v is not None and v < LONG else None for v in exact], pa.int64())],
                names=[*batch.schema.names, "whitened", "deviation"],
            )

    return rest.mapInArrow(run, schema)
