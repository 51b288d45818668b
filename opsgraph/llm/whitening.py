"""Whitening of embeddings by the leading eigenvectors of their covariance, found with LOBPCG.

Entries become integers, so counts, sums and deviations are exact. The covariance is never formed: each
round multiplies it with a block of directions in one pass over the centred rows, a partial product a
task, summed as a tree. The block is the orthonormal basis of the iterate, its residuals and the
previous directions; Rayleigh-Ritz on it gives the next iterate. As the basis is orthonormal anew each
round and its products are computed rather than carried on, residuals are true ones; rounds end when
those of all wanted eigenpairs are certified. GUARD more directions than wanted are carried along, so
that close eigenvalues at the end of those wanted don't slow them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsgraph.llm.common import saved, ship

SCALE, SHIFT = 1024, 100_000
COMPONENTS, GUARD, SEED = 8, 8, 13
#: Residuals as a share of the largest eigenvalue: what ends the rounds, and what they must come to where rounding allows no more.
TOLERANCE, WORST, ROUNDS = 2e-14, 1e-11, 500
#: Eigenvalues under this share of the largest are rounding errors of zero.
RANK = 1e-10
#: Entries (of the vectors) in a partition of the table that is read each round; larger entries than LARGEST have no exact integer.
ENTRIES, LARGEST = 1 << 21, 2.0**42


def vectors(rows: DataFrame, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """key and x, floor(SCALE * entry) + SHIFT of each entry as double; written.

    Left out: null and empty vectors, those with a null, non-finite or over LARGEST entry, and those of
    another length than most have (of lengths as frequent, the longest stays).
    """
    v = F.col(f"`{vector}`").cast("array<double>")
    whole = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda c: F.coalesce((c >= -LARGEST) & (c <= LARGEST), F.lit(False)))
    x = F.transform(v, lambda c: F.floor(c * float(SCALE)) + F.lit(SHIFT).cast("long"))
    own = rows.where(whole).select(F.col(f"`{key}`").alias("key"), x.alias("x"))
    sizes = own.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).limit(2).collect()
    if not sizes:
        return saved(own, "vectors")
    of_size = own if len(sizes) == 1 else own.where(F.size("x") == sizes[0].d)
    return saved(of_size.coalesce(max(1, -(-sizes[0].n * sizes[0].d // ENTRIES))), "vectors")


def _matrix(column: pa.ListArray) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


@dataclass(frozen=True)
class Centre:
    """n vectors whose entries sum to `sums`, exact integers, by dimension."""

    n: int
    sums: tuple[int, ...]

    def rows(self, x: np.ndarray) -> np.ndarray:
        """x - sums / n: the whole part is subtracted exactly."""
        parts = [divmod(s, self.n) for s in self.sums]
        return (x - np.array([q for q, _ in parts])).astype(float) - np.array([r / self.n for _, r in parts])

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Of each row the sum of (n * x - sums) ** 2, exact; None where a long can't hold it."""
        ends = [int(x.min()) * self.n, int(x.max()) * self.n]
        most = max(abs(b - s) for b in ends for s in (min(self.sums), max(self.sums)))
        if most * most * len(self.sums) < 2**63 and max(map(abs, ends)) < 2**63:
            return ((self.n * x - np.array(self.sums)) ** 2).sum(1).tolist()
        wide = [int(d) for d in ((self.n * x.astype(object) - np.array(self.sums, object)) ** 2).sum(1)]
        return [d if d < 2**63 else None for d in wide]


def _sum(rows: DataFrame, task: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """task(matrix) -> array, over the Arrow batches of rows, of which there are some; summed within tasks, then as a tree of tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, shape = None, None
        for batch in batches:
            if batch.num_rows:
                got = task(_matrix(batch.column(0)))
                total = got if total is None else total + got
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary()), pa.array([list(total.shape)], pa.list_(pa.int32()))], names=["b", "shape"])

    parts = rows.select("x").mapInArrow(run, "b binary, shape array<int>").rdd.map(lambda r: np.frombuffer(bytes(r.b)).reshape(list(r.shape)))
    return parts.treeReduce(lambda a, b: a + b)


def centre(rows: DataFrame) -> Centre:
    """Count and exact sums: partial sums of each batch as decimals, summed by dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(0))
                # Halves of 32 bits, so that no sum of a batch overflows.
                s = [(int(h) << 32) + int(l) for h, l in zip((x >> 32).sum(0), (x & 0xFFFFFFFF).sum(0))]
                yield pa.RecordBatch.from_arrays([pa.array(range(len(s)), pa.int32()), pa.array(s, pa.decimal128(38, 0)), pa.array([len(x)] * len(s), pa.int64())], names=["at", "s", "n"])

    summed = rows.select("x").mapInArrow(run, "at int, s decimal(38,0), n long").groupBy("at").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    found = sorted(summed.collect(), key=lambda r: r["at"])
    return Centre(found[0].n if found else 0, tuple(int(r.s) for r in found))


def _orthonormal(within: np.ndarray, more: list[np.ndarray]) -> np.ndarray:
    """Columns of `within` (orthonormal), and an orthonormal basis of what `more` adds."""
    for block in more:
        scale = np.linalg.norm(block, axis=0)
        block = block[:, scale > 0] / scale[scale > 0]
        for _ in range(2):
            block = block - within @ (within.T @ block)
        u, s, _ = np.linalg.svd(block, full_matrices=False) if block.size else (block, np.zeros(0), None)
        u = u[:, s > 1e-10]
        u = u - within @ (within.T @ u)
        within = np.linalg.qr(np.hstack([within, u]))[0][:, : min(within.shape[0], within.shape[1] + u.shape[1])] * 1.0
    return within


@dataclass(frozen=True)
class Fit:
    centre: Centre
    values: np.ndarray  # eigenvalues, falling
    directions: np.ndarray  # unit eigenvectors, as columns
    trace: float
    residual: float  # the largest of the eigenpairs, as a share of the largest eigenvalue
    rounds: int


def lobpcg(rows: DataFrame, middle: Centre, components: int = COMPONENTS) -> Fit:
    """The leading eigenpairs of the covariance (divisor n) of rows (x), with certified residuals; fewer where the rank is less."""
    d, n = len(middle.sums), middle.n
    wanted = min(components, d)
    none = Fit(middle, np.zeros(0), np.zeros((d, 0)), 0.0, 0.0, 0)
    if n < 2:
        return none
    block = min(d, components + GUARD)
    basis = np.linalg.qr(np.random.default_rng(SEED).standard_normal((d, block)))[0]
    best, stuck, trace = np.inf, 0, None
    for rounds in range(1, ROUNDS + 1):

        def product(x: np.ndarray, basis=basis) -> np.ndarray:
            rows = middle.rows(x)
            return np.hstack([rows.T @ (rows @ basis), (rows * rows).sum(0)[:, None]])

        got = _sum(rows, product) / n
        applied, trace = got[:, :-1], float(got[:, -1].sum())
        if trace <= 0:
            return none
        small = basis.T @ applied
        theta, turn = np.linalg.eigh((small + small.T) / 2)
        theta, turn = theta[::-1][:block], turn[:, ::-1][:, :block]
        iterate, image = basis @ turn, applied @ turn
        residuals = image - iterate * theta
        worst = np.linalg.norm(residuals[:, :wanted], axis=0).max() / theta[0]
        stuck = 0 if worst < best / 2 else stuck + 1
        best = min(best, worst)
        if worst <= TOLERANCE or (stuck >= 5 and worst <= WORST):
            real = theta[:wanted] > RANK * theta[0]
            return Fit(middle, theta[:wanted][real], iterate[:, :wanted][:, real], trace, float(worst), rounds)
        previous = [] if rounds == 1 else [iterate - last @ (last.T @ iterate)]
        last = iterate
        basis = _orthonormal(np.linalg.qr(iterate)[0], [residuals, *previous])
    raise ArithmeticError(f"residuals of {worst:g} after {ROUNDS} rounds")


def whiten(rows: DataFrame, fit: Fit) -> DataFrame:
    """rows (key, x) with deviation and whitened, the centred x on each component over the root of its eigenvalue."""
    ship(rows.sparkSession)
    middle, turn = fit.centre, fit.directions / np.sqrt(fit.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(1))
                found = middle.rows(x) @ turn
                white = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * found.shape[1], pa.int32()), pa.array(found.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(middle.deviations(x), pa.int64()), white], names=["key", "deviation", "whitened"])

    key = rows.schema["key"].dataType.simpleString()
    return rows.select("key", "x").mapInArrow(run, f"key {key}, deviation long, whitened array<double>")


def identity_error(rows: DataFrame, fit: Fit) -> float:
    """The largest absolute entry of the whitened vectors' covariance less the identity, from the whitened vectors."""
    middle, turn = fit.centre, fit.directions / np.sqrt(fit.values)

    def moments(x: np.ndarray) -> np.ndarray:
        white = middle.rows(x) @ turn
        return np.vstack([white.T @ white, white.sum(0)])

    got = _sum(rows, moments) / middle.n
    mean = got[-1]
    return float(np.abs(got[:-1] - np.outer(mean, mean) - np.eye(len(mean))).max())


def components(embeddings: DataFrame, vector: str = "embedding", key: str = "vec_id", count: int = COMPONENTS) -> DataFrame:
    """A row for each kept vector (see `vectors`) and component: key, component, n, deviation, whitened, explained, identity_error.

    Repeated rows are vectors of their own, in the fit and in the result; null keys stay. Components are
    numbered from 1 by falling eigenvalue, as many as asked for or as the vectors have dimensions with
    variance; equal vectors only, a lone one or none have no rows. Of equal eigenvalues any basis of
    their space may come. deviation is null where a long can't hold it. Other columns aren't read.
    """
    ship(embeddings.sparkSession)
    rows = vectors(embeddings, vector, key)
    middle = centre(rows)
    fit = lobpcg(rows, middle, count)
    if not len(fit.values):
        kind = rows.schema["key"].dataType.simpleString()
        return embeddings.sparkSession.createDataFrame([], f"{key} {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    told = F.posexplode("whitened").alias("place", "white")
    explained = F.element_at(F.array(*(F.lit(float(e / fit.trace)) for e in fit.values)), F.col("component"))
    each = whiten(rows, fit).select("key", "deviation", told).withColumn("component", (F.col("place") + 1).cast("int"))
    return each.select(F.col("key").alias(key), "component", F.lit(middle.n).cast("long").alias("n"), "deviation", F.col("white").alias("whitened"), explained.alias("explained"), F.lit(identity_error(rows, fit)).alias("identity_error"))
