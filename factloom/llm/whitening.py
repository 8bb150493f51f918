"""Whitening of embeddings over their distinct vectors.

Entries become whole numbers, floor(64 c), so that sums are exact; vectors that
are equal then count once.  Each partition reduces its vectors to a count, exact
sums and a scatter matrix about its own mean, and Chan's formula merges two of
these; a tree of merges ends on the driver, which holds a matrix of d x d and
finds its eigenvectors.  A second pass over the same vectors forms the covariance
of the whitened values in the same way and tells how far it is from the identity.

Defined cases: vectors that are null or hold entries that are null, not finite,
or of 2**34 or more take no part and have no rows; of vectors of several lengths
the commonest length counts, of two as common the longer; components without
variance (beside the largest, within rounding) have no rows, so a fit list of one
vector, and an empty table, give none; a null ``vec_id`` is kept, repeated rows
each have rows of their own, and other columns are not read; a deviation too
large for a long is null.
"""

from __future__ import annotations

import math
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 16
#: Size of an entry's whole number from which it counts as not finite: sums of a batch stay exact.
LARGEST = 1 << 40
#: Entries handled at once.
ENTRIES = 1 << 20
#: Most partial results that one merge of the tree takes.
FAN_IN = 8

Moments = tuple[int, np.ndarray, np.ndarray]


def usable(vector: Column) -> Column:
    return F.coalesce(vector.isNotNull() & F.forall(vector, lambda c: c.isNotNull() & (F.abs(c.cast("double")) < LARGEST // SCALE)), F.lit(False))


def quantised(embeddings: DataFrame) -> DataFrame:
    """vec_id and z, the whole numbers floor(64 c), of usable vectors of the commonest length."""
    vector = F.col("embedding")
    rows = embeddings.select("vec_id", F.when(usable(vector), F.transform(vector, lambda c: F.floor(c.cast("double") * SCALE))).alias("z")).where("z is not null")
    sizes = rows.groupBy(F.size("z").alias("d")).count().orderBy(F.col("count").desc(), F.col("d").desc()).first()
    return rows.where(F.size("z") == (sizes["d"] if sizes else 0))


def merged(a: Moments, b: Moments) -> Moments:
    """Chan's formula for count, sums and scatter about the mean."""
    apart = (a[1] / a[0] - b[1] / b[0]).astype(np.float64)
    n = a[0] + b[0]
    return n, a[1] + b[1], a[2] + b[2] + np.outer(apart, apart) * (a[0] / n * b[0])


def matrices(batch: pa.RecordBatch, d: int):
    """The vectors of a batch, some at a time."""
    flat = batch.column("z").flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
    step = max(1, ENTRIES // d)
    for at in range(0, len(flat), step):
        yield flat[at : at + step]


def moments(vectors: DataFrame, d: int, values) -> Moments:
    """Count, sums and scatter of ``values(matrix)`` over all vectors; whole numbers are summed exactly."""

    def run(batches):
        mine = None
        for batch in batches:
            for z in matrices(batch, d):
                x = values(z)
                sums = x.sum(axis=0)
                centred = x - sums / len(x)
                exact = np.array([int(s) for s in sums], dtype=object) if x.dtype == np.int64 else sums
                own = len(x), exact, centred.T @ centred
                mine = merged(mine, own) if mine else own
        if mine:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(mine)], pa.binary())], names=["moments"])

    partial = vectors.select("z").mapInArrow(run, "moments binary").rdd.map(lambda row: pickle.loads(row["moments"]))
    depth = max(2, math.ceil(math.log(max(2, partial.getNumPartitions()), FAN_IN)))
    return partial.treeReduce(merged, depth)


class Whitening:
    """Counts, sums and components of a fit list, as arrays of the driver."""

    def __init__(self, n: int, sums: np.ndarray, scatter: np.ndarray, components: int):
        covariance = scatter / n
        values, vectors = np.linalg.eigh(covariance)
        values, vectors = values[::-1], vectors[:, ::-1]
        keep = min(components, int(np.sum(values > max(values[0], 0) * len(values) * 1e-14)))
        self.n, self.sums = n, sums
        self.projection = vectors[:, :keep] / np.sqrt(values[:keep])
        self.explained = values[:keep] / np.trace(covariance)

    def deviations(self, z: np.ndarray) -> np.ndarray:
        """n z - S, exactly: as longs where they fit, else as Python's numbers."""
        most = max(int(np.abs(z).max(initial=0)) * self.n, max(abs(int(s)) for s in self.sums))
        return z * self.n - self.sums.astype(np.int64) if most < 1 << 62 else z.astype(object) * self.n - self.sums

    def whitened(self, z: np.ndarray) -> np.ndarray:
        return (self.deviations(z) / self.n).astype(np.float64) @ self.projection


def squares(deviations: np.ndarray) -> pa.Array:
    """Exact sums of squares of each row; null where no long holds them."""
    if deviations.dtype == np.int64 and int(np.abs(deviations).max(initial=0)) ** 2 * deviations.shape[1] < 1 << 63:
        return pa.array((deviations * deviations).sum(axis=1))
    sums = [sum(int(x) ** 2 for x in row) for row in deviations]
    return pa.array([s if s < 1 << 63 else None for s in sums], pa.int64())


RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whitened(embeddings: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """A row for each usable vector and component: deviation, whitened value, and the fit's figures."""
    rows = quantised(embeddings)
    fit = common.materialise(rows.select("z").distinct(), "fit-list")
    first = fit.select(F.size("z")).first()
    if not first or not first[0]:
        return embeddings.sparkSession.createDataFrame([], RESULT)
    d = first[0]
    model = Whitening(*moments(fit, d, lambda z: z), components)
    k = len(model.explained)
    if not k:
        return embeddings.sparkSession.createDataFrame([], RESULT)
    count, sums, scatter = moments(fit, d, model.whitened)
    error = float(np.abs(scatter / count - np.eye(k)).max())

    def run(batches):
        for batch in batches:
            at = 0
            for z in matrices(batch, d):
                n = len(z)
                apart = model.deviations(z)
                values = (apart / model.n).astype(np.float64) @ model.projection
                each = pa.array(np.repeat(np.arange(n), k))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("vec_id").slice(at, n).cast(pa.int64()).take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), n)), pa.array(np.full(n * k, model.n)),
                        squares(apart).take(each), pa.array(values.ravel()), pa.array(np.tile(model.explained, n)), pa.array(np.full(n * k, error)),
                    ],
                    names=[c.split()[0] for c in RESULT.split(", ")],
                )
                at += n

    return rows.mapInArrow(run, RESULT)
