"""Positions inside documents, packed as runs and joined back to them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import KEY, release

#: Column of packed runs; a name that tables do not have.
RUNS = "__factloom_runs"


def runs(positions: np.ndarray) -> np.ndarray:
    """Sorted positions as [begin, end) pairs."""
    if not len(positions):
        return np.zeros((0, 2), dtype=np.int32)
    cut = np.flatnonzero(np.diff(positions) > 1)
    return np.stack([positions[np.concatenate([[0], cut + 1])], positions[np.concatenate([cut, [len(positions) - 1]])] + 1], axis=1).astype(np.int32)


def by_document(rows: DataFrame) -> DataFrame:
    """doc_id, text key and the row's positions, packed as sorted runs."""
    packed = rows.groupBy("doc_id", KEY).agg(F.array_sort(F.collect_set("pos")).alias("at"))

    def run(batches):
        for batch in batches:
            at = batch.column("at")
            flat, offsets = at.values.to_numpy(), at.offsets.to_numpy()
            packed = pa.array([runs(flat[a:b]).tobytes() for a, b in zip(offsets, offsets[1:])], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column(KEY), packed], names=["doc_id", KEY, RUNS])
        release()

    return packed.mapInArrow(run, f"doc_id long, {KEY} long, {RUNS} binary")


def with_runs(docs: DataFrame, packed: DataFrame, how: str) -> DataFrame:
    """Documents, which have their text key, joined with their runs.

    A sort-merge join at every size, for runs grow with the input.
    """
    return docs.join(packed.hint("merge"), ["doc_id", KEY], how)
