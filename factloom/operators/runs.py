"""Ordered folds over the rows of each branch, streamed.

Rows are dealt by key, sorted inside their partition and passed through one
fold object per key, so a task holds the fold's state but never a branch.  One
shuffle, which spills; AQE leaves it alone, for the order must hold.

A sieve drops rows that cannot matter to a fold before they are shuffled, as a
combiner does for an aggregate, so that one huge branch is not one task's stream.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType, _parse_datatype_string


def fold(rows: DataFrame, key: str, order: list[Column | str], make: Callable[[object], object], schema: str) -> DataFrame:
    """``make(key)`` gives an object with add(row) -> rows and finish() -> rows; rows are tuples.

    Rows are dealt by a hash of the key: Spark leaves out a shuffle by the key itself where a
    join before has dealt by it, and may then, as the join turns into a broadcast, read that
    join's shuffle where it was written, which splits keys.
    """
    return _streamed(rows.repartition(F.xxhash64(key)).sortWithinPartitions(key, *order), key, make, _parse_datatype_string(schema))


def _streamed(rows: DataFrame, key: str, make: Callable[[object], object], kind: StructType) -> DataFrame:
    """One object per run of rows with the same key, in the partitions as they are."""
    target = to_arrow_schema(kind)
    names = rows.columns

    def run(batches):
        current, state = None, None
        for batch in batches:
            out = []
            columns = [batch.column(n).to_pylist() for n in names]
            at = names.index(key)
            for row in zip(*columns):
                if state is None or row[at] != current:
                    if state is not None:
                        out += state.finish()
                    current, state = row[at], make(row[at])
                out += state.add(dict(zip(names, row)))
            if out:
                yield _batch(out, target)
        if state is not None and (out := state.finish()):
            yield _batch(out, target)

    return rows.mapInArrow(run, kind)


class Sieve:
    """Keeps the first ``lead`` rows of a key, and of each size as many as fit ``budget`` plus ``spare``; counts the others.

    First fit never takes a row of a size after it has passed over one, for room only
    shrinks.  What it takes of a size are therefore that size's first rows, at most
    budget // size of them: so few rows decide, however many the key has.  The others
    become one row whose ``standing`` tells how many they are.  A leading row that
    cannot be taken by a size keeps neither it nor the text that goes with it.
    """

    def __init__(self, key, names: list[str], at: str, budget: int, lead: int, sizes: dict[str, tuple[int, str | None]]):
        self.key, self.names, self.at, self.budget, self.lead, self.sizes = key, names, at, budget, lead, sizes
        self.n = self.passed_over = 0
        self.seen = {name: {} for name in sizes}

    def add(self, row) -> list:
        if not row[self.at]:
            self.passed_over += row["standing"]
            return []
        keep = self.n < self.lead
        self.n += 1
        for name, (spare, text) in self.sizes.items():
            size = row[name]
            if size is not None:
                before = self.seen[name].get(size, 0)
                if before < self.budget // max(size, 1) + spare:
                    self.seen[name][size] = before + 1
                    keep = True
                elif text:
                    row[name] = row[text] = None
        if keep:
            return [tuple(row[n] for n in self.names)]
        self.passed_over += 1
        return []

    def finish(self) -> list:
        rest = {self.key[0]: self.key[1], "standing": self.passed_over}
        return [tuple(rest.get(n) for n in self.names)] if self.passed_over else []


def sieved(rows: DataFrame, key: str, order: list[Column | str], at: str, budget: int, lead: int, sizes: dict[str, tuple[int, str | None]], groups: int = 64) -> DataFrame:
    """``rows`` with ``standing`` (1), those that cannot matter to a first fit in ``order`` as counts: null but for the key and ``standing``.

    ``at`` names a column that is null in no row; ``sizes`` the columns of sizes, null
    where a row cannot be taken at all, each with the rows of a size that may be taken
    otherwise and the column of its text, if that is of no use without the size.  Rows are sieved where they are read, then in ``groups`` parts of each
    key; sieving parts and then their union gives what sieving all at once does.
    """
    rows = rows.withColumns({"standing": F.lit(1).cast("long"), "__part": F.spark_partition_id() % groups})
    kind, names = rows.schema, rows.columns
    kind = StructType([StructField(f.name, f.dataType, True) for f in kind])

    def make(k):
        return Sieve((key, k), names, at, budget, lead, sizes)

    once = _streamed(rows.sortWithinPartitions(key, *order), key, make, kind)
    # counts of rows passed over have no part of their own
    parts = once.withColumn("__part", F.coalesce("__part", F.lit(0)))
    return _streamed(parts.repartition(key, "__part").sortWithinPartitions(key, *order), key, make, kind).drop("__part")


def _batch(rows, target) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), target)], schema=target)
