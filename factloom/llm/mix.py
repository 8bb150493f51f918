"""Mixing sources to target weights by the cube method.

Each source has a target number of words.  A document is taken a whole number
of times: the integer part of its source's rate, and once more with the
fractional part as inclusion probability.  The cube method decides that last
time: a random walk moves the probabilities of a block of documents inside the
null space of two constraints (number of documents, number of words) until all
but two at most are 0 or 1.  Blocks hold a bounded number of documents; what
each leaves undecided meets in the next level's blocks, and the last block of a
source lands its at most two documents on the corner nearest the totals.

Documents are dealt to blocks by a hash of their id and size, and each walk is
seeded by its block, so reruns agree.

Defined cases: a null text has size 0 and is taken 0 words; a null source is a
source of its own, last in order; sources without words have target 0; a table
without words takes nothing; repeated rows are separate units of one block.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

WORD = r"[^\x20\x09-\x0D]+"
#: Weights by rank of the source, repeating.
WEIGHTS = (5, 2, 1)
#: A source gives each document this many times at most.
CAP = 3
#: Documents of a block.
BLOCK = 1024

LEVEL = "doc_id long, source string, size long, source_size long, target double, times long, chance double, blocks long, key long"


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size in words and a key of every row, from id, text and copy.

    Rows equal in all are numbered as copies, so that however many there are of
    one id, or without any, no two share a key and so a block.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.xxhash64("text").alias("text"))
    rows = rows.groupBy("doc_id", "source", "size", "text").agg((F.count("*") - 1).alias("last"))
    rows = rows.withColumn("thousand", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("last") / 1000))))
    rows = rows.withColumn("copy", F.explode(F.sequence(F.col("thousand") * 1000, F.least(F.col("last"), F.col("thousand") * 1000 + 999))))
    return rows.select("doc_id", "source", "size", F.xxhash64("doc_id", "size", "text", "copy").alias("key"))


def targets(sizes: DataFrame, weights=WEIGHTS, cap: int = CAP) -> DataFrame:
    """source, source_size, documents and target of every source.

    Sources in the order of their cap per weight fill up one after the other:
    the first k are at their cap exactly if the k-th cap per weight is not above
    the level that the rest would share.  One pass of sums over the sources.
    """
    rank = Window.orderBy(F.col("source").asc_nulls_last())
    fill = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    by_rank = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights)).cast("int") + 1)
    rest = Window.partitionBy()
    upto = fill.rowsBetween(Window.unboundedPreceding, 0)
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("documents"))
    sources = sources.withColumn("rank", F.row_number().over(rank) - 1).withColumn("weight", by_rank).withColumn("limit", cap * F.col("source_size"))
    sources = sources.withColumns({"total": F.sum("source_size").over(rest), "all_weights": F.sum("weight").over(rest), "before": F.sum("limit").over(upto) - F.col("limit"), "weights_before": F.sum("weight").over(upto) - F.col("weight")})
    # level shared from this source on, if all earlier ones are at their cap
    level = (F.col("total") - F.col("before")) / (F.col("all_weights") - F.col("weights_before"))
    sources = sources.withColumn("full", (F.col("limit") <= level * F.col("weight")))
    # the first level below a cap is the highest: levels fall from there on
    shared = F.max(F.when(~F.col("full"), level)).over(rest)
    target = F.when(F.col("full") | F.col("shared").isNull(), F.col("limit").cast("double")).otherwise(F.col("shared") * F.col("weight"))
    return sources.withColumn("shared", shared).select("source", "source_size", "documents", target.alias("target"))


def flight(chance: np.ndarray, size: np.ndarray, rng) -> np.ndarray:
    """Walk inside the null space of (1, size) until two undecided at most are left."""
    chance = chance.astype(float).tolist()
    size = [float(s) for s in size]
    active: list[int] = []
    waiting = [k for k in range(len(chance)) if 0 < chance[k] < 1]
    waiting.reverse()
    draws = iter(rng.random(3 * len(chance) + 8).tolist())
    while True:
        while len(active) < 3 and waiting:
            active.append(waiting.pop())
        if len(active) < 2:
            break
        if len(active) == 3:
            a, b, c = (size[k] for k in active)
            step = (c - b, a - c, b - a)
            if not any(step):
                step = (1.0, -1.0, 0.0)
        elif size[active[0]] == size[active[1]]:
            step = (1.0, -1.0)
        else:
            break
        up = min(((1 - chance[k]) / s if s > 0 else chance[k] / -s) for k, s in zip(active, step) if s)
        down = min((chance[k] / s if s > 0 else (1 - chance[k]) / -s) for k, s in zip(active, step) if s)
        by = up if next(draws) * (up + down) < down else -down
        for k, s in zip(active, step):
            chance[k] += by * s
            if chance[k] < 1e-9:
                chance[k] = 0.0
            elif chance[k] > 1 - 1e-9:
                chance[k] = 1.0
        active = [k for k in active if 0 < chance[k] < 1]
    return np.array(chance)


def landing(chance: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The corner nearest the word total, then the document total."""
    open_ = np.flatnonzero((chance > 0) & (chance < 1))
    if len(open_):
        corners = [np.array([c >> k & 1 for k in range(len(open_))], dtype=float) for c in range(1 << len(open_))]
        miss = lambda x: (abs(((x - chance[open_]) * size[open_]).sum()), abs((x - chance[open_]).sum()), x.tolist())
        chance = chance.copy()
        chance[open_] = min(corners, key=miss)
    return chance


def _decide(block: pd.DataFrame) -> pd.DataFrame:
    block = block.sort_values(["key", "doc_id", "size"], kind="stable", na_position="last")
    source = block["source"].iloc[0]
    rng = np.random.default_rng([zlib.crc32(repr(source).encode()), int(block["blocks"].iloc[0]), int(block["key"].iloc[0]) & 0xFFFFFFFF])
    size = block["size"].to_numpy(float)
    chance = flight(block["chance"].to_numpy(float), size, rng)
    if block["blocks"].iloc[0] == 1:
        chance = landing(chance, size)
    return block.drop(columns="block").assign(chance=chance)


def mix(docs: DataFrame, weights=WEIGHTS, cap: int = CAP, block: int = BLOCK) -> DataFrame:
    """doc_id, size, source_size, target and the words taken, for every row."""
    sizes = common.materialise(sized(docs), "mix-sizes")
    sources = common.materialise(targets(sizes, weights, cap), "mix-sources")
    largest = sources.agg(F.max("documents")).first()[0] or 0
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(cap)))).otherwise(F.lit(0.0))
    sources = sources.withColumnRenamed("source", "of")
    small = common.is_small(sources, 100_000)
    rows = sizes.join(F.broadcast(sources) if small else sources, F.col("source").eqNullSafe(F.col("of")), "left")
    rows = rows.select("doc_id", "source", "size", "source_size", "target", F.floor(rate).cast("long").alias("times"), (rate - F.floor(rate)).alias("chance"), F.greatest(F.ceil(F.col("documents") / block), F.lit(1)).cast("long").alias("blocks"), "key")
    fixed = (F.col("size") == 0) | (F.col("chance") <= 1e-9) | (F.col("chance") >= 1 - 1e-9)
    decided = rows.where(fixed).withColumn("chance", F.round("chance"))
    rows = rows.where(~fixed)
    done, n = [decided], max(1, math.ceil(largest / block))
    while True:
        rows = rows.withColumn("block", F.pmod(F.xxhash64("key", "blocks"), F.col("blocks")))
        out = common.materialise(rows.groupBy("source", "block").applyInPandas(_decide, LEVEL), "mix-level")
        open_ = (F.col("chance") > 0) & (F.col("chance") < 1)
        done.append(out.where(~open_))
        if n == 1:
            break
        n = math.ceil(2 * n / block)
        rows = out.where(open_).withColumn("blocks", F.ceil(2 * F.col("blocks") / block).cast("long"))
    whole = done[0]
    for part in done[1:]:
        whole = whole.unionByName(part)
    return whole.select("doc_id", "size", "source_size", "target", ((F.col("times") + F.round("chance").cast("long")) * F.col("size")).alias("taken"))
