"""Quality classifier on supervised subword embeddings.

A document is the average of the learned vectors of its hashed words, character
n-grams and a bigram mark for a word said twice in a row; a softmax layer over that average gives the class.  Vectors
and layer are trained together by stochastic gradient descent in numpy, on a
bounded sample of labelled rows (``ROWS_PER_CLASS`` rows of a class,
``SAMPLE_BYTES`` of features in all, documented parameters) with both classes weighing alike.

Scoring needs no vectors: softmax of a linear layer over an average depends on
one number per bucket, the difference of the two logits, so that every whole
text is scored by one gather and one sum over its n-grams.

Defined cases: a null or empty text has no features and gets the score of the
bias alone; without labels of both classes every score is 0.5; null labels are
ignored, as are those that are neither 0 nor 1; repeated rows are scored one by
one and learnt from once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .common import KEY, release, with_key
from .textkernel import U64, SLICE_BYTES, buffer_of, mix, slices

BUCKETS = 1 << 17
DIMENSIONS = 8
NGRAMS = (3, 4)
ROWS_PER_CLASS = 1000
#: Bytes of features that the driver takes at most; a text has up to 1 MB.
SAMPLE_BYTES = 256_000_000
EPOCHS = 10
RATE = 1.0
_CODE_BASE = U64(0x9E3779B97F4A7C15)
#: Stands for the word bigram (w, w), whatever w is.
REPEAT = mix(np.array([1], dtype=U64))[0]
SPACES = np.array([32, *range(9, 14)], dtype=np.uint32)


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every word and n-gram of a slice, and the text it belongs to.

    N-grams take one neighbouring white space as the mark of a word's edge but
    never span two words.
    """
    data, offsets = buffer_of(texts)
    codes = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), dtype=np.uint32)
    starts = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
    # one space around every text
    lengths = np.diff(starts) + 2
    begin = np.concatenate([[0], np.cumsum(lengths)])
    row = np.repeat(np.arange(len(lengths)), lengths)
    padded = np.full(begin[-1], 32, dtype=np.uint32)
    inner = np.ones(len(padded), dtype=bool)
    inner[begin[:-1]] = inner[begin[1:] - 1] = False
    padded[inner] = codes
    space = np.isin(padded, SPACES)
    padded[space] = 32
    value = mix(padded.astype(U64) + U64(1))
    n = len(padded)

    # words
    edge = np.flatnonzero(space)
    first, last = edge[:-1] + 1, edge[1:]
    some = last > first
    first, last = first[some], last[some]
    powers = np.full(n + 1, _CODE_BASE, dtype=U64)
    powers[0] = 1
    powers = np.multiply.accumulate(powers)
    inverse = np.full(n + 1, pow(int(_CODE_BASE), -1, 1 << 64), dtype=U64)
    inverse[0] = 1
    inverse = np.multiply.accumulate(inverse)
    total = np.concatenate([np.zeros(1, U64), np.cumsum(value * powers[:n])])
    word = mix((total[last] - total[first]) * inverse[first])
    same = np.zeros(len(word), dtype=bool)
    same[1:] = (word[1:] == word[:-1]) & (row[first][1:] == row[first][:-1])
    found = [word, np.full(int(same.sum()), REPEAT, dtype=U64)]
    rows = [row[first], row[first][same]]

    spaces = np.concatenate([[0], np.cumsum(space)])
    for k in NGRAMS:
        at = np.arange(max(0, n - k + 1))
        at = at[spaces[at + k - 1] == spaces[at + 1]]  # no space but at the ends
        found.append(mix((total[at + k] - total[at]) * inverse[at] + U64(k)))
        rows.append(row[at])
    return (np.concatenate(found) & U64(BUCKETS - 1)).astype(np.int64), np.concatenate(rows)


def counted(texts: pa.Array):
    """Distinct buckets and their counts, text by text."""
    bucket, row = features(texts)
    keys, counts = np.unique(row * BUCKETS + bucket, return_counts=True)
    bounds = np.searchsorted(keys, np.arange(len(texts) + 1) * BUCKETS)
    for k in range(len(texts)):
        own = slice(bounds[k], bounds[k + 1])
        yield (keys[own] % BUCKETS).astype(np.int32), counts[own].astype(np.int32)


def train(rows: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = EPOCHS, rate: float = RATE) -> tuple[np.ndarray, float]:
    """SGD over (buckets, counts, label); returns the logit difference by bucket, and its bias."""
    rng = np.random.default_rng(7)
    vectors = rng.uniform(-1 / DIMENSIONS, 1 / DIMENSIONS, (BUCKETS, DIMENSIONS))
    layer, bias = np.zeros((DIMENSIONS, 2)), np.zeros(2)
    labels = np.array([label for _, _, label in rows])
    weight = len(labels) / (2 * np.maximum(1, np.bincount(labels, minlength=2)))
    steps, step = epochs * len(rows), 0
    for _ in range(epochs):
        for k in rng.permutation(len(rows)):
            bucket, count, label = rows[k]
            now = rate * (1 - step / steps)
            step += 1
            share = count / max(1, count.sum())
            hidden = share @ vectors[bucket] if len(bucket) else np.zeros(DIMENSIONS)
            logits = hidden @ layer + bias
            grad = np.exp(logits - logits.max())
            grad /= grad.sum()
            grad[label] -= 1
            grad *= weight[label] * now
            back = layer @ grad
            layer -= np.outer(hidden, grad)
            bias -= 0.01 * grad
            if len(bucket):
                vectors[bucket] -= share[:, None] * back * len(bucket) ** 0.5
    return vectors @ (layer[:, 1] - layer[:, 0]), float(bias[1] - bias[0])


def sample(docs: DataFrame, labels: DataFrame, rows_per_class: int, sample_bytes: int = SAMPLE_BYTES) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """Features of the training rows: per class those first by a hash of the id, then of the text.

    Rows are fixed by id and text alone; remainder 2 of crc32 modulo 4 is held
    out.  Of rows whose features exceed ``sample_bytes`` together, the first are taken.
    """
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).dropna().where("quality in (0, 1)").distinct()
    rows = rows.where(~held_out(F.col("doc_id")))
    texts = with_key(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    order = [F.xxhash64("doc_id"), "doc_id", KEY]
    # ids first, then their texts, of which an id may have several
    first = [rows.where(F.col("quality") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows_per_class) for label in (0, 1)]
    labelled = texts.join(F.broadcast(common.materialise(first[0].unionByName(first[1]), "classifier-ids")), "doc_id").select("doc_id", KEY, "quality").distinct()
    first = [labelled.where(F.col("quality") == label).orderBy(*order).limit(rows_per_class) for label in (0, 1)]
    chosen = common.materialise(first[0].unionByName(first[1]), "classifier-labels")  # at most 2 x rows_per_class

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                found = list(counted(part.column("text")))
                own = [part.column(c) for c in ("doc_id", KEY, "quality")]
                yield pa.RecordBatch.from_arrays([*own, pa.array([b.tobytes() for b, _ in found], pa.binary()), pa.array([c.tobytes() for _, c in found], pa.binary())], names=["doc_id", KEY, "quality", "buckets", "counts"])
        release()

    found = texts.join(F.broadcast(chosen), ["doc_id", KEY]).select("doc_id", KEY, "quality", "text").mapInArrow(run, f"doc_id long, {KEY} long, quality int, buckets binary, counts binary")
    found = common.materialise(found.dropDuplicates(["doc_id", KEY, "quality"]), "classifier-rows")
    so_far = F.sum(F.length("buckets") + F.length("counts")).over(Window.orderBy(*order, "quality"))  # over the sample alone
    found = found.withColumn("so_far", so_far).where(F.col("so_far") <= sample_bytes).select("doc_id", "quality", "buckets", "counts").collect()
    found.sort(key=lambda r: (r[0], r[1], r[2]))
    return [(np.frombuffer(r[2], np.int32), np.frombuffer(r[3], np.int32), r[1]) for r in found]


def held_out(doc_id):
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def scores(docs: DataFrame, labels: DataFrame, rows_per_class: int = ROWS_PER_CLASS) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of ``docs``."""
    rows = sample(docs, labels, rows_per_class)
    if len({label for _, _, label in rows}) == 2:
        weight, bias = train(rows)
    else:
        weight, bias = np.zeros(BUCKETS), 0.0
    shared = docs.sparkSession.sparkContext.broadcast((weight, bias))

    def run(batches):
        weight, bias = shared.value
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                bucket, row = features(part.column("text"))
                total = np.bincount(row, weights=weight[bucket], minlength=part.num_rows)
                logit = total / np.maximum(1, np.bincount(row, minlength=part.num_rows)) + bias
                score = 1 / (1 + np.exp(-np.clip(logit, -500, 500)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(score)], names=["doc_id", "score"])
        release()

    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
