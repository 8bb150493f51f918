"""Substring dedup by level-wise doubling of repeated word windows.

The levels for windows of 13 words are 6, 12 and 13 words: windows that occur in
more than one document at one length are extended to twice that length, the
last step to the asked length.  ``Repeats`` goes on to 26, 52, ... words, until no
candidate survives, if it is asked for no longest length.  Shorter first levels
would thin nothing, for nearly all windows of three words repeat.

At the first level not every window is posted: a window of the asked length is
represented by the smallest hash among its short windows, so that two equal
windows always share their representative and about one position in four is
posted.  Level two and three post only windows whose representative survives.
Windows of the asked length are equal if two independent 64-bit hashes are, one
of all their words and one of the level before.

Documents that equal an earlier one word for word are settled by two such hashes
and take no part in the levels.

A word is removed if it lies in a window of ``length`` words that also starts in
a document with a smaller ``doc_id``.  All windows are judged on the input.

Defined cases: null and empty texts have no words; texts shorter than a window
lose nothing; rows with a null ``doc_id`` lose nothing and cause no removal;
rows that repeat a ``doc_id`` never count against each other, and each loses
only what its own text repeats.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .common import KEY, release
from .spans import RUNS, by_document, with_runs
from .textkernel import SPACED, Kernel, slices

LENGTH = 13


def representatives(kernel: Kernel, words, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Half-window hashes, and the place of the smallest one of each full window; -1 where none fits."""
    half = length // 2
    hashes, _ = kernel.windows(words, half)
    at = np.arange(len(hashes))
    fits = at + length <= np.repeat(words.first[1:], words.counts)
    span = length - half + 1  # half windows of a full window
    best, place, have = hashes, at, 1
    while have < span:
        step = min(have, span - have)
        other = np.minimum(at + step, len(at) - 1)
        right = best[other] < best
        best, place, have = np.where(right, best[other], best), np.where(right, place[other], place), have + step
    return hashes, np.where(fits, place, -1)


def whole_texts(docs: DataFrame) -> DataFrame:
    """doc_id, text key, two hashes of the whole word sequence, and number of words."""

    def run(batches):
        kernel = Kernel(SPACED, lower=False)
        for batch in batches:
            for part in slices(batch, "text"):
                words = kernel.words(part.column("text"))
                whole, check = (kernel.spans(words, words.first[:-1], words.first[1:], c) for c in (False, True))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column(KEY), pa.array(whole.view(np.int64)), pa.array(check.view(np.int64)), pa.array(words.counts, pa.int64())], names=["doc_id", KEY, "whole", "check", "n_words"])
        release()

    return docs.mapInArrow(run, f"doc_id long, {KEY} long, whole long, check long, n_words long")


def rows_at(part: pa.RecordBatch, words, at: np.ndarray, hashes: dict[str, np.ndarray]) -> pa.RecordBatch:
    """Rows of hashes, doc_id, text key and pos for the word numbers ``at``."""
    doc = np.searchsorted(words.first, at, side="right") - 1
    owner, pos = pa.array(doc), pa.array((at - words.first[doc]).astype(np.int32))
    return pa.RecordBatch.from_arrays([*(pa.array(h.view(np.int64)) for h in hashes.values()), part.column("doc_id").take(owner), part.column(KEY).take(owner), pos], names=[*hashes, "doc_id", KEY, "pos"])


def posted_halves(docs: DataFrame, length: int) -> DataFrame:
    """h, doc_id, text key, pos of every representative half window."""

    def run(batches):
        kernel = Kernel(SPACED, lower=False)
        for batch in batches:
            for part in slices(batch, "text"):
                words = kernel.words(part.column("text"))
                hashes, place = representatives(kernel, words, length)
                place = np.unique(place[place >= 0])
                yield rows_at(part, words, place, {"h": hashes[place]})
        release()

    return docs.mapInArrow(run, f"h long, doc_id long, {KEY} long, pos int")


def repeated(rows: DataFrame, *keys: str) -> DataFrame:
    """Keys of windows that occur in more than one document, with the smallest doc_id."""
    return rows.groupBy(*keys).agg(F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc")).where("first_doc < last_doc").select(*keys, "first_doc")


def candidate_windows(docs: DataFrame, halves: DataFrame, length: int) -> DataFrame:
    """twice, h, doc_id, text key, pos of every full window whose representative is a repeated half.

    ``twice`` is the hash of that half extended to twice its length inside the
    window, ``h`` an independent one of the window.
    """

    def run(batches):
        kernel = Kernel(SPACED, lower=False)
        for batch in batches:
            for part in slices(batch, "text"):
                words = kernel.words(part.column("text"))
                _, place = representatives(kernel, words, length)
                alive = np.zeros(len(words.hash) + 1, dtype=np.int64)
                for k, packed in enumerate(part.column(RUNS).to_pylist()):
                    pairs = np.frombuffer(packed, dtype=np.int32).reshape(-1, 2) + words.first[k]
                    np.add.at(alive, pairs[:, 0], 1)
                    np.add.at(alive, pairs[:, 1], -1)
                alive = np.cumsum(alive)[:-1] > 0
                at = np.flatnonzero(place >= 0)
                at = at[alive[place[at]]]
                double = length // 2 * 2
                # from the window's start, or from its end where the half lies there
                begin = np.where(place[at] + length // 2 <= at + double, at, at + length - double)
                twice, _ = kernel.windows(words, double)
                whole, _ = kernel.windows(words, length, check=True)
                yield rows_at(part, words, at, {"twice": twice[begin], "h": whole[at]})
        release()

    return with_runs(docs, halves, "inner").select("doc_id", KEY, "text", RUNS).mapInArrow(run, f"twice long, h long, doc_id long, {KEY} long, pos int")


def doubled(rows: DataFrame, length: int) -> DataFrame:
    """Windows of twice the length from pairs of repeated windows of a document."""
    rows = rows.dropDuplicates(["doc_id", KEY, "pos"])  # rows that repeat as a whole
    second = rows.select("doc_id", KEY, (F.col("pos") - length).alias("pos"), F.col("h").alias("next"))
    return rows.join(second, ["doc_id", KEY, "pos"]).select(F.hash("h", "next").cast("long").alias("twice"), F.xxhash64("h", "next").alias("h"), "doc_id", KEY, "pos")


def surviving(rows: DataFrame, *keys: str) -> DataFrame:
    """``rows`` of windows that occur in more than one document, with the smallest doc_id."""
    # a table of its own, so that the join may split hot windows
    shared = common.materialise(repeated(rows, *keys), "shared-windows")
    out = common.materialise(rows.drop("first_doc").join(shared, list(keys)), "repeated-windows")
    common.discard(shared)
    return out


class Repeats:
    """The levels of a table of documents, each a table of repeated windows.

    ``levels[k]`` has h, doc_id, text key, pos and first_doc of windows of
    ``lengths[k]`` words, from ``length`` on, the smallest document's own included.
    """

    def __init__(self, docs: DataFrame, length: int = LENGTH, longest: int | None = LENGTH):
        self.docs = common.with_short_key(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
        whole = common.materialise(whole_texts(self.docs.where("doc_id is not null")).where(f"n_words >= {length}"), "whole-texts")
        same = surviving(whole, "whole", "check", "n_words")
        self.copies = common.materialise(same.where("doc_id > first_doc").select("doc_id", KEY).distinct(), "copies")
        common.discard(whole, same)
        rest = common.sized_join(self.docs.where("doc_id is not null"), self.copies, ["doc_id", KEY], "left_anti")

        posted = posted_halves(rest, length)
        shared = common.materialise(repeated(posted.select("h", "doc_id"), "h").select("h"), "shared-halves")
        halves = common.materialise(by_document(posted.join(shared, "h", "left_semi")), "halves")
        self.lengths, self.levels = [], []
        rows = common.materialise(candidate_windows(rest, halves, length), "windows")
        common.discard(shared, halves)
        while True:
            half = surviving(rows, "twice")
            common.discard(rows)
            level = surviving(half, "twice", "h")
            common.discard(half)
            if level.isEmpty():
                break
            self.lengths.append(length)
            self.levels.append(level)
            if longest is not None and 2 * length > longest:
                break
            rows, length = common.materialise(doubled(level, length), "windows"), 2 * length


def removals(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_words, n_removed and the digest of the kept words of every row."""
    found = Repeats(docs, length)
    # a run ending in -1 stands for the whole text
    covers = found.copies.select("doc_id", KEY, F.lit(np.array([[0, -1]], dtype=np.int32).tobytes()).alias(RUNS))
    if found.levels:
        covers = covers.unionByName(by_document(found.levels[0].where("doc_id > first_doc").select("doc_id", KEY, "pos")))
    covers = common.materialise(covers, "covers")
    common.discard(found.copies, *found.levels)

    def run(batches):
        kernel = Kernel(SPACED, lower=False)
        for batch in batches:
            for part in slices(batch, "text"):
                words = kernel.words(part.column("text"))
                kept = np.ones(len(words.hash), dtype=bool)
                for k, packed in enumerate(part.column(RUNS).to_pylist()):
                    for begin, end in np.frombuffer(packed or b"", dtype=np.int32).reshape(-1, 2):
                        stop = words.first[k + 1] if end < 0 else words.first[k] + end - 1 + length  # inside the text, for windows are
                        kept[words.first[k] + begin : stop] = False
                digests = [hashlib.sha256(text).hexdigest() for text in kept_texts(words, kept)]
                removed = np.diff(np.concatenate([[0], np.cumsum(~kept)])[words.first])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(words.counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests)], names=["doc_id", "n_words", "n_removed", "kept_sha256"])
        release()

    return with_runs(found.docs, covers, "left").select("doc_id", "text", RUNS).mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def kept_texts(words, kept: np.ndarray):
    """The kept words of each text, joined by single spaces, as bytes."""
    for a, b in zip(words.first, words.first[1:]):
        own = np.flatnonzero(kept[a:b]) + a
        if not len(own):
            yield b""
            continue
        sizes = words.end[own] - words.start[own] + 1
        begin = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        take = np.repeat(words.start[own] - begin, sizes) + np.arange(sizes.sum())
        out = words.data[np.minimum(take, len(words.data) - 1)]
        out[begin + sizes - 1] = 32
        yield out[:-1].tobytes()
