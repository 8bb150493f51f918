"""Importance resampling towards a target corpus, by bucket-partitioned postings.

Every run of one to ``longest`` words of a text is a feature; its CRC-32 modulo
the number of buckets is its bucket.  The corpus is kept as an inverted index:
a row for each bucket of a block of documents, which lists the block's documents
that have the bucket and how often.  The rows are shuffled by bucket and meet
the sums of both corpora there, so the bucket's gain is known where its postings
are; a bucket that very many documents share is split like any skewed join key.
Each partition adds up what its buckets give to the documents of a block and
emits one row a block, and a second shuffle, by block, adds these up.

A row's weight is the sum of its features' gains.  Rows are drawn without
replacement by the largest weight plus Gumbel noise, which comes from a digest
of the row's id, so that reruns agree.

Defined cases: null and empty texts have no features, weight 0, and are never
drawn, nor are rows with a null ``doc_id``, which have no score either; rows that
repeat a ``doc_id`` are judged one by one, and ties between them are broken by
their place in the table; an empty target gives every bucket the same counts of
zero; texts of any length are cut at words and counted piece by piece.  Columns
other than ``doc_id`` and ``text`` are not read, whatever their names.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .common import release
from .textkernel import ALNUM, LOWER, SLICE_BYTES, buffer_of, word_spans

BUCKETS = 10_000
#: A block ends with the document that reaches so many bytes, or is the last of so many.
BLOCK_BYTES, BLOCK_DOCS = 1 << 22, 1 << 15
#: Words up to so many bytes are hashed together, byte by byte; longer ones are rare.
SHORT = 48
#: Postings held before equal ones are added up.
HELD = 1 << 20
INDEX = "block long, bucket int, n long, docs array<int>, counts array<long>, ids array<long>, words array<long>, features array<long>"


def crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table


def crc32(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """CRC-32 of the byte ranges start:end."""
    table, size = crc_table(), end - start
    order = np.argsort(-np.minimum(size, SHORT + 1), kind="stable")
    order = order[size[order] <= SHORT]
    at, left = start[order], size[order]
    crc = np.full(len(order), 0xFFFFFFFF, dtype=np.uint32)
    active = len(order)
    for k in range(int(left[0]) if active else 0):
        active = int(np.searchsorted(-left, -k, side="left"))  # longer than k
        crc[:active] = table[(crc[:active] ^ data[at[:active] + k]) & 0xFF] ^ (crc[:active] >> 8)
    out = np.empty(len(size), dtype=np.uint32)
    out[order] = crc ^ 0xFFFFFFFF
    for k in np.flatnonzero(size > SHORT):
        out[k] = zlib.crc32(data[start[k] : end[k]])
    return out


def pieces(text: np.ndarray, limit: int = SLICE_BYTES):
    """Cut one text after separators, every ``limit`` bytes or a little later."""
    at, inside = 0, ALNUM[LOWER]
    while at < len(text):
        stop = min(at + limit, len(text))
        while stop < len(text) and inside[text[stop - 1]]:
            more = np.flatnonzero(~inside[text[stop : stop + limit]])
            stop = stop + int(more[0]) + 1 if len(more) else min(stop + limit, len(text))
        yield text[at:stop]
        at = stop


class Block:
    """Postings of consecutive documents, added up as pieces of text come in."""

    def __init__(self, longest: int, buckets: int):
        self.longest, self.buckets = longest, buckets
        self.ids, self.words, self.features, self.codes, self.counts, self.held, self.size = [], [], [], [], [], 0, 0

    def put(self, data: np.ndarray, offsets: np.ndarray, ids: list) -> None:
        """Whole texts that lie side by side."""
        first = len(self.ids)
        self.ids += ids
        self.words += [0] * len(ids)
        self.features += [0] * len(ids)
        self.size += len(data)
        if len(ids) == 1 and len(data) > SLICE_BYTES:
            tail = data[:0]
            for piece in pieces(data):
                tail = self._count(np.concatenate([tail, piece]), np.array([0, len(tail) + len(piece)]), first, len(tail))
        else:
            self._count(data, offsets, first, 0)

    def _count(self, raw: np.ndarray, offsets: np.ndarray, first: int, known: int) -> np.ndarray:
        """Counts runs that end after the first ``known`` bytes; returns the words that the next piece needs, each with a blank."""
        data = LOWER[raw]
        start, end = word_spans(data, offsets, ALNUM)
        doc = np.searchsorted(offsets, start, side="right") - 1
        fresh = end > known
        np.add.at(words := np.zeros(len(offsets) - 1, dtype=np.int64), doc[fresh], 1)
        for k, n in enumerate(words):
            self.words[first + k] += int(n)
        if self.longest > 1 and len(start):  # one blank between words, so that runs are ranges
            sizes = end - start + 1
            begin = np.cumsum(sizes) - sizes
            source = np.repeat(start - begin, sizes) + np.arange(sizes.sum())
            joined = data[np.minimum(source, len(data) - 1)]
            joined[begin + sizes - 1] = 0x20
            data, start, end = joined, begin, begin + sizes - 1
        for length in range(1, self.longest + 1):
            last = np.arange(length - 1, len(start))
            last = last[(doc[last] == doc[last - length + 1]) & fresh[last]]
            if len(last):
                bucket = crc32(data, start[last - length + 1], end[last]) % np.uint32(self.buckets)
                self._hold((doc[last] + first) * self.buckets + bucket, np.ones(len(last), dtype=np.int64))
        carry = min(self.longest - 1, len(start))
        return np.concatenate([np.append(data[a:b], np.uint8(0x20)) for a, b in zip(start[-carry:], end[-carry:])]) if carry else raw[:0]

    def _hold(self, codes: np.ndarray, counts: np.ndarray) -> None:
        self.codes.append(codes)
        self.counts.append(counts)
        self.held += len(codes)
        if self.held > HELD:
            self._settle()

    def _settle(self) -> None:
        codes, back = np.unique(np.concatenate(self.codes), return_inverse=True) if self.codes else (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))
        counts = np.zeros(len(codes), dtype=np.int64)
        np.add.at(counts, back, np.concatenate(self.counts) if self.counts else counts)
        self.codes, self.counts, self.held = [codes], [counts], 0

    def rows(self, number: int) -> pa.RecordBatch:
        """A row for each bucket, and one of bucket -1 for the documents."""
        self._settle()
        doc, bucket, counts = self.codes[0] // self.buckets, self.codes[0] % self.buckets, self.counts[0]
        features = np.zeros(len(self.ids), dtype=np.int64)
        np.add.at(features, doc, counts)
        order = np.lexsort((doc, bucket))
        doc, bucket, counts = doc[order], bucket[order], counts[order]
        cut = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else np.zeros(0, dtype=np.int64)
        offsets = pa.array(np.concatenate([cut, [len(bucket), len(bucket)]]), pa.int32())
        lists = lambda x, kind: pa.ListArray.from_arrays(offsets, pa.array(x, kind))
        n = np.append(np.add.reduceat(counts, cut) if len(cut) else counts, 0)
        own = lambda x: pa.array([None] * len(cut) + [x], pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(n), number)), pa.array(np.append(bucket[cut], -1), pa.int32()), pa.array(n), lists(doc, pa.int32()), lists(counts, pa.int64()), own(self.ids), own(self.words), own(features.tolist())],
            names=[c.split()[0] for c in INDEX.split(", ")],
        )


def index(docs: DataFrame, longest: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """Postings of a table of doc_id, text, a row for each bucket of each block; bucket -1 holds the block's doc_ids, words and features."""

    def run(batches):
        part, number = TaskContext.get().partitionId(), 0
        block = Block(longest, buckets)
        for batch in batches:
            data, offsets = buffer_of(batch.column("text"))
            ids, row = batch.column("doc_id").to_pylist(), 0
            while row < len(ids):
                stop = int(np.searchsorted(offsets, offsets[row] + SLICE_BYTES, side="right")) - 1
                stop = min(max(stop, row + 1), len(ids), row + BLOCK_DOCS)
                block.put(data[offsets[row] : offsets[stop]], offsets[row : stop + 1] - offsets[row], ids[row:stop])
                row = stop
                if block.size >= BLOCK_BYTES or len(block.ids) >= BLOCK_DOCS:
                    yield block.rows((part << 32) + number)
                    block, number = Block(longest, buckets), number + 1
        if block.ids:
            yield block.rows((part << 32) + number)
        release()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, INDEX)


def bucket_sums(documents: DataFrame, target: DataFrame) -> DataFrame:
    """bucket, s, t: how often each bucket occurs in the corpus and in the target; ``documents`` and ``target`` are indexes."""
    both = documents.select("bucket", F.col("n").alias("s"), F.lit(0).cast("long").alias("t")).unionByName(target.select("bucket", F.lit(0).cast("long").alias("s"), F.col("n").alias("t")))
    return both.where("bucket >= 0").groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t"))


def gain(corpus: int, target: int, buckets: int):
    """1000 times the log of the smoothed ratio of shares, floored; in doubles."""
    share = (F.col("t").cast("double") + 1) * F.lit(float(corpus + buckets)) / ((F.col("s").cast("double") + 1) * F.lit(float(target + buckets)))
    return F.floor(F.lit(1000.0) * F.log(share))


def contributions(postings: DataFrame) -> DataFrame:
    """block, docs, sums: what the gains of a partition's buckets give to each document of a block."""

    def run(batches):
        current, sums = None, None
        for batch in batches:
            gains, (docs, counts) = batch.column("gain").to_numpy(), (batch.column(c) for c in ("docs", "counts"))
            at, docs, counts = docs.offsets.to_numpy(), docs.values.to_numpy(), counts.values.to_numpy()
            for k, block in enumerate(batch.column("block").to_pylist()):
                if block != current:
                    if current is not None:
                        yield total(current, sums)
                    current, sums = block, np.zeros(0, dtype=np.int64)
                own = docs[at[k] : at[k + 1]]  # ascending, each once
                if len(own) and own[-1] >= len(sums):
                    sums = np.concatenate([sums, np.zeros(own[-1] + 1 - len(sums), dtype=np.int64)])
                sums[own] += counts[at[k] : at[k + 1]] * gains[k]
        if current is not None:
            yield total(current, sums)

    def total(block, sums):
        return pa.RecordBatch.from_arrays([pa.array([block]), pa.array([sums.tolist()], pa.list_(pa.int64()))], names=["block", "sums"])

    return postings.sortWithinPartitions("block").select("block", "gain", "docs", "counts").mapInArrow(run, "block long, sums array<long>")


def weights(documents: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, place, n_words, n_features, weight of every row behind the index ``documents``."""
    sums = common.materialise(bucket_sums(documents, target), "bucket-sums")  # a table of its own, so that the join may split hot buckets
    totals = sums.agg(F.sum("s"), F.sum("t")).first()
    postings = documents.where("bucket >= 0").select("block", "bucket", "docs", "counts").join(sums.hint("merge"), "bucket")
    parts = contributions(postings.withColumn("gain", gain(totals[0] or 0, totals[1] or 0, buckets)))
    heads = documents.where("bucket = -1").select("block", F.lit(None).cast("array<long>").alias("sums"), "ids", "words", "features")
    rows = heads.unionByName(parts, allowMissingColumns=True).repartition("block").sortWithinPartitions("block")

    def run(batches):
        current, head, sums = None, None, None

        def ended():
            weight = np.zeros(len(head[0]), dtype=np.int64)
            weight[: len(sums)] += sums
            place = pa.array([f"{current}:{k}" for k in range(len(weight))])
            return pa.RecordBatch.from_arrays([pa.array(head[0], pa.int64()), place, *(pa.array(x, pa.int64()) for x in head[1:]), pa.array(weight)], names=["doc_id", "place", "n_words", "n_features", "weight"])

        for batch in batches:
            for row in batch.to_pylist():
                if row["block"] != current:
                    if current is not None:
                        yield ended()
                    current, head, sums = row["block"], None, np.zeros(0, dtype=np.int64)
                if row["ids"] is not None:
                    head = row["ids"], row["words"], row["features"]
                else:
                    more = np.array(row["sums"], dtype=np.int64)
                    low, high = sorted((sums, more), key=len)
                    sums = high.copy()
                    sums[: len(low)] += low
        if current is not None:
            yield ended()
        release()

    return rows.mapInArrow(run, "doc_id long, place string, n_words long, n_features long, weight long")


def noise(seed: int):
    """Gumbel noise from a digest of doc_id, in thousandths, floored."""
    digest = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string")), 256), 1, 8)
    share = (F.conv(digest, 16, 10).cast("double") + F.lit(0.5)) / F.lit(4294967296.0)
    return F.floor(F.lit(-1000.0) * F.log(-F.log(share)))


def ranked(rows: DataFrame, order: list, drawn: int) -> DataFrame:
    """``rows`` with rank 1, 2, ... of the first ``drawn`` in ``order``, null behind them.

    Rows are range-partitioned, sorted where they are, and numbered by the sizes
    of the partitions before them; the driver sees one size a partition.
    """
    at = F.monotonically_increasing_id()  # partition number, then place in it
    sorted_ = common.materialise(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", at), "sorted")
    part = F.shiftright("at", 33).cast("int")
    sizes = sorted_.groupBy(part.alias("part")).agg(F.count("*").alias("n")).orderBy("part").collect()
    before, seen = [], 0
    for part_, n in sizes:
        before.append((part_, seen))
        seen += n
    offsets = rows.sparkSession.createDataFrame(before or [(0, 0)], "part int, before long")
    rank = F.col("before") + F.col("at").bitwiseAND((1 << 33) - 1) + 1
    out = sorted_.withColumn("part", part).join(F.broadcast(offsets), "part")
    return out.withColumn("rank", F.when(rank <= drawn, rank)).drop("part", "before", "at")


def resampled(docs: DataFrame, target: DataFrame, longest: int = 1, buckets: int = BUCKETS, seed: int = 2024, percent: int = 10, least_words: int = 20) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every row of ``docs``; drawn rows have a rank.

    ``target`` needs a text column only.
    """
    documents = common.materialise(index(docs, longest, buckets), "postings")
    wanted = index(target.select(F.lit(None).cast("long").alias("doc_id"), "text"), longest, buckets)
    rows = weights(documents, common.materialise(wanted, "target-postings"), buckets)
    rows = common.materialise(rows.withColumn("score", F.col("weight") + noise(seed)), "scored")
    eligible = F.col("doc_id").isNotNull() & (F.col("n_words") >= least_words)
    drawn = percent * rows.where(eligible).count() // 100
    out = ranked(rows.withColumn("eligible", eligible), [F.col("eligible").desc(), F.col("score").desc(), F.col("doc_id"), F.col("place")], drawn)
    return out.select("doc_id", "n_features", "weight", "score", "rank")
