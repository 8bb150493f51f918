"""N-gram Jaccard join by prefix filter and prefix trie.

Documents become sets of word shingles under one global order, rarest first.
The order comes from a count sketch of fixed size over all documents: any
order is correct, and this one puts shingles that many documents share last.
Of each set, only the prefix that every similar set must touch is posted;
postings that occur in one set alone are dropped.  Sets that share a posting
are compared by size and by parity bitmap, which never rule out a similar pair;
what these leave connected forms a family, joined exactly by trie (see
``prefix_trie``).

Equal sets are one item throughout, whatever the number of their copies.  Sets
are known by a 64-bit hash, shingles by 56 bits and the class of their count.
Rows are told apart by ``doc_id`` and the text's hash.

Defined cases: a text of fewer words than a shingle is one shingle; null texts
and texts without words have empty sets, are linked with nothing and form
components of their own; rows with a null ``doc_id`` get the component of the
smallest known id with their set, null if there is none; repeated rows are
exact copies of each other.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, components, prefix_trie
from .common import KEY, release, with_key
from .textkernel import SPACED, U64, Kernel, mix, slices

SKETCH_BITS = 18


def shingle_sets(texts: pa.Array, kernel: Kernel, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, and bounds by text."""
    words = kernel.words(texts)
    hashes, valid = kernel.windows(words, k)
    counts = words.counts
    short = np.flatnonzero((counts > 0) & (counts < k))
    found = np.concatenate([hashes[valid], kernel.spans(words, words.first[short], words.first[short + 1])])
    doc = np.concatenate([words.docs()[valid], short])
    order = np.lexsort((found, doc))
    found, doc = found[order], doc[order]
    new = np.ones(len(found), dtype=bool)
    new[1:] = (found[1:] != found[:-1]) | (doc[1:] != doc[:-1])
    return found[new], np.searchsorted(doc[new], np.arange(len(texts) + 1))


def signature(found: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """64-bit hash of each set, independent of order."""
    total = np.concatenate([np.zeros(1, U64), np.cumsum(mix(found + U64(0x9E3779B97F4A7C15)))])
    return mix(total[bounds[1:]] - total[bounds[:-1]] + np.diff(bounds).astype(U64)).view(np.int64)


def ordered(found: np.ndarray, bounds: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Order keys of each set, sorted within it: class of the count, then hash."""
    key = (classes[(found >> U64(64 - SKETCH_BITS)).astype(np.int64)].astype(U64) << U64(56)) | (found >> U64(8))
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    return key[np.lexsort((key, doc))]


def sets_and_sketch(docs: DataFrame, k: int) -> DataFrame:
    """Rows (doc_id, text key, sig, n, bits, bucket -1) of documents, and (bucket, n) counts of shingles."""

    def run(batches):
        kernel, counts = Kernel(SPACED, lower=True), np.zeros(1 << SKETCH_BITS, dtype=np.int64)
        for batch in batches:
            for part in slices(batch, "text"):
                found, bounds = shingle_sets(part.column("text"), kernel, k)
                counts += np.bincount((found >> U64(64 - SKETCH_BITS)).astype(np.int64), minlength=len(counts))
                yield as_rows(part.column("doc_id"), part.column(KEY), signature(found, bounds), np.diff(bounds), prefix_trie.bitmaps(found, bounds), np.full(part.num_rows, -1, dtype=np.int32))
        some = np.flatnonzero(counts)
        none = pa.nulls(len(some), pa.int64())
        yield as_rows(none, none, np.zeros(len(some), dtype=np.int64), counts[some], [None] * len(some), some.astype(np.int32))
        release()

    def as_rows(doc_id, key, sig, n, bits, bucket):
        return pa.RecordBatch.from_arrays([doc_id, key, pa.array(sig), pa.array(n, pa.int64()), pa.array(bits, pa.binary()), pa.array(bucket)], names=["doc_id", KEY, "sig", "n", "bits", "bucket"])

    return docs.mapInArrow(run, f"doc_id long, {KEY} long, sig long, n long, bits binary, bucket int")


def classes_of(rows: DataFrame) -> np.ndarray:
    """Quarter-octave class of the count in each of the sketch's fixed number of cells."""
    cells = rows.where("bucket >= 0").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(1 << SKETCH_BITS)
    counts[cells.column("bucket").to_numpy()] = cells.column("n").to_numpy()
    return np.floor(4 * np.log2(counts + 1)).astype(np.uint8)


def postings(docs: DataFrame, k: int, numerator: int, shared) -> DataFrame:
    """key, sig of each set's prefix: so many first elements that no similar set misses all."""

    def run(batches):
        kernel, classes = Kernel(SPACED, lower=True), shared.value
        for batch in batches:
            for part in slices(batch, "text"):
                found, bounds = shingle_sets(part.column("text"), kernel, k)
                key, n = ordered(found, bounds, classes), np.diff(bounds)
                prefix = np.where(n > 0, n - (numerator * n + 99) // 100 + 1, 0)
                place = np.arange(len(key)) - np.repeat(bounds[:-1], n)
                kept = place < np.repeat(prefix, n)
                yield pa.RecordBatch.from_arrays([pa.array(key[kept].view(np.int64)), pa.array(np.repeat(signature(found, bounds), prefix))], names=["key", "sig"])
        release()

    return docs.select("text").mapInArrow(run, "key long, sig long")


def ordered_sets(docs: DataFrame, k: int, shared) -> DataFrame:
    """item (the set's hash) and data (its ordered elements) of each document."""

    def run(batches):
        kernel, classes = Kernel(SPACED, lower=True), shared.value
        for batch in batches:
            for part in slices(batch, "text"):
                found, bounds = shingle_sets(part.column("text"), kernel, k)
                key = ordered(found, bounds, classes)
                data = [key[a:b].tobytes() for a, b in zip(bounds, bounds[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(signature(found, bounds)), pa.array(data, pa.binary())], names=["item", "data"])
        release()

    return docs.select("text").mapInArrow(run, "item long, data binary")


def rooted_rows(docs: DataFrame, shingle: int, numerator: int) -> DataFrame:
    """doc_id, text key, n and first, the first row of its component, of every row of ``docs``.

    ``first`` is the smallest struct (unknown, doc_id, key): null ids come last.
    """
    sc = docs.sparkSession.sparkContext
    docs = with_key(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    both = common.materialise(sets_and_sketch(docs, shingle), "shingle-sets")
    shared = sc.broadcast(classes_of(both))
    rows = both.where("bucket < 0").select("doc_id", KEY, "sig", "n")
    place = F.struct(F.col("doc_id").isNull().alias("unknown"), F.col("doc_id"), F.col(KEY).alias("key"))
    known = both.where("n > 0 and bucket < 0").groupBy("sig").agg(F.min(place).alias("first"), F.first("n").alias("n"), F.first("bits").alias("bits"))
    known = common.materialise(known.withColumnRenamed("sig", "item"), "distinct-sets")

    posted = common.materialise(postings(docs, shingle, numerator, shared), "postings")
    alive = posted.groupBy("key").agg(F.min("sig").alias("leader"), F.max("sig").alias("other")).where("leader != other").select("key", "leader")
    alive = common.materialise(alive, "shared-postings")  # so that the join may split hot keys
    members = common.materialise(posted.join(alive, "key").select("leader", F.col("sig").alias("item")).distinct(), "members")
    common.discard(posted, alive)

    possible = prefix_trie.candidates(members, known.select("item", "n", "bits"), numerator)
    families = common.materialise(components.connected(possible).select(F.col("root").alias("leader"), F.col("node").alias("item")), "families")
    common.discard(members)

    wanted = known.join(families.select("item"), "item", "left_semi").select(F.col("first.doc_id").alias("rep"), F.col("first.key").alias("rep_key"))
    texts = common.sized_join(docs, common.materialise(wanted.distinct(), "wanted"), F.expr(f"doc_id <=> rep and {KEY} = rep_key"), "left_semi")
    sets = common.materialise(ordered_sets(texts, shingle, shared).dropDuplicates(["item"]), "sets")
    links = prefix_trie.join_families(families, sets, numerator, lambda data: [np.frombuffer(d, dtype=np.uint64) for d in data])
    found = components.connected(links)
    common.discard(sets, families)

    first = known.select("item", "first").join(found.withColumnRenamed("node", "item"), "item", "left").select("item", F.coalesce("root", "item").alias("root"), "first")
    firsts = common.materialise(first.groupBy("root").agg(F.min("first").alias("first")), "components")
    first = first.drop("first").join(firsts, "root").select(F.col("item").alias("sig"), "first")
    out = rows.where("n > 0").join(first, "sig").select("doc_id", KEY, "n", "first")
    return out.unionByName(rows.where("n = 0").select("doc_id", KEY, "n", place.alias("first")))


def components_of(docs: DataFrame, shingle: int = 4, numerator: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of ``docs``."""
    return rooted_rows(docs, shingle, numerator).select("doc_id", F.col("n").alias("n_shingles"), F.col("first.doc_id").alias("component_id"))


def representatives(docs: DataFrame, shingle: int = 5, numerator: int = 80) -> DataFrame:
    """The rows of ``docs``, all columns, that come first in their component.

    The first row is that of the smallest ``doc_id``, a null one last; among
    different texts of one id the text's hash decides, and rows that repeat both
    stand for one document and go or stay together.  Documents without words stay.
    """
    found = rooted_rows(docs, shingle, numerator).where(f"n > 0 and not (doc_id <=> first.doc_id and {KEY} = first.key)")
    found = common.materialise(found.select(F.col("doc_id").alias("gone"), F.col(KEY).alias("gone_key")).distinct(), "near-duplicates")
    return common.sized_join(with_key(docs), found, F.expr(f"cast(doc_id as long) <=> gone and {KEY} = gone_key"), "left_anti").select(*docs.columns)
