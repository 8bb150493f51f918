"""Benchmark decontamination by a distributed positional inverted index.

The training side is indexed once and stored: every slice of documents becomes a
shard, one row with its documents, its terms in order, and a posting list of
word positions for every term, benchmark or not.  Nothing is shuffled.

The benchmark side is a stated set of queries, looked up in blocks of bounded
size.  A first pass over the stored terms counts how often each term of a block
occurs in all documents.  A second intersects posting lists: the occurrences of
a window's rarest term, shifted by the term's offset, are looked up in the
shifted list of the next rarest, and so on, for all windows of a shard together.
The work follows the occurrences of rare terms, not the number of windows.

Terms are 64-bit hashes of whole words; a wrong match needs two words of one
hash, of which some 10^9 distinct words hold 0.03 expected pairs.

Defined cases: a null or empty text has no words; an item of fewer words than a
window is one window; items without words match nothing; a null ``item_id``
lets its words count as hit but is not listed; rows repeated in the documents
are answered one by one, and repeated items count once.  Rows of one ``doc_id``
are judged each by its own text.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .common import KEY, release, with_key
from .spans import runs
from .textkernel import ALNUM, Kernel, slices

WINDOW = 13
#: Characters of benchmark text in one block; about 20 MB of numbers.
BLOCK_CHARS = 4_000_000
#: Share of a window's distinct terms that a proximity match asks for.
NEAR_SHARE = 0.75
#: Occurrences of rarest terms looked at together.
PAIRS = 500_000

INDEX = "shard long, doc_id array<long>, keys array<long>, n_words array<int>, terms binary, counts binary, positions binary"
MATCHES = "doc_id long, item_id string, kind string, start long, length long"


def build_index(docs: DataFrame) -> DataFrame:
    """The stored index of ``docs``, a row a shard; positions are differences within each list."""

    def run(batches):
        kernel, number = Kernel(ALNUM, lower=True), TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in slices(batch, "text"):
                words = kernel.words(part.column("text"))
                order = np.argsort(words.hash, kind="stable")
                terms, first = np.unique(words.hash[order], return_index=True)
                counts = np.diff(np.append(first, len(order)))
                step = np.diff(order, prepend=0)
                step[first] = order[first]
                row = [number, part.column("doc_id").to_pylist(), part.column(KEY).to_pylist(), words.counts.tolist(), terms.tobytes(), counts.astype(np.int32).tobytes(), step.astype(np.int32).tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, SHARD)], names=["shard", "doc_id", "keys", "n_words", "terms", "counts", "positions"])
                number += 1
        release()

    rows = with_key(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    return common.materialise(rows.mapInArrow(run, INDEX), "token-index")


SHARD = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.binary(), pa.binary()]


def one_by_one(batch: pa.RecordBatch):
    """The rows of a batch, each made when its turn comes, for rows are large."""
    for k in range(batch.num_rows):
        yield batch.slice(k, 1).to_pylist()[0]


class Queries:
    """The windows of a block of items, as numbers of terms.

    Window k has the ``length[k]`` terms ``flat[start[k]:]`` and belongs to item
    ``item[k]``.
    """

    def __init__(self, items: list[tuple[str | None, str | None]], window: int):
        words = Kernel(ALNUM, lower=True).words(pa.array([text or "" for _, text in items], type=pa.string()))
        self.terms = np.unique(words.hash)
        self.flat = np.searchsorted(self.terms, words.hash).astype(np.int32)
        n = np.where(words.counts > 0, np.maximum(1, words.counts - window + 1), 0)
        self.item = np.repeat(np.arange(len(items)), n)
        self.start = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(words.first[:-1], n)
        self.length = np.repeat(np.minimum(words.counts, window), n)
        self.ids = [None if item is None else str(item) for item, _ in items]
        self.window = window

    def rank(self, frequency: np.ndarray) -> None:
        """Order the terms of each window by how often all documents hold them."""
        at = self.start[:, None] + np.arange(self.window)
        inside = np.arange(self.window) < self.length[:, None]
        often = np.where(inside, frequency[self.flat[np.minimum(at, max(len(self.flat) - 1, 0))]] if len(self.flat) else 0, np.iinfo(np.int64).max)
        self.order = np.argsort(often, axis=1, kind="stable").astype(np.int16)
        # windows by their rarest term
        rarest = self.flat[self.start + self.order[:, 0]] if len(self.start) else np.zeros(0, np.int32)
        self.by_term = np.argsort(rarest, kind="stable")
        self.bounds = np.searchsorted(rarest[self.by_term], np.arange(len(self.terms) + 1))


class Shard:
    """A row of the index, its posting lists cut down to the terms of a block."""

    def __init__(self, row: dict, queries: Queries):
        self.doc_id, self.keys, n_words = row["doc_id"], row["keys"], np.array(row["n_words"], dtype=np.int64)
        self.first = np.concatenate([[0], np.cumsum(n_words)])
        terms, counts = np.frombuffer(row["terms"], dtype=np.uint64), np.frombuffer(row["counts"], dtype=np.int32).astype(np.int64)
        number = np.searchsorted(queries.terms, terms)
        number[number == len(queries.terms)] = 0
        own = np.flatnonzero(queries.terms[number] == terms) if len(queries.terms) else np.zeros(0, dtype=np.int64)
        begin = np.cumsum(counts) - counts
        n = counts[own]
        steps = np.frombuffer(row["positions"], dtype=np.int32)
        total = np.concatenate([[0], np.cumsum(steps, dtype=np.int64)])
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begin[own], n)
        #: Positions, list after list in the order of term numbers.
        self.positions = total[at + 1] - np.repeat(total[begin[own]], n)
        self.lengths = np.zeros(len(queries.terms), dtype=np.int64)
        self.lengths[number[own]] = n
        self.bounds = np.concatenate([[0], np.cumsum(self.lengths)])
        self.size = self.first[-1] + 1
        #: The same as one sorted list of (term, position).
        self.places = np.repeat(number[own], n) * self.size + self.positions

    def phrases(self, queries: Queries):
        """Numbers of windows and the positions at which their words stand in a row, in parts."""
        if not len(queries.start):
            return
        windows = np.diff(queries.bounds)
        # every posting of a term with every window of which it is the rarest
        term = np.repeat(np.arange(len(self.lengths)), self.lengths)
        n = windows[term]
        filled = np.flatnonzero(n)
        ends = np.cumsum(n[filled])
        at = 0
        while at < len(filled):
            stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, side="right")))
            part = filled[at:stop]
            m = n[part]
            position = np.repeat(self.positions[part], m)
            window = queries.by_term[np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m) + np.repeat(queries.bounds[term[part]], m)]
            begin = position - queries.order[window, 0]
            doc = self.document(position)
            fits = (begin >= self.first[doc]) & (begin + queries.length[window] <= self.first[doc + 1])
            window, begin = window[fits], begin[fits]
            for k in range(1, queries.window):
                more = queries.length[window] > k
                offset = queries.order[window, k]
                want = queries.flat[np.minimum(queries.start[window] + offset, len(queries.flat) - 1)].astype(np.int64) * self.size + begin + offset
                found = np.searchsorted(self.places, want)
                found[found == len(self.places)] = 0
                fits = ~more | (self.places[found] == want)
                window, begin = window[fits], begin[fits]
                if not len(window):
                    break
            yield window, begin
            at = stop

    def document(self, position: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, position, side="right") - 1

    def spread(self, gap: int) -> np.ndarray:
        """The postings with ``gap`` empty positions between documents."""
        return self.positions + self.document(self.positions) * gap

    def possibly_near(self, queries: Queries) -> list[int]:
        """Windows of which the shard holds as many terms as a proximity match asks for."""
        out = []
        for k in range(len(queries.start)):
            terms = np.unique(queries.flat[queries.start[k] : queries.start[k] + queries.length[k]])
            if (self.lengths[terms] > 0).sum() >= math.ceil(NEAR_SHARE * len(terms)):
                out.append(k)
        return out

    def near(self, window: np.ndarray, slop: int, spread: np.ndarray) -> np.ndarray:
        """Positions of the window's terms from which ``len(window) + slop`` words hold ``NEAR_SHARE`` of its terms.

        Which terms are rare in the shard decides where to look, never what is found.
        """
        terms, span = np.unique(window), len(window) + slop
        need = math.ceil(NEAR_SHARE * len(terms))
        lists = [spread[self.bounds[t] : self.bounds[t + 1]] for t in terms[np.argsort(self.lengths[terms], kind="stable")]]
        # a match lacks len(terms) - need terms at most, so it holds one of the rarest
        anchors = np.unique(np.concatenate(lists[: len(terms) - need + 1]))
        held = sum(np.searchsorted(x, anchors + span) > np.searchsorted(x, anchors - span + 1) for x in lists)
        anchors = anchors[held >= need]
        if not len(anchors):
            return anchors
        starts = []
        for x in lists:
            low, high = np.searchsorted(x, anchors - span + 1), np.searchsorted(x, anchors, side="right")
            n = high - low
            starts.append(x[np.repeat(high - np.cumsum(n), n) + np.arange(n.sum())])
        starts = np.unique(np.concatenate(starts))
        return starts[sum(np.searchsorted(x, starts + span) > np.searchsorted(x, starts) for x in lists) >= need]


def blocks_of(benchmark: DataFrame, block_chars: int) -> list[DataFrame]:
    """The items in parts of about ``block_chars`` characters each."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").distinct()
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = math.ceil(total / block_chars) or 1
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
    return [items.where(part == k) for k in range(n)]


def frequencies(index: DataFrame, terms: np.ndarray) -> np.ndarray:
    """How often each of a block's terms occurs in all documents."""
    shared = index.sparkSession.sparkContext.broadcast(terms)

    def run(batches):
        total = np.zeros(len(shared.value), dtype=np.int64)
        for batch in batches:
            for row in one_by_one(batch):
                own = np.frombuffer(row["terms"], dtype=np.uint64)
                at = np.searchsorted(shared.value, own)
                at[at == len(total)] = 0
                hit = shared.value[at] == own if len(total) else np.zeros(len(own), dtype=bool)
                np.add.at(total, at[hit], np.frombuffer(row["counts"], dtype=np.int32)[hit])
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], names=["term", "n"])

    found = index.select("terms", "counts").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(len(terms), dtype=np.int64)
    out[found.column("term").to_numpy()] = found.column("n").to_numpy()
    shared.destroy()
    return out


def broadcast_queries(index: DataFrame, block: DataFrame, window: int):
    """A block of benchmark items, ranked by term frequency, as plain data."""
    queries = Queries(sorted(((r[0], r[1]) for r in block.toLocalIterator()), key=str), window)
    queries.rank(frequencies(index, queries.terms))
    return index.sparkSession.sparkContext.broadcast(vars(queries))


def received(shared) -> Queries:
    queries = object.__new__(Queries)
    vars(queries).update(shared.value)
    return queries


def block_hits(index: DataFrame, shared) -> DataFrame:
    """shard, document number, runs of hit words and items found, of documents with hits."""

    def run(batches):
        queries = received(shared)
        for batch in batches:
            for row in one_by_one(batch):
                shard = Shard(row, queries)
                cover = np.zeros(shard.size, dtype=np.int64)
                owners = []
                for window, begin in shard.phrases(queries):
                    np.add.at(cover, begin, 1)
                    np.add.at(cover, begin + queries.length[window], -1)
                    owners.append(np.unique(shard.document(begin) * len(queries.ids) + queries.item[window]))
                hit = np.flatnonzero(np.cumsum(cover) > 0)
                doc = shard.document(hit)
                owner = np.unique(np.concatenate(owners)) if owners else np.zeros(0, dtype=np.int64)
                docs = np.unique(doc)
                low, high = (np.searchsorted(doc, docs, side=x) for x in ("left", "right"))
                packed = [runs(hit[a:b] - shard.first[d]).tobytes() for d, a, b in zip(docs, low, high)]
                low, high = (np.searchsorted(owner, (docs + k) * len(queries.ids)) for k in (0, 1))
                names = [queries.ids[i] for i in (owner % len(queries.ids)).tolist()] if len(owner) else []
                items = [[x for x in names[a:b] if x is not None] for a, b in zip(low, high)]
                yield pa.RecordBatch.from_arrays([pa.array([row["shard"]] * len(docs), pa.int64()), pa.array(docs, pa.int32()), pa.array(packed, pa.binary()), pa.array(items, pa.list_(pa.string()))], names=["shard", "number", "runs", "items"])
        release()

    return index.mapInArrow(run, "shard long, number int, runs binary, items array<string>")


def hits(index: DataFrame, benchmark: DataFrame, window: int, block_chars: int) -> DataFrame:
    """shard, number, n_hit, items of documents with hits, added up over all blocks."""
    found = None
    for block in blocks_of(benchmark, block_chars):
        shared = broadcast_queries(index, block, window)
        part = common.materialise(block_hits(index, shared), "benchmark-hits")
        shared.destroy()
        found = part if found is None else found.unionByName(part)

    def total(batches):
        for batch in batches:
            n = []
            for parts in batch.column("runs").to_pylist():
                pairs = np.concatenate([np.frombuffer(x, dtype=np.int32).reshape(-1, 2) for x in parts])
                pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
                reach = np.maximum.accumulate(pairs[:, 1])
                begin = np.maximum(pairs[:, 0], np.concatenate([[0], reach[:-1]]))
                n.append(int(np.maximum(pairs[:, 1] - begin, 0).sum()))
            yield pa.RecordBatch.from_arrays([batch.column("shard"), batch.column("number"), pa.array(n, pa.int64()), batch.column("items")], names=["shard", "number", "n_hit", "items"])

    merged = found.groupBy("shard", "number").agg(F.collect_list("runs").alias("runs"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    return common.materialise(merged.mapInArrow(total, "shard long, number int, n_hit long, items array<string>"), "hits")


def judged(docs: DataFrame, benchmark: DataFrame, window: int, block_chars: int) -> DataFrame:
    """doc_id, text key, n_words, n_hit, items and contaminated of every row."""
    index = build_index(docs)
    own = index.select("shard", F.posexplode(F.arrays_zip("doc_id", "keys", "n_words")).alias("number", "doc"))
    own = own.select("shard", "number", F.col("doc.doc_id").alias("doc_id"), F.col("doc.keys").alias(KEY), F.col("doc.n_words").cast("long").alias("n_words"))
    rows = common.sized_join(own, hits(index, benchmark, window, block_chars), ["shard", "number"], "left")
    rows = rows.select("doc_id", KEY, "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))
    return rows.withColumn("contaminated", F.expr("n_hit > 0 and 20 * n_hit >= n_words"))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row per document: its words, those inside benchmark windows, and the items found.

    A document is contaminated if at least one word in twenty is hit.
    """
    rows = judged(docs, benchmark, window, block_chars)
    return rows.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")


def clean_documents(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of ``docs``, all columns, that are not contaminated; each is judged by its own text."""
    found = judged(docs, benchmark, window, block_chars).where("contaminated").select(F.col("doc_id").alias("gone"), F.col(KEY).alias("gone_key")).distinct()
    found = common.materialise(found, "contaminated")
    return common.sized_join(with_key(docs), found, F.expr(f"cast(doc_id as long) <=> gone and {KEY} = gone_key"), "left_anti").select(*docs.columns)


def matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, slop: int = 0, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Every exact phrase match and, with ``slop`` words, every proximity match.

    ``start`` is a word number within the document, counted from 0.  A proximity
    match is each of the window's words from which on as many words as the window
    has, and ``slop`` more, hold ``NEAR_SHARE`` of its distinct terms, in any order.
    """

    def scan(shared):
        def run(batches):
            queries = received(shared)
            gap = queries.window + slop + 1
            for batch in batches:
                for row in one_by_one(batch):
                    shard, out = Shard(row, queries), []

                    def add(kind, window, position):
                        doc = shard.document(position)
                        out.extend((shard.doc_id[d], queries.ids[queries.item[k]], kind, int(p - shard.first[d]), int(queries.length[k])) for k, p, d in zip(window, position, doc))

                    for window, begin in shard.phrases(queries):
                        add("exact", window, begin)
                    spread = shard.spread(gap) if slop else None
                    spread_first = shard.first[:-1] + np.arange(len(shard.first) - 1) * gap
                    for k in shard.possibly_near(queries) if slop else []:
                        own = queries.flat[queries.start[k] : queries.start[k] + queries.length[k]]
                        found = shard.near(own, slop, spread)
                        found = found - (np.searchsorted(spread_first, found, side="right") - 1) * gap
                        add("near", [k] * len(found), found)
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 5, (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()))], names=["doc_id", "item_id", "kind", "start", "length"])

        return run

    index = build_index(docs)
    parts = [index.mapInArrow(scan(broadcast_queries(index, b, window)), MATCHES) for b in blocks_of(benchmark, block_chars)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.distinct()
