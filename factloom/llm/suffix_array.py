"""Removal of repeated byte strings, by a distributed sort of sampled suffixes.

A string of ``length`` bytes is judged by the suffixes that start inside it.  Of
these one is its anchor: the leftmost whose first ``GRAM`` bytes have the smallest
hash.  Equal strings have their anchors at equal places, so only suffixes at
anchors are kept, some four in a hundred.  A record stands for an anchor and for
the run of neighbouring strings that share it; its tokens are names (64-bit
hashes) of the anchor's first ``GRAM`` bytes and of all bytes of its run.

Splitters sampled from the records range-partition them by leading tokens, then by
document and place, so that a token that very many records share is spread over as
many buckets as it needs.  A bucket is sorted in its task by multikey quicksort,
token after token, and scanned: records with both tokens equal are copies of the
first of them, whose strings are all repeats; first records whose leading token
stands under another run too stay open.  What a bucket cannot tell by itself, since
a token goes on across its first or last record, is settled from one summary a
bucket.  The strings of open records are then named one by one, beside their anchor,
and sorted and scanned in the same way.

Texts that equal an earlier one as a whole are settled by a digest before.

Defined cases: matches stay inside a row's text, null counts as empty; texts below
``length`` bytes lose nothing; rows with a null ``doc_id`` lose nothing and cause no
removal; rows that repeat a ``doc_id`` count as one document, so of two places in
them the smaller one is the earlier, and places that tie are both kept.  Texts of
any length are handled in pieces that overlap, so beside the text itself a task
holds a piece's figures.  Columns other than ``doc_id`` and ``text`` are not read,
whatever their names.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .common import KEY, release
from .textkernel import TABLE, U64, Powers, buffer_of, mix

LENGTH, GRAM = 100, 48
#: Bytes of text handled at once.
PIECE = 1 << 19
#: Records of a bucket, which one task sorts in memory; clusters with more memory take more.
BUCKET_ROWS = 1 << 19
#: Intervals packed into a row's cover; a name that tables do not have.
COVER = "__factloom_cover"

RECORDS = f"t0 long, t1 long, doc_id long, {KEY} long, pos int, n int"
#: States of scanned records: repeats, open ones, ones that depend on other buckets, and a bucket's summary.
REPEAT, OPEN, DEPENDS, SUMMARY = range(4)
#: What a record that depends on others belongs to: the bucket's first group, its first token, its last token.
FIRST_GROUP, FIRST_TOKEN, LAST_TOKEN = 1, 2, 4


class Names:
    """Names of byte ranges of one piece: polynomial hashes over prefix sums, two kinds."""

    powers = None

    def __init__(self, data: np.ndarray):
        if Names.powers is None:
            Names.powers = Powers(0x9E3779B97F4A7C15), Powers(0xAF251AF3B0F025B5)
        self.n, self.totals = len(data), []
        for powers in Names.powers:
            up, _ = powers.get(self.n + 1)
            total = np.zeros(self.n + 1, dtype=U64)
            np.cumsum(TABLE[data] * up[: self.n], out=total[1:])
            self.totals.append(total)

    def of(self, start: np.ndarray, stop: np.ndarray, kind: int) -> np.ndarray:
        _, down = Names.powers[kind].get(self.n + 1)
        total = self.totals[kind]
        return mix((total[stop] - total[start]) * down[start] + (stop - start).astype(U64))


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Smallest of each ``width`` neighbours, from blocks' running minima of both directions."""
    blocks = np.concatenate([values, np.full(-len(values) % width, U64(0xFFFFFFFFFFFFFFFF))]).reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    n = len(values) - width + 1
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def anchors(data: np.ndarray, starts: np.ndarray, stops: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Records of the strings that lie between each start and stop: t0, t1, first string's place and number of strings."""
    names = Names(data)
    n = len(data) - gram + 1
    at = np.arange(max(n, 0))
    hashes = names.of(at, at + gram, 0)
    # the high half decides, the place breaks ties
    least = sliding_least((hashes & U64(0xFFFFFFFF00000000)) | at.astype(U64), length - gram + 1)
    inside = np.zeros(len(least) + 1, dtype=np.int64)
    fits = stops - starts >= length
    np.add.at(inside, starts[fits], 1)
    np.add.at(inside, stops[fits] - length + 1, -1)
    place = np.flatnonzero(np.cumsum(inside[:-1]) > 0)
    anchor = (least[place] & U64(0xFFFFFFFF)).astype(np.int64)
    fresh = np.ones(len(place), dtype=bool)
    fresh[1:] = (anchor[1:] != anchor[:-1]) | (place[1:] != place[:-1] + 1)
    first = np.flatnonzero(fresh)
    last = np.append(first[1:], len(place))[: len(first)] - 1
    begin, end = place[first], place[last]
    return hashes[anchor[first]], names.of(begin, end + length, 1), begin, end - begin + 1


def pieces(column: pa.Array, length: int):
    """(bytes, starts, stops, rows, shifts) of runs of texts, and of overlapping parts of long ones, at most about ``PIECE`` bytes each.

    The strings that start in a part begin at ``starts``; ``shifts`` is where the part begins in its text.
    """
    data, offsets = buffer_of(column)
    row, rows = 0, len(column)
    while row < rows:
        stop = int(np.searchsorted(offsets, offsets[row] + PIECE, side="right")) - 1
        if stop > row:
            stop = min(stop, rows)
            own = offsets[row : stop + 1] - offsets[row]
            yield data[offsets[row] : offsets[stop]], own[:-1], own[1:], np.arange(row, stop), np.zeros(stop - row, dtype=np.int64)
            row = stop
            continue
        a, b = int(offsets[row]), int(offsets[row + 1])
        for at in range(a, b, PIECE):
            part = data[at : min(at + PIECE + length - 1, b)]
            yield part, np.array([0]), np.array([len(part)]), np.array([row]), np.array([at - a])
        row += 1


def records(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """The anchors' records of every text."""

    def run(batches):
        for batch in batches:
            ids, keys = batch.column("doc_id"), batch.column(KEY)
            for data, starts, stops, rows, shifts in pieces(batch.column("text"), length):
                if len(data) < length:
                    continue
                t0, t1, begin, n = anchors(data, starts, stops, length, gram)
                doc = np.searchsorted(starts, begin, side="right") - 1
                owner = pa.array(rows[doc])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(t0.view(np.int64)), pa.array(t1.view(np.int64)), ids.take(owner), keys.take(owner), pa.array((begin - starts[doc] + shifts[doc]).astype(np.int32)), pa.array(n.astype(np.int32))],
                    names=[c.split()[0] for c in RECORDS.split(", ")],
                )
        release()

    return docs.mapInArrow(run, RECORDS)


def open_runs(opened: DataFrame) -> DataFrame:
    """doc_id, text key and COVER, the packed runs of strings of open records with their anchors' names."""
    return common.materialise(opened.groupBy("doc_id", KEY).agg(F.collect_list(F.struct("t0", "pos", "n")).alias(COVER)), "open-runs")


def strings(docs: DataFrame, runs: DataFrame, length: int) -> DataFrame:
    """A record for every string of the open runs: its anchor's name and the name of its bytes are its tokens."""

    def run(batches):
        for batch in batches:
            ids, keys, cover = batch.column("doc_id"), batch.column(KEY), batch.column(COVER)
            bounds, (anchor, first, count) = cover.offsets.to_numpy(), (x.to_numpy().astype(np.int64) for x in cover.values.flatten())
            for data, starts, stops, rows, shifts in pieces(batch.column("text"), length):
                if len(data) < length:
                    continue
                names, out = Names(data), []
                for start, stop, row, shift in zip(starts, stops, rows, shifts):
                    a, b = bounds[row], bounds[row + 1]
                    # the part of each run that starts in this piece
                    low = np.maximum(first[a:b], shift)
                    some = np.maximum(np.minimum(first[a:b] + count[a:b], shift + stop - start - length + 1) - low, 0)
                    own = np.repeat(low - np.cumsum(some) + some, some) + np.arange(some.sum())
                    out.append((np.repeat(anchor[a:b], some), own, own - shift + start, np.full(len(own), row)))
                t0, own, here, owner = (np.concatenate(c) for c in zip(*out))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(t0), pa.array(names.of(here, here + length, 1).view(np.int64)), ids.take(pa.array(owner)), keys.take(pa.array(owner)), pa.array(own.astype(np.int32)), pa.array(np.ones(len(own), dtype=np.int32))],
                    names=[c.split()[0] for c in RECORDS.split(", ")],
                )
        release()

    return docs.join(runs.hint("merge"), ["doc_id", KEY]).select("doc_id", KEY, "text", COVER).mapInArrow(run, RECORDS)


def multikey_order(tokens: list[np.ndarray]) -> np.ndarray:
    """Order by the first token, then by the next one among rows that are equal so far, and so on."""
    order = np.argsort(tokens[0])
    equal = np.zeros(len(order), dtype=np.int64)  # number of each row's group of equal rows
    for k in range(1, len(tokens)):
        before = tokens[k - 1][order]
        equal = np.cumsum(np.concatenate([[0], (before[1:] != before[:-1]) | (equal[1:] != equal[:-1])])) if len(order) else equal
        several = np.flatnonzero(np.bincount(equal)[equal] > 1) if len(order) else order
        if not len(several):
            break
        rows = order[several]
        order[several] = rows[np.lexsort((tokens[k][rows], equal[several]))]
    return order


def scan(t0, t1, doc, pos, runs: bool) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """States, places in the bucket (what a record depends on) and summary of a sorted bucket.

    ``runs``: whether first records stay open where their leading token has other runs.
    """
    n = len(t0)
    token = np.concatenate([[True], t0[1:] != t0[:-1]])
    group = token | np.concatenate([[True], t1[1:] != t1[:-1]])
    token_no, group_no = np.cumsum(token) - 1, np.cumsum(group) - 1
    head = np.flatnonzero(group)[group_no]  # first record of each record's group
    first = (doc == doc[head]) & (pos == pos[head])
    groups = np.bincount(token_no, weights=group).astype(np.int64)
    shared = groups[token_no] > 1
    where = FIRST_GROUP * (group_no == 0) + FIRST_TOKEN * (token_no == 0) + LAST_TOKEN * (token_no == token_no[-1])
    state = np.where(first, np.where(shared & runs, OPEN, -1), REPEAT)
    unsure = first & ((group_no == 0) | (runs & ~shared & (where > 0)))
    state = np.where(unsure, DEPENDS, state)
    return state, where + 8 * shared, [int(t0[0]), int(t1[0]), int(t0[-1]), int(t1[-1]), int(min(groups[0], 2)), int(min(groups[-1], 2)), int(token_no[-1] == 0)]


def scanned(rows: DataFrame, n: int, runs: bool) -> DataFrame:
    """States of records after the range-partitioned sort, with ``bucket`` and ``belongs``; records that are unique are left out."""

    def run(batches):
        columns = [[] for _ in range(6)]
        for batch in batches:
            for held, column in zip(columns, batch.columns):
                held.append(column.to_numpy())
        if not columns[0]:
            return
        t0, t1, doc, key, pos, count = (np.concatenate(c) for c in columns)
        del columns
        order = multikey_order([t0, t1, doc, pos])
        t0, t1, doc, key, pos, count = (c[order] for c in (t0, t1, doc, key, pos, count))
        state, belongs, summary = scan(t0, t1, doc, pos, runs)
        keep, bucket = np.flatnonzero(state >= 0), TaskContext.get().partitionId()
        for at in range(0, len(keep), 1 << 16):
            own = keep[at : at + (1 << 16)]
            yield result(state[own], bucket, belongs[own], t0[own], doc[own], key[own], pos[own], count[own], [None] * len(own))
        yield result([SUMMARY], bucket, [0], [0], [0], [0], [0], [0], [summary])
        release()

    def result(state, bucket, belongs, t0, doc, key, pos, count, summary):
        kinds = pa.int8(), pa.int32(), pa.int8(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip((state, np.full(len(state), bucket), belongs, t0, doc, key, pos, count, summary), kinds)], names=["state", "bucket", "belongs", "t0", "doc_id", KEY, "pos", "n", "summary"])

    buckets = max(rows.sparkSession.sparkContext.defaultParallelism, math.ceil(n / BUCKET_ROWS))
    dealt = rows.repartitionByRange(buckets, "t0", "t1", "doc_id", "pos")
    return dealt.mapInArrow(run, f"state byte, bucket int, belongs byte, t0 long, doc_id long, {KEY} long, pos int, n int, summary array<long>")


def across(summaries: list[tuple[int, list[int]]]) -> list[tuple[int, bool, bool, bool]]:
    """bucket, whether its first group began before it, whether its first and its last token have several runs; from the summaries in order."""
    out, chain, several, before = [], [], False, None
    marks: dict[int, list[bool]] = {}

    def close():
        for bucket, which in chain:
            marks[bucket][which] |= several

    for bucket, (t0, t1, last0, last1, n_first, n_last, single) in summaries:
        goes_on = before is not None and before[0] == t0
        marks[bucket] = [goes_on and before[1] == t1, False, False]
        if not goes_on:
            close()
            chain, several = [], False
        several |= n_first > 1 or (goes_on and before[1] != t1)
        chain.append((bucket, 1))
        if single:
            chain.append((bucket, 2))
        else:
            close()
            chain, several = [(bucket, 2)], n_last > 1
        before = last0, last1
    close()
    for bucket, found in marks.items():
        out.append((bucket, *found))
    return out


def settled(found: DataFrame) -> DataFrame:
    """``found`` with the records that depended on other buckets decided; one row a bucket goes through the driver."""
    summaries = found.where(f"state = {SUMMARY}").select("bucket", "summary").orderBy("bucket").collect()
    flags = found.sparkSession.createDataFrame(across([(b, s) for b, s in summaries]), "bucket int, goes_on boolean, first_several boolean, last_several boolean")
    has = lambda bit: F.col("belongs").bitwiseAND(bit) > 0
    several = has(8) | (has(FIRST_TOKEN) & F.col("first_several")) | (has(LAST_TOKEN) & F.col("last_several"))
    state = F.when(has(FIRST_GROUP) & F.col("goes_on"), REPEAT).when(several, OPEN)
    unsure = found.where(f"state = {DEPENDS}").join(F.broadcast(flags), "bucket").withColumn("state", state.cast("byte"))
    columns = "state", "t0", "doc_id", KEY, "pos", "n"
    return found.where(f"state < {DEPENDS}").select(*columns).unionByName(unsure.select(*columns))


def covered(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """doc_id, text key and COVER, the packed begin and end of every run of removed bytes; rows without one are left out."""
    rows = common.materialise(records(docs, length, gram), "suffixes")
    found = common.materialise(scanned(rows, rows.count(), runs=True), "scanned-suffixes")
    common.discard(rows)
    known = settled(found)
    runs = open_runs(known.where(f"state = {OPEN}"))
    rows = common.materialise(strings(docs, runs, length), "strings")
    common.discard(runs)
    again = common.materialise(scanned(rows, rows.count(), runs=False), "scanned-strings")
    common.discard(rows)
    repeats = known.unionByName(settled(again)).where(f"state = {REPEAT}")
    packed = repeats.groupBy("doc_id", KEY).agg(F.array_sort(F.collect_list(F.struct("pos", "n"))).alias("at"))

    def run(batches):
        for batch in batches:
            at = batch.column("at")
            bounds, (first, count) = at.offsets.to_numpy(), (x.to_numpy().astype(np.int64) for x in at.values.flatten())
            out = []
            for a, b in zip(bounds, bounds[1:]):
                begin, end = first[a:b], first[a:b] + count[a:b] + length - 1
                end = np.maximum.accumulate(end)
                cut = np.flatnonzero(begin[1:] > end[:-1])
                out.append(np.stack([begin[np.concatenate([[0], cut + 1])], end[np.concatenate([cut, [len(end) - 1]])]], axis=1).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column(KEY), pa.array(out, pa.binary())], names=["doc_id", KEY, COVER])
        release()

    out = common.materialise(packed.mapInArrow(run, f"doc_id long, {KEY} long, {COVER} binary"), "covers")
    common.discard(found, again)
    return out


def whole_copies(docs: DataFrame) -> DataFrame:
    """doc_id, text key of texts that equal one of a smaller doc_id."""
    texts = docs.select("doc_id", KEY, F.md5("text").alias("digest"))
    first = common.materialise(texts.groupBy("digest").agg(F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc")).where("first_doc < last_doc").drop("last_doc"), "repeated-texts")
    found = texts.join(first.hint("merge"), "digest").where("doc_id > first_doc").select("doc_id", KEY).distinct()
    return common.materialise(found, "copies")


def removals(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the digest of the remaining bytes of every row."""
    docs = common.with_short_key(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    able = docs.where(f"doc_id is not null and octet_length(text) >= {length}")
    copies = whole_copies(able)
    rest = common.sized_join(able, copies, ["doc_id", KEY], "left_anti")
    if not rest.groupBy("doc_id", KEY).count().where("count > 1").isEmpty():
        rest = rest.dropDuplicates(["doc_id", KEY])  # identical rows of one id are one text
    covers = covered(rest, length, gram)
    # an end of -1 stands for the whole text
    covers = covers.unionByName(copies.withColumn(COVER, F.lit(np.array([[0, -1]], dtype=np.int64).tobytes())))

    def run(batches):
        for batch in batches:
            data, offsets = buffer_of(batch.column("text"))
            rows = []
            for k, cover in enumerate(batch.column(COVER).to_pylist()):
                text = data[offsets[k] : offsets[k + 1]]
                spans = np.frombuffer(cover or b"", dtype=np.int64).reshape(-1, 2)
                if len(spans) and spans[0, 1] < 0:
                    spans = np.array([[0, len(text)]])
                kept, at = hashlib.sha256(), 0
                for begin, end in spans:
                    kept.update(text[at:begin])
                    at = end
                kept.update(text[at:])
                rows.append((len(text), int((spans[:, 1] - spans[:, 0]).sum()), len(spans), kept.hexdigest()))
            if not rows:
                continue
            sizes, removed, n_spans, digests = zip(*rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(digests)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])
        release()

    return docs.join(covers.hint("merge"), ["doc_id", KEY], "left").select("doc_id", "text", COVER).mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
