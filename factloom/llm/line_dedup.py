"""Fuzzy line dedup: MinHash, banding, exact verification, union-find.

A line's set is its character shingles.  One-permutation MinHash gives each
line a signature in one pass over its characters; lines that agree in a band
of the signature are candidates.  Lines sharing a band form families, in which
the exact Jaccard similarity decides (see ``prefix_trie``), so a false
candidate costs time only.  Distributed union-find joins the links, and the
first line of each component, by ``doc_id`` and line number, is the one kept.

Equal lines are one item throughout.  With 8 bands of 4 rows, a pair of
independent rows at the threshold of 0.8 is missed with probability 0.015, at
0.9 with 0.0002; measured, of pairs of 30 to 400 characters between 0.80 and
0.86, 0.2 % at most.

Lines are the parts of a text between newlines, without the white space at
their ends.  Defined cases: lines without a word are kept and take no part;
null texts have no lines; a line shorter than a shingle is one shingle; rows
with a null ``doc_id`` are left alone; rows that repeat ``doc_id`` and text are
one document, while different texts of one id are told apart, in the order of
their hashes.  Extra columns pass through.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, components, prefix_trie
from .common import KEY, release, with_short_key
from .spans import RUNS, by_document, with_runs
from .textkernel import SPACED, TABLE, U64, Powers, buffer_of, mix, slices

SHINGLE = 7
BANDS, ROWS = 8, 4
SIMILARITY = 80
#: Families of so few lines are compared pair by pair.
SMALL = 12
_CODE_BASE = 0xA24BAED4963EE407
LINE_BASE = 0x9E3779B97F4A7C15
EMPTY = np.uint32(0xFFFFFFFF)


class Lines:
    """The worded lines of a slice of texts: byte range, document, number in it."""

    def __init__(self, texts: pa.Array):
        data, offsets = buffer_of(texts)
        n = len(offsets) - 1
        cuts = np.flatnonzero(data == 10)
        # a text's first line starts with it, the others after its newlines
        owner = np.concatenate([np.arange(n), np.searchsorted(offsets, cuts, side="right") - 1])
        start = np.concatenate([offsets[:-1], cuts + 1])
        order = np.lexsort((start, owner))
        start, doc = start[order], owner[order]
        end = np.empty_like(start)
        end[:-1] = start[1:] - 1
        last = np.ones(len(start), dtype=bool)
        last[:-1] = doc[1:] != doc[:-1]
        end[last] = offsets[doc[last] + 1]
        number = np.arange(len(start)) - np.searchsorted(doc, np.arange(n))[doc]
        # white space at the ends goes, a character a round
        space = ~SPACED
        while len(at := np.flatnonzero((start < end) & space[data[np.minimum(start, len(data) - 1)]] if len(data) else [])):
            start[at] += 1
        while len(at := np.flatnonzero((start < end) & space[data[np.maximum(end, 1) - 1]] if len(data) else [])):
            end[at] -= 1
        worded = start < end
        self.data, self.start, self.end, self.doc, self.number = data, start[worded], end[worded], doc[worded], number[worded].astype(np.int32)

    def items(self, powers: Powers) -> np.ndarray:
        """64-bit hash of each line's bytes."""
        up, down = powers.get(len(self.data) + 1)
        total = np.zeros(len(self.data) + 1, dtype=U64)
        np.cumsum(TABLE[self.data] * up[: len(self.data)], out=total[1:])
        return mix((total[self.end] - total[self.start]) * down[self.start]).view(np.int64)


def _mixed_codes() -> np.ndarray:
    return mix(np.arange(1, 65537, dtype=U64))


class Shingles:
    """Character shingles of texts given as byte ranges of a buffer."""

    def __init__(self, shingle: int = SHINGLE):
        self.shingle, self.powers, self.mixed = shingle, Powers(_CODE_BASE), _mixed_codes()

    def of(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hash of every shingle, and the range it belongs to."""
        codes = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), dtype=np.uint32)
        at_code = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        start, end = at_code[start], at_code[end]
        up, down = self.powers.get(len(codes) + 1)
        total = np.zeros(len(codes) + 1, dtype=U64)
        wide = codes > 65535
        value = self.mixed[np.where(wide, 0, codes)]
        if wide.any():
            value[wide] = mix(codes[wide].astype(U64) + U64(1))
        np.cumsum(value * up[: len(codes)], out=total[1:])
        n = np.maximum(1, end - start - self.shingle + 1)
        owner = np.repeat(np.arange(len(n)), n)
        at = np.arange(n.sum()) + np.repeat(start - np.concatenate([[0], np.cumsum(n)[:-1]]), n) if len(n) else np.zeros(0, int)
        stop = np.minimum(at + self.shingle, end[owner])
        return mix((total[stop] - total[at]) * down[at]), owner


def distinct(values: np.ndarray) -> np.ndarray:
    """The sorted distinct values of a short array."""
    values = np.sort(values)
    new = np.ones(len(values), dtype=bool)
    new[1:] = values[1:] != values[:-1]
    return values[new]


def signatures(hashes: np.ndarray, owner: np.ndarray, n: int, size: int) -> np.ndarray:
    """One-permutation MinHash with empty bins filled from the next full one."""
    bins = ((hashes >> U64(32)) * U64(size) >> U64(32)).astype(np.int64)
    out = np.full(n * size, EMPTY, dtype=np.uint32)
    np.minimum.at(out, owner * size + bins, (hashes & U64(0xFFFFFFFE)).astype(np.uint32))
    out = out.reshape(n, size)
    rows = np.flatnonzero((out == EMPTY).any(axis=1))
    given = out[rows]
    filled = given.copy()
    for step in range(1, size):
        open_ = filled == EMPTY
        if not open_.any():
            break
        source = np.roll(given, -step, axis=1)
        take = open_ & (source != EMPTY)
        filled[take] = (mix(source[take].astype(U64) + U64(step << 32)) & U64(0xFFFFFFFE)).astype(np.uint32)
    out[rows] = filled
    return out


def bands_of(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key per row and band."""
    out = np.tile(np.arange(1, bands + 1, dtype=U64), (len(signature), 1))
    for k in range(rows):
        out = mix(out * U64(0x9E3779B97F4A7C15) + signature[:, k::rows][:, :bands])
    return out


def lines_and_bands(docs: DataFrame, shingle: int, bands: int, rows: int) -> DataFrame:
    """item, doc_id, text key, pos of every worded line; the first of an item in a slice has its bands."""

    def run(batches):
        powers, shingles = Powers(LINE_BASE), Shingles(shingle)
        for batch in batches:
            for part in slices(batch, "text"):
                lines = Lines(part.column("text"))
                item, owner = lines.items(powers), pa.array(lines.doc)
                once = np.sort(np.unique(item, return_index=True)[1])
                hashes, of = shingles.of(lines.data, lines.start[once], lines.end[once])
                keys = bands_of(signatures(hashes, of, len(once), bands * rows), bands, rows).reshape(-1).view(np.int64)
                first = np.zeros(len(item), dtype=bool)
                first[once] = True
                offsets = pa.array(np.concatenate([[0], np.cumsum(first) * bands]).astype(np.int32), mask=np.append(~first, False))
                columns = [pa.array(item), part.column("doc_id").take(owner), part.column(KEY).take(owner), pa.array(lines.number), pa.ListArray.from_arrays(offsets, pa.array(keys))]
                yield pa.RecordBatch.from_arrays(columns, names=["item", "doc_id", KEY, "pos", "bands"])
        release()

    return docs.mapInArrow(run, f"item long, doc_id long, {KEY} long, pos int, bands array<long>")


def line_texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """item and data (its UTF-8 bytes) of the wanted lines.

    Few wanted items travel to the scan; more are joined.
    """
    few = wanted.limit(common.BROADCAST_ROWS + 1).toArrow().column("item")
    shared = None
    if len(few) <= common.BROADCAST_ROWS:
        shared = docs.sparkSession.sparkContext.broadcast(np.sort(few.to_numpy()))

    def run(batches):
        powers = Powers(LINE_BASE)
        known = shared.value if shared else None
        for batch in batches:
            for part in slices(batch, "text"):
                lines = Lines(part.column("text"))
                item, once = np.unique(lines.items(powers), return_index=True)
                if known is not None:
                    at = np.searchsorted(known, item)
                    at[at == len(known)] = 0
                    hit = known[at] == item if len(known) else np.zeros(len(item), bool)
                    item, once = item[hit], once[hit]
                yield pa.RecordBatch.from_arrays([pa.array(item), pa.array([lines.data[a:b].tobytes() for a, b in zip(lines.start[once], lines.end[once])], pa.binary())], names=["item", "data"])
        release()

    out = docs.select("text").mapInArrow(run, "item long, data binary")
    return out if shared else out.join(wanted, "item", "left_semi")


def repeats(docs: DataFrame, shingle: int = SHINGLE, bands: int = BANDS, rows: int = ROWS, similarity: int = SIMILARITY) -> DataFrame:
    """doc_id, text key and the runs of line numbers that repeat an earlier line, exactly or nearly.

    ``docs`` have their text key.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", KEY).where("doc_id is not null")
    both = common.materialise(lines_and_bands(docs, shingle, bands, rows), "lines")
    found, posted = both.select("item", "doc_id", KEY, "pos"), both.select(F.explode("bands").alias("band"), "item")
    alive = posted.groupBy("band").agg(F.min("item").alias("leader"), F.max("item").alias("other")).where("leader != other").select("band", "leader")
    alive = common.materialise(alive, "shared-bands")  # so that the join may split hot keys
    members = common.materialise(posted.join(alive, "band").select("leader", "item").distinct(), "line-members")
    texts = common.materialise(line_texts(docs, members.select("item").distinct()).dropDuplicates(["item"]), "line-texts")
    common.discard(alive)

    def to_sets(data):
        kernel = Shingles(shingle)
        bounds = np.concatenate([[0], np.cumsum([len(d) for d in data])]).astype(np.int64)
        hashes, owner = kernel.of(np.frombuffer(b"".join(data), dtype=np.uint8), bounds[:-1], bounds[1:])
        cuts = np.searchsorted(owner, np.arange(len(data) + 1))
        return [distinct(hashes[a:b]) for a, b in zip(cuts, cuts[1:])]

    links = prefix_trie.join_families(members, texts, similarity, to_sets, small=SMALL)
    roots = components.connected(links).withColumnRenamed("node", "item")
    common.discard(members, texts)
    grouped = common.sized_join(found, roots, "item", "left").select(F.coalesce("root", "item").alias("group"), F.struct("doc_id", KEY, "pos").alias("place"))
    first = grouped.groupBy("group").agg(F.min("place").alias("first"), F.max("place").alias("last")).where("first < last").select("group", "first")
    first = common.materialise(first, "first-lines")
    later = grouped.join(first, "group").where("place > first").select("place.*")
    out = common.materialise(by_document(later), "repeated-lines")
    common.discard(both, first)
    return out


def _kept_lines(part: pa.RecordBatch):
    """Per row: worded lines, removed lines, and the text left."""
    worded = np.bincount(Lines(part.column("text")).doc, minlength=part.num_rows)
    for k, (text, packed) in enumerate(zip(part.column("text").to_pylist(), part.column(RUNS).to_pylist())):
        if not packed:
            yield int(worded[k]), 0, text
            continue
        lines = text.split("\n")
        gone = np.zeros(len(lines), dtype=bool)
        for begin, end in np.frombuffer(packed, dtype=np.int32).reshape(-1, 2):
            gone[begin:end] = True
        yield int(worded[k]), int(gone.sum()), "\n".join(x for x, y in zip(lines, gone) if not y)


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed and kept_sha256 of every row; null text counts as empty."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                rows = [(n, gone, hashlib.sha256((text or "").encode()).hexdigest()) for n, gone, text in _kept_lines(part)]
                n, gone, sha = zip(*rows)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha)], names=["doc_id", "n_lines", "n_removed", "kept_sha256"])
        release()

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    own = with_short_key(own)
    return with_runs(own, repeats(own), "left").select("doc_id", "text", RUNS).mapInArrow(run, "doc_id long, n_lines long, n_removed long, kept_sha256 string")


def deduplicated(docs: DataFrame) -> DataFrame:
    """``docs`` with the repeated lines taken out of ``text``; ``n_chars`` follows if it is there.

    A document of which every worded line repeats an earlier one is dropped.
    """
    schema = docs.schema

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                rows = list(_kept_lines(part))
                out = {name: part.column(name) for name in schema.names}
                out["text"] = pa.array([text for _, _, text in rows], part.column("text").type)
                if "n_chars" in out:
                    changed = pa.array([gone > 0 for _, gone, _ in rows])
                    out["n_chars"] = pc.if_else(changed, pa.array([len(text or "") for _, _, text in rows]).cast(out["n_chars"].type), out["n_chars"])
                batch_out = pa.RecordBatch.from_arrays(list(out.values()), names=list(out))
                yield batch_out.filter(pa.array([gone == 0 or gone < n for n, gone, _ in rows]))
        release()

    keyed = with_short_key(docs)
    return with_runs(keyed, repeats(keyed), "left").select(*schema.names, RUNS).mapInArrow(run, schema)
