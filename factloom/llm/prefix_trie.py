"""Exact set-similarity join by prefix trie, in families of bounded blocks.

A family is a set of items that share a rare element, so every pair that may be
similar meets in at least one family.  Families are cut into blocks of bounded
items and bytes, joined in groups of one or two blocks: the sets of a group form
a path-compressed trie over the global element order (most frequent elements
first, for long shared paths).  All probing sets walk down the trie together:
the overlap of a shared path is counted once, and a subtree is left as soon as
no remaining length can lift a probe to the threshold.

Groups return the components of their links as stars, which keeps them whole,
and pairs of blocks are only formed for what one block and the family's leader
leave unconnected.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, components
from .common import release

#: Items of one block of a family, and about the bytes of their sets.
BLOCK, BLOCK_BYTES = 256, 16_000_000
#: Bytes of sets made ready at once.
CHUNK = 1 << 19
#: Cells of the membership table of the probes that walk together.
CELLS = 12_000_000


class Trie:
    """Path-compressed trie over integer sequences, nodes in breadth-first order."""

    def __init__(self, sequences: list[np.ndarray]):
        order = sorted(range(len(sequences)), key=lambda k: sequences[k].astype(">u4").tobytes())
        rows = [sequences[k] for k in order]
        lengths = np.array([len(r) for r in rows])
        shared = np.zeros(len(rows), dtype=np.int64)  # with the row before
        for k in range(1, len(rows)):
            m = min(lengths[k - 1], lengths[k])
            differs = rows[k - 1][:m] != rows[k][:m]
            shared[k] = differs.argmax() if differs.any() else m
        self.parent: list[int] = []
        self.edge: list[np.ndarray] = []
        self.depth: list[int] = []
        self.sets: list[list[int]] = []
        self.shortest: list[int] = []
        self.longest: list[int] = []
        self.levels: list[list[int]] = []
        level = [(0, len(rows), 0, -1)]
        while level:
            own, below = [], []
            for lo, hi, depth, parent in level:
                end = int(shared[lo + 1 : hi].min()) if hi - lo > 1 else int(lengths[lo])
                node = len(self.parent)
                own.append(node)
                self.parent.append(parent)
                self.edge.append(rows[lo][depth:end])
                self.depth.append(end)
                self.shortest.append(int(lengths[lo:hi].min()))
                self.longest.append(int(lengths[lo:hi].max()))
                done = lo
                while done < hi and lengths[done] == end:
                    done += 1
                self.sets.append([order[k] for k in range(lo, done)])
                if done < hi:
                    cuts = [done, *(done + 1 + np.flatnonzero(shared[done + 1 : hi] == end)), hi]
                    below += [(a, b, end, node) for a, b in zip(cuts, cuts[1:])]
            self.levels.append(own)
            level = below


def links(sets: list[np.ndarray], probes: list[np.ndarray], numerator: int, denominator: int = 100):
    """(set, probe) numbers of all pairs with Jaccard similarity >= numerator / denominator.

    Sets are arrays of distinct uint64 whose numeric order is the global order,
    rarest first.
    """
    sets_at = [k for k, s in enumerate(sets) if len(s)]
    if not sets_at:
        return
    everything = np.unique(np.concatenate([sets[k] for k in sets_at]))
    n = len(everything)
    # number 0 is the most frequent element
    numbered = [(n - 1 - np.searchsorted(everything, sets[k]))[::-1] for k in sets_at]
    trie = Trie(numbered)
    step = max(1, CELLS // n)
    for at in range(0, len(probes), step):
        chunk = probes[at : at + step]
        size = np.array([len(p) for p in chunk])
        held = np.zeros((n, len(chunk)), dtype=bool)
        own = []
        for p, probe in enumerate(chunk):
            where = np.searchsorted(everything, probe)
            where[where == n] = 0
            mine = (n - 1 - where[everything[where] == probe])[::-1]
            held[mine, p] = True
            own.append(mine)
        overlap: dict[int, np.ndarray] = {-1: np.zeros(len(chunk), dtype=np.int64)}
        alive = {-1}
        for level in trie.levels:
            nodes = [k for k in level if trie.parent[k] in alive]
            filled = [k for k in nodes if len(trie.edge[k])]
            if filled:
                tokens = np.concatenate([trie.edge[k] for k in filled])
                starts = np.concatenate([[0], np.cumsum([len(trie.edge[k]) for k in filled])[:-1]])
                sums = np.add.reduceat(held[tokens], starts, axis=0, dtype=np.int64)
                counted = {k: overlap[trie.parent[k]] + s for k, s in zip(filled, sums)}
                last = np.array([trie.edge[k][-1] for k in filled])
                # elements that each probe still has after each path
                rest = np.stack([len(m) - np.searchsorted(m, last, side="right") for m in own], axis=1)
                rest = dict(zip(filled, rest))
            for k in nodes:
                now = counted[k] if len(trie.edge[k]) else overlap[trie.parent[k]]
                overlap[k] = now
                for s in trie.sets[k]:
                    length = trie.depth[k]
                    hit = denominator * now >= numerator * (length + size - now)
                    for p in np.flatnonzero(hit & (size > 0)):
                        yield sets_at[s], at + int(p)
                left = trie.longest[k] - trie.depth[k]
                if left > 0:
                    more = np.minimum(left, rest[k]) if len(trie.edge[k]) else left
                    best = now + more
                    if ((denominator + numerator) * best >= numerator * (trie.shortest[k] + size)).any():
                        alive.add(k)


class Forest:
    """Union-find over a few hundred items; says which links are new."""

    def __init__(self, n: int, groups: list[int] | None = None):
        """Items of one group, if ``groups`` names them, are joined from the start."""
        self.up = list(range(n))
        if groups:
            first: dict[int, int] = {}
            self.up = [first.setdefault(g, k) for k, g in enumerate(groups)]

    def find(self, k: int) -> int:
        while self.up[k] != k:
            self.up[k] = self.up[self.up[k]]
            k = self.up[k]
        return k

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)
        return a != b

    def labels(self) -> np.ndarray:
        return np.array([self.find(k) for k in range(len(self.up))])


def stars(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The components of ``pairs`` as pairs of each member with the smallest, which settle in few rounds."""
    up: dict[int, int] = {}

    def find(k: int) -> int:
        while (above := up.setdefault(k, k)) != k:
            up[k] = up[above]
            k = above
        return k

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [(k, find(k)) for k in list(up) if find(k) != k]


def sides_of(sides: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the items of side 0 and of side 1; all of them twice if there is one side."""
    if (sides == sides[0]).all():
        return np.arange(len(sides)), np.arange(len(sides))
    return np.flatnonzero(sides == 0), np.flatnonzero(sides == 1)


def forest_of(items: list[int], sides: np.ndarray, groups: list[int], data: list[tuple[np.ndarray, int, int]], numerator: int, small: int = 0) -> list[tuple[int, int]]:
    """Spanning links of a group, between items of different ``groups`` alone.

    ``data``: set, its parity bitmap as a number, and the bitmap's bits.  Up to
    ``small`` sets are compared pair by pair.
    """
    forest, out = Forest(len(items), groups), []
    if len(items) <= small:
        for b in range(len(items)):
            for a in range(b):
                if forest.find(a) != forest.find(b) and may_be_similar(*data[a], *data[b], numerator):
                    x, y = data[a][0], data[b][0]
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    if 100 * both >= numerator * (len(x) + len(y) - both) and forest.join(a, b):
                        out.append((items[a], items[b]))
        return out
    first, second = sides_of(sides)
    for a, b in links([data[k][0] for k in first], [data[k][0] for k in second], numerator):
        if forest.join(int(first[a]), int(second[b])):
            out.append((items[first[a]], items[second[b]]))
    return out


def may_be_similar(x: np.ndarray, map_x: int, bits_x: int, y: np.ndarray, map_y: int, bits_y: int, numerator: int) -> bool:
    """Whether neither sizes nor bitmaps rule out a link of two sets."""
    if not 100 * min(len(x), len(y)) >= numerator * max(len(x), len(y)) > 0:
        return False
    bits = min(bits_x, bits_y)
    total = len(x) + len(y)
    return (folded(map_x, bits_x, bits) ^ folded(map_y, bits_y, bits)).bit_count() <= total - 2 * -(-numerator * total // (100 + numerator))


def folded(number: int, bits: int, to: int) -> int:
    while bits > to:
        bits //= 2
        number = (number >> bits) ^ (number & ((1 << bits) - 1))
    return number


def bitmaps(hashes: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    """Parity bitmap of each set: two to four bits per element, a power of two in all.

    Sets that differ in d elements have bitmaps that differ in d bits at most,
    at any common size; a bitmap is halved by folding.
    """
    n = np.diff(bounds)
    size = np.maximum(64, 1 << np.ceil(np.log2(np.maximum(2 * n, 1))).astype(np.int64))
    begin = np.concatenate([[0], np.cumsum(size)])
    place = (hashes & np.repeat(size - 1, n).astype(np.uint64)).astype(np.int64) + np.repeat(begin[:-1], n)
    odd = np.packbits((np.bincount(place, minlength=begin[-1]) & 1).astype(np.uint8), bitorder="little")
    return [odd[a:b].tobytes() for a, b in zip(begin[:-1] // 8, begin[1:] // 8)]


def fold(maps: np.ndarray) -> np.ndarray:
    half = maps.shape[1] // 2
    return maps[:, :half] ^ maps[:, half:]


def may_link(n_a: np.ndarray, maps_a: np.ndarray, n_b: np.ndarray, maps_b: np.ndarray, numerator: int):
    """Pairs that neither sizes nor bitmaps rule out, in parts."""
    step = max(1, 2_000_000 // max(1, maps_b.size))
    for at in range(0, len(n_a), step):
        a = n_a[at : at + step, None]
        apart = np.bitwise_count(maps_a[at : at + step, None, :] ^ maps_b[None, :, :]).sum(axis=2, dtype=np.int64)
        total = a + n_b[None, :]
        shared = -(-numerator * total // (100 + numerator))
        fits = (100 * np.minimum(a, n_b) >= numerator * np.maximum(a, n_b)) & (apart <= total - 2 * shared)
        x, y = np.nonzero(fits)
        yield x + at, y


def candidate_forest(items: list[int], sides: np.ndarray, groups: list[int], sizes: list[int], maps: list[bytes], numerator: int) -> list[tuple[int, int]]:
    """Spanning pairs of a group, of those that may link items of different ``groups``."""
    first_ends, second_ends = [], []
    side = sides_of(sides)
    n = np.array(sizes)
    width = np.array([len(m) // 8 for m in maps])
    for w in np.unique(width):
        # similar sets have bitmaps of the same width or of twice that
        own = [s[width[s] == w] for s in side]
        wide = [s[width[s] == 2 * w] for s in side]
        table = lambda at: np.frombuffer(b"".join(maps[k] for k in at), dtype=np.uint64).reshape(len(at), -1)
        for first, second, left, right in ((own[0], own[1], 0, 0), (own[0], wide[1], 0, 1), (wide[0], own[1], 1, 0)):
            if len(first) and len(second):
                a, b = (fold(table(k)) if f else table(k) for k, f in ((first, left), (second, right)))
                for x, y in may_link(n[first], a, n[second], b, numerator):
                    i, j = spanning(Forest(len(items), groups), first[x], second[y])
                    first_ends.append(i)
                    second_ends.append(j)
    if not first_ends:
        return []
    i, j = spanning(Forest(len(items), groups), np.concatenate(first_ends), np.concatenate(second_ends))
    return [(items[a], items[b]) for a, b in zip(i.tolist(), j.tolist())]


def spanning(forest: Forest, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Those of the pairs (a, b) that join what ``forest`` leaves apart, without a circle.

    Each round takes one pair for every component that still has one leading
    out of it, so that the rounds are logarithmic in the number of items.
    """
    left, right = [], []
    while True:
        label = forest.labels()
        out = label[a] != label[b]
        a, b = a[out], b[out]
        if not len(a):
            return np.array(left, dtype=np.int64), np.array(right, dtype=np.int64)
        _, first = np.unique(label[a], return_index=True)
        for k in first.tolist():
            if forest.join(int(a[k]), int(b[k])):
                left.append(int(a[k]))
                right.append(int(b[k]))


def _by_group(rows: DataFrame, columns: list[str], prepare, decide) -> DataFrame:
    """Pairs (a, b) that ``decide`` finds in each group of leader, low, high.

    Groups are sorted runs of a partition, streamed in batches: ``prepare`` sees
    whole groups of about ``CHUNK`` bytes at once, and no data frame is made.
    """
    keys = ["leader", "low", "high"]

    def run(batches):
        waiting = None

        def groups(table: pa.Table):
            if not table.num_rows:
                return
            leader, low, high = (table.column(k).to_numpy() for k in keys)
            cut = np.flatnonzero((leader[1:] != leader[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])) + 1
            cut = np.concatenate([[0], cut, [table.num_rows]])
            weight = np.concatenate([[0], np.cumsum(pc.binary_length(table.column(columns[-1])).to_numpy())])[cut]
            at, found = 0, []
            while at < len(cut) - 1:
                to = max(at + 1, int(np.searchsorted(weight, weight[at] + CHUNK, side="right")) - 1)
                part = table.slice(cut[at], cut[to] - cut[at])
                data = prepare({c: part.column(c).to_pylist() for c in columns})
                items, of, sides = part.column("item").to_pylist(), part.column("grp").to_pylist(), part.column("side").to_numpy()
                for a, b in zip(cut[at:to] - cut[at], cut[at + 1 : to + 1] - cut[at]):
                    if b - a > 1:
                        found += decide(items[a:b], sides[a:b], of[a:b], data[a:b])
                at = to
            x, y = zip(*stars(found)) if found else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], names=["a", "b"])

        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if waiting is None else pa.concat_tables([waiting, table])
            if not table.num_rows:
                continue
            last = np.ones(table.num_rows, dtype=bool)
            for k in keys:
                values = table.column(k).to_numpy()
                last &= values == values[-1]
            whole = int(np.flatnonzero(~last)[-1]) + 1 if (~last).any() else 0
            yield from groups(table.slice(0, whole).combine_chunks())
            waiting = table.slice(whole)
        if waiting is not None:
            yield from groups(waiting.combine_chunks())
        waiting = None
        release()

    rows = rows.select(*keys, "side", "grp", "item", *columns).repartition(*keys).sortWithinPartitions(*keys)
    return rows.mapInArrow(run, "a long, b long")


def _joined(members: DataFrame, data: DataFrame, columns: list[str], prepare, decide, block: int) -> DataFrame:
    """A forest over what ``decide`` links inside families, in two rounds of bounded groups.

    Round one cuts each family into blocks and puts the leader into all of
    them, so that every item is compared with its block and the leader.  In a
    family of many copies of one thing that joins nearly all.  Round two
    compares the items outside a family's largest component with all of it, and
    pairs inside that component, which can add nothing, are never formed.
    """
    heavy = data.select("item", F.length(columns[-1]).alias("bytes"))
    blocks = F.ceil(F.greatest(F.count("*") / block, F.sum("bytes") / BLOCK_BYTES)).cast("int")
    sizes = common.materialise(members.join(heavy, "item").groupBy("leader").agg(blocks.alias("blocks"), F.count("*").alias("n")).where("n > 1").select("leader", "blocks"), "family-sizes")
    dealt = members.join(sizes, "leader").withColumn("low", F.pmod(F.xxhash64("item"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("low", F.explode(F.when(F.col("item") == F.col("leader"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("low"))))
    dealt = dealt.select("leader", "item", "low", F.col("low").alias("high"), F.lit(0).alias("side"), F.col("item").alias("grp"))
    found = common.materialise(_by_group(dealt.join(data, "item"), columns, prepare, decide), "family-links")
    large = sizes.where("blocks > 1")
    if large.isEmpty():
        common.discard(sizes)
        return found
    roots = components.connected(found).withColumnRenamed("node", "item")
    own = members.join(large, "leader").join(heavy, "item").join(roots, "item", "left").withColumn("grp", F.coalesce("root", "item"))
    own = common.materialise(own.select("leader", "blocks", "item", "bytes", "grp"), "family-groups")
    parts = own.groupBy("leader", "grp").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))
    rest_blocks = F.ceil(F.greatest((F.sum("n") - F.max("n")) / block, (F.sum("bytes") - F.max(F.struct("n", "bytes"))["bytes"]) / BLOCK_BYTES)).cast("int")
    major = parts.groupBy("leader").agg(F.max(F.struct("n", "grp"))["grp"].alias("major"), F.greatest(rest_blocks, F.lit(1)).alias("rests"), F.count("*").alias("parts")).where("parts > 1")
    major = common.materialise(major.select("leader", "major", "rests"), "family-majors")
    open_ = own.join(major, "leader")
    place = lambda n: F.pmod(F.xxhash64("item"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    rest = open_.where("grp != major").select("leader", "item", place("rests").alias("low"), every("blocks").alias("high"), F.lit(0).alias("side"), "grp")
    whole = open_.select("leader", "item", every("rests").alias("low"), place("blocks").alias("high"), F.lit(1).alias("side"), "grp")
    more = common.materialise(_by_group(rest.unionByName(whole).join(data, "item"), columns, prepare, decide), "family-links")
    common.discard(sizes, own, major)
    return found.unionByName(more)


def candidates(members: DataFrame, maps: DataFrame, numerator: int, block: int = BLOCK) -> DataFrame:
    """Pairs (a, b), as tables, that span what sizes and bitmaps leave possible.

    Every link lies inside one component of these pairs, so that the components
    serve as families in which each item stands once.  ``members``: leader, item,
    distinct, the leader an item of its family.  ``maps``: item, n, bits, materialised.
    """

    def decide(items, sides, groups, data):
        return candidate_forest(items, sides, groups, [n for n, _ in data], [m for _, m in data], numerator)

    return _joined(members, maps, ["n", "bits"], lambda c: list(zip(c["n"], c["bits"])), decide, block)


def join_families(members: DataFrame, sets: DataFrame, numerator: int, to_set: Callable[[list], list[np.ndarray]], block: int = BLOCK, small: int = 0) -> DataFrame:
    """Pairs (a, b), as tables, that span the components which links make of items that share a family.

    ``members`` as for ``candidates``.  ``sets``: item, data, materialised;
    ``to_set`` turns a list of data into sorted arrays of elements.
    """

    def prepare(columns):
        sets = to_set(columns["data"])
        maps = bitmaps(np.concatenate(sets), np.cumsum([0, *map(len, sets)]))
        return [(x, int.from_bytes(m, "little"), 8 * len(m)) for x, m in zip(sets, maps)]

    def decide(items, sides, groups, data):
        return forest_of(items, sides, groups, data, numerator, small)

    return _joined(members, sets, ["data"], prepare, decide, block)
