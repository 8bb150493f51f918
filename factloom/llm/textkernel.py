"""Vectorised word kernels over Arrow string columns.

Everything here works on the UTF-8 bytes of a whole column slice at once, so
no Python code runs per word.  Both word classes the operators use are closed
under UTF-8 (every byte of a non-ASCII character is a word byte), which makes
byte-level splitting exact.

Hashes are 64-bit polynomial hashes with a seeded byte table and an avalanche
finish; equal word sequences always hash alike, in every process.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_SPACE = [0x20, *range(0x09, 0x0E)]
# 5 mod 8, so differences of powers keep few factors of two
_BYTE_BASE = 0x9E3779B97F4A7C15
_WORD_BASE = 0xD1342543DE82EF95
_CHECK_BASE = 0xAF251AF3B0F025B5

#: Bytes of text handled at once; a longer single text is taken alone.
SLICE_BYTES = 1 << 19


def _lut(separators) -> np.ndarray:
    lut = np.ones(256, dtype=bool)
    lut[list(separators)] = False
    return lut


#: ``[^\x20\x09-\x0D]+``
SPACED = _lut(_SPACE)
#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after lower-casing A-Z
ALNUM = _lut([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])


def _lower_lut() -> np.ndarray:
    lut = np.arange(256, dtype=np.uint8)
    lut[0x41:0x5B] += 0x20
    return lut


LOWER = _lower_lut()


def byte_table() -> np.ndarray:
    return np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)


TABLE = byte_table()


def mix(h: np.ndarray) -> np.ndarray:
    """Avalanche 64-bit values (xor-shift and multiply)."""
    h = h ^ (h >> U64(33))
    h = h * U64(0xFF51AFD7ED558CCD)
    h ^= h >> U64(33)
    h *= U64(0xC4CEB9FE1A85EC53)
    h ^= h >> U64(33)
    return h


class Powers:
    """base**i and base**-i modulo 2**64, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, dtype=U64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            self.up, self.down = (self._table(b, n) for b in (self.base, self.inverse))
        return self.up[:n], self.down[:n]

    @staticmethod
    def _table(base: int, n: int) -> np.ndarray:
        out = np.full(n, base, dtype=U64)
        out[0] = 1
        return np.multiply.accumulate(out)


@dataclass
class Words:
    """The words of a slice of texts; ``first[d]:first[d+1]`` are text d's."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    hash: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def docs(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


class Kernel:
    """Splits and hashes words; keeps its power tables between slices."""

    def __init__(self, word_bytes: np.ndarray, lower: bool):
        self.word_bytes, self.lower = word_bytes, lower
        self.byte_powers, self.word_powers, self.check_powers = Powers(_BYTE_BASE), Powers(_WORD_BASE), Powers(_CHECK_BASE)

    def words(self, texts: pa.Array) -> Words:
        data, offsets = buffer_of(texts)
        if self.lower:
            data = LOWER[data]
        n = len(data)
        inside = self.word_bytes[data]
        before = np.empty(n, dtype=bool)
        before[1:] = inside[:-1]
        after = np.empty(n, dtype=bool)
        after[:-1] = inside[1:]
        before[offsets[:-1][offsets[:-1] < n]] = False
        after[offsets[1:][offsets[1:] > 0] - 1] = False
        start = np.flatnonzero(inside & ~before)
        end = np.flatnonzero(inside & ~after) + 1
        up, down = self.byte_powers.get(n + 1)
        total = np.zeros(n + 1, dtype=U64)
        np.cumsum(TABLE[data] * up[:n], out=total[1:])
        hashed = mix((total[end] - total[start]) * down[start])
        return Words(data, start, end, np.searchsorted(start, offsets), hashed)

    def windows(self, w: Words, k: int, check: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the k words from each word on, and whether they stay in its text.

        With ``check`` it is a second hash, independent of the first.
        """
        n = len(w.hash)
        if n == 0:
            return np.zeros(0, dtype=U64), np.zeros(0, dtype=bool)
        total = self.totals(w, check)
        at = np.arange(n)
        valid = at + k <= np.repeat(w.first[1:], w.counts)
        stop = np.minimum(at + k, n)
        _, down = self.powers(check).get(n + 1)
        return mix((total[stop] - total[:-1]) * down[:n] + U64(k)), valid

    def powers(self, check: bool) -> Powers:
        return self.check_powers if check else self.word_powers

    def totals(self, w: Words, check: bool = False) -> np.ndarray:
        n = len(w.hash)
        up, _ = self.powers(check).get(n + 1)
        total = np.zeros(n + 1, dtype=U64)
        np.cumsum(w.hash * up[:n], out=total[1:])
        return total

    def spans(self, w: Words, begin: np.ndarray, stop: np.ndarray, check: bool = False) -> np.ndarray:
        """Hashes of the word ranges begin:stop, agreeing with windows()."""
        total = self.totals(w, check)
        _, down = self.powers(check).get(len(w.hash) + 1)
        return mix((total[stop] - total[begin]) * down[begin] + (stop - begin).astype(U64))


def word_spans(data: np.ndarray, offsets: np.ndarray, word_bytes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of every word; no word crosses the end of a text."""
    n = len(data)
    inside = word_bytes[data]
    before = np.empty(n, dtype=bool)
    before[1:] = inside[:-1]
    after = np.empty(n, dtype=bool)
    after[:-1] = inside[1:]
    before[offsets[:-1][offsets[:-1] < n]] = False
    after[offsets[1:][offsets[1:] > 0] - 1] = False
    return np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1


def buffer_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and the n + 1 offsets into them; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if not pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    _, offsets, data = texts.buffers()
    if offsets is None or len(texts) == 0:
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    offsets = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.zeros(0, dtype=np.uint8) if data is None else np.frombuffer(data, dtype=np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES):
    """Cut a batch into runs of rows holding about ``limit`` bytes of text each."""
    _, offsets = buffer_of(batch.column(column))
    row, rows = 0, batch.num_rows
    while row < rows:
        stop = int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1
        stop = min(max(stop, row + 1), rows)
        yield batch.slice(row, stop - row)
        row = stop
