"""Words of whole Arrow text columns, as arrays: places, hashes, and counts by text.

A word is a run of bytes other than the six ASCII white-space characters. All
work is on the UTF-8 bytes of many texts at once and goes through them in
slices, so the memory needed follows the longest text, at about ten bytes for
each of its bytes.
"""

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

#: Bytes hashed at a time, and bytes of text that one slice holds unless a single text is longer.
BLOCK = 1 << 20
SLICE = 1 << 21

SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_ODD = 0x9E3779B97F4A7C15
_BASE = 0xD6E8FEB86659FD93


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit finaliser (splitmix64): every input bit reaches every output bit."""
    x = x + np.uint64((_ODD * (seed + 1)) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_EXACT = mix(np.arange(256, dtype=np.uint64), 7)
_LOWER = _EXACT.copy()
_LOWER[65:91] = _EXACT[97:123]


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Powers:
    """Powers of the hash base and of its inverse, made when first needed (never sent to workers)."""

    up = down = np.ones(1, np.uint64)

    @classmethod
    def upto(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            cls.up, cls.down = _powers(_BASE, n), _powers(pow(_BASE, -1, 2**64), n)
        return cls.up, cls.down


class Texts(NamedTuple):
    """Some texts: their bytes one after another, and where each begins (one more entry than texts)."""

    data: np.ndarray
    offsets: np.ndarray

    def __len__(self) -> int:
        return len(self.offsets) - 1


def texts_of(column: pa.Array | pa.ChunkedArray) -> Texts:
    """A string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    return Texts(data[offsets[0] : offsets[-1]], offsets - offsets[0])


def slices(batch: pa.RecordBatch, column: str = "text", most: int = SLICE) -> Iterator[tuple[pa.RecordBatch, Texts]]:
    """Parts of a batch whose texts have ``most`` bytes together, or one row each."""
    texts = texts_of(batch.column(column))
    row = 0
    while row < batch.num_rows:
        end = max(row + 1, int(np.searchsorted(texts.offsets, texts.offsets[row] + most, "right")) - 1)
        cut = texts.offsets[row : end + 1]
        yield batch.slice(row, end - row), Texts(texts.data[cut[0] : cut[-1]], cut - cut[0])
        row = end
    # Give back what earlier batches used: workers live on between tasks.
    pa.default_memory_pool().release_unused()


class Spans(NamedTuple):
    """Runs of bytes in order: begin, end, and how many runs stand before each text (one more entry than texts)."""

    start: np.ndarray
    end: np.ndarray
    before: np.ndarray

    def counts(self) -> np.ndarray:
        return np.diff(self.before)

    def owner(self) -> np.ndarray:
        """The text of each run."""
        return np.repeat(np.arange(len(self.before) - 1), self.counts())


def _runs(texts: Texts, inside: np.ndarray) -> Spans:
    """Maximal runs of True that end where a text ends."""
    edge = np.zeros(len(inside) + 1, bool)
    edge[texts.offsets] = True
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:-1]
    last[:-1] &= ~inside[1:] | edge[1:-1]
    start = np.flatnonzero(first)
    return Spans(start, np.flatnonzero(last) + 1, np.searchsorted(start, texts.offsets))


def words_of(texts: Texts) -> Spans:
    return _runs(texts, ~SPACE[texts.data])


def lines_of(texts: Texts) -> Spans:
    """Pieces between line feeds, empty ones too; a text of n line feeds has n + 1 lines."""
    feeds = np.flatnonzero(texts.data == 10)
    own = np.searchsorted(texts.offsets, feeds, "right") - 1
    start = np.sort(np.concatenate([texts.offsets[:-1], feeds + 1]), kind="stable")
    end = np.sort(np.concatenate([feeds, texts.offsets[1:]]), kind="stable")
    lines = 1 + np.bincount(own, minlength=len(texts))
    return Spans(start, end, np.concatenate([[0], np.cumsum(lines)]))


def hash_spans(data: np.ndarray, spans: Spans, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of each run's bytes; ``lower`` takes A-Z as a-z. Runs must not overlap."""
    table = _LOWER if lower else _EXACT
    out = np.empty(len(spans.start), np.uint64)
    row = 0
    while row < len(out):
        base = int(spans.start[row])
        end = max(row + 1, int(np.searchsorted(spans.end, base + BLOCK, "right")))
        n = int(spans.end[end - 1]) - base
        up, down = Powers.upto(max(n, BLOCK) + 1)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(table[data[base : base + n]] * up[:n], out=total[1:])
        a, b = spans.start[row:end] - base, spans.end[row:end] - base
        out[row:end] = (total[b] - total[a]) * down[a] + b.astype(np.uint64) - a.astype(np.uint64)
        row = end
    return mix(out)


def shingle_hashes(hashes: np.ndarray, spans: Spans, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each ``width`` words in a row within a text, and its first word's place."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out = mix(out * np.uint64(3) + hashes[k : k + n], k)
    room = np.repeat(spans.before[1:], spans.counts())[:n] - np.arange(n) >= width
    return out[room], np.flatnonzero(room)


def repeated(keys: np.ndarray) -> np.ndarray:
    """Values that occur more than once, in order."""
    found = np.sort(keys)
    return np.unique(found[1:][found[1:] == found[:-1]])


def is_in(keys: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Whether each key is among the ordered values."""
    if not len(among):
        return np.zeros(len(keys), bool)
    return among[np.minimum(np.searchsorted(among, keys), len(among) - 1)] == keys


def sums(values: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Sum of the values of each text, whose own begin at before[i]."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[before[1:]] - total[before[:-1]]
