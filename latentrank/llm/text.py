"""Vectorised word handling over Arrow string columns.

Texts of an Arrow batch lie in one UTF-8 buffer.  Words are the runs of bytes
other than 0x20 and 0x09-0x0D, found for a whole block of texts at once; every
word gets a 64-bit hash from a polynomial prefix sum, so that no Python object
is made for a word.  Blocks hold about ``BLOCK_BYTES`` of text (one text at
least, always whole), which bounds the memory of a task whatever the Arrow
batch holds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES, MOST_TEXTS = 1 << 20, 4096
#: Words longer than this are hashed by the library: a polynomial modulo 2 ** 64 can be led into collisions by long structured ones.
LONG_WORD = 32
WORD = r"[^\x20\x09-\x0D]+"

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser of 64-bit values (the splitmix64 steps)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, U64)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=U64)


class Powers:
    """Powers of a base up to the n-th, as products of two short tables."""

    STEP = 12

    def __init__(self, base: int, n: int):
        self.low = powers(base, 1 << self.STEP)
        self.high = powers(pow(base, 1 << self.STEP, 1 << 64), (n >> self.STEP) + 1)

    def first(self, n: int) -> np.ndarray:
        return np.multiply.outer(self.high, self.low).ravel()[:n]

    def at(self, places: np.ndarray) -> np.ndarray:
        return self.low[places & ((1 << self.STEP) - 1)] * self.high[places >> self.STEP]


def byte_table(seed: int) -> np.ndarray:
    return mix(np.arange(1, 257, dtype=U64) * U64(0x632BE59BD9B4E019) + U64(seed))


def separators() -> np.ndarray:
    table = np.zeros(256, bool)
    table[[0x20, 9, 10, 11, 12, 13]] = True
    return table


def strings(column: pa.ChunkedArray | pa.Array) -> pa.Array:
    """One large_string array without nulls (null: empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    return pc.fill_null(column.cast(pa.large_string()), "")


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (from 0) of a large_string array."""
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    body = column.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body is not None and body.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(offsets: np.ndarray, size: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of whole texts of about ``size`` bytes, ``MOST_TEXTS`` at most."""
    n, at = len(offsets) - 1, 0
    while at < n:
        to = max(at + 1, min(at + MOST_TEXTS, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1))
        yield at, min(n, to)
        at = to


class Words:
    """The words of a block of texts: byte spans, 64-bit hashes, texts' bounds.

    ``first[i] : first[i + 1]`` are the words of text i.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, seed: int = 1, hashes: bool = True, gap: np.ndarray | None = None):
        """``gap``: 256 flags of bytes that part words, white space if not given."""
        self.data, self.offsets = data, offsets
        n = len(data)
        if n == 0:
            self.start = self.end = np.zeros(0, np.int64)
            self.first = np.zeros(len(offsets), np.int64)
            self.hash = np.zeros(0, U64)
            return
        ink = ~(separators() if gap is None else gap)[data]
        before = np.empty(n, bool)
        before[0] = False
        before[1:] = ink[:-1]
        cuts = offsets[:-1][offsets[:-1] < n]
        before[cuts] = False
        self.start = np.flatnonzero(ink & ~before)
        after = np.empty(n, bool)
        after[-1] = False
        after[:-1] = before[1:] & ink[1:]
        self.end = np.flatnonzero(ink & ~after) + 1
        self.first = np.searchsorted(self.start, offsets)
        if hashes:
            self.hash = self.hashes(seed)

    def hashes(self, seed: int) -> np.ndarray:
        """A 64-bit hash of every word; those of different seeds are independent."""
        import xxhash

        out = span_hash(self.data, self.start, self.end, seed)
        for i in np.flatnonzero(self.end - self.start > LONG_WORD).tolist():
            out[i] = xxhash.xxh3_64_intdigest(self.data[self.start[i] : self.end[i]].tobytes(), seed)
        return out

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts())


def span_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 1) -> np.ndarray:
    """A 64-bit hash of every byte span, by differences of one prefix sum."""
    n = len(data)
    prefix = np.zeros(n + 1, U64)
    terms = byte_table(seed)[data]
    terms *= Powers(_BASE, n).first(n)
    np.cumsum(terms, out=prefix[1:])
    body = (prefix[end] - prefix[start]) * Powers(_BASE_INV, n).at(start)
    return mix(body + (end - start).astype(U64) * U64(0xD6E8FEB86659FD93))


def window_hash(codes: np.ndarray, width: int, multiplier: int) -> np.ndarray:
    """Hash of ``codes[i : i + width]`` for every i (those that run past the
    end, or over a text's end, are for the caller to leave out)."""
    if len(codes) < width:
        return np.zeros(0, U64)
    m = len(codes) - width + 1
    out = codes[:m].copy()
    for k in range(1, width):
        out *= U64(multiplier)
        out += codes[k : k + m]
    return mix(out)


def texts_of(table: pa.Table, name: str = "text") -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(from, to, bytes, offsets) of every block of a table's text column."""
    data, offsets = raw(strings(table.column(name)))
    for a, b in blocks(offsets):
        yield a, b, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]


def plain(df, *names: str):
    """The named columns alone, by position safe against clashing extra names.

    A column is looked up case-sensitively first, so tables that also hold,
    say, ``TEXT`` beside ``text`` do not raise an ambiguity error.
    """
    if all(sum(c.lower() == n.lower() for c in df.columns) == 1 for n in names):
        return df.select(*names)
    spots = [df.columns.index(n) for n in names]
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))]).selectExpr(*[f"c{i} AS `{n}`" for i, n in zip(spots, names)])
