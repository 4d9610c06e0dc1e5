"""SimHash near-duplicates with pigeonring filtering.

A fingerprint has a bit set where over half of the text's shingle hashes have
it.  Distinct fingerprints with at most ``RADIUS`` (3) differing bits link, and
documents in a component are one group.

Candidates.  A fingerprint is a ring of four segments of 16 bits.  If two
fingerprints differ in at most 3 bits, then some segment starts a chain whose
first k segments differ in at most 3k/4 bits together, for every k: 0 in the
first, at most 1 in the first two, 2 in the first three, 3 in all.  Pairs are
sought per start by equal first segment and second segment at most one bit
apart (sorted lookups of the 17 possible values), checked on the third, and only
then on all 64 bits.  Where many fingerprints share those 32 bits, the remaining
ones must agree in one of their four bytes, and are looked up by that byte too.

Work is dealt by start, first segment and the upper four bits of the second, so
that one hot segment is split; a fingerprint visits the neighbouring shards that
one of those bits leads to.  A task joins what it finds into local classes and
returns one link per fingerprint, never the pairs.

Null text counts as empty; texts without words have fingerprint zero and form
one group like any other; rows with a null id get a fingerprint and, if no row
with an id shares their group, a null component; repeated rows get equal
results; an empty table gives an empty table; extra columns are left aside.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .tables import saved
from .text import U64, Words, plain, texts_of

RADIUS = 3
#: Fingerprints in one group of the candidate search, about.
GROUP = 50_000
#: Pairs compared at once.
PAIRS = 1 << 20


#: The primes of XXH64.
PRIMES = tuple(U64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def xxh64(line: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int) -> np.ndarray:
    """XXH64 of byte spans, all at once; those of 32 bytes and more by the library."""
    import xxhash

    one, two, three, four, five = PRIMES
    turn = lambda x, n: (x << U64(n)) | (x >> U64(64 - n))
    size = end - start
    lanes = np.zeros(len(line) + 8, U64)  # the eight bytes from every place on
    padded = np.zeros(len(line) + 16, np.uint8)
    padded[: len(line)] = line
    for k in range(8):
        lanes |= padded[k : k + len(lanes)].astype(U64) << U64(8 * k)
    h = size.astype(U64) + U64((seed + int(five)) % (1 << 64))
    for k in range(3):
        at = np.flatnonzero(size >= 8 * (k + 1))
        x = h[at] ^ (turn(lanes[start[at] + 8 * k] * two, 31) * one)
        h[at] = turn(x, 27) * one + four
    place = start + (size & ~7)
    at = np.flatnonzero(size & 4)
    x = h[at] ^ ((lanes[place[at]] & U64(0xFFFFFFFF)) * one)
    h[at] = turn(x, 23) * two + three
    place += size & 4
    for k in range(3):
        at = np.flatnonzero((size & 3) > k)
        h[at] = turn(h[at] ^ (padded[place[at] + k].astype(U64) * five), 11) * one
    h ^= h >> U64(33)
    h *= two
    h ^= h >> U64(29)
    h *= three
    h ^= h >> U64(32)
    body = None
    for i in np.flatnonzero(size >= 32).tolist():
        body = body or line.tobytes()
        h[i] = xxhash.xxh64_intdigest(body[start[i] : end[i]], seed)
    return h


def fingerprints(words: Words, size: int = 3, seed: int = 42) -> np.ndarray:
    """SimHash of every text of a block whose bytes are lower case already."""
    n = len(words.first) - 1
    out = np.zeros(n, U64)
    if not len(words.start):
        return out
    length = words.end - words.start
    at = np.concatenate([[0], np.cumsum(length + 1)])
    # the words, each followed by one space
    line = np.full(at[-1], 0x20, np.uint8)
    take = np.repeat(words.start - np.concatenate([[0], np.cumsum(length)[:-1]]), length) + np.arange(length.sum())
    line[np.repeat(np.arange(len(length)), length) + np.arange(length.sum())] = words.data[take]
    counts = words.counts()
    shingles = np.where(counts == 0, 0, np.maximum(counts - size + 1, 1))
    total = int(shingles.sum())
    begin = np.concatenate([[0], np.cumsum(shingles)])
    first = np.repeat(words.first[:-1] - begin[:-1], shingles) + np.arange(total)
    last = first + np.repeat(np.minimum(counts, size), shingles) - 1
    hashes = xxh64(line, at[first], at[last + 1] - 1, seed)
    return majority(hashes, begin)


def majority(hashes: np.ndarray, begin: np.ndarray, slice_of: int = 1 << 18) -> np.ndarray:
    """Per text, the bits set in over half of ``hashes[begin[i] : begin[i + 1]]``.
    A hash takes 64 bytes while it is counted, so so many are taken at once,
    wherever texts end."""
    n = len(begin) - 1
    ones = np.zeros((n, 64), np.int64)
    owner = np.repeat(np.arange(n), np.diff(begin))
    # stretches of 255 hashes of one text are counted in bytes first
    new = (np.arange(len(hashes)) - begin[owner]) % 255 == 0
    for a in range(0, len(hashes), slice_of):
        b = min(a + slice_of, len(hashes))
        bits = np.unpackbits(hashes[a:b].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        start = np.union1d(np.flatnonzero(new[a:b]), 0)
        counts = np.add.reduceat(bits, start, axis=0, dtype=np.uint8)
        of = owner[a + start]
        first = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
        ones[of[first]] += np.add.reduceat(counts, first, axis=0, dtype=np.int64)
    return np.packbits(2 * ones > np.diff(begin)[:, None], axis=1, bitorder="little").view(U64).ravel()


def fingerprint_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, seed: int = 42) -> DataFrame:
    """``id_col``, fp (the fingerprint's 64 bits as bigint)."""
    chosen = plain(docs, id_col, text_col)
    kind = dict(chosen.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lower = np.arange(256, dtype=np.uint8)
        lower[65:91] += 32
        for batch in batches:
            for a, b, data, offsets in texts_of(pa.Table.from_batches([batch]), text_col):
                fp = fingerprints(Words(lower[data], offsets, hashes=False), shingle, seed)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(fp.view(np.int64))], names=[id_col, "fp"])

    return chosen.mapInArrow(run, f"`{id_col}` {kind}, fp bigint")


class Classes:
    """Union of indices into classes, by arrays."""

    def __init__(self, n: int):
        self.of = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            x, y = self.of[a], self.of[b]
            apart = x != y
            if not apart.any():
                return
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(self.of, np.maximum(x, y), np.minimum(x, y))
            while (self.of[self.of] != self.of).any():
                self.of = self.of[self.of]


def ranges(low: np.ndarray, high: np.ndarray, rows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, position) for every position in [low, high) of each row, in parts."""
    n = np.maximum(high - low, 0)
    some = np.flatnonzero(n)
    low, n, rows = low[some], n[some], rows[some]
    ends = np.cumsum(n)
    at = 0
    while at < len(n):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, "right")))
        k = n[at:to]
        shift = np.repeat(low[at:to] - np.concatenate([[0], np.cumsum(k)[:-1]]), k)
        yield np.repeat(rows[at:to], k), shift + np.arange(k.sum())
        at = to


def links(home: np.ndarray, visitors: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links among rotated fingerprints (first segment uppermost) of some shards.

    ``visitors`` come from the shard that differs in the second segment's upper
    bit ``bits``.  Returns (values, class representatives) of linked values.
    """
    home = np.unique(home)
    values = np.unique(np.concatenate([home, visitors]))
    own, guests = np.searchsorted(values, home), np.searchsorted(values, visitors)
    classes = Classes(len(values))

    def seek(probe_rows: np.ndarray, flip: int) -> None:
        """Compares ``values[probe_rows]`` with those of home whose 32 bits differ in ``flip``."""
        x = values[probe_rows]
        head, probe = home >> U64(32), (x >> U64(32)) ^ U64(flip)
        low, high = np.searchsorted(head, probe, "left"), np.searchsorted(head, probe, "right")
        if flip == 0:
            low = np.searchsorted(home, x, "right")
        if (np.maximum(high - low, 0)).sum() <= 64 * len(x):
            compare(probe_rows, own, low, high)
            return
        # dense: one of the four bytes left must agree as well (of three, if the second segment differs)
        for byte in range(4 if flip == 0 else 3):
            cut = U64(8 * byte)
            key = ((home >> U64(32)) << U64(8)) | ((home >> cut) & U64(255))
            order = np.argsort(key, kind="stable")
            wanted = (probe << U64(8)) | ((x >> cut) & U64(255))
            compare(probe_rows, own[order], np.searchsorted(key[order], wanted, "left"), np.searchsorted(key[order], wanted, "right"))

    def compare(rows: np.ndarray, targets: np.ndarray, low: np.ndarray, high: np.ndarray) -> None:
        for a, at in ranges(low, high, rows):
            b = targets[at]
            new = classes.of[a] != classes.of[b]
            a, b = a[new], b[new]
            d = values[a] ^ values[b]
            near = (np.bitwise_count(d >> U64(16)) <= 2) & (np.bitwise_count(d) <= RADIUS)
            classes.join(a[near], b[near])

    seek(own, 0)
    for k in range(12):
        seek(own[(home >> U64(32 + k)) & U64(1) == 0], 1 << k)
    for k in range(4):
        if (mine := guests[bits == k]).size:
            seek(np.unique(mine), 1 << (12 + k))
    moved = np.flatnonzero(classes.of != np.arange(len(values)))
    return values[moved], values[classes.of[moved]]


def near_links(fps: DataFrame, groups: int) -> DataFrame:
    """(u, v): links whose components are those of all pairs within the radius."""
    fp = F.col("fp")
    turned = [F.when(F.lit(k == 0), fp).otherwise(F.shiftleft(fp, 16 * k).bitwiseOR(F.shiftrightunsigned(fp, 64 - 16 * k))) if k else fp for k in range(4)]
    shard = lambda r, flip: F.shiftrightunsigned(r, 44).bitwiseXOR(F.lit(flip).cast("bigint"))
    rows = []
    for k, r in enumerate(turned):
        rows.append(F.struct(F.lit(k).alias("ring"), r.alias("r"), F.lit(-1).alias("bit"), shard(r, 0).alias("shard")))
        # each pair once: those with the bit off visit those with the bit on
        rows += [F.when(F.shiftrightunsigned(r, 44 + b).bitwiseAND(F.lit(1)) == 0, F.struct(F.lit(k).alias("ring"), r.alias("r"), F.lit(b).alias("bit"), shard(r, 1 << b).alias("shard"))) for b in range(4)]
    dealt = fps.select(F.explode(F.array(*rows)).alias("x")).where("x is not null").select(F.pmod(F.xxhash64("x.ring", "x.shard"), F.lit(groups)).cast("int").alias("bucket"), "x.ring", "x.r", "x.bit")

    def run(t: pa.Table) -> pa.Table:
        ring, r, bit = (t.column(c).to_numpy() for c in ("ring", "r", "bit"))
        r = r.view(U64)
        out = []
        for k in range(4):
            mine = ring == k
            a, b = links(r[mine & (bit < 0)], r[mine & (bit >= 0)], bit[mine & (bit >= 0)])
            turn = lambda x, k=k: ((x >> U64(16 * k)) | (x << U64(64 - 16 * k))) if k else x
            out.append((turn(a), turn(b)))
        u, v = (np.concatenate([x[i] for x in out]).view(np.int64) for i in (0, 1))
        return pa.table({"u": pa.array(u), "v": pa.array(v)})

    return dealt.groupBy("bucket").applyInArrow(run, "u bigint, v bigint").distinct()


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, seed: int = 42) -> DataFrame:
    """``id_col``, fingerprint (16 hex digits), component_id of every row."""
    found = saved(fingerprint_table(docs, id_col, text_col, shingle, seed))
    distinct = saved(found.groupBy("fp").agg(F.min(id_col).alias("least")))
    pairs = near_links(distinct.select("fp"), max(16, -(-12 * distinct.count() // GROUP)))
    roots = components(pairs)
    classed = distinct.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    names = classed.groupBy("root").agg(F.min("least").alias("component_id"))
    table = classed.join(names, "root").select("fp", "component_id")
    return found.join(table, "fp").select(id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
