"""Benchmark decontamination by greedy string tiling.

Texts and benchmark items are lower-cased and split at white space and ASCII
punctuation.  Runs of ``min_match`` (5) tokens that an item and a document share
are seeds, found by a lookup of every run of the document in the items' runs.
An item whose tokens the document's distinct seeds cannot cover up to the
threshold is set aside before any occurrence is looked at, so that a phrase that
a document repeats costs no more than once an item.  For the others, one by one,
running Karp-Rabin passes with shrinking search length find the longest matches
among unmarked tokens, which are marked as tiles, longest first (ties by place in
the item, then in the text); what a tile leaves of a longer match is sought again
at its own length.  Each item token enters one tile at most, and tiles may come
in any order, so that reordered passages count in full.  A document is
contaminated by an item when tiles cover at least ``threshold`` (0.8) of the
item's tokens.

The items are a stated query set: they are taken in blocks of about
``BLOCK_BYTES`` of text, however many there are, and every block meets all
documents.  Items with fewer than ``min_match`` tokens match nothing.  An item
with a null id is reported like any other, with that null id.  Null texts count
as empty; rows are treated one by one, so repeated rows get equal results;
documents keep all their columns; empty tables on either side give no leaks.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StructField, StructType

from .tables import saved
from .text import U64, Words, blocks, plain, raw, strings, window_hash

BLOCK_BYTES = 8 << 20
MIN_MATCH, THRESHOLD = 5, 0.8
_SEED, _WHOLE = 0xA24BAED4963EE407, 0xD1342543DE82EF95
_KR_BASE, _KR_MOD = 1_000_003, (1 << 61) - 1
LEAKS = ArrayType(StructType([StructField("item_id", LongType()), StructField("coverage", DoubleType()), StructField("tiles", IntegerType())]))
_LEAKS = pa.list_(pa.struct([("item_id", pa.int64()), ("coverage", pa.float64()), ("tiles", pa.int32())]))


def gaps() -> np.ndarray:
    """Bytes that part tokens: white space, controls and ASCII punctuation."""
    table = np.zeros(256, bool)
    table[:128] = [not chr(i).isalnum() for i in range(128)]
    return table


def tokens(texts: pa.Array) -> tuple[Words, np.ndarray]:
    data, offsets = raw(strings(pc.utf8_lower(strings(texts))))
    return Words(data, offsets, gap=gaps()), offsets


class Items:
    """Benchmark items of a block: token names, and where each seed occurs."""

    def __init__(self, ids: list[int | None], texts: list[str], k: int = MIN_MATCH):
        self.k, self.ids = k, ids
        words, _ = tokens(pa.array(texts, pa.large_string()))
        self.names, self.first, self.size = words.hash, words.first, words.counts()
        owner = words.owner()
        seeds = window_hash(words.hash, k, _SEED)
        ok = np.flatnonzero(owner[: len(seeds)] == owner[k - 1 :]) if len(seeds) else np.zeros(0, np.int64)
        self.at = ok[np.argsort(seeds[ok], kind="stable")]  # seeds by name, as places among all items' tokens
        self.item = owner[self.at]
        self.unique, self.begin = np.unique(seeds[self.at], return_index=True)
        self.begin = np.append(self.begin, len(self.at))
        self.number = np.full(len(words.hash), -1, np.int64)  # of the seed at each token
        self.number[self.at] = np.repeat(np.arange(len(self.unique)), np.diff(self.begin))
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(self.unique & U64((1 << 20) - 1)).astype(np.int64)] = True

    def coverable(self, seeds: np.ndarray, threshold: float) -> np.ndarray:
        """Items of which ``seeds`` (distinct numbers) cover the threshold; the
        work is bounded by the block's seeds, whatever the document repeats."""
        n = self.begin[seeds + 1] - self.begin[seeds]
        rows = np.repeat(self.begin[seeds] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        at = np.sort(self.at[rows])  # by item, since items' tokens lie one after the other
        if not len(at):
            return at
        new = np.minimum(np.diff(at, prepend=at[0] - self.k), self.k)  # a seed never reaches into another item
        item = np.searchsorted(self.first, at, "right") - 1
        covered = np.bincount(item, new, len(self.size))
        return np.flatnonzero((covered > 0) & (covered >= threshold * self.size))

    def leaks(self, names: np.ndarray, hit: np.ndarray, seed: np.ndarray, threshold: float) -> list[dict]:
        """Items found in one document: ``names`` its tokens, ``hit`` the places
        of its seeds and ``seed`` the seeds' numbers."""
        found = self.coverable(np.unique(seed), threshold)
        if not len(found):
            return []
        order = np.argsort(seed, kind="stable")
        ranked, out = seed[order], []
        for i in found.tolist():
            own = self.names[self.first[i] : self.first[i + 1]]
            mine = self.number[self.first[i] : self.first[i + 1]]
            mine = np.unique(mine[mine >= 0])
            low, high = np.searchsorted(ranked, mine, "left"), np.searchsorted(ranked, mine, "right")
            where = np.sort(np.concatenate([hit[order[a:b]] for a, b in zip(low, high)]))
            tiles = greedy_tiles(own.tolist(), stretches(names, where, self.k, len(own)), self.k)
            covered = sum(t[2] for t in tiles)
            if covered >= threshold * len(own):
                out.append({"item_id": self.ids[i], "coverage": covered / len(own), "tiles": len(tiles)})
        return out


def stretches(names: np.ndarray, where: np.ndarray, k: int, length: int) -> list[int]:
    """The document's tokens under an item's seeds (``where``, sorted), stretches
    parted by -1.

    Of text repeated over and over only the first places are kept, without any
    effect on the tiles: an item of ``length`` tokens gets length // k tiles at
    most; each touches fewer than 2 * length places at which a stretch of that
    length may begin; and among equal stretches the first free one is taken.
    """
    edge = np.zeros(len(names) + 1, np.int32)
    np.add.at(edge, where, 1)
    np.add.at(edge, where + k, -1)
    inside = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
    breaks = np.flatnonzero(np.diff(inside) > 1) + 1
    row = np.insert(names[inside].astype(object), breaks, -1)
    most = (max(length // k, 1) - 1) * 2 * length + 1
    if len(row) <= 2 * most:
        return row.tolist()
    mark = np.insert(names[inside], breaks, U64(0))
    padded = np.concatenate([mark, np.zeros(length, U64)])
    whole = window_hash(padded, length, _WHOLE)[: len(row)]
    order = np.argsort(whole, kind="stable")
    new = np.concatenate([[True], whole[order][1:] != whole[order][:-1]])
    turn = np.arange(len(row)) - np.flatnonzero(new)[np.cumsum(new) - 1]
    kept = np.zeros(len(row) + length + 1, np.int32)
    begin = order[turn < most]
    np.add.at(kept, begin, 1)
    np.add.at(kept, begin + length, -1)
    left = np.flatnonzero(np.cumsum(kept)[: len(row)] > 0)
    return np.insert(row[left], np.flatnonzero(np.diff(left) > 1) + 1, -1).tolist()


def greedy_tiles(pattern: list[int], text: list[int], least: int) -> list[tuple[int, int, int]]:
    """(place in pattern, place in text, length) of tiles, by running Karp-Rabin:
    always the longest match left, then the first in the pattern and the text."""
    used_p, used_t = [False] * len(pattern), [x == -1 for x in text]
    tiles: list[tuple[int, int, int]] = []
    length = max(least, min(len(pattern), len(text)))
    while True:
        found = [(-n, p, t) for p, t, n in _scan(pattern, text, used_p, used_t, length)]
        heapq.heapify(found)
        while found:
            n, p, t = heapq.heappop(found)
            # what longer tiles have left of it, if that is still long enough, takes its turn at its own length
            at = 0
            for i in range(-n + 1):
                if i == -n or used_p[p + i] or used_t[t + i]:
                    if i - at == -n:
                        used_p[p : p + i], used_t[t : t + i] = [True] * i, [True] * i
                        tiles.append((p, t, i))
                    elif i - at >= length:
                        heapq.heappush(found, (at - i, p + at, t + at))
                    at = i + 1
        if length == least:
            return tiles
        length = max(least, length // 2)


def _scan(pattern: list[int], text: list[int], used_p: list[bool], used_t: list[bool], length: int) -> list[tuple[int, int, int]]:
    """Maximal matches of at least ``length`` unmarked tokens."""
    found: dict[int, list[int]] = {}
    for t, h in _rolling(text, used_t, length):
        found.setdefault(h, []).append(t)
    matches = []
    for p, h in _rolling(pattern, used_p, length):
        for t in found.get(h, ()):
            if p and t and not used_p[p - 1] and not used_t[t - 1] and pattern[p - 1] == text[t - 1]:
                continue  # part of a match that begins earlier
            n = 0
            while p + n < len(pattern) and t + n < len(text) and pattern[p + n] == text[t + n] and not used_p[p + n] and not used_t[t + n]:
                n += 1
            if n >= length:
                matches.append((p, t, n))
    return matches


def _rolling(row: list[int], used: list[bool], length: int) -> Iterator[tuple[int, int]]:
    """(place, Karp-Rabin hash) of every stretch of ``length`` unmarked tokens."""
    top = pow(_KR_BASE, length, _KR_MOD)
    h = free = 0
    for i, x in enumerate(row):
        if used[i]:
            h = free = 0
            continue
        h = (h * _KR_BASE + x) % _KR_MOD
        free += 1
        if free > length:
            h = (h - row[i - length] * top) % _KR_MOD
        if free >= length:
            yield i - length + 1, h


def _item_blocks(bench: DataFrame, item_col: str, text_col: str) -> Iterator[tuple[list[int | None], list[str]]]:
    ids, texts, size = [], [], 0
    for r in plain(bench, item_col, text_col).toDF("i", "t").where("t IS NOT NULL").toLocalIterator():
        ids.append(r.i)
        texts.append(r.t)
        size += len(r.t)
        if size >= BLOCK_BYTES:
            yield ids, texts
            ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def add_leaks(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", *, leaks_col: str = "leaks", min_match: int = MIN_MATCH, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with a last column of items that contaminate each document:
    array<struct<item_id bigint, coverage double, tiles int>>."""
    place = docs.columns.index(text_col)
    out = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))]).withColumn("leaks", F.lit(None).cast(LEAKS))
    n = 0
    for ids, texts in _item_blocks(bench, item_col, item_text_col):
        sent = docs.sparkSession.sparkContext.broadcast((ids, texts))  # one block of items
        if n:
            out = saved(out)  # so that a task holds one block only
        n += 1

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            items = Items(*sent.value, min_match)
            for batch in batches:
                column = strings(batch.column(place))
                for a, b in blocks(raw(column)[1]):
                    found = _leaks_of(items, column.slice(a, b - a), threshold)
                    old = batch.column(batch.num_columns - 1).slice(a, b - a).to_pylist()
                    leaks = pa.array([(x or []) + y for x, y in zip(old, found)], _LEAKS)
                    yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns[:-1], leaks], names=batch.schema.names)

        out = out.mapInArrow(run, out.schema)
    return out.withColumn("leaks", F.coalesce("leaks", F.array().cast(LEAKS))).toDF(*docs.columns, leaks_col)


def _leaks_of(items: Items, texts: pa.Array, threshold: float) -> list[list[dict]]:
    words, _ = tokens(texts)
    found: list[list[dict]] = [[] for _ in range(len(texts))]
    seeds = window_hash(words.hash, items.k, _SEED)
    if not len(seeds) or not len(items.unique):
        return found
    maybe = np.flatnonzero(items.maybe[(seeds & U64((1 << 20) - 1)).astype(np.int64)])
    at = np.minimum(np.searchsorted(items.unique, seeds[maybe]), len(items.unique) - 1)
    hit = items.unique[at] == seeds[maybe]
    rows, at = maybe[hit], at[hit]
    doc = np.searchsorted(words.first, rows, "right") - 1
    inside = rows + items.k <= words.first[doc + 1]
    rows, at, doc = rows[inside], at[inside], doc[inside]
    cut = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]])) if len(doc) else []
    for a, b in zip(cut, [*cut[1:], len(doc)]):
        found[doc[a]] = items.leaks(words.hash, rows[a:b], at[a:b], threshold)
    return found


def contamination(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """Per document: ``id_col``, contaminated (boolean), n_items (long),
    item_ids (string, ascending, comma-joined, ``null`` last for items without an
    id), max_coverage (double)."""
    found = add_leaks(plain(docs, id_col, text_col), bench, id_col, text_col, **kw)
    ids = F.array_sort(F.transform("leaks", lambda x: x["item_id"]))
    return found.select(id_col, (F.size("leaks") > 0).alias("contaminated"), F.size("leaks").cast("bigint").alias("n_items"), F.array_join(F.transform(ids, lambda i: F.coalesce(i.cast("string"), F.lit("null"))), ",").alias("item_ids"), F.coalesce(F.array_max(F.transform("leaks", lambda x: x["coverage"])), F.lit(0.0)).alias("max_coverage"))
