"""Near copies by the exact Jaccard similarity of five-word shingles.

Two texts link if their sets of shingles (ASCII lower case, 64-bit hashes) have
a similarity of at least ``PERCENT``; linked texts and equal sets form groups.
SimHashes alone would leave pairs to chance: at 0.8 they differ in ten bits of 64
on average, a radius at which segments select little.

1. Every text gets a name of its set and, from the same shingles, a SimHash;
   equal sets are one from then on.
2. First links.  Sets with one SimHash are compared with the least of them, the
   least sets of SimHashes that pigeonring filtering links (at the radius of
   ``simhash_dedup``) with each other, and so is every set in a bucket's lists (see
   3) with the next that may link: about as many pairs as sets, which join most of any large group of
   near copies.
3. The other links.  In any order of all shingles, two sets that link share one
   of the first ``n - ceil(0.8 n) + 1`` of each.  Those are sent to buckets of
   shingles, and sets meet there unless they are in one component already (a pair
   inside a component can join nothing), or their sizes or sketches rule the
   similarity out.  A sketch has ``SKETCH`` bits, each the parity of the shingles
   that fall to it: two sketches differ in no more bits than the sets in shingles.
   Shingles frequent in a sample come last in the order, which keeps lists short
   and changes no result.
4. Pairs that met are compared by how many shingles each set has in every of 256
   parts of all hashes: the counts differ by no more than the sets do, so that
   nothing is lost by leaving out pairs whose counts differ too much.  The sets of
   the pairs left are compared whole.  For both, pairs lie packed in a grid of
   cells by their two names, and a set goes once to each cell that asks for it, so
   that no pair is a row, and no set is sent once a pair.

Texts without words are equal; texts of fewer than five words are one shingle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .simhash_dedup import GROUP, majority, near_links, ranges
from .tables import drop, saved, text_bytes
from .text import U64, Words, mix, plain, texts_of, window_hash

SIZE, PERCENT, PARTS, SKETCH = 5, 80, 256, 512
SAMPLE_ROWS, FREQUENT, MOST_FREQUENT = 50_000, 8, 1 << 18
#: Rows of a list that the first links look at.
NEXT = 64
#: Text whose shingles of the first part meet in one bucket, about.
BUCKET_BYTES = 32 << 20
#: Text whose sets lie in one row or column of the grid, about.
CELL_BYTES = 64 << 20
PACKED_PAIRS = "cell bigint, us binary, vs binary"
DOC = np.dtype([("name", np.int64), ("root", np.int64), ("size", np.int64), ("sketch", U64, SKETCH // 64)])
_STEP = 0xA24BAED4963EE407
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Sets:
    """Distinct shingles of a block of texts: ``key[first[i] : first[i + 1]]`` in order of ``late`` and key."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, frequent: tuple[np.ndarray, np.ndarray] | None = None):
        words = Words(_LOWER[data], offsets, hashes=True)
        counts = words.counts()
        n = len(counts)
        keys, owners = [], []
        for k in range(min(SIZE, int(counts.max(initial=0))), 0, -1):
            h = window_hash(words.hash, k, _STEP)
            who = words.owner()[: len(h)]
            ok = words.owner()[k - 1 :] == who
            ok &= counts[who] >= SIZE if k == SIZE else counts[who] == k
            keys.append(mix(h[ok] + U64(k)))
            owners.append(who[ok])
        bare = np.flatnonzero(counts == 0)
        key = np.concatenate([*keys, np.zeros(len(bare), U64)])
        owner = np.concatenate([*owners, bare])
        late = np.zeros(len(key), np.int64)
        if frequent is not None and len(frequent[0]):
            at = np.minimum(np.searchsorted(frequent[0], key), len(frequent[0]) - 1)
            late = np.where(frequent[0][at] == key, frequent[1][at], 0)
        order = np.lexsort([key, late, owner])
        key, owner = key[order], owner[order]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])
        self.key, self.owner = key[new], owner[new]
        self.first = np.searchsorted(self.owner, np.arange(n + 1))
        self.size = np.diff(self.first)
        total = np.zeros(len(self.key) + 1, U64)
        np.cumsum(mix(self.key ^ U64(_STEP)), out=total[1:])
        self.name = mix(total[self.first[1:]] - total[self.first[:-1]] + self.size.astype(U64))

    def parts(self) -> np.ndarray:
        """How many shingles lie in each part, 255 at most (no difference grows by that)."""
        n = len(self.size)
        at = self.owner * PARTS + (self.key >> U64(56)).astype(np.int64)
        return np.minimum(np.bincount(at, minlength=n * PARTS), 255).astype(np.uint8).reshape(n, PARTS)


    def sketches(self) -> np.ndarray:
        """Per text, the parity of its shingles in each of SKETCH places, as bytes."""
        n = len(self.size)
        at = self.owner * SKETCH + (mix(self.key) >> U64(55)).astype(np.int64)
        return np.packbits((np.bincount(at, minlength=n * SKETCH) & 1).astype(bool).reshape(n, SKETCH), axis=1)


def _packed(bucket_of: np.ndarray, columns: dict[str, np.ndarray]) -> pa.RecordBatch:
    """One row per bucket, its part of every column as bytes."""
    order = np.argsort(bucket_of, kind="stable")
    some, at = np.unique(bucket_of[order], return_index=True)
    ends = [*at[1:].tolist(), len(order)]
    parts = {k: [x[order[i:j]].tobytes() for i, j in zip(at.tolist(), ends)] for k, x in columns.items()}
    return pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), *(pa.array(x, pa.binary()) for x in parts.values())], names=["bucket", *parts])


def _joined(t: pa.Table, name: str, kind) -> np.ndarray:
    return np.frombuffer(b"".join(t.column(name).to_pylist()), kind)


def frequent_shingles(docs: DataFrame, text_col: str, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles found often in a sample of texts, sorted, and how often."""
    step = max(1, rows // SAMPLE_ROWS)
    sample = docs.where(F.pmod(F.xxhash64(text_col), F.lit(step)) == 0)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in texts_of(pa.Table.from_batches([batch]), text_col):
                keys = Sets(data, offsets).key
                yield _packed((keys >> U64(60)).astype(np.int32), {"keys": keys})

    def count(t: pa.Table) -> pa.Table:
        keys, n = np.unique(_joined(t, "keys", U64), return_counts=True)
        top = np.argsort(-n, kind="stable")[: MOST_FREQUENT // 16]
        top = top[n[top] >= FREQUENT]
        return pa.table({"key": pa.array(keys[top].view(np.int64)), "n": pa.array(n[top], pa.int64())})

    found = sample.select(text_col).mapInArrow(send, "bucket int, keys binary").groupBy("bucket").applyInArrow(count, "key bigint, n bigint").toArrow()  # MOST_FREQUENT rows at most
    keys, n = found.column("key").to_numpy().view(U64), found.column("n").to_numpy()
    order = np.argsort(keys)
    return keys[order], n[order]


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= PERCENT * (len(a) + len(b) - both)


def may_link(docs: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether rows of ``docs`` are in different components, and their sizes and sketches allow a link."""
    a, b = docs["size"][x], docs["size"][y]
    ok = (docs["root"][x] != docs["root"][y]) & (PERCENT * np.maximum(a, b) <= 100 * np.minimum(a, b))
    at = np.flatnonzero(ok)
    for i in range(0, len(at), 1 << 16):
        part = at[i : i + (1 << 16)]
        apart = np.bitwise_count(docs["sketch"][x[part]] ^ docs["sketch"][y[part]]).sum(1, dtype=np.int64)
        ok[part] = (100 + PERCENT) * apart <= (100 - PERCENT) * (a[part] + b[part])
    return ok


def distinct(pairs: list[np.ndarray]) -> np.ndarray:
    """Distinct unordered pairs of small numbers."""
    both = np.concatenate([np.zeros((0, 2), np.int64), *pairs])
    code = np.unique(both.min(1, initial=1 << 31) << 32 | both.max(1, initial=0))
    return np.stack([code >> 32, code & 0xFFFFFFFF], 1)


def chained(keys: np.ndarray, who: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """In the lists of rows of ``docs`` that share a key, by size: each row with
    the next one that it may link with, among ``NEXT``."""
    rows, pairs = np.arange(len(keys)), []
    for k in range(1, NEXT + 1):
        rows = rows[rows + k < len(keys)]
        rows = rows[keys[rows] == keys[rows + k]]
        ok = may_link(docs, who[rows], who[rows + k])
        pairs.append(np.stack([who[rows[ok]], who[rows[ok] + k]], 1))
        rows = rows[~ok]
        if not len(rows):
            break
    return distinct(pairs)


def crossing(keys: np.ndarray, who: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """All pairs of rows of ``docs`` that share a key and whose components differ,
    if they may link.  The largest component of a list meets only the others, so
    that a list of one component costs nothing."""
    if not len(keys):
        return np.zeros((0, 2), np.int64)
    new = np.concatenate([[True], keys[1:] != keys[:-1]])
    start, row, roots = np.flatnonzero(new), np.cumsum(new) - 1, docs["root"][who]
    end = np.append(start[1:], len(keys))
    order = np.lexsort([roots, row])
    run = np.flatnonzero(np.concatenate([[True], (row[order][1:] != row[order][:-1]) | (roots[order][1:] != roots[order][:-1])]))
    most = np.lexsort([np.diff(np.append(run, len(keys))), row[order][run]])  # the last of each list is its largest component
    last = np.append(np.flatnonzero(np.diff(row[order][run][most])), len(most) - 1)
    small = np.flatnonzero(roots != roots[order][run][most][last][row])
    parts: list[np.ndarray] = []
    for x, y in ranges(start[row[small]], end[row[small]], small):
        ok = may_link(docs, who[x], who[y])
        parts.append(np.stack([who[x[ok]], who[y[ok]]], 1))
        if len(parts) > 16:
            parts = [distinct(parts)]
    return distinct(parts)


def near_copy_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, text_hash (xxhash64 of the text), root (the group) and
    component_id (the least id of the group) of every row with an id."""
    chosen = plain(docs, id_col, text_col).where(F.col(id_col).isNotNull())
    kind = dict(chosen.dtypes)[id_col]

    def outline(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in texts_of(pa.Table.from_batches([batch]), text_col):
                s = Sets(data, offsets)
                fp = majority(s.key, s.first)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(2).slice(a, b - a), pa.array(s.name.view(np.int64)), pa.array(s.size, pa.int64()), pa.array(fp.view(np.int64)), pa.array([x.tobytes() for x in s.parts()], pa.binary())], names=[id_col, "text_hash", "name", "size", "fp", "parts"])

    outlined = saved(chosen.withColumn("text_hash", F.xxhash64(text_col)).mapInArrow(outline, f"`{id_col}` {kind}, text_hash bigint, name bigint, size bigint, fp bigint, parts binary"))
    named = outlined.select(id_col, "text_hash", "name")
    # one holder of every set: equal sets are compared once
    holders = saved(named.groupBy("name").agg(F.min(id_col).alias(id_col)))
    total = text_bytes(chosen, text_col)
    buckets, side = max(16, -(-total // BUCKET_BYTES)), max(8, -(-total // CELL_BYTES))
    sent = chosen.sparkSession.sparkContext.broadcast(frequent_shingles(chosen, text_col, named.count()))  # bounded

    def first_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in texts_of(pa.Table.from_batches([batch]), text_col):
                s = Sets(data, offsets, sent.value)
                part = s.size - -(-PERCENT * s.size // 100) + 1
                yield pa.RecordBatch.from_arrays([pa.array(s.name.view(np.int64)), pa.array(s.size, pa.int64()), pa.array([s.key[i : i + n].tobytes() for i, n in zip(s.first[:-1], part)], pa.binary()), pa.array([x.tobytes() for x in s.sketches()], pa.binary())], names=["name", "size", "keys", "sketch"])

    held = chosen.join(holders.select(id_col).distinct(), id_col, "left_semi").select(text_col).mapInArrow(first_part, "name bigint, size bigint, keys binary, sketch binary")
    firsts = saved(held.dropDuplicates(["name"]))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs = np.zeros(len(batch), DOC)
            docs["name"], docs["size"], docs["root"] = (batch.column(i).to_numpy() for i in (0, 1, 4))
            docs["sketch"] = np.frombuffer(b"".join(batch.column(3).to_pylist()), U64).reshape(len(batch), -1)
            lists = [np.frombuffer(x.as_buffer(), U64) for x in batch.column(2)]
            keys, who = np.concatenate(lists), np.repeat(np.arange(len(batch)), [len(x) for x in lists])
            bucket = (keys % U64(buckets)).astype(np.int64)
            order = np.lexsort([who, bucket])
            keys, who, bucket = keys[order], who[order], bucket[order]
            # rows of each bucket, and the documents that they belong to
            cut = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(keys) else []
            rows = []
            for i, j in zip(cut, [*cut[1:], len(keys)]):
                own, at = np.unique(who[i:j], return_inverse=True)
                rows.append((int(bucket[i]), keys[i:j].tobytes(), at.astype(np.int32).tobytes(), docs[own].tobytes()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in rows], pa.int32()), *(pa.array([x[k] for x in rows], pa.binary()) for k in (1, 2, 3))], names=["bucket", "keys", "who", "docs"])

    def pack(u: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
        """Pairs of names, a row for each cell of the grid."""
        u, v = np.minimum(u, v), np.maximum(u, v)
        cell = (u.view(U64) % U64(side)).astype(np.int64) * side + (v.view(U64) % U64(side)).astype(np.int64)
        order = np.argsort(cell, kind="stable")
        some, at = np.unique(cell[order], return_index=True)
        ends = [*at[1:].tolist(), len(order)]
        columns = [[x[order[i:j]].tobytes() for i, j in zip(at.tolist(), ends)] for x in (u, v)]
        return pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), *(pa.array(x, pa.binary()) for x in columns)], names=["cell", "us", "vs"])

    def met(rows: DataFrame, pairs_of) -> DataFrame:
        def meet(t: pa.Table) -> pa.Table:
            docs = [np.frombuffer(x, DOC) for x in t.column("docs").to_pylist()]
            before = np.cumsum([0, *map(len, docs)])
            who = [np.frombuffer(x, np.int32) + n for x, n in zip(t.column("who").to_pylist(), before)]
            docs, who, keys = np.concatenate(docs), np.concatenate(who), _joined(t, "keys", U64)
            order = np.lexsort([docs["name"][who], docs["size"][who], keys])
            same = keys[order][1:] == keys[order][:-1]
            order = order[np.append(same, False) | np.insert(same, 0, False)]  # lists of two or more
            found = docs["name"][pairs_of(keys[order], who[order], docs)]
            return pa.Table.from_batches([pack(found[:, 0], found[:, 1])])

        schema = "bucket int, keys binary, who binary, docs binary"
        return rows.select("name", "size", "keys", "sketch", "root").mapInArrow(deal, schema).groupBy("bucket").applyInArrow(meet, PACKED_PAIRS)

    def packed_pairs(pairs: DataFrame) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pack(batch.column(0).to_numpy(), batch.column(1).to_numpy())

        return pairs.select("u", "v").mapInArrow(run, PACKED_PAIRS)

    def pairs_in(t: pa.Table) -> np.ndarray:
        """Distinct pairs of a cell."""
        pairs = np.stack([_joined(t, "us", np.int64), _joined(t, "vs", np.int64)], 1)
        order = np.lexsort([pairs[:, 1], pairs[:, 0]])
        pairs = pairs[order]
        return pairs[np.concatenate([[True], (pairs[1:] != pairs[:-1]).any(1)])] if len(pairs) else pairs

    def need(t: pa.Table) -> pa.Table:
        names = np.unique(pairs_in(t))
        return pa.table({"cell": pa.array(np.full(len(names), t.column("cell")[0].as_py()), pa.int64()), "name": pa.array(names)})

    def places(pairs: np.ndarray, t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows of ``t`` by name, and the places of both names of each pair among them."""
        names = t.column("name").to_numpy()
        order = np.argsort(names)
        return order, *(np.searchsorted(names[order], pairs[:, i]) for i in (0, 1))

    def sift(t: pa.Table, sets: pa.Table) -> pa.Table:
        pairs = pairs_in(t)
        order, x, y = places(pairs, sets)
        counts = np.frombuffer(b"".join(sets.column("parts").to_pylist()), np.uint8).reshape(-1, PARTS)[order]
        size, maybe = sets.column("size").to_numpy()[order], np.zeros(len(pairs), bool)
        for i in range(0, len(pairs), 1 << 14):
            a, b = x[i : i + (1 << 14)], y[i : i + (1 << 14)]
            apart = np.abs(counts[a].astype(np.int16) - counts[b]).sum(1, dtype=np.int64)
            maybe[i : i + (1 << 14)] = (100 + PERCENT) * apart <= (100 - PERCENT) * (size[a] + size[b])
        return pa.Table.from_batches([pack(pairs[maybe, 0], pairs[maybe, 1])])

    def compare(t: pa.Table, sets: pa.Table) -> pa.Table:
        pairs = pairs_in(t)
        order, x, y = places(pairs, sets)
        bodies = [np.frombuffer(sets.column("body")[int(i)].as_buffer(), U64) for i in order]
        near = np.array([similar(bodies[i], bodies[j]) for i, j in zip(x.tolist(), y.tolist())], bool)
        return pa.table({"u": pa.array(pairs[near, 0]), "v": pa.array(pairs[near, 1])})

    def bodies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in texts_of(pa.Table.from_batches([batch]), text_col):
                s = Sets(data, offsets)
                yield pa.RecordBatch.from_arrays([pa.array(s.name.view(np.int64)), pa.array([s.key[i:j].tobytes() for i, j in zip(s.first[:-1], s.first[1:])], pa.binary())], names=["name", "body"])

    def verified(pairs: DataFrame) -> DataFrame:
        """The pairs that are similar, by counts and then by whole sets."""
        pairs = saved(pairs)
        asked = pairs.groupBy("cell").applyInArrow(need, "cell bigint, name bigint").join(prints.select("name", "size", "parts"), "name")
        sifted = saved(pairs.groupBy("cell").cogroup(asked.groupBy("cell")).applyInArrow(sift, PACKED_PAIRS))
        drop(pairs)
        asked = saved(sifted.groupBy("cell").applyInArrow(need, "cell bigint, name bigint"))
        names = asked.select("name").distinct()
        ids = holders.join(names, "name", "left_semi").select(id_col).distinct()
        sets = chosen.join(ids, id_col, "left_semi").select(text_col).mapInArrow(bodies, "name bigint, body binary").join(names, "name", "left_semi").dropDuplicates(["name"])
        links = saved(sifted.groupBy("cell").cogroup(asked.join(sets, "name").groupBy("cell")).applyInArrow(compare, "u bigint, v bigint"))
        for done in (asked, sifted):
            drop(done)
        return links

    prints = saved(outlined.groupBy("name").agg(F.min("fp").alias("fp"), F.min("size").alias("size"), F.min("parts").alias("parts")))
    fps = saved(prints.select("fp").distinct())
    least = prints.groupBy("fp").agg(F.min("name").alias("least"))
    stars = prints.join(least, "fp").select(F.col("name").alias("u"), F.col("least").alias("v"))
    near = near_links(fps, max(16, -(-12 * fps.count() // GROUP)))
    near = near.join(least.toDF("u", "a"), "u").join(least.toDF("v", "b"), "v").select(F.col("a").alias("u"), F.col("b").alias("v"))
    first = packed_pairs(stars.unionByName(near).where("u <> v"))
    links = verified(first.unionByName(met(firsts.withColumn("root", F.col("name")), chained)))
    roots = saved(components(links))
    rooted = firsts.join(roots, F.col("name") == F.col("node"), "left").select("name", "size", "keys", "sketch", F.coalesce("root", "name").alias("root"))
    more = verified(met(rooted, crossing))
    if not more.isEmpty():  # links between components, as links of their roots
        for end in ("u", "v"):
            more = more.join(roots.toDF("node", f"{end}_root"), F.col(end) == F.col("node"), "left").drop("node")
        over = components(more.select(F.coalesce("u_root", "u").alias("u"), F.coalesce("v_root", "v").alias("v")))
        both = roots.unionByName(more.select(F.col("u").alias("node"), F.col("u").alias("root"))).unionByName(more.select(F.col("v").alias("node"), F.col("v").alias("root")))
        both = both.groupBy("node").agg(F.min_by("root", F.col("root") == F.col("node")).alias("root"))
        roots = both.join(over.toDF("old", "new"), F.col("root") == F.col("old"), "left").select("node", F.coalesce("new", "root").alias("root"))
    for done in (firsts, prints, fps):
        drop(done)
    grouped = named.join(roots, F.col("name") == F.col("node"), "left").select(id_col, "text_hash", F.coalesce("root", "name").alias("root"))
    least = grouped.groupBy("root").agg(F.min(id_col).alias("component_id"))
    return grouped.join(least, "root").select(id_col, "text_hash", "root", "component_id")
