"""Masked pseudo-likelihood of documents under a bidirectional window network.

Every word is predicted from the words around it on both sides, itself masked;
the sum of the conditional log-probabilities scores a document.

A word's probability has three factors: that of its class given the context, that
of its tier within the class given the context, both from the network, and its
share of the counts of its class and tier.

1. Counting.  Every distinct word of the corpus gets its exact count and a
   signature, the sum of random signs of the words around its occurrences, so
   that words used alike have like signatures.  The table has a row for each
   distinct word, lies in buckets of names and grows with the corpus.
2. Classes.  ``CLASSES`` centres are fitted (spherical k-means) to the signatures
   of the ``CENTRE_WORDS`` most frequent words; every word belongs to its nearest
   centre, and to a tier by the octave of its count, so that frequent words have
   their tier almost for themselves.
3. Encoding.  Groups of documents ask the buckets for their distinct words once
   and write every document as a row of classes and tiers.
4. Training.  The network sums embeddings of the classes of the ``2 * REACH``
   nearest words, place by place (one of its own beyond a text's ends), and the
   mean embedding of class and tier over the ``2 * WIDE`` words around, and takes a
   tanh layer of ``HIDDEN`` units and two softmaxes.  Documents are dealt into shards of about
   ``SHARD_TOKENS`` by a hash.  In each of ``rounds`` every shard takes Adam steps
   through its documents of that round, from common weights, and the weights are
   averaged by tokens; the rounds together cover every token of every document.
   The first weights are those of the counts alone.

Shards, their order and the sums depend on ids and words alone, so that the model
is the same however rows lie in files and partitions, or after a lost executor, and
so are the scores but for the rounding of 32-bit numbers.  The driver holds centres, cell totals and weights, of fixed size.

Null text counts as empty: no tokens, a sum of 0 and a null mean.  Repeated rows
get equal scores; an empty table gives an empty table; extra columns are left
aside.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .grouped import PACKED, answers, by_group, dealt, entries, packed, with_answers
from .tables import drop, saved
from .text import U64, Words, plain, texts_of

CLASSES, TIERS, HIDDEN, REACH, WIDE = 64, 24, 16, 2, 8
SIGNS, CENTRE_WORDS = 16, 4096
SLICES, BATCH, SHARD_TOKENS, ROUNDS = 64, 2048, 2 << 20, 3
#: Text whose counts a task holds before it sends them on.
COUNTED_BYTES = 16 << 20
OFFSETS = tuple(k for k in range(-REACH, REACH + 1) if k)
SENT = np.dtype([("n", np.uint32), ("signs", np.int16, SIGNS)])
KNOWN = np.dtype([("n", np.int64), ("signs", np.float32, SIGNS)])
TOLD = np.dtype([("cell", np.uint16), ("share", np.float32)])


def shifted(x: np.ndarray, owner: np.ndarray, k: int, beyond) -> np.ndarray:
    """``x`` of the word ``k`` places on in the same text, ``beyond`` where there is none."""
    out = np.full(x.shape, beyond, x.dtype)
    if abs(k) < len(x):
        a, b = (slice(-k, None), slice(None, k)) if k < 0 else (slice(None, -k), slice(k, None))
        out[a] = np.where(owner[a] == owner[b], x[b], out.dtype.type(beyond))
    return out


def added(keys: np.ndarray, n: np.ndarray, signs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in order, with the sums of their counts and signatures."""
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    at = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, int)
    if not len(at):
        return keys, n, signs
    if signs.dtype == np.int8:  # most words of a block come once: their rows need no sums
        total = signs[order[at]].astype(np.int32)
        many = np.diff(np.append(at, len(k))) > 1
        rows = order[np.repeat(many, np.diff(np.append(at, len(k))))]
        size = np.diff(np.append(at, len(k)))[many]
        if len(rows):
            total[many] = np.add.reduceat(signs[rows], np.cumsum(size) - size, axis=0, dtype=np.int32)
        return k[at], np.add.reduceat(n[order], at), total
    # sums of what was sent are whole numbers, exact in any order
    return k[at], np.add.reduceat(n[order], at), np.add.reduceat(signs[order], at, axis=0, dtype=np.float64 if signs.dtype == np.int16 else signs.dtype)


def counts_of(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words of a block, their counts and signatures."""
    owner = words.owner()
    own = (np.unpackbits(words.hash.view(np.uint8).reshape(-1, 8)[:, :2], axis=1)[:, :SIGNS].astype(np.int8) << 1) - 1
    around = np.zeros(own.shape, np.int8)  # sums of four signs
    for k in range(1, REACH + 1):
        if k < len(owner):
            same = (owner[k:] == owner[:-k]).astype(np.int8)[:, None]
            around[k:] += own[:-k] * same
            around[:-k] += own[k:] * same
    return added(words.hash, np.ones(len(words.hash), np.int64), around)


def count_words(docs: DataFrame, text_col: str, buckets: int) -> DataFrame:
    """A row for each bucket: its distinct words, packed with counts and signatures."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def send():
            k, n, s = added(*(np.concatenate(x) for x in zip(*held)))
            while len(k):  # sums beyond 16 bits go in several entries: nothing is cut off
                rest = np.zeros(len(k), SENT)
                rest["n"], rest["signs"] = n, np.clip(s, -32767, 32767)
                yield from packed(0, k, rest, buckets).to_batches()
                more = (s > 32767).any(1) | (s < -32767).any(1)
                k, n, s = k[more], np.zeros(more.sum(), np.int64), s[more] - rest["signs"][more]

        for batch in batches:
            for _, _, data, offsets in texts_of(pa.Table.from_batches([batch]), text_col):
                held.append(counts_of(Words(data, offsets)))
                size += len(data)
                if len(held) > 3:  # so that no more than a few blocks' words lie side by side
                    held = [added(*(np.concatenate(x) for x in zip(*held)))]
                if size >= COUNTED_BYTES:
                    yield from send()
                    held, size = [], 0
        if held:
            yield from send()

    def add(t: pa.Table) -> pa.Table:
        keys, _, rest = entries(t, SENT)
        k, n, s = added(keys, rest["n"].astype(np.int64), rest["signs"])
        out = np.zeros(len(k), KNOWN)
        out["n"], out["signs"] = n, s
        return pa.table({"bucket": t.column("bucket")[:1], "part": t.column("part")[:1], "keys": pa.array([k.tobytes()], pa.binary()), "rest": pa.array([out.tobytes()], pa.binary())})

    return plain(docs, text_col).mapInArrow(run, PACKED).groupBy("bucket").applyInArrow(add, PACKED)


def directions(n: np.ndarray, signs: np.ndarray, mean: np.ndarray) -> np.ndarray:
    x = signs / np.maximum(n, 1)[:, None] - mean
    return x / np.maximum(np.sqrt((x * x).sum(1)), 1e-9)[:, None]


class Classes:
    """Centres of signatures, and the totals of every class and tier."""

    def __init__(self, mean: np.ndarray, centres: np.ndarray, totals: np.ndarray | None = None):
        self.mean, self.centres, self.totals = mean, centres, totals

    @classmethod
    def fit(cls, n: np.ndarray, signs: np.ndarray, rounds: int = 20) -> Classes:
        """Spherical k-means from the most frequent words on, each starting a
        centre where it is far from those before it."""
        if not len(n):
            return cls(np.zeros(SIGNS), np.zeros((CLASSES, SIGNS)))
        mean = signs.sum(0) / n.sum()
        x = directions(n, signs, mean)
        centres, near = x[:1], x @ x[0]
        while len(centres) < CLASSES:
            new = int(np.argmin(near))
            centres = np.vstack([centres, x[new]])
            near = np.maximum(near, x @ x[new])
        weight = np.sqrt(n.astype(float))[:, None]
        for _ in range(rounds):
            of = (x @ centres.T).argmax(1)
            for c in range(CLASSES):
                total = (x[of == c] * weight[of == c]).sum(0)
                size = np.sqrt(total @ total)
                if size > 1e-9:
                    centres[c] = total / size
        return cls(mean, centres)

    def cells(self, n: np.ndarray, signs: np.ndarray) -> np.ndarray:
        """Class and tier of words, as one number."""
        of = np.concatenate([(directions(n[a : a + 65536], signs[a : a + 65536], self.mean) @ self.centres.T).argmax(1) for a in range(0, len(n), 65536)]) if len(n) else np.zeros(0, int)
        return (of * TIERS + np.minimum(np.log2(np.maximum(n, 1)), TIERS - 1).astype(int)).astype(np.uint16)


def classes_of(words: DataFrame) -> Classes:
    def frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(len(batch)):
                keys, _, rest = entries(pa.Table.from_batches([batch.slice(row, 1)]), KNOWN)
                top = np.lexsort([keys, -rest["n"]])[:CENTRE_WORDS]
                yield pa.RecordBatch.from_arrays([pa.array(keys[top].view(np.int64)), pa.array(rest["n"][top]), pa.array([x.tobytes() for x in rest["signs"][top]], pa.binary())], names=["key", "n", "signs"])

    top = words.mapInArrow(frequent, "key bigint, n bigint, signs binary").orderBy(F.desc("n"), "key").limit(CENTRE_WORDS).collect()
    classes = Classes.fit(np.array([r.n for r in top], np.int64), np.array([np.frombuffer(r.signs, np.float32) for r in top], float).reshape(-1, SIGNS))

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CLASSES * TIERS, np.int64)
        for batch in batches:
            for row in range(len(batch)):
                _, _, rest = entries(pa.Table.from_batches([batch.slice(row, 1)]), KNOWN)
                np.add.at(total, classes.cells(rest["n"], rest["signs"]), rest["n"])
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some])], names=["cell", "n"])

    classes.totals = np.zeros(CLASSES * TIERS, np.int64)
    for r in words.mapInArrow(totals, "cell int, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).collect():  # a row per cell
        classes.totals[r["cell"]] = r["n"]
    return classes


def encode(docs: DataFrame, words: DataFrame, classes: Classes, id_col: str, text_col: str) -> DataFrame:
    """``id_col``, n_tokens, share (the sum of the words' log shares of their
    cells), cells (class and tier of every word, two bytes each)."""
    kind = dict(docs.dtypes)[id_col]
    rows, _, buckets = dealt(docs, id_col, text_col)

    def ask(part: int, t: pa.Table) -> pa.Table:
        found = [np.unique(Words(data, offsets).hash) for _, _, data, offsets in texts_of(t, text_col)]
        return packed(part, np.unique(np.concatenate(found)) if found else np.zeros(0, U64), None, buckets)

    def tell(asked: pa.Table, known: pa.Table) -> pa.Table:
        keys, part, _ = entries(asked)
        names, _, rest = entries(known, KNOWN)
        at = np.searchsorted(names, keys)  # every word asked for is known
        cell = classes.cells(rest["n"], rest["signs"])
        told = np.zeros(len(keys), TOLD)
        told["cell"] = cell[at]
        told["share"] = np.log(rest["n"][at]) - np.log(classes.totals[cell[at]])
        return answers(part, keys, told)

    def write(part: int, t: pa.Table, told: pa.Table) -> pa.Table:
        keys, _, rest = entries(told, TOLD)
        order = np.argsort(keys)
        keys, rest = keys[order], rest[order]
        out = []
        for a, b, data, offsets in texts_of(t, text_col):
            w = Words(data, offsets)
            at = np.searchsorted(keys, w.hash)
            total = np.concatenate([[0], np.cumsum(rest["share"][at].astype(float))])
            cells = rest["cell"][at]
            out.append(pa.table({id_col: t.column(id_col).slice(a, b - a), "n_tokens": pa.array(w.counts(), pa.int64()), "share": pa.array(total[w.first[1:]] - total[w.first[:-1]]), "cells": pa.array([cells[i:j].tobytes() for i, j in zip(w.first[:-1], w.first[1:])], pa.binary())}))
        return pa.concat_tables(out)

    told = by_group(rows, ask).groupBy("bucket").cogroup(words.groupBy("bucket")).applyInArrow(tell, PACKED)
    return with_answers(rows, told, write, f"`{id_col}` {kind}, n_tokens bigint, share double, cells binary")


class Encoded:
    """Classes and tiers of the words of some encoded documents, and where their windows lie."""

    def __init__(self, lengths: np.ndarray, cells: np.ndarray):
        owner = np.repeat(np.arange(len(lengths)), lengths)
        ends = np.cumsum(lengths)
        self.own, self.tier = (cells // TIERS).astype(np.uint8), (cells % TIERS).astype(np.uint8)
        self.near = [shifted(self.own, owner, k, CLASSES) for k in OFFSETS]
        place = np.arange(len(cells))
        self.low, self.high = np.maximum(place - WIDE, (ends - lengths)[owner]), np.minimum(place + WIDE + 1, ends[owner])

    def batches(self) -> Iterator[tuple[int, int]]:
        for a in range(0, len(self.own), BATCH):
            yield a, min(a + BATCH, len(self.own))


class Network:
    """Weights in one vector; predictions and gradients for the words from ``a`` to ``b`` of encoded documents."""

    SHAPES = ((len(OFFSETS), CLASSES + 1, HIDDEN), (CLASSES, HIDDEN), (TIERS, HIDDEN), (HIDDEN,), (HIDDEN, CLASSES), (CLASSES,), (HIDDEN, TIERS), (CLASSES, TIERS))

    def __init__(self, vector: np.ndarray | None = None):
        sizes = [int(np.prod(s)) for s in self.SHAPES]
        if vector is None:
            vector = (np.random.default_rng(0).standard_normal(sum(sizes)) * 0.1).astype(np.float32)
        self.vector = vector.astype(np.float32).copy()
        at = np.cumsum([0, *sizes])
        self.near, self.wide_class, self.wide_tier, self.bias, self.to_class, self.class_prior, self.to_tier, self.tier_prior = (self.vector[a:b].reshape(s) for a, b, s in zip(at, at[1:], self.SHAPES))

    @classmethod
    def starting(cls, totals: np.ndarray) -> Network:
        """One that knows the counts of classes and tiers and nothing of contexts."""
        net, n = cls(), totals.reshape(CLASSES, TIERS) + 0.01
        net.class_prior[:] = np.log(n.sum(1) / n.sum())
        net.tier_prior[:] = np.log(n / n.sum(1, keepdims=True))
        net.to_class[:], net.to_tier[:] = net.to_class / 10, net.to_tier / 10
        return net

    @staticmethod
    def _around(x: Encoded, a: int, b: int) -> tuple[int, int, np.ndarray]:
        """The stretch that the windows of a..b reach, and one over each window's size."""
        return int(x.low[a]), int(x.high[b - 1]), (1 / np.maximum(x.high[a:b] - x.low[a:b] - 1, 1)).astype(np.float32)[:, None]

    def hidden(self, x: Encoded, a: int, b: int) -> np.ndarray:
        first, last, share = self._around(x, a, b)
        around = self.wide_class[x.own[first:last]]
        around += self.wide_tier[x.tier[first:last]]
        total = np.zeros((last - first + 1, HIDDEN), np.float32)
        np.cumsum(around, 0, out=total[1:])
        h = (total[x.high[a:b] - first] - total[x.low[a:b] - first] - around[a - first : b - first]) * share
        h += self.bias
        for k in range(len(OFFSETS)):
            h += self.near[k][x.near[k][a:b]]
        return np.tanh(h, out=h)

    def scores(self, h: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of every class, and of every tier within the class ``own``, a column for
        each word; logarithms but for a constant a word."""
        of_class, of_tier = self.to_class.T @ h.T, self.to_tier.T @ h.T
        of_class += self.class_prior[:, None]
        of_tier += self.tier_prior.T[:, own]
        return of_class, of_tier

    @staticmethod
    def chosen(z: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Log-probability of one row of each column."""
        z -= z.max(0)
        found = z[target, np.arange(z.shape[1])]
        return (found - np.log(np.exp(z, out=z).sum(0))).astype(float)

    @staticmethod
    def gap(z: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Probabilities less the target's one, over the number of words."""
        n = z.shape[1]
        z -= z.max(0)
        np.exp(z, out=z)
        z *= 1 / (z.sum(0) * n)
        z[target, np.arange(n)] -= np.float32(1 / n)
        return z

    def log_likelihoods(self, x: Encoded) -> np.ndarray:
        """Of every word's class and tier."""
        out = [np.zeros(0)]
        for a, b in x.batches():
            of_class, of_tier = self.scores(self.hidden(x, a, b), x.own[a:b])
            out.append(self.chosen(of_class, x.own[a:b]) + self.chosen(of_tier, x.tier[a:b]))
        return np.concatenate(out)

    def gradient(self, x: Encoded, a: int, b: int) -> np.ndarray:
        """Of the mean negative log-likelihood."""
        n, own = b - a, x.own[a:b]
        h = self.hidden(x, a, b)
        of_class, of_tier = self.scores(h, own)
        of_class, of_tier = self.gap(of_class, own), self.gap(of_tier, x.tier[a:b])
        back = (self.to_class @ of_class + self.to_tier @ of_tier) * (1 - h * h).T  # a row for each unit
        # a word is in the windows of the words in its own window
        first, last, share = self._around(x, a, b)
        shared = back * share[:, 0]
        total = np.zeros((HIDDEN, n + 1), np.float32)
        np.cumsum(shared, 1, out=total[:, 1:])
        wide = total[:, np.clip(x.high[first:last], a, b) - a] - total[:, np.clip(x.low[first:last], a, b) - a]
        wide[:, a - first : b - first] -= shared

        def by_word(at: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
            return np.stack([np.bincount(at, row, size) for row in values], 1)

        parts = [by_word(x.near[k][a:b], back, CLASSES + 1) for k in range(len(OFFSETS))]
        parts += [by_word(x.own[first:last], wide, CLASSES), by_word(x.tier[first:last], wide, TIERS)]
        parts += [back.sum(1), (of_class @ h).T, of_class.sum(1), (of_tier @ h).T, by_word(own, of_tier, CLASSES)]
        return np.concatenate([p.ravel() for p in parts]).astype(np.float32)


def parts_of(cells: list[bytes], tokens: int = 1 << 18) -> Iterator[tuple[int, int, Encoded]]:
    """(from, to, documents) of about so many tokens, documents always whole."""
    lengths = np.array([len(x) // 2 for x in cells], np.int64)
    ends, at = np.cumsum(lengths), 0
    while at < len(cells):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + tokens, "right")))
        yield at, to, Encoded(lengths[at:to], np.frombuffer(b"".join(cells[at:to]), np.uint16))
        at = to


def train(encoded: DataFrame, totals: np.ndarray, id_col: str, rounds: int = ROUNDS, rate: float = 0.01) -> Network:
    """Weights after all rounds, from those that the counts give; ``encoded`` has
    ``id_col`` and cells."""
    network = Network.starting(totals)
    tokens = encoded.agg(F.sum("n_tokens")).first()[0] or 0
    shards = max(1, -(-tokens // (rounds * SHARD_TOKENS)))
    key = F.xxhash64(id_col, "cells")
    turns = encoded.where("n_tokens > 0").select(F.pmod(key, F.lit(rounds)).alias("turn"), F.pmod(F.shiftright(key, 20), F.lit(shards)).cast("int").alias("shard"), key.alias("place"), "cells")
    size, schema = len(network.vector) + 1, "slice int, shard int, body binary"

    def learner(sent, rate: float):
        def learn(t: pa.Table) -> pa.Table:
            t = t.sort_by([("place", "ascending"), ("cells", "ascending")])
            net, n, step = Network(sent.value), 0, 0
            m, v = np.zeros_like(net.vector), np.zeros_like(net.vector)
            for _, _, part in parts_of(t.column("cells").to_pylist()):
                for a, b in part.batches():
                    g = net.gradient(part, a, b)
                    step += 1
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    net.vector -= np.float32(rate) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
                n += len(part.own)
            shard = t.column("shard")[0].as_py()
            return pa.table({"slice": pa.array([shard % SLICES], pa.int32()), "shard": pa.array([shard], pa.int32()), "body": pa.array([np.append(net.vector.astype(float) * n, n).tobytes()], pa.binary())})

        return learn

    def add(t: pa.Table) -> pa.Table:
        total = np.zeros(size)
        for x in t.sort_by("shard").column("body").to_pylist():
            total += np.frombuffer(x)
        return pa.table({"slice": t.column("slice").slice(0, 1), "shard": t.column("shard").slice(0, 1), "body": pa.array([total.tobytes()], pa.binary())})

    for turn in range(rounds):
        sent = encoded.sparkSession.sparkContext.broadcast(network.vector)  # fixed size
        learnt = turns.where(F.col("turn") == turn).groupBy("shard").applyInArrow(learner(sent, rate / (1 << turn)), schema)
        got = learnt.groupBy("slice").applyInArrow(add, schema).collect()  # SLICES rows at most
        if got:
            total = sum(np.frombuffer(r["body"]) for r in sorted(got, key=lambda r: r["slice"]))
            network = Network(total[:-1] / total[-1])
    return network


def score(encoded: DataFrame, network: Network, id_col: str) -> DataFrame:
    """``id_col``, n_tokens (long), log_likelihood, mean_log_likelihood (double)."""
    kind = dict(encoded.dtypes)[id_col]
    sent = encoded.sparkSession.sparkContext.broadcast(network.vector)  # fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        network = Network(sent.value)
        for batch in batches:
            lengths = batch.column(1).to_numpy()
            for a, b, part in parts_of(batch.column(3).to_pylist()):
                total = np.concatenate([[0], np.cumsum(network.log_likelihoods(part))])
                ends = np.concatenate([[0], np.cumsum(lengths[a:b])])
                found = total[ends[1:]] - total[ends[:-1]] + batch.column(2).slice(a, b - a).to_numpy()
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(found)], names=[id_col, "n_tokens", "log_likelihood"])

    out = encoded.select(id_col, "n_tokens", "share", "cells").mapInArrow(run, f"`{id_col}` {kind}, n_tokens bigint, log_likelihood double")
    return out.withColumn("mean_log_likelihood", F.when(F.col("n_tokens") > 0, F.col("log_likelihood") / F.col("n_tokens")))


def encoded_corpus(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, np.ndarray]:
    """Every document as classes and tiers, in a table of the shared folder, and
    the totals of classes and tiers."""
    chosen = plain(docs, id_col, text_col)
    _, _, buckets = dealt(chosen, id_col, text_col)
    words = saved(count_words(chosen, text_col, buckets))
    classes = classes_of(words)
    encoded = saved(encode(chosen, words, classes, id_col, text_col))
    drop(words)
    return encoded, classes.totals


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    encoded, totals = encoded_corpus(docs, id_col, text_col)
    return score(encoded, train(encoded, totals, id_col, **kw), id_col)
