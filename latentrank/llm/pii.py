"""Personal data by fixed patterns and a skip-chain conditional random field.

The patterns give base spans (e-mail, IP, payment card, phone).  The random
field then labels the tokens that hold a digit or an "@".  A token's states are
"none" and the four kinds.  Its own potential comes from its shape and from the
word before it; neighbours in the text share a chain potential; occurrences of
the same or a similar token, however far apart, share a skip potential.  Each
occurrence is linked to the one before it and to the first, so that the graph
stays linear in the text and no two occurrences are more than two links apart.
Tokens under a base span are observed.  Loopy message passing on each document
gives marginals, and a token whose most probable state is a kind, with at least
``SURE`` of the mass and no base span on it, adds a span.

Weights are learnt by pseudo-likelihood from all documents, base spans being the
states to learn: one pass counts how often each configuration (a token's
features, its state and its neighbours' states) occurs, the counts are added up
over the cluster, and gradient steps in numpy run over the distinct
configurations.  Every configuration is learnt twice, with the token's own shape
and with it hidden, so that context, neighbours and repeats must carry evidence
of their own; with shapes shown throughout, the patterns explain themselves and
links get no weight.  Configurations are combinations of hashed features and
states, of fixed number; what is collected grows with the variety of tokens, not
with the documents.

Null text counts as empty; rows are treated one by one, so repeated rows get
equal results; extra columns are left aside; an empty table gives an empty
table.  All scans are linear in the text.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import plain, texts_of

KINDS = ("email", "ip", "card", "phone")
TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
HINT = re.compile("[0-9@]")
EDGE = ".,;:!?\"'()[]{}<>|*%$&#"
#: Buckets of hashed shapes, of digit and mark counts, and of words before a token.
SHAPES, COUNTS, WORDS = 1024, 256, 64
STATES = 1 + len(KINDS)
SURE = 0.8
#: Edges in a block of messages.
EDGES = 1 << 14
#: Runs of a shape and of a preceding word are read up to so many characters.
SHOWN = 64


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        d = d * 2 if i % 2 else d
        total += d - 9 if d > 9 else d
    return total % 10 == 0


class Base:
    """The fixed patterns: leftmost non-overlapping matches of each kind, failing ones dropped.

    email ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+``, ip
    ``[0-9]+(\\.[0-9]+)(\\.[0-9]+)(\\.[0-9]+)``, card ``[0-9]([\\x20-]?[0-9])+``,
    phone ``\\+[0-9][\\x20().0-9-]+[0-9]``.  Taken literally, the first two try
    again at every character of a long run; here a run is read once.
    """

    LOCAL = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-"

    def __init__(self):
        self.domain = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
        self.dotted = re.compile(r"[0-9]++(?:\.[0-9]++)*+")  # never fails on a digit, so that no run is read twice
        self.number = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
        # the last digit of the run is where a phone number ends
        self.dialled = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

    def email(self, text: str) -> Iterator[tuple[int, int]]:
        """The part before an "@" is the whole run before it, as the "@" is no part of one."""
        floor, at = 0, text.find("@")
        while at >= 0:
            run = text[floor:at]
            size = len(run) - len(run.rstrip(self.LOCAL))
            found = self.domain.match(text, at + 1) if size else None
            if found:
                yield at - size, found.end()
            floor = found.end() if found else at + 1
            at = text.find("@", floor)

    def ip(self, text: str) -> Iterator[tuple[int, int]]:
        """Numbers joined by single dots, four by four from the left."""
        for chain in self.dotted.finditer(text):
            parts = chain.group().split(".")
            at = chain.start()
            for i in range(0, len(parts) - 3, 4):
                four = parts[i : i + 4]
                size = sum(map(len, four)) + 3
                if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in four):
                    yield at, at + size
                at += size + 1

    def card(self, text: str) -> Iterator[tuple[int, int]]:
        for m in self.number.finditer(text):
            digits = re.sub("[^0-9]", "", m.group())
            if 12 <= len(digits) <= 19 and luhn(digits):
                yield m.span()

    def phone(self, text: str) -> Iterator[tuple[int, int]]:
        if "+" in text:
            for m in self.dialled.finditer(text):
                if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15:
                    yield m.span()

    def spans(self, text: str) -> list[tuple[int, int, int]]:
        """(start, kind's place, end), sorted."""
        return sorted((a, place, b) for place, kind in enumerate(KINDS) for a, b in getattr(self, kind)(text))


def shape(token: str) -> str:
    """Digits to 9, letters to a or A; runs over four are cut to four."""
    s = re.sub("[0-9]", "9", token[: 4 * SHOWN])
    s = "".join("A" if c.isupper() else "a" if c.isalpha() else c for c in s)
    return re.sub(r"(.)\1{3,}", r"\1\1\1\1", s)[:SHOWN]


def bucket(name: str, of: int) -> int:
    return int.from_bytes(hashlib.blake2b(name.encode(), digest_size=4).digest(), "little") % of


def features(token: str, before: str) -> tuple[int, int, int]:
    """Hashed features of a token: its shape, its digits and marks, the word before it."""
    core = token.strip(EDGE)
    digits = len(re.findall("[0-9]", core))
    counts = f"{min(digits, 20)}.{core.count('.')}.{core.count('-')}.{core[:1] == '+'}.{'@' in core}.{core.isdigit()}"
    return bucket(shape(core), SHAPES), bucket(counts, COUNTS), bucket(before.strip(EDGE).lower()[:SHOWN], WORDS)


def similar_keys(token: str) -> list[str]:
    """Tokens with a key in common are linked: the same letters and digits
    whatever the case and punctuation, or the same nine digits or more at the
    end (a number with or without a prefix)."""
    core = "".join(c for c in token.lower() if c.isalnum())
    digits = re.sub("[^0-9]", "", token)
    return [k for k in ("c" + core if core else "", "d" + digits[-9:] if len(digits) >= 9 else "") if k]


def key_hash(key: str) -> int:
    """64 bits that stand for a key within its document: two of a million keys meet once in 30 million documents."""
    return int.from_bytes(hashlib.blake2b(key.encode(), digest_size=8).digest(), "little")


def repeats(keys: np.ndarray, holders: np.ndarray) -> np.ndarray:
    """Edges (earlier, later), sorted, each once: every holder of a key to the one
    before it and to the first; ``holders`` ascend."""
    if len(keys) < 2:
        return np.zeros((0, 2), np.int64)
    order = np.argsort(keys, kind="stable")
    k, h = keys[order], holders[order]
    same = k[1:] == k[:-1]
    begin = np.maximum.accumulate(np.where(np.concatenate([[True], ~same]), np.arange(len(k)), 0))
    later = h[1:][same]
    edges = np.concatenate([np.column_stack([h[:-1][same], later]), np.column_stack([h[begin[1:][same]], later])])
    edges = edges[edges[:, 0] != edges[:, 1]]
    edges = edges[np.lexsort([edges[:, 1], edges[:, 0]])]
    return edges[np.concatenate([[True], (edges[1:] != edges[:-1]).any(1)])] if len(edges) else edges


class Graph:
    """Nodes and edges of one document, in packed arrays."""

    def __init__(self, text: str, base: list[tuple[int, int, int]]):
        ends, rows, chain, before, apart = array("q"), array("i"), array("q"), "", True
        keys, holders = array("Q"), array("q")
        for m in TOKEN.finditer(text) if HINT.search(text) else ():
            token = m.group()
            if not HINT.search(token):
                before, apart = token, True
                continue
            i = len(ends) // 2
            ends.extend(m.span())
            rows.extend(features(token, before))
            if not apart:
                chain.append(i)  # only white space lies between it and the token before
            for k in similar_keys(token):
                keys.append(key_hash(k))
                holders.append(i)
            before, apart = token, False
        n = len(ends) // 2
        self.spans = np.array(ends, np.int64).reshape(n, 2)
        self.features = np.array(rows, np.int32).reshape(n, 3)
        right = np.array(chain, np.int64)
        self.chain = np.column_stack([right - 1, right])
        self.skip = repeats(np.array(keys, np.uint64), np.array(holders, np.int64))
        # the first base span on a token, by start and kind; those of one kind do not overlap
        self.state, begin = np.zeros(n, int), np.full(n, np.iinfo(np.int64).max)
        starts, ends = self.spans.T
        for place in range(len(KINDS)):
            own = np.array([(a, b) for a, k, b in base if k == place], int).reshape(-1, 2)
            if n and len(own):
                at = np.minimum(np.searchsorted(own[:, 1], starts, "right"), len(own) - 1)
                on = (own[at, 1] > starts) & (own[at, 0] < ends) & (own[at, 0] < begin)
                self.state[on], begin[on] = place + 1, own[at, 0][on]
        self.under = self.state > 0

    def configurations(self) -> np.ndarray:
        """A row per node: features, states of the neighbours to either side and
        of the occurrences before and after (STATES where there is none), own state."""
        n = len(self.state)
        around = np.full((4, n), STATES)
        for k, e in ((0, self.chain), (2, self.skip)):
            # of several earlier occurrences the last counts, of later ones the first
            around[k, e[:, 1]] = self.state[e[:, 0]]
            around[k + 1, e[::-1, 0]] = self.state[e[::-1, 1]]
        return np.column_stack([self.features, around.T, self.state])


class Field:
    """Weights: a (bucket x state) table for each feature and a (state x state) one for each kind of edge."""

    def __init__(self, *tables: np.ndarray):
        self.shapes, self.counts, self.words, self.chain, self.skip = tables or (np.zeros((SHAPES, STATES)), np.zeros((COUNTS, STATES)), np.zeros((WORDS, STATES)), np.zeros((STATES, STATES)), np.zeros((STATES, STATES)))

    def tables(self) -> tuple[np.ndarray, ...]:
        return self.shapes, self.counts, self.words, self.chain, self.skip

    def learn(self, seen: np.ndarray, times: np.ndarray, steps: int = 400, rate: float = 0.05, decay: float = 1e-4) -> None:
        """Pseudo-likelihood by full-batch Adam steps over configurations (see
        ``Graph.configurations``) that occur so often."""
        if not len(seen):
            return
        n, y = len(seen), seen[:, 7]
        weight = np.sqrt(times.astype(float))  # else the commonest numbers leave nothing to the others
        weight /= 2 * weight.sum()
        shown = [(0, seen[:, 0]), (1, seen[:, 1]), (2, seen[:, 2])]
        edges = [(t, seen[:, c]) for t, c in ((3, 3), (3, 4), (4, 5), (4, 6))]
        hot = np.eye(STATES)[y]
        sizes = [t.size for t in self.tables()]
        flat = np.concatenate([t.ravel() for t in self.tables()])
        m, v = np.zeros_like(flat), np.zeros_like(flat)
        for step in range(1, steps + 1):
            grad = np.zeros_like(flat)
            parts = [x.reshape(-1, STATES) for x in np.split(flat, np.cumsum(sizes)[:-1])]
            back = [x.reshape(-1, STATES) for x in np.split(grad, np.cumsum(sizes)[:-1])]
            padded = [np.vstack([p, np.zeros((1, STATES))]) for p in parts[3:]]
            links = sum(padded[t - 3][x] for t, x in edges)
            for hidden in (False, True):
                own = shown[2:] if hidden else shown
                z = links + sum(parts[t][x] for t, x in own)
                p = np.exp(z - z.max(1, keepdims=True))
                gap = (hot - p / p.sum(1, keepdims=True)) * weight[:, None]
                for t, x in [*own, *edges]:
                    size = len(parts[t])
                    for s in range(STATES):
                        back[t][:, s] += np.bincount(x, gap[:, s], size + 1)[:size]
            grad -= decay * flat
            m += 0.1 * (grad - m)
            v += 0.001 * (grad * grad - v)
            flat += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        self.shapes, self.counts, self.words, chain, skip = (x.reshape(-1, STATES) for x in np.split(flat, np.cumsum(sizes)[:-1]))
        self.chain, self.skip = (chain + chain.T) / 2, (skip + skip.T) / 2

    def own(self, g: Graph) -> np.ndarray:
        out = sum(t[g.features[:, k]] for k, t in enumerate((self.shapes, self.counts, self.words)))
        out[g.under] = -50.0
        out[g.under, g.state[g.under]] = 0.0
        return out

    def marginals(self, g: Graph, rounds: int = 100, damping: float = 0.3) -> np.ndarray:
        """Loopy message passing in the log domain, damped, until it settles;
        after ``rounds`` the beliefs reached are taken.  All messages of a round
        come from the one before; edges are worked on in blocks of ``EDGES``, so
        that beside messages and beliefs (some 120 bytes a token and 80 an edge)
        memory stays the same however long the text."""
        own = self.own(g)
        kinds = [(e, np.exp(t - t.max()), np.zeros((2, len(e), STATES))) for e, t in ((g.chain, self.chain), (g.skip, self.skip)) if len(e)]
        belief = own
        if kinds:

            def beliefs() -> np.ndarray:
                out = own.copy()
                for e, _, message in kinds:
                    for s in range(STATES):
                        out[:, s] += np.bincount(e[:, 1], message[0, :, s], len(own)) + np.bincount(e[:, 0], message[1, :, s], len(own))
                return out

            for _ in range(rounds):
                belief, moved = beliefs(), 0.0
                for e, table, message in kinds:
                    # a block holds both messages of its edges, which need only each other and the beliefs
                    for at in range(0, len(e), EDGES):
                        old = message[:, at : at + EDGES]
                        sent = np.stack([belief[e[at : at + EDGES, d]] - old[1 - d] for d in (0, 1)])
                        sent -= sent.max(2, keepdims=True)
                        new = np.log(np.exp(sent) @ table)
                        new -= new.max(2, keepdims=True)
                        moved = max(moved, float(np.abs(new - old).max()))
                        old *= damping
                        old += (1 - damping) * new
                if moved < 1e-6:
                    break
            belief = beliefs()
        p = np.exp(belief - belief.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)

    def added(self, text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        """Spans of tokens that the field labels, beside those under base spans."""
        g = Graph(text, base)
        if not len(g.state) or g.under.all():
            return []
        p = self.marginals(g)
        best = p.argmax(1)
        out = []
        for i in np.flatnonzero((best > 0) & (p.max(1) >= SURE) & ~g.under):
            a, b = g.spans[i].tolist()
            body = text[a:b]
            inner = body.strip(EDGE)
            if inner:
                a += len(body) - len(body.lstrip(EDGE))
                out.append((a, int(best[i]) - 1, a + len(inner)))
        return out


def hinted(batches: Iterator[pa.RecordBatch], name: str) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    """Parts of the batches with their texts; None for those without a digit or "@"."""
    hint = np.zeros(256, bool)
    hint[list(b"0123456789@")] = True
    for batch in batches:
        for a, b, data, offsets in texts_of(pa.Table.from_batches([batch]), name):
            first = np.searchsorted(np.flatnonzero(hint[data]), offsets)
            yield batch.slice(a, b - a), [data[i:j].tobytes().decode() if x < y else None for i, j, x, y in zip(offsets[:-1], offsets[1:], first[:-1], first[1:])]


def fit(docs: DataFrame, text_col: str = "text") -> Field:
    """Learns from the configurations of all documents."""
    names = ["shape", "counts", "word", "left", "right", "before", "after", "state"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = Base()
        for _, texts in hinted(batches, text_col):
            rows = [Graph(t, base.spans(t)).configurations() for t in texts if t is not None]
            if rows:
                found, times = np.unique(np.concatenate(rows), axis=0, return_counts=True)
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int32()) for c in found.T), pa.array(times, pa.int64())], names=[*names, "times"])

    counted = plain(docs, text_col).mapInArrow(run, ", ".join(f"{k} int" for k in names) + ", times bigint")
    seen = counted.groupBy(*names).agg(F.sum("times").alias("times")).toArrow()
    field = Field()
    if seen.num_rows:
        found = np.column_stack([seen.column(k).to_numpy() for k in names]).astype(int)
        order = np.lexsort(found.T)  # the same sums whatever the order in which rows come
        field.learn(found[order], seen.column("times").to_numpy()[order])
    return field


def find(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, base and added spans: array<struct<kind, start, end>> (code
    points, end exclusive), each sorted by start and then kind as listed."""
    chosen = plain(docs, id_col, text_col)
    kind = dict(chosen.dtypes)[id_col]
    weights = field.tables()
    span = "array<struct<kind:string,start:int,end:int>>"
    spans_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def named(spans):
        return [{"kind": KINDS[k], "start": a, "end": b} for a, k, b in sorted(spans)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, field = Base(), Field(*weights)
        for part, texts in hinted(batches, text_col):
            found = [[] if t is None else base.spans(t) for t in texts]
            more = [[] if t is None else field.added(t, spans) for t, spans in zip(texts, found)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([named(x) for x in found], spans_type), pa.array([named(x) for x in more], spans_type)], names=[id_col, "base", "added"])

    return chosen.mapInArrow(run, f"`{id_col}` {kind}, base {span}, added {span}")


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return find(docs, fit(docs, text_col), id_col, text_col)


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts of base spans, their hash, and all spans as text."""
    place = F.array(*[F.lit(k) for k in KINDS])
    line = lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))
    of = lambda k: lambda x: x["kind"] == k
    joined = lambda c: F.array_join(F.transform(c, line), ",")
    ranked = F.array_sort(F.transform(F.concat("base", "added"), lambda x: F.struct(x["start"].alias("start"), F.array_position(place, x["kind"]).alias("place"), x["end"].alias("end"), x["kind"].alias("kind"))))
    return found.select(
        id_col,
        *[F.size(F.filter("base", of(k))).cast("bigint").alias(f"n_{k}") for k in KINDS],
        F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
        joined(ranked).alias("spans"),
        F.size("added").cast("bigint").alias("n_added"),
    )
