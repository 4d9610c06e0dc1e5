"""Substring dedup by recompression.

Each text is parsed in rounds that name runs of equal symbols and pairs of
adjacent symbols.  Whether two neighbours merge depends on a bit of either
symbol's name alone (left symbols merge with right ones), and names are hashes
of what a symbol stands for, so that they are global without a dictionary: equal
word sequences get equal symbols everywhere, apart from those at their edges.
The bit that decides a merge looks at most two words into a run, so a symbol
edge depends on two words to either side.

A window of WIDTH (13) words has a symbol edge among its inner places, save
inside runs.  Its anchor is the least name of the six words around such an edge
(of the window itself where there is none), which depends on nothing but the
window's words.  Equal windows thus have equal anchors, and a text has one
distinct anchor per five words or so.

1. Every group of documents sends its distinct anchors; buckets tell which are
   held by several groups (a group knows which it holds several times).
2. Windows at such anchors send their own names, once per group, with the
   smallest document of the group; buckets tell which groups hold a copy of an
   earlier document's window, and which only know that they hold several.
3. Every group marks the words of windows that also start in a smaller document.

A window's name is verified, in every group and bucket, by a second one from
independent hashes of its words (127 bits in all; words beyond 32 bytes are
hashed by the library), so that a collision of names alone removes nothing.

Windows are judged on the input.  Null text counts as empty.  A null id counts
as larger than any other id, so such rows lose words to rows with ids and never
take any; rows with the same id never take words from each other.  Ids are
integers.  An empty table gives an empty table; extra columns are left aside.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .grouped import PART, Lookup, answers, by_bucket, by_group, dealt, entries, packed, ranked, with_answers
from .text import U64, Words, mix, plain, texts_of, window_hash

WIDTH, AROUND, CONTEXT = 13, 3, 2
NEVER = np.iinfo(np.int64).max
#: The bits of a check that travel: the uppermost makes room for a flag.
KEPT = U64((1 << 63) - 1)
_PAIR, _SEED, _WINDOW, _CHECK = 0x9DDFEA08EB382D69, 0xA24BAED4963EE407, 0xD1342543DE82EF95, 0xC2B2AE3D27D4EB4F
ENTRY = np.dtype([("check", U64), ("least", np.uint32)])
WIDE_ENTRY = np.dtype([("check", U64), ("least", np.int64)])
TOLD = np.dtype([("check", U64), ("everywhere", np.uint8)])


def edges(names: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Places (before each word, and at the end) that are symbol edges after
    two rounds of naming runs and pairs."""
    n = len(names)
    inner = np.zeros(n + 1, bool)
    inner[1:n] = owner[1:] == owner[:-1]

    def round_of(left: np.ndarray, right: np.ndarray, bit: int) -> np.ndarray:
        """Where the symbols left and right of a place become one: a run, or a pair."""
        pair = ((left >> U64(bit)) & U64(1) == 0) & ((right >> U64(bit)) & U64(1) == 1)
        return inner & ((left == right) | pair)

    left, right = np.zeros(n + 1, U64), np.zeros(n + 1, U64)
    left[1:], right[:n] = names, names
    joined = round_of(left, right, 17)
    # second round: symbols of one word, or named after their two words at this place
    two = mix(names[:-1] * U64(_PAIR) + names[1:])
    before, after = joined[1:n], joined[1:n]
    left[2:] = np.where(before, two, left[2:])
    right[: n - 1] = np.where(after, two, right[: n - 1])
    return ~(joined | round_of(left, right, 9))


def windows(words: Words, checked: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first word, anchor, name, check) of every window of a block; without
    ``checked`` no check is made."""
    h, n = words.hash, len(words.hash)
    if n < WIDTH:
        return np.zeros(0, np.int64), np.zeros(0, U64), np.zeros(0, U64), np.zeros(0, U64)
    owner = words.owner()
    m = n - WIDTH + 1
    name = window_hash(h, WIDTH, _WINDOW)
    seeds = window_hash(h, 2 * AROUND, _SEED) >> U64(1)
    nothing = U64(1 << 63)
    least = np.where(edges(h, owner)[AROUND : n - AROUND + 1], seeds, nothing)  # places AROUND .. n - AROUND
    width, have = WIDTH - 2 * AROUND + 1, 1
    while have < width:  # least of ``width`` neighbours, by doubling
        step = min(have, width - have)
        least = np.minimum(least[: len(least) - step], least[step:])
        have += step
    anchor = np.where(least[:m] == nothing, name | nothing, least[:m])
    # anchors are spread over all keys again: least values crowd at the low end
    first = np.flatnonzero(owner[:m] == owner[WIDTH - 1 :])
    check = window_hash(words.hashes(2), WIDTH, _CHECK)[first] if checked else np.zeros(0, U64)
    return first, mix(anchor[first]), name[first], check


def ranked_pairs(names: np.ndarray, checks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of (name, check), and where each distinct pair begins in it."""
    order = np.lexsort([checks, names])
    n, c = names[order], checks[order]
    return order, np.flatnonzero(np.concatenate([[True], (n[1:] != n[:-1]) | (c[1:] != c[:-1])])) if len(n) else np.zeros(0, int)


def find_pairs(known: Lookup, checks: np.ndarray, name: np.ndarray, check: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows whose name and check are known, their places); ``checks`` in order
    of name, check."""
    rows, at = known.find(name)
    hits, places = [], []
    while len(rows):  # more than once only if names collide
        same = checks[at] == check[rows]
        hits.append(rows[same])
        places.append(at[same])
        rows, at = rows[~same], at[~same] + 1
        more = at < len(checks)
        rows, at = rows[more], at[more]
        more = known.keys[at] == name[rows]
        rows, at = rows[more], at[more]
    return (np.concatenate(hits), np.concatenate(places)) if hits else (rows, at)


def _blocks(t: pa.Table, id_col: str, text_col: str) -> Iterator[tuple[int, int, Words, np.ndarray]]:
    ids = t.column(id_col).cast(pa.int64()).combine_chunks().fill_null(NEVER).to_numpy(zero_copy_only=False)
    for a, b, data, offsets in texts_of(t, text_col):
        yield a, b, Words(data, offsets), ids[a:b]


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """Removes words under windows that also start in a document with a smaller id.

    Returns ``id_col``, n_words, n_removed (long), kept_sha256 (string) and, with
    ``keep_text``, kept (string: the words left, joined by one space).
    """
    chosen = plain(docs, id_col, text_col)
    kind = dict(chosen.dtypes)[id_col]
    rows, _, buckets = dealt(chosen, id_col, text_col)

    def several(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        """A group's distinct anchors, and which are in several of its documents."""
        anchors, ids = [], []
        for _, _, words, doc in _blocks(t, id_col, text_col):
            first, anchor, _, _ = windows(words, checked=False)
            anchors.append(anchor)
            ids.append(doc[np.searchsorted(words.first, first, "right") - 1])
        anchors, ids = (np.concatenate(x) if x else np.zeros(0, U64) for x in (anchors, ids))
        order, at = ranked(anchors)
        if not len(at):
            return anchors, np.zeros(0, bool)
        ids = ids[order]
        return anchors[order][at], np.minimum.reduceat(ids, at) != np.maximum.reduceat(ids, at)

    def send_anchors(part: int, t: pa.Table) -> pa.Table:
        keys, _ = several(t)
        return packed(part, keys, None, buckets)

    def shared(t: pa.Table) -> pa.Table:
        keys, part, _ = entries(t)
        order, at = ranked(keys)
        n = np.diff(np.concatenate([at, [len(keys)]]))
        hit = order[np.repeat(n > 1, n)]
        return answers(part[hit], keys[hit])

    def send_windows(part: int, t: pa.Table, told: pa.Table) -> pa.Table:
        own, many = several(t)
        known = Lookup(np.concatenate([entries(told)[0], own[many]]))
        names, checks, ids = [], [], []
        for _, _, words, doc in _blocks(t, id_col, text_col):
            first, anchor, name, check = windows(words)
            hit, _ = known.find(anchor)
            names.append(name[hit])
            checks.append(check[hit])
            ids.append(doc[np.searchsorted(words.first, first[hit], "right") - 1])
        names, checks, ids = (np.concatenate(x) if x else np.zeros(0, U64) for x in (names, checks, ids))
        order, at = ranked_pairs(names, checks)
        if not len(at):
            return packed(part, names, None, buckets)
        ids, least = ids[order], np.minimum.reduceat(ids[order], at)
        wide = least.max() >= 1 << 32 or least.min() < 0
        rest = np.zeros(len(at), WIDE_ENTRY if wide else ENTRY)
        # the lowest bit: whether several documents of the group hold the window
        rest["check"] = (checks[order][at] << U64(1)) | (least != np.maximum.reduceat(ids, at)).astype(U64)
        rest["least"] = least
        return packed(part, names[order][at], rest, buckets)

    def first_of_all(t: pa.Table) -> pa.Table:
        keys, part, check, least = [], [], [], []
        for p, k, r in zip(t.column("part").to_pylist(), t.column("keys").to_pylist(), t.column("rest").to_pylist()):
            k = np.frombuffer(k, U64)
            r = np.frombuffer(r, ENTRY if len(r) == ENTRY.itemsize * len(k) else WIDE_ENTRY)
            keys.append(k)
            part.append(np.full(len(k), p, np.int32))
            check.append(r["check"])
            least.append(r["least"].astype(np.int64))
        if not keys:
            return answers(np.zeros(0, np.int32), np.zeros(0, U64))
        keys, part, check, least = (np.concatenate(x) for x in (keys, part, check, least))
        several, check = (check & U64(1)) == 1, check >> U64(1)
        order, at = ranked_pairs(keys, check)
        low = np.repeat(np.minimum.reduceat(least[order], at), np.diff(np.concatenate([at, [len(keys)]])))
        earlier = low < least[order]
        hit = earlier | several[order]
        told = np.zeros(hit.sum(), TOLD)
        # everywhere: 1 if another group has a smaller document, 0 if only later documents of this group are copies
        told["check"], told["everywhere"] = check[order][hit], earlier[hit]
        return answers(part[order][hit], keys[order][hit], told)

    def cut(part: int, t: pa.Table, told: pa.Table) -> pa.Table:
        keys, _, rest = entries(told, TOLD)
        order = np.lexsort([rest["check"], keys])
        known, checks, everywhere = Lookup(keys), rest["check"][order], rest["everywhere"][order].astype(bool)
        # smallest own document of each window that only this group repeats
        least = np.full(len(keys), NEVER, np.int64)
        for _, _, words, doc in _blocks(t, id_col, text_col):
            first, _, name, check = windows(words)
            hit, at = find_pairs(known, checks, name, check & KEPT)
            np.minimum.at(least, at, doc[np.searchsorted(words.first, first[hit], "right") - 1])
        out = []
        for a, b, words, doc in _blocks(t, id_col, text_col):
            first, _, name, check = windows(words)
            hit, at = find_pairs(known, checks, name, check & KEPT)
            start = first[hit]
            gone = everywhere[at] | (doc[np.searchsorted(words.first, start, "right") - 1] > least[at])
            edge = np.zeros(len(words.hash) + 1, np.int32)
            np.add.at(edge, start[gone], 1)
            np.add.at(edge, start[gone] + WIDTH, -1)
            left = np.cumsum(edge[:-1]) == 0
            n, texts = words.counts(), kept_texts(words, left)
            total = np.concatenate([[0], np.cumsum(left)])
            removed = n - (total[words.first[1:]] - total[words.first[:-1]])
            columns = {id_col: t.column(id_col).slice(a, b - a), "n_words": pa.array(n, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in texts], pa.string())}
            if keep_text:
                columns["kept"] = pa.array([x.decode() for x in texts], pa.string())
            out.append(pa.table(columns))
        return pa.concat_tables(out)

    told = by_bucket(by_group(rows, send_anchors), shared)
    told = by_bucket(with_answers(rows, told, send_windows, "bucket int, part int, keys binary, rest binary"), first_of_all)
    return with_answers(rows, told, cut, f"`{id_col}` {kind}, n_words bigint, n_removed bigint, kept_sha256 string" + (", kept string" if keep_text else ""))


def kept_texts(words: Words, left: np.ndarray) -> list[bytes]:
    """Per text: its words under ``left``, joined by one space."""
    length = np.where(left, words.end - words.start, -1) + 1
    total = np.concatenate([[0], np.cumsum(length)])
    body = np.full(total[-1], 0x20, np.uint8)
    size = length[left] - 1
    skip = np.concatenate([[0], np.cumsum(size)[:-1]]) if len(size) else size
    inside = np.arange(size.sum()) - np.repeat(skip, size)
    body[np.repeat(total[:-1][left], size) + inside] = words.data[np.repeat(words.start[left], size) + inside]
    whole = body.tobytes()
    at = total[words.first]
    return [whole[i : max(i, j - 1)] for i, j in zip(at[:-1], at[1:])]


#: The same in DuckDB over the table ``documents``, from the words themselves.
SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (
  SELECT row, coalesce(doc_id, {NEVER}) AS id, i, array_to_string(w[i : i + {WIDTH - 1}], ' ') AS said
  FROM (SELECT row, doc_id, w, unnest(generate_series(1, len(w) - {WIDTH - 1})) AS i FROM d WHERE len(w) >= {WIDTH})),
firsts AS (SELECT said, min(id) AS least FROM windows GROUP BY said),
gone AS (SELECT DISTINCT row, unnest(generate_series(i, i + {WIDTH - 1})) AS i FROM windows JOIN firsts USING (said) WHERE id > least),
words AS (SELECT row, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
kept AS (
  SELECT row, count(g.i) AS n_removed, string_agg(word, ' ' ORDER BY words.i) FILTER (WHERE g.i IS NULL) AS said
  FROM words LEFT JOIN gone g USING (row, i) GROUP BY row)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(said, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (row)
"""

__all__ = ["substring_dedup", "kept_texts", "windows", "edges", "PART"]
