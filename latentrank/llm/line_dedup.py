"""Line dedup by content-defined runs or chunks of lines.

With ``whole_runs`` (the query and the pipeline) every run of lines that occurs
earlier is removed whole: see ``Runs``.  Without, the units are chunks, which
find a repeated passage only where a chunk lies inside it.

A rolling hash runs over the hashes of two lines; a chunk begins at each line
whose rolling hash is a local minimum.  Boundaries depend on two lines to
either side only, so inserted or removed lines shift no boundary further off,
and chunks have two lines at least, but for texts of one line.  A chunk
of several lines is removed where an equal chunk comes earlier: in a document
with a smaller id, or earlier in the same document.  Equality is of bytes.

1. Every group of documents sends the hashes of its distinct chunks; buckets
   tell which are held by several groups.
2. Of those chunks (and those that the group itself holds several times), each
   group sends one copy of the bytes with its first place; buckets compare the
   bytes and tell the first place of all.
3. Every group drops the later copies.

Below, chunk stands for either unit.  A chunk counts only with ``min_lines`` lines that hold words and ``min_words``
words; shorter ones stay, so that short common lines are left alone.  Null text
stays null.  A null id counts as larger than any other, and such rows never
displace each other.  Rows with the same id count as one document in the order
of their chunks' places, and never displace each other's chunks at one place.
All columns return, whatever their names; an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import LongType, StructField, StructType

from .grouped import Lookup, answers, bucket_bounds, by_bucket, by_group, dealt, entries, packed, ranked, with_answers
from .text import U64, Words, mix, span_hash, texts_of

NEVER = np.iinfo(np.int64).max
_ROLL, _CHUNK = 0x9E6C63D0876A3F6B, 0xB5026F5AA96619E9
PLACE = np.dtype([("doc", np.int64), ("line", np.int64)])


class Chunks:
    """Lines and chunks of a block of texts: ``line[k] : line[k + 1]`` are chunk k's lines."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        breaks = np.flatnonzero(data == 10)
        self.start = np.unique(np.concatenate([offsets[:-1][np.diff(offsets) > 0], breaks + 1]))
        self.start = self.start[self.start < len(data)]  # a line with its line feed
        self.end = np.concatenate([self.start[1:], [len(data)]]) if len(self.start) else self.start
        text = np.searchsorted(offsets, self.start, "right") - 1
        n = len(self.start)
        # the line feed itself is left out of the hash, so that a last line equals an inner one
        body_end = np.where(data[self.end - 1] == 10, self.end - 1, self.end) if n else self.end
        names = span_hash(data, self.start, body_end, 7) if n else np.zeros(0, U64)
        roll = np.full(n, U64((1 << 64) - 1))
        inner = text[1:] == text[:-1]
        roll[1:][inner] = mix(names[:-1][inner] * U64(_ROLL) + names[1:][inner])
        cut = np.ones(n, bool)
        cut[1:] = ~inner
        low = np.zeros(n, bool)
        low[1:] = inner & (roll[1:] < roll[:-1])
        low[2:] &= inner[:-1]  # not at a text's second line
        low[1:2] = False
        low[:-1] &= inner  # nor at its last line
        low[-1:] = False
        after = np.full(n, U64((1 << 64) - 1))
        after[:-1] = np.where(inner, roll[1:], after[:-1]) if n else after[:-1]
        self.line = np.flatnonzero(cut | (low & (roll < after)))
        self.text = text[self.line]
        ends = np.concatenate([self.line[1:], [n]]) if len(self.line) else self.line
        words = Words(data, offsets, hashes=False)
        counts = np.searchsorted(words.start, np.concatenate([self.start, [len(data)]]))
        full = np.concatenate([[0], np.cumsum(np.diff(counts) > 0)])
        self.lines_with_words = full[ends] - full[self.line]
        self.words = counts[ends] - counts[self.line]
        self.from_byte = self.start[self.line]
        self.to_byte = self.end[ends - 1] if n else self.line
        # without the last line feed, as above
        self.body_end = np.where(data[self.to_byte - 1] == 10, self.to_byte - 1, self.to_byte) if n else self.line
        self.name = span_hash(data, self.from_byte, self.body_end, 11) if n else names
        # each chunk's first line within its text
        first = np.searchsorted(text, self.text)
        self.place = self.line - first
        self.n_lines = ends - self.line
        self.nonblank = full
        self.line_text = text
        self.fit = np.zeros(0, np.int64)
        self.apart = np.zeros(len(self.line), np.int64)  # chunks never overlap

    def choose(self, min_lines: int, min_words: int) -> None:
        self.fit = np.flatnonzero((self.lines_with_words >= min_lines) & (self.words >= min_words))


class Runs:
    """The shortest runs of lines with enough lines and words, from every line
    with words on and back from every such line.

    They begin and end at lines with words.  Any longer run with such ends is
    covered by those inside it, so that a passage found elsewhere is found line
    by line, wherever it begins and ends.  A byte lies in at most ``min_words``
    (or ``min_lines``) runs of each direction, since each line counted has a word.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, min_lines: int = 2, min_words: int = 8):
        breaks = np.flatnonzero(data == 10)
        self.start = np.unique(np.concatenate([offsets[:-1][np.diff(offsets) > 0], breaks + 1]))
        self.start = self.start[self.start < len(data)]
        end = np.concatenate([self.start[1:], [len(data)]]) if len(self.start) else self.start
        self.line_text = np.searchsorted(offsets, self.start, "right") - 1
        counts = np.diff(np.searchsorted(Words(data, offsets, hashes=False).start, np.concatenate([self.start, [len(data)]])))
        full = np.flatnonzero(counts)  # lines with words
        total = np.concatenate([[0], np.cumsum(counts[full])])
        text, n = self.line_text[full], len(full)
        least = max(min_lines, 1)
        on = np.arange(n)
        to = np.maximum(on + least, np.searchsorted(total, total[:-1] + min_words, "left"))
        inside = to <= n
        inside[inside] = text[to[inside] - 1] == text[inside]
        until = np.arange(1, n + 1)
        back = np.minimum(until - least, np.searchsorted(total, total[1:] - min_words, "right") - 1)
        whole = back >= 0
        whole[whole] = (text[back[whole]] == text[whole]) & (to[back[whole]] != until[whole])
        first = np.concatenate([on[inside], back[whole]])
        last = np.concatenate([to[inside], until[whole]]) - 1
        first, last = full[first], full[last]
        self.text = self.line_text[first]
        self.from_byte, self.to_byte = self.start[first], end[last]
        self.body_end = self.to_byte - (data[self.to_byte - 1] == 10) if len(first) else self.to_byte
        self.name = span_hash(data, self.from_byte, self.body_end, 11) if len(first) else np.zeros(0, U64)
        self.place = first - np.searchsorted(self.line_text, self.text)
        self.fit = np.arange(len(first))
        # a copy within the document of the first must begin after its end
        self.apart = last - first


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, min_lines: int = 2, min_words: int = 8, counts: bool = True, whole_runs: bool = False) -> DataFrame:
    """``docs`` with the text left, in all its columns; with ``counts`` also
    ``n_lines`` and ``n_removed_lines`` (long) as last columns.  With
    ``whole_runs``, all runs of lines found earlier go, not only chunks."""
    names = docs.columns
    spots = {id_col: names.index(id_col), text_col: names.index(text_col)}
    inner = docs.toDF(*[f"c{i}" for i in range(len(names))])  # whatever the names, they clash with nothing
    id_in, text_in = f"c{spots[id_col]}", f"c{spots[text_col]}"
    rows, _, buckets = dealt(inner, id_in, text_in)

    def blocks(t: pa.Table):
        ids = t.column(id_in).cast(pa.int64()).combine_chunks().fill_null(NEVER).to_numpy(zero_copy_only=False)
        for a, b, data, offsets in texts_of(t, text_in):
            if whole_runs:
                c = Runs(data, offsets, min_lines, min_words)
            else:
                c = Chunks(data, offsets)
                c.choose(min_lines, min_words)
            c.doc = ids[a:b][c.text]
            yield a, b, data, offsets, c

    def held(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        found = [c.name[c.fit] for *_, c in blocks(t)]
        keys, n = np.unique(np.concatenate(found) if found else np.zeros(0, U64), return_counts=True)
        return keys, n > 1

    def send_names(part: int, t: pa.Table) -> pa.Table:
        return packed(part, held(t)[0], None, buckets)

    def shared(t: pa.Table) -> pa.Table:
        keys, part, _ = entries(t)
        order, at = ranked(keys)
        n = np.diff(np.concatenate([at, [len(keys)]]))
        hit = order[np.repeat(n > 1, n)]
        return answers(part[hit], keys[hit])

    def send_bytes(part: int, t: pa.Table, told: pa.Table) -> pa.Table:
        keys, many = held(t)
        known = Lookup(np.concatenate([entries(told)[0], keys[many]]))
        first: dict[tuple[int, bytes], tuple[int, int]] = {}
        for _, _, data, _, c in blocks(t):
            hit, _ = known.find(c.name[c.fit])
            for k in c.fit[hit].tolist():
                # other bytes of the same hash are another chunk
                key, place = (int(c.name[k]), data[c.from_byte[k] : c.body_end[k]].tobytes()), (int(c.doc[k]), int(c.place[k]))
                if key not in first or place < first[key]:
                    first[key] = place
        chunks = sorted(first)
        names = np.array([name for name, _ in chunks], U64)
        cut = [0, *np.searchsorted(names, bucket_bounds(buckets)).tolist(), len(names)]
        out = []
        for b in range(buckets):
            part_names = names[cut[b] : cut[b + 1]]
            if len(part_names):
                mine = chunks[cut[b] : cut[b + 1]]
                bodies = [body for _, body in mine]
                head = np.array([first[x] for x in mine], np.int64).tobytes() + np.array([len(x) for x in bodies], np.int64).tobytes()
                out.append((b, part, part_names.tobytes(), head + b"".join(bodies)))
        return pa.table({"bucket": pa.array([x[0] for x in out], pa.int32()), "part": pa.array([x[1] for x in out], pa.int32()), "keys": pa.array([x[2] for x in out], pa.binary()), "rest": pa.array([x[3] for x in out], pa.binary())})

    def compare(t: pa.Table) -> pa.Table:
        least: dict[tuple[int, bytes], tuple[int, int]] = {}
        seen = []
        for part, keys, rest in zip(t.column("part").to_pylist(), t.column("keys").to_pylist(), t.column("rest").to_pylist()):
            keys = np.frombuffer(keys, U64)
            n = len(keys)
            places = np.frombuffer(rest, np.int64, 2 * n).reshape(n, 2)
            ends = 24 * n + np.cumsum(np.frombuffer(rest, np.int64, n, 16 * n))
            for i, name in enumerate(keys.tolist()):
                body = rest[ends[i - 1] if i else 24 * n : ends[i]]
                place = (int(places[i, 0]), int(places[i, 1]))
                k = (name, body)
                if k not in least or place < least[k]:
                    least[k] = place
                seen.append((part, name, body))
        told = np.zeros(len(seen), PLACE)
        for i, (_, name, body) in enumerate(seen):
            told[i] = least[(name, body)]
        return answers(np.array([x[0] for x in seen], np.int32), np.array([x[1] for x in seen], U64), told)

    def ambiguous(keys: np.ndarray, t: pa.Table) -> dict[int, list[bytes]]:
        """Names that several of the group's chunks share, with their bytes in the order sent."""
        names, n = np.unique(keys, return_counts=True)
        out: dict[int, set] = {int(x): set() for x in names[n > 1]}
        if out:
            for _, _, data, _, c in blocks(t):
                for k in c.fit[np.isin(c.name[c.fit], names[n > 1])].tolist():
                    out[int(c.name[k])].add(data[c.from_byte[k] : c.body_end[k]].tobytes())
        return {name: sorted(bodies) for name, bodies in out.items()}

    def drop(part: int, t: pa.Table, told: pa.Table) -> pa.Table:
        keys, _, rest = entries(told, PLACE)
        order = np.argsort(keys, kind="stable")
        known, first = Lookup(keys), rest[order]
        nth = ambiguous(keys[order], t)
        texts, n_lines, n_gone = [], [], []
        for a, b, data, offsets, c in blocks(t):
            hit, at = known.find(c.name[c.fit])
            k = c.fit[hit]
            for i in np.flatnonzero(np.isin(c.name[k], list(nth))) if nth else ():
                at[i] += nth[int(c.name[k[i]])].index(data[c.from_byte[k[i]] : c.body_end[k[i]]].tobytes())
            later = (first["doc"][at] < c.doc[k]) | ((first["doc"][at] == c.doc[k]) & (first["line"][at] + c.apart[k] < c.place[k]) & (c.doc[k] != NEVER))
            gone = k[later]
            edge = np.zeros(len(data) + 1, np.int32)
            np.add.at(edge, c.from_byte[gone], 1)
            np.subtract.at(edge, c.to_byte[gone], 1)
            left = np.cumsum(edge[:-1]) == 0
            total = np.concatenate([[0], np.cumsum(left)])
            body, ends = data[left].tobytes(), total[offsets]
            parts = [body[i:j] for i, j in zip(ends[:-1], ends[1:])]
            # a text whose last chunk goes ends where its text before it ended
            shorter = np.diff(ends) < np.diff(offsets)
            last = np.zeros(b - a, bool)
            last[c.text[gone][c.to_byte[gone] == offsets[c.text[gone] + 1]]] = True
            texts += [p[:-1] if s and e and p.endswith(b"\n") else p for p, s, e in zip(parts, shorter, last)]
            n_lines.append(np.bincount(c.line_text, minlength=b - a).astype(np.int64))
            n_gone.append(np.bincount(c.line_text[~left[c.start]], minlength=b - a).astype(np.int64))
        null = t.column(text_in).combine_chunks().is_null().to_numpy(zero_copy_only=False)
        new = pa.array([None if z else x.decode() for x, z in zip(texts, null)], pa.string())
        columns = [new if f"c{i}" == text_in else t.column(f"c{i}") for i in range(len(names))]
        if counts:
            columns += [pa.array(np.concatenate(x) if x else [], pa.int64()) for x in (n_lines, n_gone)]
        return pa.table(columns, names=[f"c{i}" for i in range(len(columns))])

    told = by_bucket(by_group(rows, send_names), shared)
    told = by_bucket(with_answers(rows, told, send_bytes, "bucket int, part int, keys binary, rest binary"), compare)
    more = [StructField(f"c{len(names) + i}", LongType()) for i in range(2 * counts)]
    out = with_answers(rows, told, drop, StructType([*inner.schema.fields, *more]))
    return out.toDF(*names, *(["n_lines", "n_removed_lines"] if counts else []))


#: ``line_dedup`` with ``whole_runs`` in DuckDB over the table ``documents``: lines, the shortest runs from
#: and back from every line with words, the first place of each run's text, and what is left.
SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS row, coalesce(doc_id, {NEVER}) AS id, doc_id, text, ends_with(text, chr(10)) AS closed,
    CASE WHEN coalesce(text, '') = '' THEN [] WHEN ends_with(text, chr(10)) THEN string_split(text, chr(10))[:-2] ELSE string_split(text, chr(10)) END AS lines
  FROM documents),
l AS (SELECT row, unnest(lines) AS line, generate_subscripts(lines, 1) AS i FROM d),
f AS (
  SELECT row, i, n, row_number() OVER (PARTITION BY row ORDER BY i) AS p, sum(n) OVER (PARTITION BY row ORDER BY i) AS s
  FROM (SELECT row, i, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n FROM l) WHERE n > 0),
near AS (SELECT x.row, x.i AS a, x.p AS ap, y.i AS b, y.p AS bp FROM f x JOIN f y ON x.row = y.row AND y.p BETWEEN x.p + 1 AND x.p + 7 AND y.s - x.s + x.n >= 8),
runs AS (
  SELECT row, a, min(b) AS b FROM near GROUP BY row, a
  UNION SELECT row, max(a), b FROM near GROUP BY row, b),
said AS (SELECT r.row, id, a, b, array_to_string(lines[a:b], chr(10)) AS body FROM runs r JOIN d USING (row)),
firsts AS (SELECT body, min((id, a)) AS first FROM said GROUP BY body),
gone AS (
  SELECT DISTINCT row, unnest(generate_series(a, b)) AS i FROM said JOIN firsts USING (body)
  WHERE first[1] < id OR (first[1] = id AND first[2] + b - a < a AND id <> {NEVER})),
kept AS (
  SELECT row, count(g.i) AS n, bool_or(g.i = len(lines)) AS cut,
    string_agg(line || CASE WHEN l.i < len(lines) OR closed THEN chr(10) ELSE '' END, '' ORDER BY l.i) FILTER (WHERE g.i IS NULL) AS body
  FROM l JOIN d USING (row) LEFT JOIN gone g ON g.row = l.row AND g.i = l.i GROUP BY row)
SELECT doc_id, len(lines)::BIGINT AS n_lines, coalesce(n, 0)::BIGINT AS n_removed_lines,
  CASE WHEN text IS NOT NULL THEN sha256(CASE WHEN coalesce(cut, false) AND ends_with(body, chr(10)) THEN body[:-2] ELSE coalesce(body, '') END) END AS kept_sha256
FROM d LEFT JOIN kept USING (row)
"""
