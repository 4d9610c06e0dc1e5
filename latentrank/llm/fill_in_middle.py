"""Fill-in-middle: texts cut in three at unit boundaries and laid out anew.

Each text is decoded to an array of code points (UTF-32).  Every code point has
a class, and a table of class pairs says between which neighbours a unit ends,
so that one comparison and ``flatnonzero`` give all boundaries of a text; the
two chosen ranks index them, and the slices are encoded again.  A row needs
nothing of any other, so there is no shuffle and no hot key; a text is held
whole in its task, at some twenty bytes a code point.

Draws are the first four groups of eight digits of the SHA-256 of
``seed:id``: the cuts do not depend on how rows are partitioned.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import plain

SENTINELS = ("<P>", "<S>", "<M>")
SPACES = (0x20, 9, 10, 11, 12, 13)
#: unit: (code points of class 1, class pairs (left, right) between which a unit ends)
UNITS = {
    "line": ((10,), ((1, 0), (1, 1))),  # [^\n]*\n|[^\n]+
    "word": (SPACES, ((0, 1),)),  # a word with the white space before it
    "char": ((), ((0, 0),)),
}


class Cutter:
    """Boundaries of units in arrays of code points."""

    def __init__(self, unit: str = "line"):
        if unit not in UNITS:
            raise ValueError(f"`unit` should be one of {', '.join(UNITS)}, not {unit!r}.")
        marked, pairs = UNITS[unit]
        self.marked = np.array(marked, np.uint32)
        self.ends = np.zeros((2, 2), bool)
        for left, right in pairs:
            self.ends[left, right] = True

    def bounds(self, points: np.ndarray) -> np.ndarray:
        """0, the end of every unit but the last, and the length (n + 1 numbers for n units)."""
        if not len(points):
            return np.zeros(1, np.int64)
        kind = np.isin(points, self.marked).astype(np.int8) if len(self.marked) else np.zeros(len(points), np.int8)
        inner = np.flatnonzero(self.ends[kind[:-1], kind[1:]]) + 1
        return np.concatenate([[0], inner, [len(points)]])


def draws(seed: int, key) -> list[int]:
    digits = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    return [int(digits[i : i + 8], 16) for i in range(0, 32, 8)]


def transform(text: str, key, cutter: Cutter, seed: int, rate: int, spm: int, sentinels: tuple[str, str, str]) -> tuple[int, str, int | None, int | None, str]:
    """(units, form, code points of prefix and of middle, output) of one text."""
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    bounds = cutter.bounds(points)
    n = len(bounds) - 1
    h = draws(seed, key)
    if not text or h[2] % 100 >= rate or any(s in text for s in sentinels):
        return n, "plain", None, None, text
    i, j = (int(bounds[r]) for r in sorted((h[0] % (n + 1), h[1] % (n + 1))))
    prefix, middle, suffix = (part.tobytes().decode("utf-32-le") for part in (points[:i], points[i:j], points[j:]))
    p, s, m = sentinels
    if h[3] % 100 < spm:
        return n, "spm", i, j - i, f"{s}{suffix}{p}{prefix}{m}{middle}"
    return n, "psm", i, j - i, f"{p}{prefix}{s}{suffix}{m}{middle}"


def checked(sentinels: tuple[str, str, str]) -> tuple[str, str, str]:
    """Sentinels none of which can begin inside another: then the first one found is the one written."""
    p = tuple(sentinels)
    laps = any(a[-k:] == b[:k] for a in p for b in p for k in range(1, min(len(a), len(b)) + 1) if a != b or k < len(a))
    if len(set(p)) != 3 or not all(p) or laps or any(a in b for a in p for b in p if a != b):
        raise ValueError(f"sentinels must differ and not overlap one another: {p}")
    return p


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, unit: str = "line", seed: int = 7, rate: int = 100, spm: int = 50, sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """(id, n, form, prefix_chars, middle_chars, output), a row for every row.

    Of texts that are not ``plain``, ``spm`` of a hundred have the suffix first;
    ``rate`` of a hundred are transformed at all.  A text is plain, and given
    back as it is, if it is empty or holds a sentinel; then the two counts are
    null.  A null text counts as empty, a null id as one without digits.
    Repeated rows give equal rows; other columns are not kept.
    """
    cutter, marks = Cutter(unit), checked(sentinels)
    rows = plain(docs, id_col, text_col)
    kind = rows.schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):  # outputs of so many texts at once
                part = b.slice(at, 256)
                made = [transform(t or "", k, cutter, seed, rate, spm, marks) for k, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist())]
                n, form, prefix, middle, out = zip(*made)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(out, pa.string())], names=[id_col, "n", "form", "prefix_chars", "middle_chars", "output"])

    return rows.mapInArrow(run, f"`{id_col}` {kind}, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string")


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text that an output was made of, from output and form alone."""
    p, s, m = (F.lit(x) for x in checked(sentinels))

    def between(first: Column, then: Column) -> Column:  # the output begins with ``first``
        return F.call_function("substring_index", F.substr(output, F.length(first) + 1), then, F.lit(1))

    def after(mark: Column) -> Column:
        return F.substr(output, F.instr(output, mark) + F.length(mark))

    def inner(mark: Column, then: Column) -> Column:
        return F.call_function("substring_index", after(mark), then, F.lit(1))

    psm = F.concat(between(p, s), after(m), inner(s, m))
    spm = F.concat(inner(p, m), after(m), between(s, p))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def digest(made: DataFrame, id_col: str = "doc_id", sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """The outputs' and the restored texts' digests in place of the outputs."""
    back = restored(F.col("output"), F.col("form"), sentinels)
    return made.select(id_col, "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


SQL = """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\n]*\\n|[^\\n]+') AS u,
         sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h
  FROM documents),
e AS (
  SELECT *, len(u) AS n, ('0x' || h[1:8])::BIGINT % (len(u) + 1) AS r1, ('0x' || h[9:16])::BIGINT % (len(u) + 1) AS r2, ('0x' || h[25:32])::BIGINT % 100 AS r4
  FROM d),
f AS (
  SELECT doc_id, t, n,
         array_to_string(u[1:least(r1, r2)], '') AS p, array_to_string(u[least(r1, r2) + 1:greatest(r1, r2)], '') AS m, array_to_string(u[greatest(r1, r2) + 1:], '') AS s,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') THEN 'plain' WHEN r4 < 50 THEN 'spm' ELSE 'psm' END AS form
  FROM e)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p)::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m)::BIGINT END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM f
"""
