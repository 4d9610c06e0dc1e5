"""Compression bands: reject repetitive or incompressible text.

The zstandard ratio (compressed over raw bytes) of a whole document must lie in
a band that depends on the document's length, since short texts compress less.
The ratios of its fixed chunks must lie in the band for the chunk length, so
that a long clean document with a repetitive or random stretch is seen too: a
document falls when more than ``bad_chunk_share`` of its chunks do, or
``bad_run`` chunks in a row.  (Chunks of clean prose vary little, so up to twenty
chunks no bad one is let pass; of more, a single one may be a table or a list.)
Texts of every length have a band; that of the shortest is wide, as there the
format's own bytes weigh most, and still tells one word over and over.  An empty
text has no ratio and fails the base rules.

Base rules: fewer than 20 words, or over 30 % of words inside 8-word windows
that occur twice or more in the text.

Null text counts as empty (no words: base_failed).  Rows are treated one by
one, so repeated rows get equal results; extra columns are left aside; an empty
table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .text import U64, Words, mix, plain, texts_of, window_hash

#: (raw bytes up to, lowest ratio, highest ratio) of whole documents.
WHOLE_BANDS = ((64, 0.60, 2.00), (128, 0.35, 1.60), (256, 0.40, 1.00), (512, 0.36, 0.95), (1024, 0.32, 0.90), (2048, 0.30, 0.85), (4096, 0.28, 0.80), (16384, 0.25, 0.78), (None, 0.18, 0.75))
#: The same for chunks.
CHUNK_BANDS = ((None, 0.26, 0.75),)
SYMBOLS = b"#*$%&|<>"
CHUNK_BYTES = 4096


def band(bands, n: int) -> tuple[float, float]:
    return next((low, high) for most, low, high in bands if most is None or n <= most)


def repeated_words(words: Words, width: int = 8) -> np.ndarray:
    """Per text: words inside windows of ``width`` words found twice or more in it."""
    n = len(words.first) - 1
    h = window_hash(words.hash, width, 0xA24BAED4963EE407)
    owner = words.owner()
    if not len(h):
        return np.zeros(n, np.int64)
    inside = owner[: len(h)] == owner[width - 1 :]
    key = h ^ mix(owner[: len(h)].astype(U64) + U64(1))
    at = np.flatnonzero(inside)
    order = np.argsort(key[at], kind="stable")
    ranked = key[at][order]
    same = ranked[1:] == ranked[:-1]
    twice = np.zeros(len(at), bool)
    twice[1:] |= same
    twice[:-1] |= same
    hit = at[order[twice]]
    edge = np.zeros(len(owner) + 1, np.int32)
    edge[hit] += 1  # windows start at distinct words, and so end at distinct ones
    edge[hit + width] -= 1
    covered = np.cumsum(edge[:-1]) > 0
    total = np.concatenate([[0], np.cumsum(covered)])
    return total[words.first[1:]] - total[words.first[:-1]]


def spans_total(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def duplicate_lines(text: bytes) -> int:
    lines = [x for x in text.split(b"\n") if x.strip(b" \t\n\x0b\x0c\r")]
    return len(lines) - len(set(lines))


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, min_words: int = 20, max_repeat_percent: int = 30, whole_bands=WHOLE_BANDS, chunk_bands=CHUNK_BANDS, chunk_bytes: int = CHUNK_BYTES, bad_chunk_share: float = 0.05, bad_run: int = 2, level: int = 3) -> DataFrame:
    """Counts, base verdict, ratios and verdict of every whole text.

    Returns ``id_col``, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words (long), base_failed (boolean), ratio, chunk_low, chunk_high
    (double), n_chunks, n_bad_chunks (long), kept (boolean).
    """
    chosen = plain(docs, id_col, text_col)
    kind = dict(chosen.dtypes)[id_col]
    names = [id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "ratio", "chunk_low", "chunk_high", "n_chunks", "n_bad_chunks", "kept"]

    def compressed(c, body: bytes) -> tuple:
        n = len(body)
        if not n:
            return None, None, None, 0, 0, False
        ratio = len(c.compress(body)) / n
        low, high = band(whole_bands, n)
        # a last piece of under half a chunk joins the one before it
        cuts = list(range(0, max(1, n - chunk_bytes // 2), chunk_bytes))
        ratios, bad, run, longest = [], 0, 0, 0
        for a, b in zip(cuts, [*cuts[1:], n]):
            r = len(c.compress(body[a:b])) / (b - a) if len(cuts) > 1 else ratio
            if len(cuts) > 1:
                x, y = band(chunk_bands, b - a)
                run = 0 if x <= r <= y else run + 1
                bad, longest = bad + (run > 0), max(longest, run)
            ratios.append(r)
        return ratio, min(ratios), max(ratios), len(cuts), bad, low <= ratio <= high and bad <= bad_chunk_share * len(cuts) and longest < bad_run

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        c = zstandard.ZstdCompressor(level=level, write_content_size=False, write_checksum=False)
        symbol = np.zeros(256, bool)
        symbol[list(SYMBOLS)] = True
        for batch in batches:
            for a, b, data, offsets in texts_of(pa.Table.from_batches([batch]), text_col):
                words = Words(data, offsets)
                n = words.counts()
                # code points inside words: their bytes but for UTF-8 continuation bytes
                lead = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                in_words = np.concatenate([[0], np.cumsum(lead[words.end] - lead[words.start])]) if len(words.start) else np.zeros(1, np.int64)
                repeats = repeated_words(words)
                whole = data.tobytes()
                bodies = [whole[i:j] for i, j in zip(offsets[:-1], offsets[1:])]
                failed = (n < min_words) | (100 * repeats > max_repeat_percent * n)
                found = [compressed(c, x) for x in bodies]
                ratio, low, high, chunks, bad, inside = (list(x) for x in zip(*found))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a), pa.array(n, pa.int64()), pa.array(in_words[words.first[1:]] - in_words[words.first[:-1]], pa.int64()),
                        pa.array(spans_total(symbol[data], offsets), pa.int64()), pa.array([duplicate_lines(x) for x in bodies], pa.int64()), pa.array(repeats, pa.int64()), pa.array(failed),
                        pa.array(ratio, pa.float64()), pa.array(low, pa.float64()), pa.array(high, pa.float64()), pa.array(chunks, pa.int64()), pa.array(bad, pa.int64()), pa.array(~failed & np.array(inside, bool)),
                    ],
                    names=names,
                )

    return chosen.mapInArrow(run, f"`{id_col}` {kind}, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, ratio double, chunk_low double, chunk_high double, n_chunks bigint, n_bad_chunks bigint, kept boolean")
