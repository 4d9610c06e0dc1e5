"""SentencePiece encoding and decoding by a distinct-chunk table.

In the model used here no piece has a character before a whitespace marker, so
BPE merges never cross from one marked word into the next, and segmentation of
a text is the concatenation of the segmentations of its marked words (a run of
markers with the characters after it).  A task keeps a table from each distinct
chunk to its ids, asks the library once for chunks that it has not met, and
joins the ids back by position.  Decoding starts from those ids: a second table
holds what the library makes of each chunk's ids, and the pieces are joined by
position too.  The tables are bounded: beyond ``TABLE_CHUNKS`` entries they start
anew, which costs time and never changes a result.

Whether a model's pieces do keep inside marked words is checked from its
vocabulary; other models are encoded text by text.

Null text counts as empty; null ids and repeated rows pass through row by row;
an empty table gives an empty table; extra columns are left aside.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .text import plain, texts_of

MARK = "▁"
TABLE_CHUNKS = 400_000
#: Chunks longer than this are segmented each time and not kept.
KEPT_CHARS = 64
#: New words are segmented in lines of so many: the library's time for a line grows faster than its length.
LINE_WORDS = 64


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class ChunkTable:
    """Encodes and decodes with one table entry for each distinct marked word."""

    def __init__(self, model: bytes, limit: int = TABLE_CHUNKS):
        import sentencepiece

        self.lib = sentencepiece.SentencePieceProcessor(model_proto=model)
        pieces = [self.lib.id_to_piece(i) for i in range(self.lib.get_piece_size())]
        self.separable = not any(re.search(f"[^{MARK}]{MARK}", p) for p in pieces) and self._identity()
        self.limit = limit
        self.marked = np.array([p.startswith(MARK) for p in pieces])
        self.names = [f"{i}," for i in range(len(pieces))]
        self.table: dict[str, str] = {}  # a chunk's ids, each with a comma after it
        self.back: dict[str, str] = {}  # ids, as in the table, to their text with the space of its marker
        self.runs = re.compile(f"[ {MARK}]+[^ {MARK}]*")

    def _identity(self) -> bool:
        """The library adds one marker in front and changes nothing else."""
        tries = ["", "a", " a", "a  b ", "ﬁ é　x", "\tq\r\n"]
        return all(self.lib.decode(self.lib.encode(t)) == t for t in tries) and self.lib.encode("a") == [self.lib.piece_to_id(MARK + "a")]

    def _learn(self, new: list[str]) -> None:
        """Words after one marker are segmented in lines; a line's ids part
        again where a piece begins with the marker."""
        words, rest = [], []
        for c in new:
            (words if len(c) > 1 and c[1] != " " else rest).append(c)
        for k in range(0, len(words), LINE_WORDS):
            part = words[k : k + LINE_WORDS]
            line = "".join(part)[1:]
            ids = self.lib.encode(line)
            cuts = np.flatnonzero(self.marked[ids]).tolist()
            if len(cuts) == len(part) and self.lib.decode(ids) == line:
                lists = [ids[i:j] for i, j in zip(cuts, [*cuts[1:], len(ids)])]
                for c, own in zip(part, lists):
                    self._keep(c, own)
            else:
                rest += part
        for c in rest:
            ids = self.lib.encode(c[1:]) if len(c) > 1 else [self.lib.piece_to_id(MARK)]
            self._keep(c, ids)

    def _keep(self, chunk: str, ids: list[int]) -> None:
        joined = self.table[chunk] = "".join([self.names[i] for i in ids])
        if joined not in self.back:
            self.back[joined] = " " + self.lib.decode(ids)

    def chunks(self, text: str) -> list[str]:
        if not text:
            return []
        if "  " in text or MARK in text or text[0] == " " or text[-1] == " ":
            return self.runs.findall(" " + text.replace(MARK, " "))
        return (" " + text.replace(" ", "\x00 ")).split("\x00") if "\x00" not in text else self.runs.findall(" " + text)

    def code(self, texts: list[str]) -> Iterator[tuple[int, str, str]]:
        """Per text: number of ids, ids joined by commas, decoded text."""
        if not self.separable:
            for t in texts:
                ids = self.lib.encode(t)
                yield len(ids), ",".join(map(str, ids)), self.lib.decode(ids)
            return
        table, back, cuts = self.table, self.back, [self.chunks(t) for t in texts]
        distinct = set().union(*cuts)
        if len(table) > self.limit:
            table.clear()
            back.clear()
        self._learn(list(distinct.difference(table)))
        for t, cut in zip(texts, cuts):
            coded = [table[c] for c in cut]
            ids = "".join(coded)
            yield ids.count(","), ids[:-1], "".join([back[x] for x in coded])[1:]
        for c in distinct:
            if len(c) > KEPT_CHARS:
                back.pop(table.pop(c), None)


def _id_lists(joined: list[str]) -> pa.Array:
    rows = [np.fromstring(x, np.int32, sep=",") if x else np.zeros(0, np.int32) for x in joined]
    offsets = np.cumsum([0, *map(len, rows)])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate([*rows, np.zeros(0, np.int32)]), pa.int32()))


def encode_decode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model_path: str | None = None, keep: tuple[str, ...] = ("ids", "decoded")) -> DataFrame:
    """Ids and decoded text of every document, in full.

    Returns ``id_col``, n_tokens (long), ids_sha256, decoded_sha256 (string)
    and, as named in ``keep``, ids (array<int>) and decoded (string).
    """
    with open(model_path or default_model(), "rb") as f:
        model = f.read()
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a model file: half a megabyte, whatever the input
    chosen = plain(docs, id_col, text_col)
    kind = dict(chosen.dtypes)[id_col]
    extra = {"ids": "ids array<int>", "decoded": "decoded string"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = ChunkTable(shared.value)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        for batch in batches:
            for at, to, *_ in texts_of(pa.Table.from_batches([batch]), text_col):
                part = batch.slice(at, to - at)
                rows = [(n, sha(ids), sha(text), ids if "ids" in keep else None, text if "decoded" in keep else None) for n, ids, text in table.code([t or "" for t in part.column(1).to_pylist()])]
                n, ids_sha, text_sha, ids, texts = (list(x) for x in zip(*rows))
                columns = [part.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]
                if "ids" in keep:
                    columns.append(_id_lists(ids))
                if "decoded" in keep:
                    columns.append(pa.array(texts, pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256", *(k for k in ("ids", "decoded") if k in keep)])

    schema = ", ".join([f"`{id_col}` {kind}", "n_tokens bigint, ids_sha256 string, decoded_sha256 string", *(extra[k] for k in ("ids", "decoded") if k in keep)])
    return chosen.mapInArrow(run, schema)
