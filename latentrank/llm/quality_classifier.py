"""Compression classifier: one zstandard dictionary per class.

A dictionary is trained on texts labelled good and another on texts labelled
bad.  A text is compressed under both, in pieces of ``CHUNK_BYTES`` (so that a
text that repeats itself gains nothing from its own beginning), and the
difference of the two sizes over the text's length is the one feature: a rising
logistic curve, fitted on labelled texts that the dictionaries have not seen,
turns it into a score.

Fitting uses a bounded sample: of each class at most ``sample_rows`` labelled
rows for the dictionaries and as many again for the curve, the first by a hash of
the id, of any length.  The dictionaries see a piece of ``PIECE_CHARS`` of each,
from a place given by a hash; the curve sees differences of whole texts, which
executors compute.  Scoring covers every row, in full.

Null text counts as empty and gets a score too; rows with a null label, or
whose label row is held out, are never learnt from; repeated rows get equal
scores, and rows that share an id teach once; an empty table gives an empty
table.  Without both labels among the rows to learn from, every score is the
share of label 1 (0.5 without any).  Extra columns are left aside; only the text
enters a score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .text import plain, texts_of

SAMPLE_ROWS, PIECE_CHARS = 3000, 2000
DICTIONARY_BYTES, CHUNK_BYTES, LEVEL = 262_144, 1024, 3


def held_out(id_col: str = "doc_id", folds: int = 4, fold: int = 2) -> Column:
    """True for rows whose crc32 of the id, as text, falls in the held-out fold."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % folds == fold, F.lit(False))


class Model:
    """Two dictionaries and the curve; small enough to send to every task."""

    def __init__(self, good: bytes = b"", bad: bytes = b"", curve: tuple[float, float] | None = None, prior: float = 0.5, level: int = LEVEL):
        self.good, self.bad, self.curve, self.prior, self.level = good, bad, curve, prior, level

    def parts(self) -> tuple:
        return self.good, self.bad, self.curve, self.prior, self.level

    def compressors(self):
        import zstandard as z

        def make(body: bytes):
            d = z.ZstdCompressionDict(body)
            d.precompute_compress(level=self.level)
            return z.ZstdCompressor(level=self.level, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)

        return make(self.good), make(self.bad)

    @staticmethod
    def differences(tools, texts: list[bytes]) -> np.ndarray:
        """Bytes that the good dictionary saves over the bad one, for each byte of text."""
        good, bad = tools

        def size(tool, text: bytes) -> int:
            return sum(len(tool.compress(text[i : i + CHUNK_BYTES])) for i in range(0, len(text), CHUNK_BYTES))

        return np.array([(size(bad, t) - size(good, t)) / max(len(t), 1) for t in texts], float)

    def scores(self, tools, texts: list[bytes]) -> np.ndarray:
        if self.curve is None:
            return np.full(len(texts), self.prior)
        return sigmoid(self.curve[0] + self.curve[1] * self.differences(tools, texts))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def calibrate(d: np.ndarray, y: np.ndarray, penalty: float = 0.01) -> tuple[float, float]:
    """Penalised logistic regression on one feature, by Newton steps; the slope is positive."""
    scale = d.std() + 1e-9
    z, w = np.column_stack([np.ones(len(d)), d / scale]), np.array([0.0, 1.0])
    for _ in range(60):
        p = sigmoid(z @ w)
        step = np.linalg.solve((z * (p * (1 - p) + 1e-9)[:, None]).T @ z + penalty * np.eye(2), z.T @ (p - y) + penalty * w)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(max(w[1], 1e-6) / scale)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", *, sample_rows: int = SAMPLE_ROWS, dictionary_bytes: int = DICTIONARY_BYTES, level: int = LEVEL) -> Model:
    """Learn from labelled rows outside the held-out fold."""
    import zstandard as z

    texts = plain(docs, id_col, text_col).toDF("id", "text")
    marked = plain(labels, id_col, label_col).toDF("id", "label").where(F.col("id").isNotNull() & F.col("label").isin(0, 1) & ~held_out("id")).distinct()
    marked = marked.join(texts.select("id"), "id", "left_semi").withColumn("turn", F.xxhash64("id"))

    def sample(half: int) -> DataFrame:
        """(id, label, text) of the first rows of both classes; ids first, so that no text goes through a sort."""
        of = marked.where(F.pmod(F.xxhash64("id", F.lit(1)), F.lit(2)) == half)
        ids = [of.where(F.col("label") == k).orderBy("turn", "id").limit(sample_rows).select("id", "label") for k in (0, 1)]
        return texts.join(F.broadcast(ids[0].unionByName(ids[1])), "id")  # 2 * sample_rows ids at most

    def learnt(half: int) -> tuple[list[bytes], list[bytes]]:
        place = F.pmod(F.xxhash64("text"), F.greatest(F.length("text") - PIECE_CHARS, F.lit(0)) + 1) + 1
        pieces = sample(half).withColumn("text", F.coalesce("text", F.lit(""))).select("id", "label", F.substr("text", place.cast("int"), F.lit(PIECE_CHARS)).alias("piece"))
        rows = sorted(pieces.groupBy("id", "label").agg(F.min("piece").alias("piece")).collect(), key=lambda r: (r["label"], str(r["id"])))  # pieces of bounded size
        return tuple([r["piece"].encode() for r in rows if r["label"] == k] for k in (1, 0))

    good, bad = learnt(0)
    if not good or not bad:
        n = {r["label"]: r["count"] for r in marked.groupBy("label").count().collect()}
        more = learnt(1)
        good, bad = good or more[0], bad or more[1]
        if not good or not bad:
            return Model(prior=(n.get(1, 0) + 1) / (sum(n.values()) + 2) if n else 0.5)

    def dictionary(samples: list[bytes]) -> bytes:
        try:
            return z.train_dictionary(dictionary_bytes, samples, level=level).as_bytes()
        except z.ZstdError:  # too few samples to train on: their texts themselves
            return b"".join(samples)[-dictionary_bytes:] or b"\n"

    model = Model(dictionary(good), dictionary(bad), level=level)
    sent = docs.sparkSession.sparkContext.broadcast(model.parts())  # two dictionaries of bounded size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools = Model(*sent.value).compressors()
        for batch in batches:
            for a, b, data, offsets in texts_of(pa.table([batch.column(2)], names=["text"])):
                body = data.tobytes()
                found = Model.differences(tools, [body[i:j] for i, j in zip(offsets[:-1], offsets[1:])])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a).cast(pa.int32()), pa.array(found)], names=["id", "label", "d"])

    kind = dict(texts.dtypes)["id"]
    seen = sample(1).select("id", "label", "text").mapInArrow(run, f"id {kind}, label int, d double").groupBy("id", "label").agg(F.min("d").alias("d")).collect()
    seen = sorted(((r["label"], r["d"]) for r in seen))  # 2 * sample_rows numbers at most
    if len({k for k, _ in seen}) < 2:  # too few rows for a half of their own
        tools = model.compressors()
        seen = [(k, d) for k, part in ((0, bad), (1, good)) for d in Model.differences(tools, part).tolist()]
    model.curve = calibrate(np.array([d for _, d in seen]), np.array([k for k, _ in seen], float))
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` with a column for the score of each whole text, as last column."""
    place, names = docs.columns.index(text_col), docs.columns
    inner = docs.toDF(*[f"c{i}" for i in range(len(names))])  # whatever the names, they clash with nothing
    sent = docs.sparkSession.sparkContext.broadcast(model.parts())  # two dictionaries of bounded size
    schema = StructType([*inner.schema.fields, StructField("score", DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(*sent.value)
        tools = model.compressors() if model.curve is not None else None
        for batch in batches:
            for a, b, data, offsets in texts_of(pa.table([batch.column(place)], names=["text"])):
                body = data.tobytes()
                found = model.scores(tools, [body[i:j] for i, j in zip(offsets[:-1], offsets[1:])])
                yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns, pa.array(found, pa.float64())], names=[*batch.schema.names, "score"])

    return inner.mapInArrow(run, schema).toDF(*names, score_col)


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = 0.7, **kw) -> DataFrame:
    """``id_col``, held_out, score, predicted of every document."""
    model = fit(docs, labels, id_col, text_col, label_col, **kw)
    scored = score(plain(docs, id_col, text_col), model, id_col, text_col)
    return scored.select(id_col, held_out(id_col).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
