"""Scores of documents as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.model import ScaleModel
from ..operators.score import score_linear


def score_stream(embeddings: DataFrame, model: ScaleModel, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Appends (doc_id, score) of a streaming DataFrame of (doc_id, embedding) to
    parquet.  Scoring keeps no state, so each document is scored once, exactly."""
    out = score_linear(embeddings, model.beta)
    return out.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(**(trigger or {"availableNow": True})).start()
