"""Documents to token ids: classify, drop repeated lines, near copies and
benchmark leaks, then encode."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from latentrank.llm.pipeline import STAGES
from latentrank.llm.tables import saved

#: Several stages (compression, fingerprint components, tiling, segmentation) have no SQL form.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = saved(docs)
    return docs
