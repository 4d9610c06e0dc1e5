"""Prepared datasets: projection, labels from codes, and the manifest sink."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The labels of tone codes 1 to 5.
TONE_LABELS = {1: "Promoting", 2: "Mostly promoting", 3: "Contrasting", 4: "Mostly attacking", 5: "Attacking"}


def tone_label(code: Column) -> Column:
    """The label of a code; null for any other."""
    table = F.create_map(*[F.lit(x) for pair in TONE_LABELS.items() for x in pair])
    return F.try_element_at(table, code.cast("int"))


def prepare(rows: DataFrame, columns: list[str], tone: str = "tone") -> DataFrame:
    """The columns, with the tone's label and its level."""
    return rows.select(*columns, tone_label(F.col(tone)).alias("tone_label"), F.when(F.col(tone).isin(*TONE_LABELS), F.col(tone).cast("int")).alias("tone_level"))


def write_manifest(rows: DataFrame, path: str) -> None:
    """CSV with a header; quotes are doubled, so any text comes back as it was."""
    rows.write.mode("overwrite").option("header", True).option("escape", '"').option("quoteAll", True).option("emptyValue", "").csv(path)


def read_manifest(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("escape", '"').option("multiLine", True).csv(path)


def read_checkpoint(spark: SparkSession, path: str) -> DataFrame:
    """A batch checkpoint of nested JSON."""
    schema = "version int, stage string, batch struct<id: string, status: string, request_counts: struct<total: bigint, completed: bigint, failed: bigint>>, results array<string>, started_at bigint"
    return spark.read.schema(schema).option("multiLine", True).json(path)
