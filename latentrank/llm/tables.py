"""Intermediate tables of these operators, in the folder that all executors share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import cache


def saved(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read again; lost executors re-read it."""
    out = cache.saved(df)
    out._latentrank_path = cache._written[-1][1]
    return out


def drop(df: DataFrame) -> None:
    """Deletes a table from ``saved`` that nothing reads any more."""
    path = getattr(df, "_latentrank_path", None)
    if path:
        cache.delete(df.sparkSession, path)
        cache._written[:] = [x for x in cache._written if x[1] != path]


def text_bytes(df: DataFrame, text_col: str) -> int:
    return df.agg(F.sum(F.octet_length(text_col).cast("bigint"))).first()[0] or 0
