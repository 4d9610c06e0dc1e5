"""The stages of the corpus pipeline: each takes (spark, docs, sf_dir) and gives a DataFrame.

All but the last return the columns of their input.  Rows with a null id stay
where a stage decides by id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .decontaminate import add_leaks
from .line_dedup import line_dedup
from .near_copies import near_copy_groups
from .quality_classifier import fit, score
from .sentencepiece_codec import encode_decode
from .text import WORD

KEEP_FROM = 0.7


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier accepts."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = score(docs, fit(docs, labels), score_col="__score")
    return scored.where(F.col("__score") >= KEEP_FROM).drop("__score")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without runs of lines that an earlier one has; those of which
    nothing is left (copies of earlier ones, line by line) go."""
    names = docs.columns
    out = line_dedup(docs, whole_runs=True).toDF(*names, "__lines", "__removed")
    out = out.where((F.col("__removed") == 0) | F.col("text").rlike(WORD)).drop("__lines", "__removed")
    return out.withColumn("n_chars", F.length("text").cast("bigint")).select(names) if "n_chars" in names else out


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, with the smallest id, of each group of near copies (0.8 of
    five-word shingles).  Among rows that share that id, the least by a hash of
    the text stays; rows alike in id and text are one document."""
    groups = near_copy_groups(docs)
    kept = groups.groupBy("root").agg(F.min(F.struct("doc_id", "text_hash")).alias("k")).select("k.*").distinct()
    hashed = docs.where("doc_id IS NOT NULL").withColumn("__text_hash", F.xxhash64("text"))
    kept = kept.withColumnRenamed("text_hash", "__text_hash")
    stay = hashed.join(kept, ["doc_id", "__text_hash"], "left_semi").dropDuplicates(["doc_id", "__text_hash"])
    return stay.select(docs.columns).unionByName(docs.where("doc_id IS NULL"))


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    found = add_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), leaks_col="__leaks")
    return found.where(F.size("__leaks") == 0).drop("__leaks")


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document left, with digests of ids and decoded text."""
    return encode_decode(docs, keep=("ids",))


STAGES = [("quality_classifier", quality), ("line_dedup", lines), ("simhash_near_dedup", near_copies), ("benchmark_decontamination", leaks), ("sentencepiece", encoding)]
