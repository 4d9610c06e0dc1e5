"""The contract queries of this folder and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import centroid_clusters as centroids, chat_format, fill_in_middle as middle, line_dedup as lines, substring_dedup, warc

PREDICTED_FROM = 0.7


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_dedup import substring_dedup

    return substring_dedup(table(spark, sf_dir, "documents"), keep_text=False)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import line_dedup

    return line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), whole_runs=True).select("doc_id", "n_lines", "n_removed_lines", F.sha2("text", 256).alias("kept_sha256"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import contamination

    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lm_score import lm_scores

    return lm_scores(table(spark, sf_dir, "documents"))


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat_format import format_windows, read_back

    said = "\\### Assistant: </turn> ok"
    more = spark.range(2).select(F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    return read_back(format_windows(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import quality_rules

    return quality_rules(table(spark, sf_dir, "documents"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_classifier import classify

    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=PREDICTED_FROM)


def op8_sentencepiece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sentencepiece_codec import encode_decode

    return encode_decode(table(spark, sf_dir, "documents"), keep=())


def op9_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash_dedup import near_groups

    return near_groups(table(spark, sf_dir, "documents"))


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import digest, find_personal_data

    return digest(find_personal_data(table(spark, sf_dir, "documents")))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return middle.digest(middle.fill_in_middle(table(spark, sf_dir, "documents")))


def op12_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.centroid_clusters(table(spark, sf_dir, "embeddings"))


def op13_warc_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(table(spark, sf_dir, "pages"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_line_dedup": op2_line_dedup,
    "op3_lm_scores": op3_lm_scores,
    "op4_chat_format": op4_chat_format,
    "op5_quality_rules": op5_quality_rules,
    "op6_decontaminate": op6_decontaminate,
    "op7_quality_classifier": op7_quality_classifier,
    "op8_sentencepiece_codec": op8_sentencepiece_codec,
    "op9_simhash_groups": op9_simhash_groups,
    "op10_personal_data": op10_personal_data,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_centroid_clusters": op12_centroid_clusters,
    "op13_warc_salvage": op13_warc_salvage,
}

SQL: dict[str, str] = {
    "op1_substring_dedup": substring_dedup.SQL,
    "op2_line_dedup": lines.SQL,
    "op4_chat_format": chat_format.SQL,
    "op11_fill_in_middle": middle.SQL,
    "op12_centroid_clusters": centroids.SQL,
    "op13_warc_salvage": warc.SQL,
}
