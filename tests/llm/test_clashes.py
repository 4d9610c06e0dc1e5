"""Tables with columns that clash by case or with result names, and ids at the edges."""

import pytest
from pyspark.sql import functions as F

from latentrank.llm.chat_format import format_windows, read_back
from latentrank.llm.decontaminate import add_leaks, contamination
from latentrank.llm.line_dedup import line_dedup
from latentrank.llm.lm_score import lm_scores
from latentrank.llm.pii import digest, find_personal_data
from latentrank.llm.quality_classifier import classify, score, fit
from latentrank.llm.quality_rules import quality_rules
from latentrank.llm.sentencepiece_codec import encode_decode
from latentrank.llm.simhash_dedup import near_groups
from latentrank.llm.substring_dedup import substring_dedup


@pytest.fixture(scope="module")
def docs(spark):
    text = " ".join(f"w{i}" for i in range(40)) + "\n" + "a second line of eight words or so here"
    rows = [(2**40, text, "x", 1.0, 1, "t"), (-3, text, None, None, None, None), (0, "short", "y", 2.0, 3, "u"), (0, "short", "y", 2.0, 3, "u"), (None, text, "z", 0.0, 9, "v")]
    return spark.createDataFrame(rows, "doc_id bigint, text string, c2 string, score double, bucket int, TEXT_ string").toDF("doc_id", "text", "part", "score", "bucket", "TEXT")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(2**40, 1, 5), (0, 0, 6)], "doc_id bigint, quality int, toxic int")


@pytest.mark.parametrize("op", [quality_rules, encode_decode, near_groups, substring_dedup, lm_scores, lambda d: digest(find_personal_data(d))])
def test_operators_take_clashing_columns(spark, docs, op):
    got = op(docs)
    assert got.count() == 5 and {r[0] for r in got.collect()} == {2**40, -3, 0, None}


def test_copies_across_extreme_ids(docs):
    got = {r.doc_id: r.n_removed for r in substring_dedup(docs).collect()}
    assert got == {2**40: 49, -3: 0, 0: 0, None: 49}
    assert {r.component_id for r in near_groups(docs).collect()} == {-3, 0}
    left = line_dedup(docs, counts=False)
    assert left.columns == docs.columns
    assert sorted((r[0] is None, r[0] or 0, r[1]) for r in left.collect())[0][2] != "" and sum(r[1] == "" for r in left.collect()) == 2


def test_leaks_and_scores_keep_all_columns(spark, docs, labels):
    bench = spark.createDataFrame([(1, "a second line of eight words or so here", 0)], "item_id bigint, text string, ITEM int")
    got = add_leaks(docs, bench, leaks_col="__leaks")
    assert got.columns == [*docs.columns, "__leaks"]
    assert contamination(docs, bench).where("contaminated").count() == 3
    assert classify(docs, labels).count() == 5
    assert score(docs, fit(docs, labels), score_col="__score").columns == [*docs.columns, "__score"]


def test_conversations_with_clashing_columns(spark):
    rows = [(1, 0, "user", "hi", 3), (1, 1, "assistant", "yes", 4), (1, 1, "assistant", "yes", 4)]
    conv = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, window int")
    got = read_back(format_windows(conv)).collect()
    assert [(r.n_turns, r.loss_chars) for r in got] == [(3, 6)]
    assert format_windows(conv.select("*", F.lit(1).alias("TEXT"))).count() == 1
