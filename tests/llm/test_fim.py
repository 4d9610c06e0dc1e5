import hashlib
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from latentrank.llm.fill_in_middle import Cutter, checked, digest, fill_in_middle, restored, transform

UNITS = {"line": r"[^\n]*\n|[^\n]+", "word": r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "char": r"(?s:.)"}
TEXT = st.text(st.sampled_from("ab \n\t<PSM>é漢😀\x85 "), max_size=60)


@settings(max_examples=300, deadline=None)
@given(TEXT, st.sampled_from(sorted(UNITS)))
def test_units_are_those_of_the_pattern(text, unit):
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    want = [0, *(m.end() for m in re.finditer(UNITS[unit], text))]
    assert Cutter(unit).bounds(points).tolist() == want


@settings(max_examples=300, deadline=None)
@given(TEXT, st.integers(-5, 10**6))
def test_parts_lie_where_the_draws_say(text, key):
    n, form, prefix, middle, out = transform(text, key, Cutter(), 7, 100, 50, ("<P>", "<S>", "<M>"))
    units = re.findall(UNITS["line"], text)
    h = [int(hashlib.sha256(f"7:{key}".encode()).hexdigest()[i : i + 8], 16) for i in (0, 8, 16, 24)]
    assert n == len(units)
    if not text or "<P>" in text or "<S>" in text or "<M>" in text:
        assert (form, prefix, middle, out) == ("plain", None, None, text)
        return
    i, j = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:i]), "".join(units[i:j]), "".join(units[j:])
    assert (prefix, middle) == (len(p), len(m))
    assert (form, out) == (("spm", f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 50 else ("psm", f"<P>{p}<S>{s}<M>{m}"))


@pytest.mark.parametrize("unit", ["line", "word", "char"])
def test_outputs_are_turned_back(spark, odd_docs, unit):
    made = fill_in_middle(odd_docs, unit=unit, sentinels=("<|p|>", "<|s|>", "<|m|>"))
    assert made.count() == odd_docs.count()
    want = {(r.doc_id, r.text or "") for r in odd_docs.select("doc_id", "text").collect()}
    back = made.select("doc_id", restored(F.col("output"), F.col("form"), ("<|p|>", "<|s|>", "<|m|>")).alias("t"), "form")
    rows = back.collect()
    assert {(r.doc_id, r.t) for r in rows} == want
    assert {r.form for r in rows} == {"plain", "psm", "spm"}


def test_rates_and_texts_with_sentinels(spark):
    docs = spark.createDataFrame([(i, f"a\nb {i}\nc") for i in range(400)] + [(1000, "x <M> y"), (1001, "<<P"), (1002, None), (1003, "P>\nS>\nM>")], "doc_id bigint, text string")
    forms = {r.form: r["count"] for r in fill_in_middle(docs, rate=30, spm=10).groupBy("form").count().collect()}
    assert 250 < forms["plain"] < 310 and 0 < forms["spm"] < forms["psm"]
    none = fill_in_middle(docs, rate=0)
    assert none.where("form = 'plain' AND prefix_chars IS NULL").count() == docs.count()
    rows = {r.doc_id: r for r in digest(fill_in_middle(docs)).collect()}
    assert rows[1000].form == rows[1002].form == "plain" and rows[1002].n == 0 and rows[1001].form != "plain"
    for k in (1000, 1001, 1003):
        text = {1000: "x <M> y", 1001: "<<P", 1003: "P>\nS>\nM>"}[k]
        assert rows[k].restored_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert fill_in_middle(docs.where("false")).count() == 0


def test_a_megabyte_without_and_with_breaks(spark):
    docs = spark.createDataFrame([(1, "é" * 1_000_000), (2, "\n" * 1_000_000), (2, "\n" * 1_000_000)], "doc_id bigint, text string")
    made = fill_in_middle(docs)
    back = made.select("doc_id", "n", F.sha2(restored(F.col("output"), F.col("form")), 256).alias("h")).collect()
    assert sorted((r.doc_id, r.n) for r in back) == [(1, 1), (2, 1_000_000), (2, 1_000_000)]
    assert {r.h for r in back} == {hashlib.sha256(("é" * 1_000_000).encode()).hexdigest(), hashlib.sha256(b"\n" * 1_000_000).hexdigest()}


def test_extra_columns_may_clash(spark):
    docs = spark.createDataFrame([(1, "a\nb", 5, "x")], "doc_id bigint, text string, n int, form string").select("*", F.lit(1).alias("TEXT"))
    assert fill_in_middle(docs).columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    assert digest(fill_in_middle(docs)).count() == 1


def test_marks_that_overlap_are_refused():
    assert checked(("<|p|>", "<|s|>", "<|m|>"))
    for bad in (("aa", "b", "c"), ("ab", "ba", "c"), ("a", "a", "b"), ("abc", "b", "d"), ("", "a", "b")):
        with pytest.raises(ValueError):
            checked(bad)
    with pytest.raises(ValueError):
        Cutter("page")
