import hashlib
import random
import re

import numpy as np

from latentrank.llm.grouped import Lookup
from latentrank.llm.substring_dedup import WIDTH, find_pairs, substring_dedup

SF = "/root/testdata/sf0.001"


def brute(rows):
    first = {}
    texts = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    order = lambda i: (i is None, i or 0)
    for i, w in texts:
        for k in range(len(w) - WIDTH + 1):
            key = tuple(w[k : k + WIDTH])
            if key not in first or order(i) < order(first[key]):
                first[key] = i
    out = []
    for i, w in texts:
        gone = set()
        for k in range(len(w) - WIDTH + 1):
            if order(first[tuple(w[k : k + WIDTH])]) < order(i):
                gone |= set(range(k, k + WIDTH))
        left = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(left.encode()).hexdigest(), left))
    return sorted(out, key=str)


def test_equals_brute_force(spark, odd_docs):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").union(odd_docs.select("doc_id", "text"))
    want = brute([(r.doc_id, r.text) for r in docs.collect()])
    assert sum(x[2] > 0 for x in want) > 20
    assert sorted(map(tuple, substring_dedup(docs).collect()), key=str) == want


def test_runs_periods_and_shifted_passages(spark):
    rng = random.Random(5)
    few = [f"v{i}" for i in range(3)]
    rows = []
    for i in range(120):
        w = [rng.choice(few) for _ in range(rng.randrange(0, 60))]
        if rows and rng.random() < 0.6:
            source = rng.choice(rows)[1].split()
            a = rng.randrange(0, len(source) + 1)
            at = rng.randrange(0, len(w) + 1)
            w[at:at] = source[a : a + rng.randrange(0, 40)]
        if rng.random() < 0.3:
            w += ["r"] * rng.randrange(5, 40)
        if rng.random() < 0.3:
            w = ["p", "q"] * rng.randrange(3, 20) + w
        rows.append((rng.randrange(-5, 1 << 40) if rng.random() < 0.5 else i, rng.choice([" ", "  ", "\n"]).join(w)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert sorted(map(tuple, substring_dedup(docs).collect()), key=str) == brute(rows)


def test_empty(spark, odd_docs):
    assert substring_dedup(odd_docs.limit(0)).count() == 0


def test_structured_long_words_do_not_collide(spark):
    """Thue-Morse words, whose polynomial hashes modulo a power of two are equal."""
    a, b = "a", "b"
    for _ in range(11):
        a, b = a + b, b + a
    tail = " " + " ".join(f"w{i}" for i in range(12))
    docs = spark.createDataFrame([(1, a + tail), (2, b + tail), (3, a + tail)], "doc_id bigint, text string")
    assert {r.doc_id: r.n_removed for r in substring_dedup(docs).collect()} == {1: 0, 2: 0, 3: 13}


def test_names_that_collide_are_told_apart_by_their_checks():
    known = Lookup(np.array([5, 5, 5, 9], np.uint64))
    checks = np.array([1, 3, 7, 2], np.uint64)
    rows, at = find_pairs(known, checks, np.array([5, 5, 9, 9, 4], np.uint64), np.array([7, 2, 2, 1, 1], np.uint64))
    assert sorted(zip(rows.tolist(), at.tolist())) == [(0, 2), (2, 3)]


def test_repeated_rows_and_shared_or_missing_ids(spark):
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(None, text)] * 40 + [(7, text)] * 40 + [(9, text), (7, text + " more")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert sorted(map(tuple, substring_dedup(docs).collect()), key=str) == brute(rows)
