import random
import tracemalloc

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from latentrank.llm.decontaminate import Items, _leaks_of, contamination, greedy_tiles, stretches

SF = "/root/testdata/sf0.01"


def brute_tiles(p, t, least):
    """Greedy string tiling by trying every pair of places, longest matches first."""
    up, ut, total = [0] * len(p), [x == -1 for x in t], 0
    while True:
        best = []
        longest = least
        for i in range(len(p)):
            for j in range(len(t)):
                n = 0
                while i + n < len(p) and j + n < len(t) and p[i + n] == t[j + n] and not up[i + n] and not ut[j + n]:
                    n += 1
                if n == longest:
                    best.append((i, j, n))
                elif n > longest:
                    longest, best = n, [(i, j, n)]
        if not best:
            return total
        for i, j, n in best:
            if not any(up[i : i + n]) and not any(ut[j : j + n]):
                up[i : i + n] = [1] * n
                ut[j : j + n] = [1] * n
                total += n


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=25), st.lists(st.integers(0, 3), max_size=30), st.integers(1, 4))
def test_tiles_cover_as_brute_force(p, t, least):
    tiles = greedy_tiles(p, t, least)
    for i, j, n in tiles:
        assert n >= least and p[i : i + n] == t[j : j + n]
    used = [k for i, _, n in tiles for k in range(i, i + n)]
    assert len(used) == len(set(used)) == brute_tiles(p, t, least)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 3), min_size=5, max_size=12), st.lists(st.lists(st.integers(1, 4), min_size=1, max_size=4), min_size=1, max_size=4), st.integers(20, 200))
def test_repeated_text_is_cut_without_effect(item, parts, times):
    k = 3
    text = [x for i in range(times) for x in parts[i % len(parts)]]
    row = np.array(text, np.uint64)
    runs = {tuple(item[i : i + k]) for i in range(len(item) - k + 1)}
    where = np.array([i for i in range(len(text) - k + 1) if tuple(text[i : i + k]) in runs], np.int64)
    if len(where):
        kept = stretches(row, where, k, len(item))
        assert sum(n for *_, n in greedy_tiles(item, kept, k)) == brute_tiles(item, text, k)


def test_many_items_against_one_repeated_phrase():
    """A phrase repeated all over a long text, in 20,000 items: nothing is expanded by both."""
    phrase = "to be or not to be that is the question"
    items = Items(list(range(20_000)), [f"{phrase} " + " ".join(f"{w}{i}" for w in "abcdefgh") for i in range(20_000)])
    text = f"{phrase} " * 2100 + " ".join(f"{w}7" for w in "abcdefgh")
    tracemalloc.start()
    found = _leaks_of(items, pa.array([text], pa.large_string()), 0.8)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [x["item_id"] for x in found[0]] == [7] and most < 500e6


def test_reordered_and_partial_passages(spark):
    rng = random.Random(4)
    w = [f"t{i}" for i in range(40)]
    filler = lambda n: [f"f{rng.randrange(1000)}" for _ in range(n)]
    docs = [
        (0, " ".join([*filler(30), *w, *filler(30)])),
        (1, " ".join([*w[20:], *filler(50), *w[:20]])),  # reordered
        (2, ", ".join([*filler(9), *w[:30]]).upper()),  # three quarters only
        (3, " ".join([*w[:12], *filler(4), *w[12:24], *filler(3), *w[24:38]])),
        (4, " ".join(x for x in w for x in (x, "y"))),  # no run of five
        (5, None), (6, ""), (0, "other words under the same id"),
    ]
    docs = spark.createDataFrame([(*d, 1) for d in docs], "doc_id bigint, text string, leaks int")
    bench = spark.createDataFrame([(10, " ".join(w)), (11, "one two three"), (12, None), (None, "x " * 9)], "item_id bigint, text string")
    nameless = spark.createDataFrame([(1, "before x x x x x x x x x after"), (2, "x x x x")], "doc_id bigint, text string")
    assert sorted((r.doc_id, r.contaminated, r.n_items, r.item_ids) for r in contamination(nameless, bench).collect()) == [(1, True, 1, "null"), (2, False, 0, "")]
    got = sorted((r.doc_id, r.contaminated, r.item_ids) for r in contamination(docs, bench).collect())
    assert got == [(0, False, ""), (0, True, "10"), (1, True, "10"), (2, False, ""), (3, True, "10"), (4, False, ""), (5, False, ""), (6, False, "")]
    assert contamination(docs, bench.limit(0)).where("contaminated").count() == 0
    assert contamination(docs.limit(0), bench).count() == 0


def test_seeds_find_what_a_scan_of_all_pairs_finds(spark):
    import re

    docs = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").limit(400).collect()]
    bench = spark.read.parquet(f"{SF}/benchmark.parquet").collect()
    items = Items([r.item_id for r in bench], [r.text for r in bench])
    found = _leaks_of(items, pa.array(docs, pa.large_string()), 0.8)
    split = lambda s: re.findall(r"[a-z0-9\u0080-\U0010ffff]+", s.lower())
    for text, leaks in zip(docs, found):
        t = split(text)
        body = " " + " ".join(t) + " "
        exact = {r.item_id for r in bench if " " + " ".join(split(r.text)) + " " in body}
        assert exact <= {x["item_id"] for x in leaks}
    assert sum(map(len, found)) > 5


def test_odd_rows(spark, odd_docs):
    bench = spark.createDataFrame([(1, "one two three four five six seven eight nine ten")], "item_id bigint, text string")
    got = contamination(odd_docs, bench).collect()
    assert len(got) == odd_docs.count() and [r.doc_id for r in got if r.contaminated] == [6]
