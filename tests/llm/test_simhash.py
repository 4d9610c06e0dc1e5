import random
import re

import numpy as np
import xxhash

from latentrank.llm.components import components
from latentrank.llm.simhash_dedup import RADIUS, near_groups, near_links

SF = "/root/testdata/sf0.001"


def fingerprint(text):
    t = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(values):
    values = sorted(set(values))
    a = np.array(values, np.uint64)
    of = {v: v for v in values}

    def root(x):
        while of[x] != x:
            x = of[x]
        return x

    for i, v in enumerate(values):
        for j in np.flatnonzero(np.bitwise_count(a[i + 1 :] ^ a[i]) <= RADIUS):
            x, y = root(v), root(values[i + 1 + j])
            of[max(x, y)] = min(x, y)
    return {v: root(v) for v in values}


def test_groups_equal_brute_force(spark, odd_docs):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").union(odd_docs.select("doc_id", "text"))
    rows = docs.collect()
    fps = [fingerprint(r.text) for r in rows]
    of = classes(fps)
    least = {}
    for r, f in zip(rows, fps):
        if r.doc_id is not None:
            least[of[f]] = min(r.doc_id, least.get(of[f], r.doc_id))
    want = sorted(((r.doc_id, f"{f:016x}", least.get(of[f])) for r, f in zip(rows, fps)), key=str)
    got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in near_groups(docs).collect()), key=str)
    assert got == want


def test_links_of_random_and_dense_fingerprints(spark):
    rng = random.Random(3)
    values = [rng.getrandbits(64) for _ in range(300)]
    for v in values[:60]:
        for _ in range(4):
            x = v
            for b in rng.sample(range(64), rng.randrange(1, 5)):
                x ^= 1 << b
            values.append(x)
    base = rng.getrandbits(64)
    values += [base ^ rng.getrandbits(14) for _ in range(1500)]  # many share their upper segments
    values += [base ^ (rng.getrandbits(14) << 50) for _ in range(700)]
    want = classes(values)
    signed = lambda x: x - (1 << 64) if x >= 1 << 63 else x
    fps = spark.createDataFrame([(signed(v),) for v in set(values)], "fp bigint")
    for groups in (1, 7):
        got = {}
        for r in components(near_links(fps, groups)).collect():
            got.setdefault(r.root, set()).add(r.node)
        expect = {}
        for v, k in want.items():
            expect.setdefault(k, set()).add(signed(v))
        assert sorted(map(sorted, got.values())) == sorted(sorted(x) for x in expect.values() if len(x) > 1)


def test_components_of_a_long_path(spark):
    edges = spark.range(200).selectExpr("id * 7919 % 10007 AS a", "(id + 1) * 7919 % 10007 AS b")
    got = components(edges).collect()
    assert len(got) == 201 and {r.root for r in got} == {0}
    assert components(edges.limit(0)).count() == 0


def test_empty(spark, odd_docs):
    assert near_groups(odd_docs.limit(0)).count() == 0


def test_hashes_equal_the_library():
    import xxhash

    from latentrank.llm.simhash_dedup import xxh64

    rng = np.random.default_rng(3)
    line = rng.integers(0, 256, 4000).astype(np.uint8)
    start = rng.integers(0, 3900, 3000)
    end = start + np.minimum(rng.integers(0, 70, 3000), 4000 - start)
    start, end = np.append(start, [3999, 4000]), np.append(end, [4000, 4000])
    body = line.tobytes()
    for seed in (0, 42, (1 << 64) - 5):
        assert xxh64(line, start, end, seed).tolist() == [xxhash.xxh64_intdigest(body[a:b], seed) for a, b in zip(start, end)]
