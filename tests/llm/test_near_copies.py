import random
import re

from latentrank.llm.near_copies import near_copy_groups
from latentrank.llm.pipeline import near_copies


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return frozenset(" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4)))


def groups(rows):
    """Least id by id, over all pairs."""
    sets = [(i, shingles(t)) for i, t in rows if i is not None]
    of = {i: i for i, _ in sets}

    def root(x):
        while of[x] != x:
            x = of[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[k + 1 :]:
            if 5 * len(a & b) >= 4 * len(a | b):
                x, y = root(i), root(j)
                of[max(x, y)] = min(x, y)
    return {i: root(i) for i in of}


def test_groups_equal_brute_force(spark):
    rng = random.Random(4)
    words = [f"w{k}" for k in range(3000)]
    common = " ".join(rng.choices(words, k=40))
    rows = [(9000, None), (9001, ""), (9002, " \n"), (9003, "a b"), (9004, "A b"), (9005, "a b c"), (None, common)]
    for i in range(120):
        own = rng.choices(words, k=rng.choice([6, 12, 60, 200]))
        rows.append((10 * i, " ".join(own) + ("\n" + common if rng.random() < 0.5 else "")))
        for c in range(1, rng.randrange(1, 5)):
            t = own[:]
            for _ in range(rng.randrange(0, 6)):
                t[rng.randrange(len(t))] = rng.choice(words)
            rows.append((10 * i + c, " ".join(t)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    assert {r.doc_id: r.component_id for r in near_copy_groups(docs).collect()} == groups(rows)


def test_stage_on_given_documents(spark):
    """No document that stays is near a smaller one; a document goes only into its group."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = groups([(r.doc_id, r.text) for r in docs.collect()])
    got = near_copies(spark, docs, None)
    assert got.columns == docs.columns
    assert sorted(r.doc_id for r in got.collect()) == sorted({v for v in want.values()})


def test_odd_rows(spark, odd_docs):
    got = near_copies(spark, odd_docs, None)
    assert got.columns == odd_docs.columns and got.where("doc_id IS NULL").count() == 2
    assert near_copies(spark, odd_docs.limit(0), None).count() == 0


def test_a_family_around_the_limit(spark):
    """Texts of which some pairs are just similar and others just not; long and short ones, and equal ones."""
    rng = random.Random(9)
    rows = []
    for family, size in ((0, 120), (1000, 700), (2000, 30)):
        own = [f"v{family + k}" for k in range(size)]
        for i in range(60):
            t = own[:]
            for _ in range(rng.randrange(0, 1 + size // 30)):
                t[rng.randrange(size)] = f"n{rng.randrange(10**9)}"
            rows.append((family + i, " ".join(t)))
        rows += [(family + 500 + i, rows[-1 - i][1].upper()) for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    want = groups(rows)
    assert 3 < len(set(want.values())) < 170
    assert {r.doc_id: r.component_id for r in near_copy_groups(docs).collect()} == want
