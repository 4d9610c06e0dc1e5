from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from latentrank.llm.grouped import entries
from latentrank.llm.lm_score import CLASSES, KNOWN, SIGNS, TIERS, WIDE, Encoded, Network, classes_of, count_words, encoded_corpus, lm_scores, score, shifted, train
from latentrank.llm.text import WORD, Words, raw, strings

SF = "/root/testdata/sf0.01"


def hashes(texts):
    return Words(*raw(strings(pa.array(texts, pa.string())))).hash


def vocabulary(words):
    """count, signature by hash."""
    t = pa.table(words.toArrow())
    keys, _, rest = entries(t, KNOWN)
    return {int(k): (int(n), s) for k, n, s in zip(keys, rest["n"], rest["signs"])}


def test_gradient_equals_differences():
    rng = np.random.default_rng(1)
    net = Network()
    net.vector += rng.standard_normal(len(net.vector)).astype(np.float32) * 0.1
    x = Encoded(np.array([1, 60, 0, 30]), rng.integers(0, CLASSES * TIERS, 91).astype(np.uint16))

    def loss(v):
        return -Network(v).log_likelihoods(x)[10:80].mean()

    g = net.gradient(x, 10, 80)
    for i in np.concatenate([rng.choice(len(g), 40, replace=False), np.argsort(-np.abs(g))[:40]]):
        step = np.zeros_like(net.vector)
        step[i] = 1e-2
        assert abs((loss(net.vector + step) - loss(net.vector - step)) / 2e-2 - g[i]) < 2e-3


def test_counts_and_signatures_equal_a_loop(spark, odd_docs):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").union(odd_docs.select("doc_id", "text"))
    texts = [list(hashes([r.text or ""]).tolist()) for r in docs.collect()]
    known = vocabulary(count_words(docs.repartition(5), "text", 16))
    assert {k: n for k, (n, _) in known.items()} == Counter(x for t in texts for x in t)
    signs = lambda h: 2.0 * np.unpackbits(np.array([h], np.uint64).view(np.uint8)[:2])[:SIGNS] - 1
    some = texts[3][0]
    want = sum((signs(t[i + k]) for t in texts for i, h in enumerate(t) if h == some for k in (-2, -1, 1, 2) if 0 <= i + k < len(t)), np.zeros(SIGNS))
    assert np.allclose(known[some][1], want)


def test_scores_equal_a_loop_over_words(spark):
    texts = ["a b c a b", "", "x", None, "a b c d e f g h i j k a b c"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    words = count_words(docs, "text", 16)
    known, classes = vocabulary(words), classes_of(words)
    assert classes.totals.sum() == 20
    net = Network()
    got = {r.doc_id: r for r in score(encoded_corpus(docs)[0], net, "doc_id").collect()}
    for i, t in enumerate(texts):
        cells = [int(classes.cells(np.array([known[h][0]]), known[h][1][None])[0]) for h in hashes([t]).tolist()]
        n = [known[h][0] for h in hashes([t]).tolist()]
        want = 0.0
        own, tier = [c // TIERS for c in cells], [c % TIERS for c in cells]
        for k in range(len(cells)):
            near = [own[k + o] if 0 <= k + o < len(cells) else CLASSES for o in (-2, -1, 1, 2)]
            wide = [net.wide_class[own[j]] + net.wide_tier[tier[j]] for j in range(max(0, k - WIDE), min(len(cells), k + WIDE + 1)) if j != k]
            h = np.tanh(net.bias + sum(net.near[j][c] for j, c in enumerate(near)) + (np.mean(wide, axis=0) if wide else 0))[None]
            a, b = h @ net.to_class + net.class_prior, h @ net.to_tier + net.tier_prior[own[k]]
            want += float(a[0, own[k]] - np.log(np.exp(a).sum())) + float(b[0, tier[k]] - np.log(np.exp(b).sum())) + np.log(n[k] / classes.totals[cells[k]])
        assert got[i].n_tokens == len(cells) and abs(got[i].log_likelihood - want) < 1e-3


def test_training_learns_order_whatever_the_partitions(spark):
    rng = np.random.default_rng(0)
    cycle = "sun moon star rain wind snow".split()
    texts = [" ".join(cycle[(k + i) % 6] for k in range(120)) for i in range(300)]
    texts += [" ".join(rng.permutation(t.split())) for t in texts[:5]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = []
    for parts in (2, 7):
        encoded, totals = encoded_corpus(docs.repartition(parts))
        net = train(encoded.where("doc_id < 300"), totals, "doc_id", rate=0.05)
        got.append({r.doc_id: r.mean_log_likelihood for r in score(encoded, net, "doc_id").collect()})
    assert min(got[0][i] for i in range(300)) > max(got[0][i] for i in range(300, 305)) + 0.3
    assert all(abs(got[0][i] - got[1][i]) < 1e-5 for i in range(305))


def test_held_out_text_is_predicted_better_than_by_counts(spark):
    """Against the same counts without context, on documents that the network has not seen."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    encoded, totals = encoded_corpus(docs)
    found = score(encoded, train(encoded.where("doc_id % 2 = 0"), totals, "doc_id"), "doc_id").where("doc_id % 2 = 1")
    ours = found.agg(F.sum("log_likelihood") / F.sum("n_tokens")).first()[0]
    words = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(WORD), F.lit(0))).alias("w"))
    total = words.count()
    unigram = words.join(words.groupBy("w").count(), "w").where("doc_id % 2 = 1").agg(F.avg(F.log(F.col("count") / total))).first()[0]
    assert ours > unigram + 0.3, (ours, unigram)


def test_odd_rows(spark, odd_docs):
    got = lm_scores(odd_docs).collect()
    assert len(got) == odd_docs.count()
    assert all((r.mean_log_likelihood is None) == (r.n_tokens == 0) and r.log_likelihood <= 0 for r in got)
    assert lm_scores(odd_docs.limit(0)).count() == 0
    assert shifted(np.zeros(1, int), np.zeros(1, int), 1, 9).tolist() == [9]
    assert Encoded(np.array([0, 1]), np.array([TIERS + 2], np.uint16)).near == [[CLASSES]] * 4


def test_signatures_of_frequent_words_are_whole(spark):
    """Sums far beyond 16 bits, in one task or in several."""
    rows = [(i, "tick tock tack " * 3000 + f"end {i}") for i in range(24)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    one, many = ({k: (n, s.tolist()) for k, (n, s) in vocabulary(count_words(docs.repartition(p), "text", 16)).items()} for p in (1, 12))
    assert one == many and max(abs(x) for _, s in one.values() for x in s) > 65534
    assert sorted(n for n, _ in one.values())[-3:] == [72000] * 3
