import random

import corpus_pipeline

SF = "/root/testdata/sf0.001"


def test_stages_follow_each_other(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "line_dedup", "simhash_near_dedup", "benchmark_decontamination", "sentencepiece"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, n = docs.columns, docs.count()
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, SF).persist()
        if i < 4:
            assert docs.columns == columns
        assert 0 < docs.count() <= n
        n = docs.count()
    assert "ids" in docs.columns


def test_planted_cases(spark, tmp_path):
    """Copies, leaks and junk go; clean documents stay whole."""
    rng = random.Random(8)
    docs = [r.asDict() for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    bench = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")
    words = [w for d in docs[:300] if d["lang"] == "en" and "!!" not in d["text"] for w in d["text"].split() if w.isalpha() and w.islower()]
    prose = lambda: "\n".join(" ".join(rng.choices(words, k=12)).capitalize() + "." for _ in range(12))
    item = bench.first().text
    clean = [(50_000 + i, prose()) for i in range(20)]
    copies = [(51_000 + i, t) for i, (_, t) in enumerate(clean[:5])]
    leaked = [(52_000 + i, prose() + "\n" + item + "\n" + prose()) for i in range(3)]
    junk = [(53_000 + i, " ".join(f"{rng.choice(words)}%%%" for _ in range(150))) for i in range(3)]
    new = spark.createDataFrame([(i, t, "en", "x", len(t)) for i, t in [*clean, *copies, *leaked, *junk]], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    sf = str(tmp_path)
    spark.read.parquet("/root/testdata/sf0.01/documents.parquet").unionByName(new).write.parquet(f"{sf}/documents.parquet")
    labels.write.parquet(f"{sf}/labels.parquet")
    bench.write.parquet(f"{sf}/benchmark.parquet")
    got = corpus_pipeline.run(spark, sf).collect()
    left = {r.doc_id: r.n_tokens for r in got}
    assert len(got) == len(left)
    from latentrank.llm.sentencepiece_codec import encode_decode

    whole = {r.doc_id: r.n_tokens for r in encode_decode(new).collect()}
    assert all(left.get(i) == whole[i] for i, _ in clean)
    assert not any(i in left for i, _ in [*copies, *leaked, *junk])
