import json
import logging

import pytest
from pyspark.sql import functions as F

from latentrank.operators.annotate import annotate_comparisons, cache_key, cost_estimate, system_prompt
from latentrank.operators.embeddings import Unanswered, asked, embedding_cache_key, get_embeddings
from latentrank.plans.pipeline import scale_documents
from latentrank.sources.cache import ForeignCache, _written, append_entry, compact
from latentrank.sources.providers import HttpEmbedder, RuleAnnotator, ServiceError, TableAnnotator, image_uris
from latentrank.streaming.scoring import score_stream


def pairs(spark):
    return spark.createDataFrame([(0, 1, "x", "y"), (0, 2, "x", "z"), (1, 2, "y", "z")], "doc_id_a bigint, doc_id_b bigint, text_a string, text_b string")


def always(answer):
    return lambda prompts, system, model, **kw: [answer] * len(prompts)


def refuse(*a, **kw):
    raise AssertionError("asked although cached")


def test_annotation_cache(spark, tmp_path, caplog):
    path = str(tmp_path / "cache")
    got = annotate_comparisons(pairs(spark), annotator=always("A"), cache=path)
    assert [r.winner for r in got.collect()] == ["A"] * 3 and got.columns[-1] == "winner"
    caplog.clear()
    again = annotate_comparisons(pairs(spark), annotator=refuse, cache=path)
    assert again.count() == 3 and "3 comparison(s) loaded" in caplog.text
    other = annotate_comparisons(pairs(spark), annotator=always("B"), cache=path, model="gpt-5")
    assert {r.winner for r in other.collect()} == {"B"}
    turned = pairs(spark).limit(1).select(F.col("doc_id_b").alias("doc_id_a"), F.col("doc_id_a").alias("doc_id_b"), F.col("text_b").alias("text_a"), F.col("text_a").alias("text_b"))
    assert annotate_comparisons(turned, annotator=always(" Tie "), cache=path).first().winner == "tie"
    assert spark.read.parquet(path).groupBy("cache_key").count().orderBy("count").collect()[1]["count"] == 4


def test_answers_are_cleaned_and_checked(spark):
    with pytest.warns(UserWarning, match="not among"):
        got = annotate_comparisons(pairs(spark), annotator=lambda p, s, m: ["TIE ", " A\n", "a"][: len(p)] if len(p) == 3 else ["a"] * len(p))
    assert {r.winner for r in got.collect()} <= {"tie", "A", "a"}
    with pytest.warns(UserWarning, match="not among"):
        annotate_comparisons(pairs(spark), annotator=always("tie"), allow_ties=False)


def test_batch_checkpoint_goes_and_resumes(spark, tmp_path):
    path = str(tmp_path / "batch")
    spark.createDataFrame([("x", "y", "B")], "text_a string, text_b string, response string").write.parquet(path)
    got = annotate_comparisons(pairs(spark), annotator=always("A"), parallel=False, path=path)
    assert {(r.text_a, r.text_b): r.winner for r in got.collect()} == {("x", "y"): "B", ("x", "z"): "A", ("y", "z"): "A"}
    assert not (tmp_path / "batch").exists()


def test_prompts_keys_and_costs(spark):
    assert system_prompt("Which is longer?").startswith("Which is longer?\n") and "tie" in system_prompt()
    assert cache_key("p", "s", "m") != cache_key("p", "s", "m", images=True)
    p = spark.createDataFrame([("abcd",), ("ab",)], "prompt string")
    assert cost_estimate(p, "s" * 8, "gpt-5").first().cost == pytest.approx((6 + 16) / 4 / 1e6 * 1.25 + 2 / 1e6 * 10)
    assert cost_estimate(p, "", "gpt-5", batch=True, images=True).first().cost == pytest.approx((6000 / 1e6 * 1.25 + 2 / 1e6 * 10) / 2)
    assert cost_estimate(p, "", "unknown") is None


def docs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")


def test_embedding_cache(spark, tmp_path, caplog):
    path, calls = str(tmp_path / "e"), tmp_path / "calls"
    one = lambda texts, **kw: [[float(len(t)), 1.0] for t in texts]
    got = get_embeddings(docs(spark, ["a", "bb", "a"]), path, embedder=one)
    assert sorted((r.doc_id, r.embedding) for r in got.collect()) == [(0, [1, 1]), (1, [2, 1]), (2, [1, 1])]
    caplog.clear()
    caplog.set_level(logging.WARNING)
    got = get_embeddings(docs(spark, ["bb", "ccc"]), path, embedder=one)
    assert got.count() == 2 and "1 document(s) loaded" in caplog.text and "1 document(s) require" in caplog.text
    assert get_embeddings(docs(spark, ["ccc"]), path, embedder=refuse).count() == 1
    assert get_embeddings(docs(spark, ["ccc"]), path, model="other", embedder=one).count() == 1
    assert not calls.exists()
    assert embedding_cache_key("text", None, {"chunk_size": 3, "x": 1}) == embedding_cache_key("text", "text-embedding-3-large", {"x": 1, "my_api_key": "s"})
    with pytest.raises(RuntimeError, match="No embedding service"):
        get_embeddings(docs(spark, ["new"]))


def test_legacy_and_foreign_embedding_caches(spark, tmp_path):
    path = str(tmp_path / "old")
    spark.createDataFrame([("a", [1.0])], "text string, embedding array<double>").write.parquet(path)
    with pytest.warns(UserWarning, match="does not record which model"):
        assert get_embeddings(docs(spark, ["a"]), path, embedder=refuse).first().embedding == [1.0]
    assert "cache_key" in spark.read.parquet(path).columns
    spark.range(1).write.parquet(str(tmp_path / "foreign"))
    with pytest.raises(ForeignCache):
        get_embeddings(docs(spark, ["a"]), str(tmp_path / "foreign"))


def test_http_protocol(monkeypatch):
    with pytest.raises(ServiceError, match="No API key"):
        HttpEmbedder(lambda b, h: (200, ""))
    monkeypatch.setenv("EMBEDDING_API_KEY", "k")
    seen = []

    def transport(body, headers):
        seen.append(headers)
        n = len(json.loads(body)["input"])
        return (503, "") if len(seen) == 1 else (200, json.dumps({"data": [{"embedding": [float(i)], "index": i} for i in reversed(range(n))]}))

    out = HttpEmbedder(transport, wait=lambda s: None)([f"d{i}" for i in range(45)])
    assert len(out) == 45 and out[1] == [1.0] and len(seen) == 4
    with pytest.raises(ServiceError, match="401"):
        HttpEmbedder(lambda b, h: (401, ""))(["d"])


def test_image_uris(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(b"\x00" * 100)
    got = image_uris(spark.read.format("binaryFile").load(str(tmp_path / "a.png"))).first().uri
    assert got.startswith("data:image/png;base64,AAAA") and "\n" not in got


def test_whole_run_and_stream(spark, tmp_path):
    sf = "/root/testdata/sf0.01"
    e = spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").alias("doc_id"), F.col("embedding").cast("array<double>").alias("v"))
    d = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.concat(F.col("doc_id").cast("string"), F.lit(" "), F.substring("text", 1, 30)).alias("text")).join(e.select("doc_id"), "doc_id").where("doc_id < 80")
    vectors = {r.text: r.v for r in d.join(e, "doc_id").collect()}
    latent = d.join(e, "doc_id").select("doc_id", F.expr("aggregate(transform(v, (x, i) -> x * ((37 * i) % 64 / 32 - 1)), 0D, (a, x) -> a + x)").alias("value"))
    result = scale_documents(d, "Which?", n_train=600, n_test=200, seed=4, annotator=TableAnnotator(latent), embedder=lambda t, **kw: [vectors[x] for x in t], lambda_=0.01, force=True)
    assert result.scores.columns == ["doc_id", "score", "lower", "upper"] and "accuracy" in str(result)
    assert result.scores.join(latent, "doc_id").select(F.corr("score", "value")).first()[0] > 0.9
    result.embeddings.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(result.embeddings.schema).parquet(str(tmp_path / "in"))
    score_stream(stream, result.model_final, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 80
    rule = annotate_comparisons(pairs(spark), annotator=RuleAnnotator(F.when(F.col("text_a") < F.col("text_b"), "A").otherwise("B")))
    assert {r.winner for r in rule.collect()} == {"A"}


def test_null_texts_are_texts(spark, tmp_path):
    path = str(tmp_path / "n")
    size = lambda texts, **kw: [[float(len(t or ""))] for t in texts]
    for embedder in (size, refuse):
        got = get_embeddings(docs(spark, ["a", None, None]), path, embedder=embedder)
        assert sorted((r.doc_id, r.embedding) for r in got.collect()) == [(0, [1.0]), (1, [0.0]), (2, [0.0])]
    some = spark.createDataFrame([(0, 1, "x", None), (1, 2, None, None)], "doc_id_a bigint, doc_id_b bigint, text_a string, text_b string")
    for annotator in (always("B"), refuse):
        got = annotate_comparisons(some, annotator=annotator, cache=str(tmp_path / "m"), prompt="{{doc_id_a}}")
        assert [r.winner for r in got.collect()] == ["B", "B"]


def test_an_error_leaves_older_caches_alone(spark, tmp_path):
    def fails(*a, **kw):
        raise OSError("no service")

    e, w = str(tmp_path / "e"), str(tmp_path / "w")
    spark.createDataFrame([("a", [1.0])], "text string, embedding array<double>").write.parquet(e)
    spark.createDataFrame([("x", "y", "A")], "text_a string, text_b string, winner string").write.parquet(w)
    with pytest.warns(UserWarning), pytest.raises(Exception, match="no service"):
        get_embeddings(docs(spark, ["a", "b"]), e, embedder=fails)
    with pytest.raises(Exception, match="no service"):
        annotate_comparisons(pairs(spark), annotator=fails, cache=w)
    assert spark.read.parquet(e).count() == spark.read.parquet(w).count() == 1
    got = annotate_comparisons(pairs(spark), annotator=always("B"), cache=w)
    assert sorted(r.winner for r in got.collect()) == ["A", "B", "B"] and "cache_key" in spark.read.parquet(w).columns
    spark.createDataFrame([("x", "y", "A", "h")], "text_a string, text_b string, winner string, prompt_hash string").write.parquet(f"{w}2")
    annotate_comparisons(pairs(spark), annotator=always("B"), cache=f"{w}2")
    assert any(p.name.startswith("w2-old-") for p in tmp_path.iterdir())


def test_a_failed_batch_goes_on_where_it_stopped(spark, tmp_path):
    path, many = str(tmp_path / "b"), spark.range(40).selectExpr("id AS doc_id_a", "id + 1 AS doc_id_b", "concat('a', id) AS text_a", "concat('b', id) AS text_b")

    def fails_late(prompts, system, model, **kw):
        if any("a39" in p for p in prompts):
            raise OSError("no service")
        return ["A"] * len(prompts)

    with pytest.raises(Exception, match="no service"):
        annotate_comparisons(many, annotator=fails_late, parallel=False, path=path, batch_size=1, partitions=4)
    done = spark.read.parquet(path).count()
    assert done < 40
    got = annotate_comparisons(many, annotator=always("B"), parallel=False, path=path, batch_size=1, partitions=4)
    assert got.where("winner = 'A'").count() == done and got.where("winner IS NULL").count() == 0


def test_other_statuses_are_errors(monkeypatch):
    monkeypatch.setenv("EMBEDDING_API_KEY", "k")
    for status in (403, 404, 501):
        with pytest.raises(ServiceError, match=str(status)):
            HttpEmbedder(lambda b, h, status=status: (status, ""), wait=lambda s: None)(["d"])


def test_a_turn_reads_its_own_texts_and_asks_once(spark, tmp_path):
    texts = spark.createDataFrame([(f"text {i}",) for i in range(400)], "text string")
    status, scanned = spark.sparkContext.statusTracker(), []
    spark.sparkContext.setJobGroup("turns", "turns of a ledger")
    try:
        got = asked(texts, str(tmp_path / "ledger"), lambda part, **o: [[float(len(t))] for t in part], chunk_size=10)
        scanned = status.getJobIdsForGroup("turns")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert got.count() == got.distinct().count() == 400
    assert len(scanned) < 3 * 8 + 4  # eight turns: a job or two each, and the few before them


def test_a_failing_service_is_asked_for_the_rest_only(spark, tmp_path):
    path, seen = str(tmp_path / "cache"), tmp_path / "seen"
    seen.mkdir()
    texts = [f"text {i}" for i in range(300)] + [None]

    def service(texts, broken=False, **options):
        if broken and any(t and t.endswith("7") for t in texts) and len(list(seen.iterdir())) >= 8:
            raise TimeoutError("no answer")
        (seen / f"{abs(hash(tuple(texts)))}-{broken}").write_text(json.dumps(texts))
        return [[float(len(t or "")), 0.0] for t in texts]

    with pytest.raises(Unanswered, match="TimeoutError: no answer"):
        get_embeddings(docs(spark, texts), path, embedder=lambda t, **kw: service(t, True), chunk_size=5)
    first = [t for f in seen.iterdir() for t in json.loads(f.read_text())]
    assert 0 < len(first) < len(texts)
    got = get_embeddings(docs(spark, texts), path, embedder=service, chunk_size=5)
    assert got.count() == len(texts)
    every = [t for f in seen.iterdir() for t in json.loads(f.read_text())]
    assert len(every) == len(set(every)) == len(texts)  # each text was answered once, over both runs
    assert get_embeddings(docs(spark, texts), path, embedder=refuse).count() == len(texts)
    assert [p.name for p in tmp_path.iterdir() if "asked" in p.name] == []


def test_caches_grow_by_parts(spark, tmp_path):
    path = tmp_path / "e"
    one = lambda texts, **kw: [[float(len(t)), 1.0] for t in texts]
    files = lambda: {p: p.stat().st_size for p in path.rglob("*.parquet")}
    get_embeddings(docs(spark, [f"{'long ' * 200}{i}" for i in range(200)]), str(path), embedder=one)
    before = files()
    get_embeddings(docs(spark, [f"{'long ' * 200}{i}" for i in range(201)]), str(path), embedder=one)
    after = files()
    added = [str(p) for p in after.keys() - before.keys()]
    assert before.items() <= after.items() and spark.read.parquet(*added).count() == 1
    get_embeddings(docs(spark, [f"{'long ' * 200}{i}" for i in range(201)]), str(path), embedder=refuse)
    assert files() == after  # nothing new, nothing written
    key = embedding_cache_key("text", None, {})
    append_entry(spark.createDataFrame([("again", [1.0]), ("again", None), ("again", [1.0])], "text string, embedding array<double>"), str(path), key)
    assert get_embeddings(docs(spark, ["again", "again"]), str(path), embedder=refuse).count() == 2
    assert compact(spark, str(path), key, ["text"]) == 202 and len(files()) == 1
    assert get_embeddings(docs(spark, ["again"]), str(path), embedder=refuse).first().embedding == [1.0]


def test_texts_are_written_once_for_a_run_and_once_for_its_cache(spark, tmp_path):
    path, before = str(tmp_path / "a"), set(_written)
    twice = pairs(spark).unionByName(pairs(spark).withColumn("doc_id_a", F.col("doc_id_a") + 10))
    asked = spark.sparkContext.accumulator(0)

    def judge(prompts, system, model, **kw):
        asked.add(len(prompts))
        return ["A"] * len(prompts)

    got = annotate_comparisons(twice, annotator=judge, cache=path)
    tables = [spark.read.parquet(at) for _, at in set(_written) - before]
    assert len([t for t in tables if "text_a" in t.columns]) == 1
    assert asked.value == 3 and sorted(got.columns) == ["doc_id_a", "doc_id_b", "text_a", "text_b", "winner"]
    assert got.where("winner = 'A'").count() == 6 and spark.read.parquet(path).count() == 3
    more = twice.unionByName(spark.createDataFrame([(7, 8, "y", "x")], twice.schema))
    again = annotate_comparisons(more, annotator=always("B"), cache=path)
    assert {(r.text_a, r.winner) for r in again.where("doc_id_a = 7").collect()} == {("y", "B")}
    assert again.where("winner = 'A'").count() == 6 and spark.read.parquet(path).count() == 4


def test_annotations_grow_by_parts(spark, tmp_path):
    path = tmp_path / "a"
    files = lambda: {p: p.stat().st_size for p in path.rglob("*.parquet")}
    annotate_comparisons(pairs(spark).limit(2), annotator=always(None), cache=str(path))
    before = files()
    annotate_comparisons(pairs(spark), annotator=always("A"), cache=str(path))
    after = files()
    assert before.items() <= after.items() and len(after) > len(before)
    assert [r.winner for r in annotate_comparisons(pairs(spark), annotator=refuse, cache=str(path)).collect()] == ["A"] * 3
    assert files() == after
    same = spark.createDataFrame([(0, 1, None, "y"), (0, 2, "null", "y")], "doc_id_a bigint, doc_id_b bigint, text_a string, text_b string")
    by_text = lambda prompts, system, model, **kw: ["A" if p.startswith("A: NA") else "B" for p in prompts]
    got = annotate_comparisons(same, annotator=by_text, cache=str(path)).collect()
    assert {r.doc_id_b: r.winner for r in got} == {1: "A", 2: "B"}


def test_options_reach_the_services(spark):
    texts = [f"{'x' * (i % 9)} {i}" for i in range(12)]
    told = {}

    def embedder(texts, **options):
        if options.get("dimensions") != 2:
            raise ValueError("dimensions are missing")
        return [[float(len(t)), float(t.count("1"))] for t in texts]

    def annotator(prompts, system, model, **options):
        if options.get("effort") != "low":
            raise ValueError("effort is missing")
        return ["A" if len(p.split("\n")[0]) > len(p.split("\n")[1]) else "B" for p in prompts]

    r = scale_documents(docs(spark, texts), "Which is longer?", seed=1, annotator=annotator, embedder=embedder, validate=False, ci=False, embed_options={"dimensions": 2}, annotate_options={"effort": "low"}, lambda_=0.1, **told)
    assert r.scores.count() == 12


def test_cost_of_all_needs_no_pairs(spark):
    from latentrank.functions.scalars import interpolate
    from latentrank.operators.annotate import PROMPT, cost_of_all
    from latentrank.operators.pairs import generate_comparisons

    d = spark.createDataFrame([(i, None if i == 3 else "x" * i, "b" if i % 2 else "c") for i in range(9)], "doc_id bigint, text string, block string")
    c = generate_comparisons(d, None, blocks="block")
    want = cost_estimate(c.withColumn("prompt", interpolate(PROMPT, c.columns)), "system").first()
    got = cost_of_all(d, ["block"], "system").first()
    assert (got.n, got.cost) == (want.n, pytest.approx(want.cost))


def test_probe_by_keys_of_texts(spark):
    from latentrank.operators.annotate import probe
    from latentrank.operators.pairs import generate_comparisons, with_text_keys

    d = spark.createDataFrame([(0, "x"), (1, "y"), (2, "x"), (3, None)], "doc_id bigint, text string")
    c = generate_comparisons(with_text_keys(d).drop("text"), None, columns=["key"])
    assert "text_a" not in c.columns
    known = c.where("doc_id_a = 0 OR doc_id_b = 0").withColumn("winner", F.lit("A")).withColumn("text_a", F.lit(None)).withColumn("text_b", F.lit(None))
    got = probe(c, known).collect()
    have = {(r.key_a, r.key_b) for r in known.collect()}
    assert len(got) == 6 and all((r.winner == "A") == ((r.key_a, r.key_b) in have) for r in got)
