import warnings

import numpy as np
import pytest
from pyspark.sql import functions as F

from latentrank.functions.hashing import draws
from latentrank.operators.blocks import blocks_of, celled, gram, packed
from latentrank.operators.model import ScaleModel, embedding_differences, fit_model, fold_moments, usable, weights_at
from latentrank.operators.score import bootstrap_betas, drawn, score_documents
from latentrank.operators.solvers import CubicSpline, Moments, fit_path, fit_smooth, lambda_path, linear_svm, sigmoid
from latentrank.operators.validate import GRID, Validation, ValidationStopped, calibration_smooth, check_quality, validate_model


def planted(spark, n=20, p=10, ties=0, split=False):
    rng = np.random.default_rng(7)
    latent, loading = rng.standard_normal(n), rng.standard_normal(p)
    e = np.outer(latent, loading) + 0.1 * rng.standard_normal((n, p))
    emb = spark.createDataFrame([(i, e[i].tolist()) for i in range(n)], "doc_id bigint, embedding array<double>")
    rows = [(i, j, "A" if latent[i] > latent[j] else "B") for i in range(n) for j in range(i + 1, n)]
    rows = [(j, i, {"A": "B", "B": "A"}[w]) if k % 2 else (i, j, w) for k, (i, j, w) in enumerate(rows)]
    at = set(rng.choice(len(rows), ties, replace=False).tolist())
    rows = [(a, b, "tie" if k in at else w, "train" if rng.random() < 0.8 else "test") for k, (a, b, w) in enumerate(rows)]
    comp = spark.createDataFrame(rows, "doc_id_a bigint, doc_id_b bigint, winner string, split string")
    return latent, emb, comp if split else comp.drop("split")


def correlation(scores, latent):
    got = {r.doc_id: r.score for r in scores.collect()}
    return np.corrcoef([got[i] for i in range(len(latent))], latent)[0, 1]


@pytest.mark.parametrize("method", ["ridge", "lasso", "enet", "svm"])
def test_planted_truth(spark, method):
    latent, emb, comp = planted(spark, ties=10)
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        m = fit_model(comp, emb, method, nlambda=60, lambda_min_ratio=1e-4, seed=1)
    assert m.n_pairs == 180 and len(m.beta) == 10
    assert correlation(score_documents(m, emb), latent) > 0.9
    if method in ("ridge", "svm"):  # without ties
        _, emb, comp = planted(spark)
        assert correlation(score_documents(fit_model(comp, emb, method, nlambda=60, lambda_min_ratio=1e-4, seed=1), emb), latent) > 0.95
    if method == "svm":
        assert m.sigma_post is None
        with pytest.raises(ValueError, match="not available"):
            score_documents(m, emb, ci=True)
    else:
        assert m.sigma_post.shape == (10, 10)


def test_intervals_and_storage(spark, tmp_path):
    latent, emb, comp = planted(spark)
    m = fit_model(comp, emb, lambda_=0.05, seed=1)
    wide, narrow = (score_documents(m, emb, ci=True, level=v).orderBy("doc_id").collect() for v in (0.99, 0.8))
    assert all(w.lower < n.lower < n.score < n.upper < w.upper for w, n in zip(wide, narrow))
    m.write(spark, str(tmp_path / "m"))
    again = ScaleModel.read(spark, str(tmp_path / "m"))
    assert np.allclose(again.beta, m.beta) and np.allclose(again.sigma_post, m.sigma_post) and again.lambda_ == m.lambda_
    boot = score_documents(m, emb, ci=True, ci_method="bootstrap", n_boot=20, comparisons=comp, seed=3)
    assert all(r.lower <= r.upper for r in boot.collect()) and boot.columns == ["doc_id", "score", "lower", "upper"]
    with pytest.raises(ValueError, match="must be supplied"):
        score_documents(m, emb, ci=True, ci_method="bootstrap")


def test_cluster_steps_equal_task_steps(spark):
    _, emb, comp = planted(spark)
    for method in ("ridge", "enet"):
        a = fit_model(comp, emb, method, lambda_=0.05, seed=1)
        b = fit_model(comp, emb, method, lambda_=0.05, seed=1, task_cells=0)
        assert np.allclose(a.beta, b.beta, atol=1e-5) and np.allclose(a.sigma_post, b.sigma_post, rtol=1e-3)
    design = embedding_differences(comp, emb)
    x = np.array([r.x for r in design.collect()])
    w = sigmoid(0.1 + x @ a.beta)
    want = (x * (w * (1 - w))[:, None]).T @ x
    for tile in (512, 3):  # one tile, and rims of ten columns in tiles of three
        assert np.allclose(gram(packed(design, 1, 10), 10, weights_at(0.1, a.beta), tile=tile), want)


def test_errors(spark):
    _, emb, comp = planted(spark, split=True)
    with pytest.raises(ValueError, match="should be one of"):
        fit_model(comp, emb, "other")
    with pytest.raises(ValueError, match="no winner"):
        fit_model(comp.withColumn("winner", F.lit(None).cast("string")), emb)


def test_optimality_of_penalised_fits():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((300, 6)) * [1, 2, 3, 1, 1, 5] + 1
    y = (rng.random(300) < sigmoid(x @ [0.5, -0.3, 0, 0, 0.2, 0])).astype(float)
    m = Moments.of(x, y)
    z = (x - m.mean) / m.scale
    for alpha in (0.0, 0.5, 1.0):
        lam = lambda_path(m, alpha, 50, 1e-3)[15]
        b0, b = fit_path(x, y, np.array([lam]), alpha)[0]
        u = b * m.scale
        g = z.T @ (y - sigmoid(b0 + x @ b)) / 300 - lam * (1 - alpha) * u
        assert abs((y - sigmoid(b0 + x @ b)).mean()) < 1e-6
        live = u != 0
        assert np.allclose(g[live], lam * alpha * np.sign(u[live]), atol=1e-6)
        assert (np.abs(g[~live]) <= lam * alpha + 1e-6).all()


def test_svm_separates():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((200, 3))
    y = (x @ [1, -2, 0.5] > 0.3).astype(float)
    b0, b = linear_svm(x, y, 10.0)
    assert ((x @ b + b0 > 0) == y).mean() > 0.97


def test_spline_and_smooth(spark):
    rng = np.random.default_rng(1)
    knots = np.linspace(0.5, 1, 10)
    s = CubicSpline(knots)
    assert np.allclose(s.basis(knots), np.eye(10))
    line = s.basis(np.array([0.3, 0.77, 1.2])) @ knots
    assert np.allclose(line, [0.3, 0.77, 1.2])  # straight lines pass through, also beyond the ends
    x = rng.uniform(0.5, 1, 4000)
    y = (rng.random(4000) < x).astype(float)
    b = s.basis(x)
    c = fit_smooth(s, 4000, b.T @ b, b.T @ y, b.sum(0), y.sum(), y @ y)
    assert np.abs(c[0] + s.basis(GRID) @ c[1:] - GRID).mean() < 0.03
    df = spark.createDataFrame([(float(u), float(v)) for u, v in zip(x, y)], "prob double, result double")
    assert np.abs(calibration_smooth(df) - GRID).mean() < 0.03


def test_validation(spark):
    latent, emb, comp = planted(spark, n=30, ties=10, split=True)
    m = fit_model(comp, emb, lambda_=0.05, seed=1)
    v = validate_model(m, comp, emb, force=True)
    test = [r for r in comp.collect() if r.split == "test"]
    assert v.n_ties_dropped == sum(r.winner == "tie" for r in test) and v.n_pairs == len(test) - v.n_ties_dropped
    assert 0.8 < v.accuracy <= 1 and v.accuracy_lower < v.accuracy <= v.accuracy_upper and v.ici is not None
    assert sum(r.n for r in v.plot_data().collect()) == v.n_pairs and "ICI" in str(v)
    few = validate_model(m, comp.limit(20).withColumn("split", F.lit("test")), emb, force=True)
    assert few.ici is None and "not assessed" in str(few)
    with pytest.raises(ValueError, match="not available"):
        few.plot_data()
    with pytest.raises(ValueError, match="Cannot validate"):
        validate_model(m, comp.limit(1).withColumn("split", F.lit("test")), emb)


def test_gate():
    make = lambda high, ici: Validation(None, None, 100, 50, 0.5, 0.4, high, ici, 0, 50)
    with pytest.raises(ValidationStopped, match="barely above"):
        check_quality(make(0.54, None))
    with pytest.warns(UserWarning, match="barely above"):
        check_quality(make(0.54, None), force=True)
    with pytest.warns(UserWarning, match="low"):
        check_quality(make(0.6, None))
    with pytest.raises(ValidationStopped, match="severe"):
        check_quality(make(0.9, 0.21))
    with pytest.warns(UserWarning, match="poor calibration"):
        check_quality(make(0.9, 0.11))
    check_quality(make(0.9, 0.05))


def test_path_on_cluster_equals_path_in_tasks(spark):
    """The same lambdas, curve and coefficients, with the path's early end reached."""
    _, emb, comp = planted(spark)
    fits = [fit_model(comp, emb, "ridge", nlambda=9, lambda_min_ratio=1e-9, folds=2, seed=1, task_cells=cells) for cells in (0, 1 << 40)]
    assert len(fits[0].cv) == len(fits[1].cv) < 9
    assert np.allclose(fits[0].cv, fits[1].cv, rtol=1e-4) and np.allclose(fits[0].beta, fits[1].beta, rtol=1e-3, atol=1e-5)


def test_solver_arguments_reach_the_solver(spark):
    _, emb, comp = planted(spark)
    rough, fine = (fit_model(comp, emb, lambda_=0.05, seed=1, solver=s).beta for s in ({"most": 1}, {"tol": 1e-10}))
    assert not np.allclose(rough, fine, rtol=1e-3) and np.allclose(fine, fit_model(comp, emb, lambda_=0.05, seed=1).beta, rtol=1e-3)
    with pytest.raises(Exception, match="nonsense"):
        fit_model(comp, emb, "svm", solver={"nonsense": 1})


def test_bootstrap_over_blocks_equals_refits_of_the_drawn_pairs(spark):
    _, emb, comp = planted(spark, ties=30)
    m = fit_model(comp, emb, lambda_=0.05, seed=1)
    design = packed(embedding_differences(usable(comp, None), emb), 4, 10)
    held = sorted(blocks_of(design.toArrow().to_batches()), key=lambda b: b.number)
    x, y = np.concatenate([b.x for b in held]), np.concatenate([b.y for b in held])
    times = np.zeros((6, len(y)))
    for r in drawn(spark, len(y), 0, 6, 4).collect():
        times[r.b, r["at"]] += 1
    assert (times.sum(1) == len(y)).all() and times.max() > 1
    for method, alpha in (("ridge", 0.0), ("enet", 0.5)):
        model = ScaleModel(method, m.beta, m.intercept, 0.05, alpha)
        got = bootstrap_betas(model, comp, emb, 6, seed=4)
        want = np.array([fit_path(x, y, np.array([0.05]), alpha, w, tol=1e-10)[0][1] for w in times])
        want = np.where((want @ m.beta < 0)[:, None], -want, want)
        assert np.allclose(got, want, atol=1e-5)
    got = bootstrap_betas(ScaleModel("svm", m.beta), comp, emb, 3, seed=4)
    for beta, w in zip(got, times):
        again = np.repeat(np.arange(len(y)), w.astype(int))
        _, other = linear_svm(x[again], y[again], rounds=4000)
        other = -other if other @ m.beta < 0 else other
        assert np.allclose(beta, other, atol=2e-2 * np.abs(other).max())


def test_pairs_are_not_shuffled_for_their_scores(spark, monkeypatch):
    from latentrank.operators import validate

    scores = spark.createDataFrame([(i, i / 7) for i in range(30)], "doc_id bigint, score double")
    rows = spark.createDataFrame([(i, (3 * i + 1) % 30, "A") for i in range(30)], "doc_id_a bigint, doc_id_b bigint, winner string")
    monkeypatch.setattr(validate, "SENT_SCORES", 0)
    want = sorted(validate.pair_probabilities(scores, rows).collect())
    monkeypatch.undo()
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = validate.pair_probabilities(scores, rows)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and "hashpartitioning" not in plan
        assert sorted(got.collect()) == want
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_draws_within_tasks_are_those_of_their_digests(spark):
    import hashlib

    for seed, key, low, high in ((42, 0, 0, 12_003), (None, 19, 95, 1203), (7, 499, 999_990, 1_010_003), (10**19, 10**16, 99_990, 100_010), (3, 1, 5, 5)):
        want = [int(hashlib.md5(f"{seed or 0}_boot_{key}_{j}".encode()).hexdigest()[:13], 16) for j in range(low, high)]
        assert draws(seed, "boot", key, low, high).tolist() == want


def test_counts_of_draws_are_the_same_in_any_pieces(spark, monkeypatch):
    from pyspark.sql import functions as F

    from latentrank.operators import score

    want = {(r.b, r["at"], r.times) for r in drawn(spark, 300, 2, 3, 4).groupBy("b", "at").agg(F.count("*").alias("times")).collect()}
    for pieces, counts in ((64, 90), (300, 7)):
        monkeypatch.setattr(score, "DRAWS", pieces)
        monkeypatch.setattr(score, "COUNTS", counts)
        assert {(r.b, r["at"], r.times) for r in score.times_drawn(spark, 300, 2, 3, 4).collect()} == want
    assert score.times_drawn(spark, 0, 0, 3, 4).count() == 0
    plan = score.times_drawn(spark, 300, 2, 3, 4)._jdf.queryExecution().optimizedPlan().toString()
    assert "md5" not in plan and plan.count("RepartitionByExpression") == 1  # draws are no rows, and none is shuffled by itself


def test_svm_is_one_objective_at_every_size(spark):
    _, emb, comp = planted(spark, ties=10)
    here, there = (fit_model(comp, emb, "svm", seed=1, task_cells=c) for c in (1 << 40, 0))
    assert np.allclose(here.beta, there.beta, atol=1e-6) and abs(here.intercept - there.intercept) < 1e-6
    rows = embedding_differences(usable(comp, None), emb).collect()
    x, y = np.array([r.x for r in rows]), np.array([r.y for r in rows])
    z, s = np.column_stack([x, np.full(len(y), 3.0)]), np.where(y > 0.5, 1.0, -1.0)
    value = lambda b, b0: (b @ b + (b0 / 3) ** 2) / 2 + np.maximum(1 - s * (z @ np.append(b, b0 / 3)), 0).sum()
    b0, b = linear_svm(x, y, rounds=4000)
    assert value(here.beta, here.intercept) <= value(b, b0) + 1e-6


def test_cells_give_the_sums_of_rows(spark):
    _, emb, comp = planted(spark)
    rows = usable(comp, None)
    want = packed(embedding_differences(rows, emb), 4, 10)
    for buckets in (1, 3):
        cells = celled(rows.select("doc_id_a", "doc_id_b", (F.col("winner") == "A").cast("byte").alias("y")), emb, 4, 10, buckets, 10)
        assert "x" not in cells.columns and cells.count() == buckets**2
        a, b = fold_moments(want, 10), fold_moments(cells, 10)
        assert a[2] == b[2] == 0 and all(np.allclose(u.score, v.score) and u.n == v.n for u, v in zip([a[0], *a[1]], [b[0], *b[1]]))
        assert np.allclose(gram(want, 10, weights_at(0.1, np.ones(10)), tile=4), gram(cells, 10, weights_at(0.1, np.ones(10)), tile=4))


def test_deviances_are_worked_out_on_held_out_cases_only(monkeypatch):
    from latentrank.operators import model, solvers
    from latentrank.operators.blocks import Block, Held

    rng, cells = np.random.default_rng(5), {"curve": 0, "losses": 0}
    x, fold = rng.standard_normal((400, 3)), np.arange(400) % 10
    y = (rng.random(400) < sigmoid(x @ [1.0, -1.0, 0.5])).astype(float)

    def curve(z):
        cells["curve"] += z.size if z.ndim == 2 else 0
        return sigmoid(z)

    def losses(x, y, w, b):
        cells["losses"] += w.size
        return many(x, y, w, b)

    many = solvers.many_losses
    for at in (model, solvers):
        monkeypatch.setattr(at, "sigmoid", curve)
    monkeypatch.setattr(model, "many_losses", losses)
    without = [Moments.of(x[fold != k], y[fold != k]) for k in range(10)]
    every, sets = Moments.of(x, y), [-1, *range(10)]
    fits, missed = model.paths(Held([Block(0, x, y, fold)]), every, without, sets, lambda_path(every, 0.0, 5, 1e-3), 0.0, {})
    assert 0 < cells["curve"] < cells["losses"] / 5
    assert (missed[0] == 0).all()
    for k in range(10):
        q = np.clip(sigmoid(fits[k + 1][:, :1] + fits[k + 1][:, 1:] @ x[fold == k].T), 1e-5, 1 - 1e-5)
        one = y[fold == k]
        assert np.allclose(missed[k + 1], -2 * (one * np.log(q) + (1 - one) * np.log(1 - q)).sum(1), rtol=1e-12)
