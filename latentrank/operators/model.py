"""Fitting a linear model of judgements on embedding differences.

Pairs and embeddings are joined once and packed in blocks (``blocks.py``).  All
folds of a cross-validation, and ten lambdas at a time, advance together: a pass
over the blocks gives losses and gradients of every open problem, and problems
share curvatures, so a whole path takes some hundred passes.  Up to
``TASK_CELLS`` numbers the passes of a fold are made within a task that holds
the blocks; beyond that each pass is a job and no task holds the design.  The
solvers, and so the results, are the same.
"""

from __future__ import annotations

import logging
import warnings
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import difference, label, not_tie
from .blocks import Block, Held, Spread, blocks_of, designed, gram, summed
from .solvers import Moments, Standard, fit_paths, held_out, interior_svms, lambda_path, many_losses, sigmoid, Margins

log = logging.getLogger(__name__)

TASK_CELLS = 40_000_000
METHODS = ("ridge", "lasso", "enet", "svm")
FOLDS = 10


@dataclass(frozen=True)
class ScaleModel:
    """A fitted direction: score = embedding . beta (no intercept)."""

    method: str
    beta: np.ndarray
    intercept: float = 0.0
    lambda_: float | None = None
    alpha: float | None = None
    sigma_post: np.ndarray | None = None
    cv: list[tuple[float, float]] = field(default_factory=list)
    n_pairs: int = 0

    def write(self, spark: SparkSession, path: str) -> None:
        """One row of parquet."""
        sigma = None if self.sigma_post is None else self.sigma_post.tolist()
        row = (self.method, self.beta.tolist(), self.intercept, self.lambda_, self.alpha, sigma, self.n_pairs)
        schema = "method string, beta array<double>, intercept double, lambda double, alpha double, sigma_post array<array<double>>, n_pairs bigint"
        spark.createDataFrame([row], schema).coalesce(1).write.mode("overwrite").parquet(path)

    @staticmethod
    def read(spark: SparkSession, path: str) -> ScaleModel:
        r = spark.read.parquet(path).first()
        return ScaleModel(r["method"], np.array(r["beta"]), r["intercept"], r["lambda"], r["alpha"], None if r["sigma_post"] is None else np.array(r["sigma_post"]), [], r["n_pairs"])


def usable(comparisons: DataFrame, split: str | None) -> DataFrame:
    """Rows of a split (all without one) that are no ties; rows without a winner stay."""
    rows = comparisons.where(F.col("split") == split) if split and "split" in comparisons.columns else comparisons
    return rows.where(not_tie(F.col("winner")))


def embedding_differences(comparisons: DataFrame, embeddings: DataFrame) -> DataFrame:
    """(doc_id_a, doc_id_b, x, y): difference of the two embeddings; 1.0 where A won."""
    e = embeddings.select("doc_id", "embedding")
    rows = comparisons.select("doc_id_a", "doc_id_b", "winner")
    rows = rows.join(e.toDF("doc_id_a", "ea"), "doc_id_a").join(e.toDF("doc_id_b", "eb"), "doc_id_b")
    return rows.select("doc_id_a", "doc_id_b", difference(F.col("ea"), F.col("eb")).alias("x"), label(F.col("winner")).alias("y"))


def dimensions(embeddings: DataFrame) -> int:
    row = embeddings.where("embedding IS NOT NULL").select(F.size("embedding")).first()
    return row[0] if row else 0


def weights_at(b0: float, b: np.ndarray):
    """p(1 - p) of a block's rows at the given coefficients."""

    def weights(block: Block) -> np.ndarray:
        q = sigmoid(b0 + block.x @ b)
        return q * (1 - q)

    return weights


def fold_moments(blocks: DataFrame, p: int, folds: int = FOLDS) -> tuple[Moments, list[Moments], int]:
    """(moments of all rows, of all but each fold, rows without an answer), in one pass."""

    def part(b: Block) -> list[np.ndarray]:
        out = [np.array([np.isnan(b.y).sum()])]
        for k in range(folds):
            x, y = b.x[b.fold == k], b.y[b.fold == k]
            out += [np.array([len(y), y.sum()]), x.sum(0), (x * x).sum(0), x.T @ y]
        return out

    total = summed(blocks, part)
    by_fold = total[1:].reshape(folds, 2 + 3 * p)
    of = lambda v: Moments(v[0], v[2 : 2 + p], v[2 + p : 2 + 2 * p], v[1], v[2 + 2 * p :])
    every = by_fold.sum(0)
    with np.errstate(all="ignore"):  # a fold may hold everything
        return of(every), [of(every - v) for v in by_fold], int(total[0])


def standard_curvature(passes: Held | Spread, m: Moments):
    """The mean curvature of standard columns, as a function of standard coefficients."""
    standard = Standard(m)
    turn = np.diag(np.concatenate([[1.0], 1 / m.scale]))  # [1, x] -> [1, (x - mean) / scale]
    turn[0, 1:] = -m.mean / m.scale

    def curvature(v: np.ndarray) -> np.ndarray:
        b = standard.raw(v[None])[0]
        at = weights_at(b[0], b[1:])
        return turn.T @ passes.gram(len(m.mean), lambda block: np.maximum(at(block), 1e-5)) @ turn / m.n

    return curvature


def paths(passes: Held | Spread, every: Moments, without: list[Moments], sets: list[int], lambdas: np.ndarray, alpha: float, solver: dict) -> tuple[list, list]:
    """(raw coefficients by lambda, held-out deviances by lambda) of each of ``sets``:
    -1 is all rows, any other the rows without that fold."""
    standard, p = Standard(every), len(every.mean)
    own = [every if k < 0 else without[k] for k in sets]
    out, size = np.array(sets), np.array([m.n for m in own])

    def look(v: np.ndarray, of: np.ndarray):
        b, leave = standard.raw(v), out[of]

        def part(block: Block) -> list[np.ndarray]:
            kept = leave[:, None] != block.fold[None, :]
            loss, g, eta = many_losses(block.x, block.y, kept, b)
            return [loss, held_out(eta, block.y, block.fold, leave), g]

        total = passes.total(part)
        k = len(v)
        return total[:k] / size[of], standard.gradient(total[2 * k :].reshape(k, p + 1) / size[of][:, None]), total[k : 2 * k]

    curvature = standard_curvature(passes, every)
    return fit_paths(look, curvature, standard, own, lambdas, alpha, **solver)


def _paths_in_tasks(blocks: DataFrame, every: Moments, without: list[Moments], sets: list[int], lambdas: np.ndarray, alpha: float, solver: dict) -> tuple[list, list]:
    """The same, a task for each of ``sets``."""
    copies = blocks.withColumn("set", F.explode(F.array(*[F.lit(k) for k in sets])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, held = None, []
        for batch in batches:
            k = batch.column("set")[0].as_py()
            held += blocks_of([batch])
        (fits,), (missed,) = paths(Held(sorted(held, key=lambda b: b.number)), every, without, [k], lambdas, alpha, solver)
        yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([np.column_stack([missed, fits]).tobytes()], pa.binary())], names=["set", "body"])

    rows = {r["set"]: np.frombuffer(r["body"]).reshape(-1, len(every.mean) + 2) for r in copies.groupBy("set").applyInArrow(run, "set int, body binary").collect()}
    return [rows[k][:, 1:] for k in sets], [rows[k][:, 0] for k in sets]


def svms(passes: Held | Spread, p: int, problems: int = 1, c: float = 1.0, bias: float = 3.0, cases=None, **solver) -> np.ndarray:
    """(problems, 1 + p): intercepts and coefficients.  The intercept is a constant
    column of value ``bias``, so that its own penalty is all but nil; ``cases(block)``
    gives the case weights (problems x rows) where there are several."""

    def total(at: list[int], least: int, f) -> np.ndarray:
        def part(block: Block) -> list[np.ndarray]:
            z = np.column_stack([block.x, np.full(len(block.y), bias)])
            weights = np.ones((problems, len(block.y))) if cases is None else cases(block)
            return [np.concatenate([np.ravel(a) for a in f(r, lambda steps, r=r: Margins(z, block.y, weights[r], c, steps))]) for r in at]

        def width() -> int:  # of one problem's arrays: from a row that stands for none
            none = lambda steps: Margins(np.zeros((1, p + 1)), np.ones(1), np.ones(1), c, [])
            return sum(np.size(a) for a in f(at[0], none))

        places = np.array([i * width() + j for i in range(len(at)) for j in range(least)]) if least else None
        return passes.total(part, places)

    w = interior_svms(total, p + 1, problems, c, **solver)
    return np.column_stack([w[:, -1] * bias, w[:, :-1]])


def fit_model(comparisons: DataFrame, embeddings: DataFrame, method: str = "ridge", alpha: float = 0.5, nlambda: int = 200, lambda_min_ratio: float = 1e-9, refit: bool = False, *, folds: int = FOLDS, seed: int | None = None, lambda_: float | None = None, cost: float = 1.0, task_cells: int = TASK_CELLS, solver: dict | None = None) -> ScaleModel:
    """Fits on the train split, or on all pairs with ``refit``.

    ``lambda_`` fixes the penalty and skips cross-validation.  ``solver`` goes to
    the solver as it is: tol, most (steps a lambda) and at_once for paths, bias,
    tol and most (steps) for the SVM.
    """
    if method not in METHODS:
        raise ValueError(f"`method` should be one of {', '.join(METHODS)}, not {method!r}.")
    rows = usable(comparisons, None if refit else "train")
    p = dimensions(embeddings)
    cross = method != "svm" and lambda_ is None  # only a cross-validation needs folds, and so ranks
    blocks = designed(rows, embeddings, seed, p, folds if cross else 0)
    if not p or blocks.isEmpty():
        raise ValueError("Fitting needs pairs with either answer.")
    m, without, missing = fold_moments(blocks, p, folds if cross else 10)
    if missing:
        raise ValueError(f"{missing} pair(s) have no winner; annotate them or drop them before fitting.")
    if not 0 < m.ybar < 1:
        raise ValueError("Fitting needs pairs with either answer.")
    n = int(m.n)
    small = n * p <= task_cells

    if method == "svm":
        log.info("Linear SVM of %s pairs.", f"{n:,}")
        if small:

            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                held = sorted(blocks_of(batches), key=lambda b: b.number)
                yield pa.RecordBatch.from_arrays([pa.array([svms(Held(held), p, c=cost, **(solver or {}))[0].tolist()], pa.list_(pa.float64()))], names=["body"])

            found = np.array(blocks.withColumn("all", F.lit(0)).groupBy("all").applyInArrow(run, "body array<double>").first()["body"])
        else:
            found = svms(Spread(blocks), p, c=cost, **(solver or {}))[0]
        return ScaleModel("svm", found[1:], float(found[0]), n_pairs=n)

    a = {"ridge": 0.0, "lasso": 1.0, "enet": alpha}[method]
    lambdas = np.array([lambda_]) if lambda_ is not None else lambda_path(m, a, nlambda, lambda_min_ratio)
    cv_folds = 0 if lambda_ is not None else folds
    log.info("%s pairs, %d lambda value(s), %d fold(s) of cross-validation.", f"{n:,}", len(lambdas), cv_folds)
    sets = [-1, *(k for k in range(cv_folds) if without[k].n < n)]  # folds that hold rows
    if small:
        fits, missed = _paths_in_tasks(blocks, m, without, sets, lambdas, a, solver or {})
    else:
        fits, missed = paths(Spread(blocks), m, without, sets, lambdas, a, solver or {})
    fits, held = fits[0], missed[1:]
    curve = []
    best = 0
    if cv_folds:
        reached = min(len(fits), *(len(h) for h in held))
        held = sum(h[:reached] for h in held)
        best = int(np.argmin(held))
        curve = list(zip(lambdas[:reached].tolist(), (held[:reached] / n).tolist()))
        if best == reached - 1:
            warnings.warn("The best lambda lies at the lower boundary of those searched; a smaller `lambda_min_ratio` may fit better.", stacklevel=2)
    lam = float(lambdas[best])
    b0, b = float(fits[best][0]), fits[best][1:]
    log.info("Lambda %.3g; posterior covariance of %d x %d numbers.", lam, p, p)
    # the penalty enters unscaled by n and on the columns as they are
    sigma = np.linalg.inv(gram(blocks, p, weights_at(b0, b)) + lam * np.eye(p))
    return ScaleModel(method, b, b0, lam, a, sigma, curve, n)
