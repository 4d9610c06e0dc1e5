"""K-means over whole-number vectors, with Yinyang bounds.

Vectors become whole numbers once and are packed into blocks of up to
``BLOCK`` vectors.  The blocks are written once, bucketed by their number; a
round joins them with the bounds of the round before, which are bucketed alike,
so that no round shuffles or rewrites a vector.

The starting centroids are themselves clustered into a few groups, once.  A
vector keeps an upper bound of the distance to its centroid and one lower bound
a group; centroids that move loosen them.  A vector whose upper bound is below
all lower bounds stays without a distance computed (global filter); else only
groups whose bound lies within reach are scanned (group filter), exactly.
Bounds are floats with a margin for rounding and only ever rule out; what
decides are whole-number distances, so results are those of the plain method,
ties included.

Only sums by centroid reach the driver: k x (dimensions + 1) numbers a round.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import cache
from .tables import saved
from .text import plain

BLOCK, BUCKET_BYTES, FEWEST_BUCKETS = 2048, 64 << 20, 12
UP, DOWN = 1 + 1e-9, 1 - 1e-9


def bucketed(df: DataFrame, column: str, buckets: int) -> tuple[str, DataFrame]:
    """``df`` as a bucketed table in the shared folder: (its name, the table)."""
    spark, name = df.sparkSession, f"latentrank_{uuid.uuid4().hex}"
    path = f"{cache.shared_folder(spark)}/{name}"
    cache._written.append((spark, path))
    df.write.bucketBy(buckets, column).option("path", path).saveAsTable(name)
    return name, spark.table(name)


def dropped(spark, name: str) -> None:
    spark.sql(f"DROP TABLE {name}")
    path = f"{cache.shared_folder(spark)}/{name}"
    cache.delete(spark, path)
    cache._written[:] = [x for x in cache._written if x[1] != path]


def distances(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances, vectors by centroids, as float64 or int64 like the input."""
    if v.dtype == np.float64:  # all terms are whole numbers below 2 ** 53
        return (v * v).sum(1)[:, None] + (c * c).sum(1)[None, :] - 2 * (v @ c.T)
    return np.stack([((v - x) ** 2).sum(1) for x in c], 1) if len(c) else np.zeros((len(v), 0), v.dtype)


def arithmetic(top: int, dims: int):
    """The number type in which distances of components up to ``top`` are exact."""
    most = 4 * dims * top * top
    if most >= 1 << 63:
        raise ValueError(f"Squared distances of components up to {top} do not fit in 64 bits; lower `scale`.")
    return np.float64 if most < 1 << 53 else np.int64


def centroid_groups(c: np.ndarray, groups: int, rounds: int = 5) -> list[np.ndarray]:
    """Numbers of the centroids in each group, ascending; from a few rounds of k-means over them."""
    c = c.astype(float)
    middle = c[np.linspace(0, len(c) - 1, min(groups, len(c))).astype(int)]
    for _ in range(rounds):
        own = ((c[:, None] - middle[None]) ** 2).sum(2).argmin(1)
        middle = np.stack([c[own == g].mean(0) if (own == g).any() else m for g, m in enumerate(middle)])
    return [np.flatnonzero(own == g) for g in range(len(middle)) if (own == g).any()]


def two_least(d: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place of the first least, least, second least) of each row."""
    at = d.argmin(1)
    rows = np.arange(len(d))
    least = d[rows, at].astype(float)
    rest = d.astype(float)
    rest[rows, at] = np.inf
    return at, least, rest.min(1)


class Bounds:
    """Of a block's vectors: centroid, upper bound, and a lower bound for each group."""

    def __init__(self, own: np.ndarray, upper: np.ndarray, lower: np.ndarray):
        self.own, self.upper, self.lower = own, upper, lower

    def bytes(self) -> bytes:
        return self.own.astype(np.int32).tobytes() + self.upper.tobytes() + self.lower.tobytes()

    @classmethod
    def of(cls, body: bytes, n: int) -> Bounds:
        numbers = np.frombuffer(body, np.float64, offset=4 * n)
        return cls(np.frombuffer(body, np.int32, n).astype(np.int64), numbers[:n].copy(), numbers[n:].reshape(n, -1).copy())

    @classmethod
    def first(cls, v: np.ndarray, c: np.ndarray, groups: list[np.ndarray]) -> Bounds:
        d = distances(v, c)
        own = d.argmin(1)
        rest = d.astype(float)
        upper = np.sqrt(rest[np.arange(len(v)), own]) * UP
        rest[np.arange(len(v)), own] = np.inf
        return cls(own, upper, np.stack([np.sqrt(rest[:, g].min(1)) * DOWN for g in groups], 1))

    def moved(self, v: np.ndarray, c: np.ndarray, groups: list[np.ndarray], drift: np.ndarray) -> np.ndarray:
        """Brings all up to date with centroids that moved by ``drift``; the rows that were scanned."""
        self.upper = (self.upper + drift[self.own]) * UP
        self.lower = np.maximum(self.lower - np.array([drift[g].max() for g in groups]), 0) * DOWN
        rows = np.flatnonzero(self.upper >= self.lower.min(1))  # global filter
        if not len(rows):
            return rows
        exact = ((v[rows] - c[self.own[rows]]) ** 2).sum(1)
        self.upper[rows] = np.sqrt(exact.astype(float)) * UP
        left = self.upper[rows] >= self.lower[rows].min(1)
        rows, exact = rows[left], exact[left]
        before, reach = self.own[rows], self.upper[rows]
        best, who = exact.copy(), before.copy()
        found = []
        for g, members in enumerate(groups):
            here = np.flatnonzero(self.lower[rows, g] <= reach)  # group filter
            if not len(here):
                continue
            d = distances(v[rows[here]], c[members])
            at, least, second = two_least(d)
            value, name = d[np.arange(len(here)), at], members[at]
            found.append((g, here, name, least, second))
            better = (value < best[here]) | ((value == best[here]) & (name < who[here]))
            best[here[better]], who[here[better]] = value[better], name[better]
        left_behind = np.flatnonzero(who != before)
        for g, members in enumerate(groups):  # of a group that was not scanned, its former own centroid is a rival now
            was = left_behind[np.isin(before[left_behind], members)]
            self.lower[rows[was], g] = np.minimum(self.lower[rows[was], g], np.sqrt(exact[was].astype(float)) * DOWN)
        for g, here, name, least, second in found:
            self.lower[rows[here], g] = np.sqrt(np.where(who[here] == name, second, least)) * DOWN
        self.own[rows], self.upper[rows] = who, np.sqrt(best.astype(float)) * UP
        return rows


def sums_by(v: np.ndarray, own: np.ndarray, k: int, sign: int = 1, out: np.ndarray | None = None) -> np.ndarray:
    """(k, 1 + dimensions) whole numbers: how many vectors, and their sums."""
    out = np.zeros((k, v.shape[1] + 1), np.int64) if out is None else out
    for i in np.unique(own):
        mine = v[own == i]
        out[i, 0] += sign * len(mine)
        out[i, 1:] += sign * mine.sum(0).astype(np.int64)
    return out


def packed(vectors: DataFrame, id_col: str, vector_col: str, dims: int, scale: int) -> DataFrame:
    """(block, n, top, ids, body): whole-number components of all vectors of ``dims``
    finite components, rows of the narrowest integers that hold a block."""
    kind = vectors.schema[id_col].dataType.simpleString()
    good = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    rows = vectors.where((F.size(vector_col) == dims) & good).select(id_col, F.col(vector_col).cast("array<double>").alias(vector_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for b in batches:
            for at in range(0, b.num_rows, BLOCK):
                part = b.slice(at, BLOCK)
                x = np.floor(scale * part.column(1).flatten().to_numpy(zero_copy_only=False)).reshape(-1, dims)
                top = np.abs(x).max(initial=0)
                if top >= 2.0**62:
                    raise ValueError(f"A component times {scale} does not fit in 64 bits.")
                width = next(t for t in (np.int16, np.int32, np.int64) if top <= np.iinfo(t).max)
                ids = pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), pa.concat_arrays([part.column(0)]))
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([part.num_rows], pa.int32()), pa.array([int(top)], pa.int64()), ids, pa.array([x.astype(width).tobytes()], pa.binary())], names=["block", "n", "top", "ids", "body"])
                block += 1

    return rows.mapInArrow(run, f"block bigint, n int, top bigint, ids array<{kind}>, body binary")


def unpacked(body: bytes, n: int, dims: int, number) -> np.ndarray:
    return np.frombuffer(body, np.dtype(f"i{len(body) // (n * dims)}")).reshape(n, dims).astype(number)


def seeds(vectors: DataFrame, id_col: str, vector_col: str, dims: int, scale: int, k: int, seed: int) -> np.ndarray:
    """The k kept vectors of smallest SHA-256 of ``seed:id``, in that order; ties by components."""
    good = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    whole = F.transform(vector_col, lambda x: F.floor(x.cast("double") * scale).cast("bigint"))
    rows = vectors.where((F.size(vector_col) == dims) & good).select(key.alias("h"), whole.alias("v")).orderBy("h", "v").limit(k).collect()
    return np.array([r.v for r in rows], np.int64).reshape(-1, dims)


def centroid_clusters(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", *, k: int = 8, dims: int = 64, scale: int = 1024, rounds: int = 10, seed: int = 3, groups: int | None = None) -> DataFrame:
    """(id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every
    vector of ``dims`` components, none null or non-finite; others have no row.

    Centroids start as the vectors of smallest hash of their id (repeated rows
    count each, ties go by components, a null id as one without digits); fewer
    than ``k`` vectors make fewer clusters.  An empty centroid stays where it
    is.  ``rounds`` assignments and updates are followed by one assignment; it
    ends early once no centroid moves, with the same result.  Equal vectors get
    equal clusters; other columns are not kept; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    rows = plain(vectors, id_col, vector_col)
    kind = rows.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, cluster int, distance bigint"
    start = seeds(rows, id_col, vector_col, dims, scale, k, seed)
    k = len(start)
    if not k:
        return spark.createDataFrame([], f"{schema}, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    buckets = max(FEWEST_BUCKETS, -(-rows.count() * dims * 2 // BUCKET_BYTES))
    blocks_name, blocks = bucketed(packed(rows, id_col, vector_col, dims, scale).repartition(buckets, "block"), "block", buckets)
    number = arithmetic(blocks.agg(F.max("top")).first()[0], dims)
    parts = centroid_groups(start, groups or max(1, round(k**0.5)))
    centroids, totals = start, np.zeros((k, dims + 1), np.int64)
    state_name = state = drift = None

    for turn in range(rounds + 1):

        def assign(batches: Iterator[pa.RecordBatch], c=centroids.astype(number), drift=drift) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for r in b.to_pylist():
                    v = unpacked(r["body"], r["n"], dims, number)
                    if drift is None:
                        bounds = Bounds.first(v, c, parts)
                        change = sums_by(v, bounds.own, k)
                    else:
                        bounds = Bounds.of(r["state"], r["n"])
                        before = bounds.own.copy()
                        bounds.moved(v, c, parts, drift)
                        at = np.flatnonzero(before != bounds.own)
                        change = sums_by(v[at], bounds.own[at], k, out=sums_by(v[at], before[at], k, -1))
                    yield pa.RecordBatch.from_arrays([pa.array([r["block"]], pa.int64()), pa.array([bounds.bytes()], pa.binary()), pa.array([change.tobytes()], pa.binary())], names=["block", "state", "change"])

        with_bounds = blocks.select("block", "n", "body") if state is None else blocks.select("block", "n", "body").join(state.select("block", "state").hint("merge"), "block")
        name, new = bucketed(with_bounds.mapInArrow(assign, "block bigint, state binary, change binary"), "block", buckets)
        if state_name:
            dropped(spark, state_name)
        state_name, state = name, new
        if turn == rounds:
            break
        totals += _added(state, k, dims)
        moved = np.array([[int(s) // int(n) for s in t] if n else c.tolist() for n, t, c in zip(totals[:, 0], totals[:, 1:], centroids)], np.int64)
        step = moved - centroids
        centroids, drift = moved, np.sqrt((step.astype(float) ** 2).sum(1)) * UP
        if not step.any():
            break

    def measured(batches: Iterator[pa.RecordBatch], c=centroids.astype(number)) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, r in enumerate(b.select(["n", "body", "state"]).to_pylist()):
                own = Bounds.of(r["state"], r["n"]).own
                d = ((unpacked(r["body"], r["n"], dims, number) - c[own]) ** 2).sum(1).astype(np.int64)
                yield pa.RecordBatch.from_arrays([b.column("ids").slice(i, 1).flatten(), pa.array(own, pa.int32()), pa.array(d)], names=[id_col, "cluster", "distance"])

    found = saved(blocks.select("block", "n", "body", "ids").join(state.select("block", "state").hint("merge"), "block").mapInArrow(measured, schema))
    dropped(spark, state_name)
    dropped(spark, blocks_name)
    sums = dict(found.groupBy("cluster").agg(F.sum("distance")).collect())
    names = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    facts = spark.createDataFrame([(i, sums.get(i, 0), names[i]) for i in range(k)], "cluster int, cluster_inertia bigint, centroid_sha256 string")
    out = found.join(F.broadcast(facts), "cluster")  # k rows
    return out.select(id_col, "cluster", "distance", "cluster_inertia", F.lit(sum(sums.values())).cast("bigint").alias("inertia"), "centroid_sha256")


def _added(state: DataFrame, k: int, dims: int) -> np.ndarray:
    """The blocks' changes added up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(k * (dims + 1), np.int64)
        for b in batches:
            for x in b.column(0).to_pylist():
                total += np.frombuffer(x, np.int64)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at])], names=["at", "value"])

    out = np.zeros(k * (dims + 1), np.int64)
    for r in state.select("change").mapInArrow(run, "at bigint, value bigint").groupBy("at").agg(F.sum("value").alias("value")).collect():
        out[r["at"]] = r["value"]
    return out.reshape(k, dims + 1)


def _sql(k: int = 8, dims: int = 64, scale: int = 1024, rounds: int = 10, seed: int = 3) -> str:
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""a{r} AS MATERIALIZED (
  SELECT rid, k, dist FROM (SELECT rid, k, sum((p.x - c.x) * (p.x - c.x)) AS dist FROM p JOIN c{r} c USING (d) GROUP BY rid, k)
  QUALIFY row_number() OVER (PARTITION BY rid ORDER BY dist, k) = 1)""")
        if r < rounds:
            steps.append(f"""c{r + 1} AS MATERIALIZED (
  SELECT c.k, c.d, coalesce(m.x, c.x) AS x FROM c{r} c LEFT JOIN (
    SELECT k, d, ((s - ((s % n) + n) % n) // n)::BIGINT AS x FROM (SELECT k, d, sum(x)::BIGINT AS s, count(*) AS n FROM a{r} JOIN p USING (rid) GROUP BY k, d)) m ON m.k = c.k AND m.d = c.d)""")
    return f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT rid, unnest(v) AS x, generate_subscripts(v, 1) AS d FROM kept),
c0 AS MATERIALIZED (
  SELECT k, d, x FROM (SELECT rid, row_number() OVER (ORDER BY sha256('{seed}:' || coalesce(vec_id::VARCHAR, '')), v) - 1 AS k FROM kept) s JOIN p USING (rid) WHERE k < {k}),
{", ".join(steps)},
h AS (SELECT k, sha256(string_agg(x::VARCHAR, ',' ORDER BY d)) AS centroid_sha256 FROM c{rounds} GROUP BY k)
SELECT vec_id, k::INTEGER AS cluster, dist::BIGINT AS distance, (sum(dist) OVER (PARTITION BY k))::BIGINT AS cluster_inertia, (sum(dist) OVER ())::BIGINT AS inertia, centroid_sha256
FROM a{rounds} JOIN kept USING (rid) JOIN h USING (k)
"""


SQL = _sql()
