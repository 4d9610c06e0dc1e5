"""Embeddings of documents through a cache keyed by what determines them."""

from __future__ import annotations

import json
import logging
import uuid
import warnings
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.scalars import prompt_hash
from ..sources import cache as store
from ..sources.providers import DEFAULT_EMBEDDING_MODELS, Embedder, no_embedder

log = logging.getLogger(__name__)

REQUEST_ONLY = ("chunk_size", "parallel", "cache")
#: Turns of a run through a ledger, at most.
MOST_TURNS = 64


def embedding_cache_key(kind: str, model: str | None, options: dict) -> str:
    """None stands for the kind's default model; options that only affect the
    request, and keys, are left out; the order of options does not matter."""
    kept = {k: v for k, v in options.items() if k not in REQUEST_ONLY and "api_key" not in k}
    return prompt_hash(kind, model or DEFAULT_EMBEDDING_MODELS[kind], json.dumps(kept, sort_keys=True))


def _by_text(docs: DataFrame, cached: DataFrame, how: str, *values: str) -> DataFrame:
    """By digests of the texts, which stay out of the shuffle; a null text is a text like any other."""
    known = cached.select(store.digest("text")[0].alias("__text"), *values)
    return docs.withColumn("__key", store.digest("text")[0]).join(known, F.col("__key") == F.col("__text"), how).drop("__key", "__text")


def misses(docs: DataFrame, cached: DataFrame) -> DataFrame:
    """Documents whose text the cache lacks."""
    return _by_text(docs, cached, "left_anti")


def hits(docs: DataFrame, cached: DataFrame) -> DataFrame:
    return _by_text(docs, cached, "left_semi")


def gather(docs: DataFrame, cached: DataFrame) -> DataFrame:
    """(doc_id, embedding): by text; of several rows of a text, one with an embedding."""
    keyed = docs.select("doc_id", store.digest("text")[0].alias("__key"))
    known = cached.select(store.digest("text")[0].alias("__text"), "embedding").groupBy("__text").agg(F.max_by("embedding", F.col("embedding").isNotNull().cast("int")).alias("embedding"))
    return keyed.join(known, F.col("__key") == F.col("__text")).select("doc_id", "embedding")


class Unanswered(RuntimeError):
    """The service failed; what it had answered is kept and not asked again."""


def fetch(texts: DataFrame, embedder: Embedder, model: str | None = None, chunk_size: int = 20, partitions: int = 5, **options) -> DataFrame:
    """(text, embedding, failure) of distinct texts, ``chunk_size`` to a request, at
    most ``partitions`` requests at once.  Where a request fails, its task asks no
    more and says why in one row (text and embedding null)."""
    if model is not None:
        options["model"] = model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def answered(part: list, vectors: list, failure: str | None = None) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.array(vectors, pa.list_(pa.float64())), pa.array([failure] * len(part), pa.string())], names=["text", "embedding", "failure"])

        for batch in batches:
            for at in range(0, batch.num_rows, chunk_size):
                part = batch.column(0).slice(at, chunk_size).to_pylist()
                try:
                    vectors = embedder(part, **options)
                    if len(vectors) != len(part):
                        raise ValueError(f"the embedder gave {len(vectors)} vectors for {len(part)} documents")
                except Exception as e:  # told to the driver, which raises it once the answers are written
                    yield answered([None], [None], f"{type(e).__name__}: {e}")
                    return
                yield answered(part, vectors)

    return texts.select("text").repartition(partitions).mapInArrow(run, "text string, embedding array<double>, failure string")


def asked(texts: DataFrame, ledger: str, embedder: Embedder, model: str | None = None, chunk_size: int = 20, partitions: int = 5, **options) -> DataFrame:
    """(text, embedding) of distinct texts through a ledger: a table at ``ledger`` to
    which each turn's answers are written before the next turn is asked.

    Texts that the ledger has are not asked.  If the service fails, what it had
    answered is in the ledger, and ``Unanswered`` is raised; a lost executor costs
    its own part of one turn.
    """
    spark = texts.sparkSession
    rest = texts
    if store.exists(spark, ledger):
        rest = misses(texts, spark.read.parquet(ledger))
    rest = rest.select("text")
    turns = min(MOST_TURNS, max(1, -(-rest.count() // (chunk_size * partitions))))
    # a folder for each turn, so that a turn reads its own texts only
    parts = store.saved(rest.withColumn("turn", F.pmod(F.xxhash64("text"), F.lit(turns)).cast("int")), "turn")
    for turn in range(turns):
        told = Observation()
        got = fetch(parts.where(F.col("turn") == turn), embedder, model, chunk_size, partitions, **options).observe(told, F.max("failure").alias("failure"))
        got.where("failure IS NULL").select("text", "embedding").write.mode("append").parquet(ledger)
        failed = told.get["failure"]
        if failed is not None:
            raise Unanswered(f"{failed}; answers so far are kept in '{ledger}' and taken up by the next call.")
    return spark.read.parquet(ledger)


def get_embeddings(docs: DataFrame, cache: str | None = None, kind: str = "text", model: str | None = None, embedder: Embedder = no_embedder, **options) -> DataFrame:
    """(doc_id, embedding); only texts that the cache lacks are sent, each once.

    Answers go to a ledger beside the cache as they come; after a failure the next
    call asks for the rest only.
    """
    if kind not in DEFAULT_EMBEDDING_MODELS:
        raise ValueError("`kind` should be text or image.")
    spark = docs.sparkSession
    key = embedding_cache_key(kind, model, options)
    table, legacy = store.read_cache(spark, cache), False
    if table is not None and not {"text", "embedding"} <= set(table.columns):
        raise store.ForeignCache(f"'{cache}' is not an embeddings cache.")
    if table is not None and "cache_key" not in table.columns:
        warnings.warn(f"Embeddings cache '{cache}' does not record which model produced it. Assuming it matches the current call; delete the table if not.", stacklevel=2)
        legacy = True
        cached = store.saved(table.select("text", F.col("embedding").cast("array<double>")).transform(store.first_of, ["text"]))
    else:
        cached = store.read_entry(spark, cache, key)
    wanted = docs.select("doc_id", "text")
    texts = wanted.groupBy(store.digest("text")[0].alias("__key")).agg(F.first("text").alias("text")).select("text")
    new = texts if cached is None else misses(texts, cached)
    n_new = (wanted if cached is None else misses(wanted, cached)).count()
    n_cached = wanted.count() - n_new
    if n_cached:
        log.warning("%d document(s) loaded from cache.", n_cached)
    if n_new:
        log.warning("%d document(s) require embedding.", n_new)
        if embedder is no_embedder:
            no_embedder([])
        ledger = f"{cache.rstrip('/')}-asked-{key}" if cache is not None else f"{store.shared_folder(spark)}/latentrank-asked-{uuid.uuid4().hex}"
        fresh = asked(new, ledger, embedder, model, **options)
        if cache is None:
            store._written.append((spark, ledger))
            cached = fresh if cached is None else cached.select("text", "embedding").unionByName(fresh)
        elif legacy:
            cached = store.saved(cached.unionByName(fresh))
        else:
            store.append_entry(fresh if cached is None else misses(fresh, cached), cache, key)
    if cache is not None and legacy:
        store.replace_table(cached.select("text", "embedding"), cache, key)
    if cache is not None and (legacy or n_new):
        cached = store.read_entry(spark, cache, key)
    if cache is not None and n_new:
        store.delete(spark, ledger)
    return gather(wanted, cached)
