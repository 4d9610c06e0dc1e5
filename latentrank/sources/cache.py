"""Cached results, and intermediate tables in the folder that executors share.

A cache is a parquet table partitioned by ``cache_key``, a hash of whatever
determines the results, so that results of different settings live side by side
and a read touches one key's files only.  Entries grow by appended parts: what
is written follows the new rows, and ``compact`` joins the parts of a key.
"""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_written: list[tuple[SparkSession, str]] = []


class ForeignCache(ValueError):
    """The path holds a table that is no cache of the wanted kind."""


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset, a temporary folder of this
    machine, and only with a local master: other machines would not see it."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.latentrank.tables", None)
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("Set `spark.checkpoint.dir` to a folder that all executors share.")
        folder = "file://" + tempfile.mkdtemp(prefix="latentrank-")
        spark.conf.set("spark.latentrank.tables", folder)
    return folder.rstrip("/")


def saved(df: DataFrame, *by: str) -> DataFrame:
    """``df`` written to the shared folder and read again: a cut of the lineage
    that outlives lost executors.  Rows of a value of ``by`` lie in a folder of
    their own, so that others are not read for them."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/latentrank-table-{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, column: str, buckets: int) -> DataFrame:
    """``saved`` as a bucketed table: joins and groups by ``column`` do not shuffle it."""
    spark, name = df.sparkSession, f"latentrank_{uuid.uuid4().hex}"
    path = f"{shared_folder(spark)}/{name}"
    _written.append((spark, path))
    df.write.bucketBy(buckets, column).option("path", path).option("compression", "zstd").saveAsTable(name)
    return spark.table(name)


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def delete(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.delete(p, True)


@atexit.register
def _drop_all() -> None:
    for spark, path in _written:
        try:
            delete(spark, path)
            if (name := path.rsplit("/", 1)[1]).startswith("latentrank_"):
                spark.sql(f"DROP TABLE IF EXISTS {name}")
        except Exception:  # the session may be gone; the folder's owner clears it then
            return


def read_cache(spark: SparkSession, path: str | None) -> DataFrame | None:
    """The whole table, or None without a path or a table there."""
    return None if path is None or not exists(spark, path) else spark.read.parquet(path)


def read_entry(spark: SparkSession, path: str | None, key: str) -> DataFrame | None:
    """One key's rows, or None."""
    table = read_cache(spark, path)
    if table is None or "cache_key" not in table.columns:
        return None
    rows = table.where(F.col("cache_key") == key).drop("cache_key")
    return None if rows.isEmpty() else rows


def replace_table(rows: DataFrame, path: str, key: str, keep: bool = False) -> None:
    """A cache with one entry in place of another table.  It is written beside
    the old table, which goes (or with ``keep`` gets another name) only then."""
    spark, turn = rows.sparkSession, uuid.uuid4().hex
    new, old = f"{path.rstrip('/')}-new-{turn}", f"{path.rstrip('/')}-old-{turn}"
    rows.withColumn("cache_key", F.lit(key)).write.partitionBy("cache_key").parquet(new)
    fs, p = _fs(spark, path)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    if not (fs.rename(p, at(old)) and fs.rename(at(new), p)):
        raise OSError(f"'{path}' could not be replaced; see '{old}' and '{new}'.")
    if not keep:
        fs.delete(at(old), True)


def append_entry(rows: DataFrame, path: str, key: str) -> None:
    """Adds rows to one key's; all that is there stays as it is."""
    rows.withColumn("cache_key", F.lit(key)).write.mode("append").partitionBy("cache_key").option("compression", "zstd").parquet(path)


def compact(spark: SparkSession, path: str, key: str, distinct: list[str], files: int = 1) -> int:
    """Writes one key's rows anew as ``files`` files, one row for each value of the
    columns ``distinct`` (rows without nulls in the others first); the number of rows."""
    rows = read_entry(spark, path, key)
    if rows is None:
        return 0
    ready = saved(first_of(rows, distinct).repartition(files).withColumn("cache_key", F.lit(key)))
    ready.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("cache_key").parquet(path)
    return ready.count()


def digest(*columns: str) -> list[Column]:
    """Keys that stand for texts in joins and groups: SHA-256 of each, a null its own."""
    return [F.coalesce(F.sha2(F.col(c), 256), F.lit("null")) for c in columns]


def first_of(rows: DataFrame, distinct: list[str]) -> DataFrame:
    """One row for each value of ``distinct``, one with a value in all other columns where there is one."""
    rest = [c for c in rows.columns if c not in distinct]
    whole = F.lit(True)
    for c in rest:
        whole = whole & F.col(c).isNotNull()
    keys = [d.alias(f"__d{i}") for i, d in enumerate(digest(*distinct))]
    best = rows.select("*", *keys, whole.alias("__whole")).groupBy(*[f"__d{i}" for i in range(len(keys))]).agg(F.max_by(F.struct(*rows.columns), F.col("__whole").cast("int")).alias("r"))
    return best.select("r.*").select(*rows.columns)
