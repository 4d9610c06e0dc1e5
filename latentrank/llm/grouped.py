"""Names exchanged between groups of documents and buckets of names.

Documents are dealt into groups of about ``GROUP_BYTES`` of text by a hash of
their id.  A group sends each distinct name that it holds once, packed with the
others for the same bucket into one row; a bucket sees, for every name, at most
one entry per group however often the name occurs, and sends its answers back
packed by group.  So a name that half of all rows share costs one entry a group,
no list of occurrences ever meets in a task, and a shuffle moves about eight
bytes for each distinct name of a group.  Groups and buckets grow in number
with the input; their size grows far more slowly (see ``group_bytes``).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import text_bytes
from .text import U64

GROUP_BYTES, MOST_BYTES, SMALL_TABLE = 8 << 20, 128 << 20, 64 << 30
PACKED = "bucket int, part int, keys binary, rest binary"
PART = "__part"


def group_bytes(total: int) -> int:
    """Text in a group: beyond 64 GB it grows with the root of the input, up to
    128 MB, so that a row to a bucket still packs several names."""
    return int(min(MOST_BYTES, max(GROUP_BYTES, GROUP_BYTES * (total / SMALL_TABLE) ** 0.5)))


def dealt(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, int, int]:
    """The documents with their group, the number of groups and of buckets."""
    total = text_bytes(docs, text_col)
    groups = max(16, -(-total // group_bytes(total)))
    # by id and text: rows that share an id, or have none, need not meet
    return docs.withColumn(PART, F.pmod(F.xxhash64(id_col, text_col), F.lit(groups)).cast("int")), groups, max(16, groups // 2)


def bucket_bounds(buckets: int) -> np.ndarray:
    """Lowest key of every bucket but the first."""
    return (np.arange(1, buckets, dtype=object) * (1 << 64) // buckets).astype(U64)


def packed(part: int, keys: np.ndarray, rest: list[bytes | np.ndarray] | np.ndarray | None, buckets: int) -> pa.Table:
    """Rows of a group for all buckets; ``keys`` sorted, ``rest`` as many rows."""
    cut = np.concatenate([[0], np.searchsorted(keys, bucket_bounds(buckets)), [len(keys)]])
    some = np.flatnonzero(np.diff(cut))
    return pa.table(
        {
            "bucket": pa.array(some, pa.int32()),
            "part": pa.array(np.full(len(some), part), pa.int32()),
            "keys": pa.array([keys[cut[i] : cut[i + 1]].tobytes() for i in some], pa.binary()),
            "rest": pa.array([None if rest is None else rest[cut[i] : cut[i + 1]].tobytes() for i in some], pa.binary()),
        }
    )


def entries(t: pa.Table, dtype=None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys, group of each, rest) of packed rows."""
    keys = [np.frombuffer(x, U64) for x in t.column("keys").to_pylist()]
    part = np.repeat(t.column("part").to_numpy(), [len(x) for x in keys]) if keys else np.zeros(0, np.int32)
    rest = np.concatenate([np.frombuffer(x, dtype) for x in t.column("rest").to_pylist()]) if dtype is not None and keys else np.zeros(0, dtype or np.uint8)
    return np.concatenate(keys) if keys else np.zeros(0, U64), part, rest


def answers(part: np.ndarray, keys: np.ndarray, rest: np.ndarray | None = None) -> pa.Table:
    """Packed rows by group of answers, keys sorted within a group."""
    order = np.lexsort([keys, part])
    part, keys = part[order], keys[order]
    at = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(part) else np.zeros(0, int)
    ends = np.concatenate([at[1:], [len(part)]])
    return pa.table(
        {
            "bucket": pa.array(np.zeros(len(at)), pa.int32()),
            "part": pa.array(part[at], pa.int32()),
            "keys": pa.array([keys[i:j].tobytes() for i, j in zip(at, ends)], pa.binary()),
            "rest": pa.array([None if rest is None else rest[order[i:j]].tobytes() for i, j in zip(at, ends)], pa.binary()),
        }
    )


def by_group(rows: DataFrame, f: Callable[[int, pa.Table], pa.Table], schema: str = PACKED) -> DataFrame:
    """``f(group, its documents)`` for every group."""
    return rows.groupBy(PART).applyInArrow(lambda t: f(t.column(PART)[0].as_py(), t) if t.num_rows else f(0, t), schema)


def by_bucket(sent: DataFrame, f: Callable[[pa.Table], pa.Table]) -> DataFrame:
    return sent.groupBy("bucket").applyInArrow(f, PACKED)


def with_answers(rows: DataFrame, told: DataFrame, f: Callable[[int, pa.Table, pa.Table], pa.Table], schema) -> DataFrame:
    """``f(group, its documents, its answers)`` for every group with documents."""
    return rows.groupBy(PART).cogroup(told.groupBy("part")).applyInArrow(lambda t, a: f(t.column(PART)[0].as_py(), t, a), schema)


def ranked(keys: np.ndarray) -> Iterator:
    """Order of the keys, and where each distinct one begins in it."""
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    return order, np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, int)


class Lookup:
    """Membership in a sorted array, with a small table of bits in front."""

    def __init__(self, keys: np.ndarray, bits: int = 22):
        self.keys, self.mask = np.sort(keys), U64((1 << bits) - 1)
        self.maybe = np.zeros(1 << bits, bool)
        self.maybe[(keys & self.mask).astype(np.int64)] = True

    def find(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rows of x that are members, their places among the keys)."""
        if not len(self.keys):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        rows = np.flatnonzero(self.maybe[(x & self.mask).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.keys, x[rows]), len(self.keys) - 1)
        hit = self.keys[at] == x[rows]
        return rows[hit], at[hit]
