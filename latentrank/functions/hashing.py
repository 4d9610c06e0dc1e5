"""Seeded draws that depend on keys, not on how rows are partitioned.

Every random choice is an md5 of (seed, role, keys): the same seed gives the
same result under any partitioning, and SQL can state it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def draw(seed: int | None, role: str, *keys: str | Column) -> Column:
    """32 hex digits: uniform for distinct keys."""
    cols = [F.col(k) if isinstance(k, str) else k for k in keys]
    return F.md5(F.concat_ws("_", F.lit(str(0 if seed is None else seed)), F.lit(role), *[c.cast("string") for c in cols]))


def coin(h: Column) -> Column:
    """True for half of all draws."""
    return F.substring(h, 1, 1) < "8"


def below(h: Column, n: Column) -> Column:
    """An integer from 0 up to n, from the draw's first 52 bits."""
    return F.pmod(F.conv(F.substring(h, 1, 13), 16, 10).cast("bigint"), n)


#: Fixed values of RFC 1321: additions of the 64 steps, and by how many bits the rounds turn.
_SINES = [int(abs(np.sin(i + 1)) * 2**32) for i in range(64)]
_TURNS = [(7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)]
_WORDS = [[(a * i + c) % 16 for i in range(16)] for a, c in ((1, 0), (5, 1), (3, 5), (7, 0))]


def draws(seed: int | None, role: str, key: int, low: int, high: int) -> np.ndarray:
    """The first 52 bits of ``draw(seed, role, key, j)`` for j = low .. high - 1, within a
    task: numbers that share all but their last digits are hashed as one array."""
    head, out = f"{0 if seed is None else seed}_{role}_{key}_", []
    while low < high:
        tail = min(4, max(1, len(str(low)) - 1))
        size = 10**tail
        first, stem = low - low % size, str(low // size) if low >= 10 else ""
        out.append(_hashed((head + stem).encode(), tail)[low - first : high - first])
        low = first + size
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def _hashed(stem: bytes, tail: int) -> np.ndarray:
    """The first 52 bits of the MD5 of ``stem`` with each number of ``tail`` digits behind it."""
    numbers, length = np.arange(10**tail, dtype=np.uint32), len(stem) + tail
    if length > 55:  # more than one block
        return np.array([int(hashlib.md5(stem + b"%0*d" % (tail, i)).hexdigest()[:13], 16) for i in numbers.tolist()])
    block = np.zeros(64, np.uint8)
    block[: length + 1] = np.frombuffer(stem + b"0" * tail + b"\x80", np.uint8)
    block[56], block[57] = length * 8 & 255, length * 8 >> 8
    words: list = [int(w) for w in block.view("<u4")]
    for i in range(tail):
        at = len(stem) + i
        words[at // 4] = words[at // 4] + (numbers // 10 ** (tail - 1 - i) % 10 << 8 * (at % 4)).astype(np.uint32)
    start = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
    a, b, c, d = (np.full(len(numbers), v, np.uint32) for v in start)
    f, t = np.empty_like(a), np.empty_like(a)
    for i in range(64):
        kind, word, turn = i // 16, words[_WORDS[i // 16][i % 16]], _TURNS[i // 16][i % 4]
        if kind < 2:
            one, two, three = (c, d, b) if kind == 0 else (b, c, d)
            np.bitwise_xor(one, two, out=f)
            np.bitwise_and(f, three, out=f)
            np.bitwise_xor(f, two, out=f)
        elif kind == 2:
            np.bitwise_xor(b, c, out=f)
            np.bitwise_xor(f, d, out=f)
        else:
            np.invert(d, out=f)
            np.bitwise_or(f, b, out=f)
            np.bitwise_xor(f, c, out=f)
        f += a
        if isinstance(word, int):
            f += np.uint32((word + _SINES[i]) % 2**32)
        else:
            f += word
            f += np.uint32(_SINES[i])
        np.left_shift(f, np.uint32(turn), out=t)
        np.right_shift(f, np.uint32(32 - turn), out=f)
        f |= t
        f += b
        a, b, c, d, f = d, f, b, c, a
    a += np.uint32(start[0])
    b += np.uint32(start[1])
    return (a.byteswap().astype(np.int64) << 20) | (b.byteswap() >> np.uint32(12))


def with_rank(df: DataFrame, groups: Sequence[str], order: str, ties: Sequence[str], name: str = "rank", cut: Column | None = None) -> DataFrame:
    """Adds each row's place (from 1) within its group by ``order``, a draw.

    Equal to one ``row_number`` per group, but no group meets in a task: rows
    are ranked within cuts, and the counts of the earlier cuts are added.  A cut
    is the draw's first three digits (at most 4096 a group); an order that is no
    draw needs a ``cut`` that follows it and parts its rows evenly.
    """
    cut = df.withColumn("__cut", F.substring(order, 1, 3) if cut is None else cut)
    sizes = cut.groupBy(*groups, "__cut").agg(F.count("*").alias("__n"))
    earlier = Window.partitionBy(*groups).orderBy("__cut").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select(*[F.col(g).alias(f"__g{i}") for i, g in enumerate(groups)], F.col("__cut").alias("__at"), F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"))
    own = cut.withColumn("__rank", F.row_number().over(Window.partitionBy(*groups, "__cut").orderBy(order, *ties)))
    same = F.col("__cut") == F.col("__at")
    for i, g in enumerate(groups):
        same = same & F.col(g).eqNullSafe(F.col(f"__g{i}"))
    return own.join(before, same).withColumn(name, F.col("__rank") + F.col("__before")).drop("__cut", "__at", "__rank", "__before", *[f"__g{i}" for i in range(len(groups))])
