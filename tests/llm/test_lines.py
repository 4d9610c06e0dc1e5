import random

import numpy as np

from latentrank.llm.line_dedup import Chunks, line_dedup

SF = "/root/testdata/sf0.001"


def chunks(text):
    """(first line, lines) by the same boundaries, one text at a time."""
    data = np.frombuffer(text.encode(), np.uint8)
    c = Chunks(data, np.array([0, len(data)]))
    lines = text.split("\n")
    if lines[-1] == "":
        lines = lines[:-1]
    at = [*c.line.tolist(), len(lines)]
    return [(a, lines[a:b]) for a, b in zip(at, at[1:])]


def brute(rows):
    first = {}
    order = lambda i: (i is None, i or 0)
    found = []
    for i, t in rows:
        found.append((i, t, chunks(t) if t else []))
        for at, lines in found[-1][2]:
            key = "\n".join(lines)
            place = (order(i), at)
            first[key] = min(first.get(key, place), place)
    out = []
    for i, t, cs in found:
        left = []
        for at, lines in cs:
            key, place = "\n".join(lines), (order(i), at)
            fit = sum(bool(x.split()) for x in lines) >= 2 and len(key.split()) >= 8
            if not (fit and first[key] < place and not (i is None and first[key][0] == order(None))):
                left += lines
        out.append((i, None if t is None else "\n".join(left)))
    return sorted(out, key=str)


def test_equals_brute_force(spark):
    rng = random.Random(11)
    line = lambda: " ".join(rng.choice("ab cd ef gh ij kl mn op".split()) + str(rng.randrange(50)) for _ in range(rng.randrange(3, 9)))
    pool = [[line() for _ in range(rng.randrange(2, 9))] for _ in range(12)]
    rows = [(7000, None), (7001, ""), (7002, "one line only of eight words is not several"), (None, "\n".join(pool[0])), (None, "\n".join(pool[0]))]
    for i in range(150):
        lines = [line() for _ in range(rng.randrange(0, 8))]
        for _ in range(rng.randrange(0, 3)):
            at = rng.randrange(0, len(lines) + 1)
            lines[at:at] = rng.choice(pool)
        if rng.random() < 0.2:
            lines.insert(rng.randrange(0, len(lines) + 1), "")
        rows.append((rng.choice([i, i, 40]), "\n".join(lines)))
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id bigint, text string, n_lines int, TEXT_ string")
    got = line_dedup(docs, counts=False)
    assert got.columns == docs.columns
    same_id = {r[0] for r in rows if sum(x[0] == r[0] for x in rows) > 1}
    strip = lambda rs: sorted(((i, t and t.rstrip("\n")) for i, t in rs if i not in same_id), key=str)
    assert strip((r[0], r[1]) for r in got.collect()) == strip(brute(rows))
    assert sum(len(r[1] or "") for r in got.collect()) < 0.9 * sum(len(r[1] or "") for r in rows)


def test_boundaries_resist_shifts():
    rng = random.Random(2)
    lines = [f"line {rng.random()} with some words" for _ in range(200)]
    keys = lambda ls: {"\n".join(x) for _, x in chunks("\n".join(ls))}
    a, b = keys(lines), keys([*lines[:100], "inserted line", *lines[100:]])
    assert len(a - b) <= 4 and len(a) > 40
    assert all(len(x) >= 2 for _, x in chunks("\n".join(lines)))


def test_odd_rows(spark, odd_docs):
    got = line_dedup(odd_docs)
    assert got.count() == odd_docs.count() and got.columns == [*odd_docs.columns, "n_lines", "n_removed_lines"]
    assert line_dedup(odd_docs.limit(0)).count() == 0
    same = odd_docs.select("text").exceptAll(line_dedup(odd_docs, counts=False).select("text"))
    assert same.count() == 0  # no chunk of several lines repeats there
