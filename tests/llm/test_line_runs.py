import random

from latentrank.llm.line_dedup import line_dedup


def left(rows):
    """Every run of lines (with words at both ends, two such lines, eight words) found earlier goes."""
    first, places = {}, []
    for i, t in sorted(rows):
        lines = t.split("\n")
        for a in range(len(lines)):
            for b in range(a + 2, len(lines) + 1):
                run = lines[a:b]
                if run[0].split() and run[-1].split() and sum(len(x.split()) for x in run) >= 8:
                    first.setdefault(tuple(run), (i, a))
                    places.append((i, a, b, tuple(run)))
    gone = {(i, k) for i, a, b, run in places for j, c in [first[run]] if j < i or c + (b - a) <= a for k in range(a, b)}
    return sorted((i, "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in gone)) for i, t in rows)


def test_every_repeated_run_goes_whole(spark):
    rng = random.Random(5)
    line = lambda: " ".join(rng.choice("ab cd ef gh ij kl".split()) + str(rng.randrange(60)) for _ in range(rng.choice([1, 2, 4, 6])))
    pool = [[line() for _ in range(n)] for n in (2, 2, 3, 3, 4, 5, 9, 12)]
    pool += [[y for x in p for y in (x, "")][:-1] for p in pool]  # paragraphs parted by blank lines
    rows = []
    for i in range(120):
        lines = [line() for _ in range(rng.randrange(0, 6))]
        for _ in range(rng.randrange(0, 3)):
            at = rng.randrange(0, len(lines) + 1)
            lines[at:at] = rng.choice(pool)
        rows.append((i, "\n".join(lines)))
    rows += [(500, "\n".join(["the same four words"] * 5)), (501, "\n".join(["odd line number one", "even line number two"] * 4))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = line_dedup(docs, whole_runs=True).collect()
    strip = lambda rs: [(i, t.rstrip("\n")) for i, t in rs]
    assert strip(sorted((r.doc_id, r.text) for r in got)) == strip(left(rows))
    assert all(r.n_removed_lines + r.text.count("\n") + bool(r.text) in (r.n_lines, r.n_lines + 1) for r in got if not r.text.endswith("\n"))


def test_short_run_between_other_lines(spark):
    """The query's job: a passage of two lines or two paragraphs inside different texts."""
    run, parted = "one two three four five\nsix seven eight nine ten", "first paragraph of words here\n\nsecond paragraph of words here"
    rows = [(k, f"start {k}\n{run}\nmiddle {k}\n{parted}\nend {k}") for k in range(30)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: r.text for r in line_dedup(docs, counts=False, whole_runs=True).collect()}
    assert got[0] == rows[0][1] and all(got[k] == f"start {k}\nmiddle {k}\nend {k}" for k in range(1, 30))


def test_odd_rows_stay(spark, odd_docs):
    got = line_dedup(odd_docs, whole_runs=True)
    assert got.count() == odd_docs.count() and odd_docs.select("text").exceptAll(got.select("text")).count() == 0
    assert line_dedup(odd_docs.limit(0), whole_runs=True).count() == 0


def test_runs_of_one_hash_are_told_apart(spark):
    """Structured lines whose polynomial hashes are equal modulo 2 ** 64: each run keeps its first copy."""
    import numpy as np

    from latentrank.llm.text import span_hash

    bits = [bin(i).count("1") % 2 for i in range(2048)]
    a, b = ("".join("ab"[x ^ k] for x in bits) for k in (0, 1))
    data = np.frombuffer((a + b).encode(), np.uint8)
    one, other = span_hash(data, np.array([0, 2048]), np.array([2048, 4096]))
    assert a != b and one == other
    tail = "one two three four five six seven eight"
    rows = [(i, f"head {i}\n{a if i % 2 else b}\n{tail}\nfoot {i}") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: r.text for r in line_dedup(docs, counts=False, whole_runs=True).collect()}
    assert sorted(i for i in got if got[i] == rows[i][1]) == [0, 1]
    assert all(got[i] == f"head {i}\nfoot {i}" for i in range(2, 40))
