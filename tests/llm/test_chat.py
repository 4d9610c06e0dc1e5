import hashlib
import random
import re

from latentrank.llm.chat_format import STARTS, format_windows, read_back

sha = lambda s: hashlib.sha256(s.encode()).hexdigest()


def conversations(spark):
    rows = [
        (1, 0, "system", "be \\brief <b> \"x\""), (1, 1, "user", "hi </turn>"), (1, 2, "assistant", "a " * 300), (1, 3, "user", "short"), (1, 4, "assistant", "\\l\\b\\q<<"), (1, 4, "assistant", "\\l\\b\\q<<"),
        (1, 5, "user", "b " * 700), (1, 6, "assistant", "c " * 900 + "漢字"), (1, 7, "user", None), (1, 8, None, "x"), (1, 9, "assistant", ""), (1, 10, "assistant", "end"),
        (2, None, "assistant", "\n\t"), (None, 1, "user", "q"), (None, 2, "assistant", "r"), (3, 1, 'ro"le<', "t"), (4, 0, "system", "only"),
    ]
    return spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "conv_id bigint, turn bigint, role string, text string, n_turns int")


def test_round_trip(spark):
    conv = conversations(spark)
    want = {}
    for r in sorted(conv.collect(), key=lambda r: (r.conv_id is None, r.conv_id or 0, r.turn is not None, r.turn or 0, r.role or "", r.text or "")):
        want.setdefault(r.conv_id, []).append((r.role or "", r.text or ""))
    for kw in ({}, {"budget": 100, "history": 40, "min_stride": 20}):
        windows = format_windows(conv, **kw)
        got = {r.conv_id: r for r in read_back(windows).collect()}
        assert set(got) == set(want)
        for k, turns in want.items():
            said, target = "".join(f"{a}\n{b}\n" for a, b in turns), "".join(b for a, b in turns if a == "assistant")
            r = got[k]
            assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (len(turns), sha(said), len(target), sha(target))
        assert {k: r.formatted_chars for k, r in got.items()} == {r.conv_id: r["sum(n)"] for r in windows.selectExpr("conv_id", "length(formatted) n").groupBy("conv_id").sum("n").collect()}


def test_windows_keep_the_budget_and_repeat_history(spark):
    rows = [(1, 0, "system", "s s s")] + [(1, i, "user" if i % 2 else "assistant", f"w{i} " * 10) for i in range(1, 60)]
    conv = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    got = format_windows(conv, budget=120, history=40, min_stride=10).orderBy("window").collect()
    assert len(got) > 5
    for i, r in enumerate(got):
        assert r.formatted.startswith('<turn role="system"' + (">" if i == 0 else " repeated>"))
        assert r.n_tokens <= 120
        assert (r.formatted.count(" repeated>") >= 3) == (i > 0)
        for s in r.loss:
            assert r.formatted[: s.start].endswith('<turn role="assistant">') and r.formatted[s.start + s.length :].startswith("</turn>")


def test_only_single_long_turns_exceed_the_budget(spark):
    sizes = [704, 704, 64, 704, 1500, 10, 20, 30]
    rows = [(1, i, "user" if i % 2 else "assistant", "w " * (n - 4)) for i, n in enumerate(sizes)]
    got = format_windows(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string"), budget=1024).orderBy("window").collect()
    assert [r.n_tokens for r in got] == [704, 704 + 64, 64 + 704, 1500, 60]
    assert [r.formatted.count(" repeated>") for r in got] == [0, 0, 1, 0, 0]


def test_a_long_conversation(spark):
    """More spans than a block of starts holds, against a plain walk; no window carries the whole conversation."""
    rng = random.Random(6)
    sizes = [5, *(rng.randint(0, 60) for _ in range(6000))]
    rows = [(1, i, "system" if i == 0 else "user" if i % 2 else "assistant", " ".join(f"w{i}" for _ in range(n))) for i, n in enumerate(sizes)]
    windows = format_windows(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string"), budget=100, history=20, min_stride=10)
    starts, held = [], None
    for i, n in list(enumerate(sizes))[1:]:
        if held is None or held + n + 4 > 100 - 20 - 9:
            starts.append(i)
            held = 0
        held += n + 4
    assert len(starts) > 2 * STARTS
    got = windows.orderBy("window").collect()
    assert [int(re.search(r'<turn role="(?:user|assistant)">w(\d+)|$', r.formatted).group(1) or -1) if sizes[s] else s for r, s in zip(got, starts)] == starts and len(got) == len(starts)
    told = read_back(windows).first()
    assert (told.n_turns, told.turns_sha256) == (len(rows), sha("".join(f"{r[2]}\n{r[3]}\n" for r in rows)))
    plan = windows._jdf.queryExecution().executedPlan().toString()
    generate = next(line for line in plan.split("\n") if "Generate explode" in line)
    assert "all#" not in generate.split("), [")[-1]


def test_plan_has_no_python(spark):
    plan = read_back(format_windows(conversations(spark)))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_empty(spark):
    assert read_back(format_windows(conversations(spark).limit(0))).count() == 0
