import hashlib
import re

import itertools
import time
import tracemalloc

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from latentrank.llm import pii
from latentrank.llm.pii import KINDS, STATES, Base, Field, Graph, digest, find, find_personal_data, fit, luhn, repeats

SF = "/root/testdata/sf0.001"
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute(text):
    text, out = text or "", []
    for place, kind in enumerate(KINDS):
        for m in re.finditer(PATTERNS[kind], text):
            s = m.group()
            d = re.sub("[^0-9]", "", s)
            ok = {"email": True, "ip": all(int(x) <= 255 for x in s.split(".")) if kind == "ip" else True, "card": 12 <= len(d) <= 19 and luhn(d or "1"), "phone": 9 <= len(d) <= 15}[kind]
            if ok:
                out.append((m.start(), place, m.end()))
    return sorted(out)


def test_base_spans_equal_brute_force(spark, odd_docs):
    more = [(900, "mail é a.b@c-d.org, and 1.2.3.400 1.2.3.4.5.6 +1 (974) 555-3436 4111 1111 1111 1111 4111-1111-1111-1112"), (901, "x@y x@y.z 000.0.0.1 +12 +123456789012345678")]
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").union(odd_docs.select("doc_id", "text")).union(spark.createDataFrame(more, "doc_id bigint, text string"))
    want = {}
    for r in docs.collect():
        want.setdefault(r.doc_id, set()).add(",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in brute(r.text)))
    got = digest(find_personal_data(docs)).collect()
    assert len(got) == docs.count()
    for r in got:
        assert any(hashlib.sha256(w.encode()).hexdigest() == r.base_sha256 and set(w.split(",")) - {""} <= set(r.spans.split(",")) for w in want[r.doc_id])
    assert sum(r.n_email + r.n_ip + r.n_card + r.n_phone for r in got) > 20


@settings(max_examples=400, deadline=None)
@given(st.text("a1.@+- ()é2", max_size=40))
def test_scans_equal_the_patterns(text):
    assert Base().spans(text) == brute(text)


def test_scans_are_linear():
    base, began = Base(), time.process_time()
    for text in ("7" * 5_000_000, "a" * 5_000_000 + "@b.c", "1." * 2_500_000, "a.b@c.org " * 500_000, "a@" * 1_000_000, "+1 " * 1_000_000, "+1" + " " * 3_000_000):
        base.spans(text)
    assert time.process_time() - began < 30


def series(rng, n):
    """Texts in which an address or a number comes several times, among other numbers."""
    out = []
    for _ in range(n):
        phone, ip = f"+1974555{rng.integers(1000, 9999)}", ".".join(str(x) for x in rng.integers(1, 250, 4))
        words = [f"w{'abcdefgh'[rng.integers(8)]}" for _ in range(30)]
        for what in (phone, phone, phone, ip, ip, str(rng.integers(1900, 2100)), str(rng.integers(10, 99))):
            words.insert(rng.integers(len(words)), what)
        out.append(" ".join(words))
    return out


def test_learnt_links_label_a_distant_repeat(spark):
    """A number seen as a phone number is one where it lacks the plus sign; without the links learnt it is not."""
    texts = series(np.random.default_rng(5), 60)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    field, base = fit(docs), Base()
    text = "ref +19745553436 in " + "some other words and then more " * 40 + "19745553436 or 9745553436 end"
    spans = base.spans(text)
    assert [k for _, k, _ in spans] == [3]
    added = field.added(text, spans)
    assert [(text[a:b], KINDS[k]) for a, k, b in added] == [("19745553436", "phone"), ("9745553436", "phone")]
    *tables, skip = field.tables()
    assert Field(*tables, 0 * skip).added(text, spans) == []
    again = fit(docs.repartition(7))
    assert all(np.allclose(x, y) for x, y in zip(field.tables(), again.tables()))
    assert find(docs, field).where("size(added) > 0").count() <= 3


def test_messages_equal_enumeration_on_a_tree():
    rng = np.random.default_rng(2)
    text = "call 5551 5552 then 5551 x 77@a"
    g = Graph(text, Base().spans(text))
    assert len(g.chain) == 1 and len(g.skip) == 1
    field = Field(*[rng.normal(size=t.shape) for t in Field().tables()])
    field.chain, field.skip = field.chain + field.chain.T, field.skip + field.skip.T
    own, total = field.own(g), np.zeros((len(g.state), STATES))
    for states in itertools.product(range(STATES), repeat=len(g.state)):
        p = np.exp(sum(own[i, s] for i, s in enumerate(states)) + sum(field.chain[states[i], states[j]] for i, j in g.chain) + sum(field.skip[states[i], states[j]] for i, j in g.skip))
        for i, s in enumerate(states):
            total[i, s] += p
    assert np.allclose(field.marginals(g), total / total.sum(1, keepdims=True), atol=1e-4)


def test_blocks_of_edges_change_nothing(monkeypatch):
    rng = np.random.default_rng(8)
    text = " ".join(series(rng, 4))
    g = Graph(text, Base().spans(text))
    field = Field(*[rng.normal(size=t.shape) / 2 for t in Field().tables()])
    field.chain, field.skip = (field.chain + field.chain.T) / 2, (field.skip + field.skip.T) / 2
    whole = field.marginals(g)
    monkeypatch.setattr(pii, "EDGES", 3)
    assert len(g.chain) + len(g.skip) > 20 and np.allclose(field.marginals(g), whole, atol=1e-12)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 4), st.integers(0, 30)), max_size=40))
def test_repeats_are_linked_to_the_last_and_the_first(found):
    found = sorted({(i, k) for k, i in found})
    first, last, want = {}, {}, set()
    for i, k in found:
        if k in last:
            want |= {(last[k], i), (first[k], i)}
        last[k] = i
        first.setdefault(k, i)
    got = repeats(np.array([k for _, k in found], np.uint64), np.array([i for i, _ in found], np.int64))
    assert [tuple(e) for e in got.tolist()] == sorted(want)


def test_a_long_text_of_numbers_takes_little_memory():
    """A megabyte of numbers, half of them repeats."""
    rng = np.random.default_rng(4)
    numbers = rng.integers(10**6, 10**8, 60_000)
    text = " ".join(map(str, np.concatenate([numbers, rng.permutation(numbers)]).tolist())) + " +19745553436"
    field = Field(*[rng.normal(size=t.shape) / 4 for t in Field().tables()])
    field.chain, field.skip = (field.chain + field.chain.T) / 2, (field.skip + field.skip.T) / 2
    assert len(text) > 1_000_000
    tracemalloc.start()
    base = Base().spans(text)
    tracemalloc.reset_peak()
    field.added(text, base)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100_000_000


def test_empty(spark, odd_docs):
    assert digest(find_personal_data(odd_docs.limit(0))).count() == 0
