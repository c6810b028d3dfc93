import random

import pytest

from foliospark.llm import spans
from foliospark.session import cut


def brute(docs, n):
    windows = [(d, {t[i : i + n] for i in range(len(t) - n + 1)}) for d, t in docs if d is not None and t]
    return {(a, b) for a, x in windows for b, y in windows if a < b and x & y}


def covered(docs, n):
    out = {}
    for d, t in docs:
        others = {o[i : i + n] for e, o in docs if e != d and o for i in range(len(o) - n + 1)}
        marks = bytearray(len(t or ""))
        for i in range(len(t or "") - n + 1):
            if t[i : i + n] in others:
                marks[i : i + n] = b"\1" * n
        out[d] = sum(marks)
    return out


def made(seed, docs=40, span=40):
    rng = random.Random(seed)
    text = lambda k: "".join(rng.choices("abcdefghij é😀\n", k=k))
    shared = [text(rng.randint(span - 3, 3 * span)) for _ in range(6)]
    out = []
    for d in range(docs):
        t = text(rng.randint(0, 150))
        for s in rng.sample(shared, rng.randint(0, 2)):
            a = rng.randint(0, 6)
            t += s[a : len(s) - rng.randint(0, 4)] + text(rng.randint(0, 30))
        out.append((d, t))
    return out


def frame(spark, docs):
    return spark.createDataFrame([(d, t, d, "x") for d, t in docs], "doc_id long, text string, doc long, band string")


@pytest.mark.parametrize("seed, crowd", [(1, 48), (2, 48), (3, 1)])
def test_pairs_and_shares_are_those_of_brute_force(spark, seed, crowd):
    docs = made(seed)
    at = spans.surroundings(frame(spark, docs), span=40, gram=10)
    verified = cut(spans.verified_contexts(at, 40, 10, crowd))
    pairs = {tuple(r) for r in spans.shared_pairs(at, verified, 40).collect()}
    assert pairs == brute(docs, 40) and pairs
    shares = {r.doc_id: r.shared_chars for r in spans.shared_share(frame(spark, docs), at, verified, span=40).collect()}
    assert shares == covered(docs, 40)
    parent = {d: d for d, _ in docs}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    linked = {d for p in pairs for d in p}
    assert {r.doc_id: r.component for r in spans.components(at, verified).collect()} == {d: root(d) for d in linked}


def test_edges(spark):
    long = "".join(random.Random(1).choices("abc ", k=300_000))
    docs = [(1, long), (2, "x" + long[1000:1240]), (3, "y" + long[1000:1239]), (4, None), (5, ""), (5, ""), (6, "same " * 100), (7, "same " * 100), (8, "same " * 47)]
    at = spans.surroundings(frame(spark, docs))
    pairs = {tuple(r) for r in spans.shared_pairs(at, spans.verified_contexts(at)).collect()}
    assert pairs == {(1, 2), (6, 7)}
    empty = spans.surroundings(frame(spark, []))
    assert spans.shared_pairs(empty, spans.verified_contexts(empty)).count() == 0
    assert [tuple(r) for r in spans.shared_share(frame(spark, [(4, None)]), empty, spans.verified_contexts(empty)).collect()] == [(4, 0, 0, 0.0)]


def test_a_document_shares_nothing_with_itself(spark):
    text = "".join(random.Random(2).choices("abcdef", k=300))
    at = spans.surroundings(frame(spark, [(1, text + text), (1, text)]))
    assert spans.shared_pairs(at, spans.verified_contexts(at)).count() == 0


@pytest.mark.parametrize("crowd", [1, 4])
def test_links_to_the_least_cover_and_connect_the_same(spark, crowd):
    docs = made(4)
    at = spans.surroundings(frame(spark, docs), span=40, gram=10)
    every, least = (cut(spans.verified_contexts(at, 40, 10, crowd, pairs=p)) for p in (True, False))
    of = lambda v: (sorted(map(tuple, spans.shared_share(frame(spark, docs), at, v, span=40).collect())), sorted(map(tuple, spans.components(at, v).collect())))
    assert of(every) == of(least) and least.count() <= every.count()


def test_a_passage_of_very_many_documents_links_in_linear_rows(spark):
    rng, n = random.Random(9), 300
    text = lambda k: "".join(rng.choices("abcdefghij", k=k))
    passage = text(50)
    docs = [(i, text(60) + passage + text(60)) for i in range(n)]
    at = spans.surroundings(frame(spark, docs), span=40, gram=10)
    links = cut(spans.verified_contexts(at, 40, 10, 8, pairs=False))
    bands = at.select("band").distinct().count()
    assert links.count() <= 31 * n * bands and {r.component for r in spans.components(at, links).collect()} == {0}
    # a context has 31 passages through its place; all pairs would be n * (n - 1) / 2 = 44850
    assert links.groupBy("band").count().agg({"count": "max"}).first()[0] <= 31 * n
