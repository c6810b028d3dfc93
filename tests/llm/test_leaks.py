import random

import numpy as np

from foliospark.llm import leaks
from foliospark.llm.kernels import words


def brute(docs, items, n=8):
    cut = lambda t: "".join(c if c.isalnum() else " " for c in t or "").lower().split()
    grams = lambda t: {tuple(w[i : i + n]) for w in [cut(t)] for i in range(len(w) - n + 1)}
    own = [(k, grams(t)) for k, t in items]
    return {(i, d) for d, t in docs for i, g in own if g & grams(t)}


def made(seed, n=60):
    rng = random.Random(seed)
    vocabulary = ["w%d" % i for i in range(40)] + ["Über", "ΣΟΦΟΣ", "è", "7", "a1"]
    text = lambda k: " ".join(rng.choices(vocabulary, k=k))
    items = [(i, text(rng.randint(5, 30))) for i in range(12)]
    docs = []
    for d in range(n):
        t = text(rng.randint(0, 60))
        if d % 3 == 0:
            w = rng.choice(items)[1].split()
            a = rng.randint(0, max(0, len(w) - 6))
            t += " " + rng.choice(["-", ", ", "\n", " "]).join(w[a : a + rng.randint(5, 10)]).upper() + " " + text(5)
        docs.append((d, t))
    return docs, items


def run(spark, docs, items, **more):
    a = spark.createDataFrame([(d, t, "x") for d, t in docs], "doc_id long, text string, item_id string")
    b = spark.createDataFrame([(d, t, "x") for d, t in items], "item_id long, text string, doc_id string")
    return leaks.window_hits(a, b, **more)


def test_pairs_are_those_of_brute_force(spark):
    for seed in (1, 2):
        docs, items = made(seed)
        got = {(r.item_id, r.doc_id) for r in leaks.leaked_pairs(run(spark, docs, items)).collect()}
        assert got == brute(docs, items) and got


def test_many_passes_give_the_same(spark):
    docs, items = made(3)
    once = {tuple(r) for r in leaks.leaked_pairs(run(spark, docs, items)).collect()}
    assert once == {tuple(r) for r in leaks.leaked_pairs(run(spark, docs, items, budget=300)).collect()}


def test_edges(spark):
    passage = "one two three four five six seven eight nine"
    docs = [(1, passage), (1, passage), (2, None), (3, ""), (4, "one two three four five six seven"), (None, passage), (5, "x " * 200_000 + passage), (6, "ONE-two_three.four(five)six;seven!eight")]
    items = [(1, passage), (1, passage), (2, None), (3, ""), (4, "one"), (None, passage)]
    hits = run(spark, docs, items)
    assert {tuple(r) for r in leaks.leaked_pairs(hits).collect()} == {(1, 1), (1, 5), (1, 6)}
    report = {r.doc_id: r for r in leaks.leak_report(hits).collect()}
    assert (report[5].first_word, report[5].last_word, report[5].item_words) == (200_000, 200_008, 9) and report[6].item_words == 8
    assert run(spark, [], items).count() == 0 and run(spark, docs, []).count() == 0


def test_near_windows_are_reported_not_called_verbatim(spark):
    item = " ".join(f"w{i}" for i in range(30))
    near = item.replace("w15", "other")
    hits = run(spark, [(1, near)], [(1, item)], window=24, radius=7, similarity=0.4)
    assert hits.where("NOT exact").count() > 0 and hits.where("exact").count() == 0


def test_blocks_find_all_within_the_radius():
    rng = np.random.default_rng(4)
    items = leaks.Items([(1, " ".join(f"t{i}" for i in range(200)))])
    base = items.codes[rng.integers(0, len(items.codes), 500)]
    flips = np.array([sum(1 << int(b) for b in rng.choice(64, int(k), replace=False)) for k in rng.integers(0, 6, 500)], np.uint64)
    codes = base ^ flips
    here, there = items.near(codes)
    want = {(i, j) for i, c in enumerate(codes) for j, o in enumerate(items.codes) if int(c ^ o).bit_count() <= items.radius}
    assert set(zip(here.tolist(), there.tolist())) == want


def test_word_kernel():
    texts = ["Ab, cd", "", "éÜ1_x", "ΣΑΣ σας"]
    index, starts, ends, hashes = words(texts)
    joined = "\n".join(texts)
    assert [joined[a:b] for a, b in zip(starts, ends)] == ["Ab", "cd", "éÜ1", "x", "ΣΑΣ", "σας"] and index.tolist() == [0, 0, 2, 2, 3, 3]
    assert hashes[4] == hashes[5] and len(set(hashes.tolist())) == 5 and not len(words([])[0]) and not len(words([""])[0])
