"""Near-duplicates at the threshold itself, against exact shingle sets."""

import random

import numpy as np

from plumbago.llm import simhash
from tests.llm import brute
from tests.llm.test_one_permutation import jaccard


def test_pairs_about_the_threshold(spark):
    """Pairs at 0.78 to 0.82 are linked if, and only if, they reach 0.8."""
    rng = random.Random(6)
    docs, pairs = [], []
    for k in range(400):
        n = rng.choice([60, 100, 200, 400])
        w = [f"{rng.randrange(10**6)}" for _ in range(n)]
        # Cutting m words off the end leaves a share of 1 - m / (n - 4) of the shingles.
        m = round((1 - rng.choice([0.78, 0.79, 0.8, 0.805, 0.82])) * (n - 4))
        docs += [(2 * k, " ".join(w)), (2 * k + 1, " ".join(w[: n - m]))]
        pairs.append(jaccard(docs[-1][1], docs[-2][1]) >= 0.8)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(df).collect()}
    linked = [got[2 * k + 1] == 2 * k for k in range(400)]
    assert not any(x and not y for x, y in zip(linked, pairs))
    assert sum(linked) >= 0.99 * sum(pairs) and 100 < sum(pairs) < 300


def test_alike_matches_brute_force():
    rng = np.random.default_rng(5)
    for _ in range(30):
        base = [rng.integers(0, 60, rng.integers(1, 40)) for _ in range(4)]
        sets = {np.unique(np.where(rng.random(len(b)) < 0.07, rng.integers(0, 60, len(b)), b)).astype(np.uint64).tobytes() for b in base for _ in range(12)} | {b""}
        sets = [np.frombuffer(x, np.uint64) for x in sorted(sets)]

        def close(a, b):
            x, y = set(sets[a].tolist()), set(sets[b].tolist())
            return 5 * len(x & y) >= 4 * len(x | y)

        links = simhash.alike(list(range(len(sets))), sets, 0.8)
        assert all(close(a, b) for a, b in links)
        want = brute.least_reachable(range(len(sets)), close)
        assert brute.least_reachable(range(len(sets)), lambda a, b: (a, b) in links or (b, a) in links) == want


def test_large_groups_in_blocks(spark, monkeypatch):
    """Blocks far smaller than a group find the same components."""
    rng = random.Random(11)
    docs = []
    for k in range(3):
        w = [f"{rng.randrange(10**6)}" for _ in range(120)]
        for _ in range(30):
            v = list(w)
            for _ in range(rng.randrange(4)):
                v[rng.randrange(120)] = f"x{rng.randrange(10**6)}"
            docs.append((len(docs), " ".join(v)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = {r.doc_id: r.component_id for r in simhash.near_duplicates(df).collect()}
    monkeypatch.setattr(simhash, "BLOCK", 400)
    monkeypatch.setattr(simhash, "MOST", 6)
    assert {r.doc_id: r.component_id for r in simhash.near_duplicates(df).collect()} == want
    exact = brute.least_reachable(range(len(docs)), lambda a, b: jaccard(docs[a][1], docs[b][1]) >= 0.8)
    assert want == exact


def test_columns_of_any_name_pass_through(spark):
    df = spark.createDataFrame([(1, "a b c d e f", 1, 2, 3), (2, "a b c d e f", 4, 5, 6), (None, None, 0, 0, 0)], "doc_id long, text string, gone_id long, gone int, name int")
    got = simhash.first_of_each(df)
    assert got.columns == df.columns
    assert sorted(map(tuple, got.collect()), key=str) == [(1, "a b c d e f", 1, 2, 3), (None, None, 0, 0, 0)]


def test_a_group_is_not_fetched_again_for_every_key(spark, monkeypatch):
    """Near copies that the first tables have linked do not go on under the keys of the others."""
    rng = random.Random(3)
    w = [f"{rng.randrange(10**6)}" for _ in range(150)]
    docs = []
    for k in range(300):
        v = list(w)
        for _ in range(rng.randrange(3)):
            v[rng.randrange(150)] = f"x{rng.randrange(10**6)}"
        docs.append((k, " ".join(v)))
    rows, real = [], simhash.written

    def counted(df, what):
        out = real(df, what)
        if "close" in what:
            rows.append(out.count())
        return out

    monkeypatch.setattr(simhash, "written", counted)
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == brute.least_reachable(range(len(docs)), lambda a, b: jaccard(docs[a][1], docs[b][1]) >= 0.8)
    print("rows fetched", rows)
    assert sum(rows) < 20 * len(docs)
