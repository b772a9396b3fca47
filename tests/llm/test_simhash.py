import random

import numpy as np

from plumbago.llm import queries, simhash
from plumbago.llm.components import components
from tests.llm import brute

SF = "/root/testdata/sf0.001"


def test_query_matches_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    fp = {i: brute.simhash(t) for i, t in docs}
    want = brute.least_reachable(fp, lambda a, b: (fp[a] ^ fp[b]).bit_count() <= 3)
    got = {r.doc_id: (int(r.fingerprint, 16), r.component_id) for r in queries.op5_simhash(spark, SF).collect()}
    assert got == {i: (fp[i], want[i]) for i in fp}
    assert len(set(want.values())) < len(want)


def test_native_hash_agrees(spark):
    r = spark.sql("select xxhash64('a b c') as h").first().h
    assert simhash.fingerprint(b"A b\tc") == r % 2**64


def test_links_connect_what_is_close(spark):
    rng = random.Random(3)
    centres = [rng.getrandbits(64) for _ in range(6)]
    prints = {c ^ sum({1 << rng.randrange(64) for _ in range(rng.randrange(0, 4))}) for c in centres for _ in range(60)} | {rng.getrandbits(64) for _ in range(200)} | {0, 7, 2**64 - 1}
    signed = np.array(sorted(prints), dtype=np.uint64).view(np.int64).tolist()
    df = spark.createDataFrame([(x,) for x in signed * 2], "fp long")
    pairs = simhash.links(df)
    for r in pairs.collect():
        assert ((r.a ^ r.b) % 2**64).bit_count() <= 3
    got = {r.node: r.component for r in components(pairs).collect()}
    want = brute.least_reachable(signed, lambda a, b: ((a ^ b) % 2**64).bit_count() <= 3)
    assert {x: got.get(x, x) for x in signed} == want


def test_chains_and_hubs(spark):
    links = [(k, k + 1) for k in range(100, 160)] + [(1, k) for k in range(2, 50)] + [(7, 7), (300, None)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {k: 100 for k in range(100, 161)} | {k: 1 for k in range(1, 50)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_odd_rows(spark):
    docs = [(5, None), (3, ""), (4, " \n "), (6, "One"), (7, "one"), (7, "ONE"), (None, "one"), (8, "x y " * 20000)]
    df = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, fp int")
    got = sorted((r.doc_id or 0, r.component_id) for r in simhash.linked_components(df).collect())
    assert got == [(0, None), (3, 3), (4, 3), (5, 3), (6, 6), (7, 6), (7, 6), (8, 8)]
    assert simhash.linked_components(df.limit(0)).count() == 0


def test_crowded_keys_are_dealt(spark, monkeypatch):
    """With few members to a search, the same components come out of smaller keys."""
    rng = random.Random(9)
    centre = rng.getrandbits(64)
    prints = {centre ^ sum({1 << rng.randrange(64) for _ in range(rng.randrange(0, 9))}) for _ in range(400)}
    signed = np.array(sorted(prints), dtype=np.uint64).view(np.int64).tolist()
    monkeypatch.setattr(simhash, "MOST", 5)
    pairs = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"))
    got = {r.node: r.component for r in components(pairs).collect()}
    want = brute.least_reachable(signed, lambda a, b: ((a ^ b) % 2**64).bit_count() <= 3)
    assert {x: got.get(x, x) for x in signed} == want
