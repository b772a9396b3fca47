"""Embeddings, clusters, baselines and approximate search against plain versions."""

import time

import numpy as np
import pytest

from plumbago import queries
from plumbago.errors import Refused
from plumbago.operators import semantic, vectors
from plumbago.plans import event_sql

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def vecs(spark):
    return spark.read.parquet(f"{SF}/embeddings.parquet")


def test_embedding_by_hand():
    def fnv(s, seed=0):
        h = 14695981039346656037 ^ seed
        for b in s.encode():
            h = ((h ^ b) * 1099511628211) & (2**64 - 1)
        return h

    v = [0.0] * 16
    for f, w in (("big", 1), ("big", 1), ("cat", 1), ("big_big", 0.5), ("big_cat", 0.5)):
        v[fnv(f) % 16] += w if fnv(f, 0x9E3779B9) & 1 == 0 else -w
    n = sum(x * x for x in v) ** 0.5
    assert np.allclose(semantic.embed("Big, BIG cat!", 16), [x / n for x in v], atol=1e-6)
    with pytest.raises(Refused, match="NoTokens"):
        semantic.embed(" -- ")


def test_clusters_are_exact_assignments(spark, vecs):
    centres = semantic.k_means(vecs, 6)
    rows = vecs.collect()
    x = np.array([r.embedding for r in rows], float)
    x /= np.sqrt((x**2).sum(1))[:, None]
    near = ((x[:, None] - centres[None]) ** 2).sum(2).argmin(1)
    got = {r.vec_id: r.cluster for r in semantic.assigned(vecs, centres).collect()}
    assert [got[r.vec_id] for r in rows] == near.tolist()
    out = semantic.clusters(vecs, 6, centres=centres).collect()
    assert sum(r["count"] for r in out) == len(rows) and [r["count"] for r in out] == sorted((r["count"] for r in out), reverse=True)
    assert np.allclose(semantic.k_means(vecs.repartition(7), 6), centres)
    assert semantic.clusters(vecs.limit(0), 3).count() == 0


def test_clusters_find_planted_topics_at_rate(spark):
    rng = np.random.default_rng(5)
    centre = rng.normal(size=(8, 16))
    label = rng.integers(0, 8, 20000)
    x = centre[label] + 0.15 * rng.normal(size=(20000, 16))
    df = spark.createDataFrame(list(zip(range(20000), x.tolist(), label.tolist())), "vec_id long, embedding array<double>, label long").repartition(4).cache()
    df.count()
    began = time.time()
    out = semantic.assigned(df, semantic.k_means(df, 8))
    pairs = out.groupBy("cluster").agg({"label": "approx_count_distinct"}).collect()
    took = time.time() - began
    assert len(pairs) == 8 and all(r[1] == 1 for r in pairs)
    assert 20000 / took > 500, took


def test_recall_of_the_index(spark, vecs):
    ix = semantic.index(vecs)
    assert ix.rows.count() == vecs.count()
    ix.rows = ix.rows.cache()
    got = []
    for q in (0, 5, 9, 40, 77):
        v = queries._vector(spark, SF, q)
        got.append(semantic.recall(semantic.search(ix, v, 10, 16, 200), vectors.top_k(vecs, v)).first()[0])
    assert np.mean(got) >= 0.95, got
    short = semantic.search(ix, v, 10, budget=4 * 64 * 3).collect()
    assert len(short) == 3 and all(r.fetch_budget_exhausted for r in short)


def test_baseline_threshold_and_drift(spark, vecs):
    usual = semantic.baseline(vecs, "s")
    own = sorted(r.novelty for r in vectors.novelty(vecs, usual.centres).collect())
    assert abs(usual.threshold - own[round((len(own) - 1) * 0.99)]) < 1e-12
    rows = vecs.selectExpr("*", "if(vec_id % 2 = 0, 'a', 'b') AS generation")
    out = {r.generation: r for r in semantic.drift_check(rows, {"a": semantic.baseline(vecs)}).collect()}
    assert not out["a"].degraded and out["b"].degraded and not out["a"].fired
    with pytest.raises(Refused, match="SpaceMismatch"):
        semantic.against(vecs, usual, ["label"], "other")


def test_quotas_add_up():
    assert semantic.quotas({"a": 100, "b": 1, "c": 50}, 40) == {"a": 25, "b": 1, "c": 14}
    assert semantic.quotas({}, 5) == {} and semantic.quotas({"a": 3}, 10) == {"a": 3}


def test_standing_refusals(spark, vecs):
    state = semantic.StandingTopK(vecs.where("vec_id < 50"), queries._vector(spark, SF, 0), 5)
    with pytest.raises(Refused, match="DuplicateKey"):
        state.apply(vecs.where("vec_id = 3"))
    with pytest.raises(Refused, match="UnknownRetraction"):
        state.apply(removed=vecs.where("vec_id = 60"))
    first = {r.vec_id for r in state.answer.collect()}
    change = state.apply(removed=state.answer.limit(1))
    assert {r["__w"] for r in change.collect()} == {1, -1} and len({r.vec_id for r in state.answer.collect()} & first) == 4
    assert semantic.may_migrate(state.answer, state.answer, 0)
    assert semantic.routed(vecs, 10, 5, lambda: 1, lambda: 2) == 2


def test_rows_only_queries_run(spark):
    for name in set(queries.QUERIES) - set(queries.ORACLE_SQL):
        assert queries.QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0 or name == "semantic_diff", name


ODD = [None, "", " -- ", "_", "Big, BIG cat!", "x_y__z 3a", "É e\u0301 İstanbul ΑΣ'Β ΣΑΣ ẞ K", "日本語 テスト", "a\u00a0b\x00c\x1fd", "x" * 40_000, "né " * 20_000, "ab " * 20_000, "é" * 40_000, "a b " * 3 + "ñ"]


def test_embedding_in_bulk_is_that_of_one_text(spark):
    """Bit for bit, and in time: with_embedding hashed about 0.2 MB of text a second."""
    texts = ODD + [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 60").collect()]
    for dim in (64, 16, 48):
        v, ok = semantic.embed_all([None if t is None else t.encode() for t in texts], dim)
        for t, x, valid in zip(texts, v, ok):
            try:
                want = semantic.embed(t or "", dim)
            except Refused:
                want = None
            assert (x.tolist() if valid else None) == want, t
    df = spark.createDataFrame(list(enumerate(texts)), "k int, body string")
    got = {r.k: r.embedding for r in semantic.with_embedding(df).collect()}
    v, ok = semantic.embed_all([None if t is None else t.encode() for t in texts])
    assert got == {k: v[k].tolist() if ok[k] else None for k in range(len(texts))}
    raw = [t.encode() for t in texts if t] * 10
    began = time.process_time()
    semantic.embed_all(raw)
    assert sum(map(len, raw)) / (time.process_time() - began) > 1.5e6


def test_texts_are_embedded_once(spark):
    """A condition on the score made the plan embed every text twice."""
    seen = spark.sparkContext.accumulator(0)

    def counted(text):
        seen.add(1)
        return semantic.embed(text)

    df = spark.createDataFrame([(k, f"word {k}", k) for k in range(100)], "event_id long, body string, event_time long")
    embedded = lambda rows: semantic.with_embedding(rows, embedder=counted)
    out = event_sql.run(df, "SELECT event_id, score FROM events WHERE event_time >= 60 AND embedding ≈≈ 'word 77' LIMIT 1", embed=semantic.embed, embedded=embedded).collect()
    assert out[0].event_id == 77 and seen.value == 40
    assert vectors.top_k(embedded(df), semantic.embed("word 5"), 1, "event_id").collect()[0].event_id == 5 and seen.value == 140
