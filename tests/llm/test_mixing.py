import random

import numpy as np
from pyspark.sql import functions as F

from plumbago.llm import mixing, queries
from tests.llm import brute

SF = "/root/testdata/sf0.01"


def targets(sizes):
    """source -> target by resharing until none is above its limit."""
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    limit, out, open_ = {s: 2 * sizes[s] for s in sizes}, {}, set(sizes)
    left = 1.5 * sum(sizes.values())
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] >= limit[s]}
        if not over:
            return out | {s: level * weight[s] for s in open_}
        out |= {s: limit[s] for s in over}
        left -= sum(limit[s] for s in over)
        open_ -= over
    return out


def test_query(spark):
    docs = {r.doc_id: (r.source, len(brute.words(r.text))) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    sizes = {}
    for s, n in docs.values():
        sizes[s] = sizes.get(s, 0) + n
    want, got = targets(sizes), {r.doc_id: r for r in queries.op4_mixing(spark, SF).collect()}
    assert got.keys() == docs.keys()
    took = dict.fromkeys(sizes, 0)
    for i, r in got.items():
        s, n = docs[i]
        assert (r.size, r.source_size) == (n, sizes[s]) and abs(r.target - want[s]) < 1e-6 * want[s]
        assert 0 <= r.taken <= 2 * n
        took[s] += r.taken
    for s in sizes:
        assert abs(took[s] - want[s]) <= 0.01 * want[s] + 5
    again = {r.doc_id: r.taken for r in queries.op4_mixing(spark, SF).collect()}
    assert again == {i: r.taken for i, r in got.items()}


def test_hypergeometric(spark):
    good, bad, drawn, n = 40, 60, 30, 20000
    x = np.array([r[0] for r in spark.range(n).select(mixing.hypergeometric(F.lit(good), F.lit(bad), F.lit(drawn), (F.col("id") + 0.5) / n)).collect()])
    rng = np.random.default_rng(0).hypergeometric(good, bad, drawn, n)
    assert abs(x.mean() - good * drawn / 100) < 0.01 and abs(x.std() - rng.std()) < 0.05
    for k, m, d in ((0, 5, 3), (5, 0, 3), (1, 1, 1), (10**7, 3 * 10**7, 10**6), (3, 4, 7), (3, 4, 0)):
        y = spark.range(9).select(mixing.hypergeometric(F.lit(k), F.lit(m), F.lit(d), (F.col("id") + 0.5) / 9).alias("y")).collect()
        assert all(max(0, d - m) <= r.y <= min(k, d) for r in y) and [r.y for r in y] == sorted(r.y for r in y)


def test_tree_deals_exact_quotas(spark):
    quota = spark.createDataFrame([(0, 1000), (1, 37), (2, 0), (3, 400)], "rank int, quota long")
    for shards in (1, 5, 8):
        rows = mixing.split(quota, shards).collect()
        for rank, n in ((0, 1000), (1, 37), (2, 0), (3, 400)):
            own = sorted((r.start, r.n) for r in rows if r["rank"] == rank)
            assert sum(n for _, n in own) == n and len(own) == shards
            at = 0
            for start, m in own:
                assert m == 0 or start == at
                at += m
        room = [sum(r.n for r in rows if r.shard == k) for k in range(shards)]
        assert max(room) - min(room) <= 3 and sum(room) == 1437


def test_mixed_documents(spark):
    rng = random.Random(1)
    docs = [(i, "w " * rng.randrange(0, 50), rng.choice(["a", "b", None]), 1) for i in range(400)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string, rank int")
    out = mixing.mixed_documents(df, 4)
    rows = out.withColumn("p", F.spark_partition_id()).collect()
    assert out.columns == df.columns
    times = {}
    for r in rows:
        times[r.doc_id] = times.get(r.doc_id, 0) + 1
    want = {r.doc_id: r.taken for r in mixing.taken(*mixing.mix(df, 4)).collect()}
    assert all(times.get(i, 0) * len(brute.words(t)) == want[i] for i, t, _, _ in docs)
    assert max(times.values()) <= 2 and len({r.p for r in rows}) > 1


def test_odd_rows(spark):
    docs = [(1, None, "s"), (2, "", "s"), (3, "a b", None), (None, "c d e", None), (4, "x", "t"), (4, "x", "t"), (5, "big " * 9000, "t")]
    df = spark.createDataFrame([(*d, 7) for d in docs], "doc_id long, text string, source string, size int")
    got = mixing.taken(*mixing.mix(df)).collect()
    assert len(got) == len(docs) and all(r.taken <= 2 * r["size"] for r in got)
    assert sum(r.taken for r in got if r.source == "t") <= 2 * 9002
    assert mixing.taken(*mixing.mix(df.limit(0))).count() == 0


def test_native(spark):
    mixture, rows = mixing.mix(spark.read.parquet(f"{SF}/documents.parquet"))
    plan = mixing.taken(mixture, rows)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_columns_of_any_name_pass_through(spark):
    rows = [(i, f"w{i} " * (1 + i % 5), f"s{i % 2}", i, i, i, i, i, i) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, shard long, place long, m_id long, m_key long, row long, own long")
    got = mixing.mixed_documents(df, 3)
    assert got.columns == df.columns
    out = [tuple(r) for r in got.collect()]
    assert out and set(out) <= set(rows)
