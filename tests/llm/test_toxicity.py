import numpy as np

from plumbago.llm import queries, toxicity

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    train, test = labels.where("doc_id % 4 <> 0"), labels.where("doc_id % 4 = 0").withColumnRenamed("toxic", "truth")
    model = toxicity.fit(docs, train)
    got = toxicity.score(docs, model).join(test, "doc_id").collect()
    assert sum(r.toxic and not r.truth for r in got) == 0
    # Toxic words of the rarer languages can't be learned from the few rows of this table.
    hit = [r.toxic for r in got if r.truth and r.severity > 0.3] + [True]
    assert np.mean(hit) > 0.8
    assert all(0 <= r.severity <= 3 and r.toxic == (r.grade > 0) for r in got)


def test_query_scores_every_document(spark):
    rows = queries.op7_toxicity(spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == len({r.doc_id for r in rows}) == spark.read.parquet("/root/testdata/sf0.001/documents.parquet").count()


def test_fit_recovers_ordered_thresholds():
    rng = np.random.default_rng(1)
    x = [np.flatnonzero(rng.random(6) < 0.4) for _ in range(4000)]
    w = np.array([2.0, 1.5, 1.0, 0.5, 0.0, 3.0])
    z = np.array([w[r].sum() for r in x]) + rng.logistic(size=4000)
    y = (z[:, None] > np.array([1.0, 3.0, 5.0])).sum(1)
    got, t = toxicity._fit(x, y, 6, decay=0.0)
    assert np.abs(got - w).max() < 0.3 and np.abs(t - [1, 3, 5]).max() < 0.3


def test_odd_rows(spark):
    bad, good = "you rotten gork rotten", "a mild day in may"
    texts = [(i, bad if i % 2 else f"{good} {i}") for i in range(80)] + [(100, None), (101, ""), (None, bad), (102, "ok " * 30000)]
    docs = spark.createDataFrame([(*x, 4) for x in texts], "doc_id long, text string, grade int")
    labels = spark.createDataFrame([(i, i % 2) for i in range(80)] + [(1, None), (None, 1), (999, 1)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    got = {r.doc_id: r.toxic for r in toxicity.score(docs, model).collect()}
    assert got[1] and not got[2] and not got[100] and not got[101] and got[None]
    kept = toxicity.without_toxic(docs, model)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} >= {0, 2, 100, 101}
    assert toxicity.score(docs.limit(0), model).count() == 0
    none = toxicity.fit(docs, labels.limit(0))
    assert {r.severity for r in toxicity.score(docs, none).collect()} == {0.0}
