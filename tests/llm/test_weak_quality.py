import numpy as np

from plumbago.llm import queries, weak_quality

SF = "/root/testdata/sf0.01"


def test_accuracy_against_labels_never_seen(spark):
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    got = {r.doc_id: r.kept for r in queries.op9_weak_quality(spark, SF).collect()}
    assert len(got) == 1000
    good, bad = [got[i] for i in truth if truth[i]], [got[i] for i in truth if not truth[i]]
    assert np.mean(good) > 0.98 and np.mean(bad) < 0.05


def test_label_model_estimates_accuracies():
    rng = np.random.default_rng(2)
    truth = rng.random(20000) < 0.8
    n = len(weak_quality.LABELLERS)
    hit = [0.9, 0.6, 0.5, 0.7, 0.8, 0.3, 0.4, 0.6]
    patterns = {}
    for t in truth:
        v = [weak_quality.BAD if not t and rng.random() < h or t and rng.random() < 0.01 else weak_quality.NONE for h in hit]
        v.append(weak_quality.GOOD if t and rng.random() < 0.9 else weak_quality.NONE)
        patterns[tuple(v)] = patterns.get(tuple(v), 0) + 1
    prior, rates, posterior = weak_quality.label_model(patterns)
    assert abs(prior - 0.8) < 0.02
    for j, h in enumerate(hit):
        assert abs(rates[j, 0, weak_quality.BAD] - h) < 0.05
    assert len(rates) == n and all(0 <= p <= 1 for p in posterior.values())


def test_odd_rows(spark):
    prose = "The cat sat on the mat near a door, and it slept. It was a calm day for all of them here."
    docs = [(i, f"{prose} Number {i} said so.") for i in range(60)] + [(i, "*** ### " * 30 + f"x{i}") for i in range(60, 80)]
    docs += [(90, None), (91, ""), (None, prose), (92, prose * 2000)]
    df = spark.createDataFrame([(*d, 1.0) for d in docs], "doc_id long, text string, score double")
    scorer = weak_quality.fit(df)
    got = {r.doc_id: r.kept for r in weak_quality.score(df, scorer).collect()}
    assert got[3] and not got[70] and len(got) == 84 and got[None]
    assert weak_quality.score(df.limit(0), weak_quality.fit(df.limit(0))).count() == 0


def test_scorer_agrees_with_labels_where_labellers_abstain(spark):
    """The scorer sees words and trigrams, so it can judge texts without a vote; labels are only looked at here."""
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    scorer = weak_quality.fit(docs.join(labels.select("doc_id"), "doc_id", "left_anti"))
    rows = docs.join(labels.select("doc_id", "quality"), "doc_id").collect()
    voted = {True: [], False: []}
    for r in rows:
        t = (r.text or "").encode()
        silent = not any(v for v in weak_quality.votes(weak_quality.measure(t)))
        voted[silent].append((scorer.score(t) >= 0.5) == bool(r.quality))
    assert len(voted[True]) >= 20
    assert np.mean(voted[True]) >= 0.8 and np.mean(voted[False]) >= 0.9, (np.mean(voted[True]), len(voted[True]), np.mean(voted[False]))


def test_posterior_follows_bayes():
    """One more step of the plain formulas leaves the fitted model where it is."""
    rng = np.random.default_rng(4)
    good = rng.random(3000) < 0.7
    patterns = {}
    for g in good:
        v = tuple(int(weak_quality.BAD) if rng.random() < (0.02 if g else 0.5) else 0 for _ in range(8)) + (int(weak_quality.GOOD) if g and rng.random() < 0.8 else 0,)
        patterns[v] = patterns.get(v, 0) + 1
    prior, rates, post = weak_quality.label_model(patterns)
    for v, p in post.items():
        a, b = prior, 1 - prior
        for j, x in enumerate(v):
            a *= rates[j, 1, x]
            b *= rates[j, 0, x]
        assert abs(p - a / (a + b)) < 1e-6
    assert abs(prior - good.mean()) < 0.05
