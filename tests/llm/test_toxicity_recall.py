"""Recall of held-out toxic documents by language, none left out of the count."""

import pytest

from plumbago.llm import toxicity

SF = "/root/testdata/sf0.1"


def recall(spark, keep):
    """lang -> (found, all) toxic documents among the labels that keep, a condition, leaves out; and clean ones called toxic."""
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels.where(keep))
    held = labels.where(f"not ({keep})").select("doc_id", labels.toxic.alias("truth"))
    got = toxicity.score(docs.join(held.select("doc_id"), "doc_id", "left_semi"), model).join(held, "doc_id").join(docs.select("doc_id", "lang"), "doc_id").collect()
    out = {}
    for r in got:
        if r.truth:
            found, n = out.get(r.lang, (0, 0))
            out[r.lang] = found + r.toxic, n + 1
    return out, sum(r.toxic and not r.truth for r in got)


@pytest.fixture(scope="module")
def held_out(spark):
    return recall(spark, "doc_id % 5 <> 0")


def test_held_out_recall(held_out):
    found, wrong = held_out
    assert wrong == 0 and set(found) == {"de", "en", "es", "fr"}
    assert found["en"][0] >= 0.95 * found["en"][1]
    assert sum(n for n, _ in found.values()) >= 0.8 * sum(of for _, of in found.values())


@pytest.mark.xfail(reason="3167 labels hold too few toxic documents of the rarer languages for the evidence limit", strict=True)
def test_held_out_recall_of_every_language(held_out):
    for lang, (n, of) in held_out[0].items():
        assert n >= 0.8 * of, (lang, n, of)
