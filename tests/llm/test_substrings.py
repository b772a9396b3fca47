import random

from plumbago.llm import queries, substrings
from tests.llm import brute

SF = "/root/testdata/sf0.001"


def test_query_matches_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in queries.op3_substrings(spark, SF).collect()}
    assert got == brute.removed_words(docs)
    assert any(x[1] for x in got.values())


def test_small_windows_and_odd_rows(spark):
    rng = random.Random(5)
    docs = [(i, " ".join(rng.choice("ab") for _ in range(rng.randrange(0, 30)))) for i in range(40)] + [(90, ""), (91, None), (92, "x " * 5000), (93, "x\n" * 5000)]
    for window in (1, 3, 7, 8):
        df = spark.createDataFrame([(i, t, "z", 7) for i, t in docs], "doc_id long, text string, part string, h long")
        got = {r.doc_id: (r.n_words, r.n_removed, brute.sha(r.kept)) for r in substrings.remove_repeated(df, window).collect()}
        assert got == brute.removed_words(docs, window)


def test_repeated_ids_null_ids_and_empty(spark):
    text = " ".join(f"w{k}" for k in range(20))
    df = spark.createDataFrame([(1, text), (1, text), (1, "other words"), (None, text), (2, "pre " + text)], "doc_id long, text string")
    got = sorted((str(r.doc_id), r.n_removed) for r in substrings.remove_repeated(df, 10).collect())
    assert got == [("1", 0), ("1", 0), ("1", 0), ("2", 20), ("None", 0)]
    assert substrings.remove_repeated(df.limit(0), 10).count() == 0
