import numpy as np
from pyspark.sql import functions as F

from plumbago.llm import one_permutation, queries
from tests.llm import brute

SF = "/root/testdata/sf0.001"


def shingles(text):
    w = brute.words(text)
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}


def jaccard(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b)


def edited(docs):
    """id -> (text, edited text, next text), for unique ids."""
    docs = sorted(docs, key=lambda d: (d[0] is not None, d[0]))
    out = {}
    for k, (i, t) in enumerate(docs):
        t, after = t or "", docs[(k + 1) % len(docs)][1] or ""
        m = len(t) // 4
        out[i] = (t, t[: len(t) - m] + after[:m], after)
    return out


def test_query(spark):
    want = edited([(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()])
    rows = queries.op8_fingerprints(spark, SF).collect()
    assert len(rows) == len(want)
    errors = []
    for r in rows:
        t, e, after = want[r.doc_id]
        assert (r.n_chars, r.edited_sha256) == (len(t), brute.sha(e)) and len(r.fingerprint) == one_permutation.BINS
        errors += [r.near_edited - jaccard(t, e), r.near_next - jaccard(t, after)]
    assert abs(np.mean(errors)) < 0.02 and np.sqrt(np.mean(np.square(errors))) < 0.05
    same = {}
    for r in rows:
        assert same.setdefault(want[r.doc_id][0], r.fingerprint) == r.fingerprint


def test_short_texts_and_ranges(spark):
    docs = [(None, "n one two"), (5, None), (6, ""), (7, " \n"), (8, "a b c"), (9, "a b c d e"), (10, "é\U0001f44d" * 7), (11, "word " * 30000), (-3, "x y z w v u t s r q p o")]
    df = spark.createDataFrame([(*d, "k") for d in docs], "doc_id long, text string, bucket string")
    want = edited(docs)
    for buckets in (1, 2, 50):
        rows = one_permutation.followed(df.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), ["text"], buckets).collect()
        assert {r.doc_id: r.next_text for r in rows} == {i: a for i, (_, _, a) in want.items()}
    got = {r.doc_id: r for r in one_permutation.edited(df).collect()}
    assert {i: r.edited for i, r in got.items()} == {i: e for i, (_, e, _) in want.items()}
    assert got[5].packed == got[6].packed == got[7].packed != got[8].packed
    assert one_permutation.edited(df.limit(0)).count() == 0
    alone = one_permutation.edited(df.where("doc_id = 9")).first()
    assert alone.edited == "a b c da " and alone.next_packed == alone.packed


def test_repeated_ids(spark):
    df = spark.createDataFrame([(1, "b" * 8), (1, "a" * 8), (1, "a" * 8), (2, "c" * 8)], "doc_id long, text string")
    got = sorted((r.doc_id, r.edited) for r in one_permutation.edited(df).collect())
    assert got == [(1, "aaaaaaaa"), (1, "aaaaaabb"), (1, "bbbbbbcc"), (2, "ccccccaa")]


def test_native(spark):
    plan = one_permutation.edited(spark.read.parquet(f"{SF}/documents.parquet"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_fingerprint_matches_plain_version(spark):
    """Bins, densification and packing, from Spark's hash of words and windows alone."""
    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 10**6, n)) for n in (0, 1, 4, 5, 6, 9, 40, 300, 3000)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    w = F.split("text", " ")
    windows = F.transform(F.sequence(F.lit(0), F.size(w) - 5), lambda i: F.xxhash64(*[F.xxhash64(F.get(w, i + k)) for k in range(5)]))
    plain = F.when(F.col("text") == "", F.array(F.xxhash64(F.array().cast("array<bigint>")))).when(F.size(w) < 5, F.array(F.xxhash64(F.transform(w, lambda x: F.xxhash64(x))))).otherwise(windows)
    rows = df.select("doc_id", plain.alias("h"), one_permutation.text_of(one_permutation.fingerprint(F.col("text"))).alias("f")).collect()
    table = {(r.b, r.q): r.h for r in spark.range(256).crossJoin(spark.range(256).withColumnRenamed("id", "q")).select(F.col("id").cast("int").alias("b"), F.col("q").cast("int"), F.xxhash64(F.col("id").cast("int"), F.col("q").cast("int")).alias("h")).collect()}
    for r in rows:
        want = brute.one_permutation(r.h, pair_hash=lambda b, q: table[b, q])
        assert r.f == "".join(f"{x:x}" for x in want), r.doc_id
