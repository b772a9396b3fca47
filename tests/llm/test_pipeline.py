import public_tokenizers
import sentencepiece

import corpus_pipeline
from plumbago.llm import mixing, simhash
from tests.llm import brute
from tests.llm.test_line_runs import runs_removed
from tests.llm.test_one_permutation import jaccard

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_in_turn(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    at = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        assert k == 4 or out.columns == COLUMNS
        at[name] = docs.collect(), out.collect()
        docs = out

    before, after = at["toxicity"]
    assert {r.doc_id for r in after} <= {r.doc_id for r in before}
    clean = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("toxic = 0").collect()}
    assert len(clean & {r.doc_id for r in after}) >= 0.98 * len(clean)

    before, after = at["line_dedup"]
    assert {r.doc_id: r.text for r in after} == runs_removed([(r.doc_id, r.text) for r in before])
    assert all(r.n_chars == len(r.text) for r in after)

    before, after = at["near_dedup"]
    left, texts = {r.doc_id for r in after}, {r.doc_id: r.text for r in before}
    first = {}
    for i in sorted(texts):
        first.setdefault(texts[i], i)
    assert left <= set(first.values())
    for i in sorted(set(texts) - left):
        assert any(j < i and jaccard(texts[i], texts[j]) > 0.6 for j in texts)
    for i in left:
        assert not any(j < i and jaccard(texts[i], texts[j]) > 0.93 for j in left)

    before, after = at["mixing"]
    often = {}
    for r in after:
        often[r.doc_id] = often.get(r.doc_id, 0) + 1
    want = mixing.taken(*mixing.mix(spark.createDataFrame(before))).collect()
    assert all(often.get(r.doc_id, 0) * r["size"] == r.taken for r in want)

    before, after = at["sentencepiece"]
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    expect = []
    for r in before:
        ids = sp.encode(r.text, add_eos=True)
        expect.append((r.doc_id, len(ids), brute.sha(" ".join(map(str, ids))), brute.sha(sp.decode(ids))))
    assert sorted(map(tuple, after)) == sorted(expect)


def test_run_agrees_with_itself(spark):
    a, b = (sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) for _ in range(2))
    assert a == b and a


def test_near_duplicates_find_edits_and_leave_others(spark):
    import random

    rng = random.Random(2)
    base = [[f"w{rng.randrange(400)}" for _ in range(300)] for _ in range(8)]
    docs = []
    for k, w in enumerate(base):
        docs.append((10 * k, " ".join(w)))
        for e in range(1, 5):
            v = list(w)
            v[rng.randrange(300)] = "edited"
            docs.append((10 * k + e, " ".join(v)))
    docs += [(900, None), (901, ""), (902, "short one"), (903, "Short one"), (904, "other"), (None, "other")]
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, w0 int")
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(df).collect()}
    assert all(got[i] == i // 10 * 10 for i, _ in docs if i is not None and i < 100)
    assert (got[901], got[903], got[904]) == (900, 902, 904)
    kept = simhash.first_of_each(df)
    assert kept.columns == df.columns and kept.count() == 8 + 4
    assert simhash.near_duplicates(df.limit(0)).count() == 0
