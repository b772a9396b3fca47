import public_tokenizers
import sentencepiece

from plumbago.llm import pieces, queries
from tests.llm import brute

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("piece_bpe_32k.model")
ODD = [None, "", " ", "  a  b ", "\n", "a\n\nb\n", "▁x y▁▁z", "日本語 テスト", "👍🏽 ok 𝔘𝔫", "x" * 3000, "\0 a", "\t\ttab", "<s> </s> <unk> <0x41>", "a.b,c...!?", "ﬁ é é", "\r\n x　y  z", "word. " * 20000]


def expected(texts):
    sp = sentencepiece.SentencePieceProcessor(model_file=PATH)
    out = {}
    for i, t in texts:
        ids = sp.encode(t or "", add_eos=True)
        out[i] = (len(ids), brute.sha(" ".join(map(str, ids))), brute.sha(sp.decode(ids)))
    return out


def test_query_matches_library(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert {r.doc_id: tuple(r)[1:] for r in queries.op10_sentencepiece(spark, SF).collect()} == expected(docs)


def test_odd_texts(spark):
    docs = list(enumerate(ODD)) + [(None, "no id")]
    df = spark.createDataFrame([(i, t, [1]) for i, t in docs], "doc_id long, text string, ids array<int>")
    got = pieces.digests(pieces.encode_decode(df, PATH)).collect()
    assert {r.doc_id: tuple(r)[1:] for r in got} == expected(docs)
    assert pieces.encode_decode(df.limit(0), PATH).count() == 0


def test_agenda_without_cuts():
    p = pieces.load(PATH)
    text = "▁the▁quick,▁brown▁fox's▁den"
    assert p.merge(text) == p.library.encode(text[1:].replace("▁", " "))


def test_merging_side_by_side_equals_one_by_one():
    import random

    p, rng = pieces.load(PATH), random.Random(2)
    some = [x for x in p.id_of if len(x) < 8]
    texts = ["", "a", "日", "\U0010ffff", "aaaa", "x" * 100, "▁▁▁", *("".join(rng.choices(some, k=rng.randrange(1, 9))) for _ in range(9000))]
    assert p.merge_many(texts) == [p.merge(x) for x in texts]
