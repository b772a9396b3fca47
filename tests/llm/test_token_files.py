import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from plumbago.llm import common, queries, token_files

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("word_bpe_49k.json")


def expected(docs):
    t, start, out = Tokenizer.from_file(PATH), 0, []
    for i, x in docs:
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 1]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_query_matches_library(spark):
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    assert sorted(map(tuple, queries.op2_token_files(spark, SF).collect())) == expected(docs)


ODD = ["", None, " \t\n", "Hello, World. it's  don't 3.14 a.b", "<|endoftext|> x <|STARTOFTEXT|>", "É e\u0301. É\u0301, ẞ İstanbul K", "***. a**.b x\u0301.", "日本語。 テスト", "a\u00a0b\u3000c\u2028d", "x" * 5000, "ok. " * 20000, "\0 a", "don'T. we'RE,"]


def test_odd_texts_and_files(spark):
    docs = list(enumerate(ODD))
    df = spark.createDataFrame([(i, t, 9) for i, t in docs], "doc_id long, text string, start int")
    files = token_files.write(df, PATH, common.fresh_path(spark, "t"), partitions=3)
    assert sorted(map(tuple, token_files.checksums(spark, files).collect())) == expected(docs)
    back = {r.doc_id: r.ids for r in token_files.read(spark, files).collect()}
    t = Tokenizer.from_file(PATH)
    assert back == {i: [*t.encode(x or "", add_special_tokens=False).ids, 1] for i, x in docs}


def test_seek_reads_one_frame_and_finds_damage(spark, tmp_path):
    w = token_files.FrameWriter(str(tmp_path), "f.zst", 2, 0)
    for i in (None, 3, 3, 8):
        w.add(i, np.arange(i or 1, dtype="<u2").tobytes())
    w.close()
    r = token_files.FrameReader(str(tmp_path / "f.zst"))
    assert r.doc_ids == [None, 3, 3, 8] and r.find(8)[0].tolist() == list(range(8)) and len(r.find(3)) == 2
    import io

    import zstandard

    raw = (tmp_path / "f.zst").read_bytes()
    plain = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(raw), read_across_frames=True).read()
    assert plain == b"".join(np.arange(i, dtype="<u2").tobytes() for i in (1, 3, 3, 8))
    broken = bytearray(raw)
    broken[int(r.starts[3]) + 8] ^= 1
    (tmp_path / "g.zst").write_bytes(bytes(broken))
    with pytest.raises((ValueError, zstandard.ZstdError)):
        token_files.FrameReader(str(tmp_path / "g.zst")).tokens(3)


def test_equal_and_null_ids_and_empty_table(spark):
    df = spark.createDataFrame([(2, "b"), (1, "z"), (1, "a"), (None, "n"), (1, "a")], "doc_id long, text string")
    files = token_files.encode_to_files(df, PATH)
    got = sorted(map(tuple, token_files.checksums(spark, files).collect()), key=lambda r: r[1])
    assert got == expected([(None, "n"), (1, "a"), (1, "a"), (1, "z"), (2, "b")])
    assert token_files.checksums(spark, token_files.encode_to_files(df.limit(0), PATH)).count() == 0


def test_words_are_cut_and_learnt_without_offsets():
    """The library's encode makes offsets that nothing here reads; the ids have to be the same without."""
    words, library = token_files.WordTokenizer(PATH), Tokenizer.from_file(PATH)

    class NoOffsets:
        encode_batch_fast = staticmethod(words.library.encode_batch_fast)

    words.library = NoOffsets()
    for text in [x or "" for x in ODD] + [". a.b,c;;d!? 9:8\u00e9.x\n!a."]:
        low = text.encode().lower()
        assert words.cut(text.encode()) == re.sub(rb"(?<=[A-Za-z0-9])([.,;:!?])", rb" \1", low).split()
    new = [f"{chr(97 + k % 26)}{k * 7919 % 100003:x}qu{chr(98 + k % 23)}ent{k:o}\u00e9".encode() for k in range(1001)]
    words.learn(new)
    assert all(words.ids[w] == words.pack(library.encode(w.decode(), add_special_tokens=False).ids) for w in new)


def test_plain_words_are_learnt_by_the_merges_alone():
    """Normaliser and pattern cost most of a new word; what they do to a plain one is known."""
    words, library = token_files.WordTokenizer(PATH), Tokenizer.from_file(PATH)
    whole, words.library = words.library, None
    letters = "ab\u00e9\u00c8\u00df\u00d1\u0141\u017f\u01c4\u00aa\u00b5"
    new = {f"{a}{m}{b}{k:x}".encode() for k, (a, b) in enumerate((a, b) for a in letters for b in letters) for m in ("", "'s", "'ve", "'l", "&&&", "!?.", "42", "a" * 60)}
    new |= {a.encode() for a in letters} | {b"'", b"''t", b"</w>", b"7", b"###"}
    words.learn(new)
    assert all(words.ids[w] == words.pack(library.encode(w.decode(), add_special_tokens=False).ids) for w in new)
    odd = ["e\u0301", "\u0130x", "\u65e5\u672c", "\u212a", "a\u00a0b", "\u00b2", "\x1c", "=\u0338", "ABC's", "'S"]
    words.library = whole
    words.learn(x.encode() for x in odd)
    assert all(words.ids[x.encode()] == words.pack(library.encode(x, add_special_tokens=False).ids) for x in odd)


def test_texts_are_put_together_over_any_blocks(monkeypatch):
    library, texts = Tokenizer.from_file(PATH), [x or "" for x in ODD] + ["", "one two\vthree", " one", "two. ", "\n"]
    for size in (1, 40, token_files.BLOCK):
        monkeypatch.setattr(token_files, "BLOCK", size)
        words = token_files.WordTokenizer(PATH)
        for _ in range(2):
            assert words.batch(texts) == [words.pack(library.encode(x, add_special_tokens=False).ids) for x in texts]
        assert words.batch([]) == [] and words.batch(["", ""]) == [b"", b""]
