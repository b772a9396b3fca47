import random

import xxhash

from plumbago.llm import lines
from tests.llm import brute

SF = "/root/testdata/sf0.001"


def test_chunks_match_brute_force(spark):
    """Chunks alone; the query also removes the runs between them, see test_line_runs."""
    df = spark.read.parquet(f"{SF}/documents.parquet")
    want = brute.line_chunks_removed([(r.doc_id, r.text) for r in df.collect()], lines.chunks)
    assert {r.doc_id: r.text for r in lines.deduplicate_lines(df).collect()} == want


def test_boundaries_by_rule():
    """A boundary follows a line where the hash rolled over it and the line before has its bit clear, from the second line on."""
    rng = random.Random(1)
    text = [rng.choice([b"", b" "]) if rng.random() < 0.1 else f"line {rng.randrange(99)}".encode() for _ in range(400)]
    at = [k for k, x in enumerate(text) if x.strip()]
    cuts, counted = [], 0
    for n, k in enumerate(at):
        counted += 1
        hashes = [xxhash.xxh3_64_intdigest(text[j]) for j in at[max(0, n - 1) : n + 1]]
        rolled = (hashes[0] * 0x9E3779B97F4A7C15 + hashes[1]) % 2**64 if n else hashes[0]
        if counted >= 2 and (rolled >> 32) % 2 == 0 or counted == lines.LONGEST:
            cuts.append(k + 1)
            counted = 0
    edges = [0, *cuts] + ([len(text)] if not cuts or cuts[-1] < len(text) else [])
    assert lines.chunks(text) == list(zip(edges, edges[1:]))


def test_shared_passages_and_odd_rows(spark):
    rng = random.Random(8)
    passages = [[f"line {p} {k}" for k in range(rng.randrange(4, 12))] for p in range(5)]
    docs = [(i, "\n".join([f"own {i} {k}" for k in range(rng.randrange(3))] + rng.choice(passages) + [""] + [f"end {i}"])) for i in range(40)]
    docs += [(50, None), (51, ""), (52, "\n\n"), (53, "one line"), (54, "one line"), (None, docs[0][1]), (55, "a\nb\n" * 3000)]
    df = spark.createDataFrame([(i, t, "x", 3) for i, t in docs], "doc_id long, text string, body string, h1 int")
    got = {r.doc_id: r for r in lines.deduplicate_lines(df, keep=["body", "h1"]).collect()}
    want = brute.line_chunks_removed(docs, lines.chunks)
    assert {i: r.text for i, r in got.items()} == want
    assert all((r.body, r.h1) == ("x", 3) for r in got.values())
    assert sum(r.n_removed for r in got.values()) > 40 and got[53].n_removed == got[54].n_removed == 0
    assert lines.deduplicate_lines(df.limit(0)).count() == 0


def test_boundaries_shift_with_insertions():
    base = [f"l{k}".encode() for k in range(200)]
    cut = {tuple(base[a:b]) for a, b in lines.chunks(base)}
    moved = [b"new", b"newer", *base[:90], b"mid", *base[90:]]
    kept = {tuple(moved[a:b]) for a, b in lines.chunks(moved)}
    assert len(cut & kept) > 0.85 * len(cut)
