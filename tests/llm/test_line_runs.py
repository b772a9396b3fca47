"""Repeated runs of lines against a brute force that knows nothing of chunks."""

import random

from plumbago.llm import lines, queries
from tests.llm import brute

SF = "/root/testdata/sf0.001"


def runs_removed(docs):
    """doc_id -> text without the runs of two or more lines met before, for unique ids."""
    first, out = {}, {}
    for i, t in sorted(docs, key=lambda d: (d[0] is None, d[0] or 0)):
        cut = [] if t is None else t.split("\n")
        at = [k for k, x in enumerate(cut) if brute.words(x)]
        gone = set()
        for n, (a, b) in enumerate(zip(at, at[1:])):
            doc, before = first.setdefault(tuple(cut[a : b + 1]), (i, n))
            if doc != i or n >= before + 2:
                gone |= set(range(a, b + 1))
        out[i] = None if t is None else "\n".join(x for k, x in enumerate(cut) if k not in gone)
    return out


def test_query_removes_every_repeated_run(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = {r.doc_id: r.kept_sha256 for r in queries.op6_lines(spark, SF).collect()}
    assert got == {i: brute.sha(t) for i, t in runs_removed(docs).items()}


def test_planted_passages_and_odd_rows(spark):
    rng = random.Random(4)
    passages = [[f"line {p} {k}" for k in range(n)] for p, n in enumerate([2, 3, 4, 6] * 6)]
    docs = [(10 * p + c, "\n".join([f"own {p} {c} {k}" for k in range(rng.randrange(5))] + lines_ + [f"end {p} {c}"])) for p, lines_ in enumerate(passages) for c in range(4)]
    docs += [(500, None), (501, ""), (502, "\n\n"), (503, "one line"), (504, "one line"), (None, docs[0][1]), (505, "a\nb\n" * 3000), (506, "c\n" * 7), (507, "x\n\ny\nz"), (508, "x\ny\nz"), (509, "q\n\nx\n\ny\n\n")]
    df = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, body string")
    got = {r.doc_id: r for r in lines.deduplicate_lines(df, keep=["body"], whole=True).collect()}
    assert {i: r.text for i, r in got.items()} == runs_removed(docs)
    for p, lines_ in enumerate(passages):
        assert got[10 * p].n_removed == 0 and all(got[10 * p + c].n_removed == len(lines_) for c in (1, 2, 3))
    assert got[505].text == "a\nb\n" and got[503].n_removed == got[504].n_removed == 0
    assert all(r.body == "x" for r in got.values())
    assert lines.deduplicate_lines(df.limit(0), whole=True).count() == 0
