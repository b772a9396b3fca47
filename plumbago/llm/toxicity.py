"""Severity of toxic language by cumulative-link ordinal regression.

Model: P(grade <= k | x) = sigmoid(threshold_k - w . x) for ordered grades
0..3; the weights w are shared by all thresholds. x holds hashed features of
the text, 1 where present: its words, and their first four and first five
letters. The expected severity is the sum of P(grade > k) over k; a text is
toxic if P(grade > 0) > 1/2.

Training. A bounded sample of labelled documents (about `sample`, by a hash of
the id) is graded: 0 if the label says clean. Toxic ones are graded by how often
they use telling words, by features that the other half of the sample found
telling, so that no document's own label decides what counts; ranked by it, they
make three equal parts. Telling features are those `ratio` times as often among
toxic as among clean documents with a log-likelihood ratio of at least
`evidence`; all of them get weights, which the fit holds small where few
documents speak for them.

Edge cases: a null or empty text has no features and the severity of one; a
document without an id is scored like any other; ids that are labelled twice
count as toxic if any label does; null labels and labels of unknown ids are
ignored; without labels of both kinds everything is clean (severity 0);
repeated rows of a labelled id each count; toxic documents that use equally
many are ranked by their features; very long texts count whole, a part at a time; an empty table gives an empty table; columns other
than id, text and label are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbago.llm.common import PART, Recent, arrow_rows, id_text, in_parts, only_cache, sampled, written

WORD = re.compile(r"\w+")
DIMENSIONS, GRADES = 1 << 20, 4
SAMPLE, EVIDENCE, RATIO = 8000, 12.0, 10.0
REMEMBERED = 24 << 20


def words(text: str) -> Iterator[list[str]]:
    """The words of a text in lower case, a part of it at a time."""
    if len(text) <= PART:
        yield WORD.findall(text.lower())
    else:
        for part in in_parts(text.encode()):
            yield WORD.findall(part.decode().lower())


def features(word: str) -> set[int]:
    names = [word, *(f"{word[:n]}*" for n in (4, 5) if len(word) >= n)]
    return {xxhash.xxh32_intdigest(x) % DIMENSIONS for x in names}


@dataclass
class Severity:
    """The fitted model: a weight for each telling feature, and ordered thresholds."""

    weights: dict[int, float] = field(default_factory=dict)
    thresholds: list[float] = field(default_factory=list)
    _known: Recent = field(default_factory=lambda: Recent(REMEMBERED), repr=False)

    def telling(self, found: set[str]) -> dict[str, tuple[int, ...]]:
        """The telling features of words, by word."""
        new, known, weights = self._known.missing(found), self._known, self.weights
        for w in new:
            known.add(w, tuple(sorted(x for x in features(w) if x in weights)), 60 + len(w))
        return known

    def present(self, text: str) -> list[int]:
        """Telling features of a text, each once."""
        out: set[int] = set()
        for part in words(text):
            found = set(part)
            known = self.telling(found)
            out.update(*(known[w] for w in found))
        return sorted(out)

    def uses(self, text: str) -> int:
        """How many of a text's words have a telling feature."""
        return sum(1 for part in words(text) for known in (self.telling(set(part)),) for w in part if known[w])

    def above(self, text: str) -> list[float]:
        """P(grade > k) for each k."""
        if not self.thresholds:
            return [0.0] * (GRADES - 1)
        z = sum(self.weights[f] for f in self.present(text))
        return [float(1 / (1 + np.exp(t - z))) for t in self.thresholds]


def _fit(x: list[np.ndarray], y: np.ndarray, n: int, rounds: int = 400, decay: float = 2e-4) -> tuple[np.ndarray, np.ndarray]:
    """Maximum penalised likelihood by Adam; columns of x are feature positions present in each row."""
    rows = np.repeat(np.arange(len(x)), [len(r) for r in x])
    cols = np.concatenate(x).astype(np.int64) if len(rows) else np.zeros(0, np.int64)
    share = np.array([np.mean(y > k) for k in range(GRADES - 1)]).clip(1e-3, 1 - 1e-3)
    start = -np.log(share / (1 - share))
    p = np.concatenate([np.zeros(n), [start[0]], np.log(np.maximum(np.diff(start), 1e-2))])
    m, v = np.zeros_like(p), np.zeros_like(p)
    for step in range(1, rounds + 1):
        t = np.cumsum(np.concatenate([p[n : n + 1], np.exp(p[n + 1 :])]))
        z = np.bincount(rows, p[cols], minlength=len(x))
        edges = np.concatenate([[-np.inf], t, [np.inf]])
        hi, lo = (1 / (1 + np.exp(-np.clip(edges[y + k] - z, -40, 40))) for k in (1, 0))
        hi, lo = np.where(y == GRADES - 1, 1, hi), np.where(y == 0, 0, lo)
        chance = np.maximum(hi - lo, 1e-12)
        d_hi, d_lo = hi * (1 - hi) / chance, lo * (1 - lo) / chance
        g_z = (d_hi - d_lo) / len(y)
        g_t = np.array([-d_hi[y == k].sum() + d_lo[y == k + 1].sum() for k in range(GRADES - 1)]) / len(y)
        back = np.cumsum(g_t[::-1])[::-1]  # each step of the thresholds moves all above it
        g = np.concatenate([np.bincount(cols, g_z[rows], minlength=n)[:n] + decay * p[:n], [back[0]], back[1:] * np.exp(p[n + 1 :])])
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        p = p - 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return p[:n], np.cumsum(np.concatenate([p[n : n + 1], np.exp(p[n + 1 :])]))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, evidence: float = EVIDENCE, ratio: float = RATIO, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Severity:
    """Fit on about `sample` labelled documents. The driver receives the telling features, at most DIMENSIONS, and those of each sampled document."""
    spark = docs.sparkSession
    arrow_rows(spark)
    marked = labels.select(F.col(id_col).cast("long").alias("i"), F.col(label_col).cast("int").alias("y")).dropna().groupBy("i").agg(F.max("y").alias("y"))
    chosen = marked.where(sampled(F.xxhash64("i"), marked.count(), sample))
    half = F.pmod(F.xxhash64(F.lit(1), "i"), F.lit(2)).cast("int")
    rows = written(id_text(docs, id_col, text_col).join(F.broadcast(chosen), F.col("doc_id") == F.col("i")).select(F.when(F.col("y") > 0, 1).otherwise(0).alias("y"), half.alias("half"), "text"), "labelled")

    def all_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only_cache()
        for b in batches:
            for label, h, text in zip(*(c.to_pylist() for c in b.columns)):
                found = np.fromiter(set().union(*(features(w) for part in words(text) for w in set(part))), np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), x, np.int32)) for x in (label, h)] + [pa.array(found)], names=["y", "half", "f"])

    sizes = {(r.y, r.half): r.n for r in rows.groupBy("y", "half").agg(F.count("*").alias("n")).collect()}
    toxic, clean = (sum(n for (y, _), n in sizes.items() if y == label) for label in (1, 0))
    if not toxic or not clean:
        return Severity()
    each = [F.sum(((F.col("y") == y) & (F.col("half") == h)).cast("long")).alias(f"n{y}{h}") for y in (0, 1) for h in (0, 1)]
    counts = rows.mapInArrow(all_features, "y int, half int, f int").groupBy("f").agg(*each)

    def is_telling(halves: tuple[int, ...]) -> F.Column:
        """By the counts of these halves of the sample."""
        of = [sum(sizes.get((y, h), 0) for h in halves) for y in (0, 1)]
        n = [sum((F.col(f"n{y}{h}") for h in halves), F.lit(0)) for y in (0, 1)]
        if not all(of):
            return F.lit(False)
        share = (n[0] + n[1]) / sum(of)
        g = 2 * sum((F.when(n[y] > 0, n[y] * F.log(n[y] / (share * of[y]))).otherwise(0.0) for y in (0, 1)), F.lit(0.0))
        return ((n[1] + 0.5) / (of[1] + 1) >= ratio * (n[0] + 0.5) / (of[0] + 1)) & (g >= evidence)

    kinds = [is_telling((0, 1)), is_telling((0,)), is_telling((1,))]
    found = counts.select("f", *[k.alias(f"t{i}") for i, k in enumerate(kinds)]).where("t0 or t1 or t2").orderBy("f").collect()
    telling = [r.f for r in found if r.t0]
    if not telling:
        return Severity()
    probe, halves = Severity(dict.fromkeys(telling, 1.0)), [Severity(dict.fromkeys([r.f for r in found if r[t]], 1.0)) for t in ("t1", "t2")]

    def selected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only_cache()
        for b in batches:
            y, h, texts = (c.to_pylist() for c in b.columns)
            uses = [halves[1 - k].uses(t) if label else 0 for label, k, t in zip(y, h, texts)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(uses, pa.int64()), pa.array([probe.present(t) for t in texts], pa.list_(pa.int32()))], names=["y", "uses", "fs"])

    got = rows.mapInArrow(selected, "y int, uses long, fs array<int>").collect()
    got.sort(key=lambda r: (r.y, r.uses, r.fs))
    position = {f: k for k, f in enumerate(telling)}
    grades = np.array([0 if not r.y else 1 + (GRADES - 1) * (k - (len(got) - toxic)) // toxic for k, r in enumerate(got)])
    w, t = _fit([np.array([position[f] for f in r.fs]) for r in got], grades, len(telling))
    return Severity({f: float(w[k]) for f, k in position.items()}, [float(x) for x in t])


def score(docs: DataFrame, model: Severity, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, severity (expected grade, 0 to 3), grade (the most telling cut: thresholds passed with P > 1/2) and toxic."""
    arrow_rows(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            above = [model.above(t) for t in b.column(1).to_pylist()]
            grade = [sum(p > 0.5 for p in x) for x in above]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([sum(x) for x in above], pa.float64()), pa.array(grade, pa.int32()), pa.array([g > 0 for g in grade], pa.bool_())], names=["doc_id", "severity", "grade", "toxic"])

    return id_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, severity double, grade int, toxic boolean")


def without_toxic(docs: DataFrame, model: Severity, text_col: str = "text") -> DataFrame:
    """The rows of docs that the model doesn't call toxic, columns as they are."""
    arrow_rows(docs.sparkSession)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array([model.above(t or "")[0] <= 0.5 for t in b.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
