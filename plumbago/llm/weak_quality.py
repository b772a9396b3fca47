"""Quality scores from a weak-label model and a hashed linear scorer.

Labellers. Eight heuristics look at a whole text and vote bad or nothing, and
overlap: marks that are no prose, few letters, capitals, exclamations, long
words, repeated word pairs, the same word twice in a row, repeated lines. A
ninth votes good for what looks like sentences.

Label model. The votes of all documents are counted by pattern (at most 3^9);
expectation-maximisation on the counts estimates the share of good documents
and, for each labeller and class, how often it votes what: its accuracy, with
no labelled data. Each pattern then has a posterior probability of good.

Scorer. Logistic regression with the posteriors as soft labels, on features of
the text that no labeller looks at, hashed into DIMENSIONS slots: its different
words, and the frequencies of its byte trigrams. It is fitted on a bounded sample
of different texts (`sample`, in expectation, by a hash of the text; each weighs
as often as it occurs) and scores every document; kept means 1/2 or more. So it
judges texts on which every labeller abstains by what they share with others.

Edge cases: a null or empty text has no votes and no features but the bias; a
table of which every text has the same votes is scored by the prior alone;
repeated rows count as often as they occur; null ids are scored; equal texts
have equal scores; an empty table gives an empty table; columns other than id
and text are ignored; very long texts count whole, a part at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbago.llm.common import Recent, arrow_rows, id_text, in_parts, only_cache, sampled

LABELLERS = ("marks", "letters", "capitals", "shouts", "length", "pairs", "stutter", "lines", "prose")
DIMENSIONS, SAMPLE, SCALE = 1 << 15, 4000, 40.0
REMEMBERED = 24 << 20
GOOD, BAD, NONE = 1, 2, 0
#: Byte classes; any further byte below 128 is class 11, of 128 and above 12 (first of a character) or 13.
CLASSES = (b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" ", b"\n", b".", b",", b"!?", b"*#$%&", b"|<>", b"\"'()[]-:;")
_CLASS = np.full(256, 11, np.int16)
for _k, _c in enumerate(CLASSES):
    _CLASS[list(_c)] = _k
_CLASS[128:192], _CLASS[192:] = 13, 12


_ODD = np.int64(0x2545F4914F6CDD1D)
_slots = Recent(REMEMBERED)


def measure(text: bytes) -> dict[str, float]:
    """What the labellers look at."""
    raw = np.frombuffer(text, np.uint8)
    count, lengths = np.zeros(14, np.int64), []
    for k in range(0, len(raw), 1 << 20):
        count += np.bincount(_CLASS[raw[k : k + (1 << 20)]], minlength=14)
    for part in in_parts(text):
        words = part.split()
        lengths.append(np.fromiter(map(hash, words), np.int64, len(words)))
    h = np.concatenate([np.zeros(0, np.int64), *lengths])
    n = len(h)
    lines = [x for x in text.split(b"\n") if x.strip()]
    steps = max(1, n - 1)
    return {
        "n": n,
        "marks": (count[8] + count[9]) / max(1, n),
        "letters": int(count[0] + count[1] + count[12]) / max(1, len(raw) - int(count[13] + count[3] + count[4])),
        "shouts": count[7] / max(1, n),
        "capitals": count[1] / max(1, count[0] + count[1]),
        "pairs": len(np.unique(h[:-1] * _ODD + h[1:])) / steps if n > 1 else 1.0,
        "sentences": count[5] / max(1, n),
        "length": (len(raw) - int(count[13]) - int(count[3]) - int(count[4])) / max(1, n),
        "stutter": int((h[:-1] == h[1:]).sum()) / steps,
        "lines": 1 - len(set(lines)) / max(1, len(lines)),
    }


def votes(m: dict[str, float]) -> tuple[int, ...]:
    """One vote for each of LABELLERS."""
    n = m["n"]
    bad = (
        n >= 5 and m["marks"] > 0.1,
        n >= 15 and m["letters"] < 0.9,
        n >= 15 and m["capitals"] > 0.4,
        n >= 15 and m["shouts"] > 0.4,
        n >= 15 and m["length"] > 7.5,
        n >= 20 and m["pairs"] < 0.6,
        n >= 20 and m["stutter"] > 0.1,
        n >= 20 and m["lines"] > 0.5,
    )
    prose = n > 0 and not any(bad) and 3.5 < m["length"] < 6.5 and m["sentences"] < 0.4
    return (*(BAD if x else NONE for x in bad), GOOD if prose else NONE)


def trigrams(text: bytes) -> np.ndarray:
    """The slot of each byte trigram."""
    r = np.frombuffer(text, np.uint8).astype(np.uint32)
    if len(r) < 3:
        return np.zeros(0, np.int64)
    code = (r[:-2] << np.uint32(16) | r[1:-1] << np.uint32(8) | r[2:]) * np.uint32(0x9E3779B1)
    return (code >> np.uint32(17)).astype(np.int64) % DIMENSIONS


def word_slots(text: bytes) -> np.ndarray:
    """The slots of a text's different words."""
    out: set[int] = set()
    for part in in_parts(text):
        found = set(part.split())
        for w in _slots.missing(found):
            _slots.add(w, (xxhash.xxh32_intdigest(w, 7) % DIMENSIONS,), 32 + len(w))
        out.update(_slots[w][0] for w in found)
    return np.fromiter(out, np.int64, len(out))


def features(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(slots, values) of a text: shares of its trigrams and of its words, which add up to SCALE each."""
    t, w = np.bincount(trigrams(text), minlength=DIMENSIONS), word_slots(text)
    values = t * (SCALE / max(1, t.sum()))
    values[w] += SCALE / max(1, len(w))
    slots = np.flatnonzero(values)
    return slots, values[slots]


def label_model(patterns: dict[tuple[int, ...], int], rounds: int = 200) -> tuple[float, np.ndarray, dict[tuple[int, ...], float]]:
    """Prior of good, P(vote | class) as (labeller, class, vote), and the posterior of each pattern, by EM."""
    keys = sorted(patterns)
    v, n = np.array(keys, np.int64).reshape(len(keys), len(LABELLERS)), np.array([patterns[k] for k in keys], float)
    # The labellers vote bad sparingly, each for its own kind of junk: a majority would outvote the one that sees it.
    q = np.where((v == BAD).any(1), 0.1, np.where((v == GOOD).any(1), 0.9, 0.5))
    rates = np.zeros((len(LABELLERS), 2, 3))
    prior = 0.5
    for _ in range(rounds):
        good, bad = q * n, (1 - q) * n
        prior = (good.sum() + 1) / (n.sum() + 2)
        for j in range(len(LABELLERS)):
            for vote in (NONE, GOOD, BAD):
                at = v[:, j] == vote
                rates[j, 0, vote], rates[j, 1, vote] = bad[at].sum() + 0.1, good[at].sum() + 0.1
        rates /= rates.sum(axis=2, keepdims=True)
        log = np.log(rates)
        z = np.log(prior / (1 - prior)) + sum(log[j, 1, v[:, j]] - log[j, 0, v[:, j]] for j in range(len(LABELLERS)))
        new = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        if np.abs(new - q).max(initial=0) < 1e-9:
            break
        q = new
    return float(prior), rates, dict(zip(keys, q.tolist()))


@dataclass
class Scorer:
    weights: np.ndarray
    bias: float

    def score(self, text: bytes) -> float:
        z = self.bias
        for slots in (trigrams(text), word_slots(text)):
            if len(slots):
                z += SCALE * float(self.weights[slots].mean())
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


def fit_scorer(rows: list[tuple[np.ndarray, np.ndarray]], target: np.ndarray, often: np.ndarray | None = None, rounds: int = 150, decay: float = 1e-4) -> Scorer:
    """Logistic regression by Adam; rows: (slots, values), often: how many documents each row stands for."""
    who = np.repeat(np.arange(len(rows)), [len(s) for s, _ in rows])
    slot, value = (np.concatenate([r[k] for r in rows]) if rows else np.zeros(0, np.int64) for k in (0, 1))
    share = (np.ones(len(rows)) if often is None else often) / max(1, len(rows) if often is None else often.sum())
    p, m, v = np.zeros(DIMENSIONS + 1), np.zeros(DIMENSIONS + 1), np.zeros(DIMENSIONS + 1)
    for step in range(1, rounds + 1 if rows else 1):
        z = np.bincount(who, p[slot] * value, minlength=len(rows)) + p[-1]
        e = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - target) * share
        g = np.append(np.bincount(slot, e[who] * value, minlength=DIMENSIONS) + decay * p[:-1], e.sum())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        p = p - 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Scorer(p[:-1], float(p[-1]))


def fit(docs: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> Scorer:
    """The driver receives counts of vote patterns over all documents, and votes and features of about `sample` different texts."""
    arrow_rows(docs.sparkSession)
    base = id_text(docs, id_col, text_col)

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only_cache()
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(["".join(map(str, votes(measure(t)))) for t in b.column(0).cast(pa.binary()).to_pylist()], pa.string())], names=["pattern"])

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only_cache("weak", _slots.forget)
        for b in batches:
            texts = b.column(0).cast(pa.binary()).to_pylist()
            each = [features(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [pa.array(["".join(map(str, votes(measure(t)))) for t in texts], pa.string()), pa.array([s.astype("<i4").tobytes() for s, _ in each], pa.binary()), pa.array([x.astype("<f4").tobytes() for _, x in each], pa.binary()), b.column(1)],
                names=["pattern", "slots", "parts", "n"],
            )

    counts = base.select("text").mapInArrow(vote, "pattern string").groupBy("pattern").count().collect()
    _, _, posterior = label_model({tuple(map(int, r["pattern"])): r["count"] for r in counts})
    chosen = base.where(sampled(F.xxhash64("text"), sum(r["count"] for r in counts), sample)).groupBy("text").agg(F.count("*").alias("n"))
    got = chosen.select("text", "n").mapInArrow(describe, "pattern string, slots binary, parts binary, n long").collect()
    got.sort(key=lambda r: (r.pattern, r.slots, r.parts))
    rows = [(np.frombuffer(r.slots, "<i4"), np.frombuffer(r.parts, "<f4")) for r in got]
    return fit_scorer(rows, np.array([posterior[tuple(map(int, r.pattern))] for r in got]), np.array([r.n for r in got], float))


def score(docs: DataFrame, scorer: Scorer, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score (probability of good) and kept."""
    arrow_rows(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only_cache("weak", _slots.forget)
        for b in batches:
            s = [scorer.score(t) for t in b.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s, pa.float64()), pa.array([x >= 0.5 for x in s], pa.bool_())], names=["doc_id", "score", "kept"])

    return id_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, score double, kept boolean")
