"""Removal of long word sequences that an earlier document holds already.

Level-wise doubling: windows of 7 words that are repeated across documents are
found first; those repeated are extended to 13 words, what is repeated then to
25, and that to 50, the asked length (each level doubles, less one where the
next is odd). A level compares the survivors of the last alone, and levels end
early where none survive. A full window that is repeated marks its words in
every document but the one with the smallest id; doubling ends at the asked
length, as a longer repeat is the union of its windows.

At the first level each full window is stood for by the least hash among the
windows of 7 words inside it, the first of equals, so that few of them (about
one in twenty-two) are shuffled. Extension is to the right where the full window
has room, else to the left. Equal full windows hence have equal windows at each
level, and nothing is lost. Consecutive full windows with the same inner windows
are one row through all levels. At last a full window is compared by its own
64-bit hash and that of its least window of 7 words: of N windows two unequal
ones pass for equal with a chance of N^2 / 2^129.

Exact copies of a text are set aside first: each is covered by the copy with
the smallest id.

Edge cases: null and empty texts have no words and nothing removed; texts
shorter than a window keep everything; windows repeated inside one document
only, or among rows of the same id, are kept; a row with a null id keeps
everything and counts as earlier than nobody; an empty table gives an empty
table; columns other than id and text are ignored.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbago.llm.common import arrow_rows, drop_written, id_text, in_parts, only_cache, written

WINDOW = 50
log = logging.getLogger(__name__)
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xBF58476D1CE4E5B9))


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a * _A + b * _B
    x ^= x >> np.uint64(32)
    x *= _C
    return x ^ (x >> np.uint64(29))


def _span(h: np.ndarray, length: int, join) -> np.ndarray:
    """join folded over each run of `length` neighbours, by doubling."""
    n, out, have = len(h), h, 1
    while have < length:
        step = min(have, length - have)
        out = join(out[: n - have - step + 1], out[step:])
        have += step
    return out


def lengths(window: int) -> list[int]:
    """The lengths of all levels, each at most twice the one before; the last is the window."""
    out = [window]
    while out[0] > 8:
        out.insert(0, (out[0] + 1) // 2)
    return out


def word_hashes(text: bytes) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.uint64), *(np.fromiter(map(xxhash.xxh3_64_intdigest, x), np.uint64, len(x)) for x in map(bytes.split, in_parts(text)))])


_PLACE = np.uint64((1 << 24) - 1)


def anchors(text: bytes, window: int) -> tuple[np.ndarray, list[np.ndarray], np.ndarray] | None:
    """Of each full window: the place of its inner window at each level but the last, the hashes of all windows by level, and its own hash."""
    h, levels = word_hashes(text), lengths(window)
    if len(h) < window:
        return None
    spans = [_span(h, levels[0], _mix)]
    for before, n in zip(levels, levels[1:]):
        spans.append(_mix(spans[-1][: len(h) - n + 1], spans[-1][n - before : len(h) - before + 1]))
    # The low bits of a hash give way to its place: the least has its place with it, the first of equals.
    packed = (spans[0] & ~_PLACE) | (np.arange(len(spans[0]), dtype=np.uint64) & _PLACE)
    start = np.arange(len(h) - window + 1)
    at = [start + ((_span(packed, window - levels[0] + 1, np.minimum) & _PLACE).astype(np.int64) - start) % (1 << 24)]
    for before, n in zip(levels[:-1], levels[1:-1]):
        at.append(np.where(at[-1] + n <= start + window, at[-1], at[-1] + before - n))
    return np.stack(at), spans, start


def _texts(column: pa.Array) -> list[bytes]:
    return column.cast(pa.binary()).to_pylist()


def repeated(docs: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """What to remove: (doc_id, part, starts array<int>) of windows, and (doc_id, part) of later exact copies.

    part is a 64-bit hash of the text; it tells rows of the same id apart. The
    number of rows that survive each level is logged.
    """
    arrow_rows(docs.sparkSession)
    levels = lengths(window)
    base = docs.where("doc_id is not null").withColumn("part", F.xxhash64("text"))

    keyed = base.select("doc_id", "part", F.xxhash64("text").alias("k1"), F.xxhash64(F.lit(1), "text").alias("k2"))
    firsts = written(keyed.groupBy("k1", "k2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("k1", "k2", "first"), "first-copies")
    copies = written(keyed.join(firsts, ["k1", "k2"]).where("doc_id > first").select("doc_id", "part").distinct(), "copies")
    drop_written(firsts)

    columns = [f"h{n}" for n in levels[:-1]]
    hashes = ", ".join(f"{c} long" for c in columns)

    def inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each run of full windows with the same inner windows: the first, the one after the last, and hashes by level."""
        only_cache()
        for b in (b for b in batches if b.num_rows):
            rows, sizes = [], []
            for t in _texts(b.column(2)):
                found = anchors(t, window) if columns else None
                sizes.append(0)
                if found:
                    at, spans, start = found
                    first = np.concatenate([[0], np.flatnonzero((at[:, 1:] != at[:, :-1]).any(axis=0)) + 1])
                    rows.append(np.stack([first, np.append(first[1:], len(start)), *(x[p[first]].view(np.int64) for x, p in zip(spans, at))]))
                    sizes[-1] = len(first)
            table = np.concatenate(rows, axis=1) if rows else np.zeros((2 + len(columns), 0), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(b.column(k).to_numpy(), sizes)) for k in (0, 1)] + [pa.array(x.astype(np.int32)) for x in table[:2]] + [pa.array(x) for x in table[2:]], names=["doc_id", "part", "s", "e", *columns])

    texts = base.select("doc_id", "part", "text")
    alive = None
    if columns:
        alive = written(texts.mapInArrow(inner, f"doc_id long, part long, s int, e int, {hashes}").join(copies, ["doc_id", "part"], "left_anti"), "inner-windows")
        for c in columns:
            again = written(alive.groupBy(c).agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("z")).where("a < z").select(c), "repeated-windows")
            last, alive = alive, written(alive.join(again, c).select(*alive.columns), "surviving-windows")
            n = alive.count()
            log.info("%s rows of windows are repeated at %s words", n, c[1:])
            drop_written(last)
            drop_written(again)
            if not n:
                break
        ranges = alive.groupBy("doc_id", "part").agg(F.collect_list(F.struct("s", "e")).alias("rs"))
    else:
        ranges = texts.join(copies, ["doc_id", "part"], "left_anti").select("doc_id", "part", F.array(F.struct(F.lit(0).alias("s"), F.lit((1 << 31) - 1).alias("e"))).alias("rs"))

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only_cache()
        for b in (b for b in batches if b.num_rows):
            starts, hashes, leasts, sizes = [], [], [], []
            for t, rs in zip(_texts(b.column(2)), b.column(3)):
                found, kept = anchors(t, window), np.zeros(0, np.int64)
                if found:
                    at, spans, start = found
                    edge = np.zeros(len(start) + 1, np.int32)
                    np.add.at(edge, rs.values.field("s").to_numpy(), 1)
                    np.add.at(edge, np.minimum(rs.values.field("e").to_numpy(), len(start)), -1)
                    kept = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
                    hashes.append(spans[-1][kept])
                    leasts.append(spans[0][at[0][kept]])
                starts.append(kept)
                sizes.append(len(kept))
            h, g = (np.concatenate([np.zeros(0, np.uint64), *x]).view(np.int64) for x in (hashes, leasts))
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(b.column(k).to_numpy(), sizes)) for k in (0, 1)] + [pa.array(np.concatenate(starts).astype(np.int32)), pa.array(h), pa.array(g)], names=["doc_id", "part", "s", "h", "g"])

    windows = written(texts.join(ranges, ["doc_id", "part"]).select("doc_id", "part", "text", "rs").mapInArrow(extend, "doc_id long, part long, s int, h long, g long"), "windows")
    if alive is not None:
        drop_written(alive)
    first = written(windows.groupBy("g", "h").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("g", "h", "first"), "first-windows")
    spans = windows.join(first, ["g", "h"]).where("doc_id > first").groupBy("doc_id", "part").agg(F.collect_list("s").alias("starts"))
    return spans, copies


def remove_repeated(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed and kept, the words left over joined by one space."""
    docs = id_text(docs, id_col, text_col)
    spans, copies = repeated(docs, window)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only_cache()
        for b in batches:
            totals, removed, kept = [], [], []
            for t, starts, copy in zip(_texts(b.column(1)), b.column(2), b.column(3).to_pylist()):
                words = t.split()
                n = len(words)
                totals.append(n)
                if copy and n >= window:
                    removed.append(n)
                    kept.append("")
                elif starts.is_valid:
                    edge = np.zeros(n + 1, np.int32)
                    s = starts.values.to_numpy()
                    np.add.at(edge, s, 1)
                    np.add.at(edge, s + window, -1)
                    rest = np.flatnonzero(np.cumsum(edge[:n]) == 0).tolist()
                    removed.append(n - len(rest))
                    kept.append(b" ".join([words[k] for k in rest]).decode())
                else:
                    removed.append(0)
                    kept.append(b" ".join(words).decode())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(totals, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])

    marks = spans.withColumn("copy", F.lit(False)).unionByName(copies.select("doc_id", "part", F.lit(None).cast("array<int>").alias("starts"), F.lit(True).alias("copy")))
    joined = docs.withColumn("part", F.xxhash64("text")).join(marks, ["doc_id", "part"], "left")
    return joined.select("doc_id", "text", "starts", F.coalesce("copy", F.lit(False)).alias("copy")).mapInArrow(cut, "doc_id long, n_words long, n_removed long, kept string")
