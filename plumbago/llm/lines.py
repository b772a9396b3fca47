"""Removal of runs of lines that are repeated across the corpus.

A text is cut into chunks of lines where a hash rolling over the hashes of the
last lines has its low bits clear, so that an insertion moves boundaries only
near itself and equal passages are cut alike wherever they stand. A chunk has
at least two lines and at most `longest`; what is left at the end of a text may
be a single line. Chunks of two or more lines that occur more than once, in the
same text or another, are kept where they come first (by id, then position)
and removed elsewhere, after their bytes have been compared with the first's.
Lines without a word end no chunk, and are not counted as lines.

Chunks miss a passage that no chunk happens to fall inside. With whole=True
what the repeated chunks leave is therefore compared once more, at every
alignment: each two neighbouring lines with a word (and the blank lines between
them) that do not lie inside a chunk already removed. A pair met before, by id
and then position, is removed, unless it overlaps the first one; so every run of
two or more repeated lines goes, up to its last line: inside a chunk that is
removed every pair was met before, and the first of equal pairs never lies in
one. The first occurrence of a run may lose lines to other, still earlier runs.

Edge cases: null texts stay null, empty ones empty; a single line is no chunk
to remove, however often it occurs; a text may lose all its lines and is then
empty; rows with equal ids are told apart by their texts, and of fully equal
rows with the same id all are treated alike; rows with a null id come last;
an empty table gives an empty table; further columns are passed on by
deduplicate_lines only if asked for.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbago.llm.common import arrow_rows, drop_written, only_cache, written

ROLLED, MASK, LONGEST = 2, 1, 16


def chunks(lines: list[bytes], longest: int = LONGEST) -> list[tuple[int, int]]:
    """(from, to) of each chunk of a text's lines."""
    out, start, last, counted = [], 0, [], 0
    for k, line in enumerate(lines):
        if not line.strip(b" \t\n\r\x0b\x0c"):
            continue
        counted += 1
        last = [*last[1 - ROLLED :], xxhash.xxh3_64_intdigest(line)]
        rolled = 0
        for h in last:
            rolled = (rolled * 0x9E3779B97F4A7C15 + h) % 2**64
        if counted >= longest or counted >= 2 and (rolled >> 32) & MASK == 0:
            out.append((start, k + 1))
            start, counted = k + 1, 0
    if start < len(lines):
        out.append((start, len(lines)))
    return out


def pairs(lines: list[bytes]) -> list[tuple[int, int]]:
    """(from, to) of each two neighbouring lines with a word, blank lines between them included."""
    at = [k for k, x in enumerate(lines) if x.strip(b" \t\n\r\x0b\x0c")]
    return [(a, b + 1) for a, b in zip(at, at[1:])]


def _many(lines: list[bytes]) -> bool:
    return sum(1 for x in lines if x.strip(b" \t\n\r\x0b\x0c")) > 1


def _with(rows: DataFrame, marks: DataFrame, how: str) -> DataFrame:
    """rows joined with what marks say of the same doc_id (null or not) and part."""
    marks = marks.withColumnsRenamed({"doc_id": "i", "part": "p"})
    return rows.join(marks, F.col("doc_id").eqNullSafe(F.col("i")) & F.col("part").eqNullSafe(F.col("p")), how).drop("i", "p")


def places(lines: list[bytes], longest: int, whole: bool) -> list[tuple[int, int, int, int]]:
    """(from, to, inside, kind) of what is compared: the chunks of two lines or more (kind 0), then all pairs (1) with their chunk's place or -1."""
    cut = [(a, b) for a, b in chunks(lines, longest) if _many(lines[a:b])]
    out = [(a, b, -1, 0) for a, b in cut]
    if whole:
        n = 0
        for a, b in pairs(lines):
            while n < len(cut) and cut[n][1] <= a:
                n += 1
            out.append((a, b, n if n < len(cut) and cut[n][0] <= a and b <= cut[n][1] else -1, 1))
    return out


def deduplicate_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, longest: int = LONGEST, whole: bool = False) -> DataFrame:
    """doc_id, text without repeated chunks (whole: without repeated runs of lines), n_lines, n_removed (lines with a word), and the columns in keep.

    A chunk's or pair's repetition is found by a 128-bit hash and confirmed byte for byte
    against its first occurrence. Texts are shuffled twice, to confirm and to cut.
    """
    arrow_rows(docs.sparkSession)
    keep = keep or []
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *[F.col(c).alias(f"keep_{k}") for k, c in enumerate(keep)])
    keyed = base.withColumn("part", F.xxhash64("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only_cache()
        for b in (b for b in batches if b.num_rows):
            row, at, into, kind, low, high = [], [], [], [], [], []
            for r, t in enumerate(b.column(2).cast(pa.binary()).to_pylist()):
                lines = t.split(b"\n")
                for k, (i, j, inside, what) in enumerate(places(lines, longest, whole)):
                    h = xxhash.xxh3_128_intdigest(b"\n".join(lines[i:j]))
                    row.append(r)
                    at.append(k)
                    into.append(inside)
                    kind.append(what)
                    low.append(h % 2**64)
                    high.append(h >> 64)
            rows = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(rows), b.column(1).take(rows), pa.array(at, pa.int32()), pa.array(into, pa.int32()), pa.array(kind, pa.int32()), *(pa.array(np.array(x, dtype=np.uint64).view(np.int64)) for x in (low, high))], names=["doc_id", "part", "at", "inside", "kind", "h1", "h2"])

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The bytes of repeated chunks and pairs alone."""
        only_cache()
        for b in batches:
            rows = []
            for i, part, t, wanted in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).cast(pa.binary()).to_pylist(), b.column(3).to_pylist()):
                lines = t.split(b"\n")
                cuts = places(lines, longest, whole)
                for w in wanted:
                    start, stop = cuts[w["at"]][:2]
                    rows.append((i, part, w["at"], w["h1"], w["h2"], w["leads"], w["stays"], b"\n".join(lines[start:stop])))
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(list(x), k) for x, k in zip(zip(*rows), kinds)] if rows else [pa.array([], k) for k in kinds], names=["doc_id", "part", "at", "h1", "h2", "leads", "stays", "body"])

    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "part", "at")

    def members(found: DataFrame, apart: int) -> DataFrame:
        """The occurrences of what occurs more than once. apart: the nearest place in the same text that does not overlap."""
        several = written(found.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min(place).alias("first")).where("n > 1").select("h1", "h2", "first"), "repeated-lines")
        beside = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & F.col("part").eqNullSafe(F.col("first.part")) & (F.col("at") < F.col("first.at") + apart)
        return found.join(several, ["h1", "h2"]).select("doc_id", "part", "at", "h1", "h2", place.eqNullSafe(F.col("first")).alias("leads"), beside.alias("stays"))

    texts = keyed.where("text is not null").select("doc_id", "part", "text")
    found = written(texts.mapInArrow(cut, "doc_id long, part long, at int, inside int, kind int, h1 long, h2 long"), "lines")
    repeated = members(found.where("kind = 0"), 1)
    if whole:
        gone = repeated.where("not stays").select(F.col("doc_id").alias("i"), F.col("part").alias("p"), F.col("at").alias("chunk"))
        left = found.where("kind = 1").join(gone, F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("part") == F.col("p")) & (F.col("inside") == F.col("chunk")), "left_anti")
        repeated = repeated.unionByName(members(left, 2))
    wanted = repeated.groupBy("doc_id", "part").agg(F.collect_set(F.struct("at", "h1", "h2", "leads", "stays")).alias("wanted"))
    bodies = written(_with(texts, wanted, "inner").select("doc_id", "part", "text", "wanted").mapInArrow(take, "doc_id long, part long, at int, h1 long, h2 long, leads boolean, stays boolean, body binary"), "line-bodies")
    drop_written(found)
    first = bodies.where("leads").select("h1", "h2", F.col("body").alias("first_body")).dropDuplicates(["h1", "h2"])
    gone = bodies.where("not stays").join(written(first, "first-bodies"), ["h1", "h2"]).where("body = first_body")
    marks = gone.groupBy("doc_id", "part").agg(F.collect_set("at").alias("ats"))

    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only_cache()
        for b in batches:
            texts, totals, removed = [], [], []
            for t, ats in zip(b.column(1).cast(pa.binary()).to_pylist(), b.column(2).to_pylist()):
                lines = [] if t is None else t.split(b"\n")
                words = sum(1 for x in lines if x.strip(b" \t\n\r\x0b\x0c"))
                left = lines
                if ats:
                    cuts = places(lines, longest, whole)
                    gone_at = {x for k in ats for x in range(*cuts[k][:2])}
                    left = [x for k, x in enumerate(lines) if k not in gone_at]
                totals.append(words)
                removed.append(words - sum(1 for x in left if x.strip(b" \t\n\r\x0b\x0c")))
                texts.append(None if t is None else b"\n".join(left).decode())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string()), pa.array(totals, pa.int64()), pa.array(removed, pa.int64()), *(b.column(k) for k in range(3, b.num_columns))], names=["doc_id", "text", "n_lines", "n_removed", *b.schema.names[3:]])

    joined = _with(keyed, marks, "left")
    extra = [f"keep_{k}" for k in range(len(keep))]
    kinds = "".join(f", {c} {t}" for c, t in base.select(*extra).dtypes)
    out = joined.select("doc_id", "text", "ats", *extra).mapInArrow(drop, f"doc_id long, text string, n_lines long, n_removed long{kinds}")
    return out.select("doc_id", "text", "n_lines", "n_removed", *[F.col(f"keep_{k}").alias(c) for k, c in enumerate(keep)])
