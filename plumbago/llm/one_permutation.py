"""Document fingerprints: one-permutation MinHash with optimal densification and b-bit storage.

Each shingle of five words is hashed once. The top byte of the hash is its bin,
one of 256, and a bin keeps its least hash. An empty bin borrows the value of a
bin that is not empty, chosen by a sequence of bins drawn for that empty bin
alone, the same for every text; after PROBES empty ones, the non-empty bin of
least hash with it. Two sets thus borrow alike as far as they are alike. The
lowest four bits of each value are packed into sixteen 64-bit integers.

Likeness of two fingerprints: the share of equal values, corrected for the 1/16
that would be equal by chance, between 0 and 1; it estimates the Jaccard
similarity of the shingle sets.

Everything is native: arrays and higher-order functions, no Python.

Edge cases: a text of fewer than five words is one shingle, and so is a null or
empty text, or white space alone, which are all alike; very long texts count
whole, in memory linear in the text. In edited(), rows with null ids come
first, equal ids follow by text, a lone document is followed by itself, and an
empty table gives an empty table; columns other than id and text are ignored.
"""

from __future__ import annotations

import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbago.llm.common import SHINGLE_WORDS, bind, id_text, words

BINS, BITS, PROBES = 256, 4, 12
_LOW = (1 << 56) - 1
_PER_LONG = 64 // BITS


def _longs(values: list[int]) -> Column:
    return F.lit(values).cast("array<bigint>")


def fingerprint(text: Column, shingle: int = SHINGLE_WORDS) -> Column:
    """Packed low-order bits of the text's bins: an array of sixteen integers."""
    # The greatest hash of every bin: it is a bin's least only where the bin is empty.
    ends = _longs([b << 56 | _LOW for b in range(-128, 128)])
    probes = F.lit([xxhash.xxh32_intdigest(f"{b} {t}") % BINS for b in range(BINS) for t in range(PROBES)])

    def shingles(h: Column) -> Column:
        several = F.transform(F.sequence(F.lit(0), F.size(h) - shingle), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(shingle)]))
        return F.when(F.size(h) < shingle, F.array(F.xxhash64(h))).otherwise(several)

    def leasts(s: Column) -> Column:
        """s: sorted hashes and ends; the first of each bin stays."""
        return F.filter(s, lambda x, i: (i == 0) | (F.shiftright(x, 56) != F.shiftright(F.get(s, i - 1), 56)))

    def empty(x: Column) -> Column:
        return x.bitwiseAND(F.lit(_LOW)) == F.lit(_LOW)

    def densify(bins: Column) -> Column:
        full = F.filter(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda b: ~empty(F.get(bins, b)))

        def borrowed(b: Column, full: Column) -> Column:
            drawn = F.get(F.filter(F.slice(probes, b * PROBES + 1, F.lit(PROBES)), lambda q: ~empty(F.get(bins, q))), F.lit(0))
            least = F.array_min(F.transform(full, lambda q: F.struct(F.xxhash64(b, q).alias("h"), q.alias("q"))))["q"]
            return F.coalesce(drawn, least)

        def value(b: Column, full: Column) -> Column:
            x = F.get(bins, b)
            return F.when(empty(x), F.get(bins, borrowed(b, full))).otherwise(x).bitwiseAND(F.lit((1 << BITS) - 1))

        return bind(full, lambda f: F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda b: value(b, f)))

    def pack(v: Column) -> Column:
        def one(k: Column) -> Column:
            return F.aggregate(F.slice(v, k * _PER_LONG + 1, F.lit(_PER_LONG)), F.lit(0).cast("long"), lambda a, x: F.shiftleft(a, BITS).bitwiseOR(x))

        return F.transform(F.sequence(F.lit(0), F.lit(BINS // _PER_LONG - 1)), one)

    hashed = F.transform(words(text), lambda x: F.xxhash64(x))
    binned = bind(bind(hashed, shingles), lambda g: bind(F.sort_array(F.concat(g, ends)), leasts))
    return bind(bind(binned, densify), pack)


def text_of(packed: Column) -> Column:
    """A fingerprint as lowercase hex digits, one for each bin."""
    return F.lower(F.array_join(F.transform(packed, lambda x: F.lpad(F.hex(x), 16, "0")), ""))


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of two texts from their fingerprints."""
    ones = F.lit(int("1" * _PER_LONG, 16))

    def unequal(x: Column, y: Column) -> Column:
        z = x.bitwiseXOR(y)
        z = z.bitwiseOR(F.shiftright(z, 1))
        return F.bit_count(z.bitwiseOR(F.shiftright(z, 2)).bitwiseAND(ones))

    n = F.aggregate(F.zip_with(a, b, unequal), F.lit(0), lambda s, x: s + x)
    chance = 2.0**-BITS
    return F.greatest(F.lit(0.0), F.lit(1.0) - n / BINS / (1 - chance))


def fingerprints(docs: DataFrame, shingle: int = SHINGLE_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and packed fingerprint of every row."""
    return id_text(docs, id_col, text_col).select("doc_id", fingerprint(F.col("text"), shingle).alias("packed"))


def _bucket(bounds: list[int]) -> Column:
    """How many of the sorted bounds are at most doc_id, by binary search; 0 for a null id."""
    if not bounds:
        return F.lit(0)
    steps = [1 << k for k in reversed(range(len(bounds).bit_length()))]
    edges = _longs(bounds)
    move = lambda at, step: F.when(F.get(edges, at + step - 1) <= F.col("doc_id"), at + step).otherwise(at)
    return F.coalesce(F.aggregate(F.lit(steps), F.lit(0), move), F.lit(0))


def followed(rows: DataFrame, columns: list[str], buckets: int | None = None, made: dict[str, Column] | None = None) -> DataFrame:
    """rows (with doc_id and text), made, and next_<c>, the value of each column c in the row that follows by id; the first follows the last.

    Rows are dealt by ranges of ids, so that no task sees more than its range;
    each range also gets a copy of the row that heads the next one, chosen by
    id before the columns of made, which may be costly, are computed once a
    row. The driver receives the ranges' bounds and their first ids, as many as
    `buckets`.
    """
    spark, made = rows.sparkSession, made or {}
    n = buckets or 8 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = rows.agg(F.percentile_approx("doc_id", [k / n for k in range(1, n)], 20 * n)).first()[0] if n > 1 else None
    bucket = _bucket(sorted(set(found or [])))
    heads = rows.select("doc_id", bucket.alias("bucket")).groupBy("bucket").agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("has"), "doc_id")).alias("h")).orderBy("bucket").collect()
    pairs = [(h.h.doc_id, before.bucket) for before, h in zip([heads[-1], *heads[:-1]], heads)] if heads else []
    targets = spark.createDataFrame(pairs, "head long, bucket int")
    here = rows.withColumns({"bucket": bucket, "copy": F.lit(False), **made})
    copies = rows.join(F.broadcast(targets), rows.doc_id.eqNullSafe(targets["head"])).drop("head").withColumns({"copy": F.lit(True), **made})
    # A copy comes last in its range, even where it comes from the first one.
    order = Window.partitionBy("bucket").orderBy("copy", F.col("doc_id").asc_nulls_first(), "text")
    return here.unionByName(copies).withColumns({f"next_{c}": F.lead(c).over(order) for c in columns}).where("not copy").drop("bucket", "copy")


def edited(docs: DataFrame, shingle: int = SHINGLE_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edited text.

    Edited: the last quarter of a text's code points (rounded down) replaced by
    as many of the first of the next document, or all it has. Columns: doc_id,
    text, n_chars, packed, edited, edited_packed, next_packed.
    """
    own = followed(id_text(docs, id_col, text_col), ["text", "packed"], made={"packed": fingerprint(F.col("text"), shingle)})
    n = F.length("text")
    cut = F.floor(n / 4).cast("int")
    changed = F.concat(F.substring("text", F.lit(1), n - cut), F.substring("next_text", F.lit(1), cut))
    out = own.select("doc_id", "text", n.cast("long").alias("n_chars"), "packed", changed.alias("edited"), "next_packed")
    return out.withColumn("edited_packed", fingerprint(F.col("edited"), shingle))
