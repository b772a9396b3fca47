"""Quality rules with thresholds that follow each language and source.

Counts per text are taken natively (see measures). A document fails the base
rules with fewer than ten words, or with more than a fifth of its words in
five-word windows found twice or more in it. (Windows are compared by 64-bit
hashes: in a text of n words two unequal ones pass for equal with a chance of
n^2 / 2^65.) The other rules compare a ratio with fences drawn from quantiles
among documents of the same language and source that pass the base rules:
  - word length, in hundredths of a code point: within three interquartile
    ranges of the quartiles, and for n words 700 / sqrt(n) more, three standard
    errors of a mean of n word lengths;
  - symbols a thousand words: a rate of the 85th percentile and three times its
    distance from the median, so that up to a seventh of junk doesn't move it;
  - repeated lines a thousand: a rate of the 99th percentile.
Of a rate, a document may hold the expected count c, 3 sqrt(c) and 3 more: what
chance gives a short text. No fence is fixed: where the documents of a source
use symbols or repeat lines, its limits rise with them.

Quantiles come from sketches: counts of values rounded down to eight significant
bits, so relative error is below 1/128. They are sums, so they merge exactly in
any order: by language and source, by language, over all. A small source leans
on its language and a small language on all: as if it had PRIOR documents more,
with the quantiles of the level above.

Edge cases: a null text is the empty text and fails; null languages and
sources are values of their own; very long texts count whole, in memory linear
in the text; repeated rows each count; an empty table gives an empty table;
further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbago.llm.common import SHINGLE_WORDS, bind, whole_text, words, written

SYMBOLS = "#*$%&|<>"
LEAST_WORDS, REPEATED_PERCENT, PRIOR, SIGNIFICANT = 10, 20, 10, 8
#: The two percentiles that are drawn of each ratio.
RATIOS = {"length": (25, 75), "symbols": (50, 85), "lines": (99, 99)}


def count_symbols(text: Column) -> Column:
    """Symbols are single bytes, so the difference in bytes counts them."""
    rest = text
    for c in SYMBOLS:
        rest = F.replace(rest, F.lit(c))
    return (F.octet_length(text) - F.octet_length(rest)).cast("long")


def repeated_words(w: Column, window: int = SHINGLE_WORDS) -> Column:
    """Words covered by windows that occur twice or more in the array w; windows are compared by 64-bit hashes."""

    def covered(g: Column) -> Column:
        """g: hash of each window. Equal ones are neighbours once sorted."""

        def by_hash(s: Column) -> Column:
            twin = lambda e, k: F.get(s, k - 1)["g"].eqNullSafe(e["g"]) | F.get(s, k + 1)["g"].eqNullSafe(e["g"])
            starts = F.sort_array(F.transform(F.filter(s, twin), lambda e: e["i"]))
            first = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-window).alias("last"))
            add = lambda a, i: F.struct((a["n"] + F.least(F.lit(window), i - a["last"])).alias("n"), i.alias("last"))
            return F.aggregate(starts, first, add, lambda a: a["n"])

        placed = F.transform(g, lambda x, i: F.struct(x.alias("g"), i.alias("i")))
        return F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0).cast("long")).otherwise(bind(F.sort_array(placed), by_hash))

    def windows(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(h) - window), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(window)]))

    return F.when(F.size(w) < window, F.lit(0).cast("long")).otherwise(bind(bind(F.transform(w, lambda x: F.xxhash64(x)), windows), covered))


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """Counts of each text: n_words, word_chars (code points in words), n_symbols, n_lines, n_dup_lines (lines with a word, equal to an earlier line), n_repeat_words."""
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source"), whole_text(text_col).alias("text"))

    def counts(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            repeated_words(w).alias("n_repeat_words"),
        )

    def line_counts(lines: Column) -> Column:
        return F.struct(F.size(lines).cast("long").alias("n"), (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("dup"))

    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    found = base.select("doc_id", "lang", "source", bind(words("text"), counts).alias("c"), bind(lines, line_counts).alias("l"), count_symbols(F.col("text")).alias("n_symbols"))
    return found.select("doc_id", "lang", "source", "c.n_words", "c.word_chars", "n_symbols", F.col("l.n").alias("n_lines"), F.col("l.dup").alias("n_dup_lines"), "c.n_repeat_words")


def with_ratios(measured: DataFrame) -> DataFrame:
    """measured with base_failed and the ratios as whole numbers."""
    n = F.greatest("n_words", F.lit(1))
    return measured.withColumns(
        {
            "base_failed": (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEATED_PERCENT * F.col("n_words")),
            "length": F.floor(100 * F.col("word_chars") / n),
            "symbols": F.floor(1000 * F.col("n_symbols") / n),
            "lines": F.floor(1000 * F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1))),
        }
    )


def sketches(rows: DataFrame) -> DataFrame:
    """(lang, source, ratio, bucket, n): mergeable counts of each ratio's values, rounded down to eight significant bits."""
    flat = rows.select("lang", "source", F.explode(F.map_from_arrays(F.array(*map(F.lit, RATIOS)), F.array(*RATIOS))).alias("ratio", "value"))
    low = F.greatest(F.length(F.bin("value")) - SIGNIFICANT, F.lit(0))
    bucket = F.expr("shiftleft(shiftright(value, low), low)")
    return flat.withColumn("low", low).groupBy("lang", "source", "ratio", bucket.alias("bucket")).agg(F.count("*").alias("n"))


def quantiles(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """keys, docs, and for each ratio an array of its two quantiles."""
    merged = sketch.groupBy(*keys, "ratio", "bucket").agg(F.sum("n").alias("n"))
    whole = Window.partitionBy(*keys, "ratio")
    ranked = merged.withColumns({"below": F.sum("n").over(whole.orderBy("bucket")), "docs": F.sum("n").over(whole)})
    at = lambda k: F.min(F.when(100 * F.col("below") >= F.get(F.element_at(levels, F.col("ratio")), F.lit(k)) * F.col("docs"), F.col("bucket"))).cast("double")
    levels = F.create_map(*[x for r, q in RATIOS.items() for x in (F.lit(r), F.array(*map(F.lit, q)))])
    each = ranked.groupBy(*keys, "ratio").agg(F.first("docs").alias("docs"), F.array(at(0), at(1)).alias("q"))
    return each.groupBy(*keys).agg(F.first("docs").alias("docs"), *[F.max(F.when(F.col("ratio") == r, F.col("q"))).alias(r) for r in RATIOS])


def _leaning(own: str, above: Column, prior: int) -> Column:
    """Quantiles of a level, with `prior` documents of the level above."""
    docs = F.col(f"{own}.docs").cast("double")
    mean = lambda r: F.zip_with(F.col(f"{own}.{r}"), above[r], lambda a, b: (docs * a + float(prior) * b) / (docs + float(prior)))
    return F.struct(*[mean(r).alias(r) for r in RATIOS])


def thresholds(sketch: DataFrame, prior: int = PRIOR) -> DataFrame:
    """lang, source and the quantiles t that hold there."""
    own, by_lang = (quantiles(sketch, keys).select(*keys, F.struct("docs", *RATIOS).alias(name)) for keys, name in ((["lang", "source"], "q0"), (["lang"], "q1")))
    by_lang = by_lang.withColumnRenamed("lang", "lang_")
    joined = own.join(by_lang, own.lang.eqNullSafe(by_lang.lang_)).withColumn("q2", quantiles(sketch, []).select(F.struct("docs", *RATIOS)).scalar())
    joined = joined.withColumn("l", _leaning("q1", F.col("q2"), prior))
    return joined.select(F.col("lang").alias("t_lang"), F.col("source").alias("t_source"), _leaning("q0", F.col("l"), prior).alias("t"))


def verdict() -> Column:
    """Whether a document that passes the base rules keeps within the fences drawn from t."""
    low, high = F.col("t.length")[0], F.col("t.length")[1]
    spread, slack = 3.0 * (high - low), 700.0 / F.sqrt(F.greatest("n_words", F.lit(1)).cast("double"))
    symbols = F.col("t.symbols")[1] + 3.0 * (F.col("t.symbols")[1] - F.col("t.symbols")[0])

    def within(count: str, rate: Column, of: str) -> Column:
        expected = rate * F.col(of).cast("double") / 1000.0
        return F.col(count).cast("double") <= expected + 3.0 * F.sqrt(expected) + 3.0

    return F.col("length").cast("double").between(low - spread - slack, high + spread + slack) & within("n_symbols", symbols, "n_words") & within("n_dup_lines", F.col("t.lines")[1], "n_lines")


def apply_rules(docs: DataFrame, prior: int = PRIOR, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """doc_id, the counts, base_failed and kept for each document."""
    rows = written(with_ratios(measures(docs, id_col, text_col, lang_col, source_col)), "measures")
    limits = thresholds(sketches(rows.where("not base_failed")), prior)
    joined = rows.join(limits, rows.lang.eqNullSafe(limits.t_lang) & rows.source.eqNullSafe(limits.t_source), "left")
    return joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & F.coalesce(verdict(), F.lit(False))).alias("kept"))
