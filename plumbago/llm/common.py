"""Helpers shared by the corpus operators.

Words are maximal runs of characters other than U+0020 and U+0009..U+000D.
A null text counts as the empty text; a null id is kept and sorts first.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbago.sources.tables import drop_written, fresh_path, load, written

__all__ = ["SHINGLE_WORDS", "SIMILARITY", "Recent", "arrow_rows", "bind", "documents", "drop_written", "fresh_path", "id_text", "in_parts", "only_cache", "sampled", "whole_text", "words", "written"]

SPACES = r"[\x20\x09-\x0D]+"
SHINGLE_WORDS = 5
#: Bytes of a text that a worker cuts into words at a time.
PART = 1 << 18
_BREAK = re.compile(rb"[\x20\x09-\x0D]")
SIMILARITY = 0.8


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents")


def bind(value: Column, body) -> Column:
    """body(value) with value computed once, even where body uses it in lambdas.

    Spark copies an expression into every place that names it; inside a
    higher-order function that would be once for each element.
    """
    return F.transform(F.array(value), body)[0]


def whole_text(text: Column | str) -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def words(text: Column | str) -> Column:
    return F.array_remove(F.split(whole_text(text), SPACES), "")


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the text, so that further columns cannot clash with ours."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(F.col(text_col)).alias("text"))


def sampled(key: Column, of: int, sample: int) -> Column:
    """Whether a hash falls into the share that takes about `sample` of `of` rows: all rows if they are no more."""
    return F.lit(True) if of <= sample else F.shiftrightunsigned(key, 11) < int(sample / of * (1 << 53))


def arrow_rows(spark: SparkSession, rows: int = 500) -> None:
    """Small Arrow batches: some texts are very long, and a batch is held whole in a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


class Recent(dict):
    """What a Python worker remembers of keys met lately, in at most about `most` bytes.

    Entries live in two generations: once the younger one holds half of the
    bytes it becomes the older, and what was not asked for since is forgotten.
    """

    EACH = 200  # an entry's objects and its places in two tables

    def __init__(self, most: int):
        super().__init__()
        self.half, self.held, self.old = most // 2, 0, {}

    def add(self, key, value, size: int) -> None:
        self[key] = value
        self.held += size + self.EACH

    def add_all(self, entries: Iterable, n: int, size: int) -> None:
        """Add n keys and values of `size` bytes in all."""
        self.update(entries)
        self.held += size + n * self.EACH

    def missing(self, keys: Iterable) -> set:
        """The distinct keys that have to be added; all others can be read until the next call."""
        if self.held > self.half:
            self.old, self.held = dict(self), 0
            self.clear()
        new = {k for k in keys if k not in self}  # set operations would walk the whole table
        if self.old and new:
            known = {k for k in new if k in self.old}
            for k in known:
                v = self.old[k]
                self.add(k, v, len(k) + len(v))
            new -= known
        return new

    def forget(self) -> None:
        self.clear()
        self.old, self.held = {}, 0


_caches: dict[str, Callable[[], None]] = {}


def only_cache(name: str | None = None, forget: Callable[[], None] | None = None) -> None:
    """Called where work on a partition begins: a worker keeps no other operator's cache. forget empties the caller's, later."""
    for other in [k for k in _caches if k != name]:
        _caches.pop(other)()
    if name is not None and forget is not None:
        _caches[name] = forget


def in_parts(text: bytes, size: int = PART) -> Iterator[bytes]:
    """A UTF-8 text in consecutive parts of about `size` bytes, cut before white space only, so that no word is cut."""
    at = 0
    while at < len(text):
        m = _BREAK.search(text, at + size) if at + size < len(text) else None
        end = m.start() if m else len(text)
        yield text[at:end]
        at = end
