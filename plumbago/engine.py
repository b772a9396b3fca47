"""One-shot queries: a catalog, its tables, and SQL text or a typed query."""

from __future__ import annotations

from pyspark.sql import DataFrame

from plumbago.plans.dialect import bind, parse
from plumbago.plans.ir import BIGINT, BOOLEAN, TEXT, Catalog, Field, Query
from plumbago.plans.lower import one_shot

_KINDS = {"tinyint": BIGINT, "smallint": BIGINT, "int": BIGINT, "bigint": BIGINT, "string": TEXT, "boolean": BOOLEAN}


class Engine:
    """Tables that queries may name.

    Only columns of integers, text and booleans are visible; a stored table has
    no other types in this dialect.
    """

    def __init__(self) -> None:
        self.catalog, self.tables = Catalog(), {}

    def table(self, name: str, df: DataFrame) -> Engine:
        self.catalog.declare(name, [Field(c, _KINDS[t]) for c, t in df.dtypes if t in _KINDS])
        self.tables[name] = df
        return self

    def query(self, q: str | Query) -> DataFrame:
        """The answer, as a DataFrame; Refused at once if the query is not in the dialect."""
        bound = parse(q, self.catalog) if isinstance(q, str) else bind(q, self.catalog)
        return one_shot(bound, self.catalog, self.tables)
