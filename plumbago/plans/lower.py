"""Bound queries as DataFrames: over whole tables, or over changes to them.

A table is a DataFrame with the catalog's columns; in a weighted table the
column __w says how many times a row stands (negative in a change). Columns are
renamed by position on the way in and named again at the end, because names are
case-sensitive here and are not in Spark.

Data that an expression raises on is handled in one of two ways. With errors
"raise" the job fails when it reads such a row. With "collect" the failing rows
leave the result and their messages are a second DataFrame, so that an answer
can be an error that goes away with the data.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbago.errors import Refused
from plumbago.functions.exact import evaluate, exact_sum, to_long
from plumbago.plans.ir import SPARK, Agg, Catalog, Col, Query, Scan

WEIGHT = "__w"
Tables = dict[str, DataFrame]


def consolidated(rows: DataFrame) -> DataFrame:
    """One row for each distinct row, with its summed weight; none of weight zero."""
    names = [c for c in rows.columns if c != WEIGHT]
    return rows.groupBy(*names).agg(F.sum(WEIGHT).alias(WEIGHT)).where(F.col(WEIGHT) != 0)


def negated(rows: DataFrame) -> DataFrame:
    return rows.withColumn(WEIGHT, -F.col(WEIGHT))


class Lowering:
    """The plan of one bound query."""

    def __init__(self, query: Query, catalog: Catalog, errors: str = "raise", weighted: bool = False):
        self.query, self.catalog, self.weighted, self.collect = query, catalog, weighted, errors == "collect"
        self.scans = query.scans()
        self.place = {(s.alias, f.name): f"c{i}_{j}" for i, s in enumerate(self.scans) for j, f in enumerate(catalog.tables[s.table])}
        self.errors: list[DataFrame] = []
        #: What an error counts where it is met: nothing in rows that stood before, less than nothing in groups that go.
        self.sign = 1

    def column(self, c: Col) -> Column:
        return F.col(self.place[c.table, c.name])

    def guard(self, rows: DataFrame, error: Column | None) -> DataFrame:
        """rows without those that raise."""
        if error is None:
            return rows
        if self.collect:
            if self.sign:
                weight = (F.col(WEIGHT) if WEIGHT in rows.columns else F.lit(1)).cast("long") * F.lit(self.sign)
                self.errors.append(rows.select(error.alias("error"), weight.alias(WEIGHT)).where("error is not null"))
            return rows.where(error.isNull())
        return rows.where(F.when(error.isNotNull(), F.raise_error(error).cast("boolean")).otherwise(True))

    def scan(self, s: Scan, tables: Tables) -> DataFrame:
        if s.table not in tables:
            raise Refused("UnknownTable", s.table)
        df, i = tables[s.table], self.scans.index(s)
        kinds = dict(df.dtypes)
        cols = []
        for j, f in enumerate(self.catalog.tables[s.table]):
            c = F.col(f"`{f.name}`")
            cols.append((c if kinds[f.name] == SPARK[f.type] else c.cast(SPARK[f.type])).alias(f"c{i}_{j}"))
        if self.weighted:
            cols.append((F.col(WEIGHT) if WEIGHT in kinds else F.lit(1)).cast("long").alias(WEIGHT))
        return df.select(*cols)

    def join(self, left: DataFrame, right: DataFrame, on: tuple) -> DataFrame:
        condition = reduce(lambda a, b: a & b, [self.column(a) == self.column(b) for a, b in on])
        if not self.weighted:
            return left.join(right, condition)
        product = F.try_multiply(F.col(WEIGHT), F.col("__v"))
        both = left.join(right.withColumnRenamed(WEIGHT, "__v"), condition).withColumn("__p", product).drop(WEIGHT, "__v")
        return self.guard(both, F.when(F.col("__p").isNull(), F.lit("JoinWeightOverflow"))).withColumnRenamed("__p", WEIGHT)

    def source(self, s: object, tables: Tables) -> DataFrame:
        if isinstance(s, Scan):
            return self.scan(s, tables)
        return self.join(self.source(s.left, tables), self.scan(s.right, tables), s.on)

    def error_table(self) -> DataFrame | None:
        """(error, __w) of all that was met so far; None if the query can't raise."""
        return consolidated(reduce(DataFrame.unionByName, self.errors)) if self.errors else None

    def source_change(self, s: object, before: Tables, change: Tables) -> DataFrame | None:
        """What a change of tables does to a source: a product rule with the tables as they were before."""
        if isinstance(s, Scan):
            return self.scan(s, change) if s.table in change else None
        left, right = self.source_change(s.left, before, change), self.source_change(s.right, before, change)
        terms = []
        if left is not None:
            terms.append(self.join(left, self.scan(s.right, before), s.on))
        if right is not None:
            terms.append(self.join(self.source(s.left, before), right, s.on))
        if left is not None and right is not None:
            terms.append(self.join(left, right, s.on))
        return reduce(DataFrame.unionByName, terms) if terms else None

    def filtered(self, rows: DataFrame) -> DataFrame:
        if self.query.where is None:
            return rows
        keep, error = evaluate(self.query.where, self.column)
        return self.guard(rows, error).where(keep)

    def grouped(self) -> bool:
        return self.query.grouped or any(isinstance(e, Agg) for _, e in self.query.select)

    def keyed(self, rows: DataFrame) -> DataFrame:
        """Group keys as k0..; arguments of aggregates as a0.. ."""
        q, out, errors = self.query, [], []
        for n, e in enumerate(q.keys):
            value, error = evaluate(e, self.column)
            out.append(value.alias(f"k{n}"))
            errors.append(error)
        for n, (_, e) in enumerate(q.select):
            if isinstance(e, Agg) and e.arg is not None:
                value, error = evaluate(e.arg, self.column)
                out.append(value.alias(f"a{n}"))
                errors.append(error)
        some = [e for e in errors if e is not None]
        kept = self.guard(rows, F.least(*some) if len(some) > 1 else some[0] if some else None)
        return kept.select(*out, *([WEIGHT] if self.weighted else []), *([] if out or self.weighted else [F.lit(1).alias("__one")]))

    def aggregate(self, rows: DataFrame) -> DataFrame:
        """One row a group, with output columns o0.. ."""
        q, w = self.query, F.col(WEIGHT) if self.weighted else None
        aggs, outs, errors = [], [], []
        for n, (_, e) in enumerate(q.select):
            a = F.col(f"a{n}")
            if not isinstance(e, Agg):
                outs.append(F.col(f"k{q.keys.index(e)}").alias(f"o{n}"))
            elif e.name == "COUNT":
                x = F.count(F.lit(1) if e.arg is None else a) if w is None else F.coalesce(F.sum(w if e.arg is None else F.when(a.isNotNull(), w)), F.lit(0))
                aggs.append(x.cast("long").alias(f"g{n}"))
                outs.append(F.col(f"g{n}").alias(f"o{n}"))
            elif e.name in ("MIN", "MAX"):
                aggs.append((F.min if e.name == "MIN" else F.max)(a).alias(f"g{n}"))
                outs.append(F.col(f"g{n}").alias(f"o{n}"))
            else:
                total, count = exact_sum(a, w)
                aggs += [total.alias(f"g{n}"), count.alias(f"h{n}")]
                value, error = to_long(F.col(f"g{n}"))
                errors.append(error)
                if e.name == "AVG":
                    value = F.when(F.col(f"h{n}") > 0, value.cast("double") / F.col(f"h{n}").cast("double"))
                outs.append(value.alias(f"o{n}"))
        keys = [f"k{n}" for n in range(len(q.keys))]
        grouped = rows.groupBy(*keys).agg(*aggs) if aggs else rows.select(*keys).distinct()
        some = [e for e in errors if e is not None]
        return self.guard(grouped, F.least(*some) if len(some) > 1 else some[0] if some else None).select(*outs)

    def projected(self, rows: DataFrame) -> DataFrame:
        pairs = [evaluate(e, self.column) for _, e in self.query.select]
        some = [e for _, e in pairs if e is not None]
        kept = self.guard(rows, F.least(*some) if len(some) > 1 else some[0] if some else None)
        return kept.select(*[v.alias(f"o{n}") for n, (v, _) in enumerate(pairs)], *([WEIGHT] if self.weighted else []))

    def having(self, rows: DataFrame) -> DataFrame:
        if self.query.having is None:
            return rows
        at = {name: n for n, (name, _) in enumerate(self.query.select)}
        keep, error = evaluate(self.query.having, lambda c: F.col(f"o{at[c.name]}"))
        return self.guard(rows, error).where(keep)

    def groups(self, keyed: DataFrame) -> DataFrame:
        """Output rows of a grouped query; each has weight one."""
        rows = self.having(self.aggregate(keyed))
        rows = rows.distinct() if self.query.distinct else rows
        return rows.withColumn(WEIGHT, F.lit(1).cast("long")) if self.weighted else rows

    def named(self, rows: DataFrame) -> DataFrame:
        names = [name for name, _ in self.query.select]
        return rows.toDF(*names, *([WEIGHT] if self.weighted else []))

    def answer(self, tables: Tables) -> DataFrame:
        """The answer over whole tables, whose weights are positive."""
        rows = self.filtered(self.source(self.query.source, tables))
        if self.grouped():
            return self.named(self.groups(self.keyed(rows)))
        rows = self.projected(rows)
        if self.query.distinct:
            rows = rows.select(*[f"o{n}" for n in range(len(self.query.select))]).distinct()
            rows = rows.withColumn(WEIGHT, F.lit(1).cast("long")) if self.weighted else rows
        elif self.weighted:
            rows = consolidated(rows)
        return self.named(rows)

    def change(self, before: Tables, change: Tables) -> DataFrame | None:
        """The change of the answer, from a consolidated change of the tables; None if nothing can change.

        Groups and distinct rows that the change touches are computed anew,
        before and after; all others are neither read nor shuffled beyond the
        semi-join that leaves them out.
        """
        if not self.weighted:
            raise ValueError("changes need weights")
        delta = self.source_change(self.query.source, before, change)
        if delta is None:
            return None
        rows = self.filtered(delta)
        if not self.grouped() and not self.query.distinct:
            return self.named(consolidated(self.projected(rows)))
        make = self.keyed if self.grouped() else self.projected
        self.sign = 0
        old = self.filtered(self.source(self.query.source, before))
        keys = [f"k{n}" for n in range(len(self.query.keys))] if self.grouped() else [f"o{n}" for n in range(len(self.query.select))]
        old = make(old)
        self.sign = 1
        delta = make(rows)
        if keys:
            touched = delta.select(*[F.col(k).alias(f"t_{k}") for k in keys]).distinct()
            old = old.join(touched, reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"t_{k}")) for k in keys]), "left_semi")
        new = consolidated(old.unionByName(delta))
        if self.grouped():
            come = self.groups(new)
            self.sign = -1
            gone = self.groups(old)
            self.sign = 1
        else:
            gone, come = (x.select(*keys).distinct().withColumn(WEIGHT, F.lit(1).cast("long")) for x in (old, new))
        return self.named(consolidated(come.unionByName(negated(gone))))


def one_shot(query: Query, catalog: Catalog, tables: Tables) -> DataFrame:
    """The answer of a query over tables as they are."""
    return Lowering(query, catalog).answer(tables)
