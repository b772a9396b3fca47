"""Expressions that report errors as data: a value Column and an error Column.

An error Column holds the least message that an expression raises on a row, or
null. Both operands of AND and OR are evaluated for errors; CASE evaluates the
branches up to the one it takes. A raising expression has the value null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbago.plans.ir import SPARK, Case, Col, Lit, Op

LEAST_LONG, MOST_LONG = -(1 << 63), (1 << 63) - 1
DIVISION, OVERFLOW = "DivisionByZero: {}", "ArithmeticOverflow: {}"


def literal(e: Lit) -> Column:
    return F.lit(e.value).cast(SPARK[e.type])


def first_error(*errors: Column | None) -> Column | None:
    some = [e for e in errors if e is not None]
    return F.least(*some) if len(some) > 1 else some[0] if some else None


def _raise(when: Column, message: str) -> Column:
    return F.when(when, F.lit(message))


def _arithmetic(op: str, a: Column, b: Column) -> tuple[Column, Column]:
    known = a.isNotNull() & b.isNotNull()
    if op in "+-*":
        value = {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply}[op](a, b)
        return value, _raise(known & value.isNull(), OVERFLOW.format(op))
    # try_subtract(0, 1) and the like stay null; only the guarded branch is computed.
    over = (a == F.lit(LEAST_LONG)) & (b == F.lit(-1))
    safe = F.when((b != 0) & ~over, b)
    value = F.call_function("div", a, safe) if op == "/" else a % safe
    error = F.when(b == 0, F.when(a.isNotNull(), F.lit(DIVISION.format(op)))).when(over, F.lit(OVERFLOW.format(op)))
    return value, error


def evaluate(e: object, column) -> tuple[Column, Column | None]:
    """(value, error) of a bound expression; column(Col) gives a column's value."""
    if isinstance(e, Col):
        return column(e), None
    if isinstance(e, Lit):
        return literal(e), None
    if isinstance(e, Case):
        return _case(e, column)
    values, errors = zip(*(evaluate(a, column) for a in e.args))
    error = first_error(*errors)
    if e.name in ("+", "-", "*", "/", "%"):
        value, own = _arithmetic(e.name, *values)
        return value, first_error(error, own)
    a, b = values[0], values[-1]
    value = {
        "=": lambda: a == b,
        "<>": lambda: a != b,
        "<": lambda: a < b,
        "<=": lambda: a <= b,
        ">": lambda: a > b,
        ">=": lambda: a >= b,
        "AND": lambda: a & b,
        "OR": lambda: a | b,
        "NOT": lambda: ~a,
        "IS NULL": lambda: a.isNull(),
        "IS NOT NULL": lambda: a.isNotNull(),
    }[e.name]()
    return (value if error is None else F.when(error.isNull(), value)), error


def _case(e: Case, column) -> tuple[Column, Column | None]:
    value, error = evaluate(e.otherwise, column)
    raises = error is not None
    error = error if raises else F.lit(None).cast("string")
    for cond, then in reversed(e.whens):
        (c, c_error), (t, t_error) = evaluate(cond, column), evaluate(then, column)
        raises = raises or c_error is not None or t_error is not None
        value = F.when(c, t).otherwise(value)
        error = F.when(c, t_error if t_error is not None else F.lit(None).cast("string")).otherwise(error)
        if c_error is not None:
            value, error = F.when(c_error.isNull(), value), F.when(c_error.isNotNull(), c_error).otherwise(error)
    return value, error if raises else None


def exact_sum(x: Column, weight: Column | None) -> tuple[Column, Column]:
    """Sum of a BIGINT column, times a weight if there is one: (sum as decimal(38,0), number of values), exact in any order.

    Without weights three sums of parts of x stay in long arithmetic; they are
    exact up to 2^41 rows a group.
    """
    wide = "decimal(38,0)"
    if weight is None:
        low, mid = x.bitwiseAND(F.lit((1 << 22) - 1)), F.shiftright(x, 22).bitwiseAND(F.lit((1 << 22) - 1))
        parts = [F.sum(F.shiftright(x, 44)), F.sum(mid), F.sum(low)]
        total = (parts[0].cast("decimal(20,0)") * F.lit(1 << 44).cast("decimal(15,0)")).cast(wide) + (parts[1].cast("decimal(20,0)") * F.lit(1 << 22).cast("decimal(8,0)")).cast(wide) + parts[2].cast(wide)
        return total.cast(wide), F.count(x)
    product = (x.cast("decimal(19,0)") * weight.cast("decimal(19,0)")).cast(wide)
    return F.sum(product).cast(wide), F.sum(F.when(x.isNotNull(), weight))


def to_long(total: Column) -> tuple[Column, Column]:
    """A wide sum as BIGINT, and the error where it doesn't fit."""
    fits = total.between(F.lit(LEAST_LONG).cast("decimal(38,0)"), F.lit(MOST_LONG).cast("decimal(38,0)"))
    return F.when(fits, total).cast("long"), F.when(~fits, F.lit("AggregateOverflow: SUM"))
