"""The six column kinds, and how values of different kinds meet. Spark's ANSI mode raises on bad casts; here they become null."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: kind: Spark type. null is the kind of a missing value.
SPARK = {"integer": "bigint", "float": "double", "boolean": "boolean", "date": "date", "datetime": "timestamp_ntz", "text": "string", "null": "void"}
NUMERIC = ("integer", "float")


class Unsupported(Exception):
    """A part of a formula that has no relational meaning here; it becomes null, with the reason as a note."""


def kind_of(t: T.DataType) -> str:
    if isinstance(t, T.IntegralType):
        return "integer"
    if isinstance(t, (T.FractionalType, T.DecimalType)):
        return "float"
    if isinstance(t, T.BooleanType):
        return "boolean"
    if isinstance(t, T.DateType):
        return "date"
    if isinstance(t, (T.TimestampType, T.TimestampNTZType)):
        return "datetime"
    return "null" if isinstance(t, T.NullType) else "text"


def as_kind(c: Column, kind: str, to: str) -> Column:
    if kind == to:
        return c
    if to == "text":
        return c.cast("string")
    if kind == "boolean" and to in NUMERIC:
        return c.cast("int").cast(SPARK[to])
    if kind in ("text", "null"):
        return c.cast("string").try_cast(SPARK[to])
    if kind in ("date", "datetime") and to in NUMERIC:
        return F.lit(None).cast(SPARK[to])
    return c.cast(SPARK[to])


def number(c: Column, kind: str) -> Column:
    return c if kind in NUMERIC else as_kind(c, kind, "float")


def common_kind(kinds: list[str]) -> str:
    """Same kinds stay; integers and floats are floats, dates and datetimes datetimes; all else is text."""
    found = set(kinds) - {"null"}
    if len(found) < 2:
        return found.pop() if found else "null"
    if found <= set(NUMERIC):
        return "float"
    return "datetime" if found <= {"date", "datetime"} else "text"


def unify(values: list[tuple[Column, str]]) -> tuple[list[Column], str]:
    to = common_kind([k for _, k in values])
    return [c if to == "null" else as_kind(c, k, to) for c, k in values], to


def comparable(left: tuple[Column, str], right: tuple[Column, str]) -> tuple[Column, Column]:
    """Both sides as numbers if one is a number, else of their common kind."""
    kinds = {left[1], right[1]}
    if kinds <= {*NUMERIC, "null"} or len(kinds) == 1:
        return left[0], right[0]
    if kinds & set(NUMERIC):
        return number(*left).cast("double"), number(*right).cast("double")
    (a, b), _ = unify([left, right])
    return a, b


def met_as(left: str, right: str) -> str:
    """The kind that comparable() makes of both sides; numbers of either kind meet as they are."""
    kinds = {left, right}
    if kinds <= {*NUMERIC, "null"}:
        return "number"
    return "float" if kinds & set(NUMERIC) and len(kinds) > 1 else common_kind([left, right])


def concat_text(values: list[tuple[Column, str]]) -> Column:
    return reduce(lambda a, b: F.concat(a, b), [as_kind(c, k, "text") for c, k in values])
