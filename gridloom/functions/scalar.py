"""Scalar spreadsheet functions as Spark columns: (arguments as (column, kind)) to (column, kind). Errors such as division by zero are null."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridloom.functions.kinds import Unsupported, as_kind, concat_text, number, unify

Value = tuple[Column, str]
Notes = list[str]
FUNCTIONS: dict[str, Callable[[list[Value], Notes], Value]] = {}


def function(*names: str, least: int = 1):
    def add(f):
        def checked(args: list[Value], notes: Notes, name: str) -> Value:
            if len(args) < least:
                raise Unsupported(f"{name} needs {least} arguments")
            return f(args, notes)

        for n in names:
            FUNCTIONS[n] = lambda a, notes, n=n: checked(a, notes, n)
        return f

    return add


def _text(v: Value) -> Column:
    return as_kind(*v, "text")


def _int(v: Value) -> Column:
    return number(*v).cast("int")


def _condition(v: Value) -> Column:
    return v[0] if v[1] == "boolean" else number(*v) != 0


@function("IF", least=2)
def _if(a, notes):
    (yes, no), kind = unify([a[1], a[2] if len(a) > 2 else (F.lit(None), "null")])
    return F.when(_condition(a[0]), yes).otherwise(no), kind


@function("IFS", least=2)
def _ifs(a, notes):
    values, kind = unify([a[i + 1] for i in range(0, len(a) - 1, 2)])
    out = F.lit(None)
    for i in range(len(values) - 1, -1, -1):
        out = F.when(_condition(a[2 * i]), values[i]).otherwise(out)
    return out, kind


@function("IFERROR", "IFNA")
def _iferror(a, notes):
    notes.append("errors are nulls: the first value that isn't null is taken")
    values, kind = unify(a)
    return F.coalesce(*values), kind


@function("AND")
def _and(a, notes):
    return reduce(lambda x, y: x & y, map(_condition, a)), "boolean"


@function("OR")
def _or(a, notes):
    return reduce(lambda x, y: x | y, map(_condition, a)), "boolean"


@function("NOT")
def _not(a, notes):
    return ~_condition(a[0]), "boolean"


@function("ISBLANK")
def _isblank(a, notes):
    return a[0][0].isNull(), "boolean"


def _scale(a: list[Value]) -> Column:
    return F.pow(F.lit(10.0), number(*a[1]) if len(a) > 1 else F.lit(0.0))


def _scaled(name: str, f: Callable[[Column], Column]):
    @function(name)
    def scaled(a, notes):
        x, s = number(*a[0]).cast("double"), _scale(a)
        return (f(x * s) / s).cast("double"), "float"


def away(x: Column) -> Column:
    """Nearest integer, halves away from zero."""
    return F.round(x, 0)


_scaled("ROUND", away)
_scaled("ROUNDUP", lambda x: F.ceil(x).cast("double"))
_scaled("ROUNDDOWN", lambda x: F.floor(x).cast("double"))


def _math(name: str, f: Callable[[Column], Column]):
    @function(name)
    def math(a, notes):
        return f(number(*a[0]).cast("double")), "float"


_math("INT", lambda x: F.floor(x).cast("double"))
_math("TRUNC", lambda x: F.when(x >= 0, F.floor(x)).otherwise(F.ceil(x)).cast("double"))
_math("SQRT", lambda x: F.when(x >= 0, F.sqrt(x)))


@function("ABS")
def _abs(a, notes):
    return F.abs(number(*a[0])), a[0][1] if a[0][1] == "integer" else "float"


@function("MOD", least=2)
def _mod(a, notes):
    return F.try_mod(number(*a[0]), number(*a[1])), "integer" if a[0][1] == a[1][1] == "integer" else "float"


@function("LEN")
def _len(a, notes):
    return F.length(_text(a[0])).cast("bigint"), "integer"


for _name, _f in (("UPPER", F.upper), ("LOWER", F.lower), ("TRIM", F.trim)):
    function(_name)(lambda a, notes, f=_f: (f(_text(a[0])), "text"))


@function("LEFT")
def _left(a, notes):
    return F.substring(_text(a[0]), F.lit(1), _int(a[1]) if len(a) > 1 else F.lit(1)), "text"


@function("RIGHT")
def _right(a, notes):
    return F.right(_text(a[0]), _int(a[1]) if len(a) > 1 else F.lit(1)), "text"


@function("MID", least=3)
def _mid(a, notes):
    return F.substring(_text(a[0]), _int(a[1]), _int(a[2])), "text"


@function("CONCATENATE", "CONCAT")
def _concat(a, notes):
    return concat_text(a), "text"


@function("TEXT")
def _as_text(a, notes):
    notes.append("TEXT: the format is left out")
    return _text(a[0]), "text"


@function("VALUE")
def _value(a, notes):
    return number(*a[0]).cast("double"), "float"


@function("SUBSTITUTE", least=3)
def _substitute(a, notes):
    if len(a) > 3:
        notes.append("SUBSTITUTE: all instances are replaced")
    return F.replace(_text(a[0]), _text(a[1]), _text(a[2])), "text"


@function("FIND", "SEARCH", least=2)
def _find(a, notes):
    return F.position(_text(a[0]), _text(a[1])).cast("bigint"), "integer"


@function("TODAY", least=0)
def _today(a, notes):
    return F.current_date(), "date"


@function("NOW", least=0)
def _now(a, notes):
    return F.localtimestamp(), "datetime"


for _name, _f in (("YEAR", F.year), ("MONTH", F.month), ("DAY", F.dayofmonth)):
    function(_name)(lambda a, notes, f=_f: (f(a[0][0].cast("date") if a[0][1] in ("date", "datetime") else _text(a[0]).try_cast("date")).cast("bigint"), "integer"))
