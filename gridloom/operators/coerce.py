"""Cells as values of a column's kind, and the values that such a cast would lose."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.kinds import SPARK, kind_of

#: Fixed value: texts that are true; all other texts are false.
TRUE_WORDS = ("true", "yes", "y", "t", "1")


def coerced(c: Column, source: str, kind: str) -> Column:
    """c, of kind source, as kind: null where blank or where it can't be one.

    Booleans are 0 and 1 as numbers, numbers are cut to integers and are true unless 0, a date is a text's first ten
    characters, and a date is midnight of its day.
    """
    if source == "null":
        return F.lit(None).cast(SPARK[kind])
    if source == "text":
        s = F.trim(c)
        c = F.when(s != "", s)
    if kind == source:
        return c
    if kind == "text":
        return c.cast("string")
    if kind in ("integer", "float"):
        if source == "boolean":
            return c.cast("int").cast(SPARK[kind])
        if source in ("date", "datetime"):
            return F.lit(None).cast(SPARK[kind])
        d = c.try_cast("double")
        whole = F.when(~F.isnan(d), F.when(d >= 0, F.floor(d)).otherwise(F.ceil(d))).try_cast("bigint")
        return d if kind == "float" else F.coalesce(c.try_cast("bigint"), whole) if source == "text" else whole
    if kind == "boolean":
        number = c.try_cast("double") if source in ("text", "integer", "float") else F.lit(None).cast("double")
        return F.when(c.isNotNull(), F.coalesce(number != 0, F.lower(c.cast("string")).isin(*TRUE_WORDS)))
    day = F.substring(c.cast("string"), 1, 10) if kind == "date" else c.cast("string")
    return day.try_cast(SPARK[kind])


def typed(df: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """The columns of kinds, each of its kind."""
    return df.select(*[coerced(F.col(f"`{c}`"), kind_of(df.schema[c].dataType), k).alias(c) for c, k in kinds.items()])


def lost(df: DataFrame, kinds: dict[str, str]) -> dict[str, int]:
    """For each column that loses values, how many. A table with any isn't loaded. One scan."""
    counts = []
    for c, k in kinds.items():
        source = kind_of(df.schema[c].dataType)
        value = coerced(F.col(f"`{c}`"), source, source if source != "null" else "text")
        counts.append(F.count_if(value.isNotNull() & coerced(F.col(f"`{c}`"), source, k).isNull()).alias(c))
    return {c: n for c, n in (df.agg(*counts).first().asDict() if counts else {}).items() if n}
