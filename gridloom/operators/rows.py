"""Formulas that read other rows of their own table: cells above and below, running, sliding and fixed ranges, balances.

Rows are numbered in their order without any one task seeing all of them: quantiles of the order deal it into ranges, each is
numbered by itself, and the counts of the ranges before are added. Running totals go the same way. What reads a few rows up or
down gets them by blocks of BLOCK row numbers: a block's window also has the rows beyond its ends that its formulas reach, handed
on from the neighbouring blocks. Sliding ranges of any width take two looks a row: what is left of the piece of that width in
which they begin, and what has been of the piece in which they end.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.operators.steps import MAX_RANGES, measured, of_parts

#: Rows of a block at least; a block is never shorter than the widest reach.
BLOCK = 1 << 16
#: Order values sampled for each range's edge.
SAMPLED = 64


@dataclass(frozen=True)
class Cell:
    """The value of a column so many rows below this one (above if negative)."""

    column: str
    offset: int


@dataclass(frozen=True)
class Stretch:
    """An aggregate over rows of one column: from and to are offsets from this row, or row numbers from 0 where fixed.

    A stretch between a fixed row (the first) and a moving one (the last) lies on either side of the fixed one.
    """

    f: str  # SUM, COUNTA, AVERAGE, MIN or MAX; ANY, for one fixed row, is its value
    column: str
    first: int
    last: int
    first_fixed: bool
    last_fixed: bool


@dataclass(frozen=True)
class Balance:
    """value(row) = factor * value(row above) + term; the row above the first one counts as 0. Both are columns that the step makes."""

    factor: str | None  # None: 1
    term: str


PARTS: dict[str, Callable] = {"n": F.sum, "s": F.sum, "lo": F.min, "hi": F.max, "any": F.max}


@dataclass
class Neighbours:
    """All reads of other rows that formulas of one table make at once."""

    order: list[str]
    wanted: dict[Cell | Stretch | Balance, str] = field(default_factory=dict)  # to the hidden column
    made: dict[str, Column] = field(default_factory=dict)  # columns that balances read
    edges: dict[tuple, list] = field(default_factory=dict)
    source: DataFrame | None = None  # the stored table, whose rows are those of df

    def apply(self, df: DataFrame, right: DataFrame, measure: bool = True, base: DataFrame | None = None) -> DataFrame:
        """Only df is read. measure: whether to look at the data for the edges of ranges."""
        columns = df.columns
        rows = numbered(df.withColumns(self.made) if self.made else df, self.order, "__i", self._edges(df, measure), self.source, measure)
        cells = {w: h for w, h in self.wanted.items() if isinstance(w, Cell)}
        slides = {w: h for w, h in self.wanted.items() if isinstance(w, Stretch) and not w.first_fixed}
        runs = {w: h for w, h in self.wanted.items() if isinstance(w, Stretch) and w not in slides}
        if runs:
            rows = self._running(rows, runs, measure)
        if balances := {w: h for w, h in self.wanted.items() if isinstance(w, Balance)}:
            rows = self._balances(rows, balances, measure)
        # Running totals end at this row; those that end some rows off are read from there.
        moved = {h: w.last for w, h in runs.items() if not w.last_fixed and w.last}
        if cells or slides or moved:
            rows = self._near(rows, cells, slides, moved)
        return rows.select(*columns, *self.wanted.values())

    def _edges(self, df: DataFrame, measure: bool) -> list:
        """Tuples of the order's columns, at the quantiles of a sample of them."""
        ranges = min(MAX_RANGES, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        key = tuple(self.order)
        if measure and ranges > 1 and key not in self.edges:
            sample = df.select(F.struct(*self.order).alias("o")).orderBy(F.rand(1)).limit(SAMPLED * ranges).orderBy("o").collect()
            self.edges[key] = [tuple(sample[len(sample) * i // ranges].o) for i in range(1, ranges)] if sample else []
        return self.edges.get(key, [])

    def _values(self, rows: DataFrame, w: Stretch) -> dict[str, Column]:
        v = measured(rows, w.column)
        number = v if rows.schema[w.column].dataType.typeName() not in ("date", "timestamp", "timestamp_ntz") else F.lit(None).cast("double")
        return {"n": v.isNotNull().cast("long"), "s": number, "lo": v, "hi": v, "any": F.col(w.column)}

    def _running(self, rows: DataFrame, runs: dict[Stretch, str], measure: bool) -> DataFrame:
        """Totals from a fixed row (or the first) to this one, from this one to a fixed row (or the last), or between fixed rows."""
        values, parts = {}, {}
        for j, w in enumerate(runs):
            i = F.col("__i")
            for way, inside in (("all", (i >= w.first) & (i <= w.last)),) if w.last_fixed else (("up", i >= w.first), ("down", i <= w.first)):
                for p in _parts(w.f):
                    values[f"__v{j}{way}{p}"], parts[f"__v{j}{way}{p}"] = F.when(inside, self._values(rows, w)[p]), (PARTS[p], way)
        rows = rows.withColumns(values)
        whole = gathered(rows.groupBy("__range").agg(*[g(c).alias(f"{c}_t") for c, (g, _) in parts.items()]), measure)
        turns = {"up": Column.asc, "down": Column.desc}
        ahead = {way: Window.orderBy(turn(F.col("__range"))).rowsBetween(Window.unboundedPreceding, -1) for way, turn in turns.items()} | {"all": Window.partitionBy()}
        beyond = [g(f"{c}_t").over(ahead[way]).alias(f"{c}_b") for c, (g, way) in parts.items()]
        rows = rows.join(F.broadcast(whole.select(F.col("__range").alias("__ranged"), *beyond)), F.col("__range") == F.col("__ranged")).drop("__ranged")  # a row for each range
        inside = {way: Window.partitionBy("__range").orderBy(turn(F.col("__i"))).rowsBetween(Window.unboundedPreceding, Window.currentRow) for way, turn in turns.items()}
        here = {f"{c}_x": F.col(f"{c}_b") if way == "all" else _joint(g, g(c).over(inside[way]), F.col(f"{c}_b")) for c, (g, way) in parts.items()}
        rows = rows.withColumns(here)
        out = {}
        for j, (w, h) in enumerate(runs.items()):
            told = {way: _finish(w.f, of_parts(w.f, lambda p, j=j, way=way: F.col(f"__v{j}{way}{p}_x"))) for way in (["all"] if w.last_fixed else ["up", "down"])}
            out[h] = told["all"] if w.last_fixed else F.when(F.col("__i") >= w.first, told["up"]).otherwise(told["down"])
        return rows.withColumns(out).drop(*parts, *[f"{c}_b" for c in parts], *here)

    def _balances(self, rows: DataFrame, balances: dict[Balance, str], measure: bool) -> DataFrame:
        for b, h in balances.items():
            rows = scan(rows, b, h, measure)
        return rows

    def _near(self, rows: DataFrame, cells: dict[Cell, str], slides: dict[Stretch, str], moved: dict[str, int]) -> DataFrame:
        """Everything that a window over a block and its neighbours' ends can tell."""
        reaches = [0, *[w.offset for w in cells], *[x for w in slides for x in (w.first, w.last)], *moved.values()]
        low, high = min(reaches), max(reaches)
        widths = [w.last - w.first + 1 for w in slides if w.last >= w.first]
        block = max([BLOCK, high - low + 1])
        rows = rows.withColumn("__own", F.floor(F.col("__i") / block))
        rows = rows.withColumn("__block", F.explode(F.sequence(F.greatest(F.floor((F.col("__i") - high) / block), F.lit(0)), F.floor((F.col("__i") - low) / block))))
        order = Window.partitionBy("__block").orderBy("__i")
        made = {}
        for j, w in enumerate(slides):
            for p in _parts(w.f):
                made[f"__v{j}{p}"] = self._values(rows, w)[p]
        rows = rows.withColumns(made)
        pieces = {}
        for j, (w, width) in enumerate((w, w.last - w.first + 1) for w in slides):
            if width < 1:
                continue
            rows = rows.withColumn(f"__p{j}", F.floor(F.col("__i") / width))
            for p in _parts(w.f):
                for side, turn in (("start", F.col("__i").asc()), ("rest", F.col("__i").desc())):
                    piece = Window.partitionBy("__block", f"__p{j}").orderBy(turn).rowsBetween(Window.unboundedPreceding, Window.currentRow)
                    pieces[f"__v{j}{p}_{side}"] = PARTS[p](f"__v{j}{p}").over(piece)
        rows = rows.withColumns(pieces) if pieces else rows
        out = {h: at(F.col(w.column), w.offset, order) for w, h in cells.items()}
        last = Window.partitionBy("__block").orderBy("__i").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        for h, k in moved.items():  # beyond the table's ends what is there goes on
            to = F.col("__i") + k
            out[h] = F.when(to < 0, F.first(h).over(last)).when(to > F.last("__i").over(last), F.last(h).over(last)).otherwise(at(F.col(h), k, order))
        for j, (w, h) in enumerate(slides.items()):
            width = w.last - w.first + 1
            if width < 1:
                out[h] = F.lit(0) if w.f in ("SUM", "COUNTA") else F.lit(None)
                continue
            begins, ends, end = F.floor((F.col("__i") + w.first) / width), F.floor((F.col("__i") + w.last) / width), F.last("__i").over(last)

            def part(p: str, j=j, w=w, begins=begins, ends=ends, end=end) -> Column:
                start = F.when(F.col("__i") + w.last <= end, at(F.col(f"__v{j}{p}_start"), w.last, order)).otherwise(F.when(F.last(f"__p{j}").over(last) == ends, F.last(f"__v{j}{p}_start").over(last)))
                rest = F.when(begins != ends, at(F.col(f"__v{j}{p}_rest"), w.first, order))
                return _joint(PARTS[p], start, rest)

            out[h] = _finish(w.f, of_parts(w.f, part))
        return rows.withColumns(out).where(F.col("__block") == F.col("__own"))


def _parts(f: str) -> list[str]:
    return {"SUM": ["n", "s"], "AVERAGE": ["n", "s"], "COUNTA": ["n"], "MIN": ["lo"], "MAX": ["hi"], "ANY": ["any"]}[f]


def _joint(g: Callable, a: Column, b: Column) -> Column:
    """Both parts, of which either may be missing."""
    if g is F.sum:
        return F.when(a.isNotNull() | b.isNotNull(), F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)))
    return (F.least if g is F.min else F.greatest)(a, b)


def _finish(f: str, value: Column) -> Column:
    return F.coalesce(value, F.lit(0)) if f in ("SUM", "COUNTA") else value


def at(c: Column, offset: int, order) -> Column:
    return F.lead(c, offset).over(order) if offset > 0 else F.lag(c, -offset).over(order) if offset < 0 else c


def gathered(few: DataFrame, measure: bool) -> DataFrame:
    """A row for each range or block, computed now, so that the plan that goes on reads what is before it once. Without measure no job is run."""
    return few.sparkSession.createDataFrame(few.collect(), few.schema) if measure else few


def numbered(df: DataFrame, order: list[str], name: str, edges: list, source: DataFrame | None = None, measure: bool = False) -> DataFrame:
    """Row numbers from 0 in order, and __range, the range between the edges (tuples of the order's values) that a row is in.

    Rows that the order can't tell apart have their numbers in any order.
    """
    kinds = [df.schema[c].dataType for c in order]
    place = F.struct(*[F.col(f"`{c}`").alias(f"o{i}") for i, c in enumerate(order)])
    tuples = [F.struct(*[F.lit(v).cast(k).alias(f"o{i}") for i, (v, k) in enumerate(zip(e, kinds, strict=True))]) for e in edges]
    within = F.size(F.filter(F.array(*tuples), lambda e: e <= place)) if tuples else F.lit(0)
    ranged = df.withColumn("__range", within)
    counts = gathered((ranged if source is None else source.withColumn("__range", within)).groupBy("__range").agg(F.count("*").alias("__n")), measure)
    ahead = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(F.col("__range").alias("__ranged"), F.coalesce(F.sum("__n").over(ahead), F.lit(0)).alias("__ahead"))  # a row for each range
    inside = F.row_number().over(Window.partitionBy("__range").orderBy(*[F.col(f"`{c}`").asc_nulls_first() for c in order])) - 1
    return ranged.withColumn("__in", inside).join(F.broadcast(counts), F.col("__range") == F.col("__ranged")).withColumn(name, F.col("__in") + F.col("__ahead")).drop("__in", "__ahead", "__ranged")


def scan(rows: DataFrame, b: Balance, into: str, measure: bool = True) -> DataFrame:
    """rows (numbered by __i) with the balance of each."""
    if b.factor is None:
        return Neighbours([])._running(rows, {Stretch("SUM", b.term, 0, 0, True, False): into}, measure)
    steps = rows.select(F.col("__i").alias("i"), F.coalesce(F.col(b.factor), F.lit(0)).cast("double").alias("a"), F.coalesce(F.col(b.term), F.lit(0)).cast("double").alias("c"))
    found = composed(steps, measure).select(F.col("i").alias("__at"), F.col("x").alias(into))
    return rows.join(found, F.col("__i") == F.col("__at")).drop("__at")


def composed(steps: DataFrame, measure: bool = True) -> DataFrame:
    """i and x(i) = a x(i - 1) + c for each row i, from x = 0 before the first.

    A block's steps are one step, a row for BLOCK; these, one after another, tell what each block begins with, and its rows follow in turn.
    """
    import pandas as pd

    def following(one: pd.DataFrame, x: float) -> list[float]:
        out = []
        for a, c in zip(one["a"].tolist(), one["c"].tolist(), strict=True):
            x = a * x + c if x else c
            out.append(x)
        return out

    def ends(one: pd.DataFrame) -> pd.DataFrame:
        one = one.sort_values("i")
        return pd.DataFrame({"block": one["block"].iloc[:1], "a": one["a"].prod(), "c": following(one, 0.0)[-1:]})

    def carried(all_ends: pd.DataFrame) -> pd.DataFrame:
        all_ends = all_ends.sort_values("block")
        return pd.DataFrame({"block": all_ends["block"] + 1, "carried": following(all_ends, 0.0)})

    def inside(one: pd.DataFrame) -> pd.DataFrame:
        one = one.sort_values("i")
        return pd.DataFrame({"i": one["i"], "x": following(one, float(one["carried"].iloc[0]))})

    dealt = steps.withColumn("block", F.floor(F.col("i") / BLOCK))
    ahead = gathered(dealt.groupBy("block").applyInPandas(ends, "block bigint, a double, c double").groupBy().applyInPandas(carried, "block bigint, carried double"), measure)
    return dealt.join(F.broadcast(ahead), "block", "left").fillna(0.0, ["carried"]).groupBy("block").applyInPandas(inside, "i bigint, x double")
