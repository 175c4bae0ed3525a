"""Join steps that formulas lower to. Each adds hidden columns to a frame and never changes its number of rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from gridloom.functions.kinds import as_kind, comparable, kind_of, number

#: Quantiles that a running aggregate is dealt by; its tasks grow in number with the session's shuffle partitions.
MAX_RANGES = 256


def column_kind(df: DataFrame, name: str) -> str:
    return kind_of(df.schema[name].dataType)


@dataclass
class Lookup:
    """First row of right, by order, whose key equals the value; unmatched rows get nulls. Lookups of one key share the step.

    One row of right is left for each key, whether its keys are known to be unique or not, so rows never multiply.
    """

    key: tuple[Column, str]
    right_key: str
    order: list[str]
    returns: dict[str, str] = field(default_factory=dict)  # returned column: hidden column

    def apply(self, df: DataFrame, right: DataFrame, measure: bool = True, base: DataFrame | None = None) -> DataFrame:
        left, other = comparable(self.key, (F.col(self.right_key), column_kind(right, self.right_key)))
        values = F.struct(*[F.col(c).alias(h) for c, h in self.returns.items()])
        slim = right.where(F.col(self.right_key).isNotNull()).select(other.alias("__rk"), values.alias("__rv"), F.struct(*self.order).alias("__ro"))
        slim = slim.groupBy("__rk").agg(F.min_by("__rv", "__ro").alias("__rv"))
        joined = df.withColumn("__lk", left).join(slim, F.col("__lk") == F.col("__rk"), "left")
        return joined.select(*df.columns, *[F.col(f"__rv.{h}").alias(h) for h in self.returns.values()])


@dataclass(frozen=True)
class Criterion:
    column: str
    op: str  # = <> < > <= >= like
    literal: object = None
    value: int | None = None  # place in Aggregate.values, for criteria that differ by row


@dataclass
class Aggregate:
    """Conditional aggregates of one table under the same criteria share the step: filter first, group once, join back."""

    criteria: list[Criterion]
    values: list[tuple[Column, str]]
    measures: dict[tuple[str, str | None], str] = field(default_factory=dict)  # (function, column): hidden column
    #: Quantiles by compared column, shared by the steps over one table under the same fixed criteria.
    quantiles: dict[tuple, list[float]] = field(default_factory=dict)

    def apply(self, df: DataFrame, right: DataFrame, measure: bool = True, base: DataFrame | None = None) -> DataFrame:
        """measure: whether to look at the data for quantiles; without it no job is run, and the plan is good for its columns only.

        base: df as it was before the steps that were applied to it.
        """
        for c in self.criteria:
            if c.value is None:
                right = right.where(static(right, c))
        moving = [c for c in self.criteria if c.value is not None]
        sides = [comparable(self.values[c.value], (F.col(c.column), column_kind(right, c.column))) for c in moving]
        keys = [f"__k{i}" for i in range(len(moving))]
        slim = right.select(*[b.alias(k) for (_, b), k in zip(sides, keys, strict=True)], *[measured(right, col).alias(f"__m{i}") for i, (_, col) in enumerate(self.measures)])
        left = df.withColumns({k: a for (a, _), k in zip(sides, keys, strict=True)}) if keys else df
        ops = [c.op for c in moving]
        if not keys:
            found = slim.agg(*self._aggregates())
            joined = left.join(F.broadcast(found))  # one row
        elif set(ops) == {"="}:
            found = slim.groupBy(*keys).agg(*self._aggregates())
            joined = self._join(left, found, keys)
        else:
            wanted = asked(df if base is None else base, df, [a.alias(k) for (a, _), k in zip(sides, keys, strict=True)]).distinct()
            uneven = [i for i, op in enumerate(ops) if op != "="]
            if [ops[i] for i in uneven] == ["<>"]:
                found = self._unequal(wanted, slim, keys, uneven[0])
            else:
                found = self._boxed(wanted, slim, moving, keys, measure)
            joined = self._join(left, found, keys)
        return joined.select(*df.columns, *[self._final(f, F.col(h)).alias(h) for (f, _), h in self.measures.items()])

    def _aggregates(self) -> list[Column]:
        call = {"SUM": F.sum, "COUNT": lambda c: F.count("*"), "COUNTA": F.count, "AVERAGE": F.avg, "MIN": F.min, "MAX": F.max}
        return [call[f](f"__m{i}").alias(h) for i, ((f, _), h) in enumerate(self.measures.items())]

    @staticmethod
    def _final(f: str, value: Column) -> Column:
        return F.coalesce(value, F.lit(0)) if f in ("SUM", "COUNT", "COUNTA") else value

    @staticmethod
    def _join(left: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
        found = found.withColumnsRenamed({k: f"{k}r" for k in keys})
        return left.join(found, reduce(lambda a, b: a & b, [F.col(k) == F.col(f"{k}r") for k in keys]), "left")

    def _partials(self, slim: DataFrame, keys: list[str], every: bool = True) -> tuple[DataFrame, dict]:
        """slim grouped by keys: __n rows, and of measure i the sum __s, count __n, least __lo and greatest __hi; and how each is added up. every: also those that no measure needs."""
        parts = {"s": F.sum, "n": F.count, "lo": F.min, "hi": F.max}
        needed = [(p, i) for i, (f, _) in enumerate(self.measures) for p in parts if every or p in {"COUNT": [], "COUNTA": ["n"], "MIN": ["lo"], "MAX": ["hi"]}.get(f, ["s", "n"])]
        summed = lambda i: F.col(f"__m{i}") if isinstance(slim.schema[f"__m{i}"].dataType, NumericType) else F.lit(None).cast("double")
        grouped = slim.groupBy(*keys).agg(F.count("*").alias("__n"), *[parts[p](summed(i) if p == "s" else f"__m{i}").alias(f"__{p}{i}") for p, i in needed])
        return grouped, {"__n": F.sum} | {f"__{p}{i}": {"s": F.sum, "n": F.sum, "lo": F.min, "hi": F.max}[p] for p, i in needed}

    def _unequal(self, wanted: DataFrame, slim: DataFrame, keys: list[str], at: int) -> DataFrame:
        """One <>: of a group, all rows less those of the equal value. Extremes are those of the best value, or of the next best where that is the one left out."""
        by, equal = keys[at], [k for i, k in enumerate(keys) if i != at]
        grouped, combine = self._partials(slim.where(F.col(by).isNotNull()), keys)
        ends = {f"__{p}{i}": (F.min if p == "lo" else F.max) for i in range(len(self.measures)) for p in ("lo", "hi")}
        pair = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.col(c).alias("v"), F.col(by).alias("k")))
        whole = grouped.groupBy(*equal).agg(*[F.sum(t).alias(f"{t}_a") for t in combine if t not in ends], *[f(pair(c)).alias(f"{c}_a") for c, f in ends.items()])
        on = lambda a, b: reduce(lambda x, y: x & y, [a[k].eqNullSafe(b[f"{k}_w"]) for k in equal]) if equal else None
        named = whole.withColumnsRenamed({k: f"{k}_w" for k in equal})
        side = named if equal else F.broadcast(named)  # else one row
        best = (grouped.join(side, on(grouped, named)) if equal else grouped.join(side)).select(*[grouped[k] for k in keys], *combine, *[f"{c}_a" for c in ends])
        second = best.groupBy(*equal).agg(*[f(F.when(F.col(by) != F.col(f"{c}_a.k"), F.col(c))).alias(f"{c}_b") for c, f in ends.items()])
        whole = whole.join(second, equal) if equal else whole.join(F.broadcast(second))  # one row
        named = whole.withColumnsRenamed({k: f"{k}_w" for k in equal})
        asked = wanted.where(F.col(by).isNotNull())
        met = asked.join(named, on(asked, named)) if equal else asked.join(F.broadcast(named))  # one row
        own = grouped.select(*[F.col(k).alias(f"{k}_o") for k in keys], *[t for t in combine if t not in ends])
        met = met.join(own, reduce(lambda a, b: a & b, [F.col(k) == F.col(f"{k}_o") for k in keys]), "left")
        left = lambda t: F.col(f"{t}_a") - F.coalesce(F.col(t), F.lit(0))
        end = lambda c: F.when(F.col(f"{c}_a.k") != F.col(by), F.col(f"{c}_a.v")).otherwise(F.col(f"{c}_b"))
        out = []
        for i, ((f, _), h) in enumerate(self.measures.items()):
            n, total = left(f"__n{i}"), F.coalesce(F.col(f"__s{i}_a"), F.lit(0)) - F.coalesce(F.col(f"__s{i}"), F.lit(0))
            out.append({"COUNT": left("__n"), "COUNTA": n, "SUM": F.when(n > 0, total), "AVERAGE": F.try_divide(total.cast("double"), n), "MIN": end(f"__lo{i}"), "MAX": end(f"__hi{i}")}[f].alias(h))
        return met.select(*keys, *out)

    def _boxed(self, wanted: DataFrame, slim: DataFrame, moving: list[Criterion], keys: list[str], measure: bool) -> DataFrame:
        """Several inequalities: bounds become ranks of the columns' distinct values, a range of ranks the blocks of 1, 8, 64, ... ranks it is made of.

        Rows are grouped by their block of each size, so what a criterion asks for are equal keys: up to 14 blocks of a size for
        each column. Blocks over FINE levels are made of those below, which are fewer where other columns have few values. Nothing
        is subtracted, so sums of a few rows lose no digits and extremes work alike. A <> leaves two ranges. What is read more
        than once (groups, ranks, what is asked for) is kept, so the table is read once and the plan doesn't double with each column.
        Under equal keys, groups of up to FEW rows (of distinct compared values) are met row by row instead, all at once where no
        group has more rows. One column that has a
        single bound, that of most values, needs no blocks: it is the order of running totals within the others' blocks.
        """
        equal = [k for k, c in zip(keys, moving, strict=True) if c.op == "="]
        dims: dict[tuple[str, str], list[int]] = {}
        for i, (k, c) in enumerate(zip(keys, moving, strict=True)):
            if c.op != "=":
                dims.setdefault((c.column, slim.schema[k].dataType.simpleString()), []).append(i)
        own = {d: keys[at[0]] for d, at in dims.items()}
        wanted, slim = wanted.dropna(subset=keys), slim.dropna(subset=[*equal, *own.values()])
        if equal and measure and all_within(slim, equal, FEW):
            named = slim.withColumnsRenamed({k: f"{k}_w" for k in [*equal, *own.values()]})
            tests = [COMPARED[moving[i].op](F.col(f"{own[d]}_w"), F.col(keys[i])) for d, at in dims.items() for i in at]
            met = wanted.join(named.drop(*[k for k in keys if k not in own.values() and k not in equal]), reduce(lambda a, b: a & b, [*[F.col(k) == F.col(f"{k}_w") for k in equal], *tests]))
            return self._partials(met, keys, every=False)[0].select(*keys, *self._results())
        cells, combine = self._partials(slim, [*equal, *own.values()], every=False)
        cells, wanted = kept(cells, measure), kept(wanted, measure)
        total = lambda met: met.groupBy(*keys).agg(*[f(c).alias(c) for c, f in combine.items()])
        asks, few = wanted, None
        if equal:
            named = lambda df, end: df.withColumnsRenamed({k: f"{k}{end}" for k in equal})
            on = lambda end: reduce(lambda a, b: a & b, [F.col(k) == F.col(f"{k}{end}") for k in equal])
            sizes = kept(named(cells.groupBy(*equal).agg(F.count("*").alias("__size")), "g"), measure)
            sized = cells.join(sizes, on("g")).select(*cells.columns, "__size")
            one = named(sized.where(F.col("__size") <= FEW).drop("__size").withColumnsRenamed({x: f"{x}_x" for x in own.values()}), "_w")
            tests = [COMPARED[c.op](F.col(f"{own[d]}_x"), F.col(keys[i])) for d, at in dims.items() for i in at for c in (moving[i],)]
            few = total(wanted.join(one, reduce(lambda a, b: a & b, tests, on("_w"))))
            large = sizes.where(F.col("__size") > FEW)
            cells = sized.where(F.col("__size") > FEW).drop("__size")
            asks = wanted.join(large, on("g"), "left_semi")
        single = [d for d, at in dims.items() if len(at) == 1 and moving[at[0]].op != "<>"]
        last = max(single, key=lambda d: self._distinct(cells, own[d], d[0], measure)) if single and len(dims) > 1 else None
        dims = {d: at for d, at in dims.items() if d != last} | ({last: dims[last]} if last else {})
        points, compared = asks, cells
        for j, ((column, _), at) in enumerate(dims.items()):
            x = keys[at[0]]
            values = reduce(DataFrame.unionByName, [points.select(F.col(keys[i]).alias("__x"), F.lit(0).alias("__c")) for i in at], compared.select(F.col(x).alias("__x"), F.lit(1).alias("__c")))
            ranks = kept(ranked(values, quantiles(self.quantiles, compared, x, column, measure)), measure)
            cells = cells.join(ranks.select(F.col("__x").alias(f"__x{j}"), F.col("__before").alias(f"__r{j}"), F.col("__all").alias(f"__n{j}_all")), F.col(x) == F.col(f"__x{j}")).drop(f"__x{j}", x)
            for i in at:
                asks = asks.join(ranks.select(F.col("__x").alias(f"__x{j}"), F.col("__before").alias(f"__b{i}"), F.col("__there").alias(f"__t{i}"), F.col("__all").alias(f"__n{j}_{i}")), F.col(keys[i]) == F.col(f"__x{j}")).drop(f"__x{j}")
        cells, asks = kept(cells, measure), kept(asks, measure)
        for j, ((column, kind), at) in enumerate(dims.items()):
            if (column, kind) == last:
                break
            cells = in_blocks(cells, j, combine)
            asks = asks.withColumn("__spans", F.array(F.struct(F.lit(0).cast("long").alias("lo"), F.col(f"__n{j}_{at[0]}").alias("hi"))))
            for i in at:
                before, after = F.col(f"__b{i}"), F.col(f"__b{i}") + F.col(f"__t{i}")
                upper = {"<": before, "<=": after, "<>": before}.get(moving[i].op)
                lower = {">=": before, ">": after, "<>": after}.get(moving[i].op)
                parts = [(a, b) for a, b in ((None, upper), (lower, None)) if a is not None or b is not None]
                asks = asks.withColumn("__spans", F.flatten(F.transform("__spans", _cutter(parts))))
            asks = asks.withColumn("__span", F.explode("__spans")).withColumn("__block", F.explode(F.expr(blocks("__span.lo", "__span.hi", f"__n{j}_{at[0]}"))))
            asks = asks.drop("__spans", "__span", *[c for i in at for c in (f"__b{i}", f"__t{i}", f"__n{j}_{i}")]).withColumns({f"__l{j}": F.col("__block.level"), f"__o{j}": F.col("__block.node")}).drop("__block")
        asks = kept(asks, measure)
        on = [*equal, *[f"__{c}{j}" for j in range(len(dims) - (last is not None)) for c in "lo"]]
        if last is not None:
            met = self._running(asks, cells, moving[dims[last][0]].op, dims[last][0], len(dims) - 1, on, keys, combine)
            found = total(met) if few is None else total(met).unionByName(few)
            return found.select(*keys, *self._results())
        whole = cells.groupBy(*on).agg(*[f(c).alias(c) for c, f in combine.items()])
        met = asks.select(*keys, *[c for c in on if c not in keys]).join(whole.withColumnsRenamed({c: f"{c}_w" for c in on}), reduce(lambda a, b: a & b, [F.col(c) == F.col(f"{c}_w") for c in on]))
        found = total(met) if few is None else total(met).unionByName(few)
        return found.select(*keys, *self._results())

    def _results(self) -> list[Column]:
        return [of_parts(f, lambda part, i=i: F.col(f"__{part}{i}" if part != "rows" else "__n")).alias(h) for i, ((f, _), h) in enumerate(self.measures.items())]

    def _distinct(self, slim: DataFrame, by: str, column: str, measure: bool) -> int:
        """About how many values a compared column has, sketched once."""
        key = ("distinct", column)
        if key not in self.quantiles and measure:
            self.quantiles[key] = slim.agg(F.approx_count_distinct(by)).first()[0]
        return self.quantiles.get(key, 0)

    @staticmethod
    def _running(asks: DataFrame, cells: DataFrame, op: str, i: int, j: int, on: list[str], keys: list[str], combine: dict[str, Callable]) -> DataFrame:
        """For asks and cells of the same blocks (on): totals of the cells below, or from, the rank that an ask's bound i has in column j."""
        ranges = int(asks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        place = lambda r, n: F.floor(F.col(r) * ranges / F.col(n))
        down = op in (">", ">=")
        asks = asks.withColumn("__r", F.col(f"__b{i}") + (F.col(f"__t{i}") if op in ("<=", ">") else F.lit(0))).withColumn("__range", place("__r", f"__n{j}_{i}"))
        cells = cells.withColumn("__r", F.col(f"__r{j}")).withColumn("__range", place("__r", f"__n{j}_all")).select(*on, "__range", "__r", *combine)
        spot = [*on, "__range", "__r"]
        rows = cells.unionByName(asks.select(*spot).distinct().withColumn("__asked", F.lit(True)), allowMissingColumns=True)
        rows = rows.repartition(*on, "__range").groupBy(*spot).agg(F.max("__asked").alias("__asked"), *[g(c).alias(c) for c, g in combine.items()])
        turn = Column.desc if down else Column.asc
        inside = Window.partitionBy(*on, "__range").orderBy(turn(F.col("__r"))).rowsBetween(Window.unboundedPreceding, Window.currentRow if down else -1)
        ahead = Window.partitionBy(*on).orderBy(turn(F.col("__range"))).rowsBetween(Window.unboundedPreceding, -1)
        whole = rows.groupBy(*on, "__range").agg(F.max("__asked").alias("__some"), *[g(c).alias(c) for c, g in combine.items()]).select("__some", *[F.col(c).alias(f"{c}_w") for c in [*on, "__range"]], *[g(c).over(ahead).alias(f"{c}_b") for c, g in combine.items()]).where("__some")
        here = rows.select(*spot, "__asked", *[g(c).over(inside).alias(c) for c, g in combine.items()]).where("__asked").join(whole, reduce(lambda a, b: a & b, [F.col(c) == F.col(f"{c}_w") for c in [*on, "__range"]]))
        both = {c: F.coalesce(F.col(c) + F.col(f"{c}_b"), F.col(c), F.col(f"{c}_b")) if g is F.sum else (F.least if g is F.min else F.greatest)(c, f"{c}_b") for c, g in combine.items()}
        here = here.select(*[F.col(c).alias(f"{c}_h") for c in [*on, "__r"]], *[v.alias(c) for c, v in both.items()])
        return asks.select(*keys, *[c for c in [*on, "__r"] if c not in keys]).join(here, reduce(lambda a, b: a & b, [F.col(c) == F.col(f"{c}_h") for c in [*on, "__r"]]))

#: Rows of a group that criteria are compared with one by one, and that one task's window holds.
FEW, WHOLE = 256, 1 << 16
COMPARED = {"<>": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}
#: Bits of a rank by which blocks grow from one level to the next, and the levels that are made of the rows themselves.
BITS, FINE = 3, 3


def all_within(slim: DataFrame, equal: list[str], most: int) -> bool:
    """Whether no value of the equal keys has more rows."""
    return slim.groupBy(*equal).agg(F.count("*").alias("__size")).where(F.col("__size") > most).isEmpty()


def kept(df: DataFrame, measure: bool) -> DataFrame:
    """What is read more than once, computed once: its rows stay with the executors for as long as the driver refers to them."""
    return df.localCheckpoint() if measure else df


def levels(n: str) -> str:
    """SQL: the greatest level of blocks over n ranks."""
    return f"int(ceil(log2({n}) / {BITS}))"


def blocks(lo: str, hi: str, n: str) -> str:
    """SQL: the blocks (level, node) that make up the ranks from lo to before hi, of n: of each level those that no block of the next one covers."""
    up = lambda level: f"shiftright({lo} + shiftleft(1L, {BITS} * ({level})) - 1, {BITS} * ({level}))"
    down = lambda level: f"shiftright({hi}, {BITS} * ({level}))"
    first, end, above, beyond = up("l"), down("l"), f"shiftleft({up('l + 1')}, {BITS})", f"shiftleft({down('l + 1')}, {BITS})"
    run = lambda a, b: f"if({a} < {b}, sequence({a}, {b} - 1), CAST(array() AS array<bigint>))"
    nodes = f"if({above} < {beyond}, concat({run(first, above)}, {run(beyond, end)}), {run(first, end)})"
    return f"flatten(transform(sequence(0, {levels(n)}), l -> transform({nodes}, o -> named_struct('level', l, 'node', o))))"


def in_blocks(cells: DataFrame, j: int, combine: dict[str, Callable]) -> DataFrame:
    """cells with their block of each level in column j (__l, __o) in place of the rank __r and the number of ranks __n_all. Coarse blocks are grouped before they are dealt to the levels above."""
    rank, n, level, node = f"__r{j}", f"__n{j}_all", f"__l{j}", f"__o{j}"
    fine = cells.withColumn(level, F.explode(F.expr(f"sequence(0, least({FINE - 1}, {levels(n)}))"))).withColumn(node, F.expr(f"shiftright({rank}, {BITS} * {level})"))
    coarse = cells.where(F.expr(f"{levels(n)} >= {FINE}")).withColumn(rank, F.expr(f"shiftright({rank}, {BITS * FINE})"))
    coarse = coarse.groupBy(*[c for c in cells.columns if c not in combine]).agg(*[f(c).alias(c) for c, f in combine.items()])
    coarse = coarse.withColumn(level, F.explode(F.expr(f"sequence({FINE}, {levels(n)})"))).withColumn(node, F.expr(f"shiftright({rank}, {BITS} * ({level} - {FINE}))"))
    return fine.unionByName(coarse).drop(rank, n)


def asked(base: DataFrame, df: DataFrame, values: list[Column]) -> DataFrame:
    """What rows ask for: from the rows before other steps, so their joins aren't planned again, unless the values come from such steps."""
    try:
        return base.select(*values)
    except AnalysisException:
        return df.select(*values)


def _cutter(parts: list[tuple[Column | None, Column | None]]) -> Callable[[Column], Column]:
    """Of a range its parts above the first and below the second of each pair."""
    return lambda s: F.array(*[F.struct((s["lo"] if a is None else F.greatest(s["lo"], a)).alias("lo"), (s["hi"] if b is None else F.least(s["hi"], b)).alias("hi")) for a, b in parts])


def of_parts(f: str, part: Callable[[str], Column]) -> Column:
    """An aggregate from its parts: rows, n (values), s (their sum), lo and hi."""
    if f == "COUNT":
        return part("rows")
    if f == "COUNTA":
        return part("n")
    if f in ("MIN", "MAX", "ANY"):
        return part({"MIN": "lo", "MAX": "hi", "ANY": "any"}[f])
    return F.when(part("n") > 0, part("s")) if f == "SUM" else F.try_divide(part("s").cast("double"), part("n"))


def quantiles(known: dict[tuple, list[float]], slim: DataFrame, by: str, column: str, measure: bool) -> list[float]:
    """Quantiles of the compared column, sketched from its rows once."""
    ranges = min(MAX_RANGES, int(slim.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    if ranges < 2 or not measure:
        return []
    key = (column, slim.schema[by].dataType.simpleString())
    if key not in known:
        found = slim.select(in_order(F.col(by), column_kind(slim, by)).alias("x")).approxQuantile("x", [i / ranges for i in range(1, ranges)], 0.005)
        known[key] = sorted(set(found))
    return known[key]


def range_of(c: Column, kind: str, edges: list[float]) -> Column:
    """Which of the ranges between the edges a value is in."""
    place = in_order(c, kind)
    return F.size(F.filter(F.array(*[F.lit(e) for e in edges]), lambda e: e <= place)) if edges else F.lit(0)


def ranked(values: DataFrame, edges: list[float]) -> DataFrame:
    """For each distinct __x: __before (how many lesser ones have a row with __c = 1), __there (whether it has, 0 or 1) and __all (how many have)."""
    rows = values.groupBy("__x").agg(F.max("__c").cast("long").alias("__there"))
    rows = rows.withColumn("__range", range_of(F.col("__x"), column_kind(rows, "__x"), edges))
    totals = rows.groupBy("__range").agg(F.sum("__there").alias("__t"))
    ahead, every = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    totals = totals.select(F.col("__range").alias("__ranged"), F.coalesce(F.sum("__t").over(ahead), F.lit(0)).alias("__ahead"), F.sum("__t").over(every).alias("__all"))  # a row for each range
    inside = Window.partitionBy("__range").orderBy("__x").rowsBetween(Window.unboundedPreceding, -1)
    here = rows.withColumn("__in", F.coalesce(F.sum("__there").over(inside), F.lit(0)))
    return here.join(totals, F.col("__range") == F.col("__ranged")).select("__x", (F.col("__in") + F.col("__ahead")).alias("__before"), "__there", "__all")


@dataclass
class Ordered:
    """Aggregates under bounds on one column, of which all that share the equal keys share the step: rows and bounds in one order, and
    running totals before and after each bound. Quantiles deal the order out, so no task has it all.

    Counts and sums of integers above a bound, or between two, are differences of totals. Sums of others are added up from
    their own end, so no digits are lost; between two bounds they are no concern of this step (see Aggregate).
    """

    fixed: list[Criterion]
    equal: list[tuple[str, tuple[Column, str]]]
    column: str
    bounds: dict[str, tuple[Column, str]] = field(default_factory=dict)
    #: (function, column, lower, upper), where a bound is None or an operator and a key of bounds: hidden column.
    measures: dict[tuple[str, str | None, tuple[str, str] | None, tuple[str, str] | None], str] = field(default_factory=dict)
    quantiles: dict[tuple, list[float]] = field(default_factory=dict)

    @staticmethod
    def exact(f: str, kind: str) -> bool:
        """Whether differences of totals lose nothing."""
        return f in ("COUNT", "COUNTA") or (f in ("SUM", "AVERAGE") and kind == "integer")

    def apply(self, df: DataFrame, right: DataFrame, measure: bool = True, base: DataFrame | None = None) -> DataFrame:
        for c in self.fixed:
            right = right.where(static(right, c))
        sides = [comparable(v, (F.col(c), column_kind(right, c))) for c, v in self.equal]
        equal = [f"__k{i}" for i in range(len(sides))]
        compared = [comparable(v, (F.col(self.column), column_kind(right, self.column))) for v in self.bounds.values()]
        columns = {c: i for i, c in enumerate(dict.fromkeys(c for _, c, _, _ in self.measures if c is not None))}
        slim = right.select(*[b.alias(k) for (_, b), k in zip(sides, equal, strict=True)], compared[0][1].alias("__by"), F.lit(1).cast("long").alias("__rows"), *[measured(right, c).alias(f"__m{i}") for c, i in columns.items()]).dropna(subset=[*equal, "__by"])
        left = df.withColumns({k: a for (a, _), k in zip(sides, equal, strict=True)} | {f"__b{j}": a for j, (a, _) in enumerate(compared)})
        source, own = df if base is None else base, [a.alias(k) for (a, _), k in zip(sides, equal, strict=True)]
        asks = reduce(DataFrame.unionByName, [asked(source, df, [*own, a.alias("__by")]) for a, _ in compared]).dropna().withColumn("__asked", F.lit(True))
        # Keys of few rows each are whole in their tasks: ranges would only make as many totals as there are rows.
        edges = [] if equal and measure and all_within(slim, equal, WHOLE) else quantiles(self.quantiles, slim, "__by", self.column, measure)
        # Parts by the way they are added up: from the least value on, or from the greatest.
        ways: dict[str, dict[str, Callable]] = {"up": {}, "down": {}}
        for f, c, lower, upper in self.measures:
            way = ways["up" if upper or self.exact(f, "integer" if c is None else column_kind(slim, f"__m{columns[c]}")) else "down"]
            i = "" if c is None else columns[c]
            way |= {"COUNT": {"rows": F.sum}, "COUNTA": {f"n{i}": F.sum}, "MIN": {f"lo{i}": F.min}, "MAX": {f"hi{i}": F.max}}.get(f, {f"n{i}": F.sum, f"s{i}": F.sum})
        parts = ways["up"] | ways["down"]
        of = {"rows": F.sum("__rows")} | {f"{p}{i}": g(f"__m{i}") for i in columns.values() for p, g in (("n", F.count), ("s", F.sum), ("lo", F.min), ("hi", F.max))}
        rows = slim.unionByName(asks, allowMissingColumns=True).groupBy(*equal, "__by").agg(F.max("__asked").alias("__asked"), *[of[p].alias(p) for p in parts])
        rows = rows.withColumn("__range", range_of(F.col("__by"), column_kind(rows, "__by"), edges))
        whole = rows.groupBy(*equal, "__range").agg(*[g(p).alias(p) for p, g in parts.items()])
        here, before = [F.col(c) for c in [*equal, "__by", "__range", "__asked", *parts]], [F.col(c).alias(f"{c}_w") for c in [*equal, "__range"]]
        for way, wanted in ways.items():
            turn = (lambda c: F.col(c).desc()) if way == "down" else (lambda c: F.col(c).asc())
            inside = Window.partitionBy(*equal, "__range").orderBy(turn("__by")).rowsBetween(Window.unboundedPreceding, -1)
            ahead = Window.partitionBy(*equal).orderBy(turn("__range")).rowsBetween(Window.unboundedPreceding, -1)
            here += [g(p).over(inside).alias(f"{p}_{way}") for p, g in wanted.items()]
            before += [g(p).over(ahead).alias(f"{p}_{way}_w") for p, g in wanted.items()]
        every = Window.partitionBy(*equal)
        before += [g(p).over(every).alias(f"{p}_all") for p, g in ways["up"].items() if g is F.sum]
        met = rows.select(*here).where("__asked").join(whole.select(*before), reduce(lambda a, b: a & b, [F.col(c) == F.col(f"{c}_w") for c in [*equal, "__range"]]))

        def joint(part: str, g: Callable, *columns: str) -> Column:
            return sum((F.coalesce(F.col(c), F.lit(0)) for c in columns[1:]), F.coalesce(F.col(columns[0]), F.lit(0))) if g is F.sum else (F.least if g is F.min else F.greatest)(*columns)

        found = []
        for way, wanted in ways.items():
            for p, g in wanted.items():
                found += [joint(p, g, f"{p}_{way}", f"{p}_{way}_w").alias(f"{p}_{way}_out"), joint(p, g, f"{p}_{way}", f"{p}_{way}_w", p).alias(f"{p}_{way}_in")]
        met = met.select(*equal, "__by", *found, *[F.coalesce(f"{p}_all", F.lit(0)).alias(f"{p}_all") for p, g in ways["up"].items() if g is F.sum])
        for j in range(len(compared)):
            side = met.withColumnsRenamed({c: f"{c}__{j}" for c in met.columns})
            left = left.join(side, reduce(lambda a, b: a & b, [F.col(k) == F.col(f"{k}__{j}") for k in equal], F.col(f"__b{j}") == F.col(f"__by__{j}")), "left")
        at = {b: j for j, b in enumerate(self.bounds)}

        def within(f: str, c: str | None, lower: tuple[str, str] | None, upper: tuple[str, str] | None) -> Column:
            def part(name: str) -> Column:
                p = name if c is None or name == "rows" else f"{name}{columns[c]}"
                below = lambda b, edge: F.col(f"{p}_up_{edge}__{at[b[1]]}")
                high = below(upper, "in" if upper[0] == "<=" else "out") if upper else None
                if lower is None:
                    return high
                if upper is None and p in ways["down"] and not self.exact(f, "integer" if c is None else column_kind(slim, f"__m{columns[c]}")):
                    return F.col(f"{p}_down_{'in' if lower[0] == '>=' else 'out'}__{at[lower[1]]}")
                low = below(lower, "in" if lower[0] == ">" else "out")
                # Bounds that have passed each other hold no rows: their counts are less than none.
                return (F.col(f"{p}_all__{at[lower[1]]}") if upper is None else high) - low

            n = part("rows" if f == "COUNT" else "n") if f not in ("MIN", "MAX") else None
            value = of_parts(f, part)
            return F.when(n > 0, value) if n is not None else value

        return left.select(*df.columns, *[Aggregate._final(f, within(f, c, lower, upper)).alias(h) for (f, c, lower, upper), h in self.measures.items()])


def in_order(c: Column, kind: str) -> Column:
    """A double that never falls as the value grows: days of dates and times, the first seven bytes of texts."""
    if kind in ("date", "datetime"):
        return F.datediff(c, F.lit("1970-01-01").cast("date")).cast("double")
    if kind in ("integer", "float", "boolean"):
        return c.cast("double")
    first = F.rpad(F.hex(F.substring(F.encode(c.cast("string"), "UTF-8"), 1, 7)), 14, "0")
    return F.conv(first, 16, 10).cast("double")


def measured(df: DataFrame, column: str | None) -> Column:
    if column is None:
        return F.lit(1)
    kind = column_kind(df, column)
    return number(F.col(column), kind) if kind in ("text", "boolean") else F.col(column)


def static(df: DataFrame, c: Criterion) -> Column:
    """A criterion with a literal, as a filter that reaches the scan."""
    own = (F.col(c.column), column_kind(df, c.column))
    if c.op == "like":
        return F.expr(f"`{c.column}` LIKE {sql_string(c.literal)} ESCAPE '\\\\'") if own[1] == "text" else F.call_function("like", as_kind(*own, "text"), F.lit(c.literal))
    kind = "boolean" if isinstance(c.literal, bool) else "float" if isinstance(c.literal, float) else "text"
    if kind == "float" and own[1] == "integer" and c.literal.is_integer():
        literal, kind = F.lit(int(c.literal)), "integer"
    elif kind == "text" and own[1] in ("date", "datetime"):
        literal, kind = F.lit(c.literal).try_cast("timestamp" if own[1] == "datetime" else "date"), own[1]
    else:
        literal = F.lit(c.literal)
    a, b = comparable(own, (literal, kind))
    return {"=": a == b, "<>": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[c.op]


def sql_string(s: object) -> str:
    return "'" + str(s).replace("\\", "\\\\").replace("'", "\\'") + "'"
