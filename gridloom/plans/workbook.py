"""A workbook of tables: formula columns are resolved, lowered to join steps and columns, and recomputed in dependency order.

Each table is a DataFrame whose columns have letters in their order; formula columns follow, in the order they are declared.
A formula of one row holds for all. By default cells of the own table mean this row, and row numbers and the bounds of ranges mean
nothing; a note says so where a formula's rows differ. A formula that is derived with its row is read as it stands: cells rows
above or below, ranges that run from a fixed row, slide or lie fixed, and its own cell above, by which it is a balance.
Parts that have no relational meaning become null with a note; the rest of the formula still works.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.kinds import Unsupported, as_kind, comparable, concat_text, kind_of, met_as, number, unify
from gridloom.functions.scalar import FUNCTIONS
from gridloom.operators.rows import Balance, Cell, Neighbours, Stretch
from gridloom.operators.steps import Aggregate, Criterion, Lookup, Ordered
from gridloom.plans.formula import Binary, Bool, Call, Empty, Node, Num, ParseError, Ref, Str, Unary, column_letters, parse, walk

DYNAMIC = ("INDIRECT", "OFFSET")
PLACE = ("ROW", "COLUMN")
LOOKUPS = ("VLOOKUP", "XLOOKUP", "INDEX")
CONDITIONAL = {"SUMIF": "SUM", "COUNTIF": "COUNT", "AVERAGEIF": "AVERAGE", "SUMIFS": "SUM", "COUNTIFS": "COUNT", "AVERAGEIFS": "AVERAGE", "MINIFS": "MIN", "MAXIFS": "MAX"}
RANGES = ("SUM", "AVERAGE", "MIN", "MAX", "COUNT")
Value = tuple[Column, str]
#: A sheet's last row, and the row number that stands for the end of a table.
LAST_ROW, END = 1 << 20, 1 << 60


@dataclass(frozen=True)
class Variant:
    """A formula that holds for the rows in which a stored column has a value; numbers of it (by place, from 0) that stored columns hold."""

    column: str
    value: int
    formula: str
    numbers: dict[int, str] = field(default_factory=dict, hash=False)


@dataclass
class FormulaColumn:
    formula: str
    #: Included columns keep their stored values, which other formulas read, and get a twin <name>_calc; others are the formula's.
    included: bool = False
    suffix: str = "_calc"
    #: The row of the sheet that the formula was read from; None if rows mean nothing.
    row: int | None = None
    #: Where not all rows have the same formula. Rows of none keep their stored value.
    variants: list[Variant] = field(default_factory=list)


@dataclass
class Table:
    name: str
    #: The stored columns, or what opens them when they are first read.
    source: DataFrame | Callable[[], DataFrame]
    first_by: list[str] | None
    file: str
    sheet: str
    formulas: dict[str, FormulaColumn] = field(default_factory=dict)
    books: list[str] = field(default_factory=list)
    #: The row of the sheet that the first row of the table stands in.
    first_row: int = 2
    dropped: set[str] = field(default_factory=set)

    @cached_property
    def df(self) -> DataFrame:
        return self.source() if callable(self.source) and not isinstance(self.source, DataFrame) else self.source

    @cached_property
    def columns(self) -> list[str]:
        return [*self.df.columns, *[c for c in self.formulas if c not in self.df.columns]]

    @property
    def order_by(self) -> list[str]:
        return self.first_by or list(self.df.columns)

    def output(self, column: str) -> str:
        f = self.formulas[column]
        return column + f.suffix if f.included else column


@dataclass
class Translation:
    table: str
    column: str
    formula: str
    output: str
    status: str = "ok"  # ok, partial or unsupported
    notes: list[str] = field(default_factory=list)
    depends_on: list[str] = field(default_factory=list)


@dataclass
class _Lowered:
    value: Value
    translation: Translation


#: By what makes steps the same: the table that a step reads (None: the own rows), the step, and the columns it reads there.
Steps = dict[tuple, tuple[str | None, object, set[str]]]


class Workbook:
    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.tables: dict[str, Table] = {}
        self._changed()

    def _changed(self) -> None:
        """Frames by table and columns, and quantiles by table and fixed criteria, are kept until a table or formula is added."""
        self._frames: dict[tuple, DataFrame] = {}
        self._needed: dict[tuple[str, str], set[tuple[str, str]]] = {}
        self._circles: dict[tuple[str, str], bool] = {}
        self._quantiles: dict[tuple, dict] = {}

    def add(self, name: str, df: DataFrame | Callable[[], DataFrame], order_by: list[str] | None = None, file: str = "", sheet: str | None = None, books: list[str] | None = None, first_row: int = 2) -> Table:
        """df: a frame, or a function that opens it when a formula first names the table. order_by: what makes a row first (all columns if not given)."""
        t = self.tables[name] = Table(name, df, order_by, file, sheet or name, books=books or [], first_row=first_row)
        self._changed()
        return t

    def derive(self, table: str, column: str, formula: str, included: bool = False, row: int | None = None, variants: list[Variant] | None = None) -> None:
        """variants: the formulas of the rows where they differ. row: the row of the sheet that the formula stands in, if its references to other rows of the table are to be followed."""
        t = self.tables[table]
        if "columns" in t.__dict__ and column not in t.columns:
            t.columns.append(column)
        t.formulas[column] = FormulaColumn(formula, included, row=row, variants=variants or [])
        self._changed()

    def drop(self, table: str, *columns: str) -> None:
        """Columns that recompute() leaves out; formulas still read them."""
        self.tables[table].dropped |= set(columns)

    # resolving

    def locate(self, ref: Ref, here: Table) -> Table:
        if ref.sheet is None:
            t = here
        else:
            file = here.file if ref.book is None else self._book(ref.book, here)
            found = [t for t in self.tables.values() if ref.sheet.lower() in (t.sheet.lower(), t.name.lower()) and (not file or t.file == file)]
            if not found:
                raise Unsupported(f"no table for sheet {ref.sheet}")
            t = found[0]
        if ref.last >= len(t.columns):
            raise Unsupported(f"column {column_letters(ref.last)} is outside table {t.name}")
        return t

    def _book(self, book: str, here: Table) -> str:
        if book.isdigit():
            if int(book) > len(here.books):
                raise Unsupported(f"unknown workbook [{book}]")
            return here.books[int(book) - 1]
        return book

    # frames

    def frame(self, table: str, need: set[str], measure: bool = True) -> DataFrame:
        """The table's stored columns and the formula columns of need, each computed after those that it reads. measure: see Aggregate.apply."""
        t = self.tables[table]
        df, done = t.df, ()
        for columns in self.stages(t, need):
            done = (*done, *columns)
            key = (table, done, measure)
            if key not in self._frames:
                steps: Steps = {}
                lowered = [_Lowering(self, t, c, df, steps).run() for c in columns]
                self._frames[key] = self._applied(lowered, steps, df, [t.output(c) for c in columns], measure)
            df = self._frames[key]
        return df

    def stages(self, t: Table, need: set[str]) -> list[list[str]]:
        """order() in groups: a column is in the first group after all that it reads, and the columns of a group share their steps."""
        at: dict[str, int] = {}
        for c in self.order(t, need):
            at[c] = 1 + max((at[r] for r in self._reads(t, c) if r in at and not t.formulas[r].included), default=-1)
        return [[c for c in at if at[c] == i] for i in range(max(at.values(), default=-1) + 1)]

    def order(self, t: Table, need: set[str]) -> list[str]:
        """Formula columns of need and those that they read in their own table, what is read first; in a cycle, as declared."""
        out: list[str] = []
        seen: set[str] = set()

        def visit(column: str) -> None:
            if column in seen:
                return
            seen.add(column)
            for c in self._reads(t, column):
                if c in t.formulas and not t.formulas[c].included:
                    visit(c)
            out.append(column)

        for c in t.columns:
            if c in need and c in t.formulas:
                visit(c)
        return out

    def needs(self, t: Table, column: str) -> set[tuple[str, str]]:
        """Tables and columns that a formula reads, of all tables; of a VLOOKUP's range its first column and the one returned."""
        key = (t.name, column)
        if key not in self._needed:
            f = t.formulas[column]
            nodes = []
            for text in dict.fromkeys([f.formula, *[v.formula for v in f.variants]]):
                try:
                    nodes.append(parse(text))
                except ParseError:
                    continue
            above = f.row
            self._needed[key] = {found for node in nodes for ref in _refs(node) for found in self._named(ref, t) if not (found == key and is_above(ref, above))}
        return self._needed[key]

    def _named(self, ref: Ref, here: Table) -> list[tuple[str, str]]:
        try:
            t = self.locate(ref, here)
        except Unsupported:
            return []
        return [(t.name, c) for c in t.columns[ref.first : ref.last + 1]]

    def _reads(self, t: Table, column: str) -> list[str]:
        return sorted((c for name, c in self.needs(t, column) if name == t.name), key=t.columns.index)

    def _computed(self, name: str, column: str) -> bool:
        f = self.tables[name].formulas.get(column)
        return f is not None and not f.included

    def circular(self, t: Table, column: str) -> bool:
        """Whether a formula reads its own result, be it through other tables."""
        key = (t.name, column)
        if key not in self._circles:
            seen: set[tuple[str, str]] = set()
            todo = [key]
            while todo:
                name, c = todo.pop()
                new = {x for x in self.needs(self.tables[name], c) if self._computed(*x)} - seen
                seen |= new
                todo += new
            self._circles[key] = key in seen and self._computed(*key)
        return self._circles[key]

    def _applied(self, lowered: list[_Lowered], steps: Steps, df: DataFrame, outputs: list[str], measure: bool) -> DataFrame:
        plain, base = [c for c in df.columns if c not in outputs], df
        for table, step, reads in steps.values():
            df = step.apply(df, df if table is None else self.frame(table, reads, measure), measure, base)
        return df.select(*plain, *[(x.value[0].cast("string") if x.value[1] == "null" else x.value[0]).alias(o) for x, o in zip(lowered, outputs, strict=True)])

    def recompute(self, table: str) -> DataFrame:
        """The view of a table: its columns, formula columns in place of what they replace, and twins of included ones last."""
        t = self.tables[table]
        df = self.frame(table, set(t.formulas))
        stored = [c for c in t.columns if c in t.df.columns and (c not in t.formulas or t.formulas[c].included)]
        return df.select(*[c for c in [*stored, *[t.output(c) for c in t.columns if c in t.formulas]] if c not in t.dropped])

    def register_views(self) -> list[str]:
        """A temporary view <table>_v for each table that has formulas."""
        names = []
        for t in self.tables.values():
            t.df.createOrReplaceTempView(t.name)
            if t.formulas:
                self.recompute(t.name).createOrReplaceTempView(f"{t.name}_v")
                names.append(f"{t.name}_v")
        return names

    def translations(self) -> list[Translation]:
        """What each formula became. No job is run."""
        out = []
        for t in self.tables.values():
            for column in t.formulas:
                base = self.frame(t.name, {c for c in self.order(t, {column}) if c != column}, measure=False)
                out.append(_Lowering(self, t, column, base).run().translation)
        return out


def with_columns(node: Node, numbers: dict[int, int]) -> Node:
    """A formula in which some of its numbers, counted from 0 in the order of the text, are cells of columns."""
    seen = iter(range(10**9))

    def made(n: Node) -> Node:
        match n:
            case Num():
                k = next(seen)
                return Ref(numbers[k], numbers[k], None, None) if k in numbers else n
            case Unary(op, x):
                return Unary(op, made(x))
            case Binary(op, a, b):
                left = made(a)
                return Binary(op, left, made(b))
            case Call(name, args):
                return Call(name, tuple([made(a) for a in args]))
        return n

    return made(node) if numbers else node


def is_above(ref: Ref, row: int | None) -> bool:
    """Whether a reference is to the cell in the row before."""
    return row is not None and not ref.is_range and not ref.top_fixed and ref.top == row - 1


def _refs(node: Node) -> list[Ref]:
    """References of a formula; a VLOOKUP's range as its first column and the one returned."""
    out, passed = [], set()
    for n in walk(node):
        if isinstance(n, Call) and n.name == "VLOOKUP" and len(n.args) > 2 and isinstance(n.args[1], Ref) and isinstance(n.args[2], Num):
            r, at = n.args[1], n.args[1].first + int(n.args[2].value) - 1
            passed.add(id(r))
            out += [Ref(c, c, None, None, r.sheet, r.book) for c in dict.fromkeys((r.first, min(at, r.last)))]
        elif isinstance(n, Ref) and id(n) not in passed:
            out.append(n)
    return out


class _Lowering:
    """Lowers one formula. Unsupported parts are caught where they are, one sub-expression at a time.

    steps: those of other formulas of the table over the same frame; a step that is already there gets what this formula wants of it.
    """

    def __init__(self, book: Workbook, table: Table, column: str, df: DataFrame, steps: Steps | None = None):
        self.book, self.t, self.column, self.df = book, table, column, df
        self.steps: Steps = {} if steps is None else steps
        self.report = Translation(table.name, column, table.formulas[column].formula, table.output(column))
        self.row = table.formulas[column].row
        self.failed = False

    def run(self) -> _Lowered:
        if self.book.circular(self.t, self.column):
            self.report.status = "unsupported"
            self.note(f"{self.t.name}.{self.column} depends on itself")
            return _Lowered((F.lit(None), "null"), self.report)
        if variants := self.t.formulas[self.column].variants:
            value = self.variants(variants)
            if self.failed:
                self.report.status = "unsupported" if value[1] == "null" else "partial"
            return _Lowered(value, self.report)
        try:
            node = parse(self.report.formula)
        except ParseError as e:
            self.report.status = "unsupported"
            self.report.notes.append(str(e))
            return _Lowered((F.lit(None), "null"), self.report)
        self.rows_apart(node)
        value = self.balance(node) if any(isinstance(n, Ref) and self.is_own(n) and is_above(n, self.row) for n in walk(node)) else self.value(node)
        if self.failed:
            self.report.status = "unsupported" if value[1] == "null" else "partial"
        return _Lowered(value, self.report)

    def variants(self, variants: list[Variant]) -> Value:
        """Each row by its own formula; other rows as they are stored."""
        values = []
        for v in variants:
            try:
                node = with_columns(parse(v.formula), {k: self.t.columns.index(c) for k, c in v.numbers.items()})
            except ParseError as e:
                self.failed = True
                self.note(str(e))
                node = Empty()
            self.rows_apart(node)
            values.append(self.value(node))
        cases, kind = unify(values)
        if self.column in self.t.df.columns:  # a stored text where numbers are computed is null
            own = (F.col(self.column), kind_of(self.t.df.schema[self.column].dataType))
            cases, kind = (([*cases, own[0]], own[1]) if kind == "null" else ([*cases, as_kind(*own, kind)], kind))
        whole = F.lit(None)
        for v, c in zip(variants, cases, strict=False):
            whole = F.when(F.col(v.column) == v.value, c) if v is variants[0] else whole.when(F.col(v.column) == v.value, c)
        return (whole.otherwise(cases[-1]) if len(cases) > len(variants) else whole), kind

    def note(self, text: str) -> None:
        if text not in self.report.notes:
            self.report.notes.append(text)

    def depends(self, t: Table, column: str) -> None:
        if (t is not self.t or column in t.formulas) and f"{t.name}.{column}" not in self.report.depends_on:
            self.report.depends_on.append(f"{t.name}.{column}")

    def said(self, node: Node) -> str:
        """What makes values of formulas the same; where rows are followed, they count from the formula's own."""
        return repr(node) if self.row is None else f"{self.row} {node!r}"

    # other rows

    def is_own(self, ref: Ref) -> bool:
        """Whether a reference is to the column that the formula fills."""
        try:
            return self.book.locate(ref, self.t) is self.t and self.t.columns[ref.first : ref.last + 1] == [self.column]
        except Unsupported:
            return False

    def rows_apart(self, node: Node) -> None:
        """Notes for rows that aren't followed."""
        if self.row is not None:
            return
        cells, ranges = set(), False
        for n in walk(node):
            if isinstance(n, Ref) and n.top is not None and n.sheet is None:
                if n.is_range and (n.top != n.bottom or n.top_fixed != n.bottom_fixed):
                    ranges |= not (n.top_fixed and n.bottom_fixed)
                else:
                    cells.add((n.top, n.top_fixed))
        if len(cells) > 1:
            self.note("cells of other rows are read as cells of this row")
        if ranges:
            self.note("bounds of ranges are left out")

    def neighbours(self, *more: object) -> tuple[Neighbours, tuple]:
        signature = ("rows", self.t.name, *more)
        if self.t.first_by is None:
            raise Unsupported(f"rows of {self.t.name} have no order")
        if signature not in self.steps:
            self.steps[signature] = (None, Neighbours(self.t.order_by, edges=self.book._quantiles.setdefault((self.t.name, "order"), {}), source=self.t.df), set())
        return self.steps[signature][1], signature

    def other_row(self, wanted: object, *more: object) -> str:
        step, signature = self.neighbours(*more)
        return step.wanted.setdefault(wanted, f"__s{self.column}_{list(self.steps).index(signature)}_{len(step.wanted)}")

    def stretch(self, f: str, ref: Ref) -> Stretch:
        column = self.t.columns[ref.first]
        self.own(column)
        # A range to a sheet's last row goes on to the table's end, however many rows it has.
        at = lambda r: END if r == LAST_ROW and ref.top != ref.bottom else r - self.t.first_row
        ends = [(at(r), True) if fixed else (r - self.row, False) for r, fixed in ((ref.top, ref.top_fixed), (ref.bottom, ref.bottom_fixed))]
        (first, first_fixed), (last, last_fixed) = sorted(ends, key=lambda e: not e[1])
        return Stretch(f, column, first, last, first_fixed, last_fixed)

    def balance(self, node: Node) -> Value:
        """A formula of its own cell in the row above: factor times that cell and a term."""
        try:
            factor, term = self.affine(node)
            step, signature = self.neighbours("balance", self.column)
        except Unsupported as e:
            self.failed = True
            self.note(str(e))
            return F.lit(None), "null"
        names = [f"__s{self.column}_{list(self.steps).index(signature)}_{x}" for x in ("factor", "term")]
        whole = factor is None and term[1] == "integer"
        step.made[names[1]] = number(*term)
        if factor is not None:
            step.made[names[0]] = number(*factor)
        hidden = step.wanted.setdefault(Balance(None if factor is None else names[0], names[1]), f"{names[0]}_out")
        return F.col(hidden), "integer" if whole else "float"

    def affine(self, node: Node) -> tuple[Value | None, Value]:
        """(factor, term) of the cell above; a factor of None is 1."""
        above = lambda n: any(isinstance(x, Ref) and self.is_own(x) and is_above(x, self.row) for x in walk(n))
        zero, one = (F.lit(0).cast("bigint"), "integer"), (F.lit(1).cast("bigint"), "integer")
        match node:
            case Ref() if above(node):
                return None, zero
            case Unary("%", x) if above(node):
                return self.affine(Binary("/", x, Num(100.0)))
            case Unary(op, x) if above(node):
                return self.affine(x) if op == "+" else self.affine(Binary("*", Num(-1.0), x))
            case Binary("+" | "-" as op, x, y) if above(node):
                (a, c), (b, d) = [self.affine(n) if above(n) else (zero, self.zero(n)) for n in (x, y)]
                if a is None and not above(y):
                    return None, self.arithmetic(op, c, d)
                if b is None and not above(x) and op == "+":
                    return None, self.arithmetic(op, c, d)
                return self.arithmetic(op, a or one, b or one), self.arithmetic(op, c, d)
            case Binary("*" | "/" as op, x, y) if above(node) and not (above(x) and above(y)) and not (op == "/" and above(y)):
                inner, outer = (x, y) if above(x) else (y, x)
                a, c = self.affine(inner)
                k = self._value(outer)
                return self.arithmetic(op, a or one, k), self.arithmetic(op, c, k)
        raise Unsupported(f"{self.column} depends on its cell above in another way than a factor and a term")

    def zero(self, node: Node) -> Value:
        """A term of a balance; blanks count as 0."""
        c, kind = self._value(node)
        return F.coalesce(number(c, kind), F.lit(0)), kind if kind == "integer" else "float"

    def arithmetic(self, op: str, left: Value, right: Value) -> Value:
        return self.binary(op, left, right)

    def value(self, node: Node) -> Value:
        try:
            return self._value(node)
        except Unsupported as e:
            self.failed = True
            self.note(str(e))
            return F.lit(None), "null"

    def _value(self, node: Node) -> Value:
        match node:
            case Empty():
                return F.lit(None), "null"
            case Num(v):
                return (F.lit(int(v)).cast("bigint"), "integer") if float(v).is_integer() and abs(v) < 2**53 else (F.lit(v), "float")
            case Str(v):
                return F.lit(v), "text"
            case Bool(v):
                return F.lit(v), "boolean"
            case Ref():
                return self.cell(node)
            case Unary("%", x):
                return number(*self.value(x)).cast("double") / F.lit(100.0), "float"
            case Unary(op, x):
                c, kind = self.value(x)
                return (-number(c, kind) if op == "-" else number(c, kind)), kind if kind == "integer" else "float"
            case Binary(op, left, right):
                return self.binary(op, self.value(left), self.value(right))
            case Call(name, args):
                return self.call(name, args)
        raise Unsupported(f"{node!r}")

    def cell(self, ref: Ref) -> Value:
        t = self.book.locate(ref, self.t)
        if ref.first != ref.last or (ref.is_range and ref.top != ref.bottom):
            raise Unsupported("a range of several cells stands where one value is needed")
        if t is not self.t:
            raise Unsupported(f"a cell of {t.name} is read without a key")
        column = t.columns[ref.first]
        if self.row is None or ref.top is None or (ref.top == self.row and not ref.top_fixed):
            return self.own(column)
        kind = self.own(column)[1]
        if ref.top_fixed:
            return F.col(self.other_row(self.stretch("ANY", Ref(ref.first, ref.last, ref.top, ref.top, is_range=True, top_fixed=True, bottom_fixed=True)))), kind
        return F.col(self.other_row(Cell(column, ref.top - self.row))), kind

    def own(self, column: str) -> Value:
        """A column of this row, computed first if a formula's."""
        self.depends(self.t, column)
        f = self.t.formulas.get(column)
        source = self.t.df if f is None or f.included else self.df
        if column not in source.columns:
            raise Unsupported(f"{self.t.name}.{column} depends on itself")
        return F.col(column), kind_of(source.schema[column].dataType)

    def kind_of(self, t: Table, column: str) -> str:
        return kind_of(self.book.frame(t.name, {column}, False).schema[column].dataType)

    def binary(self, op: str, left: Value, right: Value) -> Value:
        if op == "&":
            return concat_text([left, right]), "text"
        if op in ("=", "<>", "<", ">", "<=", ">="):
            a, b = comparable(left, right)
            return {"=": a == b, "<>": a != b, "<": a < b, ">": a > b, "<=": a <= b, ">=": a >= b}[op], "boolean"
        a, b = number(*left), number(*right)
        if op == "/":
            return F.try_divide(a.cast("double"), b.cast("double")), "float"
        if op == "^":
            return F.pow(a, b), "float"
        kind = "integer" if left[1] == right[1] == "integer" else "float"
        return {"+": a + b, "-": a - b, "*": a * b}[op], kind

    def call(self, name: str, args: tuple[Node, ...]) -> Value:
        if name in DYNAMIC:
            raise Unsupported(f"{name} finds its target only when it runs")
        if name in PLACE:
            raise Unsupported(f"{name} has no meaning in a table")
        if name in LOOKUPS:
            return self.lookup(name, args)
        if name in CONDITIONAL:
            return self.conditional(name, args)
        if name in RANGES:
            return self.ranged(name, args)
        if name not in FUNCTIONS:
            raise Unsupported(f"{name} isn't known")
        return FUNCTIONS[name]([self.value(a) for a in args], self.report.notes)

    # lookups

    def span(self, node: Node) -> tuple[Table, list[str]]:
        if not isinstance(node, Ref):
            raise Unsupported("a range is needed")
        t = self.book.locate(node, self.t)
        return t, t.columns[node.first : node.last + 1]

    def one(self, node: Node) -> tuple[Table, str]:
        t, columns = self.span(node)
        if len(columns) != 1:
            raise Unsupported("a range of one column is needed")
        return t, columns[0]

    @staticmethod
    def literal_int(node: Node) -> int:
        if not isinstance(node, Num):
            raise Unsupported("a column number must be written out")
        return int(node.value)

    def lookup(self, name: str, args: tuple[Node, ...]) -> Value:
        default: Node | None = None
        if name == "VLOOKUP":
            if len(args) < 3:
                raise Unsupported("VLOOKUP needs 3 arguments")
            t, columns = self.span(args[1])
            at = self.literal_int(args[2])
            if not 1 <= at <= len(columns):
                raise Unsupported(f"VLOOKUP: column {at} is outside the range")
            key, found, returned = args[0], columns[0], columns[at - 1]
            exact = args[3] if len(args) > 3 else Bool(True)
            if not (exact == Bool(False) or (isinstance(exact, Num) and exact.value == 0)):
                self.note("VLOOKUP: an approximate match is taken as exact")
        elif name == "XLOOKUP":
            if len(args) < 3:
                raise Unsupported("XLOOKUP needs 3 arguments")
            (t, found), (other, returned) = self.one(args[1]), self.one(args[2])
            if other is not t:
                raise Unsupported("XLOOKUP: both ranges must be in one table")
            key = args[0]
            default = args[3] if len(args) > 3 and not isinstance(args[3], Empty) else None
            if len(args) > 4:
                self.note("XLOOKUP: match and search modes are left out")
        else:
            if not (len(args) == 2 and isinstance(args[1], Call) and args[1].name == "MATCH" and len(args[1].args) >= 2):
                raise Unsupported("INDEX is known with MATCH only")
            (t, returned), (other, found) = self.one(args[0]), self.one(args[1].args[1])
            if other is not t:
                raise Unsupported("INDEX: both ranges must be in one table")
            key, mode = args[1].args[0], args[1].args[2] if len(args[1].args) > 2 else Num(1.0)
            if mode != Num(0.0):
                self.note("MATCH: an approximate match is taken as exact")
        value = self._value(key)
        self.depends(t, returned)
        signature = ("lookup", t.name, found, self.said(key))
        if signature not in self.steps:
            self.steps[signature] = (t.name, Lookup(value, found, t.order_by), {found})
        _, step, reads = self.steps[signature]
        reads.add(returned)
        hidden = step.returns.setdefault(returned, f"__s{self.column}_{list(self.steps).index(signature)}_{len(step.returns)}")
        kind = self.target_kind(t, returned)
        if default is None:
            return F.col(hidden), kind
        both, kind = unify([(F.col(hidden), kind), self.value(default)])
        return F.coalesce(*both), kind

    def target_kind(self, t: Table, column: str) -> str:
        f = t.formulas.get(column)
        return self.kind_of(t, column) if f and not f.included else kind_of(t.df.schema[column].dataType)

    # aggregates

    def conditional(self, name: str, args: tuple[Node, ...]) -> Value:
        f = CONDITIONAL[name]
        if name in ("SUMIF", "AVERAGEIF", "COUNTIF"):
            if len(args) < 2:
                raise Unsupported(f"{name} needs 2 arguments")
            pairs = [(args[0], args[1])]
            values = None if f == "COUNT" else args[2] if len(args) > 2 and not isinstance(args[2], Empty) else args[0]
        else:
            rest = args if f == "COUNT" else args[1:]
            values = None if f == "COUNT" else args[0] if args else None
            if not rest or len(rest) % 2:
                raise Unsupported(f"{name} needs pairs of ranges and criteria")
            pairs = list(zip(rest[::2], rest[1::2], strict=True))
        located = [self.one(rng) for rng, _ in pairs]
        measure = self.one(values) if values is not None else None
        t = located[0][0]
        if any(o is not t for o, _ in [*located, *([measure] if measure else [])]):
            raise Unsupported(f"{name}: all ranges must be in one table")
        criteria, dynamic, reprs = [], [], []
        for (_, column), (_, crit) in zip(located, pairs, strict=True):
            op, literal, node = criterion(crit)
            if node is None:
                criteria.append(Criterion(column, op, literal))
            else:
                criteria.append(Criterion(column, op, None, len(dynamic)))
                dynamic.append(self._value(node))
                reprs.append(self.said(node))
            self.depends(t, column)
        if measure:
            self.depends(t, measure[1])
        column = measure[1] if measure else None
        if bounds := self.ordered_by(t, criteria, dynamic, f, column):
            return self.bounded(t, criteria, dynamic, reprs, f, column, *bounds)
        return self.aggregate(t, criteria, dynamic, reprs, f, column)

    def ordered_by(self, t: Table, criteria: list[Criterion], dynamic: list[Value], f: str, column: str | None) -> tuple[Criterion | None, Criterion | None] | None:
        """The lower and upper bound that running totals answer: one of them, or both on one column where differences of totals are exact."""
        uneven = [c for c in criteria if c.value is not None and c.op != "="]
        lower, upper = [c for c in uneven if c.op in (">", ">=")], [c for c in uneven if c.op in ("<", "<=")]
        if len(uneven) == 1 and len(lower + upper) == 1:
            return (lower or [None])[0], (upper or [None])[0]
        if len(uneven) == 2 and len(lower) == len(upper) == 1 and lower[0].column == upper[0].column:
            kinds = {met_as(dynamic[c.value][1], self.target_kind(t, c.column)) for c in uneven}
            if len(kinds) == 1 and Ordered.exact(f, "integer" if column is None else self.target_kind(t, column)):
                return lower[0], upper[0]
        return None

    def bounded(self, t: Table, criteria, dynamic, reprs, f: str, column: str | None, lower: Criterion | None, upper: Criterion | None) -> Value:
        by = (lower or upper).column
        kind = met_as(dynamic[(lower or upper).value][1], self.target_kind(t, by))
        fixed, equal = [c for c in criteria if c.value is None], [c for c in criteria if c.value is not None and c.op == "="]
        signature = ("ordered", t.name, tuple(fixed), tuple((c.column, reprs[c.value]) for c in equal), by, kind)
        if signature not in self.steps:
            known = self.book._quantiles.setdefault((t.name, tuple(fixed)), {})
            self.steps[signature] = (t.name, Ordered(fixed, [(c.column, dynamic[c.value]) for c in equal], by, quantiles=known), {c.column for c in criteria})
        _, step, reads = self.steps[signature]
        for c in (lower, upper):
            if c is not None:
                step.bounds.setdefault(reprs[c.value], dynamic[c.value])
        return self.measure(signature, step, reads, t, f, column, (f, column, *[c and (c.op, reprs[c.value]) for c in (lower, upper)]))

    def aggregate(self, t: Table, criteria, dynamic, reprs, f: str, column: str | None) -> Value:
        signature = ("aggregate", t.name, tuple(criteria), tuple(reprs))
        if signature not in self.steps:
            self.steps[signature] = (t.name, Aggregate(criteria, dynamic, quantiles=self.book._quantiles.setdefault((t.name, tuple(c for c in criteria if c.value is None)), {})), {c.column for c in criteria})
        _, step, reads = self.steps[signature]
        return self.measure(signature, step, reads, t, f, column, (f, column))

    def measure(self, signature: tuple, step: Aggregate | Ordered, reads: set[str], t: Table, f: str, column: str | None, key: tuple) -> Value:
        if column:
            reads.add(column)
        hidden = step.measures.setdefault(key, f"__s{self.column}_{list(self.steps).index(signature)}_{len(step.measures)}")
        if f in ("COUNT", "COUNTA"):
            return F.col(hidden), "integer"
        kind = self.target_kind(t, column)
        if kind in ("text", "boolean"):
            self.note(f"{f}: {column} is read as numbers")
            kind = "float"
        return F.col(hidden), "float" if f == "AVERAGE" else kind

    def rows_of(self, name: str, ref: Ref) -> Value:
        """A range of rows of one column of the own table."""
        column = self.t.columns[ref.first]
        f, kind = "COUNTA" if name == "COUNT" else name, self.own(column)[1]
        hidden = F.col(self.other_row(self.stretch(f, ref)))
        if kind in ("text", "boolean") and f != "COUNTA":
            self.note(f"{f}: {column} is read as numbers")
            kind = "float"
        return hidden, "integer" if f == "COUNTA" else "float" if f == "AVERAGE" else kind

    def ranged(self, name: str, args: tuple[Node, ...]) -> Value:
        if self.row is not None and len(args) == 1 and isinstance(r := args[0], Ref) and r.is_range and r.first == r.last and r.top is not None and self.book.locate(r, self.t) is self.t:
            if (r.top, r.bottom, r.top_fixed, r.bottom_fixed) != (self.row, self.row, False, False):
                return self.rows_of(name, r)
        if len(args) == 1 and isinstance(args[0], Ref) and args[0].is_range and args[0].first == args[0].last and (args[0].top is None or args[0].top != args[0].bottom):
            t, column = self.one(args[0])
            self.depends(t, column)
            return self.aggregate(t, [], [], [], "COUNTA" if name == "COUNT" else name, column)
        cells: list[Value] = []
        for a in args:
            if isinstance(a, Ref) and a.is_range:
                t = self.book.locate(a, self.t)
                if t is not self.t or a.top is None or a.top != a.bottom:
                    raise Unsupported(f"{name} over a block of cells")
                cells += [self.own(c) for c in t.columns[a.first : a.last + 1]]
            else:
                cells.append(self.value(a))
        if not cells:
            raise Unsupported(f"{name} needs an argument")
        kind = "integer" if all(k == "integer" for _, k in cells) else "float"
        numbers = [as_kind(number(c, k), k if k in ("integer", "float") else "float", kind) for c, k in cells]
        if name == "COUNT":
            return sum((F.when(c.isNull(), 0).otherwise(1) for c, _ in cells), F.lit(0)).cast("bigint"), "integer"
        if name in ("MIN", "MAX"):
            return (numbers[0] if len(numbers) == 1 else (F.least if name == "MIN" else F.greatest)(*numbers)), kind
        total = sum((F.coalesce(n, F.lit(0)) for n in numbers[1:]), F.coalesce(numbers[0], F.lit(0)))
        return (total, kind) if name == "SUM" else (total.cast("double") / F.lit(float(len(numbers))), "float")


#: Operators that a criterion may begin with, the longer ones first.
OPERATORS = ("<=", ">=", "<>", "<", ">", "=")


def criterion(node: Node) -> tuple[str, object, Node | None]:
    """(operator, literal, None) for a fixed criterion, (operator, None, expression) for one that differs by row.

    A text may begin with an operator, blanks around it aside; without one, * and ? are wildcards. An operator joined to an
    expression by & compares with its value.
    """
    match node:
        case Num(v):
            return "=", float(v), None
        case Bool(v):
            return "=", v, None
        case Str(text):
            op = next((o for o in OPERATORS if text.lstrip().startswith(o)), None)
            if op:
                return op, _literal(text.lstrip()[len(op) :]), None
            return ("like", _pattern(text), None) if {"*", "?"} & set(text) else ("=", _literal(text), None)
        case Binary("&", Str(op), Num(v)) if op.strip() in OPERATORS:
            return op.strip(), float(v), None
        case Binary("&", Str(op), right) if op.strip() in OPERATORS:
            return op.strip(), None, right
    return "=", None, node


def _pattern(text: str) -> str:
    """A LIKE pattern with escape character \\."""
    return "".join({"*": "%", "?": "_"}.get(c) or (f"\\{c}" if c in "%_\\" else c) for c in text)


def _literal(text: str) -> object:
    """A number where the text is one."""
    number = re.fullmatch(r"\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*", text)
    return float(text) if number else text
