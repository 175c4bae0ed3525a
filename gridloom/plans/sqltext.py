"""A workbook's views as SQL text for SQLite or PostgreSQL, and as a PySpark script, for those who recompute elsewhere.

The text says what the Spark plans compute: parts without a relational meaning are NULL with a comment. Lookups and conditional
aggregates are correlated subqueries there. A table's included columns stand in it; columns left out are written in place
where the own table's formulas read them, and read from the other table's view elsewhere.
"""

from __future__ import annotations

from collections.abc import Callable
from graphlib import CycleError, TopologicalSorter

from gridloom.functions.kinds import Unsupported, kind_of
from gridloom.plans.formula import Binary, Bool, Call, Empty, Node, Num, ParseError, Ref, Str, Unary, parse, walk
from gridloom.plans.workbook import CONDITIONAL, DYNAMIC, LOOKUPS, PLACE, RANGES, Table, Workbook, criterion

DIALECTS = ("sqlite", "postgres")
#: Fixed value: functions that are calls of the same arguments in both dialects.
SAME = {"UPPER": "UPPER", "LOWER": "LOWER", "TRIM": "TRIM", "LEN": "LENGTH", "ABS": "ABS", "SQRT": "SQRT"}


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def string(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


class _Text:
    """SQL of one formula."""

    def __init__(self, book: Workbook, table: Table, column: str, dialect: str):
        self.book, self.t, self.column, self.dialect = book, table, column, dialect
        self.notes: list[str] = []
        self.aliases = 0
        self.inside: tuple[str, ...] = (column,)

    def whole(self) -> str:
        if self.book.circular(self.t, self.column):
            self.notes.append(f"{self.t.name}.{self.column} depends on itself")
            return "NULL"
        try:
            f = self.t.formulas[self.column]
            node = parse(f.formula)
            if f.variants[1:] or any(v.numbers for v in f.variants):
                self.notes.append("rows differ in their formulas: the first one's is written here; the Spark plans follow each")
            if f.row is not None and any(isinstance(n, Ref) and n.sheet is None and n.top is not None and (n.top_fixed or n.bottom_fixed or {n.top, n.bottom} != {f.row}) for n in walk(node)):
                self.notes.append("other rows are read by the Spark plans only")
                return "NULL"
            return self.sql(node)
        except ParseError as e:
            self.notes.append(str(e))
            return "NULL"

    def sql(self, node: Node) -> str:
        try:
            return self._sql(node)
        except Unsupported as e:
            if str(e) not in self.notes:
                self.notes.append(str(e))
            return "NULL"

    def _sql(self, node: Node) -> str:
        match node:
            case Empty():
                return "NULL"
            case Num(v):
                return str(int(v)) if float(v).is_integer() and abs(v) < 2**53 else repr(float(v))
            case Str(v):
                return string(v)
            case Bool(v):
                return "TRUE" if v else "FALSE"
            case Ref():
                return self.cell(node)
            case Unary("%", x):
                return f"({self.sql(x)} / 100.0)"
            case Unary(op, x):
                return f"({op}{self.sql(x)})"
            case Binary(op, a, b):
                return self.binary(op, a, b)
            case Call(name, args):
                return self.call(name, args)
        raise Unsupported(f"{node!r}")

    def text(self, node: Node) -> str:
        return self.sql(node) if isinstance(node, Str) else f"CAST({self.sql(node)} AS TEXT)"

    def binary(self, op: str, left: Node, right: Node) -> str:
        if op == "&":
            return f"({self.text(left)} || {self.text(right)})"
        a, b = self.sql(left), self.sql(right)
        if op == "/":
            return f"({a} * 1.0 / NULLIF({b}, 0))"
        return f"POWER({a}, {b})" if op == "^" else f"({a} {op} {b})"

    def cell(self, ref: Ref) -> str:
        t = self.book.locate(ref, self.t)
        if ref.first != ref.last or (ref.is_range and ref.top != ref.bottom):
            raise Unsupported("a range of several cells stands where one value is needed")
        if t is not self.t:
            raise Unsupported(f"a cell of {t.name} is read without a key")
        return self.own(t.columns[ref.first])

    def own(self, column: str) -> str:
        f = self.t.formulas.get(column)
        if f is None or f.included:
            return f"t.{quoted(column)}"
        if column in self.inside:
            raise Unsupported(f"{self.t.name}.{column} depends on itself")
        before, self.inside = self.inside, (*self.inside, column)
        try:
            return f"({self.sql(parse(f.formula))})"
        except ParseError as e:
            raise Unsupported(str(e)) from e
        finally:
            self.inside = before

    def source(self, t: Table, columns: list[str]) -> tuple[str, str]:
        """FROM clause and alias: the table, or its view where a column isn't stored."""
        self.aliases += 1
        computed = any(c in t.formulas and not t.formulas[c].included for c in columns)
        return f"{quoted(t.name + ('_v' if computed else ''))} x{self.aliases}", f"x{self.aliases}"

    def one(self, node: Node) -> tuple[Table, str]:
        if not isinstance(node, Ref) or node.first != node.last:
            raise Unsupported("a range of one column is needed")
        t = self.book.locate(node, self.t)
        return t, t.columns[node.first]

    def call(self, name: str, args: tuple[Node, ...]) -> str:
        if name in DYNAMIC or name in PLACE:
            raise Unsupported(f"{name} has no meaning in a table")
        if name in LOOKUPS:
            return self.lookup(name, args)
        if name in CONDITIONAL:
            return self.conditional(name, args)
        if name in RANGES:
            return self.ranged(name, args)
        if name in SAME and len(args) == 1:
            return f"{SAME[name]}({self.sql(args[0])})"
        made = self.scalars().get(name)
        if made is None:
            raise Unsupported(f"{name} isn't known")
        try:
            return made(*args)
        except TypeError as e:
            raise Unsupported(f"{name} has other arguments") from e

    def scalars(self) -> dict[str, Callable[..., str]]:
        s, lite = self.sql, self.dialect == "sqlite"
        scaled = lambda up: lambda x, d=Num(0.0): f"({'CEIL' if up else 'FLOOR'}({s(x)} * POWER(10, {s(d)})) / POWER(10, {s(d)}))"
        part = lambda code, word: lambda x: f"CAST(STRFTIME('{code}', {s(x)}) AS INTEGER)" if lite else f"CAST(EXTRACT({word} FROM {s(x)}) AS INTEGER)"
        at = lambda a, b, *_: f"INSTR({s(b)}, {s(a)})" if lite else f"POSITION({s(a)} IN {s(b)})"
        cases = lambda *xs: "CASE " + " ".join(f"WHEN {s(c)} THEN {s(v)}" for c, v in zip(xs[::2], xs[1::2], strict=False)) + " END"
        first = lambda *xs: f"COALESCE({', '.join(map(s, xs))})"
        joined = lambda *xs: "(" + " || ".join(map(self.text, xs)) + ")"
        return {
            "IF": lambda c, a, b=Empty(): f"CASE WHEN {s(c)} THEN {s(a)} ELSE {s(b)} END",
            "IFS": cases, "IFERROR": first, "IFNA": first,
            "AND": lambda *xs: "(" + " AND ".join(map(s, xs)) + ")",
            "OR": lambda *xs: "(" + " OR ".join(map(s, xs)) + ")",
            "NOT": lambda x: f"(NOT {s(x)})",
            "ISBLANK": lambda x: f"({s(x)} IS NULL)",
            "ROUND": lambda x, d=Num(0.0): f"ROUND({s(x)}{'' if lite else '::NUMERIC'}, {s(d)})",
            "ROUNDUP": scaled(True), "ROUNDDOWN": scaled(False),
            "INT": lambda x: f"FLOOR({s(x)})",
            "TRUNC": lambda x, *_: f"TRUNC({s(x)})",
            "MOD": lambda a, b: f"({s(a)} % NULLIF({s(b)}, 0))",
            "LEFT": lambda x, n=Num(1.0): f"SUBSTR({s(x)}, 1, {s(n)})",
            "RIGHT": lambda x, n=Num(1.0): f"SUBSTR({s(x)}, LENGTH({s(x)}) - {s(n)} + 1)",
            "MID": lambda x, i, n: f"SUBSTR({s(x)}, {s(i)}, {s(n)})",
            "CONCAT": joined, "CONCATENATE": joined,
            "TEXT": lambda x, *_: self.text(x),
            "VALUE": lambda x: self.number(s(x)),
            "SUBSTITUTE": lambda x, a, b, *_: f"REPLACE({s(x)}, {s(a)}, {s(b)})",
            "FIND": at, "SEARCH": at,
            "TODAY": lambda: "CURRENT_DATE", "NOW": lambda: "CURRENT_TIMESTAMP",
            "YEAR": part("%Y", "YEAR"), "MONTH": part("%m", "MONTH"), "DAY": part("%d", "DAY"),
        }

    def number(self, sql: str) -> str:
        """A text as a number; NULL where it isn't one, which neither dialect's CAST says."""
        text = f"TRIM(CAST({sql} AS TEXT))"
        if self.dialect != "sqlite":
            return f"CASE WHEN {text} ~ '^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$' THEN CAST({text} AS DOUBLE PRECISION) END"
        plain = f"{text} GLOB '*[0-9]*' AND {text} GLOB '[0-9.+-]*' AND SUBSTR({text}, 2) NOT GLOB '*[^0-9.]*' AND {text} NOT GLOB '*.*.*'"
        return f"CASE WHEN {plain} OR (JSON_VALID({text}) AND JSON_TYPE({text}) IN ('integer', 'real')) THEN CAST({text} AS REAL) END"

    def measured(self, t: Table, column: str, sql: str, f: str) -> str:
        """A column that an aggregate adds up or compares: texts are read as numbers."""
        kind = kind_of(t.df.schema[column].dataType) if column in t.df.columns else "float"
        return self.number(sql) if kind == "text" and f != "COUNT" else sql

    def in_order(self, t: Table, source: str, x: str) -> str:
        """ORDER BY of a table's first rows: by its order where that is stored, else by the order of loading."""
        if t.first_by and all(c in t.df.columns and c not in t.dropped for c in t.first_by):
            return f" ORDER BY {', '.join(f'{x}.{quoted(c)}' for c in t.first_by)}"
        if not source.startswith(quoted(t.name + "_v")):
            return f" ORDER BY {x}.{'rowid' if self.dialect == 'sqlite' else 'ctid'}"
        note = f"the first match in {t.name}_v has no order"
        if note not in self.notes:
            self.notes.append(note)
        return ""

    def lookup(self, name: str, args: tuple[Node, ...]) -> str:
        default = None
        if name == "VLOOKUP" and len(args) > 2 and isinstance(args[1], Ref) and isinstance(args[2], Num):
            t, r, at = self.book.locate(args[1], self.t), args[1], int(args[2].value)
            if not 1 <= at <= r.last - r.first + 1:
                raise Unsupported(f"VLOOKUP: column {at} is outside the range")
            key, found, returned = args[0], t.columns[r.first], t.columns[r.first + at - 1]
        elif name == "XLOOKUP" and len(args) > 2:
            (t, found), (other, returned), key = self.one(args[1]), self.one(args[2]), args[0]
            default = args[3] if len(args) > 3 and not isinstance(args[3], Empty) else None
        elif name == "INDEX" and len(args) == 2 and isinstance(args[1], Call) and args[1].name == "MATCH" and len(args[1].args) > 1:
            (t, returned), (other, found), key = self.one(args[0]), self.one(args[1].args[1]), args[1].args[0]
        else:
            raise Unsupported(f"{name} has other arguments")
        if name != "VLOOKUP" and other is not t:
            raise Unsupported(f"{name}: both ranges must be in one table")
        source, x = self.source(t, [found, returned])
        order = self.in_order(t, source, x)
        got = f"(SELECT {x}.{quoted(returned)} FROM {source} WHERE {x}.{quoted(found)} = {self._sql(key)}{order} LIMIT 1)"
        return got if default is None else f"COALESCE({got}, {self.sql(default)})"

    def conditional(self, name: str, args: tuple[Node, ...]) -> str:
        f = CONDITIONAL[name]
        if name in ("SUMIF", "AVERAGEIF", "COUNTIF"):
            pairs, values = [args[:2]], None if f == "COUNT" else args[2] if len(args) > 2 else args[0]
        else:
            rest, values = (args, None) if f == "COUNT" else (args[1:], args[0])
            pairs = list(zip(rest[::2], rest[1::2], strict=True))
        places = [self.one(r) for r, _ in pairs]
        measure = self.one(values) if values is not None else None
        t = places[0][0]
        if any(o is not t for o, _ in [*places, *([measure] if measure else [])]):
            raise Unsupported(f"{name}: all ranges must be in one table")
        source, x = self.source(t, [c for _, c in places] + ([measure[1]] if measure else []))
        tests = []
        for (_, column), (_, crit) in zip(places, pairs, strict=True):
            op, value, node = criterion(crit)
            left = f"{x}.{quoted(column)}"
            if op == "like" and self.dialect == "sqlite":  # its LIKE doesn't tell case
                tests.append(f"CAST({left} AS TEXT) GLOB {string(_glob(value))}")
            elif op == "like":
                tests.append(f"CAST({left} AS TEXT) LIKE {string(value)} ESCAPE '\\'")
            else:
                fixed = ("TRUE" if value else "FALSE") if isinstance(value, bool) else self.sql(Num(value)) if isinstance(value, float) else string(str(value))
                tests.append(f"{left} {op} {self._sql(node) if node is not None else fixed}")
        what = "COUNT(*)" if f == "COUNT" else f"{'AVG' if f == 'AVERAGE' else f}({self.measured(t, measure[1], f'{x}.{quoted(measure[1])}', f)})"
        return f"(SELECT {'COALESCE(' + what + ', 0)' if f == 'SUM' else what} FROM {source} WHERE {' AND '.join(tests)})"

    def ranged(self, name: str, args: tuple[Node, ...]) -> str:
        a = args[0] if args else None
        if len(args) == 1 and isinstance(a, Ref) and a.is_range and a.first == a.last and (a.top is None or a.top != a.bottom):
            t, column = self.one(a)
            source, x = self.source(t, [column])
            what = f"{'AVG' if name == 'AVERAGE' else name}({self.measured(t, column, f'{x}.{quoted(column)}', name)})"
            return f"(SELECT {'COALESCE(' + what + ', 0)' if name == 'SUM' else what} FROM {source})"
        cells: list[str] = []
        for a in args:
            if isinstance(a, Ref) and a.is_range:
                t = self.book.locate(a, self.t)
                if t is not self.t or a.top is None or a.top != a.bottom:
                    raise Unsupported(f"{name} over a block of cells")
                cells += [self.own(c) for c in t.columns[a.first : a.last + 1]]
            else:
                cells.append(self.sql(a))
        if not cells:
            raise Unsupported(f"{name} needs an argument")
        if name == "COUNT":
            return "(" + " + ".join(f"CASE WHEN {c} IS NULL THEN 0 ELSE 1 END" for c in cells) + ")"
        if name in ("MIN", "MAX"):
            if len(cells) == 1:
                return cells[0]
            word = name if self.dialect == "sqlite" else {"MIN": "LEAST", "MAX": "GREATEST"}[name]
            return f"{word}({', '.join(cells)})"
        total = "(" + " + ".join(f"COALESCE({c}, 0)" for c in cells) + ")"
        return total if name == "SUM" else f"({total} * 1.0 / {len(cells)})"


def _glob(pattern: str) -> str:
    """A LIKE pattern with escape character \\ as a GLOB pattern."""
    out, chars = [], iter(pattern)
    for c in chars:
        plain = next(chars, "") if c == "\\" else c
        out.append({"%": "*", "_": "?"}.get(c) or {"[": "[[]", "*": "[*]", "?": "[?]"}.get(plain, plain))
    return "".join(out)


def view_order(w: Workbook) -> list[str]:
    """Tables with formulas, each after those whose computed columns it reads; those of a cycle as they were added."""
    wait = {t.name: {name for c in t.formulas for name, x in w.needs(t, c) if name != t.name and w._computed(name, x)} for t in w.tables.values() if t.formulas}
    out: list[str] = []
    while len(out) < len(wait):
        left = {t: wait[t] - set(out) for t in wait if t not in out}
        try:
            out += [t for t in TopologicalSorter(left).static_order() if t in left]
        except CycleError:
            out.append(next(iter(left)))
    return out


def views(w: Workbook, dialect: str) -> str:
    """CREATE VIEW statements in the order in which they can be run."""
    if dialect not in DIALECTS:
        raise ValueError(f"a dialect is one of {', '.join(DIALECTS)}")
    out = []
    for name in view_order(w):
        t = w.tables[name]
        stored = [c for c in t.columns if c in t.df.columns and (c not in t.formulas or t.formulas[c].included) and c not in t.dropped]
        columns, notes = [f"t.{quoted(c)}" for c in stored], []
        for c in (c for c in t.columns if c in t.formulas):
            text = _Text(w, t, c, dialect)
            columns.append(f"{text.whole()} AS {quoted(t.output(c))}")
            notes += [f"-- {t.output(c)}: {n}" for n in text.notes]
        out += [*notes, f"CREATE VIEW {quoted(name + '_v')} AS\nSELECT " + ",\n  ".join(columns) + f"\nFROM {quoted(name)} t;"]
    return "\n".join(out) + ("\n" if out else "")


def script(w: Workbook, folder: str) -> str:
    """A PySpark script that reads the tables from folder/<table> as Parquet and registers the views."""
    lines = ["from pyspark.sql import SparkSession", "", "from gridloom.plans.workbook import Workbook", "", "spark = SparkSession.builder.getOrCreate()", "w = Workbook(spark)"]
    for t in w.tables.values():
        lines.append(f"w.add({t.name!r}, spark.read.parquet({f'{folder}/{t.name}'!r}), {t.first_by!r}, {t.file!r}, {t.sheet!r}, {t.books!r})")
        if t.dropped:
            lines.append(f"w.drop({t.name!r}, *{sorted(t.dropped)!r})")
        lines += [f"w.derive({t.name!r}, {c!r}, {f.formula!r}, included={f.included})" for c, f in t.formulas.items()]
    return "\n".join([*lines, "w.register_views()"]) + "\n"


def kinds_of(w: Workbook) -> dict[str, dict[str, str]]:
    """The stored columns of each table with their kinds, for a sink."""
    out = {}
    for t in w.tables.values():
        kept = [f for f in t.df.schema if f.name not in t.dropped and (f.name not in t.formulas or t.formulas[f.name].included)]
        out[t.name] = {f.name: "text" if (k := kind_of(f.dataType)) == "null" else k for f in kept}
    return out
