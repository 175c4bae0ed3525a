"""Workbooks end to end: files to tables, formulas, keys with evidence, lineage, and a workbook whose views recompute.

Cells are parsed once and kept by Spark. What reaches the driver is a row for each sheet, column, file and shape of formula (a
formula without its row numbers), however many rows the sheets have.
"""

from __future__ import annotations

import json
from collections import defaultdict
from dataclasses import asdict, dataclass, field, replace

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.operators.profile import ForeignKey, foreign_keys, primary_key, profile
from gridloom.plans.formula import Call, ParseError, Ref, column_letters, parse, walk
from gridloom.plans.lineage import DERIVED, classify, function_names, sources
from gridloom.plans.workbook import DYNAMIC, Variant, Workbook
from gridloom.sources import xlsx

#: Functions whose arguments show that a column looks another sheet up.
BY_KEY = ("VLOOKUP", "XLOOKUP")
BY_CRITERIA = ("SUMIF", "COUNTIF", "AVERAGEIF", "SUMIFS", "COUNTIFS", "AVERAGEIFS")
#: The column that holds a row's place in its sheet.
ROW = "__row"


@dataclass(frozen=True)
class Issue:
    level: str  # info, warning or error
    code: str
    message: str
    file: str = ""
    sheet: str = ""
    table: str = ""
    column: str = ""


@dataclass
class ColumnInfo:
    name: str
    kind: str
    null_ratio: float = 0.0
    nullable: bool = False
    max_length: int | None = None
    primary_key: bool = False
    derived: bool = False
    formula: str | None = None
    include: bool = True


@dataclass
class TableInfo:
    name: str
    file: str
    sheet: str
    header_row: int
    row_count: int
    columns: list[ColumnInfo]

    def key(self) -> str | None:
        return next((c.name for c in self.columns if c.primary_key), None)

    def kinds(self) -> dict[str, str]:
        return {c.name: c.kind for c in self.columns if c.include}


@dataclass
class Shape:
    """Formulas of one column that differ by row numbers and by constants only: the first of them and their number."""

    table: str
    file: str
    sheet: str
    col: int
    column: str
    formula: str
    cells: int
    #: What the formulas have in common, and which of their numbers (from 0) differ from cell to cell.
    text: str = ""
    varies: list[int] = field(default_factory=list)


@dataclass
class Analysis:
    tables: list[TableInfo]
    keys: list[ForeignKey] = field(default_factory=list)
    issues: list[Issue] = field(default_factory=list)
    shapes: list[Shape] = field(default_factory=list)
    books: dict[str, list[str]] = field(default_factory=dict)
    frames: dict[str, DataFrame] = field(default_factory=dict, repr=False)
    #: The cells that were read, for columns whose formulas differ; None where the analysis was loaded.
    cells: DataFrame | None = field(default=None, repr=False)

    def close(self) -> None:
        """Let go of the cells and sheets that Spark keeps."""
        for df in [*self.frames.values(), *([self.cells] if self.cells is not None else [])]:
            df.unpersist()

    def table(self, name: str) -> TableInfo:
        return next(t for t in self.tables if t.name == name)

    def at(self, file: str, sheet: str) -> TableInfo | None:
        return next((t for t in self.tables if (t.file, t.sheet.lower()) == (file, sheet.lower())), None)

    def file_of(self, ref: Ref, here: str) -> str:
        """The file a reference means; an unknown number stays as it is written."""
        if ref.book is None:
            return here
        known = self.books.get(here, [])
        return known[int(ref.book) - 1] if ref.book.isdigit() and 0 < int(ref.book) <= len(known) else ref.book

    # exclusion, editing and binding

    def without(self, columns: list[str]) -> Analysis:
        """A copy in which the columns (table.column) are left out, and with them the foreign keys from and to them."""
        gone = set()
        for c in columns:
            table, _, column = c.partition(".")
            if not any(t.name == table and any(x.name == column for x in t.columns) for t in self.tables):
                raise ValueError(f"no column {c}")
            gone.add((table, column))
        tables = [replace(t, columns=[replace(c, include=c.include and (t.name, c.name) not in gone) for c in t.columns]) for t in self.tables]
        dropped = [k for k in self.keys if (k.table, k.column) in gone or (k.target, k.key) in gone]
        more = [Issue("info", "column_excluded", f"{k.table}.{k.column} no longer refers to {k.target}.{k.key}", table=k.table, column=k.column) for k in dropped]
        return replace(self, tables=tables, keys=[k for k in self.keys if k not in dropped], issues=self.issues + more)

    def bound(self, tables: list[TableInfo]) -> Analysis:
        """The data under an edited schema: the same tables in the same order with as many columns, named anew."""
        if len(tables) != len(self.tables):
            raise ValueError(f"{len(tables)} tables for data of {len(self.tables)}")
        frames = {}
        for old, new in zip(self.tables, tables, strict=True):
            if len(old.columns) != len(new.columns):
                raise ValueError(f"{new.name}: {len(new.columns)} columns for data of {len(old.columns)}")
            frames[new.name] = self.frames[old.name].toDF(*[c.name for c in new.columns], ROW)
        named = {(o.name, c.name): (n.name, x.name) for o, n in zip(self.tables, tables, strict=True) for c, x in zip(o.columns, n.columns, strict=True)}
        keys = [ForeignKey(*named[k.table, k.column], *named[k.target, k.key], k.confidence) for k in self.keys]
        shapes = [replace(s, table=named[s.table, s.column][0], column=named[s.table, s.column][1]) for s in self.shapes]
        return replace(self, tables=tables, keys=keys, frames=frames, shapes=shapes)

    # reports

    def inventory(self) -> list[dict]:
        """A row for each column with formulas: file, sheet, column, formulas, derived, first formula, functions, books, dynamic."""
        out: dict[tuple, dict] = {}
        for s in self.shapes:
            row = out.setdefault((s.table, s.column), {"file": s.file, "sheet": s.sheet, "table": s.table, "column": s.column, "formulas": 0, "sample": s.formula, "functions": defaultdict(int), "books": [], "dynamic": 0})
            row["formulas"] += s.cells
            for n in function_names(s.formula):
                row["functions"][n] += s.cells
            row["dynamic"] += s.cells if any(n in DYNAMIC for n in function_names(s.formula)) else 0
            for b in _books(self, s):
                if b not in row["books"]:
                    row["books"].append(b)
        for (t, _), row in out.items():
            row["derived"] = row["formulas"] >= DERIVED * max(1, self.table(t).row_count)
            row["functions"] = dict(sorted(row["functions"].items()))
        return list(out.values())

    def by_file(self) -> dict[str, list[dict]]:
        out: dict[str, list[dict]] = {}
        for r in self.inventory():
            out.setdefault(r["file"], []).append(r)
        return out

    def function_totals(self, file: str | None = None) -> dict[str, int]:
        """Uses of each function, the most frequent first, then by name."""
        total: dict[str, int] = defaultdict(int)
        for r in self.inventory():
            if file in (None, r["file"]):
                for n, k in r["functions"].items():
                    total[n] += k
        return dict(sorted(total.items(), key=lambda x: (-x[1], x[0])))

    def workbook(self, spark: SparkSession) -> Workbook:
        """The tables with their derived columns; those left out are computed, those kept are read and get a twin."""
        w = Workbook(spark)
        for t in self.tables:
            mixed = {c.name: own for c in t.columns if c.derived and self.cells is not None and ((own := [s for s in self.shapes if (s.table, s.column) == (t.name, c.name)])[1:] or any(s.varies for s in own))}
            frame, hidden = self._marked(t, mixed)
            w.add(t.name, frame, [ROW], t.file, t.sheet, self.books.get(t.file, []), t.header_row + 1)
            w.drop(t.name, ROW, *hidden, *[c.name for c in t.columns if not c.include and not c.derived])
            for c in t.columns:
                if c.derived and c.formula:
                    variants = [Variant(f"__shape_{s.col}", i, s.formula, {k: f"__number_{s.col}_{k}" for k in s.varies}) for i, s in enumerate(mixed.get(c.name, []))]
                    w.derive(t.name, c.name, c.formula, included=c.include, variants=variants)
        return w

    def _marked(self, t: TableInfo, mixed: dict[str, list[Shape]]) -> tuple[DataFrame, list[str]]:
        """The table's rows with the shape (its place in the list) of each mixed column's formula and the numbers in which it differs."""
        frame, hidden = self.frames[t.name], []
        if not mixed:
            return frame, hidden
        own = with_shapes(self.cells.where((F.col("file") == t.file) & (F.col("sheet") == t.sheet)))
        marks = []
        for shapes in mixed.values():
            here = F.col("col") == shapes[0].col
            at = F.coalesce(*[F.when(F.col("shape") == s.text, i) for i, s in enumerate(shapes)])
            marks.append(F.max(F.when(here, at)).alias(f"__shape_{shapes[0].col}"))
            marks += [F.max(F.when(here, F.get("numbers", F.lit(k)).cast("double"))).alias(f"__number_{shapes[0].col}_{k}") for k in sorted({k for s in shapes for k in s.varies})]
        by_row = own.groupBy(F.col("row").alias("__at")).agg(*marks)
        hidden = by_row.columns[1:]
        return frame.join(by_row, F.col(ROW) == F.col("__at"), "left").select(*frame.columns, *hidden), hidden

    # artifacts

    def to_json(self) -> str:
        return json.dumps({k: [asdict(x) for x in getattr(self, k)] for k in ("tables", "keys", "issues", "shapes")} | {"books": self.books}, ensure_ascii=False, indent=1)

    @classmethod
    def from_json(cls, text: str) -> Analysis:
        d = json.loads(text)
        tables = [TableInfo(**{**t, "columns": [ColumnInfo(**c) for c in t["columns"]]}) for t in d["tables"]]
        return cls(tables, [ForeignKey(**k) for k in d["keys"]], [Issue(**i) for i in d["issues"]], [Shape(**s) for s in d["shapes"]], d["books"])

    def save(self, spark: SparkSession, folder: str) -> None:
        """The schema as JSON in one row, and each table with columns by their places, as Parquet in any store that Spark writes to."""
        spark.createDataFrame([(self.to_json(),)], "value string").coalesce(1).write.mode("overwrite").parquet(f"{folder}/schema")
        for i, t in enumerate(self.tables):
            self.frames[t.name].toDF(*[f"c{j}" for j in range(len(t.columns))], ROW).write.mode("overwrite").parquet(f"{folder}/data/t{i}")

    @classmethod
    def load(cls, spark: SparkSession, folder: str) -> Analysis:
        out = cls.from_json(spark.read.parquet(f"{folder}/schema").first()[0])
        for i, t in enumerate(out.tables):
            out.frames[t.name] = spark.read.parquet(f"{folder}/data/t{i}").toDF(*[c.name for c in t.columns], ROW)
        return out


def analyze(spark: SparkSession, path: str | list[str], infer_keys: bool = True) -> Analysis:
    """All workbooks under the paths."""
    found = xlsx.cells(spark, path).persist(StorageLevel.MEMORY_AND_DISK)
    files = xlsx.file_names(spark, path)
    issues = [Issue("warning", "unsupported_file", f"{f} isn't a workbook", f) for f in files if not f.lower().endswith((".xlsx", ".xlsm"))]
    issues += [Issue("error", "unreadable_file", f"{r['file']}: {r['why']}", r["file"]) for r in xlsx.damaged(spark, path).orderBy("file").collect()]
    books: dict[str, list[str]] = {}
    for r in sorted(xlsx.books(spark, path).collect(), key=lambda r: (r["file"], r["place"])):
        books.setdefault(r["file"], []).append(r["book"])
    sheets = xlsx.tables(found)
    known = {(s.file, s.sheet) for s in sheets}
    for r in found.select("file", "sheet").distinct().orderBy("file", "sheet").collect():
        if (r["file"], r["sheet"]) not in known:
            issues.append(Issue("warning", "no_header", f"no header in {r['sheet']}", r["file"], r["sheet"]))
    out = Analysis([], issues=issues, books=books)
    for s in sheets:
        frame = s.df.withColumnRenamed("row", ROW).select(*s.columns, ROW).persist(StorageLevel.MEMORY_AND_DISK)
        facts = {r["name"]: r for r in profile(frame.drop(ROW)).collect()}
        rows = frame.count()
        columns = [ColumnInfo(c, k, facts[c]["null_ratio"], facts[c]["nullable"], facts[c]["max_length"]) for c, k in zip(s.columns, s.kinds, strict=True)]
        out.tables.append(TableInfo(s.name, s.file, s.sheet, s.header_row, rows, columns))
        out.frames[s.name] = frame
        out.issues += [Issue("warning", x, f"a column of {s.sheet} has no title", s.file, s.sheet, s.name) for x in s.issues]
    out.cells = found
    out.shapes = _shapes(found, out)
    _mark(out)
    if infer_keys:
        _infer(out)
    return out


#: A number that is a constant of a formula, and how many numbers a formula may have for them to be told apart from its shape.
NUMBER = r"(?<![A-Za-z0-9_$.:!])(?:\d+(?:\.\d*)?|\.\d+)(?:[eE][+-]?\d+)?(?![A-Za-z0-9_.!(])"
MOST_NUMBERS = 8


def with_shapes(found: DataFrame) -> DataFrame:
    """Cells that hold formulas, with shape (the formula without row numbers and constants) and numbers (the constants, as texts).

    Formulas with texts or quoted names, or with very many numbers, keep their constants in the shape.
    """
    # A # in place of each row number, and one after each text or quoted name, whose digits stay.
    rows = F.regexp_replace("formula", r"""("[^"]*"|'[^']*')|(?<=[A-Za-z$])\d+(?![\dA-Za-z_.!])""", "$1#")
    numbers = F.when(~F.col("formula").rlike("[\"']"), F.regexp_extract_all("formula", F.lit(NUMBER), F.lit(0)))
    cells = found.where(F.col("formula").startswith("=")).withColumn("numbers", numbers)
    lifted = F.size("numbers").between(1, MOST_NUMBERS)
    return cells.withColumn("shape", F.when(lifted, F.regexp_replace(rows, NUMBER, "?")).otherwise(rows)).withColumn("numbers", F.when(lifted, F.col("numbers")))


def _shapes(found: DataFrame, out: Analysis) -> list[Shape]:
    """Formulas below the headers, by column and shape. What reaches the driver is a row for each shape, however many constants there are."""
    rows = with_shapes(found).groupBy("file", "sheet", "col", "shape", "row").agg(F.first("formula").alias("formula"), F.first("numbers").alias("numbers"))
    heads = {(t.file, t.sheet): t for t in out.tables}
    spark = found.sparkSession
    if not heads:
        return []
    header = spark.createDataFrame([(*k, t.header_row, len(t.columns)) for k, t in heads.items()], "file string, sheet string, header int, width int")
    below = rows.join(F.broadcast(header), ["file", "sheet"]).where((F.col("row") > F.col("header")) & (F.col("col") < F.col("width")))  # a row for each sheet
    differs = [F.coalesce(F.min(F.get("numbers", F.lit(k))) != F.max(F.get("numbers", F.lit(k))), F.lit(False)).alias(f"v{k}") for k in range(MOST_NUMBERS)]
    got = below.groupBy("file", "sheet", "col", "shape").agg(F.min_by("formula", "row").alias("formula"), F.min("row").alias("row"), F.count("*").alias("n"), *differs).collect()
    got.sort(key=lambda r: (r["file"], r["sheet"], r["col"], r["row"]))
    return [Shape((t := heads[r["file"], r["sheet"]]).name, r["file"], r["sheet"], r["col"], t.columns[r["col"]].name, r["formula"], r["n"], r["shape"], [k for k in range(MOST_NUMBERS) if r[f"v{k}"]]) for r in got]


def _books(a: Analysis, s: Shape) -> list[str]:
    try:
        refs = [n for n in walk(parse(s.formula)) if isinstance(n, Ref) and n.book is not None]
    except ParseError:
        return []
    return list(dict.fromkeys(a.file_of(r, s.file) for r in refs))


def _mark(a: Analysis) -> None:
    """Derived columns, and what formulas can't be followed to."""
    files = {t.file for t in a.tables}
    for r in a.inventory():
        column = next(c for c in a.table(r["table"]).columns if c.name == r["column"])
        column.derived, column.formula = r["derived"], r["sample"]
    for t in a.tables:
        own = [s for s in a.shapes if s.table == t.name]
        for c in t.columns:
            if c.derived and (n := len([s for s in own if s.column == c.name])) > 1:
                a.issues.append(Issue("info", "mixed_formulas", f"{c.name} has formulas of {n} kinds", t.file, t.sheet, t.name, c.name))
        empty = [c for c in t.columns if c.derived and c.null_ratio == 1.0]
        a.issues += [Issue("info", "formula_cache_empty", f"{c.name} has no cached values", t.file, t.sheet, t.name, c.name) for c in empty]
        for book in dict.fromkeys(b for s in own for b in _books(a, s) if b not in files):
            cached = all(next(c for c in t.columns if c.name == s.column).null_ratio < 1.0 for s in own if book in _books(a, s))
            a.issues.append(Issue("info" if cached else "warning", "missing_referenced_workbook", f"{book} isn't there", t.file, t.sheet, t.name))
        dynamic = sum(s.cells for s in own if any(n in DYNAMIC for n in function_names(s.formula)))
        if dynamic:
            a.issues.append(Issue("info", "dynamic_reference", f"{dynamic} formulas find their target when they run", t.file, t.sheet, t.name))


def evidence(a: Analysis) -> dict[tuple[str, str], tuple[str, str]]:
    """(table, column) of a plain key cell of the own sheet to the (table, column) of another sheet that formulas look it up in; the last one counts."""
    out: dict[tuple[str, str], tuple[str, str]] = {}
    for s in a.shapes:
        try:
            calls = [n for n in walk(parse(s.formula)) if isinstance(n, Call)]
        except ParseError:
            continue
        here = a.table(s.table)
        for c in calls:
            if c.name in BY_KEY and len(c.args) > 1:
                pairs = [(c.args[0], c.args[1])]
            elif c.name in BY_CRITERIA:
                rest = c.args[1:] if c.name in ("SUMIFS", "AVERAGEIFS") else c.args[:2] if c.name in ("SUMIF", "COUNTIF", "AVERAGEIF") else c.args
                pairs = list(zip(rest[1::2], rest[::2], strict=False))
            else:
                continue
            for key, target in pairs:
                if not (isinstance(key, Ref) and key.sheet is None and not key.is_range and isinstance(target, Ref) and target.sheet is not None):
                    continue
                there = a.at(a.file_of(target, s.file), target.sheet)
                if there is not None and there is not here and key.first < len(here.columns) and target.first < len(there.columns):
                    out[here.name, here.columns[key.first].name] = (there.name, there.columns[target.first].name)
    return out


def _infer(a: Analysis) -> None:
    stored = {t.name: a.frames[t.name].select(*[c.name for c in t.columns if not c.derived]) for t in a.tables}
    keys = {t: primary_key(df) if df.columns else None for t, df in stored.items()}
    for t in a.tables:
        for c in t.columns:
            c.primary_key = c.name == keys[t.name]
    looked = {(t, c, other) for (t, c), (other, key) in evidence(a).items() if keys.get(other) == key}
    a.keys = foreign_keys(stored, keys, looked, {t.name: t.file for t in a.tables})


# lineage


@dataclass(frozen=True)
class LineageNode:
    id: str
    label: str
    file: str = ""
    sheet: str = ""
    missing: bool = False
    dynamic: bool = False


@dataclass
class Lineage:
    nodes: dict[str, LineageNode]
    #: (source, target, kind of flow): formula cells.
    edges: dict[tuple[str, str, str], int]

    def at_level(self, level: str) -> Lineage:
        """Columns made sheets or files: flows inside one go, weights add up; a group is missing if all its members are, and dynamic nodes stay."""
        if level == "column":
            return self

        def group(n: LineageNode) -> LineageNode:
            if n.dynamic:
                return n
            if level == "sheet":
                return LineageNode(f"sheet:{n.file}/{n.sheet}", n.sheet, n.file, n.sheet)
            return LineageNode(f"file:{n.file}", n.file, n.file)

        to = {i: group(n) for i, n in self.nodes.items()}
        nodes: dict[str, LineageNode] = {}
        for i, g in to.items():
            before = nodes.get(g.id)
            nodes[g.id] = replace(g, missing=self.nodes[i].missing and (before is None or before.missing), dynamic=g.dynamic)
        edges: dict[tuple[str, str, str], int] = defaultdict(int)
        for (s, t, op), n in self.edges.items():
            if to[s].id != to[t].id:
                edges[to[s].id, to[t].id, op] += n
        return Lineage(nodes, dict(edges))

    def to_json(self) -> str:
        return json.dumps({"nodes": [asdict(n) for n in self.nodes.values()], "edges": [{"source": s, "target": t, "op": op, "weight": n} for (s, t, op), n in self.edges.items()]}, ensure_ascii=False, indent=1)

    def flowchart(self) -> str:
        """Mermaid text: a subgraph for each sheet or file with several nodes, dashed arrows for copies and dynamic ones, classes for missing and dynamic nodes."""
        ids = {n: f"n{i}" for i, n in enumerate(self.nodes)}
        groups: dict[str, list[LineageNode]] = {}
        for n in self.nodes.values():
            groups.setdefault(" / ".join(x for x in (n.file, n.sheet) if x and x != n.label), []).append(n)
        box = lambda n: f'{ids[n.id]}["{_quoted(n.label)}"]'
        lines = ["flowchart LR"]
        for i, (name, members) in enumerate(groups.items()):
            inside = [f"    {box(n)}" for n in members]
            lines += [f'  subgraph g{i}["{_quoted(name)}"]', *inside, "  end"] if name else [x[2:] for x in inside]
        for (s, t, op), n in sorted(self.edges.items()):
            lines.append(f'  {ids[s]} {"-.->" if op in ("copy", "dynamic") else "-->"}|"{op} ×{n}"| {ids[t]}')
        for kind in ("missing", "dynamic"):
            if marked := [ids[n.id] for n in self.nodes.values() if getattr(n, kind)]:
                lines.append(f"  class {','.join(marked)} {kind}")
        return "\n".join([*lines, "  classDef missing stroke-dasharray: 4", "  classDef dynamic fill:#eee"]) + "\n"


def _quoted(text: str) -> str:
    return text.replace('"', "#quot;")


def lineage(a: Analysis) -> Lineage:
    """Flows between columns, weighted by the formula cells behind them. What isn't there is a missing node named by its letters."""
    nodes: dict[str, LineageNode] = {}
    edges: dict[tuple[str, str, str], int] = defaultdict(int)

    def node(file: str, sheet: str, col: int) -> str:
        t = a.at(file, sheet)
        there = t is not None and col < len(t.columns)
        name = t.columns[col].name if there else column_letters(col)
        key = f"column:{file}/{sheet if t is None else t.sheet}/{name}"
        nodes.setdefault(key, LineageNode(key, name if there else f"{name} (missing)", file, sheet if t is None else t.sheet, missing=not there))
        return key

    for s in a.shapes:
        to, op = node(s.file, s.sheet, s.col), classify(s.formula)
        if any(n in DYNAMIC for n in function_names(s.formula)):
            key = f"dynamic:{s.file}"
            nodes.setdefault(key, LineageNode(key, "found at run time", s.file, dynamic=True))
            edges[key, to, "dynamic"] += s.cells
        try:
            refs = sources(parse(s.formula))
        except ParseError:
            continue
        for source in dict.fromkeys(node(a.file_of(r, s.file), r.sheet or s.sheet, r.first) for r in refs):
            edges[source, to, op] += s.cells
    return Lineage(nodes, dict(edges))
