"""What formulas are made of: functions, kinds of flow, an inventory, and lineage between columns, sheets and files.

Only distinct formulas and the names of columns are handled on the driver; counts of formula cells stay in DataFrames.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.plans.formula import Call, Node, ParseError, Ref, parse, walk
from gridloom.plans.workbook import CONDITIONAL, DYNAMIC, LOOKUPS, Table, Unsupported, Workbook

#: Functions that make a flow an aggregate (those with conditions only) or a join.
_AGGREGATES = tuple(CONDITIONAL)
_JOINS = (*LOOKUPS, "HLOOKUP", "LOOKUP", "MATCH", "XMATCH")
#: Share of a column's rows that are formulas from which on it is derived.
DERIVED = 0.5


def function_names(formula: str) -> list[str]:
    """Names of called functions in upper case, in order, repeats included; quoted text is passed over."""
    plain = re.sub(r'"[^"]*"|\'[^\']*\'', "", formula)
    return [re.sub(r"^(_XLFN\.|_XLWS\.)+", "", n.upper()) for n in re.findall(r"([^\W\d][\w.]*)\s*\(", plain)]


def classify(formula: str) -> str:
    """join, aggregate, copy (a single reference) or calculate."""
    names = function_names(formula)
    if any(n in _JOINS for n in names):
        return "join"
    if any(n in _AGGREGATES for n in names):
        return "aggregate"
    try:
        return "copy" if isinstance(parse(formula), Ref) else "calculate"
    except ParseError:
        return "calculate"


def sources(node: Node) -> list[Ref]:
    """The first column of each reference, and the column that a VLOOKUP returns; each once."""
    out: dict[Ref, None] = {}
    for n in walk(node):
        if isinstance(n, Ref):
            out[Ref(n.first, n.first, None, None, n.sheet, n.book)] = None
        if isinstance(n, Call) and n.name == "VLOOKUP" and len(n.args) > 2 and isinstance(n.args[1], Ref) and hasattr(n.args[2], "value"):
            r, at = n.args[1], n.args[1].first + int(n.args[2].value) - 1
            out[Ref(at, at, None, None, r.sheet, r.book)] = None
    return list(out)


def inventory(cells: DataFrame) -> DataFrame:
    """cells: file, sheet, col, formula. For each column that has formulas: formulas (their number), sample (the least), functions (name to number)."""
    plain = F.regexp_replace("formula", r"\"[^\"]*\"|'[^']*'", "")
    called = F.transform(F.regexp_extract_all(plain, F.lit(r"([\p{L}_][\w.]*)\s*\("), 1), lambda n: F.regexp_replace(F.upper(n), r"^(_XLFN\.|_XLWS\.)+", ""))
    found = cells.where(F.col("formula").startswith("="))
    key = ["file", "sheet", "col"]
    counts = found.groupBy(*key).agg(F.count("*").alias("formulas"), F.min("formula").alias("sample"))
    uses = found.select(*key, F.explode(called).alias("name")).groupBy(*key, "name").agg(F.count("*").alias("n"))
    maps = uses.groupBy(*key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "n")))).alias("functions"))  # as many as there are functions
    return counts.join(maps, key, "left")


def function_totals(found: DataFrame) -> DataFrame:
    """name and n over an inventory, the most frequent first, then by name."""
    return found.select(F.explode("functions").alias("name", "k")).groupBy("name").agg(F.sum("k").alias("n")).orderBy(F.desc("n"), "name")


@dataclass(frozen=True)
class Edge:
    source: str
    target: str
    op: str
    #: The table whose rows hold the formula: an edge's weight is its number of rows.
    table: str


def edges(w: Workbook) -> list[Edge]:
    """Column-level edges of a workbook's formula columns. Columns that no table has are named by letters in ?<sheet>."""
    out: dict[Edge, None] = {}
    for t in w.tables.values():
        for column, f in t.formulas.items():
            op, to = classify(f.formula), f"{t.name}.{column}"
            if any(n in DYNAMIC for n in function_names(f.formula)):
                out[Edge(f"dynamic:{t.file}", to, "dynamic", t.name)] = None
            try:
                refs = sources(parse(f.formula))
            except ParseError:
                continue
            for r in refs:
                out[Edge(_named(w, r, t), to, op, t.name)] = None
    return list(out)


def _named(w: Workbook, ref: Ref, here: Table) -> str:
    try:
        t = w.locate(ref, here)
        return f"{t.name}.{t.columns[ref.first]}"
    except Unsupported:
        return f"?{ref.sheet or here.name}.{ref.first}"


def weighted(w: Workbook) -> DataFrame:
    """source, target, op, weight: the number of formula cells behind each edge."""
    found = edges(w)
    names = sorted({e.table for e in found})
    rows = w.spark.createDataFrame([(e.source, e.target, e.op, e.table) for e in found], "source string, target string, op string, table string")
    sizes = None
    for n in names:
        one = w.tables[n].df.agg(F.count("*").alias("weight")).withColumn("table", F.lit(n))
        sizes = one if sizes is None else sizes.unionByName(one)
    return rows.withColumn("weight", F.lit(0).cast("bigint")).drop("table") if sizes is None else rows.join(F.broadcast(sizes), "table").groupBy("source", "target", "op").agg(F.sum("weight").alias("weight"))  # a row for each table


def at_level(found: DataFrame, groups: DataFrame) -> DataFrame:
    """Edges contracted: groups maps node to group; flows inside a group go, weights add up, nodes without a group stay."""
    for side in ("source", "target"):
        mapped = groups.select(F.col("node").alias(side), F.col("group").alias(f"_{side}"))
        found = found.join(mapped, side, "left").withColumn(side, F.coalesce(f"_{side}", side)).drop(f"_{side}")
    return found.where("source <> target").groupBy("source", "target", "op").agg(F.sum("weight").alias("weight"))


def tables_of(w: Workbook) -> DataFrame:
    """node and group: each column's table."""
    return w.spark.createDataFrame([(f"{t.name}.{c}", t.name) for t in w.tables.values() for c in t.columns], "node string, group string")


def _ids(names) -> dict[str, str]:
    return {n: f"n{i}" for i, n in enumerate(names)}


def _quoted(text: str) -> str:
    return text.replace('"', "#quot;")


def flowchart(rows: list) -> str:
    """Mermaid text of weighted edges (rows with source, target, op, weight): dashed for copies and dynamic ones."""
    ids = _ids(sorted({x for r in rows for x in (r["source"], r["target"])}))
    lines = ["flowchart LR", *(f'  {i}["{_quoted(n)}"]' for n, i in ids.items())]
    for r in sorted(rows, key=lambda r: (r["source"], r["target"], r["op"])):
        arrow = "-.->" if r["op"] in ("copy", "dynamic") else "-->"
        lines.append(f'  {ids[r["source"]]} {arrow}|"{r["op"]} ×{r["weight"]}"| {ids[r["target"]]}')
    return "\n".join(lines) + "\n"
