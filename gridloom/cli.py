"""Command line: analyze, erd, formulas, lineage, translate and migrate workbooks. Exit code 1: no tables or a failed load; 2: bad arguments."""

from __future__ import annotations

import argparse
import json
import sys
from collections import Counter
from dataclasses import asdict

from pyspark.sql import SparkSession

from gridloom.migrate import migrate, plan
from gridloom.plans import sqltext
from gridloom.plans.analysis import Analysis, analyze, lineage
from gridloom.sinks.relational import erd

TARGETS = ("sqlite", "postgres", "dump")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="gridloom", description=__doc__)
    commands = p.add_subparsers(dest="command", required=True)

    def command(name: str, text: str) -> argparse.ArgumentParser:
        c = commands.add_parser(name, help=text)
        c.add_argument("paths", nargs="+", help="workbooks, or folders of them")
        return c

    command("analyze", "the schema with its keys and issues, as JSON")
    command("erd", "an entity-relationship diagram, as Mermaid text")
    command("formulas", "functions and formulas by column").add_argument("--json", action="store_true")
    c = command("lineage", "flows between columns, sheets or files, as Mermaid text")
    c.add_argument("--level", choices=("column", "sheet", "file"), default="sheet")
    c.add_argument("--json", action="store_true")
    c = command("translate", "views that recompute derived columns")
    c.add_argument("--exclude", action="append", default=[], metavar="TABLE.COLUMN")
    c.add_argument("--format", choices=("summary", "sqlite", "postgres", "pyspark", "json"), default="summary")
    c = command("migrate", "load into a database")
    c.add_argument("--target", choices=TARGETS, default="sqlite")
    c.add_argument("--exclude", action="append", default=[], metavar="TABLE.COLUMN")
    c.add_argument("--out", required=True, help="a file, an address or a folder")
    c.add_argument("--plan", action="store_true", help="say what would be done only")
    c.add_argument("--no-views", action="store_true")
    return p


def _formulas(a: Analysis) -> str:
    lines = [f"{n} {k}" for n, k in a.function_totals().items()]
    for file, rows in a.by_file().items():
        lines += ["", file, *[f"  {r['table']}.{r['column']}: {r['formulas']} formulas{', derived' if r['derived'] else ''}: {r['sample']}" for r in rows]]
    return "\n".join(lines)


def _translated(spark: SparkSession, a: Analysis, form: str) -> str:
    w = a.workbook(spark)
    if form in sqltext.DIALECTS:
        return sqltext.views(w, form)
    if form == "pyspark":
        return sqltext.script(w, "data")
    found = w.translations()
    if form == "json":
        return json.dumps([asdict(t) for t in found], ensure_ascii=False, indent=1)
    counts = Counter(t.status for t in found)
    head = ", ".join(f"{counts[s]} {s}" for s in ("ok", "partial", "unsupported"))
    return "\n".join([head, *[f"{t.table}.{t.output}: {t.status}" + "".join(f"; {n}" for n in t.notes) for t in found]])


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    o = parser().parse_args(args)
    spark = spark or SparkSession.builder.appName("gridloom").getOrCreate()
    a = analyze(spark, o.paths)
    if not a.tables:
        print("no tables", *[f"{i.code}: {i.message}" for i in a.issues], sep="\n", file=sys.stderr)
        return 1
    try:
        kept = a.without(getattr(o, "exclude", []))
    except ValueError as e:
        print(e, file=sys.stderr)
        return 2
    match o.command:
        case "analyze":
            print(a.to_json())
        case "erd":
            said = {(t.name, c.name): ", ".join(x for x, yes in (("derived", c.derived), ("not null", not c.nullable and not c.primary_key)) if yes) for t in a.tables for c in t.columns}
            print(erd({t.name: t.kinds() for t in a.tables}, {t.name: t.key() for t in a.tables}, a.keys, said), end="")
        case "formulas":
            print(json.dumps({"functions": a.function_totals(), "files": a.by_file()}, ensure_ascii=False, indent=1) if o.json else _formulas(a))
        case "lineage":
            found = lineage(a).at_level(o.level)
            print(found.to_json() if o.json else found.flowchart(), end="")
        case "translate":
            print(_translated(spark, kept, o.format))
        case "migrate" if o.plan:
            print(json.dumps(plan(kept, o.target), indent=1))
        case "migrate":
            report = migrate(spark, a, o.target, o.out, o.exclude, not o.no_views)
            print(json.dumps(report.as_dict(), ensure_ascii=False, indent=1))
            return int(report.failed)
    return 0


if __name__ == "__main__":
    sys.exit(main())
