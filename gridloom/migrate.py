"""From analysed workbooks to a database: tables in order, views on them, and a report."""

from __future__ import annotations

import sqlite3
from dataclasses import asdict, dataclass, field

from pyspark.sql import SparkSession

from gridloom.plans import sqltext
from gridloom.plans.analysis import Analysis, Issue
from gridloom.sinks import postgres, relational


@dataclass
class Report:
    target: str
    #: Rows of each table, or why it failed.
    tables: dict[str, int | str] = field(default_factory=dict)
    views: list[str] = field(default_factory=list)
    issues: list[Issue] = field(default_factory=list)

    @property
    def failed(self) -> bool:
        return any(isinstance(n, str) for n in self.tables.values()) or any(i.level == "error" for i in self.issues)

    def as_dict(self) -> dict:
        return asdict(self) | {"failed": self.failed}


def _parts(a: Analysis):
    kinds = {t.name: t.kinds() for t in a.tables}
    keys = {t.name: k if (k := t.key()) in kinds[t.name] else None for t in a.tables}
    return kinds, keys, a.keys


def plan(a: Analysis, target: str) -> dict:
    """What migrate() would do, without doing it."""
    kinds, keys, links = _parts(a)
    rows = {t.name: t.row_count for t in a.tables}
    return (postgres.report if target == "postgres" else relational.report)(kinds, keys, links, rows)


def migrate(spark: SparkSession, a: Analysis, target: str, out: str, exclude: list[str] | None = None, with_views: bool = True) -> Report:
    """target: sqlite (out is a file), postgres (out is an address) or dump (out is a folder). Columns of exclude are left out; derived ones among them are computed by the views."""
    a = a.without(exclude or [])
    kinds, keys, links = _parts(a)
    report = Report(target, issues=[i for i in a.issues if i.code == "column_excluded"])
    found = (relational.validate if target == "sqlite" else postgres.validate)(kinds)
    report.issues += [Issue(p.level, p.code, p.message) for p in found]
    if any(p.level == "error" for p in found):
        report.issues.append(Issue("warning", "views_skipped", "tables can't be created"))
        return report
    checked = relational.broken_keys(a.frames, kinds, keys, links)
    broken = checked[1]
    report.issues += [Issue("warning", code, message) for code, message in relational.plan(kinds, keys, links, broken).issues]
    w = a.workbook(spark)
    text = sqltext.views(w, "sqlite" if target == "sqlite" else "postgres") if with_views else ""
    if target == "sqlite":
        report.tables = relational.write_sqlite(out, a.frames, kinds, keys, links, checked)
        late = relational.plan(kinds, keys, links, broken).deferred
        report.issues += [Issue("info", "fk_not_created", f"{k.table}.{k.column}: SQLite can't add a key afterwards") for k in late]
        if not _skipped(report, text):
            _create_views(out, text, report)
    elif target == "postgres":
        told = lambda view, why: report.issues.append(Issue("warning", "view_not_created", f"{view}: {why}"))
        report.tables = postgres.write(out, a.frames, kinds, keys, links, text, checked, told)
        if not _skipped(report, text):
            missing = {i.message.partition(":")[0] for i in report.issues if i.code == "view_not_created"}
            report.views = [v for t in sqltext.view_order(w) if (v := f"{t}_v") not in missing] if with_views else []
    elif target == "dump":
        report.tables = postgres.dump(spark, out, a.frames, kinds, keys, links, text, checked)
        if not _skipped(report, text):
            report.views = [f"{t}_v" for t in sqltext.view_order(w)] if with_views else []
    else:
        raise ValueError("a target is sqlite, postgres or dump")
    return report


def _skipped(report: Report, text: str) -> bool:
    """Views stand on all tables, so none is created where one failed."""
    failed = [t for t, n in report.tables.items() if isinstance(n, str)]
    if failed and text:
        report.issues.append(Issue("warning", "views_skipped", f"not loaded: {', '.join(failed)}"))
    return bool(failed)


def _create_views(path: str, text: str, report: Report) -> None:
    statements = postgres.view_statements(text)
    with sqlite3.connect(path) as db:
        for s in statements:
            name = s.split('"')[1]
            try:
                db.execute(s)
                db.execute(f'SELECT * FROM "{name}" LIMIT 1').fetchall()
                report.views.append(name)
            except sqlite3.Error as e:
                report.issues.append(Issue("warning", "view_not_created", f"{name}: {e}"))
    db.close()
