"""Schemas as DDL, the order in which tables load, and a SQLite file.

A SQLite file is written by one process, so rows stream to the driver a partition at a time and are never held whole.
"""

from __future__ import annotations

import re
import sqlite3
from collections.abc import Callable
from dataclasses import asdict, dataclass, field
from itertools import chain, count
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators.coerce import lost, typed
from gridloom.operators.profile import ForeignKey, orphans

#: Rows of one insert.
BATCH = 1000
#: SQL types by kind.
SQL_TYPES = {"integer": "BIGINT", "float": "FLOAT", "boolean": "BOOLEAN", "date": "DATE", "datetime": "TIMESTAMP", "text": "TEXT"}


@dataclass(frozen=True)
class Problem:
    level: str
    code: str
    message: str


def validate(kinds: dict[str, dict[str, str]], names: list[str] | None = None) -> list[Problem]:
    """What keeps tables from being created. names: the tables as declared, where they may repeat."""
    listed = [n.lower() for n in names or list(kinds)]
    out = [Problem("error", "duplicate_table", f"{n} is there twice") for n in dict.fromkeys(listed) if listed.count(n) > 1]
    return out + [Problem("error", "no_columns", f"{t} has no columns") for t, cs in kinds.items() if not cs]


@dataclass
class Plan:
    #: Tables in loading order, the foreign keys that stand in CREATE TABLE, those added afterwards, and why others are left out.
    order: list[str]
    inline: list[ForeignKey] = field(default_factory=list)
    deferred: list[ForeignKey] = field(default_factory=list)
    #: Keys that rows break already: added afterwards for new rows only.
    unchecked: list[ForeignKey] = field(default_factory=list)
    issues: list[tuple[str, str]] = field(default_factory=list)


def plan(kinds: dict[str, dict[str, str]], keys: dict[str, str | None], links: list[ForeignKey], broken: dict[tuple[str, str], int] | None = None) -> Plan:
    """kinds: table to column to kind. What a table refers to loads before it; see load_order() for cycles. broken: rows that break a key (table, column)."""
    good, issues = [], []
    for k in links:
        if k.target not in kinds or keys.get(k.target) != k.key:
            issues.append(("fk_skipped", f"{k.table}.{k.column}: {k.target}.{k.key} isn't a primary key"))
        elif kinds[k.table][k.column] != kinds[k.target][k.key]:
            issues.append(("fk_skipped", f"{k.table}.{k.column}: its kind differs from {k.target}.{k.key}"))
        else:
            good.append(k)
    order, deferred = load_order(list(kinds), [k for k in good if k.table != k.target])
    issues += [("fk_cycle", f"{k.table}.{k.column} -> {k.target}.{k.key} is added after loading") for k in deferred]
    unchecked = [k for k in good if (broken or {}).get((k.table, k.column))]
    issues += [("fk_orphans", f"{k.table}.{k.column}: {broken[k.table, k.column]} rows refer to no {k.target}.{k.key}") for k in unchecked]
    later = [k for k in good if (k.table == k.target or k in deferred) and k not in unchecked]
    return Plan(order, [k for k in good if k not in later and k not in unchecked], later, unchecked, issues)


def broken_keys(frames: dict[str, DataFrame], kinds: dict[str, dict[str, str]], keys: dict[str, str | None], links: list[ForeignKey]) -> tuple[DataFrame | None, dict[tuple[str, str], int]]:
    """The values of foreign keys that their targets don't have, as they would be loaded, and the rows of each key that has any. One job for all keys."""
    checked = [k for k in links if k.target in kinds and keys.get(k.target) == k.key and kinds[k.table][k.column] == kinds[k.target][k.key]]
    if not checked:
        return None, {}
    used = {t for k in checked for t in (k.table, k.target)}
    found = orphans({t: typed(frames[t], kinds[t]) for t in used}, [(k.table, k.column, k.target, k.key) for k in checked])
    return found, {(r["table"], r["column"]): r["n"] for r in found.groupBy("table", "column").agg(F.sum("rows").alias("n")).collect()}


def load_order(tables: list[str], links: list[ForeignKey]) -> tuple[list[str], list[ForeignKey]]:
    """Tables, each after those it refers to, else as declared; and the keys that close a cycle, which are left out for that.

    Where no table is free, only a table that refers to itself through others can lose a key, and the one declared last does:
    its keys into its own cycle are left out, and no others.
    """
    waits: dict[str, list[ForeignKey]] = {t: [k for k in links if k.table == t] for t in tables}
    order: list[str] = []
    late: list[ForeignKey] = []

    def reached(start: str) -> set[str]:
        seen, todo = set(), [start]
        while todo:
            for k in waits[todo.pop()]:
                if k.target not in seen:
                    seen.add(k.target)
                    todo.append(k.target)
        return seen

    while waits:
        ready = next((t for t in waits if not waits[t]), None)
        if ready is None:
            far = {t: reached(t) for t in waits}
            stuck = [t for t in waits if t in far[t]][-1]
            gone = [k for k in waits[stuck] if stuck in far[k.target]]
            late += gone
            waits[stuck] = [k for k in waits[stuck] if k not in gone]
            continue
        order.append(ready)
        del waits[ready]
        for t in waits:
            waits[t] = [k for k in waits[t] if k.target != ready]
    return order, [k for k in links if k in late]


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def ddl(kinds: dict[str, dict[str, str]], keys: dict[str, str | None], planned: Plan, types: dict[str, str] = SQL_TYPES) -> list[str]:
    """CREATE TABLE for each table in order, then the keys that are added afterwards."""
    out = []
    for t in planned.order:
        lines = [f"{quoted(c)} {types[k]}" for c, k in kinds[t].items()]
        if keys.get(t):
            lines.append(f"PRIMARY KEY ({quoted(keys[t])})")
        lines += [f"FOREIGN KEY ({quoted(k.column)}) REFERENCES {quoted(k.target)} ({quoted(k.key)})" for k in planned.inline if k.table == t]
        out.append(f"CREATE TABLE {quoted(t)} (\n  " + ",\n  ".join(lines) + "\n)")
    return out + [f"ALTER TABLE {quoted(k.table)} ADD CONSTRAINT {quoted(f'fk_{k.table}_{k.column}'[:63])} FOREIGN KEY ({quoted(k.column)}) REFERENCES {quoted(k.target)} ({quoted(k.key)}){' NOT VALID' if k in planned.unchecked else ''}" for k in [*planned.deferred, *planned.unchecked]]


def write_sqlite(path: str, frames: dict[str, DataFrame], kinds: dict[str, dict[str, str]], keys: dict[str, str | None], links: list[ForeignKey], checked: tuple | None = None) -> dict[str, int | str]:
    """checked: what broken_keys() has found, if it was asked before. A new SQLite file; for each table its number of rows or, where a value isn't of its kind or the load failed and was rolled back, the error.

    Deferred keys aren't created, nor those that rows break; the values that broke them are in a table fk_orphans.
    """
    if any(i.level == "error" for i in validate(kinds)):
        raise ValueError("; ".join(i.message for i in validate(kinds) if i.level == "error"))
    lost_keys, broken = checked or broken_keys(frames, kinds, keys, links)
    planned = plan(kinds, keys, links, broken)
    Path(path).unlink(missing_ok=True)
    done: dict[str, int | str] = {}
    with sqlite3.connect(path, isolation_level=None) as db:
        for statement in ddl(kinds, keys, planned):
            if statement.startswith("CREATE"):
                db.execute(statement)
        for t in planned.order:
            if bad := lost(frames[t], kinds[t]):
                done[t] = "; ".join(f"{c}: {n} values aren't {kinds[t][c]}" for c, n in bad.items())
                continue
            df = typed(frames[t], kinds[t]).select(*[F.col(f"`{c}`").cast("string") if k in ("date", "datetime") else F.col(f"`{c}`") for c, k in kinds[t].items()])
            insert, batch, n = f"INSERT INTO {quoted(t)} VALUES ({', '.join('?' * len(kinds[t]))})", [], 0
            db.execute("BEGIN")
            try:
                for row in df.toLocalIterator(prefetchPartitions=True):
                    batch.append(tuple(row))
                    if len(batch) == BATCH:
                        db.executemany(insert, batch)
                        n, batch = n + len(batch), []
                db.executemany(insert, batch)
                db.execute("COMMIT")
                done[t] = n + len(batch)
            except sqlite3.Error as e:
                db.execute("ROLLBACK")
                done[t] = str(e)
        if broken:
            name = orphan_table(kinds)
            db.execute(f"CREATE TABLE {quoted(name)} ({', '.join(f'{quoted(c)} {k}' for c, k in ORPHANS.items())})")
            db.executemany(f"INSERT INTO {quoted(name)} VALUES ({', '.join('?' * len(ORPHANS))})", (tuple(r) for r in lost_keys.toLocalIterator()))
    db.close()
    return done


#: Columns of the table of foreign keys' values that aren't there.
ORPHANS = {"table": "TEXT", "column": "TEXT", "target": "TEXT", "key": "TEXT", "value": "TEXT", "rows": "BIGINT"}


def orphan_table(kinds: dict[str, dict[str, str]]) -> str:
    """A name that no table has."""
    name = "fk_orphans"
    while name.lower() in {t.lower() for t in kinds}:
        name += "_"
    return name


def report(kinds: dict[str, dict[str, str]], keys: dict[str, str | None], links: list[ForeignKey], rows: dict[str, int], bulk: int | None = None, limits: Callable = validate) -> dict:
    """What a load would do: problems, DDL, order, and for each table its rows and how they go in. bulk: rows from over which they are copied."""
    planned = plan(kinds, keys, links)
    tables = [{"table": t, "rows": rows.get(t, 0), "columns": len(kinds[t]), "strategy": "copy" if bulk is not None and rows.get(t, 0) > bulk else f"insert {BATCH} at a time"} for t in planned.order]
    return {"problems": [asdict(p) for p in limits(kinds)], "issues": planned.issues, "tables": tables, "ddl": ddl(kinds, keys, planned), "deferred": [f"{k.table}.{k.column}" for k in planned.deferred]}


#: Foreign keys below this confidence are drawn dashed.
TENTATIVE = 0.9
#: Words for kinds in diagrams, labels of relations, and the name of what has no letters or digits.
ERD_TYPES = {"integer": "int", "float": "float", "boolean": "boolean", "date": "date", "datetime": "datetime", "text": "text"}
SURE_LABEL, TENTATIVE_LABEL = "{column} -> {key}", "{column} -> {key} (tentative {confidence:.2f})"
NAMELESS = "table"


def plain_words(names: list[str]) -> dict[str, str]:
    """An ASCII word for each name, no two alike: other characters are underscores, a first digit follows t_, and a repeated word is numbered from 2."""
    out: dict[str, str] = {}
    for n in names:
        word = re.sub("[^A-Za-z0-9_]", "_", n).strip("_") or NAMELESS
        word = f"t_{word}" if word[0].isdigit() else word
        tries = chain([word], (f"{word}_{i}" for i in count(2)))
        out[n] = next(w for w in tries if w not in out.values())
    return out


def erd(kinds: dict[str, dict[str, str]], keys: dict[str, str | None], links: list[ForeignKey], notes: dict[tuple[str, str], str] | None = None) -> str:
    """Mermaid text of an entity-relationship diagram. notes: a comment for a (table, column), as that it is derived. A name that isn't a word is an entity's alias, or in a column's comment."""
    ids = plain_words(list(kinds))
    said = lambda x: '"' + x.replace('"', "'") + '"'
    lines = ["erDiagram"]
    for t, columns in kinds.items():
        lines.append(f"    {ids[t]}{'' if ids[t] == t else f'[{said(t)}]'} {{")
        words = plain_words(list(columns))
        for c, kind in columns.items():
            marks = [m for m, yes in (("PK", keys.get(t) == c), ("FK", any((x.table, x.column) == (t, c) for x in links))) if yes]
            comment = ", ".join(x for x in (c if words[c] != c else "", (notes or {}).get((t, c), "")) if x)
            parts = [ERD_TYPES[kind], words[c], ",".join(marks), said(comment) if comment else ""]
            lines.append("        " + " ".join(x for x in parts if x))
        lines.append("    }")
    for k in links:
        if k.table in ids and k.target in ids:
            sure = k.confidence >= TENTATIVE
            label = (SURE_LABEL if sure else TENTATIVE_LABEL).format(column=k.column, key=k.key, confidence=k.confidence)
            lines.append(f"    {ids[k.table]} {'}o--||' if sure else '}o..o|'} {ids[k.target]} : {said(label)}")
    return "\n".join(lines) + "\n"
