"""Loads over JDBC that may fail half-way: rows are staged by the executors, then promoted in one transaction.

1. Executors write each table, typed, to a staged table of its own; nothing that others read changes.
2. The driver compares the rows of each staged table with those of its frame.
3. In one transaction: old tables go, new ones are created in loading order with their keys, staged rows are inserted within the
   database, keys of cycles and keys that rows break follow, orphans get their table. Any error rolls all of it back.
4. Views are created one by one afterwards; one that can't be is reported and the others stay.
5. Staged tables are dropped in any case.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.operators.coerce import lost, typed
from gridloom.operators.profile import ForeignKey
from gridloom.sinks import relational
from gridloom.sinks.relational import SQL_TYPES, Plan, ddl, orphan_table, quoted


@dataclass(frozen=True)
class Dialect:
    #: SQL types by kind, where they differ; what is behind DROP TABLE; whether a key may be added that rows break; how a staged column is read, by kind.
    types: dict[str, str]
    drop: str = ""
    not_valid: bool = False
    read: dict[str, str] = field(default_factory=dict, hash=False)


POSTGRES = Dialect({"float": "DOUBLE PRECISION"}, " CASCADE", True)
#: Any database without a text type of its own.
PLAIN = Dialect({"float": "DOUBLE PRECISION", "text": "VARCHAR(32672)"}, read={"text": "CAST({} AS VARCHAR(32672))"})


def staged_name(table: str, kinds: dict[str, dict[str, str]]) -> str:
    """A name that no table of the load has."""
    name = f"{table[:50]}__staged"
    while name.lower() in {t.lower() for t in kinds}:
        name += "_"
    return name


def promotion(kinds: dict[str, dict[str, str]], keys: dict[str, str | None], planned: Plan, loaded: list[str], there: list[str], dialect: Dialect, orphans: bool = False) -> list[str]:
    """The statements of the transaction. loaded: tables whose rows are staged; there: tables that are replaced."""
    types, own = SQL_TYPES | dialect.types, [*planned.order, *([orphan_table(kinds)] if orphans else [])]
    columns = kinds | ({orphan_table(kinds): dict.fromkeys(relational.ORPHANS, "text") | {"rows": "integer"}} if orphans else {})
    made = ddl(kinds, keys, planned, types)
    creates, alters = made[: len(planned.order)], made[len(planned.order) :]
    if orphans:
        creates += ddl({own[-1]: columns[own[-1]]}, {}, Plan([own[-1]]), types)
    listed = lambda t: ", ".join(map(quoted, columns[t]))
    read = lambda t: ", ".join(dialect.read.get(k, "{}").format(quoted(c)) for c, k in columns[t].items())
    moves = [f"INSERT INTO {quoted(t)} ({listed(t)}) SELECT {read(t)} FROM {quoted(staged_name(t, kinds))}" for t in own if t in loaded]
    drops = [f"DROP TABLE {quoted(t)}{dialect.drop}" for t in reversed(own) if t in there]
    return drops + creates + moves + [a for a in alters if dialect.not_valid or not a.endswith("NOT VALID")]


@contextmanager
def connection(spark: SparkSession, url: str, properties: dict[str, str]) -> Iterator[object]:
    """A JDBC connection of the driver process, without autocommit."""
    jvm = spark._jvm
    if driver := properties.get("driver"):
        jvm.java.lang.Thread.currentThread().getContextClassLoader().loadClass(driver).getDeclaredConstructor().newInstance()
    own = jvm.java.util.Properties()
    for k, v in properties.items():
        if k != "driver":
            own.setProperty(k, v)
    db = jvm.java.sql.DriverManager.getConnection(url, own)
    try:
        db.setAutoCommit(False)
        yield db
    finally:
        db.rollback()
        db.close()


def _run(db, statement: str) -> None:
    s = db.createStatement()
    try:
        s.execute(statement)
    finally:
        s.close()


def _count(db, table: str) -> int:
    s = db.createStatement()
    try:
        found = s.executeQuery(f"SELECT COUNT(*) FROM {quoted(table)}")
        found.next()
        return found.getLong(1)
    finally:
        s.close()


def _there(db, tables: list[str]) -> list[str]:
    out = []
    for t in tables:
        found = db.getMetaData().getTables(None, None, t, None)
        if found.next():
            out.append(t)
        found.close()
    return out


def _why(e: Py4JJavaError) -> str:
    return str(e.java_exception.getMessage())


def load(
    spark: SparkSession,
    url: str,
    properties: dict[str, str],
    frames: dict[str, DataFrame],
    kinds: dict[str, dict[str, str]],
    keys: dict[str, str | None],
    links: list[ForeignKey],
    views: list[str] = (),
    dialect: Dialect = POSTGRES,
    checked: tuple | None = None,
    failed: Callable[[str, str], None] = lambda view, why: None,
) -> dict[str, int | str]:
    """Rows of each table, or why it isn't loaded; if the transaction fails, that is every table's reason and the database is as it was.

    checked: what relational.broken_keys() has found, if it was asked before. failed: told of each view that can't be created.
    """
    found, broken = checked or relational.broken_keys(frames, kinds, keys, links)
    planned = relational.plan(kinds, keys, links, broken)
    done: dict[str, int | str] = {}
    staged: dict[str, DataFrame] = {}
    for t in planned.order:
        if bad := lost(frames[t], kinds[t]):
            done[t] = "; ".join(f"{c}: {n} values aren't {kinds[t][c]}" for c, n in bad.items())
        else:
            staged[t] = typed(frames[t], kinds[t])
    if broken:
        staged[orphan_table(kinds)] = found.select(*[F.col(f"`{c}`") for c in relational.ORPHANS])
    names = {t: staged_name(t, kinds) for t in staged}
    try:
        try:
            for t, df in staged.items():
                df.write.mode("overwrite").option("batchsize", relational.BATCH).jdbc(url, quoted(names[t]), properties=properties)
            with connection(spark, url, properties) as db:
                rows = {t: (df.count(), _count(db, names[t])) for t, df in staged.items()}
                if short := [f"{t}: {there} of {n} rows are staged" for t, (n, there) in rows.items() if n != there]:
                    raise ValueError("; ".join(short))
                for statement in promotion(kinds, keys, planned, list(staged), _there(db, [*planned.order, orphan_table(kinds)]), dialect, bool(broken)):
                    _run(db, statement)
                db.commit()
                done |= {t: n for t, (n, _) in rows.items() if t in kinds}
        except Py4JJavaError as e:
            return {t: _why(e) for t in planned.order}
        except ValueError as e:
            return {t: str(e) for t in planned.order}
        if all(isinstance(n, int) for n in done.values()):
            for statement in views:
                with connection(spark, url, properties) as db:
                    try:
                        _run(db, statement)
                        db.commit()
                    except Py4JJavaError as e:
                        failed(statement.split('"')[1], _why(e))
    finally:
        with connection(spark, url, properties) as db:
            for name in _there(db, list(names.values())):
                _run(db, f"DROP TABLE {quoted(name)}")
            db.commit()
    return done
