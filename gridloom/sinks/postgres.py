"""PostgreSQL: limits of names, a load over JDBC, and a dump as scripts beside files that Spark writes.

Rows never pass through the driver: executors write them, to the server or to the dump's files.
"""

from __future__ import annotations

from collections.abc import Callable
from urllib.parse import unquote, urlsplit

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.operators.coerce import lost, typed
from gridloom.operators.profile import ForeignKey
from gridloom.sinks import relational, staged
from gridloom.sinks.relational import Problem, ddl, plan, quoted

#: Bytes of a name, rows from over which a table is copied, words that are reserved.
NAME_BYTES, COPY_ROWS = 63, 10_000
RESERVED = frozenset(
    "all analyse analyze and any array as asc asymmetric both case cast check collate column constraint create current_catalog current_date current_role "
    "current_time current_timestamp current_user default deferrable desc distinct do else end except false fetch for foreign from grant group having in "
    "initially intersect into lateral leading limit localtime localtimestamp not null offset on only or order placing primary references returning select "
    "session_user some symmetric system_user table then to trailing true union unique user using variadic when where window with".split()
)


def validate(kinds: dict[str, dict[str, str]], names: list[str] | None = None) -> list[Problem]:
    out = relational.validate(kinds, names)
    for t, columns in kinds.items():
        for what in (t, *columns):
            where = what if what == t else f"{t}.{what}"
            if len(what.encode()) > NAME_BYTES:
                out.append(Problem("error", "identifier_too_long", f"{where} is longer than {NAME_BYTES} bytes"))
            if what.lower() in RESERVED:
                out.append(Problem("warning", "reserved_word", f"{where} is a reserved word and is quoted"))
    return out


def report(kinds: dict, keys: dict, links: list[ForeignKey], rows: dict[str, int]) -> dict:
    return relational.report(kinds, keys, links, rows, COPY_ROWS, validate)


def literal(c: Column, kind: str) -> Column:
    """A value as SQL text."""
    text = {"integer": c.cast("string"), "float": F.when(F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf")), F.concat(F.lit("'"), c.cast("string"), F.lit("'"))).otherwise(c.cast("string")), "boolean": F.upper(c.cast("string"))}.get(kind)
    written = F.concat(F.lit("'"), F.replace(c.cast("string"), F.lit("'"), F.lit("''")), F.lit("'")) if text is None else text
    return F.coalesce(written, F.lit("NULL"))


def inserts(df: DataFrame, table: str, kinds: dict[str, str]) -> DataFrame:
    """value: an INSERT statement for each row."""
    head = f"INSERT INTO {quoted(table)} ({', '.join(map(quoted, kinds))}) VALUES ("
    values = F.concat_ws(", ", *[literal(F.col(f"`{c}`"), k) for c, k in kinds.items()])
    return typed(df, kinds).select(F.concat(F.lit(head), values, F.lit(");")).alias("value"))


def copy_line(kinds: dict[str, str]) -> Column:
    """A row as a line of COPY's text format: tabs between values, \\N for null, control characters and backslashes escaped."""
    out = []
    for c in kinds:
        text = F.col(f"`{c}`").cast("string")
        for plain, escaped in (("\\", "\\\\"), ("\t", "\\t"), ("\n", "\\n"), ("\r", "\\r")):
            text = F.replace(text, F.lit(plain), F.lit(escaped))
        out.append(F.coalesce(text, F.lit("\\N")))
    return F.concat_ws("\t", *out)


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    """A file of its own, not a folder of parts, in any store that Spark writes to."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, True)
    out.write(bytearray(text.encode()))
    out.close()


def dump(
    spark: SparkSession,
    folder: str,
    frames: dict[str, DataFrame],
    kinds: dict[str, dict[str, str]],
    keys: dict[str, str | None],
    links: list[ForeignKey],
    views: str = "",
    checked: tuple | None = None,
) -> dict[str, int | str]:
    """schema.sql, views.sql, load.sql (which psql runs, in the folder) and a folder of rows for each table; rows, or why a table is left out.

    Tables of over COPY_ROWS rows are COPY text, the others statements. All is one transaction but the views, which are
    left out where a table is. Keys that rows break are added NOT VALID, and the values that broke them are in a table fk_orphans.
    checked: what relational.broken_keys() has found, if it was asked before.
    """
    if errors := [p.message for p in validate(kinds) if p.level == "error"]:
        raise ValueError("; ".join(errors))
    lost_keys, broken = checked or relational.broken_keys(frames, kinds, keys, links)
    planned, done, load = plan(kinds, keys, links, broken), {}, []
    places = relational.plain_words(list(kinds))
    for t in planned.order:
        if bad := lost(frames[t], kinds[t]):
            done[t] = "; ".join(f"{c}: {n} values aren't {kinds[t][c]}" for c, n in bad.items())
            continue
        done[t], place = frames[t].count(), f"data/{places[t]}"
        if done[t] > COPY_ROWS:
            typed(frames[t], kinds[t]).select(copy_line(kinds[t]).alias("value")).write.mode("overwrite").text(f"{folder}/{place}")
            load.append(f"\\copy {quoted(t)} FROM PROGRAM 'cat {place}/part-*'")
        else:
            inserts(frames[t], t, kinds[t]).write.mode("overwrite").text(f"{folder}/{place}")
            load.append(f"\\! cat {place}/part-* > {place}.sql\n\\i {place}.sql")
    made = ddl(kinds, keys, planned)
    if broken:
        name = relational.orphan_table(kinds)
        made.insert(len(planned.order), f"CREATE TABLE {quoted(name)} ({', '.join(f'{quoted(c)} {k}' for c, k in relational.ORPHANS.items())})")
        lost_keys.select(copy_line({c: "text" for c in relational.ORPHANS}).alias("value")).write.mode("overwrite").text(f"{folder}/data/{name}")
        load.append(f"\\copy {quoted(name)} FROM PROGRAM 'cat data/{name}/part-*'")
    drops = [f"DROP TABLE IF EXISTS {quoted(t)} CASCADE" for t in [*([relational.orphan_table(kinds)] if broken else []), *reversed(planned.order)]]
    create, alter = [x for x in made if x.startswith("CREATE")], [x for x in made if not x.startswith("CREATE")]
    whole = all(isinstance(n, int) for n in done.values())
    script = ["\\set ON_ERROR_STOP on", "BEGIN;", "\\i schema.sql", *load, *[f"{x};" for x in alter], "COMMIT;", *(["\\i views.sql"] if whole and views else [])]
    _write_text(spark, f"{folder}/schema.sql", ";\n".join(drops + create) + ";\n")
    _write_text(spark, f"{folder}/views.sql", views if whole else "")
    _write_text(spark, f"{folder}/load.sql", "\n".join(script) + "\n")
    return done


def jdbc(dsn: str) -> tuple[str, dict[str, str]]:
    """JDBC address and properties of a postgresql:// address."""
    at = urlsplit(dsn)
    if at.scheme.split("+")[0] not in ("postgresql", "postgres") or not at.hostname or not at.path.strip("/"):
        raise ValueError("an address is postgresql://user:password@host:port/database")
    found = {"user": unquote(at.username or ""), "password": unquote(at.password or "")}
    return f"jdbc:postgresql://{at.hostname}:{at.port or 5432}{at.path}", {k: v for k, v in found.items() if v} | {"driver": "org.postgresql.Driver"}


def write(dsn: str, frames: dict[str, DataFrame], kinds: dict[str, dict[str, str]], keys: dict[str, str | None], links: list[ForeignKey], views: str = "", checked: tuple | None = None, failed: Callable[[str, str], None] = lambda view, why: None) -> dict[str, int | str]:
    """Load over JDBC, staged by the executors and promoted in one transaction with keys and constraints, then the views; see staged.load().

    The driver's jar must be on Spark's class path. Not run against a PostgreSQL server here; the same protocol is tested on another database.
    """
    if errors := [p.message for p in validate(kinds) if p.level == "error"]:
        raise ValueError("; ".join(errors))
    url, properties = jdbc(dsn)
    spark = next(iter(frames.values())).sparkSession
    return staged.load(spark, url, properties, frames, kinds, keys, links, view_statements(views), staged.POSTGRES, checked, failed)


def view_statements(text: str) -> list[str]:
    """The CREATE VIEW statements of views as text, without comments."""
    plain = "\n" + "\n".join(x for x in text.splitlines() if not x.startswith("-- "))
    return ["CREATE VIEW" + s.rstrip().removesuffix(";") for s in plain.split("\nCREATE VIEW")[1:]]
