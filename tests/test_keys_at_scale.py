"""Uniqueness in one pass, foreign keys against the data, and loads whose rows break a key."""

import sqlite3

from gridloom.operators import profile as p
from gridloom.operators.profile import ForeignKey
from gridloom.sinks import postgres, relational


def test_uniqueness_of_all_columns(spark):
    rows = [(i, f"n{i}", f"n{i % 60}", None if i == 7 else i, " " if i == 3 else f"x{i}", [i], float(i // 2) + (i % 2) / 4, i % 2 == 0) for i in range(200)]
    df = spark.createDataFrame([*rows, (200, "n200 ", "z", 200, "y", [1], 999.0, True), (201, " n200", "z", 201, "z", [2], 1000.0, True)], "id long, name string, few string, gap long, blank string, list array<long>, x double, flag boolean")
    assert p.unique_among(df, df.columns) == {"id": True, "name": False, "few": False, "gap": False, "blank": False, "list": False, "x": True, "flag": False}, "names are trimmed"
    assert p.unique_among(df.where("false"), ["id"]) == {"id": False} and p.unique_among(df, []) == {}
    assert p.primary_key(df) == "id" and p.primary_key(df.drop("id").select("few", "name")) is None


def test_values_of_equal_hashes_are_compared(spark, monkeypatch):
    """Hashes that meet by chance don't make a column's values the same."""
    df = spark.createDataFrame([(i, i // 2) for i in range(300)], "a long, b long").withColumn("c", p.F.col("b") % 250)
    hashed = p.F.xxhash64
    monkeypatch.setattr(p.F, "xxhash64", lambda c: hashed(c) % 16)
    monkeypatch.setattr(p, "SKETCHED_SHARE", 0.0)
    assert p.unique_among(df, ["a", "b", "c"]) == {"a": True, "b": False, "c": False}


def test_orphans_of_all_keys(spark):
    tables = {"a": spark.createDataFrame([(1, "x"), (2, "y"), (2, None), (9, "q"), (9, "x")], "k long, s string"), "b": spark.createDataFrame([(1,), (2,), (3,)], "k long"), "c": spark.createDataFrame([("x",), ("y",)], "s string")}
    found = p.orphans(tables, [("a", "k", "b", "k"), ("a", "s", "c", "s")]).collect()
    assert sorted(map(tuple, found)) == [("a", "k", "b", "k", "9", 2), ("a", "s", "c", "s", "q", 1)]


def test_loads_with_orphans(spark, tmp_path):
    frames = {"child": spark.createDataFrame([(1, 1), (2, 5), (3, None)], "id long, parent long"), "parent": spark.createDataFrame([(1,), (2,)], "id long")}
    kinds, keys, links = {"child": {"id": "integer", "parent": "integer"}, "parent": {"id": "integer"}}, {"child": "id", "parent": "id"}, [ForeignKey("child", "parent", "parent", "id", 0.9)]
    found, broken = relational.broken_keys(frames, kinds, keys, links)
    assert broken == {("child", "parent"): 1} and [r["value"] for r in found.collect()] == ["5"]
    planned = relational.plan(kinds, keys, links, broken)
    assert planned.unchecked == links and not planned.inline and planned.issues[0][0] == "fk_orphans"
    assert relational.ddl(kinds, keys, planned)[-1].endswith('REFERENCES "parent" ("id") NOT VALID')
    at = str(tmp_path / "out.db")
    assert relational.write_sqlite(at, frames, kinds, keys, links) == {"child": 3, "parent": 2}
    with sqlite3.connect(at) as db:
        assert db.execute("SELECT * FROM fk_orphans").fetchall() == [("child", "parent", "parent", "id", "5", 1)]
        assert db.execute("PRAGMA foreign_key_list(child)").fetchall() == []
    folder = str(tmp_path / "dump")
    assert postgres.dump(spark, folder, frames, kinds, keys, links) == {"child": 3, "parent": 2}
    load, schema = (tmp_path / "dump/load.sql").read_text(), (tmp_path / "dump/schema.sql").read_text()
    assert 'CREATE TABLE "fk_orphans"' in schema and "NOT VALID;" in load and load.index("fk_orphans") < load.index("NOT VALID") < load.index("COMMIT")
    assert "child\tparent\tparent\tid\t5\t1" in "".join(f.read_text() for f in (tmp_path / "dump/data/fk_orphans").glob("part-*"))
    whole = {**frames, "child": frames["child"].where("id <> 2")}
    assert relational.broken_keys(whole, kinds, keys, links)[1] == {} and "FOREIGN KEY" in relational.ddl(kinds, keys, relational.plan(kinds, keys, links, {}))[1]
