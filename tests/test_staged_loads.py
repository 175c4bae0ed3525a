"""The staged load against a database that is at hand over JDBC (Derby, in memory), and its statements for PostgreSQL as text."""

import uuid

import pytest

from gridloom.operators.profile import ForeignKey
from gridloom.sinks import relational, staged

KINDS = {"child": {"id": "integer", "parent": "integer", "name": "text", "x": "float", "on": "date"}, "parent": {"id": "integer", "boss": "integer"}}
KEYS = {"child": "id", "parent": "id"}
LINKS = [ForeignKey("child", "parent", "parent", "id", 0.9), ForeignKey("parent", "boss", "parent", "id", 0.9)]


@pytest.fixture
def url():
    return f"jdbc:derby:memory:{uuid.uuid4().hex};create=true"


def frames(spark, parent=2):
    child = spark.createDataFrame([(1, 1, "it's", 0.5, "2024-01-02"), (2, parent, None, None, None)], "id long, parent long, name string, x double, on string")
    return {"child": child, "parent": spark.createDataFrame([(1, None), (2, 1)], "id long, boss long")}


def rows(spark, url, table):
    return sorted(map(tuple, spark.read.jdbc(url, f'"{table}"').collect()))


def load(spark, url, data, kinds=KINDS, **more):
    return staged.load(spark, url, {}, data, kinds, KEYS, LINKS, dialect=staged.PLAIN, **more)


def test_rows_keys_and_views(spark, url):
    missing = []
    views = ['CREATE VIEW "child_v" AS SELECT t."id", (t."x" * 2) AS "twice" FROM "child" t', 'CREATE VIEW "bad_v" AS SELECT t."nothing" FROM "child" t']
    assert load(spark, url, frames(spark), views=views, failed=lambda v, why: missing.append(v)) == {"parent": 2, "child": 2}
    assert rows(spark, url, "parent") == [(1, None), (2, 1)] and [r[:3] for r in rows(spark, url, "child")] == [(1, 1, "it's"), (2, 2, None)]
    assert rows(spark, url, "child_v") == [(1, 1.0), (2, None)] and missing == ["bad_v"]
    with staged.connection(spark, url, {}) as db:
        assert staged._there(db, ["child", "parent", "child__staged", "parent__staged", "fk_orphans"]) == ["child", "parent"]
        with pytest.raises(staged.Py4JJavaError):
            staged._run(db, 'INSERT INTO "child" ("id", "parent") VALUES (9, 77)')


def test_a_failed_load_leaves_the_database_as_it_was(spark, url):
    assert load(spark, url, frames(spark)) == {"parent": 2, "child": 2}
    twice = frames(spark)
    twice["parent"] = spark.createDataFrame([(1, None), (1, None), (2, None)], "id long, boss long")
    out = load(spark, url, twice)
    assert set(out) == {"child", "parent"} and all(isinstance(x, str) for x in out.values())
    assert rows(spark, url, "parent") == [(1, None), (2, 1)] and len(rows(spark, url, "child")) == 2
    with staged.connection(spark, url, {}) as db:
        assert not staged._there(db, ["child__staged", "parent__staged"])


def test_orphans_and_lost_values(spark, url):
    assert load(spark, url, frames(spark, parent=5)) == {"parent": 2, "child": 2}
    assert rows(spark, url, "fk_orphans") == [("child", "parent", "parent", "id", "5", 1)]
    bad = frames(spark)
    bad["child"] = bad["child"].withColumn("x", staged.F.lit("no number"))
    out = load(spark, url, bad)
    assert isinstance(out["child"], str) and out["parent"] == 2 and rows(spark, url, "child") == []


def test_statements_for_postgres():
    planned = relational.plan(KINDS, KEYS, LINKS, {("child", "parent"): 3})
    text = staged.promotion(KINDS, KEYS, planned, ["child", "parent", "fk_orphans"], ["child"], staged.POSTGRES, orphans=True)
    assert text[0] == 'DROP TABLE "child" CASCADE' and [x.split("(")[0].strip() for x in text[1:4]] == ['CREATE TABLE "parent"', 'CREATE TABLE "child"', 'CREATE TABLE "fk_orphans"']
    assert text[5].startswith('INSERT INTO "child"') and text[5].endswith('FROM "child__staged"')
    assert "boss" in text[-2] and text[-1].endswith("NOT VALID") and '"x" DOUBLE PRECISION' in text[2]
