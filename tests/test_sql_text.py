"""Views as SQL text in SQLite against the Spark plans, on rows where the two would differ: case, bad numbers, repeated keys."""

import sqlite3

import pytest

from gridloom.plans import sqltext
from gridloom.plans.workbook import Workbook

PARTS = [(1, "abc", "12", 1.5), (2, "ABC", " 3.50 ", 2.0), (3, "aXc", "abc", 4.0), (3, "a[c", "1-2", 8.0), (4, "a%c", "-.5", 16.0), (5, None, None, None), (6, "a_c", "1e2", 32.0), (1, "last", "+7", 64.0), (7, "", "1.2.3", 0.0)]
FORMULAS = {
    "number": "=VALUE(C2)", "small": '=COUNTIF(parts!B:B,"a*")', "one": '=COUNTIF(parts!B:B,"a?c")', "percent": '=COUNTIF(parts!B:B,"a%*")', "bracket": '=COUNTIF(parts!B:B,"a[*")',
    "first": "=VLOOKUP(A2,parts!A:D,2,FALSE)", "texts": "=SUMIF(parts!A:A,A2,parts!C:C)", "most": "=MAXIFS(parts!D:D,parts!A:A,A2)", "all": "=SUM(parts!C:C)",
}


@pytest.fixture
def book(spark):
    w = Workbook(spark)
    rows = [(i, *r) for i, r in enumerate(PARTS)]
    w.add("parts", spark.createDataFrame([r[1:] + (r[0],) for r in rows], "k long, name string, code string, x double, place long"), ["place"])
    for c, f in FORMULAS.items():
        w.derive("parts", c, f)
    return w


def test_sqlite_views_equal_the_plans(book):
    expected = {r["place"]: [r[c] for c in FORMULAS] for r in book.recompute("parts").collect()}
    with sqlite3.connect(":memory:") as db:
        db.execute("CREATE TABLE parts (k BIGINT, name TEXT, code TEXT, x FLOAT, place BIGINT)")
        db.executemany("INSERT INTO parts VALUES (?, ?, ?, ?, ?)", [(*r, i) for i, r in reversed(list(enumerate(PARTS)))])
        for statement in sqltext.views(book, "sqlite").split(";\n"):
            if statement.strip():
                db.execute(statement)
        got = {r[0]: list(r[1:]) for r in db.execute(f"SELECT place, {', '.join(chr(34) + c + chr(34) for c in FORMULAS)} FROM parts_v")}
    for place, values in expected.items():
        assert got[place] == pytest.approx(values), (place, dict(zip(FORMULAS, zip(got[place], values, strict=True), strict=True)))
    assert expected[0][FORMULAS and list(FORMULAS).index("first")] == "abc" and expected[2][0] is None


def test_postgres_text_casts_and_orders(book):
    text = sqltext.views(book, "postgres")
    assert 'ORDER BY x1."place" LIMIT 1' in text and "DOUBLE PRECISION" in text and "LIKE 'a%' ESCAPE" in text
    book.drop("parts", "place")
    assert "ORDER BY x1.ctid LIMIT 1" in sqltext.views(book, "postgres")
