"""Balances: each reads its table a few times, however many there are, and follows the rows one after another."""

from gridloom.operators import rows as rows_module
from gridloom.plans.queries import QUERIES
from gridloom.plans.workbook import Workbook


def test_balances_read_the_table_twice(spark):
    df = QUERIES["rows_balance"](spark, "/root/testdata/sf0.001")
    assert df._jdf.queryExecution().executedPlan().toString().count("FileScan parquet") <= 2, "a multiple for each formula before"


def test_balances_are_those_of_rows_in_turn(spark, monkeypatch):
    monkeypatch.setattr(rows_module, "BLOCK", 100)
    w = Workbook(spark)
    w.add("t", spark.createDataFrame([(i, i * 7 % 50) for i in range(450)], "id long, v long").repartition(3), ["id"])
    w.derive("t", "b", "=0.3*C1+B2", row=2)
    x = 0.0
    for r in sorted(w.recompute("t").collect(), key=lambda r: r.id):
        x = 0.3 * x + r.v
        assert r.b == x
