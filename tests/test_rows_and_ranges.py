"""Several inequalities at once, rows above and below, running and sliding ranges, balances: against brute force, and their plans."""

import random

import pytest

from gridloom.operators import rows as rows_module
from gridloom.operators import steps
from gridloom.plans.queries import QUERIES
from gridloom.plans.workbook import Workbook


@pytest.fixture
def book(spark):
    rng = random.Random(4)
    facts = [(i, rng.choice([1, 1, 1, 2, 3, None]), rng.choice([None, *range(12)]), rng.choice([None, *[x / 4 for x in range(40)]]), rng.choice([None, -1.5, 2.25, 7.0])) for i in range(700)]
    asks = [(i, rng.choice([1, 2, 9, None]), rng.choice([None, -1, 0, 3, 5, 11, 20]), rng.choice([None, 0.25, 3.1, 7.5])) for i in range(60)]
    w = Workbook(spark)
    w.add("facts", spark.createDataFrame(facts, "id long, k long, d long, e double, v double").repartition(3), ["id"])
    w.add("asks", spark.createDataFrame(asks, "id long, k long, x long, y double").repartition(2), ["id"])
    return w, facts, asks


COMPARED = {"<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "<>": lambda a, b: a != b, "=": lambda a, b: a == b}
#: Criteria as (column of facts, operator, column of asks).
SETS = [
    [("d", ">=", "x"), ("d", "<=", "y")], [("d", ">", "x"), ("e", "<", "y")], [("k", "=", "k"), ("d", ">=", "x"), ("e", "<=", "y")], [("d", "<>", "x"), ("e", ">=", "y")],
    [("d", "<", "x"), ("d", "<>", "x"), ("d", ">", "y")], [("e", ">", "y")], [("k", "=", "k"), ("d", "<=", "x")], [("d", "<>", "x"), ("e", "<>", "y")],
]


@pytest.mark.parametrize("few", [0, 256])
@pytest.mark.parametrize("at", range(len(SETS)))
def test_criteria_against_brute_force(book, monkeypatch, at, few):
    monkeypatch.setattr(steps, "FEW", few)
    w, facts, asks = book
    pairs = ",".join(f'facts!{"ABCDE"["id k d e v".split().index(c)]}:{"ABCDE"["id k d e v".split().index(c)]},' + (f'{"ABCD"["id k x y".split().index(a)]}2' if op == "=" else f'"{op}"&{"ABCD"["id k x y".split().index(a)]}2') for c, op, a in SETS[at])
    for name, f in (("n", f"=COUNTIFS({pairs})"), ("s", f"=SUMIFS(facts!E:E,{pairs})"), ("i", f"=SUMIFS(facts!A:A,{pairs})"), ("a", f"=AVERAGEIFS(facts!E:E,{pairs})"), ("lo", f"=MINIFS(facts!E:E,{pairs})"), ("hi", f"=MAXIFS(facts!A:A,{pairs})")):
        w.derive("asks", name, f)
    df = w.recompute("asks")
    plan = df._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    place = {"id": 0, "k": 1, "d": 2, "e": 3, "v": 4}
    for r in df.collect():
        own = next(a for a in asks if a[0] == r["id"])
        value = dict(zip(("id", "k", "x", "y"), own, strict=True))
        met = [f for f in facts if all(f[place[c]] is not None and value[a] is not None and COMPARED[op](f[place[c]], value[a]) for c, op, a in SETS[at])]
        vs = [f[4] for f in met if f[4] is not None]
        assert (r["n"], r["s"], r["i"], r["lo"], r["hi"]) == (len(met), sum(vs), sum(f[0] for f in met), min(vs, default=None), max((f[0] for f in met), default=None)), (r, met)
        assert r["a"] == (pytest.approx(sum(vs) / len(vs)) if vs else None)


def test_formulas_of_a_column_share_steps(book):
    """Lookups of one key in one table are one join; conditional aggregates under the same criteria are one group-by."""
    w, _, _ = book
    for name, f in (("a", "=VLOOKUP(B2,facts!B:E,3,FALSE)"), ("b", "=VLOOKUP(B2,facts!B:E,4,FALSE)"), ("c", "=COUNTIF(facts!B:B,B2)"), ("d", "=SUMIF(facts!B:B,B2,facts!E:E)")):
        w.derive("asks", name, f)
    plan = w.recompute("asks")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join LeftOuter") == 2


@pytest.mark.parametrize("block", [4, 1 << 16])
def test_rows_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(rows_module, "BLOCK", block)
    rng = random.Random(6)
    values = [(rng.choice([1, 2]), i, rng.choice([None, *range(-5, 9)]), f"t{i % 5}") for i in range(57)]
    values.sort(key=lambda r: r[:2])
    w = Workbook(spark)
    w.add("t", spark.createDataFrame(values, "g long, id long, v long, s string").repartition(4), ["g", "id"])
    v = [r[2] for r in values]
    n = len(v)
    inside = lambda a, b: [x for x in v[max(0, a) : max(0, b + 1)] if x is not None]
    either = lambda a, b: inside(min(a, b), max(a, b))
    wanted = {
        "up": ("=C1", lambda i: v[i - 1] if i else None), "down": ("=C4", lambda i: v[i + 2] if i + 2 < n else None), "text": ("=D1", lambda i: values[i - 1][3] if i else None),
        "fixed": ("=C$5", lambda i: v[3]), "run": ("=SUM(C$2:C2)", lambda i: sum(either(0, i))), "late": ("=SUM(C$6:C1)", lambda i: sum(either(4, i - 1))), "rest": ("=MAX(C2:C$40)", lambda i: max(either(38, i), default=None)),
        "n": ("=COUNT(C$2:C4)", lambda i: len(either(0, i + 2))), "slide": ("=SUM(C1:C3)", lambda i: sum(inside(i - 1, i + 1))), "far": ("=MIN(C5:C14)", lambda i: min(inside(i + 3, i + 12), default=None)),
        "back": ("=AVERAGE(C$3:C$9)", lambda i: sum(inside(1, 7)) / len(inside(1, 7))), "own": ("=SUM(C2:C2)", lambda i: v[i] or 0),
    }
    w.tables["t"].first_row = 2
    for name, (formula, _) in wanted.items():
        w.derive("t", name, formula.replace("C1:C3", "C1:C3"), row=2)
    w.derive("t", "stock", f"={'ABCDEFGHIJKLMNOPQRSTUVWXYZ'[4 + len(wanted)]}1+C2-1", row=2)
    w.derive("t", "faded", f"=({'ABCDEFGHIJKLMNOPQRSTUVWXYZ'[5 + len(wanted)]}1+2)*0.5-C2", row=2)
    w.derive("t", "worse", f"={'ABCDEFGHIJKLMNOPQRSTUVWXYZ'[6 + len(wanted)]}1^2", row=2)
    got = sorted(w.recompute("t").collect(), key=lambda r: (r.g, r.id))
    stock, faded = 0, 0.0
    for i, r in enumerate(got):
        for name, (_, f) in wanted.items():
            assert r[name] == f(i), (name, i)
        stock, faded = stock + (v[i] or 0) - 1, (faded + 2) * 0.5 - (v[i] or 0)
        assert r["stock"] == stock and r["faded"] == pytest.approx(faded) and r["worse"] is None
    notes = {t.column: t for t in w.translations()}
    assert notes["worse"].status == "unsupported" and notes["stock"].status == "ok" and not notes["run"].notes


def test_rows_that_are_not_followed_are_noted(book):
    w, _, _ = book
    for name, f in (("a", "=C1+C2"), ("b", "=SUM(C$2:C2)"), ("c", "=C2*2"), ("d", "=C2/SUM(C$2:C$9)")):
        w.derive("asks", name, f)
    notes = {t.column: t.notes for t in w.translations()}
    assert notes["a"] and notes["b"] and not notes["c"] and not notes["d"]


def test_balances_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(rows_module, "BLOCK", 5)
    w = Workbook(spark)
    w.add("t", spark.createDataFrame([(i, float(i % 4)) for i in range(120)], "id long, v double").repartition(3), ["id"])
    w.derive("t", "b", "=C1*0.9+B2", row=2)
    x = 0.0
    for r in sorted(w.recompute("t").collect(), key=lambda r: r.id):
        x = x * 0.9 + r.v
        assert r.b == pytest.approx(x)
    empty = Workbook(spark)
    empty.add("t", spark.createDataFrame([], "id long, v double"), ["id"])
    empty.derive("t", "b", "=C1*0.9+B2", row=2)
    empty.derive("t", "c", "=SUM(B$2:B2)", row=2)
    assert empty.recompute("t").count() == 0


def test_a_range_to_the_last_row_of_a_sheet_reaches_the_end_of_a_longer_table(spark):
    """The table begins six rows before a sheet's last one and has 20."""
    w = Workbook(spark)
    w.add("t", spark.createDataFrame([(i, i % 4) for i in range(20)], "id long, v long").repartition(3), ["id"])
    w.tables["t"].first_row = 1048570
    for name, f in (("left", "=SUM(B1048570:B$1048576)"), ("all", "=SUM(B$1048570:B$1048576)"), ("high", "=MAX(B1048571:B$1048576)"), ("n", "=COUNT(B$1048575:B$1048576)")):
        w.derive("t", name, f, row=1048570)
    v = [i % 4 for i in range(20)]
    for i, r in enumerate(sorted(w.recompute("t").collect(), key=lambda r: r.id)):
        assert (r.left, r["all"], r.high, r.n) == (sum(v[i:]), sum(v), max(v[min(i + 1, 19) :]), 15), i


def test_blocks_make_up_a_range_once(spark):
    rng = random.Random(9)
    spans = [(lo, rng.randrange(lo, n + 1), n) for n in (1, 2, 7, 8, 9, 64, 65, 5000) for lo in [0, n // 2, *[rng.randrange(n) for _ in range(6)]]] + [(0, n, n) for n in (1, 8, 512, 513)] + [(5, 3, 9)]
    found = spark.createDataFrame(spans, "lo long, hi long, n long").selectExpr("lo", "hi", "n", f"{steps.blocks('lo', 'hi', 'n')} AS b").collect()
    for r in found:
        size = [1 << steps.BITS * x.level for x in r.b]
        assert sorted(i for x, s in zip(r.b, size, strict=True) for i in range(x.node * s, (x.node + 1) * s)) == list(range(r.lo, r.hi))
        assert all(size.count(s) <= 2 * ((1 << steps.BITS) - 1) for s in size)


def test_several_inequalities_read_the_table_once(spark):
    df = QUERIES["sumifs_two_columns"](spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") <= 4 and plan.count("Exchange") <= 60, "164 scans and 441 exchanges when each column doubled the plan"


def test_few_rows_of_a_key_are_met_at_once(spark):
    df = QUERIES["sumifs_between_by_key"](spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") <= 20, "60 when groups were sized and cut into blocks that no key needs"
