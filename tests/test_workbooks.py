"""Workbooks end to end: the fixtures' sheets as files, read, analysed, translated and loaded."""

import json
import sqlite3
import zipfile
from datetime import date, datetime, timedelta
from xml.sax.saxutils import escape

import pytest

from gridloom import cli
from gridloom.migrate import migrate, plan
from gridloom.operators.coerce import coerced, lost
from gridloom.operators.profile import ForeignKey
from gridloom.plans import sqltext
from gridloom.plans.analysis import ROW, Analysis, ColumnInfo, TableInfo, analyze, evidence, lineage
from gridloom.plans.formula import column_letters
from gridloom.plans.lineage import classify
from gridloom.plans.workbook import Workbook
from gridloom.sinks import postgres, relational

NS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def _cell(place, v):
    if v is None:
        return ""
    if isinstance(v, str) and v.startswith("="):
        return f'<c r="{place}"><f>{escape(v[1:])}</f></c>'
    if isinstance(v, bool):
        return f'<c r="{place}" t="b"><v>{int(v)}</v></c>'
    if isinstance(v, datetime):
        return f'<c r="{place}" s="1"><v>{(v - datetime(1899, 12, 30)) / timedelta(days=1)}</v></c>'
    if isinstance(v, date):
        return f'<c r="{place}" s="1"><v>{(v - date(1899, 12, 30)).days}</v></c>'
    if isinstance(v, (int, float)):
        return f'<c r="{place}"><v>{v}</v></c>'
    return f'<c r="{place}" t="inlineStr"><is><t>{escape(v)}</t></is></c>'


def write(path, sheets, books=()):
    with zipfile.ZipFile(path, "w") as z:
        ids = "".join(f'<sheet name="{escape(n)}" sheetId="{i + 1}" r:id="r{i}"/>' for i, n in enumerate(sheets))
        links = "".join(f'<externalReference r:id="x{i}"/>' for i in range(len(books)))
        z.writestr("xl/workbook.xml", f'<workbook {NS} xmlns:r="{REL}"><sheets>{ids}</sheets><externalReferences>{links}</externalReferences></workbook>')
        rels = [f'<Relationship Id="r{i}" Target="worksheets/s{i}.xml"/>' for i in range(len(sheets))] + [f'<Relationship Id="x{i}" Target="externalLinks/e{i}.xml"/>' for i in range(len(books))]
        z.writestr("xl/_rels/workbook.xml.rels", f"<Relationships>{''.join(rels)}</Relationships>")
        for i, b in enumerate(books):
            z.writestr(f"xl/externalLinks/e{i}.xml", f"<externalLink {NS}/>")
            z.writestr(f"xl/externalLinks/_rels/e{i}.xml.rels", f'<Relationships><Relationship Id="r1" Target="folder/{b}"/></Relationships>')
        z.writestr("xl/styles.xml", f'<styleSheet {NS}><cellXfs><xf numFmtId="0"/><xf numFmtId="22"/></cellXfs></styleSheet>')
        for i, rows in enumerate(sheets.values()):
            body = "".join(f'<row r="{r}">' + "".join(_cell(f"{column_letters(c)}{r}", v) for c, v in enumerate(cells)) + "</row>" for r, cells in enumerate(rows, 1))
            z.writestr(f"xl/worksheets/s{i}.xml", f"<worksheet {NS}><sheetData>{body}</sheetData></worksheet>")


@pytest.fixture(scope="module")
def clean(tmp_path_factory):
    """Three tables: 25 customers, 60 orders, 150 items."""
    path = tmp_path_factory.mktemp("clean") / "clean.xlsx"
    customers = [["Customer ID", "Name", "Email", "Signup Date", "Active", "Credit Limit"]] + [[i, f"n{i}", f"e{i}@x", date(2024, 1, 1) + timedelta(days=i), i % 3 > 0, 10.5 * i] for i in range(1, 26)]
    orders = [["Order ID", "Customer ID", "Ordered At", "Status", "Note", "Customer Name"]]
    orders += [[i, i * 7 % 25 + 1, datetime(2024, 2, 1, 8, 30) + timedelta(hours=i), "open" if i % 2 else "done", "x" if i % 10 < 3 else None, f"=VLOOKUP(B{i - 998},Customers!$A$2:$F$26,2,FALSE)"] for i in range(1000, 1060)]
    items = [["Item ID", "Order ID", "SKU", "Qty", "Unit Price", "Line Total", "Order Status"]]
    items += [[i, 1000 + i * 11 % 60, f"s{i % 9}", i % 5 + 1, 1.25 * (i % 7 + 1), f"=D{r}*E{r}", f"=_xlfn.XLOOKUP(B{r},Orders!A2:A61,Orders!D2:D61)"] for r, i in enumerate(range(50_000, 50_150), 2)]
    write(path, {"Customers": customers, "Orders": orders, "Order Items": items})
    return str(path)


@pytest.fixture(scope="module")
def analysed(spark, clean):
    return analyze(spark, clean)


@pytest.fixture(scope="module")
def across(tmp_path_factory):
    folder = tmp_path_factory.mktemp("across")
    write(folder / "customers.xlsx", {"Customers": [["customer_id", "name", "region"]] + [[i, f"n{i}", "NS"[i % 2]] for i in range(1, 21)]})
    write(folder / "products.xlsx", {"Products": [["product_id", "product_name", "unit_price"]] + [[f"P{i:03}", f"p{i}", 2.5 * i] for i in range(1, 11)]})
    orders = [["order_id", "customer_id", "status", "customer_name", "item_count", "order_total", "status_copy", "dynamic_note"]]
    orders += [[i + 100, i % 20 + 1, "open", f"=VLOOKUP(B{r},[1]Customers!$A$2:$C$21,2,FALSE)", f"=COUNTIFS('Order Items'!$B$2:$B$101,A{r})", f"=SUMIF('Order Items'!B:B,A{r},'Order Items'!E:E)", f"=C{r}", f'=INDIRECT("A{r}")'] for r, i in enumerate(range(40), 2)]
    items = [["item_id", "order_id", "product_id", "qty", "line_total", "next_qty"]]
    items += [[i + 9000, i % 40 + 100, f"P{i % 10 + 1:03}", i % 4 + 1, f"=D{r}*_xlfn.XLOOKUP(C{r},[2]Products!A:A,[2]Products!C:C)", f"=OFFSET(D{r},1,0)"] for r, i in enumerate(range(100), 2)]
    write(folder / "orders.xlsx", {"Orders": orders, "Order Items": items}, ["customers.xlsx", "products.xlsx"])
    summary = [["customer_id", "orders", "revenue"]] + [[i, f"=COUNTIF([1]Orders!$B$2:$B$41,A{r})", f"=SUMIF([1]Orders!B:B,A{r},[1]Orders!F:F)"] for r, i in enumerate(range(1, 21), 2)]
    write(folder / "summary.xlsx", {"Summary": summary}, ["orders.xlsx"])
    return folder


def test_clean_workbook(analysed):
    a = analysed
    assert {t.name: t.row_count for t in a.tables} == {"customers": 25, "orders": 60, "order_items": 150}
    assert {i.code for i in a.issues} == {"formula_cache_empty"}
    kinds = {f"{t.name}.{c.name}": c.kind for t in a.tables for c in t.columns}
    assert [kinds[f"customers.{c}"] for c in ("customer_id", "name", "signup_date", "active", "credit_limit")] == ["integer", "text", "date", "boolean", "float"]
    assert kinds["orders.ordered_at"] == "datetime" and kinds["orders.customer_name"] == "text"
    assert {t.name: t.key() for t in a.tables} == {"customers": "customer_id", "orders": "order_id", "order_items": "item_id"}
    assert set(a.keys) == {ForeignKey("orders", "customer_id", "customers", "customer_id", 0.98), ForeignKey("order_items", "order_id", "orders", "order_id", 0.98)}
    assert {f"{t.name}.{c.name}" for t in a.tables for c in t.columns if c.derived} == {"orders.customer_name", "order_items.line_total", "order_items.order_status"}
    assert a.function_totals() == {"XLOOKUP": 150, "VLOOKUP": 60} and list(a.by_file()) == ["clean.xlsx"]
    assert len(a.shapes) == 3, "formulas that differ by rows only are one shape"
    assert a.table("orders").columns[4].null_ratio == pytest.approx(0.7)


def test_clean_workbook_in_sqlite(spark, analysed, tmp_path):
    a = analysed
    done = migrate(spark, a, "sqlite", str(tmp_path / "x.db"), ["orders.customer_name", "order_items.line_total", "order_items.order_status"])
    assert done.tables == {"customers": 25, "orders": 60, "order_items": 150} and not done.failed and sorted(done.views) == ["order_items_v", "orders_v"]
    w = a.without(["orders.customer_name", "order_items.line_total", "order_items.order_status"]).workbook(spark)
    with sqlite3.connect(tmp_path / "x.db") as db:
        for table, column in (("orders", "customer_name"), ("order_items", "line_total"), ("order_items", "order_status")):
            key = a.table(table).key()
            stored = db.execute(f"SELECT {key}, {column} FROM {table}_v ORDER BY 1").fetchall()
            assert stored == [tuple(r) for r in w.recompute(table).select(key, column).orderBy(key).collect()] and all(v is not None for _, v in stored)
        assert db.execute("SELECT typeof(active), signup_date FROM customers WHERE customer_id = 1").fetchone() == ("integer", "2024-01-02")
    with pytest.raises(ValueError, match="no column"):
        a.without(["orders.gone"])
    left = a.without(["orders.order_id"])
    assert [k.table for k in left.keys] == ["orders"] and len(a.keys) == 2 and left.issues[-1].code == "column_excluded"


def test_workbooks_across_files(spark, across):
    a = analyze(spark, str(across))
    assert a.books == {"orders.xlsx": ["customers.xlsx", "products.xlsx"], "summary.xlsx": ["orders.xlsx"]}
    sure = {(k.table, k.column): (k.target, k.confidence) for k in a.keys}
    assert sure["orders", "customer_id"] == ("customers", 0.99) and sure["order_items", "product_id"] == ("products", 0.99)
    assert evidence(a)["summary", "customer_id"] == ("orders", "customer_id")
    flows = lineage(a).at_level("sheet")
    assert flows.edges["sheet:customers.xlsx/Customers", "sheet:orders.xlsx/Orders", "join"] == 80
    assert flows.edges["sheet:orders.xlsx/Orders", "sheet:summary.xlsx/Summary", "aggregate"] == 60
    assert all(s != t for s, t, _ in flows.edges)
    assert {r["table"]: r["dynamic"] for r in a.inventory() if r["dynamic"]} == {"orders": 40, "order_items": 100}
    assert {i.table for i in a.issues if i.code == "dynamic_reference"} == {"orders", "order_items"}
    files = lineage(a).at_level("file")
    assert {n.id for n in files.nodes.values() if not n.dynamic} == {f"file:{f}.xlsx" for f in ("customers", "products", "orders", "summary")}
    text = lineage(a).flowchart()
    assert "subgraph" in text and "-.->|\"dynamic ×40\"|" in text and "class " in text
    left = a.without(["order_items.line_total"])
    w = left.workbook(spark)
    order = sqltext.view_order(w)
    assert order.index("order_items") < order.index("orders")
    assert "order_items_v" in sqltext.views(w, "sqlite").split('CREATE VIEW "orders_v"')[1]
    status = {(t.table, t.column): t.status for t in w.translations()}
    assert status["order_items", "next_qty"] == "unsupported" and status["orders", "order_total"] == "ok"
    totals = {r.order_id: r.order_total_calc for r in w.recompute("orders").collect()}
    expected = {o: sum((i % 4 + 1) * 2.5 * (i % 10 + 1) for i in range(100) if i % 40 + 100 == o) for o in range(100, 140)}
    assert totals == pytest.approx(expected)


def test_missing_workbook_and_saved_schema(spark, across, tmp_path):
    a = analyze(spark, str(across / "orders.xlsx"))
    missing = [i for i in a.issues if i.code == "missing_referenced_workbook"]
    assert {(i.level, i.table) for i in missing} == {("warning", "orders"), ("warning", "order_items")}
    found = lineage(a)
    assert found.nodes["column:customers.xlsx/Customers/B"].missing and " class " in found.flowchart()
    assert found.at_level("file").nodes["file:customers.xlsx"].missing
    a.save(spark, str(tmp_path / "job"))
    again = Analysis.load(spark, str(tmp_path / "job"))
    assert again.to_json() == a.to_json() and again.frames["orders"].orderBy(ROW).collect() == a.frames["orders"].orderBy(ROW).collect()
    tables = [type(t)(**{**vars(t), "name": f"new_{t.name}"}) for t in a.tables]
    assert sorted(a.bound(tables).frames) == ["new_order_items", "new_orders"]
    tables[0].columns = tables[0].columns[1:]
    with pytest.raises(ValueError, match="columns for data"):
        a.bound(tables)


def test_headers_and_other_files(spark, tmp_path):
    write(tmp_path / "a.xlsx", {"T": [["Report"], [], ["Name", "Name", None, "1st col"], ["x", "y", 2.5, "z"], ["a", "b", 3, "c"]], "N": [[1, 2], [3, 4]]})
    (tmp_path / "data.csv").write_text("a,b")
    a = analyze(spark, str(tmp_path))
    (t,) = a.tables
    assert [c.name for c in t.columns] == ["name", "name_2", "col_3", "_1st_col"] and (t.header_row, t.row_count) == (3, 2)
    assert {i.code for i in a.issues} == {"blank_header", "no_header", "unsupported_file"}


def test_command_line(spark, analysed, tmp_path, capsys, monkeypatch):
    clean = "clean.xlsx"
    monkeypatch.setattr(cli, "analyze", lambda _, paths: analysed if paths == [clean] else analyze(spark, paths))
    assert cli.main(["analyze", clean], spark) == 0 and json.loads(capsys.readouterr().out)["tables"][0]["name"]
    assert cli.main(["erd", clean], spark) == 0
    lines = capsys.readouterr().out.splitlines()
    assert {"    customers {", "        int customer_id PK", '    orders }o--|| customers : "customer_id -> customer_id"', '    order_items }o--|| orders : "order_id -> order_id"'} <= set(lines)
    assert any(x.startswith('        text customer_name "derived') for x in lines) and not any("tentative" in x for x in lines)
    assert cli.main(["formulas", clean], spark) == 0 and capsys.readouterr().out.startswith("XLOOKUP 150\nVLOOKUP 60")
    assert cli.main(["lineage", clean, "--level", "sheet"], spark) == 0 and "join ×" in capsys.readouterr().out
    assert cli.main(["translate", clean], spark) == 0 and capsys.readouterr().out.startswith("3 ok, 0 partial, 0 unsupported")
    assert cli.main(["translate", clean, "--format", "postgres"], spark) == 0 and 'CREATE VIEW "orders_v"' in capsys.readouterr().out
    assert cli.main(["translate", clean, "--exclude", "orders.nope"], spark) == 2
    assert cli.main(["migrate", clean, "--target", "dump", "--out", str(tmp_path / "d")], spark) == 0 and json.loads(capsys.readouterr().out)["tables"]["orders"] == 60
    assert cli.main(["migrate", clean, "--plan", "--out", "x"], spark) == 0 and json.loads(capsys.readouterr().out)["tables"][0]["table"] == "customers"
    (tmp_path / "e").mkdir()
    (tmp_path / "e" / "x.csv").write_text("")
    assert cli.main(["analyze", str(tmp_path / "e")], spark) == 1


def test_generated_script_recomputes(spark, tmp_path):
    w = Workbook(spark)
    w.add("p", spark.createDataFrame([("a", 2.0), ("b", 3.0)], "k string, price double"), ["k"])
    w.add("s", spark.createDataFrame([(1, "a"), (2, "b"), (3, "q")], "id long, k string"), ["id"])
    w.derive("s", "price", '=XLOOKUP(B2,p!A:A,p!B:B,0)')
    for t in w.tables.values():
        t.df.write.parquet(str(tmp_path / t.name))
    exec(compile(sqltext.script(w, str(tmp_path)), "script", "exec"), {})
    assert [tuple(r) for r in spark.table("s_v").orderBy("id").collect()] == [(1, "a", 2.0), (2, "b", 3.0), (3, "q", 0.0)]


def test_dump_and_limits(spark, tmp_path):
    df = spark.createDataFrame([(1, "it's\ta\\b", True, 1.5), (2, None, None, None)], "id long, x string, ok boolean, f double")
    kinds = {"t": {"id": "integer", "x": "text", "ok": "boolean", "f": "float"}}
    assert [r.value for r in postgres.inserts(df, "t", kinds["t"]).orderBy("value").collect()] == ["INSERT INTO \"t\" (\"id\", \"x\", \"ok\", \"f\") VALUES (1, 'it''s\ta\\b', TRUE, 1.5);", 'INSERT INTO "t" ("id", "x", "ok", "f") VALUES (2, NULL, NULL, NULL);']
    assert [r.v for r in df.select(postgres.copy_line(kinds["t"]).alias("v")).collect()] == ["1\tit's\\ta\\\\b\ttrue\t1.5", "2\t\\N\t\\N\t\\N"]
    big = spark.range(12000).selectExpr("id", "id / 2 AS value")
    done = postgres.dump(spark, str(tmp_path / "d"), {"t": df, "big": big}, kinds | {"big": {"id": "integer", "value": "float"}}, {"t": "id", "big": "id"}, [])
    assert done == {"t": 2, "big": 12000} and "\\copy \"big\"" in (tmp_path / "d" / "load.sql").read_text()
    assert (tmp_path / "d" / "schema.sql").read_text().startswith('DROP TABLE IF EXISTS "big" CASCADE;\nDROP TABLE IF EXISTS "t" CASCADE;\nCREATE TABLE "t"')
    assert spark.read.text(str(tmp_path / "d" / "data" / "big")).count() == 12000
    problems = postgres.validate({"t" * 64: {"select": "text"}, "none": {}}, ["a", "A"])
    assert {p.code for p in problems} == {"duplicate_table", "no_columns", "identifier_too_long", "reserved_word"}
    assert [t["strategy"] for t in postgres.report({"big": {"id": "integer"}}, {}, [], {"big": 12000})["tables"]] == ["copy"]
    assert postgres.jdbc("postgresql://u:p%40@h/db") == ("jdbc:postgresql://h:5432/db", {"user": "u", "password": "p@", "driver": "org.postgresql.Driver"})
    with pytest.raises(ValueError, match="address"):
        postgres.jdbc("mysql://h/db")


def test_coercion_and_failed_tables(spark, tmp_path):
    df = spark.createDataFrame([("12.7", "yes", "2024-01-02T10:00", " "), ("-3.9", "0", "2024-02-03", None), ("1e3", "what", None, "x")], "n string, b string, d string, t string")
    got = [tuple(r) for r in df.select(coerced(df.n, "text", "integer"), coerced(df.b, "text", "boolean"), coerced(df.d, "text", "date").cast("string"), coerced(df.t, "text", "text")).collect()]
    assert got == [(12, True, "2024-01-02", None), (-3, False, "2024-02-03", None), (1000, False, None, "x")]
    assert lost(df, {"n": "integer", "b": "date", "t": "float"}) == {"b": 3, "t": 1}
    done = relational.write_sqlite(str(tmp_path / "x.db"), {"a": df, "b": df}, {"a": {"n": "float"}, "b": {"t": "integer"}}, {}, [])
    assert done == {"a": 3, "b": "t: 1 values aren't integer"}
    flags = spark.createDataFrame([(True, 2)], "b boolean, i int")
    assert flags.select(coerced(flags.b, "boolean", "integer"), coerced(flags.i, "integer", "boolean")).first() == (1, True)


def test_load_order_defers_only_what_closes_a_cycle():
    kinds = {t: {"id": "integer", "o": "integer", "p": "integer"} for t in "xyzw"}
    links = [ForeignKey("x", "o", "y", "id", 1), ForeignKey("y", "o", "x", "id", 1), ForeignKey("z", "o", "x", "id", 1), ForeignKey("w", "o", "z", "id", 1)]
    planned = relational.plan(kinds, dict.fromkeys("xyzw", "id"), links)
    assert [k.table for k in planned.deferred] == ["y"] and planned.order == ["y", "x", "z", "w"]
    assert planned.issues == [("fk_cycle", "y.o -> x.id is added after loading")]


def test_kinds_of_flows():
    assert [classify(f) for f in ("=B2/SUM($B$2:$B$6)", "=LOOKUP(A1,B:B,C:C)", "=XMATCH(A1,B:B)", "=SUMIF($A:$A,A2,$B:$B)", "=[1]S!A1")] == ["calculate", "join", "join", "aggregate", "copy"]


def test_cycle_across_tables(spark):
    w = Workbook(spark)
    w.add("t1", spark.createDataFrame([(1,), (2,)], "a long"), ["a"])
    w.add("t2", spark.createDataFrame([(1,), (1,)], "a long"), ["a"])
    w.derive("t1", "b", "=A2*10")
    w.derive("t1", "c", "=SUMIF(t2!A:A,A2,t2!B:B)")
    w.derive("t2", "b", "=VLOOKUP(A2,t1!A:C,3,FALSE)")
    w.derive("t2", "fine", "=VLOOKUP(A2,t1!A:C,2,FALSE)")
    assert {(t.table, t.column): t.status for t in w.translations()} == {("t1", "b"): "ok", ("t1", "c"): "unsupported", ("t2", "b"): "unsupported", ("t2", "fine"): "ok"}
    assert [tuple(r) for r in w.recompute("t2").collect()] == [(1, None, 10)] * 2
    assert [tuple(r) for r in w.recompute("t1").orderBy("a").collect()] == [(1, 10, None), (2, 20, None)]
    assert "depends on itself" in sqltext.views(w, "sqlite")


def test_repeated_keys_never_add_rows(spark):
    w = Workbook(spark)
    w.add("k", spark.createDataFrame([(1, "b", 2), (1, "a", 1), (None, "n", 3)], "id long, v string, o int"), ["o"])
    w.add("t", spark.createDataFrame([(1,), (1,), (None,), (5,)], "id long"), ["id"])
    w.derive("t", "v", "=VLOOKUP(A2,k!A:B,2,FALSE)")
    assert sorted((r.id or 0, r.v) for r in w.recompute("t").collect() if r.v) == [(1, "a")] * 2 and w.recompute("t").count() == 4


ROWS = [(g, v, d, s) for g, v, d, s in [("a", 1.0, "2024-01-05", "x"), ("a", 2.5, "2024-01-05", "yy"), ("a", None, None, None), ("b", 4.0, "2023-12-31", "z"), (None, 9.0, "2025-06-01", "é"), ("b", 4.0, "2024-03-01", "")]]


@pytest.mark.parametrize(("op", "column"), [("<>", "v"), ("<>", "s"), ("<", "d"), ("<=", "v"), (">=", "s")])
def test_inequalities_against_brute_force(spark, op, column):
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    data = spark.createDataFrame(ROWS, "g string, v double, d string, s string").selectExpr("g", "v", "CAST(d AS date) d", "s")
    w = Workbook(spark)
    w.add("data", data, ["v"])
    w.add("ask", data.selectExpr("*", "monotonically_increasing_id() AS i"), ["i"])
    letter = {"v": "B", "d": "C", "s": "D"}[column]
    for f, values in (("COUNTIFS", ""), ("SUMIFS", "data!B:B,"), ("AVERAGEIFS", "data!B:B,"), ("MINIFS", "data!B:B,"), ("MAXIFS", "data!B:B,")):
        w.derive("ask", f.lower(), f'={f}({values}data!A:A,A2,data!{letter}:{letter},"{op}"&{letter}2)')
    w.derive("ask", "all_rows", f'=COUNTIF(data!{letter}:{letter},"{op}"&{letter}2)')
    view = w.recompute("ask")
    test = {"<>": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}[op]
    for r in view.collect():
        mine = {"v": r.v, "d": str(r.d) if r.d else None, "s": r.s}[column]
        every = [x for x in ROWS if mine is not None and (y := x["gvds".index(column)]) is not None and test(y, mine)]
        hits = [x for x in every if x[0] is not None and x[0] == r.g]
        vs = [x[1] for x in hits if x[1] is not None]
        expected = (len(hits), sum(vs), sum(vs) / len(vs) if vs else None, min(vs, default=None), max(vs, default=None), len(every))
        assert tuple(r[f] for f in ("countifs", "sumifs", "averageifs", "minifs", "maxifs", "all_rows")) == pytest.approx(expected), (op, column, r)
    text = view._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in text


def test_row_aggregates_skip_blanks(spark):
    w = Workbook(spark)
    w.add("t", spark.createDataFrame([(1, 2.0, None), (2, None, None), (None, 5.0, 1.0)], "a long, b double, c double"), ["a"])
    for name, f in (("s", "=SUM(A2:C2)"), ("n", "=COUNT(A2:C2)"), ("m", "=AVERAGE(A2:C2)"), ("lo", "=MIN(A2:C2)"), ("hi", "=MAX(A2:C2)"), ("j", '=CONCAT(A2,"-",B2)')):
        w.derive("t", name, f)
    got = {r.a: tuple(r)[3:] for r in w.recompute("t").collect()}
    assert got[1] == (3.0, 2, 1.0, 1.0, 2.0, "1-2.0") and got[2] == (2.0, 1, pytest.approx(2 / 3), 2.0, 2.0, None) and got[None] == (6.0, 2, 2.0, 1.0, 5.0, None)


def test_diagram_names():
    text = relational.erd({"고객 목록": {"id": "integer"}, "orders": {"ref no": "text", "1st": "date"}}, {"고객 목록": "id"}, [ForeignKey("orders", "ref no", "고객 목록", "id", 0.7), ForeignKey("orders", "x", "gone", "id", 0.9)])
    assert '    table["고객 목록"] {' in text and '        text ref_no FK "ref no"' in text and '        date t_1st "1st"' in text
    assert '    orders }o..o| table : "ref no -> id (tentative 0.70)"' in text and "gone" not in text
    assert relational.plain_words(["a b", "a_b", "é", "ü", "a_b_2"]) == {"a b": "a_b", "a_b": "a_b_2", "é": "table", "ü": "table_2", "a_b_2": "a_b_2_2"}


def test_views_are_skipped_where_a_table_failed(spark, tmp_path):
    df = spark.createDataFrame([(1, "x")], "a long, b string")
    bad = TableInfo("bad", "f.xlsx", "Bad", 1, 1, [ColumnInfo("a", "integer"), ColumnInfo("b", "integer"), ColumnInfo("c", "integer", derived=True, formula="=A2*2", include=False)])
    a = Analysis([bad], frames={"bad": df.withColumn("c", df.a).withColumn(ROW, df.a)})
    for target, out in (("sqlite", tmp_path / "x.db"), ("dump", tmp_path / "d")):
        report = migrate(spark, a, target, str(out))
        assert report.failed and report.views == [] and [i.code for i in report.issues] == ["views_skipped"]
    assert (tmp_path / "d" / "views.sql").read_text() == "" and "views" not in (tmp_path / "d" / "load.sql").read_text()


def test_dump_plan(analysed):
    a = analysed
    report = plan(a, "postgres")
    assert report["problems"] == [] and [t["table"] for t in report["tables"]] == ["customers", "orders", "order_items"] and len(report["ddl"]) == 3
