import sqlite3
import zipfile

import duckdb
import pytest

from gridloom.operators.profile import ForeignKey, foreign_keys, name_matches, primary_key, profile
from gridloom.plans.lineage import classify, flowchart, function_names, function_totals, inventory
from gridloom.plans.structure_queries import ORACLE_SQL, QUERIES
from gridloom.sinks.relational import ddl, erd, plan, write_sqlite
from gridloom.sources.xlsx import _moved, cells, distinct_names, identifier, tables

DATA = "/root/testdata/sf0.001"
NS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def sheet_xml(rows):
    """rows: row number to cells, each (attributes, inner XML)."""
    body = "".join(f'<row r="{r}">' + "".join(f'<c r="{chr(65 + i)}{r}" {a}>{x}</c>' for i, (a, x) in enumerate(cs) if x) + "</row>" for r, cs in rows.items())
    return f"<worksheet {NS}><sheetData>{body}</sheetData></worksheet>"


def write_workbook(path, sheets):
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {NS} xmlns:r="{REL}"><sheets>' + "".join(f'<sheet name="{n}" sheetId="{i}" r:id="r{i}"/>' for i, n in enumerate(sheets)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="r{i}" Target="worksheets/s{i}.xml"/>' for i in range(len(sheets))) + "</Relationships>")
        z.writestr("xl/styles.xml", f'<styleSheet {NS}><cellStyleXfs><xf numFmtId="14"/></cellStyleXfs><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>')
        z.writestr("xl/sharedStrings.xml", f"<sst {NS}><si><t>Order No</t></si><si><r><t>Cust</t></r><r><t>omer</t></r></si></sst>")
        for i, rows in enumerate(sheets.values()):
            z.writestr(f"xl/worksheets/s{i}.xml", sheet_xml(rows))


def text(v):
    return 't="inlineStr"', f"<is><t>{v}</t></is>"


def number(v, style=0):
    return f's="{style}"', f"<v>{v}</v>"


def test_workbook_to_tables(spark, tmp_path):
    write_workbook(tmp_path / "a.xlsx", {
        "Orders": {
            1: [text("A title")],
            3: [('t="s"', "<v>0</v>"), ('t="s"', "<v>1</v>"), text("Day"), text("Open"), text("Double")],
            4: [number(1), text("x"), number(45000, 1), ('t="b"', "<v>1</v>"), ("", '<f t="shared" si="0" ref="E4:E5">A4*2</f>')],
            5: [number(2), text("  "), number(45001, 1), ('t="b"', "<v>0</v>"), ("", '<f t="shared" si="0"/>')],
            6: [text(" "), text("")],
        },
        "Numbers": {1: [number(1), number(2)], 2: [number(3), number(4)]},
    })
    (tmp_path / "data.csv").write_text("a,b")
    found = cells(spark, str(tmp_path))
    (sheet,) = tables(found)  # Numbers has no header
    assert (sheet.name, sheet.header_row, sheet.columns) == ("orders", 3, ["order_no", "customer", "day", "open", "double"])
    assert sheet.kinds == ["integer", "text", "date", "boolean", "text"]
    rows = [tuple(r) for r in sheet.df.orderBy("row").select("row", "customer", sheet.df.day.cast("string"), "open").collect()]
    assert rows == [(4, "x", "2023-03-15", True), (5, None, "2023-03-16", False)]
    formulas = inventory(found).collect()
    assert [(r["col"], r["formulas"], r["sample"]) for r in formulas] == [(4, 2, "=A4*2")]
    assert {r["formula"] for r in found.where("formula IS NOT NULL").collect()} == {"=A4*2", "=A5*2"}


def test_empty_folder_of_workbooks(spark, tmp_path):
    (tmp_path / "x.csv").write_text("")
    assert tables(cells(spark, str(tmp_path))) == []


def test_shared_formulas_move():
    assert _moved('SUM($A1,B$2,$C$3)&"A1"&Log10!B2', 2, 1) == 'SUM($A3,C$2,$C$3)&"A1"&Log10!C4'


def test_names():
    assert [identifier(x, "col_3") for x in ("Order No", None, "1st col", "Größe (cm)", "--")] == ["order_no", "col_3", "_1st_col", "größe_cm", "col_3"]
    assert distinct_names(["a", "a", "a_2", "b"]) == ["a", "a_2", "a_2_2", "b"]


def test_formula_kinds(spark):
    assert [classify(f) for f in ("=VLOOKUP(A1,B:C,2,0)", "=SUMIF(A:A,1)", "=Orders!B2", "=A1*2", '=IF(A1="SUM(",1,2)')] == ["join", "aggregate", "copy", "calculate", "calculate"]
    assert function_names("='My SUM('!A1+_xlfn.XLOOKUP(A1,B1,C1)+sum(A1)") == ["XLOOKUP", "SUM"]
    found = spark.createDataFrame([("f", "s", 0, "=SUM(A1)+SUM(B1)"), ("f", "s", 0, "=1"), ("f", "s", 1, "plain"), ("f", "s", 1, None)], "file string, sheet string, col int, formula string")
    assert [tuple(r) for r in function_totals(inventory(found)).collect()] == [("SUM", 2)]


def test_profile_of_blanks_and_words(spark):
    df = spark.createDataFrame([(1, "yes", " ", 1.0, None), (2, "No", "", 2.0, None), (2, None, None, 2.0, None)], "id int, flag string, none string, whole double, nothing int")
    assert [tuple(r) for r in profile(df).collect()] == [("id", "integer", 0.0, False, None), ("flag", "boolean", 1 / 3, True, None), ("none", "text", 1.0, True, None), ("whole", "integer", 0.0, False, None), ("nothing", "text", 1.0, True, None)]
    assert [r["kind"] for r in profile(df.where("false")).collect()] == ["text"] * 5


def test_keys(spark):
    region = spark.createDataFrame([("N", "a"), ("S", "b"), ("W", "c")], "region_code string, label string")
    store = spark.createDataFrame([(i, "NSW"[i % 3] + " ", i % 2) for i in range(6)], "store_no int, region_code string, size int")
    frames = {"region": region, "store": store}
    keys = {t: primary_key(df) for t, df in frames.items()}
    assert keys == {"region": "region_code", "store": "store_no"}
    assert foreign_keys(frames, keys) == [ForeignKey("store", "region_code", "region", "region_code", 0.9)]
    looked = {("store", "region_code", "region")}
    assert foreign_keys(frames, keys, looked)[0].confidence == 0.98
    assert foreign_keys(frames, keys, looked, {"region": "a.xlsx", "store": "b.xlsx"})[0].confidence == 0.99
    assert primary_key(region.where("false")) is None
    assert name_matches("city_id", "cities", "id") and name_matches("box_no", "boxes", "id") and not name_matches("size", "region", "code")


def test_loading_order_and_sqlite(spark, tmp_path):
    kinds = {"employees": {"id": "integer", "dept_id": "integer", "boss_id": "integer"}, "departments": {"id": "integer", "head_id": "integer", "since": "date"}}
    keys = {"employees": "id", "departments": "id"}
    links = [ForeignKey("employees", "dept_id", "departments", "id", 0.9), ForeignKey("employees", "boss_id", "employees", "id", 0.9), ForeignKey("departments", "head_id", "employees", "id", 0.7), ForeignKey("employees", "dept_id", "ghosts", "id", 0.9)]
    planned = plan(kinds, keys, links)
    assert planned.order == ["departments", "employees"]
    assert [k.column for k in planned.deferred] == ["boss_id", "head_id"]
    assert [c for c, _ in planned.issues] == ["fk_skipped", "fk_cycle"]
    assert len(ddl(kinds, keys, planned)) == 4
    frames = {"employees": spark.sql("SELECT id, 1L AS dept_id, CAST(NULL AS BIGINT) AS boss_id FROM range(2500)"), "departments": spark.sql("SELECT 1L AS id, 5L AS head_id, DATE'2024-01-02' AS since UNION ALL SELECT 1L, 6L, NULL")}
    done = write_sqlite(str(tmp_path / "x.db"), frames, kinds, keys, links)
    assert done["employees"] == 2500 and "UNIQUE" in done["departments"]
    with sqlite3.connect(tmp_path / "x.db") as db:
        assert db.execute("SELECT count(*), sum(id) FROM employees").fetchone() == (2500, 2499 * 1250)
        assert db.execute("SELECT count(*) FROM departments").fetchone() == (0,)
    assert '    departments }o..o| employees : "head_id -> id (tentative 0.70)"' in erd(kinds, keys, links[:3])


def test_flowchart():
    rows = [{"source": "a", "target": "b", "op": "copy", "weight": 2}, {"source": "b", "target": "c", "op": "join", "weight": 3}]
    assert '  n0 -.->|"copy ×2"| n1' in flowchart(rows) and '  n1 -->|"join ×3"| n2' in flowchart(rows)


@pytest.mark.parametrize("name", ORACLE_SQL)
def test_queries_match_sql(spark, name):
    db = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events".split():
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    found = db.execute(ORACLE_SQL[name])
    columns = [c[0] for c in found.description]
    shown = lambda row: [round(v, 9) if isinstance(v, float) else v for v in row]
    assert sorted(map(str, map(shown, found.fetchall()))) == sorted(map(str, map(shown, QUERIES[name](spark, DATA).select(*columns).collect())))


def test_inferred_keys_equal_their_sql(spark):
    import duckdb

    from gridloom.plans import structure_queries as q

    folder = "/root/testdata/sf0.001"
    duck = duckdb.connect()
    for t in q._KINDS:
        duck.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    got = sorted(map(str, map(tuple, q.inferred_keys(spark, folder).collect())))
    assert got == sorted(map(str, duck.sql(q.ORACLE_SQL["inferred_keys"]).fetchall()))


def test_whole_numbers_are_compared_as_numbers(spark):
    from gridloom.operators import profile as p

    """Fractions that no key has stay behind, and still count as filled."""
    values = spark.createDataFrame([(1.0,), (2.5,), (None,), (-0.0,), (float(2**53),)], "x double")
    kind, number, text = p._plain(values, "x")
    assert kind == "number" and [tuple(r) for r in values.select(number, text).collect()][:2] + [tuple(values.select(number, text).collect()[4])] == [(1, ""), (0, "2.5"), (2**53, "")]
    keys = spark.createDataFrame([(0,), (1,), (7,), (None,)], "id int")
    assert p._overlaps({"a": values, "b": keys}, [("a", "x", "b", "id")]) == {("a", "x", "b"): (2 / 4, 2 / 3)}
