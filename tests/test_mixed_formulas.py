"""Columns whose rows have different formulas or constants, and folders with damaged workbooks."""

import pytest

from gridloom.plans import sqltext
from gridloom.plans.analysis import Analysis, analyze
from tests.test_workbooks import write

N = 40


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    at = tmp_path_factory.mktemp("mixed")
    rows = [["Item ID", "Qty", "Price", "Total", "Scaled", "Label", "Plain"]]
    for i in range(N):
        r = i + 2
        total = 77.5 if i == 11 else f"=B{r}*C{r}" if i % 10 < 7 else f"=B{r}*C{r}*0.9"
        rows.append([i, i % 6 + 1, 1.5 * (i % 4 + 1), total, f"=B{r}*{i}.5+{2}", f'=IF(B{r}>3,"many{i % 2}","few")', f"=C{r}+1"])
    write(at / "mixed.xlsx", {"Items": rows})
    (at / "broken.xlsx").write_bytes(b"PK\x03\x04 this is no archive")
    whole = (at / "mixed.xlsx").read_bytes()
    (at / "cut.xlsx").write_bytes(whole[: len(whole) // 2])
    write(at / "fine.xlsx", {"Other": [["Code", "N"], *[[f"c{i}", i] for i in range(5)]]})
    return str(at)


@pytest.fixture(scope="module")
def analysed(spark, folder):
    return analyze(spark, folder)


def test_each_row_follows_its_own_formula(spark, analysed):
    book = analysed.without(["items.total", "items.scaled", "items.label", "items.plain"]).workbook(spark)
    got = {r.item_id: r for r in book.recompute("items").collect()}
    assert len(got) == N and sorted(got[0].asDict()) == ["item_id", "label", "plain", "price", "qty", "scaled", "total"]
    for i, r in got.items():
        q, p = i % 6 + 1, 1.5 * (i % 4 + 1)
        assert r.total == (77.5 if i == 11 else pytest.approx(q * p if i % 10 < 7 else q * p * 0.9)), i
        assert r.scaled == pytest.approx(q * (i + 0.5) + 2) and r.plain == p + 1
        assert r.label == (f"many{i % 2}" if q > 3 else "few")


def test_shapes_are_few_and_said(analysed):
    shapes = {c: [s for s in analysed.shapes if s.column == c] for c in ("total", "scaled", "label", "plain")}
    assert [len(shapes[c]) for c in shapes] == [2, 1, 2, 1], "a row for each shape, not for each constant"
    assert shapes["scaled"][0].varies == [0] and shapes["scaled"][0].cells == N and not shapes["plain"][0].varies
    mixed = {i.column for i in analysed.issues if i.code == "mixed_formulas"}
    assert mixed == {"total", "label"}
    again = Analysis.from_json(analysed.to_json())
    assert again.shapes == analysed.shapes and again.cells is None


def test_a_loaded_analysis_has_the_first_formula(spark, analysed, tmp_path):
    analysed.save(spark, str(tmp_path / "saved"))
    book = Analysis.load(spark, str(tmp_path / "saved")).without(["items.total"]).workbook(spark)
    got = {r.item_id: r.total for r in book.recompute("items").collect()}
    assert got[8] == pytest.approx(3 * 1.5), "its cells weren't saved"
    assert "rows differ in their formulas" in sqltext.views(analysed.without(["items.total"]).workbook(spark), "sqlite")


def test_damaged_files_are_issues(analysed):
    assert {i.file for i in analysed.issues if i.code == "unreadable_file"} == {"broken.xlsx", "cut.xlsx"}
    assert {t.name for t in analysed.tables} == {"items", "other"}
    analysed.close()
