"""Workbooks as cells, and sheets as typed tables.

Files are read as bytes by Spark, so any store that Spark reads will do, and parsed on the executors into a long table of cells;
headers, kinds and tables come from it by grouping. A file is one task. Only headers and kinds of columns reach the driver.
"""

from __future__ import annotations

import io
import posixpath
import re
import unicodedata
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass, field
from datetime import datetime, timedelta
from urllib.parse import unquote
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.operators.coerce import coerced
from gridloom.operators.profile import BOOLEAN_WORDS
from gridloom.plans.formula import column_index, column_letters

#: Rows in which a header is sought, the shares it needs, built-in number formats of dates.
HEADER_ROWS, HEADER_TEXTS, HEADER_WIDTH = 50, 0.8, 0.5
DATE_FORMATS = {*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)}
CELLS = "file string, sheet string, row int, col int, kind string, value string, formula string"
_BATCH = 20_000


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _children(z: zipfile.ZipFile, name: str) -> list[ElementTree.Element]:
    return list(ElementTree.fromstring(z.read(name)).iter()) if name in z.namelist() else []


def _targets(z: zipfile.ZipFile, name: str) -> dict[str, str]:
    folder, base = posixpath.split(name)
    return {e.get("Id"): e.get("Target") for e in _children(z, f"{folder}/_rels/{base}.rels") if _local(e.tag) == "Relationship"}


def external_books(z: zipfile.ZipFile) -> list[str]:
    """File names behind [1], [2] and so on."""
    links = _targets(z, "xl/workbook.xml")
    order = [links[e.get(k)] for e in _children(z, "xl/workbook.xml") if _local(e.tag) == "externalReference" for k in e.keys() if _local(k) == "id"]
    return [posixpath.basename(unquote(next(iter(_targets(z, posixpath.normpath(f"xl/{t}")).values()), ""))) for t in order]


def _date_styles(z: zipfile.ZipFile) -> list[bool]:
    own, out, inside = {}, [], False
    for e in _children(z, "xl/styles.xml"):
        if _local(e.tag) == "numFmt":
            plain = re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", e.get("formatCode", ""))
            own[int(e.get("numFmtId"))] = bool(re.search(r"[dmyhs]", plain, re.IGNORECASE))
        elif _local(e.tag) in ("cellXfs", "cellStyleXfs", "cellStyles", "dxfs"):
            inside = _local(e.tag) == "cellXfs"
        elif inside and _local(e.tag) == "xf":
            n = int(e.get("numFmtId", 0))
            out.append(own.get(n, n in DATE_FORMATS))
    return out


def _moved(formula: str, rows: int, cols: int) -> str:
    """A shared formula as it stands so many rows and columns on."""

    def one(m: re.Match) -> str:
        if m["other"]:
            return m[0]
        col = m["col"] if m["dc"] else column_letters(column_index(m["col"]) + cols)
        return f"{m['dc']}{col}{m['dr']}{m['row'] if m['dr'] else int(m['row']) + rows}"

    return re.sub(r"""(?P<other>"[^"]*"|'[^']*'!?|[\w.]+\(|\w+!)|(?<![\w.$])(?P<dc>\$?)(?P<col>[A-Z]{1,3})(?P<dr>\$?)(?P<row>\d+)(?![\w.(])""", one, formula)


def parse_cells(content: bytes, file: str) -> Iterator[tuple]:
    """Rows of CELLS of all sheets, hidden ones too. Kinds: number, text, boolean, datetime, error; empty cells are left out."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        links, dates = _targets(z, "xl/workbook.xml"), _date_styles(z)
        strings = ["".join(x.text or "" for x in si.iter() if _local(x.tag) == "t") for si in _children(z, "xl/sharedStrings.xml") if _local(si.tag) == "si"]
        first = datetime(1904, 1, 1) if any(_local(e.tag) == "workbookPr" and e.get("date1904") in ("1", "true") for e in _children(z, "xl/workbook.xml")) else datetime(1899, 12, 30)
        sheets = [(e.get("name"), links[next(e.get(k) for k in e.keys() if k.endswith("}id"))]) for e in _children(z, "xl/workbook.xml") if _local(e.tag) == "sheet"]
        for sheet, target in sheets:
            shared: dict[str, tuple[str, int, int]] = {}
            with z.open(posixpath.normpath(posixpath.join("/xl", target)).lstrip("/")) as source:
                for _, e in ElementTree.iterparse(source):
                    if _local(e.tag) == "row":
                        e.clear()
                    if _local(e.tag) != "c":
                        continue
                    letters, digits = re.fullmatch(r"([A-Z]+)(\d+)", e.get("r")).groups()
                    row, col, kind, formula = int(digits), column_index(letters), e.get("t", "n"), None
                    value = "".join(x.text or "" for x in e.iter() if _local(x.tag) == ("t" if kind == "inlineStr" else "v")) or None
                    for f in (x for x in e if _local(x.tag) == "f"):
                        if f.get("t") == "shared":
                            if f.text:
                                shared[f.get("si")] = (f.text, row, col)
                            text, r, c = shared[f.get("si")]
                            formula = "=" + _moved(text, row - r, col - c)
                        elif f.text and f.get("t") != "array":
                            formula = "=" + f.text
                    if value is not None and kind == "s":
                        value = strings[int(value)]
                    name = {"s": "text", "str": "text", "inlineStr": "text", "b": "boolean", "e": "error", "d": "datetime"}.get(kind, "number")
                    if name == "number" and value is not None and dates and dates[int(e.get("s", 0))]:
                        name, value = "datetime", (first + timedelta(days=float(value))).isoformat(" ", "seconds")
                    if name == "boolean" and value is not None:
                        value = "true" if value == "1" else "false"
                    if value is not None or formula:
                        yield file, sheet, row, col, name, value, formula


def cells(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """The cells of all workbooks (.xlsx, .xlsm) under the paths; other files are passed over."""
    files = spark.read.format("binaryFile").load(path).where(F.lower("path").rlike(r"\.xls[xm]$")).select("path", "content")

    def parse(batches):
        import pandas as pd

        names = [x.split()[0] for x in CELLS.split(", ")]
        for batch in batches:
            for where, content in zip(batch["path"], batch["content"], strict=True):
                rows = []
                if reads(bytes(content)):
                    continue
                for row in parse_cells(bytes(content), unquote(posixpath.basename(where))):
                    rows.append(row)
                    if len(rows) == _BATCH:
                        yield pd.DataFrame(rows, columns=names)
                        rows = []
                yield pd.DataFrame(rows, columns=names)

    return files.repartition("path").mapInPandas(parse, CELLS)


def reads(content: bytes) -> str:
    """Why a file can't be read as a workbook; empty if it can. Its parts' checksums are checked, and the text of each part of the workbook."""
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            if bad := z.testzip():
                return f"{bad} is damaged"
            if "xl/workbook.xml" not in z.namelist():
                return "it holds no workbook"
            for name in z.namelist():
                if name.startswith("xl/") and name.endswith((".xml", ".rels")):
                    for _, element in ElementTree.iterparse(z.open(name)):
                        element.clear()
    except (zipfile.BadZipFile, zipfile.LargeZipFile, ElementTree.ParseError, EOFError, OSError, NotImplementedError, RuntimeError) as e:
        return str(e) or type(e).__name__
    return ""


def damaged(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """file and why, for workbooks that can't be read; cells() and books() pass them over."""
    files = spark.read.format("binaryFile").load(path).where(F.lower("path").rlike(r"\.xls[xm]$")).select("path", "content")

    def parse(batches):
        import pandas as pd

        for batch in batches:
            found = [(unquote(posixpath.basename(p)), reads(bytes(c))) for p, c in zip(batch["path"], batch["content"], strict=True)]
            yield pd.DataFrame([x for x in found if x[1]], columns=["file", "why"])

    return files.mapInPandas(parse, "file string, why string")


def books(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """file, place (1, 2, ...) and book of the workbooks that each file's formulas call [1], [2] and so on."""
    files = spark.read.format("binaryFile").load(path).where(F.lower("path").rlike(r"\.xls[xm]$")).select("path", "content")

    def parse(batches):
        import pandas as pd

        for batch in batches:
            rows = []
            for where, content in zip(batch["path"], batch["content"], strict=True):
                if reads(bytes(content)):
                    continue
                with zipfile.ZipFile(io.BytesIO(bytes(content))) as z:
                    rows += [(unquote(posixpath.basename(where)), i, b) for i, b in enumerate(external_books(z), 1)]
            yield pd.DataFrame(rows, columns=["file", "place", "book"])

    return files.mapInPandas(parse, "file string, place int, book string")


def file_names(spark: SparkSession, path: str | list[str]) -> list[str]:
    """Names of all files under the paths, other kinds too; contents aren't read."""
    found = spark.read.format("binaryFile").load(path).select("path").collect()
    return sorted(unquote(posixpath.basename(r["path"])) for r in found)


def identifier(raw: object, fallback: str) -> str:
    """A lower-case name of word characters; letters of any script stay."""
    name = re.sub(r"_+", "_", re.sub(r"\W", "_", unicodedata.normalize("NFKC", str(raw or "")))).strip("_").lower() or fallback
    return f"_{name}" if name[0].isdigit() else name


def distinct_names(names: list[str]) -> list[str]:
    """Later ones of equal names get _2, _3 and so on, whichever is free."""
    out: list[str] = []
    for n in names:
        i, name = 1, n
        while name in out:
            i += 1
            name = f"{n}_{i}"
        out.append(name)
    return out


@dataclass
class Sheet:
    name: str
    file: str
    sheet: str
    header_row: int
    columns: list[str]
    kinds: list[str]
    df: DataFrame
    issues: list[str] = field(default_factory=list)


def tables(found: DataFrame) -> list[Sheet]:
    """A table for each sheet with a header; sheets without one are left out. found: cells, read more than once, so kept by the caller."""
    filled = F.col("value").isNotNull() & (F.trim("value") != "")
    key = ["file", "sheet"]
    width = found.groupBy(*key).agg((F.max("col") + 1).alias("width"))
    head = found.where(F.col("row") <= HEADER_ROWS).groupBy(*key, "row").agg(F.count_if(filled).alias("n"), F.count_if(filled & (F.col("kind") == "text")).alias("texts"))
    rows = head.join(width, key).where((F.col("n") > 0) & (F.col("texts") >= HEADER_TEXTS * F.col("n")) & (F.col("n") >= HEADER_WIDTH * F.col("width"))).groupBy(*key, "width").agg(F.min("row").alias("header"))
    below = found.join(F.broadcast(rows), key).where(F.col("row") > F.col("header"))  # a row for each sheet
    is_kind = lambda *k: F.bool_and(F.when(filled, F.col("kind").isin(*k)))
    number = F.when(filled & (F.col("kind") == "number"), F.col("value").try_cast("double"))
    kind = (
        F.when(is_kind("boolean"), "boolean")
        .when(is_kind("datetime"), F.when(F.bool_and(F.when(filled, F.col("value").rlike(r" 00:00:00$"))), "date").otherwise("datetime"))
        .when(is_kind("number"), F.when(F.bool_and(number == F.floor(number)), "integer").otherwise("float"))
        .when(is_kind("text") & F.bool_and(F.when(filled, F.lower(F.trim("value")).isin(*BOOLEAN_WORDS))), "boolean")
        .otherwise("text")
    )
    kinds = {(r["file"], r["sheet"], r["col"]): r["kind"] for r in below.groupBy(*key, "col").agg(kind.alias("kind")).collect()}
    titles = {(r["file"], r["sheet"], r["col"]): r["value"] for r in found.join(F.broadcast(rows), key).where((F.col("row") == F.col("header")) & filled).select(*key, "col", "value").collect()}
    sheets = sorted(rows.collect(), key=lambda r: (r["file"], r["sheet"]))
    names = distinct_names([identifier(r["sheet"], f"sheet_{i + 1}") for i, r in enumerate(sheets)])
    out = []
    for name, r in zip(names, sheets, strict=True):
        at = (r["file"], r["sheet"])
        last = max((c for f, s, c in titles if (f, s) == at), default=-1)
        columns = distinct_names([identifier(titles.get((*at, c)), f"col_{c + 1}") for c in range(last + 1)])
        types = [kinds.get((*at, c), "text") for c in range(last + 1)]
        own = below.where((F.col("file") == at[0]) & (F.col("sheet") == at[1]) & (F.col("col") <= last))
        # A row's cells are at most as many as the sheet has columns.
        wide = own.where(filled).groupBy("row").agg(*[F.max(F.when(F.col("col") == c, F.col("value"))).alias(f"c{c}") for c in range(last + 1)])
        df = wide.select("row", *[coerced(F.col(f"c{c}"), "text", k).alias(columns[c]) for c, k in enumerate(types)])
        out.append(Sheet(name, *at, r["header"], columns, types, df, ["blank_header"] if any((*at, c) not in titles for c in range(last + 1)) else []))
    return out
