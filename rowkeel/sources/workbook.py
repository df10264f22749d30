"""Excel workbooks (xlsx) as tables, without any spreadsheet library.

Bytes come through Spark's binaryFile reader, so any store that Spark reads will do. A workbook is parsed once,
where its file lands, into rows of (kind, text) cells in the shared folder, parted by sheet; headers and types are then
plain DataFrame expressions over these. A workbook is one archive of limited size, hence one task a book.
"""

from __future__ import annotations

import datetime as dt
import io
import re
import unicodedata
import uuid
import zipfile
from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence
from functools import reduce
from itertools import islice
from xml.etree import ElementTree as ET

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..catalog import TableCatalog, table_key
from ..shared import shared_dir

# Texts that a workbook cell may hold for a missing value.
NULL_TOKENS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")
# What marks a summary sheet, by lower-cased name, or as it is.
SUMMARY_WORDS, SUMMARY_SIGNS = ("résumé", "resume"), ("📋",)

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
_PACKAGE = "{http://schemas.openxmlformats.org/package/2006/relationships}"
_DATE_FORMATS = frozenset([*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)])
_CELLS = "book int, sheet int, name string, row int, cells array<struct<kind: string, text: string>>"


def is_summary(sheet: str) -> bool:
    """Whether a sheet is a summary, not a table. Accents count composed or not."""
    low = unicodedata.normalize("NFC", sheet).lower()
    return any(w in low for w in SUMMARY_WORDS) or any(s in sheet for s in SUMMARY_SIGNS)


def _sheets(book: zipfile.ZipFile) -> dict[str, str]:
    """Sheet name -> path in the archive, in the workbook's order."""
    links = {r.get("Id"): r.get("Target") for r in ET.fromstring(book.read("xl/_rels/workbook.xml.rels")).iter(f"{_PACKAGE}Relationship")}
    found = ET.fromstring(book.read("xl/workbook.xml")).iter(f"{_MAIN}sheet")
    at = {s.get("name"): links[s.get(_LINK)] for s in found}
    return {n: t.lstrip("/") if t.startswith("/") else f"xl/{t}" for n, t in at.items()}


def _shared(book: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in book.namelist():
        return []
    return ["".join(t.text or "" for t in si.iter(f"{_MAIN}t")) for si in ET.fromstring(book.read("xl/sharedStrings.xml")).iter(f"{_MAIN}si")]


def _date_styles(book: zipfile.ZipFile) -> set[int]:
    """Cell styles that show a number as a date."""
    if "xl/styles.xml" not in book.namelist():
        return set()
    root = ET.fromstring(book.read("xl/styles.xml"))
    own = {int(f.get("numFmtId")): f.get("formatCode", "") for f in root.iter(f"{_MAIN}numFmt")}
    is_date = lambda n: n in _DATE_FORMATS or bool(re.search(r"[ymdhs]", re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", own.get(n, "")), re.I))
    xfs = root.find(f"{_MAIN}cellXfs")
    return {i for i, x in enumerate(xfs if xfs is not None else ()) if is_date(int(x.get("numFmtId", 0)))}


def _column(ref: str) -> int:
    n = 0
    for ch in re.match(r"[A-Z]+", ref)[0]:
        n = 26 * n + ord(ch) - 64
    return n - 1


def _number(text: str) -> str:
    """A number's text: whole ones without a fraction."""
    x = float(text)
    return str(int(x)) if x.is_integer() and abs(x) < 1e15 else repr(x)


def _date(serial: str) -> str:
    whole = dt.datetime(1899, 12, 30) + dt.timedelta(seconds=round(float(serial) * 86400, 3))
    return whole.isoformat(sep=" ")


def parse_book(data: bytes, want: Callable[[str], bool]) -> Iterator[tuple[int, str, Iterator[tuple[int, list[tuple[str, str] | None]]]]]:
    """(place from 0, name, rows) of each sheet, rows only of the wanted ones, to be read before the next sheet is asked for.

    A row is (worksheet row from 1, cells); a cell is (kind, text), kind n, s, b or t, or None. What sheets share is parsed once.
    """
    with zipfile.ZipFile(io.BytesIO(data)) as book:
        shared, dates = _shared(book), _date_styles(book)
        for i, (name, at) in enumerate(_sheets(book).items()):
            yield i, name, _rows(book, at, shared, dates) if want(name) else iter(())


def _rows(book: zipfile.ZipFile, at: str, shared: list[str], dates: set[int]) -> Iterator[tuple[int, list[tuple[str, str] | None]]]:
    with book.open(at) as xml:
        last = 0
        for _, row in ET.iterparse(xml):
            if row.tag != f"{_MAIN}row":
                continue
            last = int(row.get("r", last + 1))
            cells: list[tuple[str, str] | None] = []
            for c in row.iter(f"{_MAIN}c"):
                i = _column(c.get("r")) if c.get("r") else len(cells)
                cells += [None] * (i + 1 - len(cells))
                cells[i] = _cell(c, shared, dates)
            yield last, cells
            row.clear()


def _cell(c: ET.Element, shared: list[str], dates: set[int]) -> tuple[str, str] | None:
    kind, v = c.get("t", "n"), c.find(f"{_MAIN}v")
    if kind == "inlineStr":
        return "s", "".join(t.text or "" for t in c.iter(f"{_MAIN}t"))
    if v is None or v.text is None or kind == "e":
        return None
    if kind == "s":
        return "s", shared[int(v.text)]
    if kind == "b":
        return "b", "true" if v.text == "1" else "false"
    if kind == "n":
        return ("t", _date(v.text)) if int(c.get("s", 0)) in dates else ("n", _number(v.text))
    return ("t", v.text.replace("T", " ")) if kind == "d" else ("s", v.text)


def list_sheets(spark: SparkSession, *paths: str, tables_only: bool = True) -> DataFrame:
    """path, ordinal, sheet: the sheets of workbooks in order; tables_only: without summaries. Only the lists are parsed, a book a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, data in zip(b.column("path").to_pylist(), b.column("content")):
                with zipfile.ZipFile(io.BytesIO(data.as_buffer().to_pybytes())) as book:
                    names = [(i, n) for i, n in enumerate(_sheets(book)) if not (tables_only and is_summary(n))]
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(names), pa.string()), pa.array([i for i, _ in names], pa.int32()), pa.array([n for _, n in names], pa.string())], names=["path", "ordinal", "sheet"])

    return spark.read.format("binaryFile").load(list(paths)).select("path", "content").mapInArrow(run, "path string, ordinal int, sheet string")


def sheet_names(spark: SparkSession, path: str, *, tables_only: bool = True) -> list[str]:
    """The sheets of a workbook in order; tables_only: without summaries."""
    return [r.sheet for r in list_sheets(spark, path, tables_only=tables_only).orderBy("ordinal").collect()]


def read_cells(spark: SparkSession, paths: Sequence[str], sheet: str | None = None, null_tokens: Iterable[str] = NULL_TOKENS) -> DataFrame:
    """book, sheet (places from 0), name, row, cells of the workbooks' table sheets, or of the one named sheet.

    Each book is parsed once, in one task, and the cells are written to the shared folder, in a part for each sheet. Every
    sheet has a row 0 that holds its name; elsewhere name is null. Texts that are a null token become null.
    """
    tokens = frozenset(null_tokens)
    out = pa.schema([("book", pa.int32()), ("sheet", pa.int32()), ("name", pa.string()), ("row", pa.int32()), ("cells", pa.list_(pa.struct([("kind", pa.string()), ("text", pa.string())])))])

    def want(name: str) -> bool:
        return name == sheet if sheet is not None else not is_summary(name)

    def rows(number: int, data: bytes) -> Iterator[tuple]:
        for i, name, found in parse_book(data, want):
            yield number, i, name, 0, None
            for n, cells in found:
                yield number, i, None, n, [None if c is None or c[1] in tokens else {"kind": c[0], "text": c[1]} for c in cells]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for number, data in zip(b.column("book").to_pylist(), b.column("content")):
                left = rows(number, data.as_buffer().to_pybytes())
                while some := list(islice(left, 5000)):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some), out.types)], schema=out)

    books = [spark.read.format("binaryFile").load(p).select(F.lit(i).alias("book"), "content") for i, p in enumerate(paths)]
    at = f"{shared_dir(spark)}/rowkeel-{uuid.uuid4().hex}"
    reduce(DataFrame.unionByName, books).mapInArrow(run, _CELLS).write.partitionBy("book", "sheet").parquet(at)
    return spark.read.schema(_CELLS).parquet(at)


def _tables(cells: DataFrame, header_row: int, wanted: Callable[[int, str], bool], schema: T.StructType | None = None) -> Iterator[tuple[int, str, DataFrame]]:
    """book, name and table of each wanted sheet, in order. Two jobs for all sheets: one for names and headers, one for kinds."""
    names: dict[tuple[int, int], str] = {}
    heads: dict[tuple[int, int], list[str | None]] = {}
    for r in cells.where(F.col("row").isin(0, header_row)).select("book", "sheet", "name", "row", F.col("cells.text").alias("texts")).collect():
        if r.row == 0:
            names[r.book, r.sheet] = r.name
        else:
            heads[r.book, r.sheet] = r.texts
    # One pass for the width and the kinds of each column: a row for each column and kind.
    kinds: dict[tuple[int, int], dict[int, set[str]]] = {}
    if schema is None:
        each = cells.where(F.col("row") > header_row).select("book", "sheet", F.posexplode("cells"))
        for r in each.groupBy("book", "sheet", "pos").agg(F.collect_set("col.kind").alias("kinds"), F.bool_or(F.col("col.text").rlike(r"[.e]")).alias("fraction")).collect():
            kinds.setdefault((r.book, r.sheet), {})[r.pos] = {k + "." if k == "n" and r.fraction else k for k in r.kinds}
    for (book, i), name in sorted(names.items()):
        if wanted(book, name):
            body = cells.where((F.col("book") == book) & (F.col("sheet") == i) & (F.col("row") > header_row))
            yield book, name, _table(body, name, header_row, heads.get((book, i)), kinds.get((book, i), {}), schema)


def _table(body: DataFrame, sheet: str, header_row: int, head: list[str | None] | None, kinds: dict[int, set[str]], schema: T.StructType | None) -> DataFrame:
    if not any(h is not None for h in head or ()):
        raise ValueError(f"sheet {sheet!r} has no header in row {header_row}")
    width = max([len(head), *(p + 1 for p in kinds)])
    names = [t if t is not None else f"_c{i}" for i, t in enumerate([*head, *[None] * (width - len(head))])]
    if len(set(names)) < len(names):
        raise ValueError(f"sheet {sheet!r} repeats the headers {', '.join(sorted({n for n in names if names.count(n) > 1}))}")
    cell = lambda i: F.get("cells", F.lit(i))
    if schema is not None:
        missing = [f.name for f in schema if f.name not in names]
        if missing:
            raise ValueError(f"sheet {sheet!r} lacks the columns {', '.join(missing)}")
        return body.select(*[cell(names.index(f.name))["text"].try_cast(f.dataType).alias(f.name) for f in schema])
    to = {frozenset("n"): "bigint", frozenset(["n."]): "double", frozenset("b"): "boolean", frozenset("t"): "timestamp", frozenset("s"): "string", frozenset(): "string"}
    out = []
    for i, name in enumerate(names):
        kind = to.get(frozenset(kinds.get(i, ())))
        out.append((cell(i)["text"].cast(kind) if kind else cell(i)).alias(name))
    return body.select(*out)


def read_sheet(spark: SparkSession, path: str, sheet: str, *, header_row: int = 2, schema: T.StructType | None = None, null_tokens: Iterable[str] = NULL_TOKENS) -> DataFrame:
    """A sheet as a table: names from header_row (row 1 is a banner), data below it.

    Without a schema a column is BIGINT, DOUBLE, BOOLEAN, TIMESTAMP or STRING if all its values are of that kind, and
    STRUCT<kind, text> if they are mixed, so that number 1 and text '1' stay two values. With one, columns
    are picked by name and cast; what can't be cast is null. A sheet that isn't there, that has no header or has the same
    name twice raises ValueError; a blank header becomes _c and its place.
    """
    cells = read_cells(spark, [path], sheet, null_tokens)
    for _, _, table in _tables(cells, header_row, lambda _, name: name == sheet, schema):
        return table
    raise ValueError(f"no sheet {sheet!r}; there are {', '.join(sheet_names(spark, path, tables_only=False))}")


def load_workbooks(spark: SparkSession, books: Mapping[str, str], catalog: TableCatalog | None = None, *, header_row: int = 2, view: bool = False) -> TableCatalog:
    """Register every table sheet of the workbooks {system: path} as system/sheet. Each path is one workbook; all are parsed in one job, once."""
    catalog = catalog if catalog is not None else TableCatalog()
    if books:
        systems = list(books)
        for book, sheet, table in _tables(read_cells(spark, list(books.values())), header_row, lambda _, name: not is_summary(name)):
            catalog.register(table_key(systems[book], sheet), table, view=view)
    return catalog
