"""Small tables as an xlsx workbook, with the standard library only, in any store that Spark writes to."""

from __future__ import annotations

import io
import uuid
import zipfile
from collections.abc import Mapping, Sequence
from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import DataFrame, SparkSession

from ..shared import shared_dir

_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_LINKS = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PACKAGE = "http://schemas.openxmlformats.org/package/2006/relationships"
#: Rows that a worksheet can hold.
MAX_ROWS = 1_048_576

Cell = str | int | float | bool | None


def _cell(value: Cell) -> str:
    if value is None:
        return "<c/>"
    if isinstance(value, bool):
        return f'<c t="b"><v>{int(value)}</v></c>'
    if isinstance(value, (int, float)):
        return f"<c><v>{value!r}</v></c>"
    return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(value)}</t></is></c>'


def workbook_bytes(sheets: Mapping[str, Sequence[Sequence[Cell]]]) -> bytes:
    """An xlsx file of sheets: name -> rows of cells."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:
        listed, links = "", ""
        for n, (name, rows) in enumerate(sheets.items(), 1):
            listed += f'<sheet name={quoteattr(name)} sheetId="{n}" r:id="s{n}"/>'
            links += f'<Relationship Id="s{n}" Target="worksheets/s{n}.xml"/>'
            book.writestr(f"xl/worksheets/s{n}.xml", f'<worksheet xmlns="{_MAIN}"><sheetData>' + "".join("<row>" + "".join(map(_cell, r)) + "</row>" for r in rows) + "</sheetData></worksheet>")
        book.writestr("xl/workbook.xml", f'<workbook xmlns="{_MAIN}" xmlns:r="{_LINKS}"><sheets>{listed}</sheets></workbook>')
        book.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{_PACKAGE}">{links}</Relationships>')
    return out.getvalue()


def sheet_rows(df: DataFrame, banner: str, *, max_rows: int = MAX_ROWS - 2) -> list[list[Cell]]:
    """A banner, the column names and all rows of df; more than a sheet holds raise ValueError."""
    rows = df.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        raise ValueError(f"more than {max_rows} rows")
    return [[banner], list(df.columns), *map(list, rows)]


def write_workbook(spark: SparkSession, sheets: Mapping[str, Sequence[Sequence[Cell]]], path: str | None = None) -> str:
    """Write the workbook to path and return it. Without one: to the folder of spark.checkpoint.dir, or a temporary one on a local master."""
    path = path or f"{shared_dir(spark)}/{uuid.uuid4().hex}.xlsx"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at)
    stream.write(bytearray(workbook_bytes(sheets)))
    stream.close()
    return path
