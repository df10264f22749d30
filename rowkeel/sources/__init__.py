"""Where tables come from."""

from .parquet_dir import load_directory
from .workbook import list_sheets, load_workbooks, read_sheet, sheet_names
from .workbook_sink import write_workbook

__all__ = ["list_sheets", "load_directory", "load_workbooks", "read_sheet", "sheet_names", "write_workbook"]
