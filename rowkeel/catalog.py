"""An ordered registry of tables."""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping

from pyspark.sql import DataFrame

from .functions.missing import nan_to_null


class TableCatalog:
    """Name -> DataFrame in order of registration; the last one registered under a name wins and keeps its first place."""

    def __init__(self, tables: Mapping[str, DataFrame] | None = None):
        self._tables: dict[str, DataFrame] = {}
        for name, df in (tables or {}).items():
            self.register(name, df)

    def register(self, name: str, df: DataFrame, *, normalise: bool = True, view: bool = False) -> DataFrame:
        """Add a table. normalise: NaN in float columns becomes null, so that there is one notion of missing.

        view: also create a temporary view, named as the table with other characters than letters, digits and _ as _.
        """
        df = nan_to_null(df) if normalise else df
        self._tables[name] = df
        if view:
            df.createOrReplaceTempView(view_name(name))
        return df

    def require(self, name: str) -> DataFrame:
        if name not in self._tables:
            raise KeyError(f"table {name!r} is not in the catalog; it has {', '.join(self._tables) or 'none'}")
        return self._tables[name]

    def find(self, name: str) -> DataFrame | None:
        return self._tables.get(name)

    def require_column(self, table: str, column: str) -> DataFrame:
        df = self.require(table)
        if column not in df.columns:
            raise KeyError(f"table {table!r} has no column {column!r}")
        return df

    def __contains__(self, name: str) -> bool:
        return name in self._tables

    def __iter__(self) -> Iterator[str]:
        return iter(self._tables)

    def __len__(self) -> int:
        return len(self._tables)

    def items(self):
        return self._tables.items()


def view_name(table: str) -> str:
    return re.sub(r"\W", "_", table).lower()


def table_key(system: str, sheet: str) -> str:
    """The name under which a system's table is registered."""
    return f"{system}/{sheet}"


def short_name(table: str) -> str:
    """A table's name without its system."""
    return table.rpartition("/")[2]
