"""Rule-driven data audits on Spark: missing values, foreign keys and cardinalities across many tables."""

from .catalog import TableCatalog
from .rules import CardinalityRule, FkRule, NullMeaning

__all__ = ["CardinalityRule", "FkRule", "NullMeaning", "TableCatalog"]
