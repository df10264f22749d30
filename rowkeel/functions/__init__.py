"""Column functions of the audits."""

from .keys import canonical_key
from .missing import is_missing, is_present, nan_to_null
from .scalars import one_decimal, percent, qualified_name, status

__all__ = ["canonical_key", "is_missing", "is_present", "nan_to_null", "one_decimal", "percent", "qualified_name", "status"]
