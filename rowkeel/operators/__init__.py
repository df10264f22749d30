"""The audits: pure functions of a catalog and rules to one lazy DataFrame; and extensions beside them."""

from .cardinality import cardinality_profile, group_sizes
from .cascade import cascade, cascade_counts
from .difference import table_difference
from .foreign_keys import distinct_keys, fk_check, fk_check_joins, fk_check_long, orphan_keys, orphan_rows, skipped_rules
from .inventory import table_inventory
from .levels import level_profile
from .nested import json_schema, nested_null_profile
from .nulls import annotate_nulls, null_profile
from .prefix import running_totals
from .sessions import sessions
from .sketches import distinct_error, merge_sketches, rank_error, read_sketches, sketch
from .timeline import interval_join, latest_before

__all__ = [
    "annotate_nulls",
    "cardinality_profile",
    "cascade",
    "cascade_counts",
    "distinct_error",
    "distinct_keys",
    "fk_check",
    "fk_check_joins",
    "fk_check_long",
    "group_sizes",
    "interval_join",
    "json_schema",
    "latest_before",
    "level_profile",
    "merge_sketches",
    "nested_null_profile",
    "null_profile",
    "orphan_keys",
    "orphan_rows",
    "rank_error",
    "read_sketches",
    "running_totals",
    "sessions",
    "sketch",
    "skipped_rules",
    "table_difference",
    "table_inventory",
]
