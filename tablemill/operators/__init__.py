"""DataFrame operators."""

from tablemill.operators.aggregates import totals_by_key, totals_over_join
from tablemill.operators.joins import (
    copies_per_key,
    existence_join,
    grouped_for_join,
    inner_join,
    left_join,
)
from tablemill.operators.months import MonthWindow
from tablemill.operators.projection import rename_columns, require_unique_columns

__all__ = [
    "MonthWindow",
    "copies_per_key",
    "existence_join",
    "grouped_for_join",
    "inner_join",
    "left_join",
    "rename_columns",
    "require_unique_columns",
    "totals_by_key",
    "totals_over_join",
]
