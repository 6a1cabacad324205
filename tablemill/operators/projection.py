"""Renames and column checks."""

from __future__ import annotations

import logging
from collections import Counter
from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablemill.errors import SpecError

log = logging.getLogger(__name__)


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def rename_columns(
    frame: DataFrame, mapping: Mapping[str, str] | None, strict: bool = False
) -> DataFrame:
    """Rename all mapped columns at once, so that names can be swapped.

    Names match without regard to case. A mapped column that is absent is
    skipped with a warning, or an error if ``strict``.
    """
    if not mapping:
        return frame
    wanted = {old.lower(): new for old, new in mapping.items()}
    if len(wanted) < len(mapping):
        raise SpecError("mapping: the same column is renamed twice")
    present = {name.lower() for name in frame.columns}
    absent = [old for old in mapping if old.lower() not in present]
    if absent:
        if strict:
            raise SpecError(f"mapping: no such columns {absent}")
        log.warning("mapping skips absent columns %s", absent)
    # toDF renames by position, which also works when a name occurs twice.
    return frame.toDF(*[wanted.get(name.lower(), name) for name in frame.columns])


def require_unique_columns(frame: DataFrame) -> DataFrame:
    """Fail before a write that Parquet would refuse after the work is done."""
    counts = Counter(name.lower() for name in frame.columns)
    repeated = sorted(name for name, n in counts.items() if n > 1)
    if repeated:
        raise SpecError(
            f"columns {repeated} occur more than once; select or alias them in the SQL"
        )
    return frame
