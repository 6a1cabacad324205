"""How the read of a remote table is dealt out over tasks.

A connector that is asked for a table or a query gives all rows to one task unless
it is told ranges of a key. Ranges of equal width are as lopsided as the key is;
these are of about equal row counts. One aggregate runs at the source: it deals the
rows in the order of the key into equal parts and returns each part's first and last
key. A value that fills whole parts gets a share of its own, divided by the next key
column if there is one. Rows whose key is NULL are a share, too.

The shares cover every value, seen or not, so rows that are written to the source
between planning and reading are not lost; and they are compared at the source only,
so its own order of text decides.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame

from tablemill.errors import SpecError
from tablemill.sources.literals import remote_literal

_COLUMN = re.compile(r"[A-Za-z_]\w*(\.[A-Za-z_]\w*)*")


@dataclass(frozen=True)
class Split:
    """The rows that one task reads: an SQL condition, and how many there were when planned."""

    condition: str
    rows: int


def quantile_query(relation: str, key: str, parts: int, where: str | None = None) -> str:
    """First key, last key and number of rows of equal parts in the key's order; part 0 is NULL."""
    is_null = f"CASE WHEN {key} IS NULL THEN 1 ELSE 0 END"
    rest = f" WHERE {where}" if where else ""
    return (
        "SELECT part, MIN(split_key) AS first_key, MAX(split_key) AS last_key, COUNT(*) AS n_rows "
        f"FROM (SELECT {key} AS split_key, CASE WHEN {key} IS NULL THEN 0 ELSE "
        f"NTILE({parts}) OVER (PARTITION BY {is_null} ORDER BY {key}) END AS part "
        f"FROM {relation}{rest}) AS split_parts GROUP BY part"
    )


def _literal(value: Any) -> str | None:
    """The value as SQL text, or None if not all dialects would read it alike."""
    if isinstance(value, float) and not math.isfinite(value):
        return None
    try:
        return remote_literal("split key", value)
    except SpecError:
        return None


def _ranges(key: str, ranks: Sequence) -> list[tuple[str, int, bool]]:
    """(condition, rows, whether it is one value) for all values of the key, in order.

    ``ranks`` are the parts with rows, in order. Bounds that cannot be written are
    left out, which makes a range longer.
    """
    found: list[tuple[str, int, bool]] = []
    lower, rows, single = None, 0, None

    def up_to(upper: str | None) -> tuple[str, int, bool]:
        return " AND ".join(filter(None, (lower, upper))) or f"{key} IS NOT NULL", rows, False

    for part in ranks:
        first, n = part["first_key"], part["n_rows"]
        text = _literal(first)
        if text is not None and n > 1 and first == part["last_key"]:
            if found and first == single:
                condition, before, _ = found[-1]
                found[-1] = (condition, before + n, True)
            else:
                found += [up_to(f"{key} < {text}"), (f"{key} = {text}", n, True)]
                lower, rows, single = f"{key} > {text}", 0, first
            continue
        # What follows a single value may begin with the rest of it: no bound there.
        if rows and text is not None:
            found.append(up_to(f"{key} < {text}"))
            lower, rows = f"{key} >= {text}", 0
        rows += n
    return [*found, up_to(None)]


def plan_splits(
    ask: Callable[[str], DataFrame],
    relation: str,
    keys: Sequence[str],
    parts: int,
    where: str | None = None,
) -> list[Split]:
    """Conditions that deal the rows of ``relation`` into about ``parts`` equal shares.

    ``ask`` runs a query at the source. A value of the last key column stays in one
    share, however many rows have it.
    """
    key, more = keys[0], keys[1:]
    if not _COLUMN.fullmatch(key):
        raise SpecError(f"split_by: {key!r} is not a plain column name")
    # One row per part comes back, however large the table.
    found = {row["part"]: row for row in ask(quantile_query(relation, key, parts, where)).collect()}
    nulls = found.pop(0)["n_rows"] if 0 in found else 0
    total = nulls + sum(row["n_rows"] for row in found.values())
    if not total:
        return [Split(where or "1 = 1", 0)]

    def narrowed(condition: str) -> str:
        return f"{where} AND ({condition})" if where else f"({condition})"

    ranges = _ranges(key, [found[part] for part in sorted(found)])
    splits: list[Split] = []
    spare: list[tuple[str, int]] = []
    for condition, rows, single in [*ranges, (f"{key} IS NULL", nulls, True)]:
        shares = round(parts * rows / total)
        if not rows or (single and not shares):
            # Hardly any row was there, but the values belong to some share.
            spare.append((narrowed(condition), rows))
        elif single and more and shares > 1:
            splits += plan_splits(ask, relation, more, shares, narrowed(condition))
        else:
            splits.append(Split(narrowed(condition), rows))
    first = splits.pop(0) if splits else Split(*spare.pop(0))
    conditions = [first.condition, *(condition for condition, _ in spare)]
    return [Split(f"({' OR '.join(conditions)})", first.rows + sum(n for _, n in spare)), *splits]
