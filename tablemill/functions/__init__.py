"""Column expressions the jobs are made of. All run inside the JVM."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


def band(
    value: Column, cuts: Sequence[tuple[Any, str]], otherwise: str, side: str = "upper"
) -> Column:
    """Label ``value`` by cut-offs; the first cut that matches wins.

    ``side="upper"`` reads a cut as "at most", ``side="lower"`` as "more than".
    NULL matches no cut and gets ``otherwise``.
    """
    if side not in ("upper", "lower"):
        raise ValueError(f"unknown side {side!r}")
    if not cuts:
        raise ValueError("a band needs at least one cut")
    label = F
    for cut, name in cuts:
        label = label.when(value <= F.lit(cut) if side == "upper" else value > F.lit(cut), name)
    return label.otherwise(otherwise)


def month_start(moment: Column) -> Column:
    """First instant of the month, as a timestamp in the session's time zone."""
    return F.date_trunc("month", moment)


def guarded_ratio(numerator: Column, denominator: Column, digits: int = 2) -> Column:
    """``numerator / denominator`` rounded half up; NULL where the denominator is 0.

    Whole numbers are divided as decimals, so ties round exactly.
    """
    exact = numerator * F.lit(1.0).cast("decimal(2,1)")
    return F.round(exact / F.nullif(denominator, F.lit(0)), digits)


def since(moment: Column, first: Any) -> Column:
    """On or after ``first``; NULL moments fail."""
    return moment >= F.lit(first)


def matches_if_set(value: Column, wanted: Any) -> Column:
    """Equality that is switched off while ``wanted`` is unset (None or '')."""
    if wanted is None or wanted == "":
        return F.lit(True)
    return value == F.lit(wanted)
