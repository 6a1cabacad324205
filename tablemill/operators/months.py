"""Exact counts of distinct months, as bits instead of rows.

``COUNT(DISTINCT month)`` sends every (key, month) pair through a shuffle and
then every key through another. Here each month of a window is a bit in a few
64-bit words of the key's own row: words are combined by OR within tasks and after
the one shuffle, and their bits counted. Months outside the window are rare, so
those rows are counted by a plain COUNT DISTINCT of their own; the filter on them
reaches the scan, which skips files and row groups without such dates, and adaptive
execution drops the branch when it turns out empty. Both together are exact for all
dates there are; NULL is no month.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 64


@dataclass(frozen=True)
class MonthWindow:
    """The months that get a bit: ``words`` times 64 of them from January of ``first_year``."""

    first_year: int = 1990
    words: int = 8

    def __post_init__(self) -> None:
        if self.words < 1 or not 1 <= self.first_year <= self.end.year <= 9999:
            raise ValueError(f"{self} holds no months or leaves the calendar")

    @property
    def start(self) -> dt.date:
        return dt.date(self.first_year, 1, 1)

    @property
    def end(self) -> dt.date:
        """The first day after the window."""
        years, months = divmod(self.words * BITS, 12)
        return dt.date(self.first_year + years, months + 1, 1)

    def number(self, moment: Column) -> Column:
        """The month's place in the window; negative before it."""
        return (F.year(moment) - self.first_year) * 12 + F.month(moment) - 1

    def outside(self, moment: Column) -> Column:
        return (moment < F.lit(self.start)) | (moment >= F.lit(self.end))

    def count(self, moment: Column) -> Column:
        """Distinct months of the window, as an aggregate."""
        number = self.number(moment)
        bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), number)
        none = F.lit(0).cast("bigint")
        # A shift to the right rounds down, so months before the window are in no word.
        words = [
            F.bit_count(F.bit_or(F.when(F.shiftright(number, 6) == k, bit).otherwise(none)))
            for k in range(self.words)
        ]
        return reduce(lambda a, b: a + b, words).cast("bigint")


def totals_with_months(
    facts: DataFrame,
    keys: Sequence[str],
    near: Sequence[Column],
    months: Mapping[str, Column],
    window: MonthWindow,
    whole: bool = False,
) -> DataFrame:
    """One row per key with the aggregates ``near``, to which months outside the window are added.

    ``whole`` says that no key has a NULL part. Otherwise the parts travel as one struct,
    which is never NULL itself: equal structs may hold NULLs, and joining on one asks for
    no other partitioning than grouping by it.
    """
    own = [F.col(key) for key in keys] if whole else [F.struct(*keys).alias("__key")]
    outside = {name: window.outside(moment) for name, moment in months.items()}
    far_keys = [f"__far_{i}" for i in range(len(own))]
    totals = facts.groupBy(*own).agg(*near)
    far = (
        facts.filter(reduce(lambda a, b: a | b, outside.values()))
        .groupBy(*[column.alias(key) for column, key in zip(own, far_keys)])
        .agg(
            *[
                F.count_distinct(F.when(outside[name], window.number(moment))).alias(f"__n_{name}")
                for name, moment in months.items()
            ]
        )
    )
    mine = keys if whole else ["__key"]
    same = [F.col(key) == F.col(far_key) for key, far_key in zip(mine, far_keys)]
    joined = totals.join(far, reduce(lambda a, b: a & b, same), "left")
    named = totals.columns[len(mine) :]
    return joined.select(
        *([F.col(key) for key in keys] if whole else [F.col(f"__key.{key}") for key in keys]),
        *[
            (F.col(c) + F.coalesce(F.col(f"__n_{c}"), F.lit(0))).alias(c) if c in months else F.col(c)
            for c in named
        ],
    )
