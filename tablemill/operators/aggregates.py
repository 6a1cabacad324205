"""Grouped aggregates over a join, computed before the join.

``GROUP BY`` over "dimension joined to facts" needs only one row per key from
the facts. Aggregating first means the raw facts are never shuffled: each task
sends at most one row per key, so a key that holds a third of the table costs no
more than any other. Duplicate dimension rows are counted, not multiplied out,
and the result equals that of joining first.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablemill.operators.joins import copies_per_key, grouped_for_join
from tablemill.operators.months import MonthWindow, totals_with_months


Named = dict[str, Column]

WIDEST = 38


def times(copies: Column, amount: Column, kind: T.DataType) -> Column:
    """``copies * amount`` in the type of ``amount``, digit for digit.

    Spark gives up digits after the point when a product of decimals could need
    more than 38. Whole part and fraction are multiplied apart, where there is
    room; a result too large for the type is an error, never rounded.
    """
    if not isinstance(kind, T.DecimalType):
        return copies * amount
    room = T.DecimalType(WIDEST - 1, kind.scale)
    whole = F.when(amount >= 0, F.floor(amount)).otherwise(F.ceil(amount))
    fraction = amount % F.lit(1).cast("decimal(1,0)")
    few = copies.cast(T.DecimalType(WIDEST - 2 - max(kind.scale, 18), 0))
    return ((whole * copies).cast(room) + (fraction * few).cast(room)).cast(kind)


def _aggregates(
    counts: Named | None,
    sums: Named | None,
    averages: Named | None,
    distincts: Named | None,
    months: Named | None,
    window: MonthWindow,
) -> list[Column]:
    return [
        function(column).alias(name)
        for function, group in (
            (F.count, counts),
            (F.sum, sums),
            (F.avg, averages),
            (F.count_distinct, distincts),
            (window.count, months),
        )
        for name, column in (group or {}).items()
    ]


def totals_by_key(
    facts: DataFrame,
    keys: Sequence[str],
    counts: Named | None = None,
    sums: Named | None = None,
    averages: Named | None = None,
    distincts: Named | None = None,
    months: Named | None = None,
    window: MonthWindow = MonthWindow(),
) -> DataFrame:
    """COUNT, SUM, AVG and exact COUNT DISTINCT per key; NULLs are not counted.

    ``months`` are dates or timestamps whose distinct months are counted, without a
    row per key and month in the shuffle; ``distincts`` are any other expressions.
    """
    wanted = _aggregates(counts, sums, averages, distincts, months, window)
    if months:
        return totals_with_months(facts, keys, wanted, months, window)
    return facts.groupBy(*keys).agg(*wanted)


def totals_over_join(
    dimension: DataFrame,
    facts: DataFrame,
    join_key: str,
    group_by: Sequence[str],
    counts: Named | None = None,
    sums: Named | None = None,
    averages: Named | None = None,
    distincts: Named | None = None,
    keep_unmatched: bool = True,
    months: Named | None = None,
    window: MonthWindow = MonthWindow(),
) -> DataFrame:
    """Aggregate facts per dimension group over a left (or inner) join.

    ``group_by`` are dimension columns and must include the join key. Groups
    without facts count 0 and have NULL sums and averages; they are dropped when
    ``keep_unmatched`` is off.
    """
    group_by = list(group_by)
    if join_key not in group_by:
        raise ValueError("group_by must include the join key")
    facts = facts.filter(F.col(join_key).isNotNull())
    if group_by == [join_key]:
        wanted = _aggregates(counts, sums, averages, distincts, months, window)
        if months:
            per_key = totals_with_months(facts, [join_key], wanted, months, window, whole=True)
        else:
            per_key = facts.groupBy(join_key).agg(*wanted)
    else:
        # A join key may come with many groups, so the join must stay splittable, which a
        # second join for months outside the window would prevent.
        plain = {**(distincts or {}), **{n: window.number(m) for n, m in (months or {}).items()}}
        wanted = _aggregates(counts, sums, averages, plain, None, window)
        per_key = grouped_for_join(facts, [join_key], *wanted)
    groups = copies_per_key(dimension, group_by, "__copies")
    joined = groups.join(per_key, join_key, "left" if keep_unmatched else "inner")
    copies = F.col("__copies")
    return joined.select(
        *group_by,
        *[(copies * F.coalesce(F.col(n), F.lit(0))).alias(n) for n in counts or {}],
        *[times(copies, F.col(n), per_key.schema[n].dataType).alias(n) for n in sums or {}],
        # Repeating every fact equally changes neither a mean nor a set.
        *[F.col(n) for n in averages or {}],
        *[F.coalesce(F.col(n), F.lit(0)).alias(n) for n in (*(distincts or {}), *(months or {}))],
    )
