"""Joins that stay balanced when one key holds much of the data.

Adaptive execution splits a hot partition on either side of an inner join, but
only if the join reads both sides straight from a shuffle. A side grouped by the
join key does not: its aggregate sits between the shuffle and the join.
:func:`grouped_for_join` makes Spark shuffle such a side (one small row per key)
once more and so keeps the join splittable.

The right side of a left outer join cannot be split at all, because every part
would have to know whether another part matched. :func:`left_join` is therefore
written as an inner join plus an anti join against the distinct keys.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablemill.errors import SpecError


def whole_key(keys: Sequence[str]) -> Column:
    """No part of the key is NULL."""
    return reduce(lambda a, b: a & b, [F.col(key).isNotNull() for key in keys])


def grouped_for_join(frame: DataFrame, keys: Sequence[str], *aggregates: Column) -> DataFrame:
    """One row per key, ready to meet raw rows in a join on that key.

    The hash of the key adds no group; it only makes the grouping's partitioning
    differ from the join's.
    """
    keys = list(keys)
    spread = frame.groupBy(*keys, F.xxhash64(*keys).alias("__spread"))
    counted = spread.agg(*aggregates) if aggregates else spread.agg(F.count(F.lit(1)))
    return counted.drop("__spread") if aggregates else counted.select(*keys)


def inner_join(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner equi-join; each key column comes out once."""
    return left.join(right, list(keys), "inner")


def left_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    right_only_if: Column | None = None,
) -> DataFrame:
    """Left outer equi-join for a large, possibly skewed right side.

    ``right_only_if`` is the part of the ON condition that concerns the right
    side; left rows without a right row that passes it are kept.

    The right side is read twice, the second time only its keys and what its
    filter needs.
    """
    keys = list(keys)
    folded = {key.lower() for key in keys}
    for side in (left, right):
        lacking = [key for key in keys if key not in side.columns]
        if lacking:
            raise SpecError(f"left_join: no key columns {lacking} in {side.columns}")
    shared = {c.lower() for c in left.columns} & {c.lower() for c in right.columns} - folded
    if shared:
        raise SpecError(f"left_join: both sides have the columns {sorted(shared)}; rename one")
    if right_only_if is not None:
        right = right.filter(right_only_if)
    matched = left.join(right, keys, "inner")
    # One row per key and task leaves the scan, however hot the key is.
    present = grouped_for_join(right.filter(whole_key(keys)), keys)
    unmatched = left.join(present, keys, "left_anti")
    extra = [field for field in right.schema.fields if field.name not in keys]
    return matched.unionByName(
        unmatched.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in extra])
    )


def copies_per_key(frame: DataFrame, keys: Sequence[str], name: str = "copies") -> DataFrame:
    """How often each key occurs."""
    return frame.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def existence_join(
    rows: DataFrame, lookup: DataFrame, keys: Sequence[str], unique: bool = False
) -> DataFrame:
    """Inner join to a table that adds no column.

    With ``unique`` the lookup's keys are known to be distinct and a semi join
    is enough. Otherwise each row carries ``copies``, the number of times an
    inner join would repeat it, so nothing is multiplied out.
    """
    keys = list(keys)
    if unique:
        return rows.join(lookup.select(*keys), keys, "left_semi").withColumn(
            "copies", F.lit(1).cast("bigint")
        )
    copies = grouped_for_join(lookup, keys, F.count(F.lit(1)).alias("copies"))
    return rows.join(copies, keys, "inner")
