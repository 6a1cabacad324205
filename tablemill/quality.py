"""Data-quality rules, compiled to as few passes over the data as they allow.

All rules about single rows share one aggregate. Uniqueness and orphan rules
group by the key first, so a key that repeats endlessly leaves each task as one
row. Nothing is collected: the report is a lazy DataFrame.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablemill.errors import SpecError
from tablemill.operators.joins import copies_per_key, grouped_for_join, whole_key

ROW_RULES = ("not_null", "in_range", "allowed_values")
KINDS = (*ROW_RULES, "unique_key", "orphan_key", "min_rows")


@dataclass(frozen=True)
class Rule:
    """One rule; make it with the functions below or from a job's ``quality`` list."""

    kind: str
    columns: tuple[str, ...] = ()
    options: Mapping[str, Any] = field(default_factory=dict)

    @classmethod
    def from_dict(cls, raw: Mapping[str, Any]) -> Rule:
        options = dict(raw)
        kind = options.pop("rule", None)
        columns = options.pop("columns", options.pop("column", ()))
        columns = (columns,) if isinstance(columns, str) else tuple(columns)
        return cls(kind, columns, options).validated()

    def validated(self) -> Rule:
        allowed = {
            "not_null": set(),
            "in_range": {"low", "high"},
            "allowed_values": {"values"},
            "unique_key": set(),
            "orphan_key": {"parent", "parent_columns"},
            "min_rows": {"floor"},
        }
        if self.kind not in allowed:
            raise SpecError(f"quality: unknown rule {self.kind!r}")
        unknown = set(self.options) - allowed[self.kind]
        if unknown:
            raise SpecError(f"quality: {self.kind} does not take {sorted(unknown)}")
        if self.kind != "min_rows" and not self.columns:
            raise SpecError(f"quality: {self.kind} needs a column")
        if self.kind in ROW_RULES and len(self.columns) != 1:
            raise SpecError(f"quality: {self.kind} takes one column")
        if self.kind == "in_range" and not (
            {"low", "high"} & {k for k, v in self.options.items() if v is not None}
        ):
            raise SpecError("quality: in_range needs low or high")
        if self.kind == "allowed_values" and not self.options.get("values"):
            raise SpecError("quality: allowed_values needs values")
        if self.kind == "orphan_key":
            if not self.options.get("parent"):
                raise SpecError("quality: orphan_key needs a parent")
            if len(self.options.get("parent_columns", self.columns)) != len(self.columns):
                raise SpecError("quality: orphan_key needs as many parent columns as columns")
        if self.kind == "min_rows" and not isinstance(self.options.get("floor"), int):
            raise SpecError("quality: min_rows needs a whole number floor")
        return self

    @property
    def label(self) -> str:
        return ",".join(self.columns)


def not_null(column: str) -> Rule:
    return Rule("not_null", (column,)).validated()


def in_range(column: str, low: Any = None, high: Any = None) -> Rule:
    """Bounds are inclusive; NULL passes (add ``not_null`` to forbid it)."""
    return Rule("in_range", (column,), {"low": low, "high": high}).validated()


def allowed_values(column: str, values: Iterable[Any]) -> Rule:
    """NULL passes."""
    return Rule("allowed_values", (column,), {"values": list(values)}).validated()


def unique_key(*columns: str) -> Rule:
    """Every row that shares its key fails; keys with a NULL part are not compared."""
    return Rule("unique_key", columns).validated()


def orphan_key(
    columns: str | tuple[str, ...], parent: str, parent_columns: tuple[str, ...] | None = None
) -> Rule:
    """Rows whose key the parent frame lacks fail; keys with a NULL part pass."""
    columns = (columns,) if isinstance(columns, str) else tuple(columns)
    options: dict[str, Any] = {"parent": parent}
    if parent_columns:
        options["parent_columns"] = tuple(parent_columns)
    return Rule("orphan_key", columns, options).validated()


def min_rows(floor: int) -> Rule:
    """Fails by as many rows as are missing."""
    return Rule("min_rows", (), {"floor": floor}).validated()


def _violates(rule: Rule) -> Column:
    column = F.col(rule.columns[0])
    if rule.kind == "not_null":
        return column.isNull()
    if rule.kind == "allowed_values":
        # NULL passes; in the list it would make the comparison unknown for all others.
        values = [value for value in rule.options["values"] if value is not None]
        return ~column.isin(values) if values else column.isNotNull()
    bounds = []
    if rule.options.get("low") is not None:
        bounds.append(column < F.lit(rule.options["low"]))
    if rule.options.get("high") is not None:
        bounds.append(column > F.lit(rule.options["high"]))
    return reduce(lambda a, b: a | b, bounds)


def _line(rule: Rule, n_rows: Column, n_failed: Column) -> Column:
    failed = F.coalesce(n_failed, F.lit(0)).cast("bigint")
    return F.struct(
        F.lit(rule.kind).alias("rule"),
        F.lit(rule.label).alias("column"),
        F.coalesce(n_rows, F.lit(0)).cast("bigint").alias("n_rows"),
        failed.alias("n_failed"),
        (failed == 0).alias("passed"),
    )


def _row_rules(frame: DataFrame, rules: list[Rule]) -> DataFrame:
    counters = [F.count(F.lit(1)).alias("n")]
    lines = []
    for position, rule in enumerate(rules):
        if rule.kind == "min_rows":
            missing = F.greatest(F.lit(rule.options["floor"]) - F.col("n"), F.lit(0))
            lines.append(_line(rule, F.col("n"), missing))
        else:
            counters.append(F.count_if(_violates(rule)).alias(f"failed_{position}"))
            lines.append(_line(rule, F.col("n"), F.col(f"failed_{position}")))
    return frame.agg(*counters).select(F.inline(F.array(*lines)))


def _sets_within(keys: Iterable[tuple[str, ...]]) -> list[tuple[str, ...]]:
    """The keys that lie in no other key, widest first."""
    widest: list[tuple[str, ...]] = []
    for key in sorted(dict.fromkeys(keys), key=len, reverse=True):
        if not any(set(key) <= set(other) for other in widest):
            widest.append(key)
    return widest


def _nested_uniques(frame: DataFrame, rules: list[Rule], widest: tuple[str, ...]) -> list[DataFrame]:
    """Keys inside one key are counted from its counts, whose shuffle Spark reuses."""
    reports = []
    for rule in rules:
        counts = copies_per_key(frame, widest, "__n")
        if widest != rule.columns:
            counts = counts.groupBy(*rule.columns).agg(F.sum("__n").alias("__n"))
        repeated = F.when(whole_key(rule.columns) & (F.col("__n") > 1), F.col("__n"))
        totals = counts.agg(F.sum("__n").alias("n"), F.sum(repeated).alias("failed"))
        reports.append(totals.select(F.inline(F.array(_line(rule, F.col("n"), F.col("failed"))))))
    return reports


def _disjoint_uniques(frame: DataFrame, rules: list[Rule]) -> DataFrame:
    """All keys from one scan and one shuffle: the key sets are grouping sets.

    Each row is counted under every key within its task, so a key that repeats
    leaves the task as one row, whichever key it is of.
    """
    sets = list(dict.fromkeys(rule.columns for rule in rules))
    columns = list(dict.fromkeys(column for key in sets for column in key))
    # A bit for each column that a set lacks, the first column's the highest.
    marks = {
        key: sum(1 << (len(columns) - 1 - i) for i, c in enumerate(columns) if c not in key)
        for key in sets
    }
    counts = frame.groupingSets([[F.col(c) for c in key] for key in sets], *columns).agg(
        F.grouping_id().alias("__set"), F.count(F.lit(1)).alias("__n")
    )
    totals, lines = [], []
    for position, rule in enumerate(rules):
        own = F.col("__set") == marks[rule.columns]
        repeated = own & whole_key(rule.columns) & (F.col("__n") > 1)
        totals.append(F.sum(F.when(own, F.col("__n"))).alias(f"n_{position}"))
        totals.append(F.sum(F.when(repeated, F.col("__n"))).alias(f"failed_{position}"))
        lines.append(_line(rule, F.col(f"n_{position}"), F.col(f"failed_{position}")))
    return counts.agg(*totals).select(F.inline(F.array(*lines)))


def _uniques(frame: DataFrame, rules: list[Rule]) -> list[DataFrame]:
    widest = _sets_within(rule.columns for rule in rules)
    if len(widest) == 1:
        return _nested_uniques(frame, rules, widest[0])
    return [_disjoint_uniques(frame, rules)]


def _known_keys(rule: Rule, parents: Mapping[str, DataFrame]) -> DataFrame:
    """The distinct keys of a rule's parent, under the rule's own names."""
    name = rule.options["parent"]
    if name not in parents:
        raise SpecError(f"quality: no frame named {name!r} to look up {rule.label}")
    parent_columns = rule.options.get("parent_columns", rule.columns)
    keys = list(rule.columns)
    known = parents[name].select(*[F.col(p).alias(k) for p, k in zip(parent_columns, keys)])
    return known.filter(whole_key(keys)).distinct()


def _orphans(frame: DataFrame, rule: Rule, parents: Mapping[str, DataFrame]) -> DataFrame:
    keys = list(rule.columns)
    known = _known_keys(rule, parents).withColumn("__known", F.lit(True))
    # A left join on counted keys gives totals and orphans from one scan.
    counted = copies_per_key(frame, keys, "__n").join(known, keys, "left")
    orphan = F.when(whole_key(keys) & F.col("__known").isNull(), F.col("__n"))
    totals = counted.agg(F.sum("__n").alias("n"), F.sum(orphan).alias("failed"))
    return totals.select(F.inline(F.array(_line(rule, F.col("n"), F.col("failed")))))


def check(
    frame: DataFrame,
    rules: Iterable[Rule | Mapping[str, Any]],
    parents: Mapping[str, DataFrame] | None = None,
) -> DataFrame:
    """One row per rule: rule, column, n_rows, n_failed, passed."""
    rules = [r.validated() if isinstance(r, Rule) else Rule.from_dict(r) for r in rules]
    if not rules:
        raise SpecError("quality: no rules given")
    single = [r for r in rules if r.kind in ROW_RULES or r.kind == "min_rows"]
    reports = [_row_rules(frame, single)] if single else []
    unique = [r for r in rules if r.kind == "unique_key"]
    reports += _uniques(frame, unique) if unique else []
    reports += [_orphans(frame, r, parents or {}) for r in rules if r.kind == "orphan_key"]
    return reduce(DataFrame.unionByName, reports)


FAILED_RULES = "failed_rules"


def _bad_keys(frame: DataFrame, rule: Rule, parents: Mapping[str, DataFrame]) -> DataFrame:
    """The distinct keys whose rows break a rule, ready to meet raw rows in a join."""
    keys = list(rule.columns)
    if rule.kind == "unique_key":
        counts = grouped_for_join(frame, keys, F.count(F.lit(1)).alias("__n"))
        return counts.filter(whole_key(keys) & (F.col("__n") > 1)).select(*keys)
    lost = frame.filter(whole_key(keys)).select(*keys).distinct()
    lost = lost.join(_known_keys(rule, parents), keys, "left_anti")
    return grouped_for_join(lost, keys)


def failing_rows(
    frame: DataFrame,
    rules: Iterable[Rule | Mapping[str, Any]],
    parents: Mapping[str, DataFrame] | None = None,
) -> DataFrame:
    """The rows that break a rule, with the array ``failed_rules`` of the rules they break.

    A rule is named as ``unique_key(a,b)``; ``min_rows`` is no matter of single rows.
    Keys are looked up among the few that fail, so a key that very many rows share
    is split like any other hot key of a join; nothing is collected.
    """
    rules = [r.validated() if isinstance(r, Rule) else Rule.from_dict(r) for r in rules]
    if FAILED_RULES in frame.columns:
        raise SpecError(f"quality: the frame has a column {FAILED_RULES} already")
    columns, marked, marks = frame.columns, frame, []
    for position, rule in enumerate(rules):
        if rule.kind == "min_rows":
            continue
        if rule.kind in ROW_RULES:
            broken = _violates(rule)
        else:
            mark = f"__bad_{position}"
            bad = _bad_keys(frame, rule, parents or {}).withColumn(mark, F.lit(True))
            marked = marked.join(bad, list(rule.columns), "left")
            broken = F.col(mark).isNotNull()
        marks.append(F.when(broken, F.lit(f"{rule.kind}({rule.label})")))
    if not marks:
        raise SpecError("quality: no rules about rows given")
    failed = F.array_compact(F.array(*marks)).alias(FAILED_RULES)
    return marked.select(*columns, failed).filter(F.size(FAILED_RULES) > 0)
