"""Mixing sources to target weights by a hierarchical token budget.

Nodes form a tree: domain, then language, then source. A parent's budget is
shared among its children by weight; a child that holds fewer tokens than its
share (times ``max_epochs``) gives the rest to its siblings, and only what all
siblings together cannot use goes back to the level above. Both fall out of
filling from the top with each node's capacity, which windows over the node
tables compute in closed form: children are ordered by capacity per weight, and
those that fill up first are the ones below the water level. Ratios are compared
exactly and products have 38 digits, so budgets are right up to 2^63 tokens
(times ``max_epochs``).

A leaf with budget B over S tokens takes every document B // S times (epochs)
and, for the rest, the longest prefix that fits of its documents in the order
of md5(seed:epoch:id). Prefix sums go over 4096 ranges of that order first and
over the documents of one range after, so a source of any size is never sorted
in one task.

Rows: null and empty texts have no tokens and are taken where the prefix passes
them; null parts of the tree are nodes of their own; repeated rows stand next to
each other in the order and are taken or left together. Weights are whole numbers up to 10^9,
1 where none is given; 0 leaves a node out. Empty tables give empty ones; very long
texts are documents like others; other columns may have any names.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, written

RANGE_DIGITS = 3
LEVELS = ("domain", "language", "source")
MOST_WEIGHT = 10**9
# Fractions of whole numbers up to MOST_WEIGHT that differ, differ by one part of this or more.
PARTS = MOST_WEIGHT**2


def n_tokens(text: Column) -> Column:
    return F.coalesce(F.size(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))), F.lit(0)).cast(
        "long"
    )


def _weight(path: Sequence[str], weights: Mapping[tuple, int]) -> Column:
    """Weight of the node the columns ``path`` name."""
    found = F.lit(1)
    for nodes, weight in weights.items():
        if len(nodes) == len(path):
            here = reduce(
                lambda a, b: a & b,
                [F.col(c).eqNullSafe(F.lit(v)) for c, v in zip(path, nodes, strict=True)],
            )
            found = F.when(here, weight).otherwise(found)
    return found.cast("long")


def _wide(number: str) -> str:
    return f"cast({number} as decimal(38, 0))"


def _fill(nodes: DataFrame, parent: list[str], name: str) -> DataFrame:
    """Share column ``budget`` of each parent among its children by ``weight`` up to ``room``."""
    ordered = Window.partitionBy(*parent).orderBy(
        F.expr("room div weight"),
        F.expr(f"{_wide('room % weight')} * {PARTS} div weight"),
        F.col(name).asc_nulls_first(),
    )
    whole = Window.partitionBy(*parent)
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    after = ordered.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    room, before_room, budget = map(_wide, ("room", "before_room", "budget"))
    full = f"{room} * after_weight + {before_room} * weight <= {budget} * weight"
    portion = f"{_wide('budget - spent')} * weight div greatest(open, 1)"
    return (
        nodes.where("weight > 0")
        .withColumn("before_room", F.coalesce(F.sum("room").over(before), F.lit(0)))
        .withColumn("after_weight", F.sum("weight").over(after))
        .withColumn("full", F.expr(full))
        .withColumn("spent", F.coalesce(F.sum(F.expr("if(full, room, 0)")).over(whole), F.lit(0)))
        .withColumn("open", F.sum(F.expr("if(full, 0, weight)")).over(whole))
        .withColumn("budget", F.expr(f"if(full, room, {portion})"))
        .drop("before_room", "after_weight", "full", "spent", "open", "weight")
    )


def budgets(
    leaves: DataFrame, weights: Mapping[tuple, int], share: float, max_epochs: int
) -> DataFrame:
    """(domain, language, source, tokens, budget) from the token sums of the leaves."""
    if not all(isinstance(w, int) and 0 <= w <= MOST_WEIGHT for w in weights.values()):
        raise ValueError(f"weights must be whole numbers from 0 to {MOST_WEIGHT}")
    levels = list(LEVELS)
    room = F.col("tokens") * max_epochs
    whole = F.coalesce("all", F.lit(0)).cast("decimal(20, 0)")
    top = leaves.agg(F.sum("tokens").alias("all")).select(
        F.floor(whole * F.lit(Decimal(str(share)))).cast("long").alias("budget")
    )
    above, keys = top, []
    for depth, name in enumerate(levels):
        path = levels[: depth + 1]
        nodes = leaves.groupBy(*path).agg(F.sum(room).alias("room"), F.sum("tokens").alias("tokens"))
        nodes = nodes.withColumn("weight", _weight(path, weights))
        if keys:
            same = [nodes[k].eqNullSafe(above[k]) for k in keys]
            nodes = nodes.join(above, reduce(lambda a, b: a & b, same)).select(
                *(nodes[k] for k in path), "room", "tokens", "weight", "budget"
            )
        else:
            # One row: the budget of the whole tree.
            nodes = nodes.join(F.broadcast(above))
        above = _fill(nodes, keys, name).drop("room")
        if depth < len(levels) - 1:
            above = above.drop("tokens")
        keys = path
    return above


def _order(seed: int, doc_id: Column, epoch: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), doc_id.cast("string")))


def mix(
    docs: DataFrame,
    domain: Column,
    language: Column,
    source: Column,
    weights: Mapping[tuple, int] | None = None,
    share: float = 1.0,
    max_epochs: int = 2,
    seed: int = 20,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """The chosen documents, one row per epoch, with domain, n_tokens and epoch at the end.

    ``share`` is the budget as a share of all tokens of ``docs``.
    """
    names = docs.columns
    boxed = docs.select(
        *(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)),
        domain.cast("string").alias("domain"),
        language.cast("string").alias("language"),
        source.cast("string").alias("source"),
    )
    own, body = (F.col(f"c{names.index(c)}") for c in (doc_id, text))
    leaf = list(LEVELS)

    def same(a: DataFrame, b: DataFrame) -> Column:
        return reduce(lambda x, y: x & y, [a[k].eqNullSafe(b[k]) for k in leaf])

    sized = written(boxed.select(own.alias("id"), *leaf, n_tokens(body).alias("n")), "mix-sizes")
    sums = sized.groupBy(*leaf).agg(F.sum("n").alias("tokens"))
    plan = written(
        budgets(sums, weights or {}, share, max_epochs)
        .withColumn("epochs", F.expr("budget div greatest(tokens, 1)"))
        .withColumn("rest", F.expr("budget - epochs * tokens")),
        "mix-budgets",
    )
    placed = sized.join(plan, same(sized, plan)).select(
        *(plan[k] for k in leaf),
        "n",
        "rest",
        "id",
        _order(seed, F.col("id"), F.col("epochs")).alias("place"),
    )
    placed = placed.withColumn("part", F.substring("place", 1, RANGE_DIGITS))
    by_range = Window.partitionBy(*leaf).orderBy("part")
    ranges = (
        placed.groupBy(*leaf, "part", "rest")
        .agg(F.sum("n").alias("n"))
        .withColumn("upto", F.sum("n").over(by_range))
        .where("upto > rest")
        .groupBy(*leaf)
        .agg(
            F.min("part").alias("last"),
            F.min_by(F.expr("rest - (upto - n)"), "part").alias("left"),
        )
    )
    ranges = written(ranges, "mix-ranges")
    by_place = (
        Window.partitionBy(*leaf)
        .orderBy(F.struct("place", "id"))
        .rangeBetween(Window.unboundedPreceding, Window.currentRow)
    )
    ends = (
        placed.join(
            ranges.withColumnsRenamed({k: f"r_{k}" for k in leaf}),
            reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"r_{k}")) for k in leaf])
            & (F.col("part") == F.col("last")),
        )
        .withColumn("upto", F.sum("n").over(by_place))
        .where("upto <= left")
        .groupBy(*leaf)
        .agg(F.max(F.struct("place", "id")).alias("end"))
    )
    cuts = plan.join(ranges, same(plan, ranges), "left").select(
        *(plan[k] for k in leaf), "epochs", "last"
    )
    cuts = cuts.join(ends, same(cuts, ends), "left").select(
        *(cuts[k].alias(f"p_{k}") for k in leaf), "epochs", "last", "end"
    )
    cuts = written(cuts, "mix-cuts")
    at = F.struct(_order(seed, own, F.col("epochs")).alias("place"), own.alias("id"))
    within = (
        F.col("last").isNull()
        | (F.substring(at["place"], 1, RANGE_DIGITS) < F.col("last"))
        | F.coalesce(at <= F.col("end"), F.lit(False))
    )
    chosen = boxed.join(
        cuts, reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"p_{k}")) for k in leaf])
    ).withColumn(
        # Documents without tokens fit into any rest, but repeat no more often than others.
        "copies", F.least(F.col("epochs") + F.when(within, 1).otherwise(0), F.lit(max_epochs))
    )
    return (
        chosen.where("copies > 0")
        .withColumn("n", n_tokens(body))
        .select(
            *(f"c{i}" for i in range(len(names))),
            "domain",
            "n",
            F.explode(F.expr("sequence(0L, copies - 1L)")).alias("epoch"),
        )
        .toDF(*names, "domain", "n_tokens", "epoch")
    )
