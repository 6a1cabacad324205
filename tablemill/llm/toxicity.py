"""Toxicity by class-conditional Kneser-Ney models of word beginnings and words.

A word is read as a chain of expressions: its first 4 bytes, its first 6, the
whole word (lower-case A-Z, ASCII punctuation at both ends removed). Each link
has a Kneser-Ney estimate per class, P(e | h) = max(c(e) - D, 0) / c(h) +
D * types(h) / c(h) * S(e | h). The backoff S is shared by the classes: it
comes from their pooled counts, so expressions too rare to tell the classes
apart weigh nothing. The log-likelihoods of the two classes are compared word
by word; the parts by which the toxic one is ahead are averaged over the
length of the text (two margins) and a logistic curve fitted on labelled rows
that the counts behind it have not seen turns them into a score.

Counts, ratios and what a word is worth are made in Spark and stay in a table
with one row per expression, which grows with the vocabulary. Expressions with
at least ``TABLE_SHARE`` of the training words (at most 3 / TABLE_SHARE) are
sent to executors; all other words of the texts meet the table in a join.
Expressions are told apart by hashes of 62 bits.

Rows: null and empty texts have no words and get the score of no evidence;
repeated ids are scored one by one; a null id never trains. Without labels of
both classes every text gets the base rate (0 without labels).
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import collected, counted, fold, with_text_results, written
from .text import LOWER, Piece, pieces, runs_of, span_hashes, words

LEVELS = (4, 6, None)
TABLE_SHARE = 2.0**-20
DISCOUNT = 0.75
MARGINS = (1.0, 3.0)
# Bytes of text that a worker cuts into words at once, and counts of a group that it holds.
PIECE = 1 << 18
COUNTS_HELD = 1 << 18
# Bits, as a power of two, of the map that tells unlabelled documents before the join.
BITMAP_BITS = 26
# Rows of labelled training data, at most, that fit the logistic curve.
CALIBRATION_ROWS = 4000
PRIOR_WORDS = 10
# What the first expression of every word follows; other keys end in their level.
ROOT = len(LEVELS)
_LEVEL_BITS = np.uint64(3)

_inner = np.zeros(256, bool)
_inner[ord("0") : ord("9") + 1] = True
_inner[ord("a") : ord("z") + 1] = True
_inner[128:] = True


def expressions(piece: Piece) -> tuple[list[np.ndarray], np.ndarray]:
    """Keys of every word's chain, one array per level, and where each row's words begin."""
    data = LOWER[piece.data]
    found = words(piece)
    starts, ends = found.starts.copy(), found.ends.copy()
    # Nearest inner byte to the left (right) of each place.
    if len(starts):
        place = np.arange(len(data))
        left = np.maximum.accumulate(np.where(_inner[data], place, -1))
        right = np.minimum.accumulate(np.where(_inner[data], place, len(data))[::-1])[::-1]
        ends = np.maximum(left[ends - 1] + 1, starts)
        starts = np.minimum(right[starts], ends)
    keys = []
    for level, length in enumerate(LEVELS):
        stop = ends if length is None else np.minimum(ends, starts + length)
        h = span_hashes(data, starts, stop)
        keys.append((h & ~_LEVEL_BITS | np.uint64(level)).view(np.int64))
    return keys, found.first


def count_expressions(labelled: DataFrame) -> DataFrame:
    """Counts by group (2 * calibration fold + class) of labelled (text, grp) rows.

    Column ``extra`` is the key of what the expression follows.
    """

    def make_kernel():
        def kernel(batch):
            groups = batch.column(1).to_numpy(zero_copy_only=False)
            out = []
            for piece in pieces(batch.column(0), PIECE):
                chain, first = expressions(piece)
                owner = np.repeat(groups[piece.first : piece.first + piece.rows], np.diff(first))
                for value in np.unique(owner):
                    mine = owner == value
                    parent = np.full(int(mine.sum()), ROOT, np.int64)
                    for level in chain:
                        keys, at, n = np.unique(level[mine], return_index=True, return_counts=True)
                        out.append((int(value), keys, n, parent[at]))
                        parent = level[mine]
            return out

        return kernel

    return counted(
        labelled.select("text", "grp"),
        T.LongType(),
        make_kernel,
        flush_at=COUNTS_HELD,
        extra=T.LongType(),
    )


@dataclass
class Frequent:
    """Frequent expressions and their values, as executors have them."""

    keys: np.ndarray  # sorted
    values: np.ndarray
    nothing: float  # of words of which no expression is known

    def look_up(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.keys):
            return np.zeros(len(keys), bool), np.zeros(len(keys))
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return self.keys[at] == keys, self.values[at]

    def kernel(self):
        def run(piece: Piece):
            chain, first = expressions(piece)
            value, known = np.full(len(chain[0]), self.nothing), []
            for level in chain:
                found, worth = self.look_up(level)
                value = np.where(found, worth, value)
                known.append(found)
            row = np.repeat(np.arange(piece.rows), np.diff(first))
            parts = [
                np.bincount(
                    row[known[-1]],
                    np.maximum(value[known[-1]] - margin, 0),
                    minlength=piece.rows,
                )
                for margin in MARGINS
            ]
            # Distinct other words of each row, with what is left to look up.
            rest = np.flatnonzero(~known[-1])
            rest = rest[np.lexsort((chain[-1][rest], row[rest]))]
            bounds = runs_of(chain[-1][rest], row[rest])
            at = rest[bounds[:-1]]
            columns = [chain[-1][at], np.diff(bounds), value[at]]
            columns += [np.where(k[at], ROOT, c[at]) for c, k in zip(chain[:-1], known[:-1], strict=True)]
            cut = np.searchsorted(row[at], np.arange(piece.rows + 1))
            spans = list(zip(cut[:-1], cut[1:], strict=True))
            return [np.diff(first), *parts, *([c[i:j] for i, j in spans] for c in columns)]

        return run


@dataclass
class ToxicityModel:
    """What words are worth: the log-likelihood ratio of a word whose last known expression is key."""

    table: DataFrame  # (key, value) of all expressions
    frequent: Frequent
    weights: tuple[float, ...]


def ratios(counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Log-likelihood ratios from (parent, key, ordinary, toxic) rows, one per parent and key.

    Gives (parent, key, pooled, ratio) of known expressions and (parent, unseen)
    of unknown ones. The root, the parent of a whole level, is joined by itself.
    """
    a, b = F.col("ordinary"), F.col("toxic")
    per = [
        F.sum(a).alias("n0"),
        F.sum(b).alias("n1"),
        F.count_if(a > 0).alias("t0"),
        F.count_if(b > 0).alias("t1"),
        F.count("*").alias("types"),
    ]
    known = counts.where(a + b > 0)
    below, top = known.where(F.col("parent") != ROOT), known.where(F.col("parent") == ROOT)
    parents = below.groupBy("parent").agg(*per)
    root = top.agg(*per).where("types > 0").withColumn("parent", F.lit(ROOT).cast("long"))
    # One row per parent; all levels look them up, so they are not summed for each again.
    totals = written(parents.unionByName(root), "toxicity-parents")
    root = totals.where(F.col("parent") == ROOT)
    parents = totals.where(F.col("parent") != ROOT)

    def left(k):
        n = F.col(f"n{k}")
        return F.when(n > 0, DISCOUNT * F.col(f"t{k}") / F.greatest(n, F.lit(1))).otherwise(1.0)

    shared = (a + b + 0.5) / (F.col("n0") + F.col("n1") + 0.5 * (F.col("types") + 1))

    def log(k, own):
        n = F.greatest(F.col(f"n{k}"), F.lit(1))
        return F.ln(F.greatest(own - DISCOUNT, F.lit(0.0)) / n + left(k) * shared)

    rows = below.join(parents, "parent").unionByName(top.join(F.broadcast(root), "parent"))
    return (
        rows.select("parent", "key", (a + b).alias("pooled"), (log(1, b) - log(0, a)).alias("ratio")),
        totals.select("parent", (F.ln(left(1)) - F.ln(left(0))).alias("unseen")),
    )


def learnt(counts: DataFrame, weights: tuple[float, ...], purpose: str) -> ToxicityModel:
    """The model of (parent, key, ordinary, toxic) rows, one per expression."""
    known, unknown = ratios(counts)
    unknown = unknown.withColumnRenamed("parent", "key")
    level = F.col("key").bitwiseAND(int(_LEVEL_BITS))
    # Along a chain ratios add up; a word that ends unknown adds what its last parent says of it.
    chain, tables = None, []
    for k in range(len(LEVELS)):
        mine = known.where(level == k)
        if chain is None:
            mine = mine.withColumn("above", F.lit(0.0))
        else:
            mine = mine.join(chain, "parent")
        mine = mine.select("key", "pooled", (F.col("above") + F.col("ratio")).alias("value"))
        chain = mine.select(F.col("key").alias("parent"), F.col("value").alias("above"))
        if k < len(LEVELS) - 1:
            mine = mine.join(unknown, "key", "left").select(
                "key", "pooled", (F.col("value") + F.coalesce("unseen", F.lit(0.0))).alias("value")
            )
        tables.append(mine)
    table = written(reduce(DataFrame.unionByName, tables), purpose)
    n_words = table.where(level == 0).agg(F.sum("pooled")).first()[0] or 0
    # No more than 1 / TABLE_SHARE expressions of a level can have this share.
    rows = collected(table.where(F.col("pooled") >= TABLE_SHARE * n_words).select("key", "value"))
    keys, values = rows["key"].to_numpy(), rows["value"].to_numpy()
    order = np.argsort(keys)
    nothing = unknown.where(F.col("key") == ROOT).first()
    return ToxicityModel(
        table.select("key", "value"),
        Frequent(keys[order], values[order], nothing["unseen"] if nothing else 0.0),
        weights,
    )


def _logistic(features: np.ndarray, labels: np.ndarray) -> tuple[float, ...]:
    """Ridge logistic regression by Newton steps."""
    x = np.column_stack([np.ones(len(features)), features])
    beta = np.zeros(x.shape[1])
    ridge = np.diag([1e-6] + [1e-3] * features.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve(
            x.T @ (x * (p * (1 - p))[:, None]) + ridge, x.T @ (labels - p) - ridge @ beta
        )
        beta += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(b) for b in beta)


_FIELDS = [
    T.StructField("n_words", T.LongType()),
    *(T.StructField(f"part{k}", T.DoubleType()) for k in range(len(MARGINS))),
    T.StructField("word", T.ArrayType(T.LongType(), False)),
    T.StructField("times", T.ArrayType(T.LongType(), False)),
    T.StructField("value", T.ArrayType(T.DoubleType(), False)),
    *(T.StructField(f"link{k}", T.ArrayType(T.LongType(), False)) for k in range(len(LEVELS) - 1)),
]


def _word_values(rest: DataFrame, model: ToxicityModel) -> DataFrame:
    """(word, worth): by the last expression of each that the table has, or as known before."""
    links = [f"link{k}" for k in range(len(LEVELS) - 1)]
    out = rest.groupBy("word").agg(*(F.min(c).alias(c) for c in ["value", *links]))
    worth = F.col("value")
    for k, key in enumerate([*links, "word"]):
        table = model.table.select(F.col("key").alias(key), F.col("value").alias(f"worth{k}"))
        # Links that need no look-up any more, most of them, stay out of the join.
        asked = out.where(F.col(key) != ROOT).join(table, key, "left")
        out = asked.unionByName(out.where(F.col(key) == ROOT), allowMissingColumns=True)
        worth = F.coalesce(f"worth{k}", worth)
    return out.select("word", worth.alias("worth"))


def score(
    docs: DataFrame, model: ToxicityModel, text: str = "text", drop_text: bool = True
) -> DataFrame:
    """Add n_words, evidence, strong_evidence and score (0 to 1) to the rows."""
    boxed = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    body = f"c{docs.columns.index(text)}"
    kept = [c for c in boxed.columns if not (drop_text and c == body)]
    names = [name for name in docs.columns if not (drop_text and name == text)]
    shared = docs.sparkSession.sparkContext.broadcast(model.frequent)
    rows = written(
        with_text_results(
            boxed, body, _FIELDS, lambda: shared.value.kernel(), drop_text=drop_text, size=PIECE
        ).withColumn("row", F.monotonically_increasing_id()),
        "toxicity-parts",
        texts=True,
    )
    fields = [f.name for f in _FIELDS if isinstance(f.dataType, T.ArrayType)]
    rest = rows.select("row", F.explode(F.arrays_zip(*fields)).alias("t")).select(
        "row", *(F.col(f"t.{name}").alias(name) for name in fields)
    )
    worth = F.col("worth")
    # Other words add nothing to any part.
    telling = _word_values(rest, model).where(worth > min(MARGINS))
    added = (
        rest.select("row", "word", "times")
        .join(telling, "word")
        .groupBy("row")
        .agg(
            *(
                F.sum(F.col("times") * F.greatest(worth - margin, F.lit(0.0))).alias(f"more{k}")
                for k, margin in enumerate(MARGINS)
            )
        )
    )
    parts = [
        (F.col(f"part{k}") + F.coalesce(f"more{k}", F.lit(0.0))) / (F.col("n_words") + PRIOR_WORDS)
        for k in range(len(MARGINS))
    ]
    z = F.lit(model.weights[0])
    for weight, part in zip(model.weights[1:], parts, strict=True):
        z = z + weight * part
    z = F.greatest(F.least(z, F.lit(30.0)), F.lit(-30.0))
    return (
        rows.join(added, "row", "left")
        .select(*kept, "n_words", *parts, 1 / (1 + F.exp(-z)))
        .toDF(*names, "n_words", "evidence", "strong_evidence", "score")
    )


def _maybe_labelled(own: DataFrame, marked: DataFrame) -> DataFrame:
    """Rows of ``own`` without most of those whose id ``marked`` lacks, so that their texts stay put.

    A bitmap of hashed ids, of a fixed size; none of the ids in ``marked`` is lost.
    """
    if own.schema["id"].dataType != marked.schema["id"].dataType:
        return own  # equal ids of two types differ in their hashes
    place = F.pmod(F.xxhash64("id"), F.lit(1 << BITMAP_BITS))
    # At most 2^(BITMAP_BITS - 6) rows.
    bit = f"cast(pmod(xxhash64(id), {1 << BITMAP_BITS}) % 64 as int)"
    bits = marked.groupBy((place / 64).cast("long").alias("cell")).agg(
        F.bit_or(F.expr(f"shiftleft(1L, {bit})")).alias("bits")
    )
    return (
        own.where("id is not null")
        .withColumn("cell", (place / 64).cast("long"))
        .join(F.broadcast(bits), "cell")
        .where(f"getbit(bits, {bit}) = 1")
        .select("id", "text")
    )


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text"):
    """Learn from the labelled rows whose fold is not 0.

    ``labels`` has columns doc_id and toxic (null or other than 0 and 1: no label).
    """
    marked = (
        labels.select(F.col("doc_id").alias("id"), F.col("toxic").cast("int").alias("y"))
        .where("id is not null and y in (0, 1)")
        .where(fold("id") != 0)
        .groupBy("id")
        .agg(F.max("y").alias("y"))
        .withColumn("grp", F.when(fold("id") == 4, 2).otherwise(0) + F.col("y"))
    )
    own = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    asked = _maybe_labelled(own.where(fold("id") != 0), marked)
    labelled = asked.join(marked.hint("shuffle_hash"), "id")
    n = [F.sum(F.when(F.col("grp") == k, F.col("n")).otherwise(0)).alias(f"n{k}") for k in range(4)]
    counts = written(
        count_expressions(labelled).groupBy("key").agg(F.min("extra").alias("parent"), *n),
        "toxicity-counts",
        texts=True,
    )
    # The curve is fitted with counts of folds 1 to 3 on rows of fold 4.
    trial = learnt(
        counts.selectExpr("parent", "key", "n0 AS ordinary", "n1 AS toxic"),
        (0.0,) * (1 + len(MARGINS)),
        "toxicity-trial",
    )
    sample = (
        marked.where("grp >= 2")
        .orderBy(F.xxhash64("id"), "id")
        .limit(CALIBRATION_ROWS)
        .select("id", "y")
    )
    seen = (
        score(own.join(F.broadcast(sample), "id").select("text", "y"), trial)
        .select("y", "evidence", "strong_evidence")
        .toArrow()
    )
    y = seen["y"].to_numpy()
    both = len(y) and 0 < y.sum() < len(y)
    if both:
        x = np.column_stack([seen["evidence"].to_numpy(), seen["strong_evidence"].to_numpy()])
        weights = _logistic(x, y)
    else:
        n_toxic, n_all = counts.where(f"parent = {ROOT}").selectExpr(
            "sum(n1 + n3)", "sum(n0 + n1 + n2 + n3)"
        ).first()
        rate = min(max((n_toxic or 0) / max(n_all or 0, 1), 1e-6), 1 - 1e-6)
        weights = (float(np.log(rate / (1 - rate))),) + (0.0,) * len(MARGINS)
    return learnt(
        counts.selectExpr("parent", "key", "n0 + n2 AS ordinary", "n1 + n3 AS toxic"),
        weights,
        "toxicity-values",
    )
