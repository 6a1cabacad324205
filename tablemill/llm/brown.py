"""Brown class-based bigrams: P(w | v) = P(class of w | class of v) * P(w | class of w).

Classes come from exchange clustering, coarse first. Words with at least
``UNIT_SHARE`` of the training tokens (there can be at most 1 / UNIT_SHARE of
them) are exchanged one by one, against groups of all rarer words by spelling
(their last bytes). Spark counts bigrams of units over the whole training corpus;
each round it sums them by the current classes, every unit of one half is moved to
the class where the likelihood of its neighbours is greatest, and the next round
does the other half. Then every rarer word, however rare, is moved by itself from
the class of its group to the class that suits its own neighbours best: Spark
gathers each word's exact counts of neighbouring classes and sorts them by word, a
task reads them word by word. The result is a table with one row per word.

Transitions are exact counts of neighbouring classes over the training corpus, with
each word in its own class. Classes and counts of words with at least
``TABLE_SHARE`` of the tokens (again bounded in number) are sent to the executors;
all other words of a text meet theirs in a join by word hash, which puts their
classes into the text's sequence of classes.

Unknown words count as one more word of the class of their spelling group, so
probabilities sum to one. Null counts as the empty text, whose only token is
the end; rows with null ids train; repeated rows are scored one by one.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import collected, counted, with_text_results, written
from .text import LOWER, Piece, mix, pieces, runs_of, span_hashes, words

CLASSES = 64
UNIT_SHARE = 2.0**-12
TABLE_SHARE = 2.0**-20
GROUPS = 1024
TAIL_BYTES = 3
ROUNDS = 8
# Weight of the class's own share in its transition estimates.
PRIOR = 5.0
END = np.uint64(0xE0D)
_END_KEY = int(mix(np.array([END]))[0].astype(np.int64))
_END_GROUP = GROUPS
# In a text's sequence of classes: a word whose class is looked up by a join.
_OPEN = 255
# Neighbour counts that a task gathers before it merges them.
FLUSH_AT = 1 << 21


def tokens(piece: Piece) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys and spelling groups of all tokens in order, an end after each row, and row bounds."""
    data = LOWER[piece.data]
    found = words(piece)
    keys = span_hashes(data, found.starts, found.ends).view(np.int64)
    tails = span_hashes(data, np.maximum(found.starts, found.ends - TAIL_BYTES), found.ends)
    groups = (tails % np.uint64(GROUPS)).astype(np.int64)
    at = found.first[1:]
    first = found.first + np.arange(piece.rows + 1)
    return np.insert(keys, at, _END_KEY), np.insert(groups, at, _END_GROUP), first


def count_words(texts: DataFrame) -> DataFrame:
    """(grp, key, n): spelling group, key and count of every token of a (text) frame."""

    def make_kernel():
        def kernel(batch):
            out = []
            for piece in pieces(batch.column(0)):
                keys, groups, _ = tokens(piece)
                key, at, n = np.unique(keys, return_index=True, return_counts=True)
                out.append((0, key, n, groups[at]))
            return out

        return kernel

    return counted(texts, T.LongType(), make_kernel, extra=T.IntegerType())


@dataclass
class Units:
    """Words that are exchanged first; until then all others go by spelling group."""

    keys: np.ndarray  # sorted

    @property
    def size(self) -> int:
        return len(self.keys) + GROUPS + 1

    def of(self, keys: np.ndarray, groups: np.ndarray) -> np.ndarray:
        unit = len(self.keys) + groups
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            unit = np.where(self.keys[at] == keys, at, unit)
        return unit

    def grouped(self, units: np.ndarray) -> np.ndarray:
        """Which of these units are groups; that of the end holds nothing else."""
        return (units >= len(self.keys)) & (units < self.size - 1)


def count_unit_pairs(texts: DataFrame, units: Units) -> DataFrame:
    """(u, v, n): how often unit v follows unit u; every text begins after an end."""
    shared = texts.sparkSession.sparkContext.broadcast(units)

    def make_kernel():
        units = shared.value
        size = units.size

        def kernel(batch):
            out = []
            for piece in pieces(batch.column(0)):
                keys, groups, _ = tokens(piece)
                unit = units.of(keys, groups)
                # The token before a text is an end, like the one before it in the piece.
                before = np.concatenate([unit[-1:], unit[:-1]])
                code, n = np.unique(before * size + unit, return_counts=True)
                out.append((0, code, n))
            return out

        return kernel

    size = F.lit(units.size)
    return counted(texts, T.LongType(), make_kernel).select(
        F.expr(f"cast(key div {units.size} as int)").alias("u"),
        (F.col("key") % size).cast("int").alias("v"),
        "n",
    )


def exchange(pairs: DataFrame, n_units: int, rounds: int = ROUNDS, classes: int = CLASSES):
    """Class of every unit, and counts of class pairs, from a table of unit pairs."""
    spark = pairs.sparkSession
    totals = np.zeros(n_units)
    rows = pairs.groupBy("v").agg(F.sum("n").alias("n")).toArrow()
    totals[rows["v"].to_numpy()] = rows["n"].to_numpy()
    rank = np.argsort(np.argsort(-totals, kind="stable"), kind="stable")
    own = rank % classes

    def by_class(unit: str, other: str) -> np.ndarray:
        table = spark.createDataFrame(
            [(int(u), int(c)) for u, c in enumerate(own)], "unit int, cls int"
        )
        sums = (
            # One row per unit: at most 1 / UNIT_SHARE and the groups.
            pairs.join(F.broadcast(table), pairs[other] == table["unit"])
            .groupBy(unit, "cls")
            .agg(F.sum("n").alias("n"))
            .toArrow()
        )
        out = np.zeros((n_units, classes))
        out[sums[unit].to_numpy(), sums["cls"].to_numpy()] = sums["n"].to_numpy()
        return out

    def class_pairs(after: np.ndarray) -> np.ndarray:
        out = np.zeros((classes, classes))
        np.add.at(out, own, after)
        return out

    for turn in range(rounds):
        after, before = by_class("u", "v"), by_class("v", "u")
        both = class_pairs(after)
        size = both.sum(1) + both.sum(0)
        # Likelihood of a unit's neighbours if it were in each class.
        log = np.log(both + 0.1)
        gain = before @ log + after @ log.T - np.outer(totals, np.log(size + 1.0))
        best = gain.argmax(1)
        move = (np.arange(n_units) % 2 == turn % 2) & (totals > 0)
        # Words never leave a class empty-handed: equal gains stay.
        better = gain[np.arange(n_units), best] > gain[np.arange(n_units), own] + 1e-9
        own = np.where(move & better, best, own)
    return own, class_pairs(by_class("u", "v"))


def _merge(key, code, n, group) -> tuple[np.ndarray, ...]:
    """One entry per key and code, by key."""
    words, at = np.unique(key, return_inverse=True)
    both = at * (2 * CLASSES) + code
    order = np.argsort(both, kind="stable")
    both = both[order]
    head = runs_of(both)[:-1]
    if not len(head):
        return words, code, n, group
    return (
        words[both[head] // (2 * CLASSES)],
        (both[head] % (2 * CLASSES)).astype(np.uint8),
        np.add.reduceat(n[order], head),
        group[order][head],
    )


_CONTEXTS = pa.schema(
    [("key", pa.int64()), ("grp", pa.int32()), ("codes", pa.binary()), ("counts", pa.binary())]
)


def _binary(data: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """A binary value of each ``data[bounds[i]:bounds[i + 1]]``."""
    data = np.ascontiguousarray(data[bounds[0] : bounds[-1]])
    offsets = ((bounds - bounds[0]) * data.itemsize).astype(np.int32)
    return pa.Array.from_buffers(
        pa.binary(), len(bounds) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(data)]
    )


def _values(column: pa.Array, kind) -> tuple[np.ndarray, np.ndarray]:
    """The numbers in a binary column, one after the other, and the bounds of its rows."""
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1]
    body = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    body = body[bounds[0] : bounds[-1]].view(kind)
    return body, (bounds - bounds[0]) // np.dtype(kind).itemsize


def count_contexts(texts: DataFrame, units: Units, classes: np.ndarray) -> DataFrame:
    """Counts of the classes beside each word that has no unit of its own.

    (key, grp, codes, counts), one row per word and task: a code is the class of the
    token before, or CLASSES and that of the token after.
    """
    shared = texts.sparkSession.sparkContext.broadcast((units, classes))

    def emit(key, code, n, group):
        bounds = runs_of(key)
        for start in range(0, len(bounds) - 1, 1 << 14):
            part = bounds[start : start + (1 << 14) + 1]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(key[part[:-1]]),
                    pa.array(group[part[:-1]], pa.int32()),
                    _binary(code, part),
                    _binary(n, part),
                ],
                schema=_CONTEXTS,
            )

    def run(batches):
        units, classes = shared.value
        held, size = [], 0
        for batch in batches:
            for piece in pieces(batch.column(0)):
                keys, groups, _ = tokens(piece)
                unit = units.of(keys, groups)
                cls = classes[unit].astype(np.uint8)
                mine = np.flatnonzero(units.grouped(unit))
                # Every text begins after an end and ends with one.
                code = np.concatenate([cls[mine - 1], cls[(mine + 1) % len(cls)] + CLASSES])
                held.append(
                    _merge(
                        np.tile(keys[mine], 2),
                        code.astype(np.uint8),
                        np.ones(len(code), np.int64),
                        np.tile(groups[mine].astype(np.int16), 2),
                    )
                )
                size += len(held[-1][0])
                if size > FLUSH_AT:
                    held = [_merge(*map(np.concatenate, zip(*held, strict=True)))]
                    size = len(held[0][0])
                    if size > FLUSH_AT // 2:
                        yield from emit(*held[0])
                        held, size = [], 0
        if held:
            yield from emit(*_merge(*map(np.concatenate, zip(*held, strict=True))))

    return texts.mapInArrow(run, "key long, grp int, codes binary, counts binary")


def best_classes(
    contexts: DataFrame, units: Units, classes: np.ndarray, both: np.ndarray
) -> DataFrame:
    """(key, n, cls): count of every word of ``contexts`` and its best class.

    The rows of a word lie one after the other, so a task holds one word's sums (two
    per class) beyond its batch. ``both`` has the counts of class pairs.
    """
    shared = contexts.sparkSession.sparkContext.broadcast((units, classes, both))
    schema = pa.schema([("key", pa.int64()), ("n", pa.int64()), ("cls", pa.int32())])

    def run(batches):
        units, classes, both = shared.value
        log = np.log(both + 0.1)
        cost = np.log(both.sum(1) + both.sum(0) + 1.0)

        def moved(key, group, sums):
            before, after = sums[:, :CLASSES], sums[:, CLASSES:]
            n = before.sum(1)
            gain = before @ log + after @ log.T - np.outer(n, cost)
            own, row = classes[len(units.keys) + group], np.arange(len(key))
            best = gain.argmax(1)
            # Equal gains stay.
            best = np.where(gain[row, best] > gain[row, own] + 1e-9, best, own)
            return pa.RecordBatch.from_arrays(
                [pa.array(key), pa.array(n.astype(np.int64)), pa.array(best, pa.int32())],
                schema=schema,
            )

        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, groups = (batch.column(i).to_numpy() for i in (0, 1))
            codes, bounds = _values(batch.column(2), np.uint8)
            n, _ = _values(batch.column(3), np.int64)
            runs = runs_of(keys)
            word = np.repeat(np.repeat(np.arange(len(runs) - 1), np.diff(runs)), np.diff(bounds))
            sums = np.bincount(
                word * (2 * CLASSES) + codes, n, minlength=(len(runs) - 1) * 2 * CLASSES
            ).reshape(-1, 2 * CLASSES)
            key, group = keys[runs[:-1]], groups[runs[:-1]]
            if last and last[0][0] == key[0]:
                sums[0] += last[2][0]
            elif last:
                yield moved(*last)
            if len(key) > 1:
                yield moved(key[:-1], group[:-1], sums[:-1])
            last = key[-1:].copy(), group[-1:].copy(), sums[-1:].copy()
        if last:
            yield moved(*last)

    rows = contexts.repartition("key").sortWithinPartitions("key")
    return rows.mapInArrow(run, "key long, n long, cls int")


@dataclass
class Frequent:
    """Frequent words, as executors have them, and the classes of unknown ones."""

    keys: np.ndarray  # sorted; the end is always among them
    counts: np.ndarray
    classes: np.ndarray
    groups: np.ndarray  # class of every spelling group

    def kernel(self):
        def run(piece: Piece):
            keys, groups, first = tokens(piece)
            at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            here = self.keys[at] == keys
            cls = np.where(here, self.classes[at], _OPEN).astype(np.uint8)
            count = np.where(here, self.counts[at], 0)
            row = np.repeat(np.arange(piece.rows), np.diff(first))

            def total(values):
                return np.bincount(row, values, minlength=piece.rows)

            rare = np.flatnonzero(~here)
            place = (rare - first[row[rare]]) << 8 | self.groups[groups[rare]].astype(np.int64)
            cut = np.searchsorted(rare, first)
            spans = list(zip(cut[:-1], cut[1:], strict=True))
            return [
                np.diff(first),
                total(count > 0).astype(np.int64),
                total(np.where(here, np.log10(count + 0.5), 0.0)),
                [cls[a:b].tobytes() for a, b in zip(first[:-1], first[1:], strict=True)],
                [keys[rare[a:b]] for a, b in spans],
                [place[a:b] for a, b in spans],
            ]

        return run


_FIELDS = [
    T.StructField("n_tokens", T.LongType()),
    T.StructField("n_known", T.LongType()),
    T.StructField("logs", T.DoubleType()),
    T.StructField("classes", T.BinaryType()),
    T.StructField("rare", T.ArrayType(T.LongType(), False)),
    T.StructField("place", T.ArrayType(T.LongType(), False)),
]


def classed(docs: DataFrame, frequent: Frequent, table: DataFrame) -> DataFrame:
    """Rows of ``docs`` with n_tokens, n_known, logs, and the classes of their tokens in order.

    ``table`` has (key, n, cls) of all words. Open places of ``classes`` are filled
    from ``fills``, by place and class; see ``sequences``.
    """
    shared = docs.sparkSession.sparkContext.broadcast(frequent)
    rows = written(
        with_text_results(docs, "text", _FIELDS, lambda: shared.value.kernel()).withColumn(
            "row", F.monotonically_increasing_id()
        ),
        "text-classes",
        texts=True,
    )
    rare = rows.select("row", F.explode(F.arrays_zip("rare", "place")).alias("t")).select(
        "row", F.col("t.rare").alias("key"), F.col("t.place").alias("place")
    )
    n = F.coalesce(F.col("n"), F.lit(0))
    # The low byte of a place is the class of a word that the table lacks.
    own = F.coalesce(F.col("cls").cast("long"), F.col("place").bitwiseAND(255))
    added = (
        rare.join(table, "key", "left")
        .groupBy("row")
        .agg(
            F.count_if(n > 0).alias("more_known"),
            F.sum(F.log10(n + 0.5)).alias("more_logs"),
            F.collect_list(F.col("place") - F.col("place").bitwiseAND(255) + own).alias("fills"),
        )
    )
    kept = [c for c in docs.columns if c != "text"]
    return rows.join(added, "row", "left").select(
        *kept,
        "n_tokens",
        (F.col("n_known") + F.coalesce("more_known", F.lit(0))).cast("long").alias("n_known"),
        (F.col("logs") + F.coalesce("more_logs", F.lit(0.0))).alias("logs"),
        "classes",
        "fills",
    )


def sequences(classes: pa.Array, fills: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The classes of all tokens of some rows, and the bounds of the rows."""
    values, first = _values(classes, np.uint8)
    values = values.copy()
    found = fills.flatten().to_numpy()
    lengths = fills.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    values[np.repeat(first[:-1], lengths) + (found >> 8)] = found & 255
    return values, first


def count_class_pairs(rows: DataFrame) -> np.ndarray:
    """How often a class follows another, from rows of ``classed``; every text begins after an end."""

    def run(batches):
        out = np.zeros(CLASSES * CLASSES, np.int64)
        for batch in batches:
            if batch.num_rows:
                cls, _ = sequences(batch.column(0), batch.column(1))
                cls = cls.astype(np.int64)
                before = np.concatenate([cls[-1:], cls[:-1]])
                out += np.bincount(before * CLASSES + cls, minlength=len(out))
        code = np.flatnonzero(out)
        yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(out[code])], ["code", "n"])

    # At most CLASSES ** 2 rows.
    sums = collected(
        rows.select("classes", "fills")
        .mapInArrow(run, "code long, n long")
        .groupBy("code")
        .agg(F.sum("n").alias("n"))
    )
    out = np.zeros(CLASSES * CLASSES)
    out[sums["code"].to_numpy()] = sums["n"].to_numpy()
    return out.reshape(CLASSES, CLASSES)


@dataclass
class BrownModel:
    frequent: Frequent
    transition: np.ndarray  # log10 P(class | class before)
    emission: np.ndarray  # log10 of each class's emission denominator
    n_tokens: int
    n_types: int

    def steps(self, cls: np.ndarray, first: np.ndarray) -> np.ndarray:
        """What the classes of tokens add to the score of each row."""
        before = np.concatenate([cls[-1:], cls[:-1]])
        row = np.repeat(np.arange(len(first) - 1), np.diff(first))
        step = self.transition[before, cls] - self.emission[cls]
        return np.bincount(row, step, minlength=len(first) - 1)


def fit(docs: DataFrame, text: str = "text") -> tuple[BrownModel, DataFrame]:
    """Learn from all texts of ``docs``; also the table (key, n, cls) of all words."""
    spark = docs.sparkSession
    texts = docs.select(F.col(text).alias("text"))
    found = written(count_words(texts), "word-counts", texts=True)
    row = found.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    n_tokens, n_types = int(row["n"] or 0), int(row["v"])
    # No more than 1 / share words can have this share; the end is always among the units.
    often = (F.col("n") >= max(1.0, UNIT_SHARE * n_tokens)) | (F.col("key") == _END_KEY)
    heads = found.where(often).select("key", "n").toArrow()
    heads = dict(zip(heads["key"].to_pylist(), heads["n"].to_pylist(), strict=True))
    units = Units(
        np.array(sorted(k for k, n in heads.items() if n >= UNIT_SHARE * n_tokens), np.int64)
    )
    pairs = written(count_unit_pairs(texts, units), "unit-pairs", texts=True)
    classes, both = exchange(pairs, units.size)

    def class_of(key: int) -> int:
        return int(classes[units.of(np.array([key]), np.array([_END_GROUP]))[0]])

    alone = spark.createDataFrame(
        [(k, n, class_of(k)) for k, n in heads.items()], "key long, n long, cls int"
    )
    contexts = count_contexts(texts, units, classes)
    table = written(
        best_classes(contexts, units, classes, both).unionByName(alone), "word-classes", texts=True
    )
    # No more than 1 / share words can have this share.
    sent = collected(table.where(F.col("n") >= max(1.0, TABLE_SHARE * n_tokens)))
    keys, counts, own = (sent[c].to_numpy() for c in ("key", "n", "cls"))
    if _END_KEY not in keys:
        keys = np.append(keys, _END_KEY)
        counts, own = np.append(counts, heads.get(_END_KEY, 0)), np.append(own, class_of(_END_KEY))
    order = np.argsort(keys)
    frequent = Frequent(
        keys[order], counts[order], own[order].astype(np.uint8), classes[len(units.keys) :]
    )
    both = count_class_pairs(classed(texts, frequent, table))
    # Tokens and types of each class, over all words.
    mass = np.full(CLASSES, 0.5)
    by_class = table.groupBy("cls").agg(F.sum("n").alias("n"), F.count("*").alias("v")).toArrow()
    mass[by_class["cls"].to_numpy()] += by_class["n"].to_numpy() + 0.5 * by_class["v"].to_numpy()
    share = mass / mass.sum()
    transition = np.log10((both + PRIOR * share) / (both.sum(1, keepdims=True) + PRIOR))
    return BrownModel(frequent, transition, np.log10(mass), n_tokens, n_types), table


def score(
    docs: DataFrame, model: BrownModel, counts: DataFrame, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score of every row."""
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    rows = classed(own, model.frequent, counts)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    last = len(rows.columns) - 2
    kept = T.StructType([*rows.schema.fields[:last], T.StructField("steps", T.DoubleType())])

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                steps = shared.value.steps(*sequences(batch.column(last), batch.column(last + 1)))
                columns = [*batch.columns[:last], pa.array(steps)]
                yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names[:last], "steps"])

    base = float(np.log10(model.n_tokens + 0.5 * (model.n_types + 1)))
    return rows.mapInArrow(run, kept).select(
        "doc_id",
        "n_tokens",
        "n_known",
        F.lit(model.n_tokens).cast("long").alias("train_tokens"),
        (F.col("logs") - F.lit(base) * F.col("n_tokens")).alias("base_score"),
        (F.col("logs") + F.col("steps")).alias("score"),
    )
