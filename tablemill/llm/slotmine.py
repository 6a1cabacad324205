"""Hard-negative mining: for each anchor and positive, the best negatives within a share of its score.

Scores are inner products of vectors of whole numbers. An anchor's positives are
its best rows of the same label. Each positive asks for negatives in a window of
scores, from ``low`` to ``high`` hundredths of its own; the windows of an anchor
overlap. Their upper limits, in descending order, split the scores into disjoint
slots: the first slot reaches from the highest limit down to the next lower one,
and so on. The best k of a window are among the best k of its own slot and those
of the slots below, whatever the windows overlap, so one pass over the rows keeps
k rows per anchor and slot, and a window takes the first k, from its slot down,
that are not below its lower limit.

All rows are compared with all anchors, the stated query set, in blocks: a cell
is a block of anchors and every ``groups``-th block of rows. The rows of a cell
stream by in blocks, while its task keeps the best k per anchor (and slot) so far
and passes by rows that no longer can be among them; only the best k leave the
cell, and Spark merges those of all cells. Cells are numbered, and dealt by
number, so each is a task of its own, of the same size, whatever the labels or
vectors; groups of equal vectors meet nowhere.

A worker holds a block of anchors with their best rows (``ANCHORS``), a batch of
blocks of rows and the scores of a tile (``TILE * ROWS`` numbers). Vectors longer
than that has room for (``ANCHOR_ROOM``, ``ROW_ROOM``) make smaller blocks.

Rows that take no part: with a null id, label or vector, or a null component. Of
rows that repeat an id, that with the smallest label, then vector, counts. Vectors
of different lengths: missing components are 0. Ties go to the smaller id. Scores
are exact; one that does not fit 64 bits counts as the nearest number that does. An
anchor without positives, a positive without negatives and an empty table give no
rows. Columns other than those named are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from .common import written

#: Anchors and rows in a block, and the room for their vectors in bytes.
ANCHORS, ANCHOR_ROOM = 8192, 1 << 25
ROWS, ROW_ROOM = 1024, 1 << 20
#: Anchors whose scores are computed at a time.
TILE = 1024
#: Blocks of rows that one cell reads at most.
CELL_BLOCKS = 256
#: Tasks that cells are dealt to at most, unless the session asks for more.
CELL_TASKS = 20_000

_LEAST = np.iinfo(np.int64).min


@dataclass(frozen=True)
class Mining:
    """How many positives an anchor has, how many negatives each asks for, and where."""

    positives: int = 5
    negatives: int = 3
    low: int = 50
    high: int = 95

    def __post_init__(self) -> None:
        if self.positives < 1 or self.negatives < 1 or not 0 <= self.low <= self.high:
            raise ValueError(f"{self}: positives and negatives of 1 or more, 0 <= low <= high")


_BLOCK = T.StructType(
    [
        T.StructField("block", T.IntegerType()),
        T.StructField("ids", T.BinaryType()),
        T.StructField("labels", T.BinaryType()),
        T.StructField("limits", T.BinaryType()),
        T.StructField("width", T.IntegerType()),
        T.StructField("kind", T.StringType()),
        T.StructField("vectors", T.BinaryType()),
    ]
)


def _packed(frame: DataFrame, most: int, room: int, limits: bool = False) -> tuple[DataFrame, int]:
    """Rows (id, label, vector[, limits]) as blocks of about ``most`` rows, fewer if vectors are long.

    A block is one row: its number, and its ids, labels and vectors as numbers laid end
    to end, in the narrowest type that holds them. ``limits`` are numbers of the same
    count in each row. Blocks are numbered from 0; how many numbers there are comes second.
    """
    arrow = to_arrow_schema(_BLOCK)

    def run(batches):
        held = [[], [], [], []]
        for batch in batches:
            first = batch.column(2).offsets.to_numpy().astype(np.int64)
            values = batch.column(2).values.to_numpy()
            held[0].append(batch.column(0).to_numpy())
            held[1].append(batch.column(1).to_numpy())
            held[2] += [values[x:y] for x, y in zip(first[:-1], first[1:], strict=True)]
            if limits:
                held[3].append(batch.column(3).flatten().to_numpy().reshape(batch.num_rows, -1))
        if not held[2]:
            return
        ids, labels = np.concatenate(held[0]), np.concatenate(held[1])
        extra = np.concatenate(held[3]) if limits else np.zeros((len(ids), 0), np.int64)
        width = max(map(len, held[2]))
        table = np.zeros((len(ids), width), np.int64)
        for i, vector in enumerate(held[2]):
            table[i, : len(vector)] = vector
        high, low = int(table.max(initial=0)), int(table.min(initial=0))
        kind = next(k for k in ("i1", "i2", "i4", "i8") if max(high, -low - 1) <= np.iinfo(k).max)
        row = [ids, labels, extra, table.astype(kind)]
        ids, labels, extra, table = (np.ascontiguousarray(x).tobytes() for x in row)
        row = (TaskContext.get().partitionId(), ids, labels, extra, width, kind, table)
        yield pa.RecordBatch.from_arrays(
            [pa.array([v], f.type) for v, f in zip(row, arrow, strict=True)], schema=arrow
        )

    n, width = frame.agg(F.count("*"), F.max(F.size("vector"))).first()
    each = max(1, min(most, room // (8 * max(width or 1, 1))))
    count = -(-n // each)
    # Without a key: parts of equal size, and the same ones if a task runs again.
    blocks = frame.repartition(max(1, count)).mapInArrow(run, _BLOCK)
    return written(blocks, "vector-blocks"), count


class _Block:
    """A packed block, opened."""

    def __init__(self, row: dict) -> None:
        self.ids = np.frombuffer(row["ids"], np.int64)
        self.labels = np.frombuffer(row["labels"], np.int64)
        self.limits = np.frombuffer(row["limits"], np.int64).reshape(len(self.ids), -1)
        self.vectors = np.frombuffer(row["vectors"], row["kind"]).reshape(len(self.ids), row["width"])
        self.size = np.abs(self.vectors.astype(np.float64)).max(axis=1, initial=0)

    def scores(self, start: int, stop: int, other: _Block) -> np.ndarray:
        """Exact inner products of some rows with all of another block."""
        width = min(self.vectors.shape[1], other.vectors.shape[1])
        a, b = self.vectors[start:stop, :width], other.vectors[:, :width]
        most = self.size[start:stop].max(initial=0) * other.size.max(initial=0) * max(width, 1)
        if most < 1 << 53:
            kind = np.float32 if most < 1 << 24 else np.float64
            return (a.astype(kind) @ b.astype(kind).T).astype(np.int64)
        exact = a.astype(object) @ b.astype(object).T
        span = np.iinfo(np.int64)
        return np.clip(exact, span.min, span.max).astype(np.int64)


class _Best:
    """The best k (score, id) of each of ``n`` lists, ties to the smaller id."""

    def __init__(self, n: int, k: int) -> None:
        self.n, self.k = n, k
        self.list = np.zeros(0, np.int64)
        self.score, self.id = self.list.copy(), self.list.copy()
        #: The last one of each full list; what does not come before it is not among the best.
        self.bar = np.full(n, _LEAST)
        self.bar_id = np.full(n, np.iinfo(np.int64).max)

    def add(self, place, score, number) -> None:
        place = np.concatenate([self.list, place])
        score = np.concatenate([self.score, score])
        number = np.concatenate([self.id, number])
        # ~x is -x - 1, which no number overflows.
        order = np.lexsort((number, ~score, place))
        place, score, number = place[order], score[order], number[order]
        rank = np.arange(len(place)) - np.searchsorted(place, place, "left")
        last = rank == self.k - 1
        self.bar[place[last]], self.bar_id[place[last]] = score[last], number[last]
        keep = rank < self.k
        self.list, self.score, self.id = place[keep], score[keep], number[keep]


_POSITIVES = T.StructType([T.StructField(c, T.LongType()) for c in ("anchor", "score", "id")])
_NEGATIVES = T.StructType([T.StructField(c, T.LongType()) for c in ("anchor", "slot", "score", "id")])


def _positives_of(anchors: _Block, how: Mining):
    best = _Best(len(anchors.ids), how.positives)

    def see(rows: _Block) -> None:
        for start in range(0, len(anchors.ids), TILE):
            stop = min(start + TILE, len(anchors.ids))
            score = anchors.scores(start, stop, rows)
            bar, bar_id = (x[start:stop, None] for x in (best.bar, best.bar_id))
            fits = anchors.labels[start:stop, None] == rows.labels
            fits &= (score > bar) | ((score == bar) & (rows.ids < bar_id))
            fits &= anchors.ids[start:stop, None] != rows.ids
            a, r = np.nonzero(fits)
            best.add(a + start, score[a, r], rows.ids[r])

    def result():
        return [anchors.ids[best.list], best.score, best.id]

    return see, result


def _negatives_of(anchors: _Block, how: Mining):
    # Per anchor: the slots' upper limits, descending, repeated at the end if fewer; the floor.
    upper, floor = anchors.limits[:, :-1], anchors.limits[:, -1]
    slots = upper.shape[1]
    best = _Best(len(anchors.ids) * slots, how.negatives)

    def see(rows: _Block) -> None:
        for start in range(0, len(anchors.ids), TILE):
            stop = min(start + TILE, len(anchors.ids))
            score = anchors.scores(start, stop, rows)
            asked = anchors.labels[start:stop, None] != rows.labels
            asked &= score >= floor[start:stop, None]
            asked &= score <= upper[start:stop, :1]
            a, r = np.nonzero(asked)
            score, number, a = score[a, r], rows.ids[r], a + start
            place = a * slots + (score[:, None] <= upper[a]).sum(axis=1) - 1
            bar = best.bar[place]
            fits = (score > bar) | ((score == bar) & (number < best.bar_id[place]))
            best.add(place[fits], score[fits], number[fits])

    def result():
        anchor, slot = np.divmod(best.list, slots)
        return [anchors.ids[anchor], slot, best.score, best.id]

    return see, result


def _over_cells(anchors: tuple, rows: tuple, how: Mining, make, schema: T.StructType) -> DataFrame:
    """What ``make(block of anchors, how)`` keeps of all rows, cell by cell."""
    (anchors, n_anchors), (rows, n_rows) = anchors, rows
    spark = rows.sparkSession
    if not n_anchors or not n_rows:
        return spark.createDataFrame([], schema)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    groups = max(-(-n_rows // CELL_BLOCKS), min(n_rows, -(-tasks // n_anchors)))
    cells = n_anchors * groups
    fields = _BLOCK.fieldNames()[1:]

    def dealt(blocks: DataFrame, over: int, cell: str, at: str) -> DataFrame:
        copies = blocks.select(F.explode(F.sequence(F.lit(0), F.lit(over - 1))).alias("k"), "*")
        return copies.select(F.expr(cell).cast("long").alias("cell"), F.expr(at).alias("at"), *fields)

    # A cell's anchors come first.
    both = dealt(anchors, groups, f"cast(block as long) * {groups} + k", "-1").unionByName(
        dealt(rows, n_anchors, f"cast(k as long) * {groups} + block % {groups}", "block")
    )
    arrow = to_arrow_schema(schema)

    def run(batches):
        cell, see, result = None, None, None

        def done():
            columns = result()
            for start in range(0, len(columns[0]), 1 << 16):
                part = [pa.array(c[start : start + (1 << 16)], pa.int64()) for c in columns]
                yield pa.RecordBatch.from_arrays(part, schema=arrow)

        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(name)[i].as_py() for name in batch.schema.names}
                if row["at"] < 0:
                    if result:
                        yield from done()
                    cell = row["cell"]
                    see, result = make(_Block(row), how)
                # A number that got no anchors has rows only.
                elif row["cell"] == cell:
                    see(_Block(row))
        if result:
            yield from done()

    parts = min(cells, max(tasks, CELL_TASKS))
    place = F.expr(f"cast(cell * {parts} div {cells} as int)")
    return (
        both.repartitionById(parts, place).sortWithinPartitions("cell", "at").mapInArrow(run, schema)
    )


def _top(frame: DataFrame, by: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("score"), "id")
    return frame.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(
    frame: DataFrame,
    is_anchor: Column,
    how: Mining = Mining(),
    id_: str = "id",
    label: str = "label",
    vector: str = "vector",
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``vector`` holds whole numbers; ids and labels are whole numbers, too.
    ``is_anchor`` is a condition on the column ``id``.
    """
    own = frame.select(
        F.col(id_).cast("long").alias("id"),
        F.col(label).cast("long").alias("label"),
        F.col(vector).cast("array<bigint>").alias("vector"),
    ).where("id is not null and label is not null and vector is not null")
    own = own.where(~F.exists("vector", lambda x: x.isNull()))
    # Repeated ids combine within tasks, so that one id with very many rows does no harm.
    own = own.groupBy("id").agg(F.min(F.struct("label", "vector")).alias("v")).select("id", "v.*")
    own = written(own, "vectors")
    anchors = written(own.where(F.coalesce(is_anchor, F.lit(False))), "anchors")
    rows = _packed(own, ROWS, ROW_ROOM)
    blocks = _packed(anchors, ANCHORS, ANCHOR_ROOM)
    best = _over_cells(blocks, rows, how, _positives_of, _POSITIVES)
    positives = _top(best, ["anchor"], how.positives)
    share = "cast({0} as decimal(38, 0)) * {1}"
    positives = positives.select(
        "anchor",
        F.col("id").alias("positive"),
        F.col("score").alias("positive_score"),
        F.expr(f"cast(floor({share.format('score', how.high)} / 100) as bigint)").alias("upper"),
        F.expr(f"cast(ceil({share.format('score', how.low)} / 100) as bigint)").alias("lower"),
    )
    positives = written(positives, "positives")
    asked = positives.where("lower <= upper")
    # Descending limits of each anchor's slots, the last one repeated, then the floor.
    limits = asked.groupBy("anchor").agg(
        F.sort_array(F.collect_set("upper"), asc=False).alias("u"), F.min("lower").alias("floor")
    )
    limits = limits.select(
        F.col("anchor").alias("id"),
        F.concat(
            F.transform(
                F.sequence(F.lit(0), F.lit(how.positives - 1)),
                lambda i: F.element_at("u", F.least(i + 1, F.size("u"))),
            ),
            F.array("floor"),
        ).alias("limits"),
    )
    asking = written(anchors.join(limits, "id").select("id", "label", "vector", "limits"), "asking")
    blocks = _packed(asking, ANCHORS, ANCHOR_ROOM, limits=True)
    best = _over_cells(blocks, rows, how, _negatives_of, _NEGATIVES)
    kept = _top(best, ["anchor", "slot"], how.negatives)
    # Slots of an anchor one after the other are descending scores: a suffix is what is left
    # from a window's slot down, and of that a window takes the first ones.
    merged = kept.groupBy("anchor").agg(
        F.sort_array(F.collect_list(F.struct("slot", "rank", "score", "id"))).alias("slots")
    )
    fits = F.filter(
        "slots", lambda s: (s["score"] <= F.col("upper")) & (s["score"] >= F.col("lower"))
    )
    return (
        asked.join(merged, "anchor")
        .withColumn("found", F.slice(fits, 1, how.negatives))
        .select("*", F.posexplode("found").alias("at", "n"))
        .select(
            F.col("anchor").alias("anchor_id"),
            F.col("positive").alias("positive_id"),
            (F.col("at") + 1).cast("int").alias("rank"),
            F.col("n.id").alias("negative_id"),
            "positive_score",
            F.col("n.score").alias("negative_score"),
        )
    )
