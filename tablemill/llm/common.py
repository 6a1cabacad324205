"""What the text operators share: folds, scratch tables, and kernels over text columns."""

from __future__ import annotations

import gc
import tempfile
import zipfile
from collections.abc import Callable, Hashable, Iterator, Sequence
from pathlib import Path
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import scratch_uri, settings_for
from .text import PIECE_BYTES, Piece, add_counts, pieces

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WORD = r"[^\x20\x09-\x0D]+"
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
# Rows with whole texts that a task and its Python worker hold at once, twice each.
TEXT_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: Column | str, folds: int = 5) -> Column:
    """crc32(doc_id as text) mod ``folds``; null for a null id."""
    doc_id = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, UPPER, UPPER.lower())


def written(frame: DataFrame, purpose: str, texts: bool = False) -> DataFrame:
    """The frame, written to the folder all executors share and read back.

    This cuts the lineage, survives lost executors, and keeps a result that is
    used twice from being computed twice. The shuffle files of the write go at its
    end; otherwise they would stay until the driver happens to collect its garbage.
    With ``texts`` Python gets ``TEXT_ROWS`` rows at a time, as whole texts are long.
    """
    spark = frame.sparkSession
    uri = scratch_uri(spark, purpose)
    settings = {SHUFFLE_CLEANUP: "true"}
    if texts:
        rows = int(spark.conf.get(ARROW_ROWS, "10000"))
        settings[ARROW_ROWS] = str(min(rows, TEXT_ROWS) if rows > 0 else TEXT_ROWS)
    with settings_for(spark, settings):
        frame.write.parquet(uri)
    return spark.read.schema(frame.schema).parquet(uri)


def collected(frame: DataFrame):
    """The frame as an Arrow table on the driver, for results of a proven size; frees its shuffles."""
    with settings_for(frame.sparkSession, {SHUFFLE_CLEANUP: "true"}):
        # Spark takes the setting from when a frame is made.
        return frame.select("*").toArrow()


def _bitmap(marked: DataFrame, key: str, bits: int) -> tuple[str, str, DataFrame]:
    """Place and bit of a key in a bitmap, and the cells of those of ``marked``."""
    place = f"pmod(xxhash64({key}), {1 << bits})"
    bit = f"cast({place} % 64 as int)"
    cells = marked.groupBy(F.expr(f"{place} div 64").alias("__cell")).agg(
        F.bit_or(F.expr(f"shiftleft(1L, {bit})")).alias("__bits")
    )
    return place, bit, cells


def maybe_among(frame: DataFrame, marked: DataFrame, key: str, bits: int = 26) -> DataFrame:
    """Rows of ``frame`` without most of those whose ``key`` (a long) ``marked`` lacks.

    A bitmap of ``2 ** bits`` places is sent (16 bytes for 64 of them), whatever the
    sizes of the frames; no row whose key is in ``marked`` is lost.
    """
    place, bit, cells = _bitmap(marked, key, bits)
    kept = frame.withColumn("__cell", F.expr(f"{place} div 64")).join(F.broadcast(cells), "__cell")
    return kept.where(f"getbit(__bits, {bit}) = 1").select(*frame.columns)


def split_by(
    frame: DataFrame, marked: DataFrame, key: str, bits: int = 26
) -> tuple[DataFrame, DataFrame]:
    """Rows of ``frame`` whose ``key`` (a long) ``marked`` surely lacks, and all others.

    The bitmap of ``maybe_among`` clears most rows if ``marked`` is small.
    """
    place, bit, cells = _bitmap(marked, key, bits)
    asked = frame.withColumn("__cell", F.expr(f"{place} div 64")).join(
        F.broadcast(cells), "__cell", "left"
    )
    hit = f"coalesce(getbit(__bits, {bit}), 0) = 1"
    clear, maybe = (asked.where(x).select(*frame.columns) for x in (f"not ({hit})", hit))
    return clear, maybe


def without(frame: DataFrame, marked: DataFrame, key: str, bits: int = 26) -> DataFrame:
    """Rows of ``frame`` whose ``key`` (a long) ``marked`` lacks.

    Rows that the bitmap clears stay where they are; only the others are shuffled
    to be compared.
    """
    clear, maybe = split_by(frame, marked, key, bits)
    return clear.unionByName(maybe.join(marked, key, "left_anti"))


_held: dict[Hashable, Any] = {}
_asked: set[Hashable] = set()


def held(key: Hashable, make: Callable[[], Any]) -> Any:
    """What ``make`` gives, which the worker keeps for later tasks whose kernels ask for it."""
    _asked.add(key)
    if key not in _held:
        _held.clear()
        _held[key] = make()
    return _held[key]


def made(make_kernel: Callable, *args) -> Callable:
    """A kernel of a task; what the worker holds for other kernels goes.

    Workers outlive the operators they work for, so their tables would add up.
    """
    _asked.clear()
    kernel = make_kernel(*args)
    if gone := _held.keys() - _asked:
        for key in gone:
            del _held[key]
        gc.collect()
    return kernel


def with_text_results(
    frame: DataFrame,
    text: str,
    fields: Sequence[T.StructField],
    make_kernel: Callable[..., Callable[[Piece], Sequence]],
    drop_text: bool = True,
    beside: str | None = None,
    size: int = PIECE_BYTES,
) -> DataFrame:
    """Add columns that a kernel computes from whole texts; rows and other columns stay.

    ``make_kernel`` runs once per task; its result turns a Piece into one array
    (or list) per field, with an entry per row. With ``beside`` it runs once per
    batch and gets the batch's values of that column. Pieces have about ``size`` bytes.
    Columns travel by place, so names that clash with the new ones, or differ in case
    only, do no harm; the caller gets the new columns last.
    """
    names = frame.columns
    at = names.index(text)
    other = names.index(beside) if beside is not None else at
    kept = [i for i in range(len(names)) if not (drop_text and i == at)]
    boxed = frame.toDF(*(f"c{i}" for i in range(len(names))))
    schema = T.StructType(
        [boxed.schema[i] for i in kept]
        + [T.StructField(f"new{k}", f.dataType, f.nullable) for k, f in enumerate(fields)]
    )
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kernel = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if beside is not None:
                kernel = made(make_kernel, np.array(batch.column(other).to_pylist(), object))
            kernel = kernel or made(make_kernel)
            parts = [kernel(piece) for piece in pieces(batch.column(at), size)]
            new = []
            for k, field in enumerate(fields):
                kind = arrow.field(len(kept) + k).type
                new.append(
                    pa.concat_arrays([pa.array(part[k], kind) for part in parts])
                )
            columns = [batch.column(i).cast(arrow.field(j).type) for j, i in enumerate(kept)]
            yield pa.RecordBatch.from_arrays(columns + new, schema=arrow)

    out = boxed.mapInArrow(run, schema)
    return out.toDF(*[names[i] for i in kept], *[f.name for f in fields])


def counted(
    frame: DataFrame,
    key: T.DataType,
    make_kernel: Callable[[], Callable],
    flush_at: int = 1 << 21,
    group: T.DataType | None = None,
    extra: T.DataType | None = None,
) -> DataFrame:
    """Sum counts by key over a whole table, combining within tasks first.

    The kernel turns an Arrow batch into ``[(group, keys, counts), ...]``; the
    frame returned has columns grp, key, n with one row per group and key. With
    ``extra`` the kernel adds an array of values that depend on the key alone,
    which become a column of that name.
    """
    fields = [
        T.StructField("grp", group or T.IntegerType()),
        T.StructField("key", key),
        T.StructField("n", T.LongType()),
    ]
    if extra:
        fields.append(T.StructField("extra", extra))
    schema = T.StructType(fields)
    arrow = to_arrow_schema(schema)

    def emit(value, *columns):
        for start in range(0, len(columns[0]), 1 << 16):
            part = [column[start : start + (1 << 16)] for column in columns]
            yield pa.RecordBatch.from_arrays(
                [pa.repeat(pa.scalar(value, arrow.field(0).type), len(part[0]))]
                + [pa.array(c, arrow.field(i + 1).type) for i, c in enumerate(part)],
                schema=arrow,
            )

    def run(batches):
        kernel, waiting = made(make_kernel), {}
        for batch in batches:
            for value, *columns in kernel(batch):
                held = waiting.setdefault(value, [])
                held.append(columns)
                if sum(len(c[0]) for c in held) > flush_at:
                    merged = add_counts(*zip(*held, strict=True))
                    waiting[value] = [merged]
                    if len(merged[0]) > flush_at // 2:
                        yield from emit(value, *merged)
                        del waiting[value]
        for value, held in waiting.items():
            yield from emit(value, *add_counts(*zip(*held, strict=True)))

    sums = [F.sum("n").alias("n")] + ([F.min("extra").alias("extra")] if extra else [])
    return frame.mapInArrow(run, schema).groupBy("grp", "key").agg(*sums)


def ship(spark: SparkSession) -> None:
    """Give executors this package, once per application, if it was not submitted with it."""
    context = spark.sparkContext
    if getattr(context, "_tablemill_shipped", False):
        return
    package = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp(prefix="tablemill-code-")) / "tablemill_code.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted(package.rglob("*.py")):
            out.write(file, file.relative_to(package.parent))
    # Spark copies it to every executor, now and to those that come later.
    context.addPyFile(str(archive))
    context._tablemill_shipped = True


def like_before(result: DataFrame, docs: DataFrame, where: str | None = None) -> DataFrame:
    """The first columns of ``result``, named as in ``docs``; ``where`` may use new0, new1, ..."""
    n = len(docs.columns)
    names = [f"c{i}" if i < n else f"new{i - n}" for i in range(len(result.columns))]
    boxed = result.toDF(*names)
    if where:
        boxed = boxed.where(where)
    return boxed.select(*names[:n]).toDF(*docs.columns)
