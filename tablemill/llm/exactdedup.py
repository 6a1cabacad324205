"""Exact duplicates by a sorted corpus: equal texts become neighbours and are compared in full.

Sampled splitters deal the rows out by range of (first bytes of the normalised
text, its hash, id); the id lets a splitter cut through a group of copies, so
no group has to fit one task. Each range is sorted externally by Spark and read
as a stream in which every text is compared with the one before it. Groups
that reach over the edge of a range, at most two per range, are joined by a
second comparison of their texts.

Rows: null counts as the empty text. Of equal texts the row with the largest id
stays; a null id is smaller than any other. Of rows that also share the id,
one stays. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import lower_ascii, written

HEAD_CHARS = 32

_SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("range", T.IntegerType()),
        T.StructField("run", T.LongType()),
        T.StructField("first", T.BooleanType()),
        T.StructField("keep_id", T.LongType()),
        T.StructField("group_size", T.LongType()),
        T.StructField("text_sha256", T.StringType()),
        T.StructField("edge", T.BooleanType()),
        T.StructField("edge_text", T.StringType()),
    ]
)
_ARROW = to_arrow_schema(_SCHEMA)


def _neighbours(batches):
    """Runs of equal texts in one sorted range, with the runs at its edges marked.

    A run is held until its last row is known: its ids, not its text. The runs
    that share head and hash with the first or last row are the ones that may
    go on in the next range.
    """
    context = TaskContext.get()
    here = context.partitionId() if context else 0
    block: list = []  # runs of the head and hash now being read: [ids, text, sha]
    mark = None
    number = 0
    first_block = True

    def flush(edge: bool):
        nonlocal number
        for ids, text, sha in block:
            column = pa.concat_arrays(ids)
            n = len(column)
            first = np.zeros(n, bool)
            first[0] = True
            texts = pa.array([text if edge else None], pa.string())
            if n > 1:
                texts = pa.concat_arrays([texts, pa.nulls(n - 1, pa.string())])
            yield pa.RecordBatch.from_arrays(
                [
                    column,
                    pa.array(np.full(n, here, np.int32)),
                    pa.array(np.full(n, number, np.int64)),
                    pa.array(first),
                    pa.array([column[0].as_py()] * n, pa.int64()),
                    pa.array(np.full(n, n, np.int64)),
                    pa.array([sha] * n, pa.string()),
                    pa.array(np.full(n, edge)),
                    texts,
                ],
                schema=_ARROW,
            )
            number += 1
        block.clear()

    def grouped(frames, size=4096):
        """Fewer, larger batches."""
        held, rows = [], 0
        for frame in frames:
            held.append(frame)
            rows += frame.num_rows
            if rows >= size:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, rows = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    def read():
        nonlocal mark, first_block
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            ids, text, head, hashed, sha = (batch.column(i) for i in range(5))
            new = np.ones(n, bool)
            if n > 1:
                same = pc.equal(text.slice(1), text.slice(0, n - 1))
                new[1:] = ~same.to_numpy(zero_copy_only=False)
            if block:
                new[0] = text[0].as_py() != block[-1][1]
            heads = np.flatnonzero(new)
            if not len(heads) or heads[0]:
                stop = heads[0] if len(heads) else n
                block[-1][0].append(ids.slice(0, stop))
            for start, stop in zip(heads, [*heads[1:], n], strict=True):
                at = (head[start].as_py(), hashed[start].as_py())
                if at != mark:
                    if mark is not None:
                        yield from flush(first_block)
                        first_block = False
                    mark = at
                block.append(
                    [[ids.slice(start, stop - start)], text[start].as_py(), sha[start].as_py()]
                )
        yield from flush(True)

    yield from grouped(read())


def duplicates(docs: DataFrame, doc_id: str = "doc_id", text: Column | str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    spark = docs.sparkSession
    text = F.col(text) if isinstance(text, str) else text
    normal = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"),
        lower_ascii(F.coalesce(text, F.lit(""))).alias("norm"),
    ).select(
        "doc_id",
        "norm",
        F.substring("norm", 1, HEAD_CHARS).alias("head"),
        F.xxhash64("norm").alias("mark"),
    )
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = (
        normal.repartitionByRange(ranges, "head", "mark", F.desc_nulls_last("doc_id"))
        .sortWithinPartitions("head", "mark", "norm", F.desc_nulls_last("doc_id"))
        .withColumn("sha", F.sha2("norm", 256))
    )
    runs = written(dealt.mapInArrow(_neighbours, _SCHEMA), "content-sort")
    # Edge runs: at most two heads per range, their rows spread over the ranges.
    edges = (
        runs.where("edge and first")
        .groupBy(F.col("edge_text").alias("_text"))
        .agg(
            F.max("keep_id").alias("all_keep"),
            F.sum("group_size").alias("all_size"),
            F.max_by("range", F.struct("keep_id", -F.col("range"))).alias("winner"),
            F.collect_list(F.struct("range", "run")).alias("parts"),
        )
        .select("all_keep", "all_size", "winner", F.explode("parts").alias("part"))
        .select("all_keep", "all_size", "winner", "part.range", "part.run")
    )
    whole = runs.where("not edge").select(
        "doc_id", "keep_id", "group_size", F.col("first").alias("kept"), "text_sha256"
    )
    cut = (
        runs.where("edge")
        .join(edges, ["range", "run"])
        .select(
            "doc_id",
            F.col("all_keep").alias("keep_id"),
            F.col("all_size").alias("group_size"),
            (F.col("first") & (F.col("winner") == F.col("range"))).alias("kept"),
            "text_sha256",
        )
    )
    return whole.unionByName(cut)
