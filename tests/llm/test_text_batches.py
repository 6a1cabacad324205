"""Rows with whole texts: few at a time in Python, and not shuffled without need."""

import gc
import tracemalloc
import weakref
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tablemill.llm import bpe, common, toxicity
from tablemill.llm.common import TEXT_ROWS, without, written
from tablemill.llm.queries import word_tokenizer


def test_rows_without_marked_ones(spark):
    rows = [(k % 7 if k % 5 else None, f"t{k}") for k in range(60)]
    frame = spark.createDataFrame(rows, "mark long, text string").repartition(3)
    marked = spark.createDataFrame([(2,), (3,), (3,), (99,)], "mark long")
    left = without(frame, marked, "mark", bits=6)
    assert left.columns == ["mark", "text"]
    assert sorted(left.collect(), key=str) == sorted(
        (r for r in frame.collect() if r.mark not in (2, 3)), key=str
    )
    nobody = marked.where("mark is null")
    assert without(frame, nobody, "mark").count() == len(rows)


def test_only_maybe_toxic_texts_are_shuffled(spark):
    """A row that the bitmap clears reaches the result without an exchange."""
    frame = spark.range(1000).select(F.col("id").alias("mark"), F.lit("t").alias("text"))
    marked = spark.createDataFrame([(2,)], "mark long")
    plan = without(frame, marked, "mark")._jdf.queryExecution().optimizedPlan().toString()
    anti = plan.index("LeftAnti")
    assert plan.startswith("Union") and plan.index("LeftOuter") < anti
    assert "getbit" in plan[anti:]


def test_texts_travel_in_small_batches(spark):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], ["n"])

    frame = spark.range(3 * TEXT_ROWS, numPartitions=1).mapInArrow(sizes, "n long")
    most = [written(frame, "batches", texts=t).agg(F.max("n")).first()[0] for t in (False, True)]
    assert most[1] <= TEXT_ROWS < most[0]


def _run_of(monkeypatch, frame, make):
    """The function that ``make(frame)`` gives its Python workers."""
    kind = type(frame)
    runs, plain = [], kind.mapInArrow
    monkeypatch.setattr(
        kind, "mapInArrow", lambda self, run, schema: (runs.append(run), plain(self, run, schema))[1]
    )
    make(frame)
    return runs[0]


def test_counting_holds_little(spark, monkeypatch):
    """A worker that counts words of long texts holds few counts and small pieces at once."""
    frame = spark.createDataFrame([("a", 0)], "text string, grp int")
    run = _run_of(monkeypatch, frame, toxicity.count_expressions)
    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{n:06x}x" for n in rng.integers(0, 1 << 24, 5000)) for _ in range(120)]
    batches = [
        pa.RecordBatch.from_arrays(
            [pa.array(texts[k : k + 40]), pa.array([0] * 40, pa.int32())], ["text", "grp"]
        )
        for k in range(0, 120, 40)
    ]
    del texts
    found = Counter()
    tracemalloc.start()
    try:
        for out in run(iter(batches)):
            level = out["key"].to_numpy() & 3
            for k in range(3):
                found[k] += int(out["n"].to_numpy()[level == k].sum())
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert set(found.values()) == {600_000}
    assert peak < 60e6


def test_workers_drop_tables_of_other_operators(spark, monkeypatch):
    """The encoder stays for tasks that encode, and goes with the first task that does not."""
    frame = spark.createDataFrame([("Some words", 0)], "text string, grp int")
    encode = _run_of(monkeypatch, frame, lambda f: bpe.round_trip(f, word_tokenizer()))
    monkeypatch.undo()
    count = _run_of(monkeypatch, frame, toxicity.count_expressions)
    made = []

    class Coder(bpe.Coder):
        def __init__(self, vocabulary):
            super().__init__(vocabulary)
            made.append(weakref.ref(self))

    monkeypatch.setattr(bpe, "Coder", Coder)
    batch = pa.RecordBatch.from_arrays(
        [pa.array(["Some words"]), pa.array([0], pa.int32())], ["text", "grp"]
    )
    first, again = (list(encode(iter([batch]))) for _ in range(2))
    assert first == again and len(made) == 1 and made[0]() is not None
    assert sum(out.num_rows for out in count(iter([batch]))) == 6
    gc.collect()
    assert made[0]() is None and not common._held
    assert list(encode(iter([batch]))) == first and len(made) == 2
