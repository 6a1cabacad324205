"""Sinks, written and read back."""

import os
import threading
import time
from collections import Counter
from concurrent.futures import ThreadPoolExecutor
from pathlib import Path

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from tablemill import Connection, JobSpec, SinkSpec, SpecError, run_job, sinks, steps
from tablemill.sources import SourceReader


def bag(frame):
    return Counter(map(tuple, frame.collect()))


def test_load_renames_and_writes(spark, tmp_path):
    frame = spark.sql("SELECT 'kelp' AS plant, 2.5D AS metres UNION ALL SELECT 'dulse', NULL")
    where = steps.load(frame, {"metres": "length"}, "plants/north", str(tmp_path))
    written = spark.read.parquet(where)
    assert where == f"{tmp_path}/plants/north/" and written.columns == ["plant", "length"]
    assert bag(written) == {("kelp", 2.5): 1, ("dulse", None): 1}


@pytest.mark.parametrize("target, base", [(None, "/x"), ("t", None), (None, None), ("", "/x")])
def test_preview_when_there_is_nowhere_to_write(spark, capsys, target, base):
    assert steps.load(spark.range(30).toDF("n"), {"n": "m"}, target, base) is None
    out = capsys.readouterr().out
    assert "|m " in out and "|19 " in out and "|20 " not in out


@pytest.mark.parametrize("mode", ["auto", "staged", "direct"])
def test_overwrite_replaces_everything(spark, tmp_path, mode):
    sink = SinkSpec(mode=mode)
    for n in (50, 3):
        where = sinks.write_parquet(spark.range(n), str(tmp_path), "nested/t", sink)
    assert spark.read.parquet(where).count() == 3
    assert os.listdir(tmp_path / "nested") == ["t"]
    staging = tmp_path / ".staging"
    assert not staging.exists() or [f for f in os.listdir(staging) if f[0] != "."] == []


def test_a_failed_staged_write_keeps_the_old_output(spark, tmp_path):
    where = sinks.write_parquet(spark.range(3), str(tmp_path), "t")
    broken = spark.range(10).select(F.when(F.col("id") > 5, F.raise_error(F.lit("boom"))).alias("x"))
    with pytest.raises(Exception, match="boom"):
        sinks.write_parquet(broken, str(tmp_path), "t")
    assert spark.read.parquet(where).count() == 3


def test_target_must_not_be_an_input(spark, tmp_path):
    base = str(tmp_path)
    where = sinks.write_parquet(spark.range(3), base, "t")
    frame = spark.read.parquet(where)
    for inputs in ([where], [f"file://{where}"], [base], [f"{where}part=1"]):
        with pytest.raises(SpecError, match="overlaps"):
            sinks.write_parquet(frame, base, "t", inputs=inputs)
    sinks.write_parquet(frame, base, "t2", inputs=[where])


@pytest.mark.parametrize("target", ["../t", "/t", "a//b", ".hidden", "t;x", "a/../b", ""])
def test_targets_stay_below_the_base(spark, tmp_path, target):
    with pytest.raises(SpecError):
        sinks.write_parquet(spark.range(1), str(tmp_path), target)


def test_repeated_columns_fail_before_the_write(spark, tmp_path):
    frame = spark.range(1).selectExpr("id AS a", "id AS A")
    with pytest.raises(SpecError, match="more than once"):
        sinks.write_parquet(frame, str(tmp_path), "t")
    assert not (tmp_path / "t").exists()


def test_only_written_partitions_are_replaced(spark, tmp_path):
    sink = SinkSpec(partition_by=("day",))
    for day, n in (("d1", 4), ("d2", 5), ("d1", 2)):
        frame = spark.range(n).withColumn("day", F.lit(day))
        where = sinks.write_parquet(frame, str(tmp_path), "t", sink)
    counts = spark.read.parquet(where).groupBy("day").count()
    assert bag(counts) == {("d1", 2): 1, ("d2", 5): 1}
    with pytest.raises(SpecError):
        sinks.write_parquet(spark.range(1), str(tmp_path), "t", sink)


def test_namespaces_and_tables(spark):
    assert not sinks.namespace_exists(spark, "mart")
    where = steps.load(spark.range(3), {"id": "n"}, "mart.numbers", sink=SinkSpec(table=True))
    assert where == "mart.numbers" and sinks.namespace_exists(spark, "mart")
    assert sinks.ensure_namespace(spark, "mart") is False
    sinks.write_table(spark.range(2), "mart.numbers")
    assert spark.table("mart.numbers").count() == 2
    for name in ("mart; DROP SCHEMA mart", "1mart", "a.b.c.d"):
        with pytest.raises(SpecError):
            sinks.write_table(spark.range(1), name)
        with pytest.raises(SpecError):
            sinks.ensure_namespace(spark, name)
    spark.sql("DROP SCHEMA mart CASCADE")


def test_new_namespace_at_a_location(spark, tmp_path):
    assert sinks.ensure_namespace(spark, "placed", str(tmp_path / "it's here"))
    sinks.write_table(spark.range(2), "placed.t")
    assert (tmp_path / "it's here" / "t").exists()
    spark.sql("DROP SCHEMA placed CASCADE")


def test_partitions_of_a_table(spark):
    sink = SinkSpec(table=True, partition_by=("day",))
    for day, n in (("d1", 4), ("d2", 5), ("d1", 2)):
        frame = spark.range(n).select(F.lit(day).alias("day"), "id")
        sinks.write_table(frame, "parts.t", sink)
    counts = spark.table("parts.t").groupBy("day").count()
    assert bag(counts) == {("d1", 2): 1, ("d2", 5): 1}
    assert spark.conf.get("spark.sql.sources.partitionOverwriteMode", None) is None
    for columns in (("id",), ("id", "day", "more")):
        wrong = spark.range(1).select(*[F.lit(1).alias(c) for c in columns])
        with pytest.raises(SpecError):
            sinks.write_table(wrong, "parts.t", sink)
    spark.sql("DROP SCHEMA parts CASCADE")


VERSIONED = SinkSpec(mode="versioned", keep=2)


def numbers(spark, version, rows=200):
    return spark.range(rows).select("id", F.lit(version).alias("version"))


def test_a_reader_always_finds_one_whole_version(spark, tmp_path):
    base, target = str(tmp_path), str(tmp_path / "tide")
    with pytest.raises(FileNotFoundError):
        sinks.read_version(spark, target)
    sinks.write_parquet(numbers(spark, 0), base, "tide", VERSIONED)
    stop, seen = threading.Event(), []

    def read():
        while not stop.is_set():
            seen.append({tuple(r) for r in sinks.read_version(spark, target).groupBy("version").count().collect()})

    with ThreadPoolExecutor(1) as pool:
        reading = pool.submit(read)
        for version in range(1, 5):
            done = len(seen)
            sinks.write_parquet(numbers(spark, version), base, "tide", SinkSpec(mode="versioned", keep=9))
            while len(seen) < done + 2 and not reading.done():
                time.sleep(0.05)
        stop.set()
        reading.result()
    assert all(len(found) == 1 and {n for _, n in found} == {200} for found in seen)
    order = [v for found in seen for v, _ in found]
    assert order == sorted(order) and order[-1] == 4


def test_a_failed_write_leaves_the_old_version(spark, tmp_path):
    base, target = str(tmp_path), str(tmp_path / "tide")
    for version in (1, 2, 3):
        where = sinks.write_parquet(numbers(spark, version), base, "tide", VERSIONED)
    assert Path(where) == Path(sinks.newest_version(spark, target).removeprefix("file:"))
    folders = sorted((tmp_path / "tide" / "_versions").iterdir())
    assert len(folders) == 2
    broken = numbers(spark, 4).withColumn("id", F.expr("if(id = 150, raise_error('no tide'), id)"))
    with pytest.raises(Exception, match="no tide"):
        sinks.write_parquet(broken, base, "tide", VERSIONED)
    # What a killed writer leaves: files without the mark.
    numbers(spark, 9).write.parquet(str(tmp_path / "tide" / "_versions" / f"v{'7':0>12}-{'a' * 32}"))
    assert {r.version for r in sinks.read_version(spark, target).collect()} == {3}
    for version in (10, 11):
        sinks.write_parquet(numbers(spark, version), base, "tide", VERSIONED)
    left = [f.name[:13] for f in sorted((tmp_path / "tide" / "_versions").iterdir())]
    assert left == ["v000000000008", "v000000000009"]
    # The target itself is no Parquet folder, so versions are never mixed.
    with pytest.raises(AnalysisException):
        spark.read.parquet(target)


def test_a_job_writes_and_another_reads_versions(spark, tmp_path):
    spec = {
        "job_name": "tide",
        "sources": {"levels": {"type": "table", "table": "levels"}},
        "query": {"sql": "SELECT id FROM levels", "target_table": "tide"},
        "sink": {"mode": "versioned"},
        "quality": [{"rule": "min_rows", "floor": 8}],
    }
    for rows in (5, 9):
        frames = {"levels": spark.range(rows)}
        done = run_job(spark, JobSpec.from_dict(spec), frames=frames, base_uri=str(tmp_path))
        assert done.frame.count() == done.metrics.rows == rows and done.failed_rules() == (rows < 8)
    connection = Connection(
        "out", kind="files", base_path=str(tmp_path), tables={"tide": "tide"}, versioned=True
    )
    assert SourceReader(spark, {"out": connection}).table("tide", "out").count() == 9


@pytest.mark.parametrize("more", [{"partition_by": "id"}, {"table": True}, {"keep": 0}, {"keep": "2"}])
def test_versions_are_whole_outputs(more):
    with pytest.raises(SpecError):
        SinkSpec.from_dict({"mode": "versioned", **more})
