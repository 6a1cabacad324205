"""Running jobs: the three steps, dry runs, groups, reports, command line."""

import logging
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tablemill import JobGroups, JobSpec, SpecError, TableJob, run_group, run_job
from tablemill.__main__ import main
from tablemill.session import PROFILE, adopt, build_session, job_session, scratch_uri

TRIPS = {
    "job_name": "trips",
    "sources": {
        "boats": {"type": "query", "query": "SELECT * FROM boats"},
        "trips": {"type": "table", "table": "trips"},
    },
    "query": {
        "sql": "SELECT * FROM boats AS b JOIN trips AS t ON t.boat = b.boat",
        "target_table": "boat_trips",
    },
}


@pytest.fixture
def harbour(spark):
    """Two boats of three have made trips, one trip is of an unknown boat."""
    return {
        "boats": spark.createDataFrame(
            [("a1", "Kelp"), ("a2", "Tern"), ("a3", "Eider")], "boat string, label string"
        ),
        "trips": spark.createDataFrame(
            [("a1", 7.5), ("a3", 0.0), ("a1", 2.25), ("zz", 1.0)], "boat string, miles double"
        ),
    }


def number_job(sql="SELECT n, n % 2 AS odd FROM numbers", **more):
    return JobSpec.from_dict(
        {
            "job_name": "numbers",
            "sources": {"numbers": {"type": "table", "query": "numbers"}},
            "query": {"sql": sql, "target_table": "numbers_out"},
            **more,
        }
    )


@pytest.fixture
def numbers(spark):
    rows = spark.range(100).select(F.when(F.col("id") < 90, F.col("id")).alias("n"))
    return {"numbers": rows}


def test_frames_join_like_tables(spark, harbour):
    job = TableJob(spark, TRIPS, frames=harbour)
    job.extract()
    frame = job.transform()
    assert job.transformed_df is frame and set(job.sources) == {"boats", "trips"}
    # Both sides keep their key under a star.
    assert frame.columns == ["boat", "label", "boat", "miles"]
    assert Counter((r.label, r.miles) for r in frame.collect()) == {
        ("Kelp", 7.5): 1,
        ("Kelp", 2.25): 1,
        ("Eider", 0.0): 1,
    }
    assert spark.table("trips").count() == 4
    for view in ("boats", "trips"):
        spark.catalog.dropTempView(view)


def test_three_steps_show_what_has_no_target(spark, harbour, caplog, capsys):
    untargeted = {**TRIPS, "query": {"sql": "SELECT label FROM boats ORDER BY label"}}
    job = TableJob(spark, untargeted, frames=harbour)
    with caplog.at_level(logging.INFO):
        assert job.run() is None
    shown = capsys.readouterr().out
    assert shown.index("Eider") < shown.index("Kelp") < shown.index("Tern")
    steps = [r.getMessage().split(": ")[1] for r in caplog.records if r.name == "tablemill.runner"]
    assert [s.split()[0] for s in steps] == ["started", "reading", "planning", "loading", "finished"]


def test_a_given_frame_can_be_loaded(spark, tmp_path):
    spec = {"query": {"target_table": "depths/today"}, "mapping": {"m": "metres"}}
    job = TableJob(spark, spec, base_uri=str(tmp_path))
    job.transformed_df = spark.sql("SELECT explode(array(3, 11)) AS m")
    where = job.load()
    assert where == f"{tmp_path}/depths/today/"
    assert sorted(r.metres for r in spark.read.parquet(where).collect()) == [3, 11]


def test_star_join_cannot_be_written(spark, harbour, tmp_path):
    with pytest.raises(SpecError, match="boat"):
        run_job(spark, JobSpec.from_dict(TRIPS), frames=harbour, base_uri=str(tmp_path))


def test_run_writes_and_counts(spark, numbers, tmp_path):
    rules = [{"rule": "not_null", "column": "m"}, {"rule": "min_rows", "floor": 100}]
    spec = number_job(mapping={"n": "m"}, quality=rules)
    done = run_job(spark, spec, frames=numbers, base_uri=str(tmp_path))
    assert done.location == f"{tmp_path}/numbers_out/"
    assert (done.metrics.rows, done.metrics.nulls) == (100, {"m": 10, "odd": 10})
    assert done.metrics.seconds > 0
    assert done.frame.columns == ["m", "odd"] and done.frame.count() == 100
    assert {r["rule"]: r.n_failed for r in done.checks.collect()} == {"not_null": 10, "min_rows": 0}


def test_metrics_of_an_empty_result(spark, numbers, tmp_path):
    spec = number_job("SELECT n FROM numbers WHERE n < 0")
    done = run_job(spark, spec, frames=numbers, base_uri=str(tmp_path))
    assert (done.metrics.rows, done.metrics.nulls) == (0, {"n": 0})


def test_dry_run_does_nothing(spark, numbers, tmp_path):
    broken = number_job("SELECT raise_error('ran') AS x FROM numbers")
    done = run_job(spark, broken, frames=numbers, base_uri=str(tmp_path), dry_run=True)
    assert done.schema.names == ["x"] and "Physical Plan" in done.explain
    assert done.metrics is None and list(tmp_path.iterdir()) == []


def test_run_into_a_catalog_table(spark, numbers):
    spec = number_job(sink={"table": True}, query={"sql": "SELECT n FROM numbers", "target_table": "dm.t"})
    done = run_job(spark, spec, frames=numbers)
    assert done.location == "dm.t" and spark.table("dm.t").count() == 100
    spark.sql("DROP SCHEMA dm CASCADE")


def test_run_dated_partitions(spark, numbers, tmp_path):
    spec = number_job(
        params={"day": {"type": "date", "required": True}},
        sink={"partition_by": "day"},
        quality=[{"rule": "min_rows", "floor": 1}],
    )
    for day, limit in (("2024-01-01", 50), ("2024-01-02", 30), ("2024-01-01", 20)):
        frames = {"numbers": numbers["numbers"].filter(f"n < {limit}")}
        params = {"day": day}
        done = run_job(spark, spec, params=params, frames=frames, base_uri=str(tmp_path))
        assert done.frame.count() == done.metrics.rows == done.checks.collect()[0].n_rows == limit
    counts = spark.read.parquet(done.location).groupBy("day").count().collect()
    assert {str(r.day): r["count"] for r in counts} == {"2024-01-01": 20, "2024-01-02": 30}


def test_run_refuses_to_overwrite_its_input(spark, numbers, tmp_path):
    from tablemill import Connection

    numbers["numbers"].write.parquet(str(tmp_path / "numbers_out"))
    connection = Connection(
        "c", kind="files", base_path=str(tmp_path), tables={"numbers": "numbers_out"}
    )
    spec = number_job(
        sources={"numbers": {"type": "table", "query": "numbers", "connection": "c"}}
    )
    with pytest.raises(SpecError, match="overlaps"):
        run_job(spark, spec, connections={"c": connection}, base_uri=str(tmp_path))


def test_run_without_sql(spark):
    with pytest.raises(SpecError, match="no SQL"):
        run_job(spark, JobSpec.from_dict({"job_name": "x"}))


def test_sessions_do_not_share_views(spark, numbers):
    spark.conf.set("spark.sql.shuffle.partitions", "5")
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        one, two = job_session(spark), job_session(spark)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert one.conf.get("spark.sql.shuffle.partitions") == "5"
    assert one.conf.get("spark.sql.session.timeZone") == "UTC"
    adopt(numbers["numbers"], one).createOrReplaceTempView("only_here")
    assert one.catalog.tableExists("only_here")
    assert not two.catalog.tableExists("only_here")
    assert not spark.catalog.tableExists("only_here")
    assert [t.name for t in spark.catalog.listTables("global_temp") if "tablemill" in t.name] == []


def test_profile_leaves_given_settings_alone(spark):
    key, other = "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.adaptive.enabled"
    spark.conf.set(key, "7MB")
    try:
        build_session()
        assert spark.conf.get(key) == "7MB" and spark.conf.get(other) == "true"
    finally:
        for name in PROFILE:
            if name != "spark.sql.session.timeZone":
                spark.conf.unset(name)


def test_scratch_is_in_the_shared_folder(spark):
    one, two = scratch_uri(spark, "x"), scratch_uri(spark, "x")
    assert one != two and one.startswith(spark.conf.get("spark.checkpoint.dir"))


def test_selections(tmp_path):
    groups = JobGroups.shipped()
    both = ["customer_order_frequency", "customer_sales_summary"]
    assert groups.select("GROUP:customer") == both == groups.select(both)
    assert groups.select(["GROUP:customer", both[0]]) == both
    assert groups.select(both[1]) == both[1:]
    assert groups.listing()["GROUP:customer"] == tuple(both)
    assert set(groups.jobs) < set(groups.listing())
    for wrong in ("GROUP:none", "anything", "", " ", ["anything"], []):
        with pytest.raises(SpecError):
            groups.select(wrong)
    file = tmp_path / "g.yaml"
    for text in ("night: [a, b]", "night: []", "night: a"):
        file.write_text(text)
        with pytest.raises(SpecError):
            JobGroups.load(file, ["a"])
    file.write_text("night: [a]")
    assert JobGroups.load(file, ["a", "b"]).select("GROUP:night") == ["a"]


def test_group_runs_side_by_side(spark, numbers, tmp_path):
    """Jobs that name different sources alike, one of which fails."""
    specs = {
        f"job_{i}": number_job(
            f"SELECT {i} AS i, n FROM numbers WHERE n < {i}",
            query={"sql": f"SELECT {i} AS i, n FROM numbers WHERE n < {i}", "target_table": f"t{i}"},
        )
        for i in range(6)
    }
    specs["bad"] = number_job("SELECT nothing FROM numbers")
    specs["dated"] = number_job(
        params={"day": {"required": True}},
        query={"sql": "SELECT :day AS day", "target_table": "d_{day}"},
    )
    report = run_group(
        spark,
        list(specs),
        params='{"day": "d1"}',
        specs=specs,
        frames=numbers,
        base_uri=str(tmp_path / "out"),
        environment="test",
        report_uri=str(tmp_path / "report"),
    )
    rows = {r.job: r for r in report.collect()}
    assert {j: (r.status, r.n_rows) for j, r in rows.items()} == {
        **{f"job_{i}": ("succeeded", i) for i in range(6)},
        "bad": ("failed", None),
        "dated": ("succeeded", 1),
    }
    assert "nothing" in rows["bad"].error and rows["dated"].target == "d_d1"
    assert {r.environment for r in rows.values()} == {"test"}
    assert len({r.run_id for r in rows.values()}) == 1
    kept = spark.read.parquet(str(tmp_path / "report"))
    assert Counter(r.status for r in kept.collect()) == {"succeeded": 7, "failed": 1}


def test_rules_count_in_a_group(spark, numbers, tmp_path):
    rules = [{"rule": "min_rows", "floor": 1000}, {"rule": "not_null", "column": "odd"}]
    specs = {
        name: number_job(
            query={"sql": "SELECT n, n % 2 AS odd FROM numbers", "target_table": name}, **more
        )
        for name, more in {
            "strict": {"quality": rules, "on_failed_rule": "fail"},
            "lenient": {"quality": rules},
            "without": {},
        }.items()
    }
    report = run_group(spark, list(specs), specs=specs, frames=numbers, base_uri=str(tmp_path))
    assert {r.job: (r.status, r.n_failed_rules, r.n_nulls) for r in report.collect()} == {
        "strict": ("failed_quality", 2, {"n": 10, "odd": 10}),
        "lenient": ("succeeded", 2, {"n": 10, "odd": 10}),
        "without": ("succeeded", None, {"n": 10, "odd": 10}),
    }


def test_errors_are_reported_whole(spark, numbers):
    text = "x" * 5000
    spec = number_job(f"SELECT n, raise_error('{text} end') FROM numbers")
    report = run_group(spark, "numbers", specs={"numbers": spec}, frames=numbers, base_uri="/tmp/none")
    assert f"{text} end" in report.first().error


@pytest.mark.parametrize("table", [False, True])
def test_reads_back_only_its_own_partitions(spark, tmp_path, table):
    """The query itself gives the partition column, null included."""
    rules = [{"rule": "min_rows", "floor": 3}]
    sink = {"partition_by": ["day"], "table": table}
    spec = number_job("SELECT n, day FROM numbers", sink=sink, quality=rules)
    results = []
    for rows in ([(1, "d1"), (2, "d1"), (3, "d2")], [(4, "d2"), (5, None)]):
        frame = spark.createDataFrame(rows, "n int, day string")
        done = run_job(spark, spec, frames={"numbers": frame}, base_uri=str(tmp_path))
        results.append(done.failed_rules())
        assert Counter(map(tuple, done.frame.select("n", "day").collect())) == Counter(rows)
        assert done.checks.first().n_rows == len(rows) == done.metrics.rows
    assert results == [0, 1]
    spark.sql("DROP TABLE IF EXISTS numbers_out")


def test_group_needs_known_names(spark):
    with pytest.raises(SpecError):
        run_group(spark, "GROUP:none")
    with pytest.raises(SpecError, match="colour"):
        run_group(spark, "GROUP:product", params={"colour": "red"})


@pytest.fixture
def unstopped(spark, monkeypatch):
    """The command line ends its session; the tests share one."""
    monkeypatch.setattr("tablemill.__main__.build_session", lambda **_: spark)
    monkeypatch.setattr(type(spark), "stop", lambda self: None)


def test_command_line(spark, unstopped, tmp_path, capsys):
    conf = tmp_path / "c.yaml"
    conf.write_text("stock: {kind: files, tables: {products: products}}")
    spark.createDataFrame(
        [(1, "pen", "office", 3)],
        "product_id int, product_name string, category string, stock_quantity int",
    ).write.parquet(str(tmp_path / "in" / "products"))
    common = [
        "--connections", str(conf), "--base-path", str(tmp_path / "in"),
        "--base-uri", str(tmp_path / "out"), "--params", '{"report_date": "2024-08-01"}',
    ]
    job = "product_inventory_report"
    assert main(["--select", job, "--dry-run", *common]) == 0
    assert not (tmp_path / "out").exists()
    assert main(["--select", job, "--report-uri", str(tmp_path / "rep"), *common]) == 0
    written = spark.read.parquet(str(tmp_path / "out" / f"{job}_2024-08-01"))
    assert [r.stock_alert_level for r in written.collect()] == ["Critical"]
    from tablemill.plans import JOBS_DIR

    path = str(JOBS_DIR / f"{job}.yaml")
    assert main([path, "--dry-run", *common]) == 0
    assert "Physical Plan" in capsys.readouterr().out
    assert main([path, *common, "--report-uri", str(tmp_path / "rep")]) == 0
    assert spark.read.parquet(str(tmp_path / "rep")).count() == 2
    assert main([path, "--params", "{"]) == 2
    assert main(["--select", "customer_sales_summary", "--retries", "0"]) == 1


def test_own_jobs_on_the_command_line(spark, unstopped, tmp_path):
    spark.range(4).createOrReplaceGlobalTempView("four")
    jobs = tmp_path / "jobs"
    jobs.mkdir()
    body = """
sources: {t: {type: query, query: SELECT id FROM global_temp.four}}
query: {target_table: NAME, sql: SELECT id FROM t}
quality: [{rule: min_rows, floor: FLOOR}]
on_failed_rule: fail
"""
    for name, floor in (("north", 4), ("south", 5)):
        text = body.replace("NAME", name).replace("FLOOR", str(floor))
        (jobs / f"{name}.yaml").write_text(f"job_name: {name}\n{text}")
    (jobs / "groups.yaml").write_text("coast: [north, south]")
    call = ["--jobs-dir", str(jobs), "--base-uri", str(tmp_path / "out"), "--max-wait", "1", "--strict"]
    assert main(["--select", "north", *call]) == 0
    assert main(["--select", "GROUP:coast", *call]) == 1
    assert spark.read.parquet(str(tmp_path / "out" / "south")).count() == 4
    assert main(["--select", "GROUP:all", *call]) == 2
    assert main(["--select", "north", "--jobs-dir", str(tmp_path / "none")]) == 2
    spark.catalog.dropGlobalTempView("four")


def test_command_line_errors_before_spark(monkeypatch, tmp_path, capsys):
    monkeypatch.setattr("tablemill.__main__.build_session", lambda **_: pytest.fail("started"))
    assert main([str(tmp_path / "none.yaml")]) == 2
    assert main(["--select", "GROUP:none"]) == 2
    assert main(["--list"]) == 0
    assert "GROUP:all" in capsys.readouterr().out
    with pytest.raises(SystemExit):
        main([])


RULES = [
    {"rule": "not_null", "column": "n"},
    {"rule": "in_range", "column": "n", "high": 2},
    {"rule": "unique_key", "column": "odd"},
    {"rule": "min_rows", "floor": 1000},
]


def test_rules_are_checked_without_a_sink(spark, numbers):
    spec = number_job(quality=RULES, on_failed_rule="fail")
    done = run_job(spark, spec, frames=numbers)
    assert done.location is None and done.fails_on_rules
    failed = {r["rule"] for r in done.checks.collect() if not r.passed}
    assert "min_rows" in failed and done.failed_rules() == len(failed)
    report = run_group(spark, ["numbers"], specs={"numbers": spec}, frames=numbers).first()
    assert (report.status, report.n_failed_rules) == ("failed_quality", len(failed))


def test_rows_that_break_a_rule_are_set_aside(spark, numbers, tmp_path):
    spec = number_job(quality=RULES, quarantine="rejects/numbers")
    done = run_job(spark, spec, frames=numbers, base_uri=str(tmp_path))
    rows = done.frame.collect()
    by_odd = Counter(r.odd for r in rows)
    expected = Counter(
        (r.n, r.odd, rules)
        for r in rows
        for rules in [
            tuple(
                name
                for name, broken in (
                    ("not_null(n)", r.n is None),
                    ("in_range(n)", r.n is not None and r.n > 2),
                    ("unique_key(odd)", r.odd is not None and by_odd[r.odd] > 1),
                )
                if broken
            )
        ]
        if rules
    )
    assert expected and Counter((r.n, r.odd, tuple(r.failed_rules)) for r in done.quarantined.collect()) == expected
    assert (tmp_path / "rejects" / "numbers").is_dir()
    # The result itself keeps all rows; a run that breaks nothing sets nothing aside.
    assert len(rows) == numbers["numbers"].count()
    clean = number_job(quality=RULES[-1:], quarantine="none")
    done = run_job(spark, clean, frames=numbers, base_uri=str(tmp_path))
    assert done.quarantined is None and done.failed_rules() == 1 and not (tmp_path / "none").exists()


def test_quarantine_needs_rules():
    with pytest.raises(SpecError, match="quarantine"):
        number_job(quarantine="rejects")
