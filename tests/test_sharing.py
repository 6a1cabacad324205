"""Sources that several jobs of a group read: one copy, the same results."""

import logging
import sys
from collections import Counter
from pathlib import Path

import pytest
from pyspark import cloudpickle
from pyspark.sql.datasource import DataSource, DataSourceReader

from tablemill import Connection, JobSpec, run_group, run_job
from tablemill.session import SHARE_FROM_BYTES_KEY, job_session, plan_text
from tablemill.sharing import Shared, plan_sharing

# Executors do not have this file.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

VIEW = """SELECT c.catch_id, c.boat, b.home AS port, c.kind, c.kilos, c.note
          FROM catches AS c JOIN boats AS b ON b.boat = c.boat"""


def job(name, sql, source="SELECT * FROM landed", **more):
    return JobSpec.from_dict(
        {
            "job_name": name,
            "sources": {"rows": {"type": "query", "query": source, "connection": "harbour"}},
            "query": {"sql": sql, "target_table": name},
            **more,
        }
    )


JOBS = {
    "by_port": job(
        "by_port",
        "SELECT port, SUM(kilos) AS kilos FROM rows WHERE kind = 'cod' AND kilos > 2 GROUP BY port",
    ),
    "by_boat": job(
        "by_boat",
        "SELECT boat, COUNT(*) AS n FROM rows AS r GROUP BY boat",
        "SELECT boat, catch_id FROM landed AS l WHERE l.kind IN ('eel', 'ray') AND l.boat <> 'b''3'",
    ),
}


@pytest.fixture
def harbour(spark, tmp_path):
    kinds = ["cod", "eel", "ray", "ling", None]
    catches = [(i, f"b'{i % 7}", kinds[i % 5], i * 0.25, f"note {i}") for i in range(500)]
    spark.createDataFrame(
        catches, "catch_id long, boat string, kind string, kilos double, note string"
    ).write.parquet(str(tmp_path / "catches"))
    boats = spark.createDataFrame([(f"b'{i}", f"p{i % 2}") for i in range(6)], "boat string, home string")
    boats.write.parquet(str(tmp_path / "boats"))
    connection = Connection(
        "harbour",
        kind="files",
        base_path=str(tmp_path),
        tables={"catches": "catches", "boats": "boats"},
        views={"landed": VIEW, "plain": "SELECT * FROM catches"},
    )
    return {"harbour": connection}


@pytest.fixture
def session(spark):
    session = job_session(spark)
    session.conf.set(SHARE_FROM_BYTES_KEY, "0")
    return session


def opener(session, specs, connections):
    from tablemill.runner import _open

    def opened(name, shared=None):
        return _open(session, specs[name], connections=connections, shared=shared)

    jobs = {name: opened(name) for name in specs}
    for one in jobs.values():
        one.extract()
    return jobs, opened


def bag(frame):
    return Counter(map(tuple, frame.collect()))


def test_a_copy_holds_what_the_jobs_read(session, harbour):
    jobs, opened = opener(session, JOBS, harbour)
    (one,) = plan_sharing(session, jobs, opened)
    assert one.key == ("harbour", "landed") and one.users == ("by_port", "by_boat")
    assert one.rows.columns == ["boat", "port", "kind", "kilos"]
    whole = jobs["by_port"].reader.computed[one.key]
    wanted = whole.where("(kind = 'cod' AND kilos > 2) OR (kind IN ('eel', 'ray') AND boat <> \"b'3\")")
    assert bag(one.rows) == bag(wanted.select(one.rows.columns)) and 0 < one.rows.count() < whole.count()
    copies = {one.key: one.write()}
    for name in JOBS:
        before, after = jobs[name].plan(), opened(name, copies).plan()
        assert bag(before) == bag(after) and after.schema == before.schema
        assert "Join" in plan_text(before) and "Join" not in plan_text(after)
        assert {Path(f).parent.name for f in after.inputFiles()} == {copies[one.key].uri.split("/")[-1]}
    assert copies[one.key].open(session).where("note IS NOT NULL").isEmpty()


@pytest.mark.parametrize(
    "sql",
    [
        "SELECT boat FROM rows WHERE kilos > (SELECT AVG(LENGTH(note)) FROM rows)",
        "SELECT x, x + 1 AS y FROM (SELECT kilos AS x, note AS kilos FROM rows)",
        "SELECT COUNT(*) AS n FROM rows",
        "SELECT a.note FROM rows AS a JOIN rows AS b ON a.catch_id = b.catch_id + 1 WHERE b.kind = 'cod'",
        "SELECT kind FROM rows WHERE kilos > 10 AND kind IS NULL",
        "SELECT boat, kilos FROM rows WHERE boat NOT IN (SELECT boat FROM rows WHERE kind = 'ray')",
    ],
)
def test_any_query_over_a_copy(session, harbour, sql):
    specs = {"any": job("any", sql), **JOBS}
    jobs, opened = opener(session, specs, harbour)
    copies = {one.key: one.write() for one in plan_sharing(session, jobs, opened)}
    assert len(copies) == 1
    for name in specs:
        assert bag(jobs[name].plan()) == bag(opened(name, copies).plan())


def test_what_is_not_shared(spark, session, harbour):
    plain = {n: job(n, "SELECT boat FROM rows", "SELECT * FROM plain") for n in ("a", "b")}
    assert plan_sharing(session, *opener(session, plain, harbour)) == []
    alone = {"by_port": JOBS["by_port"], "a": plain["a"]}
    assert plan_sharing(session, *opener(session, alone, harbour)) == []
    for least in ("-1", None, str(10**9)):
        session.conf.unset(SHARE_FROM_BYTES_KEY)
        if least:
            session.conf.set(SHARE_FROM_BYTES_KEY, least)
        assert plan_sharing(session, *opener(session, JOBS, harbour)) == []


def test_parents_of_rules_are_read_whole(session, harbour, tmp_path):
    rule = {"rule": "orphan_key", "columns": ["boat"], "parent": "rows", "parent_columns": ["note"]}
    specs = {**JOBS, "checked": job("checked", "SELECT boat FROM rows WHERE kilos > 100", quality=[rule])}
    (one,) = plan_sharing(session, *opener(session, specs, harbour))
    assert "note" in one.rows.columns and one.rows.count() == one.rows.sparkSession.sql(VIEW.replace(
        "catches", f"parquet.`{tmp_path}/catches`").replace("boats", f"parquet.`{tmp_path}/boats`")).count()
    apart = run_job(session, specs["checked"], connections=harbour, base_uri=str(tmp_path / "apart"))
    report = run_group(session, list(specs), specs=specs, connections=harbour, base_uri=str(tmp_path / "out"))
    assert {r.job: r.n_failed_rules for r in report.collect()}["checked"] == apart.failed_rules() == 1


def results(spark, report, base):
    assert {r.status for r in report.collect()} == {"succeeded"}
    return {r.job: bag(spark.read.parquet(f"{base}/{r.target}")) for r in report.collect()}


def test_a_group_with_and_without_copies(spark, session, harbour, tmp_path, caplog, monkeypatch):
    def run(session, where):
        base = str(tmp_path / where)
        return results(
            spark, run_group(session, list(JOBS), specs=JOBS, connections=harbour, base_uri=base), base
        )

    caplog.set_level(logging.INFO, "tablemill.sharing")
    apart = run(spark, "apart")
    assert "written once" not in caplog.text
    shared = Path(spark.conf.get("spark.checkpoint.dir")) / "tablemill"
    before = set(shared.iterdir()) if shared.exists() else set()
    assert run(session, "shared") == apart and caplog.text.count("is written once for") == 1
    assert set(shared.iterdir()) == before

    def broken(self):
        raise OSError("no room")

    monkeypatch.setattr(Shared, "write", broken)
    assert run(session, "broken") == apart
    assert "computes landed of harbour itself: no room" in caplog.text


class Buoys(DataSource):
    """A connector that notes each read of a part."""

    @classmethod
    def name(cls):
        return "buoys"

    def schema(self):
        return "buoy long, wave double, note string"

    def reader(self, schema):
        return BuoyReader(dict(self.options))


class BuoyReader(DataSourceReader):
    def __init__(self, options):
        self.options = options

    def read(self, partition):
        with open(self.options["log"], "a") as log:
            log.write("read\n")
        yield from ((i, i * 0.5, f"n{i}") for i in range(40))


def test_a_connector_is_read_once(spark, tmp_path):
    options = {"log": str(tmp_path / "log")}
    connections = {"harbour": Connection("harbour", kind="connector", format="buoys", options=options)}
    specs = {
        f"over_{k}": job(f"over_{k}", f"SELECT buoy FROM rows WHERE wave > {k}", "SELECT waves")
        for k in (3, 5, 7)
    }
    seen, one = [], job_session(spark)
    one.dataSource.register(Buoys)
    for least in ("-1", "0"):
        one.conf.set(SHARE_FROM_BYTES_KEY, least)
        (tmp_path / "log").write_text("")
        base = str(tmp_path / f"out{len(seen)}")
        report = run_group(
            one, list(specs), specs=specs, connections=connections, base_uri=base, isolate=False
        )
        seen.append(results(spark, report, base))
        reads = len((tmp_path / "log").read_text().split())
        seen.append(reads)
    assert seen[0] == seen[2] and {k: sum(v.values()) for k, v in seen[0].items()} == {
        "over_3": 33, "over_5": 29, "over_7": 25,
    }
    assert seen[1] >= 3 and seen[3] == 1
