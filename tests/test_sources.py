"""Sources: dispatch, connections, retries."""

import datetime as dt
import logging
import sys
from collections import Counter

import pytest
from pyspark import cloudpickle
from pyspark.errors import AnalysisException

from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader
from pyspark.sql.pandas.types import from_arrow_schema

from tablemill import Connection, JobSpec, SpecError, TableJob, load_connections, steps
from tablemill.session import (
    INITIAL_PARTITIONS,
    MAX_PARTITIONS_KEY,
    MERGE_TO,
    PARTITION_BYTES_KEY,
    READ_SPLIT,
    input_bytes,
    job_session,
    size_tasks,
)
from tablemill.sources import SourceReader, ad_hoc, read_sources, with_retries
from tablemill.sources.splits import plan_splits


# Executors do not have this file.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


class Tides(DataSource):
    """A connector of our own: tells what it was asked for, row by row."""

    @classmethod
    def name(cls):
        return "tides"

    def schema(self):
        return "asked string, text string, station string, level double"

    def reader(self, schema):
        return TideReader(dict(self.options))


class TideReader(DataSourceReader):
    def __init__(self, options):
        self.options = options

    def read(self, partition):
        asked = next(k for k in ("query", "table", "dbtable") if k in self.options)
        station = self.options.get("station", "-")
        for level in (0.5, 1.5, 2.5):
            yield asked, self.options[asked], station, level


def tides(session, label="coast", **more):
    session.dataSource.register(Tides)
    return {label: Connection(label, kind="connector", format="tides", **more)}


def asked(frame):
    row = frame.first()
    return row.asked, row.text


def test_connector_query_and_table(spark):
    session = job_session(spark)
    frames = read_sources(
        SourceReader(session, tides(session, options={"station": "north"})),
        {
            "high": {"type": "query", "query": "SELECT high water", "connection": "coast"},
            "all": {"type": "table", "table": "levels", "connection": "coast"},
        },
    )
    assert asked(frames["high"]) == ("query", "SELECT high water")
    assert asked(frames["all"]) == ("table", "levels")
    assert {r.station for f in frames.values() for r in f.collect()} == {"north"}


def test_a_job_on_a_connector(spark, tmp_path):
    """From the connector to the written result, with tasks sized to the connection's hint."""
    session = job_session(spark)
    spec = JobSpec.from_dict(
        {
            "job_name": "mean_level",
            "sources": {"levels": {"type": "table", "table": "levels", "connection": "coast"}},
            "query": {
                "sql": "SELECT station, AVG(level) AS level FROM levels GROUP BY station",
                "target_table": "mean_level",
            },
        }
    )
    for hint, partitions in ((500 * 1024**3, 4000), (None, 2048)):
        connections = tides(session, bytes=hint)
        session.conf.unset(INITIAL_PARTITIONS)
        job = TableJob(
            session, spec, connections=connections, base_uri=str(tmp_path), own_session=True
        )
        where = job.run()
        assert int(session.conf.get(INITIAL_PARTITIONS)) == partitions
        assert [tuple(r) for r in spark.read.parquet(where).collect()] == [("-", 1.5)]


def test_default_connection(spark, caplog):
    session = job_session(spark)
    reader = SourceReader(session, tides(session, "default"))
    assert asked(reader.table("levels")) == ("table", "levels")
    assert "not configured" not in caplog.text
    assert asked(reader.query("SELECT low", label="harbour")) == ("query", "SELECT low")
    assert "harbour" in caplog.text


class Jdbc:
    """Notes the options of a read whose driver is not here."""

    def __init__(self):
        self.seen = {}

    read = property(lambda self: self)

    def format(self, name):
        return self

    def options(self, **options):
        return self

    def option(self, key, value):
        self.seen[key] = value
        return self

    def load(self):
        return self


def test_jdbc_reads_in_parts():
    parts = {"partitionColumn": "id", "lowerBound": "0", "upperBound": "9", "numPartitions": "3"}
    for call, expected in (
        (lambda r: r.query("SELECT id FROM t", label="w"), "(SELECT id FROM t) AS source_rows"),
        (lambda r: r.table("t", "w"), "t"),
    ):
        session = Jdbc()
        call(SourceReader(session, {"w": Connection("w", "connector", "jdbc", options=parts)}))
        assert session.seen == {"dbtable": expected}


def test_remote_parameters_become_literals(spark):
    session = job_session(spark)
    reader = SourceReader(session, tides(session))
    args = {"n": 5, "day": dt.date(2024, 1, 1), "word": "a :n b", "off": None, "yes": True}
    frame = reader.query("SELECT :n, :day, :word, :off, :yes, x::n, :nn", args, "coast")
    assert asked(frame)[1] == "SELECT 5, DATE '2024-01-01', 'a :n b', NULL, TRUE, x::n, :nn"
    with pytest.raises(SpecError):
        reader.query("SELECT :word", {"word": "x' OR '1'='1"}, "coast")


def test_files_and_views(spark, shop, tmp_path):
    shop["orders"].write.parquet(str(tmp_path / "orders"))
    connections = {
        "a": Connection(
            "a",
            kind="files",
            base_path=str(tmp_path),
            tables={"rows": "orders"},
            views={"orders": "SELECT order_id AS id FROM rows"},
        ),
        "b": Connection("b", kind="files", base_path=str(tmp_path), tables={"orders": "orders"}),
    }
    reader = SourceReader(job_session(spark), connections)
    one = reader.query("SELECT * FROM orders", label="a")
    two = reader.query("SELECT * FROM orders", label="b")
    three = reader.query("SELECT * FROM orders WHERE id = :id", {"id": 3}, "a")
    assert one.columns == ["id"] and len(two.columns) == 6
    assert [r.id for r in three.collect()] == [3]
    assert reader.table("orders", "a").columns == ["id"]
    assert reader.table("orders", "b").count() == one.count()
    assert f"{tmp_path}/orders" in reader.input_paths
    with pytest.raises(SpecError, match="nothing"):
        reader.table("nothing", "a")


@pytest.mark.parametrize("fmt", ["parquet", "orc", "json", "csv"])
def test_file_formats_and_given_schemas(spark, tmp_path, fmt):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "id int, word string")
    rows.write.format(fmt).save(str(tmp_path / "t"))
    connection = Connection(
        "a",
        kind="files",
        format=fmt,
        base_path=str(tmp_path),
        tables={"t": "t"},
        schemas={"t": "id INT, word STRING"},
    )
    frame = SourceReader(job_session(spark), {"a": connection}).table("t", "a")
    assert frame.schema.simpleString() == "struct<id:int,word:string>"
    assert sorted(map(tuple, frame.collect())) == [(1, "a"), (2, "b")]


def test_catalog_is_the_default(spark, shop):
    session = job_session(spark)
    steps.transform(session, {"orders": shop["orders"]}, "SELECT 1")
    reader = SourceReader(session)
    assert reader.table("orders").count() == reader.query("SELECT * FROM orders").count()


def test_pruning_and_pushdown_of_a_query_source(spark, shop, tmp_path):
    from tablemill.runner import explain_text

    shop["orders"].write.parquet(str(tmp_path / "orders"))
    connection = Connection("a", kind="files", base_path=str(tmp_path), tables={"orders": "orders"})
    reader = SourceReader(job_session(spark), {"a": connection})
    frame = reader.query(
        "SELECT order_id, customer_id FROM orders WHERE status = :s", {"s": "COMPLETE"}, "a"
    )
    plan = explain_text(frame.select("order_id"))
    assert "EqualTo(status,COMPLETE)" in plan
    assert "ReadSchema: struct<order_id:bigint,status:string>" in plan


def test_connections_file(tmp_path):
    path = tmp_path / "c.yaml"
    path.write_text("a: {kind: files, tables: {t: t.parquet}}\nb: {kind: catalog}\n")
    loaded = load_connections(path, base_path="/data/")
    assert loaded["a"].path_of("t") == "/data/t.parquet" and loaded["b"].base_path is None
    with pytest.raises(SpecError):
        load_connections(path)
    with pytest.raises(FileNotFoundError):
        load_connections(tmp_path / "none.yaml")
    with pytest.raises(SpecError):
        Connection("x", kind="ftp")


def flaky(failures, error=OSError):
    """An action that fails so many times, and the list of its calls."""
    calls = []

    def action():
        calls.append(len(calls))
        if len(calls) <= failures:
            raise error(f"failure {len(calls)}")
        return "frame"

    return action, calls


@pytest.mark.parametrize(
    "failures, retries, max_wait, waits",
    [(0, 3, 60, []), (2, 3, 60, [2, 4]), (3, 3, 60, [2, 4, 8]), (3, 5, 3, [2, 3, 3])],
)
def test_retries_until_it_works(failures, retries, max_wait, waits):
    action, calls = flaky(failures)
    waited = []
    assert with_retries(action, "x", retries, max_wait, waited.append) == "frame"
    assert waited == waits and len(calls) == failures + 1


def test_retries_end_with_the_last_error(caplog):
    action, calls = flaky(99)
    with caplog.at_level(logging.INFO), pytest.raises(OSError, match="failure 3"):
        with_retries(action, "x", retries=2, sleep=lambda _: None)
    levels = Counter(r.levelname for r in caplog.records)
    assert len(calls) == levels["ERROR"] == 3 and levels["CRITICAL"] == 1


@pytest.mark.parametrize(
    "sql, mistake",
    [("SELEC 1", True), ("SELECT lost FROM range(3)", True), ("SELECT 1 FROM no_such_table", False)],
)
def test_mistakes_are_not_retried(spark, sql, mistake):
    waited = []
    with pytest.raises(AnalysisException):
        with_retries(lambda: spark.sql(sql), "x", retries=1, sleep=waited.append)
    assert waited == ([] if mistake else [2])


def test_missing_path_is_retried(spark, tmp_path):
    connection = Connection("a", kind="files", base_path=str(tmp_path), tables={"t": "none"})
    waits = []
    with pytest.raises(AnalysisException):
        read_sources(
            SourceReader(spark, {"a": connection}),
            {"t": {"type": "table", "query": "t", "connection": "a"}},
            retries=1,
            sleep=waits.append,
        )
    assert waits == [2]


def test_ad_hoc_names_its_jobs(spark):
    session = job_session(spark)
    frame = ad_hoc(SourceReader(session), "SELECT :n AS n", {"n": 4}, job_id="my query")
    assert frame.collect()[0].n == 4
    # The next job does not carry the name.
    assert spark.sparkContext.getLocalProperty("spark.job.description") is None


def test_tasks_grow_with_the_input(spark, shop, tmp_path, caplog):
    session = job_session(spark)

    def sizes(n_bytes):
        size_tasks(session, n_bytes)
        return int(session.conf.get(INITIAL_PARTITIONS)), int(session.conf.get(READ_SPLIT))

    assert sizes(1000) == (4, 128 * 1024**2)
    assert sizes(100 * 1024**3) == (800, 128 * 1024**2)
    partitions, split = sizes(100 * 1024**4)
    assert partitions == 819200 and 512 * 1024**2 < split < 1024**3
    session.conf.set(MAX_PARTITIONS_KEY, "1000")
    with caplog.at_level(logging.WARNING):
        assert sizes(10**19) == (1000, 1024**3)
    assert MAX_PARTITIONS_KEY in caplog.text

    shop["orders"].write.parquet(str(tmp_path / "orders"))
    connection = Connection("a", kind="files", base_path=str(tmp_path), tables={"orders": "orders"})
    session = job_session(spark)
    session.conf.set(READ_SPLIT, "17m")
    SourceReader(session, {"a": connection}, own_session=True).table("orders", "a")
    assert session.conf.get(INITIAL_PARTITIONS) == "4" and session.conf.get(READ_SPLIT) == "17m"
    assert spark.conf.get(INITIAL_PARTITIONS, None) is None


def test_tasks_of_columnar_files_fit_their_rows(spark, shop, tmp_path):
    """Rows take far more room in a task than in the file, so its tasks read and merge less."""
    path = str(tmp_path / "orders")
    shop["orders"].write.parquet(path)
    size = input_bytes(spark.read.parquet(path))
    connection = Connection("a", kind="files", base_path=str(tmp_path), tables={"orders": "orders"})
    session = job_session(spark)
    session.conf.set(PARTITION_BYTES_KEY, "1024")
    session.conf.unset(MERGE_TO)
    SourceReader(session, {"a": connection}, own_session=True).table("orders", "a")
    assert int(session.conf.get(INITIAL_PARTITIONS)) == max(4, -(-size * 32 // 1024))
    assert (session.conf.get(READ_SPLIT), session.conf.get(MERGE_TO)) == ("32", "64")


def test_input_bytes(spark, shop, tmp_path):
    path = str(tmp_path / "orders")
    shop["orders"].write.parquet(path)
    size = sum(f.stat().st_size for f in (tmp_path / "orders").glob("part-*.parquet"))
    frame = spark.read.parquet(path)
    assert input_bytes(frame) == size
    assert input_bytes(frame.join(frame.select("order_id"), "order_id")) == 2 * size


# Splits


class Shelf(DataSource):
    """A connector that answers SQL over one Parquet file, all of it in one task."""

    @classmethod
    def name(cls):
        return "shelf"

    def _ask(self):
        import duckdb

        text = self.options.get("query") or f"SELECT * FROM {self.options['table']}"
        return duckdb.connect().from_parquet(self.options["path"]).query("books", text).to_arrow_table()

    def schema(self):
        return from_arrow_schema(self._ask().schema)

    def reader(self, schema):
        return ShelfReader(self._ask)


class ShelfReader(DataSourceReader):
    def __init__(self, ask):
        self.ask = ask

    def read(self, partition):
        yield from self.ask().to_batches()


@pytest.fixture(scope="module")
def books(spark, tmp_path_factory):
    """9,000 rows: a third of one shelf, a tenth of none, the others in ascending numbers."""
    path = str(tmp_path_factory.mktemp("shelf") / "books.parquet")
    frame = spark.range(9000).selectExpr(
        "id",
        "CASE WHEN id % 3 = 0 THEN 500 WHEN id % 10 = 1 THEN NULL ELSE id END AS shelf",
        "CAST(id % 3000 AS DOUBLE) / 7 AS weight",
        "CASE WHEN id % 10 = 0 THEN concat(\"it's \", id) ELSE concat('t', id) END AS title",
        "DATE '2001-01-01' + CAST(id % 1000 AS INT) AS bought",
        "CAST(NULL AS INT) AS nothing",
    )
    frame.toPandas().to_parquet(path)
    return path


def shelves(session, path, **more):
    session.dataSource.register(Shelf)
    return {"lib": Connection("lib", kind="connector", format="shelf", options={"path": path}, **more)}


def shares(frame):
    """Rows read by each task."""
    return [r["count"] for r in frame.groupBy(F.spark_partition_id().alias("p")).count().collect()]


@pytest.mark.parametrize(
    ("split_by", "tasks", "largest"),
    [
        # A value with a third of the rows cannot be divided by itself, but by a second key.
        (("shelf",), (9, 12), 3001),
        (("shelf", "id"), (11, 14), 1001),
        (("id",), (12, 12), 750),
        (("weight",), (12, 12), 760),
        (("title",), (6, 12), 2300),
        (("bought", "id"), (12, 12), 770),
        # Nothing but NULL.
        (("nothing",), (1, 1), 9000),
        (("nothing", "id"), (12, 12), 750),
    ],
)
def test_reads_are_dealt_by_quantiles(spark, books, split_by, tasks, largest):
    session = job_session(spark)
    reader = SourceReader(session, shelves(session, books, splits=12))
    spec = {"type": "table", "table": "books", "connection": "lib", "split_by": list(split_by)}
    frame = read_sources(reader, {"books": spec})["books"]
    assert tasks[0] <= frame.rdd.getNumPartitions() <= tasks[1]
    assert max(shares(frame)) <= largest
    got = frame.select("id", "shelf").collect()
    assert len(got) == 9000 and {r.id for r in got} == set(range(9000))


def test_a_query_is_dealt_out(spark, books):
    session = job_session(spark)
    connections = shelves(session, books, splits=5, split_by={"books": ("id",)})
    reader = SourceReader(session, connections)
    source = {
        "type": "query",
        "query": "SELECT id * 2 AS twice, title FROM books WHERE id < :most",
        "connection": "lib",
        "split_by": "twice",
    }
    frame = read_sources(reader, {"q": source}, {"most": 1000})["q"]
    assert frame.rdd.getNumPartitions() == 5 and max(shares(frame)) == 200
    assert {r.twice for r in frame.collect()} == set(range(0, 2000, 2))
    # The connection may know the key of a table; without a number, its bytes tell how many.
    assert reader.table("books", "lib").rdd.getNumPartitions() == 5
    sized = shelves(session, books, bytes=3 * 128 * 1024**2, split_by={"books": ("id",)})
    assert SourceReader(session, sized).table("books", "lib").rdd.getNumPartitions() == 3
    none = SourceReader(session, connections).query(
        "SELECT * FROM books WHERE id < 0", label="lib", split_by=("id",)
    )
    assert none.rdd.getNumPartitions() == 1 and none.count() == 0


class Rows:
    """What a source would answer."""

    def __init__(self, *rows):
        self.rows = [dict(zip(("part", "first_key", "last_key", "n_rows"), r)) for r in rows]

    def collect(self):
        return self.rows


@pytest.mark.parametrize(
    "ranks",
    [
        [(1, 1, 1, 1)],
        [(0, None, None, 7)],
        [(1, 5, 5, 9), (2, 5, 5, 9), (3, 5, 8, 9), (4, 8, 8, 9), (5, 9, 9, 9)],
        [(0, None, None, 20), (1, 1, 3, 5), (2, 3, 4, 5), (3, 4, 4, 5), (4, 4, 4, 5)],
        [(1, -2, 0, 3), (2, 0, 0, 3), (3, 0, 7, 3), (4, 7, 9, 2)],
        [(1, 1, 1, 4), (2, 2, 2, 4), (3, 2, 2, 4)],
    ],
)
def test_every_value_is_in_one_share(ranks):
    import duckdb

    splits = plan_splits(lambda sql: Rows(*ranks), "t", ["k"], len(ranks))
    assert sum(s.rows for s in splits) == sum(r[3] for r in ranks)
    values = duckdb.sql("SELECT k FROM range(-5, 15) AS r(k) UNION ALL SELECT NULL")
    places = [f"CASE WHEN {s.condition} THEN 1 ELSE 0 END" for s in splits]
    hits = values.query("t", f"SELECT {' + '.join(places)} AS n FROM t").fetchall()
    assert {n for (n,) in hits} == {1}


def test_split_keys_are_plain_columns(spark, books):
    session = job_session(spark)
    reader = SourceReader(session, shelves(session, books))
    with pytest.raises(SpecError, match="plain column"):
        reader.table("books", "lib", ("id; DROP",))
    with pytest.raises(SpecError, match="splits"):
        shelves(session, books, splits=0)


class JdbcSession(Jdbc):
    """Plans on one answer and notes the ranges Spark is given."""

    sparkContext = type("Context", (), {"defaultParallelism": 1})
    conf = type("Conf", (), {"get": staticmethod(lambda key, default=None: default)})

    def load(self):
        if "NTILE" in self.seen.get("query", ""):
            return Rows((0, None, None, 1), (1, 1, 4, 5), (2, 5, 9, 5))
        return self

    def jdbc(self, url, table, predicates, properties):
        self.seen |= {"url": url, "table": table, "predicates": predicates, "properties": properties}
        return self


def test_jdbc_gets_the_ranges_as_predicates(caplog):
    session = JdbcSession()
    options = {"url": "jdbc:x:y", "driver": "d"}
    connection = Connection("w", kind="connector", format="jdbc", options=options, splits=2)
    reader = SourceReader(session, {"w": connection})
    reader._sized = lambda frame, connection=None: frame
    reader.table("t", "w", ("id",))
    assert session.seen["url"] == "jdbc:x:y" and session.seen["table"] == "t"
    assert session.seen["predicates"] == ["((id < 5) OR (id IS NULL))", "(id >= 5)"]
    assert session.seen["properties"] == {"driver": "d"}
    reader.query("SELECT 1 AS id", label="w", split_by=("id",))
    assert session.seen["table"] == "(SELECT 1 AS id) AS source_rows"
    # Without a key: one task, which is said, or refused for what is known to be large.
    caplog.clear()
    reader.table("t", "w")
    assert "one task" in caplog.text and session.seen["dbtable"] == "t"
    large = Connection("w", kind="connector", format="jdbc", options=options, bytes=1 << 40)
    with pytest.raises(SpecError, match="split_by"):
        SourceReader(session, {"w": large}).table("t", "w")
