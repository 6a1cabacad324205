"""Reading the sources of a job as DataFrames."""

from __future__ import annotations

import contextlib
import logging
import re
import time
from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from typing import Any

from pyspark import inheritable_thread_target
from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import DataFrame, SparkSession

from tablemill.errors import SpecError
from tablemill.session import (
    MAX_READ_TASKS_KEY,
    PARTITION_BYTES_KEY,
    SINGLE_READ_BYTES_KEY,
    UNKNOWN_SOURCE_BYTES_KEY,
    UNPACKED_KEY,
    described,
    input_bytes,
    package_setting,
    size_tasks,
    unset_sizes,
)
from tablemill.sinks import newest_version
from tablemill.sources.connections import Connection
from tablemill.sources.literals import remote_literal
from tablemill.sources.splits import Split, plan_splits
from tablemill.spec import SourceSpec

log = logging.getLogger(__name__)

CATALOG = Connection(label="catalog")
COLUMNAR = ("parquet", "orc")


class SourceReader:
    """Opens sources of one session through its connections.

    Sources without a label use the connection labelled ``default``, or else the
    session's catalog; so do labels that are not configured, with a warning. With
    ``own_session`` the session serves this reader only, and its tasks are sized
    to the tables read.
    """

    def __init__(
        self,
        session: SparkSession,
        connections: Mapping[str, Connection] | None = None,
        own_session: bool = False,
        shared: Mapping[tuple[str, str], Any] | None = None,
    ) -> None:
        self.session = session
        # Copies that stand for views and connector reads; see tablemill.sharing.
        self.shared = dict(shared or {})
        # The views and connector reads that were opened, by label and name or text.
        self.computed: dict[tuple[str, str], DataFrame] = {}
        self.connections = dict(connections or {})
        self.default = self.connections.get("default", CATALOG)
        self.input_paths: set[str] = set()
        self._open_sizes = unset_sizes(session) if own_session else ()
        self._frames: dict[tuple[str, str], DataFrame] = {}
        self._bytes = 0
        self._factor = 1

    def connection(self, label: str | None) -> Connection:
        if label is not None and label not in self.connections:
            log.warning("connection %s is not configured, using %s", label, self.default.label)
        return self.connections.get(label, self.default)

    def read(self, source: SourceSpec, args: Mapping[str, Any] | None = None) -> DataFrame:
        if source.is_query:
            return self.query(source.text, args, source.connection, source.split_by)
        return self.table(source.text, source.connection, source.split_by)

    def table(
        self, name: str, label: str | None = None, split_by: Sequence[str] = ()
    ) -> DataFrame:
        connection = self.connection(label)
        if connection.kind == "connector":
            split_by = split_by or connection.split_by.get(name, ())
            return self._remote(connection, name, None, split_by)
        if connection.kind == "files":
            return self._file_frame(connection, name)
        return self._sized(self.session.read.table(name))

    def query(
        self,
        sql: str,
        args: Mapping[str, Any] | None = None,
        label: str | None = None,
        split_by: Sequence[str] = (),
    ) -> DataFrame:
        connection = self.connection(label)
        if connection.kind == "connector":
            return self._remote(connection, None, self._with_literals(sql, args or {}), split_by)
        if connection.kind == "files":
            self._register(connection, sql)
        frame = self.session.sql(sql, args=dict(args or {}))
        return frame if connection.kind == "files" else self._sized(frame)

    @staticmethod
    def _with_literals(sql: str, args: Mapping[str, Any]) -> str:
        """Spark's markers end at Spark; the other side gets literals."""
        if not args:
            return sql
        names = "|".join(map(re.escape, args))
        return re.sub(
            rf"(?<![:\w]):({names})\b",
            lambda marker: remote_literal(marker[1], args[marker[1]]),
            sql,
        )

    def _remote(
        self, connection: Connection, table: str | None, sql: str | None, split_by: Sequence[str]
    ) -> DataFrame:
        """A table or a query of a connector, dealt out over tasks where it says how."""
        key = connection.label, table or sql
        if key in self.shared:
            frame = self._sized(self.shared[key].open(self.session), connection)
        else:
            frame = self._remote_frame(connection, table, sql, split_by)
        self.computed[key] = frame
        return frame

    def _remote_frame(
        self, connection: Connection, table: str | None, sql: str | None, split_by: Sequence[str]
    ) -> DataFrame:
        if "partitionColumn" in connection.options:
            # Spark's own ranges; JDBC takes them for tables only.
            split_by = ()
        elif split_by:
            return self._sized(self._in_splits(connection, table, sql, split_by), connection)
        else:
            self._warn_of_one_task(connection, table or sql)
        reader = self._connector(connection)
        if table is not None:
            reader = reader.option("dbtable" if connection.format == "jdbc" else "table", table)
        elif "partitionColumn" in connection.options:
            reader = reader.option("dbtable", f"({sql}) AS source_rows")
        else:
            reader = reader.option("query", sql)
        return self._sized(reader.load(), connection)

    def _in_splits(
        self, connection: Connection, table: str | None, sql: str | None, split_by: Sequence[str]
    ) -> DataFrame:
        relation = table if table is not None else f"({sql}) AS source_rows"

        def ask(query: str) -> DataFrame:
            return self._connector(connection).option("query", query).load()

        splits = plan_splits(ask, relation, split_by, self._wanted_splits(connection))
        largest = max(split.rows for split in splits)
        log.info("%s: %d reads of at most %d rows", relation, len(splits), largest)
        if connection.format == "jdbc":
            options = dict(connection.options)
            conditions = [split.condition for split in splits]
            url = options.pop("url")
            return self.session.read.jdbc(url, relation, predicates=conditions, properties=options)

        def one(split: Split) -> DataFrame:
            return ask(f"SELECT * FROM {relation} WHERE {split.condition}")

        return reduce(DataFrame.unionAll, [one(split) for split in splits])

    def _wanted_splits(self, connection: Connection) -> int:
        """By the connection's ``splits`` or ``bytes``, else a few for each core there is."""
        wanted = connection.splits
        if wanted is None and connection.bytes is not None:
            wanted = -(-connection.bytes // package_setting(self.session, PARTITION_BYTES_KEY))
        if wanted is None:
            wanted = 4 * self.session.sparkContext.defaultParallelism
        return max(1, min(wanted, package_setting(self.session, MAX_READ_TASKS_KEY)))

    def _warn_of_one_task(self, connection: Connection, what: str) -> None:
        """JDBC without ranges is one task; that is refused for sources known to be large."""
        if connection.format != "jdbc":
            return
        most = package_setting(self.session, SINGLE_READ_BYTES_KEY)
        if connection.bytes is not None and connection.bytes > most:
            raise SpecError(
                f"connection {connection.label}: {connection.bytes} bytes would be read by one task "
                f"({SINGLE_READ_BYTES_KEY} is {most}); give split_by for {what!r}"
            )
        log.warning(
            "connection %s: %r is read by one task; give split_by to share it out",
            *(connection.label, what),
        )

    def _connector(self, connection: Connection):
        return self.session.read.format(connection.format).options(**connection.options)

    def _file_frame(self, connection: Connection, name: str) -> DataFrame:
        key = connection.label, name
        if key not in self._frames:
            if key in self.shared:
                copy = self.shared[key].open(self.session)
                self._frames[key] = self.computed[key] = self._sized(copy, connection)
            elif name in connection.views:
                sql = connection.views[name]
                self._register(connection, sql, before=name)
                self._frames[key] = self.computed[key] = self.session.sql(sql)
            else:
                self._open_tables(connection, [name])
        return self._frames[key]

    def _register(self, connection: Connection, sql: str, before: str | None = None) -> None:
        """Make views of the connection's names that occur in ``sql``.

        A word that is no table does no harm here. Plans are resolved at once, so
        another connection may give a name another meaning later.
        """
        names = [
            name
            for name in connection.names_before(before)
            if re.search(rf"\b{re.escape(name)}\b", sql, re.IGNORECASE)
        ]
        self._open_tables(connection, [name for name in names if name in connection.tables])
        for name in names:
            self._file_frame(connection, name).createOrReplaceTempView(name)

    def _open_tables(self, connection: Connection, names: list[str]) -> None:
        """Open tables side by side: listing the files of a large one takes a while."""

        def open_one(name: str) -> DataFrame:
            files = self._connector(connection)
            if name in connection.schemas:
                files = files.schema(connection.schemas[name])
            path = connection.path_of(name)
            return files.load(newest_version(self.session, path) if connection.versioned else path)

        names = [name for name in names if (connection.label, name) not in self._frames]
        if len(names) > 1:
            with ThreadPoolExecutor(min(8, len(names))) as pool:
                tasks = [
                    pool.submit(inheritable_thread_target(self.session)(open_one), name)
                    for name in names
                ]
                frames = [task.result() for task in tasks]
        else:
            frames = [open_one(name) for name in names]
        for name, frame in zip(names, frames):
            self.input_paths.add(connection.path_of(name))
            self._frames[connection.label, name] = self._sized(frame, connection)

    def _sized(self, frame: DataFrame, connection: Connection | None = None) -> DataFrame:
        """Count a source's bytes: those it reports, else its connection's, else a wide guess."""
        if self._open_sizes:
            known = input_bytes(frame)
            if known is None:
                known = connection.bytes if connection else None
            if known is None:
                known = package_setting(self.session, UNKNOWN_SOURCE_BYTES_KEY)
            self._bytes += known
            if connection and connection.kind == "files" and connection.format in COLUMNAR:
                self._factor = max(self._factor, package_setting(self.session, UNPACKED_KEY))
            size_tasks(self.session, self._bytes, self._open_sizes, self._factor)
        return frame


# Errors of Spark's analysis that another attempt may cure: what is looked for
# may appear. Every other one is a mistake in the statement.
_MAY_APPEAR = ("PATH_NOT_FOUND", "TABLE_OR_VIEW_NOT_FOUND", "SCHEMA_NOT_FOUND")


def is_mistake(error: Exception) -> bool:
    """Whether the spec or the SQL is wrong, so that trying again cannot help."""
    if isinstance(error, AnalysisException) and not isinstance(error, ParseException):
        return (error.getCondition() or "").split(".")[0] not in _MAY_APPEAR
    return isinstance(error, (SpecError, ParseException))


def with_retries(
    action: Callable[[], DataFrame],
    what: str,
    retries: int = 3,
    max_wait: float = 60.0,
    sleep: Callable[[float], None] | None = None,
) -> DataFrame:
    """Run ``action``; on failure wait 2, 4, 8, ... seconds, at most ``max_wait``.

    This covers planning and metadata calls only: reads are lazy, and Spark
    itself repeats failed tasks. Mistakes are not repeated, see :func:`is_mistake`.
    """
    waits = [min(2**n, max_wait) for n in range(1, retries + 1)]
    for wait in [*waits, None]:
        try:
            return action()
        except Exception as error:
            if is_mistake(error):
                raise
            log.error("%s cannot be read: %s", what, error)
            if wait is None:
                log.critical("%s: all %d attempts failed", what, len(waits) + 1)
                raise
        log.info("%s: next attempt in %s s", what, wait)
        (sleep or time.sleep)(wait)
    raise AssertionError("unreachable")


def read_sources(
    reader: SourceReader,
    sources: Mapping[str, SourceSpec | Mapping[str, Any]],
    args: Mapping[str, Any] | None = None,
    retries: int = 3,
    max_wait: float = 60.0,
    sleep: Callable[[float], None] | None = None,
) -> dict[str, DataFrame]:
    """All sources of a job as lazy frames, under their config names."""
    specs = {
        name: source if isinstance(source, SourceSpec) else SourceSpec.from_dict(name, source)
        for name, source in sources.items()
    }
    frames = {}
    for name, spec in specs.items():
        frames[name] = with_retries(
            lambda spec=spec: reader.read(spec, args), f"source {name}", retries, max_wait, sleep
        )
        log.info("source %s is ready", name)
    return frames


def ad_hoc(
    reader: SourceReader,
    sql: str,
    args: Mapping[str, Any] | None = None,
    label: str | None = None,
    job_id: str | None = None,
) -> DataFrame:
    """Run one query outside any job.

    ``job_id`` names the Spark jobs that planning starts; the result is lazy, so
    use :func:`tablemill.session.described` around the action to name those, too.
    """
    with described(reader.session, job_id) if job_id else contextlib.nullcontext():
        return reader.query(sql, args, label)
