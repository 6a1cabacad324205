"""Sources that several jobs of a group read, computed once for all of them.

A view with a shuffle in it, or a read of a connector, costs as much for each
job that uses it. Of those a group uses more than once, one copy is written to the
shared folder and the jobs read that. The copy has the columns that some job
reads and the rows that some job's filters let pass. Both are taken from the
jobs' own plans, made over an empty stand-in with the source's columns, so it is
Catalyst that tells what a job needs. Jobs plan and filter as before; columns
that none of them reads are NULL in what they see.

A plain scan is not shared: Parquet gives each job the columns and rows it needs
for less than a copy costs. Small sources are not either, see
``tablemill.shareFromBytes``.
"""

from __future__ import annotations

import json
import logging
from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, field
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablemill.session import (
    SHARE_FROM_BYTES_KEY,
    UNKNOWN_SOURCE_BYTES_KEY,
    input_bytes,
    package_setting,
    plan_text,
    scratch_uri,
    settings_for,
)
from tablemill.sinks import remove_folder

log = logging.getLogger(__name__)

# A connection's label, and the name of a view or the text of a connector's read.
Key = tuple[str, str]


@dataclass(frozen=True)
class Copy:
    """A source as some jobs need it, in a folder that all executors reach."""

    uri: str
    schema: T.StructType
    columns: frozenset[str]

    @property
    def kept(self) -> T.StructType:
        return T.StructType([field for field in self.schema if field.name in self.columns])

    def open(self, session: SparkSession) -> DataFrame:
        """All columns of the source; those not in the copy are NULL."""
        rows = session.read.schema(self.kept).parquet(self.uri)
        return rows.select(
            [
                F.col(_quoted(f.name))
                if f.name in self.columns
                else F.lit(None).cast(f.dataType).alias(f.name)
                for f in self.schema
            ]
        )


@dataclass(frozen=True)
class Filter:
    """A predicate as SQL text, with the name that the plan has for its table."""

    sql: str
    table: str


@dataclass(frozen=True)
class Need:
    """What one scan of a source asks for; without filters it asks for all rows.

    ``settings`` are those under which the job's predicates were analysed.
    """

    columns: frozenset[str]
    filters: tuple[Filter, ...] = ()
    settings: Mapping[str, str] = field(default_factory=dict)


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _listed(sequence) -> list:
    return [sequence.apply(i) for i in range(sequence.size())]


def scans_of(
    frame: DataFrame, copy: Copy, settings: Mapping[str, str] | None = None
) -> list[Need]:
    """What the plan of ``frame`` reads of a copy, scan by scan."""
    folder = copy.uri.rsplit("/", 1)[-1]
    if "Subqueries" in plan_text(frame):
        # Plans of subqueries hang on expressions; what they read is not looked for.
        return [Need(frozenset(copy.schema.names))]
    needs = []
    for leaf in _listed(frame._jdf.queryExecution().sparkPlan().collectLeaves()):
        if leaf.getClass().getSimpleName() != "FileSourceScanExec":
            continue
        roots = _listed(leaf.relation().location().rootPaths())
        if [str(root.getName()) for root in roots] != [folder]:
            continue
        fields = json.loads(leaf.requiredSchema().json())["fields"]
        filters = filter(None, map(_as_filter, _listed(leaf.dataFilters())))
        columns = frozenset(f["name"] for f in fields)
        needs.append(Need(columns, tuple(filters), dict(settings or {})))
    return needs


def _as_filter(predicate) -> Filter | None:
    """A pushed predicate, if one name for the table explains all its columns."""
    found = predicate.references().toSeq()
    names = {tuple(_listed(column.qualifier())) for column in _listed(found)}
    if len(names) != 1 or len(name := names.pop()) > 1:
        return None
    return Filter(predicate.sql(), name[0] if name else "rows")


def _flagged(frame: DataFrame, need: Need, flag: str) -> DataFrame | None:
    """``frame`` and whether a row passes the filters of a scan; None if all do.

    A predicate that Spark cannot read back is left to the job.
    """
    tables = {one.table for one in need.filters}
    if len(tables) != 1:
        return None
    named, parts = frame.alias(tables.pop()), []
    with settings_for(frame.sparkSession, need.settings):
        for one in need.filters:
            try:
                named.where(one.sql)
            except AnalysisException as problem:
                log.debug("%s is left to the jobs: %s", one.sql, problem)
            else:
                parts.append(F.expr(one.sql))
        if not parts:
            return None
        passes = reduce(lambda a, b: a & b, parts)
        return named.withColumn(flag, F.coalesce(passes, F.lit(False)))


def needed_rows(frame: DataFrame, needs: Iterable[Need]) -> DataFrame:
    """Rows that pass the filters of at least one scan."""
    flags, rows = [], frame
    for i, need in enumerate(needs):
        flags.append(f"__pass{i}")
        rows = _flagged(rows, need, flags[-1])
        if rows is None:
            return frame
    return rows.where(reduce(lambda a, b: a | b, map(F.col, flags))).drop(*flags)


def _worth(session: SparkSession, frame: DataFrame, is_view: bool, told: int | None) -> bool:
    """Whether computing a source again costs more than a copy of it."""
    least = package_setting(session, SHARE_FROM_BYTES_KEY)
    names = [name.lower() for name in frame.columns]
    if least < 0 or len(set(names)) < len(names):
        return False
    size = input_bytes(frame)
    if size is None:
        size = told if told is not None else package_setting(session, UNKNOWN_SOURCE_BYTES_KEY)
    return size >= least and (not is_view or "Exchange" in plan_text(frame))


def _stand_in(session: SparkSession, frame: DataFrame) -> Copy:
    empty = Copy(scratch_uri(session, "stand-in"), frame.schema, frozenset(frame.columns))
    session.createDataFrame([], frame.schema).write.parquet(empty.uri)
    return empty


@dataclass(frozen=True)
class Shared:
    """A source that is worth a copy: the rows and columns its users need of it, lazily."""

    key: Key
    schema: T.StructType
    rows: DataFrame
    users: tuple[str, ...]

    @classmethod
    def of(cls, key: Key, frame: DataFrame, needs: Mapping[str, list[Need]]) -> Shared:
        scans = [need for own in needs.values() for need in own]
        read = frozenset().union(*(need.columns for need in scans))
        # A count of rows reads no column, but Parquet needs one.
        read = read or frozenset(frame.columns[:1])
        rows = needed_rows(frame, scans)
        rows = rows.select([F.col(_quoted(name)) for name in frame.columns if name in read])
        return cls(key, frame.schema, rows, tuple(needs))

    def write(self) -> Copy:
        session = self.rows.sparkSession
        uri = scratch_uri(session, "shared-source")
        copy = Copy(uri, self.schema, frozenset(self.rows.columns))
        self.rows.write.parquet(copy.uri)
        log.info("%s of %s is written once for %s", self.key[1], self.key[0], ", ".join(self.users))
        return copy


def plan_sharing(
    spark: SparkSession, jobs: Mapping[str, object], reopened: Callable[[str, Mapping], object]
) -> list[Shared]:
    """The sources of opened jobs that are worth a copy.

    ``reopened`` opens a job again by name, with copies in place of some sources.
    """
    users: dict[Key, list[str]] = {}
    for name, job in jobs.items():
        for key in job.reader.computed:
            users.setdefault(key, []).append(name)
    stand_ins, frames = {}, {}
    for key, names in users.items():
        reader = jobs[names[0]].reader
        connection = reader.connections.get(key[0], reader.default)
        frames[key] = frame = reader.computed[key]
        if len(names) > 1 and _worth(spark, frame, connection.kind == "files", connection.bytes):
            try:
                stand_ins[key] = _stand_in(spark, frame)
            except Exception as problem:
                log.warning("%s of %s is not shared: %s", key[1], key[0], problem)
    needs: dict[Key, dict[str, list[Need]]] = {key: {} for key in stand_ins}
    for name, job in jobs.items():
        mine = {key: empty for key, empty in stand_ins.items() if key in job.reader.computed}
        try:
            reads = reopened(name, mine).reads() if mine else []
            for key, empty in mine.items():
                found = [need for f in reads for need in scans_of(f, empty, job.spec.settings)]
                if found:
                    needs[key][name] = found
        except Exception as problem:
            # Its own run will tell; it computes its sources itself.
            log.warning("%s shares no sources: %s", name, problem)
            needs = {key: {n: s for n, s in by.items() if n != name} for key, by in needs.items()}
    for empty in stand_ins.values():
        remove_folder(spark, empty.uri)
    return [Shared.of(key, frames[key], by) for key, by in needs.items() if len(by) > 1]
