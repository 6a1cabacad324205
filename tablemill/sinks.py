"""Where results go: Parquet folders, catalog tables, a preview."""

from __future__ import annotations

import logging
import re
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

from tablemill.errors import SpecError
from tablemill.operators.projection import require_unique_columns
from tablemill.session import settings_for
from tablemill.spec import SinkSpec

log = logging.getLogger(__name__)

_IDENTIFIER = re.compile(r"[A-Za-z_]\w*(\.[A-Za-z_]\w*){0,2}")
_TARGET = re.compile(r"[A-Za-z0-9_\-][A-Za-z0-9_.\-]*(/[A-Za-z0-9_\-][A-Za-z0-9_.\-]*)*")

# Renaming a folder is one metadata step here; elsewhere it copies every object.
RENAME_SCHEMES = ("file", "hdfs", "viewfs")


def _file_system(session: SparkSession, uri: str) -> tuple:
    """The Hadoop path of a URI and the file system that serves it."""
    path = session._jvm.org.apache.hadoop.fs.Path(uri)
    return path, path.getFileSystem(session._jsparkSession.sessionState().newHadoopConf())


def remove_folder(session: SparkSession, uri: str) -> None:
    """Delete a folder that this package has made."""
    path, fs = _file_system(session, uri)
    fs.delete(path, True)


def _qualified(session: SparkSession, uri: str) -> str:
    path, fs = _file_system(session, uri)
    return str(fs.makeQualified(path)).rstrip("/")


def target_path(base_uri: str, target: str) -> str:
    if not _TARGET.fullmatch(target):
        raise SpecError(f"target {target!r} is not a plain folder name")
    return f"{base_uri.rstrip('/')}/{target}/"


def refuse_overlap(session: SparkSession, path: str, inputs: Iterable[str]) -> None:
    """A job must not overwrite what it lazily reads, however either path is written."""
    out = _qualified(session, path)
    for source in (_qualified(session, uri) for uri in inputs):
        if out == source or out.startswith(source + "/") or source.startswith(out + "/"):
            raise SpecError(f"target {path} overlaps the input {source}")


def _swap_in(session: SparkSession, staging: str, final: str) -> None:
    """Put a finished folder in place; on failure the old one is put back.

    Between the two renames there is no target for a moment, so a reader that
    lists it just then finds nothing.
    """
    out, fs = _file_system(session, final)
    fs_path = session._jvm.org.apache.hadoop.fs.Path
    new, old = fs_path(staging), fs_path(staging + ".old")
    fs.mkdirs(out.getParent())
    replaced = fs.exists(out)
    if replaced and not fs.rename(out, old):
        raise OSError(f"cannot move {final} aside")
    if not fs.rename(new, out):
        if replaced:
            fs.rename(old, out)
        raise OSError(f"cannot move {staging} to {final}")
    if replaced:
        fs.delete(old, True)


# Spark passes over folders with this mark, so the versions are never read together.
_VERSIONS = "_versions"
_COMPLETE = "_complete"
_VERSION = re.compile(r"v(\d{12})-[0-9a-f]{32}")


def _versions(session: SparkSession, target: str) -> list[tuple[int, str, bool]]:
    """(number, folder, complete) of a target's versions, in order."""
    path, fs = _file_system(session, f"{target.rstrip('/')}/{_VERSIONS}")
    if not fs.exists(path):
        return []
    found = []
    for status in fs.listStatus(path):
        folder = status.getPath()
        if match := _VERSION.fullmatch(folder.getName()):
            done = fs.exists(session._jvm.org.apache.hadoop.fs.Path(folder, _COMPLETE))
            found.append((int(match[1]), str(folder.toString()), done))
    return sorted(found)


def newest_version(session: SparkSession, target: str) -> str:
    """The folder of the newest complete version of a versioned target."""
    complete = [folder for _, folder, done in _versions(session, target) if done]
    if not complete:
        raise FileNotFoundError(f"{target} has no complete version")
    return complete[-1]


def read_version(session: SparkSession, target: str) -> DataFrame:
    """The newest complete version; writes that go on or failed are not seen."""
    return session.read.parquet(newest_version(session, target))


def _write_version(frame: DataFrame, target: str, keep: int) -> str:
    """Write the next version beside the others and mark it complete.

    The mark is one empty file, made in one step on object stores, too, and there is
    no moment without a complete version once there was one. Of the complete versions
    the newest ``keep`` stay, for readers that have opened them; what lies before those
    goes, remains of killed writes included.
    """
    session = frame.sparkSession
    last = max((number for number, _, _ in _versions(session, target)), default=0)
    folder = f"{target.rstrip('/')}/{_VERSIONS}/v{last + 1:012d}-{uuid.uuid4().hex}"
    frame.write.mode("errorifexists").parquet(folder)
    mark, fs = _file_system(session, f"{folder}/{_COMPLETE}")
    fs.create(mark, False).close()
    versions = _versions(session, target)
    kept = [number for number, _, done in versions if done][-keep:]
    for number, old, _ in versions:
        if number < kept[0]:
            remove_folder(session, old)
    return folder


def _require_partition_columns(frame: DataFrame, sink: SinkSpec) -> None:
    absent = [column for column in sink.partition_by if column not in frame.columns]
    if absent:
        raise SpecError(f"sink: no partition columns {absent} in the result")


def write_parquet(
    frame: DataFrame,
    base_uri: str,
    target: str,
    sink: SinkSpec = SinkSpec(),
    inputs: Iterable[str] = (),
) -> str:
    """Overwrite ``{base_uri}/{target}/`` with Parquet and return that path.

    ``direct``  Spark's overwrite: the old output is gone if the job then fails.
    ``staged``  written next to the target and renamed once complete.
    ``auto``    staged where a rename is cheap, else direct.
    ``versioned``  a folder of its own for each output, see :func:`read_version`;
                the path returned is that of the version.

    With ``partition_by`` only the partitions present in the result are replaced,
    and Spark itself stages them.
    """
    path = target_path(base_uri, target)
    refuse_overlap(frame.sparkSession, path, inputs)
    require_unique_columns(frame)
    _require_partition_columns(frame, sink)
    if sink.partition_by:
        (
            frame.write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy(*sink.partition_by)
            .parquet(path)
        )
        return path
    if sink.mode == "versioned":
        return _write_version(frame, path, sink.keep)
    scheme = _file_system(frame.sparkSession, base_uri)[1].getScheme()
    staged = sink.mode == "staged" or (sink.mode == "auto" and scheme in RENAME_SCHEMES)
    if not staged:
        frame.write.mode("overwrite").parquet(path)
        return path
    flat = target.replace("/", "-")
    staging = f"{base_uri.rstrip('/')}/.staging/{flat}-{uuid.uuid4().hex}"
    frame.write.mode("errorifexists").parquet(staging)
    _swap_in(frame.sparkSession, staging, path.rstrip("/"))
    return path


def write_table(frame: DataFrame, name: str, sink: SinkSpec = SinkSpec()) -> str:
    """Overwrite a catalog table, making its namespace if there is none.

    With ``partition_by`` an existing table keeps its other partitions.
    """
    if not _IDENTIFIER.fullmatch(name):
        raise SpecError(f"table name {name!r} is not an identifier")
    require_unique_columns(frame)
    _require_partition_columns(frame, sink)
    session = frame.sparkSession
    if "." in name:
        ensure_namespace(session, name.rsplit(".", 1)[0])
    if sink.partition_by and session.catalog.tableExists(name):
        columns = session.table(name).columns
        if set(columns) != set(frame.columns):
            raise SpecError(f"table {name} has the columns {columns}, not {frame.columns}")
        with settings_for(session, {"spark.sql.sources.partitionOverwriteMode": "dynamic"}):
            frame.select(*columns).write.mode("overwrite").insertInto(name)
        return name
    writer = frame.write.mode("overwrite").format("parquet")
    if sink.partition_by:
        writer = writer.partitionBy(*sink.partition_by)
    writer.saveAsTable(name)
    return name


def preview(frame: DataFrame, rows: int = 20) -> DataFrame:
    """Print the first rows; used when a job has nowhere to write."""
    log.warning("no target or no base location, showing the first %d rows", rows)
    head = frame.limit(rows)
    head.show(rows, truncate=False)
    return head


def namespace_exists(spark: SparkSession, name: str) -> bool:
    return spark.catalog.databaseExists(name)


def ensure_namespace(spark: SparkSession, name: str, location: str | None = None) -> bool:
    """Create a namespace unless it exists; tells whether it was created."""
    if not _IDENTIFIER.fullmatch(name):
        raise SpecError(f"namespace {name!r} is not an identifier")
    if namespace_exists(spark, name):
        return False
    where = " LOCATION '" + location.replace("'", r"\'") + "'" if location else ""
    spark.sql(f"CREATE SCHEMA IF NOT EXISTS {name}{where}")
    return True
