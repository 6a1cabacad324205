"""Spark sessions: one profile for new ones, one isolated session per job."""

from __future__ import annotations

import contextlib
import io
import logging
import os
import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator, Mapping

from pyspark import SparkConf
from pyspark.sql import DataFrame, SparkSession

log = logging.getLogger(__name__)

# Settings of this package; any session may set them.
PARTITION_BYTES_KEY = "tablemill.partitionBytes"
MAX_PARTITIONS_KEY = "tablemill.maxPartitions"
MAX_READ_TASKS_KEY = "tablemill.maxReadTasks"
UNKNOWN_SOURCE_BYTES_KEY = "tablemill.unknownSourceBytes"
SINGLE_READ_BYTES_KEY = "tablemill.maxSingleReadBytes"
SHARE_FROM_BYTES_KEY = "tablemill.shareFromBytes"
UNPACKED_KEY = "tablemill.unpackedFactor"

INITIAL_PARTITIONS = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
READ_SPLIT = "spark.sql.files.maxPartitionBytes"
MERGE_TO = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
# Spark compresses what it shuffles; a shuffled byte is this many in a hash table.
UNSHUFFLED_FACTOR = 16
DEFAULTS = {
    # Shuffled bytes that suit one task.
    PARTITION_BYTES_KEY: 128 * 1024**2,
    # Every map task keeps a block per partition, so their number has a bound: a
    # million holds 128 TB. It is logged when it bites.
    MAX_PARTITIONS_KEY: 1_000_000,
    # Scans of more files than this read longer splits.
    MAX_READ_TASKS_KEY: 200_000,
    # What a source is taken to hold if neither it nor its connection tells.
    # Adaptive execution merges partitions that turn out small.
    UNKNOWN_SOURCE_BYTES_KEY: 256 * 1024**3,
    # A JDBC source known to be larger than this must be split.
    SINGLE_READ_BYTES_KEY: 16 * 1024**3,
    # From this input size on, what several jobs of a group compute alike is written
    # once; below it a Spark job more costs more than it saves. -1: never.
    SHARE_FROM_BYTES_KEY: 1024**3,
    # How many times larger the rows of a columnar file are in a task's hash table than
    # in the file: key columns take 6 bytes a row there and about 200 here.
    UNPACKED_KEY: 32,
}
MAX_SPLIT_BYTES = 1024**3
# Sources without statistics report a size near the largest long.
UNKNOWN_BYTES = 1 << 60

# Shuffles start wide and AQE merges small partitions and splits skewed ones,
# so one profile serves a laptop and a cluster; see size_tasks. Settings given to
# spark-submit come first.
PROFILE = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128MB",
}

# These can only be given before Spark starts. Compiled stages are kept for the
# next run; the default of 100 is less than a group of jobs needs.
START_PROFILE = {
    "spark.sql.codegen.cache.maxEntries": "1000",
    "spark.scheduler.mode": "FAIR",
}


def build_session(
    app_name: str = "tablemill",
    master: str | None = None,
    settings: Mapping[str, str] | None = None,
) -> SparkSession:
    """Get or create a session with the profile above."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    start = {key: value for key, value in START_PROFILE.items() if not _submitted(key)}
    for key, value in {**start, **(settings or {})}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    for key, value in PROFILE.items():
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, value)
    return spark


def _submitted(key: str) -> bool:
    """Whether a setting was given to spark-submit, where a builder would override it."""
    if "PYSPARK_GATEWAY_PORT" in os.environ:
        # The JVM that spark-submit started is there to be asked.
        return SparkConf().contains(key)
    return f"{key}=" in os.environ.get("PYSPARK_SUBMIT_ARGS", "")


def job_session(spark: SparkSession) -> SparkSession:
    """A session with its own temp views and ``spark``'s SQL settings.

    Jobs give the same view name to different tables, so jobs that run side by
    side must not share views. ``newSession`` drops settings made at run time;
    they are carried over. The time zone is pinned because truncating a
    timestamp to its month depends on it.
    """
    session = spark.newSession()
    fresh = session.conf.getAll
    wanted = {**spark.conf.getAll, "spark.sql.session.timeZone": "UTC"}
    for key, value in wanted.items():
        # Most settings are the same already; each call to the JVM takes time.
        if fresh.get(key) != value and key.startswith(("spark.sql.", "tablemill.")):
            if key.startswith("tablemill.") or session.conf.isModifiable(key):
                session.conf.set(key, value)
    return session


def package_setting(session: SparkSession, key: str) -> int:
    return int(session.conf.get(key, None) or DEFAULTS[key])


def input_bytes(frame: DataFrame) -> int | None:
    """Size of the files or tables a frame reads, as Spark already knows it.

    None if some source does not tell.
    """
    leaves = frame._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    return sum(sizes) if all(size < UNKNOWN_BYTES for size in sizes) else None


def plan_text(frame: DataFrame) -> str:
    """The formatted plan of a frame."""
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        frame.explain("formatted")
    return text.getvalue()


def unset_sizes(session: SparkSession) -> tuple[str, ...]:
    """The size settings that the user has left open."""
    open_ = [k for k in (INITIAL_PARTITIONS, READ_SPLIT) if session.conf.get(k, None) is None]
    if session.conf.get(MERGE_TO, None) in (None, PROFILE[MERGE_TO]):
        open_.append(MERGE_TO)
    return tuple(open_)


def size_tasks(
    session: SparkSession,
    n_bytes: int,
    settings: Iterable[str] = (INITIAL_PARTITIONS, READ_SPLIT),
    factor: int = 1,
) -> None:
    """Fit the number of tasks to ``n_bytes`` of input.

    A fixed number of shuffle partitions suits one data size only: 200 for a
    100 TB shuffle would hold 500 GB each. Adaptive execution merges what turns
    out small, so starting wide is cheap; ``spark.sql.shuffle.partitions`` is
    never undercut. Very large scans read longer splits, to keep the number of
    map tasks, and with it the number of shuffle blocks, in bounds.

    ``factor`` is how many bytes a byte of input becomes in a task. Grouping by a
    key that hardly repeats keeps every row of a task, so splits and partitions
    are smaller by it.
    """
    least = int(session.conf.get("spark.sql.shuffle.partitions"))
    each = package_setting(session, PARTITION_BYTES_KEY)
    most = package_setting(session, MAX_PARTITIONS_KEY)
    needed = -(-n_bytes * factor // each)
    if needed > most:
        log.warning(
            "%d bytes would need %d partitions of %d bytes; %s allows %d",
            *(n_bytes, needed, each, MAX_PARTITIONS_KEY, most),
        )
    wanted = max(least, min(needed, most))
    read_tasks = package_setting(session, MAX_READ_TASKS_KEY)
    split = max(each // factor, min(-(-n_bytes // read_tasks), MAX_SPLIT_BYTES))
    values = {
        INITIAL_PARTITIONS: str(wanted),
        READ_SPLIT: str(split),
        MERGE_TO: str(max(each // UNSHUFFLED_FACTOR, 1)),
    }
    for key in settings:
        session.conf.set(key, values[key])


def adopt(frame: DataFrame, session: SparkSession) -> DataFrame:
    """The same logical plan, owned by ``session``."""
    if frame.sparkSession is session:
        return frame
    name = f"tablemill_{uuid.uuid4().hex}"
    frame.createGlobalTempView(name)
    try:
        database = session.conf.get("spark.sql.globalTempDatabase", "global_temp")
        return session.table(f"{database}.{name}")
    finally:
        frame.sparkSession.catalog.dropGlobalTempView(name)


@contextlib.contextmanager
def settings_for(session: SparkSession, settings: Mapping[str, str]) -> Iterator[None]:
    """SQL settings that hold inside the block."""
    before = {key: session.conf.get(key, None) for key in settings}
    try:
        for key, value in settings.items():
            session.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            session.conf.unset(key) if value is None else session.conf.set(key, value)


@contextlib.contextmanager
def described(spark: SparkSession, text: str) -> Iterator[None]:
    """Label the Spark jobs of this block in the UI and event log."""
    context = spark.sparkContext
    before = context.getLocalProperty("spark.job.description")
    context.setJobDescription(text)
    try:
        yield
    finally:
        context.setLocalProperty("spark.job.description", before)


def scratch_uri(spark: SparkSession, purpose: str) -> str:
    """A fresh folder for tables that a query writes and reads back.

    Every executor must reach it, so it lies in the folder the cluster names in
    ``spark.checkpoint.dir``. Only a local run without that setting may use the
    machine's own temporary folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        root = tempfile.mkdtemp(prefix="tablemill-")
    return f"{root.rstrip('/')}/tablemill/{purpose}-{uuid.uuid4().hex}"
