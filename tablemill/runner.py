"""Running jobs: one, or a group side by side, with metrics and a report."""

from __future__ import annotations

import datetime as dt
import logging
import time
import uuid
from collections.abc import Iterable, Mapping
from concurrent.futures import Future, ThreadPoolExecutor
from dataclasses import dataclass, replace
from functools import reduce
from typing import Any

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablemill import steps
from tablemill.errors import SpecError
from tablemill.groups import JobGroups
from tablemill.metrics import JobMetrics, collected, observed
from tablemill.operators.projection import rename_columns, require_unique_columns
from tablemill.params import bind_params, fill_name, parse_params
from tablemill.plans import shipped_job, transform
from tablemill.quality import Rule, check, failing_rows
from tablemill.session import described, job_session, plan_text
from tablemill.sharing import Copy, Key, Shared, plan_sharing
from tablemill.sinks import remove_folder, write_parquet, write_table
from tablemill.sources import Connection, SourceReader, read_sources
from tablemill.spec import JobSpec

log = logging.getLogger(__name__)

REPORT_SCHEMA = (
    "run_id string, environment string, job string, target string, status string, "
    "n_rows bigint, n_nulls map<string, bigint>, n_failed_rules bigint, "
    "started_at timestamp, seconds double, error string"
)


class TableJob:
    """A job in three steps, on the session it is given.

    ``frames`` are sources that already exist as DataFrames; they replace
    declared sources of the same name.
    """

    def __init__(
        self,
        spark: SparkSession,
        spec: JobSpec | Mapping[str, Any],
        params: str | Mapping[str, Any] | None = None,
        connections: Mapping[str, Connection] | None = None,
        base_uri: str | None = None,
        frames: Mapping[str, DataFrame] | None = None,
        retries: int = 3,
        max_wait: float = 60.0,
        strict: bool = False,
        own_session: bool = False,
        shared: Mapping[Key, Copy] | None = None,
    ) -> None:
        self.spark = spark
        self.spec = spec if isinstance(spec, JobSpec) else JobSpec.from_dict(spec)
        self.params = bind_params(self.spec.params, params)
        self.job_name = fill_name(self.spec.job_name, self.params)
        target = self.spec.target_table
        self.target_table = fill_name(target, self.params) if target else None
        self.rules = [Rule.from_dict(raw) for raw in self.spec.quality]
        aside = self.spec.quarantine
        self.quarantine = fill_name(aside, self.params) if aside else None
        self.base_uri = base_uri
        self.reader = SourceReader(spark, connections, own_session, shared)
        self.sources: dict[str, DataFrame] = dict(frames or {})
        self.transformed_df: DataFrame | None = None
        self.retries = retries
        self.max_wait = max_wait
        self.strict = strict

    def extract(self) -> dict[str, DataFrame]:
        log.info("%s: reading sources", self.job_name)
        missing = {n: s for n, s in self.spec.sources.items() if n not in self.sources}
        self.sources.update(
            read_sources(self.reader, missing, self.params, self.retries, self.max_wait)
        )
        return self.sources

    def transform(self) -> DataFrame:
        log.info("%s: planning the query", self.job_name)
        self.transformed_df = transform(
            self.spark, self.sources, self.spec.sql, self.params, self.spec.settings
        )
        return self.transformed_df

    def result(self) -> DataFrame:
        """The renamed result, still lazy.

        A partition column that the query does not give is taken from the
        parameter of that name, so a run-dated job needs no column for its date.
        """
        frame = self.transformed_df
        for column, (source, summed) in self.spec.sum_types.items():
            kind = self.sources[source].select(F.sum(summed)).schema[0].dataType
            frame = frame.withColumn(column, F.col(column).cast(kind))
        frame = rename_columns(frame, self.spec.mapping, self.strict)
        for name, value in self.run_partition(frame).items():
            frame = frame.withColumn(name, F.lit(value))
        return frame

    def run_partition(self, frame: DataFrame) -> dict[str, Any]:
        """Partition columns that hold one parameter value throughout the run."""
        return {
            name: self.params[name]
            for name in self.spec.sink.partition_by
            if name not in frame.columns and self.params.get(name) is not None
        }

    @property
    def writes(self) -> bool:
        return bool(self.target_table and (self.base_uri or self.spec.sink.table))

    def load(self, frame: DataFrame | None = None) -> str | None:
        """Write the renamed result, or show it when there is nowhere to write."""
        frame = self.result() if frame is None else frame
        log.info("%s: loading the result", self.job_name)
        return steps.load(
            frame,
            target_table=self.target_table,
            base_uri=self.base_uri,
            sink=self.spec.sink,
            inputs=self.reader.input_paths,
        )

    def checks(self, frame: DataFrame) -> DataFrame | None:
        """The spec's quality rules on the result, one row each; lazy."""
        return check(frame, self.rules, self.sources) if self.rules else None

    def set_aside(self, frame: DataFrame, checks: DataFrame) -> DataFrame | None:
        """Write the rows of the result that break a rule; None, and no write, if none does."""
        about_rows = [rule for rule in self.rules if rule.kind != "min_rows"]
        if checks.where("not passed and rule <> 'min_rows'").isEmpty():
            return None
        rows = failing_rows(frame, about_rows, self.sources)
        if self.spec.sink.table:
            return self.spark.read.table(write_table(rows, self.quarantine))
        where = write_parquet(rows, self.base_uri, self.quarantine, inputs=self.reader.input_paths)
        log.warning("%s: rows that break a rule are in %s", self.job_name, where)
        return self.spark.read.parquet(where)

    def reads(self) -> list[DataFrame]:
        """Frames that together read all that a run reads."""
        frame = self.plan()
        parents = {rule.options["parent"] for rule in self.rules if rule.kind == "orphan_key"}
        return [frame, *(self.sources[name] for name in sorted(parents & set(self.sources)))]

    def plan(self) -> DataFrame:
        """Extract and transform only."""
        self.extract()
        self.transform()
        return self.result()

    def run(self) -> str | None:
        log.info("%s: started", self.job_name)
        self.plan()
        where = self.load()
        log.info("%s: finished", self.job_name)
        return where


@dataclass(frozen=True)
class RunResult:
    """What a run gave. ``frame`` reads back what this run wrote, if it wrote.

    ``quarantined`` reads copies of the rows that break a rule, if the spec asks for
    them and there are any.
    """

    job: str
    target: str | None
    frame: DataFrame
    location: str | None = None
    metrics: JobMetrics | None = None
    checks: DataFrame | None = None
    explain: str | None = None
    fails_on_rules: bool = False
    quarantined: DataFrame | None = None

    def failed_rules(self) -> int | None:
        """How many quality rules the written result breaks; None without rules."""
        return None if self.checks is None else self.checks.where("not passed").count()

    @property
    def schema(self):
        return self.frame.schema


explain_text = plan_text


def _open(spark: SparkSession, spec: JobSpec | str, isolate: bool = True, **options) -> TableJob:
    spec = shipped_job(spec) if isinstance(spec, str) else spec
    session = job_session(spark) if isolate else spark
    return TableJob(session, spec, own_session=isolate, **options)


def plan_job(spark: SparkSession, spec: JobSpec | str, **options) -> DataFrame:
    """The job's result as a lazy frame, nothing written."""
    return _open(spark, spec, **options).plan()


def run_job(
    spark: SparkSession, spec: JobSpec | str, dry_run: bool = False, **options
) -> RunResult:
    """Run a job spec (or a shipped job by name).

    A dry run stops before the sink and returns the schema and the plan. Quality
    rules of the spec are checked on the written output, so the query does not
    run twice; without a sink they are checked on the result itself.
    """
    return _run(_open(spark, spec, **options), dry_run)


def _run(job: TableJob, dry_run: bool = False) -> RunResult:
    frame = job.plan()
    if dry_run:
        if job.writes:
            require_unique_columns(frame)
        log.info("%s: dry run, would write %s", job.job_name, job.target_table)
        return RunResult(job.job_name, job.target_table, frame, explain=explain_text(frame))
    if not job.writes:
        job.load(frame)
        return RunResult(
            job.job_name,
            job.target_table,
            frame,
            checks=job.checks(frame),
            fails_on_rules=job.spec.on_failed_rule == "fail",
        )
    require_unique_columns(frame)
    by_run = job.run_partition(job.transformed_df)
    by_query = [c for c in job.spec.sink.partition_by if c not in by_run]
    counted, observation = observed(frame)
    # One entry per partition that the run writes.
    parts = Observation()
    if by_query:
        counted = counted.observe(parts, F.collect_set(F.struct(*by_query)).alias("parts"))
    started = time.monotonic()
    with described(job.spark, f"job {job.job_name}"):
        location = job.load(counted)
    metrics = collected(observation, frame, time.monotonic() - started)
    log.info("%s: %d rows in %.1f s", job.job_name, metrics.rows, metrics.seconds)
    reader = job.spark.read
    written = reader.table(location) if job.spec.sink.table else reader.parquet(location)
    for name, value in by_run.items():
        written = written.filter(F.col(name) == F.lit(value))
    if by_query:
        written = written.filter(_one_of(parts.get["parts"], frame.select(*by_query).schema))
    checks, aside = job.checks(written), None
    if checks is not None and job.quarantine:
        # One row per rule, which is asked for more than once from here on.
        checks = job.spark.createDataFrame(checks.collect(), checks.schema)
        aside = job.set_aside(written, checks)
    return RunResult(
        job.job_name,
        job.target_table,
        written,
        location,
        metrics,
        checks,
        fails_on_rules=job.spec.on_failed_rule == "fail",
        quarantined=aside,
    )


def _one_of(parts: list[Row], schema: T.StructType) -> Column:
    """Rows of the partitions a run has written, as filters on partition columns."""

    def same(part: Row) -> Column:
        return reduce(
            lambda a, b: a & b,
            [F.col(f.name).eqNullSafe(F.lit(part[f.name]).cast(f.dataType)) for f in schema],
        )

    if len(schema) == 1 and all(part[0] is not None for part in parts):
        return F.col(schema[0].name).isin([part[0] for part in parts])
    return reduce(lambda a, b: a | b, [same(part) for part in parts], F.lit(False))


def _params_for(spec: JobSpec, given: Mapping[str, Any]) -> dict[str, Any]:
    return {name: value for name, value in given.items() if name in spec.params}


def _written(name: str, copies: Mapping[Key, Future]) -> dict[Key, Copy]:
    """The copies that could be written; a job computes the other sources itself."""
    done = {}
    for key, copy in copies.items():
        try:
            done[key] = copy.result()
        except Exception as problem:
            log.warning("%s computes %s of %s itself: %s", name, key[1], key[0], problem)
    return done


def run_group(
    spark: SparkSession,
    selection: str | Iterable[str],
    params: str | Mapping[str, Any] | None = None,
    specs: Mapping[str, JobSpec] | None = None,
    groups: JobGroups | None = None,
    environment: str = "dev",
    max_parallel: int = 4,
    report_uri: str | None = None,
    **options,
) -> DataFrame:
    """Run several jobs side by side and report on each.

    Every job has a session of its own, so their views cannot clash; the threads
    only submit work, Spark shares the executors out. A job that fails is
    reported and does not stop the others. A parameter goes to each job that
    declares it and must be declared by at least one.

    Quality rules are checked on every written result. A job that breaks one is
    reported with their number, and as ``failed_quality`` if its spec says so.

    Views and connector reads that several jobs compute alike are written once,
    from ``tablemill.shareFromBytes`` of input on; see :mod:`tablemill.sharing`.

    The report is one row per job; with ``report_uri`` it is appended there.
    """
    specs = dict(specs or {})
    if groups is None:
        shipped = JobGroups.shipped()
        groups = replace(shipped, jobs=tuple(dict.fromkeys([*shipped.jobs, *specs])))
    names = groups.select(selection)
    for name in names:
        specs.setdefault(name, None)
        specs[name] = specs[name] or shipped_job(name)
    given = parse_params(params)
    unknown = sorted(p for p in given if not any(p in specs[name].params for name in names))
    if unknown:
        raise SpecError(f"no selected job has the parameters {', '.join(unknown)}")
    run_id = uuid.uuid4().hex
    dry_run = options.pop("dry_run", False)

    def opened(name: str, shared: Mapping[Key, Copy] | None = None) -> TableJob:
        own = _params_for(specs[name], given)
        return _open(spark, specs[name], params=own, shared=shared, **options)

    def extracted(name: str) -> TableJob | Exception:
        try:
            job = opened(name)
            job.extract()
        except Exception as problem:
            return problem
        return job

    def run_one(name: str, job: TableJob | Exception, copies: Mapping[Key, Future]) -> tuple:
        started, clock = dt.datetime.now(dt.timezone.utc), time.monotonic()
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", name)
        target = rows = nulls = failed_rules = error = None
        try:
            if isinstance(job, Exception):
                raise job
            if copies:
                job = opened(name, _written(name, copies))
            done = _run(job, dry_run)
            target, status = done.target, "planned" if done.explain else "succeeded"
            if done.metrics:
                rows, nulls = done.metrics.rows, dict(done.metrics.nulls)
            failed_rules = done.failed_rules()
            if failed_rules:
                log.warning("job %s: %d quality rules failed", name, failed_rules)
                status = "failed_quality" if done.fails_on_rules else status
        except Exception as problem:
            log.exception("job %s failed", name)
            status, error = "failed", f"{type(problem).__name__}: {problem}"
        seconds = time.monotonic() - clock
        return (
            *(run_id, environment, name, target, status, rows, nulls, failed_rules),
            *(started, seconds, error),
        )

    with ThreadPoolExecutor(max(1, min(max_parallel, len(names)))) as pool:

        def submit(action, *args) -> Future:
            return pool.submit(inheritable_thread_target(spark)(action), *args)

        jobs = {name: submit(extracted, name) for name in names}
        jobs = {name: job.result() for name, job in jobs.items()}
        ready = {name: job for name, job in jobs.items() if isinstance(job, TableJob)}
        sharing = plan_sharing(spark, ready, opened) if len(ready) > 1 and not dry_run else []
        # Copies come first in the queue, so a job that waits for one keeps none waiting.
        copies = {one.key: (one, submit(Shared.write, one)) for one in sharing}
        tasks = []
        for name in names:
            mine = {key: copy for key, (one, copy) in copies.items() if name in one.users}
            tasks.append(submit(run_one, name, jobs[name], mine))
        rows = [task.result() for task in tasks]
        for _, copy in copies.values():
            if not copy.exception():
                remove_folder(spark, copy.result().uri)
    report = spark.createDataFrame(rows, REPORT_SCHEMA)
    if report_uri:
        report.coalesce(1).write.mode("append").parquet(report_uri)
    return report


__all__ = [
    "RunResult",
    "TableJob",
    "explain_text",
    "plan_job",
    "run_group",
    "run_job",
]
