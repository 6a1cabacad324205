"""Declarative table jobs on Spark."""

from tablemill.errors import ParameterError, SpecError
from tablemill.groups import JobGroups
from tablemill.plans import shipped_job, shipped_jobs
from tablemill.quality import Rule, check
from tablemill.runner import RunResult, TableJob, plan_job, run_group, run_job
from tablemill.session import build_session, job_session
from tablemill.sources import Connection, SourceReader, load_connections
from tablemill.spec import JobSpec, SinkSpec, SourceSpec

__all__ = [
    "Connection",
    "JobGroups",
    "JobSpec",
    "ParameterError",
    "Rule",
    "RunResult",
    "SinkSpec",
    "SourceReader",
    "SourceSpec",
    "SpecError",
    "TableJob",
    "build_session",
    "check",
    "job_session",
    "load_connections",
    "plan_job",
    "run_group",
    "run_job",
    "shipped_job",
    "shipped_jobs",
]
