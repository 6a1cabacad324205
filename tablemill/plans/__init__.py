"""From sources to a result frame: views, one SQL statement, a rename."""

from __future__ import annotations

import logging
from collections.abc import Mapping
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from tablemill.errors import SpecError
from tablemill.session import adopt, settings_for
from tablemill.spec import JobSpec

log = logging.getLogger(__name__)

JOBS_DIR = Path(__file__).resolve().parent.parent / "jobs"


def register_views(session: SparkSession, frames: Mapping[str, DataFrame]) -> None:
    """Expose every frame to the session's SQL under its name."""
    for name, frame in frames.items():
        adopt(frame, session).createOrReplaceTempView(name)
        log.debug("view %s is registered", name)


def transform(
    session: SparkSession,
    frames: Mapping[str, DataFrame],
    sql: str,
    args: Mapping[str, Any] | None = None,
    settings: Mapping[str, str] | None = None,
) -> DataFrame:
    """Register the frames and run one statement over them (lazily).

    ``settings`` hold while the statement is analysed, which is when types are decided.
    """
    if not sql:
        raise SpecError("the job has no SQL")
    register_views(session, frames)
    with settings_for(session, settings or {}):
        return session.sql(sql, args=dict(args or {}))


def shipped_jobs() -> list[str]:
    return sorted(p.stem for p in JOBS_DIR.glob("*.yaml") if p.stem != "groups")


def shipped_job(name: str) -> JobSpec:
    """A job that comes with the package, by file name."""
    if name not in shipped_jobs():
        raise SpecError(f"no job named {name!r}; there are {', '.join(shipped_jobs())}")
    return JobSpec.load(JOBS_DIR / f"{name}.yaml")
