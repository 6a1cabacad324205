"""Run metrics, counted while the result is written."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

_ROWS = "rows"


@dataclass(frozen=True)
class JobMetrics:
    rows: int
    seconds: float
    nulls: dict[str, int] = field(default_factory=dict)


def observed(frame: DataFrame) -> tuple[DataFrame, Observation]:
    """The frame with row and NULL counters attached; no extra pass is made.

    The counters sit on top of the plan, in the stage that writes, where Spark
    counts every finished task once even if executors are lost and redone.
    """
    observation = Observation()
    counters = [F.count(F.lit(1)).alias(_ROWS)]
    for position, name in enumerate(frame.columns):
        column = F.col("`" + name.replace("`", "``") + "`")
        counters.append(F.count_if(column.isNull()).alias(f"null_{position}"))
    return frame.observe(observation, *counters), observation


def collected(observation: Observation, frame: DataFrame, seconds: float) -> JobMetrics:
    """The counters after the write has finished."""
    values = observation.get
    nulls = {name: values[f"null_{i}"] for i, name in enumerate(frame.columns)}
    return JobMetrics(rows=values[_ROWS], seconds=seconds, nulls=nulls)
