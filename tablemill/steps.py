"""The same job as three plain functions, DataFrames in and out."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from tablemill import sinks
from tablemill.operators.projection import rename_columns
from tablemill.plans import transform
from tablemill.sources import Connection, SourceReader, read_sources
from tablemill.spec import SinkSpec, SourceSpec

__all__ = ["extract", "load", "transform"]


def extract(
    spark: SparkSession,
    sources: Mapping[str, SourceSpec | Mapping[str, Any]],
    connections: Mapping[str, Connection] | None = None,
    args: Mapping[str, Any] | None = None,
    retries: int = 3,
    max_wait: float = 60.0,
) -> dict[str, DataFrame]:
    """Read all sources; the result maps their names to lazy frames."""
    reader = SourceReader(spark, connections)
    return read_sources(reader, sources, args, retries, max_wait)


def load(
    frame: DataFrame,
    mapping: Mapping[str, str] | None = None,
    target_table: str | None = None,
    base_uri: str | None = None,
    sink: SinkSpec = SinkSpec(),
    inputs: Iterable[str] = (),
) -> str | None:
    """Rename, then write; without target or location show a preview instead.

    Returns where the result lies, or None after a preview.
    """
    frame = rename_columns(frame, mapping)
    if target_table and sink.table:
        return sinks.write_table(frame, target_table, sink)
    if target_table and base_uri:
        return sinks.write_parquet(frame, base_uri, target_table, sink, inputs)
    sinks.preview(frame)
    return None
