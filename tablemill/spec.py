"""Declarative job specs: plain dataclasses, checked before any read."""

from __future__ import annotations

import os
import re
from collections.abc import Mapping
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

import yaml

from tablemill.errors import SpecError
from tablemill.params import ParamSpec

SOURCE_TYPES = ("query", "table")
SINK_MODES = ("auto", "staged", "direct", "versioned")
_STATEMENT = re.compile(r"[\s(]*(select|with)\b", re.IGNORECASE)
_TEMPLATE_MARK = re.compile(r"\{\{|\{%")


def read_yaml(source: str | Path) -> Any:
    """Parse YAML text or a YAML file, with the C parser where there is one."""
    text = source.read_text(encoding="utf-8") if isinstance(source, Path) else source
    return yaml.load(text, Loader=getattr(yaml, "CSafeLoader", yaml.SafeLoader))


def column_names(raw: Any) -> tuple[str, ...]:
    """One column name or a list of them."""
    return (raw,) if isinstance(raw, str) else tuple(raw or ())


@dataclass(frozen=True)
class SourceSpec:
    """A named input: a query run at the source, or a table read by name.

    ``split_by`` are key columns by which a connector's read is dealt out over tasks.
    """

    name: str
    type: str
    text: str
    connection: str | None = None
    split_by: tuple[str, ...] = ()

    @classmethod
    def from_dict(cls, name: str, raw: Mapping[str, Any]) -> SourceSpec:
        if not isinstance(raw, Mapping):
            raise SpecError(f"source {name}: expected a mapping")
        kind = raw.get("type")
        if kind not in SOURCE_TYPES:
            raise SpecError(f"Unknown source type: {kind} (source {name})")
        # A table name may sit under either key.
        text = raw.get("query") or (raw.get("table") if kind == "table" else None)
        if not isinstance(text, str) or not text.strip():
            raise SpecError(f"source {name}: a {kind} source needs its text")
        split_by = column_names(raw.get("split_by"))
        return cls(name, kind, text.strip(), raw.get("connection"), split_by)

    @property
    def is_query(self) -> bool:
        """A ``table`` source that carries a SELECT is a query."""
        return self.type == "query" or bool(_STATEMENT.match(self.text))


@dataclass(frozen=True)
class SinkSpec:
    """How the result is written; see :mod:`tablemill.sinks`."""

    mode: str = "auto"
    partition_by: tuple[str, ...] = ()
    table: bool = False
    # Versioned targets: how many versions stay.
    keep: int = 3

    @classmethod
    def from_dict(cls, raw: Mapping[str, Any] | None) -> SinkSpec:
        if not isinstance(raw or {}, Mapping):
            raise SpecError("sink: expected a mapping")
        raw = dict(raw or {})
        unknown = set(raw) - {"mode", "partition_by", "table", "keep"}
        if unknown:
            raise SpecError(f"sink: unknown keys {sorted(unknown)}")
        columns = column_names(raw.get("partition_by"))
        keep = raw.get("keep", cls.keep)
        spec = cls(raw.get("mode", "auto"), columns, bool(raw.get("table", False)), keep)
        if spec.mode not in SINK_MODES:
            raise SpecError(f"sink: unknown mode {spec.mode!r}")
        if spec.mode == "versioned" and (spec.partition_by or spec.table):
            raise SpecError("sink: a version is a whole output, neither partitions nor a table")
        if type(keep) is not int or keep < 1:
            raise SpecError("sink: keep must be 1 or more versions")
        return spec


@dataclass(frozen=True)
class JobSpec:
    """Sources, one SQL statement, a rename map and a target."""

    job_name: str
    sources: Mapping[str, SourceSpec] = field(default_factory=dict)
    sql: str | None = None
    target_table: str | None = None
    mapping: Mapping[str, str] = field(default_factory=dict)
    params: Mapping[str, ParamSpec] = field(default_factory=dict)
    sink: SinkSpec = SinkSpec()
    quality: tuple[Mapping[str, Any], ...] = ()
    # What a failed quality rule does to a run: "report" it or "fail" the job.
    on_failed_rule: str = "report"
    # Where copies of the rows that break a rule go; params may fill the name.
    quarantine: str | None = None
    # SQL settings that hold while the job's statement is analysed.
    settings: Mapping[str, str] = field(default_factory=dict)
    # Result columns that have the type of a sum: column -> (source, its column).
    sum_types: Mapping[str, tuple[str, str]] = field(default_factory=dict)

    @classmethod
    def from_dict(cls, raw: Mapping[str, Any], default_name: str = "job") -> JobSpec:
        if not isinstance(raw, Mapping):
            raise SpecError("a job spec must be a mapping")
        known = {
            *("job_name", "sources", "query", "mapping", "params", "sink", "quality"),
            *("on_failed_rule", "quarantine", "settings", "sum_types"),
        }
        unknown = sorted(set(raw) - known)
        if unknown:
            raise SpecError(f"job spec: unknown keys {unknown}")
        for section in ("sources", "query", "mapping", "params", "settings", "sum_types"):
            if not isinstance(raw.get(section) or {}, Mapping):
                raise SpecError(f"job spec: {section} must be a mapping")
        query = raw.get("query") or {}
        mapping = raw.get("mapping") or {}
        if not all(isinstance(k, str) and isinstance(v, str) for k, v in mapping.items()):
            raise SpecError("mapping: column names must be strings")
        on_failed_rule = raw.get("on_failed_rule", "report")
        if on_failed_rule not in ("report", "fail"):
            raise SpecError(f"on_failed_rule: {on_failed_rule!r} is neither report nor fail")
        if raw.get("quarantine") and not raw.get("quality"):
            raise SpecError("quarantine: there are no quality rules to break")
        settings = {key: str(value) for key, value in (raw.get("settings") or {}).items()}
        if not all(key.startswith("spark.sql.") for key in settings):
            raise SpecError("settings: only spark.sql settings can be made for a job")
        sum_types = {}
        for column, origin in (raw.get("sum_types") or {}).items():
            source, _, summed = str(origin).partition(".")
            if source not in (raw.get("sources") or {}) or not summed:
                raise SpecError(f"sum_types: {column} needs <source>.<column>, not {origin!r}")
            sum_types[column] = (source, summed)
        return cls(
            job_name=str(raw.get("job_name") or default_name),
            sources={
                name: SourceSpec.from_dict(name, source)
                for name, source in (raw.get("sources") or {}).items()
            },
            sql=query.get("sql"),
            target_table=query.get("target_table"),
            mapping=dict(mapping),
            params={
                name: ParamSpec.from_dict(name, param)
                for name, param in (raw.get("params") or {}).items()
            },
            sink=SinkSpec.from_dict(raw.get("sink")),
            quality=tuple(raw.get("quality") or ()),
            on_failed_rule=on_failed_rule,
            quarantine=raw.get("quarantine"),
            settings=settings,
            sum_types=sum_types,
        )

    @classmethod
    def load(cls, path: str | os.PathLike[str]) -> JobSpec:
        """Read a YAML spec; a missing file raises ``FileNotFoundError``."""
        path = Path(path)
        if not path.is_file():
            raise FileNotFoundError(f"job spec not found: {path}")
        text = path.read_text(encoding="utf-8")
        if _TEMPLATE_MARK.search(text):
            raise SpecError(
                f"{path.name} holds template marks; declare the values under 'params' "
                "and use :name in SQL, {name} in names"
            )
        return cls.from_dict(read_yaml(text), default_name=path.name.split(".")[0])
