"""What a connection label stands for: how to reach its tables."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, field, fields
from pathlib import Path
from typing import Any

from tablemill.errors import SpecError
from tablemill.spec import column_names, read_yaml

KINDS = ("catalog", "files", "connector")


@dataclass(frozen=True)
class Connection:
    """One labelled place to read from.

    ``catalog``    names resolve in the session's catalog.
    ``files``      tables are folders or files under ``base_path``; ``views``
                   are SQL over them, made in the order given; ``schemas`` may
                   give a table's columns as DDL, else Spark infers them.
    ``connector``  a Spark data source (``bigquery``, ``jdbc``, ...) that takes a
                   table name or a query as an option; ``bytes`` says how much.
    """

    label: str
    kind: str = "catalog"
    format: str = "parquet"
    base_path: str | None = None
    tables: Mapping[str, str] = field(default_factory=dict)
    views: Mapping[str, str] = field(default_factory=dict)
    schemas: Mapping[str, str] = field(default_factory=dict)
    options: Mapping[str, str] = field(default_factory=dict)
    # About how many bytes one read gives, where the source itself does not tell.
    bytes: int | None = None
    # Connectors: the key columns by which a table's read is dealt out, and into how many parts.
    split_by: Mapping[str, tuple[str, ...]] = field(default_factory=dict)
    splits: int | None = None
    # Files: the tables are targets of versioned sinks, of which the newest version is read.
    versioned: bool = False

    def __post_init__(self) -> None:
        if self.kind not in KINDS:
            raise SpecError(f"connection {self.label}: unknown kind {self.kind!r}")
        if self.kind == "files" and not self.base_path:
            raise SpecError(f"connection {self.label}: files need a base_path")
        if set(self.tables) & set(self.views):
            raise SpecError(f"connection {self.label}: a table and a view share a name")
        if self.splits is not None and self.splits < 1:
            raise SpecError(f"connection {self.label}: splits must be 1 or more")

    @classmethod
    def from_dict(
        cls, label: str, raw: Mapping[str, Any], base_path: str | None = None
    ) -> Connection:
        raw = dict(raw)
        unknown = set(raw) - {f.name for f in fields(cls) if f.name != "label"}
        if unknown:
            raise SpecError(f"connection {label}: unknown keys {sorted(unknown)}")
        if base_path and raw.get("kind") == "files":
            raw["base_path"] = base_path
        if "split_by" in raw:
            raw["split_by"] = {t: column_names(keys) for t, keys in raw["split_by"].items()}
        return cls(label=label, **raw)

    def path_of(self, table: str) -> str:
        if table not in self.tables:
            raise SpecError(f"connection {self.label}: no table or view named {table!r}")
        return f"{self.base_path.rstrip('/')}/{self.tables[table]}"

    def names_before(self, view: str | None) -> list[str]:
        """Tables and views; with ``view`` only those it may build on."""
        names = [*self.tables, *self.views]
        return names[: names.index(view)] if view else names


def load_connections(
    path: str | os.PathLike[str], base_path: str | None = None
) -> dict[str, Connection]:
    """Read label -> connection from YAML; ``base_path`` overrides the file roots."""
    path = Path(path)
    if not path.is_file():
        raise FileNotFoundError(f"connections file not found: {path}")
    raw = read_yaml(path) or {}
    return {
        label: Connection.from_dict(label, entry, base_path) for label, entry in raw.items()
    }
