"""Which jobs a run is about: single names and named groups."""

from __future__ import annotations

import os
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field
from pathlib import Path

from tablemill.errors import SpecError
from tablemill.plans import JOBS_DIR, shipped_jobs
from tablemill.spec import read_yaml

# Fixed value: what marks a group in a selection.
PREFIX = "GROUP:"


@dataclass(frozen=True)
class JobGroups:
    """The jobs that can be run, and groups of them.

    A group that names an unknown job is refused when it is made, so a selection
    either stands for runnable jobs or is an error.
    """

    jobs: tuple[str, ...]
    groups: Mapping[str, tuple[str, ...]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        for group, members in self.groups.items():
            lost = sorted(set(members) - set(self.jobs))
            if lost or not members:
                raise SpecError(f"group {group}: unknown jobs {lost}" if lost else f"group {group} is empty")

    @classmethod
    def shipped(cls) -> JobGroups:
        return cls.load(JOBS_DIR / "groups.yaml", shipped_jobs())

    @classmethod
    def load(cls, path: str | os.PathLike[str], jobs: Iterable[str]) -> JobGroups:
        """Groups from a YAML file, group -> list of jobs."""
        path = Path(path)
        if not path.is_file():
            raise FileNotFoundError(f"groups file not found: {path}")
        raw = read_yaml(path) or {}
        if not isinstance(raw, Mapping) or not all(isinstance(v, list) for v in raw.values()):
            raise SpecError(f"{path}: expected group names with lists of jobs")
        return cls(tuple(jobs), {str(name): tuple(members) for name, members in raw.items()})

    def listing(self) -> dict[str, tuple[str, ...]]:
        """Everything a selection may be, with the jobs it stands for."""
        return {PREFIX + name: tuple(m) for name, m in self.groups.items()} | {
            job: (job,) for job in self.jobs
        }

    def select(self, selection: str | Iterable[str]) -> list[str]:
        """The jobs of a selection (or of several), each once, in order."""
        known = self.listing()
        wanted = [selection] if isinstance(selection, str) else list(selection)
        unknown = [name for name in wanted if name not in known]
        if unknown or not wanted:
            raise SpecError(f"cannot select {unknown or wanted}; use {', '.join(known)}")
        return list(dict.fromkeys(job for name in wanted for job in known[name]))
