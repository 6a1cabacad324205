"""Typed job parameters.

Parameters reach Spark as named SQL markers (``:name``), never as text pasted
into the statement, so Catalyst sees literals: predicates on an unset optional
parameter fold away and the others are pushed to the scan.
"""

from __future__ import annotations

import datetime as dt
import json
import re
from collections.abc import Mapping
from dataclasses import dataclass
from decimal import Decimal, InvalidOperation
from typing import Any

from tablemill.errors import ParameterError

_NAME = re.compile(r"\{(\w+)\}")
_SAFE = re.compile(r"[A-Za-z0-9_.\-]+")


def _to_int(value: Any) -> int:
    # JSON numbers arrive as Decimal; int() would cut any fraction off.
    whole = int(value)
    if isinstance(value, bool) or (not isinstance(value, str) and value != whole):
        raise ValueError("not a whole number")
    return whole


def _to_bool(value: Any) -> bool:
    if isinstance(value, bool):
        return value
    text = str(value).strip().lower()
    if text in ("true", "false"):
        return text == "true"
    raise ValueError("not true or false")


def _to_date(value: Any) -> dt.date:
    if isinstance(value, dt.datetime):
        raise ValueError("a timestamp, not a date")
    return value if isinstance(value, dt.date) else dt.date.fromisoformat(str(value))


def _to_timestamp(value: Any) -> dt.datetime:
    if isinstance(value, dt.datetime):
        return value
    if isinstance(value, dt.date):
        return dt.datetime(value.year, value.month, value.day)
    return dt.datetime.fromisoformat(str(value))


def _to_string(value: Any) -> str:
    if isinstance(value, (dict, list)):
        raise ValueError("not a single value")
    return str(value)


CONVERTERS = {
    "int": _to_int,
    "double": float,
    "decimal": lambda value: Decimal(str(value)),
    "string": _to_string,
    "boolean": _to_bool,
    "date": _to_date,
    "timestamp": _to_timestamp,
}


@dataclass(frozen=True)
class ParamSpec:
    """One declared parameter.

    ``required`` has no default and must be given; ``optional`` may stay unset,
    and an empty string counts as unset. Unset optional parameters bind to NULL.
    """

    name: str
    type: str = "string"
    default: Any = None
    required: bool = False
    optional: bool = False

    @classmethod
    def from_dict(cls, name: str, raw: Mapping[str, Any] | None) -> ParamSpec:
        if not isinstance(raw or {}, Mapping):
            raise ParameterError(f"parameter {name}: expected a mapping")
        raw = dict(raw or {})
        unknown = set(raw) - {"type", "default", "required", "optional"}
        if unknown:
            raise ParameterError(f"parameter {name}: unknown keys {sorted(unknown)}")
        spec = cls(name=name, **raw)
        if spec.type not in CONVERTERS:
            raise ParameterError(f"parameter {name}: unknown type {spec.type!r}")
        if not (spec.required or spec.optional) and spec.default is None:
            raise ParameterError(
                f"parameter {name}: give a default, or mark it required or optional"
            )
        if spec.default is not None:
            spec.convert(spec.default)
        return spec

    def convert(self, value: Any) -> Any:
        try:
            return CONVERTERS[self.type](value)
        except (ValueError, TypeError, InvalidOperation, OverflowError) as error:
            raise ParameterError(
                f"parameter {self.name}: {value!r} is not a valid {self.type} ({error})"
            ) from error

    def bind(self, given: Mapping[str, Any]) -> Any:
        value = given.get(self.name)
        if self.optional and value == "":
            value = None
        if value is not None:
            return self.convert(value)
        if self.default is not None:
            return self.convert(self.default)
        if self.required:
            raise ParameterError(f"parameter {self.name} is required")
        return None


def parse_params(text: str | Mapping[str, Any] | None) -> dict[str, Any]:
    """Read parameters from a JSON object (or pass a mapping through)."""
    if text is None or text == "":
        return {}
    if isinstance(text, Mapping):
        return dict(text)
    try:
        # Decimals stay exact; a money threshold must not go through a float.
        values = json.loads(text, parse_float=Decimal)
    except json.JSONDecodeError as error:
        raise ParameterError(f"job parameters are not valid JSON: {error}") from error
    if not isinstance(values, dict):
        raise ParameterError("job parameters must be a JSON object")
    return values


def bind_params(
    declared: Mapping[str, ParamSpec], given: str | Mapping[str, Any] | None
) -> dict[str, Any]:
    """Check ``given`` against the declarations and fill in defaults."""
    given = parse_params(given)
    unknown = sorted(set(given) - set(declared))
    if unknown:
        raise ParameterError(f"unknown parameters: {', '.join(unknown)}")
    return {name: spec.bind(given) for name, spec in declared.items()}


def fill_name(template: str, values: Mapping[str, Any]) -> str:
    """Fill ``{parameter}`` in a job or target name.

    Only characters that are safe in a path segment are let through, so a value
    can neither leave the output folder nor silently give an empty suffix.
    """

    def substitute(match: re.Match[str]) -> str:
        value = values.get(match.group(1))
        if value is None:
            raise ParameterError(f"name {template!r} needs parameter {match.group(1)}")
        text = str(value)
        if not _SAFE.fullmatch(text):
            raise ParameterError(f"value {text!r} cannot be part of the name {template!r}")
        return text

    return _NAME.sub(substitute, template)
