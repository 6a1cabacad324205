"""Values as SQL text for statements that run outside Spark."""

from __future__ import annotations

import datetime as dt
import re
from decimal import Decimal
from typing import Any

from tablemill.errors import SpecError


def remote_literal(name: str, value: Any) -> str:
    """A parameter as SQL text for a query that runs outside Spark.

    Quoting differs between dialects, so strings are limited to characters that
    need none.
    """
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).upper()
    if isinstance(value, (int, float, Decimal)):
        return str(value)
    if isinstance(value, dt.datetime):
        return f"TIMESTAMP '{value:%Y-%m-%d %H:%M:%S.%f}'"
    if isinstance(value, dt.date):
        return f"DATE '{value:%Y-%m-%d}'"
    if isinstance(value, str) and re.fullmatch(r"[\w .,:/#@+\-]*", value):
        return f"'{value}'"
    raise SpecError(
        f"parameter {name}: {value!r} cannot be put into a remote query; "
        "filter on it in the job's SQL"
    )
