"""Sources: tables, queries and the connections they are read through."""

from tablemill.sources.connections import Connection, load_connections
from tablemill.sources.reader import SourceReader, ad_hoc, read_sources, with_retries

__all__ = [
    "Connection",
    "SourceReader",
    "ad_hoc",
    "load_connections",
    "read_sources",
    "with_retries",
]
