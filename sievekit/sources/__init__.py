"""Sources and sinks."""

from .tables import table, TABLES  # noqa: F401
