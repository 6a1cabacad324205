"""Errors raised before any Spark work starts."""


class SpecError(ValueError):
    """A job, source, sink, rule or parameter is declared wrongly."""


class ParameterError(SpecError):
    """A job parameter is missing, unknown or of the wrong type."""
