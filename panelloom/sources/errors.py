"""Errors raised before any job starts."""


class SourceError(ValueError):
    """A source cannot be read as asked."""


class UnknownSeriesError(SourceError):
    """The catalog has no such series."""
