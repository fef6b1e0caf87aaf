"""Errors of the query engine."""


class QueryError(ValueError):
    """A query that cannot be built: the first such error is kept and raised by the terminal that runs the query."""


class NotFound(LookupError):
    """No row where one was asked for."""
