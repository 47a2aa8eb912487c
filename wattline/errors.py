"""Errors raised before any Spark job starts."""


class InvalidQueryError(ValueError):
    """A query parameter is malformed or out of range."""


class InvalidConfigurationError(ValueError):
    """A resolution setting is missing or malformed."""
