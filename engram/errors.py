"""Errors of the engine."""


class EngramError(Exception):
    """Base of all errors raised on purpose."""


class EmbedderError(EngramError):
    """An embedder failed or returned something unusable."""


class ConfigError(EngramError):
    """A configuration file is missing or invalid."""


class InvalidArgumentError(EngramError):
    """An argument breaks a rule; nothing was changed."""


class SessionParseError(EngramError):
    """A line of a session file is not valid JSON."""

    def __init__(self, source_uri: str, line_number: int):
        super().__init__(f"Malformed session line {line_number} in {source_uri}")
        self.source_uri, self.line_number = source_uri, line_number
