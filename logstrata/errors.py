"""The engine's one exception."""


class EngineError(Exception):
    """A statement that cannot be parsed, planned or run; the message says why."""
