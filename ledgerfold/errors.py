"""Errors of the engine; their texts are part of its contract."""

from __future__ import annotations


class EngineError(Exception):
    """Base of all errors that a statement or a session can raise."""


class TranslateError(EngineError):
    """SQL text that can't be turned into statements."""

    def __init__(self, message: str):
        super().__init__(f"Translate error: Error: {message}")


class MissingNamedParameter(EngineError):
    def __init__(self, name: str):
        super().__init__(f"Translate error: Missing named parameter: {name}")


class MixedPlaceholderStyles(EngineError):
    def __init__(self):
        super().__init__("Translate error: cannot mix named and positional/indexed placeholders in one query")


class Unsupported(EngineError):
    """A statement whose shape the chosen profile doesn't run."""

    def __init__(self, message: str):
        super().__init__(f"Unsupported query shape for MVP executor: {message}")


class InvalidQuery(EngineError):
    def __init__(self, message: str):
        super().__init__(f"Invalid query: {message}")


class SyncDependencyUnavailable(EngineError):
    def __init__(self):
        super().__init__("Sync dependency is unavailable")


class MissingTimestampProvider(EngineError):
    def __init__(self):
        super().__init__("A timestamp provider is required to generate a UUID")


class Custom(EngineError):
    def __init__(self, message: str):
        super().__init__(f"Error: {message}")


class UriError(Custom):
    """A database address that can't be opened."""


class FromRowError(EngineError):
    """A result that doesn't fit the record it is decoded into."""
