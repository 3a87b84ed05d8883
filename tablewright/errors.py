"""Errors. Each has a message for users and details for logs."""

from __future__ import annotations

from typing import Any


class TablewrightError(Exception):
    def __init__(self, message: str, *, user_message: str | None = None, details: dict[str, Any] | None = None) -> None:
        super().__init__(message)
        self.user_message, self.details = user_message or message, dict(details or {})


class ConfigError(TablewrightError):
    """Settings or contracts are wrong."""


class SourceError(TablewrightError):
    """A source cannot be read."""


class UnsupportedFile(SourceError):
    """A file is refused."""


class ValidationFailed(TablewrightError):
    """A table must not be processed."""


class ProcessingFailed(TablewrightError):
    """A step failed."""


class CalculationFailed(TablewrightError):
    """A measure cannot be calculated."""


class SinkError(TablewrightError):
    """A result cannot be written."""


class FeatureUnavailable(TablewrightError):
    """An optional part is switched off or not installed."""
