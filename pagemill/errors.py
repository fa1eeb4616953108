"""Exceptions of the driver side; errors of single documents are values in an ``error`` column."""

from __future__ import annotations


class PagemillError(Exception):
    """Base of this package's errors."""


class UnknownModelError(PagemillError):
    """No catalog entry has the asked name."""

    def __init__(self, name: str, supported: list[str]):
        super().__init__(f"Unknown model {name!r}. Supported models: {', '.join(supported)}")
        self.name, self.supported = name, supported


class ModelNotInstalledError(PagemillError):
    """The model's folder is missing or empty."""


class DownloadError(PagemillError):
    """A model could not be fetched."""


class HardwareInspectionError(PagemillError):
    """The machine could not be inspected."""


class BackendUnavailableError(PagemillError):
    """A model or renderer needs a package that isn't installed."""
