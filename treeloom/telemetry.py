"""Events of a run, sent to a callback on the driver."""

from __future__ import annotations

import logging
from collections.abc import Callable
from dataclasses import dataclass


@dataclass(frozen=True)
class TelemetryEvent:
    table: str


@dataclass(frozen=True)
class MapStarted(TelemetryEvent):
    pass


@dataclass(frozen=True)
class MapCompleted(TelemetryEvent):
    count: int
    error_count: int


@dataclass(frozen=True)
class FlushStarted(TelemetryEvent):
    count: int


@dataclass(frozen=True)
class FlushCompleted(TelemetryEvent):
    inserted: int
    failed: int
    #: from 1; 0 are the eager tables of a stream
    batch_num: int
    #: None in a stream, whose end is not known
    batch_total: int | None
    upsert: bool


@dataclass(frozen=True)
class FlushFailed(TelemetryEvent):
    error: str
    affected_count: int


TelemetryCallback = Callable[[TelemetryEvent], None]


def emit(callback: TelemetryCallback | None, event: TelemetryEvent) -> None:
    """Send an event; a callback's error is logged and does not stop the run."""
    if callback is None:
        return
    try:
        callback(event)
    except Exception:
        logging.getLogger(__name__).warning("telemetry callback failed", exc_info=True)
