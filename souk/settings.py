"""One settings object: defaults, then an environment's overrides, then ``SOUK__SECTION__NAME`` variables. Unknown names raise."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, field, fields, replace
from typing import Any


@dataclass(frozen=True)
class Streaming:
    watermark_delay: str = "2 hours"
    trigger_interval: str = "30 seconds"
    max_heartbeat_minutes: int = 20


@dataclass(frozen=True)
class Quality:
    max_quarantine_rate: float = 0.02
    warn_freshness_hours: int = 24
    error_freshness_hours: int = 48


@dataclass(frozen=True)
class Generator:
    order_count: int = 1000
    seed: int = 42
    duplicate_rate: float = 0.02
    late_event_rate: float = 0.03


@dataclass(frozen=True)
class Settings:
    environment: str = "base"
    session_minutes: int = 30
    payment_tolerance: str = "0.01"
    streaming: Streaming = field(default_factory=Streaming)
    quality: Quality = field(default_factory=Quality)
    generator: Generator = field(default_factory=Generator)


def _merged(base: Any, changes: Mapping[str, Any], where: str) -> Any:
    known, out = {f.name: getattr(base, f.name) for f in fields(base)}, {}
    for name, value in changes.items():
        if name not in known:
            raise ValueError(f"unknown setting {where}{name}")
        now = known[name]
        out[name] = _merged(now, value, f"{where}{name}.") if isinstance(value, Mapping) else type(now)(value)
    return replace(base, **out)


def load(overrides: Mapping[str, Any] | None = None, environ: Mapping[str, str] | None = None) -> Settings:
    settings = _merged(Settings(), overrides or {}, "")
    nested: dict[str, Any] = {}
    for key, value in (os.environ if environ is None else environ).items():
        if key.startswith("SOUK__"):
            at, *path = nested, *key[6:].lower().split("__")
            for part in path[:-1]:
                at = at.setdefault(part, {})
            at[path[-1]] = value
    return _merged(settings, nested, "")
