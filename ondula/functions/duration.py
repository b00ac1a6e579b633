"""Durations such as "1hr30min", "250ms", "2kHz" or "120BPM", as samples of a recording."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Seconds of each unit (fixed values).
SECONDS = {"ns": 1e-9, "us": 1e-6, "ms": 1e-3, "s": 1.0, "m": 60.0, "min": 60.0, "h": 3600.0, "hr": 3600.0}
#: Hertz of each rate suffix, tested in this order (fixed values).
RATES = (("kHz", 1e3), ("MHz", 1e6), ("BPM", None), ("Hz", 1.0))
_PART = re.compile(r"(\d+(?:\.\d+)?)\s*([a-zA-Z]+)")


@dataclass(frozen=True)
class Duration:
    """amount seconds, or, for kind "rate", amount cycles a second."""

    kind: str
    amount: float

    def samples(self, frequency: Column) -> Column:
        """Whole samples at `frequency`, cut towards zero."""
        if self.kind == "rate":
            return (frequency / F.lit(self.amount)).cast("long")
        if self.kind == "beat":
            return (frequency * F.lit(60.0 / self.amount)).cast("long")
        return (F.lit(self.amount) * frequency).cast("long")

    def count(self, frequency: float) -> int:
        """The same for one known frequency."""
        if self.kind == "rate":
            return int(frequency / self.amount)
        return int(frequency * (60.0 / self.amount)) if self.kind == "beat" else int(self.amount * frequency)


def duration(text: str) -> Duration:
    """Signs and text without a unit count as nothing; an unknown unit is an error."""
    text = str(text).strip()
    for suffix, hertz in RATES:
        if text.endswith(suffix):
            value = float(text[: -len(suffix)])
            return Duration("beat", value) if hertz is None else Duration("rate", value * hertz)
    total = 0.0
    for value, unit in _PART.findall(text):
        if unit not in SECONDS:
            raise ValueError(f"unknown unit {unit!r} in {text!r}")
        total += float(value) * SECONDS[unit]
    return Duration("time", total)
