"""Supports thresholds: parsing and labels."""

from __future__ import annotations

import math
from decimal import Decimal

#: Thresholds used where none are given.
DEFAULT_THRESHOLDS = (2.0, 4.0, 6.0, 8.0, 10.0, 12.0)


def parse_thresholds(text: str | None) -> list[float]:
    """Comma-separated absolute supports; each must be finite and above 0."""
    if text is None or not text.strip():
        return list(DEFAULT_THRESHOLDS)
    out = []
    for part in text.split(","):
        value = float(part)
        if not math.isfinite(value) or value <= 0:
            raise ValueError(f"a support threshold must be finite and above 0: {part.strip()}")
        out.append(value)
    return out


def threshold_label(value: float) -> str:
    """A threshold as part of a file name: no trailing zeros, ``p`` for the point, ``m`` for minus."""
    plain = format(Decimal(str(value)).normalize(), "f")
    return plain.replace(".", "p").replace("-", "m")


def check_threshold(minsup: float) -> float:
    if not math.isfinite(minsup) or minsup <= 0:
        raise ValueError("minsup is an absolute weighted support: finite and above 0")
    return float(minsup)
