"""Argument guards shared by the operators. They look at parameters, never at data."""

from __future__ import annotations

from datetime import date


def window_at_least(window: int, minimum: int = 1) -> None:
    if window < minimum:
        raise ValueError(f"window must be at least {minimum}, got {window}")


def odd_window_over_order(window: int, order: int) -> None:
    if order < 1:
        raise ValueError(f"polynomial order must be at least 1, got {order}")
    if window % 2 == 0:
        raise ValueError(f"window must be odd to be centred, got {window}")
    if window <= order:
        raise ValueError(f"window {window} must exceed the polynomial order {order}")


def open_percentile(percent: float) -> None:
    if not 0 < percent < 100:
        raise ValueError(f"percentile must lie strictly between 0 and 100, got {percent}")


def ordered_range(start: date, end: date) -> None:
    if end < start:
        raise ValueError(f"range ends ({end}) before it starts ({start})")


def positive(name: str, number: float) -> None:
    if number <= 0:
        raise ValueError(f"{name} must be positive, got {number}")


def one_of(name: str, value: str, allowed) -> None:
    if value not in allowed:
        raise ValueError(f"{name} must be one of {', '.join(allowed)}, got {value!r}")
