"""Which dark components are likely edges of the paper; one rule for columns and for arrays."""

from __future__ import annotations

from typing import TypeVar

Values = TypeVar("Values")


def long_thin_at_edge(x: Values, y: Values, w: Values, h: Values, width: Values, height: Values) -> Values:
    """Whether a component touches the border and is thin in one direction and long in the other."""
    touches = (x == 0) | (y == 0) | (x + w >= width) | (y + h >= height)
    flat = ((h <= 12) | (h <= height * 0.05)) & ((w >= width * 0.25) | (w >= h * 12))
    upright = ((w <= 12) | (w <= width * 0.05)) & ((h >= height * 0.25) | (h >= w * 12))
    return touches & (flat | upright)
