"""Colours of pictures and pages, in one place."""

from __future__ import annotations

import colorsys
from collections.abc import Sequence

Rgb = tuple[int, int, int]

#: Anchors of the population scale, dark to light.
SCALE: tuple[Rgb, ...] = ((38, 20, 72), (43, 79, 129), (31, 140, 140), (96, 194, 98), (248, 230, 60))
WHITE: Rgb = (255, 255, 255)
BLACK: Rgb = (0, 0, 0)
_GOLDEN = 0.6180339887498949


def category(i: int, first: float = 0.02) -> Rgb:
    """Colour of the i-th category: hues a golden section of the circle apart, bright and dark in turns."""
    r, g, b = colorsys.hsv_to_rgb((first + i * _GOLDEN) % 1.0, 0.78, (0.88, 0.62, 0.75)[i % 3])
    return round(255 * r), round(255 * g), round(255 * b)


def categories(n: int, first: float = 0.02) -> list[Rgb]:
    """Colours of n categories."""
    return [category(i, first) for i in range(n)]


def css(colour: Rgb) -> str:
    """A colour as style sheets write it."""
    return "#" + "".join(f"{c:02x}" for c in colour)


def luminance(colour: Rgb) -> float:
    """Relative luminance by the Web Content Accessibility Guidelines."""
    linear = [c / 255 / 12.92 if c / 255 <= 0.04045 else ((c / 255 + 0.055) / 1.055) ** 2.4 for c in colour]
    return 0.2126 * linear[0] + 0.7152 * linear[1] + 0.0722 * linear[2]


def contrast(a: Rgb, b: Rgb) -> float:
    """Contrast ratio of two colours, 1 to 21."""
    high, low = sorted((luminance(a), luminance(b)), reverse=True)
    return (high + 0.05) / (low + 0.05)


def legible(background: Rgb) -> Rgb:
    """Black or white, whichever reads better on a background: its contrast is 4.5 at least."""
    return max((BLACK, WHITE), key=lambda c: contrast(c, background))


def between(scale: Sequence[Rgb], t: float) -> Rgb:
    """Colour at a place from 0 to 1 of a scale of evenly spaced anchors."""
    at = min(max(t, 0.0), 1.0) * (len(scale) - 1)
    i = min(int(at), len(scale) - 2)
    return tuple(round(a + (at - i) * (b - a)) for a, b in zip(scale[i], scale[i + 1]))  # type: ignore[return-value]


def trimmed(scale: Sequence[Rgb], background: Rgb, least: float = 1.25, steps: int = 64) -> list[Rgb]:
    """The longest part of a scale that stands out from a background, as many anchors as it had.

    The whole scale if no part of it does.
    """
    ok = [contrast(between(scale, k / steps), background) >= least for k in range(steps + 1)]
    best, start = (0, 0), None
    for k, good in enumerate([*ok, False]):
        if good and start is None:
            start = k
        elif not good and start is not None:
            best = max(best, (start, k - 1), key=lambda p: p[1] - p[0])
            start = None
    a, b = best if best[1] > best[0] else (0, steps)
    n = len(scale)
    return [between(scale, (a + (b - a) * i / (n - 1)) / steps) for i in range(n)]


#: Distances of ticks on axes of degrees, fine to coarse.
DEGREE_STEPS = (1, 2, 5, 10, 15, 30, 45, 60, 90, 120, 180, 360)


def ticks(low: float, high: float, degrees: bool, most: int = 9) -> list[float]:
    """Places of ticks on an axis, ``most`` at most: whole steps of a circle, or steps of 1, 2 or 5 times a power of ten."""
    steps = list(DEGREE_STEPS) if degrees else [m * 10.0**e for e in range(-12, 13) for m in (1, 2, 5)]
    for step in steps:
        first, last = -(-low // step), high // step
        if last - first + 1 <= most:
            return [round(k * step, 12) + 0.0 for k in range(int(first), int(last) + 1)]
    return []
