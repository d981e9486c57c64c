"""Tone: curves as 256-entry tables, ink density and levels.  Density 0 is full ink, 255 none."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .color import byte, clamp, col

Curve = list[tuple[int, int]]
IDENTITY: Curve = [(0, 0), (255, 255)]

# The named curves, as (input, output) points.
CURVES: dict[str, Curve] = {
    "clip_color_range": [(0, 0), (90, 0), (115, 255), (255, 255)],
    "sim_process": [(0, 0), (150, 150), (220, 255), (255, 255)],
    "underbase": [(0, 0), (60, 30), (140, 180), (220, 250), (255, 255)],
    "black_plate": [(0, 0), (80, 0), (160, 200), (255, 255)],
    "highlight_white": [(0, 0), (100, 0), (180, 220), (255, 255)],
    "underbase_solid": [(0, 0), (140, 0), (160, 255), (255, 255)],
    "underbase_sim": [(0, 0), (203, 0), (237, 255), (255, 255)],
    "underbase_composite": [(0, 0), (235, 0), (250, 255), (255, 255)],
    "cmyk_channel": [(0, 0), (200, 200), (240, 252), (255, 255)],
}


def is_identity(curve: Curve) -> bool:
    return [tuple(p) for p in curve] == IDENTITY


def build_lut(curve: Curve) -> list[int] | None:
    """The table of a curve: flat beyond its ends, linear between points; of points at one input the last counts.

    None for the empty and the identity curve, which change nothing.
    """
    if not curve or is_identity(curve):
        return None
    points = sorted(dict((x, y) for x, y in sorted(curve, key=lambda p: p[0])).items())
    out = []
    for d in range(256):
        below = [p for p in points if p[0] <= d]
        above = [p for p in points if p[0] >= d]
        if not below or not above:
            out.append((above[:1] or below[-1:])[0][1])
            continue
        (x0, y0), (x1, y1) = below[-1], above[0]
        v = y0 if x0 == x1 else y0 + (y1 - y0) * (d - x0) / (x1 - x0)
        out.append(min(255, max(0, math.floor(v + 0.5))))
    return out


def apply_lut(d: Column | str, lut: list[int] | None) -> Column:
    return col(d) if lut is None else F.element_at(F.array(*map(F.lit, lut)), (col(d) + 1).cast("int"))


def apply_curve(d: Column | str, curve: Curve) -> Column:
    return apply_lut(d, build_lut(curve))


def apply_density(d: Column | str, k: float) -> Column:
    """Scale the ink by k."""
    return col(d) if abs(k - 1.0) <= 1e-4 else byte(255.0 - (255.0 - col(d)) * max(k, 0.0))


def apply_levels(d: Column | str, black: int, white: int, gamma: float) -> Column:
    high = max(white, black + 1)
    v = clamp((col(d) - black) / F.lit(float(high - black)), 0.0, 1.0)
    return byte(255.0 * F.pow(v, F.lit(1.0 / max(gamma, 0.01))))


def invert(d: Column | str) -> Column:
    return 255 - col(d)


def binarize(d: Column | str) -> Column:
    return F.when(col(d) < 128, 0).otherwise(255)


# ------------------------------------------------------------------ curve editing

NEAR = 3


def add_point(curve: Curve, x: int, y: int) -> Curve:
    """A point more, unless one lies within NEAR of its input."""
    return curve if any(abs(px - x) < NEAR for px, _ in curve) else sorted([*curve, (x, y)])


def move_point(curve: Curve, i: int, x: int, y: int) -> Curve:
    """End points keep their input; others stay between their neighbours."""
    y = min(255, max(0, y))
    x = curve[i][0] if i in (0, len(curve) - 1) else min(max(x, curve[i - 1][0] + 1), curve[i + 1][0] - 1)
    return [*curve[:i], (x, y), *curve[i + 1 :]]


def delete_point(curve: Curve, i: int) -> Curve:
    return curve if i in (0, len(curve) - 1) else [*curve[:i], *curve[i + 1 :]]
