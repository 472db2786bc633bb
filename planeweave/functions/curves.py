"""Curves and colour ramps: parameters become small tables, tables become Column expressions."""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import Column
from pyspark.sql import functions as F

from .maths import clamp01, lit, mix

#: Entries of a curve's table.
ENTRIES = 1024


def monotone(points: list[tuple[float, float]]):
    """Monotone cubic through ``points`` (Fritsch-Carlson slopes), held at 0..1; no point is the identity."""
    pts = sorted({float(x): float(y) for x, y in points}.items())
    if not pts:
        return lambda x: min(max(x, 0.0), 1.0)
    if len(pts) == 1:
        return lambda x: min(max(pts[0][1], 0.0), 1.0)
    xs, ys = zip(*pts, strict=True)
    step = [b - a for a, b in zip(xs, xs[1:], strict=False)]
    secant = [(b - a) / h for a, b, h in zip(ys, ys[1:], step, strict=False)]
    slope = [secant[0], *[0.0 if s * t <= 0 else (s + t) / 2 for s, t in zip(secant, secant[1:], strict=False)], secant[-1]]
    for i, s in enumerate(secant):
        if s == 0:
            slope[i] = slope[i + 1] = 0.0
            continue
        a, b = slope[i] / s, slope[i + 1] / s
        if (reach := a * a + b * b) > 9:
            slope[i], slope[i + 1] = 3 * a * s / reach**0.5, 3 * b * s / reach**0.5

    def at(x: float) -> float:
        if x <= xs[0]:
            v = ys[0]
        elif x >= xs[-1]:
            v = ys[-1]
        else:
            i = bisect_right(xs, x) - 1
            h, t = step[i], (x - xs[i]) / step[i]
            v = (2 * t**3 - 3 * t**2 + 1) * ys[i] + (t**3 - 2 * t**2 + t) * h * slope[i] + (3 * t**2 - 2 * t**3) * ys[i + 1] + (t**3 - t**2) * h * slope[i + 1]
        return min(max(v, 0.0), 1.0)

    return at


def table(points, entries: int = ENTRIES) -> list[float]:
    f = monotone([tuple(p) for p in points or []])
    return [f(i / (entries - 1)) for i in range(entries)]


def ramp(stops: list[tuple[float, tuple[float, float, float, float]]], mode: int, t: Column) -> list[Column]:
    """Four channels of a gradient. Modes: linear, constant, ease, cubic-like smooth."""
    stops = sorted(stops)
    out = []
    for k in range(4):
        v = lit(stops[-1][1][k])
        for (p0, c0), (p1, c1) in reversed(list(zip(stops, stops[1:], strict=False))):
            s = clamp01((t - p0) / max(p1 - p0, 1e-6))
            s = {0: s, 1: F.lit(0.0), 2: s * s * (3 - 2 * s), 3: s * s * s * (s * (s * 6 - 15) + 10)}[mode]
            v = F.when(t < p1, mix(c0[k], c1[k], s)).otherwise(v)
        out.append(F.when(t <= stops[0][0], lit(stops[0][1][k])).otherwise(v))
    return out
