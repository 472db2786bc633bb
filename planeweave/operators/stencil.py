"""Neighbourhood operators as window columns of the same frame.

Windows run along rows (img, y by x) or columns (img, x by y); passes of one direction share one
shuffle and sort. Columns of tall frames are cut into tiles that also hold the rows within the
operator's reach, so that the number of windows grows with the rows. Edges repeat the outermost pixel.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import Column, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from planeweave.functions import maths as m
from planeweave.plans.registry import Call, choice, flag, number, operator
from planeweave.plans.values import Frame, Image, Number, Plane, as_column


def rows_window():
    return Window.partitionBy("img", "y").orderBy("x")


def columns_window():
    return Window.partitionBy("img", "x").orderBy("y")


#: Longest frame that is summed directly; longer ones are differences of running sums.
DIRECT = 16
#: Rows of a tile of a column, at least; frames of up to two tiles are not cut.
TILE = 1024


@contextmanager
def down(frame: Frame, reach: int) -> Iterator[WindowSpec]:
    """The window down columns for columns that are added within; they read at most ``reach`` rows up or down.

    In a tall frame each row goes to its own tile and to those it is within reach of; behind, only the
    rows of their own tile stay. A tile that begins or ends with the frame holds the frame's edge.
    """
    size = max(TILE, 4 * reach)
    if frame.h <= 2 * size:
        yield columns_window()
        return
    (tile,) = frame.add(F.lit(0))
    of = lambda y: F.least(F.greatest(F.floor(y / size), F.lit(0)), F.lit((frame.h - 1) // size)).cast("int")
    y = F.col("y")
    frame.df = frame.df.withColumn(tile, F.explode(F.sequence(of(y - reach), of(y + reach))))
    yield Window.partitionBy("img", "x", tile).orderBy("y")
    frame.df = frame.df.where(F.col(tile) == of(y)).drop(tile)


def box_radii(sigma: float, passes: int = 3) -> list[int]:
    """Radii of box passes that together have the deviation ``sigma``; none below 0.3.

    A box of w places has the variance (w * w - 1) / 12. Widths are the two odd ones around the ideal,
    as many of the narrow as bring the sum of variances nearest to the wanted one (more, on a tie).
    """
    if sigma < 0.3:
        return []
    narrow = (math.floor(math.sqrt(12 * sigma * sigma / passes + 1)) - 1) // 2
    variance = lambda r: ((2 * r + 1) ** 2 - 1) / 12
    off = {k: abs(k * variance(narrow) + (passes - k) * variance(narrow + 1) - sigma * sigma) for k in range(passes + 1)}
    best = min(off, key=lambda k: (round(off[k], 9), -k))
    return [narrow] * best + [narrow + 1] * (passes - best)


def reach(sigma: float) -> int:
    return sum(max(0, r) for r in box_radii(sigma))


def _ends(w):
    return w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def shifted(v: Column, by: int, w) -> Column:
    """The value ``by`` places on, the outermost one beyond the edge."""
    if by == 0:
        return v
    edge = F.last(v).over(_ends(w)) if by > 0 else F.first(v).over(_ends(w))
    return F.coalesce(F.lead(v, by).over(w) if by > 0 else F.lag(v, -by).over(w), v if abs(by) == 1 else edge)


def box_pass(v: Column, r: int, along: Column, length: int, w) -> Column:
    """Mean of 2r+1 places; what lies beyond an edge counts as the edge."""
    first, last = F.first(v).over(_ends(w)), F.last(v).over(_ends(w))
    if r <= DIRECT:
        inside = F.sum(v).over(w.rowsBetween(-r, r))
    else:
        run = F.sum(v).over(w.rowsBetween(Window.unboundedPreceding, r))
        inside = run - F.coalesce(F.sum(v).over(w.rowsBetween(Window.unboundedPreceding, -r - 1)), F.lit(0.0))
    before, behind = F.greatest(F.lit(0), r - along), F.greatest(F.lit(0), along + r - (length - 1))
    return (inside + before * first + behind * last) / (2 * r + 1)


def blurred(frame: Frame, names: list[str], sx: float, sy: float) -> list[str]:
    """Near-Gaussian blur of columns with deviations ``sx`` and ``sy``."""
    for r in box_radii(sx):
        if r > 0:
            names = frame.add(*(box_pass(F.col(n), r, F.col("x"), frame.w, rows_window()) for n in names))
    radii = [r for r in box_radii(sy) if r > 0]
    if radii:
        with down(frame, sum(radii)) as w:
            for r in radii:
                names = frame.add(*(box_pass(F.col(n), r, F.col("y"), frame.h, w) for n in names))
    return names


def _blur_sizes(call: Call) -> tuple[float, float]:
    if not call["Relative"]:
        return call["Size X"] / 2, call["Size Y"] / 2
    frame, way = call.frame, call["Aspect Correction"]
    return call["X %"] / 100 * (frame.h if way == 2 else frame.w) / 2, call["Y %"] / 100 * (frame.w if way == 1 else frame.h) / 2


@operator(
    "filter.blur", "Image image", "Image image", number("Size X", 10, 0, 400), number("Size Y", 10, 0, 400), flag("Relative", False), choice("Aspect Correction", "None|Y|X"), number("X %", 1, 0, 100), number("Y %", 1, 0, 100),
    reach=lambda call: max(map(reach, _blur_sizes(call))) + 1,
)
def blur(call: Call):
    """Image or plane, which stays one."""
    value = call.inputs[0]
    if value is None or isinstance(value, Number):
        return value
    frame = value.frame
    return type(value)(frame, *blurred(frame, value.names, *_blur_sizes(call)))


#: 3x3 kernels by row and what divides them; gradients take the length of both directions.
KERNELS = {
    "Soften": ((1, 2, 1, 2, 4, 2, 1, 2, 1), 16, False),
    "Box Sharpen": ((-1, -1, -1, -1, 9, -1, -1, -1, -1), 1, False),
    "Diamond Sharpen": ((0, -1, 0, -1, 5, -1, 0, -1, 0), 1, False),
    "Laplace": ((-1, -1, -1, -1, 8, -1, -1, -1, -1), 8, False),
    "Sobel": ((-1, 0, 1, -2, 0, 2, -1, 0, 1), 4, True),
    "Prewitt": ((-1, 0, 1, -1, 0, 1, -1, 0, 1), 3, True),
    "Kirsch": ((-3, -3, 5, -3, 0, 5, -3, -3, 5), 15, True),
    "Shadow": ((1, 2, 1, 0, 1, 0, -1, -2, -1), 1, False),
}


def around(frame: Frame, names: list[str]) -> list[list[Column]]:
    """The nine values around each pixel, by row, for each of the columns; one shuffle a direction for all."""
    across = frame.add(*(shifted(F.col(n), d, rows_window()) for n in names for d in (-1, 0, 1)))
    with down(frame, 1) as w:
        found = frame.add(*(shifted(F.col(across[3 * k + i]), d, w) for k in range(len(names)) for d in (-1, 0, 1) for i in range(3)))
    return [[F.col(n) for n in found[9 * k : 9 * k + 9]] for k in range(len(names))]


def slopes(frame: Frame, name: str) -> list[Column]:
    """Differences of the neighbours along the row and along the column."""
    v, w = F.col(name), rows_window()
    across = frame.add(shifted(v, 1, w) - shifted(v, -1, w))
    with down(frame, 1) as w:
        return [F.col(n) for n in [*across, *frame.add(shifted(v, 1, w) - shifted(v, -1, w))]]


@operator("filter.filter", "Image image, Factor plane = Factor", "Image image", number("Factor", 1, 0, 1), choice("Type", "|".join(KERNELS), 4), reach=lambda call: 1)
def kernel_filter(call: Call):
    image = call.image()
    kernel, by, gradient = KERNELS[list(KERNELS)[call["Type"]]]
    total = lambda near, k: sum((p * w for p, w in zip(near, k, strict=True) if w), F.lit(0.0))
    out = []
    for name, near in zip(image.names, around(image.frame, image.names[:3]), strict=False):
        v = total(near, kernel)
        if gradient:
            v = m.hypot(v, total(near, [kernel[3 * (i % 3) + i // 3] for i in range(9)]))
        out.append(m.clamp_colour(m.mix(F.col(name), v / by, call.driven("Factor")), call.linear))
    return image.frame.image(*out, image.alpha)


@operator("filter.pixelate", "Image image", "Image image", number("Size", 16, 1, 200))
def pixelate(call: Call):
    image, s = call.image(), max(1, math.floor(call["Size"] + 0.5))
    block = Window.partitionBy("img", F.floor(F.col("y") / s), F.floor(F.col("x") / s))
    return image.frame.image(*(F.avg(n).over(block) for n in image.names))


def distance_to(frame: Frame, seed: Column, most: int | None = None) -> str:
    """Exact Euclidean distance to the nearest seed, 1e6 without one: per column the nearest seed above
    or below, then per row the least of both parts. ``most`` bounds the reach and so the work."""
    (row,) = frame.add(F.when(seed, F.col("y")))
    gap = lambda above, below: F.least(F.col("y") - F.max(row).over(above), F.min(row).over(below) - F.col("y")).cast("double")
    if most:
        with down(frame, most) as w:
            (g,) = frame.add(gap(w.rowsBetween(-most, 0), w.rowsBetween(0, most)))
    else:
        # Upwards for what lies below: a frame that ends with the column is summed anew for every row.
        (g,) = frame.add(gap(*(Window.partitionBy("img", "x").orderBy(o).rowsBetween(Window.unboundedPreceding, 0) for o in (F.asc("y"), F.desc("y")))))
    if most:
        (near,) = frame.add(F.collect_list(F.when(F.col(g).isNotNull(), F.struct(F.col("x").alias("at"), F.col(g).alias("g")))).over(rows_window().rowsBetween(-most, most)))
        least = F.array_min(F.transform(near, lambda s: (s["at"] - F.col("x")) * (s["at"] - F.col("x")) + s["g"] * s["g"]))
        return frame.add(F.coalesce(F.sqrt(least), F.lit(1e6)))[0]
    return _row_distances(frame, g)


def _row_distances(frame: Frame, g: str) -> str:
    """The least of (x - at)^2 + g(at)^2 along each row, by the lower envelope of its parabolas.

    One pass over a row's array, whatever its width: a row is folded into the parabolas that are
    somewhere lowest, then each place takes the one of its stretch.
    """
    out, key = frame.name(), {k: frame.name() for k in ("img", "y", "x")}

    @F.pandas_udf("array<double>")
    def lowest(rows: pd.Series) -> pd.Series:
        return pd.Series([envelope(np.asarray(r, dtype=float)) for r in rows])

    cell = F.struct("x", F.coalesce(F.col(g) * F.col(g), F.lit(float("inf"))).alias("d"))
    lines = frame.df.groupBy("img", "y").agg(F.array_sort(F.collect_list(cell)).alias("cells"))
    lines = lines.select(F.col("img").alias(key["img"]), F.col("y").alias(key["y"]), F.inline(F.arrays_zip(F.col("cells.x").alias(key["x"]), lowest(F.col("cells.d")).alias(out))))
    on = (F.col("img") == F.col(key["img"])) & (F.col("y") == F.col(key["y"])) & (F.col("x") == F.col(key["x"]))
    frame.df = frame.df.join(lines.toDF(key["img"], key["y"], key["x"], out), on).drop(*key.values())
    return frame.add(F.when(F.col(out) < float("inf"), F.sqrt(F.col(out))).otherwise(1e6))[0]


def envelope(d: np.ndarray) -> np.ndarray:
    """min over j of (i - j)^2 + d[j] for every i; infinite where no d is finite."""
    at = np.flatnonzero(np.isfinite(d))
    if not len(at):
        return np.full(len(d), np.inf)
    kept, from_ = [int(at[0])], [-np.inf]
    for q in at[1:].tolist():
        meets = lambda p: (d[q] + q * q - d[p] - p * p) / (2.0 * (q - p))  # noqa: B023,E731
        while len(kept) > 1 and meets(kept[-1]) <= from_[-1]:
            kept.pop()
            from_.pop()
        from_.append(meets(kept[-1]))
        kept.append(q)
    i = np.arange(len(d))
    best = np.array(kept)[np.searchsorted(np.array(from_[1:]), i, side="left")]
    return (i - best) ** 2.0 + d[best]


@operator("filter.dilate_erode", "Mask plane", "Mask plane", choice("Mode", "Distance|Feather"), number("Distance", 5, -100, 100), reach=lambda call: math.ceil(abs(call["Distance"])) + 2)
def dilate_erode(call: Call):
    value = call.inputs[0]
    if value is None or isinstance(value, Number):
        return value
    frame, d = value.frame, call["Distance"]
    (mask,) = frame.add(as_column(value, frame))
    v, far = F.col(mask), max(abs(d), 1e-3)
    t = F.col(distance_to(frame, v >= 0.5 if d >= 0 else v < 0.5, math.ceil(far) + 1))
    if d >= 0:
        return frame.plane(F.greatest(v, m.clamp01(1.0 - t / far)) if call["Mode"] else F.when(t <= far, 1.0).otherwise(0.0))
    return frame.plane(F.least(v, m.clamp01(t / far)) if call["Mode"] else F.when(t > far, 1.0).otherwise(0.0))


@operator("filter.kuwahara", "Image image", "Image image", number("Size", 6, 1, 50), reach=lambda call: math.floor(call["Size"] + 0.5) + 1)
def kuwahara(call: Call):
    """The mean colour of the one of four quadrants whose brightness varies least."""
    image, r = call.image(), max(1, math.floor(call["Size"] + 0.5))
    frame = image.frame
    (light,) = frame.add(m.luma(*image.rgb))
    (square,) = frame.add(F.col(light) * F.col(light))
    parts = [*image.names[:3], light, square]
    sides = ((-r, 0), (0, r))
    across = {s: frame.add(*(F.sum(n).over(rows_window().rowsBetween(*s)) for n in parts)) for s in sides}
    count = lambda at, length, s: F.least(at if s[1] == 0 else length - 1 - at, F.lit(r)) + 1
    quadrants = [(way, side) for way in sides for side in sides]
    with down(frame, r) as w:
        totals = [frame.add(*(F.sum(n).over(w.rowsBetween(*way)) for n in across[side])) for way, side in quadrants]
    found = []
    for q, ((way, side), sums) in enumerate(zip(quadrants, totals, strict=True)):
        n = count(F.col("x"), frame.w, side) * count(F.col("y"), frame.h, way)
        red, green, blue, mean, sq = (F.col(c) / n for c in sums)
        # Rounded, so that the order of additions never decides between equal quadrants.
        found.append(F.struct(F.round(sq - mean * mean, 12).alias("v"), F.lit(q).alias("q"), red.alias("r"), green.alias("g"), blue.alias("b")))
    (best,) = frame.add(F.array_min(F.array(*found)))
    return frame.image(F.col(best)["r"], F.col(best)["g"], F.col(best)["b"], image.alpha)


@operator("filter.bilateral_blur", "Image image, Determinator image", "Image image", number("Radius", 8, 0, 60), number("Color Sigma", 0.1, 0.001, 1), choice("Quality", "High|Fast"), reach=lambda call: math.ceil(call["Radius"]) + 1)
def bilateral(call: Call):
    """Weights fall with distance and with the determinator's colour difference; at most 15 taps a side.

    Fast runs along rows, then columns; High gathers the taps of rows into arrays, then those of columns.
    """
    image = call.image()
    guide, frame = call.image("Determinator") or image, image.frame
    r, colour = call["Radius"], 1.0 / (2.0 * call["Color Sigma"] ** 2)
    ri = math.ceil(r)
    taps = list(range(-ri, ri + 1, max(1, ri // 7)))
    spread = 1.0 / (2.0 * max(r * 0.5, 0.5) ** 2)
    own = [F.col(n) for n in guide.names[:3]]
    weight = lambda s, d2: F.exp(-d2 * spread - sum(((s[k] - c) * (s[k] - c) for k, c in zip("pqs", own, strict=True)), F.lit(0.0)) * colour)
    pixel = lambda names: F.struct(*[F.col(n).alias(a) for n, a in zip([*names, *guide.names[:3]], "rgbapqs", strict=True)])

    def settled(near: Column) -> list[Column]:
        weighted = F.aggregate(near, F.array(*[F.lit(0.0)] * 5), lambda acc, t: F.zip_with(acc, F.array(*(t["w"] * t[c] for c in "rgba"), t["w"]), lambda a, b: a + b))
        (total,) = frame.add(weighted)
        return [F.element_at(total, k) / F.element_at(total, 5) for k in range(1, 5)]

    with_weight = lambda s, d2: F.struct(*[s[c].alias(c) for c in "rgba"], weight(s, d2).alias("w"))
    names = image.names
    if call["Quality"] == 1:

        def settle(names: list[str], w: WindowSpec) -> list[str]:
            (here,) = frame.add(pixel(names))
            moved = frame.add(*(shifted(F.col(here), o, w) for o in taps))
            return frame.add(*settled(F.array(*(with_weight(F.col(n), float(o * o)) for n, o in zip(moved, taps, strict=True)))))

        names = settle(names, rows_window())
        with down(frame, ri) as w:
            names = settle(names, w)
    else:
        (here,) = frame.add(pixel(names))
        (line,) = frame.add(F.array(*(shifted(F.col(here), o, rows_window()) for o in taps)))
        with down(frame, ri) as w:
            lines = frame.add(*(shifted(F.col(line), o, w) for o in taps))
        squares = F.array(*[F.lit(float(o * o)) for o in taps])
        row = lambda j: lambda s, i: with_weight(s, F.element_at(squares, i + 1) + float(j * j))
        near = [F.transform(F.col(n), row(j)) for n, j in zip(lines, taps, strict=True)]
        names = frame.add(*settled(F.flatten(F.array(*near))))
    return frame.image(*map(F.col, names))


@operator(
    "filter.glare", "Image image", "Image image, Glare image", choice("Type", "Fog Glow|Streaks|Simple Star"), number("Threshold", 0.75, 0, 1), number("Size", 60, 1, 500), number("Strength", 1, 0, 4),
    number("Streaks", 4, 2, 16), number("Angle", 30, 0, 180), number("Fade", 0.9, 0.5, 0.99), reach=lambda call: None,
)
def glare(call: Call):
    """Light above the threshold, spread and added back; the second output is what was added.

    Fog: blurred wide and narrow. Streaks: along each direction copies at doubling distances on both
    sides, each fainter by the fade's power of its distance; a star has four directions of 45 degrees.
    """
    image, t, size = call.image(), call["Threshold"], call["Size"]
    frame = image.frame
    high = frame.add(*(F.greatest(c - t, F.lit(0.0)) / max(1.0 - t, 1e-3) for c in image.rgb))
    if call["Type"] == 0:
        wide, narrow = (blurred(frame, high, k * size, k * size) for k in (0.5, 0.12))
        spread = [0.7 * F.col(a) + 0.6 * F.col(b) for a, b in zip(wide, narrow, strict=True)]
    else:
        from .geometry import sample

        star = call["Type"] == 2
        n = 4 if star else max(2, int(call["Streaks"]))
        (one,) = frame.add(F.lit(1.0))
        px, py, found = F.col("x") + 0.5, F.col("y") + 0.5, []
        for k in range(n):
            a = math.radians(call["Angle"]) + k * (math.pi / 4 if star else 2 * math.pi / n)
            now = high
            for far in (2.0**e for e in range(math.ceil(math.log2(size)))):
                sides = [sample(Image(frame, *now, one), frame, px + way * math.cos(a) * far, py + way * math.sin(a) * far, clear=True) for way in (-1, 1)]
                now = frame.add(*(F.col(c) + (F.col(p) + F.col(q)) * call["Fade"] ** far for c, p, q in zip(now, *sides, strict=False)))
            found.append(now)
        spread = [sum((F.col(f[c]) for f in found), F.lit(0.0)) / (n * max(1.0, math.log2(size))) for c in range(3)]
    glow = [F.col(n) for n in frame.add(*(call["Strength"] * c for c in spread))]
    return frame.image(*(m.clamp_colour(c + g, call.linear) for c, g in zip(image.rgb, glow, strict=True)), image.alpha), frame.image(*(m.clamp_colour(g, call.linear) for g in glow), 1.0)


def guided(frame: Frame, name: str, sigma: float, eps: float) -> str:
    """Edge-keeping blur of one plane by itself: a = var/(var+eps), b = mean-a*mean, both blurred."""
    (square,) = frame.add(F.col(name) * F.col(name))
    mean, mean2 = blurred(frame, [name, square], sigma, sigma)
    (a,) = frame.add((F.col(mean2) - F.col(mean) * F.col(mean)) / (F.col(mean2) - F.col(mean) * F.col(mean) + eps))
    (b,) = frame.add(F.col(mean) - F.col(a) * F.col(mean))
    a, b = blurred(frame, [a, b], sigma, sigma)
    return frame.add(F.col(a) * F.col(name) + F.col(b))[0]


__all__ = ["Plane", "around", "blurred", "distance_to", "down", "guided", "slopes"]
