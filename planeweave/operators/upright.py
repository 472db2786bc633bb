"""Straight lines of a picture by votes, and the camera turn that makes them vertical and horizontal.

Pixels with a clear gradient vote for the lines that they may lie on: an accumulator keyed by angle and
distance from the corner, filled by one aggregation. Peaks of it are found by windows along both keys;
the pixels that voted for a peak, met by its key, give the line's axis by sums of their moments. An image's
lines are a short table, and the turn is solved from them by damped least squares.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from planeweave.functions import maths as m
from planeweave.plans.values import Frame, Image

from .stencil import around

#: Longest edge of the copy that is looked at, least gradient, least length by the longer edge,
#: most lines, angles (degrees) from upright that count, and those a line may keep in the end.
COPY_EDGE, LEAST_GRADIENT, LEAST_LENGTH, MOST_LINES, NEARLY, AGREED = 800, 0.02, 0.06, 80, 20.0, 3.0
#: Pull of every angle towards 0, most turn, and for Auto the share of the horizontal turn and its most.
PULL, MOST_TURN, AUTO_SHARE, AUTO_MOST = 1e-3, 0.8, 0.5, 0.35
#: Bins to a degree, and how many on either side of its gradient's a pixel votes for.
BINS, SPREAD = 4, 8
#: Pixels on either side of a peak's line whose gradients, squared, weigh the line's axis: a soft edge fits in,
#: so that the band's own direction doesn't draw the axis to it.
BAND = 4
#: Which of the turns about x, y and z are free, by mode.
FREE = {"Auto": (0, 1, 2), "Level": (2,), "Vertical": (0, 2), "Full": (0, 1, 2)}


def segments(image: Image, linear: bool = False) -> DataFrame:
    """(img, x0, y0, x1, y1, n) of lines within 20 degrees of upright, ends as shares of width and height."""
    frame = image.frame
    step = max(1, -(-max(frame.w, frame.h) // COPY_EDGE))
    w, h = frame.w // step, frame.h // step
    none = frame.df.select("img", *[F.lit(0.0).alias(c) for c in ("x0", "y0", "x1", "y1")], F.lit(0).cast("long").alias("n")).limit(0)
    if min(w, h) < 8:
        return none
    light = m.clamp01(F.nanvl(m.luma(*image.rgb), F.lit(0.0)))
    cell = [(F.floor(F.col(c) / step)).cast("int").alias(c) for c in ("y", "x")]
    small = frame.df.select("img", *cell, (m.to_srgb(light) if linear else light).alias("v0")).where((F.col("y") < h) & (F.col("x") < w))
    copy = Frame(small.groupBy("img", "y", "x").agg(F.avg("v0").alias("v0")), w, h)
    (near,) = around(copy, ["v0"])
    copy.add(*near)
    (soft,) = copy.add(sum((c * k for c, k in zip(near, (1, 2, 1, 2, 4, 2, 1, 2, 1), strict=True)), F.lit(0.0)) / 16)
    (a,) = around(copy, [soft])
    gx, gy = copy.add((a[2] + 2 * a[5] + a[8] - a[0] - 2 * a[3] - a[6]) / 8, (a[6] + 2 * a[7] + a[8] - a[0] - 2 * a[1] - a[2]) / 8)
    inner = F.col("x").between(1, w - 2) & F.col("y").between(1, h - 2)
    # Degrees from -45 up, so that no upright direction lies where they begin anew.
    turned = F.pmod(F.degrees(F.atan2(F.col(gy), F.col(gx))) + 45, F.lit(360.0)) - 45
    edges = copy.df.where(inner & (m.hypot(F.col(gx), F.col(gy)) > LEAST_GRADIENT)).select("img", "y", "x", turned.alias("phi"), (F.col(gx) * F.col(gx) + F.col(gy) * F.col(gy)).alias("g"))
    off = F.abs(F.pmod(F.col("phi") + 45, F.lit(90.0)) - 45)
    bins = F.explode(F.transform(F.sequence(F.lit(-SPREAD), F.lit(SPREAD)), lambda d: F.round(F.col("phi") * BINS).cast("int") + d))
    votes = edges.where(off <= NEARLY).select("img", "y", "x", "g", bins.alias("b"))
    angle = F.radians(F.col("b") / BINS)
    votes = votes.withColumn("r", F.round(F.col("x") * F.cos(angle) + F.col("y") * F.sin(angle)).cast("int"))
    counts = votes.groupBy("img", "b", "r").agg(F.count("*").alias("n"))
    rank = F.struct("n", F.negative("b"), F.negative("r"))
    along = F.max("rank").over(Window.partitionBy("img", "r").orderBy("b").rangeBetween(-SPREAD, SPREAD))
    across = F.max("most").over(Window.partitionBy("img", "b").orderBy("r").rangeBetween(-2, 2))
    peaks = counts.withColumn("rank", rank).withColumn("most", along).withColumn("top", across).where((F.col("rank") == F.col("top")) & (F.col("n") >= LEAST_LENGTH * max(w, h)))
    nth = F.row_number().over(Window.partitionBy("img").orderBy(F.desc("n"), "b", "r"))
    peaks = peaks.withColumn("nth", nth).where(F.col("nth") <= 2 * MOST_LINES).select("img", "b", F.explode(F.array(*[F.col("r") + d for d in range(-BAND, BAND + 1)])).alias("r"), "nth")
    t = F.col("y") * F.cos(angle) - F.col("x") * F.sin(angle)
    met = votes.join(peaks, ["img", "b", "r"]).withColumn("t", t)
    weighed = lambda a, b=None: F.sum(F.col("g") * F.col(a) * (F.col(b) if b else 1.0)) / F.sum("g")
    of = met.groupBy("img", "nth", "b").agg(
        F.count("*").alias("n"), *[weighed(c).alias(f"m{c}") for c in "xyt"], *[weighed(a, b).alias(a + b) for a, b in ("xx", "yy", "xy")], F.min("t").alias("lo"), F.max("t").alias("hi"),
    )
    of = of.withColumns({a + b: F.col(a + b) - F.col(f"m{a}") * F.col(f"m{b}") for a, b in ("xx", "yy", "xy")})
    axis = 0.5 * F.atan2(2 * F.col("xy"), F.col("xx") - F.col("yy"))
    # Along the peak's own direction, which runs from angle 90 degrees on.
    way = F.signum(F.cos(axis) * -F.sin(angle) + F.sin(axis) * F.cos(angle))
    of = of.withColumn("ux", F.cos(axis) * way).withColumn("uy", F.sin(axis) * way).where((F.col("hi") - F.col("lo") >= LEAST_LENGTH * max(w, h)) & (F.col("n") >= 0.5 * (F.col("hi") - F.col("lo"))))
    end = lambda c, to, size: ((F.col(f"m{c}") + F.col(f"u{c}") * (F.col(to) - F.col("mt")) + 0.5) / size)
    return of.select("img", end("x", "lo", w).alias("x0"), end("y", "lo", h).alias("y0"), end("x", "hi", w).alias("x1"), end("y", "hi", h).alias("y1"), "n")


def rotation(angles: np.ndarray) -> np.ndarray:
    """About x, then y, then z."""
    out = np.eye(3)
    for axis, angle in enumerate(angles):
        i, j = ((1, 2), (2, 0), (0, 1))[axis]
        turn = np.eye(3)
        turn[[i, i, j, j], [i, j, i, j]] = math.cos(angle), -math.sin(angle), math.sin(angle), math.cos(angle)
        out = turn @ out
    return out


def lean(ends: np.ndarray, vertical: np.ndarray, angles: np.ndarray) -> np.ndarray:
    """Sine of each line's angle from upright once the camera is turned; ends: (line, end, x y 1)."""
    seen = ends @ rotation(angles).T
    shown = seen[..., :2] / np.maximum(seen[..., 2:], 1e-9)
    d = shown[:, 1] - shown[:, 0]
    off = np.where(vertical, d[:, 0], d[:, 1]) / np.maximum(np.hypot(d[:, 0], d[:, 1]), 1e-9)
    return np.where((seen[..., 2] < 1e-3).any(axis=1), 1.0, off)


def solved(ends: np.ndarray, vertical: np.ndarray, weight: np.ndarray, free: tuple[int, ...]) -> np.ndarray:
    """Angles of least weighted squares of ``lean``, drawn a little towards 0; damped Gauss-Newton."""
    free = list(free)

    def residuals(values: np.ndarray) -> np.ndarray:
        angles = np.zeros(3)
        angles[free] = values
        return np.concatenate([lean(ends, vertical, angles) * weight, PULL * angles])

    at, damping = np.zeros(len(free)), 1e-3
    now = residuals(at)
    for _ in range(200):
        slope = np.stack([(residuals(at + 1e-7 * e) - now) / 1e-7 for e in np.eye(len(free))], axis=1)
        square = slope.T @ slope
        step = np.linalg.solve(square + damping * np.diag(1 + np.diag(square)), -slope.T @ now)
        to = np.clip(at + step, -MOST_TURN, MOST_TURN)
        then = residuals(to)
        if then @ then < now @ now:
            moved = np.abs(to - at).max()
            at, now, damping = to, then, max(damping / 4, 1e-9)
            if moved < 1e-10:
                break
        elif damping > 1e8:
            break
        else:
            damping *= 8
    angles = np.zeros(3)
    angles[free] = at
    return angles


def turn(lines: pd.DataFrame, w: int, h: int, mode: str) -> np.ndarray:
    """Angles for one image; lines that stay over 3 degrees off once the rest agree are left out."""
    f = math.hypot(w / 2, h / 2)
    xy = np.stack([lines[["x0", "y0"]].to_numpy(float), lines[["x1", "y1"]].to_numpy(float)], axis=1) * [w, h]
    ends = np.concatenate([(xy - [w / 2, h / 2]) / f, np.ones((len(xy), 2, 1))], axis=2)
    d = np.abs(xy[:, 1] - xy[:, 0])
    slope = np.degrees(np.arctan2(d[:, 1], d[:, 0]))
    weight = np.sqrt(np.hypot(*d.T) / f)
    chosen = np.flatnonzero((slope <= NEARLY) | (slope >= 90 - NEARLY))
    chosen = chosen[np.argsort(-weight[chosen], kind="stable")][:MOST_LINES]
    angles = np.zeros(3)
    for _ in range(3):
        if not len(chosen):
            break
        upright = slope[chosen] > 45
        angles = solved(ends[chosen], upright, weight[chosen], FREE[mode])
        agree = np.abs(lean(ends[chosen], upright, angles)) < math.sin(math.radians(AGREED))
        if agree.all() or not agree.any():
            break
        chosen = chosen[agree]
    if mode == "Auto":
        angles = np.clip(angles * [1, AUTO_SHARE, 1], -AUTO_MOST, AUTO_MOST)
    return angles


def _rays(w: int, h: int) -> np.ndarray:
    """From relative coordinates to rays of the camera."""
    f = math.hypot(w / 2, h / 2)
    return np.diag([1 / f, 1 / f, 1]) @ np.array([[1, 0, -w / 2], [0, 1, -h / 2], [0, 0, 1]]) @ np.diag([w, h, 1])


def unturned(angles: np.ndarray, w: int, h: int, sliders: np.ndarray) -> np.ndarray:
    """From relative output to relative input coordinates: the sliders undone, then the turn."""
    return np.linalg.inv(_rays(w, h)) @ rotation(angles).T @ _rays(w, h) @ sliders


def guided(guides: list[dict], w: int, h: int) -> np.ndarray:
    """Angles that make lines drawn by hand (x0, y0, x1, y1 as shares) vertical where they are steeper than 45 degrees, else horizontal."""
    xy = np.array([[[float(g["x0"]), float(g["y0"])], [float(g["x1"]), float(g["y1"])]] for g in guides]).reshape(-1, 2, 2)
    ends = np.concatenate([xy, np.ones((len(xy), 2, 1))], axis=2) @ _rays(w, h).T
    d = np.abs(ends[:, 1] - ends[:, 0])
    return solved(ends, d[:, 1] > d[:, 0], np.ones(len(xy)), FREE["Full"]) if len(xy) else np.zeros(3)


def maps(lines: DataFrame, w: int, h: int, mode: str, sliders: np.ndarray) -> DataFrame:
    """(img, p0 to p8): relative output to relative input coordinates, the sliders' map and the image's turn together."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        ordered = rows.sort_values(["n", "x0", "y0", "x1", "y1"], ascending=False)
        both = unturned(turn(ordered, w, h, mode), w, h, sliders)
        return pd.DataFrame([{"img": rows["img"].iloc[0], **{f"p{k}": v for k, v in enumerate(both.ravel())}}])

    # At most twice ``MOST_LINES`` rows an image.
    return lines.groupBy("img").applyInPandas(run, "img string, " + ", ".join(f"p{k} double" for k in range(9)))
