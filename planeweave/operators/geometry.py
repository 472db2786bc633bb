"""Geometric operators: key rewrites, or one gather join on computed coordinates.

A gather's source rows first take in their right and lower neighbours by two windows, so that every
output row needs one source row, not four.
"""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planeweave.functions import maths as m
from planeweave.plans.registry import Call, choice, colour, flag, free, number, operator
from planeweave.plans.values import Frame, Image

from .stencil import down, rows_window, shifted


def sample(source: Image, frame: Frame, sx: Column, sy: Column, clear: bool = False) -> list[str]:
    """Bilinear values of ``source`` at (sx, sy), pixel centres at .5; outside transparent or the edge."""
    home, w, h = source.frame, source.frame.w, source.frame.h
    across = home.add(*(shifted(F.col(n), 1, rows_window()) for n in source.names))
    with down(home, 1) as window:
        below = home.add(*(shifted(F.col(n), 1, window) for n in [*source.names, *across]))
    kept = [*source.names, *across, *below]
    key = {k: frame.name() for k in ("img", "y", "x")}
    own = [frame.name() for _ in kept]
    right = home.df.select(*[F.col(k).alias(v) for k, v in key.items()], *[F.col(n).alias(v) for n, v in zip(kept, own, strict=True)])
    x, y = (F.col(n) for n in frame.add(m.clamp(F.nanvl(sx, F.lit(-1.0)), -1e9, 1e9), m.clamp(F.nanvl(sy, F.lit(-1.0)), -1e9, 1e9)))
    x0, y0 = m.floor(x - 0.5), m.floor(y - 0.5)
    fx, fy, ix, iy = frame.add(
        F.when((x0 < 0) | (x0 >= w), 0.0).otherwise(x - 0.5 - x0), F.when((y0 < 0) | (y0 >= h), 0.0).otherwise(y - 0.5 - y0), m.clamp(x0, 0, w - 1).cast("int"), m.clamp(y0, 0, h - 1).cast("int")
    )
    on = (F.col("img") == F.col(key["img"])) & (F.col(iy) == F.col(key["y"])) & (F.col(ix) == F.col(key["x"]))
    frame.df = frame.df.join(right, on, "left").drop(*key.values())
    a, b, c, d = (own[i : i + 4] for i in range(0, 16, 4))
    outside = (x < 0) | (y < 0) | (x > w) | (y > h)
    out = []
    for k in range(4):
        v = m.mix(m.mix(F.col(a[k]), F.col(b[k]), F.col(fx)), m.mix(F.col(c[k]), F.col(d[k]), F.col(fx)), F.col(fy))
        out.append(F.when(outside, 0.0).otherwise(v) if clear else v)
    return frame.add(*out)


def nearest(source: Image, frame: Frame, sx: Column, sy: Column) -> list[str]:
    """Values of the pixels that hold (sx, sy), transparent outside."""
    home = source.frame
    ix, iy = frame.add(m.floor(sx).cast("int"), m.floor(sy).cast("int"))
    key = {k: frame.name() for k in ("img", "y", "x")}
    own = [frame.name() for _ in range(4)]
    right = home.df.select(*[F.col(k).alias(v) for k, v in key.items()], *[F.col(n).alias(v) for n, v in zip(source.names, own, strict=True)])
    frame.df = frame.df.join(right, (F.col("img") == F.col(key["img"])) & (F.col(iy) == F.col(key["y"])) & (F.col(ix) == F.col(key["x"])), "left").drop(*key.values())
    return frame.add(*(F.coalesce(F.col(n), F.lit(0.0)) for n in own))


def _centred(frame: Frame) -> tuple[Column, Column, float, float]:
    cx, cy = frame.w / 2, frame.h / 2
    return F.col("x") + 0.5 - cx, F.col("y") + 0.5 - cy, cx, cy


@operator("xform.transform", "Image image", "Image image", free("X", 0), free("Y", 0), free("Angle", 0), number("Scale", 1, 0.05, 8), flag("Wrap", False), reach=lambda call: None)
def transform(call: Call):
    image, (ca, sa), k = call.image(), m.degrees(call["Angle"]), max(call["Scale"], 1e-3)
    frame = image.frame
    px, py, cx, cy = _centred(frame)
    px, py = px - call["X"], py - call["Y"]
    sx, sy = (px * ca - py * sa) / k + cx, (px * sa + py * ca) / k + cy
    if call["Wrap"]:
        sx, sy = F.pmod(sx, F.lit(float(frame.w))), F.pmod(sy, F.lit(float(frame.h)))
    return Image(frame, *sample(image, frame, sx, sy, clear=not call["Wrap"]))


@operator("xform.pan_zoom", "Image image", "Image image", free("Zoom", 1), free("X", 0), free("Y", 0), choice("Interpolation", "Bilinear|Nearest"), reach=lambda call: None)
def pan_zoom(call: Call):
    image, z = call.image(), min(max(call["Zoom"], 1e-3), 1e4)
    frame = image.frame
    px, py, cx, cy = _centred(frame)
    sx, sy = (px - call["X"] * frame.w) / z + cx, (py - call["Y"] * frame.h) / z + cy
    return Image(frame, *(nearest(image, frame, sx, sy) if call["Interpolation"] else sample(image, frame, sx, sy, clear=True)))


@operator("xform.flip", "Image image", "Image image", choice("Axis", "Horizontal|Vertical|Both"), reach=lambda call: None)
def flip(call: Call):
    """New keys, no join."""
    image, axis = call.image(), call["Axis"]
    old = image.frame
    x = old.w - 1 - F.col("x") if axis != 1 else F.col("x")
    y = old.h - 1 - F.col("y") if axis != 0 else F.col("y")
    frame = Frame(old.df.select("img", y.alias("y"), x.alias("x"), *[F.col(n).alias(f"s{k}") for k, n in enumerate(image.names)]), old.w, old.h)
    return frame.image(*(F.col(f"s{k}") for k in range(4)))


ASPECTS = (0, 0, 1, 4 / 5, 5 / 4, 2 / 3, 3 / 2, 3 / 4, 4 / 3, 9 / 16, 16 / 9)


def crop_box(call: Call, w: int, h: int) -> tuple[int, int, int, int]:
    """Pixels kept; an aspect shrinks the rectangle around its centre."""
    l, r = sorted((call["Left"], call["Right"]))
    t, b = sorted((call["Top"], call["Bottom"]))
    if call["Aspect"]:
        want = w / h if call["Aspect"] == 1 else ASPECTS[call["Aspect"]]
        width, height = (r - l) * w, (b - t) * h
        if height > 0 and width / height > want:
            cut = (width - height * want) / w / 2
            l, r = l + cut, r - cut
        elif width > 0:
            cut = (height - width / want) / h / 2
            t, b = t + cut, b - cut
    # A hair above, so that 0.3 * 10 in binary is still 3.
    x0, x1, y0, y1 = (int(v + 1e-9) for v in (l * w, r * w, t * h, b * h))
    x1, y1 = min(max(x1, x0 + 1), w), min(max(y1, y0 + 1), h)
    return min(x0, x1 - 1), min(y0, y1 - 1), x1, y1


@operator(
    "xform.crop", "Image image", "Image image", number("Left", 0, 0, 1), number("Right", 1, 0, 1), number("Top", 0, 0, 1), number("Bottom", 1, 0, 1), flag("Resize Image", True), number("Angle", 0, -45, 45),
    choice("Aspect", "Free|Original|1:1|4:5|5:4|2:3|3:2|3:4|4:3|9:16|16:9"), flag("Constrain to Image", True), reach=lambda call: None,
)
def crop(call: Call):
    image = call.image()
    if call["Angle"]:
        frame, (ca, sa) = image.frame, m.degrees(call["Angle"])
        w, h = frame.w, frame.h
        cover = max((w * abs(ca) + h * abs(sa)) / w, (w * abs(sa) + h * abs(ca)) / h) if call["Constrain to Image"] else 1.0
        px, py, cx, cy = _centred(frame)
        image = Image(frame, *sample(image, frame, (px * ca - py * sa) / cover + cx, (px * sa + py * ca) / cover + cy, clear=True))
    old = image.frame
    x0, y0, x1, y1 = crop_box(call, old.w, old.h)
    inside = (F.col("x") >= x0) & (F.col("x") < x1) & (F.col("y") >= y0) & (F.col("y") < y1)
    if not call["Resize Image"]:
        return old.image(*(F.when(inside, F.col(n)).otherwise(0.0) for n in image.names))
    kept = old.df.where(inside).select("img", (F.col("y") - y0).alias("y"), (F.col("x") - x0).alias("x"), *[F.col(n).alias(f"s{k}") for k, n in enumerate(image.names)])
    frame = Frame(kept, x1 - x0, y1 - y0)
    return frame.image(*(F.col(f"s{k}") for k in range(4)))


@operator("xform.lens_distortion", "Image image", "Image image", number("Distortion", 0.1, -0.99, 1), number("Dispersion", 0.02, 0, 1), flag("Fit", True), reach=lambda call: None)
def lens_distortion(call: Call):
    """Radial bend, a little different for each channel."""
    image, k, spread = call.image(), call["Distortion"], call["Dispersion"] / 2
    frame = image.frame
    px, py, cx, cy = _centred(frame)
    half = max(frame.w, frame.h) / 2
    fit = 1.0 / (1.0 + (k + spread) * (cx * cx + cy * cy) / half**2) if call["Fit"] and k > 0 else 1.0
    qx, qy = (F.col(n) for n in frame.add(px / half * fit, py / half * fit))
    r2, out = qx * qx + qy * qy, []
    for c, bend in enumerate((k - spread, k, k + spread)):
        out.append(sample(image, frame, qx * (1.0 + bend * r2) * half + cx, qy * (1.0 + bend * r2) * half + cy, clear=True)[c])
    return frame.image(*map(F.col, out), image.alpha)


@operator(
    "xform.lens_correction", "Image image", "Image image", number("Distortion", 0, -100, 100), flag("Constrain to Image", True), number("Red / Cyan", 0, -100, 100), number("Blue / Yellow", 0, -100, 100),
    number("Vignetting", 0, -100, 100), number("Midpoint", 50, 0, 100), reach=lambda call: None,
)
def lens_correction(call: Call):
    image, inside = call.image(), call["Constrain to Image"]
    frame = image.frame
    px, py, cx, cy = _centred(frame)
    half = math.hypot(cx, cy)
    qx, qy = (F.col(n) for n in frame.add(px / half, py / half))
    k = -call["Distortion"] / 100 * 0.25
    zoom = 1.0 / (1.0 + k) if inside and k > 0 else 1.0
    scales = (1.0 + call["Red / Cyan"] / 100 * 0.005, 1.0, 1.0 + call["Blue / Yellow"] / 100 * 0.005)
    r2, rgb, alpha = qx * qx + qy * qy, image.rgb, image.alpha
    if k or scales != (1.0, 1.0, 1.0):
        bend = (1.0 + k * r2) * zoom * half
        taken = {s: sample(image, frame, qx * bend * s + cx, qy * bend * s + cy, clear=not inside) for s in dict.fromkeys(scales)}
        rgb, alpha = [F.col(taken[s][c]) for c, s in enumerate(scales)], F.col(taken[1.0][3])
    if call["Vignetting"]:
        gain = F.pow(F.lit(2.0), call["Vignetting"] / 100 * 1.5 * F.pow(F.least(r2, F.lit(1.0)), F.lit((1.0 + 5.0 * call["Midpoint"] / 100) / 2)))
        rgb = [c * gain if call.linear else m.to_srgb(m.to_linear(m.clamp01(c)) * gain) for c in rgb]
    return frame.image(*(m.clamp_colour(c, call.linear) for c in rgb), alpha)


@operator("xform.displace", "Image image, X plane, Y plane", "Image image", free("Strength X", 30), free("Strength Y", 30), reach=lambda call: None)
def displace(call: Call):
    image = call.image()
    frame = image.frame
    sx = F.col("x") + 0.5 + (call.plane("X", 0.5) - 0.5) * call["Strength X"] * 2.0
    sy = F.col("y") + 0.5 + (call.plane("Y", 0.5) - 0.5) * call["Strength Y"] * 2.0
    return Image(frame, *sample(image, frame, sx, sy))


@operator("xform.map_uv", "Image image, UV image", "Image image", reach=lambda call: None)
def map_uv(call: Call):
    """The image looked up at the coordinates in the other's red and green; the result has the other's size."""
    image, uv = call.inputs
    if image is None or uv is None:
        return image
    return Image(uv.frame, *sample(image, uv.frame, F.col(uv.r) * image.frame.w, F.col(uv.g) * image.frame.h, clear=True))


def square_to(corners: list[tuple[float, float]]) -> list[list[float]]:
    """The projective map that takes the unit square's corners (clockwise from the origin) to these."""
    import numpy as np

    a, b = [], []
    for (u, v), (x, y) in zip(((0, 0), (1, 0), (1, 1), (0, 1)), corners, strict=True):
        a += [[u, v, 1, 0, 0, 0, -u * x, -v * x], [0, 0, 0, u, v, 1, -u * y, -v * y]]
        b += [x, y]
    try:
        return np.append(np.linalg.solve(np.array(a, float), np.array(b, float)), 1.0).reshape(3, 3).tolist()
    except np.linalg.LinAlgError:
        return [[0.0] * 3] * 3


CORNERS = ("Upper Left", "Upper Right", "Lower Right", "Lower Left")


@operator("xform.corner_pin", "Image image", "Image image", *[free(f"{c} {a}", d) for c, place in zip(CORNERS, ((0, 0), (1, 0), (1, 1), (0, 1)), strict=True) for a, d in zip("XY", place, strict=True)], reach=lambda call: None)
def corner_pin(call: Call):
    import numpy as np

    image = call.image()
    frame, to = image.frame, np.array(square_to([(call[f"{c} X"], call[f"{c} Y"]) for c in CORNERS]))
    back = np.linalg.inv(to) if abs(np.linalg.det(to)) > 1e-12 else np.zeros((3, 3))
    u, v = (F.col("x") + 0.5) / frame.w, (F.col("y") + 0.5) / frame.h
    px, py, pw = (F.col(n) for n in frame.add(*(float(r[0]) * u + float(r[1]) * v + float(r[2]) for r in back)))
    safe = F.when(F.abs(pw) < 1e-12, 1.0).otherwise(pw)
    s, t = (F.col(n) for n in frame.add(px / safe, py / safe))
    inside = (F.abs(pw) >= 1e-12) & (s >= 0) & (s <= 1) & (t >= 0) & (t <= 1)
    taken = sample(image, frame, s * frame.w, t * frame.h)
    return frame.image(*(F.when(inside, F.col(n)).otherwise(0.0) for n in taken))


#: Aspects of a border's canvas; the first keeps the image's.
CANVAS_ASPECTS = {"Image": None, "1:1": 1.0, "4:5": 4 / 5, "5:4": 5 / 4, "2:3": 2 / 3, "3:2": 3 / 2, "16:9": 16 / 9, "9:16": 9 / 16}


#: Places of a border's canvas that one task makes, about, and the most tasks of a rectangle of it, beyond which they make more.
CELLS, MOST_TASKS = 1 << 20, 1 << 12


def rounded(v: float) -> int:
    """Nearest whole number, halves away from 0."""
    return int(math.copysign(math.floor(abs(v) + 0.5), v))


def canvas_of(w: int, h: int, size: float, bottom: float, aspect: float | None) -> tuple[int, int, int, int]:
    """Width and height of a border's canvas, and where the image stands in it; sizes in percent of the long edge.

    An aspect lets the canvas grow in one direction, the image staying in its middle.
    """
    side, below = (rounded(p / 100 * max(w, h)) for p in (size, bottom))
    wide, high, left, top = w + 2 * side, h + 2 * side + below, side, side
    if aspect:
        grown = (rounded(high * aspect), high) if wide / high < aspect else (wide, rounded(wide / aspect))
        left, top = left + (grown[0] - wide) // 2, top + (grown[1] - high) // 2
        wide, high = grown
    return wide, high, left, top


def places(images: DataFrame, *parts: tuple[int, int, int, int]) -> list[DataFrame]:
    """(img, y, x) of rectangles (x0, y0, x1, y1) for each of ``images`` (img), counted by many tasks that hold no line of them.

    A canvas grows with the square of a picture's long edge, so a place must cost little: it is a number, of
    which line and column follow, and a name; only several images are joined.
    """
    found, names = [], images.head(2)
    for x0, y0, x1, y1 in parts:
        wide, n = x1 - x0, (x1 - x0) * (y1 - y0)
        counted = images.sparkSession.range(0, n, 1, min(max(1, n // CELLS), MOST_TASKS))
        counted = counted.select(((F.col("id") / wide).cast("int") + y0).alias("y"), ((F.col("id") % wide).cast("int") + x0).alias("x"))
        # One row an image.
        named = counted.withColumn("img", F.lit(names[0].img)) if len(names) == 1 else counted.join(F.broadcast(images))
        found.append(named.select("img", "y", "x"))
    return found


@operator(
    "xform.border", "Image image", "Image image", number("Size", 4, 0, 25), number("Bottom", 0, 0, 25), choice("Aspect", "|".join(CANVAS_ASPECTS)), colour("Color", 1, 1, 1), number("Line Size", 0, 0, 2), colour("Line Color", 0, 0, 0),
    reach=lambda call: None,
)
def border(call: Call):
    """The image on a wider opaque canvas, its colour showing through, a line around the image if wanted."""
    image = call.image()
    old = image.frame
    w, h, left, top = canvas_of(old.w, old.h, call["Size"], call["Bottom"], list(CANVAS_ASPECTS.values())[call["Aspect"]])
    line = rounded(call["Line Size"] / 100 * max(old.w, old.h))
    paper, ink = call["Color"][:3], call["Line Color"][:3]
    near = F.col("x").between(left - line, left + old.w + line - 1) & F.col("y").between(top - line, top + old.h + line - 1) & F.lit(line > 0)
    bare = [F.when(near, float(i)).otherwise(float(p)) for p, i in zip(paper, ink, strict=True)]
    right, under = left + old.w, top + old.h
    sides = [(0, 0, w, top), (0, top, left, under), (right, top, w, under), (0, under, w, h)]
    within, *around = places(old.df.select("img").distinct(), (left, top, right, under), *(p for p in sides if p[0] < p[2] and p[1] < p[3]))
    around = [part.select("img", "y", "x", *[c.alias(f"s{k}") for k, c in enumerate(bare)]) for part in around]
    inner = old.df.select(F.col("img").alias("i"), (F.col("y") + top).alias("j"), (F.col("x") + left).alias("k"), *[F.col(n).alias(f"p{c}") for c, n in enumerate(image.names)])
    inside = within.join(inner.hint("merge"), (F.col("img") == F.col("i")) & (F.col("y") == F.col("j")) & (F.col("x") == F.col("k")), "left")
    inside = inside.select("img", "y", "x", *[F.coalesce(F.col(f"p{k}") * F.col("p3") + float(p) * (1.0 - F.col("p3")), c).alias(f"s{k}") for k, (p, c) in enumerate(zip(paper, bare, strict=True))])
    frame = Frame(functools.reduce(DataFrame.union, around, inside), w, h)
    return frame.image(*(F.col(f"s{k}") for k in range(3)), 1.0)


#: Pixels of a tile of whole lines that one task smears, about.
SMEARED = 1 << 20
TAPS = 48


@operator("filter.sun_beams", "Image image", "Image image", number("Source X", 0.5, 0, 1), number("Source Y", 0.3, 0, 1), number("Length", 0.3, 0, 1), reach=lambda call: None)
def sun_beams(call: Call):
    """Light smeared away from a point: taps toward it, weighted less the farther they are; alpha stays.

    A tile of lines gives its share of all sums that read it, and shares are added: pixels are sent once and
    sums once for each tile that a pixel's taps pass, not once for each tap.
    """
    image = call.image()
    old, size = image.frame, max(1, SMEARED // image.frame.w)
    tile = F.floor(F.col("y") / size).cast("int")
    # The first line of a tile is also the lower neighbour of the last one before it.
    tiles = F.when((F.col("y") % size == 0) & (F.col("y") > 0), F.array(tile - 1, tile)).otherwise(F.array(tile))
    pixels = old.df.select("img", F.explode(tiles).alias("tile"), "y", "x", *[F.col(n).alias(f"p{k}") for k, n in enumerate(image.names)])
    sums = ", ".join(f"t{k} double" for k in range(4))
    smear = _smearing(old.w, old.h, size, call["Source X"] * old.w, call["Source Y"] * old.h, call["Length"])
    shares = pixels.groupBy("img", "tile").applyInArrow(smear, f"img string, y int, x int, {sums}, own double, here boolean")
    whole = shares.groupBy("img", "y", "x").agg(*[F.sum(f"t{k}").alias(f"t{k}") for k in range(4)], F.max("own").alias("s3"), F.max("here").alias("here")).where("here")
    out = Frame(whole.select("img", "y", "x", *[(F.col(f"t{k}") / F.col("t3")).alias(f"s{k}") for k in range(3)], "s3"), old.w, old.h)
    return out.image(*(F.col(f"s{k}") for k in range(4)))


def _smearing(w: int, h: int, size: int, cx: float, cy: float, length: float):
    """One tile's pixels to its shares of the weighted sums (three channels and the weights) of all pixels."""

    def smear(table):
        import numpy as np
        import pyarrow as pa

        first = table["tile"][0].as_py() * size
        y, x = table["y"].to_numpy() - first, table["x"].to_numpy()
        cells = np.zeros((min(size, h - first) + 1, w, 4))
        for k in range(3):
            cells[y, x, k] = table[f"p{k}"].fill_null(0.0).to_numpy()
        cells[y, x, 3] = 1.0
        count = min(size, h - first)
        if first + count >= h:
            cells[count] = cells[count - 1]
        along = [tap / TAPS * length for tap in range(TAPS)]
        # Lines whose taps read line ``first`` and those behind it, with one to spare.
        back = lambda line, a: (line - a * cy) / (1.0 - a)
        ends = [(max(0, math.floor(back(first, a)) - 2), min(h, math.ceil(back(first + count + 1, a)) + 2)) for a in along]
        if first == 0:
            ends = [(0, hi) for _, hi in ends]
        if first + count >= h:
            ends = [(lo, h) for lo, _ in ends]
        low, high = min(lo for lo, _ in ends), max(hi for _, hi in ends)
        total = np.zeros((max(high - low, 0), w, 4))
        places = np.arange(w)
        for tap, (a, (lo, hi)) in enumerate(zip(along, ends, strict=True)):
            lines = np.arange(lo, hi)
            sy = lines + 0.5 + (cy - lines - 0.5) * a
            y0 = np.floor(sy - 0.5)
            held = np.clip(y0, 0, h - 1).astype(np.int64) - first
            mine = (held >= 0) & (held < count)
            lines, sy, y0, held = lines[mine], sy[mine], y0[mine], held[mine]
            fy = np.where((y0 < 0) | (y0 >= h), 0.0, sy - 0.5 - y0)[:, None, None]
            sx = places + 0.5 + (cx - places - 0.5) * a
            x0 = np.floor(sx - 0.5)
            fx = np.where((x0 < 0) | (x0 >= w), 0.0, sx - 0.5 - x0)[:, None]
            left = np.clip(x0, 0, w - 1).astype(np.int64)
            across = cells[:, left] * (1.0 - fx) + cells[:, np.minimum(left + 1, w - 1)] * fx
            total[lines - low] += (across[held] * (1.0 - fy) + across[held + 1] * fy) * (1.0 - tap / TAPS)
        at = np.nonzero(total[:, :, 3] > 0)
        values = total[at]
        parts = {"y": (at[0] + low).astype(np.int32), "x": at[1].astype(np.int32), **{f"t{k}": values[:, k] for k in range(4)}}
        name = table["img"][0].as_py()
        shares = pa.table({"img": pa.array([name] * len(values), pa.string()), **parts, "own": pa.nulls(len(values), pa.float64()), "here": pa.nulls(len(values), pa.bool_())})
        mine = table.filter(pa.array(y < count))
        zero = np.zeros(mine.num_rows)
        alone = pa.table({"img": mine["img"].cast(pa.string()), "y": mine["y"], "x": mine["x"], **{f"t{k}": zero for k in range(4)}, "own": mine["p3"], "here": pa.array(np.ones(mine.num_rows, bool))})
        return pa.concat_tables([shares, alone])

    return smear


@operator(
    "filter.directional_blur", "Image image", "Image image", number("Distance", 30, 0, 400), number("Angle", 0, -180, 180), number("Spin", 0, -90, 90), number("Zoom", 0, 0, 1), number("Center X", 0.5, 0, 1),
    number("Center Y", 0.5, 0, 1), choice("Quality", "High|Fast"), reach=lambda call: None,
)
def directional_blur(call: Call):
    """The mean of up to 96 samples along a path of shift, turn and zoom, exploded and gathered.

    Fast: every pass takes the mean of the picture and itself moved along the path, twice as far as the
    pass before; so n passes are 2^n samples.
    """
    image = call.image()
    frame, dist, ang, spin, zoom = image.frame, call["Distance"], math.radians(call["Angle"]), math.radians(call["Spin"]), call["Zoom"]
    cx, cy = call["Center X"] * frame.w, call["Center Y"] * frame.h
    steps = min(max(int(max(dist, abs(spin) * frame.w * 0.5, zoom * frame.w * 0.5)), 1), 96)
    if call["Quality"] == 1:
        return _doubled(image, math.ceil(math.log2(steps)), spin, zoom, (math.cos(ang) * dist, math.sin(ang) * dist), (cx, cy))
    path = Frame(frame.df.select("img", "y", "x", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))).alias("tap")), frame.w, frame.h)
    t = F.col("tap") / max(steps - 1, 1)
    px, py, k = F.col("x") + 0.5 - cx, F.col("y") + 0.5 - cy, 1.0 - zoom * t
    ca, sa = F.cos(spin * t), F.sin(spin * t)
    taken = sample(image, path, (px * ca - py * sa) * k + cx + math.cos(ang) * dist * t, (px * sa + py * ca) * k + cy + math.sin(ang) * dist * t)
    out = Frame(path.df.groupBy("img", "y", "x").agg(*[F.avg(n).alias(f"s{i}") for i, n in enumerate(taken)]), frame.w, frame.h)
    return out.image(*(F.col(f"s{i}") for i in range(4)))


def _doubled(image: Image, passes: int, spin: float, zoom: float, shift: tuple[float, float], centre: tuple[float, float]) -> Image:
    """The path's first part as an affine map around the centre, put on itself after every pass."""
    import numpy as np

    if not passes:
        return image
    parts, frame, names = 2**passes - 1, image.frame, image.names
    size, angle = max(1.0 - zoom, 0.01) ** (1 / parts), spin / parts
    way = np.array([[size * math.cos(angle), -size * math.sin(angle), shift[0] / parts], [size * math.sin(angle), size * math.cos(angle), shift[1] / parts], [0, 0, 1]])
    qx, qy = F.col("x") + 0.5 - centre[0], F.col("y") + 0.5 - centre[1]
    for _ in range(passes):
        (a, b, u), (c, d, v) = way[:2].tolist()
        moved = sample(Image(frame, *names), frame, a * qx + b * qy + u + centre[0], c * qx + d * qy + v + centre[1])
        names = frame.add(*((F.col(p) + F.col(q)) * 0.5 for p, q in zip(names, moved, strict=True)))
        way = way @ way
    return Image(frame, *names)
