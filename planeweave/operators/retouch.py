"""Perspective, lens profiles, watermarks, spots and exposure merging."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from planeweave.functions import maths as m
from planeweave.plans.lineage import cut
from planeweave.plans.registry import REGISTRY, Call, Pin, Spec, choice, flag, number, operator, shape
from planeweave.plans.values import Frame, Image

from . import upright
from .align import shifts
from .geometry import sample
from .spots import healed, membrane
from .stencil import blurred

#: Camera turn at the ends of the sliders, in radians.
MOST_TILT = math.radians(30.0)


def _turn(axis: int, angle: float) -> np.ndarray:
    c, s = math.cos(angle), math.sin(angle)
    i, j = [(1, 2), (2, 0), (0, 1)][axis]
    out = np.eye(3)
    out[i, i], out[i, j], out[j, i], out[j, j] = c, -s, s, c
    return out


def perspective_map(call: Call, w: int, h: int) -> np.ndarray:
    """From relative output to relative input coordinates: offset, scale and aspect undone, then the turn."""
    cx, cy = w / 2, h / 2
    f = math.hypot(cx, cy)
    turn = _turn(2, math.radians(call["Rotate"])) @ _turn(1, call["Horizontal"] / 100 * MOST_TILT) @ _turn(0, -call["Vertical"] / 100 * MOST_TILT)
    move = lambda x, y: np.array([[1, 0, x], [0, 1, y], [0, 0, 1.0]])
    camera = np.diag([f, f, 1]) @ turn.T @ np.diag([1 / f, 1 / f, 1])
    sx = 2.0 ** (call["Aspect"] / 200)

    def build(scale: float) -> np.ndarray:
        centred = camera @ np.diag([1 / sx, sx, 1]) @ np.diag([1 / scale, 1 / scale, 1]) @ move(-call["X Offset"] / 100 * cx, call["Y Offset"] / 100 * cy)
        return np.diag([1 / w, 1 / h, 1]) @ move(cx, cy) @ centred @ move(-cx, -cy) @ np.diag([w, h, 1])

    def filled(scale: float) -> bool:
        t = np.linspace(0, 1, 17)
        edge = np.concatenate([np.stack([a, b, np.ones(17)], 1) for a, b in ((t, 0 * t), (t, 0 * t + 1), (0 * t, t), (0 * t + 1, t))])
        p = edge @ build(scale).T
        return bool((p[:, 2] > 1e-9).all() and (np.abs(p[:, :2] / p[:, 2:] - 0.5) <= 0.5 + 1e-6).all())

    scale = call["Scale"] / 100
    if not call["Constrain Crop"] or filled(scale):
        return build(scale)
    low, high = scale, scale * 2
    while not filled(high) and high < scale * 16:
        low, high = high, high * 2
    if not filled(high):
        return build(scale)
    for _ in range(40):
        middle = (low + high) / 2
        low, high = (low, middle) if filled(middle) else (middle, high)
    return build(high)


UPRIGHT = "Off|Guided|Auto|Level|Vertical|Full"


@operator(
    "xform.perspective", "Image image", "Image image", *[number(n, 0, -100, 100) for n in ("Vertical", "Horizontal")], number("Rotate", 0, -45, 45), *[number(n, 0, -100, 100) for n in ("Aspect", "X Offset", "Y Offset")],
    number("Scale", 100, 50, 150), flag("Constrain Crop", False), choice("Upright", UPRIGHT), shape("Guides", []), reach=lambda call: None,
)
def perspective(call: Call):
    """The camera turned by the sliders, before that by what makes lines upright, drawn by hand or the picture's own: nine numbers, one gather.

    Constrain Crop looks at the sliders only.
    """
    image = call.image()
    frame = image.frame
    u, v = (F.col("x") + 0.5) / frame.w, (F.col("y") + 0.5) / frame.h
    given, mode = perspective_map(call, frame.w, frame.h), UPRIGHT.split("|")[call["Upright"]]
    if mode == "Guided":
        given = upright.unturned(upright.guided(call["Guides"] or [], frame.w, frame.h), frame.w, frame.h, given)
    cells = [[F.lit(float(c)) for c in row] for row in given]
    if mode in upright.FREE:
        found = upright.maps(upright.segments(image, call.linear), frame.w, frame.h, mode, given)
        key, names = frame.name(), [frame.name() for _ in range(9)]
        frame.df = frame.df.join(found.select(F.col("img").alias(key), *[F.col(f"p{k}").alias(n) for k, n in enumerate(names)]), F.col("img") == F.col(key), "left").drop(key)
        cells = [[F.coalesce(F.col(names[3 * i + j]), cells[i][j]) for j in range(3)] for i in range(3)]
    px, py, pw = call.keep(*(r[0] * u + r[1] * v + r[2] for r in cells))
    safe = F.when(pw > 1e-9, pw).otherwise(1.0)
    s, t = call.keep(F.when(pw > 1e-9, px / safe).otherwise(-1.0), F.when(pw > 1e-9, py / safe).otherwise(-1.0))
    return Image(frame, *sample(image, frame, s * frame.w, t * frame.h, clear=True))


@operator("xform.lens_profile", "Image image", "Image image", shape("Profile", {}), reach=lambda call: None)
def lens_profile(call: Call):
    """A lens model given by its numbers: {"model": poly3 | poly5 | ptlens, "k": [...], "red": k, "blue": k, "vignetting": [k1, k2, k3]}.

    Radii are 1 at half the short edge, for vignetting at the corner. Nothing given leaves the image.
    """
    image, told = call.image(), call["Profile"] if isinstance(call["Profile"], dict) else {}
    if image is None or not told:
        return image
    frame = image.frame
    half, corner = min(frame.w, frame.h) / 2, math.hypot(frame.w, frame.h) / 2
    dx, dy = call.keep(F.col("x") + 0.5 - frame.w / 2, F.col("y") + 0.5 - frame.h / 2)
    (r,) = call.keep(m.hypot(dx, dy) / half)
    k = [*map(float, told.get("k", [])), 0.0, 0.0, 0.0][:3]
    bend = {
        "poly3": lambda: 1.0 - k[0] + k[0] * r * r, "poly5": lambda: 1.0 + k[0] * r * r + k[1] * r * r * r * r,
        "ptlens": lambda: k[0] * r * r * r + k[1] * r * r + k[2] * r + (1.0 - sum(k)),
    }.get(told.get("model"), lambda: F.lit(1.0))()
    scales = (float(told.get("red", 1.0)), 1.0, float(told.get("blue", 1.0)))
    rgb, alpha = image.rgb, image.alpha
    if told.get("model") or scales != (1.0, 1.0, 1.0):
        (b,) = call.keep(bend)
        taken = {s: sample(image, frame, dx * b * s + frame.w / 2, dy * b * s + frame.h / 2, clear=True) for s in dict.fromkeys(scales)}
        rgb, alpha = [F.col(taken[s][c]) for c, s in enumerate(scales)], F.col(taken[1.0][3])
    if told.get("vignetting"):
        v = [*map(float, told["vignetting"]), 0.0, 0.0, 0.0][:3]
        q = (dx * dx + dy * dy) / corner**2
        (gain,) = call.keep(1.0 / m.biggest(1.0 + v[0] * q + v[1] * q * q + v[2] * q * q * q, 0.05))
        rgb = [c * gain if call.linear else m.to_srgb(m.to_linear(m.clamp01(c)) * gain) for c in rgb]
    return frame.image(*(m.clamp_colour(c, call.linear) for c in rgb), alpha)


ANCHORS = "Top Left|Top|Top Right|Left|Center|Right|Bottom Left|Bottom|Bottom Right"


@operator("xform.watermark", "Image image, Logo image", "Image image", choice("Anchor", ANCHORS, 8), number("Size", 20, 1, 100), number("Margin", 3, 0, 50), number("Opacity", 0.5, 0, 1), reach=lambda call: None)
def watermark(call: Call):
    """A logo laid over the image: size and margin in percent of the width and the longer edge."""
    image, logo = call.inputs
    if not isinstance(image, Image) or not isinstance(logo, Image):
        return image
    frame, home = image.frame, logo.frame
    w = call["Size"] / 100 * frame.w
    k = w / home.w
    h, gap = home.h * k, call["Margin"] / 100 * max(frame.w, frame.h)
    column, row = call["Anchor"] % 3, call["Anchor"] // 3
    x0, y0 = (gap, (frame.w - w) / 2, frame.w - w - gap)[column], (gap, (frame.h - h) / 2, frame.h - h - gap)[row]
    names = sample(logo, frame, (F.col("x") + 0.5 - x0) / k, (F.col("y") + 0.5 - y0) / k, clear=True)
    (a,) = call.keep(m.clamp01(F.col(names[3]) * call["Opacity"]))
    return frame.image(*(m.mix(s, F.col(n), a) for s, n in zip(image.rgb, names, strict=False)), m.clamp01(a + image.alpha * (1.0 - a)))


@operator("filter.spot_removal", "Image image", "Image image", shape("Spots", []), reach=lambda call: None)
def spot_removal(call: Call):
    """Circles filled from elsewhere in the image, in order.

    A spot: {"x", "y", "sx", "sy" of 0..1, "size": of the longer edge, "feather", "opacity", "mode": "clone" | "heal"}.
    Heal adds what the two edges' colours differ by, spread smoothly over the inside.
    """
    image = call.image()
    for spot in call["Spots"] if isinstance(call["Spots"], list) else []:
        frame = image.frame
        w, h, r = frame.w, frame.h, max(float(spot.get("size", 0.03)) * max(frame.w, frame.h), 1.0)
        cx, cy, sx, sy = float(spot["x"]) * w, float(spot["y"]) * h, float(spot["sx"]) * w, float(spot["sy"]) * h
        x, y = F.col("x") + 0.5, F.col("y") + 0.5
        (d,) = call.keep(m.hypot(x - cx, y - cy))
        inner = r * (1.0 - float(spot.get("feather", 0.5)))
        cover = F.when(d >= r, 0.0).otherwise(1.0 - m.smoothstep(inner, r, d)) * float(spot.get("opacity", 1.0))
        (covered,) = frame.add(cover)
        names = sample(image, frame, x + (sx - cx), y + (sy - cy))
        copied = [F.col(n) for n in names[:3]]
        if spot.get("mode", "heal") == "heal":
            added = membrane(image, call.linear, (cx, cy), (sx - cx, sy - cy), r)
            copied = [F.when(F.col(covered) > 0, healed(c, v, call.linear)).otherwise(c) for c, v in zip(copied, added, strict=True)]
        (a,) = call.keep(F.col(covered))
        image = frame.image(*(m.clamp_colour(m.mix(s, c, a), call.linear) for s, c in zip(image.rgb, copied, strict=True)), image.alpha)
    return image


FRAMES = 32


#: Stops between exposures above which something moved, by strength; shares of full weight
#: that the reference and a picture need to be judged; blur of the mask by the longer edge.
GHOST_STOPS, GHOST_JUDGED, GHOST_BLUR = (0.0, 1.0, 0.6, 0.35), (0.2, 0.05), 0.004


def _aligned(frame, light: list[list], lum: list, refs) -> list[list]:
    """Columns of every exposure where it shows what the middle one shows at a pixel; the edge repeated.

    Exposures that lie alike in every image stay where they are. The others' pixels are sent to their
    places, so that all joins share the frame's key.
    """
    found = shifts(frame.df, lum, refs, frame.w, frame.h)
    away = found.where("dx != 0 or dy != 0")
    moved, home, out = [r.picture for r in away.select("picture").distinct().collect()], frame.df, []  # at most FRAMES numbers
    for i, rgb in enumerate(light):
        if i in moved:
            key, own = [frame.name() for _ in range(3)], [frame.name() for _ in range(3)]
            by = away.where(F.col("picture") == i).select(F.col("img").alias("m_img"), "dx", "dy")
            # The places a pixel is shown at: one, none, or along an edge all that lie beyond it.
            first = lambda k, d, n: F.when(F.col(k) == 0, 0).otherwise(F.greatest(F.col(k) - F.col(d), F.lit(0)))
            last = lambda k, d, n: F.when(F.col(k) == n - 1, n - 1).otherwise(F.least(F.col(k) - F.col(d), F.lit(n - 1)))
            sent = home.join(F.broadcast(by), F.col("img") == F.col("m_img"), "left").withColumns({d: F.coalesce(d, F.lit(0)) for d in ("dx", "dy")})
            sent = sent.withColumns({f"{e}_{k}": f(k, d, n) for k, d, n in (("y", "dy", frame.h), ("x", "dx", frame.w)) for e, f in (("first", first), ("last", last))})
            sent = sent.where("first_y <= last_y and first_x <= last_x").withColumn("to_y", F.explode(F.sequence("first_y", "last_y"))).withColumn("to_x", F.explode(F.sequence("first_x", "last_x")))
            sent = sent.select(F.col("img").alias(key[0]), F.col("to_y").alias(key[1]), F.col("to_x").alias(key[2]), *[c.alias(n) for c, n in zip(rgb, own, strict=True)])
            frame.df = frame.df.join(sent, (F.col("img") == F.col(key[0])) & (F.col("y") == F.col(key[1])) & (F.col("x") == F.col(key[2])), "left").drop(*key)
            rgb = [F.col(n) for n in own]
        out.append([F.col(n) for n in frame.add(*(F.coalesce(c, F.lit(0.0)) for c in rgb))])
    return out


def _hdr(call: Call):
    """Exposures merged at the middle one's brightness.

    Frames are aligned to it, scaled by the median ratio of pixels well exposed in both, then averaged
    by a hat weight, without those that disagree with it where Deghost is on. The exposures' light is
    written once, as every step reads it. Means, shifts and medians are one row per image, joined;
    medians take a grid of bounded size.
    """
    images = [i for k in range(1, FRAMES + 1) if (i := call.image(f"Image {k}")) is not None]
    if len(images) < 2:
        return images[0] if images else None
    first, n = images[0].frame, len(images)
    held = {f"{c}{k}": v if call.linear or c == "a" else m.to_linear(v) for k, i in enumerate(images) for c, v in zip("rgba", (*i.rgb, i.alpha), strict=True)}
    frame = Frame(cut(first.df.select("img", "y", "x", *[v.alias(name) for name, v in held.items()])), first.w, first.h)
    light, alphas = [[F.col(f"{c}{k}") for c in "rgb"] for k in range(n)], [F.col(f"a{k}") for k in range(n)]
    keep = lambda *columns: [F.col(c) for c in frame.add(*columns)]
    brightness = lambda light: keep(*(m.biggest(m.luma(*rgb), 0.0) for rgb in light))
    lum = brightness(light)
    key, stats, mid = frame.name(), frame.name(), frame.name()
    order = F.array_sort(F.transform(F.col(stats), lambda v, i: F.struct(v.alias("v"), i.alias("i"))))
    means = frame.df.groupBy("img").agg(F.array(*map(F.avg, lum)).alias(stats)).withColumn(mid, F.element_at(order, (n - 1) // 2 + 1)["i"])
    means = cut(means.withColumnRenamed("img", key))
    frame.df = frame.df.join(F.broadcast(means.select(key, mid)), F.col("img") == F.col(key)).drop(key)
    if call["Auto Align"]:
        light = _aligned(frame, light, lum, means.select(F.col(key).alias("img"), F.col(mid).alias("ref")))
        lum = brightness(light)
    of_middle = lambda columns: F.element_at(F.array(*columns), F.col(mid) + 1)
    (ref,) = keep(of_middle(lum))
    step = max(1, int(math.sqrt(frame.w * frame.h / 250_000)))
    fair = lambda v: (v > 0.01) & (v < 0.8)
    grid = frame.df.where((F.col("x") % step == 0) & (F.col("y") % step == 0))
    ratios = [F.sort_array(F.collect_list(F.when(fair(ref) & fair(v), v / F.when(ref > 0, ref).otherwise(1.0)))) for v in lum]
    found, scales, darkest, brightest = ([frame.name() for _ in range(n)] for _ in range(4))
    medians = grid.groupBy("img").agg(*[r.alias(c) for r, c in zip(ratios, found, strict=True)])
    medians = medians.select("img", *[F.when(F.size(c) >= 50, F.element_at(c, F.floor(F.size(c) / 2).cast("int") + 1)).alias(c) for c in found])
    # What is the same all over an image is found on its one row, not pixel by pixel.
    medians = medians.join(F.broadcast(means), F.col("img") == F.col(key))
    mean = lambda i: F.element_at(F.col(stats), i + 1)
    ratio = [F.coalesce(F.col(c), mean(i) / F.greatest(F.element_at(F.col(stats), F.col(mid) + 1), F.lit(1e-6))) for i, c in enumerate(found)]
    medians = medians.select(key, *[F.when(F.col(mid) == i, 1.0).when(r > 1e-6, 1.0 / F.when(r > 1e-6, r).otherwise(1.0)).otherwise(1.0).alias(s) for i, (r, s) in enumerate(zip(ratio, scales, strict=True))])
    ends = [*((F.greatest(*scales), c, s) for c, s in zip(darkest, scales, strict=True)), *((F.least(*scales), c, s) for c, s in zip(brightest, scales, strict=True))]
    medians = cut(medians.select("*", *[(F.col(s) == end).alias(c) for end, c, s in ends]))
    frame.df = frame.df.join(F.broadcast(medians), F.col("img") == F.col(key)).drop(key)
    scale = [F.col(s) for s in scales]
    weights = []
    for rgb, dark, bright in zip(light, darkest, brightest, strict=True):
        (t,) = keep(F.pow(m.clamp01(F.greatest(*rgb)), F.lit(1 / 2.2)))
        hat = 1.0 - F.pow(2.0 * t - 1.0, F.lit(12.0))
        least = F.when((F.col(dark) & (t > 0.5)) | (F.col(bright) & (t <= 0.5)), 1e-3).otherwise(1e-6)
        weights.append(F.greatest(hat, least))
    weights = keep(*weights)
    if call["Deghost"]:
        (sure,) = keep(of_middle(weights) >= GHOST_JUDGED[0])
        judged = lambda w: sure & (w >= GHOST_JUDGED[1])
        apart = [F.abs(F.log2((v * s + 1e-4) / (ref + 1e-4))) for v, s in zip(lum, scale, strict=True)]
        ghosts = frame.add(*(F.when(judged(w) & (d > GHOST_STOPS[call["Deghost"]]), 1.0).otherwise(0.0) for d, w in zip(apart, weights, strict=True)))
        sigma = max(1.0, GHOST_BLUR * max(frame.w, frame.h))
        soft = blurred(frame, ghosts, sigma, sigma)
        weights = keep(*(F.when(F.col(mid) == i, F.greatest(w, F.lit(1e-6))).otherwise(w * m.clamp01(1.0 - 2.0 * F.col(g))) for i, (w, g) in enumerate(zip(weights, soft, strict=True))))
    total = sum(weights[1:], weights[0])
    merged = [sum((rgb[c] * s * w for rgb, s, w in zip(light, scale, weights, strict=True)), F.lit(0.0)) / total for c in range(3)]
    return frame.image(*(m.biggest(c, 0.0) if call.linear else m.to_srgb(m.biggest(c, 0.0)) for c in merged), of_middle(alphas))


REGISTRY["math.hdr_merge"] = Spec(
    "math.hdr_merge", tuple(Pin(f"Image {k}", "image") for k in range(1, FRAMES + 1)), (Pin("Image", "image"),),
    (flag("Auto Align", True), choice("Deghost", "None|Low|Medium|High")), _hdr, lambda call: None,
)
