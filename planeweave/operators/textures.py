"""Generators: planes and images from position alone."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from planeweave.functions import maths as m
from planeweave.functions import noise
from planeweave.plans.registry import Call, choice, colour, number, operator
from planeweave.plans.values import Frame


def place(frame: Frame):
    """Centred coordinates: v spans -0.5..0.5, u as much times the aspect."""
    return ((F.col("x") + 0.5) / frame.w - 0.5) * (frame.w / frame.h), (F.col("y") + 0.5) / frame.h - 0.5


def _seed(call: Call) -> int:
    return max(0, math.floor(call["Seed"] + 0.5))


def _grey(frame: Frame, v):
    plane = frame.plane(v)
    return plane, frame.image(*[F.col(plane.v)] * 3, 1.0)


@operator("tex.noise", "", "Fac plane, Color image", number("Scale", 5, 0.1, 50), number("Detail", 2, 0, 12), number("Roughness", 0.5, 0, 1), number("Lacunarity", 2, 1, 4), number("Distortion", 0, 0, 5), number("Seed", 0, 0, 100))
def noise_texture(call: Call):
    frame, seed, warp = call.frame, _seed(call), call["Distortion"]
    octaves = (call["Detail"], call["Roughness"], call["Lacunarity"])
    x, y = (F.col(n) for n in frame.add(*(c * call["Scale"] for c in place(frame))))
    if warp > 0:
        (x,) = call.keep(x + (noise.fbm(call.keep, [(x + 13.1, y, seed + 7)], *octaves)[0] - 0.5) * warp)
        (y,) = call.keep(y + (noise.fbm(call.keep, [(x, y + 7.7, seed + 11)], *octaves)[0] - 0.5) * warp)
    r, g, b = noise.fbm(call.keep, [(x, y, seed + k) for k in (0, 101, 202)], *octaves)
    return frame.plane(r), frame.image(r, g, b, 1.0)


@operator("tex.voronoi", "", "Distance plane, Color image", number("Scale", 8, 0.1, 60), number("Randomness", 1, 0, 1), number("Seed", 0, 0, 100))
def voronoi_texture(call: Call):
    frame, seed = call.frame, _seed(call)
    x, y = (F.col(n) for n in frame.add(*(c * call["Scale"] for c in place(frame))))
    d, cx, cy = (F.col(n) for n in frame.add(*noise.voronoi(call.keep, x, y, call["Randomness"], seed)))
    return frame.plane(F.least(d, F.lit(1.0))), frame.image(*noise.cell_floats(call.keep, [(cx, cy, seed, 10 + k) for k in range(3)]), 1.0)


@operator("tex.gradient", "", "Fac plane, Color image", choice("Type", "Linear|Quadratic|Easing|Diagonal|Spherical|Quadratic Sphere|Radial"), number("Angle", 0, -180, 180))
def gradient(call: Call):
    frame, a = call.frame, math.radians(call["Angle"])
    (u, v), aspect = place(frame), call.frame.w / call.frame.h
    t = m.clamp01((u * math.cos(a) + v * math.sin(a)) / max(aspect, 1e-3) + 0.5)
    ball = m.biggest(1.0 - m.hypot(u, v) * 2.0, 0.0)
    kinds = [t, t * t, t * t * (3 - 2 * t), ((u / aspect + 0.5) + (v + 0.5)) * 0.5, ball, ball * ball, F.atan2(v, u) / (2 * math.pi) + 0.5]
    return _grey(frame, m.clamp01(kinds[call["Type"]]))


@operator(
    "tex.wave", "", "Fac plane, Color image", choice("Type", "Bands|Rings"), choice("Profile", "Sine|Saw|Triangle"), number("Scale", 5, 0.1, 50), number("Angle", 0, -180, 180), number("Distortion", 0, 0, 20),
    number("Detail", 2, 0, 12), number("Phase", 0, 0, 1),
)
def wave(call: Call):
    frame, a = call.frame, math.radians(call["Angle"])
    x, y = (c * call["Scale"] for c in place(frame))
    n = x * math.cos(a) + y * math.sin(a) if call["Type"] == 0 else m.hypot(x, y)
    if call["Distortion"] > 0:
        n = n + call["Distortion"] * (noise.fbm(call.keep, [(x, y, 3)], call["Detail"], 0.5, 2.0)[0] - 0.5)
    (n,) = call.keep(n + call["Phase"])
    return _grey(frame, [0.5 + 0.5 * F.sin(n * 2.0 * math.pi), m.fract(n), 1.0 - F.abs(2.0 * m.fract(n) - 1.0)][call["Profile"]])


@operator("tex.checker", "", "Color image, Fac plane", number("Scale", 8, 0.5, 100), colour("Color 1", 0.8, 0.8, 0.8), colour("Color 2", 0.2, 0.2, 0.2))
def checker(call: Call):
    frame = call.frame
    u, v = (m.floor(c * call["Scale"]) for c in place(frame))
    plane = frame.plane(F.when(F.pmod(u + v, F.lit(2.0)) == 0, 1.0).otherwise(0.0))
    light = F.col(plane.v) > 0.5
    return frame.image(*(F.when(light, p).otherwise(q) for p, q in zip(call["Color 1"], call["Color 2"], strict=True)), 1.0), plane


@operator("tex.white_noise", "", "Value plane, Color image", number("Grain Size", 1, 1, 32), number("Seed", 0, 0, 100))
def white_noise(call: Call):
    frame, seed, cell = call.frame, _seed(call), max(1.0, call["Grain Size"])
    x, y = m.floor(F.col("x") / cell), m.floor(F.col("y") / cell)
    v, *rgb = noise.cell_floats(call.keep, [(x, y, seed, salt) for salt in (0, 20, 21, 22)])
    return frame.plane(v), frame.image(*rgb, 1.0)


@operator("filter.grain", "Image image, Amount plane = Amount", "Image image", number("Amount", 25, 0, 100), number("Size", 25, 0, 100), number("Roughness", 50, 0, 100), number("Seed", 0, 0, 100))
def grain(call: Call):
    """Three scales of noise, strongest in the midtones. Strength 0.08 % and the noise's deviation 0.32."""
    image = call.image()
    frame, rough, seed = image.frame, call["Roughness"] / 100, _seed(call) * 3
    cell = 1.0 + call["Size"] / 100 * 3.0
    fine, clump = 1.0 - 0.5 * rough, 0.8 * rough
    x, y = (F.col(n) for n in frame.add((F.col("x") + 0.5) / cell, (F.col("y") + 0.5) / cell))
    near, wide, widest = noise.perlin(call.keep, [(x, y, seed), (x * 0.5 + 17.3, y * 0.5, seed + 1), (x * 0.25 + 41.7, y * 0.25, seed + 2)])
    g = (near * fine + wide * clump) * (1.0 + 0.6 * rough * widest) / (0.32 * math.hypot(fine, clump))
    seen = [m.to_srgb(c) if call.linear else c for c in image.rgb]
    light = m.luma(*seen)
    (added,) = frame.add(call.driven("Amount") * 0.0008 * m.clamp01(4.0 * light * (1.0 - light)) * g)
    return frame.image(*(m.clamp_colour(m.to_linear(c + F.col(added)) if call.linear else c + F.col(added), call.linear) for c in seen), image.alpha)


@operator(
    "filter.vignette", "Image image, Amount plane = Amount", "Image image", choice("Style", "Highlight Priority|Color Priority|Paint Overlay"), number("Amount", -25, -100, 100), number("Midpoint", 50, 0, 100),
    number("Roundness", 0, -100, 100), number("Feather", 50, 0, 100), number("Highlights", 0, 0, 100),
)
def vignette(call: Call):
    """A superellipse around the centre. The overlay mixes to black or white in display values; the other
    styles change light by up to two stops, and lightening by highlight priority screens instead."""
    image = call.image()
    frame, turn, linear = image.frame, call["Roundness"] / 100, call.linear
    hw, hh = frame.w / 2, frame.h / 2
    near, n = min(hw, hh), 2.0 + max(-turn, 0.0) * 6.0
    rx, ry = (max(s + (near - s) * max(turn, 0.0), 1e-3) for s in (hw, hh))
    mid, width = 0.35 + 0.9 * call["Midpoint"] / 100, 0.05 + 1.1 * call["Feather"] / 100
    dx, dy = F.abs(F.col("x") + 0.5 - hw) / rx, F.abs(F.col("y") + 0.5 - hh) / ry
    mask = m.smoothstep(mid - width / 2, mid + width / 2, F.pow(F.pow(dx, F.lit(n)) + F.pow(dy, F.lit(n)), F.lit(1.0 / n)), hard=False)
    mask, a = (F.col(c) for c in frame.add(mask, m.clamp(call.driven("Amount") / 100.0, -1.0, 1.0)))
    if call["Style"] == 2:
        target = F.when(a < 0, 0.0).otherwise(1.0)
        moved = [m.mix(m.to_srgb(c) if linear else c, target, F.abs(a) * mask) for c in image.rgb]
        return frame.image(*(m.clamp_colour(m.to_linear(c) if linear else c, linear) for c in moved), image.alpha)
    light = [F.col(c) for c in frame.add(*(c if linear else m.to_linear(c) for c in image.rgb))]
    gain = F.pow(F.lit(2.0), 2.0 * a * mask)
    bright = m.smoothstep(0.5, 1.0, m.to_srgb(m.clamp01(m.luma(*light))), hard=False)
    gain = F.when(a < 0, gain + (1.0 - gain) * (call["Highlights"] / 100) * bright).otherwise(gain)
    out = []
    for c in light:
        screened = m.to_linear(1.0 - (1.0 - m.to_srgb(c)) / F.pow(gain, F.lit(1 / 2.2)))
        v = F.when(a > 0, screened).otherwise(c * gain) if call["Style"] == 0 else c * gain
        out.append(m.clamp_colour(v if linear else m.to_srgb(v), linear))
    return frame.image(*out, image.alpha)
