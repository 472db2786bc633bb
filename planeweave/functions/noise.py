"""Deterministic procedural noise as columns of a frame; 32-bit arithmetic in 64-bit columns.

A hash reads its argument many times over, so every step becomes a column of its own (``keep``), for
all points, octaves and corners of an operator at once.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .maths import floor, lit

MASK = 0xFFFFFFFF
#: Multipliers of the 32-bit finaliser, the cell coordinates and the salt.
MIX1, MIX2, CELL_X, CELL_Y, SALT = 0x7FEB352D, 0x846CA68B, 0x9E3779B1, 0x85EBCA77, 0x68E31DA4


def _times(x: Column, constant: int) -> Column:
    """x * constant modulo 2^32 by halves, so that no product leaves 64 bits."""
    high, low = constant >> 16, constant & 0xFFFF
    upper = F.shiftleft((x * F.lit(high)).bitwiseAND(F.lit(0xFFFF)), 16)
    return (upper + x * F.lit(low)).bitwiseAND(F.lit(MASK))


def hash32(keep, xs: list[Column]) -> list[Column]:
    fold = lambda by: lambda x: x.bitwiseXOR(F.shiftrightunsigned(x, by))
    for step in (fold(16), lambda x: _times(x, MIX1), fold(15), lambda x: _times(x, MIX2), fold(16)):
        xs = keep(*map(step, xs))
    return xs


def hash32_value(x: int) -> int:
    x ^= x >> 16
    x = x * MIX1 & MASK
    x ^= x >> 15
    x = x * MIX2 & MASK
    return x ^ x >> 16


def cell_hashes(keep, cells: list[tuple[Column, Column, int]]) -> list[Column]:
    """Hashes of integer cells (x, y, seed); x and y are whole doubles."""
    word = lambda c: c.cast("long").bitwiseAND(F.lit(MASK))
    inner = hash32(keep, keep(*(_times(word(y), CELL_Y).bitwiseXOR(F.lit(hash32_value(seed & MASK))) for _, y, seed in cells)))
    return hash32(keep, keep(*(_times(word(x), CELL_X).bitwiseXOR(h) for (x, _, _), h in zip(cells, inner, strict=True))))


def cell_floats(keep, cells: list[tuple[Column, Column, int, int]]) -> list[Column]:
    """Uniform numbers of cells (x, y, seed, salt)."""
    found = cell_hashes(keep, [(x, y, (seed + salt * SALT) & MASK) for x, y, seed, salt in cells])
    return [F.shiftrightunsigned(h, 8) / F.lit(16777216.0) for h in found]


def perlin(keep, points: list[tuple[Column, Column, int]]) -> list[Column]:
    """Gradient noise in about -1..1 at (x, y, seed); the hash's low 16 bits are the gradient's angle."""
    flat = keep(*(c for x, y, _ in points for c in (floor(x), floor(y))))
    near = keep(*(c for (x, y, _), x0, y0 in zip(points, flat[::2], flat[1::2], strict=True) for c in (x - x0, y - y0)))
    corners = [(0, 0), (1, 0), (0, 1), (1, 1)]
    hashes = cell_hashes(keep, [(x0 + i, y0 + j, seed) for (_, _, seed), x0, y0 in zip(points, flat[::2], flat[1::2], strict=True) for i, j in corners])
    turns = keep(*(h.bitwiseAND(F.lit(0xFFFF)) / F.lit(65536.0) * (2 * math.pi) for h in hashes))
    fade = lambda t: t * t * t * (t * (t * 6 - 15) + 10)
    bends = keep(*map(fade, near))
    out = []
    for n in range(len(points)):
        fx, fy, u, v = near[2 * n], near[2 * n + 1], bends[2 * n], bends[2 * n + 1]
        a, b, c, d = (F.cos(t) * (fx - i) + F.sin(t) * (fy - j) for t, (i, j) in zip(turns[4 * n : 4 * n + 4], corners, strict=True))
        top = a + (b - a) * u
        out.append((top + (c + (d - c) * u - top) * v) * 1.414)
    return keep(*out)


def fbm(keep, points: list[tuple[Column, Column, int]], detail: float, roughness: float, lacunarity: float) -> list[Column]:
    """Octaves of ``perlin``, the last one weighted by detail's fraction, brought to about 0..1."""
    whole = int(detail)
    octaves = [(lacunarity**i, roughness**i, i) for i in range(whole + 1)]
    if detail > whole:
        octaves.append((lacunarity ** (whole + 1), roughness ** (whole + 1) * (detail - whole), whole + 1))
    waves = perlin(keep, [(x * f, y * f, seed + 131 * i) for x, y, seed in points for f, _, i in octaves])
    norm, k = sum(amp for _, amp, _ in octaves), len(octaves)
    return keep(*(0.5 + 0.5 * sum((w * amp for w, (_, amp, _) in zip(waves[n * k : n * k + k], octaves, strict=True)), lit(0.0)) / norm for n in range(len(points))))


def voronoi(keep, x: Column, y: Column, randomness: float, seed: int) -> tuple[Column, Column, Column]:
    """(distance, cell x, cell y) of the nearest jittered point among the nine cells around."""
    xi, yi = keep(floor(x), floor(y))
    cells = [(xi + i, yi + j) for j in (-1, 0, 1) for i in (-1, 0, 1)]
    jitter = cell_floats(keep, [(cx, cy, seed, salt) for cx, cy in cells for salt in (1, 2)])
    found = []
    for n, (cx, cy) in enumerate(cells):
        px, py = (c + 0.5 + (jitter[2 * n + k] - 0.5) * randomness for k, c in enumerate((cx, cy)))
        found.append(F.struct(F.sqrt((px - x) * (px - x) + (py - y) * (py - y)).alias("d"), F.lit(n).alias("n"), cx.alias("cx"), cy.alias("cy")))
    (best,) = keep(F.array_min(F.array(*found)))
    return best["d"], best["cx"], best["cy"]
