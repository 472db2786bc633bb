"""Scalar and colour maths as Column expressions; NaN is guarded before comparisons."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

LUMA = (0.2126, 0.7152, 0.0722)


def lit(x) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def clamp(v, lo, hi) -> Column:
    return F.least(F.greatest(lit(v), lit(lo)), lit(hi))


def clamp01(v) -> Column:
    return clamp(v, 0.0, 1.0)


def clamp_colour(v, linear: bool) -> Column:
    """0..1 in display-encoded graphs; scene-linear values keep their highlights."""
    return F.greatest(lit(v), F.lit(0.0)) if linear else clamp01(v)


def biggest(*v) -> Column:
    return F.greatest(*map(lit, v))


def smallest(*v) -> Column:
    return F.least(*map(lit, v))


def power(base, exponent) -> Column:
    return F.pow(lit(base), lit(exponent))


def hypot(a, b) -> Column:
    return F.sqrt(lit(a) * lit(a) + lit(b) * lit(b))


def floor(v) -> Column:
    """Whole part as a double; beyond 1e9 coordinates are held."""
    return F.floor(clamp(v, -1e9, 1e9)).cast("double")


def fract(v) -> Column:
    return lit(v) - floor(v)


def mix(a, b, t) -> Column:
    return lit(a) + (lit(b) - lit(a)) * lit(t)


def smoothstep(e0, e1, x, hard: bool = True) -> Column:
    """t*t*(3-2t); with equal edges a step (``hard``) or a division by at least 1e-6."""
    e0, e1, x = lit(e0), lit(e1), lit(x)
    width = F.when(e1 <= e0, F.lit(1.0)).otherwise(e1 - e0) if hard else biggest(e1 - e0, 1e-6)
    t = clamp01((x - e0) / width)
    soft = t * t * (3 - 2 * t)
    return F.when(e1 <= e0, F.when(x < e0, 0.0).otherwise(1.0)).otherwise(soft) if hard else soft


def luma(r, g, b) -> Column:
    return LUMA[0] * lit(r) + LUMA[1] * lit(g) + LUMA[2] * lit(b)


def to_linear(c) -> Column:
    c = lit(c)
    return F.when(c <= 0.04045, c / 12.92).otherwise(F.pow((biggest(c, 0.0) + 0.055) / 1.055, F.lit(2.4)))


def to_srgb(c) -> Column:
    c = lit(c)
    return F.when(c <= 0.0031308, c * 12.92).otherwise(1.055 * F.pow(biggest(c, 0.0), F.lit(1 / 2.4)) - 0.055)


def rgb_to_hsv(r, g, b) -> tuple[Column, Column, Column]:
    mx, mn = biggest(r, g, b), smallest(r, g, b)
    d = mx - mn
    safe = F.when(d < 1e-6, F.lit(1.0)).otherwise(d)
    hue = F.when(mx == r, (g - b) / safe + F.when(g < b, 6.0).otherwise(0.0)).when(mx == g, (b - r) / safe + 2.0).otherwise((r - g) / safe + 4.0) / 6.0
    return F.when(d < 1e-6, 0.0).otherwise(hue), F.when(mx > 1e-6, d / biggest(mx, 1e-6)).otherwise(0.0), mx


def hsv_to_rgb(h, s, v) -> tuple[Column, Column, Column]:
    h = fract(h) * 6.0
    sector, f = floor(h) % 6, fract(h)
    p, q, t = v * (1 - s), v * (1 - s * f), v * (1 - s * (1 - f))
    pick = lambda *six: F.when(sector == 0, six[0]).when(sector == 1, six[1]).when(sector == 2, six[2]).when(sector == 3, six[3]).when(sector == 4, six[4]).otherwise(six[5])
    return pick(v, q, p, p, t, v), pick(t, v, v, q, p, p), pick(p, p, t, v, v, q)


def rgb_to_hsl(r, g, b) -> tuple[Column, Column, Column]:
    mx, mn = biggest(r, g, b), smallest(r, g, b)
    light, d = (mx + mn) * 0.5, mx - mn
    hue, _, _ = rgb_to_hsv(r, g, b)
    under = F.when(light > 0.5, 2.0 - mx - mn).otherwise(mx + mn)
    return hue, F.when(d < 1e-6, 0.0).otherwise(d / F.when(d < 1e-6, F.lit(1.0)).otherwise(under)), light


def hsl_to_rgb(h, s, light) -> tuple[Column, Column, Column]:
    c = (1.0 - F.abs(2.0 * light - 1.0)) * s
    v = light + c * 0.5
    return hsv_to_rgb(h, F.when(v > 1e-6, c / biggest(v, 1e-6)).otherwise(0.0), v)


#: Linear Rec.709 to XYZ, the white point, and XYZ back to linear Rec.709.
RGB_TO_XYZ = ((0.4124564, 0.3575761, 0.1804375), (0.2126729, 0.7151522, 0.0721750), (0.0193339, 0.1191920, 0.9503041))
WHITE = (0.95047, 1.0, 1.08883)
XYZ_TO_RGB = ((3.2404542, -1.5371385, -0.4985314), (-0.9692660, 1.8760108, 0.0415560), (0.0556434, -0.2040259, 1.0572252))
#: Linear Rec.709 to the Oklab cone response, and its cube roots to Oklab.
OKLAB_CONES = ((0.4122214708, 0.5363325363, 0.0514459929), (0.2119034982, 0.6806995451, 0.1073969566), (0.0883024619, 0.2817188376, 0.6299787005))
OKLAB = ((0.2104542553, 0.7936177850, -0.0040720468), (1.9779984951, -2.4285922050, 0.4505937099), (0.0259040371, 0.7827717662, -0.8086757660))


def matrix(rows, v) -> list[Column]:
    return [sum((m * x for m, x in zip(row[1:], v[1:], strict=True)), row[0] * v[0]) for row in rows]


def rgb_to_lab(r, g, b, encoded: bool = True) -> tuple[Column, Column, Column]:
    lin = [to_linear(c) if encoded else lit(c) for c in (r, g, b)]
    xyz = [v / w for v, w in zip(matrix(RGB_TO_XYZ, lin), WHITE, strict=True)]
    fx, fy, fz = (F.when(t > 0.008856, F.cbrt(t)).otherwise(7.787 * t + 16.0 / 116.0) for t in xyz)
    return (116.0 * fy - 16.0) / 100.0, 500.0 * (fx - fy) / 128.0, 200.0 * (fy - fz) / 128.0


def lab_to_rgb(light, a, b, encoded: bool = True) -> tuple[Column, Column, Column]:
    fy = (light * 100.0 + 16.0) / 116.0
    fx, fz = fy + a * 128.0 / 500.0, fy - b * 128.0 / 200.0
    back = [F.when(t * t * t > 0.008856, t * t * t).otherwise((t - 16.0 / 116.0) / 7.787) * w for t, w in zip((fx, fy, fz), WHITE, strict=True)]
    return tuple(to_srgb(v) if encoded else v for v in matrix(XYZ_TO_RGB, back))


def rgb_to_ycbcr(r, g, b) -> tuple[Column, Column, Column]:
    y = luma(r, g, b)
    return y, (b - y) / 1.8556 + 0.5, (r - y) / 1.5748 + 0.5


def ycbcr_to_rgb(y, cb, cr) -> tuple[Column, Column, Column]:
    r, b = y + 1.5748 * (cr - 0.5), y + 1.8556 * (cb - 0.5)
    return r, (y - 0.2126 * r - 0.0722 * b) / 0.7152, b


def rgb_to_yuv(r, g, b) -> tuple[Column, Column, Column]:
    y = 0.299 * r + 0.587 * g + 0.114 * b
    return y, 0.492 * (b - y), 0.877 * (r - y)


def yuv_to_rgb(y, u, v) -> tuple[Column, Column, Column]:
    return y + 1.140 * v, y - 0.395 * u - 0.581 * v, y + 2.032 * u


def rgb_to_oklab(r, g, b) -> tuple[Column, ...]:
    return tuple(matrix(OKLAB, [F.cbrt(v) for v in matrix(OKLAB_CONES, [lit(r), lit(g), lit(b)])]))


def lookup(table: list[float], v) -> Column:
    """Linear interpolation in a table over 0..1."""
    last = len(table) - 1
    at = clamp01(v) * last
    i = F.least(F.floor(at), F.lit(last - 1)).cast("int")
    # One foldable literal; an array of literals costs a call to the JVM each.
    values = F.split(F.lit(",".join(map(repr, map(float, table)))), ",").cast("array<double>")
    low = F.element_at(values, i + 1)
    return low + (F.element_at(values, i + 2) - low) * (at - i)


def degrees(angle: float) -> tuple[float, float]:
    """Cosine and sine of an angle that turns clockwise."""
    a = -math.radians(angle)
    return math.cos(a), math.sin(a)
