"""Colour spaces that pictures are exported in: matrices from primaries, curves, and the gamut rule."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import maths as m

#: Chromaticities of red, green, blue and white by the spaces' standards.
PRIMARIES = {
    "sRGB": ((0.64, 0.33), (0.30, 0.60), (0.15, 0.06), (0.3127, 0.3290)),
    "Display P3": ((0.680, 0.320), (0.265, 0.690), (0.150, 0.060), (0.3127, 0.3290)),
    "Adobe RGB (1998)": ((0.64, 0.33), (0.21, 0.71), (0.15, 0.06), (0.3127, 0.3290)),
    "ProPhoto RGB": ((0.7347, 0.2653), (0.1596, 0.8404), (0.0366, 0.0001), (0.3457, 0.3585)),
    "Rec.2020": ((0.708, 0.292), (0.170, 0.797), (0.131, 0.046), (0.3127, 0.3290)),
    "Rec.2100 PQ": ((0.708, 0.292), (0.170, 0.797), (0.131, 0.046), (0.3127, 0.3290)),
}
#: The Bradford cones; the curves' constants of Rec.2020; those of PQ, its peak and reference white in nits.
BRADFORD = np.array([[0.8951, 0.2664, -0.1614], [-0.7502, 1.7135, 0.0367], [0.0389, -0.0685, 1.0296]])
REC_ALPHA, REC_BETA = 1.09929682680944, 0.018053968510807
PQ_M1, PQ_M2, PQ_C1, PQ_C2, PQ_C3, PQ_PEAK, PQ_WHITE = 2610 / 16384, 2523 / 4096 * 128, 3424 / 4096, 2413 / 4096 * 32, 2392 / 4096 * 32, 10000.0, 203.0


def _white(space: str) -> np.ndarray:
    x, y = PRIMARIES[space][3]
    return np.array([x / y, 1.0, (1 - x - y) / y])


def to_xyz(space: str) -> np.ndarray:
    """From linear colours of the space to XYZ: its primaries, scaled so that they make its white."""
    columns = np.array([[x / y, 1.0, (1 - x - y) / y] for x, y in PRIMARIES[space][:3]]).T
    return columns * np.linalg.solve(columns, _white(space))


def from_srgb(space: str) -> np.ndarray:
    """From linear sRGB to linear colours of the space; another white is adapted to by Bradford's cones."""
    cones = np.diag((BRADFORD @ _white(space)) / (BRADFORD @ _white("sRGB")))
    return np.linalg.inv(to_xyz(space)) @ np.linalg.inv(BRADFORD) @ cones @ BRADFORD @ to_xyz("sRGB")


def encoded(space: str, v: Column) -> Column:
    """The space's curve over linear values within its gamut."""
    if space == "Adobe RGB (1998)":
        return F.pow(v, F.lit(256 / 563))
    if space == "ProPhoto RGB":
        return F.when(v < 1 / 512, 16 * v).otherwise(F.pow(v, F.lit(1 / 1.8)))
    if space == "Rec.2020":
        return F.when(v < REC_BETA, 4.5 * v).otherwise(REC_ALPHA * F.pow(v, F.lit(0.45)) - (REC_ALPHA - 1))
    if space == "Rec.2100 PQ":
        y = F.pow(v * (PQ_WHITE / PQ_PEAK), F.lit(PQ_M1))
        return F.pow((PQ_C1 + PQ_C2 * y) / (1.0 + PQ_C3 * y), F.lit(PQ_M2))
    return m.to_srgb(v)


def shown_in(space: str, rgb: list[Column], linear: bool = True) -> list[Column]:
    """Colours of a scene, or display-encoded ones, as the space's file holds them.

    Values that sRGB would clip are kept where the space holds them and clipped to its own gamut; PQ
    keeps light above white up to its peak.
    """
    light = [F.nanvl(c, F.lit(0.0)) if linear else m.to_linear(F.nanvl(c, F.lit(0.0))) for c in rgb]
    most = PQ_PEAK / PQ_WHITE if space == "Rec.2100 PQ" else 1.0
    moved = light if space == "sRGB" else m.matrix(from_srgb(space).tolist(), light)
    return [encoded(space, m.clamp(c, 0.0, most)) for c in moved]
