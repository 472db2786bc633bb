"""Colour adjustments: point operators that keep alpha."""

from __future__ import annotations

from pyspark.sql import functions as F

from planeweave.functions import curves
from planeweave.functions import maths as m
from planeweave.plans.registry import Call, choice, colour, number, operator, shape


def adjustment(type_: str, *params, pins: str = ""):
    """Registers f(call, r, g, b) -> three columns as an image operator."""

    def take(f):
        @operator(type_, "Image image" + (", " + ", ".join(f"{p.strip()} plane = {p.strip()}" for p in pins.split(",")) if pins else ""), "Image image", *params)
        def lower(call: Call):
            image = call.image()
            return None if image is None else image.frame.image(*f(call, *image.rgb), image.alpha)

        return f

    return take


def _held(call, *rgb):
    return [m.clamp_colour(c, call.linear) for c in rgb]


@operator("color.luminance", "Image image", "Value plane", choice("Method", "Rec.709 luma|Average|Max (HSV value)|Lab lightness"))
def luminance(call: Call):
    image = call.image()
    if image is None:
        return None
    rgb = image.rgb
    ways = [lambda: m.luma(*rgb), lambda: sum(rgb[1:], rgb[0]) / 3.0, lambda: F.greatest(*rgb), lambda: m.rgb_to_lab(*_held(call, *rgb), encoded=not call.linear)[0]]
    return image.frame.plane(ways[call["Method"]]())


@adjustment("color.brightness_contrast", number("Brightness", 0, -1, 1), number("Contrast", 0, -1, 1), pins="Brightness, Contrast")
def brightness_contrast(call, *rgb):
    c = m.smallest(call.driven("Contrast"), 0.999)
    slope, b = (1.0 + c) / (1.0 - c), call.driven("Brightness")
    if call.linear:
        return _held(call, *(0.18 * F.pow(m.biggest(s, 0.0) / 0.18, slope) + b for s in rgb))
    return _held(call, *((s - 0.5) * slope + 0.5 + b for s in rgb))


@adjustment("color.saturation", number("Amount", 1, 0, 4), pins="Amount")
def saturation(call, *rgb):
    grey, a = m.luma(*rgb), call.driven("Amount")
    return _held(call, *(grey + (s - grey) * a for s in rgb))


@adjustment("color.hue_shift", number("Degrees", 0, -180, 180), pins="Degrees")
def hue_shift(call, *rgb):
    h, s, v = m.rgb_to_hsv(*_held(call, *rgb))
    return m.hsv_to_rgb(*call.keep(h + call.driven("Degrees") / 360.0, s, v))


@adjustment("color.gamma", number("Gamma", 1, 0.1, 5), pins="Gamma")
def gamma(call, *rgb):
    return [F.pow(c, 1.0 / call.driven("Gamma")) for c in _held(call, *rgb)]


@adjustment("color.exposure", number("Stops", 0, -5, 5), pins="Stops")
def exposure(call, *rgb):
    gain = F.pow(F.lit(2.0), call.driven("Stops"))
    return [s * gain for s in rgb] if call.linear else [m.clamp01(m.to_srgb(m.to_linear(m.clamp01(s)) * gain)) for s in rgb]


@adjustment("color.invert", number("Factor", 1, 0, 1), pins="Factor")
def invert(call, *rgb):
    return [m.mix(v, 1.0 - v, call.driven("Factor")) for v in map(m.clamp01, rgb)]


@adjustment(
    "color.levels", number("In Black", 0, 0, 1), number("In White", 1, 0, 1), number("Gamma", 1, 0.1, 5), number("Out Black", 0, 0, 1), number("Out White", 1, 0, 1), choice("Channel", "RGB|Red|Green|Blue"),
    pins="In Black, In White, Gamma, Out Black, Out White",
)
def levels(call, *rgb):
    ib, iw, g, ob, ow = (call.driven(n) for n in ("In Black", "In White", "Gamma", "Out Black", "Out White"))
    moved = [F.pow(m.clamp_colour((c - ib) / m.biggest(iw - ib, 1e-4), call.linear), 1.0 / g) for c in rgb]
    moved = _held(call, *(ob + v * (ow - ob) for v in moved))
    return [v if call["Channel"] in (0, k + 1) else c for k, (c, v) in enumerate(zip(rgb, moved, strict=True))]


def _tables(told, keys):
    return [curves.table(told.get(k) if isinstance(told, dict) else None) for k in keys]


@adjustment("color.curves", number("Factor", 1, 0, 1), shape("Curves", {}), pins="Factor")
def curves_(call, *rgb):
    master, *each = _tables(call["Curves"], ("master", "r", "g", "b"))
    bent = call.keep(*(m.lookup(lut, s) for s, lut in zip(rgb, each, strict=True)))
    return [m.mix(s, m.lookup(master, v), call.driven("Factor")) for s, v in zip(rgb, bent, strict=True)]


FLAT = [[i / 6, 0.5] for i in range(7)]


@adjustment("color.hue_correct", number("Factor", 1, 0, 1), shape("Hue Curves", {"h": FLAT, "s": FLAT, "v": FLAT}), pins="Factor")
def hue_correct(call, *rgb):
    h, s, v = call.keep(*m.rgb_to_hsv(*_held(call, *rgb)))
    lh, ls, lv = _tables(call["Hue Curves"], "hsv")
    new = m.hsv_to_rgb(*call.keep(h + (m.lookup(lh, h) - 0.5), m.clamp01(s * m.lookup(ls, h) * 2.0), m.clamp_colour(v * m.lookup(lv, h) * 2.0, call.linear)))
    return [m.mix(a, b, call.driven("Factor")) for a, b in zip(rgb, new, strict=True)]


@adjustment(
    "color.color_balance", number("Factor", 1, 0, 1), choice("Mode", "Lift / Gamma / Gain|Offset / Power / Slope"), colour("Lift", 1, 1, 1, hi=2), colour("Gamma", 1, 1, 1, hi=2), colour("Gain", 1, 1, 1, hi=2),
    colour("Offset", 0, 0, 0), colour("Power", 1, 1, 1, hi=2), colour("Slope", 1, 1, 1, hi=2), pins="Factor",
)
def color_balance(call, *rgb):
    out = []
    for k, c in enumerate(_held(call, *rgb)):
        p = {n: call[n][k] for n in ("Lift", "Gamma", "Gain", "Offset", "Power", "Slope")}
        if call["Mode"] == 1:
            v = F.pow(m.biggest(c * p["Slope"] + p["Offset"], 0.0), F.lit(p["Power"]))
        else:
            v = F.pow(m.biggest(((c - 1.0) * (2.0 - p["Lift"]) + 1.0) * p["Gain"], 0.0), F.lit(1.0 / max(p["Gamma"], 1e-3)))
        out.append(m.clamp_colour(m.mix(c, v, call.driven("Factor")), call.linear))
    return out


@adjustment("color.tone_map", number("Exposure", 0, -4, 4), number("White Point", 2, 1, 16), choice("Operator", "Reinhard|Filmic (ACES fit)"))
def tone_map(call, *rgb):
    out, white = [], call["White Point"]
    for c in rgb:
        x = m.biggest(c, 0.0)
        x = (x if call.linear else m.to_linear(x)) * 2.0 ** call["Exposure"]
        v = x * (1.0 + x / white**2) / (1.0 + x) if call["Operator"] == 0 else (x * (2.51 * x + 0.03)) / (x * (2.43 * x + 0.59) + 0.14)
        out.append(m.clamp01(v) if call.linear else m.clamp01(m.to_srgb(m.clamp01(v))))
    return out


@adjustment("color.convert_colorspace", choice("Conversion", "sRGB -> Linear|Linear -> sRGB|sRGB -> Gamma 2.2|Gamma 2.2 -> sRGB"))
def convert_colorspace(call, *rgb):
    ways = [m.to_linear, m.to_srgb, lambda c: F.pow(m.to_linear(c), F.lit(1 / 2.2)), lambda c: m.to_srgb(F.pow(c, F.lit(2.2)))]
    return [ways[call["Conversion"]](m.biggest(c, 0.0)) for c in rgb]


@adjustment(
    "color.film_negative", choice("Type", "Color|Black & White"), colour("Film Base Color", 0.75, 0.35, 0.15), number("D Max", 1.6, 0.3, 4), number("Scan Offset", 0, -0.5, 0.5),
    colour("Density Correction", 1, 1, 1, hi=2), number("Contrast", 1.7, 0.5, 4), number("Print Exposure", 0, -4, 4), number("Black", 0, -0.1, 0.5),
)
def film_negative(call, *rgb):
    """Densities of the negative become the print's light."""
    light = lambda v: v / 12.92 if v <= 0.04045 else ((v + 0.055) / 1.055) ** 2.4
    base = [max(v if call.linear else light(v), 1e-6) for v in call["Film Base Color"]]
    through = [c if call.linear else m.to_linear(m.clamp01(c)) for c in rgb]
    dens = [F.log10(F.lit(b) / m.biggest(t, 1e-6)) * k for b, t, k in zip(base, through, call["Density Correction"], strict=True)]
    dens = [m.luma(*dens)] * 3 if call["Type"] == 1 else dens
    black = min(call["Black"], 0.9)
    printed = [(2.0 ** call["Print Exposure"] * F.pow(F.lit(10.0), (d + call["Scan Offset"] - call["D Max"]) * call["Contrast"]) - black) / (1.0 - black) for d in dens]
    return [m.biggest(v, 0.0) if call.linear else m.clamp01(m.to_srgb(m.biggest(v, 0.0))) for v in printed]


@adjustment("filter.posterize", number("Steps", 6, 2, 64), pins="Steps")
def posterize(call, *rgb):
    n = m.biggest(F.round(call.driven("Steps")), 2.0) - 1.0
    return [F.round(m.clamp01(c) * n) / n for c in rgb]


#: Linear Rec.709 to Rec.2020 and back, and the matrices into and out of the AgX working space.
TO_2020 = ((0.6274039, 0.3292830, 0.0433131), (0.0690973, 0.9195404, 0.0113623), (0.0163914, 0.0880133, 0.8955953))
TO_709 = ((1.6604910, -0.5876411, -0.0728499), (-0.1245505, 1.1328999, -0.0083494), (-0.0181508, -0.1005789, 1.1187297))
AGX_IN = ((0.8566271533, 0.0951212405, 0.0482516061), (0.1373189729, 0.7612419906, 0.1014390365), (0.1118982130, 0.0767994186, 0.8113023684))
AGX_OUT = ((1.1271005818, -0.1106066431, -0.0164939387), (-0.1413297635, 1.1578237022, -0.0164939387), (-0.1413297635, -0.1106066431, 1.2519364066))
AGX_EV = (-12.47393, 4.026069)
AGX_CURVE = (15.5, -40.14, 31.96, -6.868, 0.4298, 0.1191, -0.00232)


def view_transform(rgb, view: str = "Standard", exposure: float = 0.0, gamma: float = 1.0):
    """Scene-linear light as a display shows it: Standard, Raw or AgX."""
    rgb = [c * 2.0**exposure for c in rgb]
    if view == "AgX":
        lo, hi = AGX_EV
        inset = m.matrix(AGX_IN, m.matrix(TO_2020, rgb))
        t = [m.clamp01((F.log2(m.biggest(c, 1e-10)) - lo) / (hi - lo)) for c in inset]
        toned = []
        for x in t:
            v = F.lit(0.0)
            for k in AGX_CURVE:
                v = v * x + k
            toned.append(v)
        out = [F.pow(m.biggest(c, 0.0), F.lit(2.2)) for c in m.matrix(AGX_OUT, toned)]
        rgb = [m.clamp01(m.to_srgb(m.clamp01(c))) for c in m.matrix(TO_709, out)]
    else:
        rgb = [m.to_srgb(m.clamp01(c)) if view == "Standard" else m.clamp01(c) for c in rgb]
    return rgb if gamma == 1.0 else [F.pow(m.biggest(c, 0.0), F.lit(1.0 / gamma)) for c in rgb]
