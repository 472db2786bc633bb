"""Scalar operators: maths, ranges, ramps, curves, expressions, colour tables and normalising."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from planeweave.functions import curves
from planeweave.functions import maths as m
from planeweave.functions.expression import compile_text, finite
from planeweave.plans.registry import Call, choice, flag, free, number, operator, shape, text
from planeweave.plans.values import Number, as_column

OPERATIONS = "Add|Subtract|Multiply|Divide|Power|Logarithm|Square Root|Absolute|Minimum|Maximum|Less Than|Greater Than|Modulo|Floor|Ceil|Round|Fract|Sine|Cosine|Snap|Ping-Pong"


def _where(condition, value):
    return F.when(condition, value).otherwise(0.0)


def _by(b):
    """A divisor that is never zero."""
    return F.when(F.abs(b) < 1e-9, 1.0).otherwise(b)


def _ping_pong(a, b):
    t = a / _by(b) - m.floor(a / _by(b) * 0.5) * 2.0
    return _where(F.abs(b) >= 1e-9, F.when(t > 1, 2.0 - t).otherwise(t) * b)


#: Undefined cases give 0 (Snap: a).
MATHS = {
    "Add": lambda a, b: a + b, "Subtract": lambda a, b: a - b, "Multiply": lambda a, b: a * b,
    "Divide": lambda a, b: _where(F.abs(b) >= 1e-9, a / _by(b)),
    "Power": lambda a, b: _where((a >= 0) | (b == m.floor(b)), F.pow(a, b)),
    "Logarithm": lambda a, b: _where((a > 0) & (b > 0) & (b != 1), F.ln(a) / F.when((b > 0) & (b != 1), F.ln(b)).otherwise(1.0)),
    "Square Root": lambda a, b: _where(a > 0, F.sqrt(m.biggest(a, 0.0))), "Absolute": lambda a, b: F.abs(a),
    "Minimum": m.smallest, "Maximum": m.biggest, "Less Than": lambda a, b: _where(a < b, 1.0), "Greater Than": lambda a, b: _where(a > b, 1.0),
    "Modulo": lambda a, b: _where(F.abs(b) >= 1e-9, a - b * m.floor(a / _by(b))),
    "Floor": lambda a, b: m.floor(a), "Ceil": lambda a, b: -m.floor(-a), "Round": lambda a, b: F.round(a), "Fract": lambda a, b: m.fract(a),
    "Sine": lambda a, b: F.sin(a), "Cosine": lambda a, b: F.cos(a),
    "Snap": lambda a, b: F.when(F.abs(b) < 1e-9, a).otherwise(m.floor(a / _by(b)) * b), "Ping-Pong": _ping_pong,
}


def _plane(call: Call, value, *pins: str):
    """A plane, or a number where every input is one."""
    if not call.constant():
        return call.frame.plane(value)
    return Number(call.context.session.spark.range(1).select(value.alias("v")).first()["v"])


@operator("conv.math", "A plane = A, B plane = B", "Value plane", free("A", 0.5), free("B", 0.5), choice("Operation", OPERATIONS), flag("Clamp", False))
def maths_(call: Call):
    v = MATHS[OPERATIONS.split("|")[call["Operation"]]](call.driven("A"), call.driven("B"))
    return _plane(call, m.clamp01(v) if call["Clamp"] else v)


@operator(
    "conv.map_range", "Value plane = Value, From Min plane = From Min, From Max plane = From Max, To Min plane = To Min, To Max plane = To Max", "Value plane",
    free("Value", 0.5), free("From Min", 0), free("From Max", 1), free("To Min", 0), free("To Max", 1), choice("Interpolation", "Linear|Smooth Step|Stepped (4)|Stepped (8)"), flag("Clamp", True),
)
def map_range(call: Call):
    v, a, b, c, d = (call.driven(n) for n in ("Value", "From Min", "From Max", "To Min", "To Max"))
    t = (v - a) / F.when(F.abs(b - a) < 1e-9, 1e-9).otherwise(b - a)
    t = call.keep(t)[0] if not call.constant() else t
    t = m.clamp01(t) if call["Clamp"] else t
    t = [lambda t: t, lambda t: m.smoothstep(0.0, 1.0, t), lambda t: m.floor(t * 4) / 4, lambda t: m.floor(t * 8) / 8][call["Interpolation"]](t)
    return _plane(call, c + t * (d - c))


@operator("conv.clamp", "Value plane = Value, Min plane = Min, Max plane = Max", "Value plane", free("Value", 0.5), free("Min", 0), free("Max", 1))
def clamp_(call: Call):
    v, lo, hi = (call.driven(n) for n in ("Value", "Min", "Max"))
    return _plane(call, m.clamp(v, F.least(lo, hi), F.greatest(lo, hi)))


@operator("conv.threshold", "Value plane = Value, Threshold plane = Threshold, Softness plane = Softness", "Mask plane", number("Value", 0.5, 0, 1), number("Threshold", 0.5, 0, 1), number("Softness", 0, 0, 0.5))
def threshold(call: Call):
    v, t, s = (call.driven(n) for n in ("Value", "Threshold", "Softness"))
    return _plane(call, m.smoothstep(t - s, t + s, v))


GREY = {"stops": [[0, 0, 0, 0, 1], [1, 1, 1, 1, 1]], "interp": 0}


@operator("conv.color_ramp", "Factor plane = Factor", "Image image, Alpha plane", number("Factor", 0.5, 0, 1), shape("Ramp", GREY))
def color_ramp(call: Call):
    told = call["Ramp"] if isinstance(call["Ramp"], dict) else GREY
    stops = [(min(max(s[0], 0), 1), tuple(min(max(v, 0), 1) for v in s[1:5])) for s in told.get("stops", []) if len(s) >= 5] or [(s[0], tuple(s[1:])) for s in GREY["stops"]]
    r, g, b, a = curves.ramp(stops, min(max(int(told.get("interp", 0)), 0), 3), call.driven("Factor"))
    frame = call.frame
    return frame.image(r, g, b, 1.0), frame.plane(a)


def band(v, lo: float, hi: float, soft: float):
    """1 between lo and hi, with soft edges outside."""
    return m.smoothstep(lo - soft, lo, v) * (1.0 - m.smoothstep(hi, hi + soft, v))


@operator(
    "conv.color_key", "Image image", "Mask plane, Image image", number("Hue", 120, 0, 360), number("Hue Range", 30, 0, 180), number("Sat Min", 0.15, 0, 1), number("Sat Max", 1, 0, 1),
    number("Value Min", 0.05, 0, 1), number("Value Max", 1, 0, 1), number("Softness", 0.1, 0, 0.5), flag("Invert", False),
)
def color_key(call: Call):
    image, soft, reach = call.image(), call["Softness"], call["Hue Range"] / 360.0
    h, s, v = (F.col(n) for n in image.frame.add(*m.rgb_to_hsv(*map(m.clamp01, image.rgb))))
    away = F.abs(h - call["Hue"] / 360.0)
    mask = band(s, call["Sat Min"], call["Sat Max"], soft) * band(v, call["Value Min"], call["Value Max"], soft)
    if reach < 0.5:
        mask = (1.0 - m.smoothstep(reach, reach + soft * 0.5, F.least(away, 1.0 - away))) * mask
    mask = 1.0 - mask if call["Invert"] else mask
    plane = image.frame.plane(mask)
    return plane, image.frame.image(*(c * F.col(plane.v) for c in image.rgb), image.alpha)


def _names(call: Call) -> dict:
    """What an expression can read; without an image rgb are 0 and a is 1."""
    frame, image = call.frame, call.image()
    rgba = [*image.rgb, image.alpha] if image else [F.lit(0.0)] * 3 + [F.lit(1.0)]
    x, y = F.col("x").cast("double"), F.col("y").cast("double")
    ins = {n.lower(): call.driven(n) for n in ("In1", "In2")}
    return dict(zip("rgba", rgba, strict=True)) | ins | {"x": x, "y": y, "u": (x + 0.5) / frame.w, "v": (y + 0.5) / frame.h, "w": F.lit(float(frame.w)), "h": F.lit(float(frame.h))}


INS = "Image image, In1 plane = In1, In2 plane = In2"


@operator("conv.expression", INS, "Value plane", text("Expression", "(r + g + b) / 3"), free("In1", 0), free("In2", 0))
def expression(call: Call):
    return call.frame.plane(compile_text(call["Expression"], _names(call)))


@operator("conv.image_expression", INS, "Image image", text("R", "r"), text("G", "g"), text("B", "b"), free("In1", 0), free("In2", 0))
def image_expression(call: Call):
    names = _names(call)
    return call.frame.image(*(compile_text(call[c], names) for c in "RGB"), names["a"])


@operator("conv.normalize", "Value plane", "Value plane", number("Low %", 0, 0, 100), number("High %", 100, 0, 100), reach=lambda call: None)
def normalize(call: Call):
    """Percentiles by exact rank become 0 and 1; each image of the frame by its own."""
    from .reduce import exact_ranks, rank_of

    value = call.inputs[0]
    if value is None or isinstance(value, Number):
        return value
    frame = value.frame
    plane = frame.plane(as_column(value, frame))
    lo, hi = sorted((call["Low %"], call["High %"]))
    stats = exact_ranks(frame.df, plane.v, {"lo": rank_of(lo / 100), "hi": rank_of(hi / 100)}, frame.w * frame.h)
    keys = {c: frame.name() for c in ("img", "lo", "hi")}
    frame.df = frame.df.join(stats.select(*[F.col(c).alias(n) for c, n in keys.items()]), F.col("img") == F.col(keys["img"])).drop(keys["img"])
    return frame.plane((F.col(plane.v) - F.col(keys["lo"])) / F.greatest(F.col(keys["hi"]) - F.col(keys["lo"]), F.lit(1e-9)))


@operator("conv.float_curve", "Value plane = Value, Factor plane = Factor", "Value plane", number("Value", 0.5, 0, 1), number("Factor", 1, 0, 1), shape("Curve", {"c": [[0, 0], [1, 1]]}))
def float_curve(call: Call):
    v = call.plane("Value")
    v = call.driven("Value") if v is None else v
    lut = curves.table((call["Curve"] or {}).get("c") if isinstance(call["Curve"], dict) else None)
    return _plane(call, m.mix(v, m.lookup(lut, v), call.driven("Factor")))


def _cie(nm: float) -> tuple[float, float, float]:
    """A sum of piecewise Gaussians for each colour-matching function."""
    g = lambda mu, below, above: math.exp(-0.5 * ((nm - mu) / (below if nm < mu else above)) ** 2)
    x = 1.056 * g(599.8, 37.9, 31.0) + 0.362 * g(442.0, 16.0, 26.7) - 0.065 * g(501.1, 20.4, 26.2)
    return x, 0.821 * g(568.8, 46.9, 40.5) + 0.286 * g(530.9, 16.3, 31.1), 1.217 * g(437.0, 11.8, 36.0) + 0.681 * g(459.0, 26.0, 13.8)


def _display(rgb) -> list[float]:
    return [c * 12.92 if c <= 0.0031308 else 1.055 * c ** (1 / 2.4) - 0.055 for c in rgb]


def wavelength_rgb(nm: float) -> list[float]:
    xyz = _cie(nm)
    return _display([min(max(sum(k * v for k, v in zip(row, xyz, strict=True)) / 1.6, 0.0), 1.0) for row in m.XYZ_TO_RGB])


def blackbody_rgb(kelvin: float) -> list[float]:
    total = [0.0, 0.0, 0.0]
    for nm in range(380, 781, 5):
        metre = nm * 1e-9
        radiance = 1.0 / (metre**5 * (math.exp(1.4388e-2 / (metre * kelvin)) - 1.0))
        total = [t + radiance * v for t, v in zip(total, _cie(nm), strict=True)]
    light = [total[0] / total[1], 1.0, total[2] / total[1]]
    rgb = [max(sum(k * v for k, v in zip(row, light, strict=True)), 0.0) for row in m.XYZ_TO_RGB]
    return _display([c / max(*rgb, 1e-6) for c in rgb])


def _coloured(call: Call, tables: list[list[float]], t):
    (t,) = call.keep(t)
    rgb = [m.lookup(lut, t) for lut in zip(*tables, strict=True)]
    return call.frame.image(*(map(m.to_linear, rgb) if call.linear else rgb), 1.0)


@operator("conv.wavelength", "Wavelength plane = Wavelength", "Color image", number("Wavelength", 550, 360, 830))
def wavelength(call: Call):
    return _coloured(call, [wavelength_rgb(360.0 + i) for i in range(471)], (call.driven("Wavelength") - 360.0) / 470.0)


@operator("conv.blackbody", "Temperature plane = Temperature", "Color image", number("Temperature", 3200, 800, 12000))
def blackbody(call: Call):
    kelvin = F.greatest(call.driven("Temperature"), F.lit(800.0))
    return _coloured(call, [blackbody_rgb(800.0 * 50.0 ** (i / 255.0)) for i in range(256)], F.ln(kelvin / 800.0) / math.log(50.0))


__all__ = ["band", "finite"]
