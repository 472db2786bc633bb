"""Masks and keys: predicates over position or colour as planes of 0..1."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from planeweave.functions import maths as m
from planeweave.plans.registry import Call, choice, colour, flag, free, number, operator

WAYS = choice("Operation", "Add|Subtract|Multiply|Not")


def combined(way: int, base, v):
    return m.clamp01([lambda: F.greatest(base, v), lambda: base - v, lambda: base * v, lambda: F.greatest(base, 1.0 - v)][way]())


def _centre(call: Call):
    return F.col("x") + 0.5, F.col("y") + 0.5


def _shape(type_: str, width: float, height: float, feather: float, round_: bool):
    @operator(
        type_, "Mask plane, Value plane = Value", "Mask plane", number("X", 0.5, 0, 1), number("Y", 0.5, 0, 1), number("Width", width, 0, 2), number("Height", height, 0, 2),
        number("Rotation", 0, -180, 180), number("Feather", feather, 0, 1), number("Value", 1, 0, 1), WAYS,
    )
    def lower(call: Call):
        frame = call.frame
        (x, y), (ca, sa) = _centre(call), m.degrees(call["Rotation"])
        px, py = x - call["X"] * frame.w, y - call["Y"] * frame.h
        rx, ry = (px * ca - py * sa) / max(call["Width"] * frame.w / 2, 1e-3), (px * sa + py * ca) / max(call["Height"] * frame.h / 2, 1e-3)
        q = m.hypot(rx, ry) if round_ else F.greatest(F.abs(rx), F.abs(ry))
        inside = 1.0 - m.smoothstep(1.0 - call["Feather"], 1.0 + 1e-4, q)
        return frame.plane(combined(call["Operation"], call.plane("Mask", 0.0), call.driven("Value") * inside))


_shape("matte.box_mask", 0.5, 0.5, 0.0, False)
_shape("matte.ellipse_mask", 0.5, 0.5, 0.1, True)
_shape("matte.radial_gradient", 0.6, 0.6, 0.5, True)


@operator("matte.linear_gradient", "Mask plane, Value plane = Value", "Mask plane", free("Start X", 0.5), free("Start Y", 0.2), free("End X", 0.5), free("End Y", 0.6), number("Value", 1, 0, 1), WAYS)
def linear_gradient(call: Call):
    frame, (x, y) = call.frame, _centre(call)
    x0, y0 = call["Start X"] * frame.w, call["Start Y"] * frame.h
    dx, dy = call["End X"] * frame.w - x0, call["End Y"] * frame.h - y0
    t = ((x - x0) * dx + (y - y0) * dy) / max(dx * dx + dy * dy, 1e-6)
    fade = m.clamp01(t) if call.linear else m.smoothstep(0.0, 1.0, t)
    return frame.plane(combined(call["Operation"], call.plane("Mask", 0.0), call.driven("Value") * (1.0 - fade)))


def key(type_: str, *params, keyed: bool = False, invert=lambda call: False):
    """Registers f(call, rgb[, key rgb]) -> matte. The image comes out multiplied by the held matte."""

    def take(f):
        @operator(type_, "Image image" + (", Key image" if keyed else ""), "Matte plane, Image image", *params)
        def lower(call: Call):
            image = call.image()
            if image is None:
                return None
            against = ()
            if keyed:
                other = call.image("Key")
                against = (other.rgb if other else [F.lit(v) for v in call["Key Color"]],)
            matte = m.clamp01(f(call, image.rgb, *against))
            plane = image.frame.plane(1.0 - matte if invert(call) else matte)
            v = F.col(plane.v)
            return plane, image.frame.image(*(c * v for c in image.rgb), image.alpha * v)

        return f

    return take


@key("matte.channel_key", choice("Channel", "Red|Green|Blue|Hue|Saturation|Value|Y|Cb|Cr", 1), number("Low", 0.3, 0, 1), number("High", 0.7, 0, 1), flag("Invert", False), invert=lambda call: call["Invert"])
def channel_key(call, rgb):
    held, at = [m.clamp01(c) for c in rgb], call["Channel"]
    v = rgb[at] if at < 3 else (m.rgb_to_hsv(*held)[at - 3] if at < 6 else m.rgb_to_ycbcr(*held)[at - 6])
    return 1.0 - m.smoothstep(call["Low"], max(call["High"], call["Low"] + 1e-4), v)


@key("matte.luminance_key", number("Low", 0.2, 0, 1), number("High", 0.8, 0, 1), flag("Keep Bright", True), invert=lambda call: not call["Keep Bright"])
def luminance_key(call, rgb):
    return m.smoothstep(call["Low"], max(call["High"], call["Low"] + 1e-4), m.luma(*rgb))


KEYED = (colour("Key Color", 0.1, 0.8, 0.1), number("Tolerance", 0.1, 0, 1), number("Falloff", 0.1, 0, 1))


def _past(call, distance):
    return (distance - call["Tolerance"]) / max(call["Falloff"], 1e-4)


@key("matte.difference_key", *KEYED, keyed=True)
def difference_key(call, rgb, other):
    return _past(call, F.greatest(*(F.abs(a - b) for a, b in zip(rgb, other, strict=True))))


@key("matte.distance_key", *KEYED, choice("Space", "RGB|YCbCr"), keyed=True)
def distance_key(call, rgb, other):
    if call["Space"] == 1:
        a, b = m.rgb_to_ycbcr(*rgb), m.rgb_to_ycbcr(*other)
        return _past(call, m.hypot(a[1] - b[1], a[2] - b[2]) * 2.0)
    return _past(call, F.sqrt(sum(((a - b) * (a - b) for a, b in zip(rgb, other, strict=True)), F.lit(0.0))) / 1.732)


@key("matte.chroma_key", colour("Key Color", 0.1, 0.8, 0.1), number("Acceptance", 25, 1, 80), number("Falloff", 15, 0, 60), number("Min Saturation", 0.2, 0, 1), keyed=True)
def chroma_key(call, rgb, other):
    """The angle between chroma vectors; colours of little chroma stay."""
    (_, ax, ay), (_, bx, by) = m.rgb_to_ycbcr(*rgb), m.rgb_to_ycbcr(*other)
    ax, ay, bx, by = call.keep(*(v - 0.5 for v in (ax, ay, bx, by)))
    ma, mb = call.keep(m.hypot(ax, ay), m.hypot(bx, by))
    grey = (mb < 1e-5) | (ma < call["Min Saturation"] * mb)
    cosine = (ax * bx + ay * by) / F.when(grey | (ma * mb == 0), 1.0).otherwise(ma * mb)
    angle = F.acos(m.clamp(cosine, -1.0, 1.0)) * 180.0 / math.pi
    return F.when(grey, 1.0).otherwise((angle - call["Acceptance"]) / max(call["Falloff"], 1e-3))


@operator("matte.color_spill", "Image image, Factor plane = Factor", "Image image", number("Factor", 1, 0, 1), choice("Spill Channel", "Red|Green|Blue", 1), choice("Limit", "Single|Average", 1), number("Ratio", 1, 0.5, 1.5))
def color_spill(call: Call):
    image = call.image()
    rgb, c = image.rgb, call["Spill Channel"]
    p, q = rgb[(c + 1) % 3], rgb[(c + 2) % 3]
    spill = F.greatest(F.lit(0.0), rgb[c] - ((p + q) * 0.5 if call["Limit"] == 1 else p) * call["Ratio"])
    rgb[c] = rgb[c] - spill * call.driven("Factor")
    return image.frame.image(*rgb, image.alpha)


@operator("matte.double_edge_mask", "Inner Mask plane, Outer Mask plane", "Mask plane", reach=lambda call: None)
def double_edge_mask(call: Call):
    """1 inside the inner mask, 0 outside the outer one, between them by the two distances."""
    from .stencil import distance_to

    inner, outer = call.plane("Inner Mask"), call.plane("Outer Mask")
    if inner is None or outer is None:
        return None
    frame = call.frame
    a, b = frame.add(inner >= 0.5, outer < 0.5)
    to_inner, to_outside = distance_to(frame, F.col(a)), distance_to(frame, F.col(b))
    between = F.col(to_outside) / F.greatest(F.col(to_inner) + F.col(to_outside), F.lit(1e-4))
    return frame.plane(F.when(F.col(a), 1.0).when(F.col(b), 0.0).otherwise(between))


@operator(
    "matte.range_mask", "Image image, Mask plane", "Mask plane", choice("Mode", "Luminance|Color"), number("Low", 0, 0, 1), number("High", 1, 0, 1), number("Smoothness", 0.5, 0, 1),
    colour("Color", 0.5, 0.5, 0.5), number("Amount", 0.5, 0, 1), flag("Invert", False),
)
def range_mask(call: Call):
    """A band of Oklab lightness, or nearness to a colour with lightness counting half; times the base mask."""
    image = call.image()
    if image is None:
        return None
    light = lambda c: m.biggest(c, 0.0) if call.linear else m.to_linear(m.biggest(c, 0.0))
    L, a, b = call.keep(*m.rgb_to_oklab(*call.keep(*map(light, image.rgb))))  # noqa: N806
    if call["Mode"] == 0:
        lo, soft = call["Low"], call["Smoothness"] * 0.25 + 1e-4
        hi = max(call["High"], lo)
        v = m.smoothstep(lo - soft, lo, L) * (1.0 - m.smoothstep(hi, hi + soft, L))
    else:
        tl, ta, tb = m.rgb_to_oklab(*(light(F.lit(c)) for c in call["Color"]))
        far, dl = 0.02 + call["Amount"] * 0.23, (L - tl) * 0.5
        v = 1.0 - m.smoothstep(far * 0.5, far, F.sqrt(dl * dl + (a - ta) * (a - ta) + (b - tb) * (b - tb)))
    v = 1.0 - v if call["Invert"] else v
    return image.frame.plane(v * call.plane("Mask", 1.0))


#: What each selecting mask can select, with the default; all need a model of their own.
SELECTIONS = {
    "matte.select_subject": [choice("Model", "Accurate|Light")],
    "matte.select_people": [flag("Face Skin", True), *(flag(n, False) for n in ("Eyebrows", "Eyes", "Lips", "Mouth", "Hair", "Neck", "Clothes", "Accessories"))],
    "matte.select_landscape": [flag("Sky", False), flag("Water", True), *(flag(n, False) for n in ("Vegetation", "Mountains", "Natural Ground", "Architecture", "Artificial Ground"))],
    "matte.select_objects": [flag("People", True), *(flag(n, False) for n in ("Animals", "Vehicles", "Furniture", "Signs and Poles", "Lights", "Screens", "Potted Plants and Flowers"))],
    "matte.select_sky": [],
}


def _selecting(type_: str, own: list) -> None:
    @operator(type_, "Image image, Mask plane", "Mask plane", flag("Refine Edges", True), flag("Invert", False), *own, number("Feather", 0, 0, 100), number("Edge", 0, -100, 100), reach=lambda call: None)
    def lower(call: Call):
        """Without a model nothing is found: an empty mask of the image's size, which inverting makes full."""
        image = call.image()
        if image is None:
            return None
        found = F.lit(1.0 if call["Invert"] else 0.0)
        return image.frame.plane(found * m.clamp01(call.plane("Mask", 1.0)))


for _type, _own in SELECTIONS.items():
    _selecting(_type, _own)
