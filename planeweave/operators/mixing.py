"""Zips of images: mixing, blending, layers and compositing, all as columns of one frame."""

from __future__ import annotations

from pyspark.sql import functions as F

from planeweave.functions import maths as m
from planeweave.plans.registry import REGISTRY, Call, Param, Pin, Spec, choice, flag, number, operator

MODES = "Mix|Darken|Multiply|Color Burn|Lighten|Screen|Color Dodge|Add|Overlay|Soft Light|Linear Light|Difference|Exclusion|Subtract|Divide|Hue|Saturation|Color|Value"


def _over(top, under):
    """top / under where under is positive."""
    return top / F.when(under > 0, under).otherwise(1.0)


CHANNEL = {
    "Mix": lambda a, b: b,
    "Darken": m.smallest,
    "Multiply": lambda a, b: a * b,
    "Color Burn": lambda a, b: F.when(b <= 0, 0.0).otherwise(1.0 - m.smallest(1.0, _over(1.0 - a, b))),
    "Lighten": m.biggest,
    "Screen": lambda a, b: 1.0 - (1.0 - a) * (1.0 - b),
    "Color Dodge": lambda a, b: F.when(b >= 1, 1.0).otherwise(m.smallest(1.0, _over(a, 1.0 - b))),
    "Add": lambda a, b: a + b,
    "Overlay": lambda a, b: F.when(a < 0.5, 2.0 * a * b).otherwise(1.0 - 2.0 * (1.0 - a) * (1.0 - b)),
    "Soft Light": lambda a, b: (1.0 - 2.0 * b) * a * a + 2.0 * b * a,
    "Linear Light": lambda a, b: a + 2.0 * b - 1.0,
    "Difference": lambda a, b: F.abs(a - b),
    "Exclusion": lambda a, b: a + b - 2.0 * a * b,
    "Subtract": lambda a, b: a - b,
    "Divide": lambda a, b: F.when(b <= 1e-6, a).otherwise(a / F.when(b <= 1e-6, 1.0).otherwise(b)),
}
#: Which of hue, saturation and value come from B.
SWAPS = {"Hue": (1, 0, 0), "Saturation": (0, 1, 0), "Color": (1, 1, 0), "Value": (0, 0, 1)}


def blended(mode: str, a, b, linear: bool, frame=None):
    """Three channels of B blended over A. Hue, saturation and value become columns first, if a frame is given."""
    if mode not in SWAPS:
        return [CHANNEL[mode](p, q) for p, q in zip(a, b, strict=True)]
    hsv = [m.rgb_to_hsv(*(m.clamp_colour(c, linear) for c in side)) for side in (a, b)]
    picked = [hsv[take][k] for k, take in enumerate(SWAPS[mode])]
    if frame is not None:
        picked = [F.col(n) for n in frame.add(*picked)]
    return list(m.hsv_to_rgb(*picked))


@operator("math.mix", "A image, B image, Factor plane = Factor", "Image image", number("Factor", 0.5, 0, 1))
def mix(call: Call):
    a, b = call.image("A"), call.image("B")
    if a is None or b is None:
        return a or b
    f = call.driven("Factor")
    return a.frame.image(*(m.clamp_colour(m.mix(p, q, f), call.linear) for p, q in zip(a.rgb, b.rgb, strict=True)), m.clamp01(m.mix(a.alpha, b.alpha, f)))


@operator("math.blend", "A image, B image, Factor plane = Factor", "Image image", number("Factor", 1, 0, 1), choice("Mode", MODES, 2), flag("Clamp", True))
def blend(call: Call):
    a, b = call.image("A"), call.image("B")
    if a is None or b is None:
        return a or b
    f = call.driven("Factor") * b.alpha
    out = [m.mix(p, q, f) for p, q in zip(a.rgb, blended(MODES.split("|")[call["Mode"]], a.rgb, b.rgb, call.linear, a.frame), strict=True)]
    return a.frame.image(*(map(m.clamp01, out) if call["Clamp"] else out), a.alpha)


LAYERS = 32


def _stack(call: Call):
    """Layers from the bottom up; each lies over what is below with its alpha times its opacity."""
    acc = None
    for i in range(LAYERS):
        image = call.image(f"Layer {i + 1}")
        if image is None:
            continue
        frame = image.frame
        a = m.clamp01(image.alpha * call.driven(f"Opacity {i + 1}"))
        if acc is None:
            acc = [*image.rgb, a]
        else:
            mode = MODES.split("|")[call[f"Mode {i + 1}"]]
            below = m.clamp01(acc[3])
            over = [m.mix(c, q, below) for c, q in zip(image.rgb, blended(mode, acc[:3], image.rgb, call.linear, frame), strict=True)]
            acc = [*(m.mix(p, q, a) for p, q in zip(acc[:3], over, strict=True)), a + acc[3] * (1.0 - a)]
        # One projection per layer keeps expressions small.
        acc = [F.col(n) for n in frame.add(*acc)]
    return frame.image(*(m.clamp_colour(c, call.linear) for c in acc[:3]), m.clamp01(acc[3])) if acc else None


REGISTRY["math.layer_stack"] = Spec(
    "math.layer_stack",
    tuple(p for i in range(1, LAYERS + 1) for p in (Pin(f"Layer {i}", "image"), Pin(f"Opacity {i}", "plane", f"Opacity {i}"))),
    (Pin("Image", "image"),),
    tuple(p for i in range(1, LAYERS + 1) for p in (number(f"Opacity {i}", 1, 0, 1), Param(f"Mode {i}", "enum", 0, options=tuple(MODES.split("|"))))),
    _stack,
)


@operator("math.alpha_over", "Background image, Foreground image, Factor plane = Factor", "Image image", number("Factor", 1, 0, 1), flag("Premultiplied", False))
def alpha_over(call: Call):
    under, over = call.image("Background"), call.image("Foreground")
    if under is None or over is None:
        return under or over
    f = call.driven("Factor")
    a = m.clamp01(over.alpha * f)
    share = f if call["Premultiplied"] else a
    return under.frame.image(*(q * share + p * (1.0 - a) for p, q in zip(under.rgb, over.rgb, strict=True)), m.clamp01(a + under.alpha * (1.0 - a)))
