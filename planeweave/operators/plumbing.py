"""Sources, sinks, splitting, combining and other column plumbing: no operator here moves a row."""

from __future__ import annotations

from pyspark.sql import functions as F

from planeweave.functions import maths as m
from planeweave.plans.registry import Call, choice, flag, number, operator, text
from planeweave.plans.values import Number, Plane


@operator("io.image_input", "", "Image image", text("File"), choice("Color Space", "sRGB|Linear|Non-Color"))
def image_input(call: Call):
    """The session's source of that name (the first, if none is named), decoded to the graph's light."""
    sources = call.context.session.sources
    source = sources.get(call["File"]) if call["File"] else next(iter(sources.values()), None)
    if source is None:
        return None
    space, frame = call["Color Space"], source.frame
    if space == 0 and call.linear:
        return frame.image(*map(m.to_linear, source.rgb), source.alpha)
    if space == 1 and not call.linear:
        return frame.image(*(m.clamp01(m.to_srgb(c)) for c in source.rgb), source.alpha)
    return source


@operator("io.output", "Image image", "Image image")
def output(call: Call):
    return call.image()


@operator("io.number", "", "Value number", number("Value", 1, -10, 10))
def constant(call: Call):
    return Number(call["Value"])


@operator("util.file_output", "Image image", "Image image", text("File"), choice("Format", "Parquet|PNG"))
def file_output(call: Call):
    """Notes a further sink; written only on export."""
    image = call.image()
    if image is not None and call["File"]:
        call.context.session.sinks.append((call["File"], call["Format"], image))
    return image


@operator("util.reroute", "Value image", "Value image")
def reroute(call: Call):
    return call.inputs[0]


@operator("util.switch", "Off image, On image", "Image image", flag("On", False))
def switch(call: Call):
    return call.inputs[1 if call["On"] else 0]


@operator("util.image_info", "Image image", "Width number, Height number, Aspect number")
def image_info(call: Call):
    w, h = call.frame.w, call.frame.h
    return Number(w), Number(h), Number(w / h)


def split(type_: str, names: str, convert):
    @operator(type_, "Image image", ", ".join(f"{n} plane" for n in [*names.split(), "A"]))
    def lower(call: Call):
        image = call.image()
        if image is None:
            return None
        rgb = image.rgb if convert is None else convert(*call.keep(*(m.clamp_colour(c, call.linear) for c in image.rgb)))
        found = image.frame.add(*rgb)
        return tuple(Plane(image.frame, n) for n in [*found, image.a])


def combine(type_: str, pins: list[tuple[str, float, float, float]], convert, held: bool):
    told = [*pins, ("A", 1.0, 0.0, 1.0)]

    @operator(type_, ", ".join(f"{n} plane = {n}" for n, *_ in told), "Image image", *[number(n, d, lo, hi) for n, d, lo, hi in told])
    def lower(call: Call):
        frame = call.frame
        a, b, c, alpha = (call.driven(n) for n, *_ in told)
        rgb = convert(*call.keep(a, b, c)) if convert else (a, b, c)
        return frame.image(*(m.clamp01(v) if held else v for v in rgb), m.clamp01(alpha))


UNIT = (0.0, 1.0)
split("color.split_rgb", "R G B", None)
split("color.split_hsv", "H S V", m.rgb_to_hsv)
split("color.split_lab", "L a b", m.rgb_to_lab)
split("color.split_ycbcr", "Y Cb Cr", m.rgb_to_ycbcr)
split("color.split_yuv", "Y U V", m.rgb_to_yuv)
split("color.split_hsl", "H S L", m.rgb_to_hsl)
combine("color.combine_rgb", [(n, 0.0, *UNIT) for n in "RGB"], None, False)
combine("color.combine_hsv", [("H", 0.0, *UNIT), ("S", 0.0, *UNIT), ("V", 0.0, *UNIT)], m.hsv_to_rgb, True)
combine("color.combine_lab", [("L", 0.5, *UNIT), ("a", 0.0, -1.0, 1.0), ("b", 0.0, -1.0, 1.0)], m.lab_to_rgb, True)
combine("color.combine_ycbcr", [("Y", 0.5, *UNIT), ("Cb", 0.5, *UNIT), ("Cr", 0.5, *UNIT)], m.ycbcr_to_rgb, True)
combine("color.combine_yuv", [("Y", 0.5, *UNIT), ("U", 0.0, -0.5, 0.5), ("V", 0.0, -0.7, 0.7)], m.yuv_to_rgb, True)
combine("color.combine_hsl", [("H", 0.0, *UNIT), ("S", 0.0, *UNIT), ("L", 0.5, *UNIT)], m.hsl_to_rgb, True)


@operator("conv.set_alpha", "Image image, Alpha plane = Alpha", "Image image", number("Alpha", 1, 0, 1), choice("Mode", "Replace Alpha|Apply Mask"))
def set_alpha(call: Call):
    image, alpha = call.image(), call.driven("Alpha")
    if call["Mode"] == 1:
        return image.frame.image(*(c * alpha for c in image.rgb), image.alpha * alpha)
    return image.frame.image(*image.rgb, alpha)


@operator("util.split", "A image, B image", "Image image", number("Position", 0.5, 0, 1), choice("Orientation", "Vertical line|Horizontal line"), flag("Show Line", True))
def compare(call: Call):
    """A before the cut, B behind it, and a white line at it."""
    a, b = call.image("A"), call.image("B")
    if a is None or b is None:
        return a or b
    frame, upright = a.frame, call["Orientation"] == 0
    cut = int(call["Position"] * (frame.w if upright else frame.h))
    at = F.col("x" if upright else "y")
    picked = [F.when(at < cut, F.col(p)).otherwise(F.col(q)) for p, q in zip(a.names, b.names, strict=True)]
    if call["Show Line"]:
        picked[:3] = [F.when(at == cut, 1.0).otherwise(c) for c in picked[:3]]
    return frame.image(*picked)
