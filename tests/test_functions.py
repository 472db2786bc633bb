import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from planeweave.functions import curves
from planeweave.functions import maths as m
from planeweave.functions.expression import ExpressionError, compile_text
from planeweave.functions.noise import cell_hashes, hash32_value
from planeweave.sources.tables import decode_png, encode_png, png_pixels


def value(spark, text, **names):
    return spark.range(1).select(compile_text(text, {k: F.lit(float(v)) for k, v in names.items()}).alias("v")).first()["v"]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("1 + 2 * 3", 7), ("(1 + 2) * 3", 9), ("2 ^ 3", 8), ("7 % 4", 3), ("-7 % 4", -3), ("sin pi", 0), ("max(r, b) * 2 + clamp(g, 0, .1)", 1.3), ("1, 2, 3", 3), ("!!5", 1), ("-!0", -1), ("3 >= 3 && 2 != 1", 1),
        ("1 / 0", 0), ("ln(-1)", 0), ("sqrt(-1)", 0), ("acos(2)", 0), ("fac 5", 120), ("ncr(5, 2)", 10), ("npr(5, 2)", 20), ("1e3 + .5", 1000.5), ("smoothstep(0, 1, .5)", 0.5), ("mix(2, 4, .25)", 2.5), ("step(.5, .5)", 1),
    ],
)
def test_expressions(spark, text, want):
    assert value(spark, text, r=0.2, g=0.4, b=0.6) == pytest.approx(want, abs=1e-12)


@pytest.mark.parametrize("text", ["1 +", "(1", "foo", "max(1)", "1 $ 2", "1 2", ""])
def test_expression_errors_name_the_place(text):
    with pytest.raises(ExpressionError, match="character"):
        compile_text(text, {})


def test_colour_round_trips(spark):
    g = np.random.default_rng(1)
    df = spark.createDataFrame([tuple(map(float, v)) for v in g.random((60, 3))], "r double, g double, b double")
    rgb = [F.col(c) for c in "rgb"]
    for there, back in ((m.rgb_to_hsv, m.hsv_to_rgb), (m.rgb_to_hsl, m.hsl_to_rgb), (m.rgb_to_lab, m.lab_to_rgb), (m.rgb_to_ycbcr, m.ycbcr_to_rgb)):
        out = df.select("r", "g", "b", *[c.alias(f"o{k}") for k, c in enumerate(back(*there(*rgb)))]).collect()
        assert all(abs(row[k] - row[k + 3]) < 2e-3 for row in out for k in range(3)), there


def test_curves_are_monotone_and_pass_through_their_points():
    f = curves.monotone([(0, 0), (0.3, 0.6), (0.5, 0.61), (1, 1)])
    assert [round(f(x), 9) for x in (0, 0.3, 0.5, 1)] == [0, 0.6, 0.61, 1]
    steps = [f(i / 500) for i in range(501)]
    assert all(b >= a - 1e-12 for a, b in zip(steps, steps[1:], strict=False))
    assert curves.table(None)[512] == pytest.approx(512 / 1023)


def test_cell_hashes_are_32_bit_arithmetic(spark):
    def want(x, y, seed):
        mask = 0xFFFFFFFF
        inner = hash32_value((y & mask) * 0x85EBCA77 & mask ^ hash32_value(seed))
        return hash32_value((x & mask) * 0x9E3779B1 & mask ^ inner)

    cells = [(x, y) for x in (-70000, -1, 0, 3, 123456) for y in (-2, 0, 99999)]
    df = spark.createDataFrame([(float(x), float(y)) for x, y in cells], "x double, y double")
    held = {"df": df, "n": 0}

    def keep(*columns):
        names = [f"k{held['n'] + i}" for i in range(len(columns))]
        held["n"] += len(columns)
        held["df"] = held["df"].withColumns(dict(zip(names, columns, strict=True)))
        return [F.col(n) for n in names]

    (h,) = cell_hashes(keep, [(F.col("x"), F.col("y"), 42)])
    assert {(r.x, r.y): r.h for r in held["df"].select("x", "y", h.alias("h")).collect()} == {(x, y): want(x, y, 42) for x, y in cells}


def test_png_files_round_trip_and_broken_ones_are_left_out(spark, tmp_path):
    pixels = np.random.default_rng(2).integers(0, 256, (5, 7, 4)) / 255
    (tmp_path / "a.png").write_bytes(encode_png(pixels))
    (tmp_path / "b.png").write_bytes(encode_png(pixels)[:40])
    assert np.abs(decode_png(encode_png(pixels)) - pixels).max() < 1e-9
    df = png_pixels(spark, str(tmp_path))
    assert df.count() == 35
    r = df.where("y = 3 and x = 2").first()
    assert [r[c] for c in "rgba"] == pytest.approx(list(pixels[3, 2]))


def test_wide_boxes_equal_narrow_ones(spark):
    from planeweave.operators import stencil

    assert stencil.box_radii(0.2) == [] and stencil.box_radii(3.0) == [2, 2, 3]
    assert sum((2 * r + 1) ** 2 - 1 for r in stencil.box_radii(5)) / 12 == pytest.approx(25, rel=0.1)
    v = np.random.default_rng(3).random(60)
    df = spark.createDataFrame([("i", 0, x, float(c)) for x, c in enumerate(v)], "img string, y int, x int, v double")
    out = df.select("x", stencil.box_pass(F.col("v"), 20, F.col("x"), 60, stencil.rows_window()).alias("o")).orderBy("x").collect()
    want = [np.mean(v[np.clip(np.arange(x - 20, x + 21), 0, 59)]) for x in range(60)]
    assert [r.o for r in out] == pytest.approx(want)
    assert math.isclose(stencil.reach(3.0), 7)


def test_export_spaces_have_their_published_matrices_and_curves(spark):
    from planeweave.functions import spaces

    p3 = [[0.82246197, 0.17753803, 0.0], [0.03319420, 0.96680580, 0.0], [0.01708263, 0.07239744, 0.91051993]]
    rec = [[0.62740390, 0.32928304, 0.04331307], [0.06909729, 0.91954040, 0.01136232], [0.01639144, 0.08801331, 0.89559525]]
    assert np.allclose(spaces.from_srgb("Display P3"), p3, atol=2e-5) and np.allclose(spaces.from_srgb("Rec.2020"), rec, atol=2e-5)
    for space in spaces.PRIMARIES:
        assert np.allclose(spaces.from_srgb(space).sum(axis=1), 1.0, atol=1e-9)  # white stays white
        row = spark.range(1).select(*[c.alias(f"{n}{k}") for n, v in (("white", 1.0), ("black", 0.0), ("bright", 4.0)) for k, c in enumerate(spaces.shown_in(space, [F.lit(v)] * 3))]).first()
        white, bright = [row[f"white{k}"] for k in range(3)], row["bright0"]
        if space == "Rec.2100 PQ":
            assert np.allclose(white, 0.58068, atol=1e-4) and bright > white[0] + 0.1  # 203 nits; highlights stay brighter
        else:
            assert np.allclose(white, 1.0, atol=1e-6) and abs(bright - 1.0) < 1e-6
        assert abs(row["black0"]) < 1e-6
