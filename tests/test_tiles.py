"""Tiles against wholes: cutting a picture changes no value; and small functions against plain versions."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from planeweave import catalogue
from planeweave.functions import maths
from planeweave.operators import develop, geometry, iterative, library, reduce, stencil
from planeweave.plans.evaluate import Evaluator, Session
from planeweave.plans.graph import Graph
from planeweave.plans.registry import REGISTRY
from planeweave.plans.values import Frame

TILED = ["blur", "blur_plane", "filter_sobel", "kuwahara", "bilateral_high", "bilateral_fast", "dilate", "denoise", "defringe", "sharpen_masked", "transform", "basic_clarity", "glare", "capture_sharpen", "diffuse"]


def rows(df):
    return sorted(tuple(round(v, 7) + 0.0 if isinstance(v, float) else v for v in r) for r in df.collect())


@pytest.mark.parametrize("name", TILED)
def test_tiles_equal_the_whole(spark, sf_dir, name, monkeypatch):
    """The picture of 1,000 pixels has 10 rows; as one of 10 columns it has 100, cut into tiles of 4 and more."""
    monkeypatch.setattr(catalogue, "events_image", tall)
    whole = rows(catalogue.QUERIES[name](spark, sf_dir))
    for module, size, value in ((stencil, "TILE", 4), (iterative, "SIDE", 8)):
        monkeypatch.setattr(module, size, value)
    assert rows(catalogue.QUERIES[name](spark, sf_dir)) == whole


def tall(spark, sf_dir):
    df = spark.range(1000).select(F.lit("0").alias("img"), (F.col("id") / 10).cast("int").alias("y"), (F.col("id") % 10).cast("int").alias("x"), *[(F.pmod(F.xxhash64("id", F.lit(c)), F.lit(1000)) / 1000).alias(c) for c in "rgb"], F.lit(1.0).alias("a"))
    frame = Frame(df, 10, 100)
    return frame.image(*(F.col(c) for c in "rgba"))


def test_a_tall_column_has_many_windows(spark):
    frame = Frame(spark.range(1).select(F.lit("0").alias("img"), F.lit(0).alias("y"), F.lit(0).alias("x"), F.lit(0.5).alias("v")), 100, 10**6)
    with stencil.down(frame, 9) as w:
        (name,) = frame.add(F.sum("v").over(w.rowsBetween(-9, 9)))
    assert "Generate" in frame.df._jdf.queryExecution().optimizedPlan().toString() and name in frame.df.columns
    assert 100 * math.ceil(frame.h / stencil.TILE) > 97_000


def test_a_kernel_takes_two_shuffles(spark, sf_dir):
    df = catalogue.QUERIES["filter_sobel"](spark, sf_dir)
    assert df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 2


def test_envelope_is_the_least_parabola():
    g = np.random.default_rng(1)
    for n in (1, 2, 7, 60):
        for _ in range(30):
            d = np.where(g.random(n) < 0.6, np.inf, g.integers(0, 40, n).astype(float))
            i = np.arange(n)
            assert np.array_equal(stencil.envelope(d), ((i[:, None] - i[None, :]) ** 2 + d[None, :]).min(axis=1))


def test_box_radii_follow_the_published_formula():
    for sigma in np.arange(0.3, 80, 0.37):
        low = math.floor(math.sqrt(12 * sigma * sigma / 3 + 1))
        low -= low % 2 == 0
        ideal = (12 * sigma * sigma - 3 * low * low - 12 * low - 9) / (-4 * low - 4)
        k = math.floor(ideal + 0.5)
        assert stencil.box_radii(sigma) == [((low if i < k else low + 2) - 1) // 2 for i in range(3)]


def test_file_hash(spark):
    def plain(raw):
        h = 1469598103934665603
        for b in raw:
            h = ((h ^ b) * 1099511628211) % 2**64
        return ((h ^ len(raw)) * 1099511628211) % 2**64 or 1

    raws = [b"", b"a", b"ab", b"abc" * 700, bytes(range(256)), b"abc" * 700 + b"x", None, b"ab"]
    got = spark.createDataFrame([(i, x) for i, x in enumerate(raws)], "i int, x binary").select("i", reduce.file_hash(F.col("x")).alias("h")).collect()
    assert {r.i: r.h % 2**64 for r in got} == {i: plain(x or b"") for i, x in enumerate(raws)} and reduce.folded(b"ab") == plain(b"ab")


def test_ranks_of_lopsided_values(spark):
    """A constant with one far value, ties, nulls and a few values."""
    for values in ([0.5] * 3000 + [1e9], [None, 1.0, None, 2.0, 3.0], [7.0], sorted([float(i % 7) for i in range(500)])):
        known = sorted(v for v in values if v is not None)
        df = spark.createDataFrame([("0", v) for v in values], "img string, v double")
        asked = {f"p{p}": reduce.rank_of(p / 100) for p in (0, 5, 37, 50, 95, 100)} | {"top": reduce.top_rank(1000)}
        got = reduce.exact_ranks(df, "v", asked, len(values)).first()
        n = len(known)
        assert [got[f"p{p}"] for p in (0, 5, 37, 50, 95, 100)] == [known[int(p / 100 * (n - 1) + 0.5)] for p in (0, 5, 37, 50, 95, 100)]
        assert got["top"] == known[n - max(1, n // 1000)]


def test_lanczos_weights_sum_to_one(spark):
    for n, size in ((10, 4), (7, 20), (5, 5)):
        got = iterative.lanczos_weights(spark, n, size).groupBy("out").agg(F.sum("weight").alias("w"), F.min("into").alias("lo"), F.max("into").alias("hi")).collect()
        assert len(got) == size and all(abs(r.w - 1) < 1e-12 and r.lo >= 0 and r.hi < n for r in got)


def test_canvas_of_a_border():
    assert geometry.canvas_of(100, 50, 4, 0, None) == (108, 58, 4, 4)
    assert geometry.canvas_of(100, 50, 0, 10, None) == (100, 60, 0, 0)
    assert geometry.canvas_of(100, 50, 0, 0, 1.0) == (100, 100, 0, 25)
    assert geometry.canvas_of(50, 100, 0, 0, 16 / 9) == (178, 100, 64, 0)


def test_places_are_those_of_the_whole_order(spark):
    g = np.random.default_rng(2)
    told = [(i, int(k)) for i, k in enumerate(g.integers(0, 5, 300))]
    df = spark.createDataFrame(told, "i int, k int")
    got = {r.i: r.place for r in library.numbered(df, [F.col("k").desc(), F.col("i").asc()]).collect()}
    assert got == {i: n for n, (i, _) in enumerate(sorted(told, key=lambda x: (-x[1], x[0])), 1)}


#: Parameters of some types with their defaults and ranges.
PARAMETERS = {
    "io.number": [("Value", 1.0, -10.0, 10.0)],
    "color.combine_hsv": [("H", 0.0, 0.0, 1.0), ("S", 0.0, 0.0, 1.0), ("V", 0.0, 0.0, 1.0), ("A", 1.0, 0.0, 1.0)],
    "filter.sun_beams": [("Source X", 0.5, 0.0, 1.0), ("Source Y", 0.3, 0.0, 1.0), ("Length", 0.3, 0.0, 1.0)],
    "filter.glare": [("Threshold", 0.75, 0.0, 1.0), ("Size", 60.0, 1.0, 500.0), ("Strength", 1.0, 0.0, 4.0), ("Streaks", 4.0, 2.0, 16.0), ("Angle", 30.0, 0.0, 180.0), ("Fade", 0.9, 0.5, 0.99)],
    "filter.directional_blur": [("Distance", 30.0, 0.0, 400.0), ("Angle", 0.0, -180.0, 180.0), ("Spin", 0.0, -90.0, 90.0), ("Zoom", 0.0, 0.0, 1.0), ("Center X", 0.5, 0.0, 1.0), ("Center Y", 0.5, 0.0, 1.0)],
    "xform.border": [("Size", 4.0, 0.0, 25.0), ("Bottom", 0.0, 0.0, 25.0), ("Line Size", 0.0, 0.0, 2.0)],
}


@pytest.mark.parametrize("kind", PARAMETERS)
def test_parameters(kind):
    assert [(p.name, p.default, p.lo, p.hi) for p in REGISTRY[kind].params if p.kind == "float"] == PARAMETERS[kind]


@pytest.mark.parametrize("linear", [False, True])
def test_automatic_tone(spark, linear):
    """Dark and flat pictures are lifted and spread, full ones left nearly alone, bright ones lowered."""
    def sliders(low, high):
        x = (low + (high - low) * F.col("id") / 4095.0)
        df = spark.range(4096).select(F.lit("0").alias("img"), (F.col("id") / 64).cast("int").alias("y"), (F.col("id") % 64).cast("int").alias("x"), x.alias("v"))
        frame = Frame(df, 64, 64)
        return develop.auto_tone(frame.image(F.col("v"), F.col("v"), F.col("v"), 1.0), linear).first().asDict()

    def tones(s, low, high):
        v = np.linspace(low, high, 4096)
        v = np.where(v <= 0.0031308, v * 12.92, 1.055 * v ** (1 / 2.4) - 0.055) if linear else v
        return develop.toned_values(np.stack([v] * 3, axis=1), s)

    low, high = (0.01, 0.05) if linear else (0.1, 0.3)
    s = sliders(low, high)
    t = tones(s, low, high)
    assert s["Exposure"] > 0.5 and 0.3 < t[2048] < 0.6 and t[-1] <= 1 and s["Whites"] > 0 and s["Blacks"] < 0
    low, high = (0.002, 0.9) if linear else (0.03, 0.95)
    s = sliders(low, high)
    t = tones(s, low, high)
    assert abs(s["Exposure"]) < 1.5 and 0.9 < t[-1] <= 1
    assert sliders(*((0.5, 0.9) if linear else (0.75, 0.95)))["Exposure"] < 0


def test_tone_values_are_those_of_the_operator(spark):
    g = np.random.default_rng(3)
    rgb = g.random((1000, 3))
    sliders = {"Exposure": 0.4, "Contrast": -20.0, "Highlights": -40.0, "Shadows": 35.0, "Whites": 20.0, "Blacks": -30.0}
    df = spark.createDataFrame([("0", i // 100, i % 100, *map(float, v)) for i, v in enumerate(rgb)], "img string, y int, x int, r double, g double, b double")
    graph = Graph()
    a, b = graph.add("io.image_input", params={"Color Space": 2}), graph.add("color.basic", params=sliders)
    graph.connect(a, 0, b, 0)
    frame = Frame(df, 100, 10)
    out = Evaluator(graph, Session(spark, {"one": frame.image(F.col("r"), F.col("g"), F.col("b"), 1.0)})).result(b.id, 0).toPandas()
    assert np.allclose(np.sort(out[["r", "g", "b"]].to_numpy() @ np.array(maths.LUMA)), develop.toned_values(rgb, sliders), atol=1e-9)


def bilinear(plane, sx, sy):
    """Values at places, pixel centres at .5, the edge repeated."""
    h, w = plane.shape[:2]
    x0, y0 = np.floor(sx - 0.5).astype(int), np.floor(sy - 0.5).astype(int)
    fx, fy = (sx - 0.5 - x0)[..., None], (sy - 0.5 - y0)[..., None]
    at = lambda j, i: plane[np.clip(j, 0, h - 1), np.clip(i, 0, w - 1)]
    return (at(y0, x0) * (1 - fx) + at(y0, x0 + 1) * fx) * (1 - fy) + (at(y0 + 1, x0) * (1 - fx) + at(y0 + 1, x0 + 1) * fx) * fy


def test_fast_directional_blur(spark, sf_dir, monkeypatch):
    """Passes of moved copies against the affine path put on itself in numpy."""
    monkeypatch.setattr(catalogue, "events_image", tall)
    given = tall(spark, sf_dir)
    rows_ = given.frame.df.select("y", "x", *given.names).toPandas().sort_values(["y", "x"]).to_numpy()
    now = rows_[:, 2:].reshape(100, 10, 4)
    y, x = np.mgrid[0:100, 0:10]
    parts = 2**3 - 1
    s, a = (1 - 0.05) ** (1 / parts), math.radians(4.0) / parts
    turn, move = s * np.array([[math.cos(a), -math.sin(a)], [math.sin(a), math.cos(a)]]), np.array([math.cos(math.radians(30)), math.sin(math.radians(30))]) * 6.0 / parts
    for _ in range(3):
        q = np.stack([x + 0.5 - 5.0, y + 0.5 - 50.0], axis=-1) @ turn.T + move
        now = 0.5 * (now + bilinear(now, q[..., 0] + 5.0, q[..., 1] + 50.0))
        turn, move = turn @ turn, turn @ move + move
    got = catalogue.QUERIES["directional_blur_fast"](spark, sf_dir).toPandas().sort_values(["y", "x"])[["r", "g", "b", "a"]].to_numpy().reshape(100, 10, 4)
    assert np.allclose(got, now, atol=1e-7)


def plain_diffused(planes, amount, radius, span, rounds, sensitivity, threshold):
    """Pixel by pixel, level by level."""
    h, w = planes[0].shape
    centre = math.log2(max(radius, 0.25))
    raw = [math.exp(-0.5 * ((k - centre) / span) ** 2) for k in range(min(max(math.ceil(centre + 2 * span) + 1, 1), 10))]
    weights = [r / max(sum(raw), 1.0) for r in raw]
    spline = (1 / 16, 4 / 16, 6 / 16, 4 / 16, 1 / 16)
    get = lambda p, y, x: p[min(max(y, 0), h - 1)][min(max(x, 0), w - 1)]
    for _ in range(rounds):
        luma = [[sum(k * p[y][x] for k, p in zip((0.2126, 0.7152, 0.0722), planes, strict=True)) for x in range(w)] for y in range(h)]
        out = []
        for plane in planes:
            now, move = [list(map(float, row)) for row in plane], np.zeros((h, w))
            for level, weight in enumerate(weights):
                far = 1 << level
                rows = [[sum(k * get(now, y + (d - 2) * far, x) for d, k in enumerate(spline)) for x in range(w)] for y in range(h)]
                soft = [[sum(k * get(rows, y, x + (d - 2) * far) for d, k in enumerate(spline)) for x in range(w)] for y in range(h)]
                for y in range(h):
                    for x in range(w):
                        detail, gate = now[y][x] - soft[y][x], 1.0
                        if amount > 0 and threshold > 0:
                            t = min(max(abs(detail) / threshold - 1.0, 0.0), 1.0)
                            gate = t * t * (3 - 2 * t)
                        move[y, x] += weight * gate * detail
                now = soft
            new = np.zeros((h, w))
            for y in range(h):
                for x in range(w):
                    gx, gy = (get(luma, y, x + 1) - get(luma, y, x - 1)) / 2, (get(luma, y + 1, x) - get(luma, y - 1, x)) / 2
                    pace = 2 * amount / rounds / (1 + (gx * gx + gy * gy) / (0.05 / sensitivity) ** 2 if sensitivity else 1)
                    new[y, x] = max(plane[y][x] + max(pace, -1.0) * move[y, x], 0.0)
            out.append(new)
        planes = out
    return planes


@pytest.mark.parametrize(("amount", "sensitivity", "threshold"), [(25, 50, 5), (-100, 50, 5), (80, 0, 0)])
def test_diffusion_equals_a_plain_version(spark, amount, sensitivity, threshold):
    planes = np.random.default_rng(7).random((3, 13, 17))
    y, x = np.indices((13, 17)).reshape(2, -1)
    rows = pd.DataFrame({"img": "0", "y": y, "x": x, **{c: p.ravel() for c, p in zip("rgb", planes, strict=True)}})
    graph = Graph()
    a = graph.add("io.image_input", params={"Color Space": 2})
    b = graph.add("filter.diffuse", params={"Amount": amount, "Edge Sensitivity": sensitivity, "Noise Threshold": threshold, "Iterations": 2})
    graph.connect(a, 0, b, 0)
    frame = Frame(spark.createDataFrame(rows, "img string, y int, x int, r double, g double, b double"), 17, 13)
    out = Evaluator(graph, Session(spark, {"one": frame.image(F.col("r"), F.col("g"), F.col("b"), 1.0)})).result(b.id, 0).toPandas().sort_values(["y", "x"])
    want = plain_diffused(list(planes), amount / 100, 4.0, 1.0, 2, sensitivity / 100, threshold / 100 * 0.02)
    for c, p in zip("rgb", want, strict=True):
        assert np.allclose(out[c].to_numpy().reshape(13, 17), np.clip(p, 0, 1), atol=1e-9)


def test_automatic_sliders_are_the_best_of_all_their_values():
    """Each slider brings its share of the tones nearest to its tone, of all whole values with the earlier ones set."""
    g = np.random.default_rng(12)
    for low, high, bend in ((0.1, 0.4, 1.0), (0.0, 1.0, 2.0), (0.3, 0.98, 0.6)):
        rgb = np.clip(low + (high - low) * g.random((3000, 1)) ** bend + 0.02 * g.random((3000, 3)), 0, 1)
        s = develop.automatic(rgb)
        at = lambda share, **more: np.quantile(develop.toned_values(rgb, s | more), share, method="nearest")  # noqa: B023,E731
        zero = dict.fromkeys(develop.AUTO_SLIDERS, 0.0)
        stops = [k / 20 for k in range(-80, 81)]
        near = lambda share, tone: min(stops, key=lambda v: abs(np.quantile(develop.toned_values(rgb, zero | {"Exposure": v}), share, method="nearest") - tone))  # noqa: B023,E731
        middle, bright = near(0.5, 0.42), near(0.995, 0.92)
        assert abs(s["Exposure"] - (middle if middle >= 0 else min(max(middle, bright), 0.0))) <= 0.051
        for slider, share, tone in (("Blacks", 0.005, 0.02), ("Whites", 0.995, 0.97)):
            before = {"Blacks": 0.0} if slider == "Whites" else {}
            off = {v: abs(at(share, **before, **{slider: float(v)}) - tone) for v in range(-70, 71)}
            assert off[int(s[slider])] <= min(off.values()) + 0.006
