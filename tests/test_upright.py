"""Lines of tilted pictures, and the turn that makes them upright."""

import math

import numpy as np
import pandas as pd
import pytest

from planeweave.operators import upright
from planeweave.plans.evaluate import Evaluator, Session
from planeweave.plans.graph import Graph
from planeweave.sources.tables import pixel_table


def facade(h, w, angles):
    """A wall of windows seen by a camera that is turned by ``angles``, softly drawn."""
    f = math.hypot(w / 2, h / 2)
    y, x = np.indices((h, w))
    rays = np.stack([(x + 0.5 - w / 2) / f, (y + 0.5 - h / 2) / f, np.ones((h, w))], axis=-1) @ upright.rotation(np.array(angles))
    u, v = rays[..., 0] / rays[..., 2] * f, rays[..., 1] / rays[..., 2] * f
    edge = lambda c: 1 / (1 + np.exp(-4 * (np.abs((c + 500) % 40 - 20) - 10) / 2))
    return 0.2 + 0.6 * np.clip(edge(u) + edge(v), 0, 1)


def table(spark, pictures):
    h, w = next(iter(pictures.values())).shape
    y, x = np.indices((h, w)).reshape(2, -1)
    return pixel_table(spark.createDataFrame(pd.concat([pd.DataFrame({"img": n, "y": y, "x": x, "r": p.ravel(), "g": p.ravel(), "b": p.ravel(), "a": 1.0}) for n, p in pictures.items()])), w, h)


@pytest.mark.parametrize(("mode", "axes"), [("Level", (2,)), ("Vertical", (0,)), ("Full", (0, 1, 2))])
def test_planted_turns_are_found(spark, mode, axes):
    h, w = 225, 300
    planted = {}
    for name, degrees in (("a", (5.0, -4.0, 3.0)), ("b", (-6.0, 3.0, -5.0))):
        planted[name] = [math.radians(d) if k in axes else 0.0 for k, d in enumerate(degrees)]
    lines = upright.segments(table(spark, {n: facade(h, w, a) for n, a in planted.items()})).toPandas()
    for name, angles in planted.items():
        own = lines[lines["img"] == name]
        assert 10 < len(own) <= 2 * upright.MOST_LINES
        # What was turned one way is turned back.
        found = upright.rotation(upright.turn(own, w, h, mode)) @ upright.rotation(np.array(angles))
        off = math.degrees(math.acos(min(1.0, (np.trace(found) - 1) / 2)))
        assert off < 0.2


def test_a_tilted_picture_is_levelled_and_a_plain_one_stays(spark):
    h, w = 120, 160
    image = table(spark, {"tilted": facade(h, w, (0, 0, math.radians(4))), "plain": np.full((h, w), 0.5)})
    g = Graph()
    node = g.add("xform.perspective", params={"Upright": "Level"})
    g.connect(g.add("io.image_input", params={"Color Space": 2}), 0, node, 0)
    out = Evaluator(g, Session(spark, {"one": image})).result(node.id).toPandas()
    level = facade(h, w, (0, 0, 0))
    made = out[out["img"] == "tilted"].sort_values(["y", "x"])["r"].to_numpy().reshape(h, w)
    assert np.abs(made - level)[25:-25, 35:-35].mean() < 0.03
    assert (out[out["img"] == "plain"]["r"] == 0.5).all()


def test_guides_become_upright():
    """Lines drawn along what a turned camera sees of a vertical and of a horizontal one."""
    w, h, f = 400, 300, 250.0
    seen = upright.rotation(np.radians([7.0, -5.0, 3.0]))
    guides = []
    for a, b in (((-0.3, -0.4, 1), (-0.3, 0.4, 1)), ((0.4, -0.4, 1), (0.4, 0.3, 1)), ((-0.4, 0.3, 1), (0.4, 0.3, 1)), ((-0.4, -0.3, 1), (0.4, -0.3, 1))):
        (x0, y0), (x1, y1) = ((p[:2] / p[2] * f + [w / 2, h / 2]) / [w, h] for p in (seen @ np.array(a), seen @ np.array(b)))
        guides.append({"x0": x0, "y0": y0, "x1": x1, "y1": y1})
    back = upright.rotation(upright.guided(guides, w, h)) @ seen
    assert math.degrees(math.acos(min(1.0, (np.trace(back) - 1) / 2))) < 0.1
    assert (upright.guided([], w, h) == 0).all()
