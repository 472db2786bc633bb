"""Dust on smooth pictures and spots that heal into their surroundings."""

import numpy as np
import pandas as pd
import pytest

from planeweave.operators import spots
from planeweave.plans.evaluate import Evaluator, Session
from planeweave.plans.graph import Graph
from planeweave.sources.tables import pixel_table


def table(spark, pictures):
    y, x = np.indices(next(iter(pictures.values())).shape).reshape(2, -1)
    rows = [pd.DataFrame({"img": name, "y": y, "x": x, "r": p.ravel(), "g": p.ravel(), "b": p.ravel(), "a": 1.0}) for name, p in pictures.items()]
    h, w = next(iter(pictures.values())).shape
    return pixel_table(spark.createDataFrame(pd.concat(rows)), w, h)


def test_dust_is_found_and_other_dark_things_are_not(spark):
    h, w = 120, 160
    y, x = np.indices((h, w))
    sky = 0.4 + 0.3 * y / h
    disk = lambda cx, cy, r: np.clip(1 - ((x + 0.5 - cx) ** 2 + (y + 0.5 - cy) ** 2) / r**2, 0, 1)
    dusty = sky - 0.12 * (disk(40, 30, 3) + disk(100, 70, 3) + disk(130, 25, 2.5))
    other = sky.copy()
    other[60, 20:140] -= 0.2  # a wire
    other -= 0.12 * disk(1, 90, 3)  # cut by the frame
    found = spots.dust(table(spark, {"dusty": dusty, "other": other, "clean": sky})).collect()
    assert {r.img for r in found} == {"dusty"} and len(found) == 3
    for cx, cy in ((40, 30), (100, 70), (130, 25)):
        r = min(found, key=lambda r: abs(r.x * w - cx) + abs(r.y * h - cy))
        assert abs(r.x * w - cx) < 0.6 and abs(r.y * h - cy) < 0.6 and r.radius * w >= 3
    assert spots.dust(table(spark, {"tiny": sky[:10, :10]})).count() == 0


@pytest.mark.parametrize("linear", [False, True])
def test_a_healed_spot_takes_on_its_surroundings(spark, linear):
    """On light that changes evenly (by a factor, in linear light) a copy from elsewhere meets the edge all around."""
    h, w = 60, 80
    y, x = np.indices((h, w))
    even = 0.1 * 4.0 ** (x / w) if linear else 0.2 + 0.5 * x / w + 0.1 * y / h
    marked = even.copy()
    marked[(x + 0.5 - 24) ** 2 + (y + 0.5 - 30) ** 2 < 9] = 0.9
    spot = {"x": 24 / w, "y": 0.5, "sx": 54 / w, "sy": 0.5, "size": 6 / w, "feather": 0.3, "mode": "heal"}
    g = Graph({"linear": True} if linear else None)
    node = g.add("filter.spot_removal", params={"Spots": [spot]})
    g.connect(g.add("io.image_input", params={"Color Space": 1 if linear else 2}), 0, node, 0)
    out = Evaluator(g, Session(spark, {"one": table(spark, {"i": marked})})).result(node.id).toPandas().sort_values(["y", "x"])
    assert np.abs(out["r"].to_numpy().reshape(h, w) - even).max() < 0.02
