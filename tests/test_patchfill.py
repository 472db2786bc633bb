"""Filled holes against a plain version, for any tile size, and on textures whose continuation is known."""

import numpy as np
import pandas as pd
import pytest

from planeweave.operators import patchfill as p
from planeweave.plans.evaluate import Evaluator, Session
from planeweave.plans.graph import Graph
from planeweave.sources.tables import pixel_table


def plain_round(planes, hole, match, level, turn):
    """One round for one image, patch by patch; planes (4, h, w) of whole numbers."""
    h, w = hole.shape
    at = lambda y, x: planes[:, np.clip(y + p._OFF, 0, h - 1)[:, None], np.clip(x + p._OFF, 0, w - 1)[None, :]].astype(float)
    near = lambda y, x: hole[max(0, y - 3) : y + 4, max(0, x - 3) : x + 4].any()
    out = {}
    for y in range(h):
        for x in range(w):
            if not near(y, x):
                continue
            places = {match.get((y, x), (-1, -1))}
            for s in (1, 4):
                for dy, dx in ((-s, 0), (s, 0), (0, -s), (0, s)):
                    if (y + dy, x + dx) in match:
                        a, b = match[y + dy, x + dx]
                        places.add((a - dy, b - dx))
            reach, k = max(h, w), 0
            while reach >= 1:
                bits = int(p.drawn(np.array([y]), np.array([x]), level, turn, k)[0])
                low, high, span = bits & 0xFFFFFFFF, bits >> 32, 2 * reach + 1
                own = match.get((y, x))
                places.add((low % h, high % w) if own is None else (own[0] + low % span - reach, own[1] + high % span - reach))
                reach, k = reach // 2, k + 1
            found = []
            for a, b in places:
                if 3 <= a < h - 3 and 3 <= b < w - 3 and (a, b) != (y, x) and not near(a, b):
                    found.append((float(((at(y, x) - at(a, b)) ** 2).sum()) / p.UNIT**2, a, b))
            if found:
                out[y, x] = min(found)
    return out


def plain_filled(planes, hole):
    planes, match = p.peeled(planes, hole), {}
    h, w = hole.shape
    for turn in range(16):
        found = plain_round(planes, hole, match, 0, turn)
        match = {k: v[1:] for k, v in found.items()}
        if turn % 2:
            new = planes.copy()
            for y, x in zip(*np.nonzero(hole), strict=True):
                total, weight = np.zeros(4, np.int64), 0
                for dy in range(-3, 4):
                    for dx in range(-3, 4):
                        if (y - dy, x - dx) in found:
                            cost, a, b = found[y - dy, x - dx]
                            v = round(4096 / (1 + 4 * cost)) + 1
                            total, weight = total + planes[:, a + dy, b + dx] * v, weight + v
                if weight:
                    new[:, y, x] = (2 * total + weight) // (2 * weight)
            planes = new
    return planes


def picture(h, w, seed=0):
    g = np.random.default_rng(seed)
    planes = (g.integers(0, 4, (4, h // 2 + 1, w // 2 + 1)).repeat(2, 1).repeat(2, 2)[:, :h, :w] * (p.UNIT // 4)).astype(np.int64)
    return planes


def table(spark, planes, hole, name="a"):
    y, x = np.indices(hole.shape).reshape(2, -1)
    rows = pd.DataFrame({"img": name, "y": y, "x": x} | {c: planes[k].ravel() for k, c in enumerate(p.COLOURS)} | {"hole": hole.ravel()})
    return spark.createDataFrame(rows, "img string, y int, x int, q0 long, q1 long, q2 long, q3 long, hole boolean")


def planes_of(df, shape):
    out = np.zeros((4, *shape), np.int64)
    for r in df.collect():
        out[:, r.y, r.x] = r.q0, r.q1, r.q2, r.q3
    return out


def test_equals_a_plain_version(spark):
    planes, hole = picture(26, 34), np.zeros((26, 34), bool)
    hole[10:15, 13:20] = hole[0:2, 30:34] = True
    want = plain_filled(planes, hole)
    assert (p.filled(planes, hole, 0, 1)[0] == want).all()
    for side in (512, 16):  # in one task, and over tiles whose border the hole crosses
        assert (planes_of(p.completed(table(spark, planes, hole), hole.shape, side=side), hole.shape) == want).all()


def test_any_tile_size_and_level_gives_the_same(spark):
    shape = (50, 55)
    planes, hole = picture(*shape, seed=3), np.zeros(shape, bool)
    hole[20:31, 24:40] = True
    both = table(spark, planes, hole).union(table(spark, planes[::-1].copy(), hole, "b"))
    one = {(r.img, r.y, r.x): tuple(r) for r in p.completed(both, shape).collect()}
    cut = {(r.img, r.y, r.x): tuple(r) for r in p.completed(both, shape, side=27).collect()}
    assert one == cut and len(one) == 2 * 50 * 55


def test_nothing_to_copy_from_is_filled_smoothly(spark):
    planes, hole = picture(30, 30, seed=5), np.ones((30, 30), bool)
    hole[:, :3] = False
    made = p.filled(planes, hole, 0, 1)[0]
    assert (made == p.peeled(planes, hole)).all() and (made[:, ~hole] == planes[:, ~hole]).all()
    planes, hole = picture(26, 30, seed=6), np.ones((26, 30), bool)
    hole[:, 1::7] = hole[:, 2::7] = hole[:, 3::7] = False  # known pixels, but no whole patch
    assert (planes_of(p.completed(table(spark, planes, hole), hole.shape, side=16), hole.shape) == p.peeled(planes, hole)).all()
    planes, hole = picture(60, 50, seed=6), np.ones((60, 50), bool)
    hole[:, 20:23] = False
    assert (p.filled(planes, hole, 0, 2)[0] == p.peeled(planes, hole)).all()


def _removed(spark, image, mask, grow=0.0, linear=False):
    g = Graph({"linear": linear} if linear else {})
    source, hide, node = g.add("io.image_input", params={"File": "image"}), g.add("io.image_input", params={"File": "mask"}), g.add("filter.remove", params={"Grow": grow})
    g.connect(source, 0, node, "Image")
    g.connect(hide, 0, node, "Mask")
    return Evaluator(g, Session(spark, {"image": image, "mask": mask})).result(node.id)


@pytest.mark.parametrize("grow", [0.0, 2.0])
def test_stripes_go_on_where_a_square_is_removed(spark, grow):
    n = 96
    y, x = np.indices((n, n)).reshape(2, -1)
    inside = (y >= 36) & (y < 60) & (x >= 36) & (x < 60)
    stripe = np.where(x // 4 % 2 == 1, 0.8, 0.2)
    square = np.where(inside, 0.0, stripe)
    rows = pd.DataFrame({"img": "s", "y": y, "x": x, "r": np.where(inside, 1.0, stripe), "g": square, "b": square, "a": 1.0})
    image = lambda df: pixel_table(spark.createDataFrame(df), n, n)
    hide = rows.assign(r=inside.astype(float), g=inside.astype(float), b=inside.astype(float))
    made = _removed(spark, image(rows), image(hide), grow).toPandas().sort_values(["y", "x"])
    assert np.abs(made["r"].to_numpy() - stripe).mean() < 0.02 and np.abs(made["g"] - made["r"]).max() < 1e-6
    if not grow:
        assert (made["r"].to_numpy()[~inside] == rows["r"].to_numpy()[~inside]).all()


def test_a_level_is_dealt_out_to_tiles_once(spark, monkeypatch):
    """Rounds deal out what surrounds the hole, not the level's pixels again."""
    planes, hole = picture(26, 34, seed=8), np.zeros((26, 34), bool)
    hole[11:14, 15:18] = True
    tiles, dealt = p._tiles, []
    monkeypatch.setattr(p, "_tiles", lambda df, *more: (dealt.append("target" in df.columns), tiles(df, *more))[1])
    p.completed(table(spark, planes, hole), hole.shape, side=16)
    assert dealt.count(False) == 1 and dealt.count(True) == 16
