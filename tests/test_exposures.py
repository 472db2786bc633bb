"""Exposures with planted shifts and moved things."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from planeweave.operators import align, retouch
from planeweave.plans.evaluate import Evaluator, Session
from planeweave.plans.graph import Graph
from planeweave.sources.tables import pixel_table


def plain_bitmaps(light):
    """(above, used) of every level, finest first."""
    g = np.rint(np.clip(light, 0, 1) ** (1 / 2.2) * 255 * 1024).astype(np.int64)
    out, unit = [], 1024
    while True:
        cumulated = np.cumsum(np.bincount(np.minimum(g // unit, 255).ravel(), minlength=256))
        median = int(np.argmax(cumulated >= g.size // 2))
        out.append((g > median * unit, np.abs(g - median * unit) > 4 * unit))
        h, w = g.shape
        if max(w, h) < 64 or len(out) >= 10 or min(w, h) < 8:
            return out
        h, w, unit = h // 2, w // 2, unit * 4
        g = g[: 2 * h, : 2 * w].reshape(h, 2, w, 2).sum(axis=(1, 3))


def plain_shift(ref, img):
    dx = dy = 0
    for (a, ua), (b, ub) in zip(plain_bitmaps(ref)[::-1], plain_bitmaps(img)[::-1], strict=True):
        h, w = a.shape
        costs = []
        for k in range(9):
            sx, sy = 2 * dx + k % 3 - 1, 2 * dy + k // 3 - 1
            y = np.arange(max(0, -sy), min(h, h - sy))[:, None]
            x = np.arange(max(0, -sx), min(w, w - sx))[None, :]
            if y.size and x.size:
                used = ua[y, x] & ub[y + sy, x + sx]
                if used.any():
                    costs.append((int(((a[y, x] ^ b[y + sy, x + sx]) & used).sum()) * 1000000 // int(used.sum()), k != 4, k, sx, sy))
        dx, dy = min(costs)[3:] if costs else (2 * dx, 2 * dy)
    return dx, dy


def scene(h, w, seed):
    g = np.random.default_rng(seed)
    coarse = g.random((h // 8 + 2, w // 8 + 2)).repeat(8, 0).repeat(8, 1)[:h, :w]
    return 0.1 + 0.3 * coarse + 0.2 * g.random((h, w))


def test_shifts_of_several_images(spark):
    h, w, rows, planted = 90, 150, [], {"a": (5, -3), "b": (-6, 4), "c": (0, 0)}
    y, x = np.indices((h, w))
    for k, (name, (dx, dy)) in enumerate(planted.items()):
        ref = scene(h, w, k)
        shown = ref[np.clip(y - dy, 0, h - 1), np.clip(x - dx, 0, w - 1)] * 1.7
        noise = scene(h, w, 50 + k)
        rows.append(pd.DataFrame({"img": name, "y": y.ravel(), "x": x.ravel(), "p0": shown.ravel(), "p1": ref.ravel(), "p2": noise.ravel()}))
    df = spark.createDataFrame(pd.concat(rows), "img string, y int, x int, p0 double, p1 double, p2 double")
    found = align.shifts(df, [F.col(f"p{k}") for k in range(3)], df.select("img", F.lit(1).alias("ref")).distinct(), w, h)
    got = {(r.img, r.picture): (r.dx, r.dy) for r in found.collect()}
    assert {k[0]: v for k, v in got.items() if k[1] == 0} == planted
    for part in rows:
        planes = [part[f"p{k}"].to_numpy().reshape(h, w) for k in range(3)]
        for k in (0, 2):
            assert got[part["img"].iloc[0], k] == plain_shift(planes[1], planes[k])


def merged(spark, pictures, params):
    g = Graph({"linear": True})
    merge = g.add("math.hdr_merge", params=params)
    h, w = pictures[0].shape
    y, x = np.indices((h, w)).reshape(2, -1)
    sources = {}
    for k, p in enumerate(pictures):
        v = p.ravel()
        sources[f"s{k}"] = pixel_table(spark.createDataFrame(pd.DataFrame({"img": "i", "y": y, "x": x, "r": v, "g": v, "b": v, "a": 1.0})), w, h)
        g.connect(g.add("io.image_input", params={"Color Space": 1, "File": f"s{k}"}), 0, merge, f"Image {k + 1}")
    rows = Evaluator(g, Session(spark, sources)).result(merge.id).toPandas().sort_values(["y", "x"])
    return rows["r"].to_numpy().reshape(h, w)


def test_a_moved_block_leaves_no_double_image(spark):
    still = scene(60, 70, 9)
    moved = still * 1.9
    moved[20:32, 30:44] = 0.02
    pictures = [still * 0.5, still, moved]
    with_ghost, without = (merged(spark, pictures, {"Auto Align": False, "Deghost": k}) for k in (0, 2))
    inner = np.s_[22:30, 32:42]
    assert np.abs(with_ghost - still)[inner].max() > 0.05
    assert np.abs(without - still)[inner].max() < 1e-9
    far = np.ones(still.shape, bool)
    far[14:38, 24:50] = False
    assert np.abs(without - still)[far].max() < 1e-9


def test_merging_aligns_unless_told_not_to(spark):
    still = scene(80, 80, 4)
    y, x = np.indices(still.shape)
    shaken = 1.8 * still[np.clip(y - 2, 0, 79), np.clip(x + 3, 0, 79)]
    inside = np.s_[8:-8, 8:-8]
    assert np.abs(merged(spark, [still, shaken], {}) - still)[inside].max() < 1e-9
    assert np.abs(merged(spark, [still, shaken], {"Auto Align": False}) - still)[inside].max() > 0.01


def test_only_moved_exposures_are_sent_to_their_places(spark, monkeypatch):
    """Two images whose first exposure lies elsewhere: each place shows the pixel that is there, the edge repeated."""
    h, w, planted = 9, 7, {"a": (2, -3), "b": (-4, 1)}
    y, x = np.indices((h, w))
    values = {name: np.random.default_rng(k).random((2, h, w)) for k, name in enumerate(planted)}
    rows = pd.concat([pd.DataFrame({"img": n, "y": y.ravel(), "x": x.ravel(), "r": v[0].ravel(), "g": v[1].ravel(), "b": 0.0, "a": 1.0}) for n, v in values.items()])
    frame = pixel_table(spark.createDataFrame(rows, "img string, y int, x int, r double, g double, b double, a double"), w, h).frame
    found = spark.createDataFrame([(n, p, *(d if p == 0 else (0, 0))) for n, d in planted.items() for p in (0, 1)], "img string, picture int, dx int, dy int")
    monkeypatch.setattr(retouch, "shifts", lambda *_: found)
    light = retouch._aligned(frame, [[F.col("p0")] * 3, [F.col("p1")] * 3], [], None)
    out = frame.df.select("img", "y", "x", light[0][0].alias("moved"), light[1][0].alias("still"))
    assert frame.df._jdf.queryExecution().optimizedPlan().toString().count("Join") == 2  # pixels once, by the shifts' rows
    got = {(r.img, r.y, r.x): (r.moved, r.still) for r in out.collect()}
    assert len(got) == 2 * h * w
    for name, (dx, dy) in planted.items():
        there = values[name][0][np.clip(y + dy, 0, h - 1), np.clip(x + dx, 0, w - 1)]
        assert all(got[name, j, i] == (there[j, i], values[name][1][j, i]) for j in range(h) for i in range(w))
