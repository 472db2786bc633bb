import numpy as np
import pytest
from pyspark.sql import functions as F

import planeweave.operators  # noqa: F401
from planeweave.plans.evaluate import Evaluator, Session
from planeweave.plans.graph import Graph, GraphError, difference
from planeweave.plans.region import region
from planeweave.plans.registry import REGISTRY
from planeweave.sources.tables import pixel_table


def picture(spark, w=12, h=8, images=("a",), nan=False):
    rows = []
    for n, img in enumerate(images):
        for y in range(h):
            for x in range(w):
                u, v = (x + 0.5) / w, (y + 0.5) / h
                r = float("nan") if nan and x == 0 else 1.3 * u - 0.08 + n * 0.1
                rows.append((img, y, x, r, 0.5 + 0.45 * float(np.sin(9 * u + 4 * v)), v * v, 1.0))
    return pixel_table(spark.createDataFrame(rows, "img string, y int, x int, r double, g double, b double, a double"), w, h)


def rows(df):
    return {(r["y"], r["x"]): tuple(r[c] for c in df.columns if c not in ("img", "y", "x")) for r in df.collect()}


def chain(*types):
    g = Graph()
    nodes = [g.add("io.image_input"), *(g.add(t, params=p) for t, p in types), g.add("io.output")]
    for a, b in zip(nodes, nodes[1:], strict=False):
        g.connect(a, 0, b, 0)
    return g, nodes


def test_wires_are_typed_and_acyclic():
    g = Graph()
    a, b, n, info = g.add("color.invert"), g.add("color.gamma"), g.add("io.number"), g.add("util.image_info")
    g.connect(a, 0, b, 0)
    with pytest.raises(GraphError, match="cycle"):
        g.connect(b, 0, a, 0)
    with pytest.raises(GraphError, match="cycle"):
        g.connect(a, 0, a, 0)
    g.connect(n, 0, a, "Factor")
    g.connect(info, 0, b, "Gamma")
    with pytest.raises(GraphError, match="unknown"):
        g.add("no.such")
    assert len(g.links) == 3


def test_loading_makes_parameters_valid_and_drops_bad_wires():
    told = {"nodes": [{"id": 4, "type": "color.levels", "params": {"In Black": 9, "Gamma": "x", "Channel": "Green", "Out White": float("nan")}}, {"id": 7, "type": "io.output"}], "links": [{"from": [4, 0], "to": [7, 0]}, {"from": [4, 5], "to": [7, 0]}, {"from": [1, 0], "to": [7, 0]}]}
    g = Graph.from_json(told)
    assert g.nodes[4].params == {"In Black": 1.0, "In White": 1.0, "Gamma": 1.0, "Out Black": 0.0, "Out White": 1.0, "Channel": 2}
    assert len(g.links) == 1
    assert Graph.from_json(g.to_json()).to_json() == g.to_json()
    assert g.add("io.number").id == 8


def test_edits():
    g, (i, a, b, o) = chain(("color.invert", {}), ("color.gamma", {"Gamma": 2.0}))
    old = Graph.from_json(g.to_json())
    g.remove(a.id, bridge=True)
    assert g.links[b.id, 0].source == i.id
    g.swap(b.id, "color.exposure")
    assert g.links[o.id, 0].source == b.id and g.nodes[b.id].params == {"Stops": 0.0}
    copies = g.clone({i.id, b.id})
    assert g.links[copies[b.id], 0].source == copies[i.id]
    assert any("Remove" in t for t in difference(old, g)) and any("Add" in t for t in difference(old, g))


def test_equal_plans_are_lowered_once(spark):
    g, (i, a, b, o) = chain(("color.invert", {}), ("color.gamma", {"Gamma": 2.0}))
    session = Session(spark, {"p": picture(spark)})
    first = Evaluator(g, session)
    first.result()
    again = Evaluator(g, session)
    again.result()
    g.nodes[b.id].params["Gamma"] = 3.0
    changed = Evaluator(g, session)
    changed.result()
    assert (first.lowered, again.lowered, changed.lowered) == (4, 0, 2)


def test_driven_parameters_hold_their_range_and_take_nan_for_0(spark):
    g, (i, a, o) = chain(("color.saturation", {}))
    s = g.add("color.split_rgb")
    g.connect(i, 0, s, 0)
    g.connect(s, "R", a, "Amount")
    image = picture(spark, nan=True)
    out = rows(Evaluator(g, Session(spark, {"p": image})).result())
    src = rows(image.frame.df.select("y", "x", *[F.col(n) for n in image.names]))
    for at, (r, gg, b, _) in src.items():
        if at[1] == 0:
            assert np.isnan(r)
        else:
            light = 0.2126 * r + 0.7152 * gg + 0.0722 * b
            k = min(max(r, 0), 4)
            assert out[at][:3] == pytest.approx([min(max(light + (c - light) * k, 0), 1) for c in (r, gg, b)])


def test_point_chains_need_no_shuffle(spark):
    g, _ = chain(("color.exposure", {"Stops": 1.0}), ("color.saturation", {"Amount": 0.5}), ("color.invert", {}))
    plan = Evaluator(g, Session(spark, {"p": picture(spark)})).result()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_images_of_other_sizes_are_sampled_by_nearest_position(spark):
    a, b = picture(spark), picture(spark, 5, 3)
    g = Graph()
    x, y, m = g.add("io.image_input", params={"File": "a"}), g.add("io.image_input", params={"File": "b"}), g.add("math.mix", params={"Factor": 1.0})
    g.connect(x, 0, m, "A")
    g.connect(y, 0, m, "B")
    small = rows(b.frame.df.select("y", "x", *b.names))
    out = rows(Evaluator(g, Session(spark, {"a": a, "b": b})).result(m.id))
    assert len(out) == 96
    for (yy, xx), v in out.items():
        want = small[min(2, yy * 3 // 8), min(4, xx * 5 // 12)]
        assert v[:3] == pytest.approx([min(max(c, 0), 1) for c in want[:3]])


@pytest.mark.parametrize("types", [[("filter.blur", {"Size X": 4.0, "Size Y": 4.0})], [("filter.filter", {}), ("color.gamma", {"Gamma": 2.0})], [("xform.flip", {})], [("matte.luminance_key", {}), ("filter.dilate_erode", {"Distance": 2.0})]])
def test_a_region_is_the_crop_of_the_whole(spark, types):
    whole = rows(Evaluator(chain(*types)[0], Session(spark, {"p": picture(spark, 24, 20)})).result())
    part = rows(region(chain(*types)[0], Session(spark, {"p": picture(spark, 24, 20)}), (9, 7, 5, 4)))
    assert len(part) == 20
    for at, v in part.items():
        assert v == pytest.approx(whole[at], abs=1e-9)


def test_groups_take_sliders_and_wires(spark):
    inner = Graph()
    i, v = inner.add("group.input", extra={"port": 0}), inner.add("group.value_input", extra={"port": 1, "default": 1.0}, label="Strength")
    n, o = inner.add("color.invert"), inner.add("group.output", extra={"port": 2})
    inner.connect(i, 0, n, 0)
    inner.connect(v, 0, n, "Factor")
    inner.connect(n, 0, o, 0)
    g = Graph()
    a, b = g.add("io.image_input"), g.add("group.group", extra={"graph": inner.to_json()})
    g.connect(a, 0, b, 0)
    flat, _ = chain(("color.invert", {}))
    assert rows(Evaluator(g, Session(spark, {"p": picture(spark)})).result(b.id)) == rows(Evaluator(flat, Session(spark, {"p": picture(spark)})).result())
    g.nodes[b.id].params["Strength"] = 0.0
    out = rows(Evaluator(g, Session(spark, {"p": picture(spark)})).result(b.id))
    assert max(v for c in out.values() for v in c) <= 1.0


def test_several_images_go_through_one_plan(spark):
    g, _ = chain(("conv.normalize", {"Low %": 10.0, "High %": 90.0}))
    df = Evaluator(g, Session(spark, {"p": picture(spark, images=("a", "b"))})).result()
    means = {r["img"]: r["m"] for r in df.groupBy("img").agg(F.avg("r").alias("m")).collect()}
    assert len(means) == 2 and abs(means["a"] - means["b"]) < 0.2


def test_every_operator_survives_tiny_pictures(spark):
    for type_ in ("filter.filter", "filter.pixelate", "filter.kuwahara", "xform.transform", "xform.crop", "tex.checker", "matte.ellipse_mask", "filter.vignette"):
        for w, h in ((1, 1), (2, 3)):
            g, nodes = chain()
            n = g.add(type_)
            if n.spec.inputs and n.spec.inputs[0].kind == "image":
                g.connect(nodes[0], 0, n, 0)
            df = Evaluator(g, Session(spark, {"p": picture(spark, w, h)})).result(n.id)
            assert df.count() == w * h
    assert len(REGISTRY) > 80
