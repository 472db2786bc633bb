import planeweave.operators  # noqa: F401
from planeweave.plans.graph import Graph
from planeweave.plans.recipes import add_mask, clip, load_presets, mask_nodes, paste, retargeted, save_preset


def chain():
    g = Graph()
    a, b, c, d = g.add("io.image_input"), g.add("color.gamma"), g.add("color.exposure"), g.add("io.output")
    for x, y in ((a, b), (b, c), (c, d)):
        g.connect(x, 0, y, 0)
    return g, (a, b, c, d)


def test_masks_go_between():
    g, (a, b, c, d) = chain()
    adjusted, mask = add_mask(g, b.id, "color.basic", "matte.ellipse_mask", {"Exposure": 1.0})
    assert g.links[c.id, 0].source == adjusted.id and g.links[adjusted.id, 0].source == b.id
    assert g.links[adjusted.id, 1].source == mask.id and adjusted.params["Exposure"] == 1.0
    mixed = mask_nodes(g, b.id, c.id, "matte.box_mask")
    assert g.links[d.id, 0].source == mixed.id and g.links[mixed.id, 0].source == a.id and g.links[mixed.id, 1].source == c.id


def test_presets_and_retargeting(tmp_path):
    g, (a, b, c, d) = chain()
    save_preset(str(tmp_path), "warm", g, {b.id, c.id})
    (tmp_path / "bad.json").write_text("{")
    presets = load_presets(str(tmp_path))
    assert list(presets) == ["warm"] and len(clip(g, {b.id, c.id})["links"]) == 1
    new = paste(g, presets["warm"])
    assert g.links[new[c.id], 0].source == new[b.id]
    other = retargeted(g, "p2")
    assert other.nodes[a.id].params["File"] == "p2" and g.nodes[a.id].params["File"] == ""
