"""Plan macros: masks around adjustments, presets as clips of nodes, and edits carried to other photos."""

from __future__ import annotations

import copy
import json
from pathlib import Path

from .graph import Graph, Node


def feeds(graph: Graph, node_id: int) -> list[tuple[int, int, int]]:
    """(output, target, input) of every wire from a node."""
    return [(l.output, l.target, l.input) for l in graph.links.values() if l.source == node_id]


def add_mask(graph: Graph, after: int, adjustment: str, mask: str, params: dict | None = None) -> tuple[Node, Node]:
    """An adjustment behind a node, driven by a new mask at its factor."""
    adjusted, shape = graph.add(adjustment, params=params or {}), graph.add(mask)
    for output, target, pin in feeds(graph, after):
        graph.connect(adjusted, 0, target, pin)
    graph.connect(after, 0, adjusted, 0)
    graph.connect(shape, 0, adjusted, "Factor")
    return adjusted, shape


def mask_nodes(graph: Graph, first: int, last: int, mask: str) -> Node:
    """A chain from ``first`` to ``last`` mixed over its own input by a new mask."""
    before = graph.links[first, 0]
    mixed, shape = graph.add("math.mix"), graph.add(mask)
    for output, target, pin in feeds(graph, last):
        graph.connect(mixed, 0, target, pin)
    graph.connect(before.source, before.output, mixed, "A")
    graph.connect(last, 0, mixed, "B")
    graph.connect(shape, 0, mixed, "Factor")
    return mixed


def clip(graph: Graph, ids: set[int]) -> dict:
    """Nodes and the wires among them, as JSON."""
    told = graph.to_json()
    return {"nodes": [n for n in told["nodes"] if n["id"] in ids], "links": [l for l in told["links"] if l["from"][0] in ids and l["to"][0] in ids]}


def paste(graph: Graph, told: dict) -> dict[int, int]:
    """Adds a clip; old id to new id."""
    source = Graph.from_json(told)
    new = {i: graph.add(n.type, params=copy.deepcopy(n.params), muted=n.muted, label=n.label, extra=copy.deepcopy(n.extra)).id for i, n in source.nodes.items()}
    for l in source.links.values():
        graph.connect(new[l.source], l.output, new[l.target], l.input)
    return new


def save_preset(folder: str, name: str, graph: Graph, ids: set[int]) -> Path:
    path = Path(folder) / f"{name}.json"
    path.write_text(json.dumps(clip(graph, ids), indent=1))
    return path


def load_presets(folder: str) -> dict[str, dict]:
    """Presets of a folder by name; damaged files are left out."""
    found = {}
    for path in sorted(Path(folder).glob("*.json")):
        try:
            told = json.loads(path.read_text())
            Graph.from_json(told)
            found[path.stem] = told
        except (ValueError, KeyError, TypeError, AttributeError):
            continue
    return found


def retargeted(graph: Graph, source: str) -> Graph:
    """A copy of an edit that reads another photo: its image inputs name ``source``."""
    new = Graph.from_json(graph.to_json())
    for node in new.nodes.values():
        if node.type == "io.image_input":
            node.params["File"] = source
    return new
