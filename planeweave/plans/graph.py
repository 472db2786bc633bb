"""Graphs of operators: typed wires, no cycles, JSON in and out, and plan edits."""

from __future__ import annotations

import copy
import json
from dataclasses import dataclass, field

from .registry import REGISTRY

CONVERTS = {("image", "image"), ("image", "plane"), ("plane", "plane"), ("plane", "image"), ("number", "image"), ("number", "plane"), ("number", "number")}


class GraphError(ValueError):
    pass


@dataclass
class Node:
    id: int
    type: str
    params: dict = field(default_factory=dict)
    muted: bool = False
    label: str = ""
    extra: dict = field(default_factory=dict)

    @property
    def spec(self):
        from .groups import spec_of

        return spec_of(self)


@dataclass(frozen=True)
class Link:
    source: int
    output: int
    target: int
    input: int


class Graph:
    def __init__(self, colour_management: dict | None = None) -> None:
        self.nodes: dict[int, Node] = {}
        self.links: dict[tuple[int, int], Link] = {}
        self.colour_management = colour_management or {}
        self._next = 1

    def add(self, type_: str, node_id: int | None = None, **options) -> Node:
        params, muted, label, extra = options.get("params", {}), options.get("muted", False), options.get("label", ""), options.get("extra", {})
        if type_ not in REGISTRY and not type_.startswith("group."):
            raise GraphError(f"unknown operator {type_}")
        node_id = self._next if node_id is None else int(node_id)
        self._next = max(self._next, node_id) + 1
        node = Node(node_id, type_, {}, muted, label, extra)
        self.nodes[node_id] = node
        node.params = {p.name: p.clean(params[p.name]) if p.name in params else copy.deepcopy(p.default) for p in node.spec.params}
        return node

    def connect(self, source, output, target, input_) -> Link:
        """Wires an output to an input, by number or name; an input's earlier wire goes."""
        a, b = self.nodes[getattr(source, "id", source)], self.nodes[getattr(target, "id", target)]
        pin = lambda pins, p: p if isinstance(p, int) else next(i for i, x in enumerate(pins) if x.name == p)
        out, into = pin(a.spec.outputs, output), pin(b.spec.inputs, input_)
        if not (0 <= out < len(a.spec.outputs) and 0 <= into < len(b.spec.inputs)):
            raise GraphError("no such pin")
        if (a.spec.outputs[out].kind, b.spec.inputs[into].kind) not in CONVERTS:
            raise GraphError(f"{a.spec.outputs[out].kind} doesn't convert to {b.spec.inputs[into].kind}")
        if a.id == b.id or b.id in self.upstream(a.id):
            raise GraphError("a wire would close a cycle")
        link = Link(a.id, out, b.id, into)
        self.links[b.id, into] = link
        return link

    def upstream(self, node_id: int) -> set[int]:
        """All nodes whose results reach ``node_id``."""
        seen, todo = set(), [node_id]
        while todo:
            n = todo.pop()
            for (target, _), link in self.links.items():
                if target == n and link.source not in seen:
                    seen.add(link.source)
                    todo.append(link.source)
        return seen

    def remove(self, node_id: int, bridge: bool = False) -> None:
        """Drops a node; with ``bridge`` its first wired input feeds what it fed where types allow."""
        into = [l for (t, _), l in sorted(self.links.items()) if t == node_id]
        outs = [l for l in self.links.values() if l.source == node_id]
        self.links = {k: l for k, l in self.links.items() if node_id not in (l.source, l.target)}
        del self.nodes[node_id]
        for l in outs if bridge and into else []:
            a = self.nodes[into[0].source].spec.outputs[into[0].output].kind
            if (a, self.nodes[l.target].spec.inputs[l.input].kind) in CONVERTS:
                self.links[l.target, l.input] = Link(into[0].source, into[0].output, l.target, l.input)

    def swap(self, node_id: int, type_: str) -> Node:
        """Another operator in a node's place; parameters and wires of equal names stay."""
        old = self.nodes[node_id]
        ins = {old.spec.inputs[l.input].name: l for (t, _), l in self.links.items() if t == node_id}
        outs = [(old.spec.outputs[l.output].name, l) for l in self.links.values() if l.source == node_id]
        self.links = {k: l for k, l in self.links.items() if node_id not in (l.source, l.target)}
        new = self.add(type_, node_id, params=old.params)
        for name, l in ins.items():
            if any(p.name == name for p in new.spec.inputs):
                self.connect(l.source, l.output, node_id, name)
        for name, l in outs:
            if any(p.name == name for p in new.spec.outputs):
                self.connect(node_id, name, l.target, l.input)
        return new

    def clone(self, ids: set[int]) -> dict[int, int]:
        """Copies nodes and the wires among them; old id to new id."""
        new = {i: self.add(self.nodes[i].type, params=copy.deepcopy(self.nodes[i].params), muted=self.nodes[i].muted, label=self.nodes[i].label, extra=copy.deepcopy(self.nodes[i].extra)).id for i in sorted(ids)}
        for l in list(self.links.values()):
            if l.source in new and l.target in new:
                self.connect(new[l.source], l.output, new[l.target], l.input)
        return new

    def output(self) -> int | None:
        return next((n.id for n in self.nodes.values() if n.type == "io.output"), None)

    def to_json(self) -> dict:
        nodes = [{"id": n.id, "type": n.type, "params": n.params} | ({"muted": True} if n.muted else {}) | ({"label": n.label} if n.label else {}) | ({"extra": n.extra} if n.extra else {}) for n in self.nodes.values()]
        links = [{"id": i, "from": [l.source, l.output], "to": [l.target, l.input]} for i, l in enumerate(self.links.values(), 1)]
        return {"nextId": self._next, "nodes": nodes, "links": links} | ({"colorManagement": self.colour_management} if self.colour_management else {})

    @classmethod
    def from_json(cls, told: dict | str) -> Graph:
        """Unknown operators raise; wires with bad pins are dropped; parameters are made valid."""
        told = json.loads(told) if isinstance(told, str) else told
        told = told.get("graph", told)
        graph = cls(told.get("colorManagement"))
        for n in told.get("nodes", []):
            graph.add(n["type"], n["id"], params=n.get("params") if isinstance(n.get("params"), dict) else {}, muted=bool(n.get("muted")), label=n.get("label", ""), extra=n.get("extra", {}))
        for l in told.get("links", []):
            try:
                graph.connect(l["from"][0], l["from"][1], l["to"][0], l["to"][1])
            except (GraphError, KeyError, IndexError, StopIteration, TypeError):
                continue
        return graph


def difference(old: Graph, new: Graph) -> list[str]:
    """What changed between two graphs, for people to read."""
    told = []
    for i, n in new.nodes.items():
        if i not in old.nodes:
            told.append(f"Add {n.label or n.type}")
        else:
            told += [f"Change {n.label or n.type}: {k}" for k, v in n.params.items() if old.nodes[i].params.get(k) != v]
            if n.muted != old.nodes[i].muted:
                told.append(f"{'Mute' if n.muted else 'Unmute'} {n.label or n.type}")
    told += [f"Remove {n.label or n.type}" for i, n in old.nodes.items() if i not in new.nodes]
    told += ["Connect" for k, l in new.links.items() if old.links.get(k) != l and l.source in old.nodes and l.target in old.nodes]
    told += ["Disconnect" for k in old.links if k not in new.links and k[0] in new.nodes]
    return told
