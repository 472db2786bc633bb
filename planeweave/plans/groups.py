"""Groups: a graph inside a node, with pins and sliders of its own."""

from __future__ import annotations

from .registry import REGISTRY, Param, Pin, Spec

#: Nodes inside a group that stand for its pins; ``extra`` holds their number.
PORTS = {
    "group.input": Spec("group.input", (), (Pin("Value", "image"),), (), lambda call: (call.context.port(call),)),
    "group.output": Spec("group.output", (Pin("Value", "image"),), (Pin("Value", "image"),), (), lambda call: (call.inputs[0],)),
    "group.value_input": Spec("group.value_input", (), (Pin("Value", "number"),), (), lambda call: (call.context.port(call),)),
    "group.value_output": Spec("group.value_output", (Pin("Value", "plane"),), (Pin("Value", "plane"),), (), lambda call: (call.inputs[0],)),
}


def spec_of(node) -> Spec:
    if node.type in PORTS:
        return PORTS[node.type]
    if node.type != "group.group":
        return REGISTRY[node.type]
    inner = node.extra.get("graph", {})
    ports = sorted(inner.get("nodes", []), key=lambda n: (n.get("extra", {}).get("port", 0), n["id"]))
    name = lambda n, i: n.get("label") or f"{n['type'].rsplit('_', 1)[-1]} {i + 1}"
    ins = [n for n in ports if n["type"] in ("group.input", "group.value_input")]
    outs = [n for n in ports if n["type"] in ("group.output", "group.value_output")]
    params = tuple(Param(name(n, i), "float", float(n.get("extra", {}).get("default", 0.0)), *map(float, n.get("extra", {}).get("range", (0.0, 1.0)))) for i, n in enumerate(ins) if n["type"] == "group.value_input")
    inputs = tuple(Pin(name(n, i), "image" if n["type"] == "group.input" else "plane", None if n["type"] == "group.input" else name(n, i)) for i, n in enumerate(ins))
    outputs = tuple(Pin(name(n, i), "image" if n["type"] == "group.output" else "plane") for i, n in enumerate(outs))
    return Spec("group.group", inputs, outputs, params, _lower)


def _lower(call):
    from .evaluate import Evaluator
    from .graph import Graph

    inner = Graph.from_json(call.context.extra["graph"])
    order = sorted(inner.nodes.values(), key=lambda n: (n.extra.get("port", 0), n.id))
    ins = [n for n in order if n.type in ("group.input", "group.value_input")]
    outs = [n for n in order if n.type in ("group.output", "group.value_output")]
    given = {}
    for n, pin, value in zip(ins, call.spec.inputs, call.inputs, strict=True):
        from .values import Number

        given[n.id] = Number(call.params[pin.param]) if value is None and pin.param else value
    run = Evaluator(inner, call.context.session, ports=given)
    return tuple(run.value(n.id, 0) for n in outs)
