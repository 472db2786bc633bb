"""Lowering of graphs: pulled from the sink, each node once, by signature."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .graph import Graph
from .registry import Call
from .values import Frame, Image, Number, Plane, canvas


@dataclass
class Session:
    """What a graph runs in: the named sources, the default size, and lowered plans by signature.

    ``long_edge``: the edge whose shares the blurs of color.basic and color.tone_equalizer are; without it the picture's own.
    """

    spark: SparkSession
    sources: dict[str, Image] = field(default_factory=dict)
    width: int = 64
    height: int = 64
    plans: dict[str, tuple] = field(default_factory=dict)
    sinks: list = field(default_factory=list)
    long_edge: int | None = None
    _canvas: Frame | None = None

    def canvas(self) -> Frame:
        first = next(iter(self.sources.values()), None)
        if first is not None:
            return first.frame
        if self._canvas is None:
            self._canvas = canvas(self.spark, self.width, self.height)
        return self._canvas


@dataclass
class Context:
    session: Session
    linear: bool
    extra: dict
    node: object
    ports: dict
    scale: float = 1.0

    def canvas(self) -> Frame:
        return self.session.canvas()

    def port(self, call) -> object:
        return self.ports.get(self.node.id)


class Evaluator:
    def __init__(self, graph: Graph, session: Session, ports: dict | None = None) -> None:
        self.graph, self.session, self.ports = graph, session, ports or {}
        self.linear = bool(graph.colour_management.get("linear"))
        self.lowered = 0
        self._done: dict[int, tuple] = {}

    def signature(self, node_id: int) -> str:
        """Type, parameters and inputs' signatures: equal plans are lowered once per session."""
        node = self.graph.nodes[node_id]
        ins = [self.signature(l.source) + str(l.output) if (l := self.graph.links.get((node_id, i))) else "-" for i in range(len(node.spec.inputs))]
        port = str(id(self.ports.get(node_id))) if node_id in self.ports else ""
        return hashlib.sha1(json.dumps([node.type, node.params, node.muted, node.extra, self.linear, port, ins], sort_keys=True, default=str).encode()).hexdigest()

    def value(self, node_id: int, output: int = 0):
        return self.outputs(node_id)[output]

    def outputs(self, node_id: int) -> tuple:
        if node_id in self._done:
            return self._done[node_id]
        signature = self.signature(node_id)
        if signature not in self.session.plans:
            self.session.plans[signature] = self._lower(node_id)
            self.lowered += 1
        self._done[node_id] = self.session.plans[signature]
        return self._done[node_id]

    def _lower(self, node_id: int) -> tuple:
        node = self.graph.nodes[node_id]
        spec = node.spec
        inputs = [self.value(l.source, l.output) if (l := self.graph.links.get((node_id, i))) else None for i in range(len(spec.inputs))]
        if node.muted:
            return self._bypass(spec, inputs)
        context = Context(self.session, self.linear, node.extra, node, self.ports)
        out = spec.lower(Call(spec, node.params, inputs, context))
        out = out if isinstance(out, tuple) else (out,)
        return out + (None,) * (len(spec.outputs) - len(out))

    @staticmethod
    def _bypass(spec, inputs) -> tuple:
        """Each output is the first wired input of its kind, else the first that converts."""
        kinds = {"image": Image, "plane": (Plane, Number), "number": Number}
        return tuple(next((v for v in inputs if isinstance(v, kinds[pin.kind])), next((v for v in inputs if v is not None), None)) for pin in spec.outputs)

    def result(self, node_id: int | None = None, output: int = 0) -> DataFrame | None:
        node_id = self.graph.output() if node_id is None else node_id
        return frame_of(self.value(node_id, output), self.session)


def frame_of(value, session: Session) -> DataFrame | None:
    """A value as rows: (img, y, x, r, g, b, a), (img, y, x, v) or one row (v)."""
    if value is None:
        return None
    if isinstance(value, Number):
        return session.spark.range(1).select(F.lit(float(value.v)).alias("v"))
    names = ["r", "g", "b", "a"] if isinstance(value, Image) else ["v"]
    return value.frame.df.select("img", "y", "x", *[F.col(n).alias(a) for n, a in zip(value.names, names, strict=True)])
