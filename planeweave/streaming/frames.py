"""Graphs of point operators over a stream of pixels.

A stream of (img, y, x, r, g, b, a) rows is a frame like any other: point operators only add columns,
so their plan runs on ``readStream`` unchanged. Windows and gathers need whole images and are refused.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from planeweave.plans.evaluate import Evaluator, Session
from planeweave.plans.graph import Graph, GraphError
from planeweave.plans.region import padding
from planeweave.sources.tables import pixel_table


def over_stream(graph: Graph, stream: DataFrame, w: int, h: int, node_id: int | None = None) -> DataFrame:
    """The graph's result as a streaming frame."""
    node_id = graph.output() if node_id is None else node_id
    session = Session(stream.sparkSession, {"stream": pixel_table(stream, w, h)})
    if padding(graph, node_id, session) != 0:
        raise GraphError("only operators that work pixel by pixel can run on a stream")
    return Evaluator(graph, session).result(node_id)
