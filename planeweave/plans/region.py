"""Regions: a rectangle of a result without the rest of the image.

The rectangle goes from the sink to the sources, grown on the way by every operator's reach; sources
are cut to it before any window sees them, and the result is cut to the rectangle itself. A region
equals the crop of the whole because coordinates and sizes stay those of the whole image; operators
of unbounded reach take the whole source. Edges of the grown rectangle only feed rows outside it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .evaluate import Evaluator, Session
from .graph import Graph
from .registry import Call
from .values import Frame, Image


def padding(graph: Graph, node_id: int, session: Session) -> int | None:
    """Pixels around the region that its sources must have; None for all."""
    node = graph.nodes[node_id]
    frame = session.canvas()
    call = Call(node.spec, node.params, [next(iter(session.sources.values()), None)], None)
    call._frame = frame
    own = 0 if node.muted else node.spec.reach(call)
    below = [padding(graph, l.source, session) for (t, _), l in graph.links.items() if t == node_id]
    return None if own is None or None in below else own + max(below, default=0)


def cut(image: Image, x0: int, y0: int, x1: int, y1: int) -> Image:
    """The image's rows inside a rectangle, size and positions unchanged."""
    old = image.frame
    inside = F.col("x").between(x0, x1 - 1) & F.col("y").between(y0, y1 - 1)
    frame = Frame(old.df.where(inside).select("img", "y", "x", *[F.col(n).alias(f"z{k}") for k, n in enumerate(image.names)]), old.w, old.h)
    return frame.image(*(F.col(f"z{k}") for k in range(4)))


def region(graph: Graph, session: Session, rect: tuple[int, int, int, int], node_id: int | None = None) -> DataFrame:
    """The rectangle (x, y, width, height) of a node's image."""
    node_id = graph.output() if node_id is None else node_id
    x, y, w, h = rect
    pad = padding(graph, node_id, session)
    sources = session.sources
    if pad is not None:
        sources = {k: cut(v, x - pad, y - pad, x + w + pad, y + h + pad) for k, v in sources.items()}
    run = Evaluator(graph, Session(session.spark, sources, session.width, session.height, long_edge=session.long_edge))
    return run.result(node_id).where(F.col("x").between(x, x + w - 1) & F.col("y").between(y, y + h - 1))
