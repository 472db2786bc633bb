"""Connected components over a table of edges, by alternating star contractions.

Every round is two aggregations and two joins over the edges. A node with more than its share of the
edges is joined apart: such nodes are fewer than there are shuffle partitions, so that they are sent to
all tasks and their edges stay where they are. Lineage is cut in the shared checkpoint folder, a round's
table goes when the next is written, and neither edges nor labels come to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, discard


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _with_least(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``edges`` (a, b) with m, the smallest of a and its neighbours b; and the table of least neighbours."""
    parts = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = cut(edges.groupBy(F.col("a").alias("n")).agg(F.least("n", F.min("b")).alias("m"), F.count("*").alias("degree")))
    share = (met.agg(F.sum("degree")).first()[0] or 0) / parts
    # Fewer than ``parts`` nodes can have more edges than that.
    hot = F.broadcast(met.where(F.col("degree") > max(share, 1)).select("n", "m"))
    cold = met.where(F.col("degree") <= max(share, 1)).select("n", "m")
    on = F.col("a") == F.col("n")
    rest = edges.join(hot, on, "left_anti").join(cold, on)
    return rest.select("a", "b", "m").union(edges.join(hot, on).select("a", "b", "m")), met


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b) -> (node, label): label is the smallest node that can be reached.

    Large-star links every larger neighbour of a node to its smallest neighbour, small-star every
    smaller one; a fixed point is a forest of stars around the smallest nodes. Rounds go on until no
    edge moves; their number grows with the logarithm of the longest path.
    """
    # Stars around smallest nodes stay as they are: equal counts and sums of both ends mean no edge moved.
    of = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    now = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = of(now)
    while True:
        known, met = _with_least(_both(now))
        large = cut(known.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct())
        discard(met, now)
        known, met = _with_least(large)
        small = known.select(F.col("b").alias("a"), F.col("m").alias("b")).union(known.select("a", F.col("m").alias("b")))
        now = cut(small.where("a <> b").distinct())
        discard(met, large)
        after = of(now)
        if after == before:
            break
        before = after
    labels = now.groupBy("a").agg(F.min("b").alias("label"))
    return labels.select(F.col("a").alias("node"), "label").union(labels.select(F.col("label").alias("node"), "label").distinct())
