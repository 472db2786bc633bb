"""Spots: healing them by a membrane over their edge, and finding dust."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from planeweave.functions import maths as m
from planeweave.plans.values import Image

from .library import grouped
from .stencil import blurred

#: Fixed values of healing: places along the edge, reach of the cross that each averages (by the radius,
#: a pixel at least), least squared distance by the squared radius, and what keeps logarithms finite.
EDGE, CROSS, CLOSEST, DARKEST = 64, 0.04, 1e-4, 1e-3
#: Fixed values of dust: largest radius by the longer edge (three pixels at least), blurs of lightness, of
#: the background and of texture (by that radius), contrast at sensitivity 0 and its share at 100, texture
#: that contrast must exceed, longest shape and least share of its box, the circle's growth, and how many.
DUST_SIZE, DUST_FINE, DUST_WIDE, DUST_TEXTURE, DUST_CONTRAST, DUST_SHARE, DUST_ABOVE, DUST_LONG, DUST_FULL, DUST_GROWN, DUST_MOST = 0.012, 0.8, 1.5, 3.0, 0.04, 0.125, 3.0, 2.5, 0.5, (1.8, 2.0), 60


def _taps(x: float, y: float, w: int, h: int) -> list[tuple[int, int, float]]:
    """(y, x, weight) of a bilinear sample, coordinates held to the image."""
    x, y = min(max(x - 0.5, 0.0), w - 1.0), min(max(y - 0.5, 0.0), h - 1.0)
    fx, fy = x - math.floor(x), y - math.floor(y)
    return [(min(int(y) + j, h - 1), min(int(x) + i, w - 1), (fx if i else 1 - fx) * (fy if j else 1 - fy)) for j in (0, 1) for i in (0, 1)]


def membrane(image: Image, linear: bool, centre: tuple[float, float], offset: tuple[float, float], r: float) -> list[Column]:
    """What to add to copied colours (to their logarithms in linear light) so that they meet the surroundings.

    At ``EDGE`` places around the circle the colours there and at the source are averaged over a small
    cross; their differences are spread over the inside by inverse squared distances. The places' pixels
    are a table of constant size, met with the image by a join; an image's differences are one short row.
    """
    frame, (cx, cy), (ox, oy) = image.frame, centre, offset
    ring = [(cx + r * math.cos(2 * math.pi * k / EDGE), cy + r * math.sin(2 * math.pi * k / EDGE)) for k in range(EDGE)]
    soft, weights = max(1.0, r * CROSS), {}
    for k, (x, y) in enumerate(ring):
        for side in (0, 1):
            for dx, dy in ((0, 0), (soft, 0), (-soft, 0), (0, soft), (0, -soft)):
                for ty, tx, v in _taps(x + dx + side * ox, y + dy + side * oy, frame.w, frame.h):
                    weights[k, side, ty, tx] = weights.get((k, side, ty, tx), 0.0) + v / 5
    spark = frame.df.sparkSession
    taps = F.broadcast(spark.createDataFrame([(*key, v) for key, v in weights.items() if v], "k int, side int, t_y int, t_x int, v double"))
    met = frame.df.select("img", "y", "x", *[F.col(n).alias(c) for n, c in zip(image.names, "rgb", strict=False)]).join(taps, (F.col("y") == F.col("t_y")) & (F.col("x") == F.col("t_x")))
    work = (lambda v: F.log(m.biggest(v, 0.0) + DARKEST)) if linear else (lambda v: v)
    at = lambda c, side: work(F.sum(F.when(F.col("side") == side, F.col(c) * F.col("v"))))
    edge = met.groupBy("img", "k").agg(*[(at(c, 0) - at(c, 1)).alias(c) for c in "rgb"])
    # EDGE rows an image, in order.
    lists = edge.groupBy("img").agg(F.array_sort(F.collect_list(F.struct("k", *"rgb"))).alias("edge"))
    key, told = frame.name(), frame.name()
    lists = lists.select(F.col("img").alias(key), F.col("edge").alias(told))
    frame.df = frame.df.join(lists, F.col("img") == F.col(key), "left").drop(key)
    px, py = F.col("x") + 0.5, F.col("y") + 0.5
    places = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ring])
    pulls = F.transform(places, lambda p: 1.0 / ((px - p["x"]) * (px - p["x"]) + (py - p["y"]) * (py - p["y"]) + CLOSEST * r * r))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v)
    (pull,) = frame.add(F.when(m.hypot(px - cx, py - cy) < r, pulls))
    spread = lambda c: total(F.zip_with(F.col(told), F.col(pull), lambda e, v: e[c] * v)) / total(F.col(pull))
    return [F.col(n) for n in frame.add(*map(spread, "rgb"))]


def healed(copied: Column, added: Column, linear: bool) -> Column:
    return F.exp(F.log(m.biggest(copied, 0.0) + DARKEST) + added) - DARKEST if linear else copied + added


def dust(image: Image, sensitivity: float = 50.0, linear: bool = False) -> DataFrame:
    """(img, x, y, radius, score) of small, round, soft spots darker than a smooth background; the clearest first ``DUST_MOST`` of an image.

    Places are shares of width and height, radii of the longer edge. Pixels are candidates where lightness
    lies far enough below its wide blur, by contrast and by texture; neighbouring ones are joined to blobs by
    label hopping, and blobs judged by size, shape and distance from the frame.
    """
    frame, longest = image.frame, max(image.frame.w, image.frame.h)
    if min(frame.w, frame.h) < 16:
        return frame.df.select("img", *[F.lit(0.0).alias(c) for c in ("x", "y", "radius", "score")]).limit(0)
    largest = max(3.0, DUST_SIZE * longest)
    light = m.clamp01(F.nanvl(m.luma(*image.rgb), F.lit(0.0)))
    given = frame.add(m.to_srgb(light) if linear else light)
    (fine,), (wide,) = blurred(frame, given, DUST_FINE, DUST_FINE), blurred(frame, given, largest * DUST_WIDE, largest * DUST_WIDE)
    (texture,) = blurred(frame, frame.add(F.abs(F.col(fine) - F.col(wide))), largest * DUST_TEXTURE, largest * DUST_TEXTURE)
    need = DUST_CONTRAST * DUST_SHARE ** (min(max(sensitivity, 0.0), 100.0) / 100)
    depth = F.col(wide) - F.col(fine)
    spots = frame.df.where((depth > need) & (depth > DUST_ABOVE * F.col(texture))).select("img", "y", "x", depth.alias("d"))
    # Pixels are numbered within their image; links keep to it.
    node = lambda y, x: F.struct("img", y.alias("y"), x.alias("x"))
    right = spots.select("img", "y", "x", F.explode(F.array(F.struct(F.lit(0).alias("j"), F.lit(1).alias("i")), F.struct(F.lit(1).alias("j"), F.lit(0).alias("i")))).alias("s"))
    right = right.select(node(F.col("y"), F.col("x")).alias("a"), node(F.col("y") + F.col("s.j"), F.col("x") + F.col("s.i")).alias("b"))
    links = right.join(spots.select(node(F.col("y"), F.col("x")).alias("b")), "b", "left_semi")
    labels = grouped(links).select(F.col("idx").alias("p"), "group_id")
    own = node(F.col("y"), F.col("x"))
    marked = spots.withColumn("p", own).join(labels, "p", "left").withColumn("blob", F.coalesce("group_id", "p"))
    edge = (F.col("x") == 0) | (F.col("y") == 0) | (F.col("x") == frame.w - 1) | (F.col("y") == frame.h - 1)
    mean = lambda c: F.sum((F.col(c) + 0.5) * F.col("d")) / F.sum("d")
    long = lambda c: F.max(c) - F.min(c) + 1
    blobs = marked.groupBy("img", "blob").agg(mean("x").alias("cx"), mean("y").alias("cy"), F.count("*").alias("n"), F.max("d").alias("peak"), F.bool_or(edge).alias("edge"), long("x").alias("bw"), long("y").alias("bh"))
    size = F.sqrt(F.col("n") / math.pi)
    kept = blobs.where(~F.col("edge") & (size <= largest) & (F.greatest("bw", "bh") <= DUST_LONG * F.least("bw", "bh")) & (F.col("n") >= DUST_FULL * F.col("bw") * F.col("bh")))
    by, more = DUST_GROWN
    found = kept.select("img", (F.col("cx") / frame.w).alias("x"), (F.col("cy") / frame.h).alias("y"), m.clamp((size * by + more) / longest, 0.003, 0.3).alias("radius"), (F.col("peak") * F.col("n")).alias("score"))
    # A report of the clearest: no more than that are kept of an image.
    nth = F.row_number().over(Window.partitionBy("img").orderBy(F.desc("score"), "y", "x"))
    return found.withColumn("nth", nth).where(F.col("nth") <= DUST_MOST).drop("nth")
