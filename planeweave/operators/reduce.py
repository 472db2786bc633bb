"""Reductions over pixels: exact ranks, histograms, means, hashes and smaller copies."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from planeweave.functions.maths import clamp01, luma
from planeweave.plans.values import Frame, Image

#: How far around a rank values are looked at: a share of all values on either side.
NEAR = 0.001


def rank_of(share: float) -> tuple[float, Callable[[Column], Column]]:
    """A percentile's place among n values (nearest, half up): its share and the 0-based rank by n."""
    held = min(max(share, 0.0), 1.0)
    return held, lambda n: F.floor(held * (n - 1) + 0.5)


def top_rank(part: int) -> tuple[float, Callable[[Column], Column]]:
    """The place above which one in ``part`` values lie, at least one."""
    return 1.0 - 1.0 / part, lambda n: n - F.greatest(F.lit(1), F.floor(n / part))


def exact_ranks(df: DataFrame, column: str, ranks: dict[str, tuple[float, Callable[[Column], Column]]], about: int) -> DataFrame:
    """(img, one column per name): the value at each 0-based rank of every image's values; nulls don't count.

    Approximate percentiles bracket each rank; a second pass counts what lies below a bracket and orders
    only the distinct values in it, about two thousandths of all (``about`` of them are expected).
    """
    value = df.select("img", F.col(column).alias("v")).where("v is not null")
    near = NEAR + 8.0 / max(about, 1)
    names = list(ranks)
    ends = [min(max(share + way * near, 0.0), 1.0) for share, _ in ranks.values() for way in (-1, 1)]
    bracket = value.groupBy("img").agg(F.percentile_approx("v", F.array(*map(F.lit, ends)), 20_000).alias("at"), F.count("*").alias("n"))
    wanted = F.array(*[F.struct(F.lit(k).alias("name"), F.col("at")[2 * i].alias("lo"), F.col("at")[2 * i + 1].alias("hi"), ranks[k][1](F.col("n")).cast("long").alias("rank")) for i, k in enumerate(names)])
    bracket = bracket.select(F.col("img").alias("b_img"), wanted.alias("wanted"))
    told = value.join(bracket, F.col("img") == F.col("b_img")).select("img", "v", F.inline("wanted")).where(F.col("v") <= F.col("hi"))
    # What lies below a bracket is one value for the counts.
    inside = told.groupBy("img", "name", "rank", F.when(F.col("v") >= F.col("lo"), F.col("v")).alias("v")).agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("img", "name").orderBy(F.col("v").asc_nulls_first()))
    found = inside.withColumn("upto", upto).where((F.col("rank") < F.col("upto")) & (F.col("rank") >= F.col("upto") - F.col("n")))
    return found.groupBy("img").agg(*[F.max(F.when(F.col("name") == name, F.col("v"))).alias(name) for name in names])


def histogram(image: Image) -> DataFrame:
    """(img, channel, bin, n): 256 bins of red, green, blue and luminance."""
    each = F.array(*[F.struct(F.lit(c).alias("channel"), v.alias("v")) for c, v in (*zip("rgb", image.rgb, strict=True), ("luma", luma(*image.rgb)))])
    return image.frame.df.select("img", F.inline(each)).groupBy("img", "channel", F.floor(clamp01(F.col("v")) * 255 + 0.5).cast("int").alias("bin")).agg(F.count("*").alias("n"))


def area_average(image: Image, x0: int, y0: int, x1: int, y1: int) -> DataFrame:
    """Mean colour of a rectangle, both ends included, held to the image."""
    w, h = image.frame.w, image.frame.h
    x0, x1, y0, y1 = (min(max(v, 0), n - 1) for v, n in ((x0, w), (x1, w), (y0, h), (y1, h)))
    inside = F.col("x").between(x0, x1) & F.col("y").between(y0, y1)
    return image.frame.df.where(inside).groupBy("img").agg(*[F.avg(n).alias(c) for c, n in zip("rgb", image.names, strict=False)])


def extent(image: Image) -> DataFrame:
    """Least and greatest of each channel."""
    return image.frame.df.groupBy("img").agg(*[f(n).alias(f"{c}_{a}") for c, n in zip("rgba", image.names, strict=True) for a, f in (("min", F.min), ("max", F.max))])


def airlight(image: Image) -> DataFrame:
    """Mean colour of the pixels whose least channel is among the top thousandth."""
    frame = image.frame
    (dark,) = frame.add(F.least(*map(clamp01, image.rgb)))
    least = exact_ranks(frame.df, dark, {"least": top_rank(1000)}, frame.w * frame.h).withColumnRenamed("img", "l_img")
    bright = frame.df.join(least, F.col("img") == F.col("l_img")).where(F.col(dark) >= F.col("least"))
    return bright.groupBy("img").agg(*[F.avg(clamp01(c)).alias(a) for c, a in zip(image.rgb, "rgb", strict=True)])


def picture_hash(image: Image) -> DataFrame:
    """(img, hash): 64 bits, each whether one of 9x8 cells is darker than the next to its right."""
    frame = image.frame
    grey = 0.299 * image.rgb[0] + 0.587 * image.rgb[1] + 0.114 * image.rgb[2]
    cells = frame.df.groupBy("img", F.floor(F.col("y") * 8 / frame.h).cast("int").alias("row"), F.floor(F.col("x") * 9 / frame.w).cast("int").alias("cell")).agg(F.avg(grey).alias("v"))
    after = cells.withColumn("next", F.lead("v").over(Window.partitionBy("img", "row").orderBy("cell"))).where("cell < 8")
    bit = F.when(F.col("v") < F.col("next"), F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("row") * 8 + F.col("cell")).cast("int"))).otherwise(F.lit(0).cast("long"))
    return after.groupBy("img").agg(F.bit_or(bit).alias("hash"))


def shrunk(image: Image, longest: int) -> Image:
    """A copy whose longer side is at most ``longest``, by means of whole blocks."""
    old = image.frame
    s = max(1, -(-max(old.w, old.h) // longest))
    means = old.df.groupBy("img", F.floor(F.col("y") / s).cast("int").alias("y"), F.floor(F.col("x") / s).cast("int").alias("x")).agg(*[F.avg(n).alias(f"s{k}") for k, n in enumerate(image.names)])
    frame = Frame(means, -(-old.w // s), -(-old.h // s))
    return frame.image(*(F.col(f"s{k}") for k in range(4)))


#: Fixed values of file hashes: where they start, and their factor.
HASH_START, HASH_FACTOR = 1469598103934665603, 1099511628211


def folded(raw: bytes) -> int:
    """The file hash of a file's bytes: each is mixed in, the length last; 0 becomes 1."""
    h = HASH_START
    for b in (*raw, len(raw)):
        h = (h ^ b) * HASH_FACTOR & 0xFFFFFFFFFFFFFFFF
    return h or 1


def file_hash(content: Column) -> Column:
    """``folded`` of every file, as a signed 64-bit value; step by step over all files of a batch at once."""

    @F.pandas_udf("long")
    def fold(files: pd.Series) -> pd.Series:
        raws = [bytes(x or b"") for x in files]
        order = np.argsort([-len(x) for x in raws], kind="stable")
        lengths = np.array([len(raws[k]) for k in order], dtype=np.uint64)
        h = np.full(len(raws), HASH_START, dtype=np.uint64)
        cells = np.frombuffer(b"".join(raws[k] for k in order), np.uint8)
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)
        factor = np.uint64(HASH_FACTOR)
        with np.errstate(over="ignore"):
            # Files that are long enough come first, so each step is one slice.
            longer = len(raws) - np.searchsorted(lengths[::-1], np.arange(int(lengths.max(initial=0))), side="right")
            for at, n in enumerate(longer.tolist()):
                if n == 1:
                    break
                h[:n] = (h[:n] ^ cells[starts[:n] + at]) * factor
            else:
                at = len(longer)
            if len(raws):
                one = int(h[0])
                for b in raws[order[0]][at:]:
                    one = (one ^ b) * HASH_FACTOR & 0xFFFFFFFFFFFFFFFF
                h[0] = np.uint64(one)
            h = (h ^ lengths) * factor
        out = np.empty_like(h)
        out[order] = np.where(h == 0, np.uint64(1), h)
        return pd.Series(out.view(np.int64))

    return fold(content)
