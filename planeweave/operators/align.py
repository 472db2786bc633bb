"""Alignment of exposures by median threshold bitmaps, 64 pixels to a word.

A picture's pixels above its median look alike at any exposure. Grey values are summed into the cells
of a pyramid's second level, those into all coarser ones in one pass; each level's median comes from a histogram of 256 tones, and
bits are packed into words along rows. From the coarsest level to the finest the nine shifts around
twice the last are scored by the bits that differ: words are shifted, met with the reference's by their
place and counted, so no pixel is joined. Grey values are whole numbers, their sums exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from planeweave.plans.lineage import cut

#: Tones, the power that makes them perceptual, tones around the median that are noise, and where a pyramid ends.
TONES, POWER, NOISE, COARSEST, NARROWEST, LEVELS = 256, 1 / 2.2, 4, 64, 8, 10
#: Parts of a tone.
PARTS = 1024


def depth(w: int, h: int) -> int:
    n = 1
    while max(w, h) >= COARSEST and min(w, h) >= NARROWEST and n < LEVELS:
        w, h, n = max(1, w // 2), max(1, h // 2), n + 1
    return n


def bitmaps(df: DataFrame, lights: list[Column], w: int, h: int) -> DataFrame:
    """(img, level, picture, y, k, above, used): words of each picture's bits; bit b of word k is pixel 64 k + b."""
    grey = [F.round(F.pow(F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0)), F.lit(POWER)) * ((TONES - 1) * PARTS)).cast("long").alias(f"g{i}") for i, v in enumerate(lights)]
    cells = df.select("img", F.lit(0).alias("level"), "y", "x", *grey)
    names = [f"g{i}" for i in range(len(lights))]

    def summed(rows: DataFrame, by: int) -> DataFrame:
        """Sums of the cells 2^(level - by) across that lie whole in the picture."""
        at = rows.withColumns({c: F.expr(f"shiftright({c}, level - {by})") for c in ("y", "x")}).where(f"y < shiftright({h}, level) and x < shiftright({w}, level)")
        return at.groupBy("img", "level", "y", "x").agg(*[F.sum(g).alias(g) for g in names])

    if depth(w, h) > 1:
        half = cut(summed(cells.withColumn("level", F.lit(1)), 0))
        cells = cells.union(half)
        if depth(w, h) > 2:
            cells = cells.union(summed(half.withColumn("level", F.explode(F.sequence(F.lit(2), F.lit(depth(w, h) - 1)))), 1).select(cells.columns))
    each = F.inline(F.array(*[F.struct(F.lit(i).alias("picture"), F.col(f"g{i}").alias("v")) for i in range(len(lights))]))
    tones = cells.select("img", "level", "y", "x", each).withColumn("unit", F.expr(f"shiftleft({PARTS}L, 2 * level)"))
    key = ["img", "level", "picture"]
    counts = tones.groupBy(*key, F.least(F.expr("v div unit"), F.lit(TONES - 1)).alias("tone")).agg(F.count("*").alias("n"))
    by = Window.partitionBy(*key)
    upto = F.sum("n").over(by.orderBy("tone").rowsBetween(Window.unboundedPreceding, 0))
    medians = counts.withColumns({"upto": upto, "half": F.expr("sum(n) over (partition by img, level, picture) div 2")}).where("upto >= half").groupBy(*key).agg(F.min("tone").alias("median"))
    away = F.col("v") - F.col("median") * F.col("unit")
    bit = lambda c: F.expr(f"bit_or(shiftleft(cast({c} as bigint), cast(x % 64 as int)))")
    flags = tones.join(F.broadcast(medians), key).withColumns({"over": away > 0, "clear": F.abs(away) > NOISE * F.col("unit")})
    return flags.groupBy(*key, "y", F.expr("cast(x div 64 as int)").alias("k")).agg(bit("over").alias("above"), bit("clear").alias("used"))


def shifts(df: DataFrame, lights: list[Column], reference: DataFrame, w: int, h: int) -> DataFrame:
    """(img, picture, dx, dy): the picture at (x + dx, y + dy) shows what ``reference`` (img, ref) shows at (x, y)."""
    words = cut(bitmaps(df, lights, w, h).join(F.broadcast(reference), "img"))
    found = reference.select("img", "ref", F.explode(F.sequence(F.lit(0), F.lit(len(lights) - 1))).alias("picture")).where("picture != ref").select("img", "picture", F.lit(0).alias("dx"), F.lit(0).alias("dy"))
    for level in range(depth(w, h) - 1, -1, -1):
        at = words.where(F.col("level") == level)
        still = at.where("picture = ref").select("img", "y", "k", F.col("above").alias("r_above"), F.col("used").alias("r_used"))
        tried = F.explode(F.array(*[F.struct(F.lit(j * 3 + i).alias("n"), (2 * F.col("dx") + i - 1).alias("sx"), (2 * F.col("dy") + j - 1).alias("sy")) for j in range(3) for i in range(3)]))
        moved = at.join(F.broadcast(found), ["img", "picture"]).select("img", "picture", "y", "k", "above", "used", tried.alias("t")).select("img", "picture", "above", "used", "t.*", "k", F.expr("y - t.sy").alias("y"))
        moved = moved.withColumns({"by": F.expr("pmod(-sx, 64)"), "to": F.expr("k + cast(floor(-sx / 64) as int)")})
        low = moved.select("img", "picture", "n", "sx", "sy", "y", F.col("to").alias("k"), F.expr("shiftleft(above, by)").alias("above"), F.expr("shiftleft(used, by)").alias("used"))
        high = moved.where("by > 0").select("img", "picture", "n", "sx", "sy", "y", F.expr("to + 1").alias("k"), F.expr("shiftrightunsigned(above, 64 - by)").alias("above"), F.expr("shiftrightunsigned(used, 64 - by)").alias("used"))
        met = low.union(high).groupBy("img", "picture", "n", "sx", "sy", "y", "k").agg(F.bit_or("above").alias("above"), F.bit_or("used").alias("used")).join(still, ["img", "y", "k"])
        both = F.col("used").bitwiseAND(F.col("r_used"))
        differ = F.col("above").bitwiseXOR(F.col("r_above")).bitwiseAND(both)
        costs = met.groupBy("img", "picture", "n", "sx", "sy").agg(F.sum(F.bit_count(differ)).alias("off"), F.sum(F.bit_count(both)).alias("seen")).where("seen > 0")
        # Per compared pixel, so that a large shift doesn't gain by its small overlap; ties stay in the middle.
        best = costs.groupBy("img", "picture").agg(F.min(F.struct(F.expr("off * 1000000 div seen"), (F.col("n") != 4).alias("aside"), "n", "sx", "sy")).alias("best"))
        found = found.join(best, ["img", "picture"], "left")
        found = cut(found.select("img", "picture", F.coalesce("best.sx", 2 * F.col("dx")).alias("dx"), F.coalesce("best.sy", 2 * F.col("dy")).alias("dy")))
    return found
