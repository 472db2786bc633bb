"""Mixing sources to target weights by entropy balancing.

Document rates stay as near 1 as relative entropy allows while every source's words meet its target
and no rate exceeds ``cap``: rate = min(cap, exp(lambda * size / mean size)), with one multiplier
per source. The dual is convex; damped Newton steps on it, bracketed by bisection, run as distributed
sums over the (source, size) histogram. Sums are taken over fixed-point integers, so neither the
order of rows nor a rerun changes a result.

Rates become copies by systematic rounding along each source's documents in order of size: running
sums of the fractions are made within range partitions and joined by the partitions' totals, so a
source that holds most rows is spread over many tasks. One document per source has a copy more or less
where that takes up what rounding left. Documents are taken whole: a source's words miss its target by
up to half a document, and more where it has only one or two.

Defined results: null or empty text has size 0 and takes nothing; a null source comes last; a source
without words has target 0; rows that repeat a doc_id are rows of their own; an empty table gives an
empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_words, cut, discard, written

UNIT = 1 << 20
PROBES = 15
#: Rows of a table by source that are sent to every task.
FEW = 100_000


def running(rows: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """``rows`` with the sums over all rows before each in ``order``, which must not tie.

    Ranges of rows are summed apart and joined by their totals, as many as there are shuffle partitions.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = written(rows.repartitionByRange(parts, *order).withColumn("range", F.spark_partition_id()))
    earlier = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy(F.col("range").alias("o_range")).agg(*[F.sum(c).alias(f"o_{k}") for k, c in sums.items()]).withColumnRenamed("o_range", "range")
    offsets = totals.select(F.col("range").alias("o_range"), *[F.coalesce(F.sum(f"o_{k}").over(earlier), F.lit(0)).alias(f"o_{k}") for k in sums])
    inside = Window.partitionBy("range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    joined = ranged.join(F.broadcast(offsets), F.col("range") == F.col("o_range"))
    added = joined.withColumns({k: F.coalesce(F.sum(c).over(inside), F.lit(0)) + F.col(f"o_{k}") for k, c in sums.items()})
    return added.drop("range", "o_range", *[f"o_{k}" for k in sums])


def targets(sizes: DataFrame, weights: tuple[float, ...], cap: float) -> DataFrame:
    """source, source_size, mean size and target; ``sizes`` has one row per document.

    The shares that stop at ``cap`` times a source's size are those below the water level t for which
    sum(min(cap * size, weight * t)) is all words; the level is found by one pass in order of
    cap * size / weight. Any number of sources: both orders are kept in ranges.
    """
    by_source = F.col("source").asc_nulls_last()
    per = running(sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")), [by_source], {"nth": F.lit(1)})
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("nth"), F.lit(len(weights))) + 1).cast("int"))
    per = per.withColumn("weight", weight).withColumn("most", F.col("source_size") * F.lit(float(cap))).withColumn("fills", F.col("most") / F.col("weight"))
    per = written(running(per, [F.col("fills").asc(), by_source], {"before": F.col("most"), "lighter": F.col("weight")}))
    of = per.agg(F.sum("source_size").alias("words"), F.sum("weight").alias("weight")).first()
    tide = (F.lit(float(of["words"] or 0)) - F.col("before")) / (F.lit(float(of["weight"] or 0)) - F.col("lighter"))
    free = per.withColumn("tide", tide).where(F.col("tide") * F.col("weight") <= F.col("most"))
    water = free.agg(F.min(F.struct("fills", "tide")).alias("first")).first()["first"]
    target = F.col("most") if water is None else F.least(F.col("most"), F.col("weight") * F.lit(float(water["tide"])))
    return per.select("source", "source_size", (F.col("source_size") / F.col("n")).alias("mean_size"), target.alias("target"))


def _rate(multiplier: Column, size: Column, mean: Column, cap: float) -> Column:
    return F.least(F.lit(float(cap)), F.exp(F.least(multiplier * size / mean, F.lit(60.0))))


def balanced(histogram: DataFrame, goals: DataFrame, cap: float) -> DataFrame:
    """``goals`` with the multiplier of every source: Newton's steps within a bracket.

    Each round reads the words at Newton's point and at ``PROBES`` points between the bracket's ends, so
    the bracket shrinks to less than a sixteenth a round whatever Newton's steps do, and the loop ends.
    """
    fixed = lambda c: F.sum(F.round(c * UNIT).cast("decimal(38,0)")).cast("double") / UNIT
    top = 64.0
    state = cut(
        goals.select(
            "*", F.lit(-top).alias("low"), F.lit(top).alias("high"),
            # Nothing to solve: no words, or every rate is at the cap.
            ((F.col("source_size") == 0) | (F.col("target") >= cap * F.col("source_size"))).alias("done"),
        ).withColumn("multiplier", F.when(F.col("target") >= cap * F.col("source_size"), F.lit(float("inf"))).otherwise(0.0))
    )
    at = [F.col("multiplier"), *(F.col("low") + (F.col("high") - F.col("low")) * (j / (PROBES + 1)) for j in range(1, PROBES + 1))]
    while not state.where("not done").isEmpty():
        open_ = state.where("not done")
        rows = histogram.join(open_, histogram["source"].eqNullSafe(open_["source"])).drop(histogram["source"])
        words = [F.col("n") * F.col("size") * _rate(x, F.col("size"), F.col("mean_size"), cap) for x in at]
        free = _rate(at[0], F.col("size"), F.col("mean_size"), cap) < cap
        sums = rows.groupBy(F.col("source").alias("s_source")).agg(
            *[fixed(w).alias(f"words_{j}") for j, w in enumerate(words)], fixed(F.when(free, words[0] * F.col("size") / F.col("mean_size"))).alias("slope")
        )
        moved = state.join(sums, state["source"].eqNullSafe(sums["s_source"]), "left")
        excess = [F.col(f"words_{j}") - F.col("target") for j in range(len(at))]
        low = F.greatest("low", *(F.when(e < 0, x) for e, x in zip(excess, at, strict=True)))
        high = F.least("high", *(F.when(e > 0, x) for e, x in zip(excess, at, strict=True)))
        narrowed = moved.select("source", "source_size", "mean_size", "target", "multiplier", "done", low.alias("low"), high.alias("high"), excess[0].alias("excess"), "slope")
        newton = F.col("multiplier") - F.when(F.col("slope") > 0, F.col("excess") / F.col("slope"))
        step = F.when((newton > F.col("low")) & (newton < F.col("high")), newton).otherwise((F.col("low") + F.col("high")) / 2)
        # Within half a word, or as near as the bracket can tell.
        done = F.col("done") | F.coalesce((F.abs("excess") <= 0.5) | (F.col("high") - F.col("low") < 1e-12), F.lit(True))
        state, last = cut(narrowed.withColumn("multiplier", F.when(done, F.col("multiplier")).otherwise(step)).withColumn("done", done).drop("excess", "slope")), state
        discard(last)
    return state


def rounded(docs: DataFrame, part: str) -> DataFrame:
    """``docs`` (source, size, rate, order) with whole ``copies``: floor, or one more where the running
    sum of fractions in order of size passes a whole number. ``part`` numbers rows' range partitions."""
    known = docs.withColumn("part_of_one", F.floor((F.col("rate") - F.floor("rate")) * UNIT).cast("long"))
    totals = known.groupBy("source", part).agg(F.sum("part_of_one").alias("sum"))
    before = F.coalesce(F.sum("sum").over(Window.partitionBy("source").orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = totals.select(F.col("source").alias("o_source"), F.col(part).alias("o_part"), before.alias("offset"))
    run = Window.partitionBy("source", part).orderBy("size", "order", "row")
    upto = F.sum("part_of_one").over(run.rowsBetween(Window.unboundedPreceding, 0)) + F.col("offset") + UNIT // 2
    joined = known.join(offsets, known["source"].eqNullSafe(offsets["o_source"]) & (known[part] == offsets["o_part"]))
    summed = joined.withColumn("upto", upto)
    extra = F.floor(F.col("upto") / UNIT) - F.floor((F.col("upto") - F.col("part_of_one")) / UNIT)
    return summed.withColumn("copies", (F.floor("rate") + extra).cast("long")).drop("o_source", "o_part", "offset", "upto", "part_of_one")


def _sent(per_source: DataFrame) -> DataFrame:
    """A written table of a row per source, sent to all tasks up to ``FEW`` rows, so that no source's
    documents meet in one task; beyond that joined by key, where Spark splits a skewed one."""
    return F.broadcast(per_source) if per_source.count() <= FEW else per_source


def drawn(docs: DataFrame, weights: tuple[float, ...], cap: float) -> DataFrame:
    """Every document with its source's target, its rate and whole copies."""
    spark = docs.sparkSession
    sized = written(docs.select("doc_id", "source", F.xxhash64("text").alias("text_hash"), F.size(ascii_words(F.col("text"))).cast("long").alias("size")))
    solved = balanced(sized.groupBy("source", "size").agg(F.count("*").alias("n")), targets(sized, weights, cap), cap)
    solved = solved.select(F.col("source").alias("s_source"), "source_size", "mean_size", "target", "multiplier")
    rate = F.when(F.col("size") > 0, F.when(F.col("multiplier") == float("inf"), F.lit(float(cap))).otherwise(_rate(F.col("multiplier"), F.col("size"), F.col("mean_size"), cap))).otherwise(0.0)
    rated = sized.join(_sent(written(solved)), F.col("source").eqNullSafe(F.col("s_source"))).drop("s_source").withColumn("rate", rate)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = rated.withColumn("order", F.xxhash64("doc_id"))
    ranged = written(
        keyed.repartitionByRange(parts, F.col("source"), F.col("size"), F.col("order")).withColumns({"part": F.spark_partition_id(), "row": F.monotonically_increasing_id()})
    )
    whole = written(rounded(ranged, "part"))
    discard(sized, ranged)
    return whole


def source_mix(docs: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), cap: float = 3.0) -> DataFrame:
    """doc_id, source, size, source_size, target, rate, copies, taken (copies times size), text_hash.

    One row per document, none of them taken in part: rates rounded into copies. The one document of
    each source whose size is nearest to what rounding left has a copy more or less, where that brings
    the source's words nearer to their target.
    """
    whole = drawn(docs, weights, cap)
    gaps = written(whole.groupBy("source").agg((F.max("target") - F.sum(F.col("copies") * F.col("size"))).alias("gap")).withColumnRenamed("source", "g_source"))
    left = whole.join(_sent(gaps), F.col("source").eqNullSafe(F.col("g_source")))
    off = F.abs(F.abs("gap") - F.col("size"))
    able = F.when(F.col("gap") > 0, F.col("copies") + 1 <= cap).otherwise(F.col("copies") > 0)
    nearest = left.where(able & (off < F.abs("gap"))).groupBy("source").agg(F.min(F.struct(off.alias("off"), "order", "doc_id", "row")).alias("one"), F.max(F.signum("gap")).cast("long").alias("more"))
    nearest = _sent(written(nearest.select(F.col("one.row").alias("c_row"), "more")))
    copies = F.col("copies") + F.coalesce("more", F.lit(0))
    out = whole.join(nearest, F.col("row") == F.col("c_row"), "left").withColumn("copies", copies)
    return out.select("doc_id", "source", "size", "source_size", "target", "rate", "copies", (F.col("copies") * F.col("size")).alias("taken"), "text_hash")
