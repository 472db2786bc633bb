"""Quality rules whose limits adapt to each language and source (DataFrame functions only).

Every text is parsed once into a narrow table of counts. Each rate is then summarised by a
log-bucket quantile sketch: a count per bucket, so sketches of partitions, sources and languages
merge by addition. Only texts that pass the base rule are in a sketch. No limit is a fixed rate.

Rates that are 0 in most texts have no quartiles to speak of, and one sign in a short text is not a
rate. So a group's yardstick is its unit, one event in its median text; what lies at or below counts as
none. Two things set a limit. Of the texts that show a rate at all: their upper quartile times a
power of its ratio to the lower one (a quartile fence of logarithms, as rates are skewed). And of all texts: the first gap of the sketch above the upper
quartile in which rates grow ``gap``-fold without any text between, taken at its middle; it parts
another kind of text from the rest. Without either there is no limit. Groups with little support use
the merged sketch of their language, then of everything.

Defined results: a null or empty text has no words and fails the base rule; null ``lang`` or
``source`` is a group of its own; repeated rows are rows of their own; an empty table gives an
empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_words, written

SYMBOLS = "#*$%&|<>"
#: Rates in ten-thousandths (word length: hundredths of a character) and what they are shares of.
RATES = {"symbol_rate": "word_chars", "dup_line_rate": "n_lines", "repeat_rate": "n_words", "word_length": None}
#: The limit of a group that has none.
NONE = 1e12
GAMMA = 1.04


def counted(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the base counts of every text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    words = docs.select("doc_id", "lang", "source", text.alias("text"), ascii_words(F.col("text")).alias("words"))
    lines = F.filter(F.split(F.col("text"), "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    n = F.size("words")
    grams = words.select(
        "doc_id", "lang", "source",
        n.cast("long").alias("n_words"),
        F.length(F.regexp_replace("text", r"[\x20\x09-\x0D]+", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("text", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        lines.alias("lines"),
        F.when(
            n >= 3,
            F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get("words", i), F.get("words", i + 1), F.get("words", i + 2))),
        ).otherwise(F.array().cast("array<bigint>")).alias("grams"),
    )
    # Only texts with a repeated window pay for the sort that finds where.
    repeated = F.size(F.array_distinct("grams")) < F.size("grams")
    placed = grams.select(
        "doc_id", "lang", "source", "n_words", "word_chars", "n_symbols",
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(repeated, F.sort_array(F.transform("grams", lambda h, i: F.struct(h.alias("h"), i.alias("p"))))).alias("places"),
    )
    twice = F.filter("places", lambda s, i: (F.get("places", i - 1)["h"] == s["h"]) | (F.get("places", i + 1)["h"] == s["h"]))
    starts = placed.withColumn("starts", F.sort_array(F.transform(twice, lambda s: s["p"]))).drop("places")
    covered = F.aggregate(F.transform("starts", lambda p, i: F.least(F.lit(3), F.coalesce(F.get("starts", i + 1) - p, F.lit(3)))), F.lit(0), lambda a, x: a + x)
    return starts.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("starts")


def bucket(value: Column) -> Column:
    """Bucket of the sketch: 0 holds 0, bucket k > 0 holds GAMMA^(k-2) < value <= GAMMA^(k-1)."""
    return F.when(value <= 0, F.lit(0)).otherwise(1 + F.ceil(F.ln(value.cast("double")) / F.log(F.lit(GAMMA)))).cast("int")


def limits(measured: DataFrame, spread: float, gap: float, support: int) -> DataFrame:
    """One row per language and source of ``measured`` with the limit of every rate."""
    unit = lambda whole: F.when(F.col(whole) > 0, 10000 / F.col(whole)).otherwise(0.0) if whole else F.lit(0.0)
    series = F.inline(F.array(*[F.struct(F.lit(r).alias("rate"), F.lit(u).alias("is_unit"), bucket(unit(whole) if u else F.col(r)).alias("bucket")) for r, whole in RATES.items() for u in (False, True)]))
    own = measured.select("lang", "source", series).groupBy("lang", "source", "rate", "is_unit", "bucket").agg(F.count("*").alias("n"))
    keys = own.select("lang", "source", "rate").distinct()
    # A bucket stands for its upper end; bucket 0 for 0.
    value = lambda b: F.when(b <= 0, F.lit(0.0)).otherwise(F.pow(F.lit(GAMMA), b - 1.0))
    for level, by in {"own": ["lang", "source"], "lang": ["lang"], "all": []}.items():
        merged = own.groupBy(*by, "rate", "is_unit", "bucket").agg(F.sum("n").alias("n"))
        of = Window.partitionBy(*by, "rate", "is_unit")
        running = of.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
        # The unit: the median of what one event is.
        halves = merged.withColumns({"upto": F.sum("n").over(running), "total": F.sum("n").over(of)})
        middle = F.min(F.when(F.col("is_unit") & (F.col("upto") >= F.ceil(F.col("total") * 0.5)), F.col("bucket"))).over(Window.partitionBy(*by, "rate"))
        rated = halves.withColumn("unit", middle).where("not is_unit").groupBy(*by, "rate", "unit", F.greatest("bucket", "unit").alias("bucket")).agg(F.sum("n").alias("n"))
        shown = F.when((F.col("bucket") > F.col("unit")) | (F.col("unit") == 0), F.col("n")).otherwise(0)
        of = Window.partitionBy(*by, "rate")
        running = of.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
        ranked = rated.withColumns({
            "upto": F.sum("n").over(running), "total": F.sum("n").over(of), "seen": F.sum(shown).over(running), "showing": F.sum(shown).over(of), "next": F.lead("bucket").over(of.orderBy("bucket")),
        })
        at = lambda q: F.min(F.when((F.col("showing") > 0) & (F.col("seen") >= F.ceil(F.col("showing") * q)), F.col("bucket")))
        parted = (F.col("upto") >= F.ceil(F.col("total") * 0.75)) & (F.col("next") - F.col("bucket") >= math.ceil(math.log(gap) / math.log(GAMMA)))
        q = ranked.groupBy(*by, "rate").agg(F.max("total").alias("total"), F.max("showing").alias("showing"), at(0.25).alias("q1"), at(0.75).alias("q3"), F.min(F.when(parted, F.col("bucket") + F.col("next"))).alias("ends"))
        last = F.lit(level == "all")
        fence = F.when(last | (F.col("showing") >= support), F.coalesce(value(F.col("q3") + spread * (F.col("q3") - F.col("q1"))), F.lit(NONE)))
        jump = F.when(last | (F.col("total") >= support), F.coalesce(value(F.col("ends") / 2), F.lit(NONE)))
        q = q.select(*[F.col(c).alias(f"k_{c}") for c in [*by, "rate"]], fence.alias(f"fence_{level}"), jump.alias(f"jump_{level}"))
        on = F.col("rate") == F.col("k_rate")
        for c in by:
            on &= F.col(c).eqNullSafe(F.col(f"k_{c}"))
        keys = keys.join(q, on, "left").drop(*[f"k_{c}" for c in [*by, "rate"]])
    limit = F.least(*[F.coalesce(*[F.col(f"{kind}_{level}") for level in ("own", "lang", "all")]) for kind in ("fence", "jump")])
    found = keys.withColumn("limit", limit)
    return found.groupBy("lang", "source").agg(*[F.max(F.when(F.col("rate") == r, F.col("limit"))).alias(f"{r}_limit") for r in RATES])


def quality_rules(docs: DataFrame, spread: float = 4.0, gap: float = 16.0, support: int = 200) -> DataFrame:
    """Base counts, the rates, the limits that hold for each row and the verdict ``kept``.

    ``spread``: the power of the quartiles' ratio; ``gap``: how many-fold rates must grow
    without a text between; ``support``: rows a sketch needs. A limit of ``NONE`` is none.
    """
    per = lambda part, whole, unit: F.when(F.col(whole) > 0, F.floor(F.col(part) * unit / F.col(whole))).otherwise(0).cast("long")
    counts = counted(docs).select(
        "*",
        per("n_symbols", "word_chars", 10000).alias("symbol_rate"),
        per("n_dup_lines", "n_lines", 10000).alias("dup_line_rate"),
        per("n_repeat_words", "n_words", 10000).alias("repeat_rate"),
        per("word_chars", "n_words", 100).alias("word_length"),
    )
    measured = written(counts)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    rules = limits(measured.where(~failed), spread, gap, support).withColumnsRenamed({"lang": "k_lang", "source": "k_source"})
    within = F.lit(True)
    for r in RATES:
        within &= F.col(r) <= F.col(f"{r}_limit")
    joined = measured.join(rules, F.col("lang").eqNullSafe(F.col("k_lang")) & F.col("source").eqNullSafe(F.col("k_source")), "left")
    return joined.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & within).alias("kept"), *RATES,
        *[F.round(f"{r}_limit", 3).alias(f"{r}_limit") for r in RATES],
    )
