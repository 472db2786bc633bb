"""Lines that many documents share are dropped from all documents but one.

Every line's key is the line without the six ASCII white-space characters at its ends and with A-Z
lower-cased. Keys of at least ``shortest`` characters are hashed (128 bits of SHA-256); a hash found
in ``shared`` or more distinct documents loses its lines except in the largest doc_id that holds it.
All other lines stay, joined by line feeds in their order.

One pass counts hashes: distinct (hash, doc_id) pairs first, so that a line which a third of all
documents hold is spread by document before its documents are counted, with partial sums. A second
pass finds the places of shared hashes: the table of shared hashes is written, its rows are counted,
and it is sent to all tasks only up to ``few`` rows; beyond that it is joined by hash, where Spark
splits a skewed key. Places go to their document, whose kept lines are the stretches between them.

Defined results: a null or empty text is one empty line; a line's end is a line feed only; a null
doc_id is one document, smaller than any other; rows that repeat a doc_id are one document in the
count and rows of their own in the result; an empty table gives an empty result; other columns of the
input are ignored.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

_SPACE = " \t\n\x0b\f\r"


def key(line: Column) -> Column:
    """The line stripped of ASCII white space with A-Z lower-cased, other letters as they are."""
    bare = F.btrim(line, F.lit(_SPACE))
    plain = F.length(bare) == F.octet_length(bare)
    return F.when(plain, F.lower(bare)).otherwise(F.translate(bare, string.ascii_uppercase, string.ascii_lowercase))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def hashed_lines(docs: DataFrame, shortest: int) -> DataFrame:
    """doc_id, text_hash, at (line number from 0) and hash of every line whose key is long enough."""
    # The text is hashed before its lines are dealt out, once and not for every line.
    split = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), _lines(F.col("text")).alias("lines"))
    exploded = split.select("doc_id", "text_hash", F.posexplode("lines").alias("at", "line"))
    long_enough = exploded.where(F.length(F.btrim("line", F.lit(_SPACE))) >= shortest)
    # Never null, so that no join hashes each line once more to leave nulls out.
    hashed = F.coalesce(F.substring(F.unhex(F.sha2(key(F.col("line")), 256)), 1, 16), F.lit(b""))
    return long_enough.select("doc_id", "text_hash", "at", hashed.alias("hash"))


def shared_hashes(lines: DataFrame, shared: int) -> DataFrame:
    """hash and last (the largest doc_id with it) of hashes in at least ``shared`` distinct documents."""
    pairs = lines.select("hash", "doc_id").distinct()
    return pairs.groupBy("hash").agg(F.count("*").alias("n"), F.max("doc_id").alias("last")).where(F.col("n") >= shared).select("hash", "last")


def line_dedup(docs: DataFrame, shortest: int = 40, shared: int = 5, few: int = 200_000) -> DataFrame:
    """doc_id, text (kept lines, never null), n_lines and n_dropped (long), one row per row of ``docs``."""
    lines = hashed_lines(docs, shortest)
    often = written(shared_hashes(lines, shared)).withColumnRenamed("hash", "s_hash")
    often = F.broadcast(often) if often.count() <= few else often
    elsewhere = ~F.col("doc_id").eqNullSafe(F.col("last"))
    places = lines.join(often, (F.col("hash") == F.col("s_hash")) & elsewhere).groupBy("doc_id", "text_hash")
    # Rows equal in doc_id and text give each place once for every row.
    places = places.agg(F.array_sort(F.collect_set("at")).alias("gone"))
    places = places.select(F.col("doc_id").alias("p_doc_id"), F.col("text_hash").alias("p_hash"), "gone")
    whole = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.xxhash64("text").alias("text_hash"))
    met = whole.join(places, whole["doc_id"].eqNullSafe(places["p_doc_id"]) & (whole["text_hash"] == places["p_hash"]), "left")
    met = met.withColumn("lines", _lines(F.col("text")))
    met = met.withColumn("ends", F.concat(F.array(F.lit(-1)), F.col("gone"), F.array(F.size("lines"))))
    # Between two dropped lines, and before the first and behind the last, lines stay.
    stretches = F.transform(F.sequence(F.lit(1), F.size("gone") + 1), lambda k: F.slice("lines", F.get("ends", k - 1) + 2, F.get("ends", k) - F.get("ends", k - 1) - 1))
    return met.select(
        "doc_id",
        F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.concat_ws("\n", F.flatten(stretches))).alias("text"),
        F.size("lines").cast("long").alias("n_lines"),
        F.greatest(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"),
    )


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped and the SHA-256 of the kept text."""
    return line_dedup(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))
