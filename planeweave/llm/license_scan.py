"""License scan by diagonal voting (DataFrame functions only).

All rolling word 3-gram hashes of every text are joined to the positions of 3-grams in the license
templates (a table of fixed size); a match votes for the diagonal "place in text minus place in
template". A base phrase stands where its diagonal has all votes. Longer notices may have words put
in or left out: their neighbouring diagonals are merged and the span is verified by the share of
template words that matching 3-grams cover within a stretch of twice the template's words, and by the
words that decide: of a notice of another license that shares 3-grams with it, the span must hold at
least one 3-gram that the other lacks. The join also compares the 3-grams themselves.

Defined results: null or empty text has no words, no place, empty labels and score 0; rows that
repeat a doc_id and text give equal rows; an empty table gives an empty result; other columns of the
input are ignored. A null doc_id is an id like any other.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

K = 3
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Base phrases and their labels.
PHRASES = [
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
]
#: Opening words of public license notices and their labels.
NOTICES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("gpl-2", "licensed under the gnu general public license version 2"),
    ("gpl-2", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"),
    ("gpl-3", "licensed under the gnu general public license version 3"),
    ("gpl-3", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("lgpl-2.1", "licensed under the gnu lesser general public license version 2 1"),
    ("lgpl-2.1", "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version"),
    ("lgpl-3", "licensed under the gnu lesser general public license version 3"),
    ("lgpl-3", "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("agpl-3", "licensed under the gnu affero general public license version 3"),
    ("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa", "licensed under a creative commons attribution sharealike"),
    ("cc-by-nc", "licensed under a creative commons attribution noncommercial"),
    ("cc-by-nd", "licensed under a creative commons attribution noderivatives"),
]


def license_words(text: Column) -> Column:
    """Words of a text with A-Z lower-cased; other letters stay as they are."""
    lowered = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.array_remove(F.split(lowered, SEPARATORS), "")


def rivals() -> dict[int, dict[int, set[str]]]:
    """For every notice the notices of other licenses that share 3-grams with it, and what they lack of it."""
    told = [*PHRASES, *NOTICES]
    grams = [{" ".join(w[at : at + K]) for at in range(len(w) - K + 1)} for w in (words.split() for _, words in told)]
    later = range(len(PHRASES), len(told))
    return {n: {o: grams[n] - grams[o] for o in later if told[o][0] != told[n][0] and grams[n] & grams[o] and grams[n] - grams[o]} for n in later}


def templates(spark: SparkSession) -> DataFrame:
    """Every 3-gram of every template with its place; as many rows as the constants above have words.

    ``others``: the template's rivals; ``beats``: those that lack this 3-gram.
    """
    rows, against = [], rivals()
    for n, (label, words) in enumerate([*PHRASES, *NOTICES]):
        w, of = words.split(), against.get(n, {})
        for at in range(len(w) - K + 1):
            gram = " ".join(w[at : at + K])
            rows.append((n, label, n < len(PHRASES), len(w), at, gram, sorted(of), sorted(o for o, lacked in of.items() if gram in lacked)))
    made = spark.createDataFrame(rows, "template int, label string, exact boolean, template_words int, at int, t_gram string, others array<int>, beats array<int>")
    w = F.split("t_gram", " ")
    return made.withColumn("t_hash", F.xxhash64(w[0], w[1], w[2]))


def votes(docs: DataFrame) -> DataFrame:
    """Distinct matches (text, template, diagonal, place in the template)."""
    words = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), license_words(F.col("text")).alias("w"))
    grams = F.when(
        F.size("w") >= K,
        F.transform(
            F.sequence(F.lit(0), F.size("w") - K),
            lambda i: F.struct(
                i.alias("pos"),
                F.xxhash64(F.get("w", i), F.get("w", i + 1), F.get("w", i + 2)).alias("hash"),
                F.concat_ws(" ", F.get("w", i), F.get("w", i + 1), F.get("w", i + 2)).alias("gram"),
            ),
        ),
    )
    rolled = words.select("doc_id", "text_hash", F.inline(grams))
    known = F.broadcast(templates(docs.sparkSession))
    hit = rolled.join(known, (F.col("hash") == F.col("t_hash")) & (F.col("gram") == F.col("t_gram")))
    return hit.select("doc_id", "text_hash", "template", "label", "exact", "template_words", "others", "beats", "at", (F.col("pos") - F.col("at")).alias("diagonal")).distinct()


def license_scan(docs: DataFrame, coverage: float = 0.6, drift: int = 8) -> DataFrame:
    """One row per document: its base places and the labels of base phrases and verified notices.

    ``coverage``: share of a notice's words that a stretch of a span must cover; ``drift``: how far apart
    neighbouring diagonals of one span may be.
    """
    key = ["doc_id", "text_hash"]
    found = votes(docs)
    w = Window.partitionBy(*key, "template").orderBy("diagonal", "at")
    # An exact phrase's diagonals stay apart; a notice's span goes on while diagonals are near.
    fresh = F.when(F.col("exact"), F.col("diagonal") != F.lag("diagonal").over(w)).otherwise(F.col("diagonal") - F.lag("diagonal").over(w) > drift)
    spans = found.withColumn("span", F.sum(F.coalesce(fresh, F.lit(True)).cast("int")).over(w))
    # A span of several notices is verified where one of its stretches of twice the notice's words is.
    at3 = F.array("at", F.col("at") + 1, F.col("at") + 2)
    along = Window.partitionBy(*key, "template", "span").orderBy("pos")
    reach = F.lit(None)
    for n in sorted({len(words.split()) for _, words in NOTICES}):
        reach = F.when(~F.col("exact") & (F.col("template_words") == n), F.collect_set(at3).over(along.rangeBetween(0, 2 * n - K))).otherwise(reach)
    spans = spans.withColumn("pos", F.col("diagonal") + F.col("at")).withColumn("near", F.size(F.array_distinct(F.flatten(reach))))
    merged = spans.groupBy(*key, "template", "label", "exact", "template_words", "others", "span").agg(
        F.min("pos").alias("first"),
        F.max("near").alias("near"),
        # Bounded by the template's words.
        F.size(F.array_distinct(F.flatten(F.collect_set(at3)))).alias("covered"),
        F.flatten(F.collect_set("beats")).alias("beaten"),
    )
    share = F.col("covered") / F.col("template_words")
    verified = F.when(F.col("exact"), F.col("covered") == F.col("template_words")).otherwise((F.col("near") / F.col("template_words") >= coverage) & (F.size(F.array_except("others", "beaten")) == 0))
    judged = merged.withColumn("share", share).withColumn("verified", verified)
    base = F.col("exact") & F.col("verified")
    told = judged.groupBy(*key).agg(
        F.count_if(base).alias("n_base"),
        F.min(F.when(base, F.col("first"))).cast("long").alias("first_word"),
        F.max(F.when(base, F.col("first"))).cast("long").alias("last_word"),
        F.array_join(F.sort_array(F.collect_set(F.when(base, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.collect_set(F.when(F.col("verified"), F.col("label")))), ",").alias("labels"),
        F.max("share").alias("score"),
    )
    told = told.withColumnsRenamed({"doc_id": "k_doc_id", "text_hash": "k_text_hash"})
    whole = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.size(license_words(F.col("text"))).cast("long").alias("n_words"))
    joined = whole.join(told, F.col("doc_id").eqNullSafe(F.col("k_doc_id")) & (F.col("text_hash") == F.col("k_text_hash")), "left")
    return joined.select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"),
        F.round(F.coalesce("score", F.lit(0.0)), 9).alias("score"),
    )
