"""A training corpus in five stages; each calls one operator and works on all that the one before kept.

Language ID, one document of each near-duplicate group, personal data replaced, sources mixed to
target weights, packing. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from planeweave.llm import language_id, packing, pii, simhash_dedup, source_mix
from planeweave.llm.common import discard, leave, stage, table, written
from planeweave.llm.queries import tokenizer_files

#: A document stays unless it has no letter or no language is likelier than this.
LEAST_LANGUAGE = 0.4


def _held(docs: DataFrame) -> DataFrame:
    """Rows as one struct, so that no operator's column meets one of the input."""
    return docs.select(F.struct("*").alias("held"))


def _one_each(held: DataFrame, *key: Column) -> DataFrame:
    """One row per key and hash of the text: that whose columns hash to the least."""
    return held.groupBy(*key, "hash").agg(F.min_by("held", F.xxhash64("held")).alias("held"))


def _columns(held: DataFrame, docs: DataFrame) -> DataFrame:
    return held.select(*[F.col(f"held.`{c}`").alias(c) for c in docs.columns])


@stage
def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without a letter and those whose language the network can't tell.

    Where no row to train on has a language there is no network: every text with a letter stays. Null and
    empty texts go; rows that repeat are judged each; an empty table gives an empty one.
    """
    net = language_id.train(docs.select("doc_id", "text", "lang"))

    @F.pandas_udf("boolean")
    def known(texts: pd.Series) -> pd.Series:
        if net is None:
            return pd.Series([bool(t) and any(map(str.isalpha, t)) for t in texts])
        named, score = language_id.predict_batch(net, texts.tolist())
        return pd.Series([n != "und" and s >= LEAST_LANGUAGE for n, s in zip(named, score, strict=True)])

    return docs.where(known(F.col("text")))


@stage
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group: that of smallest doc_id (null last), then of smallest hash of its text.

    Different texts of one doc_id are documents of their own. Of rows equal in doc_id and text the one
    whose columns hash to the least stays. Null and empty texts are one group; an empty table gives an
    empty one.
    """
    kept = written(simhash_dedup.representatives(docs.select("doc_id", "text"))).withColumnsRenamed({"doc_id": "k_doc_id", "text_hash": "k_hash"})
    held = _held(docs).withColumn("hash", F.xxhash64("held.text"))
    on = F.col("held.doc_id").eqNullSafe(F.col("k_doc_id")) & (F.col("hash") == F.col("k_hash"))
    stays = held.join(kept.select("k_doc_id", "k_hash"), on, "left_semi")
    if not kept.where("rows > 1").isEmpty():
        stays = _one_each(stays, F.col("held.doc_id"))
    return _columns(stays, docs)


@stage
def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Identifiers in texts become their kind in brackets; n_chars follows.

    Null and empty texts stay as they are, rows that repeat are changed alike, no row goes.
    """
    clean = pii.redact(docs)
    if "n_chars" not in docs.columns:
        return clean
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


@stage
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, always whole, as often as the mix takes it; those it takes zero times go.

    Rows of equal doc_id, source and text are one document that is taken as often as all. Texts without
    a word have no size and are not taken; an empty table gives an empty one.
    """
    taken = source_mix.source_mix(docs.select("doc_id", "source", "text")).where("size > 0")
    key = [F.col("doc_id").alias("m_doc_id"), F.col("source").alias("m_source"), F.col("text_hash").alias("m_hash")]
    taken = written(taken.groupBy(*key).agg(F.count("*").alias("rows"), F.sum("copies").alias("copies")))
    held = _held(docs).withColumn("hash", F.xxhash64("held.text"))
    if not taken.where("rows > 1").isEmpty():
        held = _one_each(held, F.col("held.doc_id"), F.col("held.source"))
    on = F.col("held.doc_id").eqNullSafe(F.col("m_doc_id")) & F.col("held.source").eqNullSafe(F.col("m_source")) & (F.col("hash") == F.col("m_hash"))
    joined = held.join(taken.where("copies > 0"), on)
    return _columns(joined.select("held", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy")), docs)


@stage
def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the tokenized documents with their ids, their document's row, their sequence and offset.

    ``document`` tells copies of one doc_id apart, so both documents and sequences can be built from the
    result. A null or empty text is the end id alone; an empty table gives no piece.
    """
    return packing.pack(docs.select("doc_id", "text"), *tokenizer_files(), keep_ids=True)


STAGES = [
    ("language_id", keep_languages),
    ("near_duplicates", drop_near_duplicates),
    ("personal_data", replace_personal_data),
    ("source_mix", mix_sources),
    ("packing", pack_sequences),
]

#: No stage can be expressed in SQL; tests hold each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's result, written; what the stages leave between them goes as soon as it is read."""
    given = docs = table(spark, sf_dir, "documents")
    for _, step in STAGES:
        made = written(step(spark, docs, sf_dir))
        if docs is not given:
            discard(docs)
        docs = made
    leave()
    return docs
