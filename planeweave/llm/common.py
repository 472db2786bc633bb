"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import functools
import tempfile
import uuid
from collections.abc import Callable

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Separators of words: the six ASCII white-space characters.
SPACES = r"[\x20\x09-\x0D]+"


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder for cut lineage, from the session; one of our own only in local mode without one."""
    context = spark.sparkContext._jsc.sc()
    if context.getCheckpointDir().isEmpty():
        given = spark.conf.get("spark.checkpoint.dir", None)
        if not given:
            if not context.isLocal():
                raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
            given = tempfile.mkdtemp(prefix="cut-lineage-")
        spark.sparkContext.setCheckpointDir(given)
    return context.getCheckpointDir().get()


#: Folders of the tables that ``written`` made and that are still there.
_TABLES: set[str] = set()
#: Those of a stage of the pipeline that has returned.
_LEFT: set[str] = set()


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: evaluated once, readable after executors are lost.

    The table is removed by ``discard``, by the next stage of a pipeline, or when the driver ends.
    """
    spark = df.sparkSession
    path = f"{checkpoint_root(spark)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not _TABLES:
        atexit.register(lambda: _remove(set(_TABLES)))
    _TABLES.add(path)
    return spark.read.schema(df.schema).parquet(path)


def _remove(paths: set[str]) -> None:
    for path in paths:
        _TABLES.discard(path)
        _LEFT.discard(path)
        try:
            context = SparkContext._active_spark_context
            where = context._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(context._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # noqa: BLE001 - the session is already gone; the folder belongs to the cluster
            continue


def _read_by(*frames: DataFrame) -> set[str]:
    """Tables of ``written`` that these frames read."""
    names = {path.rsplit("/", 1)[1]: path for path in _TABLES}
    read = {file.rsplit("/", 2)[-2] for frame in frames for file in frame.inputFiles()}
    return {names[n] for n in read if n in names}


def discard(*tables: DataFrame) -> None:
    """Removes tables that ``written`` or ``cut`` gave, as soon as what is read of them is written."""
    _remove(_read_by(*tables))


def stage(function: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """A stage of a pipeline. Its tables between steps go when the next stage begins: a stage's result is
    written before that. Tables that the next stage's own input reads stay."""

    @functools.wraps(function)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        _remove(_LEFT - _read_by(docs))
        before = set(_TABLES)
        out = function(spark, docs, sf_dir)
        _LEFT.update(set(_TABLES) - before)
        return out

    return run


def leave() -> None:
    """Removes what the last stage of a pipeline left, once its result is written."""
    _remove(set(_LEFT))


def cut(df: DataFrame) -> DataFrame:
    """A small table of an iteration, written so that its lineage ends."""
    return written(df)


def crc_mod(column: Column, modulus: int) -> Column:
    """crc32 of a value as text, modulo; a null value counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def ascii_words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text as an array; null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
