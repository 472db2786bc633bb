"""Cutting lineage in the session's shared folder."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """``df.checkpoint()`` in the folder that the session names; one of our own only in local mode without one."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        given = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not given and not sc._jsc.sc().isLocal():
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(given or tempfile.mkdtemp(prefix="planeweave-"))
    return df.checkpoint()
