"""Cutting of lineage: tables written to the folder that all executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def settled(df: DataFrame) -> DataFrame:
    """``df``, computed once and written under ``spark.checkpoint.dir``.

    Where neither that setting nor a checkpoint folder is given (tests on one machine) a temporary
    one is taken; a cluster without the setting is an error, as its executors share no such folder.
    """
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        path = df.sparkSession.conf.get("spark.checkpoint.dir", "")
        if not path and sc.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(path or tempfile.mkdtemp(prefix="stratiform-"))
    return df.checkpoint()
