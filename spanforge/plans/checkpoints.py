"""Frames that are computed once because several later steps read them."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def settled(df: DataFrame) -> DataFrame:
    """The frame, computed once and read back from the folder in spark.checkpoint.dir, so that later steps neither repeat it nor plan it again.

    A temporary folder stands in for that setting only where it is unset and all runs on one machine.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="spanforge-checkpoint-"))
    return df.checkpoint(eager=True)
