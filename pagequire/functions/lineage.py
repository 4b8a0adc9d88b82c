"""Cutting the lineage of what a loop makes."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def settled(frame: DataFrame) -> DataFrame:
    """The frame written to the checkpoint folder and read from there. The folder is the session's, which driver and
    executors share; only in local mode, on one machine, one is made where none is named."""
    context = frame.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir") or frame.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and context.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="pagequire-"))
    return frame.checkpoint()
