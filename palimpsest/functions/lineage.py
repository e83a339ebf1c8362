"""Cutting lineage: a plan that is read several times is run once."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame


def checkpoint(rows: DataFrame) -> DataFrame:
    """Reliable checkpoint in the folder of ``spark.checkpoint.dir``, which executors share.
    Only a session within one process (as in tests) gets a folder of its own where none is
    set; a cluster is refused."""
    spark = rows.sparkSession
    if spark.conf.get("spark.checkpoint.dir", None) is None and spark.sparkContext.getCheckpointDir() is None:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints"))
    return rows.checkpoint()
