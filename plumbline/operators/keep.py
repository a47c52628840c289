"""Results kept where the loss of an executor does not reach them."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame


def saved(df: DataFrame) -> DataFrame:
    """The rows, computed once and kept in ``spark.checkpoint.dir``; on one machine in a folder of our own where that is unset."""
    spark = df.sparkSession
    if spark.conf.get("spark.checkpoint.dir", None) is None and spark.sparkContext.getCheckpointDir() is None:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="plumbline-"))
    return df.checkpoint(eager=True)
