"""Where a plan is written down, so that what comes after reads it once and a lost executor doesn't start it anew."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and go on from there.

    The folder is the cluster's spark.checkpoint.dir; where that is unset, a session within one process (tests) gets a
    temporary one, and any other is refused, as its executors couldn't read the driver's folders.
    """
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir isn't set: it names the folder that driver and executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="tidemark-checkpoint-"))
    return df.checkpoint()
