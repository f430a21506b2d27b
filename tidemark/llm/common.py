"""What the operators of this subpackage share: reading, lineage cuts, shipping code, Arrow batches."""

from __future__ import annotations

import io
import os
import re
import tempfile
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table of a folder of Parquet tables; the path may be of any store that Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so that workers can import it anywhere."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, files in os.walk(top):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(top)))
    path = os.path.join(tempfile.mkdtemp(prefix="tidemark-"), "tidemark_src.zip")
    with open(path, "wb") as out:
        out.write(buffer.getvalue())
    sc.addPyFile(path)
    _shipped.add(sc.applicationId)


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


def by_batch(df: DataFrame, make: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str, rows: int | None = None, done: Callable[[], None] | None = None) -> DataFrame:
    """mapInArrow with one function of a batch, or of at most `rows` rows of one where what is made of a row is large.

    `done` is called after a task's last batch: workers live on, and what one holds then is lacking in later stages.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, rows or max(1, batch.num_rows)):
                if (out := make(batch.slice(lo, rows))) is not None:
                    yield out
        if done:
            done()
        pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, schema)
