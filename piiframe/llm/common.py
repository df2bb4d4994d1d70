"""Helpers that the operators share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that go through a numpy or regex step at a time hold about so many bytes of text.
SLICE_BYTES = 8 << 20
#: Arrow batches hold about so many bytes at most.
BATCH_BYTES = str(6 << 20)


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names, or the one set for checkpoints.  Where both are
    unset, a folder of our own if all runs on this machine (tests); on a cluster that would be
    out of the executors' sight, so it is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="piiframe-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def small_batches(spark: SparkSession) -> None:
    """Texts go to Python workers some megabytes at a time, whatever their lengths: rows of long
    texts would else make batches that a small executor cannot hold twice.  Spark reads the
    setting when a plan is run, so it stays set for the session."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


@contextmanager
def own_folder(spark: SparkSession, name: str):
    """A new folder in the shared one, deleted when the block ends."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
    try:
        yield path.toString()
    finally:
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def cut(df: DataFrame) -> DataFrame:
    """Checkpoint to the shared folder, so that a lost executor costs no recomputation."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_bytes(column="text"):
    """UTF-8 bytes of a text column; null counts as empty."""
    return F.coalesce(F.col(column), F.lit("")).cast("binary")


def slices(batches: Iterator[pa.RecordBatch], column: int, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that one column's bytes stay near `most` (a longer row stands alone)."""
    for batch in batches:
        held, start = 0, 0
        sizes = pc.binary_length(batch.column(column)).to_pylist()
        for i, n in enumerate(sizes):
            if held and held + (n or 0) > most:
                yield batch.slice(start, i - start)
                held, start = 0, i
            held += n or 0
        if start < batch.num_rows:
            yield batch.slice(start)
