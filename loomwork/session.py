"""What operators need from the session: a folder that driver and executors share, and plans cut there."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

CHUNK = 1 << 20
#: Rows that a partition of a small table should have at least.
PARTITION_ROWS = 100_000


def checkpoint_folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir. Where none is set, a temporary folder on a local master; elsewhere an error."""
    context = spark.sparkContext
    held = context._jsc.sc().getCheckpointDir
    if not held().isDefined():
        told = context.getConf().get("spark.checkpoint.dir")
        if not told and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(told or tempfile.mkdtemp(prefix="checkpoints-"))
    return held().get()


def cut(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Compute df once, into the shared checkpoint folder, and drop its lineage; `discard` deletes it.

    If the number of its rows is known (or one that it doesn't exceed), a small
    table is written in few files, however many partitions made it.
    """
    checkpoint_folder(df.sparkSession)
    return (df if rows is None else df.coalesce(max(8, -(-rows // PARTITION_ROWS)))).checkpoint(eager=True)


def shared_folder(spark: SparkSession, name: str) -> str:
    """The path of a new folder that driver and executors share, below the checkpoint folder."""
    return f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _file(spark: SparkSession, path: str):
    own = spark._jvm.org.apache.hadoop.fs.Path(path)
    return own.getFileSystem(spark._jsc.hadoopConfiguration()), own


def remove(spark: SparkSession, path: str) -> None:
    """Delete a file or folder of any file system that Spark knows; none there is no error."""
    fs, own = _file(spark, path)
    fs.delete(own, True)


def discard(df: DataFrame) -> None:
    """Delete what `cut` wrote for df; neither df nor plans on it may be used any more."""
    held = df._jdf.queryExecution().logical().rdd().getCheckpointFile()
    if held.isDefined():
        remove(df.sparkSession, held.get())


def spool(spark: SparkSession, chunks: Iterable[bytes], name: str) -> tuple[str, int]:
    """Write chunks to a new file in the shared folder; its path and size. The driver holds one chunk at a time."""
    path = shared_folder(spark, name)
    fs, own = _file(spark, path)
    out, size = fs.create(own), 0
    try:
        for chunk in chunks:
            out.write(bytearray(chunk))
            size += len(chunk)
    finally:
        out.close()
    return path, size


def pieces(stream, size: int = CHUNK) -> Iterable[bytes]:
    """A readable binary stream in chunks."""
    while chunk := stream.read(size):
        yield chunk
