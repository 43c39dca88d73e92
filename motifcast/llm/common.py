"""Shared helpers of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from motifcast.functions.frames import shared_folder

#: Bounds of what may be broadcast: rows are counted (or bounded by construction) before a broadcast hint is given.
BROADCAST_ROWS = 1_000_000
#: Rows of an Arrow batch that a Python worker gets.
ARROW_ROWS = 1_000
#: Files of the checkpoints made within the innermost ``settled`` or ``released``.
_MADE: ContextVar[list[str] | None] = ContextVar("made", default=None)


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the folder that ``spark.checkpoint.dir`` names."""
    spark = df.sparkSession
    shared_folder(spark)
    # A checkpoint keeps its plan's constraints; a union of two such frames then fails in the optimizer. It needs none. Python
    # workers get batches of at most ARROW_ROWS rows, so that long texts do not add up in memory.
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    wanted = {"spark.sql.constraintPropagation.enabled": "false", rows: str(min(ARROW_ROWS, int(spark.conf.get(rows)) or ARROW_ROWS))}
    before = {key: spark.conf.get(key) for key in wanted}
    try:
        for key, value in wanted.items():
            spark.conf.set(key, value)
        out = df.checkpoint(eager=True)
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    if _MADE.get() is not None:
        file = out._jdf.queryExecution().logical().rdd().getCheckpointFile()
        if file.isDefined():
            _MADE.get().append(file.get())
    return out


def delete(spark: SparkSession, *paths: str) -> None:
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def settled(spark: SparkSession, make: Callable[[], DataFrame]) -> DataFrame:
    """The frame that ``make`` returns, checkpointed; then the checkpoints made on the way to it are deleted."""
    made: list[str] = []
    token = _MADE.set(made)
    try:
        frame = make()
    finally:
        _MADE.reset(token)
    out = checkpointed(frame)
    delete(spark, *made)
    return out


def released(spark: SparkSession, write: Callable[[], None]) -> None:
    """Runs ``write``, which leaves its result elsewhere; then all checkpoints made within are deleted."""
    made: list[str] = []
    token = _MADE.set(made)
    try:
        write()
    finally:
        _MADE.reset(token)
    delete(spark, *made)


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def crc32_mod(key: Column, modulus: int) -> Column:
    """crc32 of the key's decimal text, modulo ``modulus``; a null key counts as 0."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")), F.lit(0)) % modulus


def bounded_broadcast(df: DataFrame, rows: int) -> DataFrame:
    """A broadcast hint if the counted ``rows`` are within the bound; else Spark chooses (and shuffles)."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


