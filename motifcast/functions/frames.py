"""DataFrame helpers."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. Where it is unset, a temporary one in local mode; on a cluster that is an error."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-ckpt-"))
    return context._jsc.sc().getCheckpointDir().get()


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage: the rows are kept as Parquet in the shared folder and read back.

    Columns take less room than the rows that ``DataFrame.checkpoint`` writes out, and a reader takes only the columns, and by their
    bounds the row groups, that it needs."""
    path = f"{shared_folder(df.sparkSession)}/kept-{uuid.uuid4()}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def union_all(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


#: A filter has sixteen bits for each key, up to this many (16 MB); beyond it lets more other rows through.
MOST_BITS = 1 << 27


def among(rows: DataFrame, columns: list[str], keys: DataFrame) -> DataFrame:
    """The rows whose ``columns`` may all be among ``keys`` (one column of longs): all that are, and a few others.

    For rows that are to be shuffled to a join with the keys, so that most of those without a partner stay where they are. The keys'
    hashes set bits in arrays of 1,024 words, which are broadcast; their size has a bound, whatever the number of keys."""
    (name,) = keys.columns
    bits = min(MOST_BITS, 1 << max(16, (16 * keys.count()).bit_length()))
    hashed = lambda c: F.pmod(F.xxhash64(F.col(c).cast("long")), F.lit(bits))
    set_ = keys.select(hashed(name).alias("_h")).selectExpr("_h div 64 AS _word", "shiftleft(1L, (_h % 64)::int) AS _bits")
    every = set_.unionByName(keys.sparkSession.range(bits // 64).selectExpr("id AS _word", "0L AS _bits"))
    words = every.withColumn("_block", F.expr("_word div 1024")).repartition("_block").groupBy("_block", "_word").agg(F.bit_or("_bits").alias("_bits"))
    blocks = words.groupBy("_block").agg(F.transform(F.array_sort(F.collect_list(F.struct("_word", "_bits"))), lambda x: x["_bits"]).alias("_words"))
    bit = F.expr("shiftright(get(_words, ((_h div 64) % 1024)::int), (_h % 64)::int) & 1")
    for c in columns:
        rows = rows.withColumn("_h", hashed(c)).join(F.broadcast(blocks), (F.expr("_h div 65536") == F.col("_block")) & (bit == 1), "left_semi").drop("_h")
    return rows
