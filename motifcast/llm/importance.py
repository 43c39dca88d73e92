"""Importance resampling towards a target distribution of hashed n-grams.

1. A 256-byte table lower-cases A-Z and blanks all other ASCII bytes but digits and letters in a text's UTF-8; ``bytes.split``
   gives its words. The CRC-32 of an n-gram is that of the gram one word shorter, continued with a space and the next word, so
   no gram is ever built as bytes. Grams fall into ``buckets`` by their CRC-32; Counters per task add up, Spark adds the tasks'.
2. A bucket's gain is the logarithm of its smoothed share in the target over its share in the documents, as a floored integer.
   There are as many gains as buckets, whatever the input; they are the only thing collected and broadcast.
3. A second pass gives each document the floored mean of its grams' gains and adds Gumbel noise hashed from its id: the highest
   scores are a sample without replacement, with chances that grow with the weights.
4. Scores are ranked over all documents by ranges: rows are dealt by range and sorted within, and the counts of the ranges
   before are added. No window spans more than one row per range.

Defined cases: null and empty texts, and texts without words, have no features and weight 0; a null doc_id is hashed as an empty
one and ranks before other ids with its score; repeated rows are ranked one after another, each as a document of its own; an
empty table gives an empty result; without target texts the target is uniform; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from motifcast.llm.common import bounded_broadcast, checkpointed, documents

BUCKETS, LONGEST, LEAST_WORDS, PERCENT, SEED = 10_000, 2, 20, 25, 7

#: Letters lower-cased, digits and all bytes beyond ASCII kept, everything else blank.
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(TABLE).split()


def gram_buckets(words: list[bytes], longest: int = LONGEST, buckets: int = BUCKETS) -> np.ndarray:
    """The bucket of each run of 1 to ``longest`` consecutive words, by length and place."""
    crc = list(map(zlib.crc32, words))
    out = [np.array(crc, dtype=np.int64)]
    for k in range(1, min(longest, len(words))):
        crc = list(map(zlib.crc32, words[k:], map(zlib.crc32, repeat(b" "), crc[: len(words) - k])))
        out.append(np.array(crc, dtype=np.int64))
    return np.concatenate(out) % buckets


def _counted(longest: int, buckets: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[int] = Counter()
        for batch in batches:
            for text in batch.column(0):
                counts.update(gram_buckets(words_of(text.as_py()), longest, buckets).tolist())
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.int64()), pa.array(list(counts.values()), pa.int64())], ["bucket", "n"])

    return run


def bucket_counts(texts: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): all occurrences of all grams; at most ``buckets`` rows."""
    parts = texts.select(F.col("text").cast("string")).mapInArrow(_counted(longest, buckets), "bucket long, n long")
    return parts.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: dict[int, int], target: dict[int, int], buckets: int = BUCKETS) -> np.ndarray:
    """1000 times the log ratio of each bucket's smoothed shares, floored."""
    s, t = float(sum(source.values()) + buckets), float(sum(target.values()) + buckets)
    return np.array([math.floor(1000 * math.log((target.get(b, 0) + 1) * s / ((source.get(b, 0) + 1) * t))) for b in range(buckets)], dtype=np.int64)


def noise(doc_id: int | None, seed: int = SEED) -> int:
    """1000 times a Gumbel number hashed from the id, floored."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def _weighed(shared, longest: int, seed: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = shared.value
        for batch in batches:
            out: list[list[int]] = [[], [], [], []]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = words_of(text.as_py())
                got = gain[gram_buckets(words, longest, len(gain))]
                weight = int(got.sum()) // len(got) if len(got) else 0
                for column, value in zip(out, (len(words), len(got), weight, weight + noise(doc_id, seed)), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in out)], ["doc_id", "n_words", "n_features", "weight", "score"])

    return run


def weighed(docs: DataFrame, gain: np.ndarray, longest: int = LONGEST, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight, score for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_weighed(shared, longest, seed), "doc_id long, n_words long, n_features long, weight long, score long")


def ranked_by_range(rows: DataFrame, *order) -> DataFrame:
    """``rank`` from 1 over all rows by ``order``; rows that are equal in it follow one another in any order."""
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    tied = rows.withColumn("_tie", F.monotonically_increasing_id())  # so that many equal rows can lie in several ranges
    dealt = checkpointed(tied.repartitionByRange(parts, *order, F.col("_tie")).sortWithinPartitions(*order, F.col("_tie")).drop("_tie"))
    place = F.monotonically_increasing_id()  # partition * 2**33 + place within it; a checkpoint keeps both
    placed = dealt.withColumn("_part", F.shiftright(place, 33)).withColumn("_place", place.bitwiseAND(F.lit((1 << 33) - 1)))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    return placed.join(bounded_broadcast(offsets, parts), "_part").withColumn("rank", F.col("_before") + F.col("_place") + 1).drop("_part", "_place", "_before")


def resample(docs: DataFrame, target: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS, least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank for every row of ``docs``; ``rank`` is null where it is not drawn.

    Drawn are the floor(``percent`` * N / 100) highest scores of the N rows with at least ``least_words`` words.
    """
    source, wanted = ({r["bucket"]: r["n"] for r in bucket_counts(x, longest, buckets).collect()} for x in (docs, target))
    scored = checkpointed(weighed(docs, gains(source, wanted, buckets), longest, seed).withColumn("_long", F.col("n_words") >= least_words))
    drawn = percent * scored.where("_long").count() // 100
    ranked = ranked_by_range(scored, F.col("_long").desc(), F.col("score").desc(), F.col("doc_id").asc())
    return ranked.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank"))).drop("_long")


def op13_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resample(documents(spark, sf_dir), documents(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")
