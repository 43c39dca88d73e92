"""Document fingerprints: a homomorphic multiset hash of paragraphs, in DataFrame functions only.

A paragraph (line) is hashed to a wide vector; a text's fingerprint is the sum of its paragraphs' vectors, each lane modulo a
power of two. So it does not depend on the paragraphs' order, and a paragraph is added or taken away by adding or subtracting
its vector. The vector has two parts:

* ``DENSE`` lanes of 60 bits, each a hash of the paragraph from another seed: equality of the multiset of paragraphs;
* 65,536 lanes of 16 bits, almost all zero and kept sparse: each sentence of the paragraph adds one to the lane that its hash
  names. Two fingerprints' likeness is the overlap of these counts (sum of minima / sum of maxima).

As a string: the dense lanes in hex, ``-``, then for each lane that is not zero the lane and its count in hex, by lane. Such
strings are added (``inserted``) and subtracted (``deleted``) lane by lane, so a document's fingerprint follows the insertion and
deletion of paragraphs without a look at the others. A lane that wraps round to zero is left out like one never used.

Likeness counts sentences: a text without any sentence end is one sentence, and any change to it makes it unlike.

Defined cases: a null text is empty; the empty text has one empty paragraph; equal texts (and texts with the same paragraphs
in another order) have equal fingerprints; repeated rows follow one another, and the last of them is followed by the next document; two texts without sentences are alike if equal;
an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from motifcast.llm.common import documents

DENSE, DENSE_BITS = 4, 60
LANE_MASK, COUNT_MASK = 0xFFFF, 0xFFFF
#: Documents that share a block of the order, about, and most blocks there may be (256 times 256 cuts are searched in two steps).
BLOCK_ROWS, MAX_BLOCKS, STEP = 2_048, 65_536, 256
LEAST_ID = -(1 << 63)


def dense_lanes(paragraphs: Column, lanes: int = DENSE) -> Column:
    """Array of lanes: sums of the paragraphs' hashes modulo 2**60.

    ``xxhash64`` takes the hash of one argument as the seed of the next, so the lane's number comes first: lanes whose paragraph
    came first would all follow from one 64-bit hash."""
    mask = F.lit((1 << DENSE_BITS) - 1)

    def lane(k: int) -> Column:
        return F.aggregate(paragraphs, F.lit(0).cast("long"), lambda t, p: (t + F.xxhash64(F.lit(k), p).bitwiseAND(mask)).bitwiseAND(mask))

    return F.array(*map(lane, range(lanes)))


def sentence_lanes(text: Column) -> Column:
    """Sorted lanes of all sentences, with repeats; a sentence ends at a line feed, or at a space after another sign than a
    letter or digit."""
    sentences = F.filter(F.split(text, r"\n|(?<=[^\p{L}\p{N}]) ", -1), lambda s: s != "")
    return F.array_sort(F.transform(sentences, lambda s: F.xxhash64(s).bitwiseAND(F.lit(LANE_MASK)).cast("int")))


def counted_lanes(lanes: Column) -> Column:
    """Sorted lanes with repeats -> array of lane * 65536 + count (modulo 65536), by lane."""
    n = F.size(lanes)
    ends = F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: (n > 0) & ((i == n) | (F.get(lanes, i) != F.get(lanes, i - 1))))
    return F.zip_with(ends, F.slice(F.concat(F.array(F.lit(0)), ends), 1, F.size(ends)), lambda e, s: F.get(lanes, e - 1).cast("long") * 65536 + (e - s).cast("long").bitwiseAND(F.lit(COUNT_MASK)))


def fingerprint(dense: Column, counted: Column) -> Column:
    wide = lambda x, n: F.lpad(F.lower(F.hex(x)), n, "0")
    counted = F.filter(counted, lambda x: x.bitwiseAND(F.lit(COUNT_MASK)) > 0)
    return F.concat(F.array_join(F.transform(dense, lambda x: wide(x, DENSE_BITS // 4)), ""), F.lit("-"), F.array_join(F.transform(counted, lambda x: wide(x, 8)), ""))


def _lanes_of(fingerprints: Column) -> tuple[Column, Column]:
    """(dense lanes, counted lanes) of a fingerprint's string."""
    number = lambda x: F.conv(x, 16, 10).cast("long")
    width = DENSE_BITS // 4
    dense = F.array(*[number(F.substring(fingerprints, 1 + k * width, width)) for k in range(DENSE)])
    return dense, F.transform(F.regexp_extract_all(F.substring_index(fingerprints, "-", -1), F.lit("[0-9a-f]{8}"), F.lit(0)), number)


def _combined(x: Column, y: Column, sign: int) -> Column:
    (dense_x, counted_x), (dense_y, counted_y) = _lanes_of(x), _lanes_of(y)
    dense = F.zip_with(dense_x, dense_y, lambda a, b: (a + sign * b).bitwiseAND(F.lit((1 << DENSE_BITS) - 1)))
    lane, count = lambda v: F.shiftright(v, 16), lambda v: v.bitwiseAND(F.lit(COUNT_MASK))
    counted_y = F.transform(counted_y, lambda v: lane(v) * 65536 + (sign * count(v)).bitwiseAND(F.lit(COUNT_MASK)))

    def last_of_lane(z: Column, v: Column, i: Column) -> Column:
        """The lane with the sum of its (at most two) counts, at the last of them; -1 elsewhere."""
        before, after = F.get(z, i - 1), F.get(z, i + 1)
        total = count(v) + F.when(lane(before) == lane(v), count(before)).otherwise(0)
        return F.when(lane(after) == lane(v), -1).otherwise(lane(v) * 65536 + total.bitwiseAND(F.lit(COUNT_MASK)))

    both = F.array_sort(F.concat(counted_x, counted_y))
    summed = F.flatten(F.transform(F.array(both), lambda z: F.transform(z, lambda v, i: last_of_lane(z, v, i))))  # z: sorted once
    return fingerprint(dense, F.filter(summed, lambda v: v >= 0))


def inserted(fingerprints: Column, paragraphs: Column) -> Column:
    """The fingerprint of a text to which the paragraphs of another fingerprint were added, wherever they went; null with a null."""
    return _combined(fingerprints, paragraphs, 1)


def deleted(fingerprints: Column, paragraphs: Column) -> Column:
    """The fingerprint of a text from which the paragraphs of another fingerprint were taken; the inverse of ``inserted``."""
    return _combined(fingerprints, paragraphs, -1)


def _occurrences(lanes: Column, counted: Column) -> Column:
    """A set that stands for the multiset: the lane's first occurrence as itself, repeats with their number."""
    repeated = F.filter(counted, lambda c: c.bitwiseAND(F.lit(COUNT_MASK)) > 1)
    more = F.flatten(F.transform(repeated, lambda c: F.transform(F.sequence(F.lit(2).cast("long"), c.bitwiseAND(F.lit(COUNT_MASK))), lambda k: F.shiftright(c, 16) * 65536 + k)))
    return F.concat(F.transform(F.array_distinct(lanes), lambda x: x.cast("long") * 65536), more)


def likeness(x: Column, y: Column, equal: Column) -> Column:
    """Sum of minima over sum of maxima of two lane counts, given as sets of occurrences."""
    both = F.size(F.array_intersect(x, y))
    either = F.size(x) + F.size(y) - both
    return F.when(equal, 1.0).when(either > 0, both / either).otherwise(0.0)


def with_fingerprint(df: DataFrame, text: str, prefix: str = "") -> DataFrame:
    """Adds ``{prefix}fingerprint`` and ``{prefix}occurrences`` (for likeness)."""
    paragraphs, dense, lanes, counted = f"{prefix}paragraphs_", f"{prefix}dense_", f"{prefix}lanes_", f"{prefix}counted_"
    df = df.withColumns({paragraphs: F.split(text, "\n", -1), lanes: sentence_lanes(F.col(text))})
    df = df.withColumns({dense: dense_lanes(F.col(paragraphs)), counted: counted_lanes(F.col(lanes))}).drop(paragraphs)
    return df.withColumns({f"{prefix}fingerprint": fingerprint(F.col(dense), F.col(counted)), f"{prefix}occurrences": _occurrences(F.col(lanes), F.col(counted))}).drop(dense, lanes, counted)


def blocks_of(docs: DataFrame, block_rows: int = BLOCK_ROWS) -> Column:
    """A struct (ids, part) that rises with the order (key, tie) and cuts the rows into blocks of about ``block_rows``.

    Cuts are quantiles of the key, so gaps between ids do not matter. An id that several quantiles meet on has so many rows that
    its block is cut further, by equal ranges of the tie (a hash of the text)."""
    n = docs.count()
    blocks = min(MAX_BLOCKS, -(-n // block_rows))
    if blocks < 2:
        return F.struct(F.lit(0).alias("ids"), F.lit(0).alias("part"))
    at = [k / blocks for k in range(1, blocks)]
    found = Counter(docs.agg(F.percentile_approx("key", at, max(10_000, 4 * blocks)).alias("cuts")).first()["cuts"])
    distinct, repeats = sorted(found), {c: k + 1 for c, k in found.items() if k > 1}
    array = lambda x: F.from_json(F.lit(str(x)), "array<bigint>")  # noqa: E731  (a constant of at most MAX_BLOCKS numbers)
    step = F.size(F.filter(array(distinct[STEP - 1 :: STEP]), lambda c: c < F.col("key"))) * STEP
    ids = step + F.size(F.filter(F.slice(array(distinct), step + 1, STEP), lambda c: c < F.col("key")))
    parts = F.coalesce(F.from_json(F.lit(str({str(k): v for k, v in repeats.items()}).replace("'", '"')), "map<string,bigint>")[F.col("key").cast("string")], F.lit(1))
    part = F.floor((F.col("tie") / F.lit(2.0**64) + 0.5) * parts).cast("int")
    return F.struct(ids.alias("ids"), F.when((parts > 1) & (F.element_at(array(distinct), ids + 1) == F.col("key")), 1 + F.least(part, parts - 1)).otherwise(0).cast("int").alias("part"))


def with_next(docs: DataFrame, columns: list[str], block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Each row with ``next_<column>`` of the row that follows by descending doc_id (after the last: the first).

    The order is cut into blocks of neighbouring rows; a block also gets a copy of the first row of the block that follows, so
    rows are dealt to tasks once, by block. Rows that tie on doc_id are ordered by a hash of the text; a null doc_id comes last.
    The table of blocks is small (at most two for each of 65,536 quantiles). Only rows that repeat one doc_id and one text stay
    together, however many they are.
    """
    keyed = docs.withColumn("key", F.coalesce("doc_id", F.lit(LEAST_ID).cast("long"))).withColumn("tie", F.xxhash64("text"))
    keyed = keyed.withColumn("block", blocks_of(keyed.select("key"), block_rows))
    heads = keyed.groupBy("block").agg(F.max(F.struct("key", "tie")).alias("head"))
    order = Window.orderBy(F.desc("block"))
    above = heads.withColumn("to", F.lag("block").over(order)).withColumn("to", F.coalesce("to", F.min("block").over(Window.partitionBy())))
    first = F.struct("key", "tie") == F.col("head")
    copies = keyed.join(F.broadcast(above), "block").where(first).drop("block", "head").withColumnRenamed("to", "block").dropDuplicates(["block"])
    rows = keyed.withColumn("copy", F.lit(False)).unionByName(copies.withColumn("copy", F.lit(True)))
    along = Window.partitionBy("block").orderBy("copy", F.desc("key"), F.desc("tie"))
    return rows.select("*", *[F.lead(c).over(along).alias(f"next_{c}") for c in columns]).where(~F.col("copy")).drop("block", "copy", "tie", "key")


def edited(text: Column, n_chars: Column, next_text: Column) -> Column:
    """The last half of the text's code points (rounded down) replaced by the first as many of the next text."""
    half = F.floor(n_chars / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), n_chars - half), F.substring(next_text, F.lit(1), half))


def document_fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = with_next(with_fingerprint(docs, "text"), ["text", "fingerprint", "occurrences"])
    rows = rows.withColumn("n_chars", F.char_length("text")).withColumn("edited", edited(F.col("text"), F.col("n_chars"), F.col("next_text")))
    rows = with_fingerprint(rows, "edited", "edited_")
    return rows.select(
        "doc_id",
        F.col("n_chars").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        "fingerprint",
        "edited_fingerprint",
        likeness(F.col("occurrences"), F.col("edited_occurrences"), F.col("fingerprint") == F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("occurrences"), F.col("next_occurrences"), F.col("fingerprint") == F.col("next_fingerprint")).alias("near_next"),
    )


def op2_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_fingerprints(documents(spark, sf_dir))
