"""Sequence packing: shortest-pack-first over the histogram of piece lengths.

1. Every text is tokenized once, in Arrow batches; a document of more than ``capacity`` ids is cut into full pieces and
   one remainder. Only piece metadata (length, CRC) leaves the tasks, never the ids.
2. The histogram of piece lengths has at most ``capacity`` rows, whatever the input; it is the only thing collected.
3. The driver packs the histogram: lengths longest first, each into the pattern with the most room left, with pattern
   *counts* updated (a pattern is a class of equal packs, so the work is bounded by lengths, not by documents).
4. Each placement covers an interval of ranks within a length. Documents get their rank by a two-level count (length and
   salt), so a length that a third of all pieces share is spread over many tasks, and join the placements.

Defined cases: null and empty texts have one id (the end id); equal rows are packed like different ones; an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from motifcast.llm.common import checkpointed, documents

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
#: Runs whose ids a Python worker keeps, about (those not used for the longest time leave); characters encoded at once.
RECENT_RUNS, TOGETHER = 180_000, 1_000_000
#: Pieces that share a length and a salt, about; groups of that size are ranked in one task.
RANK_GROUP = 20_000

_loaded: dict = {}


class Recent(dict):
    """At most about ``size`` entries: when the younger half is full it becomes the older one, and what is used again moves up."""

    def __init__(self, size: int):
        super().__init__()
        self.half, self.older = size // 2, {}

    def missing(self, keys: set) -> set:
        """The keys that neither half holds; those of the older half move up. All other ``keys`` can be looked up afterwards."""
        if len(self) > self.half:
            self.older = dict(self)
            self.clear()
        new = keys.difference(self)
        again = new.intersection(self.older)
        self.update((k, self.older[k]) for k in again)
        return new - again


def _encoder(path: str):
    """Per worker: texts -> bytes of little-endian unsigned 32-bit ids.

    The tokenizer drops white space, cuts a text into runs of letters, digits and other signs, and never joins text across
    them. So a text is cut into its runs, and the tokenizer's BPE model encodes each new run; recent runs are kept with their
    ids. Texts with special tokens or unusual control signs go to the tokenizer as they are.
    """
    if path not in _loaded:
        import json
        from array import array

        import regex
        from tokenizers import Tokenizer

        tokenizer, runs = Tokenizer.from_file(path), Recent(RECENT_RUNS)
        special = [t["content"] for t in json.loads(tokenizer.to_str())["added_tokens"]]
        # How the tokenizer cuts a text into runs, and the same for lower-case letters up to U+017F.
        cut = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+").findall
        letters, numbers = "a-z\u00aa\u00b5\u00ba\u00df-\u00f6\u00f8-\u017f", "0-9\u00b2\u00b3\u00b9\u00bc-\u00be"
        cut_latin = re.compile(rf"[{letters}]+|'(?:s|t|re|ve|m|ll|d)|[{numbers}]|[^\s{letters}{numbers}]+").findall
        beyond = re.compile("[\u0130\u0180-\U0010ffff]").search
        # Byte-level BPE writes a byte as a character: printable Latin-1 as itself, the others from 256 on.
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        other = [b for b in range(256) if b not in set(shown)]
        sign = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(other)}
        bpe = tokenizer.model.tokenize

        def runs_of(text: str) -> list[str] | None:
            text = text.replace("\n", " ").replace("\t", " ").replace("\r", " ")
            if not text.isprintable() or "<|" in text and any(x in text for x in special):
                return None
            if text.isascii() or not beyond(text):
                return cut_latin(text.lower())
            return cut(tokenizer.normalizer.normalize_str(text))

        def encode(texts: list[str]) -> list[bytes]:
            cuts = [runs_of(t) for t in texts]
            for run in runs.missing(set().union(*(c for c in cuts if c))):
                text = run if run.isascii() else "".join([sign[b] for b in run.encode()])
                runs[run] = array("I", [t.id for t in bpe(text)]).tobytes()
            return [array("I", tokenizer.encode(t, add_special_tokens=False).ids).tobytes() if c is None else b"".join([runs[r] for r in c]) for t, c in zip(texts, cuts, strict=True)]

        _loaded[path] = encode
    return _loaded[path]


def text_parts(text: str, size: int) -> Iterator[str]:
    """The text in parts of about ``size`` characters, cut at spaces only, so that no run is cut."""
    at = 0
    while len(text) - at > 2 * size and (end := text.find(" ", at + size)) >= 0:
        yield text[at:end]
        at = end
    yield text[at:] if at else text


def _pieces_of(path: str, end_id: int, capacity: int):
    tail, step = end_id.to_bytes(4, "little"), 4 * capacity

    def encoded(texts: pa.Array) -> Iterator[bytes]:
        encode, part, size = _encoder(path), [], 0
        for i in range(len(texts)):  # about a million characters at a time
            text = texts[i].as_py() or ""
            if len(text) > 2 * TOGETHER:
                if part:
                    yield from (ids + tail for ids in encode(part))
                    part, size = [], 0
                yield b"".join([encode([t])[0] for t in text_parts(text, TOGETHER)]) + tail
                continue
            part.append(text)
            size += len(text)
            if size > TOGETHER:
                yield from (ids + tail for ids in encode(part))
                part, size = [], 0
        yield from (ids + tail for ids in encode(part) if part)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list[int]] = [[], [], [], [], []]
            for doc_id, ids in zip(batch.column(0).to_pylist(), encoded(batch.column(1)), strict=True):
                for at in range(0, len(ids), step):
                    part = ids[at : at + step]
                    for column, value in zip(out, (doc_id, at // 4, len(part) // 4, zlib.crc32(part), len(ids) // 4), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return run


def pieces(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 2) -> DataFrame:
    """One row per piece of a document: where it starts, its length, the CRC-32 of its ids, the document's ids."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_pieces_of(tokenizer, end_id, capacity), PIECES)


def pack_histogram(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Shortest-pack-first: (length, first rank, count, first sequence, offset) for each placement.

    Patterns are classes of equal packs, kept by the room left. The next length goes to the class with the most room (the
    shortest packs); a class that is larger than what is left to place is split by count.
    """
    placed, room, sequences = [], [], 0  # room: heap of (-left, first sequence, count)
    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            if room and -room[0][0] >= length:
                free, first, count = heapq.heappop(room)
                used = min(count, left)
                if count > used:
                    heapq.heappush(room, (free, first + used, count - used))
                free = -free
            else:
                free, first, used = capacity, sequences, left
                sequences += used
            placed.append((length, rank, used, first, capacity - free))
            if free > length:
                heapq.heappush(room, (length - free, first, used))
            rank, left = rank + used, left - used
    return placed


def ranked(rows: DataFrame, key: str, counts: dict[int, int], order: list[str], group: int = RANK_GROUP) -> DataFrame:
    """Rank from 0 within ``key`` as column ``rank``; a frequent key is cut into salts of about ``group`` rows."""
    spark = rows.sparkSession
    sizes = spark.createDataFrame([(k, -(-n // group)) for k, n in counts.items()] or [(0, 1)], f"{key} long, salts long")
    salted = rows.join(F.broadcast(sizes), key).withColumn("salt", F.pmod(F.xxhash64(*order), F.col("salts"))).drop("salts")
    before = Window.partitionBy(key).orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = salted.groupBy(key, "salt").agg(F.count(F.lit(1)).alias("n")).withColumn("offset_", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    within = Window.partitionBy(key, "salt").orderBy(*order)
    return (
        salted.withColumn("rank_", F.row_number().over(within))
        .join(offsets, [key, "salt"])
        .withColumn("rank", F.col("offset_") + F.col("rank_") - 1)
        .drop("salt", "offset_", "rank_")
    )


def pack(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 2) -> DataFrame:
    """Pack documents into sequences of at most ``capacity`` ids.

    Returns doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset: one row per piece.
    """
    cut = checkpointed(pieces(docs, tokenizer, capacity, end_id))
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    fields = [("length", "long"), ("rank_lo", "long"), ("used", "long"), ("first_sequence", "long"), ("offset", "long")]
    plan = docs.sparkSession.createDataFrame(pack_histogram(counts, capacity), T.StructType([T.StructField(n, T.LongType()) for n, _ in fields]))
    # A length has few placements; one array per length keeps the join's keys unique.
    slots = plan.groupBy("length").agg(F.array_sort(F.collect_list(F.struct("rank_lo", "used", "first_sequence", "offset"))).alias("slots"))
    order = ["doc_id", "start", "ids_crc32"]
    found = ranked(cut, "length", counts, order).join(F.broadcast(slots), "length")
    slot = F.element_at(F.filter("slots", lambda s: (s["rank_lo"] <= F.col("rank")) & (F.col("rank") < s["rank_lo"] + s["used"])), 1)
    return found.withColumn("slot", slot).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens",
        (F.col("slot.first_sequence") + F.col("rank") - F.col("slot.rank_lo")).alias("sequence_id"),
        F.col("slot.offset").alias("offset"),
    )


def word_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir), word_tokenizer())
