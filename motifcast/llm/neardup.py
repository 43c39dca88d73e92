"""Near-duplicate groups: banded MinHash candidates, odd-sketch screening, exact confirmation on full shingle sets.

1. One Arrow pass over the texts gives each document's shingle-set size, a 128-bit hash of the whole set and its MinHash band
   keys. Documents with equal sets are one class with its smallest doc_id as representative; copies are never compared.
2. Representatives that share a band also get, once, their shingle set (64-bit hashes) and an odd sketch: each of ``SAMPLES``
   MinHash samples flips one bit of a bitmap, so the XOR of two bitmaps holds the samples that differ, and its population count
   estimates high similarities closely. Pairs are screened by size ratio and odd sketch, and confirmed on the full sets.
3. Two rounds of centres: every bucket compares one member with its others, so n alike texts cost n pairs, not n squared; a
   bucket whose members are one component is done.
4. What is left are members of different components in one bucket: texts that share a passage, or the fringe of a group. A
   shingle of one component alone is in no intersection of interest; so a text with ``shared`` others has at most ``shared`` in
   common with any text it may still be linked to. Texts for which that rules out the least similarity leave, which lowers the
   count of others; this is exact and costs one count over shingles, no pairs. The rest meet in longer bands, where the same bound, for the two
   sizes of a pair, stands in the join's condition with the sketch screen.
5. Connected components over the confirmed links, and a join of every document to its class.

A pair at the least similarity shares no band with probability 1 - (1 - 0.75**4)**32 = 5e-6 of the first kind, fails the screen
(four standard errors) with about 3e-5, and more similar pairs do so less often.

Defined cases: texts without words (or null) have no shingles and no links; texts of fewer than five words are one shingle;
rows that repeat a doc_id share its component (of texts that differ under one doc_id as representative, one is compared); a null
doc_id gets the component of its copies, else null and is kept; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from motifcast.llm.common import bounded_broadcast, checkpointed, documents, settled
from motifcast.llm.components import components

WORDS, BANDS, ROWS = 5, 32, 4
#: MinHash samples and bits of an odd sketch: at a similarity of 0.75 the estimate's standard error is about 0.020.
SAMPLES, SKETCH_BITS = 512, 2048
LEAST_PERCENT = 75
#: Pairs whose estimated similarity is below this are not confirmed; four standard errors under the threshold.
SCREEN = 0.67
#: Times that texts without enough shared shingles leave.
PEELS = 3

SIGNATURE = "doc_id long, n_shingles long, set_hash binary, bands array<long>"
SKETCH = "rep long, n long, sketch array<long>, bands array<long>, shingles binary"
#: Members that are compared with one centre in one task, about.
SALT_GROUP = 20_000
#: Bands of the second cut, from the sketch's samples: a pair at the least similarity misses all of them with 2e-5.
BANDS2, ROWS2 = 56, 6
#: Members of a bucket that one task compares with as many others; larger buckets are cut into pairs of such blocks.
BLOCK = 1_024

_rng = np.random.default_rng(20240501)
_A = _rng.integers(1, 1 << 32, BANDS * ROWS + SAMPLES, dtype=np.uint32) | np.uint32(1)
_B = _rng.integers(0, 1 << 32, BANDS * ROWS + SAMPLES, dtype=np.uint32)
_P = np.uint64(0x9E3779B97F4A7C15)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 100_000:
            self.clear()
        h = self[word] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        return h


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, hashes: dict) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's five-word shingles."""
    words = (text or "").encode("utf-8", "replace").lower().split()  # bytes: only A-Z, and only the six ASCII spaces
    if not words:
        return np.zeros(0, dtype=np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), dtype=np.uint64, count=len(words))
    width = min(WORDS, len(h))
    n = len(h) - width + 1
    s = np.full(n, width, dtype=np.uint64)
    for k in range(width):
        s = s * _P + h[k : k + n]
    return np.unique(_mix(s))


def _minhash(s: np.ndarray, of: slice) -> np.ndarray:
    """MinHash samples of a set of hashes, by the hash functions of the given numbers."""
    a, b = _A[of], _B[of]
    x, least = (s >> np.uint64(32)).astype(np.uint32), np.full(len(a), 0xFFFFFFFF, dtype=np.uint32)
    for at in range(0, len(x), 1024):
        least = np.minimum(least, (x[at : at + 1024, None] * a + b).min(0))
    return least


def _band_keys(samples: np.ndarray, bands: int, rows: int) -> np.ndarray:
    m, key = samples.astype(np.uint64), np.arange(bands, dtype=np.uint64)
    for k in range(rows):
        key = _mix(key * _P + m[k * bands : (k + 1) * bands])
    return key.view(np.int64)


def _signatures(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = _WordHashes()
    for batch in batches:
        sizes, sets, bands = [], [], []
        for text in batch.column(1):
            s = shingle_set(text.as_py(), hashes)
            sizes.append(len(s))
            if not len(s):
                sets.append(None)
                bands.append(None)
                continue
            sets.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
            bands.append(_band_keys(_minhash(s, slice(0, BANDS * ROWS)), BANDS, ROWS))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(sets, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], ["doc_id", "n_shingles", "set_hash", "bands"])


def odd_sketch(samples: np.ndarray) -> np.ndarray:
    """Parity bitmap, as 64-bit integers: each MinHash sample flips the bit that its number and value hash to."""
    bits = (_mix(samples.astype(np.uint64) * _P + np.arange(SAMPLES, dtype=np.uint64)) % np.uint64(SKETCH_BITS)).astype(np.int64)
    return np.packbits(np.bincount(bits, minlength=SKETCH_BITS).astype(np.uint8) & 1).view(np.int64)


def _sketches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(rep, set_hash, text) -> ``SKETCH``; rows whose text has another shingle set are left out."""
    hashes, longs = _WordHashes(), pa.list_(pa.int64())
    for batch in batches:
        out: list[list] = [[], [], [], [], []]
        for rep, set_hash, text in zip(*batch.columns, strict=True):
            s = shingle_set(text.as_py(), hashes)
            if hashlib.blake2b(s.tobytes(), digest_size=16).digest() == set_hash.as_py():
                samples = _minhash(s, slice(BANDS * ROWS, None))
                for column, value in zip(out, (rep.as_py(), len(s), odd_sketch(samples), _band_keys(samples, BANDS2, ROWS2), s.tobytes()), strict=True):
                    column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, (pa.int64(), pa.int64(), longs, longs, pa.binary()), strict=True)], ["rep", "n", "sketch", "bands", "shingles"])


def differing_bits(x: Column, y: Column) -> Column:
    """Bits in which two odd sketches differ."""
    return reduce(lambda a, b: a + b, [F.bit_count(F.get(x, F.lit(i)).bitwiseXOR(F.get(y, F.lit(i)))) for i in range(SKETCH_BITS // 64)])


def odd_similarity(x: Column, y: Column) -> Column:
    """Similarity estimated from two odd sketches; 0 where they differ in half of the bits or more."""
    inside = 1 - 2 * differing_bits(x, y) / SKETCH_BITS
    return F.when(inside > 0, 1 + SKETCH_BITS / (4 * SAMPLES) * F.log(inside)).otherwise(0.0)


#: The screen as a number of bits: differing in more, the estimate is below ``SCREEN``.
_MOST_BITS = math.floor(SKETCH_BITS / 2 * (1 - math.exp(4 * SAMPLES / SKETCH_BITS * (SCREEN - 1))))


def _alike(n: Column, sketch: Column, m: Column, other: Column) -> Column:
    return (100 * F.least(n, m) >= LEAST_PERCENT * F.greatest(n, m)) & (differing_bits(sketch, other) <= _MOST_BITS)


def _confirm(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        linked = []
        for x, y in zip(batch.column(2), batch.column(3), strict=True):
            x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            linked.append(100 * both >= LEAST_PERCENT * (len(x) + len(y) - both))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(linked, pa.bool_())], ["a", "b", "linked"])


def _of(kept: DataFrame, x: str, *columns: str) -> DataFrame:
    """The given columns of representatives, named for side ``x`` of a pair."""
    return kept.select(F.col("rep").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in columns])


def _links(pairs: DataFrame, kept: DataFrame, screened: bool = False) -> DataFrame:
    """The pairs (a, b) that are similar enough: screened by sketch, then confirmed on full sets.

    Few distinct ``a`` may have very many ``b``; each is dealt to as many tasks as its pairs need."""
    if not screened:
        seen = pairs.join(_of(kept, "a", "n", "sketch"), "a").join(_of(kept, "b", "n", "sketch"), "b")
        pairs = seen.where(_alike(F.col("n_a"), F.col("sketch_a"), F.col("n_b"), F.col("sketch_b"))).select("a", "b")
    pairs = checkpointed(pairs)
    salts = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / SALT_GROUP).cast("int").alias("salts"))
    centres = _of(kept, "a", "shingles").join(salts, "a").select("a", "shingles_a", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    salted = pairs.join(_of(kept, "b", "shingles"), "b").join(salts, "a").withColumn("salt", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int"))
    full = salted.join(centres, ["a", "salt"]).select("a", "b", "shingles_a", "shingles_b")
    return checkpointed(full.mapInArrow(_confirm, "a long, b long, linked boolean").where("linked").select("a", "b"))


def _unpacked(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(rep, component, shingles) -> (rep, component, shingle), a row each."""
    for batch in batches:
        for rep, component, shingles in zip(*batch.columns, strict=True):
            values = pa.Array.from_buffers(pa.int64(), len(shingles.as_buffer()) // 8, [None, shingles.as_buffer()])
            yield pa.RecordBatch.from_arrays([pa.repeat(rep, len(values)), pa.repeat(component, len(values)), values], ["rep", "component", "shingle"])


def _with_shared(rows: DataFrame, kept: DataFrame) -> DataFrame:
    """(rep, component, n) with ``shared``: how many of the text's shingles a text of another component has.

    A shingle of one component alone is found by its least and largest component; rows are not paired, and a shingle that very
    many rows have is one row on the other side of the join, which adaptive execution splits. Shingle sets are read where they
    are kept, so only single shingles and narrow rows are shuffled."""
    placed = _of(kept, "rep", "shingles").join(bounded_broadcast(rows.select("rep", "component"), rows.count()), "rep")
    said = placed.select("rep", "component", "shingles_rep").mapInArrow(_unpacked, "rep long, component long, shingle long")
    alone = said.groupBy("shingle").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo = hi").select("shingle")
    own = said.join(alone, "shingle", "left_semi").groupBy("rep").agg(F.count(F.lit(1)).alias("own"))
    return rows.join(own, "rep", "left").withColumn("shared", F.col("n") - F.coalesce("own", F.lit(0))).drop("own")


def _possible(shared: Column, sizes: Column) -> Column:
    """May sets of these sizes (their sum) with at most ``shared`` in common reach the least similarity?"""
    return (100 + LEAST_PERCENT) * shared >= LEAST_PERCENT * sizes


def _open(placed: DataFrame, centre: Column) -> DataFrame:
    """The rows of buckets that hold several components, with ``a``: the member that ``centre`` puts first, and its component."""
    first = F.min_by(F.struct("rep", "component"), centre).alias("a")
    buckets = placed.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), first).where("lo <> hi").select("bucket", "a")
    return placed.join(buckets, "bucket")


def _compare(table: pa.Table) -> pa.Table:
    """One block of a bucket (rows of one or two parts of it): pairs of different components that pass the bounds and the screen,
    each only in the first band that the two share."""
    if table.num_rows < 2:
        return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
    rep, component, n, shared, part, band, i, j = (table.column(c).to_numpy() for c in ("rep", "component", "n", "shared", "part", "band", "i", "j"))
    sketch = np.array(table.column("sketch").to_pylist(), dtype=np.int64).view(np.uint64)
    earlier = np.array(table.column("marks").to_pylist(), dtype=np.int32)[:, : band[0]]
    left, right = np.flatnonzero(part == i[0]), np.flatnonzero(part == j[0])
    found: tuple[list, list] = ([], [])
    for x in left:
        y = right[rep[right] > rep[x]] if i[0] == j[0] else right
        y = y[component[y] != component[x]]
        y = y[(100 * np.minimum(n[x], n[y]) >= LEAST_PERCENT * np.maximum(n[x], n[y])) & ((100 + LEAST_PERCENT) * np.minimum(shared[x], shared[y]) >= LEAST_PERCENT * (n[x] + n[y]))]
        y = y[np.bitwise_count(sketch[y] ^ sketch[x]).sum(1) <= _MOST_BITS]
        y = y[~(earlier[y] == earlier[x]).any(1)]
        found[0].extend(np.minimum(rep[x], rep[y]).tolist())
        found[1].extend(np.maximum(rep[x], rep[y]).tolist())
    return pa.table({"a": pa.array(found[0], pa.int64()), "b": pa.array(found[1], pa.int64())})


def _likely(rest: DataFrame) -> DataFrame:
    """Pairs (a, b) of different components that share a longer band and may be similar enough.

    The members of a bucket are dealt to parts of about ``BLOCK``, and each pair of parts is one group: groups are bounded
    whatever the bucket's size. ``marks`` (32 bits of each band key) tell a bucket that it is not the first one two rows share."""
    marks = F.transform("bands", lambda k: F.shiftright(k, 32).cast("int"))
    rows = rest.select("rep", "component", "n", "shared", "sketch", marks.alias("marks"), F.posexplode("bands").alias("band", "bucket"))
    buckets = rows.groupBy("bucket", "band").agg(F.count(F.lit(1)).alias("k"), F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi")
    parts = buckets.select("bucket", "band", F.ceil(F.col("k") / BLOCK).cast("int").alias("parts"))
    dealt = rows.join(parts, ["bucket", "band"]).withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumns({"i": F.least("part", "other"), "j": F.greatest("part", "other")})
    return dealt.drop("parts", "other").groupBy("bucket", "i", "j").applyInArrow(_compare, "a long, b long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs``."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = checkpointed(docs.mapInArrow(_signatures, SIGNATURE))
    classes = checkpointed(signed.where("n_shingles > 0").groupBy("set_hash").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands")))
    reps = classes.where("rep is not null").groupBy("rep").agg(F.min_by(F.struct("set_hash", "bands"), "set_hash").alias("x")).select("rep", "x.set_hash", "x.bands")

    rows = reps.select("rep", F.explode("bands").alias("bucket"))
    firsts = rows.groupBy("bucket").agg(F.min("rep").alias("a"), F.max("rep").alias("z")).where("a <> z").select("bucket", "a")
    members = checkpointed(rows.join(firsts, "bucket").where("rep <> a"))
    ids = checkpointed(members.select("rep").unionByName(members.select(F.col("a").alias("rep"))).distinct())
    near_ids = bounded_broadcast(reps.select(F.col("rep").alias("doc_id"), "set_hash").join(ids.withColumnRenamed("rep", "doc_id"), "doc_id", "left_semi"), ids.count())
    kept = checkpointed(docs.join(near_ids, "doc_id").select("doc_id", "set_hash", "text").mapInArrow(_sketches, SKETCH).dropDuplicates(["rep"]))

    groups = ids.select("rep", F.col("rep").alias("component"))
    links = docs.sparkSession.createDataFrame([], "a long, b long")

    def grouped(found: DataFrame) -> None:
        nonlocal groups, links
        if not found.isEmpty():
            links = links.unionByName(found)
            groups = settled(docs.sparkSession, lambda: ids.join(components(links).withColumnRenamed("node", "rep"), "rep", "left").select("rep", F.coalesce("component", "rep").alias("component")))

    grouped(_links(members.select("a", F.col("rep").alias("b")).distinct(), kept))
    left = checkpointed(_open(members.drop("a").join(groups, "rep"), F.xxhash64("rep")))
    grouped(_links(left.where("component <> a.component").select("a.rep", F.col("rep").alias("b")).toDF("a", "b").distinct(), kept))

    open_ = _open(left.where("rep <> a.rep").select("bucket", "rep").join(groups, "rep"), F.col("rep")).select("rep", "component").distinct()
    rest = checkpointed(kept.select("rep", "n").join(open_, "rep").select("rep", "component", "n"))
    for _ in range(PEELS):
        rest = checkpointed(_with_shared(rest.select("rep", "component", "n"), kept).where(_possible(F.col("shared"), F.col("n") + F.col("shared"))))
    likely = kept.select("rep", "sketch", "bands").join(bounded_broadcast(rest, rest.count()), "rep")
    grouped(_links(_likely(likely), kept, screened=True))

    found = checkpointed(classes.select("set_hash", "rep").join(groups, "rep", "left").select("set_hash", F.coalesce("component", "rep").alias("component_id")))
    out = signed.select("doc_id", "n_shingles", "set_hash").join(found, "set_hash", "left")
    out = out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()))


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END)) AS s FROM w
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), shared AS MATERIALIZED (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL
), link AS MATERIALIZED (
  SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)
), pair AS MATERIALIZED (
  SELECT a, b FROM link UNION SELECT b, a FROM link
), reach(a, b) AS (
  SELECT a, b FROM pair UNION SELECT r.a, p.b FROM reach r JOIN pair p ON p.a = r.b
), low AS (
  SELECT a, min(b) AS b FROM reach GROUP BY a
)
SELECT doc_id, coalesce(n.n, 0) AS n_shingles, least(doc_id, coalesce(low.b, doc_id)) AS component_id, doc_id <= coalesce(low.b, doc_id) AS kept
FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN low ON low.a = doc_id
"""
