"""Line dedup: repeated runs of lines by distributed prefix doubling, in DataFrame functions only.

A run of consecutive lines with at least ``least_words`` words that occurs more than once stays at its first place (smallest
doc_id, then line); every line of its later copies is deleted. Lines are compared by two 64-bit hashes of different seeds, runs of
any length are found.

The suffix array over line ids is held as its intervals: at depth 2**k, suffixes that share their first 2**k lines form one
interval, named by the first place where those lines occur. Names double: a depth-2**(k+1) name is the first place of the
pair (name at p, name at p + 2**k). Places whose interval has one member leave, so what is kept shrinks to repeated runs.
A longest repeated run is covered by its shortest qualifying windows: from each start the first end, and from each end the
last start, with enough words. A window of n lines has the key (n, name at its start, name of its last 2**k lines), with
2**k <= n; the windows that are not first for their key are the later copies, and their union is the maximal later copies.

Texts that are copies of a whole earlier text take no part: all their lines go if they have enough words, none otherwise.

Defined cases: a null doc_id counts as the smallest one, and rows with it are told apart by their texts; null and empty texts have no line to delete and stay; blank lines count as lines of no words; rows with the
same doc_id and text are one place; texts without repeats are unchanged; a text of which all lines go becomes empty; an empty
table gives an empty result; extra columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from motifcast.llm.common import bounded_broadcast, checkpointed, documents

LEAST_WORDS = 50
PLACE = ["doc_id", "tie", "line"]
#: Stands for a null doc_id in keys.
NO_ID = -(1 << 63)


def word_count(line: Column) -> Column:
    """Words between spaces."""
    return F.size(F.array_remove(F.split(line, " ", -1), ""))


def _place(line: Column | None = None) -> Column:
    return F.struct("doc_id", "tie", (F.col("line") if line is None else line).alias("line"))


def named(rows: DataFrame, key: list[str]) -> DataFrame:
    """Rows whose key occurs at several places, with ``name``: the first of these places."""
    classes = rows.groupBy(*key).agg(F.min(_place()).alias("name"), F.max(_place()).alias("last")).where("name <> last").drop("last")
    return rows.join(checkpointed(classes), key)


def shortest_windows(rows: DataFrame, least_words: int) -> DataFrame:
    """(doc_id, tie, line, n): windows of n consecutive rows with enough words; the shortest from each start and to each end."""
    doc = Window.partitionBy("doc_id", "tie").orderBy("line")
    island = rows.withColumn("island", F.col("line") - F.row_number().over(doc))
    along = Window.partitionBy("doc_id", "tie", "island").orderBy("line")
    summed = island.withColumn("upto", F.sum("words").over(along)).withColumn("before", F.col("upto") - F.col("words"))
    keep = ["doc_id", "tie", "island", "line"]
    ends = summed.select(*keep, F.col("upto").alias("at"), F.lit(0).alias("asks"))
    ask_end = summed.select(*keep, (F.col("before") + least_words).alias("at"), F.lit(1).alias("asks"))
    starts = summed.select(*keep, F.col("before").alias("at"), F.lit(0).alias("asks"))
    ask_start = summed.select(*keep, (F.col("upto") - least_words).alias("at"), F.lit(1).alias("asks"))
    from_above = Window.partitionBy("doc_id", "tie", "island").orderBy(F.desc("at"), "asks").rowsBetween(Window.unboundedPreceding, 0)
    from_below = Window.partitionBy("doc_id", "tie", "island").orderBy("at", "asks").rowsBetween(Window.unboundedPreceding, 0)
    answer = F.when(F.col("asks") == 0, F.col("line"))
    forward = ends.unionByName(ask_end).withColumn("end", F.min(answer).over(from_above)).where("asks = 1 and end is not null")
    backward = starts.unionByName(ask_start).withColumn("start", F.max(answer).over(from_below)).where("asks = 1 and start is not null")
    return (
        forward.select("doc_id", "tie", "line", (F.col("end") - F.col("line") + 1).alias("n"))
        .unionByName(backward.select("doc_id", "tie", F.col("start").alias("line"), (F.col("line") - F.col("start") + 1).alias("n")))
        .distinct()
    )


def later_copies(lines: DataFrame, least_words: int) -> DataFrame:
    """(doc_id, tie, line, n): windows that occur at an earlier place. ``lines``: doc_id, tie, line, h1, h2, words."""
    names = checkpointed(named(lines, ["h1", "h2"]).select(*PLACE, "words", "name"))
    windows = checkpointed(shortest_windows(names.select(*PLACE, "words"), least_words).withColumn("k", F.floor(F.log2(F.col("n") + F.lit(0.5))).cast("int")))
    names = names.drop("words")
    found, k = None, 0
    while True:
        half = names.select("doc_id", "tie", F.col("line").alias("line_"), F.col("name").alias("name_"))
        here = windows.where(F.col("k") == k)
        keyed = here.join(names, PLACE).withColumn("line_", F.col("line") + F.col("n") - (1 << k)).join(half, ["doc_id", "tie", "line_"]).drop("line_")
        copies = _not_first(keyed)
        found = copies if found is None else found.unionByName(copies)
        windows = windows.where(F.col("k") > k)
        if windows.isEmpty():
            return found
        pairs = names.withColumn("line_", F.col("line") + (1 << k)).join(half, ["doc_id", "tie", "line_"]).drop("line_").withColumnRenamed("name", "name0")
        names = checkpointed(named(pairs, ["name0", "name_"]).select(*PLACE, "name"))
        k += 1


def _not_first(windows: DataFrame) -> DataFrame:
    key = ["n", "name", "name_"]
    first = windows.groupBy(*key).agg(F.min(_place()).alias("first"), F.max(_place()).alias("last")).where("first <> last").drop("last")
    return checkpointed(windows.join(checkpointed(first), key).where(_place() != F.col("first")).select(*PLACE, "n"))


def deleted_lines(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """doc_id (``NO_ID`` for null), tie (hash of the text), lines: numbers from 0 of the lines to delete; null for the whole text."""
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))
    hashed = texts.select("doc_id", "tie", F.xxhash64(F.lit(1), "text").alias("tie2"), F.size(F.array_remove(F.split(F.col("text"), "[ \n]", -1), "")).alias("words")).distinct()
    hashed = checkpointed(hashed)
    copied = checkpointed(hashed.groupBy("tie", "tie2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first <> last").drop("last"))
    copies = checkpointed(hashed.join(copied, ["tie", "tie2"]).where("doc_id <> first").select("doc_id", "tie", "words"))

    lines = texts.select("doc_id", "tie", F.posexplode(F.split("text", "\n", -1)).alias("line", "said"))
    lines = lines.select(*PLACE, F.xxhash64("said").alias("h1"), F.xxhash64(F.lit(1), "said").alias("h2"), word_count(F.col("said")).alias("words"))
    lines = lines.join(bounded_broadcast(copies.select("doc_id", "tie"), copies.count()), ["doc_id", "tie"], "left_anti")
    covered = later_copies(lines, least_words).select("doc_id", "tie", F.explode(F.sequence("line", F.col("line") + F.col("n") - 1)).alias("line"))
    runs = covered.groupBy("doc_id", "tie").agg(F.collect_set("line").alias("lines"))
    return runs.unionByName(copies.where(F.col("words") >= least_words).select("doc_id", "tie", F.lit(None).cast("array<int>").alias("lines")))


def dedup_lines(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """``docs`` with the later copies of repeated runs deleted from ``text``, and n_lines, n_deleted (they replace columns of these names)."""
    gone = checkpointed(deleted_lines(docs, least_words).select("doc_id", "tie", F.struct("lines").alias("gone")))
    rows = docs.select(F.struct("*").alias("row"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumns({"id": F.coalesce(F.col("row.doc_id").cast("long"), F.lit(NO_ID)), "hash": F.xxhash64("text")})
    joined = rows.join(bounded_broadcast(gone, gone.count()), (F.col("id") == F.col("doc_id")) & (F.col("hash") == F.col("tie")), "left")
    lines, mask = F.split("text", "\n", -1), F.col("gone.lines")
    n_lines = F.size(lines)
    stay = F.array_except(F.sequence(F.lit(0), n_lines - 1), mask)
    rest = F.array_join(F.transform(stay, lambda i: F.get(F.col("lines"), i)), "\n")
    clean = F.when(F.col("gone").isNull(), F.col("row.text")).when(mask.isNull(), F.lit("")).otherwise(rest)
    n_deleted = F.when(F.col("gone").isNull(), F.lit(0)).when(mask.isNull(), n_lines).otherwise(F.size(mask))
    made = {"text": clean, "n_lines": n_lines.cast("long"), "n_deleted": n_deleted.cast("long")}
    out = joined.withColumn("lines", F.when(mask.isNotNull(), lines))
    names = [*docs.columns, *(x for x in ("n_lines", "n_deleted") if x not in docs.columns)]
    return out.select(*[made[x].alias(x) if x in made else F.col("row")[x].alias(x) for x in names])


def op7_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(documents(spark, sf_dir))
    return out.select("doc_id", "n_lines", "n_deleted", F.sha2(F.coalesce("text", F.lit("")), 256).alias("clean_sha256"))


ORACLE = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS said, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS line FROM documents
), w AS (
  SELECT *, len(list_filter(string_split(said, ' '), lambda x: x <> '')) AS words, count(*) OVER (PARTITION BY said) AS times FROM l
), s AS (
  SELECT *, sum(words) OVER (PARTITION BY doc_id ORDER BY line) AS upto, sum((times = 1)::INT) OVER (PARTITION BY doc_id ORDER BY line) AS single FROM w
), win AS (
  SELECT a.doc_id, a.line AS p, e.line AS q
  FROM s a JOIN s e ON a.doc_id = e.doc_id AND a.line <= e.line AND a.times > 1 AND a.single = e.single AND e.upto - (a.upto - a.words) >= 50
  WHERE e.upto - e.words - (a.upto - a.words) < 50 OR e.upto - a.upto < 50
), said AS (
  SELECT doc_id, p, q, string_agg(said, chr(10) ORDER BY line) AS said FROM win JOIN l USING (doc_id) WHERE line BETWEEN p AND q GROUP BY ALL
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY said ORDER BY doc_id, p) AS r FROM said
), gone AS (
  SELECT DISTINCT l.doc_id, l.line FROM ranked JOIN l ON l.doc_id = ranked.doc_id AND l.line BETWEEN p AND q WHERE r > 1
)
SELECT l.doc_id, count(*) AS n_lines, count(gone.line) AS n_deleted,
       sha256(coalesce(string_agg(said, chr(10) ORDER BY l.line) FILTER (WHERE gone.line IS NULL), '')) AS clean_sha256
FROM l LEFT JOIN gone ON gone.doc_id = l.doc_id AND gone.line = l.line GROUP BY l.doc_id
"""
