"""Pattern workloads: drawing patterns from a graph, and checking, classifying and configuring them.

A workload is rows (pattern, vids): a set of data vertices; its induced edges with renumbered ids are the pattern. Walkers are
rows, and each step is a join, so any number of patterns is drawn at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from motifcast.functions.frames import among, checkpointed
from motifcast.functions.ordered import numbered
from motifcast.functions.random import prn, prn_bits


def _near(edges: DataFrame, ends: DataFrame) -> DataFrame:
    """Distinct pairs from the ``ends`` (one column), and a few others: no more are shuffled, once, by their source."""
    return among(edges.select("src", "dst"), ["src"], ends).repartition("src").distinct()


def sample_paths(edges: DataFrame, starts: DataFrame, size: int, salt: str) -> DataFrame:
    """Non-repeating random walks from (pattern, vid): (pattern, vids); walks that get stuck go."""
    two63, two64 = (F.lit(str(1 << n)).cast("decimal(20,0)") for n in (63, 64))
    pairs = edges.select("src", "dst")  # a repeated pair changes no least
    walk = starts.select("pattern", F.array("vid").alias("vids")).distinct()
    for step in range(1, size):
        ends = walk.withColumn("src", F.element_at("vids", -1))
        options = ends.hint("shuffle_hash").join(among(pairs, ["src"], ends.select("src")), "src").where(~F.array_contains("vids", F.col("dst")))
        # The least (number, vertex) as one whole number below 2**96: a decimal is kept in place, so options are not sorted.
        key = prn_bits(F.concat_ws("-", "pattern", "dst"), f"{salt}-{step}").cast("decimal(10,0)") * two64 + (F.col("dst").cast("decimal(19,0)") + two63)
        least = options.groupBy("pattern").agg(F.min(key.cast("decimal(38,0)")).alias("_k"))
        dst = (F.col("_k") % two64 - two63).cast("long")
        walk = checkpointed(walk.join(least, "pattern").select("pattern", F.array_append("vids", dst).alias("vids")))
    return walk


def sample_stars(edges: DataFrame, starts: DataFrame, size: int, salt: str) -> DataFrame:
    """A centre and size-1 of its neighbours, filled from two hops away if there are too few."""
    one = checkpointed(starts.withColumnRenamed("vid", "src").join(_near(edges, starts.select("vid")), "src").select("pattern", F.col("src").alias("centre"), "dst", F.lit(1).alias("hop")))
    few = one.groupBy("pattern").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") < size - 1).select("pattern")
    short = checkpointed(one.join(few, "pattern", "left_semi").select("pattern", "centre", F.col("dst").alias("src")))
    two = short.join(_near(edges, short.select("src")), "src").where("dst <> centre").select("pattern", "centre", "dst", F.lit(2).alias("hop"))
    every = one.unionByName(two).groupBy("pattern", "centre", "dst").agg(F.min("hop").alias("hop"))
    order = Window.partitionBy("pattern").orderBy("hop", prn(F.concat_ws("-", "pattern", "dst"), salt), "dst")
    kept = every.withColumn("r", F.row_number().over(order)).where(F.col("r") < size)
    return kept.groupBy("pattern", "centre").agg(F.array_sort(F.collect_list("dst")).alias("leaves")).select("pattern", F.concat(F.array("centre"), "leaves").alias("vids"))


def sample_trees(edges: DataFrame, starts: DataFrame, size: int, salt: str) -> DataFrame:
    """Connected sets: each frontier vertex takes 1 to 3 random new neighbours per level until the size is reached."""
    sets = starts.select("pattern", F.array("vid").alias("vids"), F.array("vid").alias("front"))
    for level in range(size):
        front = sets.where(F.size("vids") < size).select("pattern", "vids", F.explode("front").alias("src"))
        grown = front.hint("shuffle_hash").join(_near(edges, front.select("src")), "src").where(~F.array_contains("vids", F.col("dst"))).select("pattern", "src", "dst")
        order = Window.partitionBy("pattern", "src").orderBy(prn(F.concat_ws("-", "pattern", "src", "dst"), f"{salt}-{level}"), "dst")
        take = 1 + F.floor(3 * prn(F.concat_ws("-", "pattern", "src"), f"{salt}-k{level}"))
        picked = grown.withColumn("r", F.row_number().over(order)).where((F.col("r") <= 3) & (F.col("r") <= take))
        new = picked.groupBy("pattern").agg(F.array_sort(F.collect_set("dst")).alias("new"))
        sets = checkpointed(sets.join(new, "pattern", "left").withColumn("new", F.slice(F.coalesce("new", F.array().cast("array<bigint>")), F.lit(1), F.greatest(size - F.size("vids"), F.lit(0)))).select("pattern", F.concat("vids", "new").alias("vids"), F.col("new").alias("front")))
    return sets.where(F.size("vids") == size).select("pattern", "vids")


def sample_cycles(edges: DataFrame, starts: DataFrame, size: int, salt: str) -> DataFrame:
    """Walks whose ends are adjacent; for the others connected sets with at least as many edges as vertices."""
    paths = sample_paths(edges, starts, size, salt).withColumn("src", F.element_at("vids", -1)).withColumn("dst", F.element_at("vids", 1))
    closing = among(among(edges.select("src", "dst"), ["src"], paths.select("src")), ["dst"], paths.select("dst"))
    closed = paths.join(closing, ["src", "dst"], "left_semi").select("pattern", "vids")
    rest = sample_trees(edges, starts.join(closed, "pattern", "left_anti"), size, salt)
    rest = checkpointed(rest)
    dense = induced_edges(rest, edges_between(rest, edges)).groupBy("pattern").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= size)
    return closed.unionByName(rest.join(dense, "pattern", "left_semi").select("pattern", "vids"))


def edges_between(patterns: DataFrame, edges: DataFrame) -> DataFrame:
    """The edges with both ends in some pattern, and a few others: all that ``induced_edges`` has to shuffle."""
    return among(edges, ["src", "dst"], patterns.select(F.explode("vids").alias("vid")))


def induced_edges(patterns: DataFrame, edges: DataFrame) -> DataFrame:
    """(pattern, u, v, elabel) with renumbered ids, u < v: all edges between a pattern's vertices, each once.

    ``edges`` has both directions; one of them is joined, by its smaller end."""
    first = patterns.select("pattern", "vids", F.posexplode("vids").alias("u", "x"))
    pairs = first.select("pattern", "u", "x", F.posexplode("vids").alias("v", "y")).where("u < v")  # a few for each pattern, so no hub's edges are made
    pairs = pairs.select("pattern", "u", "v", F.least("x", "y").alias("src"), F.greatest("x", "y").alias("dst"))
    return pairs.hint("shuffle_hash").join(edges.where("src <= dst"), ["src", "dst"]).select("pattern", "u", "v", "elabel").distinct()


def pattern_vertices(patterns: DataFrame, labels: DataFrame, induced: DataFrame) -> DataFrame:
    """(pattern, q, label, degree) of the renumbered vertices."""
    ends = induced.select("pattern", F.explode(F.array("u", "v")).alias("q")).groupBy("pattern", "q").agg(F.count(F.lit(1)).alias("degree"))
    long = patterns.select("pattern", F.posexplode("vids").alias("q", "vid")).join(labels.select("vid", "label"), "vid")
    return long.join(ends, ["pattern", "q"], "left").select("pattern", "q", "label", F.coalesce("degree", F.lit(0)).alias("degree"))


def accept_by_label(vertices: DataFrame, label: int, most: int, decay: float, salt: str) -> DataFrame:
    """Patterns with 1 to ``most`` vertices of the label, kept with chance decay^(count - 1)."""
    n = vertices.groupBy("pattern").agg(F.sum((F.col("label") == label).cast("int")).alias("n"))
    return n.where((F.col("n") > 0) & (F.col("n") <= most) & (prn(F.col("pattern"), salt) < F.pow(F.lit(decay), F.col("n") - 1))).select("pattern", "n")


def canonical(vertices: DataFrame, induced: DataFrame) -> DataFrame:
    """(pattern, text, hash): a text form with sorted lines, and its md5."""
    v = vertices.groupBy("pattern").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("q", "label", "degree"))), lambda x: F.concat_ws(" ", F.lit("v"), x["q"].cast("string"), x["label"].cast("string"), x["degree"].cast("string"))), "\n").alias("vt"), F.count(F.lit(1)).alias("nv"))
    e = induced.groupBy("pattern").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("u", "v"))), lambda x: F.concat_ws(" ", F.lit("e"), x["u"].cast("string"), x["v"].cast("string"))), "\n").alias("et"), F.count(F.lit(1)).alias("ne"))
    text = F.concat_ws("\n", F.concat_ws(" ", F.lit("t"), F.col("nv").cast("string"), F.coalesce("ne", F.lit(0)).cast("string")), "vt", "et")
    return v.join(e, "pattern", "left").select("pattern", text.alias("text")).withColumn("hash", F.md5("text"))


def drop_duplicate_patterns(texts: DataFrame) -> DataFrame:
    """The first pattern of each hash."""
    return texts.groupBy("hash").agg(F.min("pattern").alias("pattern"))


def classify(vertices: DataFrame, induced: DataFrame) -> DataFrame:
    """(pattern, kind): path, star, tree, cycle or dense; null if disconnected (labels spread over at most ten vertices)."""
    both = induced.select("pattern", F.col("u").alias("a"), F.col("v").alias("b")).unionByName(induced.select("pattern", F.col("v").alias("a"), F.col("u").alias("b")))
    reach = vertices.select("pattern", "q", F.col("q").alias("root"))
    for _ in range(4):  # pointer spread: 2**4 steps
        near = both.join(reach.withColumnRenamed("q", "b"), ["pattern", "b"]).groupBy("pattern", F.col("a").alias("q")).agg(F.min("root").alias("r"))
        hop = reach.join(near, ["pattern", "q"], "left").select("pattern", "q", F.least("root", F.coalesce("r", "root")).alias("root"))
        jump = hop.join(hop.select("pattern", F.col("q").alias("root"), F.col("root").alias("up")), ["pattern", "root"])
        reach = checkpointed(jump.select("pattern", "q", F.least("root", "up").alias("root")))
    roots = reach.groupBy("pattern").agg(F.countDistinct("root").alias("parts"))
    shape = vertices.groupBy("pattern").agg(F.count(F.lit(1)).alias("n"), (F.sum("degree") / 2).cast("int").alias("m"), F.max("degree").alias("top"), F.sum((F.col("degree") == 2).cast("int")).alias("twos"))
    kind = (
        F.when((F.col("m") == F.col("n") - 1) & (F.col("top") <= 2), "path").when((F.col("m") == F.col("n") - 1) & (F.col("top") == F.col("n") - 1), "star").when(F.col("m") == F.col("n") - 1, "tree")
        .when((F.col("m") == F.col("n")) & (F.col("twos") == F.col("n")), "cycle").otherwise("dense")
    )
    return shape.join(roots, "pattern").select("pattern", F.when(F.col("parts") == 1, kind).alias("kind"))


def semantic_check(vertices: DataFrame, induced: DataFrame, centre: int, allowed: list[tuple[int, int]]) -> DataFrame:
    """(pattern, ok, reason): exactly one vertex of the centre's label, and only allowed pairs of labels."""
    pairs = F.array(*[F.lit(f"{min(p)}-{max(p)}") for p in allowed])
    name = lambda x: vertices.select("pattern", F.col("q").alias(x), F.col("label").alias(f"{x}_label"))
    e = induced.join(name("u"), ["pattern", "u"]).join(name("v"), ["pattern", "v"])
    odd = e.where(~F.array_contains(pairs, F.concat_ws("-", F.least("u_label", "v_label").cast("string"), F.greatest("u_label", "v_label").cast("string")))).groupBy("pattern").agg(F.count(F.lit(1)).alias("odd"))
    n = vertices.groupBy("pattern").agg(F.sum((F.col("label") == centre).cast("int")).alias("centres"))
    reason = F.when(F.col("centres") != 1, F.concat(F.col("centres").cast("string"), F.lit(" centres"))).when(F.col("odd") > 0, F.concat(F.col("odd").cast("string"), F.lit(" pairs of labels not allowed"))).otherwise("")
    return n.join(odd, "pattern", "left").select("pattern", (reason == "").alias("ok"), reason.alias("reason"))


def format_check(vertices: DataFrame, induced: DataFrame, labels: list[int]) -> DataFrame:
    """(pattern, errors): ids 0..n-1, known labels, declared degree equal to the actual one."""
    ends = induced.select("pattern", F.explode(F.array("u", "v")).alias("q")).groupBy("pattern", "q").agg(F.count(F.lit(1)).alias("actual"))
    rows = vertices.join(ends, ["pattern", "q"], "left").withColumn("actual", F.coalesce("actual", F.lit(0)))
    g = rows.groupBy("pattern").agg(F.min("q").alias("lo"), F.max("q").alias("hi"), F.countDistinct("q").alias("ids"), F.count(F.lit(1)).alias("n"), F.sum((~F.col("label").isin(labels)).cast("int")).alias("odd"), F.sum((F.col("degree") != F.col("actual")).cast("int")).alias("wrong"))
    errors = F.array_compact(F.array(F.when((F.col("lo") != 0) | (F.col("hi") != F.col("n") - 1) | (F.col("ids") != F.col("n")), "ids"), F.when(F.col("odd") > 0, "labels"), F.when(F.col("wrong") > 0, "degrees")))
    return g.select("pattern", F.array_join(errors, ",").alias("errors"))


def label_counts(vertices: DataFrame) -> DataFrame:
    """(label, per_pattern, patterns): how many patterns have how many vertices of a label."""
    return vertices.groupBy("pattern", "label").agg(F.count(F.lit(1)).alias("per_pattern")).groupBy("label", "per_pattern").agg(F.count(F.lit(1)).alias("patterns"))


def choose_core_labels(vertices: DataFrame, required: int, weights: dict[int, float], salt: str) -> DataFrame:
    """(pattern, required, other): the required label and one more available label drawn by weight, for patterns that have it."""
    have = vertices.select("pattern", "label").distinct()
    table = F.create_map(*[F.lit(x) for p in weights.items() for x in p])
    key = -F.log(F.greatest(prn(F.concat_ws("-", "pattern", "label"), salt), F.lit(2.0**-33))) / table[F.col("label")]
    other = have.where(F.col("label").isin(list(weights)) & (F.col("label") != required)).withColumn("k", key).groupBy("pattern").agg(F.min_by("label", F.struct("k", "label")).alias("other"))
    return have.where(F.col("label") == required).select("pattern", F.col("label").alias("required")).join(other, "pattern", "left")


def core_config(vertices: DataFrame, chosen: DataFrame) -> DataFrame:
    """(pattern, label, qs): the pattern's vertices of each chosen label; the first of them is qs[0]."""
    want = chosen.select("pattern", F.explode(F.array_compact(F.array("required", "other"))).alias("label"))
    return vertices.join(want, ["pattern", "label"]).groupBy("pattern", "label").agg(F.array_sort(F.collect_list("q")).alias("qs"))


def answers_of(answers: DataFrame, kept: DataFrame) -> DataFrame:
    """The answers (pattern, ...) of the kept patterns."""
    return answers.join(kept.select("pattern").distinct(), "pattern", "left_semi")


def with_label(vertices: DataFrame, label: int) -> DataFrame:
    return vertices.groupBy("pattern").agg(F.collect_set("label").alias("ls")).where(F.array_contains("ls", label)).select("pattern")


def merge_workloads(old: DataFrame, new: DataFrame, prefix: Column) -> DataFrame:
    """(name, hash): the old set and the new patterns it lacks, numbered on from the highest number per prefix.

    Names are ``<prefix>_<number>``. Numbers follow the hashes; they come from ranges, so one prefix may hold all patterns."""
    fresh = new.join(old.select("hash"), "hash", "left_anti").withColumn("prefix", prefix).groupBy("hash").agg(F.min("prefix").alias("prefix"))
    top = old.select(F.regexp_extract("name", r"^(.*)_\d+$", 1).alias("prefix"), F.regexp_extract("name", r"_(\d+)$", 1).cast("long").alias("i")).groupBy("prefix").agg(F.max("i").alias("top"))
    placed = numbered(fresh, ["prefix"], ["hash"], "r").join(top, "prefix", "left")
    return old.select("name", "hash").unionByName(placed.select(F.concat_ws("_", "prefix", (F.coalesce("top", F.lit(-1)) + F.col("r")).cast("string")).alias("name"), "hash"))
