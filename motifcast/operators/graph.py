"""Building a labelled graph from tables, and what pattern matching needs to know about it.

vertices: (vid, label, ...); links: (u, v, elabel), each edge once; edges: (src, dst, elabel), both directions.
"""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from motifcast.functions.frames import checkpointed
from motifcast.functions.ordered import numbered


def both_directions(links: DataFrame) -> DataFrame:
    return links.select(F.col("u").alias("src"), F.col("v").alias("dst"), "elabel").unionByName(links.select(F.col("v").alias("src"), F.col("u").alias("dst"), "elabel"))


def degrees(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("src").alias("vid")).agg(F.count(F.lit(1)).alias("degree"))


def assign_ids(nodes: DataFrame, order: list[str]) -> DataFrame:
    """Dense ``internal_id`` for distinct (type, orig_id): types in the given order, then by orig_id (numeric).

    Places come from ranges of the sorted nodes, so ids may be of any size and spread, and no window spans all rows.
    """
    rank = F.array_position(F.array(*map(F.lit, order)), F.col("type")).cast("int")
    nodes = nodes.select("type", F.col("orig_id").cast("long").alias("orig_id")).distinct().withColumn("_t", rank)
    placed = numbered(nodes, [], ["_t", "orig_id"], "_r")
    return placed.select((F.col("_r") - 1).alias("internal_id"), "orig_id", "type", (F.col("_t") - 1).alias("label"))


def derive_edges(ids: DataFrame, users: DataFrame, posts: DataFrame, comments: DataFrame, author: bool = True) -> DataFrame:
    """Links from foreign keys: author 0 (user-post), creator 1 (user-comment), post 2, reply 3, view 4 (user-post by comment).

    Dangling ends are dropped, ends ordered, repeats removed."""
    of = lambda kind, name: ids.where(F.col("type") == kind).select(F.col("orig_id").alias(name), F.col("internal_id").alias(f"{name}_id"))

    def link(rows: DataFrame, a: str, kind_a: str, b: str, kind_b: str, label: int) -> DataFrame:
        pairs = rows.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).join(of(kind_a, "a"), "a").join(of(kind_b, "b"), "b")
        return pairs.select(F.least("a_id", "b_id").alias("u"), F.greatest("a_id", "b_id").alias("v"), F.lit(label).alias("elabel"))

    parts = [link(posts, "creator", "user", "id", "post", 0)] if author else []
    parts += [link(comments, "creator", "user", "id", "comment", 1), link(comments, "post", "post", "id", "comment", 2), link(comments, "parent", "comment", "id", "comment", 3), link(comments, "creator", "user", "post", "post", 4)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.distinct()


def merge_parallel(vertices: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links without labels and parallels, and vertices with their degree anew (0 kept)."""
    merged = links.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct().withColumn("elabel", F.lit(0))
    degree = degrees(both_directions(merged))
    return vertices.join(degree, "vid", "left").withColumn("degree", F.coalesce("degree", F.lit(0))), merged


def graph_stats(vertices: DataFrame, links: DataFrame) -> DataFrame:
    """(kind, label, n): counts per vertex and edge label, and totals with label -1."""
    count = lambda df, kind, label: df.rollup(label).agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), F.coalesce(label, F.lit(-1)).alias("label"), "n")
    return count(vertices, "vertex", "label").unionByName(count(links, "edge", "elabel"))


def relabel(vertices: DataFrame) -> DataFrame:
    """(label, dense, share): labels numbered by their first vertex, with their share of the vertices."""
    seen = vertices.groupBy("label").agg(F.min("vid").alias("first"), F.count(F.lit(1)).alias("n"))
    every = Window.partitionBy()  # one row per label
    return seen.select("label", (F.row_number().over(Window.orderBy("first")) - 1).alias("dense"), (F.col("n") / F.sum("n").over(every)).alias("share"))


def label_entropy(vertices: DataFrame) -> DataFrame:
    return relabel(vertices).agg(F.sum(-F.col("share") * F.log2("share")).alias("entropy"))


def core_numbers(edges: DataFrame, rounds: int | None = None) -> DataFrame:
    """(vid, core): the k-core number of each vertex, as the fixpoint of the h-index of the neighbours' numbers.

    A vertex starts with its degree; each round it takes the largest h such that h neighbours have at least h. The h-index
    comes from a count per (vertex, value) and a running sum, so a hub's neighbours are pre-aggregated, not gathered. Rounds go on
    until nothing changes (about half the length of the longest chain); past a limit of ``rounds`` it raises.
    """
    pairs = checkpointed(edges.select("src", "dst").distinct())
    core = checkpointed(degrees(pairs).select("vid", F.col("degree").cast("long").alias("core")))
    for done in itertools.count():
        if done == rounds:
            raise RuntimeError(f"core numbers still change after {rounds} rounds")
        near = pairs.join(core.select(F.col("vid").alias("dst"), F.col("core").alias("c")), "dst").join(core.select(F.col("vid").alias("src"), "core"), "src")
        counts = near.groupBy("src", "core", F.least("c", "core").alias("c")).agg(F.count(F.lit(1)).alias("n"))
        above = Window.partitionBy("src").orderBy(F.desc("c")).rowsBetween(Window.unboundedPreceding, 0)
        new = counts.withColumn("h", F.least("c", F.sum("n").over(above))).groupBy(F.col("src").alias("vid")).agg(F.max("h").alias("core"), F.first("core").alias("old"))
        new = checkpointed(new)
        same = new.where("core <> old").isEmpty()
        core = new.select("vid", "core")
        if same:
            return core


def incidence(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with both ends' labels and degrees."""
    known = vertices.select("vid", "label").join(degrees(edges), "vid")
    side = lambda x: known.select(F.col("vid").alias(x), F.col("label").alias(f"{x}_label"), F.col("degree").alias(f"{x}_degree"))
    return edges.join(side("src"), "src").join(side("dst"), "dst")


def _oriented(edges: DataFrame) -> DataFrame:
    """(x, y, dx, dy): each adjacent pair once, from the end of smaller (degree, id); a vertex then has few outgoing edges, hubs too."""
    pairs = edges.where("src <> dst").select("src", "dst").repartition("src").distinct()  # degrees and the first join need no other shuffle
    degree = degrees(pairs)
    both = pairs.join(degree.withColumnsRenamed({"vid": "src", "degree": "dx"}), "src").join(degree.withColumnsRenamed({"vid": "dst", "degree": "dy"}), "dst")
    return both.where(F.struct("dx", "src") < F.struct("dy", "dst")).select(F.col("src").alias("x"), F.col("dst").alias("y"), "dx", "dy")


def triangles(edges: DataFrame) -> DataFrame:
    """(a, b, c) with a < b < c: each triangle once, by a join over degree-ordered edges.

    The third edge of a triangle leaves the middle one of its vertices, so only wedges whose lower end has an outgoing edge are made."""
    up = checkpointed(_oriented(edges))
    closing = up.select(F.col("x").alias("y"), F.col("y").alias("z"))
    lower = up.select("x", "y", "dy").join(closing.select("y").distinct(), "y", "left_semi")
    upper = up.select("x", F.col("y").alias("z"), F.col("dy").alias("dz"))
    wedge = lower.join(upper, "x").where(F.struct("dy", "y") < F.struct("dz", "z")).select("x", "y", "z")
    three = F.array_sort(F.array("x", "y", "z"))
    return wedge.join(closing, ["y", "z"]).select(three[0].alias("a"), three[1].alias("b"), three[2].alias("c"))


def edge_triangles(edges: DataFrame) -> DataFrame:
    """(src, dst, third): for each directed pair every third vertex that closes a triangle."""
    turns = [("a", "b", "c"), ("b", "a", "c"), ("a", "c", "b"), ("c", "a", "b"), ("b", "c", "a"), ("c", "b", "a")]
    six = F.array(*[F.struct(F.col(x).alias("src"), F.col(y).alias("dst"), F.col(z).alias("third")) for x, y, z in turns])
    return triangles(edges).select(F.inline(six))


def four_cycles(edges: DataFrame) -> DataFrame:
    """(u, v, w, x, uw, vx): each four-cycle u-v-w-x once, and whether its diagonals exist. u is the last of the four by (degree,
    id), and v < x.

    Only wedges u-v-w below their end u are made: an edge brings as many as the degree of its smaller end, so hubs are ends of
    many wedges but the middle of few, at most the number of edges times the root of twice that number. Cycles are pairs of wedges
    with equal ends, so the second join makes no row that is not in the result."""
    up = checkpointed(_oriented(edges))
    near = up.select(F.col("x").alias("v"), F.col("y").alias("w"), F.col("dy").alias("dw")).unionByName(up.select(F.col("y").alias("v"), F.col("x").alias("w"), F.col("dx").alias("dw")))
    wedges = up.select(F.col("y").alias("u"), F.col("dy").alias("du"), F.col("x").alias("v")).join(near, "v").where(F.struct("dw", "w") < F.struct("du", "u"))
    wedges = checkpointed(wedges.select("u", "w", "v"))
    cycles = wedges.join(wedges.withColumnRenamed("v", "x"), ["u", "w"]).where("v < x")
    pairs = up.select(F.least("x", "y").alias("_a"), F.greatest("x", "y").alias("_b"), F.lit(True).alias("_there"))
    for one, other in (("u", "w"), ("v", "x")):
        known = pairs.withColumnRenamed("_there", f"{one}{other}")
        cycles = cycles.join(known, (F.least(one, other) == F.col("_a")) & (F.greatest(one, other) == F.col("_b")), "left").drop("_a", "_b")
    return cycles.select("u", "v", "w", "x", F.coalesce("uw", F.lit(False)).alias("uw"), F.coalesce("vx", F.lit(False)).alias("vx"))


def edge_four_cycles(edges: DataFrame) -> DataFrame:
    """(u, v, w, x, uw, vx): for each directed pair u-v every v-w, w-x, x-u with four vertices, and whether the diagonals exist."""
    turns = [("u", "v", "w", "x"), ("v", "w", "x", "u"), ("w", "x", "u", "v"), ("x", "u", "v", "w")]
    turns += [(a, d, c, b) for a, b, c, d in turns]
    eight = F.array(*[F.struct(*[F.col(c).alias(n) for c, n in zip(t, "uvwx", strict=True)], F.col("uw" if t[0] in "uw" else "vx").alias("uw"), F.col("vx" if t[0] in "uw" else "uw").alias("vx")) for t in turns])
    return four_cycles(edges).select(F.inline(eight))


def infer_views(user_comment: DataFrame, post_comment: DataFrame) -> DataFrame:
    """(user, post): user wrote a comment on the post."""
    return user_comment.join(post_comment, "comment").select("user", "post").distinct()
