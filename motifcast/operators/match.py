"""Candidate filtering and exact matching of small patterns, as joins.

A pattern is compiled on the driver (at most ten vertices); all data work is semi-joins and joins. Matching is injective and
checks every pattern edge with its label; other data edges between matched vertices are allowed.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import combinations, zip_longest

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from motifcast.functions.frames import among, checkpointed, union_all


@dataclass(frozen=True)
class Pattern:
    """labels[i] is the label of vertex i; edges are (i, j, edge label or None for any); core are the predicate's vertices."""

    name: str
    labels: tuple[int, ...]
    edges: tuple[tuple[int, int, int | None], ...]
    core: tuple[int, ...] = ()

    def near(self, q: int) -> list[tuple[int, int | None]]:
        return [(b if a == q else a, k) for a, b, k in self.edges if q in (a, b)]

    def degree(self, q: int) -> int:
        return len(self.near(q))

    def cores(self) -> list[int]:
        """k-core number of each pattern vertex, by peeling."""
        left, out, k = set(range(len(self.labels))), [0] * len(self.labels), 0
        while left:
            low = {q for q in left if sum(n in left for n, _ in self.near(q)) <= k}
            for q in low:
                out[q] = k
            left -= low
            k += not low
        return out

    def order(self, sizes: dict[int, int] | None = None, start: int | None = None) -> list[int]:
        """Connected order: most built neighbours first, then the smallest candidate set."""
        size = lambda q: (sizes or {}).get(q, 0)
        first = min(range(len(self.labels)), key=lambda q: (size(q), q)) if start is None else start
        done = [first]
        while len(done) < len(self.labels):
            done.append(max((q for q in range(len(self.labels)) if q not in done and any(n in done for n, _ in self.near(q))), key=lambda q: (sum(n in done for n, _ in self.near(q)), -size(q), -q)))
        return done

    def triangles(self) -> list[tuple[int, int, int]]:
        adjacent = {(a, b) for a, b, _ in self.edges} | {(b, a) for a, b, _ in self.edges}
        n = range(len(self.labels))
        return [(a, b, c) for a in n for b in n for c in n if a < b < c and {(a, b), (b, c), (a, c)} <= adjacent]


PATTERNS = {
    p.name: p
    for p in (
        Pattern("path3", (0, 1, 2), ((0, 1, 0), (1, 2, 1)), (1,)),
        Pattern("path4", (0, 1, 2, 3), ((0, 1, 0), (1, 2, 1), (2, 3, 3)), (1, 2)),
        Pattern("tri", (1, 2, 3), ((0, 1, 1), (1, 2, 3), (0, 2, 2)), (1,)),
        Pattern("cyc4", (1, 2, 1, 3), ((0, 1, 1), (1, 2, 1), (2, 3, 2), (0, 3, 2)), (0, 2)),
        Pattern("star4", (1, 0, 2, 2), ((0, 1, 0), (0, 2, 1), (0, 3, 1)), (2, 3)),
    )
}

#: (q, vid) tables: the candidates of a pattern.
Candidates = DataFrame


def process_pattern(spark: SparkSession, pattern: Pattern) -> DataFrame:
    """(q, label, degree, core) of the pattern's vertices."""
    cores = pattern.cores()
    return spark.createDataFrame([(q, x, pattern.degree(q), cores[q]) for q, x in enumerate(pattern.labels)], "q int, label int, degree int, core int")


def initial_candidates(pattern: Pattern, vertices: DataFrame, edges: DataFrame, cores: DataFrame | None = None) -> Candidates:
    """Vertices with the label, degree and core number, and with a candidate neighbour for each neighbour built before.

    vertices: (vid, label, degree)."""
    need = pattern.cores()
    if cores is not None:
        vertices = vertices.join(cores, "vid")
    made: dict[int, DataFrame] = {}
    first: dict[tuple, int] = {}  # of the pattern vertices of which the same is asked, so that their candidates are the same
    like: dict[int, int] = {}
    for q in pattern.order():
        like[q] = first.setdefault((pattern.labels[q], pattern.degree(q), need[q], frozenset((like[other], k) for other, k in pattern.near(q) if other in made)), q)
        if like[q] != q:
            made[q] = made[like[q]]
            continue
        mine = vertices.where((F.col("label") == pattern.labels[q]) & (F.col("degree") >= pattern.degree(q)))
        if cores is not None:
            mine = mine.where(F.col("core") >= need[q])
        mine = mine.select("vid")
        for other, k in pattern.near(q):
            if other in made:
                mine = mine.join(labelled(edges, k).join(made[other].withColumnRenamed("vid", "dst"), "dst", "left_semi").select(F.col("src").alias("vid")), "vid", "left_semi")
        made[q] = checkpointed(mine)  # read by all later neighbours
    return union_all([m.select(F.lit(q).alias("q"), "vid") for q, m in sorted(made.items())])


def labelled(edges: DataFrame, label: int | None) -> DataFrame:
    return (edges if label is None else edges.where(F.col("elabel") == label)).select("src", "dst")


def candidate_edges(pattern: Pattern, candidates: Candidates, edges: DataFrame) -> DataFrame:
    """(edge, src, dst): for each pattern edge, by number, the data edges between candidates."""
    of = lambda q, name: candidates.where(F.col("q") == q).select(F.col("vid").alias(name))
    parts = []
    for a, k in dict.fromkeys((a, k) for a, _, k in pattern.edges):  # edges of one kind from one vertex are looked for once
        ends = {i: b for i, (x, b, y) in enumerate(pattern.edges) if (x, y) == (a, k)}
        there = labelled(edges, k).join(of(a, "src"), "src", "left_semi").distinct()
        if len(ends) == 1:
            ((i, b),) = ends.items()
            parts.append(there.join(of(b, "dst"), "dst", "left_semi").select(F.lit(i).alias("edge"), "src", "dst"))
        else:
            fit = union_all([of(b, "dst").withColumn("edge", F.lit(i)) for i, b in ends.items()]).groupBy("dst").agg(F.collect_set("edge").alias("edges"))
            parts.append(there.join(fit, "dst").select(F.explode("edges").alias("edge"), "src", "dst"))
    return union_all(parts)


def neighbour_safe(pattern: Pattern, candidates: Candidates, between: DataFrame) -> Candidates:
    """Candidates that have, for each label, at least as many candidate neighbours as the pattern vertex has neighbours."""
    kept = []
    for q in range(len(pattern.labels)):
        mine = candidates.where(F.col("q") == q)
        for label in sorted({pattern.labels[n] for n, _ in pattern.near(q)}):
            near = [between.where(F.col("edge") == i).select(F.col("src" if a == q else "dst").alias("vid"), F.col("dst" if a == q else "src").alias("n")) for i, (a, b, _) in enumerate(pattern.edges) if q in (a, b) and pattern.labels[b if a == q else a] == label]
            enough = union_all(near).distinct().groupBy("vid").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= len(near)).select("vid")
            mine = mine.join(enough, "vid", "left_semi")
        kept.append(mine.select("q", "vid"))
    return union_all(kept)


def _rivals(pattern: Pattern, q: int) -> dict[int, int]:
    """For each pattern edge at ``q``, as bits, the edges at ``q`` whose far ends have the same label: only these may want one neighbour."""
    far = {i: pattern.labels[b if a == q else a] for i, (a, b, _) in enumerate(pattern.edges) if q in (a, b)}
    return {i: sum(1 << j for j in far if far[j] == label) for i, label in far.items()}


def _demands(pattern: Pattern) -> list[list[int]]:
    """For each pattern vertex the sets of rivals at it, as bits of edges. By Hall's theorem the edges can be matched to distinct
    neighbours just if each set has at least as many neighbours as edges (at most 511 sets, of a vertex with nine rivals)."""
    out = []
    for q in range(len(pattern.labels)):
        rivals = _rivals(pattern, q)
        out.append(sorted(sum(1 << i for i in some) for group in set(rivals.values()) for k in range(1, group.bit_count() + 1) for some in combinations([i for i in rivals if group >> i & 1], k)))
    return out


def _at(values: list[int | None]) -> Column:
    """The value of the row's pattern vertex."""
    return F.get(F.array(*[F.lit(v).cast("long") for v in values]), F.col("q"))


def _near_rows(pattern: Pattern, between: DataFrame, least: int, all_near: bool) -> DataFrame:
    """(q, vid, n, mask): the neighbours of candidates of pattern vertices with ``least`` edges, each once, with the pattern edges
    that it can serve as bits. Unless ``all_near``, neighbours that no two edges can want are one row, a null."""
    rivals = [_rivals(pattern, q) for q in range(len(pattern.labels))]
    ends = []
    for k, (x, y) in enumerate((("src", "dst"), ("dst", "src"))):
        q = F.get(F.array(*[F.lit(e[k]) for e in pattern.edges]), F.col("edge"))
        wanted = F.get(F.array(*[F.lit(all_near or rivals[e[k]][i].bit_count() > 1) for i, e in enumerate(pattern.edges)]), F.col("edge"))
        deep = F.get(F.array(*[F.lit(pattern.degree(e[k]) >= least) for e in pattern.edges]), F.col("edge"))
        ends.append(F.when(deep, F.struct(q.alias("q"), F.col(x).cast("long").alias("vid"), F.when(wanted, F.col(y)).cast("long").alias("n"))))
    rows = between.select(F.explode(F.array(*ends)).alias("end"), F.expr("shiftleft(1L, edge)").alias("mask")).where("end is not null")
    return rows.select("end.*", "mask").groupBy("q", "vid", "n").agg(F.bit_or("mask").alias("mask"))


def _supplies(pattern: Pattern, near: DataFrame) -> DataFrame:
    """(q, vid, n0, n1, ...): each candidate's number of neighbours for each set of ``_demands`` of its pattern vertex."""
    sets = list(zip_longest(*_demands(pattern)))
    return near.groupBy("q", "vid").agg(*[F.sum(F.when(F.col("mask").bitwiseAND(_at(of)) != 0, 1).otherwise(0)).alias(f"n{j}") for j, of in enumerate(sets)])


def _met(pattern: Pattern, but: int | None = None) -> Column:
    """Whether all sets have neighbours enough; with ``but``, those sets without that edge, whose neighbour the row's ``n`` is."""
    met = F.lit(True)
    for j, of in enumerate(zip_longest(*_demands(pattern))):
        left, free = F.col(f"n{j}"), F.lit(False)
        if but is not None:
            rivals = [_rivals(pattern, q).get(but, 0) for q in range(len(pattern.labels))]
            taken = F.col("mask").bitwiseAND(_at([s and s & r for s, r in zip(of, rivals, strict=True)])) != 0
            left, free = left - F.when(taken, 1).otherwise(0), _at([s and s >> but & 1 for s in of]) == 1
        met = met & (_at(of).isNull() | F.coalesce(free, F.lit(False)) | (left >= _at([s and s.bit_count() for s in of])))
    return met


def bipartite_safe(pattern: Pattern, candidates: Candidates, between: DataFrame) -> Candidates:
    """Candidates whose pattern edges can be matched to distinct neighbours."""
    supplies = _supplies(pattern, _near_rows(pattern, between, 1, False))
    return candidates.join(supplies.where(_met(pattern)).select("q", "vid"), ["q", "vid"], "left_semi")


def edge_bipartite_safe(pattern: Pattern, between: DataFrame) -> DataFrame:
    """Candidate edges that are part of such a matching at both of their ends (an end of degree one has no other edge to match)."""
    need = [sum(pattern.degree(q) > 1 for q in (a, b)) for a, b, _ in pattern.edges]
    if not any(need):
        return between.select("edge", "src", "dst")
    near = _near_rows(pattern, between, 2, True)
    rows = near.join(_supplies(pattern, near), ["q", "vid"])
    served = [F.when((F.col("mask").bitwiseAND(F.lit(1 << i)) != 0) & _met(pattern, i), F.lit(i)) for i in range(len(need))]
    rows = rows.withColumn("edge", F.explode(F.array(*served))).where("edge is not null")
    first = F.col("q") == F.get(F.array(*[F.lit(a) for a, _, _ in pattern.edges]), F.col("edge"))
    found = rows.select("edge", F.when(first, F.col("vid")).otherwise(F.col("n")).alias("src"), F.when(first, F.col("n")).otherwise(F.col("vid")).alias("dst"))
    if max(need) > 1:
        ends = F.get(F.array(*map(F.lit, need)), F.col("edge"))
        found = found.groupBy("edge", "src", "dst").agg(F.count(F.lit(1)).alias("ends")).where(F.col("ends") == ends).select("edge", "src", "dst")
    return found if all(need) else found.unionByName(between.where(F.col("edge").isin([i for i, k in enumerate(need) if not k])).select("edge", "src", "dst"))


def _sides(pattern: Pattern, between: DataFrame):
    """Function (x, y) -> the data edges of the pattern edge x-y as columns v<x>, v<y>; None where the pattern has no such edge."""
    at = {frozenset((a, b)): (i, a) for i, (a, b, _) in enumerate(pattern.edges)}

    def side(x: int, y: int, of: DataFrame = between) -> DataFrame | None:
        if frozenset((x, y)) not in at:
            return None
        i, a = at[frozenset((x, y))]
        return of.where(F.col("edge") == i).select(F.col("src" if a == x else "dst").alias(f"v{x}"), F.col("dst" if a == x else "src").alias(f"v{y}"))

    return side


#: Tested edges are few if there are at least so many candidate edges for each.
FEW = 20
#: Most rows, counted, that are broadcast to be taken out of others (about 60 bytes each).
BROADCAST_ROWS = 200_000


def triangle_safe(pattern: Pattern, between: DataFrame, tested: DataFrame | None = None) -> DataFrame:
    """Of the ``tested`` candidate edges (else all) those that have a candidate triangle for each pattern triangle on their pattern
    edge. A few tested edges are each extended from their own end. Otherwise the triangles are found once, from the vertex
    where the fewest pairs of candidate edges meet, and serve all three edges."""
    side, every = _sides(pattern, between), tested is None
    whole = [every] * len(pattern.edges)  # edges of which all are tested and none is gone yet: those of the found triangles are the result
    mine = [side(a, b, between if every else tested) for a, b, _ in pattern.edges]
    if not every and (some := tested.count()) and between.count() < FEW * some:
        every = True
    cost = _wedges(pattern, between) if every and pattern.triangles() else {}
    for triangle in pattern.triangles():
        if every:
            m = min(triangle, key=lambda q: (min([cost.get((x, q, z), 0.0) for x in triangle for z in triangle if len({x, q, z}) == 3]), q))
            x, z = (q for q in triangle if q != m)
            full = checkpointed(side(x, m).join(side(m, z), f"v{m}").join(side(x, z), [f"v{x}", f"v{z}"]))
        for i, (a, b, _) in enumerate(pattern.edges):
            if {a, b} <= set(triangle):
                (c,) = set(triangle) - {a, b}
                found = full if every else mine[i].join(side(a, c), f"v{a}").join(side(b, c), [f"v{b}", f"v{c}"])
                found = found.select(f"v{a}", f"v{b}").distinct()
                mine[i] = found if whole[i] else mine[i].join(found, [f"v{a}", f"v{b}"], "left_semi")
                whole[i] = False
    return union_all([df.select(F.lit(i).alias("edge"), F.col(f"v{a}").alias("src"), F.col(f"v{b}").alias("dst")) for i, ((a, b, _), df) in enumerate(zip(pattern.edges, mine, strict=True))])


def _wedges(pattern: Pattern, between: DataFrame) -> dict[tuple[int, int, int], int]:
    """(end, middle, end) -> number of pairs of candidate edges that meet in the middle, for all wedges of the pattern (a few numbers)."""
    parts = [between.where(F.col("edge") == i).groupBy(F.lit(q).alias("q"), F.col(x).alias("vid"), "edge").agg(F.count(F.lit(1)).alias("n")) for i, (a, b, _) in enumerate(pattern.edges) for q, x in ((a, "src"), (b, "dst"))]
    n = checkpointed(union_all(parts))
    both = n.join(n.select("q", "vid", F.col("edge").alias("other"), F.col("n").alias("m")), ["q", "vid"]).where("edge < other")
    out = {}
    for r in both.groupBy("q", "edge", "other").agg(F.sum(F.col("n").cast("double") * F.col("m")).alias("pairs")).collect():
        ends = [b if a == r["q"] else a for a, b, _ in (pattern.edges[r["edge"]], pattern.edges[r["other"]])]
        out[ends[0], r["q"], ends[1]] = out[ends[1], r["q"], ends[0]] = r["pairs"]
    return out


def four_cycle_safe(pattern: Pattern, between: DataFrame, tested: DataFrame | None = None) -> DataFrame:
    """Of the ``tested`` candidate edges (else all) those that have a candidate four-cycle for each pattern four-cycle on their edge
    (diagonals of the pattern too).

    A cycle a-b-c-d is two wedges over one diagonal. Of the wedges over a-c only the pairs are kept, each with the least and the
    largest middle, which is enough to tell whether there is one besides b; so no cycle is made, and the diagonal with fewer
    wedges is taken. Where the pattern joins b and d too, the cycles themselves are looked at."""
    side, tested = _sides(pattern, between), between if tested is None else tested
    n = range(len(pattern.labels))
    joined = {frozenset((a, b)) for a, b, _ in pattern.edges}
    cycles = [(a, b, c, d) for a in n for b in n for c in n for d in n if len({a, b, c, d}) == 4 and a == min(a, b, c, d) and b < d and all(frozenset(x) in joined for x in ((a, b), (b, c), (c, d), (a, d)))]
    if not cycles:
        return tested
    cost = _wedges(pattern, between)
    mine = {i: side(a, b, tested) for i, (a, b, _) in enumerate(pattern.edges)}
    number = {frozenset((a, b)): i for i, (a, b, _) in enumerate(pattern.edges)}
    same = lambda x, y: pattern.labels[x] == pattern.labels[y]

    def differ(df: DataFrame, x: int, y: int) -> DataFrame:
        return df.where(F.col(f"v{x}") != F.col(f"v{y}")) if same(x, y) else df

    for a, b, c, d in cycles:
        over_ac = cost.get((a, b, c), 0.0) + cost.get((a, d, c), 0.0)
        if frozenset((b, d)) not in joined and (frozenset((a, c)) in joined or over_ac <= cost.get((b, a, d), 0.0) + cost.get((b, c, d), 0.0)):
            ends, middles = (a, c), (b, d)
        else:
            ends, middles = (b, d), (a, c)
        x, z = ends
        chord = side(x, z)
        if side(*middles) is not None:  # both diagonals: no pairs of wedges, the cycles
            full = differ(side(x, middles[0]).join(side(middles[0], z), f"v{middles[0]}").join(side(x, middles[1]), f"v{x}").join(side(middles[1], z), [f"v{middles[1]}", f"v{z}"]), x, z)
            full = checkpointed(differ(full, *middles).join(chord, [f"v{x}", f"v{z}"], "left_semi").join(side(*middles), [f"v{m}" for m in middles], "left_semi"))
            for p, q in ((a, b), (b, c), (c, d), (a, d)):
                i = number[frozenset((p, q))]
                mine[i] = mine[i].join(full.select(f"v{p}", f"v{q}").distinct(), [f"v{p}", f"v{q}"], "left_semi")
            continue
        # Wedges (ends, which middle, it): pairs of ends with the least and the largest of either middle tell which wedges have another.
        wedges = []
        for which, m in enumerate(middles):
            over = differ(side(x, m).join(side(m, z), f"v{m}"), x, z)
            if chord is not None:
                over = over.join(chord, [f"v{x}", f"v{z}"], "left_semi")
            wedges.append(over.select(F.col(f"v{x}").alias("_x"), F.col(f"v{z}").alias("_z"), F.lit(which).alias("_which"), F.col(f"v{m}").alias("_m")))
        wedges = union_all(wedges)
        at_most = [f(F.when(F.col("_which") == k, F.col("_m"))).alias(f"_{name}{k}") for k in (0, 1) for f, name in ((F.min, "least"), (F.max, "most"))]
        pairs = wedges.repartition("_x", "_z").groupBy("_x", "_z").agg(*at_most).where("_least0 is not null and _least1 is not null")
        if same(*middles):
            pairs = pairs.where("_least0 != _most0 or _least1 != _most1 or _least0 != _least1")
        pairs = checkpointed(pairs)
        # Few pairs close a cycle, so few wedges are shuffled again.
        pair = F.xxhash64("_x", "_z").alias("_p")
        again = among(wedges.withColumn("_p", pair), ["_p"], pairs.select(pair)).drop("_p").join(pairs, ["_x", "_z"])
        if same(*middles):
            others = [F.when(F.col("_which") == 0, F.col(f"_{name}1")).otherwise(F.col(f"_{name}0")) for name in ("least", "most")]
            again = again.where((others[0] != F.col("_m")) | (others[1] != F.col("_m")))
        again = checkpointed(again.select("_x", "_z", "_which", "_m"))
        for which, m in enumerate(middles):
            for p in ends:
                i = number[frozenset((p, m))]
                found = again.where(F.col("_which") == which).select(F.col("_x" if p == x else "_z").alias(f"v{p}"), F.col("_m").alias(f"v{m}")).distinct()
                mine[i] = mine[i].join(found, [f"v{p}", f"v{m}"], "left_semi")
    return union_all([mine[i].select(F.lit(i).alias("edge"), F.col(f"v{a}").alias("src"), F.col(f"v{b}").alias("dst")) for i, (a, b, _) in enumerate(pattern.edges)])


def ends_of(pattern: Pattern, between: DataFrame) -> Candidates:
    """Candidates that still have a candidate edge for each of their pattern edges."""
    kept = []
    for q in range(len(pattern.labels)):
        mine = [between.where(F.col("edge") == i).select(F.col("src" if a == q else "dst").alias("vid")).distinct() for i, (a, b, _) in enumerate(pattern.edges) if q in (a, b)]
        out = mine[0]
        for more in mine[1:]:
            out = out.join(more, "vid", "left_semi")
        kept.append(out.select(F.lit(q).alias("q"), "vid"))
    return union_all(kept)


def refine(pattern: Pattern, candidates: Candidates, edges: DataFrame, visits: int | None = None, bipartite: bool = True) -> tuple[Candidates, DataFrame]:
    """Candidates and candidate edges that pass all safety tests, or as far as ``visits`` tests of a candidate go (five for each
    candidate edge if not given; what is removed by then is right to remove).

    Driven by changes: the first round tests all candidates and edges, each later one only candidates at the ends of edges that
    went (and their neighbours, if the pattern has four-cycles) and the edges there, until nothing goes."""
    between = checkpointed(candidate_edges(pattern, candidates, edges))
    candidates = changed = checkpointed(candidates)
    left, near = (5 * between.count() if visits is None else visits), [(i, q, x) for i, (a, b, _) in enumerate(pattern.edges) for q, x in ((a, "src"), (b, "dst"))]
    n = range(len(pattern.labels))
    far = any(len({a, b, c, d}) == 4 and all(any({p, q} == {x, y} for x, y, _ in pattern.edges) for p, q in ((a, b), (b, c), (c, d), (d, a))) for a in n for b in n for c in n for d in n)
    # Where no two edges can want one neighbour, an edge is part of a matching if its ends are: the candidates' test says it.
    rivals = any(r.bit_count() > 1 for q in n for r in _rivals(pattern, q).values())
    edge = ["edge", "src", "dst"]

    def ends(where: DataFrame, k: int) -> DataFrame:
        """(edge, src or dst) of the (q, vid) of ``where``."""
        return union_all([where.where(F.col("q") == e[k]).select(F.lit(i).alias("edge"), F.col("vid").alias(("src", "dst")[k])) for i, e in enumerate(pattern.edges)])

    def at(rows: DataFrame, where: DataFrame) -> DataFrame:
        """The rows of ``rows`` with an end among the (q, vid) of ``where``; only those that may have one are shuffled."""
        return union_all([among(rows, [x], where.select("vid")).join(ends(where, k), ["edge", x], "left_semi") for k, x in enumerate(("src", "dst"))]).select(*edge).distinct()

    def ends_at(rows: DataFrame) -> DataFrame:
        return union_all([rows.where(F.col("edge") == i).select(F.lit(q).alias("q"), F.col(x).alias("vid")) for i, q, x in near]).distinct()

    def less(rows: DataFrame, gone: DataFrame, by: list[str], many: int) -> DataFrame:
        """The rows without those in ``gone``, of which there are ``many``."""
        return rows.join(F.broadcast(gone) if many <= BROADCAST_ROWS else gone, by, "left_anti")

    while left > 0 and (tests := changed.count()):
        left -= tests
        every = changed is candidates  # then all edges are at them
        around = between if every else checkpointed(at(between, changed))
        if bipartite:  # by Hall's theorem as many neighbours as edges, for each edge and label too
            safe = bipartite_safe(pattern, changed, around)
        else:
            safe = neighbour_safe(pattern, changed.join(ends_of(pattern, around), ["q", "vid"], "left_semi"), around)
        lost = checkpointed(changed.join(safe, ["q", "vid"], "left_anti"))
        open_, rest = around, between
        if many := lost.count():
            candidates = checkpointed(less(candidates, lost, ["q", "vid"], many))
            rest = checkpointed(less(less(between, ends(lost, 0), ["edge", "src"], many), ends(lost, 1), ["edge", "dst"], many))
            open_ = rest if every else checkpointed(less(less(around, ends(lost, 0), ["edge", "src"], many), ends(lost, 1), ["edge", "dst"], many))
        kept = open_
        if bipartite and rivals:  # needs all edges at both ends of those it tests
            whole = rest if every else at(rest, ends_at(kept))
            kept = checkpointed(edge_bipartite_safe(pattern, whole).join(kept, edge, "left_semi"))
        if pattern.triangles():
            kept = checkpointed(triangle_safe(pattern, rest, None if kept is rest else kept))
        if far:
            kept = checkpointed(four_cycle_safe(pattern, rest, kept))
        if kept.count() == around.count():  # no edge went, so nothing is to be tested again
            break
        gone = checkpointed(around.join(kept, edge, "left_anti"))
        before, between = between, kept if every else checkpointed(less(between, gone, edge, gone.count()))
        changed = ends_at(gone)
        if far:
            changed = changed.unionByName(ends_at(at(before, changed))).distinct()
        changed = checkpointed(changed.join(candidates, ["q", "vid"], "left_semi"))
    return candidates, between


def count_candidates(pattern: Pattern, candidates: Candidates, between: DataFrame) -> DataFrame:
    """(kind, id, n): rows per pattern vertex and per pattern edge."""
    return candidates.groupBy("q").count().select(F.lit("vertex").alias("kind"), F.col("q").alias("id"), F.col("count").alias("n")).unionByName(between.groupBy("edge").count().select(F.lit("edge").alias("kind"), F.col("edge").alias("id"), F.col("count").alias("n")))


def match(pattern: Pattern, between: DataFrame, sizes: dict[int, int] | None = None, kept: bool = False) -> DataFrame:
    """All embeddings as columns u0..uk, from candidate edges (edge, src, dst): joins in a connected order.

    A new vertex comes by one edge; its other edges to built vertices are further join keys; vertices of one label differ. In a
    pattern with cycles the numbers of pairs of candidate edges that meet in a vertex are counted first: a four-cycle is two wedges
    over the diagonal with the fewer of them, else the joins begin with the least wedge and each vertex comes by the edge that adds least.
    For that the edges are kept, unless they are already (``kept``).
    """
    at = {frozenset((a, b)): (i, a) for i, (a, b, _) in enumerate(pattern.edges)}
    n, cost = range(len(pattern.labels)), {}
    if len(pattern.edges) >= len(pattern.labels):
        between = between if kept else checkpointed(between)
        cost = _wedges(pattern, between)

    def side(x: int, y: int) -> DataFrame:
        i, a = at[frozenset((x, y))]
        return between.where(F.col("edge") == i).select(F.col("src" if a == x else "dst").alias(f"u{x}"), F.col("dst" if a == x else "src").alias(f"u{y}"))

    def differ(df: DataFrame, q: int, others: list[int]) -> DataFrame:
        for other in others:
            if pattern.labels[other] == pattern.labels[q]:
                df = df.where(F.col(f"u{other}") != F.col(f"u{q}"))
        return df

    def wedge(x: int, m: int, z: int) -> DataFrame:
        return differ(side(x, m).join(side(m, z), f"u{m}"), z, [x])

    joined = lambda x, y: frozenset((x, y)) in at
    # A diagonal x-z with its middles m and o, the pairs of edges that meet there, and none between the middles.
    halves = [(cost.get((x, m, z), 0.0) + cost.get((x, o, z), 0.0), x, m, z, o) for x in n for z in n for m in n for o in n if len({x, m, z, o}) == 4 and x < z and m < o and all(joined(*e) for e in ((x, m), (m, z), (x, o), (o, z))) and not joined(x, z) and not joined(m, o)] if cost else []
    closed = [(c, x, m, z) for (x, m, z), c in cost.items() if joined(x, z)]
    if halves:
        _, x, m, z, o = min(halves)
        out, done = differ(wedge(x, m, z).join(wedge(x, o, z), [f"u{x}", f"u{z}"]), o, [m]), [x, m, z, o]
    elif closed:
        _, x, m, z = min(closed)
        out, done = wedge(x, m, z).join(side(x, z), [f"u{x}", f"u{z}"]), [x, m, z]
    else:
        out, done = None, [pattern.order(sizes)[0]]
    while len(done) < len(n):
        if cost:
            q = max((q for q in n if q not in done and any(x in done for x, _ in pattern.near(q))), key=lambda q: (sum(x in done for x, _ in pattern.near(q)), -(sizes or {}).get(q, 0), -q))
        else:
            q = pattern.order(sizes)[len(done)]
        near = [x for x, _ in pattern.near(q) if x in done]
        near.sort(key=lambda x: min([cost[p, x, q] for p in done if (p, x, q) in cost], default=0.0))
        step = side(near[0], q)
        out = step if out is None else out.join(step, f"u{near[0]}")
        for x in near[1:]:
            out = out.join(side(x, q), [f"u{x}", f"u{q}"])
        out = differ(out, q, done)
        done.append(q)
    return out.select(*[f"u{q}" for q in n])


def graph_between(pattern: Pattern, vertices: DataFrame, edges: DataFrame, passing: DataFrame | None = None, keep: bool = False) -> DataFrame:
    """(edge, src, dst) between vertices of the right labels. With ``passing`` (vid) the core vertices must be among them: that
    filters the candidates, before any embedding is made or counted. Edges may repeat.

    Pattern edges of one kind (equal labels, predicates and edge label) are made once and turned round where needed. ``keep``: the
    edges of each kind are kept, for a caller that reads them several times."""
    of: dict = {}
    kinds = [(label, passing is not None and q in pattern.core) for q, label in enumerate(pattern.labels)]
    for label, core in kinds:
        rows = vertices.where(F.col("label") == label).select("vid")
        of[label, core] = rows.join(passing.select("vid"), "vid", "left_semi") if core else rows
    made: dict = {}
    parts = []
    for i, (a, b, k) in enumerate(pattern.edges):
        x, y = sorted((kinds[a], kinds[b]))
        if (x, y, k) not in made:
            ends = among(labelled(edges, k), ["src"], of[x]).join(of[x].withColumnRenamed("vid", "src"), "src", "left_semi")
            made[x, y, k] = ends.distinct().join(of[y].withColumnRenamed("vid", "dst"), "dst", "left_semi").select("src", "dst")
            made[x, y, k] = checkpointed(made[x, y, k]) if keep else made[x, y, k]
        rows = made[x, y, k]
        parts.append(rows.select(F.lit(i).alias("edge"), F.col("src" if x == kinds[a] else "dst").alias("src"), F.col("dst" if x == kinds[a] else "src").alias("dst")))
    return union_all(parts)


def match_graph(pattern: Pattern, vertices: DataFrame, edges: DataFrame, passing: DataFrame | None = None) -> DataFrame:
    """Match over all edges between vertices of the right labels (see ``graph_between``). Edges may repeat."""
    cyclic = len(pattern.edges) >= len(pattern.labels)
    return match(pattern, graph_between(pattern, vertices, edges, passing, keep=cyclic), kept=cyclic)


def match_batch(patterns: list[Pattern], vertices: DataFrame, edges: DataFrame, timeout_s: float | None = None) -> DataFrame:
    """(pattern, elapsed_ms, cardinality, failure): one count per pattern. Where it took too long (its jobs are cancelled) or
    failed, the cardinality is -1 and ``failure`` says ``timeout`` or names the error; it is null else."""
    import threading
    import time

    spark, rows = vertices.sparkSession, []
    context = spark.sparkContext
    for pattern in patterns:
        tag, began, n, failure = f"match-{pattern.name}", time.time(), -1, None
        timer = threading.Timer(timeout_s or 1e6, context.cancelJobsWithTag, [tag])
        timer.daemon = True
        context.addJobTag(tag)
        timer.start()
        try:
            n = match_graph(pattern, vertices, edges).count()
        except Exception as error:  # a cancelled or failed job counts as not answered
            failure = "timeout" if timeout_s and time.time() - began >= timeout_s else f"{type(error).__name__}: {str(error)[:200]}"
        finally:
            timer.cancel()
            context.removeJobTag(tag)
        rows.append((pattern.name, (time.time() - began) * 1000, n, failure))
    return spark.createDataFrame(rows, "pattern string, elapsed_ms double, cardinality long, failure string")
