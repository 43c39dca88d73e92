"""Safety tests and the fixpoint of candidate filtering against brute force."""

from __future__ import annotations

import itertools
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from motifcast.operators import graph as G
from motifcast.operators import match as M


def rows(df) -> set:
    return {tuple(r) for r in df.collect()}


def brute_cycles(links: set) -> set:
    near: dict = {}
    for a, b in links:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    return {(u, v, w, x, w in near[u], x in near[v]) for u in near for v in near[u] for w in near[v] - {u} for x in (near[w] & near[u]) - {u, v, w}}


def test_four_cycles_match_brute_force(spark):
    r = random.Random(2)
    links = {(0, b) for b in range(1, 25)} | {(min(x), max(x)) for x in ((r.randrange(25), r.randrange(25)) for _ in range(60)) if x[0] != x[1]}
    edges = spark.createDataFrame([(a, b) for a, b in links] + [(b, a) for a, b in links] + [(3, 3), (0, 1)], "src long, dst long")
    got = [tuple(x) for x in G.edge_four_cycles(edges).select("u", "v", "w", "x", "uw", "vx").collect()]
    assert len(got) == len(set(got)) and set(got) == brute_cycles(links)
    assert G.edge_four_cycles(edges.limit(0)).count() == 0


SHAPES = {
    "square": M.Pattern("square", (0, 1, 0, 1), ((0, 1, None), (1, 2, None), (2, 3, None), (0, 3, None))),
    "chord": M.Pattern("chord", (0, 1, 0, 1), ((0, 1, None), (1, 2, None), (2, 3, None), (0, 3, None), (0, 2, None))),
    "full": M.Pattern("full", (0, 0, 0, 1), ((0, 1, None), (1, 2, None), (2, 3, None), (0, 3, None), (0, 2, None), (1, 3, None))),
}


def random_graph(spark, seed: int, vertices: int = 16, links: int = 38):
    r = random.Random(seed)
    pairs = {(min(x), max(x)) for x in ((r.randrange(vertices), r.randrange(vertices)) for _ in range(links)) if x[0] != x[1]}
    label = {v: v % 2 for v in range(vertices)}
    v = spark.createDataFrame([(v, x) for v, x in label.items()], "vid long, label int")
    e = spark.createDataFrame([(a, b, 0) for a, b in pairs] + [(b, a, 0) for a, b in pairs], "src long, dst long, elabel int")
    return v, e


@pytest.mark.parametrize("shape", SHAPES)
def test_four_cycle_safety_matches_brute_force(spark, shape):
    """Cycles whose four vertices differ where their labels do, for each pattern cycle on an edge."""
    pattern, (v, e) = SHAPES[shape], random_graph(spark, 3)
    between = M.checkpointed(M.graph_between(pattern, v, e))
    have = rows(between)
    on: dict = {(i, s, d): set() for i, s, d in have}
    side = {(a, b): {(s, d) for i, s, d in have if i == k} for k, (a, b, _) in enumerate(pattern.edges)}
    side |= {(b, a): {(d, s) for s, d in x} for (a, b), x in side.items()}
    cycles = [c for c in itertools.permutations(range(4)) if c[0] == min(c) and c[1] < c[3] and all((c[k], c[(k + 1) % 4]) in side for k in range(4))]
    ids = sorted({x for _, s, d in have for x in (s, d)})
    for c in cycles:
        for m in itertools.permutations(ids, 4):
            at = dict(zip(c, m, strict=True))
            if all((at[p], at[q]) in side[p, q] for p, q in side if {p, q} <= set(c)):
                for i, (a, b, _) in enumerate(pattern.edges):
                    if any({a, b} == {c[k], c[(k + 1) % 4]} for k in range(4)):
                        on[i, at[a], at[b]].add(c)
    def needs(i):
        return {c for c in cycles if any({*pattern.edges[i][:2]} == {c[k], c[(k + 1) % 4]} for k in range(4))}
    want = {x for x, found in on.items() if found >= needs(x[0])}
    assert rows(M.four_cycle_safe(pattern, between)) == want
    some = between.where(F.col("src") % 3 != 0)
    assert rows(M.four_cycle_safe(pattern, between, some)) == {x for x in want if x[1] % 3}


@pytest.mark.parametrize("shape", ["square", "chord"])
def test_refine_reaches_the_fixpoint(spark, shape):
    """All tests hold on the result, and no embedding is lost."""
    pattern, (v, e) = SHAPES[shape], random_graph(spark, 5, 14, 30)
    vertices = v.join(G.degrees(e), "vid")
    full = rows(M.match_graph(pattern, v, e))
    candidates, between = M.refine(pattern, M.initial_candidates(pattern, vertices, e), e)
    assert rows(M.match(pattern, between)) == full
    c, b = rows(candidates.select("q", "vid")), rows(between)
    assert rows(M.bipartite_safe(pattern, candidates, between)) == c == rows(M.neighbour_safe(pattern, candidates, between))
    assert rows(M.edge_bipartite_safe(pattern, between)) == rows(M.four_cycle_safe(pattern, between)) == rows(M.triangle_safe(pattern, between)) == b


def test_refine_follows_a_chain_of_removals(spark):
    """A long path loses one end after the other: only a run to the fixpoint empties it, and the visits stop it before."""
    pattern = M.Pattern("triple", (0, 0, 0), ((0, 1, None), (1, 2, None), (0, 2, None)))
    chain = [(k, k + 1) for k in range(9)] + [(100, 101), (101, 102), (100, 102)]
    e = spark.createDataFrame([(a, b, 0) for a, b in chain] + [(b, a, 0) for a, b in chain], "src long, dst long, elabel int")
    v = spark.createDataFrame([(x,) for x in sorted({y for p in chain for y in p})], "vid long").withColumn("label", F.lit(0))
    candidates = M.union_all([v.select(F.lit(q).alias("q"), "vid") for q in range(3)])
    kept, between = M.refine(pattern, candidates, e)
    assert {vid for _, vid in rows(kept.select("q", "vid"))} == {100, 101, 102} and len(rows(between)) == 18
    some, _ = M.refine(pattern, candidates, e, visits=1)
    assert {100, 101, 102} <= {r["vid"] for r in some.collect()}


def test_matching_tests_are_counts_and_agree_with_all_matchings(spark):
    """no Python per candidate, and on random edges the same as trying all ways to give a vertex's edges distinct neighbours."""
    r = random.Random(5)
    clique = M.Pattern("clique", (0, 0, 0, 0), tuple((a, b, None) for a in range(4) for b in range(a + 1, 4)))
    star = M.Pattern("star", (0, 1, 1, 1, 2, 2), ((0, 1, None), (0, 2, None), (3, 0, None), (0, 4, None), (5, 0, None)))
    for pattern in (M.PATTERNS["star4"], M.PATTERNS["tri"], clique, star, M.Pattern("edge", (0, 1), ((0, 1, None),))):
        rows = set()
        for i, (a, b, _) in enumerate(pattern.edges):
            for x in range(14):
                rows |= {(i, x * 8 + pattern.labels[a], y * 8 + pattern.labels[b]) for y in r.sample(range(14), r.choice([0, 1, 1, 2, 3])) if x != y}
        between = spark.createDataFrame(sorted(rows), "edge int, src long, dst long")
        near = defaultdict(lambda: defaultdict(set))
        for i, x, y in rows:
            a, b, _ = pattern.edges[i]
            near[a, x][i].add(y)
            near[b, y][i].add(x)

        def ways(q, vid, but=None, taken=None, near=near, pattern=pattern):
            of = [near[q, vid][i] - {taken} for i, e in enumerate(pattern.edges) if q in e[:2] and i != but]
            return any(len(set(pick)) == len(pick) for pick in itertools.product(*of))

        candidates = sorted(near)
        df = spark.createDataFrame([*candidates, (0, 9999)], "q int, vid long")
        safe, edges = M.bipartite_safe(pattern, df, between), M.edge_bipartite_safe(pattern, between)
        assert sorted(map(tuple, safe.collect())) == [(q, v) for q, v in candidates if ways(q, v)]
        assert sorted(map(tuple, edges.collect())) == sorted((i, x, y) for i, x, y in rows if ways(pattern.edges[i][0], x, i, y) and ways(pattern.edges[i][1], y, i, x))
        for made in (safe, edges):
            assert "InPandas" not in made._jdf.queryExecution().toString()
