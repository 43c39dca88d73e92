"""Aggregates without enumeration against matching on random graphs."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from motifcast.operators import match as M
from motifcast.operators import semiring as S

SHAPES = {
    "path": M.Pattern("path", (0, 1, 0), ((0, 1, None), (1, 2, None))),
    "star": M.Pattern("star", (0, 1, 1, 1), ((0, 1, None), (0, 2, None), (0, 3, None))),
    "tree": M.Pattern("tree", (0, 1, 0, 1, 0), ((0, 1, None), (1, 2, None), (2, 3, None), (1, 4, None))),
    "triangle": M.Pattern("triangle", (0, 0, 1), ((0, 1, None), (1, 2, None), (0, 2, None))),
    "square": M.Pattern("square", (0, 1, 0, 1), ((0, 1, None), (1, 2, None), (2, 3, None), (0, 3, None))),
    "tailed": M.Pattern("tailed", (0, 1, 0, 1), ((0, 1, None), (1, 2, None), (0, 2, None), (2, 3, None))),
}


def graph(spark, seed: int):
    r = random.Random(seed)
    label = {v: v % 2 for v in range(14)}
    links = {(min(a, b), max(a, b)) for a, b in ((r.randrange(14), r.randrange(14)) for _ in range(45)) if a != b} | {(3, 3)}
    vertices = spark.createDataFrame([(v, x) for v, x in label.items()], "vid long, label int")
    edges = spark.createDataFrame([(a, b, 0) for a, b in links] + [(b, a, 0) for a, b in links if a != b], "src long, dst long, elabel int")
    values = spark.createDataFrame([(v, v * v - 20) for v in label if v != 5] + [(6_000, 1)], "vid long, val long")
    return vertices, edges, values


@pytest.mark.parametrize("shape", SHAPES)
@pytest.mark.parametrize("seed", [1])
def test_aggregates_match_enumeration(spark, shape, seed):
    pattern, (vertices, edges, values) = SHAPES[shape], graph(spark, seed)
    candidates = M.union_all([vertices.where(F.col("label") == x).select(F.lit(q).alias("q"), "vid") for q, x in enumerate(pattern.labels)])
    between = M.candidate_edges(pattern, candidates, edges)
    found = [tuple(r) for r in M.match(pattern, between).collect()]
    found = [m for m in found if len(set(m)) == len(m)]
    val = {r["vid"]: r["val"] for r in values.collect()}
    g = lambda m, columns: sum(val.get(m[q], 0) for q in columns)
    for columns in ((), (0,), (0, 2)):
        got = S.marginals(pattern, between, values if columns else None, columns).first()
        assert (got["n"], got["s"]) == (len(found), sum(g(m, columns) for m in found) if columns and got["s"] is not None else None)
    keep = len(pattern.labels) - 1
    want: dict = {}
    for m in found:
        n, s = want.get(m[keep], (0, 0))
        want[m[keep]] = n + 1, s + g(m, (1, 0))
    assert {r["vid"]: (r["n"], r["s"]) for r in S.marginals(pattern, between, values, (1, 0), keep).collect()} == want


def test_no_embedding_rows_in_the_plan(spark):
    """On a tree every join is one of sums by vertex: no join has two columns of vertices on each side."""
    vertices, edges, values = graph(spark, 1)
    candidates = M.union_all([vertices.where(F.col("label") == x).select(F.lit(q).alias("q"), "vid") for q, x in enumerate(SHAPES["path"].labels)])
    out = S.marginals(SHAPES["path"], M.candidate_edges(SHAPES["path"], candidates, edges), values, (1,))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Cross" not in plan and plan.count("Aggregate") >= 5


def test_empty_and_large(spark):
    pattern = SHAPES["path"]
    none = spark.createDataFrame([], "edge int, src long, dst long")
    assert tuple(S.marginals(pattern, none).first()) == (0, None)
    values = spark.createDataFrame([(0, 10**12)], "vid long, val long")
    one = spark.createDataFrame([(0, a, 1) for a in range(0, 4000, 2)] + [(1, 1, a) for a in range(0, 4000, 2)], "edge int, src long, dst long")
    got = S.marginals(pattern, one, values, (0,), number="decimal(38,0)").first()
    assert (got["n"], got["s"]) == (2000 * 1999, 1999 * 10**12)


def test_quotients_of_a_star():
    assert sorted(sign for sign, _ in S.quotients(SHAPES["star"])) == [-1, -1, -1, 1, 2]


def test_a_cycle_is_opened_by_its_cheapest_vertex(spark):
    """Orders have two parts and a supplier each; a part is in many orders, and the table without orders is the smallest."""
    orders = range(1000, 1060)
    rows = [(0, o, p) for o in orders for p in (o % 3, (o + 1) % 3)] + [(1, p, 100 + s) for p in range(3) for s in range(2)] + [(2, o, 100 + o % 2) for o in orders]
    out = S.marginals(M.PATTERNS["tri"], spark.createDataFrame(rows, "edge int, src long, dst long"))
    text = out._jdf.queryExecution().optimizedPlan().toString()
    deepest = max((line for line in text.splitlines() if "Join Inner" in line), key=lambda line: line.index("Join"))
    assert "u0#" in deepest.split("Join Inner, ")[1]
    assert out.first()["n"] == 120
