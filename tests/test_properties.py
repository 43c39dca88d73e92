"""Properties of operators that draw, train or iterate: what holds for every result."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from motifcast.functions.frames import checkpointed
from motifcast.functions.random import prn
from motifcast.operators import predicate as P
from motifcast.operators import sampling as E
from motifcast.operators import synth as W
from motifcast.operators import workload as Y


@pytest.fixture(scope="module")
def pop(spark):
    rows = spark.range(1500).select("id", (1 + F.col("id") % 9).cast("double").alias("a"), (0.1 + 0.8 * prn(F.col("id"), "p")).alias("proxy"))
    return checkpointed(rows.withColumn("pass", prn(F.col("id"), "o") < F.col("proxy")))


@pytest.fixture(scope="module")
def graph(spark):
    links = {(i, (i + k) % 40) for i in range(40) for k in (1, 2, 7)}
    return spark.createDataFrame([(a, b, 0) for a, b in links] + [(b, a, 0) for a, b in links], "src long, dst long, elabel int").distinct(), {frozenset(x) for x in links}


def test_scores_come_from_the_model_in_batches(spark):
    df = spark.createDataFrame([(1, "the cat of"), (2, None), (3, "dog")], "id long, text string")
    got = {r["id"]: r["prob"] for r in P.score(df, P.lexicon_model({"the": 0.2, "of": 0.1}, "text"), ["text"], batch=2).collect()}
    assert got == pytest.approx({1: 1 - 0.95 * 0.8 * 0.9, 2: 0.05, 3: 0.05})
    times = P.score_timing(df, P.lexicon_model({}, "text"), ["text"], batch=1).first()
    assert (times["batches"], times["rows"]) == (3, 3) and 0 <= times["min_s"] <= times["avg_s"] <= times["max_s"]
    assert P.score(df.limit(0), P.lexicon_model({}, "text"), ["text"]).count() == 0


def test_clusters_are_ordered_intervals(pop):
    spans = [(r["lo"], r["hi"]) for r in E.by_clusters(pop, 4).withColumn("x", F.col("proxy") * F.col("a")).groupBy("stratum").agg(F.min("x").alias("lo"), F.max("x").alias("hi")).orderBy("stratum").collect()]
    assert len(spans) == 4 and all(spans[i][1] < spans[i + 1][0] for i in range(3))
    assert E.by_clusters(pop.limit(3), 4).agg(F.max("stratum")).first()[0] == 0


def test_two_stages_hold_the_pilot_once(pop):
    cut = checkpointed(E.by_proxy(pop, 4))
    sample = E.two_stage_sample(cut, 200, 0.3, "two").collect()
    assert len({r["id"] for r in sample}) == len(sample) and 190 <= len(sample) <= 210
    assert all(0 < r["pi"] <= 1 for r in sample) and sum(r["pi"] == 1 for r in sample) >= 60


@pytest.mark.parametrize("runs", [12])
def test_adaptive_runs_are_about_right(pop, runs):
    truth = E.full_evaluation(pop).first()["estimate"]
    cells = {(r,): E.preset_cell("adaptive", 0.2, f"u{r}") for r in range(runs)}
    got = [r["estimate"] for r in E.named_cells(pop, cells, "run int").collect()]
    spread = math.sqrt(sum((x - truth) ** 2 for x in got) / runs)
    assert abs(sum(got) / runs - truth) < 3 * spread / math.sqrt(runs) + 0.02 * truth and spread < 0.15 * truth


def test_a_bandit_spends_its_budget(pop):
    cut = checkpointed(E.by_proxy(pop, 3))
    got = E.bandit(cut, 150, "b").first()
    truth = E.full_evaluation(pop).first()["estimate"]
    assert 150 <= got["n"] <= 210 and abs(got["estimate"] - truth) < 0.4 * truth


def test_noise_meets_the_range(spark):
    rows = spark.range(3000).withColumn("p", prn(F.col("id"), "w"))
    got = W.f1(W.noisy_proxy(rows, "id", "p", 0.75, 0.8, "proxy"), "proxy", "p").first()["f1"]
    assert 0.75 <= got <= 0.8


@pytest.mark.parametrize("kind", ["star", "tree", "cycle"])
def test_drawn_patterns_are_what_they_say(spark, graph, kind):
    edges, links = graph
    starts = spark.range(30).select(F.col("id").alias("pattern"), (F.col("id") % 40).alias("vid"))
    draw = {"star": Y.sample_stars, "tree": Y.sample_trees, "cycle": Y.sample_cycles}[kind]
    got = {r["pattern"]: r["vids"] for r in draw(edges, starts, 5, "d").collect()}
    assert got and got == {r["pattern"]: r["vids"] for r in draw(edges.repartition(7), starts, 5, "d").collect()}
    for pattern, vids in got.items():
        assert len(vids) == len(set(vids)) == 5 and vids[0] == pattern % 40
        inside = {frozenset((a, b)) for a in vids for b in vids if frozenset((a, b)) in links}
        seen, front = {vids[0]}, [vids[0]]
        while front:
            at = front.pop()
            new = {b for e in inside if at in e for b in e} - seen
            seen |= new
            front += new
        assert seen == set(vids)
        if kind == "star":
            assert all(frozenset((vids[0], b)) in links for b in vids[1:])
        if kind == "cycle":
            assert len(inside) >= 5


def test_core_labels_follow_the_weights(spark):
    vertices = spark.range(900).select((F.col("id") / 3).cast("long").alias("pattern"), (F.col("id") % 3).cast("int").alias("label")).unionByName(spark.createDataFrame([(900, 1), (901, 0)], "pattern long, label int"))
    got = {r["pattern"]: (r["required"], r["other"]) for r in Y.choose_core_labels(vertices, 0, {1: 3.0, 2: 1.0}, "c").collect()}
    assert 900 not in got and got[901] == (0, None) and all(r == 0 for r, _ in got.values())
    ones = sum(o == 1 for _, o in got.values())
    assert abs(ones / 300 - 0.75) < 4 * math.sqrt(0.75 * 0.25 / 300)
