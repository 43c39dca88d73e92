"""The library's operators: SQL of the queries, properties of the samplers, files, and edge cases."""

from __future__ import annotations

import math
import random
import subprocess
import sys
from collections import Counter
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from motifcast.functions import ordered
from motifcast.functions.ordered import cells, intervals, lookup, running
from motifcast.functions.random import below, below_sql, prn, prn_bits, prn_sql
from motifcast.operators import graph as G
from motifcast.operators import match as M
from motifcast.operators import predicate as P
from motifcast.operators import prep, synth
from motifcast.operators import sampling as E
from motifcast.operators import tree as X
from motifcast.plans import registry
from motifcast.sources import files as S

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: One query of each kind; the driver compares all of them.
CHECKED = ["g2_derive_edges", "g5_graph_stats", "g9_edge_triangles", "m2_initial_candidates", "m11_match_tri", "p4_exact_count", "p10_short_circuit", "e1_by_proxy", "e9_systematic", "q8_outliers", "q11_repeat_failures", "d14_threshold_grid", "d21_reference_check", "w5_distances", "y1_sample_paths", "s5_estimate_blocks"]


@pytest.fixture(scope="module")
def db(sf_dir):
    made = duckdb.connect()
    for t in TABLES:
        made.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return made


@pytest.mark.parametrize("name", CHECKED)
def test_query_matches_sql(spark, sf_dir, db, name):
    sql = registry.ORACLE_SQL[name]
    columns = sorted(db.sql(sql).columns)
    quoted = ", ".join(f'"{c}"' for c in columns)
    want = Counter(map(repr, db.sql(f"select {quoted} from ({sql})").fetchall()))
    got = Counter(repr(tuple(r)) for r in registry.QUERIES[name](spark, sf_dir).select(*columns).collect())
    assert got == want


def test_portable_random_numbers(spark, db):
    rows = {r["id"]: r["b"] for r in spark.range(200).select("id", prn_bits(F.col("id"), "s").alias("b")).collect()}
    want = dict(db.sql(f"select i, {prn_sql('i', 's')} from range(200) t(i)").fetchall())
    assert rows == want


def test_running_sum_and_lookup(spark):
    df = spark.range(3000).withColumn("u", prn(F.col("id"), "r")).withColumn("w", (F.col("id") % 7 + 1).cast("double")).withColumn("g", F.col("id") % 3)
    got = running(df, ["u", "id"], "w", "c", by=["g"], buckets=64).collect()
    for g in range(3):
        total = 0.0
        for r in sorted((r for r in got if r["g"] == g), key=lambda r: (r["u"], r["id"])):
            total += r["w"]
            assert math.isclose(total, r["c"])


def test_draws_find_their_interval(spark):
    """Groups above and below the size of a bucket, one unit that outweighs all others, totals above 2**40."""
    rows = [("hub", i, 1 + i % 5) for i in range(3000)] + [("hub", 3000, 1 << 41)] + [("few", i, (1 << 41) + i) for i in range(3)] + [("one", 7, 1)]
    placed = intervals(spark.createDataFrame(rows, "g string, id long, w long"), ["g"], "id").cache()
    spans: dict = {}
    for r in placed.collect():
        spans.setdefault(r["g"], []).append((r["lo"], r["hi"], r["id"], r["total"]))
    weight = {(g, i): w for g, i, w in rows}
    for g, got in spans.items():
        at = 0
        for lo, hi, i, total in sorted(got):
            assert lo == at and hi - lo == weight[g, i]
            at = hi
        assert at == total == sum(w for (x, _), w in weight.items() if x == g)
    draws = spark.range(6000).withColumn("g", F.element_at(F.array(F.lit("hub"), F.lit("few"), F.lit("one")), (F.col("id") % 3 + 1).cast("int"))).withColumnRenamed("id", "draw")
    draws = draws.join(placed.select("g", "total", "width").distinct(), "g").withColumn("x", below(F.col("draw"), "d", F.col("total")))
    units = cells(placed)
    assert units.count() <= 3 * len(rows) + 4
    got = lookup(draws, units, ["g"]).select("draw", "g", "x", "id").collect()
    assert len(got) == 6000
    for r in got:
        assert any(lo <= r["x"] < hi and i == r["id"] for lo, hi, i, _ in spans[r["g"]])
    met = draws.withColumn("cell", F.expr("x div width")).join(units, ["g", "cell"]).count()
    assert met < 3 * 6000


def test_numbers_below_large_totals(spark, db):
    total = 9 * 10**17 + 7
    rows = {r["id"]: r["x"] for r in spark.range(300).select("id", below(F.col("id"), "big", F.lit(total)).alias("x")).collect()}
    assert rows == dict(db.sql(f"select i, {below_sql('i', 'big', str(total))} from range(300) t(i)").fetchall())
    assert all(0 <= x < total for x in rows.values()) and max(rows.values()) > total * 0.95 and len({x % 1024 for x in rows.values()}) > 200


def test_draws_with_replacement_reach_their_units(spark):
    """One heavy unit among many: draws go on until enough distinct ones are there, or 200 times as many draws."""
    pop = spark.createDataFrame([(i, 5000.0 if i == 0 else 1.0, 1.0, True, 0) for i in range(200)] + [(1000 + i, 1.0, 1.0, True, 1) for i in range(5)], "id long, a double, proxy double, pass boolean, stratum int")
    got = E.with_replacement(pop, {0: 30, 1: 9}, F.col("a"), "wr").groupBy("stratum").agg(F.countDistinct("id").alias("n"), F.count(F.lit(1)).alias("draws"), F.max("draw").alias("last")).collect()
    state = {r["stratum"]: r for r in got}
    assert state[0]["n"] == 30 and state[0]["draws"] == state[0]["last"] + 1 > 650
    assert (state[1]["n"], state[1]["draws"]) == (5, 1800)  # nine are wanted, five exist
    assert E.with_replacement(pop.limit(0), {0: 3}, F.col("a"), "wr").count() == 0


@pytest.mark.parametrize("direct", [0, 10**9])
def test_quantiles_are_exact(spark, monkeypatch, direct):
    """Many ties, few values, one value, nulls, null keys, groups of nulls alone; accuracy so low that bounds hold many values."""
    from motifcast.functions import ordered

    monkeypatch.setattr(ordered, "DIRECT_ROWS", direct)
    monkeypatch.setattr(ordered, "ACCURACY", 20)
    r = random.Random(4)
    rows = [("many", r.gauss(0, 1)) for _ in range(5000)] + [("ties", float(r.randrange(3))) for _ in range(700)] + [("one", 4.0)] + [("two", 1.0), ("two", 2.0), ("two", None), (None, 5.0), (None, 7.0), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    shares = [0.0, 0.25, 0.333, 0.5, 0.95, 1 - 1e-6, 1.0]
    want = {x["g"]: x["q"] for x in df.groupBy("g").agg(F.percentile("v", F.array(*map(F.lit, shares))).alias("q")).collect()}
    got = {x["g"]: x["q"] for x in ordered.quantiles(df, "v", shares, ["g"]).collect()}
    assert got == {g: q for g, q in want.items() if q is not None}
    assert ordered.quantiles(df, "v", shares).first()["q"] == df.agg(F.percentile("v", F.array(*map(F.lit, shares))).alias("q")).first()["q"]
    means = ordered.with_quantiles(df.groupBy("g").count(), df, "v", [0.5], ["g"])
    assert {x["g"]: x["q"] and x["q"][0] for x in means.collect()} == {g: q and q[3] for g, q in want.items()}
    assert ordered.quantiles(df.limit(0), "v", shares, ["g"]).count() == 0


def test_quantiles_take_their_bounds_once(spark, monkeypatch):
    """Sketches merged in another order give other bounds, here by up to eight places of forty; both passes must see the same ones."""
    from motifcast.functions import ordered

    sketch = F.percentile_approx
    moved = F.udf(lambda found: [x + random.uniform(-8, 8) for x in found], "array<double>").asNondeterministic()
    monkeypatch.setattr(ordered.F, "percentile_approx", lambda *of: moved(sketch(*of)))
    rows = spark.range(200_001).select((F.col("id") % 2).alias("g"), F.expr("(id div 2) * 1.0D").alias("v"))
    assert {r["g"]: r["q"][0] for r in ordered.quantiles(rows, "v", [0.8], ["g"]).collect()} == {0: 80_000.0, 1: 0.8 * 99_999}


@pytest.fixture(scope="module")
def small(spark):
    """A random labelled graph with hubs."""
    links = spark.range(420).select((prn(F.col("id"), "a") * prn(F.col("id"), "a2") * 60).cast("long").alias("u"), (60 + prn(F.col("id"), "b") * 50).cast("long").alias("v")).distinct()
    more = spark.range(200).select((prn(F.col("id"), "c") * 60).cast("long").alias("u"), (prn(F.col("id"), "d") * 60).cast("long").alias("v")).where("u < v").distinct()
    links = G.checkpointed(links.unionByName(more).withColumn("elabel", F.lit(0)))
    edges = G.checkpointed(G.both_directions(links))
    vertices = spark.range(110).select(F.col("id").alias("vid"), F.when(F.col("id") < 60, 0).otherwise(1).alias("label")).join(G.degrees(edges), "vid")
    return G.checkpointed(vertices), edges


def adjacency(edges):
    near = {}
    for r in edges.collect():
        near.setdefault(r["src"], set()).add(r["dst"])
    return near


def test_core_numbers(small):
    near = adjacency(small[1])
    core, left, k = {}, {v: set(n) for v, n in near.items()}, 0
    while left:
        low = [v for v, n in left.items() if len(n) <= k]
        if not low:
            k += 1
        for v in low:
            core[v] = k
            for n in left.pop(v):
                if n in left:
                    left[n].discard(v)
    assert {r["vid"]: r["core"] for r in G.core_numbers(small[1]).collect()} == core


def test_core_numbers_of_a_chain(spark):
    chain = G.checkpointed(G.both_directions(spark.range(19).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"), F.lit(0).alias("elabel"))))
    with pytest.raises(RuntimeError):
        G.core_numbers(chain, rounds=3).collect()
    assert [r["core"] for r in G.core_numbers(chain).collect()] == [1] * 20


SQUARE = M.Pattern("square", (0, 1, 0, 1), ((0, 1, 0), (1, 2, 0), (2, 3, 0), (0, 3, 0)), (0, 2))
STAR = M.Pattern("star", (0, 1, 1), ((0, 1, 0), (0, 2, 0)), (0,))


@pytest.mark.parametrize("pattern", [SQUARE, STAR], ids=lambda p: p.name)
def test_filters_keep_all_matches(small, pattern):
    vertices, edges = small
    full = M.match_graph(pattern, vertices, edges).collect()
    cores = G.core_numbers(edges)
    candidates, between = M.refine(pattern, M.initial_candidates(pattern, vertices, edges, cores), edges)
    assert Counter(map(tuple, M.match(pattern, between).collect())) == Counter(map(tuple, full)) and full
    kept = {(r["q"], r["vid"]) for r in candidates.collect()}
    assert {(q, row[q]) for row in full for q in range(len(pattern.labels))} <= kept


def test_tree_estimates(small):
    vertices, edges = small
    pattern = SQUARE
    truth = M.match_graph(pattern, vertices, edges).count()
    c = M.checkpointed(M.initial_candidates(pattern, vertices, edges))
    b = M.checkpointed(M.candidate_edges(pattern, c, edges))
    tree = X.choose_tree(pattern, *X.densities(c, b))
    counts = X.count_trees(pattern, tree, c, b)
    total = X.total_trees(tree, counts)
    trials = M.checkpointed(X.sample_trees(pattern, tree, counts, b, 6000, "t"))
    assert trials.count() == 6000
    est = X.estimate_count(trials, total).first()
    assert abs(est["estimate"] - truth) < 5 * total * math.sqrt(est["successes"]) / 6000
    weights = X.projection_weights(trials, pattern.core, total).agg(F.sum("est_w")).first()[0]
    roots = X.root_frequency(trials, tree.order[0], total).agg(F.sum("estimate")).first()[0]
    assert math.isclose(weights, est["estimate"]) and math.isclose(roots, est["estimate"])
    n, s = X.stop_rule(trials)
    assert n <= 6000 and n % 100 == 0 and s > 0
    assert abs(X.estimate_by_expansion(pattern, c, b, 100_000, "g").first()[0] - truth) < 0.5 * truth


def test_tree_trials_are_drawn_until_the_rule_holds(spark, small):
    vertices, edges = small
    pattern = SQUARE
    c = M.checkpointed(M.initial_candidates(pattern, vertices, edges))
    b = M.checkpointed(M.candidate_edges(pattern, c, edges))
    tree = X.choose_tree(pattern, *X.densities(c, b))
    counts = X.count_trees(pattern, tree, c, b)
    total = X.total_trees(tree, counts)
    drawn = [X.sample_until_stop(pattern, tree, counts, b, "r", at_once) for at_once in (500, 4000)]
    a, z = (sorted(map(tuple, t.collect())) for t in drawn)
    assert a == z and len(a) % 100 == 0 and len(a) >= 1000 and X.first_stop(drawn[0])[2]
    assert not X.first_stop(drawn[0].where(F.col("trial") < len(a) - 100))[2]
    # With no success at all the rule gives up, and the estimate comes from expansion.
    never = M.checkpointed(drawn[0].withColumn("valid", F.lit(False)))
    assert X.first_stop(never, give_up=1000) == (1000, 0, True)
    assert X.estimate_embeddings(pattern, c, b, drawn[0], total).first()["by"] == "trees"
    grown = X.estimate_embeddings(pattern, c, b, never, total, keep=100_000).first()
    truth = M.match_graph(pattern, vertices, edges).count()
    assert grown["by"] == "expansion" and abs(grown["estimate"] - truth) < 0.5 * truth
    # The oracle inside the loop, against a plain loop over the trials.
    attrs = M.checkpointed(vertices.select("vid", F.when(F.col("vid") % 3 == 0, 0.2).otherwise(0.9).alias("prob")))
    for budget in (3, 10**6):
        trials = X.sample_until_spent(pattern, tree, counts, b, attrs, pattern.core, budget, "r", 500)
        got = X.estimate_under_budget(trials, attrs, pattern.core, total, budget).first()
        seen, n, hits, over = set(), 0, 0, False
        for row in sorted(trials.collect(), key=lambda r: r["trial"]):
            new, ok = set(), row["valid"]
            for q in pattern.core if ok else ():
                new.add(row[f"u{q}"])
                if row[f"u{q}"] % 3 == 0:
                    ok = False
                    break
            over = len(seen | new) > budget
            if over:
                break
            seen, n, hits = seen | new, n + 1, hits + ok
            over = n % 100 == 0 and n >= 1000 and hits > 0 and X.binomial_tail(hits, n, 0.8 * hits / n) < 0.025 and (1.25 * hits >= n or 1 - X.binomial_tail(hits + 1, n, 1.25 * hits / n) < 0.025)
            if over:
                break
        assert over and (got["trials"], got["unique"]) == (n, len(seen)) and math.isclose(got["estimate"], hits * total / n)
    nothing = X.sample_until_stop(pattern, tree, {q: w.where("false") for q, w in counts.items()}, b, "r")
    assert nothing.count() == 0
    assert X.curve_budgets((0.1, 0.2), {0.1: 50}, 70) == {0.1: 60, 0.2: 70} and X.curve_budgets((0.5,), {}) == {0.5: 500}


def test_budget_curve_ends_where_the_distinct_count_is_reached(spark):
    pop = spark.createDataFrame([(i, float(1 + i % 7), 0.5, i % 3 == 0) for i in range(200)], "id long, a double, proxy double, pass boolean")
    got = {r["frac"]: r["draws"] for r in E.budget_curve_replacement(pop, F.col("a"), [0.1, 0.25], "c").collect()}
    draws = {r["draw"]: r["id"] for r in E.with_replacement(pop.withColumn("stratum", F.lit(0)), {0: 50}, F.col("a"), "c").collect()}
    for frac, target in ((0.1, 20), (0.25, 50)):
        seen: set = set()
        for draw in sorted(draws):
            seen.add(draws[draw])
            if len(seen) == target:
                break
        assert got[frac] == len([d for d in draws if d <= draw]) and len(seen) == target


def test_uniform_budget_stops_after_a_free_batch(spark):
    matches = spark.createDataFrame([(i,) for i in range(5)], "u0 long")
    attrs = spark.createDataFrame([(i, 0.9 if i % 2 else 0.1) for i in range(5)], "vid long, prob double")
    ask = lambda budget, free: E.uniform_budget(matches, attrs, [("u0", "r", 10)], budget, 1000, "s", F.col("u0"), free).first()
    every, some = ask(10**6, 10_000), ask(10**6, 100)
    assert (every["draws"], every["cost"]) == (1000, 50) and some["cost"] == 50 and some["draws"] == 200
    assert ask(20, 100)["cost"] == 20 and ask(20, 100)["draws"] < 100


def test_uniform_budget_reads_matches_once_and_orders_drawn_parts_alone(spark):
    """the draws are the places in the order of bucket and key, and the matches are made once."""
    made = spark.sparkContext.accumulator(0)

    def name(i):
        made.add(1)
        return f"{i * 37 % 600}-x"

    ids = spark.range(600).select(F.col("id").alias("u0"))
    matches = ids.withColumn("name", F.udf(name, "string").asNondeterministic()("u0"))
    attrs = ids.select(F.col("u0").alias("vid"), F.when(F.col("u0") % 3 == 0, 0.9).otherwise(0.1).alias("prob"))
    got = E.uniform_budget(matches, attrs, [("u0", "r", 10)], 10**6, 200, "s", F.col("name")).first()
    assert made.value == 600
    plain = ids.withColumn("name", F.expr("concat(u0 * 37 % 600, '-x')")).withColumn("b", F.pmod(F.xxhash64("name"), F.lit(256)))
    order = [r["u0"] for r in plain.orderBy("b", "name").collect()]
    drawn = [order[r["x"]] for r in spark.range(200).select(below(F.col("id"), "s", F.lit(600).cast("long")).alias("x")).collect()]
    assert (got["draws"], got["cost"]) == (200, 10 * len(set(drawn))) and abs(got["estimate"] - 3 * sum(u % 3 == 0 for u in drawn)) < 1e-6


def test_best_number_of_strata(spark):
    tuned = spark.createDataFrame([(2, 0.3), (5, 0.1), (7, 0.1)], "k int, mean double")
    assert tuple(E.best_strata(tuned).first()) == (5, 0.1)


def test_binomial_tail():
    for n, p, s in ((20, 0.3, 7), (500, 0.1, 60), (1000, 0.9, 880), (50, 0.5, 0), (50, 0.5, 51)):
        exact = sum(math.comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(max(s, 0), n + 1))
        assert math.isclose(X.binomial_tail(s, n, p), exact, rel_tol=1e-9, abs_tol=1e-12)


@pytest.fixture(scope="module")
def pop(spark):
    u = prn(F.col("id"), "pop")
    return G.checkpointed(spark.range(2000).select("id", (1 + 20 * prn(F.col("id"), "w") ** 3).alias("a"), (0.8 * u + 0.1).alias("proxy"), (prn(F.col("id"), "pass") < 0.8 * u + 0.1).alias("pass")))


def test_inclusion_probabilities_add_up(pop):
    flat = pop.withColumn("stratum", F.lit(0))
    rows = E.inclusion(flat, {0: 300}, F.pow("a", F.lit(3))).agg(F.sum("pi"), F.max("pi"), F.min("pi")).first()
    assert math.isclose(rows[0], 300, rel_tol=1e-9) and rows[1] == 1 and rows[2] > 0
    assert E.systematic(flat, {0: 300}, F.pow("a", F.lit(3)), "x").count() in (299, 300, 301)


@pytest.mark.parametrize("sampling", ["systematic", "uniform", "replacement"])
def test_estimates_are_close(pop, sampling):
    truth = E.full_evaluation(pop).first()["estimate"]
    estimates = [E.stratified_run(pop, 0.15, "contribution", sampling, salt=f"s{i}").first()["estimate"] for i in range(3)]
    assert abs(sum(estimates) / 3 - truth) < 0.12 * truth


def test_small_populations_and_odd_strata(pop, spark):
    few = pop.where("id < 50")
    assert E.stratified_run(few, 0.1).first()["estimate"] == E.full_evaluation(few).first()["estimate"]
    same = pop.withColumn("proxy", F.lit(0.5))
    assert E.by_proxy(same, 5).select("stratum").distinct().count() == 1
    zero = pop.withColumn("proxy", F.lit(0.0))
    assert E.stratified_run(zero, 0.2).first()["n"] > 0
    assert E.full_evaluation(pop.limit(0)).first()["estimate"] == 0


def test_largest_remainder():
    assert E.largest_remainder({0: 1.0, 1: 1.0, 2: 1.0}, 10) == {0: 4, 1: 3, 2: 3}
    assert E.largest_remainder({0: 100.0, 1: 1.0}, 20, 1, {0: 5, 1: 50}) == {0: 5, 1: 15}
    assert E.largest_remainder({0: 1.0, 1: 0.0}, 5, 1) == {0: 5, 1: 1}


def test_short_circuit(spark):
    draws = spark.createDataFrame([(0,), (1,), (2,)], "draw long")
    checks = spark.createDataFrame([(0, 0, "r", 1, False), (0, 1, "r", 2, True), (1, 0, "r", 2, True), (1, 1, "r", 3, True), (2, 0, "r", 3, True), (2, 1, "r", 2, True)], "draw long, pos int, role string, vid long, pass boolean")
    done, made = P.short_circuit(draws, checks)
    assert {r["draw"]: r["pass"] for r in done.collect()} == {0: False, 1: True, 2: True}
    assert sorted((r["draw"], r["vid"], r["charged"]) for r in made.collect()) == [(0, 1, True), (1, 2, True), (1, 3, True), (2, 2, False), (2, 3, False)]


def test_exact_answers_of_nothing(spark):
    none = spark.createDataFrame([], "u0 long, u1 long")
    attrs = spark.createDataFrame([(1, 0.9, 5.0)], "vid long, prob double, val double")
    assert P.exact_count(none).first()["answer"] == 0 and P.exact_sum(none, attrs, ["u0"]).first()["answer"] == 0
    with pytest.raises(ValueError):
        P.exact_sum(none, attrs)


def test_parse_answer(spark):
    rows = spark.createDataFrame([("Yes, 0.83",), ("no 1.0.",), ("maybe",), (None,), ("yes, 1.7",)], "t string").select(P.parse_answer(F.col("t")).alias("a")).collect()
    assert [(r["a"]["label"], r["a"]["confidence"]) if r["a"] else None for r in rows] == [("yes", 0.83), ("no", 1.0), None, None, None]


def test_graph_files(spark, tmp_path):
    (tmp_path / "g").mkdir()
    (tmp_path / "g" / "x.graph").write_text("t 3 2\nv 0 5 1\nv 1\nv 2 7 1\ne 0 1\ne 2 1 4\n")
    vertices, edges = S.read_graph(spark, str(tmp_path / "g"))
    assert sorted(map(tuple, vertices.collect())) == [(0, 5), (1, 0), (2, 7)]
    assert sorted(map(tuple, edges.collect())) == [(0, 1, 0), (1, 0, 0), (1, 2, 4), (2, 1, 4)]


def test_result_error(spark):
    rows = spark.createDataFrame([(0.0, 0.0), (3.0, 0.0), (3.0, 2.0)], "e double, t double").select(S.result_error(F.col("e"), F.col("t")).alias("x")).collect()
    assert [r["x"] for r in rows] == [0.0, 1.0, 0.5]


def test_entry_without_the_training_data_operators():
    """With that subpackage gone (and corpus_pipeline.py left or gone), all other queries are there."""
    code = """
import importlib.util, sys
find = importlib.util.find_spec
importlib.util.find_spec = lambda name, *rest: None if name.startswith("motifcast.llm") else find(name, *rest)
sys.modules["motifcast.llm"] = None
import __spark_entry__
from motifcast.plans import registry
assert __spark_entry__.queries().keys() == registry.QUERIES.keys() and __spark_entry__.oracle_sql() == registry.ORACLE_SQL
"""
    subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).parents[1], check=True)


def test_a_grid_gives_what_single_runs_give(spark):
    """Every cell of a grid equals the run with its parameters; one job chain for all of them."""
    pop = spark.range(900).select(F.col("id"), (F.col("id") % 13 + 1).cast("double").alias("a"), (0.1 + 0.8 * prn(F.col("id"), "p")).alias("proxy"), (prn(F.col("id"), "o") < 0.4).alias("pass"))
    pop = M.checkpointed(pop)
    truth = E.full_evaluation(pop).first()["estimate"]
    names = ["contribution_importance", "proxy_uniform"]
    got = {(r["method"], r["frac"], r["run"]): (r["estimate"], r["n"]) for r in E.grid(pop, names, [0.05, 0.3], 2, truth).collect()}
    assert len(got) == 8
    for (m, f, r), (estimate, n) in got.items():
        one = E.preset(pop, m, f, f"run{r}").first()
        assert n == one["n"] and math.isclose(estimate, one["estimate"], rel_tol=1e-9)
    worse = E.grid(pop, names[:1], [0.3], 1, truth, {"good": "proxy", "flat": "0.5 * proxy + 0.25"}).collect()
    assert {r["proxy"] for r in worse} == {"good", "flat"} and len({r["estimate"] for r in worse}) == 2
    few = E.grid(pop.limit(50), names, [0.1], 1, truth).collect()
    assert {r["n"] for r in few} == {50}
    tuned = E.tune_strata(pop, [1, 4], 0.2, 2, truth).collect()
    assert {r["k"] for r in tuned} == {1, 4} and all(r["median"] <= r["p95"] for r in tuned)


def test_roles_calls_and_pilot(spark):
    """Checks of a row stop at its first failure, a vertex is paid once; a vertex that is not known fails."""
    attrs = spark.createDataFrame([(1, "order", 0.9, 0.5), (2, "order", 0.1, 0.5), (7, "part", 0.8, None), (8, "part", 0.2, 0.25)], "vid long, role string, prob double, proxy double")
    long = spark.createDataFrame([("p", "x", 1, 1, 2.0), ("p", "x", 2, 7, 2.0), ("p", "y", 1, 2, 3.0), ("p", "y", 2, 7, 3.0), ("p", "z", 1, 1, 4.0), ("p", "z", 2, 8, 4.0), ("p", "w", 1, 99, 1.0), ("p", "v", 1, 1, 0.0)], "pattern string, instance_id string, core_index int, vid long, est_w double")
    wide = E.aggregate_instances(long, attrs)
    x = {r["instance_id"]: r for r in wide.collect()}
    assert x["x"]["ids"] == {"order": [1], "part": [7]} and x["x"]["probs"] == {"order": [0.9], "part": [0.8]} and x["w"]["lost"] == 1
    pop = {r["id"]: r for r in E.population(wide).collect()}
    assert {i: (r["a"], r["proxy"], r["pass"]) for i, r in pop.items()} == {"x": (2.0, 0.5, True), "y": (3.0, 0.5, False), "z": (4.0, 0.125, False), "w": (1.0, 1.0, False)}
    assert pop["z"]["slots"] == {"order": 1, "part": 1} and [(c["role"], c["vid"], c["pass"]) for c in pop["z"]["checks"]] == [("order", 1, True), ("part", 8, False)]
    assert E.role_calls(E.population(wide)).first()["calls"] == {"order": 2, "part": 2}  # y stops at its order
    many = spark.range(2000).select("id", F.lit(2.0).alias("a"), (0.2 + 0.6 * prn(F.col("id"), "p")).alias("proxy"), (prn(F.col("id"), "o") < 0.5).alias("pass"))
    run = E.stratified_run(many, 0.2, pilot=0.25, truth=2000.0, calls=True).first()
    assert 380 <= run["n"] <= 420 and run["calls"] == {"core": run["n"]} and run["error"] < 0.2


def test_walks_reach_all_spanning_trees(spark, small):
    """A cycle of four has four spanning trees; each gives an estimate of the same count."""
    vertices, edges = small
    trees = [X.random_walk_tree(SQUARE, f"s{i}") for i in range(60)]
    kinds = {frozenset(t.edge.values()): t for t in trees}
    assert len(kinds) == 4 and min(Counter(frozenset(t.edge.values()) for t in trees).values()) >= 5
    assert X.random_walk_tree(SQUARE, "s0") == trees[0]
    c = M.checkpointed(M.initial_candidates(SQUARE, vertices, edges))
    b = M.checkpointed(M.candidate_edges(SQUARE, c, edges))
    truth = M.match(SQUARE, b).count()
    for t in list(kinds.values())[:2]:
        assert all(t.parent[q] in t.order[: t.order.index(q)] for q in t.order[1:])
        counts = X.count_trees(SQUARE, t, c, b)
        total = X.total_trees(t, counts)
        got = X.estimate_count(X.sample_trees(SQUARE, t, counts, b, 4000, "walk"), total).first()
        assert abs(got["estimate"] - truth) < 5 * total * math.sqrt(max(1, got["successes"])) / 4000


def test_numbers_without_gaps(spark):
    rows = [(g, r, i) for i, (g, r) in enumerate([(None, 5), (None, 5), ("a", 1)] + [("hub", i * 37 % 101) for i in range(300)])]
    df = spark.createDataFrame(rows, "g string, k int, id int").repartition(5)
    got: dict = {}
    for r in ordered.numbered(df, ["g"], ["k", "id"]).collect():
        got.setdefault(r["g"], []).append((r["rank"], r["k"], r["id"]))
    for g, found in got.items():
        assert [x[1:] for x in sorted(found)] == sorted((k, i) for x, k, i in rows if x == g) and [x[0] for x in sorted(found)] == list(range(1, len(found) + 1))
    assert len(got) == 3 and ordered.numbered(df.limit(0), ["g"], ["k"]).count() == 0


def test_mixture_has_exact_shares(spark):
    got = synth.mixture(spark.range(997), "id", 0.3, "p").agg(F.sum((F.col("p") < 0.5).cast("int")), F.min("p"), F.max("p"), F.sum((F.col("p") == 0.5).cast("int"))).first()
    assert got[0] == round(0.3 * 997) and 0 <= got[1] < 0.01 and 0.99 < got[2] <= 1 and got[3] == 0


def test_auc_and_proxies(spark):
    r = random.Random(6)
    rows = [(float(r.randrange(12)), r.random() < 0.4) for _ in range(200)]
    wins = [(x > y) + (x == y) / 2 for x, p in rows if p for y, q in rows if not q]
    assert math.isclose(prep.auc(spark.createDataFrame(rows, "s double, t boolean"), "s", F.col("t")).first()["auc"], sum(wins) / len(wins))
    assert prep.auc(spark.createDataFrame([(1.0, True)], "s double, t boolean"), "s", F.col("t")).first()["auc"] is None
    points = [([r.gauss(0, 1) + (k % 2), r.gauss(0, 1)], 0.8 if k % 2 else 0.2) for k in range(400)]
    df = spark.createDataFrame(points, "v array<double>, prob double")
    got = {x["model"]: x for x in prep.compare_proxies(df.limit(300), df, "v", "prob").collect()}
    assert set(got) == {"linear", "svm", "mlp"} and all(x["auc"] > 0.7 and x["accuracy"] > 0.6 and x["n"] == 400 for x in got.values()) and got["svm"]["mse"] is None


def test_saved_matches_resume(spark, tmp_path):
    """A run that stops half way and starts again gives the same table as one run; what it left behind is not read."""
    path = str(tmp_path / "matches")
    one, two = spark.range(5).withColumnRenamed("id", "u0"), spark.range(3).selectExpr("id AS u0", "id + 1 AS u1")

    def broken(df):
        def fail(batches):
            yield from batches
            raise RuntimeError("lost")

        return df.mapInPandas(fail, df.schema)

    with pytest.raises(Exception, match="lost"):
        S.save_matches({"one": one, "two": broken(two)}, path)
    assert [r["pattern"] for r in S.saved_matches(spark, path).collect()] == ["one"]
    before = S.read_matches(spark, path, "one").inputFiles()
    summary = {r["pattern"]: r["n"] for r in S.save_matches({"one": one, "two": two, "none": one.limit(0)}, path).collect()}
    assert summary == {"one": 5, "two": 3, "none": 0}
    assert S.read_matches(spark, path, "one").inputFiles() == before
    assert sorted(map(tuple, S.read_matches(spark, path, "two").collect())) == [(0, 1), (1, 2), (2, 3)]
    with pytest.raises(KeyError):
        S.read_matches(spark, path, "three")


def test_a_budget_curve_is_its_single_budgets(spark, small):
    """Each budget of a curve gives what a run with that budget alone gives, stop rule included."""
    vertices, edges = small
    c = M.checkpointed(M.initial_candidates(SQUARE, vertices, edges))
    b = M.checkpointed(M.candidate_edges(SQUARE, c, edges))
    tree = X.choose_tree(SQUARE, *X.densities(c, b))
    counts = X.count_trees(SQUARE, tree, c, b)
    total = X.total_trees(tree, counts)
    trials = M.checkpointed(X.sample_trees(SQUARE, tree, counts, b, 3000, "curve"))
    attrs = vertices.select("vid", prn(F.col("vid"), "o").alias("prob"))
    budgets = {0.1: 3, 0.2: 12, 0.5: 12, 0.9: 10_000, 0.0: 0}
    for rule in ({}, {"give_up": 200, "least": 10_000}):
        got = {r["frac"]: tuple(r)[1:] for r in X.budget_curve(trials, attrs, (0, 2), total, budgets, **rule).collect()}
        assert got == {f: tuple(X.estimate_under_budget(trials, attrs, (0, 2), total, n, **rule).first()) for f, n in budgets.items()}
