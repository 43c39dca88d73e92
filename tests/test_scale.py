"""Steps that grew faster than their input, and results that hung on ties or equal numbers."""

from __future__ import annotations

import itertools
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from motifcast.functions.frames import among, checkpointed, shared_folder
from motifcast.functions.random import prn
from motifcast.operators import graph as G
from motifcast.operators import match as M
from motifcast.operators import predicate as P
from motifcast.operators import report as R
from motifcast.operators import sampling as E
from motifcast.operators import tree as X
from motifcast.operators import workload as Y
from motifcast.plans import registry
from motifcast.plans.reports import rounded_scaled


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def size(folder: str) -> int:
    return sum(f.stat().st_size for f in Path(folder.removeprefix("file:")).rglob("*") if f.is_file())


def test_kept_rows_are_small(spark):
    rows = spark.range(200_000).select((F.xxhash64("id") % 1_000_000).alias("src"), (F.xxhash64("id", "id") % 1_000_000).alias("dst"), F.lit(1).alias("elabel"))
    sizes = [size(shared_folder(spark))]
    for keep in (checkpointed, lambda df: df.checkpoint(eager=True)):
        assert keep(rows).count() == 200_000
        sizes.append(size(shared_folder(spark)))
    assert 1.5 * (sizes[1] - sizes[0]) < sizes[2] - sizes[1]


def hub(spark):
    """A hub with 50 neighbours that are a ring."""
    ring = [(i, i % 50 + 1, 0) for i in range(1, 51)] + [(0, i, 1) for i in range(1, 51)]
    return spark.createDataFrame([*ring, *[(b, a, k) for a, b, k in ring]], "src long, dst long, elabel int")


def test_walks_take_the_least_number_without_sorting(spark, monkeypatch):
    edges, starts = hub(spark), spark.createDataFrame([(i, i) for i in range(1, 51)], "pattern long, vid long")
    plans = []
    monkeypatch.setattr(Y, "checkpointed", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or checkpointed(df))
    walks = {r["pattern"]: r["vids"] for r in Y.sample_paths(edges, starts, 3, "s").collect()}
    assert not any("SortAggregate" in p for p in plans)
    near = {(r["src"], r["dst"]) for r in edges.collect()}
    pairs = [(p, v) for p in range(1, 51) for v in range(51)]
    number = {(step, r["p"], r["v"]): r["x"] for step in (1, 2) for r in spark.createDataFrame(pairs, "p long, v long").select("p", "v", prn(F.concat_ws("-", "p", "v"), f"s-{step}").alias("x")).collect()}
    for p in range(1, 51):
        vids = [p]
        for step in (1, 2):
            vids.append(min((v for v in range(51) if (vids[-1], v) in near and v not in vids), key=lambda v: (number[step, p, v], v)))
        assert walks[p] == vids


def test_induced_edges_make_no_edges_of_a_hub(spark):
    patterns = spark.createDataFrame([(1, [0, 1, 2]), (2, [3, 0, 9])], "pattern long, vids array<long>")
    out = Y.induced_edges(patterns, hub(spark))
    assert plan(out).count("Join ") == 1
    assert {tuple(r) for r in out.collect()} == {(1, 0, 1, 1), (1, 0, 2, 1), (1, 1, 2, 0), (2, 0, 1, 1), (2, 1, 2, 1)}


@pytest.fixture(scope="module")
def crowded(spark):
    """Orders 0..59 each with the parts i and i + 1 (mod 3) and their suppliers; a part is in many orders, an order has few parts."""
    rows = [(0, 1000 + o, p, 1) for o in range(60) for p in (o % 3, (o + 1) % 3)] + [(2, 1000 + o, 100 + o % 2, 1) for o in range(60)] + [(1, p, 100 + s, 1) for p in range(3) for s in range(2)]
    return spark.createDataFrame([r[:3] for r in rows], "edge int, src long, dst long")


def brute(pattern, rows):
    by = {i: {(s, d) for e, s, d in rows if e == i} for i in range(len(pattern.edges))}
    pools = [{(s, d)[0 if a == q else 1] for i, (a, b, _) in enumerate(pattern.edges) if q in (a, b) for s, d in by[i]} for q in range(len(pattern.labels))]
    differ = [(a, b) for a, b in itertools.combinations(range(len(pattern.labels)), 2) if pattern.labels[a] == pattern.labels[b]]
    out, order = [()], range(len(pattern.labels))
    for q in order:
        out = [(*m, v) for m in out for v in pools[q] if all((m[a], v) in by[i] if b == q else (v, m[b]) in by[i] for i, (a, b, _) in enumerate(pattern.edges) if q == max(a, b)) and all(m[a] != v for a, b in differ if b == q)]
    return set(out)


def test_triangles_begin_where_fewest_edges_meet(spark, crowded):
    tri, rows = M.PATTERNS["tri"], [tuple(r) for r in crowded.collect()]
    out, want = M.match(tri, crowded), brute(tri, rows)
    deepest = max((line for line in plan(out).splitlines() if "Join Inner" in line), key=lambda line: line.index("Join"))
    assert "u0#" in deepest.split("Join Inner, ")[1]  # orders, not the parts that lie in many
    assert {tuple(r) for r in out.collect()} == want
    safe = {tuple(r) for r in M.triangle_safe(tri, crowded).collect()}
    assert safe == {(i, m[a], m[b]) for m in want for i, (a, b, _) in enumerate(tri.edges)}
    few = crowded.where("src = 1000")
    assert {tuple(r) for r in M.triangle_safe(tri, crowded, few).collect()} == {x for x in safe if x[1] == 1000}


def test_four_cycles_meet_over_a_diagonal(spark):
    cyc4 = M.PATTERNS["cyc4"]
    rows = [(0, o, o % 4) for o in range(12)] + [(0, o, (o + 1) % 4) for o in range(12)]
    rows += [(1, p, o) for _, o, p in rows] + [(2, o, 50 + o % 3) for o in range(12)] + [(3, o, 50 + o % 3) for o in range(12)]
    out = M.match(cyc4, spark.createDataFrame(rows, "edge int, src long, dst long"))
    top = min((line for line in plan(out).splitlines() if "Join Inner" in line), key=lambda line: line.index("Join"))
    assert "u1#" in top and "u3#" in top and plan(out).count("Join Inner") == 3
    assert sorted(map(tuple, out.collect())) == sorted(brute(cyc4, rows))


def test_certain_units_settle_though_sums_differ_in_their_last_bits(spark, monkeypatch):
    pop = spark.range(500).select("id", (1 + F.col("id") % 7).cast("double").alias("a"), F.lit(0.5).alias("proxy"), F.lit(True).alias("pass"), (F.col("id") % 2).cast("int").alias("stratum"))
    real, calls = F.sum, itertools.count(1)

    def wobbling(column):
        done = next(calls)
        assert done < 60, "the sums never agree to the last bit"
        return real(column) * F.lit(1 + done * 1e-14) if column is not None and not isinstance(column, str) else real(column) * F.lit(1 + done * 1e-14 if column == "_w" else 1)

    monkeypatch.setattr(E.F, "sum", wobbling)
    out = E.inclusion(pop, {0: 20, 1: 30}, F.col("a"))
    monkeypatch.undo()
    assert out.agg(F.round(F.sum("pi"), 6)).first()[0] == 50


def test_instances_are_described_in_place(spark):
    instances = spark.createDataFrame([([1, 2], 2.00004), ([2, 9], 1.0), ([3, 4], 5.0)], "instance array<long>, est_w double")
    attrs = spark.createDataFrame([(1, "order", 0.9, 0.5), (2, "part", 0.2, 0.4), (3, "part", 0.8, 0.3), (4, "part", 0.7, None)], "vid long, role string, prob double, proxy double")
    want = E.aggregate_instances(E.instances_long(instances, "x", 1.0), attrs)
    got = E.describe_instances(instances, "x", 2, attrs)
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(got) == rows(want.select(*got.columns))
    assert "Generate" not in plan(got)
    pop = E.population(got)
    made = E.role_calls(pop)
    assert "Window" not in plan(made)
    assert made.first()["calls"] == {"order": 1, "part": 3}  # 1, 2 fails; 2 fails before 9; 3 and 4


def test_equal_errors_are_placed_by_their_query(spark):
    rows = [(0, "z", 0, 0.001)] * 100 + [(0, "b", r, x) for r, x in enumerate((0.1, 0.2, 0.3))] + [(0, "a", r, x) for r, x in enumerate((0.3, 0.2, 0.1))]
    out = R.repeat_failures(spark.createDataFrame(rows, "method int, query string, run int, rel double").coalesce(1), 1)
    assert [r["query"] for r in out.orderBy("place").collect()] == ["a", "b"]


def test_errors_are_rounded_like_the_sql(spark):
    """The first is below a half by its digits and a half by its multiple, the second a half by its digits and below by its multiple."""
    values = [0.07164717649999999, 0.0663537635, 0.0, 0.25, 0.1234567895, 3.0000000005]
    got = [r["error"] for r in rounded_scaled(spark.createDataFrame([(i, x) for i, x in enumerate(values)], "i int, error double"), "error", 9).orderBy("i").collect()]
    assert got == [duckdb.execute("SELECT round(?::DOUBLE, 9)", [x]).fetchone()[0] for x in values]


def test_draws_of_one_number_are_one_draw(spark, tmp_path):
    """Orders whose draws (x, y) and (x + 1, y - 10007) have the same number."""
    con = duckdb.connect()
    orders = range(1, 13)
    parts = {o: [5 * o, 5 * o + 1, 20_000 + 3 * o, 9_993 + 3 * o] for o in orders}
    tables = {
        "customer": "SELECT 1::BIGINT AS c_custkey",
        "orders": f"SELECT unnest({list(orders)})::BIGINT AS o_orderkey, 1::BIGINT AS o_custkey, 1.0::DOUBLE AS o_totalprice",
        "part": f"SELECT unnest({sorted({p for ps in parts.values() for p in ps})})::BIGINT AS p_partkey, 1.0::DOUBLE AS p_retailprice",
        "supplier": "SELECT 1::BIGINT AS s_suppkey",
        "lineitem": "SELECT * FROM (VALUES " + ", ".join(f"({o}::BIGINT, {p}::BIGINT, 1::BIGINT)" for o, ps in parts.items() for p in ps) + ") t(l_orderkey, l_partkey, l_suppkey)",
    }
    for name, sql in tables.items():
        con.execute(f"COPY ({sql}) TO '{tmp_path}/{name}.parquet' (FORMAT parquet)")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet'")
    want = con.execute(registry.ORACLE_SQL["p10_short_circuit"]).fetchall()
    assert [tuple(r) for r in registry.QUERIES["p10_short_circuit"](spark, str(tmp_path)).collect()] == want


def shuffled(spark, run):
    """Records that the stages of ``run()`` shuffle, and its result."""
    gateway, store = spark.sparkContext._gateway, spark.sparkContext._jsc.sc().statusStore()

    def stages():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        seq = store.stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
        return {seq.apply(i).stageId(): seq.apply(i).shuffleWriteRecords() for i in range(seq.size())}

    before = max(stages(), default=-1)
    out = run()
    return sum(n for stage, n in stages().items() if stage > before), out


def test_few_walks_shuffle_few_edges(spark):
    n = 50_000
    ring = spark.range(n).select(F.col("id").alias("src"), ((F.col("id") + 1) % n).alias("dst"), F.lit(1).alias("elabel"))
    edges = checkpointed(ring.unionByName(ring.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "elabel")))
    starts = spark.range(20).select(F.col("id").alias("pattern"), (F.col("id") * 1000).alias("vid"))

    def run():
        walks = Y.sample_paths(edges, starts, 4, "s")
        return walks.collect(), Y.induced_edges(walks, Y.edges_between(walks, edges)).count()

    sent, (walks, induced) = shuffled(spark, run)
    assert len(walks) == 20 and all(len({(b - a) % n for a, b in itertools.pairwise(r["vids"])}) == 1 for r in walks) and induced == 60
    assert sent < n / 2


def test_among_loses_no_key(spark):
    rows, keys = spark.range(-100, 100_000).withColumnRenamed("id", "a"), spark.range(-50, 100_000, 7).withColumnRenamed("id", "k")
    kept = checkpointed(among(rows, ["a"], keys))
    assert kept.join(keys, F.col("a") == F.col("k")).count() == keys.count()
    assert kept.count() < 1.5 * keys.count()
    assert among(rows, ["a"], keys.where("false")).isEmpty()


def test_few_trees_stars_and_cycles_shuffle_few_edges(spark):
    n = 50_000
    ring = spark.range(n).select(F.col("id").alias("src"), ((F.col("id") + 1) % n).alias("dst"), F.lit(1).alias("elabel"))
    edges = checkpointed(ring.unionByName(ring.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "elabel")))
    starts = spark.range(20).select(F.col("id").alias("pattern"), (F.col("id") * 1000).alias("vid"))
    for sample, size, found in ((Y.sample_trees, 4, 20), (Y.sample_stars, 4, 20), (Y.sample_cycles, 4, 0)):
        sent, rows = shuffled(spark, lambda sample=sample, size=size: sample(edges, starts, size, "s").collect())
        assert len(rows) == found and all(len(set(r["vids"])) == size for r in rows)
        assert sent < n / 2


def test_equal_kinds_of_pattern_edges_are_made_once(spark, monkeypatch):
    """Repeated edges, of which two pattern edges have each kind; the wedges of both halves are one shuffle."""
    links = [(100 + o, p, 1) for o in range(12) for p in (o % 4, (o + 1) % 4)] + [(100 + o, 50 + o % 3, 2) for o in range(12)]
    edges = spark.createDataFrame(2 * [*links, *[(b, a, k) for a, b, k in links]], "src long, dst long, elabel int")
    vertices = spark.createDataFrame([(v, 1 if v >= 100 else 3 if v >= 50 else 2) for v in {x for a, b, _ in links for x in (a, b)}], "vid long, label int")
    cyc4, kept = M.PATTERNS["cyc4"], []
    monkeypatch.setattr(M, "checkpointed", lambda df: kept.append(checkpointed(df)) or kept[-1])
    out = M.match_graph(cyc4, vertices, edges)
    rows = [(0, a, b) for a, b, k in links if k == 1] + [(1, b, a) for a, b, k in links if k == 1] + [(e, a, b) for e in (2, 3) for a, b, k in links if k == 2]
    assert sum(df.count() for df in kept if df.columns == ["src", "dst"]) == len(links)
    assert not any("edge" in df.columns and "src" in df.columns for df in kept)
    assert sorted(map(tuple, out.collect())) == sorted(brute(cyc4, rows))


def test_triangles_make_no_wedges_that_nothing_closes(spark):
    """2,000 posts below three hubs that have no edge to each other, and one triangle."""
    links = [(100 + i, h, 0) for i in range(2000) for h in range(3)] + [(5000, 5001, 0), (5001, 5002, 0), (5000, 5002, 0)]
    edges = checkpointed(spark.createDataFrame([*links, *[(b, a, k) for a, b, k in links]], "src long, dst long, elabel int"))
    out = G.edge_triangles(edges)
    assert "Join LeftSemi" in plan(out)
    assert {r["third"] for r in out.collect()} == {5000, 5001, 5002} and out.count() == 6


def test_only_pairs_that_close_a_four_cycle_are_kept(spark, monkeypatch):
    """Orders with a part and a supplier of their own, and two that share both."""
    orders = [(o, 1000 + o, 2000 + o) for o in range(300)] + [(300, 1299, 2299)]
    rows = [r for o, p, s in orders for r in ((0, o, p), (1, p, o), (2, o, s), (3, o, s))]
    cyc4, kept = M.PATTERNS["cyc4"], []
    monkeypatch.setattr(M, "checkpointed", lambda df: kept.append(checkpointed(df)) or kept[-1])
    safe = M.four_cycle_safe(cyc4, spark.createDataFrame(rows, "edge int, src long, dst long"))
    assert sorted(map(tuple, safe.collect())) == sorted((e, a, b) for e, a, b in rows if {a, b} & {299, 300})
    assert sum(df.count() for df in kept if any(c.startswith("_least") for c in df.columns)) == 1


def test_induced_edges_join_one_direction(spark):
    edges = hub(spark)
    patterns = spark.createDataFrame([(1, [3, 0, 2, 1]), (2, [50, 1])], "pattern long, vids array<long>")
    out = Y.induced_edges(patterns, edges)
    assert any("src" in x and "<=" in x and "dst" in x for x in plan(out).splitlines())
    there = {(r["src"], r["dst"]): r["elabel"] for r in edges.collect()}
    want = {(p, u, v, there[a, b]) for p, vids in ((1, [3, 0, 2, 1]), (2, [50, 1])) for u, a in enumerate(vids) for v, b in enumerate(vids) if u < v and (a, b) in there}
    assert {tuple(r) for r in out.collect()} == want


def test_tree_samples_make_cells_for_drawn_parents_only(spark, monkeypatch):
    pattern, tree = M.PATTERNS["path3"], X.Tree((0, 1, 2), {1: 0, 2: 1}, {1: 0, 2: 1})
    tops, mids = range(1000), range(1000, 11_000)
    between = spark.createDataFrame([(0, m % 1000, m) for m in mids] + [(1, m, 20_000 + m % 7) for m in mids], "edge int, src long, dst long")
    candidates = spark.createDataFrame([(0, v) for v in tops] + [(1, v) for v in mids] + [(2, 20_000 + v) for v in range(7)], "q int, vid long")
    counts = X.count_trees(pattern, tree, candidates, between)
    kept = []

    def keep(df):
        out = checkpointed(df)
        kept.append(out.count())
        return out

    monkeypatch.setattr(X, "checkpointed", keep)
    trials = X.sample_trees(pattern, tree, counts, between, 20, "few").collect()
    assert len(trials) == 20 and all(t["u1"] % 1000 == t["u0"] and t["u2"] == 20_000 + t["u1"] % 7 for t in trials)
    assert sum(kept) - 1000 < 1000  # the roots' sums, and rows below the 20 draws (before: cells of all 20,000 candidate edges)
    sampler, made = X.TreeSampler(pattern, tree, counts, between), []
    first = sampler.draw(20, "few").collect()
    monkeypatch.setattr(X, "intervals", lambda *a, **k: made.append(1))  # a second round of the same parents makes no cells
    assert sorted(sampler.draw(20, "few").collect()) == sorted(first) == sorted(trials) and not made


def trade_tables(folder, orders: int, parts: int) -> str:
    """Orders of ``parts`` parts each, out of 40."""
    con = duckdb.connect()
    tables = {
        "customer": "SELECT unnest(range(5))::BIGINT AS c_custkey",
        "orders": f"SELECT o::BIGINT AS o_orderkey, (o % 5)::BIGINT AS o_custkey, 1.0::DOUBLE AS o_totalprice FROM range({orders}) t(o)",
        "part": "SELECT unnest(range(40))::BIGINT AS p_partkey, 1.0::DOUBLE AS p_retailprice",
        "supplier": "SELECT unnest(range(7))::BIGINT AS s_suppkey",
        "lineitem": f"SELECT o::BIGINT AS l_orderkey, ((o * 3 + k * (1 + o % 3)) % 40)::BIGINT AS l_partkey, ((o + k * k) % 7)::BIGINT AS l_suppkey FROM range({orders}) t(o), range({parts}) s(k)",
    }
    for name, sql in tables.items():
        con.execute(f"COPY ({sql}) TO '{folder}/{name}.parquet' (FORMAT parquet)")
    return str(folder)


def test_checks_of_embeddings_are_shuffled_once(spark, tmp_path):
    folder = trade_tables(tmp_path, 400, 8)
    records, rows = shuffled(spark, lambda: registry.QUERIES["p10_short_circuit"](spark, folder).collect())
    con = duckdb.connect()
    for name in ("customer", "orders", "part", "supplier", "lineitem"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    assert [tuple(r) for r in rows] == con.execute(registry.ORACLE_SQL["p10_short_circuit"]).fetchall()
    embeddings = con.execute(f"{registry.ORACLE_SQL['m11_match_star4'].replace('SELECT * FROM m', 'SELECT count(*) FROM m')}").fetchone()[0]
    assert records < 3 * embeddings


def test_totals_of_checks_are_those_of_short_circuit(spark):
    """Draws of several rows, vertices at both places, a vertex 0, and a draw that passes at one place only."""
    rows = [(k // 3, (5 * k) % 11, (k * k) % 7, k % 4 != 0, k % 5 != 0) for k in range(120)]
    wide = spark.createDataFrame(rows, "draw long, a long, b long, p boolean, q boolean")
    long = spark.createDataFrame([(d, pos, "part", v, ok) for d, a, b, p, q in rows for pos, v, ok in ((0, a, p), (1, b, q))], "draw long, pos int, role string, vid long, pass boolean")
    drawn, made = P.short_circuit(wide.select("draw").distinct(), long)
    got = P.short_circuit_totals(wide, [("part", F.col("a"), F.col("p")), ("part", F.col("b"), F.col("q"))]).collect()
    assert [tuple(r) for r in got] == [("part", made.where("charged").select("vid").distinct().count(), made.count(), drawn.where("pass").count())]
    assert [tuple(r) for r in P.short_circuit_totals(wide.limit(0), [("part", F.col("a"), F.col("p"))]).collect()] == [("part", 0, 0, 0)]


def test_refinement_shuffles_few_rows_an_edge(spark, tmp_path):
    folder = trade_tables(tmp_path, 400, 8)
    for name, column in (("m9_refine", "vid"), ("m10_candidate_space", "src")):
        records, rows = shuffled(spark, lambda name=name: registry.QUERIES[name](spark, folder).collect())
        con = duckdb.connect()
        for table in ("customer", "orders", "part", "supplier", "lineitem"):
            con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
        assert sorted(tuple(r) for r in rows) == sorted(con.execute(registry.ORACLE_SQL[name]).fetchall())
        wedges = 400 * 8 * 7  # of an order's parts and suppliers
        assert records < 1.5 * wedges, (name, records)
