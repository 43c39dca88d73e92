"""Queries: synthetic predicates, pattern workloads, sources and sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from motifcast.functions.frames import checkpointed, shared_folder
from motifcast.functions.ordered import numbered
from motifcast.functions.random import prn, prn_sql
from motifcast.operators import graph as G
from motifcast.operators import synth as W
from motifcast.operators import workload as Y
from motifcast.plans.exact import T
from motifcast.sources import files as S
from motifcast.sources.fixtures import table, trade_links, trade_vertices

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


# ---------------------------------------------------------------- synthetic predicates


@query("w1_min_max", "SELECT l_orderkey, l_linenumber, l_partkey, round((l_extendedprice - min(l_extendedprice) OVER ()) / (max(l_extendedprice) OVER () - min(l_extendedprice) OVER ()), 9) AS scaled FROM lineitem")
def _(spark, d):
    return W.min_max(table(spark, d, "lineitem"), "l_extendedprice", "scaled").select("l_orderkey", "l_linenumber", "l_partkey", F.round("scaled", 9).alias("scaled"))


@query("w2_positive_rate", f"WITH x AS (SELECT event_id, {prn_sql('event_id', 'w2')} / 4294967296.0 AS p FROM events), q AS (SELECT greatest(least(quantile_cont(p, 0.8), 1 - 1e-6), 1e-6) AS q FROM x) SELECT event_id, round(pow(p, ln(0.5) / ln(q)), 6) AS p2 FROM x, q")
def _(spark, d):
    rows = table(spark, d, "events").select("event_id", prn(F.col("event_id"), "w2").alias("p"))
    return W.positive_rate(rows, "p", 0.2, "p2").select("event_id", F.round("p2", 6).alias("p2"))


def probs(spark, d):
    return table(spark, d, "events").select("event_id", prn(F.col("event_id"), "w3").alias("p"))


@query("w3_noisy_proxy")
def _(spark, d):
    return W.f1(W.noisy_proxy(probs(spark, d), "event_id", "p", 0.7, 0.8, "proxy"), "proxy", "p")


@query("w4_draw")
def _(spark, d):
    rows = table(spark, d, "events").select("event_id")
    shapes = ("uniform", "normal", "skew", "beta", "two_peak")
    for s in shapes:
        rows = W.draw(rows, "event_id", s, s, "w4")
    return rows.agg(*[F.round(F.avg(s), 4).alias(s) for s in shapes])


@query("w4_mixture", f"WITH r AS (SELECT event_id, row_number() OVER (ORDER BY ('0x' || substr(md5(event_id || ':mix'), 1, 15))::BIGINT, event_id) AS r, {prn_sql('event_id', 'mix-value')} / 4294967296.0 AS v FROM events) SELECT event_id, CASE WHEN r <= (SELECT round(0.3 * count(*)) FROM r) THEN v / 2 ELSE 1 - v / 2 END AS p FROM r")
def _(spark, d):
    return W.mixture(table(spark, d, "events").select("event_id"), "event_id", 0.3, "p", "mix")


@query("w5_distances", """WITH b AS (SELECT round(l_quantity) AS v FROM lineitem WHERE l_linenumber = 1), c AS (SELECT round(l_quantity * (1 - l_discount)) AS v FROM lineitem WHERE l_linenumber = 2),
x AS (SELECT v, sum(p) AS p FROM (SELECT v, 1.0 / (SELECT count(*) FROM b) AS p FROM b UNION ALL SELECT v, -1.0 / (SELECT count(*) FROM c) FROM c) GROUP BY v), g AS (SELECT v, sum(p::DOUBLE) OVER (ORDER BY v) AS gap, lead(v) OVER (ORDER BY v) AS nxt FROM x)
SELECT round(max(abs(gap)), 6) AS ks, round(sum(abs(gap) * (nxt - v)), 5) AS wasserstein FROM g""")
def _(spark, d):
    line = table(spark, d, "lineitem")
    out = W.distances(line.where("l_linenumber = 1").select(F.round("l_quantity").alias("v")), line.where("l_linenumber = 2").select(F.round(F.col("l_quantity") * (1 - F.col("l_discount"))).alias("v")), "v")
    return out.select(F.round("ks", 6).alias("ks"), F.round("wasserstein", 5).alias("wasserstein"))


@query("w6_f1", f"WITH x AS (SELECT {prn_sql('event_id', 'w3')} > 2147483648 AS t, {prn_sql('event_id', 'w6')} > 2147483648 AS p FROM events) SELECT round(2 * sum((t AND p)::INT) / (sum(p::INT) + sum(t::INT)), 9) AS f1, round(avg(t::INT), 9) AS rate FROM x")
def _(spark, d):
    return W.f1(probs(spark, d).withColumn("q", prn(F.col("event_id"), "w6")), "q", "p").select(F.round("f1", 9).alias("f1"), F.round("rate", 9).alias("rate"))


# ---------------------------------------------------------------- workloads


def base(spark, d):
    """Edges, which may repeat, and vertices: a repeated edge changes no draw, and none is to be shuffled only to find that out."""
    return G.both_directions(trade_links(spark, d, repeated=True)), trade_vertices(spark, d)


def starts(spark, d):
    """A walker per customer."""
    return table(spark, d, "customer").select(F.col("c_custkey").alias("pattern"), (F.col("c_custkey") * 8).alias("vid"))


def drawn(spark, d):
    """Patterns of four vertices: a walk from each customer, with its induced edges and its vertices."""
    edges, vertices = base(spark, d)
    patterns = checkpointed(Y.sample_paths(edges, starts(spark, d), 4, "y"))
    induced = checkpointed(Y.induced_edges(patterns, Y.edges_between(patterns, edges)))
    return patterns, induced, checkpointed(Y.pattern_vertices(patterns, vertices, induced))


STEP = "w{0} AS (SELECT pattern, {1}, arg_min(dst, {2}) AS v{0} FROM w{3} JOIN n ON n.src = v{3} WHERE {4} GROUP BY ALL)"


def _steps(size: int) -> str:
    out = ["n AS (SELECT DISTINCT src, dst FROM e)", "w0 AS (SELECT c_custkey AS pattern, c_custkey * 8 AS v0 FROM customer)"]
    for k in range(1, size):
        done = ", ".join(f"v{i}" for i in range(k))
        salt = f"('0x' || substr(md5(CAST(pattern AS VARCHAR) || '-' || CAST(dst AS VARCHAR) || ':y-{k}'), 1, 8))::BIGINT"
        out.append(STEP.format(k, done, f"({salt}, dst)", k - 1, " AND ".join(f"dst <> v{i}" for i in range(k))))
    return ", ".join(out)


WALK = f"{T}, {_steps(4)}"
LONG = f"{WALK}, l AS (SELECT pattern, 0 AS q, v0 AS vid FROM w3 UNION ALL SELECT pattern, 1, v1 FROM w3 UNION ALL SELECT pattern, 2, v2 FROM w3 UNION ALL SELECT pattern, 3, v3 FROM w3), ind AS (SELECT DISTINCT x.pattern, x.q AS u, y.q AS v, e.elabel FROM l x JOIN e ON e.src = x.vid JOIN l y ON y.pattern = x.pattern AND y.vid = e.dst AND y.q > x.q), pv AS (SELECT pattern, q, label, (SELECT count(*) FROM ind i WHERE i.pattern = l.pattern AND q IN (i.u, i.v)) AS degree FROM l JOIN v USING (vid))"


@query("y1_sample_paths", WALK + " SELECT pattern, v0::VARCHAR || ',' || v1 || ',' || v2 || ',' || v3 AS vids FROM w3")
def _(spark, d):
    edges, _ = base(spark, d)
    return Y.sample_paths(edges, starts(spark, d), 4, "y").select("pattern", F.array_join(F.transform("vids", lambda x: x.cast("string")), ",").alias("vids"))


@query("y2_sample_stars")
def _(spark, d):
    edges, _ = base(spark, d)
    return Y.sample_stars(edges, starts(spark, d), 4, "stars")


@query("y3_sample_trees")
def _(spark, d):
    edges, _ = base(spark, d)
    return Y.sample_trees(edges, starts(spark, d), 5, "trees")


@query("y4_sample_cycles")
def _(spark, d):
    edges, _ = base(spark, d)
    return Y.sample_cycles(edges, starts(spark, d), 4, "y")


@query("y5_induced_edges", LONG + " SELECT pattern, u, v, elabel FROM ind")
def _(spark, d):
    return drawn(spark, d)[1]


@query("y6_accept_by_label", LONG + f", c AS (SELECT pattern, sum((label = 2)::INT)::BIGINT AS n FROM pv GROUP BY pattern) SELECT pattern, n FROM c WHERE n BETWEEN 1 AND 2 AND {prn_sql('pattern', 'accept')} / 4294967296.0 < pow(0.5, n - 1)")
def _(spark, d):
    return Y.accept_by_label(drawn(spark, d)[2], 2, 2, 0.5, "accept")


CANON = LONG + """, vt AS (SELECT pattern, count(*) AS n, string_agg('v ' || q || ' ' || label || ' ' || degree, chr(10) ORDER BY q) AS s FROM pv GROUP BY pattern),
et AS (SELECT pattern, count(*) AS n, string_agg('e ' || u || ' ' || v, chr(10) ORDER BY u, v) AS s FROM (SELECT pattern, u, v FROM ind) GROUP BY pattern),
cn AS (SELECT vt.pattern, md5('t ' || vt.n || ' ' || et.n || chr(10) || vt.s || chr(10) || et.s) AS hash FROM vt JOIN et USING (pattern))"""


@query("y7_canonical", CANON + " SELECT hash, min(pattern) AS pattern FROM cn GROUP BY hash")
def _(spark, d):
    _, induced, vertices = drawn(spark, d)
    return Y.drop_duplicate_patterns(Y.canonical(vertices, induced))


@query("y8_classify", LONG + """, s AS (SELECT pattern, count(*) AS n, sum(degree) / 2 AS m, max(degree) AS top, sum((degree = 2)::INT) AS twos FROM pv GROUP BY pattern)
SELECT pattern, CASE WHEN m = n - 1 AND top <= 2 THEN 'path' WHEN m = n - 1 AND top = n - 1 THEN 'star' WHEN m = n - 1 THEN 'tree' WHEN m = n AND twos = n THEN 'cycle' ELSE 'dense' END AS kind FROM s""")
def _(spark, d):
    _, induced, vertices = drawn(spark, d)
    return Y.classify(vertices, induced)


@query("y9_semantic_check", LONG + """, o AS (SELECT i.pattern, count(*) AS odd FROM ind i JOIN pv a ON a.pattern = i.pattern AND a.q = i.u JOIN pv b ON b.pattern = i.pattern AND b.q = i.v WHERE (least(a.label, b.label), greatest(a.label, b.label)) NOT IN ((0, 1), (1, 2)) GROUP BY i.pattern),
centres AS (SELECT pattern, sum((label = 1)::INT)::BIGINT AS c FROM pv GROUP BY pattern),
r AS (SELECT pattern, CASE WHEN c <> 1 THEN c || ' centres' WHEN odd > 0 THEN odd || ' pairs of labels not allowed' ELSE '' END AS reason FROM centres LEFT JOIN o USING (pattern)) SELECT pattern, reason = '' AS ok, reason FROM r""")
def _(spark, d):
    _, induced, vertices = drawn(spark, d)
    return Y.semantic_check(vertices, induced, 1, [(0, 1), (1, 2)])


@query("y10_format_check", LONG + " SELECT pattern, CASE WHEN sum((label = 3)::INT) > 0 THEN 'labels' ELSE '' END AS errors FROM pv GROUP BY pattern")
def _(spark, d):
    _, induced, vertices = drawn(spark, d)
    return Y.format_check(vertices, induced, [0, 1, 2])


@query("y11_label_counts", LONG + ", c AS (SELECT pattern, label, count(*) AS per_pattern FROM pv GROUP BY ALL) SELECT label, per_pattern, count(*) AS patterns FROM c GROUP BY ALL")
def _(spark, d):
    return Y.label_counts(drawn(spark, d)[2])


@query("y12_choose_core_labels")
def _(spark, d):
    return Y.choose_core_labels(drawn(spark, d)[2], 1, {0: 1.0, 2: 2.0, 3: 1.0}, "core")


@query("y13_core_config", LONG + " SELECT pattern, label, string_agg(q::VARCHAR, ',' ORDER BY q) AS qs FROM pv WHERE label = 1 GROUP BY ALL")
def _(spark, d):
    vertices = drawn(spark, d)[2]
    chosen = vertices.select("pattern").distinct().select("pattern", F.lit(1).alias("required"), F.lit(None).cast("int").alias("other"))
    return Y.core_config(vertices, chosen).select("pattern", "label", F.array_join(F.transform("qs", lambda x: x.cast("string")), ",").alias("qs"))


@query("y14_with_label", LONG + " SELECT pattern, count(*) AS answer FROM pv WHERE pattern IN (SELECT pattern FROM pv WHERE label = 3) GROUP BY pattern")
def _(spark, d):
    """Patterns with a supplier, and their answers (here their numbers of vertices)."""
    vertices = checkpointed(drawn(spark, d)[2])
    return Y.answers_of(vertices.groupBy("pattern").agg(F.count(F.lit(1)).alias("answer")), Y.with_label(vertices, 3))


@query("y15_merge_workloads", CANON + ", hs AS (SELECT DISTINCT hash, CASE WHEN hash[-1] < '8' THEN 'a' ELSE 'b' END AS prefix FROM cn), o AS (SELECT hash, prefix, 2 * row_number() OVER (PARTITION BY prefix ORDER BY hash) AS i FROM hs WHERE hash < '8'), f AS (SELECT hash, prefix, row_number() OVER (PARTITION BY prefix ORDER BY hash) AS r FROM hs WHERE hash >= '8') SELECT prefix || '_' || i AS name, hash FROM o UNION ALL SELECT f.prefix || '_' || (coalesce(t, -1) + r), hash FROM f LEFT JOIN (SELECT prefix, max(i) AS t FROM o GROUP BY prefix) m ON m.prefix = f.prefix")
def _(spark, d):
    """About half of the drawn patterns are an old set with gaps in its numbers; all of them come as new ones."""
    _, induced, vertices = drawn(spark, d)
    new = checkpointed(Y.drop_duplicate_patterns(Y.canonical(vertices, induced)).select("hash"))
    prefix = F.when(F.substring("hash", -1, 1) < "8", "a").otherwise("b")
    old = numbered(new.where("hash < '8'").withColumn("prefix", prefix), ["prefix"], ["hash"])
    return Y.merge_workloads(old.select(F.concat_ws("_", "prefix", (2 * F.col("rank")).cast("string")).alias("name"), "hash"), new, prefix)


# ---------------------------------------------------------------- sources and sinks


def folder(spark) -> str:
    """A new folder that driver and executors share."""
    return f"{shared_folder(spark)}/files-{uuid.uuid4()}"


@query("s1_s2_graph_round_trip", T + " SELECT src, dst, elabel FROM e")
def _(spark, d):
    links, path = trade_links(spark, d), folder(spark)
    edges = G.both_directions(links)
    vertices = trade_vertices(spark, d).where("label <> 9").join(G.degrees(edges), "vid", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    S.write_graph(vertices, links, path)
    return S.read_graph(spark, path)[1]


@query("s3_read_nodes", "SELECT c_custkey::VARCHAR AS id, c_name AS name, c_mktsegment AS label FROM customer")
def _(spark, d):
    path = folder(spark)
    table(spark, d, "customer").select(F.col("c_custkey").alias("id:ID"), F.col("c_name").alias("name:string"), F.col("c_mktsegment").alias(":LABEL")).write.csv(path, header=True)
    return S.read_nodes(spark, path)


@query("s4_ndjson_to_table", "SELECT event_id, event_type || ' x' AS kind FROM events")
def _(spark, d):
    path = folder(spark)
    table(spark, d, "events").select(F.to_json(F.struct("event_id", F.concat("event_type", F.lit(" x")).alias("kind"))).alias("value")).write.text(path)
    return S.ndjson_to_table(spark, path, "event_id bigint, kind string")


@query("s5_estimate_blocks", "SELECT o_custkey::VARCHAR AS query, o_orderkey AS vid, round(o_totalprice, 2) AS est, (SELECT count(*) FROM orders x WHERE x.o_custkey = o.o_custkey)::DOUBLE AS all_est FROM orders o")
def _(spark, d):
    path = folder(spark)
    lines = F.array_join(F.array_sort(F.collect_list(F.concat_ws(" ", F.col("o_orderkey").cast("string"), F.format_string("%.2f", F.round("o_totalprice", 2))))), "\n")
    o = table(spark, d, "orders").groupBy("o_custkey").agg(lines.alias("l"), F.count(F.lit(1)).alias("n"))
    o.select(F.concat(F.lit("Query: "), F.col("o_custkey").cast("string"), F.lit("\nAll Est: "), F.col("n").cast("string"), F.lit("\n"), "l", F.lit("\n-----")).alias("value")).write.text(path)
    return S.read_estimate_blocks(spark, path).select("query", "vid", "est", "all_est")


@query("s6_core_config", "SELECT p_partkey::VARCHAR AS pattern, p_size AS label, p_partkey % 5 AS q FROM part UNION ALL SELECT p_partkey::VARCHAR, p_size, p_partkey % 5 + 1 FROM part")
def _(spark, d):
    q = (F.col("p_partkey") % 5).cast("int")
    config = F.create_map(F.col("p_partkey").cast("string"), F.create_map(F.col("p_size").cast("string"), F.array(q, q + 1)))
    path = folder(spark)
    table(spark, d, "part").select(F.to_json(config).alias("value")).write.text(path)
    return S.read_core_config(spark, path).withColumn("q", F.col("q").cast("long"))


@query("s6_core_labels", "SELECT p_partkey::VARCHAR || '.graph' AS pattern, p_size AS label FROM part WHERE p_partkey % 10 <> 0 UNION ALL SELECT p_partkey::VARCHAR || '.graph', 99 FROM part WHERE p_partkey % 10 <> 0")
def _(spark, d):
    line = F.concat(F.when(F.col("p_partkey") % 10 == 0, "# ").otherwise(""), F.col("p_partkey").cast("string"), F.lit(".graph "), F.col("p_size").cast("string"), F.lit(" 99"))
    path = folder(spark)
    table(spark, d, "part").select(line.alias("value")).write.text(path)
    return S.read_core_labels(spark, path)


@query("s7_answers", "SELECT 'q' || p_partkey AS pattern, p_size + 0.5 AS elapsed_ms, p_partkey AS cardinality FROM part")
def _(spark, d):
    line = F.concat(F.lit("q"), F.col("p_partkey").cast("string"), F.lit(" "), F.col("p_size").cast("string"), F.lit(".5ms "), F.col("p_partkey").cast("string"))
    path = folder(spark)
    table(spark, d, "part").select(line.alias("value")).write.text(path)
    return S.read_answers(spark, path)


ORACLE_SQL["s7_answers"] = "SELECT 'q' || p_partkey AS pattern, (p_size + 0.5)::DOUBLE AS elapsed_ms, p_partkey AS cardinality FROM part"


@query("s9_split_by_pattern", "SELECT event_id, event_type AS pattern FROM events")
def _(spark, d):
    path = folder(spark)
    S.split_by_pattern(table(spark, d, "events").select("event_id", F.col("event_type").alias("pattern")), path)
    return spark.read.parquet(path).select("event_id", F.col("pattern").cast("string").alias("pattern"))


@query("s10_results", "SELECT l_partkey AS query, l_linenumber, l_orderkey, round(CASE WHEN p_size < 10 THEN (l_quantity > 0)::INT::DOUBLE ELSE abs(l_quantity - p_size) / p_size END, 9) AS error FROM lineitem JOIN part ON p_partkey = l_partkey")
def _(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_partkey").alias("query"), "l_linenumber", "l_orderkey", F.col("l_quantity").alias("t_hat"))
    known = table(spark, d, "part").select(F.col("p_partkey").alias("query"), F.when(F.col("p_size") < 10, 0).otherwise(F.col("p_size")).cast("double").alias("t_true"))
    path = folder(spark)
    S.append_results(S.with_results(rows, known), path)
    return spark.read.parquet(path).select("query", "l_linenumber", "l_orderkey", F.round("error", 9).alias("error"))


@query("s10_summary", "SELECT l_linenumber AS method, count(DISTINCT l_partkey) AS queries, round(avg(abs(l_quantity - p_size) / p_size), 6) AS mean_error, round(avg(l_orderkey), 4) AS mean_cost FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY l_linenumber")
def _(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_partkey").alias("query"), F.col("l_linenumber").alias("method"), F.col("l_orderkey").alias("oracle_cost"), F.col("l_quantity").alias("t_hat"))
    known = table(spark, d, "part").select(F.col("p_partkey").alias("query"), F.col("p_size").cast("double").alias("t_true"))
    return S.summarize_results(S.with_results(rows, known), ["method"]).withColumns({"mean_error": F.round("mean_error", 6), "mean_cost": F.round("mean_cost", 4)})


@query("s11_still_to_do", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def _(spark, d):
    return S.still_to_do(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels"), ["doc_id"])


@query("s12_load_runs", "SELECT o_orderkey::VARCHAR AS query, o_orderkey % 3 AS run, o_custkey::VARCHAR AS \"T_hat\" FROM orders")
def _(spark, d):
    path = folder(spark)
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("query"), F.col("o_custkey").alias("T_hat_mean"), (F.col("o_orderkey") % 3).alias("file"))
    rows.write.partitionBy("file").csv(path, header=True)
    read = S.load_runs(spark, path)
    return read.select("query", F.col("file").cast("long").alias("run"), "T_hat")
