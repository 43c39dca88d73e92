"""Queries: error and cost reports over a result table derived from ``lineitem``."""

from __future__ import annotations

from pyspark.sql import functions as F

from motifcast.operators import report as R
from motifcast.sources.fixtures import table

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def results(spark, d):
    """query, method, run, t_true, t_hat, rel."""
    t = F.round("l_extendedprice")
    df = table(spark, d, "lineitem").select((F.col("l_partkey") % 20).alias("query"), F.col("l_linenumber").alias("method"), (F.col("l_orderkey") % 5).alias("run"), t.alias("t_true"), (t * (1 + F.col("l_discount") - F.col("l_tax"))).alias("t_hat"))
    return df.withColumn("rel", R.relative_error(F.col("t_hat"), F.col("t_true")))


RES = "WITH r0 AS (SELECT l_partkey % 20 AS query, l_linenumber AS method, l_orderkey % 5 AS run, round(l_extendedprice) AS t_true, round(l_extendedprice) * (1 + l_discount - l_tax) AS t_hat FROM lineitem), r AS (SELECT *, abs(t_hat - t_true) / (t_true + 1e-9) AS rel FROM r0)"
BOUNDS = "b AS (SELECT method, quantile_cont(rel, 0.25) AS q1, quantile_cont(rel, 0.75) AS q3, quantile_cont(rel, 0.9) AS q90, quantile_cont(rel, 0.95) AS q95 FROM r GROUP BY method), bb AS (SELECT *, q3 - q1 AS iqr, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM b)"


def rounded(df, *columns, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in columns})


def rounded_scaled(df, column, digits):
    """Rounds a column of doubles from 0 on as the SQL does: the multiple by a power of ten to a whole number, halves up. ``F.round``
    goes by the decimal digits, which differs where the multiple is a half and the digits are not, or the other way round."""
    scaled = F.col(column) * float(10**digits)
    whole = F.rint(scaled)
    return df.withColumn(column, F.when(scaled - whole == 0.5, whole + 1).otherwise(whole) / float(10**digits))


@query("q1_error_columns", RES + " SELECT method, count(*) AS n, round(avg(rel), 6) AS rel, round(avg(2 * abs(t_hat - t_true) / (t_hat + t_true + 1e-9)), 6) AS sym, round(avg((t_hat - t_true) / (t_true + 1e-9)), 6) AS signed, round(avg(CASE WHEN t_hat >= t_true THEN greatest(t_hat, 1) / greatest(t_true, 1) ELSE -greatest(t_true, 1) / greatest(t_hat, 1) END), 6) AS ratio, round(avg(log2(greatest(t_hat, 1) / greatest(t_true, 1))), 6) AS log2_ratio FROM r GROUP BY method")
def _(spark, d):
    e = R.error_columns(results(spark, d))
    return rounded(e.groupBy("method").agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(c) for c in ("rel", "sym", "signed", "ratio", "log2_ratio")]), "rel", "sym", "signed", "ratio", "log2_ratio")


@query("q2_ratio_error", RES + ", x AS (SELECT method, log10(greatest(t_hat, 1) / greatest(t_true, 1)) AS l FROM r) SELECT method, round(sum(abs(l)), 4) AS total, round(avg(abs(l)), 6) AS mean, round(stddev_pop(abs(l)), 6) AS std FROM x GROUP BY method")
def _(spark, d):
    return rounded(rounded(R.spread(R.ratio_error(results(spark, d)), "sym_log_ratio", ["method"]), "mean", "std"), "total", digits=4)


@query("q3_method_quantiles", RES + " SELECT method, round(avg(rel), 6) AS mean, round(quantile_cont(rel, 0.5), 6) AS median, round(quantile_cont(rel, 0.9), 6) AS p90, round(quantile_cont(rel, 0.95), 6) AS p95, round(max(rel), 6) AS max FROM r GROUP BY method")
def _(spark, d):
    return rounded(R.method_quantiles(results(spark, d), "rel", ["method"]), "mean", "median", "p90", "p95", "max")


@query("q4_cdf_points", RES + ", c AS (SELECT method, round(rel, 2) AS x, count(*) AS n FROM r GROUP BY ALL) SELECT method, x, round(sum(n) OVER (PARTITION BY method ORDER BY x) / sum(n) OVER (PARTITION BY method), 6) AS share FROM c")
def _(spark, d):
    return rounded(R.cdf_points(results(spark, d).withColumn("x", F.round("rel", 2)), "x", "method"), "share")


@query("q5_mean_error_curve", RES + " SELECT CASE method WHEN 1 THEN 'ours' ELSE method::VARCHAR END AS method, run AS frac, round(avg(abs(t_hat - (query * 1000)) / (query * 1000 + 1e-9)), 6) AS error, count(*) AS n FROM r WHERE query <> 0 GROUP BY ALL")
def _(spark, d):
    rows = results(spark, d)
    truth = rows.select("query").distinct().withColumn("truth", F.col("query") * 1000)
    return rounded(R.mean_error_curve(rows.withColumnRenamed("run", "frac"), truth, {"1": "ours"}), "error")


@query("q6_common_queries", "WITH r AS (SELECT l_partkey AS query, l_linenumber AS method FROM lineitem) SELECT query, count(*) AS n FROM r WHERE query IN (SELECT query FROM r GROUP BY query HAVING count(DISTINCT method) = (SELECT count(DISTINCT method) FROM r)) GROUP BY query")
def _(spark, d):
    return R.common_queries(table(spark, d, "lineitem").select(F.col("l_partkey").alias("query"), F.col("l_linenumber").alias("method"))).groupBy("query").agg(F.count(F.lit(1)).alias("n"))


@query("q7_ablation", RES + " SELECT run AS dataset, method, CASE method WHEN 3 THEN 1 WHEN 1 THEN 2 ELSE 3 END AS place, round(100 * avg(rel), 5) AS mean_pct, round(100 * quantile_cont(rel, 0.5), 5) AS median_pct FROM r WHERE method IN (1, 2, 3) GROUP BY ALL")
def _(spark, d):
    out = R.ablation(results(spark, d).withColumnRenamed("run", "dataset"), ["3", "1", "2"])
    return rounded(out.withColumn("place", F.col("place").cast("int")), "mean_pct", "median_pct", digits=5)


@query("q8_outliers", f"{RES}, {BOUNDS} SELECT method, count(*) AS n, sum((rel < lo OR rel > hi)::INT)::BIGINT AS outside, round(sum((rel < lo OR rel > hi)::INT) / count(*), 6) AS share, round(any_value(iqr), 6) AS iqr, round(any_value(q90), 6) AS q90, round(any_value(q95), 6) AS q95 FROM r JOIN bb USING (method) GROUP BY method")
def _(spark, d):
    return rounded(R.outliers(results(spark, d), "rel", ["method"]), "share", "iqr", "q90", "q95")


@query("q9_robust_mean", f"{RES}, {BOUNDS} SELECT method, round(avg(rel), 6) AS mean FROM r JOIN bb USING (method) WHERE rel BETWEEN lo AND hi GROUP BY method")
def _(spark, d):
    return rounded(R.robust_mean(results(spark, d), "rel", ["method"]), "mean")


ONE = ", o AS (SELECT query, method, run, round(avg(rel), 9) AS rel FROM r GROUP BY ALL)"


def per_run(spark, d):
    return results(spark, d).groupBy("query", "method", "run").agg(F.round(F.avg("rel"), 9).alias("rel"))


@query("q10_win_tie_loss", RES + ONE + " SELECT m.method, sum((m.rel - b.rel < -1e-12)::INT)::BIGINT AS win, sum((abs(m.rel - b.rel) <= 1e-12)::INT)::BIGINT AS tie, sum((m.rel - b.rel > 1e-12)::INT)::BIGINT AS loss, round(avg((b.rel - m.rel) / nullif(b.rel, 0)), 5) AS improvement FROM o m JOIN o b USING (run, query) WHERE b.method = 1 AND m.method <> 1 GROUP BY m.method")
def _(spark, d):
    return rounded(R.win_tie_loss(per_run(spark, d), 1), "improvement", digits=5)


FAIL = f"{RES}, x AS (SELECT l_partkey AS query, l_linenumber AS method, l_orderkey % 5 AS run, l_extendedprice / 1000 * l_discount * l_discount * l_discount AS rel FROM lineitem), {BOUNDS.replace('FROM r ', 'FROM x ')}"


def skewed(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_partkey").alias("query"), F.col("l_linenumber").alias("method"), (F.col("l_orderkey") % 5).alias("run"), (F.col("l_extendedprice") / 1000 * F.col("l_discount") * F.col("l_discount") * F.col("l_discount")).alias("rel"))


@query("q11_repeat_failures", FAIL + ", p AS (SELECT method, query, count(DISTINCT run) AS failing, avg(abs(rel)) AS error FROM x JOIN bb USING (method) WHERE rel > hi GROUP BY ALL HAVING count(DISTINCT run) > 1) SELECT method, query, failing, round(error, 9) AS error, row_number() OVER (PARTITION BY method ORDER BY error DESC, query)::INT AS place FROM p")
def _(spark, d):
    return rounded_scaled(R.repeat_failures(skewed(spark, d), 1), "error", 9)


@query("q12_joint_failures", RES + ", p AS (SELECT query, method, avg((rel > 0.02)::INT) AS rate, avg(rel) AS error FROM r GROUP BY ALL HAVING avg((rel > 0.02)::INT) >= 0.4) SELECT query, count(*) AS methods, round(avg(error), 6) AS error FROM p GROUP BY query HAVING count(*) = (SELECT count(DISTINCT method) FROM r)")
def _(spark, d):
    return rounded(R.joint_failures(results(spark, d), 0.02, 0.4), "error")


@query("q13_zero_estimates", "SELECT DISTINCT l_linenumber AS method, l_partkey AS query, CASE WHEN l_tax = 0 THEN 'correct' ELSE 'fatal' END AS verdict FROM lineitem WHERE l_discount = 0")
def _(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_linenumber").alias("method"), F.col("l_partkey").alias("query"), F.col("l_tax").alias("t_true"), F.col("l_discount").alias("t_hat"))
    return R.zero_estimates(rows)


@query("q14_worst", RES + " SELECT query, method, run, t_true, round(abs(t_hat - t_true), 4) AS abs_error FROM r ORDER BY abs(t_hat - t_true) DESC, t_true, query, method, run LIMIT 25")
def _(spark, d):
    return R.worst(results(spark, d), 25, ["t_true", "query", "method", "run"]).select("query", "method", "run", "t_true", F.round("abs_error", 4).alias("abs_error"))


@query("q15_median_signed", RES + ", x AS (SELECT CASE WHEN query % 2 = 0 THEN 'path' ELSE 'cycle' END AS kind, method, (t_hat - t_true) / (t_true + 1e-9) AS signed FROM r) SELECT kind, round(quantile_cont(signed, 0.5) FILTER (WHERE method = 1), 6) AS m1, round(quantile_cont(signed, 0.5) FILTER (WHERE method = 2), 6) AS m2 FROM x GROUP BY kind")
def _(spark, d):
    named = R.error_columns(results(spark, d)).withColumn("query", F.concat(F.when(F.col("query") % 2 == 0, "path").otherwise("cycle"), F.lit("_"), F.col("query").cast("string")))
    return rounded(R.median_signed(named, [1, 2]).toDF("kind", "m1", "m2"), "m1", "m2")


CALLS = "c AS (SELECT l_partkey % 20 AS query, l_linenumber AS method, sum(l_quantity)::BIGINT AS n1, count(*) AS n2, sum(l_quantity)::BIGINT * 10 AS x1, count(*) * 10 AS x2 FROM lineitem GROUP BY ALL)"


def calls(spark, d):
    total = F.sum("l_quantity").cast("long")
    return table(spark, d, "lineitem").groupBy((F.col("l_partkey") % 20).alias("query"), F.col("l_linenumber").alias("method")).agg(total.alias("n1"), F.count(F.lit(1)).alias("n2"), (total * 10).alias("x1"), (F.count(F.lit(1)) * 10).alias("x2"))


@query("q16_speed_up", f"WITH {CALLS}, t AS (SELECT query, method, n1 / 43.2 + n2 / 96.0 + x1 / 544.0 + x2 / 992.0 AS s FROM c) SELECT t.method, round(avg(b.s / t.s), 5) AS mean, round(max(b.s / t.s), 5) AS max FROM t JOIN t b USING (query) WHERE b.method = 1 AND t.method <> 1 GROUP BY t.method")
def _(spark, d):
    return rounded(R.speed_up(calls(spark, d), 1, (43.2, 96.0), (544.0, 992.0)), "mean", "max", digits=5)


@query("q17_time_breakdown", f"WITH {CALLS} SELECT method, round(count(*) * 1.0, 4) AS sampling_s, round(sum(x1) * 1.838 / 1000, 4) AS proxy_s, round(sum(n1) * 78.0 / 1000, 4) AS oracle_s, round(count(*) * 1.0 + sum(x1) * 1.838 / 1000 + sum(n1) * 78.0 / 1000, 4) AS total_s FROM c GROUP BY method")
def _(spark, d):
    rows = calls(spark, d).select("method", F.lit(1).alias("queries"), F.col("x1").alias("proxy_calls"), F.col("n1").alias("oracle_calls"))
    return rounded(R.time_breakdown(rows), "sampling_s", "proxy_s", "oracle_s", "total_s", digits=4)


@query("q18_sparsity", "WITH a AS (SELECT l_linenumber AS method, greatest(0, round(l_quantity) - 25) AS answer FROM lineitem) SELECT method, count(*) AS n, round(avg(answer), 6) AS mean, quantile_cont(answer, 0.5) AS median, min(answer) AS min, max(answer) AS max, sum((answer = 0)::INT)::BIGINT AS zeros, round(sum((answer = 0)::INT) / count(*), 6) AS zero_share FROM a GROUP BY method")
def _(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_linenumber").alias("method"), F.greatest(F.lit(0.0), F.round("l_quantity") - 25).alias("answer"))
    return rounded(R.sparsity(rows, ["method"]), "mean", "zero_share")


@query("q19_accuracy", RES + " SELECT method, run, round(greatest(0, 1 - avg(rel)) * 100, 5) AS accuracy FROM r GROUP BY ALL")
def _(spark, d):
    return rounded(R.accuracy(results(spark, d), ["method", "run"]), "accuracy", digits=5)


@query("q20_larger_error", RES + ", w AS (SELECT query, avg(rel) FILTER (WHERE method = 1) AS a, avg(rel) FILTER (WHERE method = 2) AS b FROM r GROUP BY query) SELECT query, round(a, 6) AS a, round(b, 6) AS b FROM w WHERE a > b")
def _(spark, d):
    return rounded(R.larger_error(results(spark, d), 1, 2), "a", "b")
