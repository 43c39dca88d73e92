"""Error and cost reports over result rows (query, method, run, budget fraction, truth, estimate, calls)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from motifcast.functions.ordered import quantiles, with_quantiles

EPS = 1e-9


def relative_error(est: Column, true: Column) -> Column:
    return F.abs(est - true) / (true + EPS)


def error_columns(df: DataFrame, est: str = "t_hat", true: str = "t_true") -> DataFrame:
    """Relative, symmetric, signed relative and signed-ratio errors; ratios have both sides floored at 1."""
    e, t = F.col(est), F.col(true)
    up, down = F.greatest(e, F.lit(1.0)), F.greatest(t, F.lit(1.0))
    signed = F.when(e >= t, up / down).otherwise(-down / up)
    return df.withColumns({"rel": relative_error(e, t), "sym": 2 * F.abs(e - t) / (e + t + EPS), "signed": (e - t) / (t + EPS), "ratio": signed, "log2_ratio": F.log2(up / down)})


def ratio_error(df: DataFrame, est: str = "t_hat", true: str = "t_true") -> DataFrame:
    """max(est, 1) / max(true, 1), its log10, and the symmetric log10 ratio."""
    r = F.greatest(F.col(est), F.lit(1.0)) / F.greatest(F.col(true), F.lit(1.0))
    return df.withColumns({"ratio": r, "log_ratio": F.log10(r), "sym_log_ratio": F.abs(F.log10(r))})


def spread(df: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    return df.groupBy(*(by or [])).agg(F.sum(value).alias("total"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))


def method_quantiles(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Mean, median, p90, p95 (linear) and max."""
    means = df.groupBy(*by).agg(F.avg(value).alias("mean"), F.max(value).alias("max"))
    return with_quantiles(means, df, value, [0.5, 0.9, 0.95], by).select(*by, "mean", F.col("q")[0].alias("median"), F.col("q")[1].alias("p90"), F.col("q")[2].alias("p95"), "max")


def cdf_points(df: DataFrame, value: str, by: str, lo: float = 0.0, hi: float = 1.0) -> DataFrame:
    """(by, value, share): share of the method's rows up to each distinct value, for values between two quantiles."""
    counts = df.groupBy(by, value).agg(F.count(F.lit(1)).alias("n"))
    up = Window.partitionBy(by).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    points = counts.withColumn("share", F.sum("n").over(up) / F.sum("n").over(Window.partitionBy(by))).drop("n")
    if (lo, hi) != (0.0, 1.0):
        cut = quantiles(df, value, [lo, hi], [by], "_q")
        points = points.join(F.broadcast(cut), by).where((F.col(value) >= F.col("_q")[0]) & (F.col(value) <= F.col("_q")[1])).drop("_q")
    return points


def mean_error_curve(df: DataFrame, truth: DataFrame, names: dict[str, str]) -> DataFrame:
    """(method, frac, error, n): mean relative error with methods renamed and truths joined; zero truths are dropped."""
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    rows = df.join(truth.select("query", "truth"), "query").where("truth <> 0").withColumn("method", F.coalesce(table[F.col("method").cast("string")], F.col("method").cast("string")))
    return rows.groupBy("method", "frac").agg(F.avg(relative_error(F.col("t_hat"), F.col("truth"))).alias("error"), F.count(F.lit(1)).alias("n"))


def common_queries(df: DataFrame) -> DataFrame:
    """Rows of the queries that every method has."""
    methods = df.select("method").distinct().count()
    full = df.groupBy("query").agg(F.countDistinct("method").alias("m")).where(F.col("m") == methods).select("query")
    return df.join(full, "query", "left_semi")


def ablation(df: DataFrame, order: list[str]) -> DataFrame:
    """(dataset, method, mean_pct, median_pct, place) of the listed methods, in that order."""
    place = F.array_position(F.array(*map(F.lit, order)), F.col("method").cast("string"))
    by, rows = ["dataset", "method", "place"], df.withColumn("place", place).where("place > 0")
    means = rows.groupBy(*by).agg((100 * F.avg("rel")).alias("mean_pct"))
    return with_quantiles(means, rows, "rel", [0.5], by).select(*by, "mean_pct", (100 * F.col("q")[0]).alias("median_pct"))


def iqr_bounds(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    q = quantiles(df, value, [0.25, 0.75, 0.9, 0.95], by)
    iqr = F.col("q")[1] - F.col("q")[0]
    return q.select(*by, iqr.alias("iqr"), (F.col("q")[0] - 1.5 * iqr).alias("lo"), (F.col("q")[1] + 1.5 * iqr).alias("hi"), F.col("q")[2].alias("q90"), F.col("q")[3].alias("q95"))


def outliers(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Per method: rows, rows outside 1.5 IQR, their share, IQR, q90 and q95."""
    bounds = iqr_bounds(df, value, by)
    out = F.sum(((F.col(value) < F.col("lo")) | (F.col(value) > F.col("hi"))).cast("int"))
    return df.join(F.broadcast(bounds), by).groupBy(*by, "iqr", "q90", "q95").agg(F.count(F.lit(1)).alias("n"), out.alias("outside")).withColumn("share", F.col("outside") / F.col("n"))


def robust_mean(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Mean without the rows outside 1.5 IQR; the plain mean of fewer than two rows."""
    n = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    kept = df.join(F.broadcast(iqr_bounds(df, value, by)), by).join(F.broadcast(n), by).where((F.col("_n") < 2) | F.col(value).between(F.col("lo"), F.col("hi")))
    return kept.groupBy(*by).agg(F.avg(value).alias("mean"))


def win_tie_loss(df: DataFrame, baseline: str, tie: float = 1e-12) -> DataFrame:
    """(method, win, tie, loss, improvement) against the baseline over (run, query): mean relative improvement of the error."""
    base = df.where(F.col("method") == baseline).select("run", "query", F.col("rel").alias("base"))
    both = df.where(F.col("method") != baseline).join(base, ["run", "query"])
    gap = F.col("rel") - F.col("base")
    return both.groupBy("method").agg(F.sum((gap < -tie).cast("int")).alias("win"), F.sum((F.abs(gap) <= tie).cast("int")).alias("tie"), F.sum((gap > tie).cast("int")).alias("loss"), F.avg(F.try_divide(-gap, F.col("base"))).alias("improvement"))


def repeat_failures(df: DataFrame, more_than: int) -> DataFrame:
    """(method, query, failing, error, place): queries with more failing runs (outside 1.5 IQR above) than given, worst first."""
    failing = df.join(F.broadcast(iqr_bounds(df, "rel", ["method"])), "method").where(F.col("rel") > F.col("hi"))
    per = failing.groupBy("method", "query").agg(F.countDistinct("run").alias("failing"), F.avg(F.abs("rel")).alias("error")).where(F.col("failing") > more_than)
    # Sums of one set of errors differ in their last bits with the order they are made in; 14 digits make them one, and the query decides.
    size = F.format_string("%.13e", F.col("error")).cast("double")
    return per.withColumn("place", F.row_number().over(Window.partitionBy("method").orderBy(F.desc(size), "query")))


def joint_failures(df: DataFrame, limit: float, rate: float = 0.5) -> DataFrame:
    """(query, methods, error): queries that fail (relative error above the limit) in at least that share of runs, in every method."""
    methods = df.select("method").distinct().count()
    per = df.groupBy("query", "method").agg(F.avg((F.col("rel") > limit).cast("double")).alias("rate"), F.avg("rel").alias("error")).where(F.col("rate") >= rate)
    return per.groupBy("query").agg(F.count(F.lit(1)).alias("methods"), F.avg("error").alias("error")).where(F.col("methods") == methods)


def zero_estimates(df: DataFrame) -> DataFrame:
    """(method, query, verdict): estimates of 0 are correct where the truth is 0, fatal elsewhere."""
    return df.where("t_hat = 0").select("method", "query", F.when(F.col("t_true") == 0, "correct").otherwise("fatal").alias("verdict")).dropDuplicates(["method", "query", "verdict"])


def worst(df: DataFrame, k: int, ties: list[str]) -> DataFrame:
    return df.withColumn("abs_error", F.abs(F.col("t_hat") - F.col("t_true"))).orderBy(F.desc("abs_error"), *ties).limit(k)


def median_signed(df: DataFrame, methods: list) -> DataFrame:
    """Median signed error by query type (the name's part before ``_``), one column per method."""
    kind = F.split("query", "_")[0].alias("kind")
    medians = quantiles(df.withColumn("kind", kind), "signed", [0.5], ["kind", "method"])
    return medians.groupBy("kind").pivot("method", methods).agg(F.first(F.col("q")[0]))


def speed_up(calls: DataFrame, baseline: str, oracle: tuple[float, float], proxy: tuple[float, float]) -> DataFrame:
    """(method, mean, max) of the baseline's time over the method's, from call counts n1, n2 (oracle) and x1, x2 (proxy) at
    given throughputs."""
    time = F.col("n1") / oracle[0] + F.col("n2") / oracle[1] + F.col("x1") / proxy[0] + F.col("x2") / proxy[1]
    timed = calls.withColumn("s", time)
    base = timed.where(F.col("method") == baseline).select("query", F.col("s").alias("base"))
    return timed.where(F.col("method") != baseline).join(base, "query").groupBy("method").agg(F.avg(F.try_divide("base", "s")).alias("mean"), F.max(F.try_divide("base", "s")).alias("max"))


def time_breakdown(calls: DataFrame, oracle_ms: float = 78.0, proxy_ms: float = 1.838, sampling_ms: float = 1000.0) -> DataFrame:
    """(method, sampling_s, proxy_s, oracle_s, total_s) from rows (method, queries, proxy_calls, oracle_calls)."""
    parts = {"sampling_s": F.sum("queries") * sampling_ms / 1000, "proxy_s": F.sum("proxy_calls") * proxy_ms / 1000, "oracle_s": F.sum("oracle_calls") * oracle_ms / 1000}
    out = calls.groupBy("method").agg(*[v.alias(k) for k, v in parts.items()])
    return out.withColumn("total_s", F.col("sampling_s") + F.col("proxy_s") + F.col("oracle_s"))


def sparsity(answers: DataFrame, by: list[str] | None = None) -> DataFrame:
    zero = F.sum((F.col("answer") == 0).cast("int"))
    counts = answers.groupBy(*(by or [])).agg(F.count(F.lit(1)).alias("n"), F.avg("answer").alias("mean"), F.min("answer").alias("min"), F.max("answer").alias("max"), zero.alias("zeros"), (zero / F.count(F.lit(1))).alias("zero_share"))
    return with_quantiles(counts, answers, "answer", [0.5], by).select(*(by or []), "n", "mean", F.col("q")[0].alias("median"), "min", "max", "zeros", "zero_share")


def accuracy(df: DataFrame, by: list[str]) -> DataFrame:
    return df.groupBy(*by).agg((F.greatest(F.lit(0.0), 1 - F.avg("rel")) * 100).alias("accuracy"))


def larger_error(df: DataFrame, a, b) -> DataFrame:
    """Queries in which method a has a larger mean error than method b."""
    wide = df.groupBy("query").pivot("method", [a, b]).agg(F.avg("rel"))
    return wide.select("query", F.col(str(a)).alias("a"), F.col(str(b)).alias("b")).where("a > b")
