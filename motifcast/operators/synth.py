"""Synthetic predicates: probability columns of given shape and rate, noisy proxies, and distances between columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from motifcast.functions.frames import checkpointed
from motifcast.functions.ordered import numbered, quantiles
from motifcast.functions.random import bits60, prn


def min_max(df: DataFrame, column: str, out: str) -> DataFrame:
    """Scaled to [0, 1]; a constant column is unchanged."""
    ends = df.agg(F.min(column).alias("_lo"), F.max(column).alias("_hi"))
    scaled = F.when(F.col("_hi") > F.col("_lo"), (F.col(column) - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))).otherwise(F.col(column))
    return df.crossJoin(F.broadcast(ends)).withColumn(out, scaled).drop("_lo", "_hi")


def positive_rate(df: DataFrame, column: str, rate: float, out: str, clip: float = 1e-6) -> DataFrame:
    """p to a power such that the given share of rows is above 0.5."""
    q = quantiles(df, column, [1 - rate]).select(F.greatest(F.least(F.col("q")[0], F.lit(1 - clip)), F.lit(clip)).alias("_q"))
    return df.crossJoin(F.broadcast(q)).withColumn(out, F.pow(F.col(column), F.log(F.lit(0.5)) / F.log("_q"))).drop("_q")


def normal(key: Column, salt: str) -> Column:
    """A standard normal number (Box-Muller on two portable numbers)."""
    u = F.greatest(prn(key, f"{salt}-1"), F.lit(2.0**-33))
    return F.sqrt(-2 * F.log(u)) * F.cos(2 * F.pi() * prn(key, f"{salt}-2"))


def f1(df: DataFrame, proxy: str, truth: str) -> DataFrame:
    """(f1, rate): of proxy > 0.5 against truth > 0.5, and the truth's positive rate."""
    p, t = F.col(proxy) > 0.5, F.col(truth) > 0.5
    tp, found, real = F.sum((p & t).cast("int")), F.sum(p.cast("int")), F.sum(t.cast("int"))
    return df.agg(F.coalesce(F.try_divide(2 * tp, found + real), F.lit(0.0)).alias("f1"), F.avg(t.cast("double")).alias("rate"))


def noisy_proxy(df: DataFrame, key: str, prob: str, lo: float, hi: float, out: str, salt: str = "noise", rounds: int = 200) -> DataFrame:
    """A proxy with noise on the logit scale whose F1 is within [lo, hi]: the deviation grows by 1.1 or shrinks by 0.9; the best is
    kept. Each round is one aggregate over the rows."""
    p = F.least(F.greatest(F.col(prob), F.lit(1e-6)), F.lit(1 - 1e-6))
    rows = checkpointed(df.withColumn("_l", F.log(p / (1 - p))).withColumn("_z", normal(F.col(key), salt)))
    at = lambda s: 1 / (1 + F.exp(-(F.col("_l") + s * F.col("_z"))))
    sigma, best = 1.0, (2.0, 1.0)
    for _ in range(rounds):
        got = f1(rows.withColumn("_p", at(sigma)), "_p", prob).first()["f1"]
        best = min(best, (abs(got - (lo + hi) / 2), sigma))
        if lo <= got <= hi:
            break
        sigma *= 1.1 if got > hi else 0.9
    return rows.withColumn(out, at(best[1])).drop("_l", "_z")


def draw(df: DataFrame, key: str, shape: str, out: str, salt: str = "draw") -> DataFrame:
    """A predicate column in [0, 1]: uniform, normal, skew (skew-normal from two normals), beta (2, 5 as order statistic), two_peak
    (see ``mixture`` for exact shares)."""
    k = F.col(key)
    u, z = prn(k, salt), normal(k, salt)
    clip = lambda x: F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))
    shapes = {
        "uniform": u,
        "normal": clip(0.5 + 0.15 * z),
        "skew": clip(0.3 + 0.2 * (0.95 * F.abs(z) + 0.31 * normal(k, f"{salt}-b"))),
        "beta": F.sort_array(F.array(*[prn(k, f"{salt}-{i}") for i in range(6)]))[1],  # the second of six uniforms is beta(2, 5)
        "two_peak": clip(F.when(prn(k, f"{salt}-side") < 0.5, 0.25).otherwise(0.75) + 0.08 * z),
    }
    return df.withColumn(out, shapes[shape])


def mixture(df: DataFrame, key: str, low: float, out: str, salt: str = "draw") -> DataFrame:
    """A predicate column of two parts with exact shares: round(``low`` N) rows uniform in [0, 0.5), the others in (0.5, 1]. The rows
    with the least random numbers, ties by key, are the low ones."""
    ranked = numbered(df.withColumn("_u", bits60(F.col(key), salt)), [], ["_u", key], "_r")
    quota = round(low * df.count())
    v = prn(F.col(key), f"{salt}-value")
    return ranked.withColumn(out, F.when(F.col("_r") <= quota, v / 2).otherwise(1 - v / 2)).drop("_u", "_r")


def distances(a: DataFrame, b: DataFrame, value: str) -> DataFrame:
    """(ks, wasserstein) of two samples of a column.

    Values are counted first, so the ordered window runs over distinct values in buckets of equal width."""
    from motifcast.functions.ordered import running

    n = a.agg(F.count(F.lit(1)).alias("na")).crossJoin(b.agg(F.count(F.lit(1)).alias("nb")))
    both = a.select(F.col(value).alias("v"), F.lit(1).alias("x"), F.lit(0).alias("y")).unionByName(b.select(F.col(value).alias("v"), F.lit(0).alias("x"), F.lit(1).alias("y")))
    counts = both.groupBy("v").agg(F.sum("x").alias("x"), F.sum("y").alias("y"))
    counts = checkpointed(min_max(counts, "v", "at").crossJoin(F.broadcast(n)).withColumn("d", F.col("x") / F.col("na") - F.col("y") / F.col("nb")).withColumn("at", F.col("at") * 0.999999))
    run = running(counts, ["at", "v"], "d", "gap")
    cell = F.floor(F.col("at") * 256)
    firsts = run.groupBy(cell.alias("cell")).agg(F.min("v").alias("v0"))
    nxt = firsts.withColumn("v1", F.lead("v0").over(Window.orderBy("cell"))).select("cell", "v1")  # at most 256 rows
    step = run.withColumn("cell", cell).withColumn("next", F.lead("v").over(Window.partitionBy("cell").orderBy("v"))).join(F.broadcast(nxt), "cell")
    width = F.coalesce("next", "v1") - F.col("v")
    return step.agg(F.max(F.abs("gap")).alias("ks"), F.coalesce(F.sum(F.abs("gap") * width), F.lit(0.0)).alias("wasserstein"))
