"""Ordered computations that do not pass through one partition."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from motifcast.functions.frames import checkpointed
from motifcast.functions.random import prn_bits, prn_sql


def running(df: DataFrame, order: list[str], value: str, out: str, by: list[str] | None = None, buckets: int = 1024) -> DataFrame:
    """``out`` = sum of ``value`` up to and including the row, in ``order`` (first column numeric in [0, 1)), within ``by``.

    The first order column is cut into buckets of equal width: sums run within a bucket, and the buckets' totals (at most
    ``buckets`` per group) are summed apart and joined back. No window spans more than one bucket.
    """
    by = by or []
    cut = df.withColumn("_b", F.floor(F.col(order[0]) * buckets).cast("int"))
    totals = cut.groupBy(*by, "_b").agg(F.sum(value).alias("_t"))
    before = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.withColumn("_o", F.coalesce(F.sum("_t").over(before), F.lit(0))).drop("_t")
    within = Window.partitionBy(*by, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return cut.withColumn("_s", F.sum(value).over(within)).join(F.broadcast(offsets) if not by else offsets, [*by, "_b"]).withColumn(out, F.col("_s") + F.col("_o")).drop("_b", "_s", "_o")


#: Rows of a group that one task orders; larger groups are cut into buckets of this size or the root of their own.
GROUP_ROWS, CHUNK_CELLS = 1024, 4096


def bucket_sql(unit: str, n: str) -> str:
    """The bucket of a unit in a group of ``n`` as DuckDB SQL."""
    return f"CASE WHEN {n} <= {GROUP_ROWS} THEN 0 ELSE {prn_sql(unit, 'bucket')} % CAST(ceil({n} / greatest({GROUP_ROWS}.0, sqrt({n}))) AS BIGINT) END"


def intervals(rows: DataFrame, by: list[str], unit: str, weight: str = "w", few: bool = False) -> DataFrame:
    """Adds ``total``, ``width``, ``lo`` and ``hi``: running sums of whole-number weights above 0 within ``by``, by bucket and unit.

    Buckets come from a hash of the unit. ``width`` is about the mean weight of the group. No window spans a group: one spans a
    bucket, one the sums of a group's buckets. ``few``: the groups are few by construction, so their sums are broadcast."""
    sizes = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), F.sum(weight).cast("long").alias("total"))
    several = F.col("_n") > GROUP_ROWS
    bucket = F.when(several, prn_bits(F.col(unit), "bucket") % F.ceil(F.col("_n") / F.greatest(F.lit(float(GROUP_ROWS)), F.sqrt("_n")))).otherwise(F.lit(0)).cast("long")
    cut = rows.join(F.broadcast(sizes) if few else sizes, by).withColumn("_b", bucket)
    before = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cut.where(several).groupBy(*by, "_b").agg(F.sum(weight).alias("_s")).withColumn("_o", F.sum("_s").over(before)).drop("_s")
    within = Window.partitionBy(*by, "_b").orderBy(unit).rowsBetween(Window.unboundedPreceding, 0)
    out = cut.withColumn("_w", F.sum(weight).over(within)).join(offsets, [*by, "_b"], "left").withColumn("hi", (F.col("_w") + F.coalesce("_o", F.lit(0))).cast("long"))
    return out.withColumn("lo", (F.col("hi") - F.col(weight)).cast("long")).withColumn("width", mean_width("total", "_n")).drop("_b", "_o", "_w", "_n")


def mean_width(total: str, n: str) -> Column:
    """Width of a group's cells: the mean weight, at least 1."""
    return F.greatest(F.lit(1).cast("long"), F.expr(f"{total} div {n}"))


def cells(intervals: DataFrame) -> DataFrame:
    """One row per interval and ``cell`` it lies in. A group has at most three rows per unit, so a draw, which falls into each
    cell with about the same chance, meets fewer than three on average, however uneven the weights are."""
    first, last = F.expr("lo div width"), F.expr("(hi - 1) div width")
    chunk = F.explode(F.sequence(F.expr(f"(lo div width) div {CHUNK_CELLS}"), F.expr(f"((hi - 1) div width) div {CHUNK_CELLS}")))
    rows = intervals.withColumns({"_first": first, "_last": last}).withColumn("_chunk", chunk)
    inner = F.explode(F.sequence(F.greatest(F.col("_first"), F.col("_chunk") * CHUNK_CELLS), F.least(F.col("_last"), F.col("_chunk") * CHUNK_CELLS + CHUNK_CELLS - 1)))
    return rows.withColumn("cell", inner).drop("_first", "_last", "_chunk", "width", "total")


def lookup(draws: DataFrame, cells: DataFrame, by: list[str], x: str = "x", width: str = "width") -> DataFrame:
    """Each draw with the interval of its group that holds its ``x``: an equi-join on the cell and a filter. The draw brings ``x``
    (below the group's total) and the group's ``width``."""
    at = draws.withColumn("cell", F.expr(f"{x} div {width}"))
    return at.join(cells, [*by, "cell"]).where((F.col("lo") <= F.col(x)) & (F.col(x) < F.col("hi"))).drop("cell", "lo", "hi")


#: A table of so few values is ordered by one task per group; a larger one by counts of values between approximate bounds.
DIRECT_ROWS, ACCURACY = 100_000, 10_000


def quantiles(rows: DataFrame, value: Column | str, shares: list[float], by: list[str] | None = None, out: str = "q") -> DataFrame:
    """(by..., out): the array of exact quantiles of each group, linear between neighbours, as ``percentile`` has them.

    Values are counted. If they are many, each quantile gets bounds from a mergeable sketch, whose rank error is known; one more
    pass counts what lies below them and, by distinct value, between them. So a task orders about twice the root of the number of
    rows at most, not a group. Null values do not count; groups of nulls alone have no row; null keys are a group."""
    by = by or []
    value = F.col(value) if isinstance(value, str) else value
    group = F.struct(*by) if by else F.struct(F.lit(0).alias("_all"))
    rows = checkpointed(rows.select(group.alias("_g"), value.cast("double").alias("_v")).where(F.col("_v").isNotNull()))
    n, names = rows.count(), ([f"_g.{c}" for c in by])
    if n <= DIRECT_ROWS:
        return rows.groupBy("_g").agg(F.percentile("_v", F.array(*map(F.lit, shares))).alias(out)).select(*names, out)
    accuracy = max(ACCURACY, math.isqrt(n))
    wide = 2.0 / accuracy
    bound = lambda end, far: F.percentile_approx("_v", F.array(*[F.lit(min(1.0, max(0.0, s + end))) for s in shares]), accuracy).alias(far)
    # Kept: a sketch hangs on the order its parts are merged in, so made again it may give other bounds to the second pass.
    bounds = checkpointed(rows.groupBy("_g").agg(F.count(F.lit(1)).alias("_n"), bound(-wide, "_low"), bound(wide, "_high")))
    placed = rows.join(bounds, "_g")
    small = F.col("_n") <= accuracy  # all values may lie between the bounds
    low = lambda t: F.when(small | F.lit(shares[t] <= wide), F.lit(-math.inf)).otherwise(F.get("_low", F.lit(t)))
    high = lambda t: F.when(small | F.lit(shares[t] >= 1 - wide), F.lit(math.inf)).otherwise(F.get("_high", F.lit(t)))
    which = range(len(shares))
    under = placed.groupBy("_g", "_n").agg(F.array(*[F.sum((F.col("_v") < low(t)).cast("long")) for t in which]).alias("_under"))
    here = F.filter(F.array(*[F.when((F.col("_v") >= low(t)) & (F.col("_v") <= high(t)), F.lit(t)) for t in which]), lambda t: t.isNotNull())
    inside = placed.select("_g", "_v", F.explode(here).alias("_t")).groupBy("_g", "_t", "_v").agg(F.count(F.lit(1)).alias("_c"))
    upto = Window.partitionBy("_g", "_t").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    counted = inside.withColumn("_upto", F.sum("_c").over(upto)).join(under, "_g").withColumn("_upto", F.col("_upto") + F.get("_under", F.col("_t")))
    at = F.get(F.array(*map(F.lit, shares)), F.col("_t")) * (F.col("_n") - 1)
    first = lambda rank: F.min(F.when(F.col("_upto") > rank, F.col("_v")))
    got = counted.withColumn("_at", at).groupBy("_g", "_t", "_at").agg(first(F.floor("_at")).alias("a"), first(F.ceil("_at")).alias("b"))
    q = F.when(F.col("a") == F.col("b"), F.col("a")).otherwise((F.ceil("_at") - F.col("_at")) * F.col("a") + (F.col("_at") - F.floor("_at")) * F.col("b"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("_t", q.alias("q")))), lambda x: x["q"])
    return got.groupBy("_g").agg(listed.alias(out)).select(*names, out)


def with_quantiles(groups: DataFrame, rows: DataFrame, value: Column | str, shares: list[float], by: list[str] | None = None, out: str = "q") -> DataFrame:
    """``groups``, one row per group of ``rows`` by ``by``, with the group's quantiles as ``out`` (null where it has no value)."""
    found = quantiles(rows, value, shares, by, out)
    if not by:
        return groups.join(F.broadcast(found), how="left")  # one row
    found = found.withColumnsRenamed({c: f"_q{c}" for c in by})
    same = [F.col(c).eqNullSafe(F.col(f"_q{c}")) for c in by]
    return groups.join(found, same, "left").drop(*[f"_q{c}" for c in by])


def running_by_range(rows: DataFrame, by: list[str], order: list[str], value: str, out: str) -> DataFrame:
    """``out`` = whole-number sum of ``value`` up to and including the row, in ``order`` within ``by``, for columns of any kind.

    Rows are dealt by range, so a task orders one range, whatever the groups' sizes; the sums of a group's ranges are added apart
    (one row per group and range). ``order`` should tell rows of a group apart."""
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = rows.repartitionByRange(parts, *by, *order).withColumn("_part", F.spark_partition_id())
    dealt = checkpointed(dealt)
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.groupBy(*by, "_part").agg(F.sum(value).alias("_s")).withColumn("_o", F.coalesce(F.sum("_s").over(before), F.lit(0))).drop("_s")
    offsets = offsets.withColumnsRenamed({c: f"_{c}" for c in [*by, "_part"]})
    within = Window.partitionBy(*by, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in [*by, "_part"]]
    summed = dealt.withColumn("_w", F.sum(value).over(within)).join(offsets, same)
    return summed.withColumn(out, (F.col("_w") + F.col("_o")).cast("long")).drop("_w", "_o", "_part", *[f"_{c}" for c in [*by, "_part"]])


def numbered(rows: DataFrame, by: list[str], order: list[str], out: str = "rank") -> DataFrame:
    """``out`` = place from 1 within ``by`` in ``order``, without gaps and without a window over a group."""
    return running_by_range(rows.withColumn("_one", F.lit(1)), by, order, "_one", out).drop("_one")
