"""COUNT and SUM over all embeddings of a pattern without making them: sums of products, vertex by vertex.

Every pattern edge is a table of the data edges between its candidates, every summed vertex a table of its values. Each row weighs
a pair (n, s): embeddings and their sum. Pairs multiply as (n m, n t + m s) where embeddings of two parts are joined, and add up
where a vertex is eliminated. Leaves go first: one ``groupBy`` by their neighbour. On a tree no table ever gets larger than the
edges it came from; a cycle costs the pairs of neighbours of the vertex that opens it, the cheapest by the sizes of the tables.

Embeddings are injective: vertices of one label differ. Sums of products count maps that may meet, so those of the patterns in
which some of these vertices are one are taken away again (inclusion and exclusion over the partitions of each label's vertices;
each block of b vertices brings the factor (-1)^(b-1) (b-1)!). Vertices joined by an edge are never one.

Numbers are whole and exact; sums beyond 64 bits raise an error, or take ``number="decimal(38,0)"``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motifcast.functions.frames import checkpointed, union_all
from motifcast.operators.match import Pattern


def partitions(items: list[int]) -> Iterator[list[list[int]]]:
    """All partitions of the items into blocks."""
    if not items:
        yield []
        return
    first, rest = items[0], items[1:]
    for blocks in partitions(rest):
        yield [[first], *blocks]
        for k in range(len(blocks)):
            yield [*blocks[:k], [first, *blocks[k]], *blocks[k + 1 :]]


def quotients(pattern: Pattern) -> list[tuple[int, dict[int, int]]]:
    """(factor, representative of each vertex) of the patterns whose signed sums of products give the injective ones."""
    adjacent = {frozenset((a, b)) for a, b, _ in pattern.edges}
    out = [(1, {})]
    for label in sorted(set(pattern.labels)):
        mine = [q for q, x in enumerate(pattern.labels) if x == label]
        fit = [p for p in partitions(mine) if not any(frozenset((a, b)) in adjacent for block in p for a in block for b in block)]
        out = [(sign * math.prod((-1) ** (len(b) - 1) * math.factorial(len(b) - 1) for b in p), of | {q: min(b) for b in p for q in b}) for sign, of in out for p in fit]
    return out


@dataclass(frozen=True)
class _Table:
    """A table over pattern vertices ``on`` (columns u<q>) with weights n and, if ``sums``, s. ``plain``: n is 1 and not a column;
    ``optional``: values, where a vertex without a row has 0. ``rows`` and ``fan`` (rows per binding of a vertex) are estimates."""

    df: DataFrame
    on: tuple[int, ...]
    plain: bool = False
    sums: bool = False
    optional: bool = False
    rows: float = 0.0
    fan: dict[int, float] = field(default_factory=dict)

    def times(self, other: _Table) -> _Table:
        right = other.df.withColumnsRenamed({"n": "_n", "s": "_s"})
        df = self.df.join(right, [f"u{q}" for q in self.on if q in other.on], "left" if other.optional else "inner")
        n, m = F.lit(1) if self.plain else F.col("n"), F.lit(1) if other.plain else F.col("_n")
        parts = [n * F.coalesce("_s", F.lit(0)) if other.optional else n * F.col("_s")] if other.sums else []
        parts += [m * F.col("s")] if self.sums else []
        on, plain = tuple(dict.fromkeys((*self.on, *other.on))), self.plain and other.plain
        weights = ([] if plain else [(n * m).alias("n")]) + ([sum(parts[1:], parts[0]).alias("s")] if parts else [])
        return _Table(df.select(*[f"u{q}" for q in on], *weights), on, plain, bool(parts))

    def without(self, q: int, number: str) -> _Table:
        """Summed over vertex q."""
        left = tuple(x for x in self.on if x != q)
        sums = [(F.count(F.lit(1)) if self.plain else F.sum("n")).cast(number).alias("n")]
        if self.sums:
            sums.append(F.sum("s").cast(number).alias("s"))
        return _Table(self.df.groupBy(*[f"u{x}" for x in left]).agg(*sums), left, False, self.sums)


def _product(tables: list[_Table], over: int | None = None) -> _Table:
    """All tables joined: those of the vertex ``over`` first, so that it opens the cycle, and each to one it shares a vertex with."""
    rest = sorted(tables, key=lambda t: (t.optional, over is not None and over not in t.on, len(t.on), t.rows))
    first = rest.pop(0)
    while rest:
        t = next((t for t in rest if set(t.on) & set(first.on)), rest[0])
        rest.remove(t)
        first = first.times(t)
    return first


def _eliminated(tables: list[_Table], keep: int | None, number: str) -> _Table:
    """All tables multiplied and summed over every vertex but ``keep``."""
    while left := sorted({q for t in tables for q in t.on} - {keep}):

        def cost(q: int, tables: list[_Table] = tables) -> tuple:
            mine = sorted((t for t in tables if q in t.on), key=lambda t: t.rows)
            return len({x for t in mine for x in t.on} - {q}), mine[-1].rows * math.prod(t.fan.get(q, 1.0) for t in mine[:-1]), q

        q = min(left, key=cost)
        near = {x for t in tables if q in t.on for x in t.on} - {q}
        # Tables among the neighbours close the cycle, so there is less to sum.
        now = [t for t in tables if q in t.on or len(t.on) > 1 and set(t.on) <= near]
        tables = [t for t in tables if t not in now] + [_product(now, q).without(q, number)]
    return _product(tables)


def marginals(pattern: Pattern, between: DataFrame, values: DataFrame | None = None, columns: tuple[int, ...] = (), keep: int | None = None, number: str = "bigint") -> DataFrame:
    """(n, s), or (vid, n, s) for each data vertex that ``keep`` is bound to: embeddings, and the sum of ``values`` (vid, val) over
    the pattern vertices ``columns``. Without embeddings n is 0 and s null (no row with ``keep``). A missing value is 0.

    between: (edge, src, dst), the data edges between the candidates of each pattern edge; rows must not repeat."""
    between = between.where(F.col("src") != F.col("dst"))
    rows, fan = [0.0] * len(pattern.edges), [{}] * len(pattern.edges)
    if len(pattern.edges) >= len(pattern.labels):  # a cycle: which vertex opens it depends on the tables' sizes
        between = checkpointed(between)
        for r in between.groupBy("edge").agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("src").alias("a"), F.approx_count_distinct("dst").alias("b")).collect():
            a, b, _ = pattern.edges[r["edge"]]
            rows[r["edge"]], fan[r["edge"]] = float(r["n"]), {a: r["n"] / r["a"], b: r["n"] / r["b"]}
    known = None if values is None else values.select("vid", F.col("val").cast(number).alias("s"))
    answers = []
    for sign, rep in quotients(pattern):
        kept, tables = None if keep is None else rep[keep], []
        for i, (a, b, _) in enumerate(pattern.edges):
            edge = between.where(F.col("edge") == i).select(F.col("src").alias(f"u{rep[a]}"), F.col("dst").alias(f"u{rep[b]}"))
            tables.append(_Table(edge, (rep[a], rep[b]), plain=True, rows=rows[i], fan={rep[q]: x for q, x in fan[i].items()}))
        tables += [_Table(known.withColumnRenamed("vid", f"u{rep[q]}"), (rep[q],), plain=True, sums=True, optional=True) for q in columns]
        got = _eliminated(tables, kept, number)
        n, s = F.lit(1) if got.plain else F.col("n"), F.col("s") if got.sums else F.lit(None)
        answers.append(got.df.select(*([] if kept is None else [F.col(f"u{kept}").alias("vid")]), (sign * n).cast(number).alias("n"), (sign * s).cast(number).alias("s")))
    if keep is not None:
        out = union_all(answers)
        return (out if len(answers) == 1 else out.groupBy("vid").agg(F.sum("n").cast(number).alias("n"), F.sum("s").cast(number).alias("s"))).where("n != 0")
    return union_all(answers).agg(F.coalesce(F.sum("n"), F.lit(0)).cast(number).alias("n"), F.sum("s").cast(number).alias("s"))
