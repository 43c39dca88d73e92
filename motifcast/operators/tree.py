"""Tree counting and sampling: weights of core bindings without enumerating all matches.

A spanning tree of the pattern is counted bottom-up (how many tree embeddings hang below each candidate), then sampled
top-down uniformly over tree embeddings; a sample is valid if it is injective and all pattern edges are there. Trials are rows;
their random numbers are portable (md5), so samples repeat under any partitioning.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from motifcast.functions.frames import among, checkpointed, union_all
from motifcast.functions.ordered import cells, intervals, lookup, mean_width
from motifcast.functions.random import below, prn
from motifcast.operators.match import Pattern


@dataclass(frozen=True)
class Tree:
    """Vertices in an order in which parents come first; parent[q] and the number of the pattern edge to it."""

    order: tuple[int, ...]
    parent: dict[int, int]
    edge: dict[int, int]

    def children(self, q: int) -> list[int]:
        return [c for c in self.order if self.parent.get(c) == q]


def densities(candidates: DataFrame, between: DataFrame) -> tuple[dict[int, int], dict[int, int]]:
    """Candidates per pattern vertex and candidate pairs per pattern edge (a few numbers)."""
    return ({r["q"]: r["n"] for r in candidates.groupBy("q").agg(F.count(F.lit(1)).alias("n")).collect()}, {r["edge"]: r["n"] for r in between.groupBy("edge").agg(F.count(F.lit(1)).alias("n")).collect()})


def choose_tree(pattern: Pattern, sizes: dict[int, int], pairs: dict[int, int], root: int | None = None, label: int | None = None) -> Tree:
    """Spanning tree of least density (pairs / product of sizes; ties by degree), rooted at the smallest candidate set, a given
    vertex, or the first vertex of a label."""
    if root is None:
        among = [q for q, x in enumerate(pattern.labels) if label is None or x == label]
        root = among[0] if label is not None else min(among, key=lambda q: (sizes.get(q, 0), q))
    weight = lambda i: pairs.get(i, 0) / max(1, sizes.get(pattern.edges[i][0], 0) * sizes.get(pattern.edges[i][1], 0)) - 1e-7 * (pattern.degree(pattern.edges[i][0]) + pattern.degree(pattern.edges[i][1]))
    order, parent, edge = [root], {}, {}
    while len(order) < len(pattern.labels):
        i = min((i for i, (a, b, _) in enumerate(pattern.edges) if (a in order) != (b in order)), key=lambda i: (weight(i), i))
        a, b, _ = pattern.edges[i]
        new, old = (b, a) if a in order else (a, b)
        order.append(new)
        parent[new], edge[new] = old, i
    return Tree(tuple(order), parent, edge)


def random_walk_tree(pattern: Pattern, seed: str, root: int = 0) -> Tree:
    """A spanning tree drawn uniformly: a random walk over the pattern's vertices (at most ten) from ``root``; the edge by which it
    first enters a vertex joins the tree. Its steps are hashed from the seed."""
    order, parent, edge, at = [root], {}, {}, root
    for step in itertools.count():
        if len(order) == len(pattern.labels):
            return Tree(tuple(order), parent, edge)
        mine = [i for i, (a, b, _) in enumerate(pattern.edges) if at in (a, b)]
        i = mine[int(hashlib.md5(f"{step}:{seed}".encode()).hexdigest()[:8], 16) % len(mine)]
        a, b, _ = pattern.edges[i]
        new = b if at == a else a
        if new not in order:
            order.append(new)
            parent[new], edge[new] = at, i
        at = new


def _down(pattern: Pattern, tree: Tree, between: DataFrame, q: int) -> DataFrame:
    """(up, vid): candidate edges from q's parent to q."""
    i = tree.edge[q]
    up, down = ("src", "dst") if pattern.edges[i][0] == tree.parent[q] else ("dst", "src")
    return between.where(F.col("edge") == i).select(F.col(up).alias("up"), F.col(down).alias("vid"))


def count_trees(pattern: Pattern, tree: Tree, candidates: DataFrame, between: DataFrame) -> dict[int, DataFrame]:
    """For each pattern vertex (vid, w, and t<c>, n<c> per child c): the tree embeddings of the subtree below it at that candidate,
    those below each child and the child's candidates there; w > 0 only. Whole numbers; beyond 64 bits Spark raises an error."""
    counts: dict[int, DataFrame] = {}
    for q in reversed(tree.order):
        mine = candidates.where(F.col("q") == q).select("vid", F.lit(1).cast("long").alias("w"))
        for child in tree.children(q):
            below_ = _down(pattern, tree, between, child).join(counts[child].select("vid", F.col("w").alias("cw")), "vid")
            sums = below_.groupBy(F.col("up").alias("vid")).agg(F.sum("cw").cast("long").alias(f"t{child}"), F.count(F.lit(1)).alias(f"n{child}"))
            mine = mine.join(sums, "vid").withColumn("w", F.col("w") * F.col(f"t{child}"))
        counts[q] = checkpointed(mine)
    return counts


def total_trees(tree: Tree, counts: dict[int, DataFrame]) -> float:
    return float(counts[tree.order[0]].agg(F.coalesce(F.sum("w"), F.lit(0))).first()[0])


class TreeSampler:
    """Draws tree embeddings uniformly. A candidate lies in cells of its parent's running sums, and a step of a trial is one equi-join
    on (parent, cell), which meets fewer than three rows on average, below a hub like elsewhere. Sums and cells are made for the
    drawn parents alone, so work beyond a pass over the candidate edges grows with the trials and not with the graph.

    With ``roots`` (vid) only trees below these are drawn."""

    def __init__(self, pattern: Pattern, tree: Tree, counts: dict[int, DataFrame], between: DataFrame, roots: DataFrame | None = None, check_edges: bool = True):
        self.pattern, self.tree, self.counts, self.between, self.check_edges = pattern, tree, counts, between, check_edges
        root = tree.order[0]
        top = counts[root] if roots is None else counts[root].join(roots, "vid", "left_semi")
        self.top = checkpointed(intervals(top.withColumn("all", F.lit(0)), ["all"], "vid", few=True))
        self.total = self.top.select("all", "total", "width").limit(1)
        self.known: dict[int, tuple[DataFrame, DataFrame]] = {}

    def _below(self, q: int, drawn: DataFrame) -> DataFrame:
        """Cells of q's candidates below the ``drawn`` candidates (up) of its parent; those made in earlier rounds are kept."""
        known = self.known.get(q)
        drawn = checkpointed(drawn if known is None else drawn.join(known[0], "up", "left_anti"))
        if known is None or not drawn.isEmpty():
            near = checkpointed(among(_down(self.pattern, self.tree, self.between, q), ["up"], drawn).join(drawn, "up", "left_semi"))
            steps = near.join(among(self.counts[q], ["vid"], near.select("vid")), "vid")
            made = checkpointed(cells(intervals(steps, ["up"], "vid")).withColumnsRenamed({"up": f"u{self.tree.parent[q]}", "vid": f"u{q}"}).drop("w"))
            self.known[q] = (drawn, made) if known is None else (known[0].unionByName(drawn), known[1].unionByName(made))
        return self.known[q][1]

    def draw(self, n: int, seed: str, first: int = 0) -> DataFrame:
        """Trials (trial, u0..uk, valid) with numbers from ``first`` on. A trial hangs on its number alone."""
        pattern, tree, root = self.pattern, self.tree, self.tree.order[0]
        number = lambda q: F.concat_ws("-", "trial", F.lit(q))
        out = self.between.sparkSession.range(first, first + n).withColumnRenamed("id", "trial").crossJoin(F.broadcast(self.total))  # one row
        out = checkpointed(out.withColumn("x", below(number(root), seed, F.col("total"))))
        met = among(cells(self.top), ["cell"], out.select(F.expr("x div width").alias("cell")))
        out = lookup(out, met.withColumnRenamed("vid", f"u{root}").drop("w"), ["all"]).drop("all", "total", "x", "width")
        for q in tree.order[1:]:
            out = checkpointed(out)  # read for its parents, and for the step
            step = out.withColumn("x", below(number(q), seed, F.col(f"t{q}"))).withColumn("width", mean_width(f"t{q}", f"n{q}")).drop(f"t{q}", f"n{q}")
            out = lookup(step, self._below(q, out.select(F.col(f"u{tree.parent[q]}").alias("up")).distinct()), [f"u{tree.parent[q]}"]).drop("x", "width")
        valid: Column = F.lit(True)
        for a in range(len(pattern.labels)):
            for b in range(a):
                if pattern.labels[a] == pattern.labels[b]:
                    valid = valid & (F.col(f"u{a}") != F.col(f"u{b}"))
        out = checkpointed(out.withColumn("valid", valid))
        if self.check_edges:
            for i, (a, b, _) in enumerate(pattern.edges):
                if i not in tree.edge.values():
                    there = self.between.where(F.col("edge") == i).select(F.col("src").alias(f"u{a}"), F.col("dst").alias(f"u{b}"), F.lit(True).alias("there"))
                    for c in (f"u{a}", f"u{b}"):
                        there = among(there, [c], out.select(c))
                    out = out.join(there, [f"u{a}", f"u{b}"], "left").withColumn("valid", F.col("valid") & F.coalesce("there", F.lit(False))).drop("there")
        return out.select("trial", *[f"u{q}" for q in range(len(pattern.labels))], "valid")


def sample_trees(pattern: Pattern, tree: Tree, counts: dict[int, DataFrame], between: DataFrame, n: int, seed: str, first: int = 0, roots: DataFrame | None = None, check_edges: bool = True) -> DataFrame:
    """Trials (trial, u0..uk, valid): tree embeddings drawn uniformly (see ``TreeSampler``)."""
    return TreeSampler(pattern, tree, counts, between, roots, check_edges).draw(n, seed, first)


def binomial_tail(s: int, n: int, p: float) -> float:
    """P(X >= s) for X ~ Binomial(n, p), by the continued fraction of the incomplete beta function."""
    if s <= 0:
        return 1.0
    if p <= 0 or s > n:
        return 0.0
    if p >= 1:
        return 1.0
    a, b = float(s), float(n - s + 1)
    if p > (a + 1) / (a + b + 2):
        return 1.0 - _beta(1 - p, b, a)
    return _beta(p, a, b)


def _beta(x: float, a: float, b: float) -> float:
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 400):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 + num * d, 1 + num / c
            d, c = 1 / (d if abs(d) > tiny else tiny), c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return front * h


def first_stop(trials: DataFrame, budget: int = 1000, every: int = 100, give_up: int = 50_000, least: int = 10) -> tuple[int, int, bool]:
    """(trials, successes, stopped): the first multiple of ``every`` from ``budget`` on where the exact 95 % bounds of the success
    rate are within [0.8, 1.25] of it, or ``give_up`` with at most ``least`` successes; else all trials, not stopped.

    Successes are counted per step of ``every`` trials; only these counts reach the driver."""
    steps = trials.groupBy(F.expr(f"trial div {every}L").alias("step")).agg(F.sum(F.col("valid").cast("int")).alias("s"), F.count(F.lit(1)).alias("n")).orderBy("step").collect()
    n = s = 0
    for step in steps:
        n, s = n + step["n"], s + step["s"]
        if n >= budget and s and n % every == 0:
            rate = s / n
            low_ok = binomial_tail(s, n, 0.8 * rate) < 0.025
            high_ok = 1.25 * rate >= 1 or 1 - binomial_tail(s + 1, n, 1.25 * rate) < 0.025
            if low_ok and high_ok:
                return n, s, True
        if n >= give_up and s <= least:
            return n, s, True
    return n, s, False


def stop_rule(trials: DataFrame, budget: int = 1000, every: int = 100, give_up: int = 50_000, least: int = 10) -> tuple[int, int]:
    """(trials, successes) at which sampling may stop (see ``first_stop``)."""
    return first_stop(trials, budget, every, give_up, least)[:2]


def draw_rounds(draw: Callable[[int, int], DataFrame], settled: Callable[[DataFrame], bool], at_once: int = 4000) -> DataFrame:
    """Trials of ``draw(first, n)`` in rounds that double, until ``settled``. A trial hangs on its number alone, so the size of a
    round does not change the result. Nothing is drawn twice; an empty space (no trial drawn) ends at once."""
    trials, n = checkpointed(draw(0, at_once)), at_once
    while not trials.isEmpty() and not settled(trials):
        trials, n = checkpointed(trials.unionByName(draw(n, n))), 2 * n
    return trials


def sample_until_stop(pattern: Pattern, tree: Tree, counts: dict[int, DataFrame], between: DataFrame, seed: str, at_once: int = 4000, **rule: int) -> DataFrame:
    """Trials drawn until the stop rule holds, cut at the trial where it does."""
    sampler = TreeSampler(pattern, tree, counts, between)
    trials = draw_rounds(lambda first, n: sampler.draw(n, seed, first), lambda t: first_stop(t, **rule)[2], at_once)
    return trials.where(F.col("trial") < first_stop(trials, **rule)[0])


def estimate_embeddings(pattern: Pattern, candidates: DataFrame, between: DataFrame, trials: DataFrame, total: float, keep: int = 2000, least: int = 10, seed: str = "grow") -> DataFrame:
    """(estimate, trials, successes, by): by the trials, or by expansion where at most ``least`` of them succeeded.

    Expansion then keeps ``keep`` partial embeddings per pattern vertex, fewer the more trials succeeded."""
    n, s = trials.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.col("valid").cast("long")), F.lit(0))).first()
    if s > least:
        return estimate_count(trials, total).withColumn("by", F.lit("trees"))
    grown = estimate_by_expansion(pattern, candidates, between, math.ceil(keep * len(pattern.labels) / math.sqrt(s + 1)), seed)
    return grown.select("estimate", F.lit(n).cast("long").alias("trials"), F.lit(s).cast("long").alias("successes"), F.lit("expansion").alias("by"))


def estimate_count(trials: DataFrame, total: float) -> DataFrame:
    """(estimate, trials, successes)."""
    return trials.agg(F.count(F.lit(1)).alias("trials"), F.coalesce(F.sum(F.col("valid").cast("long")), F.lit(0)).alias("successes")).select(F.coalesce(F.try_divide(F.col("successes") * F.lit(total), F.col("trials")), F.lit(0.0)).alias("estimate"), "trials", "successes")


def root_frequency(trials: DataFrame, root: int, total: float) -> DataFrame:
    """(vid, estimate) per sampled root; they add up to the estimate of the count."""
    n = trials.count()
    return trials.where("valid").groupBy(F.col(f"u{root}").alias("vid")).agg((F.count(F.lit(1)) * F.lit(total) / n).alias("estimate"))


def projection_weights(trials: DataFrame, core: tuple[int, ...], total: float, g: Column | None = None) -> DataFrame:
    """(instance, est_w): estimated weight of each sorted core binding; the weights add up to the estimate of the whole."""
    n = max(1, trials.count())
    instance = F.array_sort(F.array(*[F.col(f"u{q}") for q in core])).alias("instance")
    return trials.where("valid").groupBy(instance).agg((F.sum(F.lit(1) if g is None else g) * F.lit(total) / n).alias("est_w"))


def trial_accounts(trials: DataFrame, attrs: DataFrame, core: tuple[int, ...]) -> DataFrame:
    """(draw, valid, pass, cost, checks, spent): what each trial's oracle calls cost, and the running sum.

    A valid trial checks its core vertices in order until one fails; a vertex is paid when first checked."""
    from motifcast.functions.ordered import running
    from motifcast.operators.predicate import short_circuit

    checks = trials.where("valid").select(F.col("trial").alias("draw"), F.explode(F.array(*[F.struct(F.lit(i).alias("pos"), F.lit("core").alias("role"), F.col(f"u{q}").alias("vid")) for i, q in enumerate(core)])).alias("c")).select("draw", "c.*")
    checks = checks.join(attrs.select("vid", (F.col("prob") > 0.5).alias("pass")), "vid", "left").withColumn("pass", F.coalesce("pass", F.lit(False)))
    drawn, made = short_circuit(trials.select(F.col("trial").alias("draw"), "valid"), checks)
    cost = made.groupBy("draw").agg(F.sum(F.col("charged").cast("long")).alias("cost"), F.count(F.lit(1)).alias("checks"))
    each = drawn.join(cost, "draw", "left").fillna(0, ["cost", "checks"])
    top = each.agg(F.max("draw")).first()[0] or 0
    return checkpointed(running(each.withColumn("at", F.col("draw") / F.lit(top + 1.0)), ["at", "draw"], "cost", "spent"))


def _over(each: DataFrame, budgets: list[int], **rule: int) -> tuple[dict[int, int | None], int | None]:
    """First draw that each budget cannot pay, and the number of draws at which the stop rule holds for trials that are valid and
    pass (None: neither happened)."""
    firsts = each.agg(*[F.min(F.when(F.col("spent") > b, F.col("draw"))).alias(f"b{i}") for i, b in enumerate(budgets)]).first()
    n, _, stopped = first_stop(each.select(F.col("draw").alias("trial"), (F.col("valid") & F.coalesce("pass", F.lit(False))).alias("valid")), **rule)
    return {b: firsts[f"b{i}"] for i, b in enumerate(budgets)}, n if stopped else None


def paid_trials(trials: DataFrame, attrs: DataFrame, core: tuple[int, ...], budget: int, **rule: int) -> tuple[DataFrame, bool]:
    """Trials that count (draw, valid, pass, cost, checks), with the oracle inside the loop, and whether the run is over.

    The run is over before the first trial that ``budget`` new vertices cannot pay in full (that trial does not count), or where the
    stop rule holds for trials that are valid and pass, whichever comes first."""
    each = trial_accounts(trials, attrs, core)
    last, stop = _over(each, [budget], **rule)
    ends = [x for x in (last[budget], stop) if x is not None]
    return each.where(F.col("draw") < min(ends)) if ends else each, bool(ends)


def estimate_under_budget(trials: DataFrame, attrs: DataFrame, core: tuple[int, ...], total: float, budget: int, g: Column | None = None, **rule: int) -> DataFrame:
    """(estimate, trials, unique, calls, hits) of the trials that count within ``budget`` new vertices (see ``paid_trials``)."""
    kept = paid_trials(trials, attrs, core, budget, **rule)[0]
    if g is not None:
        kept = kept.join(trials.select(F.col("trial").alias("draw"), g.alias("g")), "draw")
    hit = F.when(F.col("valid") & F.col("pass"), F.col("g") if g is not None else F.lit(1)).otherwise(0)
    sums = kept.agg(F.count(F.lit(1)).alias("trials"), F.coalesce(F.sum(hit), F.lit(0)).alias("s"), F.coalesce(F.sum("cost"), F.lit(0)).alias("unique"), F.coalesce(F.sum("checks"), F.lit(0)).alias("calls"))
    return sums.select(F.coalesce(F.try_divide(F.col("s") * F.lit(total), F.col("trials")), F.lit(0.0)).alias("estimate"), "trials", "unique", "calls", (F.col("calls") - F.col("unique")).alias("hits"))


def sample_until_spent(pattern: Pattern, tree: Tree, counts: dict[int, DataFrame], between: DataFrame, attrs: DataFrame, core: tuple[int, ...], budget: int, seed: str, at_once: int = 4000, **rule: int) -> DataFrame:
    """Trials drawn until ``budget`` new vertices are spent or the stop rule holds."""
    sampler = TreeSampler(pattern, tree, counts, between)
    return draw_rounds(lambda first, n: sampler.draw(n, seed, first), lambda t: paid_trials(t, attrs, core, budget, **rule)[1], at_once)


def curve_budgets(fracs: tuple[float, ...], costs: dict[float, float], summary: float | None = None, default: int = 500) -> dict[float, int]:
    """Budget of each fraction: 1.2 times what the reference method paid there, else the ``summary`` value, else ``default``."""
    return {f: math.ceil(1.2 * costs[f]) if f in costs else math.ceil(summary) if summary is not None else default for f in fracs}


def estimate_by_expansion(pattern: Pattern, candidates: DataFrame, between: DataFrame, keep: int, seed: str) -> DataFrame:
    """(estimate): partial embeddings extended vertex by vertex; each partial keeps at most max(ceil(n/2), 4) of its n extensions
    at random and is weighted by n / kept; each level keeps at most ``keep`` partials, weighted likewise."""
    order = pattern.order()
    out = candidates.where(F.col("q") == order[0]).select(F.col("vid").alias(f"u{order[0]}"), F.lit(1.0).alias("weight"))
    out, done = _thin(out, keep, f"{seed}-{order[0]}", [f"u{order[0]}"]), [order[0]]
    at = {frozenset((a, b)): (i, a) for i, (a, b, _) in enumerate(pattern.edges)}

    def side(x: int, y: int) -> DataFrame:
        i, a = at[frozenset((x, y))]
        return between.where(F.col("edge") == i).select(F.col("src" if a == x else "dst").alias(f"u{x}"), F.col("dst" if a == x else "src").alias(f"u{y}"))

    for q in order[1:]:
        built = [f"u{x}" for x in done]
        near = [n for n, _ in pattern.near(q) if n in done]
        for n in near:
            out = out.join(side(n, q), [f"u{n}"] if n == near[0] else [f"u{n}", f"u{q}"])
        for n in done:
            if pattern.labels[n] == pattern.labels[q]:
                out = out.where(F.col(f"u{n}") != F.col(f"u{q}"))
        done.append(q)
        group = Window.partitionBy(*built)
        u = prn(F.concat_ws("-", *[f"u{x}" for x in done]), f"{seed}-{q}")
        n = F.count(F.lit(1)).over(group)
        out = out.withColumn("_n", n).withColumn("_k", F.greatest(F.ceil(F.col("_n") / 2), F.least(F.col("_n"), F.lit(4)))).withColumn("_r", F.row_number().over(group.orderBy(u)))
        out = out.where("_r <= _k").withColumn("weight", F.col("weight") * F.col("_n") / F.col("_k")).drop("_n", "_k", "_r")
        out = _thin(out, keep, f"{seed}-t{q}", [f"u{x}" for x in done])
    return out.agg(F.coalesce(F.sum("weight"), F.lit(0.0)).alias("estimate"))


def _thin(df: DataFrame, keep: int, seed: str, key: list[str]) -> DataFrame:
    """About ``keep`` rows by a hash of the row (Poisson sampling), weights divided by the rate: unbiased."""
    df = checkpointed(df)
    n = df.count()
    if n <= keep:
        return df
    return df.where(prn(F.concat_ws("-", *key), seed) < keep / n).withColumn("weight", F.col("weight") * (n / keep))


def estimate_containing(pattern: Pattern, tree: Tree, counts: dict[int, DataFrame], between: DataFrame, vertices: DataFrame, n: int, seed: str) -> DataFrame:
    """(vid, estimate): tree embeddings (injective) through each given root candidate; 0 if it is no candidate, -1 if no trial hit it."""
    root = tree.order[0]
    top = counts[root].join(vertices, "vid", "left_semi")
    trials = sample_trees(pattern, tree, counts, between, n, seed, roots=vertices, check_edges=False)
    found = trials.groupBy(F.col(f"u{root}").alias("vid")).agg(F.count(F.lit(1)).alias("hits"), F.sum(F.col("valid").cast("int")).alias("s"))
    out = vertices.join(top, "vid", "left").join(found, "vid", "left")
    return out.select("vid", F.when(F.col("w").isNull(), 0.0).when(F.col("hits").isNull(), -1.0).otherwise(F.col("w") * F.col("s") / F.col("hits")).alias("estimate"))


def budget_curve(trials: DataFrame, attrs: DataFrame, core: tuple[int, ...], total: float, budgets: dict[float, int], **rule: int) -> DataFrame:
    """(frac, estimate, trials, unique, calls, hits) for each budget, cut from one sample: the accounts of the trials are kept once, and
    each trial counts for the budgets whose end is after it."""
    each = trial_accounts(trials, attrs, core)
    lasts, stop = _over(each, sorted(set(budgets.values())), **rule)
    never = 1 << 62
    ends = [(float(f), min(never if x is None else x for x in (lasts[b], stop))) for f, b in budgets.items()]
    counted = F.explode(F.filter(F.array(*[F.struct(F.lit(f).alias("frac"), F.lit(end).alias("end")) for f, end in ends]), lambda x: F.col("draw") < x["end"]))
    kept = each.withColumn("b", counted).withColumn("frac", F.col("b.frac"))
    hit = F.when(F.col("valid") & F.col("pass"), 1).otherwise(0)
    sums = kept.groupBy("frac").agg(F.count(F.lit(1)).alias("trials"), F.sum(hit).alias("s"), F.sum("cost").alias("unique"), F.sum("checks").alias("calls"))
    wanted = trials.sparkSession.createDataFrame([(f,) for f, _ in ends], "frac double")
    out = wanted.join(sums, "frac", "left").fillna(0)
    return out.select("frac", F.coalesce(F.try_divide(F.col("s") * F.lit(total), F.col("trials")), F.lit(0.0)).alias("estimate"), "trials", "unique", "calls", (F.col("calls") - F.col("unique")).alias("hits"))
