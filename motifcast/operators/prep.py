"""Table preparation: cleaning, filtering, counting and checking of user, post and comment tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from motifcast.functions.ordered import numbered, quantiles, running_by_range
from motifcast.functions.random import prn_bits


def clean_text(c: Column) -> Column:
    """Null is empty; line breaks and runs of spaces are one space; trimmed; other than ASCII is dropped."""
    ascii_only = F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), r"[\r\n]+", " "), r"[^\x00-\x7F]", "")
    return F.trim(F.regexp_replace(ascii_only, r"\s+", " "))


def drop_hashtags(df: DataFrame, column: str) -> DataFrame:
    """Hashtags removed, trimmed; rows left empty are dropped."""
    return df.withColumn(column, F.trim(F.regexp_replace(column, r"#\w+", ""))).where(F.col(column) != "")


def mask_tokens(c: Column) -> Column:
    """Words that begin with @ become @user, those that begin with http become http."""
    return F.array_join(F.transform(F.split(c, " ", -1), lambda w: F.when(w.startswith("@") & (F.length(w) > 1), "@user").when(w.startswith("http"), "http").otherwise(w)), " ")


def letters(c: Column) -> Column:
    return F.length(F.regexp_replace(c, "[^A-Za-z]", ""))


STOP_WORDS = ("the", "of", "and", "to", "in", "is", "that", "it", "for", "was", "with", "be")


def english_score(c: Column) -> Column:
    """Share of words that are English stop words."""
    words = F.filter(F.split(F.lower(c), r"[^a-z]+"), lambda w: w != "")
    return F.coalesce(F.try_divide(F.size(F.filter(words, lambda w: w.isin(*STOP_WORDS))), F.size(words)), F.lit(0.0))


def keep_language(df: DataFrame, text: str, lang: str | None = None, wanted: str = "en", least: float = 0.1) -> DataFrame:
    """Rows with at least two Latin letters that are of the wanted language by a column, or by the stop-word score."""
    ok = F.col(lang) == wanted if lang else english_score(F.col(text)) >= least
    return df.where((letters(F.col(text)) > 1) & ok)


def ordered_by_kind(df: DataFrame, kind: str, number: str, ties: list[str]) -> DataFrame:
    """``number`` cast (bad is 0) and ``place``: from 1 within each kind, largest number first, then by ``ties``."""
    cast = df.withColumn(number, F.coalesce(F.col(number).try_cast("long"), F.lit(0))).withColumn("_down", -F.col(number))
    return numbered(cast, [kind], ["_down", *ties], "place").drop("_down")


def split_by_kind(df: DataFrame, kind: str, number: str, ties: list[str], path: str) -> None:
    """One folder ``<kind>=<value>`` per kind, its rows in order of ``place`` over its files: one pass, whatever the number of kinds."""
    placed = ordered_by_kind(df, kind, number, ties)
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    placed.repartitionByRange(parts, kind, "place").sortWithinPartitions(kind, "place").write.mode("overwrite").partitionBy(kind).parquet(path)


def probable_rows(df: DataFrame, prob: str, above: float, label: str, value) -> DataFrame:
    """Rows with a probability above the cut (strictly) and the given label."""
    return df.where((F.col(prob) > above) & (F.col(label) == value))


def sorted_top(df: DataFrame, keys: list[str], ties: list[str], k: int | None = None) -> DataFrame:
    """Rows by several falling keys, then by ``ties``; the first k of them, if k is given."""
    rows = df.orderBy(*[F.desc(c) for c in keys], *ties)
    return rows if k is None else rows.limit(k)


def at_least(df: DataFrame, any_of: dict[str, int]) -> DataFrame:
    """Rows in which some column reaches its threshold."""
    return df.where(reduce(lambda a, b: a | b, [F.col(c) >= k for c, k in any_of.items()]))


def least_words(df: DataFrame, column: str, k: int) -> DataFrame:
    return df.where(F.size(F.filter(F.split(F.trim(F.col(column)), r"\s+"), lambda w: w != "")) >= k)


def with_key_in(df: DataFrame, key: str, other: DataFrame, other_key: str, complement: bool = False) -> DataFrame:
    return df.join(other.select(F.col(other_key).alias(key)).distinct(), key, "left_anti" if complement else "left_semi")


def pick_files(df: DataFrame, n: int, m: int, order: list[str], salt: str, folder: bool = False) -> DataFrame:
    """The first m rows, by ``order``, of each of n files picked at random (by a hash of the file's name, or of its folder's)."""
    rows = df.withColumn("_file", F.element_at(F.split(F.input_file_name(), "/"), -2 if folder else -1))
    picked = rows.select("_file").distinct().orderBy(prn_bits(F.col("_file"), salt), "_file").limit(n)
    kept = rows.join(F.broadcast(picked), "_file")
    return kept.withColumn("_r", F.row_number().over(Window.partitionBy("_file").orderBy(*order))).where(F.col("_r") <= m).drop("_file", "_r")


def child_counts(parents: DataFrame, key: str, children: DataFrame, foreign: str, out: str) -> DataFrame:
    """Number of children per parent, 0 for none."""
    n = children.groupBy(F.col(foreign).alias(key)).agg(F.count(F.lit(1)).alias(out))
    return parents.join(n, key, "left").withColumn(out, F.coalesce(out, F.lit(0)))


def append_tables(frames: list[DataFrame], fill) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames).fillna(fill)


def activity(users: DataFrame, posts: DataFrame, comments: DataFrame) -> DataFrame:
    """Users with their post and comment counts."""
    p, c = posts.groupBy(F.col("creator").alias("id")).agg(F.count(F.lit(1)).alias("posts")), comments.groupBy(F.col("creator").alias("id")).agg(F.count(F.lit(1)).alias("comments"))
    return users.join(p.join(c, "id", "full_outer"), "id", "left").fillna(0, ["posts", "comments"])


def value_counts(df: DataFrame, column: str, categories: list[str] | None = None) -> DataFrame:
    """(value, n); with categories: all of them, zero rows too, the rest as ``other``."""
    if categories is None:
        return df.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    listed = df.sparkSession.createDataFrame([(c,) for c in [*categories, "other"]], "value string")
    n = df.groupBy(F.when(F.col(column).isin(categories), F.col(column)).otherwise("other").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return listed.join(n, "value", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def threshold_grid(df: DataFrame, a: str, b: str, truth: str, thresholds: list[float]) -> DataFrame:
    """Precision, recall and F1 of (a > s and b > t) against ``truth`` on a grid of thresholds, in one pass over the rows.

    Rows are counted by how many thresholds each column exceeds; the grid sums these few counts."""
    above = lambda c: sum(((F.col(c) > t).cast("int") for t in thresholds), F.lit(0))
    cells = df.groupBy(above(a).alias("ka"), above(b).alias("kb")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(truth).cast("int")).alias("p"))
    grid = df.sparkSession.createDataFrame([(s, t, i, j) for i, s in enumerate(thresholds) for j, t in enumerate(thresholds)], "s double, t double, i int, j int")
    hit = (F.col("ka") > F.col("i")) & (F.col("kb") > F.col("j"))
    out = grid.crossJoin(F.broadcast(cells)).groupBy("s", "t").agg(F.sum(F.when(hit, F.col("p")).otherwise(0)).alias("tp"), F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("found"), F.sum("p").alias("real"))
    precision, recall = F.coalesce(F.try_divide("tp", "found"), F.lit(0.0)), F.coalesce(F.try_divide("tp", "real"), F.lit(0.0))
    out = out.select("s", "t", precision.alias("precision"), recall.alias("recall"))
    return out.withColumn("f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)))


def best_thresholds(grid: DataFrame, least: float) -> DataFrame:
    """(rule, s, t): best by F1, by precision with enough recall, by recall with enough precision."""
    first = lambda rule, df, by: df.orderBy(*by, "s", "t").limit(1).select(F.lit(rule).alias("rule"), "s", "t")
    return first("f1", grid, [F.desc("f1")]).unionByName(first("precision", grid.where(F.col("recall") >= least), [F.desc("precision")])).unionByName(first("recall", grid.where(F.col("precision") >= least), [F.desc("recall")]))


def histogram(df: DataFrame, value: str, edges: list[float]) -> DataFrame:
    """(bin, n, percent) on right-closed bins, the lowest edge included, empty bins kept."""
    v = F.col(value)
    number = F.when(v == edges[0], 0).otherwise(sum(((v > e).cast("int") for e in edges), F.lit(0)) - 1)
    n = df.where((v >= edges[0]) & (v <= edges[-1])).groupBy(number.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    bins = df.sparkSession.range(len(edges) - 1).select(F.col("id").cast("int").alias("bin"))
    full = bins.join(F.broadcast(n), "bin", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return full.withColumn("percent", F.coalesce(F.try_divide(100 * F.col("n"), F.sum("n").over(Window.partitionBy())), F.lit(0.0)))


def column_tools(df: DataFrame, rename: dict | None = None, drop: list | None = None, lower: list | None = None, values: dict[str, dict] | None = None, equal: dict | None = None, keep: list | None = None) -> DataFrame:
    df = df.withColumnsRenamed(rename or {}).drop(*(drop or []))
    for c in lower or []:
        df = df.withColumn(c, F.lower(c))
    for c, table in (values or {}).items():
        df = df.withColumn(c, F.coalesce(F.create_map(*[F.lit(x) for p in table.items() for x in p])[F.col(c)], F.col(c)))
    for c, v in (equal or {}).items():
        df = df.where(F.col(c) == v)
    return df.select(*keep) if keep else df


def order_by_labels(df: DataFrame, label: str, order: list[str], then: str, ties: list[str] | None = None) -> DataFrame:
    place = F.array_position(F.array(*map(F.lit, order)), F.col(label))
    return df.orderBy(F.when(place > 0, place).otherwise(len(order) + 1), F.desc(then), *(ties or []))


def overwrite(df: DataFrame, other: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """The columns' values from the other table by key; missing is null."""
    return df.drop(*columns).join(other.select(key, *columns), key, "left")


def flip(prob: Column, label: Column, value) -> Column:
    return F.when(label == value, 1 - prob).otherwise(prob)


def reference_check(users: DataFrame, posts: DataFrame, comments: DataFrame) -> DataFrame:
    """(check, n, percent): comments by which of user and post exist; posts without user; users without activity."""
    u, p = users.select(F.col("id").alias("creator"), F.lit(True).alias("_u")), posts.select(F.col("id").alias("post"), F.lit(True).alias("_p"))
    state = F.when(F.col("_u") & F.col("_p"), "comment ok").when(F.col("_p"), "comment without user").when(F.col("_u"), "comment without post").otherwise("comment without both")
    a = comments.join(u, "creator", "left").join(p, "post", "left").groupBy(state.alias("check")).agg(F.count(F.lit(1)).alias("n")).withColumn("percent", 100 * F.col("n") / F.sum("n").over(Window.partitionBy()))
    lost = with_key_in(posts, "creator", users, "id", complement=True).agg(F.count(F.lit(1)).alias("n")).crossJoin(posts.agg(F.count(F.lit(1)).alias("of"))).select(F.lit("post without user").alias("check"), "n", "of")
    active = posts.select("creator").unionByName(comments.select("creator"))
    idle = with_key_in(users, "id", active, "creator", complement=True).agg(F.count(F.lit(1)).alias("n")).crossJoin(users.agg(F.count(F.lit(1)).alias("of"))).select(F.lit("user without activity").alias("check"), "n", "of")
    return a.unionByName(lost.unionByName(idle).select("check", "n", F.coalesce(F.try_divide(100 * F.col("n"), F.col("of")), F.lit(0.0)).alias("percent")))


def trim_cascade(users: DataFrame, posts: DataFrame, comments: DataFrame, k: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Posts with at least k comments, their comments, and the comments' users."""
    posts = with_key_in(posts, "id", comments.groupBy("post").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= k), "post")
    comments = with_key_in(comments, "post", posts, "id")
    return with_key_in(users, "id", comments, "creator"), posts, comments


def count_at_least(df: DataFrame, value: str, thresholds: list[int]) -> DataFrame:
    sums = df.agg(F.array(*[F.struct(F.lit(t).alias("threshold"), F.coalesce(F.sum((F.col(value) >= t).cast("long")), F.lit(0)).alias("n")) for t in thresholds]).alias("x"))
    return sums.select(F.inline("x"))


def recover_parents(children: DataFrame, foreign: str, have: DataFrame, full: DataFrame, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """Parents that the children need but ``have`` lacks: found in ``full``, and keys that are still missing."""
    need = children.where(F.col(foreign).isNotNull()).select(F.col(foreign).alias(key)).distinct().join(have.select(key), key, "left_anti")
    return full.join(need, key, "left_semi"), need.join(full.select(key), key, "left_anti")


def with_body(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.trim(F.coalesce(column, F.lit(""))) != "")


def training_split(df: DataFrame, key: str, share: float, salt: str, positive: Column | None = None) -> DataFrame:
    """Adds ``train``: that share of the rows (of each class, if ``positive`` is given) with the smallest random numbers."""
    cls = F.lit(0) if positive is None else positive.cast("int")
    if positive is None:
        return df.withColumn("train", prn_bits(F.col(key), salt) < F.lit(int(share * (1 << 32))))
    df = df.withColumn("_c", cls).withColumn("_u", prn_bits(F.col(key), salt))
    # The class's exact quantile of the random numbers is the cut; no window ranks the rows.
    cut = quantiles(df, "_u", [share], ["_c"]).select("_c", F.col("q")[0].alias("_q"))
    return df.join(F.broadcast(cut), "_c").withColumn("train", F.col("_u") <= F.col("_q")).drop("_c", "_u", "_q")


def pair_features(a: Column, b: Column) -> Column:
    """[a, b, a*b, |a-b|] of two vectors."""
    return F.concat(a, b, F.zip_with(a, b, lambda x, y: x * y), F.zip_with(a, b, lambda x, y: F.abs(x - y)))


def train_proxy(df: DataFrame, features: str, prob: str, kind: str = "linear"):
    """A cheap proxy of the oracle's probability: ``linear`` regression, linear ``svm`` or ``mlp`` classifier; returns the model."""
    from pyspark.ml.classification import LinearSVC, MultilayerPerceptronClassifier
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.regression import LinearRegression

    rows = df.select(array_to_vector(F.col(features)).alias("features"), F.col(prob).alias("prob"), (F.col(prob) > 0.5).cast("double").alias("label"))
    if kind == "linear":
        return LinearRegression(labelCol="prob", regParam=1e-3).fit(rows)
    if kind == "svm":
        return LinearSVC(maxIter=20, regParam=1e-3).fit(rows)
    width = len(df.select(features).first()[0])
    return MultilayerPerceptronClassifier(layers=[width, 8, 2], maxIter=30, seed=7).fit(rows)


def auc(df: DataFrame, score: str, positive: Column) -> DataFrame:
    """(auc): the chance that a positive row scores above a negative one, ties counting half; null without both. Rows are counted by
    score, so ties are one row, and the negatives below each score are a running sum by ranges."""
    counts = df.groupBy(F.col(score).cast("double").alias("_x")).agg(F.sum(positive.cast("long")).alias("_p"), F.sum((~positive).cast("long")).alias("_n"))
    below = running_by_range(counts, [], ["_x"], "_n", "_upto")
    half = F.col("_p").cast("double") * (F.col("_upto") - F.col("_n") / 2)
    return below.agg(F.try_divide(F.sum(half), F.sum("_p").cast("double") * F.sum("_n")).alias("auc"))


def proxy_quality(scored: DataFrame, score: str, prob: str, cut: float) -> DataFrame:
    """(n, mse, auc, accuracy) of a proxy's scores against the oracle's probability; a row is called positive above ``cut``."""
    truth = F.col(prob) > 0.5
    sums = scored.agg(F.count(F.lit(1)).alias("n"), F.avg(F.pow(F.col(score) - F.col(prob), 2)).alias("mse"), F.avg(((F.col(score) > cut) == truth).cast("double")).alias("accuracy"))
    return sums.crossJoin(F.broadcast(auc(scored, score, truth)))  # one row each


def compare_proxies(train: DataFrame, test: DataFrame, features: str, prob: str, kinds: tuple[str, ...] = ("linear", "svm", "mlp")) -> DataFrame:
    """(model, n, mse, auc, accuracy) on ``test`` of proxies trained on ``train``. A linear model's score is its prediction, an SVM's its
    margin (no mse), an MLP's the probability of the positive class."""
    from pyspark.ml.functions import array_to_vector, vector_to_array

    from motifcast.functions.frames import checkpointed, union_all

    rows, out = test.withColumn("_f", array_to_vector(F.col(features))).select("_f", F.col(prob).alias("_prob")), []
    for kind in kinds:
        model = train_proxy(train, features, prob, kind)
        scored = model.transform(rows.withColumnRenamed("_f", "features"))
        value = F.col("prediction") if kind == "linear" else vector_to_array(F.col("rawPrediction" if kind == "svm" else "probability"))[1]
        scored = checkpointed(scored.select(value.alias("_score"), "_prob"))
        quality = proxy_quality(scored, "_score", "_prob", 0.0 if kind == "svm" else 0.5)
        out.append(quality.select(F.lit(kind).alias("model"), "n", (F.lit(None).cast("double") if kind == "svm" else F.col("mse")).alias("mse"), "auc", "accuracy"))
    return union_all(out)
