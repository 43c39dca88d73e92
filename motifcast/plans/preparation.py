"""Queries: table preparation."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import functions as F

from motifcast.functions.frames import shared_folder
from motifcast.functions.random import prn_sql
from motifcast.operators import prep as D
from motifcast.sources.fixtures import SOCIAL_SQL, social_tables, table

QUERIES: dict = {}
ORACLE_SQL: dict = {}
S = "WITH " + SOCIAL_SQL


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


@query("d1_clean_text", r"SELECT doc_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '[\r\n]+', ' ', 'g'), '[^\x00-\x7F]', '', 'g'), '\s+', ' ', 'g'))) AS clean FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(D.clean_text(F.col("text"))).alias("clean"))


@query("d2_drop_hashtags", r"WITH x AS (SELECT event_id, trim(regexp_replace('#' || event_type || ' ' || CASE WHEN event_id % 3 = 0 THEN '' ELSE event_type END, '#\w+', '', 'g')) AS said FROM events) SELECT * FROM x WHERE said <> ''")
def _(spark, d):
    said = F.concat(F.lit("#"), "event_type", F.lit(" "), F.when(F.col("event_id") % 3 == 0, "").otherwise(F.col("event_type")))
    return D.drop_hashtags(table(spark, d, "events").select("event_id", said.alias("said")), "said")


@query("d3_mask_tokens", "SELECT page_id, CASE WHEN page_id % 2 = 0 THEN '@user ' ELSE '' END || 'sees http' AS said FROM pages")
def _(spark, d):
    return table(spark, d, "pages").select("page_id", D.mask_tokens(F.concat(F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("@u"), F.col("page_id").cast("string"), F.lit(" "))).otherwise(""), F.lit("sees "), "url")).alias("said"))


@query("d4_keep_language", "SELECT doc_id FROM documents WHERE length(regexp_replace(text, '[^A-Za-z]', '', 'g')) > 1 AND lang = 'en'")
def _(spark, d):
    return D.keep_language(table(spark, d, "documents"), "text", "lang").select("doc_id")


@query("d4_keep_language_by_score", "WITH w AS (SELECT doc_id, text, list_filter(regexp_split_to_array(lower(text), '[^a-z]+'), lambda x: x <> '') AS ws FROM documents) SELECT doc_id FROM w WHERE length(regexp_replace(text, '[^A-Za-z]', '', 'g')) > 1 AND len(list_filter(ws, lambda x: x IN ('the', 'of', 'and', 'to', 'in', 'is', 'that', 'it', 'for', 'was', 'with', 'be'))) / nullif(len(ws), 0) >= 0.1")
def _(spark, d):
    return D.keep_language(table(spark, d, "documents"), "text").select("doc_id")


@query("d5_split_by_kind", "SELECT event_id, kind, comments, row_number() OVER (PARTITION BY kind ORDER BY comments DESC, event_id) AS place FROM (SELECT event_id, event_type AS kind, coalesce(try_cast(CASE WHEN event_id % 7 = 0 THEN 'none' ELSE (event_id % 13)::VARCHAR END AS BIGINT), 0) AS comments FROM events)")
def _(spark, d):
    """Written by kind and read back; the places tell whether the order is kept."""
    rows = table(spark, d, "events").select("event_id", F.col("event_type").alias("kind"), F.when(F.col("event_id") % 7 == 0, "none").otherwise((F.col("event_id") % 13).cast("string")).alias("comments"))
    path = f"{shared_folder(spark)}/kinds-{uuid.uuid4()}"
    D.split_by_kind(rows, "kind", "comments", ["event_id"], path)
    return spark.read.parquet(path).select("event_id", F.col("kind").cast("string").alias("kind"), "comments", "place")


@query("d6_at_least", f"{S}, n AS (SELECT u.id, (SELECT count(*) FROM posts WHERE creator = u.id) AS posts, (SELECT count(*) FROM comments WHERE creator = u.id) AS comments FROM users u) SELECT * FROM n WHERE comments >= 70 OR posts >= 8")
def _(spark, d):
    return D.at_least(D.activity(*social_tables(spark, d)), {"comments": 70, "posts": 8})


@query("d6_least_words", r"SELECT doc_id FROM documents WHERE len(list_filter(regexp_split_to_array(trim(text), '\s+'), lambda x: x <> '')) >= 3")
def _(spark, d):
    return D.least_words(table(spark, d, "documents"), "text", 3).select("doc_id")


@query("d7_sorted_top", f"{S}, n AS (SELECT u.id, (SELECT count(*) FROM posts WHERE creator = u.id) AS posts, (SELECT count(*) FROM comments WHERE creator = u.id) AS comments FROM users u) SELECT * FROM n ORDER BY comments DESC, posts DESC, id LIMIT 20")
def _(spark, d):
    return D.sorted_top(D.activity(*social_tables(spark, d)), ["comments", "posts"], ["id"], 20)


@query("d8_key_in", f"{S} SELECT id, 'in' AS side FROM comments WHERE creator IN (SELECT id FROM users) UNION ALL SELECT id, 'out' FROM comments WHERE creator NOT IN (SELECT id FROM users)")
def _(spark, d):
    users, _, comments = social_tables(spark, d)
    return D.with_key_in(comments, "creator", users, "id").select("id", F.lit("in").alias("side")).unionByName(D.with_key_in(comments, "creator", users, "id", complement=True).select("id", F.lit("out").alias("side")))


@query("d9_pick_files", f"WITH p AS (SELECT lang FROM (SELECT DISTINCT lang FROM documents) ORDER BY {prn_sql("'lang=' || lang", 'files')}, lang LIMIT 2) SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS r FROM documents WHERE lang IN (SELECT lang FROM p)) WHERE r <= 50")
def _(spark, d):
    """The documents are written in folders by language; two of these are picked, and the first rows of each."""
    path = f"{shared_folder(spark)}/files-{uuid.uuid4()}"
    table(spark, d, "documents").select("doc_id", "lang").write.partitionBy("lang").parquet(path)
    return D.pick_files(spark.read.parquet(path), 2, 50, ["doc_id"], "files", folder=True).withColumn("lang", F.col("lang").cast("string"))


@query("d10_child_counts", f"{S} SELECT p.id, count(c.id) AS sub_comment FROM posts p LEFT JOIN comments c ON c.post = p.id GROUP BY p.id")
def _(spark, d):
    _, posts, comments = social_tables(spark, d)
    return D.child_counts(posts.select("id"), "id", comments, "post", "sub_comment")


@query("d11_append_tables", f"{S} SELECT id, creator, coalesce(kind, 'none') AS kind FROM (SELECT id, creator, NULL AS kind FROM posts UNION ALL SELECT id, creator, kind FROM comments)")
def _(spark, d):
    _, posts, comments = social_tables(spark, d)
    return D.append_tables([posts.select("id", "creator"), comments.select("id", "creator", "kind")], {"kind": "none"})


@query("d12_activity", f"{S} SELECT u.id, (SELECT count(*) FROM posts WHERE creator = u.id) AS posts, (SELECT count(*) FROM comments WHERE creator = u.id) AS comments FROM users u")
def _(spark, d):
    return D.activity(*social_tables(spark, d))


@query("d13_value_counts", "WITH k AS (SELECT CASE WHEN event_type IN ('click', 'error', 'never') THEN event_type ELSE 'other' END AS value FROM events) SELECT c.value, (SELECT count(*) FROM k WHERE k.value = c.value) AS n FROM (VALUES ('click'), ('error'), ('never'), ('other')) c(value)")
def _(spark, d):
    return D.value_counts(table(spark, d, "events"), "event_type", ["click", "error", "never"])


GRID = [0.1, 0.3, 0.5, 0.7, 0.9]
GRID_SQL = f"""WITH x AS (SELECT {prn_sql("doc_id", "a")} / 4294967296.0 AS a, {prn_sql("doc_id", "b")} / 4294967296.0 AS b, toxic = 1 AS y FROM labels),
t(v) AS (VALUES (0.1), (0.3), (0.5), (0.7), (0.9)), g AS (SELECT s.v::DOUBLE AS s, t.v::DOUBLE AS t FROM t s, t),
n AS (SELECT s, t, (SELECT count(*) FROM x WHERE a > s AND b > t AND y) AS tp, (SELECT count(*) FROM x WHERE a > s AND b > t) AS f, (SELECT count(*) FROM x WHERE y) AS r FROM g),
pr AS (SELECT s, t, coalesce(tp / nullif(f, 0), 0) AS precision, coalesce(tp / nullif(r, 0), 0) AS recall FROM n),
fin AS (SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1 FROM pr)"""


def grid(spark, d):
    from motifcast.functions.random import prn

    rows = table(spark, d, "labels").select(prn(F.col("doc_id"), "a").alias("a"), prn(F.col("doc_id"), "b").alias("b"), (F.col("toxic") == 1).alias("y"))
    return D.threshold_grid(rows, "a", "b", "y", GRID)


@query("d14_threshold_grid", GRID_SQL + " SELECT s, t, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM fin")
def _(spark, d):
    return grid(spark, d).withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1")})


@query("d14_best_thresholds", GRID_SQL + " SELECT * FROM (SELECT 'f1' AS rule, s, t FROM fin ORDER BY f1 DESC, s, t LIMIT 1) UNION ALL SELECT * FROM (SELECT 'precision', s, t FROM fin WHERE recall >= 0.1 ORDER BY precision DESC, s, t LIMIT 1) UNION ALL SELECT * FROM (SELECT 'recall', s, t FROM fin WHERE precision >= 0.1 ORDER BY recall DESC, s, t LIMIT 1)")
def _(spark, d):
    return D.best_thresholds(grid(spark, d), 0.1)


@query("d15_histogram", "WITH e(i, lo, hi) AS (VALUES (0, 0, 10), (1, 10, 20), (2, 20, 30), (3, 30, 45), (4, 45, 60)), n AS (SELECT i, (SELECT count(*) FROM lineitem WHERE (l_quantity > lo AND l_quantity <= hi) OR (i = 0 AND l_quantity = lo)) AS n FROM e) SELECT i AS bin, n, round(100 * n / sum(n) OVER (), 6) AS percent FROM n")
def _(spark, d):
    return D.histogram(table(spark, d, "lineitem"), "l_quantity", [0.0, 10.0, 20.0, 30.0, 45.0, 60.0]).withColumn("percent", F.round("percent", 6))


@query("d16_column_tools", "SELECT event_id AS id, CASE event_type WHEN 'click' THEN 'tap' ELSE lower(event_type) END AS kind FROM events WHERE user_id = 7")
def _(spark, d):
    return D.column_tools(table(spark, d, "events"), rename={"event_id": "id", "event_type": "kind"}, drop=["props"], lower=["kind"], values={"kind": {"click": "tap"}}, equal={"user_id": 7}, keep=["id", "kind"])


@query("d17_order_by_labels", "SELECT event_id, event_type, value FROM events ORDER BY CASE event_type WHEN 'error' THEN 1 WHEN 'click' THEN 2 ELSE 3 END, value DESC, event_id LIMIT 10")
def _(spark, d):
    rows = table(spark, d, "events").select("event_id", "event_type", "value")
    return D.order_by_labels(rows, "event_type", ["error", "click"], "value", ["event_id"]).limit(10)


@query("d18_overwrite", "SELECT d.doc_id, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id)")
def _(spark, d):
    return D.overwrite(table(spark, d, "documents").select("doc_id", F.lit(9).alias("toxic")), table(spark, d, "labels"), "doc_id", ["toxic"])


@query("d19_flip", "SELECT event_id, round(CASE WHEN event_type = 'error' THEN 1 - value ELSE value END, 6) AS p FROM events")
def _(spark, d):
    return table(spark, d, "events").select("event_id", F.round(D.flip(F.col("value"), F.col("event_type"), "error"), 6).alias("p"))


@query("d20_user_function", "SELECT doc_id, length(text)::BIGINT * 2 AS n FROM documents")
def _(spark, d):
    @F.pandas_udf("long")
    def twice_length(s: pd.Series) -> pd.Series:
        return s.str.len() * 2

    return table(spark, d, "documents").select("doc_id", twice_length("text").alias("n"))


@query("d21_reference_check", f"""{S}, c AS (SELECT CASE WHEN creator IN (SELECT id FROM users) AND post IN (SELECT id FROM posts) THEN 'comment ok' WHEN post IN (SELECT id FROM posts) THEN 'comment without user' WHEN creator IN (SELECT id FROM users) THEN 'comment without post' ELSE 'comment without both' END AS "check" FROM comments)
SELECT "check", count(*) AS n, round(100 * count(*) / sum(count(*)) OVER (), 6) AS percent FROM c GROUP BY "check"
UNION ALL SELECT 'post without user', count(*) FILTER (WHERE creator NOT IN (SELECT id FROM users)), round(100 * count(*) FILTER (WHERE creator NOT IN (SELECT id FROM users)) / count(*), 6) FROM posts
UNION ALL SELECT 'user without activity', count(*) FILTER (WHERE id NOT IN (SELECT creator FROM posts) AND id NOT IN (SELECT creator FROM comments)), round(100 * count(*) FILTER (WHERE id NOT IN (SELECT creator FROM posts) AND id NOT IN (SELECT creator FROM comments)) / count(*), 6) FROM users""")
def _(spark, d):
    return D.reference_check(*social_tables(spark, d)).withColumn("percent", F.round("percent", 6))


@query("d22_trim_cascade", f"{S}, p AS (SELECT * FROM posts WHERE (SELECT count(*) FROM comments WHERE post = posts.id) >= 10), c AS (SELECT * FROM comments WHERE post IN (SELECT id FROM p)), u AS (SELECT * FROM users WHERE id IN (SELECT creator FROM c)) SELECT 'user' AS kind, id FROM u UNION ALL SELECT 'post', id FROM p UNION ALL SELECT 'comment', id FROM c")
def _(spark, d):
    parts = D.trim_cascade(*social_tables(spark, d), 10)
    out = None
    for kind, df in zip(("user", "post", "comment"), parts, strict=True):
        one = df.select(F.lit(kind).alias("kind"), "id")
        out = one if out is None else out.unionByName(one)
    return out


@query("d23_count_at_least", "SELECT t AS threshold, (SELECT count(*) FROM lineitem WHERE l_quantity >= t) AS n FROM (VALUES (1), (10), (25), (50)) x(t)")
def _(spark, d):
    return D.count_at_least(table(spark, d, "lineitem"), "l_quantity", [1, 10, 25, 50])


@query("d24_recover_parents", f"{S} SELECT 'found' AS state, id FROM comments WHERE id IN (SELECT parent FROM comments) AND kind <> 'click' AND id % 5 <> 0 UNION ALL SELECT DISTINCT 'missing', parent FROM comments WHERE parent IS NOT NULL AND parent NOT IN (SELECT id FROM comments WHERE kind = 'click') AND parent NOT IN (SELECT id FROM comments WHERE id % 5 <> 0)")
def _(spark, d):
    _, _, comments = social_tables(spark, d)
    found, missing = D.recover_parents(comments, "parent", comments.where("kind = 'click'").select("id"), comments.where("id % 5 <> 0"))
    return found.select(F.lit("found").alias("state"), "id").unionByName(missing.select(F.lit("missing").alias("state"), "id"))


@query("d25_with_body", "SELECT conv_id, turn FROM conversations WHERE trim(coalesce(text, '')) <> ''")
def _(spark, d):
    return D.with_body(table(spark, d, "conversations"), "text").select("conv_id", "turn")


@query("d26_probable_rows", "SELECT event_id FROM events WHERE value > 10 AND event_type = 'click'")
def _(spark, d):
    return D.probable_rows(table(spark, d, "events"), "value", 10, "event_type", "click").select("event_id")


@query("d27_training_split", f"SELECT doc_id, {prn_sql('doc_id', 'split')} < floor(0.8 * 4294967296)::BIGINT AS train FROM labels")
def _(spark, d):
    return D.training_split(table(spark, d, "labels").select("doc_id"), "doc_id", 0.8, "split")


@query("d27_stratified_split", f"WITH x AS (SELECT doc_id, toxic, {prn_sql('doc_id', 'split')} AS u FROM labels), q AS (SELECT toxic = 1 AS c, quantile_cont(u::DOUBLE, 0.8) AS q FROM x GROUP BY 1) SELECT doc_id, u <= q.q AS train FROM x JOIN q ON q.c = (toxic = 1)")
def _(spark, d):
    return D.training_split(table(spark, d, "labels").select("doc_id", "toxic"), "doc_id", 0.8, "split", F.col("toxic") == 1).select("doc_id", "train")


@query("d28_pair_features", "SELECT vec_id, round(list_sum(embedding)::DOUBLE + list_sum(list_reverse(embedding))::DOUBLE, 2) + 0.0 AS plain FROM embeddings")
def _(spark, d):
    v = F.transform("embedding", lambda x: x.cast("double"))
    f = D.pair_features(v, F.reverse(v))
    return table(spark, d, "embeddings").select("vec_id", (F.round(F.aggregate(F.slice(f, F.lit(1), 2 * F.size(v)), F.lit(0.0), lambda t, x: t + x), 2) + F.lit(0.0)).alias("plain"))


@query("d28_auc", "WITH x AS (SELECT round(embedding[1]::DOUBLE, 2) AS s, label % 2 = 0 AS pos FROM embeddings), c AS (SELECT s, sum(pos::INT) AS p, sum((NOT pos)::INT) AS n FROM x GROUP BY s) SELECT round(sum(p * (b - n / 2.0)) / (sum(p) * sum(n)), 9) AS auc FROM (SELECT *, sum(n) OVER (ORDER BY s) AS b FROM c)")
def _(spark, d):
    rows = table(spark, d, "embeddings").select(F.round(F.element_at("embedding", 1).cast("double"), 2).alias("s"), "label")
    return D.auc(rows, "s", F.col("label") % 2 == 0).select(F.round("auc", 9).alias("auc"))


@query("d28_train_proxy")
def _(spark, d):
    """All of the vectors; the oracle's probability depends on the label."""
    rows = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"), F.when(F.col("label") % 2 == 0, 0.8).otherwise(0.2).alias("prob"))
    rows = D.training_split(rows, "vec_id", 0.8, "train")
    return D.compare_proxies(rows.where("train"), rows.where("not train"), "v", "prob").withColumns({c: F.round(c, 4) for c in ("mse", "auc", "accuracy")})
