"""Graphs and tables that the queries derive from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motifcast.functions.random import prn, prn_sql

CUSTOMER, ORDER, PART, SUPPLIER = range(4)
ROLES = ("customer", "order", "part", "supplier")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vid(key: str, label: int):
    return (F.col(key).cast("long") * 8 + label).cast("long")


def trade_links(spark: SparkSession, sf_dir: str, repeated: bool = False) -> DataFrame:
    """(u, v, elabel): each edge once, or as often as the tables have it if ``repeated``."""
    line, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    c, o, p, s = vid("o_custkey", CUSTOMER), vid("l_orderkey", ORDER), vid("l_partkey", PART), vid("l_suppkey", SUPPLIER)
    every = lambda t, u, v, k: t.select(u.alias("u"), v.alias("v"), F.lit(k).alias("elabel"))
    edge = every if repeated else (lambda *of: every(*of).distinct())
    return edge(orders, c, vid("o_orderkey", ORDER), 0).unionByName(edge(line, o, p, 1)).unionByName(edge(line, o, s, 2)).unionByName(edge(line, p, s, 3))


def trade_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vid, label, val): val in cents, 0 where the table has none."""
    one = lambda t, key, label, val: table(spark, sf_dir, t).select(vid(key, label).alias("vid"), F.lit(label).alias("label"), val.alias("val"))
    cents = lambda c: F.round(F.col(c) * 100).cast("long")
    none = F.lit(0).cast("long")
    return one("customer", "c_custkey", CUSTOMER, none).unionByName(one("orders", "o_orderkey", ORDER, cents("o_totalprice"))).unionByName(one("part", "p_partkey", PART, cents("p_retailprice"))).unionByName(one("supplier", "s_suppkey", SUPPLIER, none))


def attributes(vertices: DataFrame) -> DataFrame:
    """(vid, role, prob, proxy, val): the label's name, the oracle's probability, a cheap proxy of it, and the sum column."""
    prob = prn(F.col("vid"), "oracle")
    role = F.element_at(F.array(*map(F.lit, ROLES)), F.col("label") + 1)
    return vertices.select("vid", role.alias("role"), prob.alias("prob"), (0.7 * prob + 0.3 * prn(F.col("vid"), "proxy")).alias("proxy"), "val")


TRADE_SQL = f"""ue AS (
  SELECT o_custkey * 8 AS u, o_orderkey * 8 + 1 AS v, 0 AS elabel FROM orders
  UNION SELECT l_orderkey * 8 + 1, l_partkey * 8 + 2, 1 FROM lineitem
  UNION SELECT l_orderkey * 8 + 1, l_suppkey * 8 + 3, 2 FROM lineitem
  UNION SELECT l_partkey * 8 + 2, l_suppkey * 8 + 3, 3 FROM lineitem
), e AS (
  SELECT u AS src, v AS dst, elabel FROM ue UNION ALL SELECT v, u, elabel FROM ue
), v AS (
  SELECT c_custkey * 8 AS vid, 0 AS label, 0::BIGINT AS val FROM customer
  UNION ALL SELECT o_orderkey * 8 + 1, 1, round(o_totalprice * 100)::BIGINT FROM orders
  UNION ALL SELECT p_partkey * 8 + 2, 2, round(p_retailprice * 100)::BIGINT FROM part
  UNION ALL SELECT s_suppkey * 8 + 3, 3, 0 FROM supplier
), deg AS (
  SELECT src AS vid, count(*) AS degree FROM e GROUP BY src
), a AS (
  SELECT vid, label, val, {prn_sql("vid", "oracle")} / 4294967296.0 AS prob,
         0.7 * ({prn_sql("vid", "oracle")} / 4294967296.0) + 0.3 * ({prn_sql("vid", "proxy")} / 4294967296.0) AS proxy FROM v
)"""


def social_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Users, posts and comments with foreign keys; comments whose id is a multiple of 101 point nowhere."""
    events, docs = table(spark, sf_dir, "events"), table(spark, sf_dir, "documents")
    users = events.select(F.col("user_id").cast("long").alias("id")).where("id is not null").distinct()
    n_users, n_posts = users.count(), docs.count()
    posts = docs.select(F.col("doc_id").cast("long").alias("id"), (F.col("doc_id") % n_users).cast("long").alias("creator"), F.col("text").alias("body"))
    e = F.col("event_id").cast("long")
    lost = e % 101 == 0
    comments = events.select(
        e.alias("id"), F.when(lost, -1).otherwise(F.col("user_id")).cast("long").alias("creator"), F.when(lost, -1).otherwise(e % n_posts).cast("long").alias("post"),
        F.when((e % 3 == 0) & (e > 0), e - 1).alias("parent"), F.col("event_type").alias("kind"), F.col("value").cast("double").alias("value"),
    )
    return users, posts, comments


SOCIAL_SQL = """users AS (
  SELECT DISTINCT user_id::BIGINT AS id FROM events WHERE user_id IS NOT NULL
), posts AS (
  SELECT doc_id::BIGINT AS id, doc_id % (SELECT count(*) FROM users) AS creator, text AS body FROM documents
), comments AS (
  SELECT event_id::BIGINT AS id, CASE WHEN event_id % 101 = 0 THEN -1 ELSE user_id END::BIGINT AS creator,
         CASE WHEN event_id % 101 = 0 THEN -1 ELSE event_id % (SELECT count(*) FROM documents) END::BIGINT AS post,
         CASE WHEN event_id % 3 = 0 AND event_id > 0 THEN event_id - 1 END::BIGINT AS parent, event_type AS kind, value::DOUBLE AS value FROM events
)"""
