"""Sources and sinks: graph texts, node tables, estimate blocks, configurations, answers, results and runs."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Lines ``v id label [degree]`` and ``e u v [elabel]`` -> vertices (vid, label), edges (src, dst, elabel) in both directions;
    a missing label is 0."""
    parts = spark.read.text(path).select(F.split(F.trim("value"), r"\s+").alias("p"))
    at = lambda i, kind="long": F.get("p", F.lit(i)).cast(kind)
    vertices = parts.where(F.col("p")[0] == "v").select(at(1).alias("vid"), F.coalesce(at(2, "int"), F.lit(0)).alias("label"))
    one = parts.where(F.col("p")[0] == "e").select(at(1).alias("src"), at(2).alias("dst"), F.coalesce(at(3, "int"), F.lit(0)).alias("elabel"))
    return vertices, one.unionByName(one.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "elabel"))


def graph_lines(vertices: DataFrame, links: DataFrame) -> DataFrame:
    """Canonical lines (kind, a, b, line): vertices by id, then edges by (u, v), each once with u < v."""
    n = vertices.agg(F.count(F.lit(1)).alias("n")).crossJoin(links.agg(F.count(F.lit(1)).alias("m")))
    t = n.select(F.lit(0).alias("kind"), F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"), F.concat_ws(" ", F.lit("t"), F.col("n").cast("string"), F.col("m").cast("string")).alias("line"))
    v = vertices.select(F.lit(1).alias("kind"), F.col("vid").alias("a"), F.lit(0).cast("long").alias("b"), F.concat_ws(" ", F.lit("v"), F.col("vid").cast("string"), F.col("label").cast("string"), F.col("degree").cast("string")).alias("line"))
    u, w = F.least("u", "v"), F.greatest("u", "v")
    e = links.select(F.lit(2).alias("kind"), u.alias("a"), w.alias("b"), F.concat_ws(" ", F.lit("e"), u.cast("string"), w.cast("string"), F.col("elabel").cast("string")).alias("line"))
    return t.unionByName(v).unionByName(e)


def write_graph(vertices: DataFrame, links: DataFrame, path: str) -> None:
    """A global sort by range partitions: part files in order are the text."""
    graph_lines(vertices, links).orderBy("kind", "a", "b").select("line").write.mode("overwrite").text(path)


def clean_name(name: str) -> str:
    return name.split(":")[0] or name.lstrip(":").split(":")[0].lower()


def read_nodes(spark: SparkSession, path: str) -> DataFrame:
    """All-string CSV with cleaned header names (``id:ID`` -> id, ``:LABEL`` -> label)."""
    df = spark.read.csv(path, header=True, inferSchema=False)
    return df.toDF(*[clean_name(c) for c in df.columns])


def ndjson_to_table(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    """NDJSON with the line separators U+2028 and U+2029 as spaces; fields by the given DDL, unreadable lines are null rows."""
    lines = spark.read.text(path, lineSep="\n").select(F.translate("value", "\u2028\u2029", "  ").alias("v")).where("trim(v) <> ''")
    return lines.select(F.from_json("v", ddl).alias("r")).select("r.*")


def parse_estimate_blocks(blocks: DataFrame) -> DataFrame:
    """(index, block) texts ``Query: name / All Est: x / id value ...`` -> (query_index, query, vid, est, all_est); bad numbers are null."""
    number = lambda s: F.regexp_replace(s, "[^0-9eE+.-]", "").try_cast("double")
    rows = blocks.withColumn("query", F.trim(F.regexp_extract("block", r"Query:\s*([^\n]*)", 1))).withColumn("all_est", number(F.regexp_extract("block", r"All Est:\s*([^\n]*)", 1)))
    lines = rows.where("query <> ''").select(F.col("index").alias("query_index"), "query", "all_est", F.explode(F.split("block", "\n")).alias("line"))
    parts = lines.withColumn("p", F.split(F.trim("line"), r"\s+")).where(F.col("p")[0].rlike(r"^\d+$") & (F.size("p") == 2))
    return parts.select("query_index", "query", F.col("p")[0].cast("long").alias("vid"), number(F.col("p")[1]).alias("est"), "all_est")


def read_estimate_blocks(spark: SparkSession, path: str, separator: str = "-----") -> DataFrame:
    blocks = spark.read.option("lineSep", separator).text(path).where("trim(value) <> ''").select(F.monotonically_increasing_id().alias("index"), F.col("value").alias("block"))
    return parse_estimate_blocks(blocks)


def parse_core_config(lines: DataFrame) -> DataFrame:
    """(json) ``{pattern: {label: [vertices]}}`` -> (pattern, label, q)."""
    m = lines.select(F.explode(F.from_json("json", "map<string,map<string,array<int>>>")).alias("pattern", "m"))
    return m.select("pattern", F.explode("m").alias("label", "qs")).select("pattern", F.col("label").cast("int").alias("label"), F.explode("qs").alias("q"))


def parse_core_labels(lines: DataFrame) -> DataFrame:
    """(value) ``pattern label [label]``; lines that begin with # are skipped -> (pattern, label)."""
    p = lines.where(~F.trim("value").startswith("#") & (F.trim("value") != "")).select(F.split(F.trim("value"), r"\s+").alias("p"))
    return p.select(F.col("p")[0].alias("pattern"), F.explode(F.slice("p", F.lit(2), F.size("p"))).alias("label")).select("pattern", F.col("label").cast("int").alias("label"))


def parse_answers(lines: DataFrame) -> DataFrame:
    """(value) ``name 12.3ms 456`` -> (pattern, elapsed_ms, cardinality)."""
    at = lambda i: F.regexp_extract("value", r"^(\S+)\s+([0-9.]+)ms\s+(-?\d+)", i)
    return lines.where(at(1) != "").select(at(1).alias("pattern"), at(2).cast("double").alias("elapsed_ms"), at(3).cast("long").alias("cardinality"))


def read_core_config(spark: SparkSession, path: str, whole: bool = False) -> DataFrame:
    """Files of one JSON object per line, or of one object each if ``whole`` -> (pattern, label, q)."""
    return parse_core_config(spark.read.text(path, wholetext=whole).withColumnRenamed("value", "json"))


def read_core_labels(spark: SparkSession, path: str) -> DataFrame:
    """A file of lines ``pattern label [label]`` -> (pattern, label)."""
    return parse_core_labels(spark.read.text(path))


def read_answers(spark: SparkSession, path: str) -> DataFrame:
    """A file of lines ``name 12.3ms 456`` -> (pattern, elapsed_ms, cardinality)."""
    return parse_answers(spark.read.text(path))


def summarize_results(results: DataFrame, by: list[str]) -> DataFrame:
    """(by..., queries, mean_error, mean_cost) of results with their error and oracle cost."""
    return results.groupBy(*by).agg(F.countDistinct("query").alias("queries"), F.avg("error").alias("mean_error"), F.avg("oracle_cost").alias("mean_cost"))


def split_by_pattern(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").partitionBy("pattern").parquet(path)


def result_error(est: Column, true: Column) -> Column:
    """Relative error; with truth 0 it is 1 if the estimate is above 0, else 0."""
    return F.when(true == 0, (est > 0).cast("double")).otherwise(F.abs(est - true) / true)


def with_results(rows: DataFrame, known: DataFrame) -> DataFrame:
    """Result rows with the known truth per query and their error; appended to a table by ``append_results``."""
    return rows.join(known.select("query", "t_true"), "query", "left").withColumn("error", result_error(F.col("t_hat"), F.col("t_true")))


def append_results(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def still_to_do(todo: DataFrame, done: DataFrame, key: list[str]) -> DataFrame:
    return todo.join(done.select(*key).distinct(), key, "left_anti")


def load_runs(spark: SparkSession, path: str, rename: dict[str, str] | None = None) -> DataFrame:
    """Run files as one table: the run id from the file name, missing query names filled from it, columns renamed."""
    df = spark.read.option("header", True).csv(path).withColumnsRenamed(rename or {"T_hat_mean": "T_hat"})
    file = F.element_at(F.split(F.input_file_name(), "/"), -1)
    df = df.withColumn("run", F.regexp_extract(file, r"(\d+)\D*$", 1).cast("int"))
    name = F.regexp_replace(file, r"_?\d+\D*$", "")
    return df.withColumn("query", F.coalesce("query", name) if "query" in df.columns else name)


def save_matches(todo: dict[str, DataFrame], path: str) -> DataFrame:
    """Save each pattern's matches with their columns, and return the summary (pattern, folder, n) of all that are saved.

    Patterns that the summary lists are skipped, so a run that was cut short goes on where it stopped. A pattern's rows go to a
    folder of their own, and count once its line in the summary is written; what a lost run left behind is never read. ``path`` must
    be in storage that all executors share."""
    spark = next(iter(todo.values())).sparkSession
    done = {r["pattern"] for r in saved_matches(spark, path).collect()}
    for name, rows in todo.items():
        if name not in done:
            folder = f"{path}/data/{name}-{uuid.uuid4()}"
            rows.write.parquet(folder)
            line = spark.read.parquet(folder).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("pattern"), F.lit(folder).alias("folder"), "n")
            line.coalesce(1).write.mode("append").parquet(f"{path}/summary")
    return saved_matches(spark, path)


def saved_matches(spark: SparkSession, path: str) -> DataFrame:
    """The summary of saved matches: (pattern, folder, n), the first line of each pattern."""
    try:
        lines = spark.read.schema("pattern string, folder string, n long").parquet(f"{path}/summary")
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], "pattern string, folder string, n long")
    return lines.groupBy("pattern").agg(F.min(F.struct("folder", "n")).alias("s")).select("pattern", "s.folder", "s.n")


def read_matches(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """A pattern's saved matches."""
    found = saved_matches(spark, path).where(F.col("pattern") == pattern).first()
    if found is None:
        raise KeyError(pattern)
    return spark.read.parquet(found["folder"])
