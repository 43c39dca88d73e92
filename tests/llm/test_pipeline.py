"""Each stage of the pipeline against its own input, and the SQL of the queries that have it."""

from __future__ import annotations

import random

import duckdb
import pytest

import corpus_pipeline
from motifcast.llm import registry
from tests.llm.test_operators import WORDS, say

TABLES = "documents pages benchmark labels conversations".split()


def test_stages_keep_columns_and_take_effect(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = docs
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, before, sf_dir)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns and out.dtypes == docs.dtypes
        out.write.parquet(str(tmp_path / str(k)))
        after = spark.read.parquet(str(tmp_path / str(k)))
        kept, had = {r[0] for r in after.select("doc_id").collect()}, {r[0] for r in before.select("doc_id").collect()}
        assert kept <= had and len(kept) >= 0.7 * len(had)
        if k == 4:
            assert kept == had
        before = after


def test_run_on_odd_documents_matches_brute_force(spark, tmp_path):
    """Null, empty, repeated and clashing rows through all stages; each stage's decision is known."""
    item = say(400, 20)
    block = "\n".join(say(k, 12) for k in range(6))
    texts = {1: say(1, 80), 2: say(1, 80), 3: " ".join([*say(1, 80).split()[:-2], "new", "end"]), 4: f"{say(4, 30)} {item}", 5: f"start\n{block}", 6: f"{block}\nlast line {say(6, 30)}", 7: None, 8: "", 9: say(9, 3)}
    rows = [(i, t, "en", "s", len(t or ""), "x") for i, t in texts.items()] + [(9, texts[9], "en", "s", len(texts[9]), "x")]
    rng = random.Random(5)
    labelled = [(100 + k, " ".join([*rng.choices(WORDS, k=30), *(["vile", "scum", "filthy"] if k % 4 == 0 else [])]), "en", "s", 0, "x") for k in range(80)]
    rows += labelled
    schema = "doc_id long, text string, lang string, source string, n_chars long, tie string"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, int((i - 100) % 4 == 0)) for i, *_ in labelled], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs, outs = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / f"out{k}"))
        docs = spark.read.parquet(str(tmp_path / f"out{k}"))
        outs.append(docs)
    clean = {i for i, *_ in labelled if (i - 100) % 4}
    ids = [{r[0] for r in o.select("doc_id").collect()} for o in outs]
    assert ids[0] == set(texts) | clean
    said = {r["doc_id"]: r["text"] for r in outs[1].collect()}
    assert ids[1] == ids[0] - {2} and said[6] == texts[6].removeprefix(block + "\n") and all(said[i] == texts[i] for i in texts if i not in (2, 6))
    assert ids[2] == ids[1] - {3} and ids[3] == ids[2] - {4} == ids[4]
    assert {r["n_chars"] for r in outs[1].where("doc_id = 6").collect()} == {len(said[6])}
    ran = corpus_pipeline.run(spark, str(tmp_path))
    assert ran.columns == outs[4].columns and sorted(map(repr, ran.collect())) == sorted(map(repr, outs[4].collect()))


def test_run_on_an_empty_table(spark, sf_dir, tmp_path):
    spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    for table in ("labels", "benchmark"):
        spark.read.parquet(f"{sf_dir}/{table}.parquet").write.parquet(str(tmp_path / f"{table}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_queries_match_sql(spark, sf_dir, name):
    db = duckdb.connect()
    for t in TABLES:
        db.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    sql = db.sql(registry.ORACLE_SQL[name])
    columns = sorted(sql.columns)
    want = sorted(map(repr, db.sql(f"select {', '.join(columns)} from ({registry.ORACLE_SQL[name]})").fetchall()))
    got = sorted(repr(tuple(r)) for r in registry.QUERIES[name](spark, sf_dir).select(*columns).collect())
    assert got == want
